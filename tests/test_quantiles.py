import numpy as np
import pandas as pd

from trueline.operators.quantiles import exact_quantiles


def test_selection_matches_pandas_on_large_groups(spark):
    rng = np.random.default_rng(11)
    n = 3000
    vals = np.concatenate([rng.normal(size=n // 2), np.full(n // 3, 7.25), rng.integers(0, 40, n - n // 2 - n // 3)])
    rng.shuffle(vals)
    keys = np.where(np.arange(n) % 3 == 0, "a", "b")
    pdf = pd.DataFrame({"k": keys, "x": vals, "y": vals * 3 + 1.0})
    pdf.loc[::17, "y"] = None
    df = spark.createDataFrame(pdf)
    probs = [0.25, 0.5, 0.75, 0.999]
    # final_rows far below the group sizes forces histogram passes
    got = exact_quantiles(df, ["x", "y"], probs, ["k"], final_rows=40).collect()
    for r in got:
        expect = pdf[pdf.k == r.k][r.column].dropna().quantile(probs).to_numpy()
        assert np.allclose(r["values"], expect, rtol=0, atol=1e-12), (r.k, r.column)


def test_small_groups_use_percentile_and_agree(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 4, 8]], "x double")
    a = exact_quantiles(df, ["x"], [0.25, 0.5]).collect()[0]["values"]
    b = exact_quantiles(df, ["x"], [0.25, 0.5], final_rows=1).collect()[0]["values"]
    assert a == b == [1.75, 3.0]


def test_brackets_move_no_cells(spark, monkeypatch):
    """Many series below the sorting bound: nothing is exploded, results are pandas'."""
    from trueline.operators import quantiles
    rng = np.random.default_rng(5)
    n = 4000
    pdf = pd.DataFrame({"k": rng.integers(0, 7, n).astype(float), "x": np.round(rng.normal(size=n), 2),
                        "y": np.where(rng.random(n) < 0.6, 3.5, rng.normal(size=n)), "z": np.nan})
    pdf.loc[pdf.k == 6, "k"] = None
    pdf.loc[::13, "x"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                               "k double, x double, y double, z double").repartition(5)

    def moved(*a, **b):
        raise AssertionError("cells were exploded")
    monkeypatch.setattr(quantiles, "long_values", moved)
    monkeypatch.setattr(quantiles, "DIGEST", 40)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["x", "y", "z"], probs, ["k"]).collect()
    assert len(got) == 14 and {r.column for r in got} == {"x", "y"}
    for r in got:
        mine = pdf[pdf.k.isna() if r.k is None else pdf.k == r.k][r.column].dropna()
        assert np.allclose(r["values"], mine.quantile(probs).to_numpy(), rtol=0, atol=1e-12), (r.k, r.column)
    whole = {r.column: r["values"] for r in exact_quantiles(df, ["x", "y", "z"], probs).collect()}
    assert set(whole) == {"x", "y"}
    for c, values in whole.items():
        assert np.allclose(values, pdf[c].dropna().quantile(probs).to_numpy(), rtol=0, atol=1e-12)
    monkeypatch.undo()
    assert exact_quantiles(df.where("x > 1e9"), ["x"], probs, ["k"]).collect() == []


def test_all_ways_agree_bit_for_bit(spark, monkeypatch):
    from trueline.operators import quantiles
    monkeypatch.setattr(quantiles, "DIGEST", 20)
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(int(k % 3), float(v)) for k, v in enumerate(rng.normal(size=900))], "k int, x double")
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    ways = [exact_quantiles(df, ["x"], probs, ["k"], row_bound=900), exact_quantiles(df, ["x"], probs, ["k"]),
            exact_quantiles(df, ["x"], probs, ["k"], final_rows=5)]
    a, b, c = ({r.k: r["values"] for r in w.collect()} for w in ways)
    assert a == b == c


def test_large_groups_get_finer_digests(spark, monkeypatch):
    """Groups far beyond what the coarsest digest can bracket: still nothing is exploded."""
    from trueline.operators import quantiles
    rng = np.random.default_rng(13)
    n = 6000
    pdf = pd.DataFrame({"k": rng.integers(0, 2, n), "x": rng.normal(size=n), "y": rng.integers(0, 9, n) / 100})
    df = spark.createDataFrame(pdf).repartition(5)

    def moved(*a, **b):
        raise AssertionError("cells were exploded")
    monkeypatch.setattr(quantiles, "long_values", moved)
    monkeypatch.setattr(quantiles, "DIGEST", 10)
    monkeypatch.setattr(quantiles, "BETWEEN", 100, raising=False)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    whole = exact_quantiles(df, ["x", "y"], probs, final_rows=400).collect()
    for r in [*whole, *exact_quantiles(df, ["x", "y"], probs, ["k"], final_rows=400).collect()]:
        mine = pdf[r.column] if "k" not in r else pdf[pdf.k == r.k][r.column]
        assert np.allclose(r["values"], mine.quantile(probs).to_numpy(), rtol=0, atol=1e-12), r
    assert len(whole) == 2


def test_accuracy_grows_with_the_group_within_bounds():
    from trueline.operators import quantiles as q
    assert q._accuracy(1_000_000, 4) == q.DIGEST
    assert q._accuracy(36_000_000, 4) == 4320
    assert q._accuracy(10 ** 10, 4) == q.FINEST
    assert q._accuracy(10 ** 10, 6400) == 312
    assert q._accuracy(10 ** 10, 10 ** 6) == q.DIGEST
