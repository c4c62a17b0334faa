import datetime as dt
import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from trueline.operators.ordered import dense_positions, ordered_select


def make(spark, n, keys=1, gaps=True, seed=0):
    rng = random.Random(seed)
    rows = []
    for k in range(keys):
        t = dt.datetime(2024, 1, 1)
        for i in range(n):
            t += dt.timedelta(hours=rng.choice([1, 1, 1, 5]) if gaps else 1)
            rows.append((f"k{k}", t, float(rng.randint(0, 100))))
    return spark.createDataFrame(rows, "k string, timestamp timestamp_ntz, v double"), rows


def test_positions_are_dense_and_ordered(spark):
    df, rows = make(spark, 200, keys=2)
    out = dense_positions(df, "timestamp", ["k"], time_block_us=86_400_000_000).collect()
    for key in ("k0", "k1"):
        got = sorted((r.timestamp, r["__pos"]) for r in out if r.k == key)
        assert [p for _, p in got] == list(range(200))


def test_positions_dense_across_super_blocks(spark, monkeypatch):
    import trueline.operators.ordered as od
    monkeypatch.setattr(od, "SUPER_BLOCK", 3)
    df, rows = make(spark, 120, keys=2, seed=4)
    out = od.dense_positions(df, "timestamp", ["k"], time_block_us=3_600_000_000 * 5).collect()
    for key in ("k0", "k1"):
        got = sorted((r.timestamp, r["__pos"]) for r in out if r.k == key)
        assert [p for _, p in got] == list(range(120))


def test_halo_window_equals_plain_window(spark):
    for seed, (n, block, lag, lead, win) in enumerate([(57, 10, 3, 2, 4), (200, 16, 6, 6, 6), (31, 64, 1, 0, 2),
                                                        (150, 11, 2, 5, 3)]):
        df, rows = make(spark, n, keys=2, seed=seed)

        def build(w):
            return [F.lag("v", lag).over(w).alias("lagged"), F.lag("v", -lead).over(w).alias("led"),
                    F.avg("v").over(w.rowsBetween(-(win - 1), 0)).alias("roll")]

        got = ordered_select(df, "timestamp", ["k"], max(lag, win - 1), lead, build, block_rows=block,
                             time_block_us=6 * 3_600_000_000).toPandas()
        pdf = pd.DataFrame(rows, columns=["k", "timestamp", "v"]).sort_values(["k", "timestamp"])
        g = pdf.groupby("k")["v"]
        pdf["lagged"] = g.shift(lag)
        pdf["led"] = g.shift(-lead)
        pdf["roll"] = g.transform(lambda s: s.rolling(win, min_periods=1).mean())
        merged = got.merge(pdf, on=["k", "timestamp"], suffixes=("", "_e"))
        assert len(merged) == len(pdf) == len(got)
        for c in ("lagged", "led", "roll"):
            a, e = merged[c], merged[c + "_e"]
            assert ((a.isna() & e.isna()) | ((a - e).abs() < 1e-9)).all(), c


def test_no_single_partition_window_over_rows(spark):
    df, _ = make(spark, 300, keys=1)

    def build(w):
        return [F.lag("v", 1).over(w).alias("l1")]

    out = ordered_select(df, "timestamp", [], 1, 0, build, block_rows=50)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # the only single-partition exchange is the one over the block-count table
    assert plan.count("SinglePartition") <= 1
    assert "__grp" in plan and "BatchEvalPython" not in plan
