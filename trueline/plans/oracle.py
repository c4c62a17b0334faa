"""DuckDB SQL oracles for the registered queries.

Each statement recomputes a query from the raw views (``events``,
``orders``, ``lineitem``) with plain SQL windows and aggregates: an
independent second implementation of the same semantics.  Linear models
use their one-feature closed forms.  Floating outputs are rounded to 6
decimals, as on the Spark side.
"""

from __future__ import annotations

import math

from ..ml.tree_grower import POISSON, draw, mix
from ..sources.fixtures import (GROWTH_SQL, REF_CLEAN_SQL, REF_KEYED_SQL, SEN_CLEAN_SQL, SEN_DIRTY_SQL, SEN_KEYED_SQL)

H_US = 3_600_000_000
M15_US = 900_000_000
D_US = 86_400_000_000
MAX_LAG = 6

FIXTURES = {
    "ref_clean": REF_CLEAN_SQL,
    "sen_clean": SEN_CLEAN_SQL,
    "sen_dirty": SEN_DIRTY_SQL,
    "ref_keyed": REF_KEYED_SQL,
    "sen_keyed": SEN_KEYED_SQL,
    "growth": GROWTH_SQL,
    "ref_one": "SELECT ts AS timestamp, value AS pm25 FROM events",
    "sen_one": "SELECT ts + INTERVAL '2' HOUR AS timestamp, 0.8 * value + 0.05 * user_id + 3.0 AS pm25_raw FROM events",
    "dirty_parsed": "SELECT TRY_CAST(timestamp AS TIMESTAMP) AS timestamp, pm25_raw, humidity FROM sen_dirty",
    "dirty_valid": ("SELECT timestamp, pm25_raw, humidity FROM (SELECT *, row_number() OVER (PARTITION BY timestamp "
                    "ORDER BY pm25_raw ASC NULLS FIRST, humidity ASC NULLS FIRST) AS rn FROM dirty_parsed "
                    "WHERE timestamp IS NOT NULL) WHERE rn = 1"),
    "orders_series": "SELECT o_orderdate AS timestamp, o_totalprice FROM orders",
    "nan_valid": ("SELECT ts AS timestamp, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS pm25_raw, "
                  "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS humidity FROM events"),
    "lineitem_values": "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
    "lineitem_daily": "SELECT l_shipdate AS timestamp, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem",
}
DEPENDS = {"dirty_parsed": ["sen_dirty"], "dirty_valid": ["dirty_parsed"]}
LINEITEM_VALUES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
REF_COLS = ["pm25", "temperature"]
SEN_COLS = ["pm25_raw", "humidity", "voc", "flat"]
DIRTY_COLS = ["pm25_raw", "humidity"]


def rnd(expr: str, digits: int = 6) -> str:
    """Same IEEE expression as the Spark side (see ``round_half_up``)."""
    scale = float(2 ** math.ceil(digits * math.log2(10)))
    return f"(floor(({expr}) * {scale} + 0.5) / {scale})"


def r6(expr: str, alias: str, digits: int = 6) -> str:
    return f"{rnd(expr, digits)} AS {alias}"


class Sql:
    """A chain of CTEs ending in one SELECT."""

    def __init__(self, *fixtures: str):
        self.ctes: list[tuple[str, str]] = []
        self.names: set[str] = set()
        for f in fixtures:
            self.fixture(f)

    def fixture(self, name: str) -> "Sql":
        for dep in DEPENDS.get(name, []):
            self.fixture(dep)
        if name not in self.names:
            self.add(name, FIXTURES[name])
        return self

    def add(self, name: str, body: str) -> str:
        self.ctes.append((name, body))
        self.names.add(name)
        return name

    def final(self, select: str) -> str:
        if not self.ctes:
            return select
        return "WITH " + ",\n".join(f"{n} AS ({b})" for n, b in self.ctes) + "\n" + select


def all_not_null(cols) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


def any_not_null(cols) -> str:
    return "(" + " OR ".join(f"{c} IS NOT NULL" for c in cols) + ")"


# ------------------------------------------------------------ resampling
AGG_SQL = {
    "mean": "avg({c})", "median": "quantile_cont({c}, 0.5)", "min": "min({c})", "max": "max({c})",
    "std": "stddev_samp({c})", "var": "var_samp({c})", "sem": "stddev_samp({c}) / sqrt(count({c}))",
    "first": "arg_min({c}, timestamp) FILTER (WHERE {c} IS NOT NULL)",
    "last": "arg_max({c}, timestamp) FILTER (WHERE {c} IS NOT NULL)",
    "sum": "COALESCE(sum({c}), 0)", "prod": "COALESCE(product({c}), 1)",
    "count": "count({c})", "nunique": "count(DISTINCT {c})",
}
EMPTY = {"sum": "0", "prod": "1", "count": "0", "nunique": "0"}


def resample(q: Sql, src: str, cols, rule: str, agg: str, name: str, keys=()) -> str:
    """Adds CTE ``name`` (keys…, timestamp, cols…) and returns it.
    rule: ('fixed', width_us, origin_needed) | ('cal', kind)."""
    k = list(keys)
    kc = "".join(f"{x}, " for x in k)
    if rule[0] == "fixed":
        w, need_origin = rule[1], rule[2]
        if need_origin:
            if k:
                org = q.add(f"{name}_org", f"SELECT {', '.join(k)}, epoch_us(date_trunc('day', min(timestamp))) AS o "
                                           f"FROM {src} GROUP BY {', '.join(k)}")
                base = f"SELECT s.*, {org}.o FROM {src} s JOIN {org} USING ({', '.join(k)})"
            else:
                base = f"SELECT s.*, (SELECT epoch_us(date_trunc('day', min(timestamp))) FROM {src}) AS o FROM {src} s"
            bucket = f"o + (epoch_us(timestamp) - o) // {w} * {w}"
        else:
            base = f"SELECT * FROM {src}"
            bucket = f"epoch_us(timestamp) // {w} * {w}"
        label = lambda b: f"make_timestamp({b})"
    else:
        kind = rule[1]
        base = f"SELECT * FROM {src}"
        start = {"week": "CAST(date_trunc('week', timestamp) AS DATE)",
                 "month_end": "CAST(date_trunc('month', timestamp) AS DATE)",
                 "month_start": "CAST(date_trunc('month', timestamp) AS DATE)",
                 "quarter_end": "CAST(date_trunc('quarter', timestamp) AS DATE)",
                 "year_start": "CAST(date_trunc('year', timestamp) AS DATE)"}[kind]
        bucket = start
        label = {"week": lambda b: f"CAST({b} + 6 AS TIMESTAMP)",
                 "month_end": lambda b: f"CAST(last_day({b}) AS TIMESTAMP)",
                 "month_start": lambda b: f"CAST({b} AS TIMESTAMP)",
                 "quarter_end": lambda b: f"CAST(last_day({b} + INTERVAL 2 MONTH) AS TIMESTAMP)",
                 "year_start": lambda b: f"CAST({b} AS TIMESTAMP)"}[kind]
    aggs = ", ".join(f"{AGG_SQL[agg].format(c=c)} AS {c}" for c in cols)
    grouped = q.add(f"{name}_g", f"SELECT {kc}{bucket} AS b, {aggs} FROM ({base}) GROUP BY ALL")
    if agg in EMPTY:
        if rule[0] == "fixed":
            series = f"unnest(generate_series(min(b), max(b), {rule[1]}))"
        else:
            step = {"week": "INTERVAL 7 DAY", "month_start": "INTERVAL 1 MONTH", "month_end": "INTERVAL 1 MONTH",
                    "quarter_end": "INTERVAL 3 MONTH", "year_start": "INTERVAL 1 YEAR"}[rule[1]]
            series = f"CAST(unnest(generate_series(CAST(min(b) AS TIMESTAMP), CAST(max(b) AS TIMESTAMP), {step})) AS DATE)"
        spine = q.add(f"{name}_sp", f"SELECT {kc}{series} AS b FROM {grouped}" + (f" GROUP BY {', '.join(k)}" if k else ""))
        fills = ", ".join(f"COALESCE(g.{c}, {EMPTY[agg]}) AS {c}" for c in cols)
        keyed = "".join(f"sp.{x}, " for x in k)
        body = (f"SELECT {keyed}{label('sp.b')} AS timestamp, {fills} "
                f"FROM {spine} sp LEFT JOIN {grouped} g USING ({', '.join([*k, 'b'])})")
        return q.add(name, body)
    body = f"SELECT {kc}{label('b')} AS timestamp, {', '.join(cols)} FROM {grouped} WHERE {any_not_null(cols)}"
    return q.add(name, body)


HOURLY = ("fixed", H_US, False)


# ------------------------------------------------------------ alignment
def _lag_name(k: int) -> str:
    return f"l{'m' if k < 0 else 'p'}{abs(k)}"


def shift_expr(col: str, k: int, window: str = "w") -> str:
    if k > 0:
        return f"lag({col}, {k}) OVER {window}"
    if k < 0:
        return f"lead({col}, {-k}) OVER {window}"
    return col


def lag_scores(q: Sql, rr: str, sr: str, target: str, feature: str, name: str, keys=()) -> str:
    k = list(keys)
    using = ", ".join([*k, "timestamp"])
    kc = "".join(f"{x}, " for x in k)
    j = q.add(f"{name}_j", f"SELECT {kc}timestamp, a.{target} AS r, b.{feature} AS s FROM {rr} a JOIN {sr} b "
                           f"USING ({using}) WHERE a.{target} IS NOT NULL AND b.{feature} IS NOT NULL")
    part = f"PARTITION BY {', '.join(k)} " if k else ""
    cols = ", ".join(f"{shift_expr('s', i)} AS {_lag_name(i)}" for i in range(-MAX_LAG, MAX_LAG + 1))
    sh = q.add(f"{name}_sh", f"SELECT {kc}r, {cols} FROM {j} WINDOW w AS ({part}ORDER BY timestamp)")
    gb = f" GROUP BY {', '.join(k)}" if k else ""
    parts = []
    for i in range(-MAX_LAG, MAX_LAG + 1):
        x = _lag_name(i)
        parts.append(f"SELECT {kc}{i} AS lag, covar_pop(r, {x}) / NULLIF(stddev_pop(CASE WHEN {x} IS NOT NULL THEN r END)"
                     f" * stddev_pop(CASE WHEN r IS NOT NULL THEN {x} END), 0) AS score FROM {sh}{gb}")
    return q.add(name, " UNION ALL ".join(parts))


def best_lag(q: Sql, scores: str, name: str, keys=(), key_source: str | None = None) -> str:
    k = list(keys)
    if not k:
        return q.add(name, f"SELECT COALESCE((SELECT lag FROM {scores} WHERE score IS NOT NULL AND NOT isnan(score) "
                           f"ORDER BY score DESC, lag ASC LIMIT 1), 0) AS lag_steps")
    kl = ", ".join(k)
    ranked = q.add(f"{name}_r", f"SELECT {kl}, lag, row_number() OVER (PARTITION BY {kl} ORDER BY score DESC, lag ASC) "
                                f"AS rn FROM {scores} WHERE score IS NOT NULL AND NOT isnan(score)")
    picked = f"SELECT {kl}, lag AS lag_steps FROM {ranked} WHERE rn = 1"
    if key_source is None:
        return q.add(name, picked)
    return q.add(name, f"SELECT {kl}, COALESCE(p.lag_steps, 0) AS lag_steps FROM (SELECT DISTINCT {kl} FROM "
                       f"{key_source}) s LEFT JOIN ({picked}) p USING ({kl})")


def apply_lag(q: Sql, sr: str, cols, lag_sql: str | None, name: str, keys=(), best: str | None = None,
              fixed: int | None = None) -> str:
    k = list(keys)
    kc = "".join(f"{x}, " for x in k)
    part = f"PARTITION BY {', '.join(k)} " if k else ""
    if fixed is not None:
        exprs = [f"{shift_expr(c, fixed)} AS {c}" for c in cols]
        src = sr
    else:
        exprs = []
        for c in cols:
            cases = " ".join(f"WHEN {i} THEN {shift_expr(c, i)}" for i in range(-MAX_LAG, MAX_LAG + 1))
            exprs.append(f"CASE lag_steps {cases} END AS {c}")
        if k:
            src = f"(SELECT s.*, COALESCE(b.lag_steps, 0) AS lag_steps FROM {sr} s LEFT JOIN {best} b USING ({', '.join(k)}))"
        else:
            src = f"(SELECT s.*, (SELECT lag_steps FROM {best}) AS lag_steps FROM {sr} s)"
    sh = q.add(f"{name}_w", f"SELECT {kc}timestamp, {', '.join(exprs)} FROM {src} WINDOW w AS ({part}ORDER BY timestamp)")
    return q.add(name, f"SELECT * FROM {sh} WHERE {all_not_null(cols)}")


def align(q: Sql, ref: str, ref_cols, sen: str, sen_cols, target: str, name: str, keys=()) -> str:
    """resample 1h mean → lag scores on the first sensor column → shift → prefixed join."""
    k = list(keys)
    rr = resample(q, ref, ref_cols, HOURLY, "mean", f"{name}_rr", k)
    sr = resample(q, sen, sen_cols, HOURLY, "mean", f"{name}_sr", k)
    sc = lag_scores(q, rr, sr, target, sen_cols[0], f"{name}_sc", k)
    best = best_lag(q, sc, f"{name}_best", k, key_source=sr if k else None)
    sl = apply_lag(q, sr, sen_cols, None, f"{name}_sl", k, best=best)
    kc = "".join(f"{x}, " for x in k)
    sel = ", ".join([*(f"a.{c} AS reference_{c}" for c in ref_cols), *(f"b.{c} AS sensor_{c}" for c in sen_cols)])
    out = [*(f"reference_{c}" for c in ref_cols), *(f"sensor_{c}" for c in sen_cols)]
    return q.add(name, f"SELECT * FROM (SELECT {kc}timestamp, {sel} FROM {rr} a JOIN {sl} b USING "
                       f"({', '.join([*k, 'timestamp'])})) WHERE {all_not_null(out)}")


# ------------------------------------------------------------ features
def calendar(ts: str = "timestamp") -> list[str]:
    return [f"CAST(hour({ts}) AS INTEGER) AS hour", f"CAST(isodow({ts}) - 1 AS INTEGER) AS day_of_week",
            f"CAST(month({ts}) AS INTEGER) AS month",
            f"CAST(CASE WHEN isodow({ts}) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend"]


def window_features(cols, lags=(), windows=(), part: str = "") -> list[tuple[str, str]]:
    out = []
    for c in cols:
        for k in lags:
            out.append((f"lag({c}, {k}) OVER (w)", f"{c}_lag_{k}"))
    for c in cols:
        for n in windows:
            frame = f"(w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
            out.append((f"avg({c}) OVER {frame}", f"{c}_roll_mean_{n}"))
            out.append((f"COALESCE(stddev_samp({c}) OVER {frame}, 0.0)", f"{c}_roll_std_{n}"))
    return out


# ------------------------------------------------------------ preprocessing
def preprocess(q: Sql, src: str, passthrough, cols, name: str, keys=(), iqr: bool = True) -> str:
    """median impute → IQR(1.5), if wanted → standard scale over ``cols`` (per key)."""
    k = list(keys)
    kc = "".join(f"{x}, " for x in k)
    gb = f" GROUP BY {', '.join(k)}" if k else ""

    def with_params(left, right):
        return f"{left} JOIN {right} USING ({', '.join(k)})" if k else f"{left}, {right}"

    fills = ", ".join(f"quantile_cont({c}, 0.5) AS f_{c}" for c in cols)
    fp = q.add(f"{name}_fp", f"SELECT {kc}{fills} FROM {src}{gb}")
    imp = q.add(f"{name}_imp", f"SELECT {', '.join(passthrough)}, "
                               + ", ".join(f"COALESCE(CAST({c} AS DOUBLE), f_{c}) AS {c}" for c in cols)
                               + f" FROM {with_params(src, fp)}")
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in cols)
    qq = q.add(f"{name}_q", f"SELECT {kc}{qs} FROM {imp}{gb}")
    conds = " AND ".join(f"({c} IS NULL OR {c} BETWEEN q1_{c} - 1.5 * (q3_{c} - q1_{c}) AND q3_{c} + 1.5 * (q3_{c} - q1_{c}))"
                         for c in cols) if iqr else "true"
    flt = q.add(f"{name}_flt", f"SELECT {', '.join(passthrough)}, {', '.join(cols)} FROM {with_params(imp, qq)} WHERE {conds}")
    ss = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
                   for c in cols)
    sc = q.add(f"{name}_sc", f"SELECT {kc}{ss} FROM {flt}{gb}")
    if k:
        return q.add(name, f"SELECT {', '.join(passthrough)}, " + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in cols)
                     + f" FROM {with_params(flt, sc)}")
    q.add(f"{name}_params", " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", f_{c} AS fill, m_{c} AS center, s_{c} AS scale FROM {fp}, {sc}" for c in cols))
    return q.add(name, f"SELECT {', '.join(passthrough)}, " + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in cols)
                 + f" FROM {flt}, {sc}")


# ------------------------------------------------------------ models
HASH = "('0x' || substr(md5(concat_ws('|', CAST(epoch_us(timestamp) AS VARCHAR), '{salt}')), 1, 8))::UBIGINT"


def split_columns() -> str:
    return (f"rank() OVER (ORDER BY {HASH.format(salt='split:42')}) <= ceil(0.2e0 * count(*) OVER ()) AS is_test, "
            f"CAST({HASH.format(salt='fold:42')} % 5 AS INTEGER) AS fold")


# Slope of each linear model for one centred feature, from
# n, var_pop(x) = vx and covar_pop(x, y) = cxy of the training rows
# (alpha 1.0, l1_ratio 0.5 as in the defaults).
SLOPES = {
    "linear_regression": "cxy / vx",
    "ridge": "(cxy * n) / (vx * n + 1.0)",
    "lasso": "sign(cxy) * greatest(abs(cxy) - 1.0, 0) / vx",
    "elastic_net": "sign(cxy) * greatest(abs(cxy) - 0.5, 0) / (vx + 0.5)",
}


def one_feature_data(q: Sql) -> str:
    al = align(q, "ref_one", ["pm25"], "sen_one", ["pm25_raw"], "pm25", "al1")
    return q.add("d", f"SELECT timestamp, reference_pm25 AS y, sensor_pm25_raw AS x, {split_columns()} FROM {al}")


def linear_predictions(q: Sql, d: str, models) -> str:
    """``preds(model, sid, timestamp, actual, predicted)``; sid −1 = hold-out, 0..4 = folds."""
    q.add("splits", "SELECT * FROM (VALUES (-1), (0), (1), (2), (3), (4)) t(sid)")
    q.add("train_rows", f"SELECT s.sid, d.* FROM {d} d JOIN splits s ON (s.sid = -1 AND NOT d.is_test) "
                        f"OR (s.sid >= 0 AND d.fold <> s.sid)")
    q.add("test_rows", f"SELECT s.sid, d.* FROM {d} d JOIN splits s ON (s.sid = -1 AND d.is_test) "
                       f"OR (s.sid >= 0 AND d.fold = s.sid)")
    q.add("st", "SELECT sid, count(*) AS n, avg(x) AS xm, avg(y) AS ym, covar_pop(x, y) AS cxy, var_pop(x) AS vx "
                "FROM train_rows GROUP BY sid")
    fits = " UNION ALL ".join(f"SELECT '{m}' AS model, sid, {SLOPES[m]} AS w, xm, ym FROM st" for m in models)
    q.add("fits", f"SELECT model, sid, w, ym - w * xm AS b FROM ({fits})")
    return q.add("preds", "SELECT f.model, t.sid, t.timestamp, t.y AS actual, f.b + f.w * t.x AS predicted "
                          "FROM test_rows t JOIN fits f USING (sid)")


def metric_sql(a: str = "actual", p: str = "predicted") -> list[tuple[str, str]]:
    e = f"({a} - {p})"
    sst = f"(var_pop({a}) * count({a}))"
    return [(f"sqrt(avg({e} * {e}))", "rmse"), (f"avg(abs({e}))", "mae"),
            (f"CASE WHEN {sst} > 0 THEN 1.0 - sum({e} * {e}) / {sst} WHEN sum({e} * {e}) = 0 THEN 1.0 ELSE 0.0 END", "r2"),
            (f"avg(CASE WHEN {a} <> 0 THEN abs({e} / {a}) END) * 100.0", "mape")]


def cv_metric_sql(a: str = "actual", p: str = "predicted") -> list[tuple[str, str]]:
    e = f"({a} - {p})"
    return [(f"sqrt(avg({e} * {e}))", "cv_rmse"), (f"avg(abs({e}))", "cv_mae")]


# ------------------------------------------------------------ statements
def _sel(cols_exprs) -> str:
    return ", ".join(cols_exprs)


def _round_cols(cols, digits: int = 6) -> list[str]:
    return [r6(c, c, digits) for c in cols]


def s_scan_frame():
    return Sql("ref_clean").final(f"SELECT timestamp, {_sel(_round_cols(REF_COLS))} FROM ref_clean")


def s_coerce():
    return Sql("dirty_parsed").final(f"SELECT timestamp, {_sel(_round_cols(DIRTY_COLS))} FROM dirty_parsed")


def s_drop_bad():
    return Sql("dirty_parsed").final(
        f"SELECT timestamp, {_sel(_round_cols(DIRTY_COLS))} FROM dirty_parsed WHERE timestamp IS NOT NULL")


def s_dirty_valid():
    return Sql("dirty_valid").final(f"SELECT timestamp, {_sel(_round_cols(DIRTY_COLS))} FROM dirty_valid")


def s_numeric_columns():
    return ("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax "
            "FROM lineitem")


IMPUTE_SQL = {
    "mean": "(SELECT avg({c}) FROM dirty_valid)",
    "median": "(SELECT quantile_cont({c}, 0.5) FROM dirty_valid)",
    "most_frequent": ("(SELECT {c} FROM dirty_valid WHERE {c} IS NOT NULL GROUP BY {c} "
                      "ORDER BY count(*) DESC, {c} ASC LIMIT 1)"),
    "constant": "0.0",
}


def s_impute(strategy):
    exprs = [r6(f"COALESCE({c}, {IMPUTE_SQL[strategy].format(c=c)})", c) for c in DIRTY_COLS]
    return Sql("dirty_valid").final(f"SELECT timestamp, {_sel(exprs)} FROM dirty_valid")


def s_quartiles():
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column, {r6(f'quantile_cont({c}, 0.25)', 'q1')}, {r6(f'quantile_cont({c}, 0.75)', 'q3')} "
        f"FROM lineitem" for c in LINEITEM_VALUES)


def _iqr_where(src, cols):
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in cols)
    conds = " AND ".join(f"({c} IS NULL OR {c} BETWEEN q1_{c} - 1.5 * (q3_{c} - q1_{c}) AND q3_{c} + 1.5 * (q3_{c} - q1_{c}))"
                         for c in cols)
    return f"FROM {src}, (SELECT {qs} FROM {src}) q WHERE {conds}"


def s_iqr():
    return Sql("dirty_valid").final(f"SELECT timestamp, {_sel(_round_cols(DIRTY_COLS))} {_iqr_where('dirty_valid', DIRTY_COLS)}")


def s_iqr_wide():
    return Sql("lineitem_values").final(
        f"SELECT l_orderkey, l_linenumber, {_sel(_round_cols(LINEITEM_VALUES))} {_iqr_where('lineitem_values', LINEITEM_VALUES)}")


def _scaler_sql(c, method):
    if method == "standard":
        return f"avg({c})", f"CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END"
    return f"min({c})", f"CASE WHEN max({c}) - min({c}) = 0 THEN 1.0 ELSE max({c}) - min({c}) END"


def s_scaler_params(method):
    parts = []
    for c in LINEITEM_VALUES:
        center, scale = _scaler_sql(c, method)
        parts.append(f"SELECT '{c}' AS column, {r6(center, 'center')}, {r6(scale, 'scale')} FROM lineitem")
    return " UNION ALL ".join(parts)


def s_scale(method):
    stats = ", ".join(f"{_scaler_sql(c, method)[0]} AS m_{c}, {_scaler_sql(c, method)[1]} AS s_{c}" for c in LINEITEM_VALUES)
    exprs = [r6(f"(CAST({c} AS DOUBLE) - m_{c}) / s_{c}", c) for c in LINEITEM_VALUES]
    return Sql("lineitem_values").final(
        f"SELECT l_orderkey, l_linenumber, {_sel(exprs)} FROM lineitem_values, (SELECT {stats} FROM lineitem_values)")


def s_preprocess_reference():
    q = Sql("ref_clean")
    pre = preprocess(q, "ref_clean", ["timestamp", "pm25"], ["temperature"], "pre")
    return q.final(f"SELECT timestamp, {r6('pm25', 'pm25')}, {r6('temperature', 'temperature')} FROM {pre}")


def s_preprocess_sensor():
    q = Sql("dirty_valid")
    pre = preprocess(q, "dirty_valid", ["timestamp"], DIRTY_COLS, "pre")
    return q.final(f"SELECT timestamp, {_sel(_round_cols(DIRTY_COLS))} FROM {pre}")


def s_preprocess_params():
    q = Sql("dirty_valid")
    preprocess(q, "dirty_valid", ["timestamp"], DIRTY_COLS, "pre")
    return q.final(f"SELECT \"column\", {r6('fill', 'fill')}, {r6('center', 'center')}, {r6('scale', 'scale')} FROM pre_params")


def s_preprocess_keyed():
    q = Sql("sen_keyed")
    pre = preprocess(q, "sen_keyed", ["event_type", "timestamp"], ["pm25_raw", "humidity"], "pre", ["event_type"])
    return q.final(f"SELECT event_type, timestamp, {_sel(_round_cols(['pm25_raw', 'humidity']))} FROM {pre}")


def s_dropna():
    return Sql("dirty_valid").final(
        f"SELECT timestamp, {_sel(_round_cols(DIRTY_COLS))} FROM dirty_valid WHERE {all_not_null(DIRTY_COLS)}")


def s_resample(fixture, cols, rule, agg, keys=(), digits=6):
    q = Sql(fixture)
    out = resample(q, fixture, cols, rule, agg, "rs", keys)
    kc = "".join(f"{k}, " for k in keys)
    vals = cols if agg in ("count", "nunique") else _round_cols(cols, digits)
    return q.final(f"SELECT {kc}timestamp, {_sel(vals)} FROM {out}")


def _pair(q):
    rr = resample(q, "ref_clean", REF_COLS, HOURLY, "mean", "rr")
    sr = resample(q, "sen_clean", SEN_COLS, HOURLY, "mean", "sr")
    return rr, sr


def s_pearson():
    q = Sql("ref_clean", "sen_clean")
    rr, sr = _pair(q)
    return q.final(f"SELECT {r6('covar_pop(a.pm25, b.pm25_raw) / NULLIF(stddev_pop(a.pm25) * stddev_pop(b.pm25_raw), 0)', 'score')} "
                   f"FROM {rr} a JOIN {sr} b USING (timestamp) WHERE a.pm25 IS NOT NULL AND b.pm25_raw IS NOT NULL")


def s_lag_join():
    q = Sql("ref_clean", "sen_clean")
    rr, sr = _pair(q)
    return q.final(f"SELECT timestamp, {r6('a.pm25', 'pm25')}, {r6('b.pm25_raw', 'pm25_raw')} FROM {rr} a JOIN {sr} b "
                   f"USING (timestamp) WHERE a.pm25 IS NOT NULL AND b.pm25_raw IS NOT NULL")


def s_lag_scores():
    q = Sql("ref_clean", "sen_clean")
    rr, sr = _pair(q)
    sc = lag_scores(q, rr, sr, "pm25", "pm25_raw", "sc")
    return q.final(f"SELECT lag, {r6('score', 'score')} FROM {sc}")


def s_best_lag():
    q = Sql("ref_clean", "sen_clean")
    rr, sr = _pair(q)
    sc = lag_scores(q, rr, sr, "pm25", "pm25_raw", "sc")
    b = best_lag(q, sc, "best")
    return q.final(f"SELECT CAST(lag_steps AS INTEGER) AS lag_steps FROM {b}")


def _keyed_pair(q):
    k = ["event_type"]
    rr = resample(q, "ref_keyed", REF_COLS, HOURLY, "mean", "rr", k)
    sr = resample(q, "sen_keyed", ["pm25_raw", "humidity"], HOURLY, "mean", "sr", k)
    return rr, sr


def s_lag_scores_keyed():
    q = Sql("ref_keyed", "sen_keyed")
    rr, sr = _keyed_pair(q)
    sc = lag_scores(q, rr, sr, "pm25", "pm25_raw", "sc", ["event_type"])
    return q.final(f"SELECT event_type, lag, {r6('score', 'score')} FROM {sc}")


def s_best_lag_keyed():
    q = Sql("ref_keyed", "sen_keyed")
    rr, sr = _keyed_pair(q)
    sc = lag_scores(q, rr, sr, "pm25", "pm25_raw", "sc", ["event_type"])
    b = best_lag(q, sc, "best", ["event_type"])
    return q.final(f"SELECT event_type, CAST(lag_steps AS INTEGER) AS lag_steps FROM {b}")


def s_apply_lag(k):
    q = Sql("sen_clean")
    sr = resample(q, "sen_clean", SEN_COLS, HOURLY, "mean", "sr")
    sl = apply_lag(q, sr, SEN_COLS, None, "sl", fixed=k)
    return q.final(f"SELECT timestamp, {_sel(_round_cols(SEN_COLS))} FROM {sl}")


ALIGNED_COLS = ["reference_pm25", "reference_temperature", "sensor_pm25_raw", "sensor_humidity", "sensor_voc",
                "sensor_flat"]
FEATURE_SOURCES = ["reference_temperature", "sensor_pm25_raw", "sensor_humidity", "sensor_voc", "sensor_flat"]


def _aligned(q):
    return align(q, "ref_clean", REF_COLS, "sen_clean", SEN_COLS, "pm25", "al")


def s_aligned():
    q = Sql("ref_clean", "sen_clean")
    al = _aligned(q)
    return q.final(f"SELECT timestamp, {_sel(_round_cols(ALIGNED_COLS))} FROM {al}")


KEYED_ALIGNED_COLS = ["reference_pm25", "reference_temperature", "sensor_pm25_raw", "sensor_humidity"]


def _aligned_keyed(q):
    return align(q, "ref_keyed", REF_COLS, "sen_keyed", ["pm25_raw", "humidity"], "pm25", "al", ["event_type"])


def s_aligned_keyed():
    q = Sql("ref_keyed", "sen_keyed")
    al = _aligned_keyed(q)
    return q.final(f"SELECT event_type, timestamp, {_sel(_round_cols(KEYED_ALIGNED_COLS))} FROM {al}")


def s_alignment_metadata():
    q = Sql("ref_clean", "sen_clean")
    _aligned(q)
    return q.final("SELECT CAST(lag_steps AS INTEGER) AS lag_steps, '1H' AS resample_rule, 'mean' AS aggregation, "
                   "'pm25_raw' AS lag_detection_column FROM al_best")


def _feature_select(src, base_cols, feats, keys=(), where_all=False, calendar_cols=False):
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    kc = "".join(f"{k}, " for k in keys)
    inner = [*(f"{e} AS {a}" for e, a in feats)]
    if calendar_cols:
        inner += calendar()
    names = [*base_cols, *(a for _, a in feats), *(["hour", "day_of_week", "month", "is_weekend"] if calendar_cols else [])]
    body = f"SELECT {kc}timestamp, {', '.join(base_cols)}, {', '.join(inner)} FROM {src} WINDOW w AS ({part}ORDER BY timestamp)"
    outer = [*(r6(c, c) for c in base_cols), *(r6(a, a) for _, a in feats)]
    if calendar_cols:
        outer += ["hour", "day_of_week", "month", "is_weekend"]
    where = f" WHERE {all_not_null(names)}" if where_all else ""
    return f"SELECT {kc}timestamp, {', '.join(outer)} FROM ({body}){where}"


def s_lag_features():
    q = Sql("ref_clean", "sen_clean")
    al = _aligned(q)
    return q.final(_feature_select(al, ALIGNED_COLS, window_features(FEATURE_SOURCES, lags=[1, 2, 3])))


def s_rolling(stat):
    q = Sql("ref_clean", "sen_clean")
    al = _aligned(q)
    feats = [f for f in window_features(FEATURE_SOURCES, windows=[3, 6]) if f"_roll_{stat}_" in f[1]]
    return q.final(_feature_select(al, ALIGNED_COLS, feats))


def s_time_features():
    return Sql("ref_clean").final(f"SELECT timestamp, {_sel(_round_cols(REF_COLS))}, {', '.join(calendar())} FROM ref_clean")


def s_features():
    q = Sql("ref_clean", "sen_clean")
    al = _aligned(q)
    feats = window_features(FEATURE_SOURCES, lags=[1, 2, 3]) + window_features(FEATURE_SOURCES, windows=[3, 6])
    return q.final(_feature_select(al, ALIGNED_COLS, feats, where_all=True, calendar_cols=True))


def s_features_keyed():
    q = Sql("ref_keyed", "sen_keyed")
    al = _aligned_keyed(q)
    src = ["reference_temperature", "sensor_pm25_raw", "sensor_humidity"]
    feats = window_features(src, lags=[1, 2, 3]) + window_features(src, windows=[3, 6])
    return q.final(_feature_select(al, KEYED_ALIGNED_COLS, feats, keys=["event_type"], where_all=True,
                                   calendar_cols=True))


def s_holdout_split():
    return Sql("ref_clean").final(f"SELECT timestamp, rank() OVER (ORDER BY {HASH.format(salt='split:42')}) "
                                  f"<= ceil(0.2e0 * count(*) OVER ()) AS is_test FROM ref_clean")


def s_kfold():
    return Sql("ref_clean").final(f"SELECT timestamp, CAST({HASH.format(salt='fold:42')} % 5 AS INTEGER) AS fold "
                                  f"FROM ref_clean")


def _linear(models):
    q = Sql("ref_one", "sen_one")
    d = one_feature_data(q)
    linear_predictions(q, d, models)
    return q


def s_model_holdout(model):
    q = _linear([model])
    return q.final(f"SELECT timestamp, {r6('actual', 'actual')}, {r6('predicted', 'predicted')} FROM preds "
                   f"WHERE sid = -1")


def s_score():
    q = _linear(["linear_regression"])
    return q.final(f"SELECT d.timestamp, {r6('f.b + f.w * d.x', 'prediction')} FROM d, fits f WHERE f.sid = -1")


def s_cv_predictions():
    q = _linear(["linear_regression"])
    return q.final(f"SELECT timestamp, {r6('actual', 'actual')}, {r6('predicted', 'predicted')} FROM preds WHERE sid >= 0")


def s_metrics():
    q = _linear(["linear_regression"])
    return q.final(f"SELECT {_sel(r6(e, a) for e, a in metric_sql())} FROM preds WHERE sid = -1")


def s_mape():
    return f"SELECT {r6(metric_sql('l_discount', 'l_tax')[3][0], 'mape')} FROM lineitem"


def s_cv_metrics():
    q = _linear(["linear_regression"])
    return q.final(f"SELECT {_sel(r6(e, a) for e, a in cv_metric_sql())} FROM preds WHERE sid >= 0")


LINEAR = ["linear_regression", "ridge", "lasso", "elastic_net"]


def _board(q):
    hold = ", ".join(f"{e} AS {a}" for e, a in metric_sql())
    cv = ", ".join(f"{e} AS {a}" for e, a in cv_metric_sql())
    q.add("hold", f"SELECT model, {hold} FROM preds WHERE sid = -1 GROUP BY model")
    q.add("cv", f"SELECT model, {cv} FROM preds WHERE sid >= 0 GROUP BY model")
    return q.add("board", "SELECT * FROM hold LEFT JOIN cv USING (model)")


def s_leaderboard(limit=None):
    q = _linear(LINEAR)
    _board(q)
    cols = ", ".join(r6(c, c) for c in ["rmse", "mae", "r2", "mape", "cv_rmse", "cv_mae"])
    tail = f" ORDER BY rmse ASC, model LIMIT {limit}" if limit else ""
    return q.final(f"SELECT model, {cols} FROM board{tail}")


def s_unpivot():
    q = _linear(["linear_regression"])
    return q.final(f"SELECT timestamp, 'actual' AS series, {rnd('actual')} AS value FROM preds WHERE sid = -1 "
                   f"UNION ALL SELECT timestamp, 'predicted', {rnd('predicted')} FROM preds WHERE sid = -1")


def _calibrated(q):
    pre = preprocess(q, "sen_one", ["timestamp"], ["pm25_raw"], "spre")
    al = align(q, "ref_one", ["pm25"], pre, ["pm25_raw"], "pm25", "cal")
    d = q.add("d", f"SELECT timestamp, reference_pm25 AS y, sensor_pm25_raw AS x, {split_columns()} FROM {al}")
    q.add("fit", f"SELECT regr_slope(y, x) AS w, regr_intercept(y, x) AS b FROM {d} WHERE NOT is_test")
    return d


def s_calibrated():
    q = Sql("ref_one", "sen_one")
    d = _calibrated(q)
    return q.final(f"SELECT timestamp, {r6('y', 'reference_value')}, {r6('b + w * x', 'calibrated_prediction')} "
                   f"FROM {d}, fit")


def s_preview():
    return Sql("ref_clean").final(f"SELECT timestamp, {_sel(_round_cols(REF_COLS))} FROM ref_clean "
                                  f"ORDER BY timestamp LIMIT 50")


def s_validated_nan():
    return Sql("nan_valid").final(f"SELECT timestamp, {_sel(_round_cols(DIRTY_COLS))} FROM nan_valid")


def s_preprocess_nan():
    q = Sql("nan_valid")
    p = preprocess(q, "nan_valid", ["timestamp"], DIRTY_COLS, "pre")
    return q.final(f"SELECT timestamp, {_sel(_round_cols(DIRTY_COLS))} FROM {p}")


def s_scan_csv_na():
    v = "CASE WHEN event_id % 9 = 0 OR event_id % 17 = 0 THEN NULL ELSE value END"
    return f"SELECT ts AS timestamp, {r6(v, 'pm25')}, user_id FROM events"


def s_positions_null_key():
    return ("SELECT series, timestamp, row_number() OVER (PARTITION BY series ORDER BY timestamp) - 1 AS position FROM ("
            "SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_type END AS series, ts AS timestamp FROM events)")


def s_coerce_offset():
    return ("SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts - INTERVAL '330' MINUTE WHEN 1 THEN ts + INTERVAL '480' MINUTE "
            "ELSE ts END AS timestamp FROM events")


def s_coerce_format():
    return "SELECT event_id, date_trunc('second', ts) AS timestamp FROM events"


def s_resample_periods(period: str, every: int, label: str):
    """Calendar multiples: ``period`` numbers a row's period, ``label`` dates the
    period n."""
    return (f"WITH o AS (SELECT o_totalprice, {period} AS p FROM orders), "
            f"b AS (SELECT o_totalprice, m + CAST(ceil((p - m) / {every}.0) AS BIGINT) * {every} AS n "
            f"FROM o, (SELECT min(p) AS m FROM o)) "
            f"SELECT CAST({label} AS TIMESTAMP) AS timestamp, {r6('avg(o_totalprice)', 'o_totalprice', 4)} FROM b GROUP BY n")


def week_number(first_day: str) -> str:
    """Weeks since a first weekday before all data."""
    return f"(date_diff('day', DATE '{first_day}', CAST(o_orderdate AS DATE)) // 7)"


def s_resample_100ms():
    return (f"SELECT make_timestamp(epoch_us(ts) // 100000 * 100000) AS timestamp, {r6('avg(value)', 'pm25')}, "
            f"{r6('avg(CAST(user_id AS DOUBLE))', 'temperature')} FROM events GROUP BY ALL")


def s_two_features(alpha: str):
    """Ridge (alpha 0: least squares) with two features: Cramer's rule on the
    population covariances of the training rows."""
    q = Sql("ref_clean", "sen_clean")
    al = align(q, "ref_clean", REF_COLS, "sen_clean", SEN_COLS, "pm25", "al2")
    q.add("d", f"SELECT timestamp, reference_pm25 AS y, sensor_pm25_raw AS a, sensor_humidity AS b, {split_columns()} "
               f"FROM {al}")
    q.add("m", f"SELECT avg(a) AS am, avg(b) AS bm, avg(y) AS ym, var_pop(a) + {alpha} / count(*) AS aa, "
               f"var_pop(b) + {alpha} / count(*) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, "
               f"covar_pop(b, y) AS byc FROM d WHERE NOT is_test")
    q.add("w", "SELECT *, (ay * bb - byc * ab) / (aa * bb - ab * ab) AS wa, (byc * aa - ay * ab) / (aa * bb - ab * ab) AS wb "
               "FROM m")
    p = "ym + wa * (a - am) + wb * (b - bm)"
    return q.final(f"SELECT timestamp, {r6('y', 'actual')}, {r6(p, 'predicted')} FROM d, w WHERE is_test")


def s_score_reloaded_keyed():
    """Ridge (alpha 1) with three features per series, by Cramer's rule on the
    population covariances of its training rows; all rows scored."""
    q = Sql("ref_keyed", "sen_keyed")
    keys = ["event_type"]
    rp = preprocess(q, "ref_keyed", ["event_type", "timestamp", "pm25"], ["temperature"], "rp", keys, iqr=False)
    sp = preprocess(q, "sen_keyed", ["event_type", "timestamp"], ["pm25_raw", "humidity"], "sp", keys, iqr=False)
    al = align(q, rp, REF_COLS, sp, ["pm25_raw", "humidity"], "pm25", "al", keys)
    h = HASH.replace("concat_ws('|', ", "concat_ws('|', event_type, ").format(salt="split:42")
    q.add("d", f"SELECT event_type, timestamp, reference_pm25 AS y, reference_temperature AS a, sensor_pm25_raw AS b, "
               f"sensor_humidity AS c, rank() OVER (PARTITION BY event_type ORDER BY {h}) <= "
               f"ceil(0.2e0 * count(*) OVER (PARTITION BY event_type)) AS is_test FROM {al}")
    pairs = ", ".join(f"covar_pop({x}, {y}) AS {x}{y}" for x, y in ("ab", "ac", "bc", "ay", "by", "cy")).replace(" AS by", " AS b_y")
    q.add("m", f"SELECT event_type, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my, {pairs}, "
               + ", ".join(f"var_pop({x}) + 1.0 / count(*) AS {x}{x}" for x in "abc")
               + " FROM d WHERE NOT is_test GROUP BY event_type")

    def det(m):
        (a, b, c), (d, e, f), (g, h2, i) = m
        return f"({a} * ({e} * {i} - {f} * {h2}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h2} - {e} * {g}))"

    rows = [["aa", "ab", "ac"], ["ab", "bb", "bc"], ["ac", "bc", "cc"]]
    right = ["ay", "b_y", "cy"]
    w = [f"{det([[right[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)])} / {det(rows)} AS w{k}"
         for k in range(3)]
    q.add("w", f"SELECT *, {', '.join(w)} FROM m")
    p = "my + w0 * (a - ma) + w1 * (b - mb) + w2 * (c - mc)"
    return q.final(f"SELECT event_type, timestamp, {r6(p, 'calibrated_prediction')}, {r6('y', 'reference_value')} "
                   f"FROM d JOIN w USING (event_type)")


def s_two_features_l1(l1: str, l2: str):
    """Lasso and elastic net with two features: the stationary point of every
    pattern of signs (0: not in the support) that has those signs; the one of
    least objective is the minimum."""
    q = Sql("ref_clean", "sen_clean")
    al = align(q, "ref_clean", REF_COLS, "sen_clean", SEN_COLS, "pm25", "al2")
    q.add("d", f"SELECT timestamp, reference_pm25 AS y, sensor_pm25_raw AS a, sensor_humidity AS b, {split_columns()} "
               f"FROM {al}")
    q.add("m", f"SELECT avg(a) AS am, avg(b) AS bm, avg(y) AS ym, var_pop(a) + {l2} AS aa, var_pop(b) + {l2} AS bb, "
               f"covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byc FROM d WHERE NOT is_test")
    q.add("signs", "SELECT * FROM (VALUES (-1), (0), (1)) s(sa), (VALUES (-1), (0), (1)) t(sb)")
    q.add("points", f"SELECT *, CASE WHEN sa = 0 THEN 0 WHEN sb = 0 THEN (ay - {l1} * sa) / aa "
                    f"ELSE ((ay - {l1} * sa) * bb - (byc - {l1} * sb) * ab) / (aa * bb - ab * ab) END AS wa, "
                    f"CASE WHEN sb = 0 THEN 0 WHEN sa = 0 THEN (byc - {l1} * sb) / bb "
                    f"ELSE ((byc - {l1} * sb) * aa - (ay - {l1} * sa) * ab) / (aa * bb - ab * ab) END AS wb FROM m, signs")
    q.add("w", f"SELECT * FROM points WHERE sign(wa) = sa AND sign(wb) = sb ORDER BY 0.5e0 * (aa * wa * wa + "
               f"2 * ab * wa * wb + bb * wb * wb) - ay * wa - byc * wb + {l1} * (abs(wa) + abs(wb)) LIMIT 1")
    p = "ym + wa * (a - am) + wb * (b - bm)"
    return q.final(f"SELECT timestamp, {r6('y', 'actual')}, {r6(p, 'predicted')} FROM d, w WHERE is_test")


def s_per_key(two: bool):
    """Least squares and ridge (alpha 1) per series on its own training rows,
    and the series' best model by hold-out rmse."""
    q = Sql("ref_keyed", "sen_keyed")
    al = _aligned_keyed(q)
    h = HASH.replace("concat_ws('|', ", "concat_ws('|', event_type, ").format(salt="split:42")
    q.add("d", f"SELECT event_type, timestamp, reference_pm25 AS y, sensor_pm25_raw AS a, sensor_humidity AS b, "
               f"rank() OVER (PARTITION BY event_type ORDER BY {h}) <= ceil(0.2e0 * count(*) OVER (PARTITION BY event_type)) "
               f"AS is_test FROM {al}")
    parts = []
    for model, alpha in (("linear_regression", "0.0"), ("ridge", "1.0")):
        m = (f"SELECT event_type, '{model}' AS model, avg(a) AS am, avg(b) AS bm, avg(y) AS ym, "
             f"var_pop(a) + {alpha} / count(*) AS aa, var_pop(b) + {alpha} / count(*) AS bb, covar_pop(a, b) AS ab, "
             f"covar_pop(a, y) AS ay, covar_pop(b, y) AS byc FROM d WHERE NOT is_test GROUP BY event_type")
        wa, wb = ("(ay * bb - byc * ab) / (aa * bb - ab * ab)", "(byc * aa - ay * ab) / (aa * bb - ab * ab)") if two \
            else ("ay / aa", "0.0")
        parts.append(f"SELECT event_type, model, am, bm, ym, {wa} AS wa, {wb} AS wb FROM ({m})")
    q.add("fits", " UNION ALL ".join(parts))
    q.add("preds", "SELECT event_type, timestamp, model, y AS actual, ym + wa * (a - am) + wb * (b - bm) AS predicted "
                   "FROM d JOIN fits USING (event_type) WHERE is_test")
    q.add("scores", "SELECT event_type, model, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse FROM preds "
                    "GROUP BY event_type, model")
    q.add("best", "SELECT event_type, arg_min(model, rmse) AS best FROM scores GROUP BY event_type")
    return q.final(f"SELECT event_type, timestamp, model, {r6('actual', 'actual')}, {r6('predicted', 'predicted')}, best "
                   f"FROM preds JOIN best USING (event_type)")


def _splits(q: Sql, columns: str, al: str) -> None:
    """``tr``: the training rows of the hold-out fit (-1) and of the folds."""
    q.add("d", f"SELECT timestamp, reference_pm25 AS y, {columns}, {HASH.format(salt='tree')} AS h, {split_columns()} FROM {al}")
    q.add("tr", "SELECT s.sid, d.* FROM d JOIN (VALUES (-1), (0), (1), (2), (3), (4)) s(sid) "
                "ON (s.sid = -1 AND NOT d.is_test) OR (s.sid >= 0 AND d.fold <> s.sid)")


def _stump(q: Sql, name: str, rows: str, key: str) -> None:
    """Best cut of ``rows`` (key, x, t, w) by squared error, between values:
    ``name``(key, cut, lo, hi)."""
    q.add(f"{name}_v", f"SELECT {key}, x, sum(w) AS n, sum(w * t) AS s FROM {rows} WHERE w > 0 GROUP BY ALL")
    q.add(f"{name}_c", f"SELECT {key}, x, sum(n) OVER a AS nl, sum(s) OVER a AS sl, sum(n) OVER b AS na, sum(s) OVER b AS sa, "
                       f"lead(x) OVER (PARTITION BY {key} ORDER BY x) AS nx FROM {name}_v "
                       f"WINDOW a AS (PARTITION BY {key} ORDER BY x), b AS (PARTITION BY {key})")
    q.add(name, f"SELECT {key}, arg_max({{'cut': x, 'lo': sl / nl, 'hi': (sa - sl) / (na - nl)}}, "
                f"sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl)) AS b FROM {name}_c WHERE nx IS NOT NULL GROUP BY {key}")


def _stump_result(q: Sql, predicted: str, parts: str) -> str:
    """Out-of-fold and hold-out predictions from ``p``(sid, timestamp, predicted)."""
    q.add("p", f"SELECT d.sid, d.timestamp, {predicted} AS predicted FROM (SELECT s.sid, d.* FROM d JOIN "
               f"(VALUES (-1), (0), (1), (2), (3), (4)) s(sid) ON (s.sid = -1 AND d.is_test) OR d.fold = s.sid) d {parts}")
    return q.final(f"SELECT d.timestamp, {r6('d.y', 'actual')}, {r6('c.predicted', 'cv_predicted')}, "
                   f"{r6('t.predicted', 'predicted')} FROM d JOIN p c ON c.timestamp = d.timestamp AND c.sid = d.fold "
                   f"LEFT JOIN p t ON t.timestamp = d.timestamp AND t.sid = -1")


def _hour_data(q: Sql) -> None:
    al = align(q, "ref_one", ["pm25"], "sen_one", ["pm25_raw"], "pm25", "al1")
    _splits(q, "CAST(hour(timestamp) AS DOUBLE) AS x", al)


def s_boost_stump():
    """Three rounds of least-squares boosting from the mean, rate 0.1, depth one."""
    q = Sql("ref_one", "sen_one")
    _hour_data(q)
    q.add("m0", "SELECT sid, avg(y) AS start FROM tr GROUP BY sid")
    parts, margin = ["JOIN m0 USING (sid)"], "m0.start"
    for k in range(3):
        q.add(f"r{k}", f"SELECT d.sid, d.x, 1 AS w, d.y - ({margin}) AS t FROM tr d {' '.join(parts)}")
        _stump(q, f"b{k}", f"r{k}", "sid")
        parts.append(f"JOIN b{k} USING (sid)")
        margin += f" + 0.1e0 * CASE WHEN d.x <= b{k}.b.cut THEN b{k}.b.lo ELSE b{k}.b.hi END"
    return _stump_result(q, margin, " ".join(parts))


def _mix_sql(x: str) -> str:
    a = f"((({x}) % 4294967296) * 2246822519) % 4294967296"
    a = f"xor({a}, ({a}) >> 15)"
    b = f"(({a}) * 3266489917) % 4294967296"
    return f"xor({b}, ({b}) >> 13)"


def s_forest_stump():
    """Three bootstrapped trees of depth one; weights by the same hash of
    (row, fit, tree)."""
    q = Sql("ref_one", "sen_one")
    _hour_data(q)
    add = lambda v: int(mix(v + 374761393))
    q.add("z1", f"SELECT *, {_mix_sql('h + 374761393')} AS z FROM tr")
    q.add("z2", f"SELECT * EXCLUDE (z), {_mix_sql(f'z + {int(mix(43))}')} AS z FROM z1")
    fits = " ".join(f"WHEN sid = {f} THEN {add(f + 2)}" for f in (-1, 0, 1, 2, 3, 4))
    q.add("z3", f"SELECT * EXCLUDE (z), z + (CASE {fits} END)::UBIGINT AS z FROM z2")
    q.add("z4", f"SELECT * EXCLUDE (z), {_mix_sql('z')} AS z FROM z3")
    trees = " ".join(f"WHEN tree = {t} THEN {add(t)}" for t in range(3))
    q.add("z5", f"SELECT z4.* EXCLUDE (z), tree, z + (CASE {trees} END)::UBIGINT AS z FROM z4, (VALUES (0), (1), (2)) t(tree)")
    q.add("z6", f"SELECT * EXCLUDE (z), CAST({_mix_sql('z')} AS DOUBLE) / 4294967296.0e0 AS u FROM z5")
    w = " + ".join(f"CASE WHEN u >= {p!r} THEN 1 ELSE 0 END" for p in POISSON.tolist())
    q.add("r", f"SELECT sid, tree, x, y AS t, {w} AS w FROM z6")
    _stump(q, "b", "r", "sid, tree")
    # a cut lies between values of the table, not only of the drawn rows
    return _stump_result(q, "(SELECT avg(CASE WHEN d.x <= b.b.cut THEN b.b.lo ELSE b.b.hi END) FROM b WHERE b.sid = d.sid)", "")


def s_extra_stump():
    """Three trees of depth one; the cut of each feature is drawn between its
    least and largest training value."""
    q = Sql("ref_clean", "sen_clean")
    al = align(q, "ref_clean", REF_COLS, "sen_clean", SEN_COLS, "pm25", "al2")
    _splits(q, "sensor_pm25_raw AS a, sensor_humidity AS b", al)
    u = [(f, t, j, float(draw(42, f + 2, t, 0, j))) for f in (-1, 0, 1, 2, 3, 4) for t in range(3) for j in range(2)]
    q.add("u", "SELECT * FROM (VALUES " + ", ".join(f"({f}, {t}, {j}, {x!r}e0)" for f, t, j, x in u) + ") u(sid, tree, j, u)")
    q.add("lng", "SELECT sid, y, 0 AS j, a AS x FROM tr UNION ALL SELECT sid, y, 1, b FROM tr")
    q.add("rng", "SELECT sid, j, min(x) AS lo, max(x) AS hi FROM lng GROUP BY ALL")
    q.add("cuts", "SELECT sid, tree, j, lo + u * (hi - lo) AS cut FROM u JOIN rng USING (sid, j)")
    q.add("sums", "SELECT sid, tree, j, cut, count(*) FILTER (x <= cut) AS nl, sum(y) FILTER (x <= cut) AS sl, count(*) AS na, "
                  "sum(y) AS sa FROM lng JOIN cuts USING (sid, j) GROUP BY ALL")
    q.add("k", "SELECT sid, tree, arg_max({'j': j, 'cut': cut, 'lo': sl / nl, 'hi': (sa - sl) / (na - nl)}, "
               "sl * sl / nl + (sa - sl) * (sa - sl) / (na - nl)) AS b FROM sums GROUP BY ALL")
    return _stump_result(q, "(SELECT avg(CASE WHEN (CASE WHEN k.b.j = 0 THEN d.a ELSE d.b END) <= k.b.cut THEN k.b.lo "
                            "ELSE k.b.hi END) FROM k WHERE k.sid = d.sid)", "")


def s_sink_tree_model():
    """The hold-out fit of the boosted stumps over all rows."""
    q = Sql("ref_one", "sen_one")
    _hour_data(q)
    q.add("m0", "SELECT sid, avg(y) AS start FROM tr GROUP BY sid")
    parts, margin = ["JOIN m0 USING (sid)"], "m0.start"
    for k in range(3):
        q.add(f"r{k}", f"SELECT d.sid, d.x, 1 AS w, d.y - ({margin}) AS t FROM tr d {' '.join(parts)}")
        _stump(q, f"b{k}", f"r{k}", "sid")
        parts.append(f"JOIN b{k} USING (sid)")
        margin += f" + 0.1e0 * CASE WHEN d.x <= b{k}.b.cut THEN b{k}.b.lo ELSE b{k}.b.hi END"
    return q.final(f"SELECT d.timestamp, {r6(margin, 'prediction')} FROM (SELECT -1 AS sid, d.* FROM d) d {' '.join(parts)}")


def build() -> dict[str, str]:
    hourly_dirty = lambda agg, digits=6: s_resample("dirty_valid", DIRTY_COLS, HOURLY, agg, digits=digits)
    q15 = lambda agg: s_resample("dirty_valid", DIRTY_COLS, ("fixed", M15_US, False), agg)
    orders = lambda rule, agg: s_resample("orders_series", ["o_totalprice"], rule, agg,
                                          digits=4)
    out = {
        "validated_nan": s_validated_nan(),
        "preprocess_nan": s_preprocess_nan(),
        "resample_nan": s_resample("nan_valid", DIRTY_COLS, HOURLY, "mean"),
        "scan_csv_na": s_scan_csv_na(),
        "positions_null_key": s_positions_null_key(),
        "coerce_timestamp_offset": s_coerce_offset(),
        "coerce_timestamp_format": s_coerce_format(),
        "resample_2w": s_resample_periods(week_number("1900-01-01"), 2, "DATE '1900-01-07' + CAST(n * 7 AS INTEGER)"),
        "resample_w_mon": s_resample_periods(week_number("1900-01-02"), 1, "DATE '1900-01-08' + CAST(n * 7 AS INTEGER)"),
        "resample_3m": s_resample_periods(
            "(year(o_orderdate) * 12 + month(o_orderdate) - 1)", 3,
            "last_day(make_date(n // 12, n % 12 + 1, 1))"),
        "resample_100ms": s_resample_100ms(),
        "ols_two_features": s_two_features("0.0"),
        "ridge_two_features": s_two_features("1.0"),
        "score_reloaded_keyed": s_score_reloaded_keyed(),
        "lasso_two_features": s_two_features_l1("1.0", "0.0"),
        "elastic_net_two_features": s_two_features_l1("0.5", "0.5"),
        "extra_stump": s_extra_stump(),
        "boost_stump": s_boost_stump(),
        "forest_stump": s_forest_stump(),
        "sink_tree_model": s_sink_tree_model(),
        "calibrate_per_key": s_per_key(False),
        "calibrate_per_key_two": s_per_key(True),
        "scan_frame": s_scan_frame(),
        "scan_csv": s_scan_frame(),
        "sink_csv": s_aligned(),
        "sink_model": s_score(),
        "coerce_timestamp": s_coerce(),
        "drop_bad_timestamp": s_drop_bad(),
        "dedupe_timestamp": s_dirty_valid(),
        "validated_series": s_dirty_valid(),
        "sorted_series": s_dirty_valid(),
        "numeric_columns": s_numeric_columns(),
        "impute_mean": s_impute("mean"),
        "impute_median": s_impute("median"),
        "impute_most_frequent": s_impute("most_frequent"),
        "impute_constant": s_impute("constant"),
        "quartiles": s_quartiles(),
        "iqr_filter": s_iqr(),
        "iqr_filter_wide": s_iqr_wide(),
        "scaler_params_standard": s_scaler_params("standard"),
        "scaler_params_minmax": s_scaler_params("minmax"),
        "scale_standard": s_scale("standard"),
        "scale_minmax": s_scale("minmax"),
        "preprocess_reference": s_preprocess_reference(),
        "preprocess_sensor": s_preprocess_sensor(),
        "preprocess_params": s_preprocess_params(),
        "dropna_any": s_dropna(),
        "preprocess_keyed": s_preprocess_keyed(),
        "resample_keyed_count": s_resample("sen_keyed", ["pm25_raw", "humidity"], ("fixed", M15_US, False), "count",
                                           ["event_type"]),
        "sink_parquet": s_aligned(),
        "resample_mean": s_resample("ref_clean", REF_COLS, HOURLY, "mean"),
        "resample_median": hourly_dirty("median"),
        "resample_min": hourly_dirty("min"),
        "resample_max": hourly_dirty("max"),
        "resample_std": hourly_dirty("std"),
        "resample_var": hourly_dirty("var", 3),
        "resample_sem": hourly_dirty("sem"),
        "resample_first": hourly_dirty("first"),
        "resample_last": hourly_dirty("last"),
        "resample_sum": q15("sum"),
        "resample_prod": s_resample("growth", ["factor"], ("fixed", M15_US, False), "prod"),
        "resample_count": q15("count"),
        "resample_nunique": q15("nunique"),
        "resample_7h": s_resample("ref_clean", REF_COLS, ("fixed", 7 * H_US, True), "mean"),
        "resample_day": orders(("fixed", D_US, False), "mean"),
        "resample_week": orders(("cal", "week"), "mean"),
        "resample_month_end": orders(("cal", "month_end"), "mean"),
        "resample_month_start": orders(("cal", "month_start"), "count"),
        "resample_quarter_end": orders(("cal", "quarter_end"), "max"),
        "resample_year_start": orders(("cal", "year_start"), "mean"),
        "resample_sum_wide": s_resample("lineitem_daily", LINEITEM_VALUES, ("fixed", D_US, False), "sum", digits=4),
        "resample_keyed": s_resample("ref_keyed", REF_COLS, HOURLY, "mean", ["event_type"]),
        "resample_keyed_7h": s_resample("ref_keyed", REF_COLS, ("fixed", 7 * H_US, True), "mean", ["event_type"]),
        "pearson": s_pearson(),
        "lag_join": s_lag_join(),
        "lag_scores": s_lag_scores(),
        "best_lag": s_best_lag(),
        "lag_scores_keyed": s_lag_scores_keyed(),
        "best_lag_keyed": s_best_lag_keyed(),
        "apply_lag_pos": s_apply_lag(2),
        "apply_lag_neg": s_apply_lag(-2),
        "aligned": s_aligned(),
        "aligned_keyed": s_aligned_keyed(),
        "alignment_metadata": s_alignment_metadata(),
        "lag_features": s_lag_features(),
        "rolling_mean": s_rolling("mean"),
        "rolling_std": s_rolling("std"),
        "time_features": s_time_features(),
        "features": s_features(),
        "features_keyed": s_features_keyed(),
        "holdout_split": s_holdout_split(),
        "kfold_assign": s_kfold(),
        "ols_predictions": s_model_holdout("linear_regression"),
        "ridge_predictions": s_model_holdout("ridge"),
        "lasso_predictions": s_model_holdout("lasso"),
        "elastic_net_predictions": s_model_holdout("elastic_net"),
        "holdout_predictions": s_model_holdout("linear_regression"),
        "score": s_score(),
        "cv_predictions": s_cv_predictions(),
        "metrics": s_metrics(),
        "mape": s_mape(),
        "cv_metrics": s_cv_metrics(),
        "leaderboard": s_leaderboard(),
        "best_model": s_leaderboard(limit=1),
        "unpivot_predictions": s_unpivot(),
        "calibrated_dataset": s_calibrated(),
        "calibrated_left_join": s_calibrated(),
        "preview": s_preview(),
    }
    return out
