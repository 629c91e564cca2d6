"""Queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import scratch
from .operators import extract as ops
from .operators.selection import select_features
from .sources.frames import from_arrays, from_long, from_wide, pad
from .streaming.processors import expanding_stream, sliding_stream

WINDOW, STRIDE, EVERY = 20, 5, 10

# Both engines put results on the same grid with the same operations, so that sums in another
# order compare equal. The offset keeps the grid's edges away from short decimals.
_OFFSET = 0.3217845


def _grid(c: Column, digits: int) -> Column:
    scale = 10.0**digits
    return F.floor(c * scale + _OFFSET) / F.lit(scale)


def _grid_sql(e: str, digits: int) -> str:
    return f"floor(({e}) * {10.0**digits} + {_OFFSET}) / {10.0**digits}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    return from_long(rows, "user_id", ["ts", "event_id"], "value")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_arrays(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id", "embedding")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return from_long(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")


FRAMES = {"events": _events, "embeddings": _embeddings, "orders": _orders}

SERIES_SQL = {
    "events": "SELECT CAST(user_id AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS v FROM events",
    "embeddings": "SELECT CAST(vec_id AS VARCHAR) AS series_id, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
    "orders": "SELECT CAST(o_custkey AS VARCHAR) AS series_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos, o_totalprice AS v FROM orders",
}
FRAME_SQL = {
    "static": ("0 AS k", "SELECT series_id, 0 AS k, pos, v FROM s"),
    "expanding": (
        "k AS end_pos",
        f"SELECT s.series_id, e.k, s.pos, s.v FROM s JOIN (SELECT series_id, pos AS k FROM (SELECT *, max(pos) OVER (PARTITION BY series_id) AS last FROM s) WHERE (pos + 1) % {EVERY} = 0 OR pos = last) e ON s.series_id = e.series_id AND s.pos <= e.k",
    ),
    "sliding": (
        "k AS window_id",
        f"SELECT s.series_id, w.k, s.pos - w.k * {STRIDE} AS pos, s.v FROM s JOIN (SELECT series_id, unnest(range(0, max(pos) - {WINDOW} + 2, {STRIDE})) // {STRIDE} AS k FROM s GROUP BY series_id) w ON s.series_id = w.series_id AND s.pos BETWEEN w.k * {STRIDE} AND w.k * {STRIDE} + {WINDOW - 1}",
    ),
}
# helper columns, in stages; only those named in an expression are made
HELPERS = [
    {
        "n": "count(*) OVER g", "mu": "avg(v) OVER g", "mn": "min(v) OVER g", "mx": "max(v) OVER g", "tot": "sum(abs(v)) OVER g",
        "lag1": "lag(v, 1) OVER o", "lag2": "lag(v, 2) OVER o", "lag4": "lag(v, 4) OVER o", "lead1": "lead(v, 1) OVER o", "lead2": "lead(v, 2) OVER o", "lead3": "lead(v, 3) OVER o", "lead4": "lead(v, 4) OVER o",
        "mass": "sum(abs(v)) OVER (o ROWS UNBOUNDED PRECEDING)", "ra": "row_number() OVER (PARTITION BY series_id, k ORDER BY abs(v) DESC, pos)",
        "cv": "count(*) OVER (PARTITION BY series_id, k, v)", "rv": "row_number() OVER (PARTITION BY series_id, k, v ORDER BY pos)",
        "ca": "{0}(v) OVER (PARTITION BY series_id, k, pos // 5)", "digit": "CASE WHEN v <> 0 THEN CAST(substr(printf('%.15e', abs(v)), 1, 1) AS INT) END",
    },
    {
        "zc": "(v < 0) <> (lag1 < 0)", "bin": "CASE WHEN mx - mn > 1e-9 THEN floor((v - mn) / (mx - mn) * 9) END",
        "gup": "pos - sum(CASE WHEN v > mu THEN 1 ELSE 0 END) OVER (o ROWS UNBOUNDED PRECEDING)", "gdn": "pos - sum(CASE WHEN v < mu THEN 1 ELSE 0 END) OVER (o ROWS UNBOUNDED PRECEDING)",
        "cy": "CASE WHEN pos % 5 = 4 THEN ca END", "cx": "CASE WHEN pos % 5 = 4 THEN pos // 5 END",
    },
    {"lup": "CASE WHEN v > mu THEN count(*) OVER (PARTITION BY series_id, k, gup, v > mu) END", "ldn": "CASE WHEN v < mu THEN count(*) OVER (PARTITION BY series_id, k, gdn, v < mu) END"},
    {"cb": "count(*) OVER (PARTITION BY series_id, k, bin)"},
]
NEEDS = {"zc": ["lag1"], "bin": ["mn", "mx"], "gup": ["mu"], "gdn": ["mu"], "cy": ["ca"], "cx": [], "lup": ["mu", "gup"], "ldn": ["mu", "gdn"], "cb": ["bin"]}

_VAR = "coalesce(var_samp(v), 0)"
_M2 = f"({_VAR} * (count(*) - 1))"
_G2 = "(sum(pow(v - mu, 4)) / count(*)) / pow(sum(pow(v - mu, 2)) / count(*), 2) - 3"
_FIRST, _LAST = "arg_min(v, pos)", "arg_max(v, pos)"
_COV = lambda lag: f"sum((v - mu) * (lead{lag} - mu))"
_SLOPE = "coalesce(regr_slope(cy, cx), 0)"
_REST = f"greatest(regr_syy(cy, cx) - {_SLOPE} * regr_sxy(cy, cx), 0)"
_RE, _IM = "sum(v * cos(2 * pi() * {0} * pos / n))", "-sum(v * sin(2 * pi() * {0} * pos / n))"


def _benford() -> str:
    shares = [f"(count(*) FILTER (digit = {d}) / nullif(count(digit), 0))" for d in range(1, 10)]
    laws = [f"log10(1 + 1 / {d}.0)" for d in range(1, 10)]
    mean = "(1 / 9.0)"
    top = " + ".join(f"({s} - {mean}) * ({b} - {mean})" for s, b in zip(shares, laws))
    a, b = (" + ".join(f"pow({x} - {mean}, 2)" for x in xs) for xs in (shares, laws))
    return f"CASE WHEN {a} > 0 THEN ({top}) / sqrt(({a}) * ({b})) ELSE 0 END"


# name -> (SQL over helper columns, digits of the grid, series, family)
SQL: dict[str, tuple[str, int, str, str]] = {
    "total_sum": ("sum(v)", 4, "events", "moments"),
    "mean": ("avg(v)", 6, "events", "moments"),
    "variance": (_VAR, 4, "events", "moments"),
    "std_dev": ("coalesce(stddev_samp(v), 0)", 6, "events", "moments"),
    "min_value": ("min(v)", 6, "events", "moments"),
    "max_value": ("max(v)", 6, "events", "moments"),
    "abs_max": ("max(abs(v))", 6, "embeddings", "moments"),
    "energy": ("sum(v * v)", 2, "events", "moments"),
    "rms": ("sqrt(sum(v * v) / count(*))", 6, "events", "moments"),
    "root_mean_square": ("sqrt(sum(v * v) / count(*))", 6, "embeddings", "moments"),
    "skewness": (f"CASE WHEN {_VAR} > 1e-9 THEN (sum(pow(v - mu, 3)) / count(*)) / pow(sum(pow(v - mu, 2)) / count(*), 1.5) ELSE 0 END", 6, "events", "moments"),
    "kurtosis": (f"CASE WHEN {_VAR} > 1e-9 AND count(*) > 3 THEN (count(*) - 1) * ((count(*) + 1) * ({_G2}) + 6) / ((count(*) - 2) * (count(*) - 3)) ELSE 0 END", 6, "events", "moments"),
    "biased_fisher_kurtosis": (f"CASE WHEN {_VAR} > 1e-9 THEN {_G2} ELSE 0 END", 6, "events", "moments"),
    "variation_coefficient": ("CASE WHEN abs(avg(v)) > 1e-9 THEN coalesce(stddev_samp(v), 0) / avg(v) ELSE 0 END", 6, "events", "moments"),
    "mean_n_absolute_max-7": ("avg(abs(v)) FILTER (ra <= 7)", 6, "embeddings", "order"),
    "median": ("median(v)", 6, "events", "order"),
    "iqr": ("quantile_cont(v, 0.75) - quantile_cont(v, 0.25)", 6, "events", "order"),
    "quantile-0.3": ("quantile_cont(v, 0.3)", 6, "events", "order"),
    "mad": ("avg(abs(v - mu))", 6, "events", "order"),
    "count_above_mean": ("count(*) FILTER (v > mu)", 6, "events", "counts"),
    "count_below_mean": ("count(*) FILTER (v < mu)", 6, "events", "counts"),
    "longest_strike_above_mean": ("coalesce(max(lup), 0)", 6, "events", "counts"),
    "longest_strike_below_mean": ("coalesce(max(ldn), 0)", 6, "events", "counts"),
    "zero_crossing_rate": ("count(*) FILTER (zc) / count(*)", 6, "embeddings", "counts"),
    "zero_crossing_mean": ("coalesce(avg(pos) FILTER (zc), 0)", 6, "embeddings", "counts"),
    "zero_crossing_std": ("coalesce(stddev_pop(pos) FILTER (zc), 0)", 6, "embeddings", "counts"),
    "peak_count": ("count(*) FILTER (v > lag1 AND v > lead1)", 6, "events", "counts"),
    "slope_sign_change": ("0.0 * count(*)", 6, "events", "counts"),
    "turning_points": ("0.0 * count(*)", 6, "events", "counts"),
    "first_loc_max": ("min(pos) FILTER (v = mx) / count(*)", 6, "events", "counts"),
    "last_loc_max": ("(max(pos) FILTER (v = mx) + 1) / count(*)", 6, "events", "counts"),
    "first_loc_min": ("min(pos) FILTER (v = mn) / count(*)", 6, "events", "counts"),
    "last_loc_min": ("(max(pos) FILTER (v = mn) + 1) / count(*)", 6, "events", "counts"),
    "mean_abs_change": ("coalesce(sum(abs(v - lag1)) / nullif({changes}, 0), 0)", 6, "events", "change"),
    "mean_change": ("coalesce(sum(v - lag1) / nullif({changes}, 0), 0)", 6, "events", "change"),
    "abs_sum_change": ("coalesce(sum(abs(v - lag1)), 0)", 4, "events", "change"),
    "cid_ce": ("coalesce(sqrt(sum(pow(v - lag1, 2))), 0)", 6, "events", "change"),
    "auc": (f"coalesce(sum((v + lag1) / 2), 0) + CASE WHEN {{static}} AND count(*) >= 4 THEN {_FIRST} ELSE 0 END", 4, "events", "change"),
    "signal_distance": ("coalesce(sum(sqrt(pow(v - lag1, 2) + 1)), 0)", 4, "events", "change"),
    "slope": ("CASE WHEN count(*) > 1 THEN regr_slope(v, pos) ELSE 0 END", 6, "events", "trend"),
    "intercept": ("CASE WHEN count(*) > 1 THEN regr_intercept(v, pos) ELSE avg(v) END", 6, "events", "trend"),
    "paa-6-4": ("coalesce(avg(v) FILTER (pos >= {edge}(n * 4 / 6) AND pos < {edge}(n * 5 / 6)), 0)", 6, "events", "trend"),
    "agg_linear_trend-slope-5-max": (f"CASE WHEN count(cy) >= 2 THEN {_SLOPE} ELSE 0 END", 6, "events", "trend"),
    "agg_linear_trend-intercept-5-mean": (f"CASE WHEN count(cy) >= 2 THEN avg(cy) - {_SLOPE} * avg(cx) ELSE 0 END", 6, "events", "trend"),
    "agg_linear_trend-stderr-5-min": (f"CASE WHEN count(cy) > 2 THEN sqrt({_REST} / (count(cy) - 2) / regr_sxx(cy, cx)) ELSE 0 END", 6, "events", "trend"),
    "agg_linear_trend-rvalue-5-var": (f"CASE WHEN count(cy) >= 2 AND regr_syy(cy, cx) > 1e-9 THEN sqrt(greatest(1 - {_REST} / regr_syy(cy, cx), 0)) * sign({_SLOPE}) ELSE 0 END", 5, "events", "trend"),
    "agg_linear_trend-pvalue-5-mean": ("0.0 * count(*)", 6, "events", "trend"),
    "autocorr_lag1": (f"CASE WHEN {_VAR} > 1e-9 THEN (coalesce(sum(v * lag1), 0) + CASE WHEN {{static}} AND count(*) >= 4 THEN pow({_FIRST}, 2) ELSE 0 END - avg(v) * (2 * sum(v) - {_FIRST} - {_LAST}) + (count(*) - 1) * pow(avg(v), 2)) / {_M2} ELSE 0 END", 6, "embeddings", "autocorrelation"),
    "autocorr-3": (f"CASE WHEN {_VAR} > 1e-9 AND count(*) > 3 THEN {_COV(3)} / {{acf3}} ELSE 0 END", 6, "events", "autocorrelation"),
    "partial_autocorr-1": (f"CASE WHEN {_VAR} > 1e-9 AND count(*) > 1 THEN {_COV(1)} / {{acf1}} ELSE 0 END", 6, "events", "autocorrelation"),
    "partial_autocorr-2": (f"CASE WHEN {_VAR} > 1e-9 AND count(*) > 2 AND 1 - pow({_COV(1)} / {{acf1}}, 2) >= 1e-9 THEN ({_COV(2)} / {{acf2}} - pow({_COV(1)} / {{acf1}}, 2)) / (1 - pow({_COV(1)} / {{acf1}}, 2)) ELSE 0 END", 6, "events", "autocorrelation"),
    "c3-2": ("coalesce(sum(v * lag2 * lag4) / nullif(count(lag4), 0), 0)", 2, "events", "autocorrelation"),
    "time_reversal_asymmetry-2": ("coalesce(sum(pow(lead4, 2) * lead2 - lead2 * pow(v, 2)) / nullif(count(lead4), 0), 0)", 2, "events", "autocorrelation"),
    "entropy": ("coalesce(sum(-ln(cb / n) / n) FILTER (bin IS NOT NULL), 0)", 6, "events", "shape"),
    "benford_correlation": (_benford(), 6, "events", "shape"),
    "sum_of_reoccurring_values": ("coalesce(sum(v) FILTER (cv > 1 AND rv = 1), 0)", 4, "events", "shape"),
    "sum_of_reoccurring_data_points": ("coalesce(sum(v) FILTER (cv > 1), 0)", 4, "events", "shape"),
    "index_mass_quantile-0.4": ("coalesce((min(pos) FILTER (mass >= tot * 0.4) + 1) / count(*), 1)", 6, "events", "shape"),
    "max_langevin_fixed_point-3-30": ("0.0 * count(*)", 6, "events", "shape"),
    "fft_coeff-3-real": (_RE.format(3), 5, "embeddings", "spectral"),
    "fft_coeff-3-imag": (_IM.format(3), 5, "embeddings", "spectral"),
    "fft_coeff-3-abs": (f"sqrt(pow({_RE.format(3)}, 2) + pow({_IM.format(3)}, 2))", 5, "embeddings", "spectral"),
    "fft_coeff-3-angle": (f"degrees(atan2({_IM.format(3)}, {_RE.format(3)}))", 4, "embeddings", "spectral"),
    "wavelet-2-0": ("coalesce(avg(abs(v - lag1)) FILTER (pos % 2 = 1), 0)", 6, "events", "spectral"),
    "wavelet-2-1": ("coalesce(sqrt(avg(pow(v - lag1, 2)) FILTER (pos % 2 = 1)), 0)", 6, "events", "spectral"),
    "spectrogram-1-2": ("abs(sum(v))", 4, "events", "spectral"),
}
FAMILIES = list(dict.fromkeys(x[3] for x in SQL.values()))

# Features of the whole spectrum or of all pairs: (SQL of a query with columns series_id and x, digits)
_SPECTRUM = """z AS (SELECT series_id, b, sqrt(pow(sum(v * cos(2 * pi() * b * pos / n)), 2) + pow(sum(v * sin(2 * pi() * b * pos / n)), 2)) AS a
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM s), range(0, 33) r(b) GROUP BY series_id, b)"""
_PHI = """p{0} AS (SELECT series_id, avg(ln(c / t)) AS phi FROM (
  SELECT x.series_id, x.pos, count(*) AS c, any_value(x.t) AS t FROM g{0} x JOIN g{0} y ON x.series_id = y.series_id AND {1} GROUP BY x.series_id, x.pos) GROUP BY series_id)"""


def _grams(m: int) -> str:
    cols = ", ".join(f"lead(v, {i}) OVER o AS v{i}" for i in range(m))
    return f"g{m} AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS t FROM (SELECT series_id, pos, {cols} FROM s WINDOW o AS (PARTITION BY series_id ORDER BY pos)) WHERE v{m - 1} IS NOT NULL)"


def _near(m: int, r: float) -> str:
    return " AND ".join(f"abs(x.v{i} - y.v{i}) <= {r}" for i in range(m))


WHOLE_SQL: dict[str, tuple[str, int]] = {
    "spectral_centroid": (f"{_SPECTRUM} SELECT series_id, sum(b * a) / sum(a) AS x FROM z GROUP BY series_id", 6),
    "spectral_distance": (f"{_SPECTRUM} SELECT series_id, sqrt(sum(pow(a - m, 2))) AS x FROM (SELECT *, avg(a) OVER (PARTITION BY series_id) AS m FROM z) GROUP BY series_id", 6),
    "spectral_decrease": (f"{_SPECTRUM} SELECT series_id, sum((a - a0) / b) / sum(a) AS x FROM (SELECT *, max(CASE WHEN b = 0 THEN a END) OVER (PARTITION BY series_id) AS a0 FROM z) WHERE b > 0 GROUP BY series_id", 6),
    "spectral_slope": (f"{_SPECTRUM} SELECT series_id, regr_slope(a, b) AS x FROM z GROUP BY series_id", 6),
    "human_range_energy-100": (f"{_SPECTRUM} SELECT series_id, coalesce(sum(a * a) FILTER (b >= ceil(0.6 / (100 / 64.0)) AND b <= floor(2.5 / (100 / 64.0))), 0) / sum(a * a) AS x FROM z GROUP BY series_id", 6),
    "autocorrelation": (
        """c AS (SELECT *, v - avg(v) OVER (PARTITION BY series_id) AS d FROM s), m AS (SELECT series_id, sum(d * d) AS m2 FROM c GROUP BY series_id),
  r AS (SELECT a.series_id, b.pos - a.pos AS lag, sum(a.d * b.d) AS t FROM c a JOIN c b ON a.series_id = b.series_id AND b.pos > a.pos GROUP BY ALL)
  SELECT m.series_id, coalesce(min(lag) FILTER (t / m2 < 0.36787944), 0) AS x FROM m LEFT JOIN r ON m.series_id = r.series_id GROUP BY m.series_id""",
        6,
    ),
    "approx_entropy-2-0.05": (f"{_grams(2)}, {_grams(3)}, {_PHI.format(2, _near(2, 0.05))}, {_PHI.format(3, _near(3, 0.05))} SELECT p2.series_id, p2.phi - p3.phi AS x FROM p2 JOIN p3 ON p2.series_id = p3.series_id", 6),
}


def _features_sql(names: list[str], series: str, mode: str, digits: list[int] | None = None) -> str:
    key, frame = FRAME_SQL[mode]
    made = []
    for name, places in zip(names, digits or [SQL[n][1] for n in names]):
        e = SQL[name][0]
        for mark, text in {
            "{changes}": "count(*)" if mode == "sliding" else "(count(*) - 1)", "{static}": "true" if mode == "static" else "false", "{edge}": "round" if mode == "static" else "floor",
            **{f"{{acf{lag}}}": f"((count(*) - {lag}) * {_VAR})" if mode == "expanding" else _M2 for lag in (1, 2, 3)},
        }.items():
            e = e.replace(mark, text)
        made.append(f'{_grid_sql(e, places)} AS "{name}"')
    text = " ".join(made)
    wanted = {h for level in HELPERS for h in level if re.search(rf"\b{h}\b", text)}
    while more := {x for h in wanted for x in NEEDS.get(h, ())} - wanted:
        wanted |= more
    chunk = next((n.rsplit("-", 1)[1] for n in names if n.startswith("agg_linear")), "mean")
    made_chunk = {"max": "max", "min": "min", "mean": "avg", "var": "var_pop"}[chunk] if "ca" in wanted else ""
    steps, last = [f"s AS ({SERIES_SQL[series]})", f"f AS ({frame})"], "f"
    for i, level in enumerate(HELPERS):
        if cols := [f"{e.replace('{0}', made_chunk)} AS {h}" for h, e in level.items() if h in wanted]:
            steps.append(f"h{i} AS (SELECT *, {', '.join(cols)} FROM {last} WINDOW g AS (PARTITION BY series_id, k), o AS (PARTITION BY series_id, k ORDER BY pos))")
            last = f"h{i}"
    shown = "" if mode == "static" else f"CAST({key.split(' AS ')[0]} AS BIGINT) AS {key.split(' AS ')[1]}, "
    return f"WITH {', '.join(steps)} SELECT series_id, {shown}{', '.join(made)} FROM {last} GROUP BY series_id, k"


def _whole_sql(name: str, series: str, mode: str = "static") -> str:
    body, digits = WHOLE_SQL[name]
    if mode != "static":  # prefixes and windows as series of their own, of any length up to 64
        body = body.replace("s), range(0, 33) r(b) GROUP BY", "s) JOIN range(0, 33) r(b) ON b <= n // 2 GROUP BY").replace("AS a\n", "AS a, any_value(n) AS n\n")
        body = body.replace("(100 / 64.0)", "(100 / (n // 2 * 2.0))")
        key, frame = FRAME_SQL[mode][0].split(" AS ")[1], FRAME_SQL[mode][1]
        steps = f"s AS ({SERIES_SQL[series]}), f AS ({frame}), g AS (SELECT series_id || '|' || k AS series_id, pos, v FROM f)"
        inner = re.sub(r"\bs\b(?=[\s,)]|$)", "g", body)
        return f'WITH {steps}, w AS (WITH {inner}) SELECT split_part(series_id, chr(124), 1) AS series_id, CAST(split_part(series_id, chr(124), 2) AS BIGINT) AS {key}, {_grid_sql("x", digits)} AS "{name}" FROM w'
    return f'WITH s AS ({SERIES_SQL[series]}), w AS (WITH {body}) SELECT series_id, {_grid_sql("x", digits)} AS "{name}" FROM w'


def _run(names: list[str], series: str, mode: str, digits: list[int]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = FRAMES[series](spark, sf_dir)
        if mode == "static":
            out, keys = ops.extract(frame, names), ["series_id"]
        elif mode == "expanding":
            out, keys = ops.expanding(frame, names, EVERY), ["series_id", "end_pos"]
        else:
            out, keys = ops.sliding(frame, names, WINDOW, STRIDE), ["series_id", "window_id"]
        return out.select("series_id", *[F.col(k).cast("long").alias(k) for k in keys[1:]], *[_grid(F.col(f"`{n}`"), d).alias(n) for n, d in zip(names, digits)])

    return query


def _key(name: str) -> str:
    return re.sub(r"\W", "_", name)


def _streamed(make: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The events as a stream of files, run until all are taken."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark, "stream")
        _events(spark, sf_dir).write.parquet(f"{path}/in")
        stream = make(spark.readStream.schema("series_id string, pos int, v double").parquet(f"{path}/in"))
        stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).format("parquet").start(f"{path}/out").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/out")

    return query


STREAMED = ["mean", "median", "autocorr-3", "mean_abs_change", "entropy"]


def _on_grid(out: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return out.select(*keys, *[_grid(F.col(f"`{n}`"), SQL[n][1]).alias(n) for n in names])


def stream_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points come in one micro-batch, so each series has one row, over all of it."""
    return _on_grid(_streamed(lambda s: expanding_stream(s, STREAMED))(spark, sf_dir), ["series_id"], STREAMED)


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_grid(_streamed(lambda s: sliding_stream(s, STREAMED, WINDOW, STRIDE))(spark, sf_dir), ["series_id", "window_id"], STREAMED)


def source_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as series."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_custkey")
    frame = from_wide(rows, "o_orderkey", ["o_totalprice", "o_custkey"])
    return ops.extract(frame, ["mean", "min_value", "max_value", "peak_count"]).select("series_id", _grid(F.col("mean"), 3).alias("mean"), "min_value", "max_value", "peak_count")


SOURCE_WIDE = f"""
WITH u AS (SELECT o_orderkey, 'o_totalprice' AS series_id, o_totalprice AS v FROM orders UNION ALL SELECT o_orderkey, 'o_custkey', o_custkey FROM orders),
     w AS (SELECT *, lag(v) OVER o AS a, lead(v) OVER o AS b FROM u WINDOW o AS (PARTITION BY series_id ORDER BY o_orderkey))
SELECT series_id, {_grid_sql("avg(v)", 3)} AS mean, CAST(min(v) AS DOUBLE) AS min_value, CAST(max(v) AS DOUBLE) AS max_value, CAST(count(*) FILTER (v > a AND v > b) AS DOUBLE) AS peak_count
FROM w GROUP BY series_id
"""


def source_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series filled with zeros to 100 points."""
    return _on_grid(ops.extract(pad(_events(spark, sf_dir), 100), ["mean", "median"]), ["series_id"], ["mean", "median"])


SOURCE_PADDED = f"""
WITH s AS ({SERIES_SQL["events"]}), p AS (SELECT series_id, v FROM s UNION ALL SELECT series_id, 0.0 FROM (SELECT series_id, unnest(range(count(*), 100)) FROM s GROUP BY series_id))
SELECT series_id, {_grid_sql("avg(v)", 6)} AS mean, {_grid_sql("median(v)", 6)} AS median FROM p GROUP BY series_id
"""


SELECTED = ["total_sum", "mean", "std_dev", "variance", "energy", "turning_points", "median", "slope", "abs_max"]


def _selected(target: str | None) -> Callable[[SparkSession, str], DataFrame]:
    """Each feature's state and, with a target, p-value."""
    level = 0.5

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("series_id"), "label", (F.col("label") % 2).alias("odd"))
        table = ops.extract(_embeddings(spark, sf_dir), SELECTED)
        if target is not None:  # else sums in another order would part equal values
            table = table.select("series_id", *[_grid(F.col(n), 9).alias(n) for n in SELECTED])
        found = select_features(table.join(labels, "series_id"), SELECTED, target, fdr_level=level)
        state = lambda n: "constant" if n in found.constant else "correlated" if n in found.correlated else "kept" if n in found.kept else "insignificant"
        p_value = lambda n: math.floor(found.p_values[n] * 1e6 + _OFFSET) / 1e6 if n in found.p_values else None
        if target is None:
            return spark.createDataFrame([(n, state(n)) for n in SELECTED], "feature string, state string")
        return spark.createDataFrame([(n, state(n), p_value(n)) for n in SELECTED], "feature string, state string, p_value double")

    return query


_SELECTED_SQL = ["sum(v)", "avg(v)", "stddev_samp(v)", "var_samp(v)", "sum(v * v)", "0.0", "median(v)", "regr_slope(v, pos)", "max(abs(v))"]
_STATE = "CASE WHEN n.i NOT IN (SELECT i FROM k) THEN 'constant' WHEN list_contains((SELECT gone FROM r WHERE i = 9), n.i) THEN 'correlated'"

# Student's t of whole degrees of freedom: its finite series in the angle whose tangent is t / sqrt(freedom).
_T_TEST = """
m AS (SELECT i, count(x) FILTER (y = 0) AS n0, count(x) FILTER (y = 1) AS n1, avg(x) FILTER (y = 0) - avg(x) FILTER (y = 1) AS d, var_samp(x) FILTER (y = 0) AS v0, var_samp(x) FILTER (y = 1) AS v1 FROM t GROUP BY i),
q AS (SELECT i, n0 + n1 - 2 AS f, abs(d) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)) AS t FROM m),
u AS (SELECT *, unnest(range(0, f // 2)) AS j FROM q),
w AS (SELECT i, exp(sum(CASE WHEN j = 0 THEN 0 WHEN f % 2 = 0 THEN ln((2 * greatest(j, 1) - 1) / (2.0 * greatest(j, 1))) ELSE ln(2 * greatest(j, 1) / (2.0 * j + 1)) END) OVER (PARTITION BY i ORDER BY j) + j * ln(f / (f + t * t))) AS x FROM u),
p AS (SELECT i, greatest(1 - CASE WHEN f % 2 = 0 THEN t / sqrt(f + t * t) * z ELSE 2 / pi() * (atan(t / sqrt(f)) + t * sqrt(f) / (f + t * t) * z) END, 0) AS p FROM q JOIN (SELECT i, sum(x) AS z FROM w GROUP BY i) USING (i))"""

# Discordant pairs by running counts of each label; the normal tail by the series of the error function.
_KENDALL = """
a AS (SELECT i, x, y, count(*) AS c FROM t GROUP BY ALL),
e AS (SELECT d.i, d.x, l.y, coalesce(a.c, 0) AS c FROM (SELECT DISTINCT i, x FROM a) d CROSS JOIN (SELECT DISTINCT y FROM a) l LEFT JOIN a ON a.i = d.i AND a.x = d.x AND a.y = l.y),
h AS (SELECT *, sum(c) OVER (PARTITION BY i, y ORDER BY x) - c AS before FROM e),
o AS (SELECT *, sum(before) OVER (PARTITION BY i, x ORDER BY y DESC) - before AS above FROM h),
d AS (SELECT i, CAST(sum(c * above) AS DOUBLE) AS d FROM o GROUP BY i),
n AS (SELECT i, CAST(sum(c) AS DOUBLE) AS n, CAST(sum(c * (c - 1) // 2) AS DOUBLE) AS ties FROM a GROUP BY i),
tx AS (SELECT i, CAST(sum(c * (c - 1) // 2) AS DOUBLE) AS p, sum(CAST(c AS DOUBLE) * (c - 1) * (c - 2)) AS t, sum(CAST(c AS DOUBLE) * (c - 1) * (2 * c + 5)) AS s FROM (SELECT i, sum(c) AS c FROM a GROUP BY i, x) GROUP BY i),
ty AS (SELECT i, CAST(sum(c * (c - 1) // 2) AS DOUBLE) AS p, sum(CAST(c AS DOUBLE) * (c - 1) * (c - 2)) AS t, sum(CAST(c AS DOUBLE) * (c - 1) * (2 * c + 5)) AS s FROM (SELECT i, sum(c) AS c FROM a GROUP BY i, y) GROUP BY i),
q AS (SELECT i, abs(n * (n - 1) / 2 - tx.p - ty.p + ties - 2 * d) / sqrt(2 * ((n * (n - 1) * (2 * n + 5) - tx.s - ty.s) / 18 + 2 * tx.p * ty.p / (n * (n - 1)) + tx.t * ty.t / (9 * n * (n - 1) * (n - 2)))) AS z FROM n JOIN d USING (i) JOIN tx USING (i) JOIN ty USING (i)),
u AS (SELECT i, least(z, 12) AS z, unnest(range(0, 600)) AS j FROM q),
w AS (SELECT i, exp(j * ln(2) + (2 * j + 1) * ln(greatest(z, 1e-300)) - z * z - sum(ln(2 * j + 1)) OVER (PARTITION BY i ORDER BY j)) AS x FROM u),
p AS (SELECT i, greatest(1 - 2 / sqrt(pi()) * sum(x), 0) AS p FROM w GROUP BY i)"""


def _select_sql(label: str = "", test: str = "", level: float = 0.5) -> str:
    """The greedy pass over correlated pairs as a recursion over the features in order; with a
    label the test and the step-up over its p-values."""
    made = ", ".join(_grid_sql(e, 9) if label else e for e in _SELECTED_SQL)
    both = f"""WITH RECURSIVE s AS ({SERIES_SQL["embeddings"]}),
f AS (SELECT series_id, [{made}] AS x FROM s GROUP BY series_id),
l AS (SELECT series_id, unnest(range(1, 10)) AS i, unnest(x) AS x FROM f),
k AS (SELECT i FROM l GROUP BY i HAVING stddev_pop(x) > 0),
c AS (SELECT a.i, b.i AS j FROM l a JOIN l b ON a.series_id = b.series_id AND a.i < b.i WHERE a.i IN (SELECT i FROM k) AND b.i IN (SELECT i FROM k) GROUP BY a.i, b.i HAVING abs(corr(a.x, b.x)) > 0.98),
g AS (SELECT list(i * 10 + j) AS close FROM c),
r AS (SELECT 0 AS i, CAST([] AS BIGINT[]) AS gone UNION ALL
      SELECT r.i + 1, CASE WHEN list_contains(gone, r.i + 1) THEN gone ELSE list_concat(gone, list_transform(list_filter(coalesce(close, []), lambda z: z // 10 = r.i + 1), lambda z: z % 10)) END FROM r, g WHERE r.i < 9)"""
    if not label:
        return f"{both} SELECT {SELECTED}[n.i] AS feature, {_STATE} ELSE 'kept' END AS state FROM range(1, 10) n(i)"
    return f"""{both},
t AS (SELECT l.i, l.x, y.y FROM l JOIN (SELECT CAST(vec_id AS VARCHAR) AS series_id, {label} AS y FROM embeddings) y USING (series_id)
      WHERE l.i IN (SELECT i FROM k) AND NOT list_contains((SELECT gone FROM r WHERE i = 9), l.i)),{test},
b AS (SELECT *, row_number() OVER (ORDER BY p, i) AS place, count(*) OVER () AS tests FROM p),
z AS (SELECT coalesce(max(place) FILTER (p <= place / tests * {level}), 0) AS last FROM b)
SELECT {SELECTED}[n.i] AS feature, {_STATE} WHEN b.place <= z.last THEN 'kept' ELSE 'insignificant' END AS state, {_grid_sql("b.p", 6)} AS p_value
FROM range(1, 10) n(i) CROSS JOIN z LEFT JOIN b ON b.i = n.i"""


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]]:
    out = {}
    for name, (_, digits, series, _) in SQL.items():
        out[f"static_{_key(name)}"] = (_run([name], series, "static", [digits]), _features_sql([name], series, "static"))
    for name, (_, digits) in WHOLE_SQL.items():
        out[f"static_{_key(name)}"] = (_run([name], "embeddings", "static", [digits]), _whole_sql(name, "embeddings"))
    for mode in ("expanding", "sliding"):
        for family in FAMILIES:
            by: dict[str, list[str]] = {}
            for n, x in SQL.items():
                if x[3] == family:  # one kind of chunk at a time
                    by.setdefault(n if n.startswith("agg_linear") and "pvalue" not in n else "", []).append(n)
            for one, names in by.items():
                series = "embeddings" if family in ("spectral", "counts") else "events"
                out[f"{mode}_{_key(one or family)}"] = (_run(names, series, mode, [SQL[n][1] for n in names]), _features_sql(names, series, mode))
        for name, (_, digits) in WHOLE_SQL.items():
            out[f"{mode}_{_key(name)}"] = (_run([name], "embeddings", mode, [digits]), _whole_sql(name, "embeddings", mode))
    short = {"total_sum": 2, "mean": 4, "variance": 0, "median": 4, "kurtosis": 5, "slope": 3, "autocorr-3": 6, "c3-2": -6, "paa-6-4": 4, "auc": 2}  # large values, so a coarser grid
    out["static_short_series"] = (_run(list(short), "orders", "static", list(short.values())), _features_sql(list(short), "orders", "static", list(short.values())))
    stream_sql = _features_sql(STREAMED, "events", "expanding")
    out["stream_expanding"] = (stream_expanding, f'SELECT * EXCLUDE (end_pos) FROM ({stream_sql}) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY end_pos DESC) = 1')
    out["stream_sliding"] = (stream_sliding, _features_sql(STREAMED, "events", "sliding"))
    out["source_wide"], out["source_padded"] = (source_wide, SOURCE_WIDE), (source_padded, SOURCE_PADDED)
    out["select_unsupervised"] = (_selected(None), _select_sql())
    out["select_two_classes"], out["select_kendall"] = (_selected("odd"), _select_sql("label % 2", _T_TEST)), (_selected("label"), _select_sql("label", _KENDALL))
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments and order statistics of each user's events."""
    return ops.extract(_events(spark, sf_dir), ["total_sum", "mean", "std_dev", "min_value", "max_value", "median", "skewness", "kurtosis"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s}
