"""Feature selection: constant, correlated and insignificant features go.

All statistics are aggregates over the feature table, so rows never reach the driver;
what does is a number for each feature, or pair of features.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Selection:
    """kept: names in the order of the result. p_values: of the features that were tested."""

    frame: DataFrame
    kept: list[str]
    constant: list[str]
    correlated: list[str]
    p_values: dict[str, float]


def constant_features(df: DataFrame, features: list[str]) -> list[str]:
    """Those whose population standard deviation, without nulls and NaN, isn't above 0."""
    clean = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    row = df.agg(*[F.stddev_pop(clean(c)).alias(f"s{k}") for k, c in enumerate(features)]).first()
    return [c for k, c in enumerate(features) if not (row[k] or 0) > 0]


def correlated_features(df: DataFrame, features: list[str], threshold: float = 0.98, at_once: int = 512) -> list[str]:
    """In order, each feature that isn't dropped drops the later ones whose absolute
    correlation with it is above threshold. Rows in which either of two features is null don't
    count for them; a feature with NaN or infinite values correlates with none that is there.

    One pass gives all pairs of at_once features; of more, each pair of blocks takes one."""
    x = lambda c: F.col(f"`{c}`").cast("double")
    means = df.agg(*[F.avg(F.when(F.abs(x(c)) < float("inf"), x(c))).alias(f"m{k}") for k, c in enumerate(features)]).first()
    blocks = [range(k, min(k + at_once, len(features))) for k in range(0, len(features), at_once)]
    close: dict[int, set[int]] = {}
    for n, left in enumerate(blocks):
        for right in blocks[n:]:
            for i, j in _close_pairs(df.select(*[x(features[k]).alias(f"c{k}") for k in sorted({*left, *right})]), left, right, [m or 0.0 for m in means], threshold):
                close.setdefault(i, set()).add(j)
    gone: set[int] = set()
    for i in range(len(features)):
        if i not in gone:
            gone |= close.get(i, set())
    return [features[i] for i in sorted(gone)]


def _close_pairs(columns: DataFrame, left: range, right: range, means: list[float], threshold: float) -> list[tuple[int, int]]:
    """Pairs i < j of left and right whose absolute correlation is above threshold. Each task adds
    up products of matrices of centred values; a feature's sums meet in one row."""
    size = len(right)

    def add_up(batches):
        import numpy as np
        import pyarrow as pa

        sums = np.zeros((7, len(left), size))

        def values(batch, of):  # centred values, 1 where there is one, 1 where it isn't finite
            raw = [batch.column(f"c{k}") for k in of]
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in raw])
            v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in raw]) - np.array([means[k] for k in of])
            sound = there & np.isfinite(v)
            return np.where(sound, v, 0.0), there.astype(float), (there & ~sound).astype(float)

        for batch in batches:
            (a, in_a, bad_a), (b, in_b, bad_b) = values(batch, left), values(batch, right)
            sums += [in_a.T @ in_b, a.T @ in_b, in_a.T @ b, (a * a).T @ in_b, in_a.T @ (b * b), a.T @ b, bad_a.T @ in_b + in_a.T @ bad_b]
        yield pa.RecordBatch.from_arrays([pa.array(list(left), pa.int64()), pa.array([sums[:, i].tobytes() for i in range(len(left))], pa.binary())], ["i", "sums"])

    def compare(table):
        import numpy as np
        import pyarrow as pa

        i = table["i"][0].as_py()
        total = np.zeros(7 * size)
        for part in table["sums"]:
            total += np.frombuffer(part.as_buffer(), np.float64)
        n, a, b, aa, bb, ab, bad = total.reshape(7, size)
        n = np.maximum(n, 1)
        spread = np.sqrt(np.maximum(aa - a * a / n, 0) * np.maximum(bb - b * b / n, 0))
        found = [j for k, j in enumerate(right) if j > i and not bad[k] and spread[k] > 0 and abs(ab[k] - a[k] * b[k] / n[k]) > threshold * spread[k]]
        return pa.table({"i": pa.array([i] * len(found), pa.int64()), "j": pa.array(found, pa.int64())})

    sums = columns.mapInArrow(add_up, "i long, sums binary")
    return [(r["i"], r["j"]) for r in sums.groupBy("i").applyInArrow(compare, "i long, j long").collect()]


def _log_beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _log_beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _log_beta_fraction(b, a, 1 - x) / b


def t_test_p(t: float, freedom: float) -> float:
    """Two-sided p-value of Student's t."""
    return _beta(freedom / 2, 0.5, freedom / (freedom + t * t))


def two_class_p_values(df: DataFrame, features: list[str], label: str) -> dict[str, float]:
    """Pooled-variance t-test of label 0 against 1; 1 where a group has one row or fewer, or no
    variance is left."""
    y = F.col(f"`{label}`")
    parts = []
    for k, c in enumerate(features):
        for g in (0, 1):
            x = F.when(y == g, F.col(f"`{c}`").cast("double"))
            parts += [F.count(x).alias(f"n{k}_{g}"), F.avg(x).alias(f"m{k}_{g}"), F.var_samp(x).alias(f"v{k}_{g}")]
    row = df.agg(*parts).first()
    out = {}
    for k, c in enumerate(features):
        (n0, m0, v0), (n1, m1, v1) = ([row[f"{s}{k}_{g}"] for s in "nmv"] for g in (0, 1))
        out[c] = 1.0
        if n0 > 1 and n1 > 1:
            pooled = ((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)
            if pooled > 0 and math.isfinite(pooled):
                out[c] = t_test_p((m0 - m1) / math.sqrt(pooled * (1 / n0 + 1 / n1)), n0 + n1 - 2)
            elif pooled == 0 and m0 != m1:
                out[c] = 0.0
    return out


def _exact_kendall(n: int, discordant: int) -> float:
    """Two-sided p-value without ties, from the number of permutations with so many inversions."""
    fewest = min(discordant, n * (n - 1) // 2 - discordant)
    counts = [1]
    for k in range(2, n + 1):
        sums, total = [], 0
        for i in range(len(counts) + k - 1):
            total += counts[i] if i < len(counts) else 0
            total -= counts[i - k] if i >= k else 0
            sums.append(total)
        counts = sums
    return 1.0 if 2 * fewest == n * (n - 1) // 2 else min(1.0, 2 * sum(counts[: fewest + 1]) / math.factorial(n))


def _inversions(values: list) -> int:
    """Pairs out of order: sorted runs are merged, all runs of a length at once."""
    import numpy as np

    n = len(values)
    if n < 2:
        return 0
    ranks = np.unique(np.asarray(values), return_inverse=True)[1].astype(np.int64)
    x = np.full(1 << (n - 1).bit_length(), n, np.int64)  # filled up with what is never before anything
    x[:n] = ranks
    width, total = 1, 0
    while width < len(x):
        pairs = x.reshape(-1, 2, width)
        run = np.arange(len(pairs))[:, None] * (n + 1)
        left, right = (pairs[:, 0] + run).ravel(), (pairs[:, 1] + run).ravel()
        upto = np.searchsorted(left, right, "right").reshape(len(pairs), width)
        total += int(((np.arange(len(pairs))[:, None] + 1) * width - upto).sum())
        x = np.sort(pairs.reshape(-1, 2 * width), axis=1).ravel()
        width *= 2
    return total


@dataclass(frozen=True)
class Ties:
    """Over the sizes c of groups of equal values: sums of c(c-1)/2, c(c-1)(c-2), c(c-1)(2c+5)."""

    pairs: int
    triples: int
    spread: int

    @staticmethod
    def of(sizes: list[int]) -> "Ties":
        return Ties(sum(c * (c - 1) // 2 for c in sizes), sum(c * (c - 1) * (c - 2) for c in sizes), sum(c * (c - 1) * (2 * c + 5) for c in sizes))


def kendall_from_counts(n: int, discordant: int, x: Ties, y: Ties, both: int) -> float:
    """p-value of Kendall's tau-b: exact for up to 33 rows without ties (or with few
    discordant pairs), else by the normal limit with ties; 1 if a side is constant. both:
    pairs that are equal in both."""
    total = n * (n - 1) // 2
    if n < 2 or x.pairs == total or y.pairs == total:
        return 1.0
    if not x.pairs and not y.pairs and (n <= 33 or min(discordant, total - discordant) <= 1):
        return _exact_kendall(n, discordant)
    score = total - x.pairs - y.pairs + both - 2 * discordant
    m = n * (n - 1.0)
    var = (m * (2 * n + 5) - x.spread - y.spread) / 18 + 2 * x.pairs * y.pairs / m + (x.triples * y.triples / (9 * m * (n - 2)) if n > 2 else 0)
    return math.erfc(abs(score) / math.sqrt(var) / math.sqrt(2)) if var > 0 else 1.0


def kendall_p(x: list[float], y: list[float]) -> float:
    """Kendall's test of two columns that fit into one task."""
    sizes = lambda values: [len(list(g)) for _, g in groupby(sorted(values))]
    pairs = sorted(zip(x, y))
    return kendall_from_counts(len(pairs), _inversions([b for _, b in pairs]), Ties.of(sizes(x)), Ties.of(sizes(y)), Ties.of(sizes(pairs)).pairs)


def _tie_sums(long: DataFrame, columns: list[str]) -> dict[str, Ties]:
    c = F.col("count")
    sums = long.groupBy("_feature", *columns).count().where("count > 1").groupBy("_feature").agg(F.sum(c * (c - 1)).alias("p"), F.sum((c * (c - 1) * (c - 2)).cast("decimal(38,0)")).alias("t"), F.sum((c * (c - 1) * (2 * c + 5)).cast("decimal(38,0)")).alias("s"))
    return {r["_feature"]: Ties(r["p"] // 2, int(r["t"]), int(r["s"])) for r in sums.collect()}


def _discordant(long: DataFrame, blocks: int) -> dict[str, int]:
    """Discordant pairs of each feature. Both sides are cut into blocks of values. Pairs in
    different blocks on both sides are counted from the table of block sizes; pairs in the
    same block of x in a task for that block, and those in different blocks of x but the
    same of y in a task for that. Blocks of a single value have none and are left out, so
    a hot value goes to no task."""
    share = [k / blocks for k in range(1, blocks)]
    edges = long.groupBy("_feature").agg(F.percentile_approx("_x", share).alias("_ex"), F.percentile_approx("_y", share).alias("_ey"))
    block = lambda v, e: F.size(F.filter(e, lambda b: b < F.col(v)))
    rows = long.join(F.broadcast(edges), "_feature")  # 2 * blocks numbers for each feature
    rows = rows.select("_feature", "_x", "_y", block("_x", "_ex").alias("_bx"), block("_y", "_ey").alias("_by"))

    def between(t):  # a feature's table of block sizes, of blocks ** 2 numbers at most
        import numpy as np
        import pyarrow as pa

        sizes = np.zeros((blocks + 1, blocks + 2), object)
        sizes[t["_bx"].to_numpy(), t["_by"].to_numpy()] = t["count"].to_numpy().astype(object)
        above = np.cumsum(np.cumsum(sizes, axis=0)[:, ::-1], axis=1)[:, ::-1]  # of blocks up to x and from y on
        return pa.table({"_feature": t["_feature"][:1], "n": pa.array([int((sizes[1:, :-1] * above[:-1, 1:]).sum())], pa.int64())})

    table = rows.groupBy("_feature", "_bx", "_by").count()
    out = {r["_feature"]: r["n"] for r in table.groupBy("_feature").applyInArrow(between, "_feature string, n long").collect()}

    def inside(by: str, of: str, order: list[str]) -> None:
        several = rows.groupBy("_feature", by).agg(F.min(of).alias("lo"), F.max(of).alias("hi")).where("lo < hi").select("_feature", by)

        def count(t):
            import pyarrow as pa

            found = _inversions([y for _, y in sorted(zip(t[order[0]].to_pylist(), t["_y"].to_pylist()))])
            return pa.table({"_feature": t["_feature"][:1], "n": pa.array([found], pa.int64())})

        counts = rows.join(several, ["_feature", by]).groupBy("_feature", by).applyInArrow(count, "_feature string, n long")
        for r in counts.groupBy("_feature").agg(F.sum("n").alias("n")).collect():
            out[r["_feature"]] += r["n"]

    inside("_bx", "_x", ["_x"])
    inside("_by", "_y", ["_bx"])
    return out


def kendall_p_values(df: DataFrame, features: list[str], target: str, rows_in_task: int = 100_000) -> dict[str, float]:
    """Kendall's test of each feature against a target of any number of values. Up to
    rows_in_task rows a feature is a task's work; beyond, it is cut into blocks. Rows in which
    the feature or the target is null or NaN don't count for that feature; without rows: 1."""
    long = df.select(F.col(f"`{target}`").cast("double").alias("_y"), *[F.col(f"`{c}`").cast("double").alias(c) for c in features]).unpivot("_y", features, "_feature", "_x")
    long = long.where("_x is not null and _y is not null and not isnan(_x) and not isnan(_y)")
    counts = {r["_feature"]: r["count"] for r in long.groupBy("_feature").count().collect()}
    n = max(counts.values(), default=0)
    if n > rows_in_task:
        discordant = _discordant(long, min(256, -(-n // rows_in_task) + 1))
        none = Ties(0, 0, 0)
        x, y, both = (_tie_sums(long, c) for c in (["_x"], ["_y"], ["_x", "_y"]))
        return {c: kendall_from_counts(counts.get(c, 0), discordant.get(c, 0), x.get(c, none), y.get(c, none), both.get(c, none).pairs) for c in features}

    def test(table):
        import pyarrow as pa

        p = kendall_p(table["_x"].to_pylist(), table["_y"].to_pylist())
        return pa.table({"_feature": table["_feature"][:1], "p": pa.array([p])})

    found = {r["_feature"]: r["p"] for r in long.groupBy("_feature").applyInArrow(test, "_feature string, p double").collect()}
    return {c: found.get(c, 1.0) for c in features}


def benjamini_hochberg(p_values: dict[str, float], level: float = 0.05) -> list[str]:
    """Step-up: names in the order of their p-values, up to the last p within rank / m * level."""
    order = sorted(p_values, key=lambda c: p_values[c])
    last = max((k for k, c in enumerate(order, 1) if p_values[c] <= k / len(order) * level), default=0)
    return order[:last]


def select_features(df: DataFrame, features: list[str], target: str | None = None, correlation_threshold: float = 0.98, fdr_level: float = 0.05) -> Selection:
    """df with its other columns and the selected features. Without a target only constant and
    correlated features go. Two distinct labels: t-test; otherwise Kendall's test."""
    others = [c for c in df.columns if c not in features]
    constant = constant_features(df, features) if features else []
    left = [c for c in features if c not in constant]
    correlated = correlated_features(df, left, correlation_threshold) if len(left) > 1 else []
    left = [c for c in left if c not in correlated]
    p_values: dict[str, float] = {}
    if target is not None and left:
        two = df.select(target).distinct().limit(3).count() == 2
        p_values = two_class_p_values(df, left, target) if two else kendall_p_values(df, left, target)
        p_values = {c: 1.0 if math.isnan(p) else p for c, p in p_values.items()}
        left = benjamini_hochberg(p_values, fdr_level)
    return Selection(df.select(*[F.col(f"`{c}`") for c in [*others, *left]]), left, constant, correlated, p_values)
