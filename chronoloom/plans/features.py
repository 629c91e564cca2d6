"""From feature specs to one window stage and one aggregation.

The frame is long: key columns, ``pos`` (0-based and dense within the keys) and ``v``.
Only the helper columns that the requested features need are made. All window functions
and the aggregation share the keys' partitioning, so there is one exchange of the rows;
without helper columns the aggregation is partial before that exchange. Features that
need a whole series at once get it as an array from the same aggregation and run in one
Arrow function, over batches of series.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..specs import FeatureSpec

STATIC, EXPANDING, SLIDING = "static", "expanding", "sliding"
TINY = 1e-9
#: Features that are always zero: accepted names without a meaning of their own.
ZERO = ("slope_sign_change", "turning_points", "max_langevin_fixed_point")
ARRAY = ("autocorrelation", "partial_autocorr", "approx_entropy", "spectral_centroid", "spectral_distance", "spectral_decrease", "spectral_slope", "human_range_energy")


def _div(a, b) -> Column:
    return F.try_divide(a, b)


def _or0(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


class After:
    """A feature as an expression over parts, columns of the aggregation's result."""

    def __init__(self, column: Column):
        self.column = column


class Planner:
    """Helper columns and aggregates for one request."""

    def __init__(self, keys: list[str], mode: str = STATIC, max_size: int | None = None, textbook: bool = False):
        if mode not in (STATIC, EXPANDING, SLIDING):
            raise ValueError(f"unknown mode: {mode!r}")
        self.mode, self.max_size, self.textbook = mode, max_size, textbook
        self.all = Window.partitionBy(*keys)
        self.ordered = self.all.orderBy("pos")
        self.running = self.ordered.rowsBetween(Window.unboundedPreceding, 0)
        self.keys = keys
        self.levels: list[dict[str, Column]] = [{}, {}]
        self.parts: dict[str, Column] = {}

    def helper(self, name: str, column: Column, level: int = 0) -> Column:
        self.levels[level][name] = column
        return F.col(name)

    def part(self, name: str, aggregate: Column) -> Column:
        """An aggregate that several expressions use, made once."""
        self.parts[name] = aggregate
        return F.col(name)

    # helper columns

    def before(self, lag: int = 1) -> Column:
        return self.helper(f"_lag{lag}", F.lag("v", lag).over(self.ordered))

    def after(self, lag: int = 1) -> Column:
        return self.helper(f"_lead{lag}", F.lead("v", lag).over(self.ordered))

    def mean(self) -> Column:
        return self.helper("_mean", F.avg("v").over(self.all))

    def size(self) -> Column:
        return self.helper("_size", F.count("v").over(self.all))

    def low(self) -> Column:
        return self.helper("_low", F.min("v").over(self.all))

    def high(self) -> Column:
        return self.helper("_high", F.max("v").over(self.all))

    def run(self, above: bool) -> Column:
        """Length of the run of values above (below) the mean that ends here."""
        v, name = F.col("v"), "_run_above" if above else "_run_below"
        inside = v > self.mean() if above else v < self.mean()
        breaks = F.max(F.when(~inside, F.col("pos"))).over(self.running)
        return self.helper(name, F.when(inside, F.col("pos") - F.coalesce(breaks, F.lit(-1))), 1)

    def fft_size(self) -> Column | int:
        """The transform's length: that of the series, or padded if a size is asked for."""
        if not self.max_size or self.mode == SLIDING:
            return self.size()
        # sizes above max_size are padded too
        return self.helper("_fft_size", F.when(self.size() <= self.max_size, F.lit(kernels.next_good_fft_size(self.max_size))).otherwise(padded_sizes()(self.size())), 1)

    # features

    def aggregate(self, spec: FeatureSpec) -> Column | After:
        """The feature as an expression over aggregates, or over parts."""
        made = getattr(self, "_" + spec.kind)(*spec.params)
        return After(_or0(made.column.cast("double"))) if isinstance(made, After) else _or0(made.cast("double"))

    @property
    def v(self) -> Column:
        return F.col("v")

    @property
    def pos(self) -> Column:
        return F.col("pos")

    @property
    def n(self) -> Column:
        return F.count("v")

    @property
    def var(self) -> Column:
        return _or0(F.var_samp("v"))

    def _total_sum(self):
        return F.sum("v")

    def _mean(self):
        return F.avg("v")

    def _variance(self):
        return F.var_samp("v")

    def _std_dev(self):
        return F.stddev_samp("v")

    def _min_value(self):
        return F.min("v")

    def _max_value(self):
        return F.max("v")

    def _abs_max(self):
        return F.max(F.abs("v"))

    def _energy(self):
        return F.sum(self.v * self.v)

    def _rms(self):
        return F.sqrt(F.avg(self.v * self.v))

    _root_mean_square = _rms

    def _skewness(self):
        return F.when(self.var > TINY, F.skewness("v"))

    def _biased_fisher_kurtosis(self):
        return F.when(self.var > TINY, F.kurtosis("v"))

    def _kurtosis(self):
        n = self.n.cast("double")
        return F.when((self.var > TINY) & (n > 3), _div((n - 1) * ((n + 1) * F.kurtosis("v") + 6), (n - 2) * (n - 3)))

    def _variation_coefficient(self):
        return F.when(F.abs(F.avg("v")) > TINY, _div(F.stddev_samp("v"), F.avg("v")))

    def _mean_n_absolute_max(self, count: int):
        place = self.helper("_abs_place", F.row_number().over(self.all.orderBy(F.abs("v").desc(), "pos")))
        return F.avg(F.when(place <= count, F.abs("v")))

    def _median(self):
        return F.median("v")

    def _iqr(self):
        return F.percentile("v", F.lit(0.75)) - F.percentile("v", F.lit(0.25))

    def _quantile(self, q: float):
        return F.percentile("v", F.lit(q))

    def _mad(self):
        return F.avg(F.abs(self.v - self.mean()))

    def _count_above_mean(self):
        return F.count_if(self.v > self.mean())

    def _count_below_mean(self):
        return F.count_if(self.v < self.mean())

    def _longest_strike_above_mean(self):
        return F.max(self.run(True))

    def _longest_strike_below_mean(self):
        return F.max(self.run(False))

    def crossing(self) -> Column:
        return (self.v < 0) != (self.before() < 0)

    def _zero_crossing_rate(self):
        return F.count_if(self.crossing()) / self.n

    def _zero_crossing_mean(self):
        return F.avg(F.when(self.crossing(), self.pos))

    def _zero_crossing_std(self):
        return F.stddev_pop(F.when(self.crossing(), self.pos))

    def _peak_count(self):
        return F.count_if((self.v > self.before()) & (self.v > self.after()))

    def turns(self) -> Column:
        return F.count_if((self.v - self.before()) * (self.after() - self.v) < 0)

    def _slope_sign_change(self):
        return self.turns() if self.textbook else F.lit(0.0) * self.n

    _turning_points = _slope_sign_change

    def _max_langevin_fixed_point(self, m: int, r: float):
        return F.lit(0.0) * self.n

    def _first_loc_max(self):
        return -F.max(F.struct(self.v, -self.pos))["col2"] / self.n

    def _last_loc_max(self):
        return (F.max(F.struct(self.v, self.pos))["pos"] + 1) / self.n

    def _first_loc_min(self):
        return F.min(F.struct(self.v, self.pos))["pos"] / self.n

    def _last_loc_min(self):
        return (1 - F.min(F.struct(self.v, -self.pos))["col2"]) / self.n

    def change(self) -> Column:
        return self.v - self.before()

    def changes(self) -> Column:
        return self.n if self.mode == SLIDING and not self.textbook else self.n - 1

    def _mean_abs_change(self):
        return _div(F.sum(F.abs(self.change())), self.changes())

    def _mean_change(self):
        return _div(F.sum(self.change()), self.changes())

    def _abs_sum_change(self):
        return F.sum(F.abs(self.change()))

    def _cid_ce(self):
        return F.sqrt(F.sum(self.change() * self.change()))

    def first_value(self) -> Column:
        return F.min(F.struct(self.pos, self.v))["v"]

    def start_twice(self) -> bool:
        """The static mode pairs the first value with itself in series of four or more."""
        return self.mode == STATIC and not self.textbook

    def _auc(self):
        area = F.sum((self.v + self.before()) / 2)
        return _or0(area) + F.when(self.n >= 4, self.first_value()).otherwise(0.0) if self.start_twice() else area

    def _signal_distance(self):
        return F.sum(F.sqrt(self.change() * self.change() + 1))

    def _slope(self):
        return F.regr_slope("v", "pos")

    def _intercept(self):
        return F.coalesce(F.regr_intercept("v", "pos"), F.avg("v"))

    def _paa(self, total: int, segment: int):
        at = lambda k: self.size() * k / total
        edge = (lambda k: F.round(at(k))) if self.mode == STATIC else (lambda k: F.floor(at(k)))
        return F.avg(F.when((self.pos >= edge(segment)) & (self.pos < edge(segment + 1)), self.v))

    def _agg_linear_trend(self, part: str, length: int, function: str):
        if part == "pvalue":
            return F.lit(0.0) * self.n
        chunk = F.floor(self.pos / length)
        made = {"max": F.max, "min": F.min, "mean": F.avg, "var": F.var_pop}[function]("v")
        value = self.helper(f"_chunk_{length}_{function}", made.over(Window.partitionBy(*self.keys, chunk)))
        last = self.pos % length == length - 1  # of a full chunk
        y, x = F.when(last, value), F.when(last, chunk.cast("double"))
        m, sxx, sst, sxy = F.count(y), F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
        slope = F.when(sxx > TINY, _div(sxy, sxx)).otherwise(0.0)
        rest = F.greatest(sst - slope * sxy, F.lit(0.0))
        out = {
            "slope": slope,
            "intercept": F.avg(y) - slope * F.avg(x),
            "stderr": F.when((m > 2) & (sxx > TINY), F.sqrt(_div(_div(rest, m - 2), sxx))),
            "rvalue": F.when(sst > TINY, F.sqrt(F.greatest(1 - _div(rest, sst), F.lit(0.0))) * F.signum(slope)),
        }[part]
        return F.when(m >= 2, out)

    def squares(self) -> Column:
        return self.var * (self.n - 1)

    def _autocorr_lag1(self):
        mu, n = F.avg("v"), self.n
        first, last = self.first_value(), F.max(F.struct(self.pos, self.v))["v"]
        product = _or0(F.sum(self.v * self.before()))
        if self.start_twice():
            product = product + F.when(n >= 4, first * first).otherwise(0.0)
        return F.when((self.var > TINY) & (n > 1), _div(product - mu * (2 * F.sum("v") - first - last) + (n - 1) * mu * mu, self.squares()))

    def _autocorr(self, lag: int):
        together = F.sum((self.v - self.mean()) * (self.after(lag) - self.mean()))
        by = (self.n - lag) * self.var if self.mode == EXPANDING and not self.textbook else self.squares()
        return F.when((self.var > TINY) & (self.n > lag), _div(together, by))

    def _c3(self, lag: int):
        terms = self.v * self.before(lag) * self.before(2 * lag) if lag else self.v * self.v * self.v
        return F.when(self.n > 2 * lag, F.avg(terms))

    def _time_reversal_asymmetry(self, lag: int):
        if not lag:
            return F.lit(0.0) * self.n
        middle, far = self.after(lag), self.after(2 * lag)
        return F.when(self.n > 2 * lag, F.avg(far * far * middle - middle * self.v * self.v))

    def _entropy(self):
        spread = self.high() - self.low()
        bin_ = self.helper("_bin", F.when(spread > TINY, F.floor((self.v - self.low()) / spread * 9)), 1)
        n = self.part("_n", self.n)
        shares = F.array(*[self.part(f"_bin_{k}", F.count_if(bin_ == k)) / n for k in range(10)])
        return After(-F.aggregate(shares, F.lit(0.0), lambda total, p: total + F.when(p > 0, p * F.log(p)).otherwise(0.0)))

    def _benford_correlation(self):
        # NaN and infinite values have no digit
        size = F.when(F.abs(self.v) < float("inf"), F.abs(self.v))
        exponent = F.floor(F.log10(F.when(size > 0, size)))
        # powers of ten below 1 aren't exact, so small values are multiplied
        power = F.pow(F.lit(10.0), F.abs(exponent))
        scaled = self.helper("_scaled", F.when(exponent < 0, size * power).otherwise(size / power))
        # log10 may be off by one at a power of ten
        digit = self.helper("_digit", F.floor(F.when(scaled >= 10, scaled / 10).when(scaled < 1, scaled * 10).otherwise(scaled)), 1)
        counts = [self.part(f"_digit_{d}", F.count_if(digit == d)) for d in range(1, 10)]
        total = self.part("_digits", F.count(digit))
        laws = [math.log10(1 + 1 / d) for d in range(1, 10)]
        mean = sum(laws) / 9
        # correlation doesn't change with scale, so counts stand for shares
        cross = F.aggregate(F.array(*[c * (b - mean) for c, b in zip(counts, laws)]), F.lit(0.0), lambda t, x: t + x)
        squares = F.aggregate(F.array(*[c * c for c in counts]), F.lit(0).cast("long"), lambda t, x: t + x)
        spread = squares - total * total / 9
        return After(F.when(spread > TINY, _div(cross, F.sqrt(spread * sum((b - mean) ** 2 for b in laws)))))

    def again(self) -> Column:
        same = Window.partitionBy(*self.keys, "v")
        return self.helper("_same", F.count("v").over(same)) > 1

    def _sum_of_reoccurring_values(self):
        first = self.helper("_same_place", F.row_number().over(Window.partitionBy(*self.keys, "v").orderBy("pos"))) == 1
        return F.sum(F.when(self.again() & first, self.v))

    def _sum_of_reoccurring_data_points(self):
        return F.sum(F.when(self.again(), self.v))

    def _index_mass_quantile(self, q: float):
        mass = self.helper("_mass", F.sum(F.abs("v")).over(self.running))
        total = self.helper("_total_mass", F.sum(F.abs("v")).over(self.all))
        return F.coalesce((F.min(F.when(mass >= total * q, self.pos)) + 1) / self.n, F.lit(1.0))

    def _fft_coeff(self, k: int, part: str):
        angle = self.pos * (2 * math.pi * k) / self.fft_size()
        real, imag = F.sum(self.v * F.cos(angle)), -F.sum(self.v * F.sin(angle))
        return {"real": real, "imag": imag, "abs": F.sqrt(real * real + imag * imag), "angle": F.degrees(F.atan2(imag, real))}[part]

    def _wavelet(self, width: int, kind: int):
        gap = F.when(self.pos % 2 == 1, self.change())
        return F.avg(F.abs(gap)) if kind == 0 else F.sqrt(F.avg(gap * gap))

    def _spectrogram(self, t: int, f: int):
        return F.abs(F.sum("v"))


def _from_array(spec: FeatureSpec, mode: str, max_size: int | None, textbook: bool):
    """series -> the feature."""
    p = spec.params
    match spec.kind:
        case "autocorrelation":
            return kernels.autocorr_first_1e
        case "partial_autocorr":
            return lambda x: kernels.partial_autocorr(x, p[0], mode == EXPANDING and not textbook)
        case "approx_entropy":
            return lambda x: kernels.approx_entropy(x, *p)
    kernel = getattr(kernels, spec.kind)

    def spectral(x):
        size = kernels.next_good_fft_size(max(max_size, len(x))) if max_size and mode != SLIDING else None
        return kernel(kernels.spectrum(x, size), *p)

    return spectral


def features(frame: DataFrame, keys: list[str], specs: list[FeatureSpec], mode: str = STATIC, max_size: int | None = None, textbook: bool = False) -> DataFrame:
    """keys and one double column for each spec, in order. Never null."""
    plan = Planner(keys, mode, max_size, textbook)
    whole = [s for s in specs if s.kind in ARRAY]
    made = {s.name: plan.aggregate(s) for s in specs if s.kind not in ARRAY}
    for level in plan.levels:
        if level:
            frame = frame.withColumns(level)
    aggregates = [c.alias(name) for name, c in (made | plan.parts).items() if not isinstance(c, After)]
    if whole:
        aggregates.append(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("_series"))
    out = frame.groupBy(*keys).agg(*(aggregates or [F.count("v").alias("_n")]))
    if whole:
        out = out.withColumn("_whole", whole_series([_from_array(s, mode, max_size, textbook) for s in whole])("_series"))

    def shown(s: FeatureSpec) -> Column:
        if s in whole:
            return F.col("_whole")[whole.index(s)]
        return made[s.name].column if isinstance(made[s.name], After) else F.col(f"`{s.name}`")

    return out.select(*keys, *[shown(s).alias(s.name) for s in specs])


def padded_sizes():
    """An Arrow function from sizes to those of their transforms; each different size of a batch is
    looked for once."""

    @F.arrow_udf("int")
    def run(sizes):
        import numpy as np
        import pyarrow as pa

        kinds, at = np.unique(sizes.to_numpy(zero_copy_only=False), return_inverse=True)
        return pa.array(np.array([kernels.next_good_fft_size(int(n)) for n in kinds], np.int32)[at])

    return run


def whole_series(kernels_: list):
    """An Arrow function from arrays of numbers to an array with each kernel's result."""

    @F.arrow_udf("array<double>")
    def run(series):
        import numpy as np
        import pyarrow as pa

        out = []
        for x in series:
            values = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            out.append([float(k(values)) for k in kernels_])
        return pa.array(out, pa.list_(pa.float64()))

    return run
