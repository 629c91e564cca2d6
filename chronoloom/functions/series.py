"""Every feature of one series in numpy: for streams, and to test the plans against."""

from __future__ import annotations

import math

import numpy as np

from ..plans.features import ARRAY, EXPANDING, SLIDING, STATIC, TINY, _from_array
from ..specs import FeatureSpec


def _trend(x: np.ndarray, part: str, length: int, function: str) -> float:
    m = len(x) // length
    if m < 2 or part == "pvalue":
        return 0.0
    y = getattr(np, function)(x[: m * length].reshape(m, length), axis=1)
    k = np.arange(m)
    sxx, sst = ((k - k.mean()) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    slope = ((k - k.mean()) * (y - y.mean())).sum() / sxx
    rest = ((y - y.mean() - slope * (k - k.mean())) ** 2).sum()
    match part:
        case "slope":
            return slope
        case "intercept":
            return y.mean() - slope * k.mean()
        case "stderr":
            return math.sqrt(rest / (m - 2) / sxx) if m > 2 else 0.0
    return math.sqrt(max(0.0, 1 - rest / sst)) * np.sign(slope) if sst > TINY else 0.0


def _longest(inside: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def _benford(x: np.ndarray) -> float:
    digits = np.array([int(f"{abs(v):.15e}"[0]) for v in x if v != 0])
    if not len(digits):
        return 0.0
    p = np.bincount(digits, minlength=10)[1:10] / len(digits)
    b = np.log10(1 + 1 / np.arange(1, 10))
    return float(np.corrcoef(p, b)[0, 1]) if p.std() > 0 else 0.0


def feature(x: np.ndarray, spec: FeatureSpec, mode: str = STATIC, textbook: bool = False) -> float:
    """A feature of a series of at least one point."""
    n, p, d = len(x), spec.params, np.diff(x)
    mean = x.mean()
    var = x.var(ddof=1) if n > 1 else 0.0
    m2 = ((x - mean) ** 2).sum()
    twice = mode == STATIC and not textbook and n >= 4
    if spec.kind in ARRAY:
        return float(_from_array(spec, mode, None, textbook)(x))
    match spec.kind:
        case "total_sum":
            return x.sum()
        case "mean":
            return mean
        case "variance":
            return var
        case "std_dev":
            return math.sqrt(var)
        case "min_value":
            return x.min()
        case "max_value":
            return x.max()
        case "abs_max":
            return np.abs(x).max()
        case "energy":
            return (x * x).sum()
        case "rms" | "root_mean_square":
            return math.sqrt((x * x).mean())
        case "skewness":
            return ((x - mean) ** 3).mean() / (m2 / n) ** 1.5 if var > TINY else 0.0
        case "kurtosis" | "biased_fisher_kurtosis":
            if var <= TINY:
                return 0.0
            g = ((x - mean) ** 4).mean() / (m2 / n) ** 2 - 3
            if spec.kind != "kurtosis":
                return g
            return (n - 1) * ((n + 1) * g + 6) / ((n - 2) * (n - 3)) if n > 3 else 0.0
        case "variation_coefficient":
            return math.sqrt(var) / mean if abs(mean) > TINY else 0.0
        case "mean_n_absolute_max":
            return np.sort(np.abs(x))[::-1][: p[0]].mean() if p[0] else 0.0
        case "median":
            return np.median(x)
        case "iqr":
            return np.quantile(x, 0.75) - np.quantile(x, 0.25)
        case "quantile":
            return np.quantile(x, p[0])
        case "mad":
            return np.abs(x - mean).mean()
        case "count_above_mean":
            return (x > mean).sum()
        case "count_below_mean":
            return (x < mean).sum()
        case "longest_strike_above_mean":
            return _longest(x > mean)
        case "longest_strike_below_mean":
            return _longest(x < mean)
        case "zero_crossing_rate" | "zero_crossing_mean" | "zero_crossing_std":
            at = np.flatnonzero((x[1:] < 0) != (x[:-1] < 0)) + 1
            if spec.kind.endswith("rate"):
                return len(at) / n
            return (at.mean() if spec.kind.endswith("mean") else at.std()) if len(at) else 0.0
        case "peak_count":
            return ((x[1:-1] > x[:-2]) & (x[1:-1] > x[2:])).sum()
        case "slope_sign_change" | "turning_points":
            return (d[1:] * d[:-1] < 0).sum() if textbook else 0.0
        case "max_langevin_fixed_point":
            return 0.0
        case "first_loc_max":
            return x.argmax() / n
        case "last_loc_max":
            return (n - x[::-1].argmax()) / n
        case "first_loc_min":
            return x.argmin() / n
        case "last_loc_min":
            return (n - x[::-1].argmin()) / n
        case "mean_abs_change" | "mean_change":
            by = n if mode == SLIDING and not textbook else n - 1
            return (np.abs(d) if "abs" in spec.kind else d).sum() / by if n > 1 else 0.0
        case "abs_sum_change":
            return np.abs(d).sum()
        case "cid_ce":
            return math.sqrt((d * d).sum())
        case "auc":
            return ((x[1:] + x[:-1]) / 2).sum() + (x[0] if twice else 0.0)
        case "signal_distance":
            return np.sqrt(d * d + 1).sum()
        case "slope" | "intercept":
            i = np.arange(n) - (n - 1) / 2
            slope = (i * x).sum() / (i * i).sum() if n > 1 else 0.0
            return slope if spec.kind == "slope" else mean - slope * (n - 1) / 2
        case "paa":
            edge = (lambda k: math.floor(n * k / p[0] + 0.5)) if mode == STATIC else (lambda k: n * k // p[0])
            part = x[edge(p[1]) : edge(p[1] + 1)]
            return part.mean() if len(part) else 0.0
        case "agg_linear_trend":
            return _trend(x, *p)
        case "autocorr_lag1":
            if var <= TINY:
                return 0.0
            product = (x[1:] * x[:-1]).sum() + (x[0] ** 2 if twice else 0.0)
            return (product - mean * (2 * x.sum() - x[0] - x[-1]) + (n - 1) * mean**2) / m2
        case "autocorr":
            lag = p[0]
            if var <= TINY or n <= lag:
                return 0.0
            return ((x[:-lag] - mean) * (x[lag:] - mean)).sum() / ((n - lag) * var if mode == EXPANDING and not textbook else m2)
        case "c3":
            k = p[0]
            return (x[2 * k :] * x[k : n - k] * x[: n - 2 * k]).mean() if n > 2 * k else 0.0
        case "time_reversal_asymmetry":
            k = p[0]
            return (x[2 * k :] ** 2 * x[k : n - k] - x[k : n - k] * x[: n - 2 * k] ** 2).mean() if n > 2 * k else 0.0
        case "entropy":
            spread = x.max() - x.min()
            if spread <= TINY:
                return 0.0
            share = np.bincount(np.floor((x - x.min()) / spread * 9).astype(int)) / n
            return -(share[share > 0] * np.log(share[share > 0])).sum()
        case "benford_correlation":
            return _benford(x)
        case "sum_of_reoccurring_values" | "sum_of_reoccurring_data_points":
            values, counts = np.unique(x, return_counts=True)
            again = counts > 1
            return (values[again] * (counts[again] if spec.kind.endswith("points") else 1)).sum()
        case "index_mass_quantile":
            mass = np.cumsum(np.abs(x))
            return (np.argmax(mass >= p[0] * mass[-1]) + 1) / n
        case "fft_coeff":
            c = (x * np.exp(-2j * np.pi * p[0] * np.arange(n) / n)).sum()
            return {"real": c.real, "imag": c.imag, "abs": abs(c), "angle": math.degrees(math.atan2(c.imag, c.real))}[p[1]]
        case "wavelet":
            gap = x[: n // 2 * 2 : 2] - x[1 : n // 2 * 2 : 2]
            return (np.abs(gap).mean() if p[1] == 0 else math.sqrt((gap * gap).mean())) if len(gap) else 0.0
        case "spectrogram":
            return abs(x.sum())
    raise ValueError(spec.kind)


def compute(x: np.ndarray, specs: list[FeatureSpec], mode: str = STATIC, textbook: bool = False) -> list[float]:
    return [float(feature(x, s, mode, textbook)) for s in specs]
