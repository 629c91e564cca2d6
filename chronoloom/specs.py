"""Feature requests: names, aliases, parameters, canonical names."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

# The accepted plain names of each feature, its canonical name first, then
# the name of the operator if that differs.
PLAIN = {
    "total_sum": ["value__sum_values"],
    "mean": ["value__mean"],
    "variance": ["value__variance"],
    "std_dev": ["std", "value__standard_deviation"],
    "min_value": ["min", "value__minimum"],
    "max_value": ["max", "value__maximum"],
    "median": ["value__median"],
    "skewness": ["skew", "value__skewness"],
    "kurtosis": ["value__kurtosis", "unbiased_fisher_kurtosis"],
    "biased_fisher_kurtosis": [],
    "mad": [],
    "iqr": [],
    "entropy": [],
    "energy": ["torque_Absolute energy"],
    "rms": [],
    "root_mean_square": [],
    "zero_crossing_rate": [],
    "peak_count": [],
    "autocorr_lag1": ["centered_autocorr_lag1"],
    "autocorrelation": ["autocorr_first_1e"],
    "mean_abs_change": [],
    "mean_change": ["mean_diff", "torque_Mean diff"],
    "cid_ce": [],
    "slope": ["torque_Slope"],
    "intercept": [],
    "abs_sum_change": [],
    "count_above_mean": [],
    "count_below_mean": [],
    "longest_strike_above_mean": [],
    "longest_strike_below_mean": [],
    "variation_coefficient": [],
    "auc": [],
    "slope_sign_change": [],
    "turning_points": [],
    "zero_crossing_mean": [],
    "zero_crossing_std": [],
    "abs_max": ["value__absolute_maximum"],
    "first_loc_max": ["value__first_location_of_maximum"],
    "last_loc_max": ["value__last_location_of_maximum"],
    "first_loc_min": ["value__first_location_of_minimum"],
    "last_loc_min": ["value__last_location_of_minimum"],
    "benford_correlation": ["value__benford_correlation"],
    "sum_of_reoccurring_values": ["value__sum_of_reoccurring_values"],
    "sum_of_reoccurring_data_points": ["value__sum_of_reoccurring_data_points"],
    "spectral_centroid": ["torque_Centroid"],
    "spectral_distance": ["torque_Spectral distance"],
    "spectral_decrease": ["torque_Spectral decrease"],
    "spectral_slope": ["torque_Spectral slope"],
    "signal_distance": ["torque_Signal distance"],
    "human_range_energy-100": ["human_range_energy", "torque_Human range energy"],
}
FFT_PARTS = ("real", "imag", "abs", "angle")
TREND_PARTS = ("slope", "intercept", "stderr", "rvalue", "pvalue")
TREND_FUNCTIONS = ("max", "min", "mean", "var")

_BY_NAME = {x: name for name, others in PLAIN.items() for x in (name, *others)}


@dataclass(frozen=True)
class FeatureSpec:
    """kind: the operator. params: its parameters. name: the canonical name."""

    kind: str
    params: tuple
    name: str


def _number(text: str) -> float:
    return float(text)


def _shown(x: float) -> str:
    """A 32-bit float's shortest form, without a trailing .0."""
    import numpy as np

    text = str(np.float32(x))
    return text.removesuffix(".0")


def _whole(text: str, most: int, least: int = 0) -> int:
    if not re.fullmatch(r"\+?\d+", text) or not least <= int(text) <= most:
        raise ValueError(text)
    return int(text)


def _short(x: float) -> int:
    """The low 16 bits of a 32-bit float: what is kept of a frequency in a long name."""
    return struct.unpack("<I", struct.pack("<f", x))[0] & 0xFFFF


def _spec(kind: str, *params, shown: list | None = None) -> FeatureSpec:
    return FeatureSpec(kind, params, "-".join([kind, *map(str, shown or params)]))


def _parsed(text: str) -> FeatureSpec | None:
    if text in _BY_NAME:
        name = _BY_NAME[text]
        return FeatureSpec("human_range_energy", (100.0,), name) if name.startswith("human") else FeatureSpec(name, (), name)
    head, *rest = text.split("-")
    match head, rest:
        case "paa", [total, segment]:
            total, segment = _whole(total, 65535, 1), _whole(segment, 65535)
            if segment >= total:
                raise ValueError(text)
            return _spec("paa", total, segment)
        case ("c3" | "autocorr" | "partial_autocorr" | "time_reversal_asymmetry"), [lag]:
            return _spec(head, _whole(lag.strip(), 65535, 1 if "autocorr" in head else 0))
        case "fft_coeff", [k, part] if part in FFT_PARTS:
            return _spec("fft_coeff", _whole(k, 65535), part)
        case "approx_entropy", [m, r]:
            m, r = _whole(m, 255), _number(r)
            return _spec("approx_entropy", m, r, shown=[m, _shown(r)])
        case "agg_linear_trend", [part, size, function] if part in TREND_PARTS and function in TREND_FUNCTIONS:
            return _spec("agg_linear_trend", part, _whole(size, 65535, 1), function)
        case ("quantile" | "index_mass_quantile"), [q]:
            q = _number(q)
            if not 0 <= q <= 1:
                raise ValueError(text)
            return _spec(head, q, shown=[_shown(q)])
        case "max_langevin_fixed_point", [m, r]:
            m, r = _whole(m, 255), _number(r)
            return _spec(head, m, r, shown=[m, _shown(r)])
        case "mean_n_absolute_max", [n]:
            return _spec(head, _whole(n, 65535))
        case ("wavelet" | "spectrogram"), [a, b]:
            return _spec(head, _whole(a, 65535), _whole(b, 65535))
    # long names
    if m := re.search(r"c3__lag_(.+)$", text):
        return _spec("c3", _whole(m[1], 65535))
    if m := re.search(r"time_reversal_asymmetry_statistic__lag_(.+)$", text):
        return _spec("time_reversal_asymmetry", _whole(m[1], 65535))
    if "agg_linear_trend__attr_" in text:
        part = next((p for p in ("slope", "intercept") if f'attr_"{p}"' in text), "slope")
        size = re.search(r"chunk_len_(\d+)(?:__|$)", text)
        function = next((f for f in ("mean", "var", "max", "min") if f'f_agg_"{f}"' in text), "mean")
        return _spec("agg_linear_trend", part, _whole(size[1], 65535, 1) if size else 5, function)
    if m := re.search(r"value__(index_mass_)?quantile__q_(.+)$", text):
        return parse(f"{m[1] or ''}quantile-{m[2]}")
    if m := re.search(r"value__max_langevin_fixed_point__m_(\d+)?(?:__r_([\d.]+))?", text):
        return parse(f"max_langevin_fixed_point-{m[1] or 3}-{m[2] or 30}")
    if m := re.search(r"value__mean_n_absolute_max__number_of_maxima_(.+)$", text):
        return _spec("mean_n_absolute_max", _whole(m[1], 65535))
    if "torque_Wavelet" in text:
        m = re.search(r"_([\d.]+)Hz", text)
        return _spec("wavelet", _short(float(m[1])) if m else 0, 0 if "absolute mean" in text else 1)
    if m := re.search(r"torque_Spectrogram mean coefficient_([\d.]*)Hz", text):
        return _spec("spectrogram", 0, _short(float(m[1] or 0)))
    return None


def parse(text: str) -> FeatureSpec:
    """The feature that a name asks for; ValueError if there is none such.

    A lag of 0 for the autocorrelations, a segment beyond its total, a chunk of 0 and a
    quantile outside 0 to 1 are refused as well."""
    try:
        found = _parsed(text)
    except (ValueError, TypeError):
        found = None
    if found is None:
        raise ValueError(f"unknown feature: {text!r}")
    return found


def parse_all(names: list[str]) -> list[FeatureSpec]:
    """Specs in the order of the request, each once."""
    return list({s.name: s for s in map(parse, names)}.values())


def plain_names() -> list[str]:
    return list(_BY_NAME)
