"""Expanding and sliding extraction over streams of (series_id, pos, v).

State is kept for each series by Spark. Rows of a micro-batch are sorted by pos; rows at
or before a position already taken are late and left out, or raise an error. Kernels are
the batch plan's own definitions, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.series import compute
from ..plans.features import EXPANDING, SLIDING
from ..sources.frames import SERIES
from ..specs import parse_all


def _take(parts: Iterator[pd.DataFrame], last: int, late: str) -> tuple[np.ndarray, int]:
    rows = pd.concat(list(parts)).sort_values("pos", kind="stable").drop_duplicates("pos")
    new = rows[rows["pos"] > last]
    if late == "fail" and len(new) < len(rows):
        raise ValueError(f"late position {rows['pos'].min()} in series {rows[SERIES].iloc[0]!r}")
    return new["v"].to_numpy(np.float64), int(new["pos"].max()) if len(new) else last


#: Features of the spectrum, which a stream may leave as they were for a while.
SPECTRAL = ("spectral_centroid", "spectral_distance", "spectral_decrease", "spectral_slope", "human_range_energy", "fft_coeff", "spectrogram", "autocorrelation")


def expanding_stream(stream: DataFrame, names: list[str], textbook: bool = False, late: str = "drop", fft_update_period: int = 1) -> DataFrame:
    """After each micro-batch, for each series in it: series_id, n_points and the features of
    all its points so far. The whole history is kept, as order statistics need it.
    fft_update_period: features of the spectrum are computed again only when so many points
    have come since."""
    specs = parse_all(names)
    slow = [s for s in specs if s.kind in SPECTRAL]
    schema = "series_id string, n_points long, " + ", ".join(f"`{s.name}` double" for s in specs)

    def update(key, parts, state):
        last, held, fft_points, fft = state.get if state.exists else (-1, b"", 0, b"")
        values, last = _take(parts, last, late)
        held += values.tobytes()
        x = np.frombuffer(held, np.float64)
        if len(values) and (not fft_points or len(x) - fft_points >= fft_update_period):
            fft_points, fft = len(x), np.array(compute(x, slow, EXPANDING, textbook)).tobytes()
        state.update((last, held, fft_points, fft))
        if len(values):
            known = dict(zip([s.name for s in slow], np.frombuffer(fft, np.float64)))
            known |= dict(zip([s.name for s in specs if s not in slow], compute(x, [s for s in specs if s not in slow], EXPANDING, textbook)))
            yield pd.DataFrame([(key[0], len(x), *(float(known[s.name]) for s in specs))], columns=["series_id", "n_points", *(s.name for s in specs)])

    return stream.groupBy(SERIES).applyInPandasWithState(update, schema, "last long, held binary, fft_points long, fft binary", "append", "NoTimeout")


def sliding_stream(stream: DataFrame, names: list[str], window: int, stride: int = 1, textbook: bool = False, late: str = "drop") -> DataFrame:
    """For each window that has become full: series_id, window_id and its features. At most
    window points more than a batch brings are kept."""
    specs = parse_all(names)
    schema = "series_id string, window_id long, " + ", ".join(f"`{s.name}` double" for s in specs)

    def update(key, parts, state):
        last, begin, window_id, held = state.get if state.exists else (-1, 0, 0, b"")
        values, last = _take(parts, last, late)
        x, out = np.concatenate([np.frombuffer(held, np.float64), values]), []
        # begin: how many points have gone before x
        while (at := window_id * stride - begin) + window <= len(x):
            out.append((key[0], window_id, *compute(x[at : at + window], specs, SLIDING, textbook)))
            window_id += 1
        gone = min(max(0, window_id * stride - begin), len(x))
        state.update((last, begin + gone, window_id, x[gone:].tobytes()))
        if out:
            yield pd.DataFrame(out, columns=["series_id", "window_id", *(s.name for s in specs)])

    return stream.groupBy(SERIES).applyInPandasWithState(update, schema, "last long, begin long, window_id long, held binary", "append", "NoTimeout")
