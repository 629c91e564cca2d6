"""Extraction over whole series, growing prefixes and sliding count windows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.features import EXPANDING, SLIDING, STATIC, features
from ..sources.frames import POS, SERIES, VALUE, from_arrow
from ..specs import parse_all


def extract(frame: DataFrame, names: list[str], max_size: int | None = None, textbook: bool = False) -> DataFrame:
    """series_id and the features of each whole series. frame: (series_id, pos, v)."""
    return features(frame, [SERIES], parse_all(names), STATIC, max_size, textbook)


def expanding(frame: DataFrame, names: list[str], every: int = 1, max_size: int | None = None, textbook: bool = False) -> DataFrame:
    """series_id, end_pos and the features of prefixes: those of every, 2 * every, ... points,
    and the whole series. end_pos is a prefix's last position.

    A point goes to each prefix that it is in, so choose every in proportion to the length."""
    if every < 1:
        raise ValueError("every must be 1 at least")
    # the series' end comes by a window, so that the rows are exchanged once, by series
    frame = frame.withColumn("_last", F.max(POS).over(Window.partitionBy(SERIES)))
    # prefixes end at multiples of every, less one; the last also at the series' end
    first = F.floor(F.col(POS) / every)
    ends = F.transform(F.sequence(first, F.floor(F.col("_last") / every)), lambda k: F.least((k + 1) * every - 1, F.col("_last").cast("long")))
    rows = frame.select(SERIES, POS, VALUE, F.explode(ends).alias("end_pos"))
    return features(rows, [SERIES, "end_pos"], parse_all(names), EXPANDING, max_size, textbook)


def sliding(frame: DataFrame, names: list[str], window: int, stride: int = 1, textbook: bool = False) -> DataFrame:
    """series_id, window_id and the features of windows of `window` points, one each `stride`
    points. Windows that aren't full don't come out."""
    if window < 1 or stride < 1:
        raise ValueError("window and stride must be 1 at least")
    lo = F.greatest(F.lit(0), F.ceil((F.col(POS) - (window - 1)) / stride)).cast("long")
    # the series' end comes by a window, so that the rows are exchanged once, by series
    full = F.floor((F.max(POS).over(Window.partitionBy(SERIES)) - (window - 1)) / stride)
    hi = F.least(F.floor(F.col(POS) / stride), F.col("_full")).cast("long")
    rows = frame.withColumn("_full", full).where(lo <= hi).select(SERIES, POS, VALUE, F.explode(F.sequence(lo, hi)).alias("window_id"))
    rows = rows.withColumn(POS, (F.col(POS) - F.col("window_id") * stride).cast("int"))
    return features(rows, [SERIES, "window_id"], parse_all(names), SLIDING, None, textbook)


def tumbling(frame: DataFrame, names: list[str], window: int, textbook: bool = False) -> DataFrame:
    """Windows that don't overlap."""
    return sliding(frame, names, window, window, textbook)


class Extractor:
    """Features of whole series, from frames or Arrow batches of one column a series."""

    def __init__(self, names: list[str], max_size: int | None = None, textbook: bool = False):
        self.specs, self.names, self.max_size, self.textbook = parse_all(names), names, max_size, textbook

    def process(self, frame: DataFrame) -> DataFrame:
        return extract(frame, self.names, self.max_size, self.textbook)

    def process_arrow(self, spark: SparkSession, batch: pa.RecordBatch) -> pa.Table:
        """One row a column of batch, in its order; columns in the order of the request."""
        order = {c: k for k, c in enumerate(batch.schema.names)}
        found = {r[SERIES]: r for r in self.process(from_arrow(spark, batch)).collect()}
        rows = [found.get(c) for c in order]
        return pa.table({s.name: pa.array([r[s.name] if r else 0.0 for r in rows], pa.float32()) for s in self.specs})


class ExpandingExtractor:
    """Keeps what it has been given and gives the features of all of it after each update, one
    row a column."""

    def __init__(self, names: list[str], max_size: int | None = None, textbook: bool = False):
        self.specs, self.names, self.max_size, self.textbook = parse_all(names), names, max_size, textbook
        self.held: pa.Table | None = None

    def update(self, spark: SparkSession, batch: pa.RecordBatch) -> pa.Table:
        if batch.num_rows:
            new = pa.Table.from_batches([batch])
            self.held = new if self.held is None else pa.concat_tables([self.held, new])
        if self.held is None or not batch.num_rows:
            return pa.table({s.name: pa.array([], pa.float32()) for s in self.specs})
        frame = from_arrow(spark, self.held)
        found = {r[SERIES]: r for r in features(frame, [SERIES], self.specs, EXPANDING, self.max_size, self.textbook).collect()}
        return pa.table({s.name: pa.array([found[c][s.name] for c in self.held.column_names], pa.float32()) for s in self.specs})


class SlidingExtractor:
    """Keeps a tail of what it has been given and gives the features of the windows that have
    become full, those of the first column first."""

    def __init__(self, names: list[str], window: int, stride: int = 1, textbook: bool = False):
        self.specs, self.names, self.window, self.stride, self.textbook = parse_all(names), names, window, stride, textbook
        self.held: pa.Table | None = None
        self.skip = 0  # rows to pass before the next window, where stride is larger than window

    def update(self, spark: SparkSession, batch: pa.RecordBatch) -> pa.Table:
        new = pa.Table.from_batches([batch])
        self.held = new if self.held is None else pa.concat_tables([self.held, new])
        passed = min(self.skip, self.held.num_rows)
        self.held, self.skip = self.held.slice(passed), self.skip - passed
        full = max(0, (self.held.num_rows - self.window) // self.stride + 1)
        if not full:
            return pa.table({s.name: pa.array([], pa.float32()) for s in self.specs})
        order = {c: k for k, c in enumerate(self.held.column_names)}
        rows = sliding(from_arrow(spark, self.held), self.names, self.window, self.stride, self.textbook).collect()
        rows.sort(key=lambda r: (order[r[SERIES]], r["window_id"]))
        gone = full * self.stride
        self.skip = max(0, gone - self.held.num_rows)
        self.held = self.held.slice(min(gone, self.held.num_rows))
        return pa.table({s.name: pa.array([r[s.name] for r in rows], pa.float32()) for s in self.specs})
