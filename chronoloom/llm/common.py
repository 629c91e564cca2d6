"""What the operators share: the shared folder, written tables, keys for rows.

Every intermediate table that is read more than once is written below
``spark.checkpoint.dir``, which all executors see, so a lost executor costs
only the tasks that were running on it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, and tab to carriage return.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where it is unset, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            path = found.get()
        else:
            path = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/chronoloom/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder; cuts the lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(f)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def row_key(*cols: Column | str) -> Column:
    """A 64-bit key of a row's content. Joined together with the id, it tells rows apart
    that share an id, and rows that are equal in both are interchangeable."""
    return F.xxhash64(*cols)


def strip_white(c: Column) -> Column:
    """c without any ASCII white space."""
    for w in WHITE:
        c = F.replace(c, F.lit(w), F.lit(""))
    return c


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that extra columns with clashing names do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches in parts of few rows, so that little is held as Python objects at a time.
    At the end of the task the worker, which stays for others, gives back what it has freed."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system, where the allocators would keep it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class TextCache(dict):
    """text -> what make() gives for it. When it holds `most`, these become the old ones,
    from which those that are asked for again are taken back; older ones are forgotten.
    Long texts aren't kept, so that memory is bounded."""

    def __init__(self, make: Callable[[str], bytes], most: int, longest: int = 48):
        self.make, self.most, self.longest = make, most, longest
        self.old: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        out = self.old.get(text)
        if out is None:
            out = self.make(text)
            if len(text) > self.longest:
                return out
        self.keep(text, out)
        return out

    def keep(self, text: str, out: bytes) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[text] = out

    def trim(self) -> None:
        """Forgets the old ones; for when a task ends but its worker stays."""
        self.old = {}
