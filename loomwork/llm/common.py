"""Helpers that the operators of this subpackage share: scratch tables in the shared folder, ASCII word rules, hashes."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte tables for bytes.translate. LOWER maps A-Z to a-z; WORDS also turns every ASCII byte that is no letter or digit into a space.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a local one of our own if the session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not (own := spark.conf.get("loomwork.scratch.dir", None)):
        own = f"file://{tempfile.mkdtemp(prefix='loomwork-')}"
        spark.conf.set("loomwork.scratch.dir", own)
    return own.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Lets Spark hand Python workers at most 1,000 rows and 4 MB at once (or one longer row), so that tasks with long texts keep their memory, inside and outside the JVM's heap. Spark reads these settings when a result is computed, so they can't be set back here: they hold for the session from now on, unless its batches are smaller already."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = int(re.sub(r"[^0-9-]", "", spark.conf.get(key)) or 0)
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def whole_row(df: DataFrame) -> F.Column:
    """All columns of df as one struct, so that their names clash with none of an operator's; unpacked() gives them back."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`").alias(c) for c in df.columns])


def unpacked(df: DataFrame, row: str = "row", **other) -> list[F.Column]:
    """The columns that whole_row(df) holds in the column `row`; `other` gives expressions to stand in for some of them."""
    return [(other[c] if c in other else F.col(row)[c]).alias(c) for c in df.columns]


class Scratch:
    """Tables of one operator run, written to the shared folder so that lineage ends there and a lost executor costs no recomputation.

    Tables that nothing reads any more go with drop() or only(); the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        small_batches(spark)
        self.spark, self.root, self.made = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0
        self.kept: dict[str, DataFrame] = {}
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns a reader of what was written."""
        df.write.parquet(path := self.path(name))
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.kept[path] = out
        return out

    def only(self, *tables: DataFrame) -> None:
        """Drops all tables but these, which a lazy result still reads."""
        paths = {t._scratch_path for t in tables}
        if gone := [t for path, t in self.kept.items() if path not in paths]:
            self.drop(*gone)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.kept.pop(t._scratch_path, None)
        try:
            jvm = self.spark.sparkContext._jvm
            for p in [t._scratch_path for t in tables] or [self.root]:
                path = jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit; what is left is only scratch
            if tables:
                raise


def beside(small: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of narrow rows to be joined with a large one: marked for broadcast if it has at most `most` rows, else left to a shuffled join. Counted here, so it should be a written one."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def frees(run):
    """run, a function over an iterator of Arrow batches, so wrapped that the worker gives its memory back when a task ends: workers are used again, for other stages too.

    What an earlier stage has kept in the worker (see worker_encoder) goes first, unless run has the attribute `keeps`.
    """

    def wrapped(batches):
        import ctypes
        import gc
        import sys

        import pyarrow as pa

        def release():
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

        if not getattr(run, "keeps", False) and sys.modules.pop("_loomwork_worker", None) is not None:
            release()
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


class Memo(dict):
    """A dict that computes what it lacks and forgets everything beyond `limit` entries, so its memory is bounded."""

    def __init__(self, make, limit: int = 200_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.make(key)
        return value


def word_hashes(limit: int = 200_000) -> Memo:
    return Memo(xxhash.xxh64_intdigest, limit)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer over uint64, so that sums and products of word hashes spread over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def binary_texts(batch, name: str = "text") -> list[bytes]:
    """A string column of an Arrow batch as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def lower_az(c) -> F.Column:
    return F.translate(c, UPPER_AZ, LOWER_AZ)


#: DuckDB texts of the same word rules.
SQL_LOWER = f"translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}')"
SQL_ASCII_WORDS = rf"regexp_extract_all({SQL_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL_SPACED_WORDS = rf"regexp_extract_all({SQL_LOWER}, '[^\x20\x09-\x0D]+')"
