"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]++"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the checkpoint folder of the session.

    A local folder is used only where none is set and everything runs in one
    process (tests); on a cluster that is an error, as each executor would
    write to a disk of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or spark.conf.get("quillon.scratch.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("quillon.scratch.dir", named)
    return f"{named.rstrip('/')}/quillon-{context.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The tables stay until ``release``.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that are not yet written are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_key(id_col: str, text: str) -> Column:
    """The id of a row as a long; rows without one are known by a hash of their text, above all usual ids."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text)).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))


def bounded_batches(spark: SparkSession, rows: int = 256, size: str = "2m") -> None:
    """Bound what a Python worker gets at once: whole texts can be long, so by bytes as well as by rows.

    The settings stay, as a result may be computed long after the operator was called.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names]


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or ``name`` with underscores where the input already has such a column."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def document_schema(df: DataFrame) -> list[str]:
    return [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in df.columns]


#: What this worker process holds for the operator it runs now.
_held: dict[str, object] = {}


def forget() -> None:
    """Let go of what this worker process holds for an operator that ran in it before."""
    import gc

    import pyarrow as pa

    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def once(make, value=None):
    """``make(value)``, made once per worker process until another operator runs in it.

    ``value`` is compared by identity, as the values of broadcasts are kept.
    """
    if _held.get("make") is not make or _held.get("value") is not value:
        forget()
        _held.update(made=make(value), make=make, value=value)
    return _held["made"]


class Remembered(dict):
    """``make(key)`` by key, for the keys met lately: a full memory becomes the old one, from which keys still met return."""

    def __init__(self, make, most: int = 100_000):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found
