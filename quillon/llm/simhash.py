"""SimHash near-duplicate detection over segment-popcount embeddings.

A fingerprint is embedded as the bit counts of its 32 two-bit segments.  The
Manhattan distance of two embeddings never exceeds the Hamming distance of
the fingerprints, so all links lie among pairs within Manhattan distance
``MAX_BITS``.  These are found by a grid range-join: the segments are dealt
into six axes; a pair within distance 3 differs on three axes at most, so it
shares the grid cell of at least one of the 20 choices of three axes.  Pairs
of a cell pass the Manhattan bound and then the exact Hamming test inside
the join.  Equal fingerprints are merged before, whatever their number.

Counts are held in unary (0, 1, 2 -> 00, 01, 11), which makes an embedding
one 64-bit integer, equality of counts equality of masked bits, and the
Manhattan distance the bit count of an exclusive or.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded_batches, fresh, materialize, text_key
from .components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Bits of each axis of the grid; whole segments.
AXES = (12, 12, 10, 10, 10, 10)
_LOW = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(text: str | None) -> int:
    """Fingerprint of one text as a signed 64-bit integer; no words: 0."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(SHINGLE))) if len(words) >= SHINGLE else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    h = np.array([digest(join(s), SEED) for s in shingles], dtype="<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        counts += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: Column) -> Column:
    """64-bit SimHash of whole texts (null: as empty)."""

    @arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t.as_py()) for t in texts], pa.int64())

    return of(text)


def embedding(fp: Column) -> Column:
    """Bit counts of the two-bit segments, in unary."""
    low, half = F.lit(_LOW), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))


def _cells(e: Column) -> Column:
    """The grid cells of an embedding: one for every choice of three axes."""
    at = [sum(AXES[:i]) for i in range(len(AXES))]
    masks = [sum(((1 << AXES[i]) - 1) << at[i] for i in c) for c in combinations(range(len(AXES)), len(AXES) - MAX_BITS)]
    return F.array(*[F.struct(F.lit(k).alias("cell"), e.bitwiseAND(F.lit(_signed(m))).alias("at")) for k, m in enumerate(masks)])


def links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b) with a < b: all pairs of the distinct fingerprints that differ in 1 to MAX_BITS bits."""
    e = fps.select(F.col(fp).alias("fp")).where("fp is not null").distinct().withColumn("e", embedding(F.col("fp")))
    dealt = e.select("fp", "e", F.explode(_cells(F.col("e"))).alias("c")).select("fp", "e", "c.cell", "c.at")
    a = dealt.select("cell", "at", F.col("fp").alias("a"), F.col("e").alias("ea"))
    b = dealt.select("cell", "at", F.col("fp").alias("b"), F.col("e").alias("eb"))
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    near = (F.col("a") < F.col("b")) & (apart("ea", "eb") <= MAX_BITS) & (apart("a", "b") <= MAX_BITS)
    return a.join(b, ["cell", "at"]).where(near).select("a", "b").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row of ``df``.

    ``component_id`` is the smallest id whose fingerprint is reachable by
    links of at most MAX_BITS bits.  Texts without words (null, empty, white
    space) have fingerprint 0 and are linked like any other.  Rows with a null
    id keep their fingerprint and get the component of the others with it
    (null if there are none).  Repeated rows are repeated in the result.
    """
    bounded_batches(df.sparkSession)
    fps = materialize(df.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text)).alias("fp")), "simhash")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    pairs = links(fps.select("fp"))
    # a fingerprint is named by its smallest document
    named = pairs.join(least.select(F.col("fp").alias("a"), F.col("least").alias("u")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("v")), "b")
    found = components(named)
    classes = least.join(found, least["least"] == found["node"], "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stand for their component, all columns kept: the ones with the smallest id.

    Rows without an id are known by a hash of their text and come after all
    others, so a copy of a row with an id goes and one of several copies
    without stays.  Rows that share an id are one document: the one with the
    smallest hash of its text stays, whatever the order of the rows.
    """
    key, mark, least = (fresh(c, df.columns) for c in ("_key", "_kept", "_least"))
    keyed = df.withColumn(key, text_key(id_col, text))
    keep = near_duplicates(keyed, key, text).where("doc_id = component_id").select(F.col("doc_id").alias(mark)).distinct()
    # of the rows of one id, the one with the smallest hash
    some = keyed.groupBy(F.col(key).alias(mark)).agg(F.min(F.xxhash64(text)).alias(least), F.count("*").alias("n")).where("n > 1").drop("n")
    kept = keyed.join(keep, F.col(key) == F.col(mark), "left_semi").join(some, F.col(key) == F.col(mark), "left")
    return kept.where(F.col(least).isNull() | (F.xxhash64(text) == F.col(least))).dropDuplicates([key]).select(*df.columns)
