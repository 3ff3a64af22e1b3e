"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source; a source's repetition rate is its target over
its size; a document is emitted floor(rate) times, and once more with
probability equal to the fraction.  The draws are hash-seeded and stratified:
a source's documents are dealt into shards by a hash of their identifiers and
ordered by size, and the additional copies are spread evenly over that order
from a start that a hash of the shard fixes.  So every document has the same
chance as by a draw of its own, while the words a shard takes differ from its
share of the target by less than the size of its largest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialize, word_count

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
#: Targets are broadcast up to this number of sources, and joined by shuffling beyond it.
MOST_SOURCES = 100_000
#: Documents of a shard, about: a source of any size is dealt to as many tasks as it needs.
SHARD = 5_000


def draw(identifier: Column) -> Column:
    """A number in [0, 1) fixed by a text or number: the first 13 hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(identifier.cast("string")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(16**13))


def weights_by_order(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add ``weight``: the cycle of ``weights`` over sources by code point, null last.

    One row per source; only these rows are ordered, never documents.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    return sources.withColumn("weight", F.get(cycle, (place % len(weights)).cast("int")).cast("long"))


def targets(sources: DataFrame, max_rate: int = MAX_RATE) -> DataFrame:
    """Add ``target`` to (source, source_size, weight).

    All targets sum to all sizes and follow the weights; none is above
    ``max_rate`` times its source's size, the excess going to the others by
    weight.  Every round finds the sources that the current level puts at
    their limit; it reads two sums from one row per source.
    """
    cap = F.col("source_size") * max_rate
    level = None
    capped = F.lit(False)
    while True:
        free = F.when(~capped, F.col("weight"))
        total, held, spread = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)), F.coalesce(F.sum(free), F.lit(0))).first()
        now = (total - held, spread)
        if now == level or not spread:
            break
        level = now
        # at its limit: weight * left / spread >= cap, in whole numbers
        capped = F.col("weight").cast("decimal(38,0)") * F.lit(level[0]).cast("decimal(19,0)") >= cap.cast("decimal(25,0)") * F.lit(level[1]).cast("decimal(12,0)")
    share = F.lit(float(level[0]) / float(level[1])) if level else F.lit(0.0)
    return sources.withColumn("target", F.when(capped, cap.cast("double")).otherwise(F.col("weight") * share))


def plan(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target`` and ``copies``.

    Null and empty texts have size 0 and are still emitted by the rate.  A
    null source is a source of its own, the last.  A source of size 0 has
    target 0 and copies 0.  The words taken of a source differ from its target
    by less than its largest document for every SHARD documents it has, and
    far less on average.  Rows that repeat an identifier are in one shard; a
    null identifier is dealt by the text.  Columns of these names are replaced.
    """
    taken = [c for c in df.columns if c not in ("size", "source_size", "target", "copies")]
    rows = df.select(*taken).withColumn("size", word_count(F.col(text)))
    sizes = materialize(rows.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    goal = targets(weights_by_order(sizes, weights), max_rate)
    name, shards, shard, chance = (fresh(c, taken) for c in ("_source", "_shards", "_shard", "_chance"))
    goal = goal.select(F.col("source").alias(name), "source_size", "target", F.ceil(F.col("n") / SHARD).alias(shards))
    if sizes.count() <= MOST_SOURCES:
        goal = F.broadcast(goal)
    # hashed before the join, so that a text that is not asked for does not travel
    rows = rows.withColumn(chance, draw(F.coalesce(F.col(id_col).cast("string"), F.col(text), F.lit(""))))
    joined = rows.join(goal, rows[source].eqNullSafe(F.col(name)), "left").withColumn(shard, F.floor(F.col(chance) * F.col(shards)).cast("long"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    place = F.row_number().over(W.partitionBy(source, shard).orderBy("size", chance))
    start = draw(F.concat(F.coalesce(F.col(source), F.lit("")), F.lit("#"), F.col(shard).cast("string")))
    upto = lambda n: F.floor(start + n.cast("double") * (rate - whole))
    return joined.withColumn("copies", (whole + upto(place) - upto(place - 1)).cast("long")).drop(name, shards, shard, chance)


def mix(df: DataFrame, **options) -> DataFrame:
    """The documents of the mix: every row of ``df`` as often as ``plan`` says, with the columns of ``df``."""
    planned = plan(df, **options)
    again = F.explode(F.when(F.col("copies") > 0, F.array_repeat(F.lit(0), F.col("copies").cast("int"))).otherwise(F.array().cast("array<int>")))
    mark = fresh("_copy", planned.columns)
    return planned.select(*df.columns, again.alias(mark)).drop(mark)
