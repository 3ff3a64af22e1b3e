"""SpotSigs document fingerprints, with DataFrame functions only.

A signature is a common word (anchor) with the chain of content words that
follow it, anchors skipped.  A document's fingerprint is the set of its
signatures; the likeness of two documents is the Jaccard similarity of their
sets.  Sets are named by the MD5 of the sorted signatures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components
from .neighbours import with_next

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "the of and to in is that it for as with on be at by this are was an a from or have not "
    "le la les de des du un une et est en que qui dans pour pas par sur au avec "
    "der die das den dem und ist zu von mit auf für nicht ein eine als auch sich es im "
    "el los las una y del se por con para su lo como no más"
).split()
CHAIN = 3


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null: none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ", -1))


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted distinct signatures of a whole text.

    Of a run of anchors the last one counts.  A chain at the end of the text
    may be shorter.  A text in which no anchor has a chain gets a chain from
    every word, so it is still told from others; a text without words has none.
    """
    common = lambda w: w.isin(list(anchors))
    bare = lambda w: F.substring_index(w, "~", -1)

    def marked(ws: Column) -> Column:
        mark = lambda w, i: F.when(~common(w), F.when((i > 0) & common(F.get(ws, i - 1)), F.concat(F.get(ws, i - 1), F.lit("~"), w)).otherwise(w))
        return F.filter(F.transform(ws, mark), lambda w: w.isNotNull())

    def chains(ws: Column, every: bool) -> Column:
        link = lambda w, i: F.concat_ws(" ", w, *[bare(F.get(ws, i + k)) for k in range(1, chain)])
        made = F.transform(ws, lambda w, i: link(w, i) if every else F.when(F.contains(w, F.lit("~")), link(w, i)))
        return made if every else F.filter(made, lambda s: s.isNotNull())

    def found(ws: Column) -> Column:
        return _let(marked(ws), lambda m: _let(chains(m, False), lambda s: F.when(F.size(s) > 0, s).otherwise(chains(ws, True))))

    return F.sort_array(F.array_distinct(_let(words(text), found)))


def fingerprint(sigs: Column) -> Column:
    """32 hexadecimal digits naming a signature set."""
    return F.md5(F.concat_ws("\n", sigs))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; 1 for two empty sets."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both.cast("double") / either)


def fingerprints(df: DataFrame, text: str = "text", sigs: str = "signatures", name: str = "fingerprint") -> DataFrame:
    """Add the signature set and its name.  Null texts count as empty; rows and other columns pass through."""
    return df.withColumn(sigs, signatures(F.col(text))).withColumn(name, fingerprint(F.col(sigs)))


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Each document beside its edited text and the next document, by ascending id (null last, then by text).

    Adds n_chars, edited (the text whose last quarter of code points is the
    beginning of the next document), fingerprint, edited_fingerprint,
    near_edited and near_next.  The last document's next is the first; a
    single document is its own next.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # four ranges to a task even out how hashing deals them
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    add = lambda d: d.withColumn("signatures", signatures(F.col("text")))
    both = with_next(rows, "doc_id", "text", F.struct("text", "signatures"), "next", parts, before=add)
    n, m = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - m), F.substring(F.col("next.text"), F.lit(1), m))
    both = both.select("doc_id", "signatures", F.col("next.signatures").alias("next_signatures"), n.cast("long").alias("n_chars"), edited.alias("edited"))
    both = both.withColumn("edited_signatures", signatures(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", "edited",
        fingerprint(F.col("signatures")).alias("fingerprint"), fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"), likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )


def similar_sets(df: DataFrame, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """(a, b, jaccard) of all pairs of different fingerprints with likeness at or above ``threshold``, a < b.

    Equal sets are one row, whatever their number.  Sets are partitioned by
    length, each range ending where a longer set can no longer reach the
    threshold, so a pair lies in one range or in two neighbouring ones; a set
    is indexed by its rarest signatures, as many as any similar set must
    share one of; the lengths are compared before the sets.
    """
    sets = materialize(df.select(signatures(F.col(text)).alias("s")).withColumn("fp", fingerprint(F.col("s"))).dropDuplicates(["fp"]).where("size(s) > 0"), "spotsigs")
    rarity = sets.select(F.explode("s").alias("sig")).groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    # signatures of one set only link nothing, but count in the prefix: they come first
    shared = sets.select("fp", F.size("s").alias("n"), F.explode("s").alias("sig")).join(rarity, "sig")
    per = shared.groupBy("fp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("by"))
    prefix = F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1
    alone = F.col("n") - F.size("by")
    per = per.select("fp", "n", F.slice("by", 1, F.greatest(prefix - alone, F.lit(0))).alias("by"))
    length = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.0 / threshold))).cast("int") if threshold < 1 else F.col("n")
    keyed = per.select("fp", "n", length.alias("range"), F.explode("by").alias("x")).select("fp", "n", "range", F.col("x.sig").alias("sig"))
    a = keyed.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("range"), "sig")
    b = keyed.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.explode(F.array(F.col("range"), F.col("range") + 1)).alias("range"), "sig")
    longer = (F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    pairs = a.join(b, ["range", "sig"]).where(longer & (F.col("nb") >= F.col("na") * threshold - 1e-9)).select("a", "b").distinct()
    left, right = sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), sets.select(F.col("fp").alias("b"), F.col("s").alias("sb"))
    checked = pairs.join(left, "a").join(right, "b").withColumn("jaccard", likeness(F.col("sa"), F.col("sb"))).where(F.col("jaccard") >= threshold - 1e-12)
    return checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, fingerprint, class_id, links): class_id is the smallest id reachable; links counts similar other sets.

    Texts without words form one class.  Rows with a null id keep their fingerprint.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), fingerprint(signatures(F.col(text))).alias("fingerprint"))
    least = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    pairs = materialize(similar_sets(df, threshold, text), "similar")
    ends = pairs.select(F.col("a").alias("f")).union(pairs.select(F.col("b").alias("f"))).groupBy("f").agg(F.count("*").alias("links"))
    named = pairs.join(least.select(F.col("fingerprint").alias("a"), F.col("least").alias("u")), "a").join(least.select(F.col("fingerprint").alias("b"), F.col("least").alias("v")), "b")
    found = components(named)
    classes = least.join(found, least["least"] == found["node"], "left").join(ends, least["fingerprint"] == ends["f"], "left")
    classes = classes.select("fingerprint", F.coalesce("component", "least").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return rows.join(classes, "fingerprint").select("doc_id", "fingerprint", "class_id", "links")
