"""Queries over the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html, mixing, simhash, spotsigs, substring, tokencount, topk, toxicity
from .common import tables

WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as counts and digests."""
    (docs,) = tables(spark, sf_dir, "documents")
    coder = bpe.Coder(spark, vocabulary(WORD_VOCABULARY))
    coded = bpe.round_trip(docs.select("doc_id", "text"), coder)
    return coded.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    (docs,) = tables(spark, sf_dir, "documents")
    found = simhash.near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    (docs,) = tables(spark, sf_dir, "documents")
    found = spotsigs.compare_with_next(docs.select("doc_id", "text"))
    return found.withColumn("edited_sha256", F.sha2("edited", 256)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    (pages,) = tables(spark, sf_dir, "pages")
    return html.extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten highest inner products of every hundredth vector."""
    (vectors,) = tables(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, 10)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that an earlier document has too."""
    (docs,) = tables(spark, sf_dir, "documents")
    return substring.passages(docs.select("doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and words taken of every document."""
    (docs,) = tables(spark, sf_dir, "documents")
    planned = mixing.plan(docs.select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that a document is toxic, learnt from four fifths of the labelled ids."""
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    docs = docs.select("doc_id", "text")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    rated = toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity.score").alias("score"), F.size("toxicity.passages").alias("passages"))
    return rated.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under a unigram vocabulary."""
    (docs,) = tables(spark, sf_dir, "documents")
    return tokencount.count_tokens(docs.select("doc_id", "text"), vocabulary(PIECE_VOCABULARY)).select("doc_id", "n_tokens", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked events of every conversation, with a digest of their canonical JSON."""
    (messages,) = tables(spark, sf_dir, "conversations")
    found = chat.format_chats(messages)
    return found.select("conv_id", "turn", "kind", "call_id", "status", F.size("problems").alias("n_problems"), "order_turn", "place", F.sha2("json", 256).alias("json_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_spotsigs": op3_spotsigs,
    "op4_html": op4_html,
    "op5_topk": op5_topk,
    "op6_substring": op6_substring,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_tokencount": op9_tokencount,
    "op10_chat": op10_chat,
}

_SIGNATURES = f"""
  list_sort(list_distinct(CASE WHEN len(list_filter(marked, lambda w: contains(w, '~'))) > 0
    THEN list_filter(list_transform(marked, lambda w, i: CASE WHEN contains(w, '~') THEN
           concat_ws(' ', w, split_part(marked[i + 1], '~', -1), split_part(marked[i + 2], '~', -1)) END), lambda s: s IS NOT NULL)
    ELSE list_transform(ws, lambda w, i: concat_ws(' ', w, ws[i + 1], ws[i + 2])) END))"""
_ANCHORS = "[" + ", ".join(f"'{a}'" for a in spotsigs.ANCHORS) + "]"
_MARKED = f"""
  list_filter(list_transform(ws, lambda w, i: CASE WHEN list_contains({_ANCHORS}, w) THEN NULL
    WHEN i > 1 AND list_contains({_ANCHORS}, ws[i - 1]) THEN ws[i - 1] || '~' || w ELSE w END), lambda w: w IS NOT NULL)"""
_WORDS = r"""
  list_filter(string_split(trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '')"""
_LIKENESS = """CASE WHEN len({0}) + len({1}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"""

ORACLE_SQL: dict[str, str] = {
    "op3_spotsigs": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, length(text) AS n_chars,
        coalesce(lead(text) OVER (ORDER BY doc_id NULLS LAST, text), first_value(text) OVER (ORDER BY doc_id NULLS LAST, text)) AS next_text FROM d),
e AS (SELECT *, substr(text, 1, n_chars - n_chars // 4) || substr(next_text, 1, n_chars // 4) AS edited FROM n),
u AS (SELECT doc_id, 1 AS kind, text AS t FROM e UNION ALL SELECT doc_id, 2, edited FROM e UNION ALL SELECT doc_id, 3, next_text FROM e),
w AS (SELECT doc_id, kind, {_WORDS.format("t")} AS ws FROM u),
m AS (SELECT doc_id, kind, ws, {_MARKED} AS marked FROM w),
s AS (SELECT doc_id, kind, {_SIGNATURES} AS sigs FROM m),
p AS (SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, a.sigs AS a, b.sigs AS b, c.sigs AS c
      FROM e JOIN s a ON a.doc_id = e.doc_id AND a.kind = 1 JOIN s b ON b.doc_id = e.doc_id AND b.kind = 2 JOIN s c ON c.doc_id = e.doc_id AND c.kind = 3)
SELECT doc_id, n_chars, edited_sha256, md5(array_to_string(a, chr(10))) AS fingerprint, md5(array_to_string(b, chr(10))) AS edited_fingerprint,
  {_LIKENESS.format("a", "b")} AS near_edited, {_LIKENESS.format("a", "c")} AS near_next FROM p""",
    "op5_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap, ceil(count(*) / 5000)::BIGINT AS shards,
        [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
r AS (SELECT *, cap * (10 // w) AS ratio FROM s),
o AS (SELECT ratio, sum(cap) AS cap, sum(w) AS w FROM r GROUP BY ratio),
k AS (SELECT ratio, sum(cap) OVER (ORDER BY ratio) - cap AS held, sum(w) OVER (ORDER BY ratio) - w AS used FROM o),
t AS (SELECT sum(source_size) AS total, sum(w) AS spread FROM s),
l AS (SELECT (total - held)::DOUBLE / (spread - used)::DOUBLE AS share, ratio FROM k, t
      WHERE ratio * (spread - used) > 10 * (total - held) ORDER BY ratio LIMIT 1),
g AS (SELECT r.source, r.source_size, r.shards, CASE WHEN l.ratio IS NULL OR r.ratio < l.ratio THEN r.cap::DOUBLE ELSE r.w * l.share END AS target FROM r LEFT JOIN l ON true),
x AS (SELECT doc_id, d.source, size, source_size, target, shards, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
y AS (SELECT *, floor(u * shards)::BIGINT AS shard FROM x),
z AS (SELECT *, rate - floor(rate) AS part, row_number() OVER (PARTITION BY source, shard ORDER BY size, u)::DOUBLE AS place,
        ('0x' || substr(md5(coalesce(source, '') || '#' || shard), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS start FROM y)
SELECT doc_id, size, source_size, target, ((floor(rate) + floor(start + place * part) - floor(start + (place - 1) * part))::BIGINT * size)::BIGINT AS taken FROM z""",
    "op10_chat": """
WITH m AS (SELECT conv_id, turn::BIGINT AS turn, role, coalesce(text, '') AS text FROM conversations),
e AS (SELECT *, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 0 END AS kind,
        CASE role WHEN 'user' THEN conv_id || ':' || turn WHEN 'assistant' THEN conv_id || ':' || (turn - 1) END AS call_id FROM m),
l AS (SELECT e.*, o.turn AS other FROM e LEFT JOIN m o ON o.conv_id = e.conv_id
        AND ((e.kind = 1 AND o.role = 'assistant' AND o.turn = e.turn + 1) OR (e.kind = 2 AND o.role = 'user' AND o.turn = e.turn - 1)))
SELECT conv_id, turn, kind, call_id,
  CASE kind WHEN 0 THEN 'message' WHEN 1 THEN CASE WHEN other IS NULL THEN 'unanswered' ELSE 'called' END
    ELSE CASE WHEN other IS NULL THEN 'orphan' ELSE 'linked' END END AS status,
  0 AS n_problems, turn AS order_turn, 0 AS place,
  sha256('{' || CASE WHEN kind = 1 THEN '"arguments":{"prompt":' || to_json(text) || '},' ELSE '' END
    || CASE WHEN kind > 0 THEN '"call_id":' || to_json(call_id) || ',' ELSE '' END
    || CASE WHEN kind <> 1 THEN '"content":' || to_json(text) || ',' ELSE '' END || '"conv_id":' || conv_id || ','
    || CASE WHEN kind = 1 THEN '"name":"reply",' ELSE '' END || '"role":' || to_json(role) || ',"turn":' || turn || '}') AS json_sha256 FROM l""",
}
