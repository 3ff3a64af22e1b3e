"""Toxic passages as maximum-scoring segments.

Training: document counts of words and of word beginnings by label give
log-odds under an informative Dirichlet prior; features that are not
significant are dropped, so the model is small whatever the corpus.

Scoring: a text's words get the log-odds of their most significant feature,
less a drift that makes ordinary text score below zero.  One linear scan
(Ruzzo and Tompa) finds all maximal-scoring segments.  Their scores follow an
extreme-value law in clean text; its two parameters turn every segment into
the number of such segments to expect by chance, and what exceeds chance is
summed and calibrated to a probability on the training rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import bounded_batches, forget, materialize, once

#: At most about so many labelled rows are learnt from (all, where there are fewer); also bounds the broadcast.
MAX_LABELLED = 200_000
#: Least significance of a feature, in standard deviations, and documents that have it.  All such features are
#: kept; the labelled rows, which MAX_LABELLED bounds, bound them too.
LEAST_Z, LEAST_DOCS = 2.8, 3
#: Prior documents spread over all features by their frequency, and the least prior of a feature.
PRIOR, LEAST_PRIOR = 500.0, 0.5
DRIFT = 0.5
#: Word beginnings counted as features, for words not met in training.
BEGINNINGS = (4, 5, 6, 7)
#: Code points that are hashed at once.
CHUNK = 1 << 18
_ODD = 0x9E3779B97F4A7C15
SEGMENT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())])
RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(SEGMENT))])


@dataclass
class Model:
    """log-odds and significance by feature; law and calibration."""

    odds: dict[str, tuple[float, float]]
    rate: float = 1.0
    space: float = 1.0
    bias: float = -6.0
    slope: float = 1.0


def lower(text: str) -> str:
    """The text in lower case, as long as it was: what a letter would become that grows is cut to its first code point."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


@cache
def _letters():
    """Whether a code point is part of a word: letters and digits."""
    import numpy as np

    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@cache
def _powers(n: int):
    """Powers of an odd number, and of its inverse, modulo 2**64."""
    import numpy as np

    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)]) for base in (_ODD, pow(_ODD, -1, 1 << 64)))


def _mixed(h):
    import numpy as np

    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """The words of some texts, and their features as 64-bit hashes: the word and its beginnings."""

    text: str  # all texts in lower case, one after another
    begins: object  # code points before each text, and all
    start: object
    end: object
    row: object  # the text of each word
    hashes: list = field(default_factory=list)  # by kind of feature: (words that have it, hash)


def words(texts: list[str | None]) -> Words:
    """Words are runs of letters and digits of the lower-case text."""
    import numpy as np

    low = [lower(t or "") for t in texts]
    begins = np.cumsum([0, *map(len, low)])
    # one blank after each text keeps words apart
    text = " ".join(low) + " "
    begins = begins + np.arange(len(begins))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.r_[False, _letters()[points], False]
    start, end = np.flatnonzero(letter[1:-1] & ~letter[:-2]), np.flatnonzero(letter[1:-1] & ~letter[2:]) + 1
    found = Words(text, begins, start, end, np.searchsorted(begins, start, "right") - 1)
    lengths = end - start
    ranks = [np.arange(len(start))] + [np.flatnonzero(lengths >= k) for k in BEGINNINGS]
    sums_of = [np.empty(len(r), np.uint64) for r in ranks]
    at = 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK)))
        lo, size = int(start[at]), int(end[upto - 1] - start[at])
        power, inverse = _powers(CHUNK if size <= CHUNK else 1 << (size - 1).bit_length())
        with np.errstate(over="ignore"):
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(_mixed((points[lo : lo + size].astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD)) * power[:size], out=sums[1:])
            for k, r, out in zip((None, *BEGINNINGS), ranks, sums_of):
                a, b = np.searchsorted(r, (at, upto))
                s = start[r[a:b]] - lo
                e = end[r[a:b]] - lo if k is None else s + k
                out[a:b] = (sums[e] - sums[s]) * inverse[s]
        at = upto
    found.hashes = [(r, _mixed(h + np.uint64(0 if k is None else 1 << k))) for k, r, h in zip((None, *BEGINNINGS), ranks, sums_of)]
    return found


def feature_hash(feature: str) -> int:
    """The hash of a word, or of a beginning (marked by an asterisk), as ``words`` has it."""
    import numpy as np

    bare = feature.removesuffix("*")
    points = np.array([ord(c) for c in bare], np.uint64)
    with np.errstate(over="ignore"):
        h = (_mixed((points + np.uint64(1)) * np.uint64(_ODD)) * _powers(64 if len(bare) <= 64 else len(bare))[0][: len(bare)]).sum(dtype=np.uint64)
        return int(_mixed(np.array([h + np.uint64(0 if bare == feature else 1 << len(bare))]))[0])


def maximal_segments(scores) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments [start, end) of a sequence, in order (Ruzzo and Tompa), in linear time."""
    import numpy as np

    scores = np.asarray(scores, dtype=np.float64)
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.cumsum(scores)
    kept: list[list[float]] = []  # start, end, sum before, sum after
    back: list[int] = []  # the nearest earlier segment with a smaller sum before it
    for i in at.tolist():
        new = [i, i + 1, total[i] - scores[i], total[i]]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = back[j]
            if j < 0 or kept[j][3] >= new[3]:
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:], back[j:]
        kept.append(new)
        back.append(j)
    return [(int(a), int(b), float(r - l)) for a, b, l, r in kept]


class Scorer:
    def __init__(self, model: Model):
        import numpy as np

        self.model = model
        rated = sorted((feature_hash(f), *v) for f, v in model.odds.items())
        self.known = np.array([r[0] for r in rated], np.uint64)
        self.odds, self.z = (np.array([r[i] for r in rated]) for i in (1, 2))

    def word_scores(self, found: Words):
        """The log-odds of each word's most significant feature (the longest word counts first), less the drift."""
        import numpy as np

        odds, z = np.zeros(len(found.start)), np.zeros(len(found.start))
        if len(self.known):
            for rank, h in found.hashes:
                each, back = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(self.known, each), len(self.known) - 1)
                hit = (self.known[at] == each)[back]
                rank, at = rank[hit], at[back[hit]]
                better = np.abs(self.z[at]) > np.abs(z[rank])
                rank, at = rank[better], at[better]
                odds[rank], z[rank] = self.odds[at], self.z[at]
        return odds - DRIFT

    def segments(self, texts: list[str | None]):
        """For each text the number of its words and its maximal segments in words; and the words."""
        import numpy as np

        found = words(texts)
        scores = self.word_scores(found)
        cuts = np.searchsorted(found.row, np.arange(len(texts) + 1)).tolist()
        return [(b - a, maximal_segments(scores[a:b])) for a, b in zip(cuts, cuts[1:])], found, cuts

    def excess(self, n: int, segments) -> float:
        """What the segments have beyond chance in a text of n words."""
        m = self.model
        return sum(max(0.0, m.rate * s - math.log(m.space * max(n, 1))) for _, _, s in segments)

    def score(self, texts: list[str | None]) -> list[dict]:
        """The probability and the significant segments, in code points, of each text."""
        m, out = self.model, []
        rated, found, cuts = self.segments(texts)
        for (n, segments), first, begin in zip(rated, cuts, found.begins.tolist()):
            x = m.bias + m.slope * self.excess(n, segments)
            significant = [(a, b, s, e) for a, b, s in segments if (e := m.space * n * math.exp(-m.rate * s)) < 1]
            spans = [{"start": int(found.start[first + a]) - begin, "end": int(found.end[first + b - 1]) - begin, "score": s, "expected": e} for a, b, s, e in significant]
            out.append({"score": 1 / (1 + math.exp(-max(-500.0, min(500.0, x)))), "passages": spans})
        return out


def labelled_sample(labels: DataFrame, id_col: str = "doc_id", label: str = "toxic", most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, toxic) of one row per labelled id: all, or a share of about ``most`` chosen by a hash of the id.

    Ids or labels that are null are left out; of conflicting labels the larger counts.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _step(x: float) -> float:
    """``x`` to a multiple of 2**-20: sums of such numbers are exact, so they do not depend on the order of rows."""
    return round(x * 2**20) / 2**20


def _counts(rows: DataFrame) -> DataFrame:
    """(feature, y1, y0, docs) by label: each document adds 1 + log2 of a feature's occurrences.

    The logarithm keeps a word that one document repeats from looking
    typical of its label.  Sums are made per task, in pieces of bounded size.
    """

    def count(batches):
        import numpy as np

        def rows_of(texts, toxic):
            found = words(texts)
            label = np.array([1 if y else 0 for y in toxic])
            for k, (rank, h) in zip((None, *BEGINNINGS), found.hashes):
                if not len(rank):
                    continue
                # occurrences of each feature in each text
                order = np.lexsort((h, found.row[rank]))
                row, h, rank = found.row[rank][order], h[order], rank[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
                times = np.diff(np.r_[new, len(h)])
                weight = 1 + np.round(np.log2(times) * 2**20) / 2**20
                row, h, rank = label[row[new]], h[new], rank[new]
                order = np.lexsort((h, row))
                row, h, rank, weight = row[order], h[order], rank[order], weight[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
                start = found.start[rank[new]]
                end = found.end[rank[new]] if k is None else start + k
                mark = "" if k is None else "*"
                names = [found.text[a:b] + mark for a, b in zip(start.tolist(), end.tolist())]
                columns = [pa.array(names, pa.string()), pa.array(row[new].astype(np.int32)), pa.array(np.add.reduceat(weight, new)), pa.array(np.diff(np.r_[new, len(h)]))]
                yield pa.RecordBatch.from_arrays(columns, ["feature", "toxic", "n", "docs"])

        forget()
        texts, toxic, size = [], [], 0
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.append(t)
                toxic.append(y)
                size += len(t or "")
                if size > 2 * CHUNK:
                    yield from rows_of(texts, toxic)
                    texts, toxic, size = [], [], 0
        if texts:
            yield from rows_of(texts, toxic)

    of = lambda k: F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0.0))
    return rows.mapInArrow(count, "feature string, toxic int, n double, docs long").groupBy("feature").agg(of(1).alias("y1"), of(0).alias("y0"), F.sum("docs").alias("docs"))


def log_odds(counts: DataFrame) -> dict[str, tuple[float, float]]:
    """All significant features: log-odds (one deviation nearer to zero) and significance."""
    n1, n0 = counts.agg(F.coalesce(F.sum("y1"), F.lit(0.0)), F.coalesce(F.sum("y0"), F.lit(0.0))).first()
    if not n1 or not n0:
        return {}
    a = F.greatest(F.lit(PRIOR / (n1 + n0)) * (F.col("y1") + F.col("y0")), F.lit(LEAST_PRIOR))
    of = lambda y, n: F.log((F.col(y) + a) / (F.lit(float(n + PRIOR)) - F.col(y) - a))
    spread = F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))
    rated = counts.select("feature", (of("y1", n1) - of("y0", n0)).alias("d"), spread.alias("sd")).withColumn("z", F.col("d") / F.col("sd")).where(F.abs("z") >= LEAST_Z)
    return {r["feature"]: (math.copysign(abs(r["d"]) - r["sd"], r["d"]), r["z"]) for r in rated.select("feature", "d", "sd", "z").collect()}


def _law(model: Model, rated: DataFrame) -> None:
    """Fit the extreme-value law to the segments of the clean training texts."""
    total = F.sum(F.aggregate("s", F.lit(0.0), lambda a, x: a + x))
    words, n, score = (x or 0 for x in rated.where("toxic = 0").agg(F.sum("n"), F.sum(F.size("s")), total).first())
    # scores of segments in clean text fall off exponentially: its rate, with one prior segment
    n, score = (n, score) if n else (1, 1.0)
    model.rate = min(1.0, (n + 1) / (score + 2.0))
    model.space = (n + 1) / (words + 1)


def _excess(model: Model) -> Column:
    """``Scorer.excess`` of the columns n and s."""
    chance = F.lit(math.log(model.space)) + F.log(F.greatest(F.col("n"), F.lit(1)).cast("double"))
    return F.aggregate("s", F.lit(0.0), lambda a, x: a + F.greatest(F.lit(0.0), F.lit(model.rate) * x - chance))


def _calibrate(model: Model, rated: DataFrame) -> None:
    """Logistic fit of the label on the summed excess, by Newton steps with a small ridge.

    Two numbers a row reach the driver, of the bounded training rows only, whatever the length of their texts.
    """
    import numpy as np

    rows = sorted((r["x"], float(r["toxic"])) for r in rated.select("toxic", F.least(_excess(model), F.lit(50.0)).alias("x")).collect())
    x, y = np.array([x for x, _ in rows]), np.array([y for _, y in rows])
    w, design = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 0.01 * w
        hess = design.T @ (design * (p * (1 - p))[:, None]) + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.bias, model.slope = float(w[0]), max(0.0, float(w[1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MAX_LABELLED) -> Model:
    """A model from the documents that ``labels`` marks; all other documents are left unread after the join.

    Without toxic or without clean training rows the model has no features
    and gives every text the same score below one half.
    """
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(labels, id_col, label, most)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic")
    model = Model(log_odds(materialize(_counts(rows).where(F.col("docs") >= LEAST_DOCS), "toxicity")))
    if not model.odds:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<n:int,s:array<double>>")
    def seen(texts: pa.Array) -> pa.Array:
        found = once(Scorer, shared.value).segments(texts.to_pylist())[0]
        return pa.array([{"n": n, "s": [_step(s) for _, _, s in segments]} for n, segments in found], pa.struct([("n", pa.int32()), ("s", pa.list_(pa.float64()))]))

    rated = materialize(rows.select("toxic", seen("text").alias("x")).select("toxic", "x.n", "x.s"), "segments")
    _law(model, rated)
    _calibrate(model, rated)
    return model


def toxicity(model: Model, spark) -> object:
    """A column function: text -> struct(score, passages)."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("score", pa.float64()), ("passages", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])))])

    @arrow_udf(RESULT)
    def rate(texts: pa.Array) -> pa.Array:
        return pa.array(once(Scorer, shared.value).score(texts.to_pylist()), kind)

    return rate


def score(df: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add ``out``: the probability and the significant passages [start, end) in code points.

    Null and empty texts have no passages and the probability of a text without any.
    """
    return df.withColumn(out, toxicity(model, df.sparkSession)(F.col(text)))


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: CRC32 of the id's text is a multiple of 5; null ids are held out."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 5 == 0, F.lit(True))
