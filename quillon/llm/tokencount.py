"""Token counts under a unigram vocabulary, without building tokens.

Aho-Corasick enumerates the vocabulary pieces that end at every position of
a word; dynamic programming keeps, per position, the best score and the
number of pieces of the best path.  Ties follow the tokenizers library:
candidates are met by ascending start and only a strictly better score
replaces one, so the earliest start wins; a character without a piece of its
own costs the lowest score less 10 and counts as its UTF-8 bytes where the
vocabulary has byte pieces, else runs of such characters count as one.

Words (a word-start mark and what follows it) are independent, so counts are
remembered per word in each Python worker, up to a bounded number.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Remembered, bounded_batches, once

MARK = "▁"
PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece model file, by id; id 0 is the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


class Counter:
    """Counts pieces of whole texts."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        #: Line ends are a boundary of their own where no longer piece has one.
        self.lines = not any("\n" in p and p != "\n" for p in names)
        self.start, self.inside = Remembered(lambda word: self.word(MARK + word)), Remembered(self.word)
        self.newline = self.word("\n")

    def word(self, word: str) -> int:
        """Pieces of the best segmentation of one word."""
        n = len(word)
        best, count, fused = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.auto.iter(word):
            ends[end].append(found)
        for e in range(1, n + 1):
            top, pieces, unk, single = None, 0, False, False
            # every piece that ends here, the longest first
            for length, score in sorted(ends[e - 1], reverse=True):
                single |= length == 1
                s = e - length
                if top is None or best[s] + score > top:
                    top, pieces, unk = best[s] + score, count[s] + 1, False
            if not single and (top is None or best[e - 1] + self.unknown > top):
                top, unk = best[e - 1] + self.unknown, True
                pieces = count[e - 1] + (len(word[e - 1].encode()) if self.bytes else not fused[e - 1])
            best[e], count[e], fused[e] = top, pieces, unk
        return count[n]

    def text(self, text: str | None) -> int:
        """Pieces of a whole text: spaces are word-start marks, one is put before the text; null and empty: 0."""
        if not text:
            return 0
        start, inside = self.start, self.inside
        text = text.replace(MARK, " ")
        lines = (text if text[0] == " " else " " + text).split("\n") if self.lines else [text if text[0] == " " else " " + text]
        total = self.newline * (len(lines) - 1)
        for line in lines:
            first, *rest = line.split(" ")
            if first:
                total += inside[first]
            total += sum(map(start.__getitem__, rest))
        return total


def counter(spark: SparkSession, pieces: list[tuple[str, float]]):
    """A column function: text -> number of tokens.  The vocabulary is broadcast; its size is the file's."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(pieces)

    @arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        of = once(Counter, shared.value).text
        return pa.array([of(t.as_py()) for t in texts], pa.int64())

    return count


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add ``out``: tokens of every whole text under the vocabulary in ``path``.

    Null and empty texts have 0 tokens; rows and other columns pass through.
    """
    return df.withColumn(out, counter(df.sparkSession, vocabulary(path))(F.col(text)))
