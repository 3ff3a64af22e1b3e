import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import components, registry, simhash, spotsigs, substring


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5), (7, None)]
    parent = list(range(400))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if b is not None:
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    got = dict(components.components(spark.createDataFrame(pairs, "u long, v long")).collect())
    assert got == {x: top(x) for p in pairs for x in p if x is not None and p[0] != p[1] and None not in p}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def near(fps):
    """Smallest document by brute force over all pairs within three bits."""
    comp = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 3:
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    return comp


def test_simhash_components(spark, docs):
    rows = docs.orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = [simhash.simhash(r["text"]) for r in rows]
    assert [got[r["doc_id"]]["fp"] for r in rows] == fps
    assert [got[r["doc_id"]]["component_id"] for r in rows] == [rows[c]["doc_id"] for c in near(fps)]


def test_links_are_whole(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    some = base + [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(1, 6))) for b in base for _ in range(4)]
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in some})
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert {tuple(r) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()} == want


def test_simhash_edges(spark, edge, empty):
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(edge).collect()]
    assert len(got) == 11 and {(d, c) for d, f, c in got if d in (1, 2, 3)} == {(1, 1), (2, 1), (3, 1)} and all(f == 0 for d, f, _ in got if d in (1, 2, 3))
    assert {c for d, _, c in got if d in (8, 9)} == {8}
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8]
    assert simhash.keep_one(empty).count() == 0


def test_spotsigs_edges(spark, edge, empty):
    rows = spotsigs.compare_with_next(edge).collect()
    assert len(rows) == 11 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert spotsigs.compare_with_next(empty).count() == 0
    one = spotsigs.compare_with_next(edge.where("doc_id = 8")).first()
    assert one["near_next"] == 1.0 and one["n_chars"] == 24
    parts = {p: sorted(map(tuple, spotsigs.compare_with_next(edge.where("doc_id is not null"), parts=p).collect())) for p in (1, 7)}
    assert parts[1] == parts[7]


def test_spotsigs_pairs(spark, docs):
    sets = {r["fp"]: set(r["s"]) for r in docs.select(spotsigs.signatures(F.col("text")).alias("s")).withColumn("fp", spotsigs.fingerprint(F.col("s"))).where("size(s) > 0").collect()}
    names = sorted(sets)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in spotsigs.similar_sets(docs).collect()} == want
    found = spotsigs.near_duplicates(docs)
    assert found.count() == docs.count() and found.where("class_id > doc_id").count() == 0


def words(rng, n):
    return [f"w{rng.randrange(10_000)}" for _ in range(n)]


def test_passages(spark):
    rng = random.Random(7)
    p, q = words(rng, 60), words(rng, 52)
    fuzzy = [w if i % 15 else "edited" for i, w in enumerate(words(rng, 120))]
    original = [w if i % 30 else f"other{i}" for i, w in enumerate(fuzzy)]
    docs = [
        (1, words(rng, 100) + p + words(rng, 50)),
        (2, words(rng, 30) + p + words(rng, 40) + q),
        (3, q + words(rng, 300)),
        (4, words(rng, 80) + p[:40] + words(rng, 80)),
        (5, words(rng, 20) + original + words(rng, 20)),
        (6, words(rng, 70) + fuzzy + words(rng, 9)),
        (7, words(rng, 500)),
    ]
    df = spark.createDataFrame([(i, " \n".join(t), len(t)) for i, t in docs], "doc_id long, text string, n_chars long")
    got = {(r["doc_id"], r["source_id"]): (r["start_word"], r["end_word"]) for r in substring.passages(df).collect()}
    assert set(got) == {(2, 1), (3, 2), (6, 5)}
    assert got[2, 1] == (30, 90) and got[3, 2] == (0, 52)
    assert abs(got[6, 5][0] - 70) <= 3 and abs(got[6, 5][1] - 190) <= 3
    left = {r["doc_id"]: r["text"].split() for r in substring.cut(df).collect()}
    texts = dict(docs)
    assert left[2] == texts[2][:30] + texts[2][90:] and left[3] == texts[3][52:] and all(left[i] == texts[i] for i in (1, 4, 5, 7))


def test_repetitions_within_a_passage(spark):
    """Copies of texts that repeat a line, or one word over and over, are covered as a whole."""
    rng = random.Random(3)
    line = words(rng, 12)
    docs = [(1, line * 5), (2, line * 5), (3, words(rng, 9) + line * 6), (4, words(rng, 5) + ["the"] * 70), (5, words(rng, 7) + ["the"] * 70 + words(rng, 7))]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    covered = {}
    for r in substring.passages(df).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert covered == {2: set(range(60)), 3: set(range(9, 81)), 5: set(range(7, 77))}


def test_longer_runs_of_one_word_are_covered(spark):
    rng = random.Random(5)
    docs = [(1, words(rng, 9) + ["so"] * 50 + words(rng, 9)), *[(i, words(rng, i) + ["so"] * n + words(rng, 3)) for i, n in enumerate((51, 66, 97, 240, 1_003), 2)], (9, ["no"] * 49 + words(rng, 5)), (10, ["no"] * 90)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    covered = {}
    for r in substring.passages(df).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert covered == {i: set(range(i, i + n)) for i, n in enumerate((51, 66, 97, 240, 1_003), 2)}


def test_exact_passages_do_not_depend_on_the_places_of_seeds(spark, monkeypatch):
    """Passages of three documents are found by their windows where no seed is matched at all."""
    rng = random.Random(9)
    p = words(rng, 60)
    df = spark.createDataFrame([(i, " ".join(words(rng, 9 * i) + p + words(rng, 5))) for i in (1, 2, 3)], "doc_id long, text string")
    monkeypatch.setattr(substring, "_alike", lambda a, b: F.lit(False))
    got = sorted(tuple(r) for r in substring.passages(df).collect())
    assert got == [(2, 18, 78, 1, 9, 60), (3, 27, 87, 1, 9, 60)]


def longest_passages(texts):
    """(doc_id, start, end) of all runs of 50 words or more that an earlier text has too and that cannot be made longer, by brute force."""
    out, before = set(), []
    for i, t in texts:
        a, ends = np.array(t), np.zeros(len(t) + 1, int)
        for b in before:
            row = np.zeros(len(b) + 1, int)
            for x in range(len(a) - 1, -1, -1):  # equal words from here on
                row[:-1] = np.where(b == a[x], row[1:] + 1, 0)
                ends[x] = max(ends[x], x + row.max())
        out |= {(i, x, int(ends[x])) for x in range(len(a)) if ends[x] - x >= 50 and (not x or ends[x - 1] < ends[x])}
        before.append(a)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_passages_are_listed_as_long_as_they_are(spark, monkeypatch, seed):
    """Passages that first stood in pieces, runs of up to three words and repeated lines, of which earlier documents have shorter ones."""
    rng = random.Random(seed)
    bases, line = [words(rng, 150) for _ in range(3)], words(rng, 12)
    texts = []
    for _ in range(24):
        t = words(rng, 3)
        for _ in range(3):
            base, s = rng.choice(bases), rng.randrange(90)
            n, run = rng.randrange(45, 130), rng.choice([["so"], ["so"], ["x", "y"], ["p", "q", "r"], line])
            t += rng.choice([base[s : s + rng.randrange(30, 150)], [run[k % len(run)] for k in range(n)], words(rng, 5), base[100:] + ["so"] * n])
        texts.append(t)
    # every text stands there three times, so all seeds are crowded
    docs = [(i + 100 * copy, t) for copy in range(3) for i, t in enumerate(texts)]
    monkeypatch.setattr(substring, "_alike", lambda a, b: F.lit(False))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    found = substring.passages(df).collect()
    every = dict(docs)
    for r in found:
        n = r["end_word"] - r["start_word"]
        assert r["source_id"] < r["doc_id"] and r["n_equal"] == n and every[r["doc_id"]][r["start_word"] : r["end_word"]] == every[r["source_id"]][r["source_word"] :][:n]
    first = {(r["doc_id"], r["start_word"], r["end_word"]) for r in found if r["doc_id"] < 100}
    assert first == longest_passages(docs[: len(texts)])
    assert len(found) - len(first) == 2 * sum(len(t) >= 50 for t in texts)


def test_cut_deletes_the_words_of_all_whole_passages(spark, docs):
    def covered(whole):
        out = {}
        for r in substring.passages(docs, whole=whole).collect():
            out.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
        return out

    assert covered(True) == covered(False)


@pytest.mark.parametrize("run", [("Is", "onhe."), ("Is", "q5z"), ("a", "b", "c")])
def test_runs_of_a_few_words_are_covered_by_few_seeds(spark, run):
    rng = random.Random(6)
    docs = [(i, words(rng, 7 * i) + [run[(i + k) % len(run)] for k in range(600)] + words(rng, 5)) for i in (1, 2)]
    assert all(len(substring.seeds(*substring.word_hashes(pa.array([" ".join(t)])))[0]) < 80 for _, t in docs)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    covered = set()
    for r in substring.passages(df).collect():
        assert r["doc_id"] == 2
        covered.update(range(r["start_word"], r["end_word"]))
    assert covered == set(range(14, 614))


def test_word_hashes():
    texts = pa.array(["A b\tc", None, "", "x" * 100 + " ü", " b ", "Ü"])
    h, begins = substring.word_hashes(texts)
    assert begins.tolist() == [0, 3, 3, 3, 5, 6, 7] and h[1] == h[5] and h[4] == h[6] and len(set(h.tolist())) == 5
    some = ["a bb ccc " * 50, "dd"]
    whole = substring.word_hashes(pa.array(some))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(substring, "CHUNK", 7)
        assert all((x == y).all() for x, y in zip(whole, substring.word_hashes(pa.array(some))))


def test_no_exact_passage_is_missed(spark, docs):
    """Every window of 50 words that an earlier document has is covered."""
    covered = {}
    for r in substring.passages(docs).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    first = {}
    for r in docs.orderBy("doc_id").collect():
        w = (r["text"] or "").lower().split()
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), r["doc_id"]) != r["doc_id"]:
                assert set(range(i, i + 50)) <= covered.get(r["doc_id"], set())


def test_reported_passages_are_repeated(spark, docs):
    """Precision: the words of every passage can be aligned with the source's so that enough of them are equal."""
    from difflib import SequenceMatcher

    texts = {r["doc_id"]: (r["text"] or "").lower().split() for r in docs.collect()}
    found = substring.passages(docs).collect()
    assert len(found) > 10
    for r in found:
        a = texts[r["doc_id"]][r["start_word"] : r["end_word"]]
        b = texts[r["source_id"]][r["source_word"] : r["source_word"] + int(len(a) / substring.IDENTITY) + 1]
        equal = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        # the matcher is not optimal, so a little less than the operator's own count is allowed
        assert r["source_id"] < r["doc_id"] and len(a) >= substring.MIN_WORDS and r["n_equal"] >= substring.IDENTITY * len(a) and equal >= 0.95 * r["n_equal"] - 2


def test_rows_without_ids_and_with_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (None, text), (5, text), (6, "other words"), (6, "more words"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in simhash.keep_one(df).collect()]
    assert (5, text) in kept and (None, text) not in kept and sum(i == 6 for i, _ in kept) == 1
    assert sorted(kept, key=str) == sorted((tuple(r) for r in simhash.keep_one(df.repartition(5)).collect()), key=str)
    cut = [tuple(r) for r in substring.cut(df.where("doc_id is null or doc_id < 6")).collect()]
    assert sorted(cut, key=str) == sorted([(None, ""), (None, ""), (5, text), (None, None)], key=str)


def test_substring_edges(spark, edge, empty):
    left = substring.cut(edge)
    assert left.columns == edge.columns and left.count() == 11
    assert substring.passages(empty).count() == 0 and substring.cut(empty).count() == 0
    assert substring.delete("a b  c d", [(1, 2), (1, 3)]) == "a d"


def test_chain_and_align():
    a, b = np.arange(100, dtype=np.uint32), np.r_[np.arange(500, 520), np.arange(40), [999], np.arange(41, 100)].astype(np.uint32)
    x = np.array([2, 9, 20, 50, 70, 90, 30, 5])
    y = np.array([22, 29, 40, 70, 90, 110, 3, 100])
    row, source, *parts = substring.segments(np.zeros(8, int), np.ones(8, int), x, y)
    parts = list(zip(*(p.tolist() for p in parts)))
    best = substring.chains(parts)[0]
    assert [(p[0], p[1]) for p in best] == [(2, 22), (50, 70)] and best[0][2:] == (18 + substring.K, 3 * substring.K)
    assert substring.all_repeated(best, a, b) == [(0, 100, 20, 120, 99)]


def brute_chains(parts):
    """Best score over all ascending sequences of segments."""
    K, best = substring.K, {}
    for i in sorted(range(len(parts)), key=lambda i: parts[i]):
        x, y, n, c = parts[i]
        before = [best[j] - substring.GAP * (x - parts[j][0] + y - parts[j][1] - 2 * parts[j][2]) for j in best if parts[j][0] + parts[j][2] - K + 1 <= x and parts[j][1] + parts[j][2] - K + 1 <= y]
        best[i] = c + max([0, *before])
    return max(best.values())


def test_chains_score_as_brute_force():
    rng = random.Random(11)
    for _ in range(60):
        parts = sorted({(rng.randrange(50), rng.randrange(50), n, n) for n in (rng.randrange(5, 12) for _ in range(12))})
        chain = substring.chains(parts)[0]
        score = sum(p[3] for p in chain) - substring.GAP * sum(q[0] - p[0] + q[1] - p[1] - 2 * p[2] for p, q in zip(chain, chain[1:]))
        assert score == pytest.approx(brute_chains(parts))


def test_registered_queries_cover_all_rows(spark, small, docs):
    assert registry.op2_simhash(spark, small).count() == docs.count()
