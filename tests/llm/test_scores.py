import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing, registry, toxicity


def brute(scores):
    """All maximal-scoring segments by their recursive definition."""

    def within(a, b):
        best = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (best is None or total > best[2] + 1e-9):
                    best = (i, j + 1, total)
        return [] if best is None else within(a, best[0]) + [best] + within(best[1], b)

    return [x[:2] for x in within(0, len(scores))]


def test_segments():
    rng = random.Random(1)
    for _ in range(300):
        s = [round(rng.uniform(-3, 3), 5) for _ in range(rng.randrange(13))]
        assert [x[:2] for x in toxicity.maximal_segments(s)] == brute(s)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = registry.op8_toxicity(spark, folder).join(labels, "doc_id").where("held_out").collect()
    pos, neg = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.9 and all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_toxicity_edges(spark, edge, empty):
    toxic = [(100 + i, f"plain words here {'vile idiot' if i % 2 else 'nice friend'} number {i}", i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in toxic], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.odds["idiot"][0] > 0 > model.odds["friend"][0]
    rows = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    assert all((rows[i]["score"] >= 0.5) == bool(y) for i, _, y in toxic)
    text, spans = toxic[1][1], rows[101]["passages"]
    assert "idiot" in text[spans[0]["start"] : spans[0]["end"]]
    assert toxicity.score(edge, model).where("toxicity.score < 0.5").count() == 11
    none = toxicity.train(docs, labels.limit(0))
    assert {r["toxicity"]["score"] for r in toxicity.score(docs, none).collect()} == {toxicity.score(edge, none).first()["toxicity"]["score"]}
    assert toxicity.score(empty, model).count() == 0 and toxicity.train(empty, labels).odds == {}


def plain_features(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return words, [[w, *(w[:k] + "*" for k in (4, 5, 6, 7) if len(w) >= k)] for w in words]


def test_toxicity_is_as_brute_force(spark):
    """Counts, log-odds, segments, law, calibration and scores, all worked out again word by word."""
    rng = random.Random(8)
    vocabulary = [f"w{rng.randrange(90)}rest" for _ in range(60)] + ["vile", "viler", "Idiots", "ok", "straße", "a_b"]
    docs = [(i, " ".join(rng.choice(vocabulary[:60]) for _ in range(rng.randrange(1, 40))) + (" " + " ".join(rng.choices(vocabulary[60:63], k=3)) if i % 4 == 0 else " ok straße a_b"), int(i % 4 == 0)) for i in range(160)]
    model = toxicity.train(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in docs], "doc_id long, toxic int"))
    y, seen = {0: {}, 1: {}}, {}
    for _, text, toxic in docs:
        own = {}
        for fs in plain_features(text)[1]:
            for f in fs:
                own[f] = own.get(f, 0) + 1
        for f, n in own.items():
            y[toxic][f] = y[toxic].get(f, 0) + 1 + math.log2(n)
            seen[f] = seen.get(f, 0) + 1
    kept = [f for f in seen if seen[f] >= 3]
    n1, n0 = (sum(y[k].get(f, 0) for f in kept) for k in (1, 0))
    odds = {}
    for f in kept:
        a, b = y[1].get(f, 0), y[0].get(f, 0)
        prior = max(500 / (n1 + n0) * (a + b), 0.5)
        d = math.log((a + prior) / (n1 + 500 - a - prior)) - math.log((b + prior) / (n0 + 500 - b - prior))
        sd = math.sqrt(1 / (a + prior) + 1 / (b + prior))
        if abs(d / sd) >= 2.8:
            odds[f] = (math.copysign(abs(d) - sd, d), d / sd)
    assert set(model.odds) == set(odds) and len(odds) >= 4
    assert all(model.odds[f] == pytest.approx(odds[f], rel=1e-4) for f in odds)
    scores = [[max((model.odds[f] for f in fs if f in model.odds), key=lambda v: abs(v[1]), default=(0, 0))[0] - 0.5 for fs in plain_features(t)[1]] for _, t, _ in docs]
    found = [[sum(s[a:b]) for a, b in brute(s)] for s in scores]
    clean = [(s, f) for s, f, d in zip(scores, found, docs) if not d[2]]
    n, total = sum(len(f) for _, f in clean), sum(sum(f) for _, f in clean)
    n, total = (n, total) if n else (1, 1.0)
    assert model.rate == pytest.approx(min(1, (n + 1) / (total + 2)), rel=1e-4)
    assert model.space == pytest.approx((n + 1) / (sum(len(s) for s, _ in clean) + 1))
    x = [sum(max(0, model.rate * v - math.log(model.space * max(len(s), 1))) for v in f) for s, f in zip(scores, found)]
    p = [1 / (1 + math.exp(-(model.bias + model.slope * min(v, 50)))) for v in x]
    # the fit is where the gradient of the penalised likelihood is zero
    assert sum(q - d[2] for q, d in zip(p, docs)) + 0.01 * model.bias == pytest.approx(0, abs=1e-3)
    assert sum((q - d[2]) * min(v, 50) for q, d, v in zip(p, docs, x)) + 0.01 * model.slope == pytest.approx(0, abs=1e-2)
    rated = {r["doc_id"]: r["toxicity"] for r in toxicity.score(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), model).collect()}
    assert all(rated[d[0]]["score"] == pytest.approx(1 / (1 + math.exp(-(model.bias + model.slope * v))), abs=1e-4) for d, v in zip(docs, x))


def test_passages_keep_their_place_where_lower_case_is_longer():
    model = toxicity.Model({"vile": (6.0, 9.0)}, rate=1.0, space=0.01)
    text = "İİ one İ two vile VILE end"
    (found,) = toxicity.Scorer(model).score([text])
    assert [text[p["start"] : p["end"]] for p in found["passages"]] == ["vile VILE"]
    both = toxicity.Scorer(model).score([None, "x vile", "", text])
    assert both[3] == found and [len(b["passages"]) for b in both] == [0, 1, 0, 1] and both[1]["passages"][0]["start"] == 2


def test_words_are_hashed_alike_everywhere(monkeypatch):
    texts = ["Ein Wörtchen_zwei 漢字 über 123abcdefgh", None, "x", "ein " * 20]
    whole = toxicity.words(texts)
    assert [whole.text[a:b] for a, b in zip(whole.start, whole.end)][:5] == ["ein", "wörtchen", "zwei", "漢字", "über"]
    assert int(whole.hashes[0][1][1]) == toxicity.feature_hash("wörtchen") and int(whole.hashes[2][1][0]) == toxicity.feature_hash("wörtc*")
    monkeypatch.setattr(toxicity, "CHUNK", 9)
    assert all((a == b).all() for x, y in zip(whole.hashes, toxicity.words(texts).hashes) for a, b in zip(x, y))


def test_mixing_targets(spark, small):
    rows = registry.op7_mixing(spark, small).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    by = {(r["source_size"], r["target"]) for r in rows}
    assert all(t <= 3 * s for s, t in by)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, registry.op7_mixing(spark, small).collect()))


def test_taken_words_come_near_the_targets(spark, monkeypatch):
    """Within the largest document of the source for every shard, and within 5 % where no document is large."""
    for shard in (mixing.SHARD, 20):
        monkeypatch.setattr(mixing, "SHARD", shard)
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
        rows = mixing.plan(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.count("*").alias("n")).collect()
        assert len(rows) > 5
        assert all(abs(r["taken"] - r["target"]) <= r["most"] * (-(-r["n"] // shard)) for r in rows)
    even = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), F.expr("repeat('w ', 50 + int(id % 31))").alias("text"))
    for r in mixing.plan(even).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 0.05 * r["target"]


def test_targets_share_all_and_stop_at_the_limit(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 5), (None, 500), ("d", 0)]
    s = mixing.weights_by_order(spark.createDataFrame(sizes, "source string, source_size long"))
    got = {r["source"]: (r["weight"], r["target"]) for r in mixing.targets(s).collect()}
    assert {k: w for k, (w, _) in got.items()} == {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    assert got["a"][1] == 30 and got["c"][1] == 15 and got["d"][1] == 0
    assert got["b"][1] == got[None][1] == (1515 - 45) / 4 * 2


def test_mix_edges(spark, edge, empty):
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns
    planned = mixing.plan(edge).agg(F.sum("copies")).first()[0]
    assert mixed.count() == planned
    assert mixing.mix(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1])
def test_draw_is_uniform(spark, n):
    us = [r[0] for r in spark.range(2000).select(mixing.draw(F.col("id") + n * 5000)).collect()]
    assert abs(sum(us) / 2000 - 0.5) < 0.03 and all(0 <= u < 1 for u in us)
