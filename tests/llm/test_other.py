import json
import os
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import bpe, chat, html, registry, tokencount, topk, toxicity


def test_lines_of_a_page():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li>Home</ul></nav><div id=cookie-notice>We use cookies</div><!-- <p>gone</p> -->
    <main><article><header><h2>Title &amp; more</h2><p>by me</p></header><p>One<br>two&nbsp; three <b>bo</b>ld<p>Next<form><input value="x"><p>Mail</form>
    <div class="ad">Buy</div><p>a &lt;b&gt; &copy</p></article><section class="comments"><p>First!</p></section></main>
    <aside>More</aside><footer>&copy; us</footer></body></html>"""
    assert [t for t, k in html.lines(page) if k == html.MAIN] == ["Title & more", "One two three bold", "Next", "a <b> ©"]
    assert html.lines(None) == html.lines("") == [] and html.lines("<div class='ad'>x<article><p>y</article>")[-1] == ("y", html.MAIN)
    assert html.lines("plain < text") == [("plain < text", html.OTHER)]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = [[rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2)]
        found = html.common(a, b)
        assert len(found) == lcs(a, b) and found == sorted(found)


def test_alignment_by_rows_is_as_long():
    rng = random.Random(4)
    for _ in range(300):
        a, b = [[rng.randrange(3) for _ in range(rng.randrange(15))] for _ in range(2)]
        found = html._by_rows(a, b)
        rest = iter(b)
        assert len(found) == lcs(a, b) and all(any(y == a[i] for y in rest) for i in found)
    assert len(html.common([1] * 20_000 + [2] + [3] * 20_000, [3] * 15_000 + [2] + [1] * 20_000)) == 20_000


@pytest.mark.parametrize("page", ["<div>" * 200_000, '<a "' * 250_000, "<b>" * 100_000 + "<p>x</p>" * 60_000, "<div>" * 100_000 + "</span>" * 100_000, "<!-- " * 200_000, "<article><p>y" + "<i>" * 300_000])
def test_long_pages_take_seconds(page):
    began = time.process_time()
    html.lines(page)
    assert time.process_time() - began < 15


def brute_text(pages, page_id):
    """The text of a page by the stated rules, all its neighbours being looked for among all pages."""

    def split(url):
        rest = re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//", "", url or "")
        host, slash, path = rest.partition("/")
        return host.lower(), re.split("[?#]", slash + path)[0]

    by = {}
    for i, url, page in sorted(pages, key=lambda p: p[0]):
        by.setdefault(split(url), html.lines(page))
    own = next(p for p in pages if p[0] == page_id)
    host, path = split(own[1])
    lines = html.lines(own[2])
    paths = sorted(p for h, p in by if h == host)
    at = paths.index(path)
    near = [paths[i] for i in (at - 1, at + 1) if 0 <= i < len(paths)]
    near.sort(key=lambda p: -len(os.path.commonprefix([p, path])))
    if any(k == html.MAIN for _, k in lines):
        return "\n".join(t for t, k in lines if k == html.MAIN)
    kept = lines
    for p in near:
        other, left = by[host, p], [x for x in lines if x[1] == html.OTHER]
        table = [[0] * (len(other) + 1) for _ in range(len(lines) + 1)]
        for i in range(len(lines) - 1, -1, -1):
            for j in range(len(other) - 1, -1, -1):
                table[i][j] = table[i + 1][j + 1] + 1 if lines[i] == other[j] else max(table[i + 1][j], table[i][j + 1])
        i = j = 0
        shared = set()
        while i < len(lines) and j < len(other):
            if lines[i] == other[j]:
                shared.add(i)
                i, j = i + 1, j + 1
            elif table[i + 1][j] >= table[i][j + 1]:
                i += 1
            else:
                j += 1
        if sum(lines[i][1] == html.OTHER for i in shared) <= html.COPY * len(left):
            kept = [x for i, x in enumerate(lines) if i not in shared]
            break
    return "\n".join(t for t, k in kept if k == html.OTHER)


def test_query_is_as_brute_force(spark, tmp_path):
    """All pages of a table, a third of them without an article element, so that neighbours decide."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(400)}"
    pages = []
    for i in range(120):
        body = "".join(f"<p>{word()} {word()} {word()} {i}</p>" for _ in range(rng.randrange(1, 6)))
        body = f"<article>{body}</article>" if i % 3 else body
        pages.append((i, f"http://h{i % 4}/s{rng.randrange(9)}/p{i}", f"<body><p>Menu of h{i % 4}</p><nav><p>x</p></nav>{body}<p>All rights {rng.randrange(2)}</p></body>"))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in registry.op4_html(spark, str(tmp_path)).collect()}
    assert len(got) == 120 and all(r["text"] == brute_text(pages, i) and r["n_chars"] == len(r["text"]) for i, r in got.items())
    alone = {i: "\n".join(t for t, k in html.lines(p) if k == html.OTHER) for i, _, p in pages if i % 3 == 0}
    assert sum(got[i]["text"] != t for i, t in alone.items()) > 30  # withheld neighbours would change the result


def test_differencing(spark):
    page = lambda body: f"<body><p>Menu</p><p>Welcome to the site</p>{body}<p>All rights</p></body>"
    rows = [(1, "http://h/a/1", page("<p>One.</p>")), (2, "http://h/a/2", page("<p>Two.</p><p>Three.</p>")), (3, "http://h/a/2?p=2", page("<p>Two.</p><p>Three.</p>")), (4, "http://other/a/1", page("<p>Lone.</p>")), (5, None, None), (5, None, None), (6, "http://h/z", "<article>Kept</article><p>Menu</p>")]
    df = spark.createDataFrame([(*r, "u") for r in rows], "page_id long, url string, html string, path string")
    for parts in (1, 4):
        got = {r["page_id"]: r["text"] for r in html.extract(df, parts=parts).collect()}
        assert got == {1: "One.", 2: "Two.\nThree.", 3: "Two.\nThree.", 4: "Menu\nWelcome to the site\nLone.\nAll rights", 5: "", 6: "Kept"}
    assert html.extract(df).count() == 7 and html.extract(df.limit(0)).count() == 0


def test_top_k_edges(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(700)] + [(700, None), (701, [1.0, None]), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (None, [1.0] * 8), (5, [0.5] * 8)]
    rows += [(800 + i, [1.0] * 8) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = [(i, [int(np.floor(1024 * y)) for y in x]) for i, x in rows if i is not None and x is not None and all(y is not None and np.isfinite(y) for y in x)]
    for q, own in v:
        if q % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(own, x)), i) for i, x in v if i != q))[:10]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 100"), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_of_repeated_ids_is_as_sql(spark, tmp_path):
    rows = [(100, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [0.5, 0.0]), (200, [0.0, 1.0]), (200, [0.0, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["op5_topk"]).fetchall()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in registry.op5_topk(spark, str(tmp_path)).collect()) == sorted(want)


def test_lanes_out_of_reach_are_not_asked(spark, monkeypatch):
    """Clustered vectors and clashing columns: most lanes are out of a group's reach, and the result is exact."""
    monkeypatch.setattr(topk, "LEAST_LANE", 50)
    rng = np.random.default_rng(4)
    x = np.concatenate([c + rng.normal(size=(60, 4)) * 0.01 for c in rng.normal(size=(12, 4)) * 5])
    df = spark.createDataFrame([(i, r.tolist(), 1, "s", 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, query_id int, score string, rank int")
    w = np.floor(1024 * x).astype(int)
    got = topk.top_k(df, F.col("vec_id") % 100 == 0).collect()
    for q in range(0, len(x), 100):
        best = sorted((-int(s), i) for i, s in enumerate(w @ w[q]) if i != q)[:10]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    queries = topk.CoverTree.build(np.arange(0, 720, 100), w[::100], 4)
    floor = topk._floors(queries, np.arange(720), w, 10)
    trees = [topk.CoverTree.build(np.arange(60), w[60 * k : 60 * k + 60]) for k in range(12)]
    one = topk.CoverTree.build(np.array([0]), w[:1], 4)
    near = topk._reached(one, floor[queries.ids == 0], np.array([t.vectors[t.nodes[0]["centre"]] for t in trees], float), np.array([t.nodes[0]["radius"] for t in trees]))
    assert 0 < len(near) < 12


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (30, 6))
    x = np.concatenate([c + rng.integers(-20, 20, (200, 6)) for c in centres])
    queries, data = topk.CoverTree.build(np.arange(0, 6000, 100), x[::100], 4), topk.CoverTree.build(np.arange(6000), x)
    best = topk.Best(60, 10, np.full(60, -(2**62)))
    compared = topk.search(queries, data, best)
    leaves = [(t.nodes["child"] == t.nodes["last"]).sum() for t in (queries, data)]
    assert compared < leaves[0] * leaves[1]
    for q, rows in zip(queries.ids.tolist(), best.rows):
        s = x @ x[q]
        want = sorted((-int(v), i) for i, v in enumerate(s) if i != q)[:10]
        assert rows == want


def test_tool_calls(spark):
    call = lambda i, name, args: {"id": i, "name": name, "arguments": args}
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "early"})),
        (1, 2, "assistant", json.dumps({"tool_calls": [call("a", "add", {"y": 2, "x": 1}), call("b", "add", {"x": "1", "z": 0}), call("a", "add", {}), call("c", "none", {})]})),
        (1, 3, "tool", json.dumps({"tool_call_id": "zz", "content": "lost"})),
        (1, 4, "assistant", "{not json"),
        (2, 0, None, None),
        (None, None, "user", "x"),
    ]
    df = spark.createDataFrame([(*r, "u") for r in rows], "conv_id long, turn int, role string, text string, kind string")
    tools = chat.Tools({"add": chat.Schema({"x": "integer", "y": "number"}, ("x", "y"))})
    got = chat.format_chats(df, tools, exchanges=False).collect()
    by = {(r["turn"], r["place"]): r for r in got if r["conv_id"] == 1}
    assert [by[2, i]["status"] for i in range(4)] == ["called", "unanswered", "repeated", "unanswered"]
    assert [by[2, i]["problems"] for i in range(4)] == [[], ["type of x", "missing y", "unknown z"], ["missing x", "missing y"], ["unknown tool"]]
    assert by[1, 0]["status"] == "linked" and by[1, 0]["order_turn"] == 2 and by[3, 0]["status"] == "orphan" and by[4, 0]["status"] == "message"
    assert by[2, 0]["json"] == '{"arguments":{"x":1,"y":2},"call_id":"a","conv_id":1,"name":"add","role":"assistant","turn":2}'
    assert len(got) == 10 and all(json.loads(r["json"]) is not None for r in got)
    assert chat.format_chats(df.limit(0)).count() == 0
    assert {r["status"] for r in chat.format_chats(df).where("conv_id = 1").collect()} >= {"unanswered", "called"}


def test_repeated_messages_and_long_texts(spark):
    """Copies of a message give copies of its events; results stand behind their calls in the total order."""
    call = json.dumps({"tool_calls": [{"id": "a", "name": "add", "arguments": {"x": 1}}]})
    rows = [(1, 0, "tool", json.dumps({"tool_call_id": "a", "content": "early"})), (1, 1, "assistant", call), (1, 1, "assistant", call), (2, 0, "user", "long " * 100_000), (2, 1, "assistant", "")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), chat.Tools({"add": chat.Schema({"x": "integer"})}), exchanges=False).collect()
    copies = [r for r in got if r["kind"] == chat.CALL]
    assert len(got) == 5 and len(copies) == 2 and copies[0] == copies[1] and copies[0]["status"] == "called"
    order = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: (r["order_turn"], r["kind"], r["turn"], r["place"]))
    assert [r["kind"] for r in order] == [chat.CALL, chat.CALL, chat.RESULT] and order[-1]["status"] == "linked"
    assert max(len(r["json"]) for r in got) > 500_000


def test_pipeline(spark, small, docs):
    kept, ids = docs, set()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = corpus_pipeline.materialize(stage(spark, kept, small), "test")
        assert kept.columns == docs.columns, name
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        if name in ("toxicity", "simhash_near_dedup"):
            assert 0 < len(ids) < before
        if name == "substring_dedup":
            assert kept.count() == before
    last = corpus_pipeline.STAGES[-1][1](spark, kept, small)
    assert last.count() == kept.count() and last.where("octet_length(ids) <> 4 * n_tokens").count() == 0
    assert corpus_pipeline.run(spark, small).count() == last.count()


@pytest.mark.parametrize("table", ["edge", "empty"])
def test_pipeline_over_odd_rows(spark, small, request, table):
    """Nulls, empty and very long texts, repeated rows, extra columns with clashing names, and an empty table."""
    kept = request.getfixturevalue(table)
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialize(stage(spark, kept, small), "odd")
        assert kept.columns == columns, name
    last = corpus_pipeline.STAGES[-1][1](spark, kept, small).collect()
    ids = [r["doc_id"] for r in last]
    assert len(last) == kept.count() and (table == "empty" or {1, 4, 8} & set(ids)) and not {3, 9} & set(ids)


def test_clashing_columns(spark, edge):
    """Columns of the input with the names that operators add or use inside."""
    rows = edge.select("doc_id", "text", *[F.lit("mine").alias(c) for c in ("ids", "decoded", "toxicity", "n_tokens", "score")]).where("doc_id < 7")
    coded = bpe.round_trip(rows, bpe.Coder(spark, registry.vocabulary(registry.WORD_VOCABULARY))).collect()
    assert len(coded) == 6 and {r["decoded"] for r in coded if r["doc_id"] == 4} == {"word</w>"}
    rated = toxicity.score(rows, toxicity.Model({})).collect()
    assert len(rated) == 6 and all(0 < r["toxicity"]["score"] < 0.5 for r in rated)
    counted = tokencount.count_tokens(rows, registry.vocabulary(registry.PIECE_VOCABULARY)).collect()
    assert len(counted) == 6 and all(isinstance(r["n_tokens"], int) for r in counted)


def test_native_operators_run_no_python(spark, small):
    for name in ("op3_spotsigs", "op7_mixing", "op10_chat"):
        assert "Python" not in registry.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
