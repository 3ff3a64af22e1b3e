"""Exact top-k by inner product: a dual-tree search over cover trees.

Vectors are dealt into lanes by their nearest pivot (of a bounded sample), in
as many lanes a pivot as their number asks for, and every lane is indexed by a
cover tree; queries are dealt into groups of bounded size, each with a tree of
its own.  A group meets a lane only if the lane's root, its centre and
covering radius, lets one of the group's queries reach its kth score so far.
Within a meeting both trees are descended together: a pair of nodes is dropped
when the largest inner product that their centres and covering radii allow is
below the worst kth score of the node's queries.  The kth scores start from
the sample, so they prune from the first pair on.  All products are whole
numbers.  Where vectors have no clusters (random directions), no bound can
drop a pair and every query meets every vector, in blocks.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import materialize

SCALE = 1024
#: Vectors of a lane, queries of a group, vectors and queries of a leaf, children of a node, vectors of the sample, pivots.
LANE, GROUP, LEAF, QUERY_LEAF, FANOUT, SAMPLE, PIVOTS = 32_768, 1_024, 256, 16, 12, 1_024, 64
#: Least vectors of a lane (fewer lanes than cores are no use), bytes of a lane or group at most, groups that meet a lane in one task.
LEAST_LANE, LANE_BYTES, MEETINGS = 2_048, 1 << 25, 16
#: Roots of lanes are sent to all tasks up to this number; beyond it every group meets every lane.
MOST_ROOTS = 50_000
TREE = "ids binary, vectors binary, width int, nodes binary"


def whole(embedding: Column) -> Column:
    """floor(1024 x) of every component; null where the vector or a component is null or not finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(embedding.isNotNull() & finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE)))


class CoverTree:
    """A cover tree over rows of a matrix; nodes are runs of rows.

    Node: first row, end row, row of the centre, covering radius, first
    child, end of children (equal where there are none).
    """

    KIND = [("first", "<i4"), ("end", "<i4"), ("centre", "<i4"), ("radius", "<f8"), ("child", "<i4"), ("last", "<i4")]

    def __init__(self, ids, vectors, nodes):
        self.ids, self.vectors, self.nodes = ids, vectors, nodes

    @classmethod
    def build(cls, ids, vectors, leaf: int = LEAF):
        import numpy as np

        x = vectors.astype(np.float64)
        order, nodes = np.arange(len(x)), [(0, len(x), 0, 0.0, 0, 0)]
        at = 0
        while at < len(nodes):  # breadth first, so that a node's children stand together
            first, end = nodes[at][:2]
            rows = order[first:end]
            centre = int(np.argmin(((x[rows] - x[rows].mean(0)) ** 2).sum(1))) if len(rows) else 0
            away = np.sqrt(((x[rows] - x[rows[centre]]) ** 2).sum(1)) if len(rows) else np.zeros(0)
            radius, child, last = float(away.max(initial=0.0)), 0, 0
            if len(rows) > leaf and radius > 0:
                # a net of the node: the farthest row becomes a centre until all are within half the radius
                near, which, k = away.copy(), np.zeros(len(rows), np.int64), 1
                while near.max() > radius / 2 and k < FANOUT:
                    d = np.sqrt(((x[rows] - x[rows[int(near.argmax())]]) ** 2).sum(1))
                    which[d < near], near = k, np.minimum(d, near)
                    k += 1
                sort = np.argsort(which, kind="stable")
                order[first:end] = rows[sort]
                centre = int(np.flatnonzero(sort == centre)[0])
                cuts = [first, *(first + np.flatnonzero(np.diff(which[sort])) + 1).tolist(), end]
                child, last = len(nodes), len(nodes) + len(cuts) - 1
                nodes += [(a, b, a, 0.0, 0, 0) for a, b in zip(cuts, cuts[1:])]
            nodes[at] = (first, end, first + centre, radius, child, last)
            at += 1
        return cls(ids[order], vectors[order], np.array(nodes, dtype=cls.KIND))._recentre()

    def _recentre(self):
        """Centres and radii of the rows in their final order."""
        import numpy as np

        x = self.vectors.astype(np.float64)
        for n in self.nodes:
            rows = x[n["first"] : n["end"]]
            if len(rows):
                c = int(np.argmin(((rows - rows.mean(0)) ** 2).sum(1)))
                n["centre"], n["radius"] = n["first"] + c, math.sqrt(float(((rows - rows[c]) ** 2).sum(1).max()))
        return self

    def pack(self) -> dict:
        return {"ids": self.ids.astype("<i8").tobytes(), "vectors": self.vectors.astype("<i8").tobytes(), "width": self.vectors.shape[1], "nodes": self.nodes.tobytes()}

    @classmethod
    def unpack(cls, ids: bytes, vectors: bytes, width: int, nodes: bytes):
        import numpy as np

        return cls(np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<i8").reshape(-1, width) if width else np.zeros((len(ids) // 8, 0), np.int64), np.frombuffer(nodes, cls.KIND))


def products(a, b):
    """Exact inner products of two whole-number matrices; the shorter width is filled up with zeros."""
    import numpy as np

    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(w, 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if most < 2**62 else (a.astype(object) @ b.astype(object).T).clip(-(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best (score, id) of every query: higher scores first, ties to the smaller id."""

    def __init__(self, n: int, k: int, floor):
        import numpy as np

        self.k = k
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.least = floor.astype(np.int64)  # no score below this can be among the k best

    def meet(self, q: int, scores, ids) -> None:
        hits = scores >= self.least[q]
        if not hits.any():
            return
        rows = self.rows[q] + list(zip((-scores[hits]).tolist(), ids[hits].tolist()))
        rows.sort()
        self.rows[q] = rows[: self.k]
        if len(rows) >= self.k:
            self.least[q] = max(self.least[q], -self.rows[q][-1][0])


def search(queries: CoverTree, data: CoverTree, best: Best) -> int:
    """Descend both trees together; returns the number of leaf pairs compared."""
    import numpy as np

    def norms(t):
        return np.sqrt((t.vectors[t.nodes["centre"]].astype(np.float64) ** 2).sum(1)) if len(t.ids) else np.zeros(len(t.nodes))

    if not len(queries.ids) or not len(data.ids):
        return 0
    nq, nd = norms(queries), norms(data)
    centres = products(queries.vectors[queries.nodes["centre"]], data.vectors[data.nodes["centre"]]).astype(np.float64)
    rq, rd = queries.nodes["radius"], data.nodes["radius"]
    bound = centres + np.outer(rq, nd) + np.outer(nq, rd) + np.outer(rq, rd)
    bound = np.ceil(bound * (1 + 1e-12 * np.sign(bound)) + 1e-6)
    compared, stack = 0, [(0, 0)]
    while stack:
        a, b = stack.pop()
        qa, da = queries.nodes[a], data.nodes[b]
        if bound[a, b] < best.least[qa["first"] : qa["end"]].min():
            continue
        split_q, split_d = qa["child"] < qa["last"], da["child"] < da["last"]
        if split_d and (not split_q or rd[b] >= rq[a]):
            below = [(a, c) for c in range(da["child"], da["last"])]
        elif split_q:
            below = [(c, b) for c in range(qa["child"], qa["last"])]
        else:
            compared += 1
            own, ids = queries.ids[qa["first"] : qa["end"]], data.ids[da["first"] : da["end"]]
            s = products(queries.vectors[qa["first"] : qa["end"]], data.vectors[da["first"] : da["end"]])
            s[own[:, None] == ids[None, :]] = np.iinfo(np.int64).min
            for i in np.flatnonzero(s.max(1) >= best.least[qa["first"] : qa["end"]]).tolist():
                keep = s[i] > np.iinfo(np.int64).min
                best.meet(qa["first"] + i, s[i][keep], ids[keep])
            continue
        stack += sorted(below, key=lambda p: bound[p])  # the most promising is taken first
    return compared


def _matrix(rows: pa.Array):
    """The vectors of a list array as rows, shorter ones filled up with zeros."""
    import numpy as np

    lengths = rows.value_lengths().to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _pivots(vectors, most: int):
    """Rows far from each other: the first, then always the one farthest from those chosen; in an order that puts near ones side by side."""
    import numpy as np

    x, chosen = vectors.astype(np.float64), [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    p = x[chosen]
    order, left = [0], set(range(1, len(p)))
    while left:
        order.append(min(left, key=lambda i: float(((p[i] - p[order[-1]]) ** 2).sum())))
        left.remove(order[-1])
    return p[order]


def _nearest(shared, vector: str):
    """Number of the pivot nearest to a vector."""

    @arrow_udf("int")
    def of(rows: pa.Array) -> pa.Array:
        import numpy as np

        x, p = _matrix(rows).astype(np.float64), shared.value
        w = max(x.shape[1], p.shape[1])
        x, p = (np.pad(m, ((0, 0), (0, w - m.shape[1]))) for m in (x, p))
        return pa.array(((p**2).sum(1) - 2 * (x @ p.T)).argmin(1).astype(np.int32))

    return of(vector)


def _trees(vectors: DataFrame, most: int, name: str, leaf: int, spark: SparkSession) -> DataFrame:
    """One tree for about ``most`` vectors: of a pivot, of a part of one, or of some that follow each other."""
    counts = {r["pivot"]: r["count"] for r in vectors.groupBy("pivot").count().collect()}  # a row a pivot
    offsets, at, free = {}, 0, 0
    for p, c in sorted(counts.items()):
        if c <= free:
            offsets[p], free = (at - 1, 1), free - c
        else:
            parts = math.ceil(c / most)
            offsets[p], at, free = (at, parts), at + parts, most - c

    def build(table: pa.Table) -> pa.Table:
        import numpy as np

        ids = table.column("vec_id").to_numpy().astype(np.int64)
        tree = CoverTree.build(ids, _matrix(table.column("v").combine_chunks()), leaf).pack()
        return pa.Table.from_pylist([{name: table.column(name)[0].as_py(), **tree}], pa.schema([(name, pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("width", pa.int32()), ("nodes", pa.binary())]))

    place = spark.createDataFrame([(p, o, n) for p, (o, n) in offsets.items()], "pivot int, _offset int, _parts int")
    dealt = vectors.join(F.broadcast(place), "pivot").withColumn(name, (F.col("_offset") + F.pmod(F.xxhash64("vec_id", "v"), F.col("_parts"))).cast("int"))
    return dealt.select(name, "vec_id", "v").groupBy(name).applyInArrow(build, f"{name} int, {TREE}")


def _floors(queries: CoverTree, ids, rows, k: int):
    """A score that the kth best of every query reaches: the kth best of the sample."""
    import numpy as np

    least = np.iinfo(np.int64).min + 1
    if len(ids) <= k:
        return np.full(len(queries.ids), least, np.int64)
    s = products(queries.vectors, rows)
    s[queries.ids[:, None] == ids[None, :]] = least
    return np.partition(s, -k, axis=1)[:, -k]


def _reached(queries: CoverTree, floor, centres, radii):
    """Lanes whose root lets some query reach its floor."""
    import numpy as np

    x = queries.vectors.astype(np.float64)
    w = min(x.shape[1], centres.shape[1])
    bound = x[:, :w] @ centres[:, :w].T + np.outer(np.sqrt((x**2).sum(1)), radii)
    return np.flatnonzero((bound + 1e-9 * np.abs(bound) + 1 >= floor[:, None]).any(0))


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query among all vectors of other ids.

    Ties go to the smaller id.  Vectors that are null or hold a null or
    non-finite component, and rows with a null id, take no part.  Rows that
    share an id are all candidates of the other ids, and as queries share one
    list.  Vectors of different widths are compared as if filled up with
    zeros.  No queries: an empty result.  Other columns are not looked at.
    """
    import numpy as np

    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vector)).alias("v"), is_query.alias("q")).where("vec_id is not null and v is not null")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    most = max(1, min(LANE, LANE_BYTES // (8 * max(1, width)), max(LEAST_LANE, n // (2 * spark.sparkContext.defaultParallelism))))
    # about SAMPLE vectors, chosen by a hash of their ids: a start for the kth scores
    some = rows.where(F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(max(1, math.ceil(n / SAMPLE)))) == 0).select("vec_id", "v").limit(4 * SAMPLE)
    known = sorted((r["vec_id"], r["v"]) for r in some.collect()) or [(0, [])]
    ids, known = np.array([i for i, _ in known], np.int64), _matrix(pa.array([v for _, v in known], pa.list_(pa.int64())))
    if not n:
        ids, known = ids[:0], known[:0]
    sample = spark.sparkContext.broadcast((ids, known))
    pivots = spark.sparkContext.broadcast(_pivots(known, PIVOTS) if n and len(known) else np.zeros((1, 1)))
    vectors = rows.withColumn("pivot", _nearest(pivots, "v"))
    data = materialize(_trees(vectors.select("vec_id", "v", "pivot"), most, "lane", LEAF, spark), "lanes")
    groups = _trees(vectors.where("q").select("vec_id", "v", "pivot"), min(GROUP, most), "grp", QUERY_LEAF, spark)
    lanes = data.count()
    roots = None
    if lanes <= MOST_ROOTS:
        found = [(r["lane"], CoverTree.unpack(b"", bytes(r["v"]), r["width"], bytes(r["nodes"]))) for r in _root_rows(data).collect()]
        size = max((t.vectors.shape[1] for _, t in found), default=0)
        centres = np.array([np.pad(t.vectors[0].astype(np.float64), (0, size - t.vectors.shape[1])) for _, t in found]).reshape(len(found), size)
        roots = spark.sparkContext.broadcast((np.array([lane for lane, _ in found], np.int32), centres, np.array([t.nodes[0]["radius"] for _, t in found])))
    every = list(range(lanes)) if roots is None else []

    def ask(batches):
        for batch in batches:
            for r in batch.to_pylist():
                queries = CoverTree.unpack(r["ids"], r["vectors"], r["width"], r["nodes"])
                floor = _floors(queries, *sample.value, k)
                asked = every if roots is None else roots.value[0][_reached(queries, floor, *roots.value[1:])].tolist()
                yield pa.RecordBatch.from_pylist([{**{"q_" + c: r[c] for c in ("ids", "vectors", "width", "nodes")}, "block": r["grp"] // MEETINGS, "lanes": asked}], _ASKED)

    asked = groups.mapInArrow(ask, "q_ids binary, q_vectors binary, q_width int, q_nodes binary, block int, lanes array<int>")
    asked = asked.select("q_ids", "q_vectors", "q_width", "q_nodes", "block", F.explode("lanes").alias("lane"))
    last = groups.agg(F.coalesce(F.max("grp"), F.lit(0))).first()[0] // MEETINGS
    salted = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last))))

    def meet(batches):
        for batch in batches:
            for r in batch.to_pylist():
                queries = CoverTree.unpack(r["q_ids"], r["q_vectors"], r["q_width"], r["q_nodes"])
                tree = CoverTree.unpack(r["ids"], r["vectors"], r["width"], r["nodes"])
                best = Best(len(queries.ids), k, _floors(queries, *sample.value, k))
                search(queries, tree, best)
                found = [(q, i, -s) for q, rows_ in zip(queries.ids.tolist(), best.rows) for s, i in rows_]
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    found = salted.join(asked, ["lane", "block"]).mapInArrow(meet, "query_id long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_ASKED = pa.schema([("q_ids", pa.binary()), ("q_vectors", pa.binary()), ("q_width", pa.int32()), ("q_nodes", pa.binary()), ("block", pa.int32()), ("lanes", pa.list_(pa.int32()))])


def _root_rows(data: DataFrame) -> DataFrame:
    """(lane, width, v, nodes): the first node of every tree and its centre."""

    def of(batches):
        for batch in batches:
            for r in batch.to_pylist():
                t = CoverTree.unpack(r["ids"], r["vectors"], r["width"], r["nodes"])
                yield pa.RecordBatch.from_pylist([{"lane": r["lane"], "width": r["width"], "v": t.vectors[t.nodes[0]["centre"]].tobytes(), "nodes": t.nodes[:1].tobytes()}], pa.schema([("lane", pa.int32()), ("width", pa.int32()), ("v", pa.binary()), ("nodes", pa.binary())]))

    return data.mapInArrow(of, "lane int, width int, v binary, nodes binary")
