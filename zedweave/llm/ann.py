"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zedweave.llm.common import Scratch

#: The tree is fitted on at most SAMPLE vectors (fewer of many components, COMPONENTS in all); every row is indexed.
SAMPLE, COMPONENTS = 65_536, 1 << 23
#: Vectors of a leaf that the tree aims at, its branching, and queries on which the visits are calibrated.
LEAF, BRANCH, CALIBRATE = 256, 8, 256
#: Vectors and queries of a task's cell.
CELL, CELL_QUERIES = 2048, 2048
#: Leaves of more vectors are divided by trees of their own, on executors, each fitted on about PARTLY vectors of the leaf; vectors
#: that are assigned by one task.
WIDE, PARTLY, ASSIGNED = 4 * LEAF, 16_384, 1 << 16


class Tree:
    """Nodes by number, 0 the root: centroids, children (none: a leaf)."""

    def __init__(self, vectors: np.ndarray, leaf: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        centers, self.children = [vectors.mean(axis=0) if len(vectors) else np.zeros(vectors.shape[1])], [[]]
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= leaf:
                continue
            x = vectors[rows]
            label, c = kmeans(x, min(BRANCH, max(2, -(-len(rows) // leaf))), rng)
            if len(c) < 2:
                continue
            for k in range(len(c)):
                self.children[node].append(len(self.children))
                todo.append((len(self.children), rows[label == k]))
                centers.append(c[k])
                self.children.append([])
        self.centers = np.array(centers, dtype=np.float32)
        self.leaves = [i for i, c in enumerate(self.children) if not c]

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector descends to, nearest child by nearest child."""
        at = np.zeros(len(vectors), dtype=np.int32)
        while True:
            moved = False
            for node in np.unique(at).tolist():
                if kids := self.children[node]:
                    rows = np.flatnonzero(at == node)
                    at[rows] = np.array(kids)[nearest(vectors[rows], self.centers[kids])]
                    moved = True
            if not moved:
                return at

    def visits(self, distances: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves of a query, best bin first; distances: to all nodes' centroids."""
        d, queue, out = distances.tolist(), [(0.0, 0)], []
        while queue and len(out) < most:
            node = heapq.heappop(queue)[1]
            while kids := self.children[node]:  # down to a leaf, the other branches wait
                best = min(kids, key=d.__getitem__)
                for k in kids:
                    if k != best:
                        heapq.heappush(queue, (d[k], k))
                node = best
            out.append(node)
        return out

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        return 1 + (self.centers**2).sum(axis=1) - 2 * vectors.astype(np.float32) @ self.centers.T


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - (c * c).sum(axis=1) / 2, axis=1)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centroids; centroids without members are dropped."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        label = nearest(x, c)
        used = np.unique(label)
        new = np.stack([x[label == i].mean(axis=0) for i in used])
        if len(used) == len(c) and np.allclose(new, c):
            break
        c = new
    label = nearest(x, c)
    used, label = np.unique(label, return_inverse=True)
    return label, c[used]


def matrix(column) -> np.ndarray:
    """A list column without nulls, all of one length, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no under- or overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the same for the same two vectors wherever they stand. Powers of two scale exactly, so that squares of
    very small or large components neither vanish nor overflow."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def best_of(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of q, row of x, cosine) of each q's k nearest x and of those that tie with the last."""
    near = unit(q) @ unit(x).T
    k = min(k, near.shape[1])
    last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
    i, j = np.nonzero(near >= last[:, None] - 1e-9)
    return i, j, cosines(q[i], x[j])


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components known and finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    return vector.isNotNull() & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(wide, lambda x: x != 0)


def _leaves(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            leaf = tree.leaf_of(unit(matrix(b.column(2))))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *b.columns], ["leaf", "vid", "ids", "v"])


def bundles(held_by: dict[int, int]) -> dict[int, int]:
    """A number for each leaf: leaves that follow one another in the tree share one while they hold CELL vectors together."""
    out, bundle, held = {}, 0, 0
    for leaf in sorted(held_by):
        if held and held + held_by[leaf] > CELL:
            bundle, held = bundle + 1, 0
        held += held_by[leaf]
        out[leaf] = bundle
    return out


def _visits(batches: Iterator[pa.RecordBatch], tree: Tree, most: int, bundle_of: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """A row for each query and bundle that it visits, with the leaves that it visits there; and one, of bundle -1, with those that
    are divided."""
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            rows, numbers, leaves = [], [], []
            for i, d in enumerate(tree.distances(unit(matrix(part.column(1))))):
                by: dict[int, list[int]] = {}
                for leaf in tree.visits(d, most):
                    if leaf in bundle_of:
                        by.setdefault(bundle_of[leaf], []).append(leaf)
                rows += [i] * len(by)
                numbers += by
                leaves += by.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), part.column(0).take(at), part.column(1).take(at), pa.array(leaves, pa.list_(pa.int64()))], ["bundle", "qid", "q", "leaves"])


def _divided(group: pa.Table, aim: int) -> pa.Table:
    """The leaves of a tree of a leaf's own: leaf, sub (neighbours follow one another), c (the centroid)."""
    x, m = unit(matrix(group["v"])), group["m"][0].as_py()
    tree = Tree(x, max(8, int(aim * len(x) / m)))
    c = tree.centers[tree.leaves]
    return pa.table({"leaf": pa.array([group["leaf"][0].as_py()] * len(c), pa.int32()), "sub": pa.array(range(len(c)), pa.int32()), "c": pa.array(list(c), pa.list_(pa.float32()))})


def _assigned(rows: pa.Table, subs: pa.Table) -> pa.Table:
    """The vectors of a leaf with the sub-leaf of the nearest centroid."""
    subs = subs.sort_by("sub")
    c = matrix(subs["c"]) if subs.num_rows else np.zeros((1, 1))
    at = [nearest(unit(matrix(rows["v"].slice(k, CELL))), c) for k in range(0, rows.num_rows, CELL)]
    return pa.table({"leaf": rows["leaf"], "sub": pa.array(np.concatenate(at) if at else [], pa.int32()), "vid": rows["vid"], "ids": rows["ids"], "v": rows["v"]})


def _near(q: np.ndarray, subs: pa.Table, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, sub, distance) of the `most` sub-leaves nearest to each q."""
    c = matrix(subs["c"])
    d = 1 + (c * c).sum(axis=1) - 2 * unit(q) @ c.T
    most = min(most, len(c))
    at = np.argpartition(d, most - 1, axis=1)[:, :most]
    i = np.repeat(np.arange(len(q)), most)
    return i, subs["sub"].to_numpy()[at.ravel()], d[i, at.ravel()]


def _routed(queries: pa.Table, subs: pa.Table, most: int) -> pa.Table:
    """leaf, qid, sub, d: the `most` sub-leaves of a leaf that are nearest to each query."""
    if not queries.num_rows or not subs.num_rows:
        return pa.schema([("leaf", pa.int32()), ("qid", pa.int64()), ("sub", pa.int32()), ("d", pa.float64())]).empty_table()
    i, sub, d = _near(matrix(queries["q"]), subs, most)
    return pa.table({"leaf": pa.array(np.full(len(i), subs["leaf"][0].as_py()), pa.int32()), "qid": queries["qid"].combine_chunks().take(pa.array(i)), "sub": pa.array(sub, pa.int32()), "d": pa.array(d)})


def _cell(x: pa.Table, q: pa.Table, k: int) -> pa.Table:
    """The k best vectors of each query among the cell's vectors in leaves that it visits; ties go to the smallest id."""
    names = pa.schema([("qid", pa.int64()), ("vid", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
    if not x.num_rows or not q.num_rows:
        return names.empty_table()
    vectors, queries = matrix(x["v"]), matrix(q["q"])
    leaf, asked = x["code"].to_numpy(), q["leaves"].combine_chunks()
    wanted, of = asked.flatten().to_numpy(), np.repeat(np.arange(q.num_rows), np.diff(asked.offsets.to_numpy()))
    found = []
    for one in np.unique(leaf).tolist():
        at, by = np.flatnonzero(leaf == one), of[wanted == one]
        if len(by):
            i, j, score = best_of(queries[by], vectors[at], k)
            found.append((by[i], at[j], score))
    if not found:
        return names.empty_table()
    i, j, score = (np.concatenate(c) for c in zip(*found))
    ids = x["ids"].combine_chunks()
    least = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
    order = np.lexsort((least[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
    i, j, score = (c[rank < k] for c in (i, j, score))
    return pa.Table.from_arrays([q["qid"].combine_chunks().take(pa.array(i)), x["vid"].combine_chunks().take(pa.array(j)), ids.take(pa.array(j)), pa.array(score)], schema=names)


def _brute(batches: Iterator[pa.RecordBatch], queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, 8192):
            part = b.slice(s, 8192)
            i, j, score = best_of(queries, matrix(part.column(2)), k)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), part.column(0).take(pa.array(j)), part.column(1).take(pa.array(j)), pa.array(score)], ["q", "leaf", "sub", "score"])


def quantile(ranks: list[int], share: float) -> int:
    """The smallest rank that at least this share doesn't exceed."""
    return sorted(ranks)[min(len(ranks) - 1, int(np.ceil(share * len(ranks))) - 1)]


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """vid, ids (the `keep` smallest, for no other can be among the nearest), v: one row for each vector."""
    rows = rows.groupBy("v", "id").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= keep)
    return rows.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.monotonically_increasing_id().alias("vid"), "ids", "v")


def divided(index: DataFrame, wide: dict[int, int], v_type: str, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """The index with a column sub, 0 for leaves that aren't wide; and the sub-leaves of the others (leaf, sub, c), saved.

    wide: the rows of each wide leaf. Its tree is fitted on about PARTLY of its vectors in one task; its vectors are dealt over
    tasks of about ASSIGNED.
    """
    if not wide:
        return index.withColumn("sub", F.lit(0)), None
    of = index.sparkSession.createDataFrame([(leaf, m, -(-m // PARTLY), -(-m // ASSIGNED)) for leaf, m in wide.items()], "l int, m long, one int, parts int")
    own = index.join(F.broadcast(of), F.col("leaf") == F.col("l"), "left")
    some = own.where(F.col("l").isNotNull() & (F.pmod(F.xxhash64("vid"), F.col("one")) == 0)).select("leaf", "m", "v")
    aim = LEAF
    subs = scratch.save(some.groupBy("leaf").applyInArrow(lambda g: _divided(g, aim), "leaf int, sub int, c array<float>"))
    rows = own.where(F.col("l").isNotNull()).withColumn("y", F.pmod(F.xxhash64("vid", F.lit(1)), F.col("parts"))).select("leaf", "y", "vid", "ids", "v")
    lots = subs.join(F.broadcast(of), F.col("leaf") == F.col("l")).select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("y"), "sub", "c")
    deep = rows.groupBy("leaf", "y").cogroup(lots.groupBy("leaf", "y")).applyInArrow(_assigned, f"leaf int, sub int, vid long, ids array<long>, v {v_type}")
    flat = own.where(F.col("l").isNull()).select("leaf", F.lit(0).alias("sub"), "vid", "ids", "v")
    return scratch.save(flat.unionByName(deep)), subs


def calibrated(queries: np.ndarray, found: list, order: list[dict[int, int]], most: int, subs: DataFrame | None, share: float) -> int | None:
    """How many sub-leaves, of all divided leaves among its first `most`, a query visits so that this share of the true neighbours in
    them is met. Distances to all sub-leaves are ranked by query on executors."""
    found = [r for r in found if order[r["q"]][r["leaf"]] < most]
    if subs is None or not found:
        return None
    visited = [{leaf for leaf, i in o.items() if i < most} for o in order]

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = unit(queries)
        for b in batches:
            c = matrix(b.column(2))
            d = 1 + (c * c).sum(axis=1)[:, None] - 2 * c @ u.T
            i, q = np.nonzero([[leaf in own for own in visited] for leaf in b.column(0).to_pylist()])
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), b.column(0).take(at), b.column(1).take(at), pa.array(d[i, q])], ["q", "leaf", "sub", "d"])

    ranks = subs.select("leaf", "sub", "c").mapInArrow(ranked, "q int, leaf int, sub int, d double").withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "leaf", "sub")))
    wanted = subs.sparkSession.createDataFrame(sorted({(r["q"], r["leaf"], r["sub"]) for r in found}), "_q int, _l int, _s int")
    near = ranks.join(F.broadcast(wanted), (F.col("q") == F.col("_q")) & (F.col("leaf") == F.col("_l")) & (F.col("sub") == F.col("_s")))
    rank = {(r["q"], r["leaf"], r["sub"]): r["r"] for r in near.collect()}  # at most CALIBRATE * k
    return quantile([rank[r["q"], r["leaf"], r["sub"]] for r in found], share)


def nearest_neighbours(table: DataFrame, is_query: Column, k: int = 5, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of largest cosine that the search finds for each query row, its own id left out.

    Returns query_id, rank (from 1), vec_id, score (the cosine in double precision); ties go to the smaller id.
    The tree is fitted on a bounded sample (SAMPLE); every row is indexed. Leaves that hold more than WIDE vectors are divided
    by trees of their own, so that leaves stay small however many rows there are. A query visits the leaves of a priority queue
    in order of their centroids' nearness; their number is widened until, for CALIBRATE queries against all rows, the
    share of true neighbours whose leaf is visited reaches `recall`. Of divided leaves the sub-leaves are ordered likewise, and their
    number is calibrated too.
    Leaves are searched by bundles of neighbouring ones, and each task returns a query's best of its bundle only.
    Equal vectors are searched once, with the ids that can count. Rows with a null id or a vector that is null, zero,
    or holds null or non-finite components take no part, nor do vectors of another length than the
    most frequent one (ties: the shortest). Repeated rows (id and vector) count once; a repeated id with different
    vectors is as many candidates, and as a query gives one list per vector. Without rows the result is empty.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "ann")
    v = F.col(vector_col)
    rows = table.where(F.col(id_col).isNotNull() & usable(v)).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), is_query.alias("is_query"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else 1
    rows = rows.where(F.size("v") == dim)
    vectors = scratch.save(distinct_vectors(rows, k + 1))
    asked = scratch.save(rows.where("is_query").select(F.col("id").alias("query_id"), "v").distinct())
    queries = scratch.save(asked.groupBy("v").agg(F.count(F.lit(1)).alias("n")).select(F.monotonically_increasing_id().alias("qid"), F.col("v").alias("q")))
    n = vectors.count()
    few = lambda df, c, m: unit(matrix(df.select(c).orderBy(F.xxhash64(c)).limit(m).toArrow()[c])) if n else np.zeros((0, dim))
    sample = few(vectors, "v", min(SAMPLE, max(1024, COMPONENTS // dim)))
    tree = Tree(sample, max(32, int(LEAF * len(sample) / max(n, 1))))
    v_type = dict(vectors.dtypes)["v"]
    count = lambda df, c: {r[c]: r["n"] for r in df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).collect()}  # noqa: E731  a row for each leaf
    index = scratch.save(vectors.mapInArrow(lambda b: _leaves(b, tree), f"leaf int, vid long, ids array<long>, v {v_type}"))
    held_by = count(index, "leaf")
    wide = {leaf: m for leaf, m in held_by.items() if m > WIDE}
    index, subs = divided(index, wide, v_type, scratch)
    held = queries.select("q").orderBy(F.xxhash64("q")).limit(CALIBRATE).toArrow()["q"]
    most, deep = len(tree.leaves), None
    if len(held):
        calibrate = matrix(held)
        found = index.select("leaf", "sub", "v").mapInArrow(lambda b: _brute(b, calibrate, k + 1), "q int, leaf int, sub int, score double")
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") <= k + 1).collect()  # CALIBRATE * (k + 1)
        order = [{leaf: i for i, leaf in enumerate(tree.visits(d, most))} for d in tree.distances(unit(calibrate))]
        # the query's own vector, found first, doesn't tell anything
        found = [r for r in found if r["r"] > 1]
        if found:
            most = 1 + quantile([order[r["q"]][r["leaf"]] for r in found], recall if not wide else (1 + recall) / 2)
            deep = calibrated(calibrate, [r for r in found if r["leaf"] in wide], order, most, subs, 1 - (1 - recall) / 2)
    bundle_of = bundles({leaf: m for leaf, m in held_by.items() if leaf not in wide})
    first, per = 1 + max(bundle_of.values(), default=-1), {}
    if wide:
        n_subs = count(subs, "leaf")  # a row for each divided leaf
        for leaf in sorted(wide):
            per[leaf] = (first, max(1, CELL * n_subs[leaf] // wide[leaf]))
            first += -(-n_subs[leaf] // per[leaf][1])
    narrow = spark.createDataFrame([(leaf, b, 1) for leaf, b in bundle_of.items()] + [(leaf, *x) for leaf, x in per.items()], "l int, base long, per int")
    bundle = F.col("base") + F.floor(F.col("sub") / F.col("per"))
    code = F.shiftleft(F.col("leaf").cast("long"), 32) + F.col("sub")
    index = index.join(F.broadcast(narrow), F.col("leaf") == F.col("l")).select(bundle.alias("b"), code.alias("code"), "vid", "ids", "v")
    q_type = dict(queries.dtypes)["q"]
    asks = lambda df, of: df.mapInArrow(lambda b: _visits(b, tree, most, of), f"bundle long, qid long, q {q_type}, leaves array<long>")
    visits = asks(queries, bundle_of).withColumn("leaves", F.transform("leaves", lambda x: F.shiftleft(x, 32)))
    if wide:
        lots = -(-queries.count() // CELL_QUERIES) or 1
        # to each divided leaf its queries, in lots; the nearest sub-leaves of all leaves that a query visits count together
        there = asks(queries, dict.fromkeys(wide, -1)).select("qid", "q", F.explode(F.col("leaves").cast("array<int>")).alias("leaf")).withColumn("y", F.pmod(F.xxhash64("qid"), F.lit(lots)))
        there_too = subs.select("leaf", "sub", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long"))).alias("y"))
        routed = there.groupBy("leaf", "y").cogroup(there_too.groupBy("leaf", "y")).applyInArrow(lambda a, b: _routed(a, b, deep or b.num_rows), "leaf int, qid long, sub int, d double")
        if deep:
            nearest_first = Window.partitionBy("qid").orderBy("d", "leaf", "sub")
            routed = routed.withColumn("r", F.row_number().over(nearest_first)).where(F.col("r") <= deep)
        routed = routed.join(F.broadcast(narrow), F.col("leaf") == F.col("l")).groupBy(bundle.alias("bundle"), F.col("qid").alias("_q")).agg(F.collect_list(code).alias("leaves"))
        visits = visits.unionByName(routed.join(queries, F.col("_q") == F.col("qid")).select("bundle", "qid", "q", "leaves"))
    visits = scratch.save(visits)
    sizes = index.groupBy("b").agg(F.count(F.lit(1)).alias("xs")).select(F.col("b").alias("c"), F.ceil(F.col("xs") / CELL).cast("int").alias("xs"))
    asked_of = visits.groupBy("bundle").agg(F.count(F.lit(1)).alias("qs")).select(F.col("bundle").alias("c2"), F.ceil(F.col("qs") / CELL_QUERIES).cast("int").alias("qs"))
    sizes = scratch.save(sizes.join(asked_of, F.col("c") == F.col("c2")).select("c", "xs", "qs"))
    index = index.join(sizes, F.col("b") == F.col("c")).withColumn("x", F.pmod(F.xxhash64("vid"), F.col("xs")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    visits = visits.join(sizes, F.col("bundle") == F.col("c")).withColumn("y", F.pmod(F.xxhash64("qid"), F.col("qs")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)))
    cells = index.select("b", "x", "y", "code", "vid", "ids", "v").groupBy("b", "x", "y").cogroup(visits.select("c", "x", "y", "qid", "q", "leaves").groupBy("c", "x", "y"))
    found = cells.applyInArrow(lambda a, b: _cell(a, b, k + 1), "qid long, vid long, ids array<long>, score double")
    found = found.select("qid", F.explode("ids").alias("vec_id"), "score")
    by_query = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    found = scratch.save(found.withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= k + 1).drop("r"))
    named = scratch.save(asked.join(queries, F.col("v") == F.col("q")).select("query_id", "qid"))
    out = named.withColumnRenamed("qid", "_q").join(found, F.col("_q") == F.col("qid")).where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "qid").orderBy(F.desc("score"), "vec_id")))
    return out.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
