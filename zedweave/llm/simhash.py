"""SimHash near-duplicates: a self-join of binary tries of fingerprints, and their components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zedweave.llm import trie
from zedweave.llm.common import Scratch, boxed, field, freed, marked, unboxed
from zedweave.llm.tokens import texts

#: Expected fingerprints of a key; more keys of more bits are taken as fingerprints grow in number.
PER_KEY = 256
#: Keys with more fingerprints than this are cut into slices, and each pair of slices is a task's.
HOT = 16_384
#: Fingerprints of a task of the self-join.
PER_TASK = 100_000

#: near_copies: shingles of WORDS words; SIMILAR / 100 of two texts' distinct shingles in common; 64-bit lanes of a fingerprint.
WORDS, SIMILAR, LANES = 5, 80, 4
#: Expected standard deviations of the differing bits above their mean at that similarity that the budget allows, the share of such
#: pairs that may agree in no key, fingerprints of such a key, and its fewest bits.
DEVIATIONS, MISSED, RARE, BITS = 3, 0.01, 128, 12
#: Keys of the first round, whose links the others needn't find again.
FIRST = 3
#: Shingles of a slice of texts that are compared together.
SLICE = 1 << 18


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint: a bit is 1 if set in over half the shingles' XXH64."""
    w = text.encode().lower().split()  # both know ASCII only
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    hashed = b"".join([xxhash.xxh64_digest(x, seed) for x in shingles])
    bits = np.frombuffer(hashed, dtype=np.uint8).reshape(n, 8)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 15):
        counts += np.unpackbits(bits[k : k + (1 << 15)], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.fromiter((fingerprint(t, words) for _, t in texts([batch])), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])


def _cells(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray] | None:
    """A task's rows (k, key, cell, fingerprint lanes f0 ..., others), sorted by group and fingerprint; their groups and lanes."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return None
    table = pa.Table.from_batches(parts)
    fps = np.stack([table[c].to_numpy().view(np.uint64) for c in table.column_names if c[0] == "f"], axis=1)
    by = [table[c].to_numpy() for c in ("k", "key", "cell")]
    order = np.lexsort((*fps.T[::-1], *by[::-1]))
    by = [x[order] for x in by]
    group = np.cumsum(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in by])])
    return table.take(pa.array(order)), group, fps[order]


def _links(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """(fp, root of its component in this task) of all rows that aren't their own root."""
    if (own := _cells(batches)) is None:
        return
    _, group, fps = own
    root = trie.forest(group, fps, budget)[0]
    at = np.flatnonzero(root != np.arange(len(root)))
    if at.size:
        pairs = np.unique(np.stack([fps[at, 0].view(np.int64), fps[root[at], 0].view(np.int64)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])


def masks(n: int, budget: int) -> list[int]:
    """Bits of which any two fingerprints within the budget agree in one mask at least.

    64 bits are cut into budget + t blocks; `budget` differing bits leave t blocks alike, so each choice of t
    blocks is a key. t is the smallest that makes keys rare enough for n fingerprints.
    """
    t = 1
    while n / 2 ** (64 * t / (budget + t)) > PER_KEY and t < 4:
        t += 1
    edges = [round(64 * i / (budget + t)) for i in range(budget + t + 1)]
    blocks = [sum(1 << b for b in range(x, y)) for x, y in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, t)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def dealt(keyed: DataFrame, member: str, n: int, scratch: Scratch) -> DataFrame:
    """keyed (k, key, member, others; n rows), dealt over tasks so that any two rows of a key meet in one of them.

    The members of a hot key are cut into slices by hash and each pair of slices is a cell; the tasks are counted from
    the rows of all cells.
    """
    hot = scratch.save(keyed.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select(F.col("k").alias("_k"), F.col("key").alias("_key"), "n", F.ceil(F.col("n") * 2 / HOT).alias("_s")))
    more = hot.agg(F.sum(F.col("n") * (F.col("_s") - 1)).alias("n")).first()["n"]
    one = F.array(F.lit(0).cast("long"))
    if more:
        keyed = keyed.join(hot.drop("n"), (F.col("k") == F.col("_k")) & (F.col("key") == F.col("_key")), "left")
        own = F.pmod(F.xxhash64(member), F.col("_s"))
        cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_s") - 1), lambda t: F.least(own, t) * F.col("_s") + F.greatest(own, t))
        one = F.when(F.col("_s").isNull(), one).otherwise(cells)
    cells = keyed.withColumn("cell", F.explode(one)).drop("_k", "_key", "_s")
    tasks = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(n + (more or 0)) // PER_TASK))
    return cells.repartition(tasks, "k", "key", "cell")


def linked(fps: DataFrame, budget: int, scratch: Scratch) -> DataFrame:
    """fps: distinct `fp`, saved. A saved table (u, v): v is the smallest member of u's component, u isn't."""
    n = fps.count()
    own = masks(n, budget)
    keyed = fps.select(F.col("fp").alias("f0"), F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(own)])).alias("s")).select("s.k", "s.key", "f0")
    edges = dealt(keyed, "f0", n * len(own), scratch).mapInArrow(lambda b: freed(_links(b, budget)), "u long, v long")
    edges = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    return components(edges, scratch)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: saved, u > v, distinct. Alternates large-star and small-star until each node hangs on its component's smallest."""
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == seen:
            return edges
        seen = mark
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = scratch.save(both.where(F.col("v") > F.col("u")).join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(low, F.col("u") == F.col("w")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.save(low.select(F.col("w").alias("u"), F.col("m").alias("v")).unionAll(small).distinct())
        for old in (edges, large):
            scratch.drop(old)
        edges = new


def near_duplicates(docs: DataFrame, budget: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint and component of each document; links are at most `budget` differing bits.

    Returns doc_id, text_hash, fingerprint (16 hexadecimal digits), component_id (the smallest id that is
    reachable). Null texts are empty; those without words have fingerprint zero and link like others.
    Null ids don't count for component_id, which is null where a component has no other. Repeated rows and ids are
    rows of the same component if their texts' fingerprints are. An empty table gives an empty result.
    Columns of other names are ignored; whole texts are read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    text = F.col(text_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    own = scratch.save(slim.mapInArrow(lambda b: freed(_fingerprints(b, words)), "doc_id long, text_hash long, fp long"))
    fps = scratch.save(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    stars = linked(fps, budget, scratch)
    hangs = fps.join(stars, F.col("fp") == F.col("u"), "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    ids = scratch.save(hangs.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("root").alias("r"), "component_id"))
    named = scratch.save(hangs.join(ids, F.col("root") == F.col("r"), "left").select(F.col("fp").alias("f"), F.when(F.col("r").isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id")))
    return own.join(named, F.col("fp") == F.col("f")).select("doc_id", "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: str, words: int = WORDS) -> set[bytes]:
    """Of a text of fewer words, the whole; case and white space don't count."""
    w = text.encode().lower().split()
    return set(map(b" ".join, zip(*(w[i:] for i in range(words))))) if len(w) > words else {b" ".join(w)}


def wide_fingerprint(own: set[bytes]) -> bytes:
    """LANES * 64 bits: a bit is 1 if set in over half the shingles' hashes."""
    bits = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x, seed) for x in own for seed in range(LANES // 2)]), dtype=np.uint8).reshape(len(own), 8 * LANES)
    counts = np.zeros(64 * LANES, dtype=np.int64)
    for k in range(0, len(own), 1 << 13):
        counts += np.unpackbits(bits[k : k + (1 << 13)], axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(own)).tobytes()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f"f{i}" for i in range(LANES)]
    for batch in batches:
        n, prints = [], []
        for _, t in texts([batch]):
            own = shingles(t)
            n.append(len(own))
            prints.append(wide_fingerprint(own))
        lanes = np.frombuffer(b"".join(prints), dtype=">u8").astype(np.uint64).view(np.int64).reshape(-1, LANES)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), *(pa.array(lanes[:, i].copy()) for i in range(LANES))], ["t", "n", *names])


def near_budget() -> int:
    """Differing bits within which texts of similarity SIMILAR / 100 stay. Two sets of equal size with Jaccard similarity s
    have the cosine 2s / (1 + s), and a bit differs with the probability of their angle over a half turn."""
    p = angle()
    return round(64 * LANES * p + DEVIATIONS * math.sqrt(64 * LANES * p * (1 - p)))


def angle() -> float:
    s = SIMILAR / 100
    return math.acos(2 * s / (1 + s)) / math.pi


def samples(n: int) -> list[np.ndarray]:
    """Keys of near_copies: sets of bits, so many that a pair at the limit agrees in one of them but for MISSED.

    They have as many bits as make keys rare enough for n fingerprints, and are cut from the bits in random order, so that
    those of one order share none.
    """
    m = min(64, max(BITS, math.ceil(math.log2(max(n, 1) / RARE))))
    count = math.ceil(math.log(MISSED) / math.log(1 - (1 - angle()) ** m))
    rng, out = np.random.default_rng(42), []
    while len(out) < count:
        order = rng.permutation(64 * LANES)
        out += [order[k : k + m] for k in range(0, len(order) - m + 1, m)]
    return out[:count]


def _sampled(bits: np.ndarray) -> Column:
    """The key of a set of bits: the hash of the lanes with all other bits off."""
    lanes = {int(b) >> 6 for b in bits}
    return F.xxhash64(*[F.col(f"f{i}").bitwiseAND(F.lit(_signed(sum(1 << (63 - (int(b) & 63)) for b in bits if int(b) >> 6 == i)))) for i in sorted(lanes)])


def _loose(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """(u, v): links enough to join all rows t, of unlike labels r, that have close fingerprints."""
    if (own := _cells(batches)) is None:
        return
    table, group, fps = own
    t, n = table["t"].to_numpy(), table["n"].to_numpy()
    _, first, of = np.unique(table["r"].to_numpy(), return_index=True, return_inverse=True)
    root, found = first[of], []

    def seen(a: np.ndarray, b: np.ndarray) -> None:
        fit = 100 * np.minimum(n[a], n[b]) >= SIMILAR * np.maximum(n[a], n[b])
        a, b = trie.linking(root, a[fit], b[fit])
        trie.joined(root, a, b)
        found.append((t[a], t[b]))

    near = np.flatnonzero((group[1:] == group[:-1]) & (trie.differing(fps[1:], fps[:-1]) <= budget))
    seen(near, near + 1)
    for a, b in trie.close_pairs(group, fps, budget, root):
        seen(a, b)
    u, v = (np.concatenate(x) for x in zip(*found))
    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])


def _links_of_texts(t: list[int], own: list[set[int]], fps: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Links that join the texts t that are alike. Pairs of close fingerprints come from the trie, the closest of a lot first; those
    within a component that is known aren't compared."""
    order = np.lexsort(fps.T[::-1])
    fps, t, own = fps[order], [t[i] for i in order], [own[i] for i in order]
    parent, root, links = list(range(len(t))), np.arange(len(t)), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in trie.close_pairs(np.zeros(len(t), dtype=int), fps, budget, root):
        for k in np.argsort(trie.differing(fps[a], fps[b]), kind="stable").tolist():
            x, y = int(a[k]), int(b[k])
            if (rx := find(x)) == (ry := find(y)):
                continue
            m, n = len(own[x]), len(own[y])
            if 100 * min(m, n) >= SIMILAR * max(m, n):
                both = len(own[x] & own[y])
                if 100 * both >= SIMILAR * (m + n - both):
                    parent[max(rx, ry)] = min(rx, ry)
                    links.append((max(t[x], t[y]), min(t[x], t[y])))
        root[:] = [find(x) for x in range(len(t))]
    return links


def _alike(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Links (u, v) that join the texts of each cell that are alike. Rows (c, i, j, t, text, lanes) come cell by cell."""
    cell, t, own, fps = None, [], [], []

    def links() -> pa.RecordBatch:
        found = _links_of_texts(t, own, np.array(fps, dtype=np.uint64), budget) if len(t) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    for batch in batches:
        lanes = np.stack([batch.column(5 + k).to_numpy().view(np.uint64) for k in range(LANES)], axis=1)
        for k, at in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)))):
            if at != cell:
                yield links()
                cell, t, own, fps = at, [], [], []
            t.append(batch.column(3)[k].as_py())
            own.append(set(map(xxhash.xxh64_intdigest, shingles(batch.column(4)[k].as_py()))))
            fps.append(lanes[k])
    yield links()


def near_copies(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs: texts `t` (hash), `text`. A saved table (u, v): v is the smallest member of u's component of near copies, u isn't.

    Two texts are near copies if SIMILAR / 100 of their distinct WORDS-word shingles are common. Trie self-joins of SimHash
    fingerprints, within keys of sampled bits, find the loose components of texts within near_budget() of each other: links of FIRST
    keys, then of all keys those between components. The texts of a loose component meet in one cell (or, if they are many,
    slice by slice in a cell for each two slices), where a trie of all of them proposes pairs and the texts decide. Only links
    are returned from tasks, never the pairs of a group, and only texts of loose components are shuffled.
    """
    lanes = [f"f{i}" for i in range(LANES)]
    sketch = docs.mapInArrow(lambda b: freed(_sketches(b)), "t long, n int, " + ", ".join(f"{c} long" for c in lanes))
    sketch = scratch.save(sketch.groupBy("t").agg(F.first("n").alias("n"), *[F.first(c).alias(c) for c in lanes]))  # copies count once
    total, budget = sketch.count(), near_budget()
    keys = samples(total)

    def loose(some: list[np.ndarray], labels: DataFrame | None) -> DataFrame:
        rows = sketch.withColumn("r", F.col("t"))
        if labels is not None:
            rows = sketch.join(labels, F.col("t") == F.col("u"), "left").withColumn("r", F.coalesce("v", "t")).drop("u", "v")
        keyed = rows.select("*", F.posexplode(F.array(*[_sampled(bits) for bits in some])).alias("k", "key")).select("k", "key", "t", "n", "r", *lanes)
        return scratch.save(dealt(keyed, "t", total * len(some), scratch).mapInArrow(lambda b: freed(_loose(b, budget)), "u long, v long").distinct())

    stars = components(loose(keys[:FIRST], None), scratch)
    stars = components(scratch.save(stars.unionAll(loose(keys, stars)).distinct()), scratch)
    members = stars.select(F.col("u").alias("t"), F.col("v").alias("c")).unionAll(stars.select(F.col("v").alias("t"), F.col("v").alias("c")).distinct())
    members = scratch.save(members.join(sketch.withColumnRenamed("t", "_t"), F.col("t") == F.col("_t")).drop("_t"))
    slices = members.groupBy("c").agg(F.ceil(F.sum("n") / SLICE).alias("s")).where("s > 1").select(F.col("c").alias("_c"), "s")
    near = marked(docs, "t", members.select(F.col("t").alias("_m"))).where("_hit").drop("_hit")
    near = near.groupBy("t").agg(F.first("text").alias("text")).join(members.withColumnRenamed("t", "_t"), F.col("t") == F.col("_t"))
    near = near.join(slices, F.col("c") == F.col("_c"), "left").withColumn("slot", F.pmod(F.xxhash64("t", F.lit(7)), F.coalesce("s", F.lit(1))))
    cells = near.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("s", F.lit(1)) - 1)))
    cells = cells.select("c", F.least("slot", "o").alias("i"), F.greatest("slot", "o").alias("j"), "t", "text", *lanes)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-members.count() // PER_TASK))
    cells = cells.repartition(tasks, "c", "i", "j").sortWithinPartitions("c", "i", "j")
    return components(scratch.save(cells.mapInArrow(lambda b: freed(_alike(b, budget)), "u long, v long").distinct()), scratch)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document of each component of near copies (see near_copies): the one with the smallest id
    stays (null ids last), of equal ids the one with the smallest text hash, and of rows alike in both one.

    Null texts are empty, and texts without words are near copies of each other. Null ids, repeated ids and repeated
    rows are allowed; columns of any name are returned as they are; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), text.alias("text"))
    stars = near_copies(slim.select(F.col("text_hash").alias("t"), "text"), scratch)
    found = slim.drop("text").join(stars, F.col("text_hash") == F.col("u"), "left").select("doc_id", "text_hash", F.coalesce("v", "text_hash").alias("_g"))
    return first_of_each(docs, scratch.save(found), scratch, id_col, text_col)


def first_of_each(docs: DataFrame, found: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """docs without all but the first row of each group; found: doc_id, text_hash and group _g of each row."""
    key = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    first = scratch.save(found.groupBy("_g").agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("n")).select(F.col("_g").alias("_g1"), F.col("k.i").alias("_i"), F.col("k.h").alias("_h"), "n"))
    many = first.where("n > 1")
    own = found.join(many, F.col("_g") == F.col("_g1"))
    is_first = F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_h"))
    goes = scratch.save(own.where(~is_first).select(F.col("doc_id").alias("_di"), F.col("text_hash").alias("_dh")))
    out = boxed(docs).select("row", field(id_col).cast("long").alias("_id"), F.xxhash64(field(text_col)).alias("_th"))
    out = marked(out.withColumn("_k", F.xxhash64("_id", "_th")), "_k", goes.select(F.xxhash64("_di", "_dh").alias("_m")))
    # rows that stay for sure aren't shuffled
    out = out.where(~F.col("_hit")).unionAll(out.where("_hit").join(goes, F.col("_id").eqNullSafe(F.col("_di")) & (F.col("_th") == F.col("_dh")), "left_anti"))
    again = own.where(is_first).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1").head(1)
    if again:  # rows repeat as a whole
        out = out.dropDuplicates(["_id", "_th"])
    return unboxed(out, docs.columns)
