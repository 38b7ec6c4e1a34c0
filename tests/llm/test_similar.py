"""The pipeline's near copies: 5-word shingles, Jaccard 0.8 at least."""

import corpus_pipeline
from tests.llm.test_brute import SF, fingerprint
from zedweave.llm import quality
from zedweave.llm.common import Scratch
from zedweave.llm.simhash import shingles


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return 10 * len(a & b) >= 8 * len(a | b)


def components(texts):
    """The smallest id of each document's component, by all pairs."""
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and alike(texts[a], texts[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in texts}


def test_shingles():
    assert shingles("A b  c\nd e F") == {b"a b c d e", b"b c d e f"} and shingles("A b") == {b"a b"} and shingles(" ") == {b""}


def test_whole_table(spark):
    """All pairs by brute force; the rule of 4 bits of SimHash missed some."""
    scratch = Scratch(spark, "test-similar")
    good = scratch.save(quality.keep_good(spark.read.parquet(f"{SF}/documents.parquet")))
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    want = components(texts)
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, good, SF).collect()}
    assert kept == set(want.values())
    assert any(want[a] != a and all((fingerprint(texts[a]) ^ fingerprint(texts[b])).bit_count() > 4 for b in texts if b != a) for a in texts)


def test_chains_and_edge_of_the_rule(spark):
    """Copies of copies hang together, below 0.8 both stay, and short, empty, null and repeated rows are met."""
    words = [f"w{i}" for i in range(300)]
    change = lambda n, at=0: " ".join(f"x{i}" if at <= i < at + 5 * n and i % 5 == 0 else w for i, w in enumerate(words))
    rows = [(1, change(0)), (2, change(6)), (3, change(12)), (4, change(20, 150)), (5, "one two"), (6, "One  two"), (7, "one two three"), (8, ""), (9, None), (10, change(0)), (10, change(0)), (None, "one two")]
    texts = {k: t or "" for k, (_, t) in enumerate(rows)}
    assert alike(texts[0], texts[1]) and alike(texts[1], texts[2]) and not alike(texts[0], texts[2]) and not alike(texts[0], texts[3])
    want = sorted(rows[k][0] for k in set(components(texts).values()))
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), None).collect()
    assert sorted(r["doc_id"] for r in out) == want == [1, 4, 5, 7, 8]


def test_large_families(spark, monkeypatch):
    """Families of copies whose keys are hot, some of whose members are too far from each other; by all pairs."""
    import random

    from zedweave.llm import simhash

    monkeypatch.setattr(simhash, "HOT", 16)
    monkeypatch.setattr(simhash, "SLICE", 2000)
    r, texts = random.Random(3), {}
    for f in range(4):
        base = [f"f{f}w{r.randrange(2000)}" for _ in range(120)]
        for _ in range(60):
            own = list(base)
            for k in range(r.choice((0, 1, 2, 3))):
                own[r.randrange(120)] = f"e{r.randrange(10**6)}"
            texts[len(texts)] = " ".join(own)
    for _ in range(200):
        texts[len(texts)] = " ".join(f"w{r.randrange(3000)}" for _ in range(r.randrange(20, 60)))
    want = set(components(texts).values())
    out = simhash.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()
    assert {x["doc_id"] for x in out} == want and 200 < len(want) < 300


def test_equal_fingerprints():
    """Rows of equal fingerprints in one group are pairs too, in both forms of the join."""
    import numpy as np

    from zedweave.llm import trie

    fps = np.array([[1, 2], [1, 2], [1, 2], [1, 3], [9, 0]], dtype=np.uint64)
    group = np.zeros(5, dtype=int)
    pairs = {tuple(sorted(x)) for a, b in trie.close_pairs(group, fps, 1, np.arange(5)) for x in zip(a.tolist(), b.tolist())}
    assert pairs == {(0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (2, 3)}
    assert trie.forest(group, fps, 1)[0].tolist() == [0, 0, 0, 0, 4]
