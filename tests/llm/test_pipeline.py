"""The pipeline stage by stage against brute force, on a whole small table."""

import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tests.llm.test_brute import SF, WORD, personal, rules
from tests.llm.test_similar import components
from zedweave.llm import mixing, quality
from zedweave.llm.common import Scratch
from zedweave.llm.queries import tokenizer


def test_stages(spark):
    from tokenizers import Tokenizer

    scratch, docs, after = Scratch(spark, "test-pipeline"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    start = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = after[name] = scratch.save(stage(spark, docs, SF))
    rows = {name: df.collect() for name, df in after.items()}
    first = {r["doc_id"]: r for r in start.collect()}

    # rules: those that fail go, others keep all but boilerplate lines
    kept = {r["doc_id"] for r in quality.quality_rules(start).collect() if r["kept"]}
    one = {r["doc_id"]: r for r in rows["quality rules"]}
    assert one.keys() == kept and not any(rules(first[d]["text"])[5] for d in kept)
    for d, r in one.items():
        lines = iter(first[d]["text"].split("\n"))
        assert all(x in lines for x in r["text"].split("\n")) and (r["n_chars"] == len(r["text"]) or r["text"] == first[d]["text"])

    # near copies: the smallest id of each component stays
    find = components({d: r["text"] for d, r in one.items()})
    two = {r["doc_id"]: r for r in rows["near-dedup"]}
    assert two.keys() == set(find.values()) and all(two[d] == one[d] for d in two)

    # personal data: none of the base kinds is left, and texts without any anchor stay
    three = {r["doc_id"]: r for r in rows["personal data"]}
    assert three.keys() == two.keys()
    for d, r in three.items():
        assert sum(personal(r["text"])[0]) == 0 or "<" in r["text"]
        if not any(c in two[d]["text"] for c in "@+:=0123456789"):
            assert r == two[d]
        if sum(personal(two[d]["text"])[0]):
            assert r["text"] != two[d]["text"]

    # mix: as often as the operator says, near the targets
    size = {d: len(WORD.findall(r["text"])) for d, r in three.items()}
    plan = {r["doc_id"]: r for r in mixing.mix_sources(after["personal data"]).collect()}
    four = Counter(r["doc_id"] for r in rows["mix"])
    assert all(four[d] == plan[d]["copies"] <= 3 and plan[d]["size"] == size[d] for d in three)
    taken, target = defaultdict(int), {}
    for d, r in three.items():
        taken[r["source"]] += four[d] * size[d]
        target[r["source"]] = plan[d]["target"]
    assert all(abs(taken[s] - target[s]) <= max(size[d] for d in three if three[d]["source"] == s) / 2 for s in target)

    # packing: every token of every copy once
    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    ids = {d: np.array(t.encode(three[d]["text"], add_special_tokens=False).ids + [0], dtype="<u4") for d in four}
    covered, places = Counter(), defaultdict(list)
    for p in rows["pack"]:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] and zlib.crc32(part) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        covered[p["doc_id"]] += p["length"]
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    assert covered == Counter({d: n * len(ids[d]) for d, n in four.items()})
    for own in places.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 1024
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted((p["doc_id"], p["start"], p["length"], p["ids_crc32"]) for p in rows["pack"])
