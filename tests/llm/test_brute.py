"""The registered queries against brute force, on whole small tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from zedweave.llm.queries import QUERIES, tokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, n):
    return QUERIES[next(k for k in QUERIES if k.startswith(f"op{n}_"))](spark, SF).collect()


def test_sharding(spark, docs):
    out = result(spark, 1)
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    by, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        b = docs[r["doc_id"]]["text"].encode()
        assert r["size"] == len(b) + 1 and r["text_crc32"] == zlib.crc32(b)
        by[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[b].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(g) == 1 for g in groups.values())
    assert len(by) == 16 and max(by.values()) < 1.1 * sum(by.values()) / 16


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    ids = {d: np.array(t.encode(r["text"], add_special_tokens=False).ids + [0], dtype="<u4") for d, r in docs.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in result(spark, 2):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for d, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[d]) and p["ids_crc32"] == zlib.crc32(ids[d][at : at + p["length"]])
            at += p["length"]
        assert at == len(ids[d])
    total = padding = 0
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.03 * total


def test_mixing(spark, docs):
    size = {d: len(WORD.findall(r["text"])) for d, r in docs.items()}
    sources = sorted({r["source"] for r in docs.values()}, key=lambda s: (s is None, s))
    own = {s: sum(size[d] for d, r in docs.items() if r["source"] == s) for s in sources}
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    total, capped = sum(own.values()), set()
    while True:
        rest = total - sum(3 * own[s] for s in capped)
        target = {s: 3 * own[s] if s in capped else rest * weight[s] / sum(weight[x] for x in sources if x not in capped) for s in sources}
        if not (over := {s for s in sources if s not in capped and target[s] > 3 * own[s]}):
            break
        capped |= over
    taken = Counter()
    out = result(spark, 3)
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    for r in out:
        s = docs[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == own[s] and r["target"] == pytest.approx(target[s]) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        assert not r["size"] or r["taken"] % r["size"] == 0 and r["taken"] // r["size"] in (int(target[s] / own[s] + 1e-9), int(target[s] / own[s]) + 1)
    assert all(abs(taken[s] - target[s]) <= max(size[d] for d in docs if docs[d]["source"] == s) / 2 for s in sources)
    assert {(r["doc_id"], r["taken"]) for r in out} == {(r["doc_id"], r["taken"]) for r in result(spark, 3)}


def licence_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places = [(i, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licences(spark, docs):
    found = Counter()
    for r in result(spark, 4):
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == licence_base(docs[r["doc_id"]]["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
        assert ("cc-by-nc" in r["labels"].split(",")) == ("CC BY-NC 4.0" in docs[r["doc_id"]]["text"])
        found.update(r["labels"].split(","))
    assert found["mit"]


def test_warc(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = {}
    for p in sorted(pages):
        first.setdefault(pages[p], p)
    out = {r["page_id"]: r for r in result(spark, 5)}
    assert out.keys() == pages.keys()
    for p, b in pages.items():
        f = first[b]
        assert tuple(out[p])[1:] == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == p else "revisit", None if f == p else f)


def fingerprint(text):
    w = [x for x in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    fp = {d: fingerprint(r["text"]) for d, r in docs.items()}
    ids, root = sorted(fp), {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {tuple(r) for r in result(spark, 6)} == {(d, f"{fp[d]:016x}", find(d)) for d in ids}


def test_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    got = defaultdict(list)
    for r in result(spark, 7):
        got[r["query_id"]].append(r)
    hit = 0
    assert got.keys() == {int(i) for i in ids if i % 50 == 0}
    for q, rs in got.items():
        s = u @ u[ids == q][0]
        s[ids == q] = -9
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == [1, 2, 3, 4, 5] and rs == sorted(rs, key=lambda r: (-r["score"], r["vec_id"]))
        assert all(r["score"] == pytest.approx(s[ids == r["vec_id"]][0], abs=1e-12) for r in rs)
        hit += len({r["vec_id"] for r in rs} & {int(i) for i in ids[np.argsort(-s)[:5]]})
    assert hit >= 0.9 * 5 * len(got)


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    t, at = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), 0
    out = {r["doc_id"]: r for r in result(spark, 8)}
    assert out.keys() == docs.keys()
    for d in sorted(docs):
        ids = np.array(t.encode(docs[d]["text"], add_special_tokens=False).ids + [2], dtype="<u4")
        assert tuple(out[d])[1:] == (at, len(ids), zlib.crc32(ids))
        at += len(ids)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    out = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15],
    }
    return [len(v) for v in out.values()], [f"{k}:{s}:{e}" for k, v in out.items() for s, e in v]


def test_personal_data(spark, docs):
    for r in result(spark, 9):
        counts, spans = personal(docs[r["doc_id"]]["text"])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest() and r["spans"].split(",")[: len(spans)] == (spans or r["spans"].split(",")[:0])


def rules(text):
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if c[x] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, docs):
    out = result(spark, 10)
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    for r in out:
        assert tuple(r)[1:7] == rules(docs[r["doc_id"]]["text"]), r
        assert not (r["base_failed"] and r["kept"])
    assert sum(r["base_failed"] for r in out) > sum(r["kept"] is False and not r["base_failed"] for r in out)
