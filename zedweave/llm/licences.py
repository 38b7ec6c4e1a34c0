"""Licence scan by a positional rare-token index, in DataFrame functions only."""

from __future__ import annotations

import math
import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zedweave.llm.common import Scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A word, of a text whose A-Z are in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: label, notice, mandatory key phrases (of words that aren't in STOP, in the notice).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["hereby granted free", "associated documentation files"]),
    ("apache", "licensed under the apache license version 2 0", ["apache license version"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["free software", "general public license"]),
    ("lgpl", "licensed under the gnu lesser general public license version 3", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["source", "binary forms", "permitted"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["purpose", "hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released", "public domain"]),
    ("cc0", "licensed under cc0 1 0 universal", ["cc0"]),
    ("cc-by", "licensed under cc by 4 0", ["licensed", "cc", "4 0"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc", "sa 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc", "nc 4 0"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc", "nd 4 0"]),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ["cc", "nc sa 4 0"]),
    ("cc-by", "creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
]

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Words of notices that aren't looked up.
STOP = frozenset("a and any are as by can for in into is it of or the this to use under with without you".split())

#: A notice is indexed by its RARE words of highest IDF, and a file looked up by all its indexed words.
RARE = 6
#: Indexed words that must stand in one alignment (all, for notices that have fewer).
AGREE = 2

_SHIFT, _TEMPLATE = 1 << 32, 1 << 40


def _notices(templates) -> list[dict]:
    """words: (position, word) of each notice without stop words; key: the positions of its key phrases."""
    out = []
    for label, text, phrases in templates:
        w, key = re.findall(WORD, text.lower()), set()
        for p in phrases:
            k = re.findall(WORD, p.lower())
            at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
            key |= set(range(at, at + len(k)))
        out.append({"label": label, "words": [(i, x) for i, x in enumerate(w) if x not in STOP], "key": key})
    return out


def _map(entries: dict[str, Column]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), v) for k, v in entries.items()))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None) -> DataFrame:
    """A row for each document: n_words, base places, base_labels, labels and score.

    The document frequency of each licence word is counted over all documents; the index holds, by word, the
    notices and positions of their rarest words. A file's indexed words propose alignments (notice, start); one
    in which enough of them agree and all words of the mandatory key phrases stand in their places gives the notice's label.
    score is the largest share of a notice's words that stand in place, over such alignments, 1 if there is a base
    place but no such alignment, else 0. Words of one alignment are counted in one sorted pass, so time grows with the
    text. Null and empty texts have no words; ids may be null or repeat; repeated rows give equal rows; of
    a notice's equally rare words the first by code point is indexed; an empty table gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "licence")
    notices = _notices(TEMPLATES if templates is None else templates)
    vocabulary = sorted({w for n in notices for _, w in n["words"]} | {w for p in BASE for w in p.split()})
    known = F.array(*[F.lit(w) for w in vocabulary])
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))  # alike for ASCII, where lower is faster
    d = docs.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(vocabulary))
    slim = scratch.save(d.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.arrays_overlap("words", known), hits).alias("hits")))
    seen = slim.where("hits is not null").select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["w"]))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each word of notices
    total, df = slim.count(), {r["w"]: r["n"] for r in seen}
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) for w in vocabulary}
    postings: dict[str, list] = {}
    for t, n in enumerate(notices):
        rare = set(sorted({w for _, w in n["words"]}, key=lambda w: (-idf[w], w))[:RARE])
        n["need"] = min(AGREE, sum(w in rare for _, w in n["words"]))
        for p, w in n["words"]:
            postings.setdefault(w, []).append((t, p, p in n["key"], w in rare))
    if not postings:
        postings = {"": []}
    entry = lambda q: F.struct(F.lit(q[0] * _TEMPLATE + _SHIFT - q[1]).cast("long").alias("e"), F.lit(int(q[2])).alias("key"), F.lit(int(q[3])).alias("rare"))
    index = _map({w: F.array(*[entry(q) for q in qs]) for w, qs in postings.items()})

    # base places: all phrases end in the same word
    def place(x, k):
        before = lambda j, w: F.coalesce((F.get("hits", k - j)["w"] == w) & (F.get("hits", k - j)["i"] == x["i"] - j), F.lit(False))
        out = F.lit(None).cast("struct<s:int,l:string>")
        for phrase, label in BASE.items():
            w = phrase.split()
            ok = x["w"] == w[-1]
            for j in range(1, len(w)):
                ok = ok & before(j, w[-1 - j])
            out = F.when(ok, F.struct((x["i"] - (len(w) - 1)).cast("int").alias("s"), F.lit(label).alias("l"))).otherwise(out)
        return out

    places = F.filter(F.transform("hits", place), lambda x: x.isNotNull())
    s = slim.select("doc_id", "n_words", "hits", places.alias("places"))
    entries = F.flatten(F.transform("hits", lambda x: F.transform(F.coalesce(index[x["w"]], F.array().cast("array<struct<e:bigint,key:int,rare:int>>")), lambda q: F.struct(
        (q["e"] + x["i"]).alias("e"), q["key"].alias("key"), q["rare"].alias("rare")))))
    s = s.select("doc_id", "n_words", "places", F.sort_array(entries).alias("entries"))
    of = lambda values, e: F.element_at(F.array(*[F.lit(v) for v in values or [1]]), F.floor(e / _TEMPLATE).cast("int") + 1)
    needs, keys, sizes = [n["need"] for n in notices], [len(n["key"]) for n in notices], [len(n["words"]) for n in notices]

    def settled(a):
        """The state once its alignment is complete."""
        ok = (a["e"] >= 0) & (a["rare"] >= of(needs, a["e"])) & (a["key"] >= of(keys, a["e"]))
        found = F.array_union(a["found"], F.array(F.floor(a["e"] / _TEMPLATE).cast("int")))
        return F.when(ok, found).otherwise(a["found"]).alias("found"), F.when(ok, F.greatest(a["best"], a["n"] / of(sizes, a["e"]))).otherwise(a["best"]).alias("best")

    def step(a, x):
        found, best = settled(a)
        same = a["e"] == x["e"]
        return F.when(same, F.struct(a["e"].alias("e"), (a["n"] + 1).alias("n"), (a["key"] + x["key"]).alias("key"), (a["rare"] + x["rare"]).alias("rare"), a["found"].alias("found"), a["best"].alias("best"))).otherwise(
            F.struct(x["e"].alias("e"), F.lit(1).alias("n"), x["key"].alias("key"), x["rare"].alias("rare"), found, best))

    start = F.struct(F.lit(-1).cast("long").alias("e"), F.lit(0).alias("n"), F.lit(0).alias("key"), F.lit(0).alias("rare"), F.array().cast("array<int>").alias("found"), F.lit(0.0).alias("best"))
    s = s.withColumn("m", F.when(F.size("entries") > 0, F.aggregate("entries", start, step, lambda a: F.struct(*settled(a)))))
    names = F.array(*[F.lit(n["label"]) for n in notices] or [F.lit("")])
    base_labels = F.coalesce(F.array_sort(F.array_distinct(F.transform("places", lambda x: x["l"]))), F.array().cast("array<string>"))
    own = F.coalesce(F.transform("m.found", lambda t: F.element_at(names, t + 1)), F.array().cast("array<string>"))
    n_base = F.coalesce(F.when(F.col("places").isNotNull(), F.size("places")), F.lit(0)).cast("long")
    starts = F.transform("places", lambda x: x["s"].cast("long"))
    score = F.coalesce(F.when(F.size("m.found") > 0, F.col("m.best")), F.when(n_base > 0, F.lit(1.0)), F.lit(0.0))
    return s.select("doc_id", "n_words", n_base.alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), F.array_join(base_labels, ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_union(base_labels, own)), ",").alias("labels"), score.cast("double").alias("score"))
