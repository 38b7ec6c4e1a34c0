"""Fixed scenarios, in both modes of evaluation."""

import pytest
from pyspark.sql import functions as F

from zedweave import Builder, ContextMismatch

MODES = ["snapshot", "delta"]


@pytest.fixture(params=MODES)
def mode(request):
    return request.param


def feed(run, target, add="", sub=""):
    for sign, rows in ((1, add), (-1, sub)):
        for r in rows.split() if isinstance(rows, str) else rows:
            target.update(run, tuple(r), sign)


def once(spark, schema, rows, build_out, mode="snapshot"):
    """What an operator makes of one input with weights."""
    b = Builder(spark)
    own, rel = b.create_input(schema)
    out = build_out(rel).get_arrangement(b)
    run = b.begin(mode)
    for x, w in rows:
        own.update(run, x, w)
    run.commit()
    return out.to_dict(run)


def twice(spark, schemas, rows, build_out, mode="snapshot"):
    b = Builder(spark)
    ins = [b.create_input(s) for s in schemas]
    out = build_out(*[r for _, r in ins]).get_arrangement(b)
    run = b.begin(mode)
    for (own, _), rs in zip(ins, rows):
        for x, w in rs:
            own.update(run, x, w)
    run.commit()
    return out.to_dict(run)


def test_map_insert_delete(spark, mode):
    b = Builder(spark)
    own, v = b.create_input("v BIGINT")
    out = v.map(v="v + 1").get_arrangement(b)
    run = b.begin(mode)
    for x in (1, 2, 3):
        own.insert(run, x)
    assert out.to_dict(run) == out.to_dict(run) == {}
    run.commit()
    assert out.to_dict(run) == {(2,): 1, (3,): 1, (4,): 1}
    own.delete(run, 2)
    run.commit()
    assert out.to_dict(run) == {(2,): 1, (4,): 1}


def test_shared_inputs(spark, mode):
    b = Builder(spark)
    i1, r1 = b.create_input("c STRING, n BIGINT")
    i2, r2 = b.create_input("c STRING, s STRING")
    r2 = r2.split()
    left = r1.join(r2, "c").map("c", n="n + octet_length(s)")
    right = r2.map(c="if(s = '', 'x', substr(s, 1, 1))", n="cast(octet_length(s) as bigint)")
    out = left.concat(right).distinct().get_arrangement(b)
    run = b.begin(mode)
    for x in (("a", 5), ("b", 6)):
        i1.insert(run, x)
    for x in (("b", "Hello"), ("b", "world")):
        i2.insert(run, x)
    run.commit()
    assert out.to_dict(run) == {("H", 5): 1, ("b", 11): 1, ("w", 5): 1}
    i1.delete(run, ("b", 6))
    i2.insert(run, ("a", "Goodbye"))
    run.commit()
    assert out.to_dict(run) == {("G", 7): 1, ("H", 5): 1, ("a", 12): 1, ("w", 5): 1}


def closure(b, edges):
    sub = b.subgraph()
    handle, v = sub.variable("s STRING, d STRING")
    e = edges.enter(sub)
    step = v.join(e.rename(s="m", d="t"), [("d", "m")]).map("s", d="t")
    body = e.concat(step).distinct()
    handle.set(body)
    return body.leave(sub.finish())


def distances(b, edges):
    sub = b.subgraph(tier="n")
    handle, v = sub.variable("s STRING, d STRING, n BIGINT")
    e = edges.enter(sub)
    step = v.join(e.rename(s="m", d="t"), [("d", "m")]).map("s", d="t", n="n + 1")
    body = e.with_columns(n="1L").concat(step).group_min(["s", "d"])
    handle.set(body)
    return body.leave(sub.finish())


def pairs(text):
    return {tuple(x): 1 for x in text.split()}


def with_n(text):
    return {(x[0], x[1], int(x[2:])): 1 for x in text.split()}


def test_closure(spark):
    b = Builder(spark)
    own, edges = b.create_input("s STRING, d STRING")
    out = closure(b, edges).get_arrangement(b)
    run = b.begin("delta")
    feed(run, own, "AB BC AC DE CD")
    run.commit()
    assert out.to_dict(run) == pairs("CD AD BD CE AE BE AB BC AC DE")
    feed(run, own, sub=["AC"])
    run.commit()
    assert out.to_dict(run) == pairs("CD AD BD CE AE BE AB BC AC DE")
    feed(run, own, sub=["AB"])
    run.commit()
    assert out.to_dict(run) == pairs("CD BD CE BE BC DE")


def test_distances(spark):
    b = Builder(spark)
    own, edges = b.create_input("s STRING, d STRING")
    out = distances(b, edges).get_arrangement(b)
    run = b.begin("delta")
    feed(run, own, "AB BC AC DE CD")
    run.commit()
    assert out.to_dict(run) == with_n("CD1 AD2 BD2 CE2 AE3 BE3 AB1 BC1 AC1 DE1")
    feed(run, own, sub=["AC"])
    run.commit()
    assert out.to_dict(run) == with_n("AC2 AD3 AE4 CD1 BD2 CE2 BE3 AB1 BC1 DE1")


def test_distances_cyclic(spark):
    b = Builder(spark)
    own, edges = b.create_input("s STRING NOT NULL, d STRING NOT NULL")
    out = distances(b, edges).get_arrangement(b)
    run = b.begin()
    feed(run, own, "AB BC CA DE CD")
    run.commit()
    assert out.to_dict(run) == with_n("AB1 BC1 CA1 AC2 BA2 CB2 AA3 BB3 CC3 DE1 CD1 BD2 AD3 CE2 BE3 AE4")
    feed(run, own, sub=["CA"])
    run.commit()
    assert out.to_dict(run) == with_n("CD1 BD2 AD3 CE2 BE3 AE4 AB1 BC1 AC2 DE1")


def vertices_closure(b, verts, edges, tiered):
    sub = b.subgraph(tier="n" if tiered else [])
    handle, v = sub.variable("s STRING, d STRING, n BIGINT" if tiered else "s STRING, d STRING")
    e = edges.enter(sub).rename(s="m", d="t")
    base = verts.enter(sub).map(s="v", d="v")
    if tiered:
        body = base.with_columns(n="0L").concat(v.join(e, [("d", "m")]).map("s", d="t", n="n + 1")).group_min(["s", "d"])
    else:
        body = base.concat(v.join(e, [("d", "m")]).map("s", d="t")).distinct()
    handle.set(body)
    return body.leave(sub.finish())


@pytest.mark.parametrize("tiered", [True, False])
def test_bridge_and_cycle(spark, tiered):
    """Without tiers too the least fixpoint is returned: a cycle doesn't keep itself alive."""
    b = Builder(spark)
    iv, verts = b.create_input("v STRING")
    ie, edges = b.create_input("s STRING, d STRING")
    out = vertices_closure(b, verts, edges, tiered).get_arrangement(b, "nested", keys=["s", "d"] if tiered else ["s"])
    run = b.begin()
    for x in "abc":
        iv.insert(run, x)
    feed(run, ie, "ab bc cb")
    run.commit()
    reached = lambda: {(r["s"], r["d"]) for r in out.read(run).collect()} if tiered else {(r["s"], k[0]) for r in out.read(run).collect() for k in r["contents"]}
    assert ("a", "c") in reached()
    feed(run, ie, sub=["ab"])
    run.commit()
    assert ("a", "c") not in reached() and ("b", "c") in reached()


def test_entered_relation_in_a_loop(spark):
    b = Builder(spark)
    fi, foo = b.create_input("k BIGINT, v BIGINT")
    bi, bar = b.create_input("k BIGINT, y BIGINT")
    sub = b.subgraph(tier="k")
    handle, x = sub.variable("k BIGINT, v BIGINT")
    body = foo.enter(sub).concat(x.join(bar.enter(sub), "k").map(k="k + 1", v="v + y"))
    handle.set(body)
    out = body.leave(sub.finish()).get_arrangement(b)
    run = b.begin()
    fi.insert(run, (1, 10))
    bi.insert_all(run, [(1, 5), (2, 7)])
    run.commit()
    assert out.to_dict(run) == {(1, 10): 1, (2, 15): 1, (3, 22): 1}


def test_variable_that_is_never_set(spark):
    b = Builder(spark)
    sub = b.subgraph()
    _, v = sub.variable("x BIGINT")
    out = v.leave(sub.finish()).get_arrangement(b)
    run = b.begin()
    run.commit()
    assert out.to_dict(run) == {}


def test_nested_scopes_and_two_variables(spark):
    b = Builder(spark)
    own, edges = b.create_input("s STRING, d STRING")
    sub = b.subgraph(tier="n")
    handle, v = sub.variable("s STRING, n BIGINT")  # even and odd steps from A, by an inner closure of the seeds
    inner = sub.subgraph()
    ih, iv = inner.variable("s STRING, n BIGINT")
    seeds = v.enter(inner)
    ib = seeds.concat(iv.filter("false")).distinct()
    ih.set(ib)
    settled = ib.leave(inner.finish())
    start = edges.enter(sub).filter("s = 'A'").map("s", n="0L").distinct()
    step = settled.join(edges.enter(sub).rename(s="m", d="t"), [("s", "m")]).map(s="t", n="n + 1")
    body = start.concat(step).group_min("s")
    handle.set(body)
    h2, u = sub.variable("s STRING, n BIGINT")
    twice_ = body.filter("n % 2 = 0")
    h2.set(twice_)
    fin = sub.finish()
    out, even = body.leave(fin).get_arrangement(b), u.leave(fin).get_arrangement(b)
    run = b.begin()
    feed(run, own, "AB BC CA CD")
    run.commit()
    assert out.to_dict(run) == {("A", 0): 1, ("B", 1): 1, ("C", 2): 1, ("D", 3): 1}
    assert even.to_dict(run) == {("A", 0): 1, ("C", 2): 1}


def test_weights(spark, mode):
    xs = [("x", 3), ("y", -2)]
    assert once(spark, "a STRING", xs, lambda r: r.distinct(), mode) == {("x",): 1, ("y",): 1}
    assert once(spark, "a STRING", xs, lambda r: r.counts(), mode) == {("x", 3): 1, ("y", -2): 1}
    assert once(spark, "a STRING", xs, lambda r: r.concat(r.negate()), mode) == {}
    assert once(spark, "a STRING", xs, lambda r: r.map_r("_w * 2"), mode) == {("x",): 6, ("y",): -4}
    assert once(spark, "a STRING", [("x", -1)], lambda r: r, mode) == {("x",): -1}
    assert once(spark, "a STRING", [("x", 1), ("x", -1)], lambda r: r, mode) == {}


def test_joins(spark, mode):
    b = Builder(spark)
    li, x = b.create_input("k STRING, a STRING")
    ins = {n: b.create_input("k STRING") for n in ("three", "minus", "a", "b", "both")}
    (three, minus, on_a, on_b, both) = (r for _, r in ins.values())
    pi, p = b.create_input("k STRING, b STRING")
    outs = {
        "join": (x.join(p, "k"), {("k", "a", "b"): 6, (None, "n", "m"): 1}),
        "semijoin": (x.semijoin(three, "k"), {("k", "a"): 6}),
        "antijoin": (x.antijoin(minus, "k"), {("m", "b"): 5, (None, "n"): 1}),
        "fst": (x.semijoin_on_fst(three), {("k", "a"): 6}),
        "snd": (x.semijoin_on_snd(on_a), {("k", "a"): 6}),
        "anti_fst": (x.antijoin_on_fst(three), {("m", "b"): 5, (None, "n"): 1}),
        "anti_snd": (x.antijoin_on_snd(on_b), {("k", "a"): 2, (None, "n"): 1}),
        "on": (x.semijoin_on(both, "upper(k || a)"), {("k", "a"): 6}),
        "anti_on": (x.antijoin_on(both, "upper(k || a)"), {("m", "b"): 5, (None, "n"): 1}),
        "left": (x.left_join(p, "k"), {("k", "a", "b"): 6, ("m", "b", None): 5, (None, "n", "m"): 1}),
        "cross": (three.rename(k="u").join(on_a, []), {("k", "a"): 9}),
    }
    read = {n: (r.get_arrangement(b), expected) for n, (r, expected) in outs.items()}
    run = b.begin(mode)
    for row, w in ((("k", "a"), 2), (("m", "b"), 5), ((None, "n"), 1)):
        li.update(run, row, w)
    for n, k, w in (("three", "k", 3), ("minus", "k", -1), ("a", "a", 3), ("b", "b", 3), ("both", "KA", 3)):
        ins[n][0].update(run, k, w)
    pi.update(run, ("k", "b"), 3)
    pi.insert(run, (None, "m"))
    run.commit()
    for n, (out, expected) in read.items():
        assert out.to_dict(run) == expected, n


def test_antijoin_follows_the_right_side(spark, mode):
    b = Builder(spark)
    li, left = b.create_input("k STRING, a STRING")
    ri, right = b.create_input("k STRING")
    out = left.antijoin(right, "k").get_arrangement(b)
    run = b.begin(mode)
    li.update(run, ("k", "a"), 2)
    li.update(run, ("m", "b"), 5)
    ri.update(run, "k", -1)
    run.commit()
    assert out.to_dict(run) == {("m", "b"): 5}
    ri.update(run, "k", 1)
    run.commit()
    assert out.to_dict(run) == {("k", "a"): 2, ("m", "b"): 5}


def test_sets(spark, mode):
    x, y = "a STRING", "a STRING"
    assert twice(spark, [x, y], [[("x", 3), ("y", 1)], [("x", 1)]], lambda p, q: p.set_minus(q), mode) == {("y",): 1}
    assert twice(spark, [x, y], [[("x", 3)], [("x", 2)]], lambda p, q: p.intersection(q), mode) == {("x",): 6}
    data, keys = [("x", 2), ("z", 4)], [("x", 1), ("y", 1)]
    assert twice(spark, [x, y], [data, keys], lambda p, q: p.histogram(q), mode) == {("x", 2): 1, ("y", 0): 1}
    assert twice(spark, [x, y], [data, keys], lambda p, q: p.hist_including(q), mode) == {("x", 2): 1, ("y", 0): 1, ("z", 3): 1}
    assert twice(spark, [x, y], [[("x", -1)], [("x", 1)]], lambda p, q: p.hist_including(q), mode) == {}


def test_groups(spark, mode):
    kv = "k STRING, v BIGINT"
    rows = [(("k", 1), -1), (("k", 5), 1)]
    assert once(spark, kv, rows, lambda r: r.group_min("k"), mode) == {("k", 1): 1}
    assert once(spark, kv, rows, lambda r: r.group_max("k"), mode) == {("k", 5): 1}
    assert once(spark, kv, [(("k", None), 1), (("k", 5), 1)], lambda r: r.group_min("k"), mode) == {("k", None): 1}
    assert once(spark, kv, [(("k", None), 1), (("k", 5), 1)], lambda r: r.group_max("k"), mode) == {("k", 5): 1}
    kvw = "k STRING, v BIGINT, u STRING"
    assert once(spark, kvw, [(("k", 1, "b"), 1), (("k", 1, "a"), 1), (("k", 2, "c"), 1)], lambda r: r.group_min("k"), mode) == {("k", 1, "a"): 1}
    many = [(("k", i), i) for i in range(1, 5)]
    assert once(spark, kv, many, lambda r: r.group_top_k("k", 2, F.desc("v")), mode) == {("k", 4): 1, ("k", 3): 1}
    assert once(spark, kv, many, lambda r: r.reduce("k", total="sum(v * _w)", n="count(1)"), mode) == {("k", 30, 4): 1}
    assert once(spark, kv, many, lambda r: r.reduce([], total="sum(v * _w)"), mode) == {(30,): 1}
    assert once(spark, kv, many, lambda r: r.reduce("k", lambda key, g: g[g.v == g.v.max()][["v", "_w"]], schema="v BIGINT"), mode) == {("k", 4): 4}


def test_triangles(spark, mode):
    b = Builder(spark)
    ins = [b.create_input(s) for s in ("x BIGINT, y BIGINT", "x BIGINT, z BIGINT", "y BIGINT, z BIGINT")]
    out = ins[0][1].triangles(ins[1][1], ins[2][1]).get_arrangement(b)
    run = b.begin(mode)
    for (own, _), x, w in zip(ins, ((1, 2), (1, 3), (2, 3)), (2, 3, 5)):
        own.update(run, x, w)
    run.commit()
    assert out.to_dict(run) == {(1, 2, 3): 30}


def test_step_isolation(spark, mode):
    b = Builder(spark)
    own, r = b.create_input("x BIGINT")
    out = r.get_dyn_arrangement(b)
    run = b.begin(mode)
    run.commit()
    own.insert(run, 1)
    assert out.to_dict(run) == {}
    for x in (2, 3):
        run.commit()
        own.insert(run, x)
    run.commit()
    assert out.to_dict(run) == {(1,): 1, (2,): 1, (3,): 1}


def test_contexts_do_not_mix(spark):
    a, b = Builder(spark), Builder(spark)
    ia, ra = a.create_input("x BIGINT")
    _, rb = b.create_input("x BIGINT")
    for how in (lambda: ra.concat(rb), lambda: ra.join(rb, "x"), lambda: ra.antijoin(rb, "x"), lambda: ra.set_minus(rb), lambda: rb.get_arrangement(a)):
        with pytest.raises(ContextMismatch, match="Context mismatch"):
            how()
    sub = a.subgraph()
    _, v = sub.variable("x BIGINT")
    for how in (lambda: v.concat(ra), lambda: v.get_arrangement(a), lambda: rb.enter(sub)):
        with pytest.raises(ContextMismatch):
            how()
    with pytest.raises(ContextMismatch):
        ia.insert(b.begin(), 1)


def test_checks_and_containers(spark):
    b = Builder(spark)
    own, r = b.create_input("k STRING, v BIGINT")
    checked, mapping = r.assert_1to1_with_output("k", b)
    ones = r.assert_ones().get_arrangement(b)
    ordered = r.get_arrangement(b, "ordered")
    nested = r.get_arrangement(b, "nested", keys="k")
    only = r.get_arrangement(b, "mapping", keys="k")
    top, by_key = r.group_max("k").split_reduce_output(b)
    none = r.reduce("k", lambda key, g: g.head(0)[["v"]], schema="v BIGINT").reduce_output(b)
    run = b.begin()
    own.insert_all(run, [("b", 2), ("a", 1)])
    run.commit()
    assert mapping.to_dict(run) == {("a",): (1,), ("b",): (2,)} and ones.to_dict(run) == {("a", 1): 1, ("b", 2): 1}
    assert [tuple(x) for x in ordered.read(run).collect()] == [("a", 1, 1), ("b", 2, 1)]
    assert {x["k"]: {k[0]: w for k, w in x["contents"].items()} for x in nested.read(run).collect()} == {"a": {1: 1}, "b": {2: 1}}
    assert {tuple(x) for x in only.read(run).collect()} == {("a", 1), ("b", 2)}
    assert {x["k"]: {k[0]: w for k, w in x["contents"].items()} for x in by_key.read(run).collect()} == {"a": {1: 1}, "b": {2: 1}}
    assert {x["k"]: x["contents"] for x in none.read(run).collect()} == {"a": {}, "b": {}}
    own.insert(run, ("a", 7))
    own.insert(run, ("b", 2))
    run.commit()
    for out in (mapping, ones, only):
        with pytest.raises(Exception, match="exactly one value|Not a one"):
            out.read(run).collect()


def test_nested_of_any_depth(spark):
    """Maps of maps, and sorted arrays of sorted arrays; one exchange for all levels."""
    b = Builder(spark)
    own, r = b.create_input("k STRING, l INT, m INT")
    deep, one = r.get_arrangement(b, "nested", keys=[["k"], ["l"]]), r.get_arrangement(b, "nested", keys=["k", "l"])
    ordered, whole = r.get_arrangement(b, "nested_ordered", keys=[["k"], ["l"]]), r.get_arrangement(b, "nested", keys=[["k"], ["l"], ["m"]])
    run = b.begin()
    own.insert_all(run, [("b", 2, 9), ("a", 2, 1), ("a", 1, 5), ("a", 2, 0), ("a", 2, 0)])
    run.commit()
    assert {x["k"]: {l[0]: {m[0]: w for m, w in c.items()} for l, c in x["contents"].items()} for x in deep.read(run).collect()} == {"a": {1: {5: 1}, 2: {1: 1, 0: 2}}, "b": {2: {9: 1}}}
    assert {(x["k"], x["l"]): {m[0]: w for m, w in x["contents"].items()} for x in one.read(run).collect()} == {("a", 1): {5: 1}, ("a", 2): {1: 1, 0: 2}, ("b", 2): {9: 1}}
    assert [(x["k"], [(e["key"]["l"], [(f["key"]["m"], f["contents"]) for f in e["contents"]]) for e in x["contents"]]) for x in ordered.read(run).collect()] == [("a", [(1, [(5, 1)]), (2, [(0, 2), (1, 1)])]), ("b", [(2, [(9, 1)])])]
    assert {x["k"]: {l[0]: {m[0]: list(c2.values()) for m, c2 in c.items()} for l, c in x["contents"].items()} for x in whole.read(run).collect()} == {"a": {1: {5: [1]}, 2: {1: [1], 0: [2]}}, "b": {2: {9: [1]}}}
    with pytest.raises(ValueError):
        Builder(spark).create_input("k INT")[1].get_arrangement(b, "nested", keys=[["k"], ["k"]])


def test_reduces_to_containers(spark, mode):
    from zedweave.functions.maps import OptionMap, SingletonMap, VecMap

    kv, rows = "k STRING, v BIGINT", [(("a", 1), 2), (("a", 3), 1), (("b", 2), 1)]
    of = lambda fn: once(spark, kv, rows, lambda r: r.reduce("k", fn, schema="v BIGINT"), mode)
    assert of(lambda key, g: SingletonMap(int(g["v"].sum()))) == {("a", 4): 1, ("b", 2): 1}
    assert of(lambda key, g: OptionMap(7, 5) if len(g) > 1 else OptionMap()) == {("a", 7): 5}
    assert of(lambda key, g: VecMap((int(v), int(w)) for v, w in zip(g["v"], g["_w"]))) == {("a", 1): 2, ("a", 3): 1, ("b", 2): 1}
    assert of(lambda key, g: {(9,): 2}) == {("a", 9): 2, ("b", 9): 2}
    with pytest.raises(Exception, match="Duplicate keys"):
        of(lambda key, g: VecMap([(1, 1), (1, 1)]))


def test_python_functions(spark, mode):
    kv = "k STRING, v BIGINT"
    rows = [(("a", 1), 2), (("b", 2), 1)]
    assert once(spark, kv, rows, lambda r: r.map(lambda x: (x["v"] * 10,), schema="v BIGINT"), mode) == {(10,): 2, (20,): 1}
    assert once(spark, kv, rows, lambda r: r.flat_map(lambda x: [(x["v"], i) for i in range(x["v"])], schema="v BIGINT, i BIGINT"), mode) == {(1, 0): 2, (2, 0): 1, (2, 1): 1}
    assert once(spark, kv, rows, lambda r: r.filter(lambda x: x["k"] == "a"), mode) == {("a", 1): 2}
    assert once(spark, kv, rows, lambda r: r.flat_map_dr(lambda x, w: [((x["k"],), w * x["v"])], schema="k STRING"), mode) == {("a",): 2, ("b",): 2}
    assert once(spark, kv, rows, lambda r: r.flat_map("array(v, v + 1)", "k", name="i"), mode) == {("a", 1): 2, ("a", 2): 2, ("b", 2): 1, ("b", 3): 1}


def test_sums_in_weights(spark, mode):
    from zedweave.functions.weights import count_and_sum, sum_by_weight

    rows = [(("g", 5), 1), (("g", -5), 1), (("h", 4), 3)]
    assert once(spark, "g STRING, v BIGINT", rows, lambda r: sum_by_weight(r, ["g"], "v"), mode) == {("h", 12): 1}
    assert once(spark, "g STRING, v BIGINT", rows, lambda r: count_and_sum(r, ["g"], "v"), mode) == {("g", 2, 0): 1, ("h", 3, 12): 1}


def test_dot_and_messages(spark):
    import io

    b = Builder(spark)
    own, r = b.create_input("x BIGINT")
    out = r.named("numbers").hmap(x="x + 1").distinct().op_named("unique").get_arrangement(b)
    run = b.begin("delta", count_messages=True)
    own.insert_all(run, [1, 2, 3])
    run.commit()
    assert len(out.to_dict(run)) == 3
    w = io.StringIO()
    run.dump_dot(w)
    assert "numbers\\ninput\\n3" in w.getvalue() and "unique\\n3" in w.getvalue() and "map" not in w.getvalue() and "n0 -> n2" in w.getvalue()
    with pytest.raises(ValueError):
        r.concat(r).hidden() if not b.frozen else r.hidden()


def test_key_types(spark):
    b = Builder(spark)
    _, r = b.create_input("x DOUBLE, y BIGINT")
    with pytest.raises(TypeError):
        r.group_min("x")
    with pytest.raises(ValueError):
        r.join(r, "x2")
    with pytest.raises(ValueError):
        r.join(r, "y")


def test_containers():
    from zedweave.functions.maps import OptionMap, VecMap, assert_ones

    assert list(OptionMap().items()) == [] and list(OptionMap("a", 1).items()) == [("a", 1)]
    assert list(VecMap([(2, 1), (1, 1)]).items()) == [(1, 1), (2, 1)] and list(assert_ones({"a": 1})) == ["a"]
    with pytest.raises(ValueError, match="Duplicate keys"):
        VecMap([(1, 1), (1, 2)])
    with pytest.raises(ValueError, match="Not a one"):
        list(assert_ones({"a": 2}))
