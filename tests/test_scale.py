"""What keeps the work of large tables in proportion to them; results stay the same."""

import random

import pytest

from tests.model import triangles
from zedweave import Builder
from zedweave.plans import nodes


def edges(n, left, right, seed):
    r = random.Random(seed)
    return list({(r.randrange(left), r.randrange(right)) for _ in range(n)})


@pytest.mark.parametrize("mode", ["snapshot", "delta"])
@pytest.mark.parametrize("hub", [False, True])
def test_triangles_by_the_vertex_of_fewest_wedges(spark, monkeypatch, mode, hub):
    """x and y have many edges, z few, but for a hub; so wedges are made at z."""
    monkeypatch.setattr(nodes, "MANY_EDGES", 0)
    monkeypatch.setattr(nodes, "HEAVY", 4)
    places, apart, by_vertex, by_edge = [], [], nodes.Triangles.closed, nodes.Triangles.by_edge
    monkeypatch.setattr(nodes.Triangles, "closed", staticmethod(lambda a, b, c, at: places.append(at) or by_vertex(a, b, c, at)))
    monkeypatch.setattr(nodes.Triangles, "by_edge", staticmethod(lambda *a: apart.append(a[-1]) or by_edge(*a)))
    xy, xz, yz = edges(150, 8, 10, 1), edges(300, 8, 120, 2), edges(300, 10, 120, 3)
    if hub:
        xz, yz = xz + [(x, 500) for x in range(100, 118)] + [(x, 500) for x in range(8)], yz + [(y, 500) for y in range(26)]
    b = Builder(spark)
    ins = [b.create_input(f"{p} INT, {q} INT") for p, q in ("ab", "cd", "ef")]
    out = ins[0][1].triangles(ins[1][1], ins[2][1]).get_arrangement(b)
    run = b.begin(mode)

    def read():
        return sorted(map(tuple, out.read(run).collect()))

    for (i, _), rows in zip(ins, (xy, xz, yz)):
        i.insert_all(run, rows)
    run.commit()
    ones = lambda rows: dict.fromkeys(rows, 1)
    assert read() == sorted((*k, w) for k, w in triangles(*map(ones, (xy, xz, yz))).items())
    assert set(places) == {"z"} and bool(apart) == hub
    gone = yz[::3]
    for e in gone:
        ins[2][0].delete(run, e)
    run.commit()
    assert read() == sorted((*k, w) for k, w in triangles(*map(ones, (xy, xz, [e for e in yz if e not in set(gone)]))).items())


@pytest.mark.parametrize("mode", ["snapshot", "delta"])
@pytest.mark.parametrize("odd", ["", "hub", "nulls"])
def test_wedges_of_many_edges_are_closed_by_hashing(spark, monkeypatch, mode, odd):
    """The tasks of large triangles go by the edges and not by the session's partitions, and wedges aren't sorted."""
    for name, n in {"MANY_EDGES": 0, "HEAVY": 4, "MANY_HASHED": 0, "HASHED": 8, "SORTED": 40}.items():
        monkeypatch.setattr(nodes, name, n)
    apart, by_edge = [], nodes.Triangles.by_edge
    monkeypatch.setattr(nodes.Triangles, "by_edge", staticmethod(lambda *a: apart.append(a[-1]) or by_edge(*a)))
    xy, xz, yz = edges(150, 8, 10, 1), edges(300, 8, 120, 2), edges(300, 10, 120, 3)
    if odd == "hub":  # few edges of one side, so that only their product is large
        xy, xz, yz = edges(900, 30, 20, 1), xz + [(x, 500) for x in range(2)], yz + [(y, 500) for y in range(900)]
    if odd == "nulls":
        xy, xz, yz = xy + [(None, 1), (None, None)], xz + [(None, 500)], yz + [(None, 500), (1, 500)]
    b = Builder(spark)
    ins = [b.create_input(f"{p} INT, {q} INT") for p, q in ("ab", "cd", "ef")]
    relations = [r.distinct() for _, r in ins]
    out = relations[0].triangles(*relations[1:]).get_arrangement(b)
    run = b.begin(mode)
    order = lambda rows: sorted(rows, key=repr)
    read = lambda: order(map(tuple, out.read(run).collect()))
    for (i, _), rows in zip(ins, (xy, xz, yz)):
        i.insert_all(run, rows + rows[:5])
    run.commit()
    ones = lambda rows: dict.fromkeys(rows, 1)
    assert read() == order((*k, w) for k, w in triangles(*map(ones, (xy, xz, yz))).items())
    assert bool(apart) == (odd == "hub")
    if mode == "snapshot" and not odd:
        plan = out.read(run)._jdf.queryExecution().executedPlan().toString()
        tasks = -(-len(xy) // 8)
        assert "ShuffledHashJoin" in plan and f"{tasks}), REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
    gone = yz[5::3]
    for e in gone:
        ins[2][0].delete(run, e)
    run.commit()
    assert read() == order((*k, w) for k, w in triangles(*map(ones, (xy, xz, [e for e in yz if e not in set(gone)]))).items())


def test_large_closures_are_not_shuffled_by_round(spark, monkeypatch):
    """A distinct that has grown large finds rows that it holds already through a filter of the new ones, and finds all of them."""
    from zedweave.plans import delta
    from zedweave.queries import _closure

    monkeypatch.setattr(delta, "LARGE", 1)
    used, sieve = [], nodes.sieve
    monkeypatch.setattr(nodes, "sieve", lambda *a: used.append(a[1]) or sieve(*a))
    b = Builder(spark)
    target, edges = b.create_input("s BIGINT, d BIGINT")
    out = _closure(b, edges).get_arrangement(b)
    run = b.begin("delta")
    pairs = [(i, i // 2) for i in range(1, 40)]

    def closure(pairs):
        known, more = set(), set(pairs)
        while more:
            known |= more
            more = {(s, e) for s, d in known for x, e in pairs if x == d} - known
        return sorted((s, d, 1) for s, d in known)

    target.insert_all(run, pairs)
    run.commit()
    assert sorted(map(tuple, out.read(run).collect())) == closure(pairs)
    more = [(1, 8), (50, 3), (50, 1)]  # a cycle, and two ways to the same rows
    target.insert_all(run, more)
    run.commit()
    assert sorted(map(tuple, out.read(run).collect())) == closure(pairs + more)
    assert used


def test_tasks_go_by_what_is_read(spark, monkeypatch):
    """Jobs of a recursion over large tables have more tasks, by the session's settings only while they run."""
    from zedweave.plans import store
    from zedweave.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = lambda: sorted(map(tuple, QUERIES["distances_cyclic"](spark, folder).collect()))
    names = ["spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    settings = lambda: [spark.conf.get(n) for n in names]
    want, was, inside, spread = rows(), settings(), [], store.spread
    monkeypatch.setattr(store, "MANY", 1)
    monkeypatch.setattr(store, "A_PARTITION", 1 << 12)

    @store.contextmanager
    def looked_at(df):
        with spread(df):
            inside.append(settings())
            yield

    monkeypatch.setattr(store, "spread", looked_at)
    assert rows() == want
    assert max(int(s[0]) for s in inside) > 3 and all(s[1] == s[2] == str(store.A_TASK) for s in inside if s != was)
    assert settings() == was
    with pytest.raises(ZeroDivisionError), spread(spark.read.parquet(f"{folder}/lineitem.parquet")):
        assert settings() != was
        raise ZeroDivisionError
    assert settings() == was


def test_growing_logs_are_not_written_again(spark, monkeypatch):
    """Rows of a closure that only grows are written once, however long its logs; what is taken back later is merged as ever."""
    from zedweave.plans import delta, fixpoint
    from zedweave.plans.store import Store
    from zedweave.queries import _closure

    wrote, watched = [], Store.watched
    monkeypatch.setattr(Store, "watched", lambda self, df, w: (out := watched(self, df, w), wrote.append(out._zedweave_rows if out else 0))[0])
    chain = [(i, i + 1) for i in range(10)]

    def sums(long):
        for module in (delta, fixpoint):
            monkeypatch.setattr(module, "LONG", long)
        wrote.clear()
        b = Builder(spark)
        target, edges = b.create_input("s BIGINT, d BIGINT")
        out = _closure(b, edges).get_arrangement(b)
        run = b.begin("delta")
        target.insert_all(run, chain)
        run.commit()
        assert sorted(map(tuple, out.read(run).collect())) == [(i, j, 1) for i in range(11) for j in range(i + 1, 11)]
        made = sum(wrote)
        target.delete(run, (4, 5))
        run.commit()
        assert sorted(map(tuple, out.read(run).collect())) == [(i, j, 1) for i in range(11) for j in range(i + 1, 11) if i > 4 or j < 5]
        return made

    assert sums(4) == sums(100)
