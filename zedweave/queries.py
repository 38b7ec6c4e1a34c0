"""Queries over the driver's tables, one or more for each operator, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zedweave.functions.weights import count_and_sum, sum_by_weight
from zedweave.operators.relation import Relation
from zedweave.plans.context import Builder
from zedweave.sources.frames import stream_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """A builder's relations over a folder of tables, whose rows don't repeat."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.build = spark, folder, Builder(spark)

    def frame(self, name: str, *columns: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.select(*columns) if columns else df

    def of(self, name: str, *columns: str, unique: bool = False) -> Relation:
        """The columns of a table; unique: they hold its key."""
        return self.build.from_frame(self.frame(name, *columns), unique=unique)

    def read(self, relation: Relation, weight: str | None = None, mode: str = "snapshot") -> DataFrame:
        """Plain rows, or distinct rows with their weight as a column."""
        out = relation.get_arrangement(self.build)
        run = self.build.begin(mode)
        return out.rows(run) if weight is None else out.read(run).withColumnRenamed("_w", weight)


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    def named(fn: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        QUERIES[fn.__name__] = run
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return run

    return named


@query("""SELECT DISTINCT c_nationkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey
UNION SELECT DISTINCT c_nationkey, c_mktsegment FROM customer""")
def flagship(t: Tables) -> DataFrame:
    customer = t.of("customer", "c_custkey", "c_nationkey", "c_mktsegment", unique=True)
    joined = t.of("orders", "o_custkey", "o_orderpriority").join(customer, [("o_custkey", "c_custkey")])
    return t.read(joined.map("c_nationkey", "o_orderpriority").concat(customer.map("c_nationkey", o_orderpriority="c_mktsegment")).distinct())


@query("SELECT o_orderkey + 1 AS k FROM orders")
def map(t: Tables) -> DataFrame:
    return t.read(t.of("orders", "o_orderkey", unique=True).map(k="o_orderkey + 1"))


@query("SELECT o_orderkey + 1 AS k FROM orders")
def hmap(t: Tables) -> DataFrame:
    return t.read(t.of("orders", "o_orderkey", unique=True).hmap(k="o_orderkey + 1"))


@query("SELECT doc_id, unnest(string_split(source, 'c')) AS tok FROM documents")
def flat_map(t: Tables) -> DataFrame:
    return t.read(t.of("documents", "doc_id", "source").flat_map("split(source, 'c')", "doc_id", name="tok"))


@query("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS w FROM lineitem GROUP BY 1")
def flat_map_dr(t: Tables) -> DataFrame:
    items = "array(named_struct('l_returnflag', l_returnflag, '_w', cast(l_quantity as bigint) * _w))"
    return t.read(t.of("lineitem", "l_returnflag", "l_quantity").flat_map_dr(items), weight="w")


@query("SELECT c_custkey, c_name || '!' AS name FROM customer WHERE c_nationkey < 5")
def python_functions(t: Tables) -> DataFrame:
    few = t.of("customer", "c_custkey", "c_name", "c_nationkey").filter(lambda r: r["c_nationkey"] < 5)
    return t.read(few.map(lambda r: (r["c_custkey"], r["c_name"] + "!"), schema="c_custkey BIGINT, name STRING"))


@query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def filter(t: Tables) -> DataFrame:
    return t.read(t.of("orders", unique=True).filter("o_orderstatus = 'F'"))


@query("SELECT c_nationkey, CAST(3 * count(*) AS BIGINT) AS w FROM customer GROUP BY 1")
def map_r(t: Tables) -> DataFrame:
    return t.read(t.of("customer", "c_nationkey").map_r("_w * 3"), weight="w")


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS w FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def negate_cancel(t: Tables) -> DataFrame:
    orders = t.of("orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return t.read(orders.concat(orders.filter("o_orderstatus = 'F'").negate()).map("o_custkey"), weight="w")


@query("SELECT n_nationkey AS k FROM nation UNION ALL SELECT c_nationkey FROM customer")
def concat(t: Tables) -> DataFrame:
    return t.read(t.of("nation", "n_nationkey").rename(n_nationkey="k").concat(t.of("customer", "c_nationkey").rename(c_nationkey="k")))


@query("SELECT c_nationkey, CAST(count(*) AS BIGINT) AS w FROM customer GROUP BY 1")
def consolidate(t: Tables) -> DataFrame:
    return t.read(t.of("customer", "c_nationkey").consolidate(), weight="w")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join(t: Tables) -> DataFrame:
    joined = t.of("orders", "o_custkey", "o_orderkey").join(t.of("customer", "c_custkey", "c_name", unique=True), [("o_custkey", "c_custkey")])
    return t.read(joined.map("o_orderkey", "c_name"))


@query("""SELECT a.k, CAST(a.w * b.w AS BIGINT) AS w FROM (SELECT c_nationkey k, count(*) w FROM customer GROUP BY 1) a
JOIN (SELECT s_nationkey k, count(*) w FROM supplier GROUP BY 1) b ON a.k = b.k""")
def join_weights(t: Tables) -> DataFrame:
    left, right = t.of("customer", "c_nationkey").consolidate(), t.of("supplier", "s_nationkey").consolidate()
    return t.read(left.join(right, [("c_nationkey", "s_nationkey")]).rename(c_nationkey="k"), weight="w")


@query("SELECT c_custkey, CAST(count(*) AS BIGINT) AS w FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def semijoin_multiplies(t: Tables) -> DataFrame:
    return t.read(t.of("customer", "c_custkey", unique=True).semijoin(t.of("orders", "o_custkey").consolidate(), [("c_custkey", "o_custkey")]), weight="w")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semijoin_on_fst(t: Tables) -> DataFrame:
    pending = t.of("orders", "o_custkey", "o_orderstatus").filter("o_orderstatus = 'P'").map("o_custkey").distinct()
    return t.read(t.of("customer", "c_custkey", "c_name", unique=True).semijoin_on_fst(pending))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def semijoin_on_snd(t: Tables) -> DataFrame:
    some = t.of("nation", "n_nationkey", "n_regionkey", unique=True).filter("n_regionkey = 1").map("n_nationkey", injective=True)
    return t.read(t.of("customer", "c_custkey", "c_nationkey", unique=True).semijoin_on_snd(some))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 25 IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def semijoin_on(t: Tables) -> DataFrame:
    some = t.of("nation", "n_nationkey", "n_regionkey", unique=True).filter("n_regionkey = 2").map("n_nationkey", injective=True)
    return t.read(t.of("customer", "c_custkey", unique=True).semijoin_on(some, "cast(c_custkey % 25 as int)"))


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F')")
def antijoin(t: Tables) -> DataFrame:
    fulfilled = t.of("orders", "o_custkey", "o_orderstatus").filter("o_orderstatus = 'F'")
    return t.read(t.of("customer", "c_custkey", unique=True).antijoin(fulfilled, [("c_custkey", "o_custkey")]))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def antijoin_on_fst(t: Tables) -> DataFrame:
    return t.read(t.of("customer", "c_custkey", "c_name", unique=True).antijoin_on_fst(t.of("orders", "o_custkey", "o_orderstatus").filter("o_orderstatus = 'P'").map("o_custkey")))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def antijoin_on_snd(t: Tables) -> DataFrame:
    few = t.of("supplier", "s_acctbal", "s_nationkey").filter("s_acctbal < 0").map("s_nationkey")
    return t.read(t.of("customer", "c_custkey", "c_nationkey", unique=True).antijoin_on_snd(few))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 25 NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def antijoin_on(t: Tables) -> DataFrame:
    some = t.of("nation", "n_nationkey", "n_regionkey", unique=True).filter("n_regionkey = 2").map("n_nationkey", injective=True)
    return t.read(t.of("customer", "c_custkey", unique=True).antijoin_on(some, "cast(c_custkey % 25 as int)"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def left_join(t: Tables) -> DataFrame:
    return t.read(t.of("customer", "c_custkey", unique=True).left_join(t.of("orders", "o_custkey", "o_orderkey", unique=True), [("c_custkey", "o_custkey")]))


@query("SELECT c_nationkey, CAST(count(*) AS BIGINT) AS w FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) GROUP BY 1")
def set_minus_keeps_multiplicity(t: Tables) -> DataFrame:
    other = t.of("nation", "n_nationkey", "n_regionkey").filter("n_regionkey = 0").map(c_nationkey="n_nationkey")
    return t.read(t.of("customer", "c_nationkey").set_minus(other), weight="w")


@query("""SELECT c_nationkey AS k, CAST(c.w * s.w AS BIGINT) AS w FROM (SELECT c_nationkey, count(*) w FROM customer GROUP BY 1) c
JOIN (SELECT s_nationkey, count(*) w FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey""")
def intersection_product(t: Tables) -> DataFrame:
    left, right = t.of("customer", "c_nationkey").map(k="c_nationkey").consolidate(), t.of("supplier", "s_nationkey").map(k="s_nationkey").consolidate()
    return t.read(left.intersection(right), weight="w")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(t: Tables) -> DataFrame:
    return t.read(t.of("lineitem", "l_returnflag", "l_linestatus").distinct())


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS cnt FROM events GROUP BY 1")
def counts(t: Tables) -> DataFrame:
    return t.read(t.of("events", "event_type").counts())


@query("SELECT c_custkey AS user_id, CAST(count(e.event_id) AS BIGINT) AS cnt FROM customer LEFT JOIN events e ON e.user_id = c_custkey GROUP BY 1")
def histogram(t: Tables) -> DataFrame:
    users = t.of("customer", "c_custkey", unique=True).rename(c_custkey="user_id")
    return t.read(t.of("events", "user_id").consolidate().histogram(users))


@query("SELECT k AS user_id, CAST(count(*) - 1 AS BIGINT) AS cnt FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT user_id FROM events) GROUP BY 1")
def hist_including(t: Tables) -> DataFrame:
    return t.read(t.of("events", "user_id").hist_including(t.of("customer", "c_custkey", unique=True).rename(c_custkey="user_id")))


@query("SELECT o_custkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def group_min(t: Tables) -> DataFrame:
    return t.read(t.of("orders", "o_custkey", "o_orderdate").group_min("o_custkey"))


@query("SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def group_max(t: Tables) -> DataFrame:
    return t.read(t.of("orders", "o_custkey", "o_orderdate").group_max("o_custkey"))


@query("SELECT l_returnflag, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1")
def sum_in_weight(t: Tables) -> DataFrame:
    return t.read(sum_by_weight(t.of("lineitem", "l_returnflag", "l_extendedprice"), ["l_returnflag"], "cast(round(l_extendedprice * 100) as bigint)", "cents"))


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1")
def custom_weight(t: Tables) -> DataFrame:
    return t.read(count_and_sum(t.of("lineitem", "l_returnflag", "l_extendedprice"), ["l_returnflag"], "cast(round(l_extendedprice * 100) as bigint)", "n", "cents"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, max(o_orderkey) AS last FROM orders GROUP BY 1")
def reduce(t: Tables) -> DataFrame:
    orders = t.of("orders", "o_orderkey", "o_custkey", "o_totalprice", unique=True)
    return t.read(orders.reduce("o_custkey", n="sum(_w)", cents="sum(cast(round(o_totalprice * 100) as bigint) * _w)", last="max(o_orderkey)", merged=False))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) rn FROM orders) WHERE rn <= 2")
def reduce_top2(t: Tables) -> DataFrame:
    return t.read(t.of("orders", "o_custkey", "o_orderkey", unique=True).group_top_k("o_custkey", 2, F.desc("o_orderkey")))


@query("SELECT c_nationkey, CAST(median AS BIGINT) AS middle FROM (SELECT c_nationkey, quantile_disc(c_custkey, 0.5) AS median FROM customer GROUP BY 1)")
def reduce_python(t: Tables) -> DataFrame:
    def middle(key, rows):
        own = rows["c_custkey"].sort_values()
        return own.iloc[[(len(own) - 1) // 2]].rename("middle").to_frame()

    return t.read(t.of("customer", "c_nationkey", "c_custkey", unique=True).reduce("c_nationkey", middle, schema="middle BIGINT"))


#: Suppliers, parts and orders of which each two meet in a line.
_TRIANGLES = """WITH l AS (SELECT * FROM lineitem WHERE {0})
SELECT xy.x, xy.y, xz.z FROM (SELECT DISTINCT l_suppkey x, l_partkey y FROM l) xy JOIN (SELECT DISTINCT l_partkey y, l_orderkey z FROM l) yz ON yz.y = xy.y
JOIN (SELECT DISTINCT l_suppkey x, l_orderkey z FROM l) xz ON xy.x = xz.x AND yz.z = xz.z"""


def _triangles(items: Relation) -> Relation:
    xy, xz, yz = items.map(x="l_suppkey", y="l_partkey"), items.map(x="l_suppkey", z="l_orderkey"), items.map(y="l_partkey", z="l_orderkey")
    return xy.distinct().triangles(xz.distinct(), yz.distinct())


@query(_TRIANGLES.format("true"))
def triangles(t: Tables) -> DataFrame:
    return t.read(_triangles(t.of("lineitem", "l_orderkey", "l_partkey", "l_suppkey")))


@query("SELECT n_nationkey, n_name FROM nation")
def assert_1to1(t: Tables) -> DataFrame:
    _, mapping = t.of("nation", "n_nationkey", "n_name").assert_1to1_with_output("n_nationkey", t.build)
    return mapping.read(t.build.begin())


@query("SELECT s_suppkey, s_name FROM supplier")
def assert_ones(t: Tables) -> DataFrame:
    return t.read(t.of("supplier", "s_suppkey", "s_name").assert_ones())


@query("SELECT c_nationkey, CAST(count(*) AS BIGINT) AS kinds, CAST(sum(n) AS BIGINT) AS customers FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def nested_arrangement(t: Tables) -> DataFrame:
    out = t.of("customer", "c_nationkey", "c_mktsegment").get_arrangement(t.build, "nested", keys="c_nationkey")
    df = out.read(t.build.begin())
    return df.select("c_nationkey", F.size("contents").cast("bigint").alias("kinds"), F.aggregate(F.map_values("contents"), F.lit(0).cast("bigint"), lambda a, w: a + w).alias("customers"))


@query("SELECT n_regionkey, n_nationkey, CAST(1 AS BIGINT) AS w FROM nation")
def ordered_arrangement(t: Tables) -> DataFrame:
    return t.of("nation", "n_regionkey", "n_nationkey").get_arrangement(t.build, "ordered").read(t.build.begin()).withColumnRenamed("_w", "w")


@query("SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1")
def reduce_output(t: Tables) -> DataFrame:
    relation, out = t.of("orders", "o_custkey", "o_orderkey").group_max("o_custkey").split_reduce_output(t.build)
    return out.read(t.build.begin()).select("o_custkey", F.map_keys("contents")[0]["o_orderkey"].alias("last"))


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS cnt FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, CAST(count(*) AS BIGINT) FROM orders GROUP BY 1")
def split(t: Tables) -> DataFrame:
    orders = t.of("orders", "o_orderstatus", "o_orderpriority").split()
    both = orders.map(o_orderstatus="o_orderstatus").counts().concat(orders.map(o_orderstatus="o_orderpriority").counts())
    return t.read(both)


def _closure(build: Builder, edges: Relation) -> Relation:
    scope = build.subgraph()
    handle, v = scope.variable("s BIGINT, d BIGINT")
    inside = edges.enter(scope)
    body = inside.concat(v.join(inside.rename(s="m", d="t"), [("d", "m")]).map("s", d="t")).distinct()
    handle.set(body)
    return body.leave(scope.finish())


@query("""WITH RECURSIVE e AS (SELECT p_partkey s, p_partkey // 2 d FROM part WHERE p_partkey > 0),
c(s, d) AS (SELECT s, d FROM e UNION SELECT c.s, e.d FROM c JOIN e ON c.d = e.s) SELECT s, d FROM c""")
def closure_tree(t: Tables) -> DataFrame:
    edges = t.of("part", "p_partkey", unique=True).filter("p_partkey > 0").map(s="p_partkey", d="p_partkey div 2", injective=True)
    return t.read(_closure(t.build, edges))


#: Regions, nations, customers, suppliers and orders as the nodes of a graph; its edges go both ways, so that it has many cycles.
_EDGES = """SELECT n_regionkey AS a, 10 + n_nationkey AS b FROM nation UNION SELECT 10 + c_nationkey, 10000000000 + c_custkey FROM customer
UNION SELECT 10 + s_nationkey, 20000000000 + s_suppkey FROM supplier UNION SELECT 10000000000 + o_custkey, 30000000000 + o_orderkey FROM orders
UNION SELECT 20000000000 + l_suppkey, 30000000000 + l_orderkey FROM lineitem"""


def _graph(t: Tables) -> Relation:
    pair = lambda table, a, b, a0, b0, **of: t.of(table, a, b).map(s=f"{a0}L + {a}", d=f"{b0}L + {b}")
    one = pair("nation", "n_regionkey", "n_nationkey", 0, 10).concat(pair("customer", "c_nationkey", "c_custkey", 10, 10**10)).concat(pair("supplier", "s_nationkey", "s_suppkey", 10, 2 * 10**10))
    one = one.concat(pair("orders", "o_custkey", "o_orderkey", 10**10, 3 * 10**10)).concat(pair("lineitem", "l_suppkey", "l_orderkey", 2 * 10**10, 3 * 10**10))
    return one.concat(one.map(s="d", d="s")).distinct()


@query(f"""WITH RECURSIVE g AS ({_EDGES}), e AS (SELECT CAST(a AS BIGINT) AS s, CAST(b AS BIGINT) AS d FROM g UNION SELECT b, a FROM g),
c(s, d, n) USING KEY (s, d) AS (SELECT e.s, e.d, CAST(1 AS BIGINT) FROM e JOIN region ON e.s = r_regionkey
UNION SELECT c.s, e.d, min(c.n) + 1 FROM c JOIN e ON c.d = e.s WHERE NOT EXISTS (SELECT 1 FROM recurring.c AS r WHERE r.s = c.s AND r.d = e.d) GROUP BY c.s, e.d)
SELECT s, d, n FROM c""")
def distances_cyclic(t: Tables) -> DataFrame:
    """The distances of all nodes of a graph of whole tables from each region."""
    edges, regions = _graph(t), t.of("region", "r_regionkey", unique=True).map(s="cast(r_regionkey as bigint)", injective=True)
    scope = t.build.subgraph(tier="n")
    handle, v = scope.variable("s BIGINT, d BIGINT, n BIGINT")
    inside = edges.enter(scope)
    start = inside.semijoin(regions.enter(scope), "s").with_columns(n="1L")
    step = v.join(inside.rename(s="m", d="t"), [("d", "m")]).map("s", d="t", n="n + 1")
    body = start.concat(step).group_min(["s", "d"])
    handle.set(body)
    return t.read(body.leave(scope.finish()))


@query("SELECT c_nationkey, CAST(count(*) AS BIGINT) AS cnt FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' GROUP BY 1")
def incremental_delete(t: Tables) -> DataFrame:
    """All orders, then those of status F taken back; maintained by the changes."""
    return _in_two_steps(t, "delta")


@query("SELECT c_nationkey, CAST(count(*) AS BIGINT) AS cnt FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' GROUP BY 1")
def snapshot_delete(t: Tables) -> DataFrame:
    return _in_two_steps(t, "snapshot")


def _in_two_steps(t: Tables, mode: str) -> DataFrame:
    target, orders = t.build.create_input("o_orderkey BIGINT, o_custkey BIGINT")
    customer = t.of("customer", "c_custkey", "c_nationkey", unique=True)
    out = orders.join(customer, [("o_custkey", "c_custkey")]).map("c_nationkey").counts().get_arrangement(t.build)
    run = t.build.begin(mode)
    table = t.frame("orders", "o_orderkey", "o_custkey", "o_orderstatus")
    target.insert_df(run, table)
    run.commit()
    out.read(run)
    target.delete_df(run, table.where("o_orderstatus = 'F'"))
    run.commit()
    return out.rows(run)


@query("SELECT event_type, min(user_id) AS user_id FROM events WHERE value >= 5 GROUP BY 1")
def incremental_min(t: Tables) -> DataFrame:
    """A minimum under retractions."""
    target, events = t.build.create_input("event_id BIGINT, event_type STRING, user_id BIGINT")
    out = events.map("event_type", "user_id").group_min("event_type")
    table = t.frame("events", "event_id", "event_type", "user_id", "value")
    return _maintained(t, out, [(target, table, None)], [(target, None, table.where("value < 5"))])


def _maintained(t: Tables, relation: Relation, *steps: list) -> DataFrame:
    """A relation read after each step and at the end, maintained by the changes. A step: (input, insertions, deletions) ..."""
    out = relation.get_arrangement(t.build)
    run = t.build.begin("delta")
    for step in steps:
        for target, more, less in step:
            if more is not None:
                target.insert_df(run, more)
            if less is not None:
                target.delete_df(run, less)
        run.commit()
        out.read(run)
    return out.rows(run)


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')")
def incremental_antijoin(t: Tables) -> DataFrame:
    """Rows come back when the last order that excluded them goes."""
    target, orders = t.build.create_input("o_orderkey BIGINT, o_custkey BIGINT")
    out = t.of("customer", "c_custkey", unique=True).antijoin(orders.map(c_custkey="o_custkey"), "c_custkey")
    table = t.frame("orders", "o_orderkey", "o_custkey", "o_orderpriority")
    return _maintained(t, out, [(target, table, None)], [(target, None, table.where("o_orderpriority <> '1-URGENT'"))])


@query(_TRIANGLES.format("l_returnflag <> 'R'"))
def incremental_triangles(t: Tables) -> DataFrame:
    """Triangles go with the last line that holds one of their edges, and come with the first."""
    columns = "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT"
    target, items = t.build.create_input(columns)
    table = t.frame("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    return _maintained(t, _triangles(items), [(target, table.where("l_returnflag <> 'N'"), None)], [(target, table.where("l_returnflag = 'N'"), table.where("l_returnflag = 'R'"))])


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R'")
def incremental_distinct(t: Tables) -> DataFrame:
    target, items = t.build.create_input("l_partkey BIGINT, l_suppkey BIGINT")
    table = t.frame("lineitem", "l_partkey", "l_suppkey", "l_returnflag")
    return _maintained(t, items.distinct(), [(target, table, None)], [(target, None, table.where("l_returnflag = 'R'"))])


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def incremental_reduce(t: Tables) -> DataFrame:
    target, orders = t.build.create_input("o_custkey BIGINT, o_orderkey BIGINT, o_totalprice DECIMAL(18,2)")
    out = orders.reduce("o_custkey", n="sum(_w)", cents="sum(cast(round(o_totalprice * 100) as bigint) * _w)", merged=False)
    table = t.frame("orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return _maintained(t, out, [(target, table, None)], [(target, None, table.where("o_orderstatus = 'F'"))])


#: The ancestors in the tree of parts of which some aren't there.
_CLOSURE = """WITH RECURSIVE e AS (SELECT p_partkey s, p_partkey // 2 d FROM part WHERE p_partkey > 0 AND {0}),
c(s, d) AS (SELECT s, d FROM e UNION SELECT c.s, e.d FROM c JOIN e ON c.d = e.s) SELECT s, d FROM c"""


def _tree(t: Tables) -> DataFrame:
    return t.frame("part", "p_partkey", "p_size").where("p_partkey > 0").select(F.col("p_partkey").alias("s"), F.expr("p_partkey div 2").alias("d"), "p_size")


@query(_CLOSURE.format("true"))
def incremental_recursion(t: Tables) -> DataFrame:
    """Insertions into a standing closure cost what follows from them."""
    target, edges = t.build.create_input("s BIGINT, d BIGINT")
    return _maintained(t, _closure(t.build, edges), [(target, _tree(t).where("p_size > 1"), None)], [(target, _tree(t).where("p_size = 1"), None)])


@query(_CLOSURE.format("p_size > 1"))
def retracted_recursion(t: Tables) -> DataFrame:
    """Edges of a standing closure are taken back."""
    target, edges = t.build.create_input("s BIGINT, d BIGINT")
    return _maintained(t, _closure(t.build, edges), [(target, _tree(t), None)], [(target, None, _tree(t).where("p_size = 1"))])


@query("""WITH RECURSIVE e AS (SELECT p_partkey s, p_partkey // 2 d FROM part WHERE p_partkey > 0),
c(s, d, n) AS (SELECT s, d, 1 FROM e UNION SELECT c.s, e.d, c.n + 1 FROM c JOIN e ON c.d = e.s) SELECT DISTINCT s, d FROM c WHERE n % 2 = 0""")
def two_variables(t: Tables) -> DataFrame:
    """Paths of odd and of even length, each made from the other's."""
    edges = t.of("part", "p_partkey", unique=True).filter("p_partkey > 0").map(s="p_partkey", d="p_partkey div 2", injective=True)
    scope = t.build.subgraph()
    (set_odd, odd), (set_even, even) = scope.variable("s BIGINT, d BIGINT"), scope.variable("s BIGINT, d BIGINT")
    inside = edges.enter(scope)
    longer = lambda v: v.join(inside.rename(s="m", d="t"), [("d", "m")]).map("s", d="t")
    set_odd.set(inside.concat(longer(even)).distinct())
    own = longer(odd).distinct()
    set_even.set(own)
    return t.read(own.leave(scope.finish()))


@query("""SELECT n_nationkey AS x FROM nation UNION SELECT 100 + r_regionkey FROM region JOIN nation ON n_regionkey = r_regionkey""")
def nested_scopes(t: Tables) -> DataFrame:
    """A scope within a scope: what is reached from all nations, each round's new nodes settled in an inner scope."""
    nation = t.of("nation", "n_nationkey", "n_regionkey", unique=True)
    up, start = nation.map(s="cast(n_nationkey as bigint)", d="100L + n_regionkey"), nation.map(x="cast(n_nationkey as bigint)", injective=True)
    outer = t.build.subgraph()
    handle, v = outer.variable("x BIGINT")
    inner = outer.subgraph()
    set_inner, w = inner.variable("x BIGINT")
    settled = v.enter(inner).concat(w).distinct()
    set_inner.set(settled)
    there = settled.leave(inner.finish())
    body = start.enter(outer).concat(there.join(up.enter(outer), [("x", "s")]).map(x="d")).distinct()
    handle.set(body)
    return t.read(body.leave(outer.finish()))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS cnt FROM events WHERE value > 10 GROUP BY 1")
def streamed_counts(t: Tables) -> DataFrame:
    """The table as a stream, its batches as steps."""
    from zedweave.plans.store import Store
    from zedweave.streaming.driver import StreamDriver

    target, events = t.build.create_input("event_type STRING, value DOUBLE")
    out = events.filter("value > 10").map("event_type").counts().get_arrangement(t.build)
    run = t.build.begin("delta")
    stream = stream_table(t.spark, f"{t.folder}/events.parquet")
    place = Store(t.spark, "stream").path
    StreamDriver(run, f"{place}/log").start(stream.select("event_type", "value"), target, "events", f"{place}/checkpoint").awaitTermination()
    return out.rows(run)
