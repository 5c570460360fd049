"""Queries over the supplied tables, one or more per operator of the engine, and the same in DuckDB SQL.

Every query is a program run over whole tables.  ``G`` is a weighted graph from all orders to the suppliers of their lines, on to
these suppliers' nations, and to the nations' regions; ``TREE`` is the halving tree of part numbers.  The recursive
queries walk them.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import BOT, IGNORE, WITH_ELEMENTS, LVar, Program, bind, call, custom, enumerate_, guard, iterate, lbitset, lmax, lmin, lookup, lset, variables, xrange
from tessera.functions import sets
from tessera.inspect import export_json, json_of
from tessera.program import Relation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Setting:
    """A program over the tables of a folder: ``ext("nation", "n_nationkey", "n_name")`` is a source of some columns."""

    def __init__(self, spark: SparkSession, sf_dir: str, name: str, **options):
        self.p, self.dir = Program(spark, name, **options), sf_dir

    def df(self, table: str) -> DataFrame:
        return self.p.spark.read.parquet(f"{self.dir}/{table}.parquet")

    def ext(self, table: str, *columns: str, name: str | None = None) -> Relation:
        df = self.df(table)
        return self.p.external(df.select(*columns) if columns else df, name or table)

    def graph(self) -> Relation:
        """Edges (u, v, w), a node's number telling its kind (order, supplier, nation, region) by its remainder by 4."""
        node = lambda c, kind: (F.col(c).cast("long") * 4 + kind)
        line = self.df("lineitem").groupBy(node("l_orderkey", 0).alias("u"), node("l_suppkey", 1).alias("v")).agg(F.min(F.round(F.col("l_extendedprice") * 100)).cast("long").alias("w"))
        home = self.df("supplier").select(node("s_suppkey", 1).alias("u"), node("s_nationkey", 2).alias("v"), (F.col("s_suppkey") % 10 + 1).alias("w"))
        part = self.df("nation").select(node("n_nationkey", 2).alias("u"), node("n_regionkey", 3).alias("v"), F.lit(5).cast("long").alias("w"))
        return self.p.external(line.unionAll(home).unionAll(part), "G")

    def tree(self) -> Relation:
        parts = self.df("part").filter("p_partkey > 1").select(F.col("p_partkey").alias("c"), F.expr("p_partkey div 2").alias("p"))
        return self.p.external(parts, "T")

    def sink(self, columns: dict, *body) -> DataFrame:
        self.p.emit("out", columns, *body)
        return self.p.run("out")

    def result(self, *columns: str, **types) -> Relation:
        return self.p.table("H", **{**dict.fromkeys(columns, "long"), **types})


G = """g AS (SELECT l_orderkey * 4 AS u, l_suppkey * 4 + 1 AS v, CAST(min(round(l_extendedprice * 100)) AS BIGINT) AS w FROM lineitem GROUP BY ALL
  UNION ALL SELECT s_suppkey * 4 + 1, s_nationkey::BIGINT * 4 + 2, s_suppkey % 10 + 1 FROM supplier
  UNION ALL SELECT n_nationkey::BIGINT * 4 + 2, n_regionkey::BIGINT * 4 + 3, 5 FROM nation)"""
TREE = "t AS (SELECT p_partkey AS c, p_partkey // 2 AS p FROM part WHERE p_partkey > 1)"
CLOSURE = f"WITH RECURSIVE {G}, r AS (SELECT u, v FROM g UNION SELECT r.u, g.v FROM r JOIN g ON r.v = g.u)"

a, b, c, d, e, k, n, s, u, v, w, x, y, z = variables("a b c d e k n s u v w x y z")


# scans, projections, filters


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_external(spark, sf):
    q = Setting(spark, sf, "scan_external")
    return q.sink({"n_nationkey": a, "n_name": b, "n_regionkey": c}, q.ext("nation")(a, b, c))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
def scan_filtered_source(spark, sf):
    q = Setting(spark, sf, "scan_filtered_source")
    rich = q.p.external(q.df("customer").filter("c_acctbal > 5000").select("c_custkey", "c_acctbal"), "rich")
    return q.sink({"c_custkey": a, "c_acctbal": b}, rich(a, b))


@query("SELECT n_regionkey AS region, n_name AS name FROM nation")
def project_rename(spark, sf):
    q = Setting(spark, sf, "project_rename")
    return q.sink({"region": c, "name": b}, q.ext("nation", "n_nationkey", "n_name", "n_regionkey")(a, b, c))


@query("SELECT c_nationkey AS nation FROM customer")
def wildcard_project(spark, sf):
    q = Setting(spark, sf, "wildcard_project")
    return q.sink({"nation": k}, q.ext("customer")(IGNORE, IGNORE, k, IGNORE, IGNORE))


@query("SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS segment FROM customer")
def distinct_project(spark, sf):
    q = Setting(spark, sf, "distinct_project")
    h = q.p.table("H", nation="int", segment="string")
    q.p.rule(h(k, s), q.ext("customer", "c_nationkey", "c_mktsegment")(k, s))
    return q.p.run(h)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def const_filter(spark, sf):
    q = Setting(spark, sf, "const_filter")
    return q.sink({"l_orderkey": a, "l_linenumber": b}, q.ext("lineitem", "l_orderkey", "l_linenumber", "l_returnflag")(a, b, "R"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > 50000 AND l_quantity < 40")
def guard_filter(spark, sf):
    q = Setting(spark, sf, "guard_filter")
    line = q.ext("lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return q.sink({"l_orderkey": a, "l_linenumber": b, "l_extendedprice": c}, line(a, b, c, d), guard((c > 50000) & (d < 40)))


@query("SELECT l_orderkey, l_linenumber, l_suppkey AS same FROM lineitem WHERE l_suppkey = l_partkey")
def repeated_var(spark, sf):
    q = Setting(spark, sf, "repeated_var")
    return q.sink({"l_orderkey": a, "l_linenumber": b, "same": k}, q.ext("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")(a, b, k, k))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
def bind_expr(spark, sf):
    q = Setting(spark, sf, "bind_expr")
    line = q.ext("lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return q.sink({"l_orderkey": a, "l_linenumber": b, "revenue": e}, line(a, b, c, d), bind(e, c * (1 - d)))


@query("SELECT p_partkey FROM part WHERE p_size = p_partkey % 50 + 1")
def bind_check(spark, sf):
    q = Setting(spark, sf, "bind_check")
    return q.sink({"p_partkey": a}, q.ext("part", "p_partkey", "p_size")(a, b), bind(b, a % 50 + 1))


@query("SELECT n_nationkey, n_regionkey, length(n_name) AS len FROM nation")
def whole_row_struct(spark, sf):
    q = Setting(spark, sf, "whole_row_struct")
    nation = q.ext("nation", "n_nationkey", "n_name", "n_regionkey")
    return q.sink({"n_nationkey": a.field("n_nationkey"), "n_regionkey": k, "len": call(lambda t: F.length(t).cast("long"), a.field("n_name"))}, nation(a, WITH_ELEMENTS, IGNORE, IGNORE, k))


@query("SELECT r_regionkey, r_name, 7 AS seven, 'const' AS word FROM region")
def head_constant(spark, sf):
    q = Setting(spark, sf, "head_constant")
    h = q.p.table("H", r_regionkey="int", r_name="string", seven="int", word="string")
    q.p.rule(h(a, b, 7, "const"), q.ext("region")(a, b))
    return q.p.run(h)


# joins


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_inner(spark, sf):
    q = Setting(spark, sf, "join_inner")
    return q.sink({"c_custkey": a, "n_name": b}, q.ext("customer", "c_custkey", "c_nationkey")(a, k), q.ext("nation", "n_nationkey", "n_name")(k, b))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_multiway(spark, sf):
    q = Setting(spark, sf, "join_multiway")
    nation = q.ext("nation", "n_nationkey", "n_name", "n_regionkey")
    return q.sink({"c_custkey": a, "n_name": b, "r_name": c}, q.ext("customer", "c_custkey", "c_nationkey")(a, k), nation(k, b, n), q.ext("region")(n, c))


@query("SELECT x.r_name AS one, y.r_name AS other FROM region x, region y")
def join_cross(spark, sf):
    q = Setting(spark, sf, "join_cross")
    region = q.ext("region")
    return q.sink({"one": a, "other": b}, region(IGNORE, a), region(IGNORE, b))


@query("SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
def semi_join_point(spark, sf):
    q = Setting(spark, sf, "semi_join_point")
    return q.sink({"n_nationkey": k, "n_name": b}, q.ext("nation", "n_nationkey", "n_name")(k, b), q.ext("supplier", "s_nationkey")(k))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey AND s_nationkey = c_nationkey)")
def anti_join(spark, sf):
    q = Setting(spark, sf, "anti_join")
    return q.sink({"c_custkey": k, "c_nationkey": n}, q.ext("customer", "c_custkey", "c_nationkey")(k, n), ~q.ext("supplier", "s_suppkey", "s_nationkey")(k, n))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def anti_join_wildcard(spark, sf):
    q = Setting(spark, sf, "anti_join_wildcard")
    return q.sink({"o_orderkey": k}, q.ext("orders", "o_orderkey")(k), ~q.ext("lineitem", "l_orderkey", "l_partkey", "l_returnflag")(k, IGNORE, "R"))


@query("SELECT x.c_custkey AS one, y.s_suppkey AS other FROM customer x JOIN supplier y ON x.c_nationkey = y.s_nationkey AND x.c_acctbal < y.s_acctbal")
def theta_join(spark, sf):
    q = Setting(spark, sf, "theta_join")
    one, other = q.ext("customer", "c_custkey", "c_nationkey", "c_acctbal"), q.ext("supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    return q.sink({"one": a, "other": b}, one(a, k, x), other(b, k, y), guard(x < y))


TRADE = """t AS (SELECT s_nationkey AS u, c_nationkey AS v, sum(round(l_extendedprice * 100)::BIGINT)::HUGEINT AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
e AS (SELECT u, v FROM t WHERE w * (SELECT count(*) FROM t) > (SELECT sum(w) FROM t))"""


def trade(q: Setting) -> Relation:
    """Pairs of nations of which one sells to the other for more than pairs do on average, as a table."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("decimal(28,0)")
    sold = q.df("lineitem").join(q.df("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(q.df("customer"), F.col("o_custkey") == F.col("c_custkey")).join(q.df("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sold = sold.groupBy(F.col("s_nationkey").alias("u"), F.col("c_nationkey").alias("v")).agg(F.sum(cents).alias("w"))
    total = sold.agg(F.sum("w").alias("total"), F.count("w").cast("decimal(9,0)").alias("pairs"))
    h = q.p.table("E", u="int", v="int")
    q.p.rule(h(u, v), q.p.external(sold, "sold")(u, v, w), q.p.external(total, "total")(x, n), guard(w * n > x))
    return h


@query(f"WITH {TRADE} SELECT p.u AS a, p.v AS b, q.v AS c FROM e p JOIN e q ON p.v = q.u JOIN e r ON q.v = r.u AND r.v = p.u WHERE p.u <> p.v AND p.v <> q.v AND p.u <> q.v")
def triangle(spark, sf):
    q = Setting(spark, sf, "triangle")
    h = trade(q)
    return q.sink({"a": a, "b": b, "c": c}, h(a, b), h(b, c), guard((a != b) & (b != c) & (a != c)), h(c, a))


@query(f"WITH {TRADE} SELECT p.u AS a, p.v AS b, q.v AS c FROM e p JOIN e q ON p.v = q.u WHERE p.u <> p.v AND p.v <> q.v AND p.u <> q.v AND NOT EXISTS (SELECT 1 FROM e r WHERE r.u = q.v AND r.v = p.u)")
def almost_triangle(spark, sf):
    q = Setting(spark, sf, "almost_triangle")
    h = trade(q)
    return q.sink({"a": a, "b": b, "c": c}, h(a, b), h(b, c), guard((a != b) & (b != c) & (a != c)), ~h(c, a))


# set operations


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_rules(spark, sf):
    q = Setting(spark, sf, "union_rules")
    h = q.p.table("H", nation="int")
    q.p.rule(h(k), q.ext("customer", "c_nationkey")(k))
    q.p.rule(h(k), q.ext("supplier", "s_nationkey")(k))
    return q.p.run(h)


@query("SELECT o_custkey AS key FROM orders INTERSECT SELECT l_partkey FROM lineitem")
def intersect_rules(spark, sf):
    q = Setting(spark, sf, "intersect_rules")
    h = q.result("key")
    q.p.rule(h(k), q.ext("orders", "o_custkey")(k), q.ext("lineitem", "l_partkey")(k))
    return q.p.run(h)


@query("SELECT p_partkey AS key FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity = 50")
def except_rules(spark, sf):
    q = Setting(spark, sf, "except_rules")
    h = q.result("key")
    q.p.rule(h(k), q.ext("part", "p_partkey")(k), ~q.ext("lineitem", "l_partkey", "l_quantity")(k, 50.0))
    return q.p.run(h)


# sinks


@query("SELECT o_orderpriority AS priority, l_returnflag AS flag FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def emit_bag(spark, sf):
    q = Setting(spark, sf, "emit_bag")
    return q.sink({"priority": a, "flag": b}, q.ext("orders", "o_orderkey", "o_orderpriority")(k, a), q.ext("lineitem", "l_orderkey", "l_returnflag")(k, b))


@query("SELECT l_returnflag AS flag, sum(l_linenumber)::BIGINT AS total, count(*) AS n FROM lineitem GROUP BY ALL")
def fold_sum(spark, sf):
    q = Setting(spark, sf, "fold_sum")
    bag = q.sink({"flag": a, "j": b}, q.ext("lineitem", "l_returnflag", "l_linenumber")(a, b))
    return bag.groupBy("flag").agg(F.sum("j").alias("total"), F.count("j").alias("n"))


@query("SELECT 'number' AS heading, list(r_regionkey::VARCHAR ORDER BY r_regionkey) AS cells FROM region UNION ALL SELECT 'label', list(r_name ORDER BY r_regionkey) FROM region")
def export_json_table(spark, sf):
    q = Setting(spark, sf, "export_json")
    shown = export_json(q.sink({"key": a, "name": b}, q.ext("region")(a, b)).orderBy("key"), ["number", "label"])
    return spark.createDataFrame([(h, [str(r[i]) for r in shown["data"]]) for i, h in enumerate(shown["columns"])], "heading string, cells array<string>")


@query("SELECT r_regionkey AS key FROM region WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))")
def constraint_rule(spark, sf):
    q = Setting(spark, sf, "constraint")
    q.p.constraint("an order without a customer", q.ext("orders", "o_custkey")(k), ~q.ext("customer", "c_custkey")(k))
    return q.sink({"key": a}, q.ext("region")(a, IGNORE))


# lattices


@query("SELECT l_orderkey AS key, min(l_extendedprice) AS d FROM lineitem GROUP BY ALL")
def agg_lmin(spark, sf):
    return one_lattice(spark, sf, "agg_lmin", lmin("double"), "l_extendedprice")


@query("SELECT l_orderkey AS key, max(l_extendedprice) AS d FROM lineitem GROUP BY ALL")
def agg_lmax(spark, sf):
    return one_lattice(spark, sf, "agg_lmax", lmax("double"), "l_extendedprice")


@query("SELECT l_orderkey AS key, bit_or(1::BIGINT << l_linenumber)::BIGINT AS d FROM lineitem GROUP BY ALL")
def agg_lbitset(spark, sf):
    return one_lattice(spark, sf, "agg_lbitset", lbitset(), F.expr("shiftleft(1L, l_linenumber)").alias("bit"))


@query("SELECT l_orderkey AS key, list_sort(list(DISTINCT l_suppkey)) AS d FROM lineitem GROUP BY ALL")
def agg_lset(spark, sf):
    return one_lattice(spark, sf, "agg_lset", lset(), "l_suppkey")


@query("SELECT l_orderkey AS key, sum(DISTINCT l_linenumber)::BIGINT AS d FROM lineitem GROUP BY ALL")
def agg_custom(spark, sf):
    """A lattice of the caller's: sums of distinct powers, kept as a bit set and read back by a fold."""
    bits = custom("bits", "bigint", F.bit_or, lambda p, q: p.bitwiseOR(q), lambda new, old: new.bitwiseAND(F.bitwise_not(old)) != 0)
    df = one_lattice(spark, sf, "agg_custom", bits, F.expr("shiftleft(1L, l_linenumber)").alias("bit"))
    return df.select("key", F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(0).cast("long"), lambda t, i: t + F.when(F.getbit("d", i) == 1, i).otherwise(0)).alias("d"))


def one_lattice(spark, sf, name, lattice, column) -> DataFrame:
    q = Setting(spark, sf, name)
    h = q.p.table("H", key="long", d=lattice)
    q.p.rule(h(k, x), q.ext("lineitem", "l_orderkey", column)(k, x))
    return q.p.run(h)


@query("SELECT n_nationkey AS key, coalesce(bit_or(1::BIGINT << (s_suppkey % 60)), 0)::BIGINT AS d, min(s_suppkey) AS least FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY ALL")
def agg_bottom(spark, sf):
    q = Setting(spark, sf, "agg_bottom")
    h = q.p.table("H", key="int", d=lbitset(), least=lmin())
    q.p.rule(h(k, BOT, BOT), q.ext("nation", "n_nationkey")(k))
    q.p.rule(h(k, call(lambda m: F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2), m % 60).cast("long"), a), a), q.ext("supplier", "s_suppkey", "s_nationkey", "s_acctbal")(a, k, x), guard(x > 9000))
    return q.p.run(h)


@query("SELECT max(l_extendedprice) AS hi, l_partkey AS key, min(l_quantity) AS lo FROM lineitem GROUP BY ALL")
def lattice_two_cols(spark, sf):
    q = Setting(spark, sf, "lattice_two_cols")
    h = q.p.table("H", hi=lmax("double"), key="long", lo=lmin("double"))
    q.p.rule(h(x, k, y), q.ext("lineitem", "l_partkey", "l_extendedprice", "l_quantity")(k, x, y))
    return q.p.run(h)


@query("SELECT l_partkey AS key, count(*) AS n, avg(l_linenumber) AS mean FROM (SELECT DISTINCT l_partkey, l_suppkey, l_linenumber FROM lineitem) GROUP BY ALL")
def lset_count_avg(spark, sf):
    q = Setting(spark, sf, "lset_count_avg")
    pairs = lset("struct<s:bigint,n:int>")
    out, res = q.p.table("out", key="long", d=pairs), q.p.table("H", key="long", n="long", mean="double")
    q.p.rule(out(k, call(lambda p, r: F.struct(p.alias("s"), r.alias("n")), a, b)), q.ext("lineitem", "l_partkey", "l_suppkey", "l_linenumber")(k, a, b))
    total = call(lambda ps: F.aggregate(ps, F.lit(0.0), lambda t, p: t + p["n"]), d)
    q.p.rule(res(k, call(F.size, d), total / call(F.size, d)), out(k, d))
    return q.p.run(res)


@query("SELECT o.o_custkey AS key, greatest(max(o.o_totalprice), max(c_acctbal)) AS d FROM orders o JOIN customer ON o.o_custkey = c_custkey GROUP BY ALL")
def lvar_lub_body(spark, sf):
    q = Setting(spark, sf, "lvar_lub_body")
    most = LVar("most", lmax("double"))
    h = q.p.table("H", key="long", d=lmax("double"))
    q.p.rule(h(k, most), q.ext("orders", "o_custkey", "o_totalprice")(k, most), q.ext("customer", "c_custkey", "c_acctbal")(k, most))
    return q.p.run(h)


# generators


@query("SELECT p_partkey AS key, unnest(range(p_size, p_size * 4, p_size))::BIGINT AS multiple FROM part")
def iterate_xrange(spark, sf):
    q = Setting(spark, sf, "iterate_xrange")
    return q.sink({"key": k, "multiple": x}, q.ext("part", "p_partkey", "p_size")(k, n), iterate(x, xrange(n, n * 4, n)))


@query("SELECT vec_id, unnest(embedding) AS x FROM embeddings")
def iterate_array(spark, sf):
    q = Setting(spark, sf, "iterate_array")
    return q.sink({"vec_id": k, "x": x}, q.ext("embeddings", "vec_id", "embedding")(k, a), iterate(x, a))


@query("SELECT p_partkey AS key, generate_subscripts(string_split(p_type, ' '), 1) - 1 AS at, unnest(string_split(p_type, ' ')) AS word FROM part")
def enumerate_posexplode(spark, sf):
    q = Setting(spark, sf, "enumerate_posexplode")
    words = call(lambda t: F.split(t, " "), a)
    return q.sink({"key": k, "at": call(lambda i: i.cast("long"), n), "word": w}, q.ext("part", "p_partkey", "p_type")(k, a), enumerate_(n, w, words))


# recursion


@query(CLOSURE + " SELECT u, v FROM r")
def tc_linear(spark, sf):
    q = Setting(spark, sf, "tc_linear")
    g, r = q.graph(), q.p.table("R", "u long, v long")
    q.p.rule(r(u, v), g(u, v, IGNORE))
    q.p.rule(r(u, w), r(u, v), g(v, w, IGNORE))
    return q.p.run(r)


@query(f"WITH RECURSIVE {TREE}, r AS (SELECT c, p FROM t UNION SELECT r.c, t.p FROM r JOIN t ON r.p = t.c) SELECT c, p FROM r")
def tc_nonlinear(spark, sf):
    q = Setting(spark, sf, "tc_nonlinear")
    t, r = q.tree(), q.p.table("R", "c long, p long")
    q.p.rule(r(u, w), r(u, v), r(v, w))
    q.p.rule(r(u, v), t(u, v))
    return q.p.run(r)


@query(CLOSURE + " SELECT u, v FROM r")
def tc_manual_strata(spark, sf):
    q = Setting(spark, sf, "tc_manual_strata")
    g, r, h = q.graph(), q.p.table("R", "u long, v long"), q.result("u", "v")
    q.p.rule(r(u, v), g(u, v, IGNORE))
    q.p.rule(r(u, w), r(u, v), r(v, w))
    q.p.rule(h(u, v), r(u, v))
    q.p.strata([2, 1])
    return q.p.run(h)


@query(f"""WITH RECURSIVE {TREE}, r(c, p, odd) AS (SELECT c, p, true FROM t UNION SELECT r.c, t.p, NOT r.odd FROM r JOIN t ON r.p = t.c)
SELECT c, p FROM r WHERE NOT odd""")
def tc_mutual(spark, sf):
    q = Setting(spark, sf, "tc_mutual")
    t, odd, even = q.tree(), q.p.table("odd", "c long, p long"), q.p.table("even", "c long, p long")
    q.p.rule(odd(u, v), t(u, v))
    q.p.rule(even(u, w), odd(u, v), t(v, w))
    q.p.rule(odd(u, w), even(u, v), t(v, w))
    return q.p.run(even)


@query(CLOSURE + ", o AS (SELECT DISTINCT u FROM g WHERE u % 4 = 0), e AS (SELECT DISTINCT v FROM g WHERE v % 4 = 3) SELECT o.u, e.v FROM o, e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.u = o.u AND r.v = e.v)")
def stratified_negation(spark, sf):
    """Orders and the regions, of which there are five, that none of their lines comes from."""
    q = Setting(spark, sf, "stratified_negation")
    g, r, order, region, h = q.graph(), q.p.table("R", "u long, v long"), q.p.table("O", "u long"), q.p.table("E", "v long"), q.result("u", "v")
    q.p.rule(h(u, v), order(u), region(v), ~r(u, v))
    q.p.rule(r(u, w), r(u, v), g(v, w, IGNORE))
    q.p.rule(r(u, v), g(u, v, IGNORE))
    q.p.rule(order(u), g(u, IGNORE, IGNORE), guard(u % 4 == 0))
    q.p.rule(region(v), g(IGNORE, v, IGNORE), guard(v % 4 == 3))
    return q.p.run(h)


APSP = f"WITH RECURSIVE {G}, r(u, v, d) AS (SELECT u, v, w FROM g UNION ALL SELECT x.u, g.v, x.d + g.w FROM r x JOIN g ON x.v = g.u) SELECT u, v, min(d) AS d FROM r GROUP BY ALL"


@query(APSP)
def apsp_lmin(spark, sf):
    q = Setting(spark, sf, "apsp_lmin")
    g, r = q.graph(), q.p.table("R", u="long", v="long", d=lmin())
    one, two, both = (LVar(name, lmin()) for name in ("d1", "d2", "d"))
    q.p.rule(r(u, w, both), r(u, v, one), g(v, w, two), bind(both, one + two))
    q.p.rule(r(u, v, one), g(u, v, one))
    q.p.rule(r(u, v, BOT), g(u, v, IGNORE))
    return q.p.run(r)


@query(f"WITH RECURSIVE {TREE}, r(c, d) AS (SELECT 1::BIGINT, 0::BIGINT UNION ALL SELECT t.c, r.d + 1 FROM r JOIN t ON t.p = r.c) SELECT c, max(d) AS d FROM r GROUP BY ALL")
def level_lmax(spark, sf):
    q = Setting(spark, sf, "level_lmax")
    t, h = q.tree(), q.p.table("H", c="long", d=lmax())
    one = LVar("one", lmax())
    q.p.rule(h(1, 0), t(IGNORE, 1))
    q.p.rule(h(u, one + 1), h(v, one), t(u, v))
    return q.p.run(h)


@query(f"""WITH RECURSIVE {TREE}, r(c, p, h) AS (SELECT c, p, 1 FROM t UNION ALL SELECT r.c, t.p, r.h + 1 FROM r JOIN t ON r.p = t.c)
SELECT c, p, min(h)::INTEGER AS _height, CASE WHEN min(h) = 1 THEN 0 ELSE 1 END AS _rule FROM r GROUP BY c, p""")
def provenance_heights(spark, sf):
    q = Setting(spark, sf, "provenance", provenance=True)
    t, r = q.tree(), q.p.table("R", "c long, p long")
    q.p.rule(r(u, v), t(u, v))
    q.p.rule(r(u, w), r(u, v), t(v, w))
    return q.p.run(r)


# further sources, sinks and terms


@query("SELECT range AS x, range * range AS square FROM range(1000)")
def generator_rule(spark, sf):
    """A rule without an atom, from ``xrange(stop)``."""
    q = Setting(spark, sf, "generator_rule")
    return q.sink({"x": x, "square": x * x}, iterate(x, xrange(1000)))


@query("SELECT p_partkey AS key, unnest(range(p_size::BIGINT)) AS below FROM part")
def iterate_stop(spark, sf):
    q = Setting(spark, sf, "iterate_stop")
    return q.sink({"key": k, "below": x}, q.ext("part", "p_partkey", "p_size")(k, n), iterate(x, xrange(n)))


@query("SELECT c_nationkey AS nation, c_custkey AS key FROM customer ORDER BY c_nationkey DESC, c_custkey LIMIT 20")
def ordered_sink(spark, sf):
    """The first rows of a sink in an order of the caller's."""
    q = Setting(spark, sf, "ordered_sink")
    q.p.emit("out", {"nation": n, "key": k}, q.ext("customer", "c_custkey", "c_nationkey")(k, n))
    return q.p.run("out", ordered=[F.col("nation").desc(), "key"]).limit(20)


@query("SELECT c_nationkey AS nation, c_mktsegment AS segment FROM customer GROUP BY c_nationkey, c_mktsegment ORDER BY length(c_mktsegment), c_mktsegment, c_nationkey LIMIT 30")
def ordered_table(spark, sf):
    """The first rows of a table by a comparison key: the segment's length first."""
    q = Setting(spark, sf, "ordered_table")
    h = q.p.table("H", nation="int", segment="string")
    q.p.rule(h(k, s), q.ext("customer", "c_nationkey", "c_mktsegment")(k, s))
    return q.p.run(h, ordered=[F.length("segment"), "segment", "nation"]).limit(30)


@query("SELECT l_orderkey AS key, l_linenumber AS line FROM lineitem WHERE l_quantity > 25 + 20")
def captured_value(spark, sf):
    """A scalar function that holds a value of the caller's."""
    bound = 20
    q = Setting(spark, sf, "captured_value")
    more = call(lambda c: c > 25 + bound, x)
    return q.sink({"key": k, "line": n}, q.ext("lineitem", "l_orderkey", "l_linenumber", "l_quantity")(k, n, x), guard(more))


@query("SELECT c_custkey AS key FROM customer WHERE c_nationkey = 7")
def constant_by_reference(spark, sf):
    """A constant given as an expression of the caller's, in a place of an atom."""
    q = Setting(spark, sf, "constant_by_reference")
    return q.sink({"key": k}, q.ext("customer", "c_custkey", "c_nationkey")(k, F.lit(3) + F.lit(4)))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def indexed_lookup(spark, sf):
    q = Setting(spark, sf, "indexed_lookup")
    part = q.df("part").select("p_partkey", "p_name", "p_brand")
    return lookup(part, "p_brand", part.agg(F.min("p_brand")).first()[0])


@query("""WITH s AS (SELECT o_custkey AS key, list_sort(list(DISTINCT o_orderstatus)) AS a FROM orders GROUP BY ALL)
SELECT key, list_sort(list_distinct(list_append(a, 'X'))) AS with_x, list_filter(a, lambda e: e <> 'F') AS without_f, len(list_filter(a, lambda e: e > 'F'))::INTEGER AS above,
  CASE WHEN len(a) = 1 THEN a[1] END AS only, list_contains(a, 'P') AS has_p, len(list_filter(a, lambda e: e NOT IN ('F', 'O'))) = 0 AS plain FROM s""")
def flat_sets(spark, sf):
    """Operations on sets, of the statuses of a customer's orders."""
    q = Setting(spark, sf, "flat_sets")
    h = q.p.table("H", key="long", a=lset("string"))
    q.p.rule(h(k, x), q.ext("orders", "o_custkey", "o_orderstatus")(k, x))
    st = F.col("a")
    return q.p.run(h).select(
        "key", sets.insert(st, F.lit("X")).alias("with_x"), sets.erase(st, F.lit("F")).alias("without_f"), sets.count_if(st, lambda e: e > "F").alias("above"),
        sets.singleton(st).alias("only"), sets.contains(st, "P").alias("has_p"), sets.is_subset(st, F.array(F.lit("F"), F.lit("O"))).alias("plain"),
    )


@query(f"WITH RECURSIVE {TREE}, r AS (SELECT c, p FROM t UNION SELECT r.c, t.p FROM r JOIN t ON r.p = t.c) SELECT 1::BIGINT AS rule, r.p AS v FROM r JOIN t ON r.p = t.c WHERE r.c = 77 AND t.p = 4")
def proof_step(spark, sf):
    """The bindings that derive one row of a closure."""
    q = Setting(spark, sf, "proof_step")
    t, r = q.tree(), q.p.table("R", "c long, p long")
    q.p.rule(r(u, v), t(u, v))
    q.p.rule(r(u, w), r(u, v), t(v, w))
    q.p.run(r)
    return spark.createDataFrame([(i, x["v"]) for i, found in q.p.proofs(r, (77, 4)) for x in found], "rule long, v long")


@query("SELECT n_regionkey AS key, '[' || string_agg('[' || n_nationkey || ', \"' || n_name || '\"]', ', ' ORDER BY n_nationkey) || ']' AS shown FROM nation GROUP BY ALL")
def rows_as_json(spark, sf):
    q = Setting(spark, sf, "rows_as_json")
    h = q.p.table("H", key="int", d=lset("struct<k:int,n:string>"))
    q.p.rule(h(k, call(lambda i, t: F.struct(i.alias("k"), t.alias("n")), a, b)), q.ext("nation", "n_regionkey", "n_nationkey", "n_name")(k, a, b))
    return spark.createDataFrame([(r.key, json.dumps(json_of(r.d))) for r in q.p.run(h).collect()], "key int, shown string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their nation and region, which has rows at any size."""
    return join_multiway(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
