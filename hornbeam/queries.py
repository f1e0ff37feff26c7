"""Queries over the star-schema tables, one or more for each operator, with the SQL that says the same.

Each takes (spark, folder of Parquet tables); relations are the named columns of a table, by position.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornbeam.features import Features
from hornbeam.lang.parser import parse
from hornbeam.model import Const, Dependency, schema
from hornbeam.operators.views import Criterion, View
from hornbeam.plans.fixpoint import Evaluator, Naive, SemiNaive
from hornbeam.program import Program, dependency_rows


@dataclass(frozen=True)
class Ask:
    """``given``: relation -> (table, columns); ``goal``: the query; ``columns``: names of the answer's columns."""

    given: dict[str, tuple[str, str]]
    text: str
    goal: str
    columns: str
    sql: str
    evaluator: Callable[[], Evaluator] = SemiNaive
    disjunction: str = "reject"

    def program(self, spark: SparkSession, folder: str) -> Program:
        p = Program(Features.all(), disjunction=self.disjunction)
        for label, (table, columns) in self.given.items():
            p.add_frame(label, spark.read.parquet(f"{folder}/{table}.parquet").select(*columns.split()))
        return parse(self.text + f"\n?- {self.goal}.", program=p)

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        p = self.program(spark, folder)
        return p.run(spark, self.evaluator(), check="skip")[0][1].toDF(*self.columns.split())


CUSTOMER = {"customer": ("customer", "c_custkey c_nationkey c_mktsegment")}
NATION = {"nation": ("nation", "n_nationkey n_name n_regionkey")}
REGION = {"region": ("region", "r_regionkey r_name")}
SUPPLIER = {"supplier": ("supplier", "s_suppkey s_nationkey")}
PART = {"part": ("part", "p_partkey p_name p_brand p_size")}
ORDERS = {"orders": ("orders", "o_orderkey o_custkey o_orderstatus")}
LINES = {"line": ("lineitem", "l_orderkey l_suppkey l_quantity l_discount")}

#: Nations that trade: a supplier of one ships a large, discounted line to a customer of the other.
TRADE = "trade(A, B) :- line(O, S, Q, D), Q >= 50.0, D >= 0.1, orders(O, C, _), supplier(S, A), customer(C, B, _).\n"
TRADE_GIVEN = LINES | ORDERS | SUPPLIER | CUSTOMER
TRADE_SQL = """trade AS (SELECT DISTINCT s_nationkey::BIGINT AS a, c_nationkey::BIGINT AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity >= 50 AND l_discount >= 0.1)"""
CLOSURE_SQL = f"WITH RECURSIVE {TRADE_SQL}, reach AS (SELECT a, b FROM trade UNION SELECT r.a, t.b FROM reach r JOIN trade t ON r.b = t.a)"
REACH = TRADE + "reach(A, B) :- trade(A, B).\n"


def compared(op: str, sql: str) -> Ask:
    return Ask(PART, f"found(K) :- part(K, _, _, S), S {op} 25.", "found(K)", "partkey", f"SELECT p_partkey AS partkey FROM part WHERE p_size {sql} 25")


ASKS: dict[str, Ask] = {
    "projection": Ask(CUSTOMER, "seg(S) :- customer(_, _, S).", "seg(S)", "segment", "SELECT DISTINCT c_mktsegment AS segment FROM customer"),
    "selection_const": Ask(ORDERS, 'done(K) :- orders(K, _, "F").', "done(K)", "orderkey", "SELECT o_orderkey AS orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "cmp_eq": compared("=", "="),
    "cmp_ne": compared("≠", "<>"),
    "cmp_lt": compared("<", "<"),
    "cmp_le": compared("<=", "<="),
    "cmp_gt": compared(">", ">"),
    "cmp_ge": compared("≥", ">="),
    "cmp_negated": Ask(PART, "found(K) :- part(K, _, _, S), NOT 40 <= S.", "found(K)", "partkey", "SELECT p_partkey AS partkey FROM part WHERE p_size < 40"),
    "cmp_float": Ask(LINES, "found(O, Q) :- line(O, _, Q, D), Q > 4.9e1, D = 0.1.", "found(O, Q)", "orderkey quantity", "SELECT DISTINCT l_orderkey AS orderkey, l_quantity AS quantity FROM lineitem WHERE l_quantity > 49 AND l_discount = 0.1"),
    "string_match": Ask(NATION, 'found(N) :- nation(_, N, _), N MATCHES "_1[0-9]$".', "found(N)", "name", "SELECT n_name AS name FROM nation WHERE regexp_matches(n_name, '_1[0-9]$')"),
    "natural_join": Ask(CUSTOMER | NATION, "from(C, N) :- customer(C, K, _), nation(K, N, _).", "from(C, N)", "custkey nation", "SELECT c_custkey AS custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "multiway_join": Ask(
        CUSTOMER | NATION | REGION, "cust_region(C, R) :- customer(C, N, _), nation(N, _, RK), region(RK, R).", "cust_region(C, R)", "custkey region",
        "SELECT c_custkey AS custkey, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "self_join": Ask(SUPPLIER, "pair(A, B) :- supplier(A, N), supplier(B, N), A < B.", "pair(A, B)", "a b", "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey"),
    "theta_join": Ask(REGION | NATION, "below(R, N) :- region(R, _), nation(N, _, _), N < R.", "below(R, N)", "r n", "SELECT r_regionkey::BIGINT AS r, n_nationkey::BIGINT AS n FROM region JOIN nation ON n_nationkey < r_regionkey"),
    "equi_theta_join": Ask(CUSTOMER | NATION, "of(C, N) :- customer(C, K, _), nation(L, N, _), K = L.", "of(C, N)", "custkey nation", "SELECT c_custkey AS custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "cartesian_product": Ask(REGION, "pair(A, B) :- region(_, A), region(_, B).", "pair(A, B)", "a b", "SELECT x.r_name AS a, y.r_name AS b FROM region x CROSS JOIN region y"),
    "union": Ask(CUSTOMER | SUPPLIER, "n(N) :- customer(_, N, _).\nn(N) :- supplier(_, N).", "n(N)", "nation", "SELECT c_nationkey::BIGINT AS nation FROM customer UNION SELECT s_nationkey::BIGINT FROM supplier"),
    "intersection": Ask(CUSTOMER | SUPPLIER, "c(N) :- customer(_, N, _).\ns(N) :- supplier(_, N).\nboth(N) :- c(N), s(N).", "both(N)", "nation", "SELECT c_nationkey::BIGINT AS nation FROM customer INTERSECT SELECT s_nationkey::BIGINT FROM supplier"),
    "difference": Ask(PART, "full(B) :- part(_, _, B, 50).\nall(B) :- part(_, _, B, _).\nrest(B) :- all(B), NOT full(B).", "rest(B)", "brand", "SELECT p_brand AS brand FROM part EXCEPT SELECT p_brand FROM part WHERE p_size = 50"),
    "repeated_variable": Ask(LINES | ORDERS | SUPPLIER | CUSTOMER, "sale(A, B) :- line(O, S, _, _), orders(O, C, _), supplier(S, A), customer(C, B, _).\nhome(X) :- sale(X, X).", "home(X)", "nation", "SELECT DISTINCT s_nationkey::BIGINT AS nation FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey = c_nationkey"),
    "negation": Ask(ORDERS | CUSTOMER, 'filled(C) :- orders(_, C, "F").\nopen(C) :- customer(C, _, _), ￢filled(C).', "open(C)", "custkey", "SELECT c_custkey AS custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    "negation_any": Ask(ORDERS | CUSTOMER, "idle(C) :- customer(C, _, _), NOT orders(_, C, \"P\").", "idle(C)", "custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "ground_query": Ask(REGION, "r(K, N) :- region(K, N).", 'r(1, "ASIA")', "found", "SELECT EXISTS (SELECT 1 FROM region WHERE r_regionkey = 1 AND r_name = 'ASIA') AS found"),
    "ground_query_false": Ask(REGION, "r(K, N) :- region(K, N).", 'r(2, "nowhere")', "found", "SELECT EXISTS (SELECT 1 FROM region WHERE r_regionkey = 2 AND r_name = 'nowhere') AS found"),
    "mixed_query": Ask(NATION, "n(K, N, R) :- nation(K, N, R).", "n(_, N, 2)", "name region", "SELECT DISTINCT n_name AS name, 2::BIGINT AS region FROM nation WHERE n_regionkey = 2"),
    "universal_query": Ask(NATION, "n(K, R) :- nation(K, _, R).", "n(K, R)", "nation region", "SELECT n_nationkey::BIGINT AS nation, n_regionkey::BIGINT AS region FROM nation"),
    "ground_guard": Ask(NATION | REGION, "n(N) :- nation(_, N, _), region(0, _), NOT region(99, _).\nn(N) :- nation(_, N, _), region(98, _).", "n(N)", "name", "SELECT n_name AS name FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = 0)"),
    "semi_join": Ask(CUSTOMER | ORDERS, "buyer(C, S) :- customer(C, _, S), orders(_, C, _).", "buyer(C, S)", "custkey segment", "SELECT c_custkey AS custkey, c_mktsegment AS segment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "head_constant": Ask(CUSTOMER | SUPPLIER, 'tag(N, cust) :- customer(_, N, _).\ntag(N, "supp") :- supplier(_, N).', "tag(N, T)", "nation tag", "SELECT DISTINCT c_nationkey::BIGINT AS nation, 'cust' AS tag FROM customer UNION SELECT s_nationkey::BIGINT, 'supp' FROM supplier"),
    "transitive_closure": Ask(TRADE_GIVEN, REACH + "reach(A, B) :- trade(A, C), reach(C, B).", "reach(A, B)", "a b", CLOSURE_SQL + " SELECT a, b FROM reach"),
    "tc_linear": Ask(TRADE_GIVEN, REACH + "reach(A, B) :- trade(A, C), reach(C, B).", "reach(A, B)", "a b", CLOSURE_SQL + " SELECT a, b FROM reach", lambda: SemiNaive(doubling=False)),
    "tc_nonlinear": Ask(TRADE_GIVEN, REACH + "reach(A, B) :- reach(A, C), reach(C, B).", "reach(A, B)", "a b", CLOSURE_SQL + " SELECT a, b FROM reach"),
    "tc_naive": Ask(TRADE_GIVEN, REACH + "reach(A, B) :- reach(A, C), reach(C, B).", "reach(A, B)", "a b", CLOSURE_SQL + " SELECT a, b FROM reach", Naive),
    "mutual_recursion": Ask(
        TRADE_GIVEN, TRADE + "odd(A, B) :- trade(A, B).\nodd(A, B) :- even(A, C), trade(C, B).\neven(A, B) :- odd(A, C), trade(C, B).\nwalk(A, B, odd) :- odd(A, B).\nwalk(A, B, even) :- even(A, B).", "walk(A, B, P)", "a b parity",
        f"WITH RECURSIVE {TRADE_SQL}, walk AS (SELECT a, b, 1 AS p FROM trade UNION SELECT w.a, t.b, 1 - w.p FROM walk w JOIN trade t ON w.b = t.a) SELECT a, b, CASE p WHEN 1 THEN 'odd' ELSE 'even' END AS parity FROM walk",
    ),
    "stratified_negation_over_recursion": Ask(
        TRADE_GIVEN | NATION, REACH + "reach(A, B) :- trade(A, C), reach(C, B).\ncut(A, B) :- nation(A, _, _), nation(B, _, _), NOT reach(A, B).", "cut(A, B)", "a b",
        CLOSURE_SQL + " SELECT x.n_nationkey::BIGINT AS a, y.n_nationkey::BIGINT AS b FROM nation x CROSS JOIN nation y EXCEPT SELECT a, b FROM reach",
    ),
    "same_generation": Ask(
        NATION | REGION, "up(N, R) :- nation(_, N, K), region(K, R).\nup(R, world) :- region(_, R).\nsg(X, X) :- up(X, _).\nsg(X, X) :- up(_, X).\nsg(X, Y) :- up(X, U), sg(U, V), up(Y, V).", "sg(X, Y)", "x y",
        """WITH RECURSIVE up AS (SELECT n_name AS x, r_name AS y FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'world' FROM region),
        sg AS (SELECT x, x AS y FROM up UNION SELECT y, y FROM up UNION SELECT p.x, q.x FROM up p JOIN sg ON p.y = sg.x JOIN up q ON q.y = sg.y) SELECT x, y FROM sg""",
    ),
    "disjunction_split": Ask(PART, "small(K) ∨ light(K) :- part(K, _, _, S), S < 5.", "light(K)", "partkey", "SELECT p_partkey AS partkey FROM part WHERE p_size < 5", disjunction="split"),
}


def _view(spark: SparkSession, folder: str, table: str, columns: str) -> View:
    df = spark.read.parquet(f"{folder}/{table}.parquet").select(*columns.split())
    return View.of(df.select(*[F.col(c).cast("long") if t == "int" else F.col(c) for c, t in df.dtypes]))


def view_algebra(spark: SparkSession, folder: str) -> DataFrame:
    """Set operators of views, each apart: nations of both names, of one only, of either."""
    n = _view(spark, folder, "nation", "n_nationkey n_regionkey")
    low = n.select(Criterion("n_nationkey", "<", Const(15))).project("n_regionkey", "n_nationkey")
    high = n.select(Criterion("n_nationkey", ">", Const(9))).project("n_regionkey", "n_nationkey")
    parts = {"union": low.union(high), "intersection": low.intersection(high), "difference": low.difference(high)}
    frames = [v.rename(n_regionkey="region", n_nationkey="nation").frame().withColumn("part", F.lit(name)) for name, v in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def view_joins(spark: SparkSession, folder: str) -> DataFrame:
    """Selection, theta join, projection and natural join of views."""
    n = _view(spark, folder, "nation", "n_nationkey n_name n_regionkey")
    r = _view(spark, folder, "region", "r_regionkey r_name").select(Criterion("r_regionkey", ">", Const(0)))
    both = n.theta_join(r, Criterion("n_regionkey", "=", "r_regionkey"))
    return both.project("n_nationkey", "r_name").natural_join(n.project("n_nationkey", "n_name")).frame()


def view_product(spark: SparkSession, folder: str) -> DataFrame:
    r, n = _view(spark, folder, "region", "r_name"), _view(spark, folder, "nation", "n_name")
    return r.cartesian_product(n).frame()


def constraint_violations(spark: SparkSession, folder: str) -> DataFrame:
    p = Program(Features.all())
    p.add_frame("part", spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_size"))
    parse(":- part(K, S), S > 45, S != 50.", program=p)
    return p.violations(spark, {})[0][1].toDF("partkey", "size")


def fd_check(spark: SparkSession, folder: str) -> DataFrame:
    p = Program(Features.all())
    p.add_frame("orders", spark.read.parquet(f"{folder}/orders.parquet").select("o_custkey", "o_orderstatus"), ["cust", "status"])
    parse(".fd orders: cust --> status.", program=p)
    return p.violations(spark, {})[0][1].toDF("custkey", "n")


def fd_holds(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_custkey").toDF("c0", "c1")
    broken = dependency_rows(orders, Dependency((0,), (1,)))
    return broken.agg((F.count("*") == 0).alias("holds"))


def _round_trip(form: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        import uuid

        from hornbeam.plans.storage import folder as shared
        from hornbeam.sources.formats import reader, writer

        s, path = schema("integer", "string", "integer"), f"{shared(spark)}/{uuid.uuid4().hex}"
        p = Program()
        p.add_frame("nation", spark.read.parquet(f"{folder}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey"))
        writer(form)(p.frame("nation", spark), path, s)
        return reader(form)(spark, path, s, **options).toDF("nationkey", "name", "regionkey")

    return run


MORE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "view_algebra": (view_algebra, """WITH low AS (SELECT n_regionkey::BIGINT AS region, n_nationkey::BIGINT AS nation FROM nation WHERE n_nationkey < 15),
        high AS (SELECT n_regionkey::BIGINT AS region, n_nationkey::BIGINT AS nation FROM nation WHERE n_nationkey > 9)
        SELECT *, 'union' AS part FROM (FROM low UNION FROM high) UNION ALL SELECT *, 'intersection' FROM (FROM low INTERSECT FROM high) UNION ALL SELECT *, 'difference' FROM (FROM low EXCEPT FROM high)"""),
    "view_joins": (view_joins, "SELECT n_nationkey::BIGINT AS n_nationkey, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey > 0"),
    "view_product": (view_product, "SELECT r_name, n_name FROM region CROSS JOIN nation"),
    "constraint_violations": (constraint_violations, "SELECT p_partkey AS partkey, p_size::BIGINT AS size FROM part WHERE p_size > 45 AND p_size <> 50"),
    "fd_check": (fd_check, "SELECT o_custkey AS custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1"),
    "fd_holds": (fd_holds, "SELECT count(*) = 0 AS holds FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) > 1)"),
    **{f"{form}_roundtrip": (_round_trip(form, **options), "SELECT n_nationkey::BIGINT AS nationkey, n_name AS name, n_regionkey::BIGINT AS regionkey FROM nation") for form, options in (("csv", {"has_headers": True}), ("tsv", {"has_headers": True}), ("json", {}), ("parquet", {}))},
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**ASKS, **{k: f for k, (f, _) in MORE.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{k: a.sql for k, a in ASKS.items()}, **{k: s for k, (_, s) in MORE.items()}}
