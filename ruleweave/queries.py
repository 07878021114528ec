"""The registered queries of the rule engine over the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators.equality import functional_pairs, representatives
from .operators.joins import anti_join, hash_join, merge_join, project, theta_join
from .plans.analysis import Safety
from .plans.model import Atom, Var, atom, cond, rule
from .storage import shared_dir
from .terms import OWL, RDFS, TYPE, iri

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SUB, DOM, RNG, INV = iri(RDFS + "subClassOf"), iri(RDFS + "domain"), iri(RDFS + "range"), iri(OWL + "inverseOf")
_TYPE_OF = {k: iri(OWL + k) for k in ("TransitiveProperty", "SymmetricProperty", "FunctionalProperty", "InverseFunctionalProperty", "Class", "Restriction")}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Facts:
    """The tables as relations; nodes are named table/key."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def columns(self, table: str, *expressions: str) -> DataFrame:
        return _table(self.spark, self.sf_dir, table).selectExpr(*expressions)

    def customer_nation(self) -> DataFrame:
        return self.columns("customer", "c_custkey", "concat('nation/', c_nationkey)")

    def nation_region(self) -> DataFrame:
        return self.columns("nation", "concat('nation/', n_nationkey)", "concat('region/', n_regionkey)")

    def supplier_nation(self) -> DataFrame:
        return self.columns("supplier", "concat('supplier/', s_suppkey)", "concat('nation/', s_nationkey)")

    def order_customer(self) -> DataFrame:
        return self.columns("orders", "o_orderkey", "o_custkey")

    def part(self, column: str) -> DataFrame:
        return self.columns("part", "p_partkey", column)

    def turns(self) -> DataFrame:
        """Each turn of a conversation to the next one there is."""
        t = _table(self.spark, self.sf_dir, "conversations").select("conv_id", "turn").distinct()
        nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"))
        return t.join(nxt, ["conv_id", "turn"]).selectExpr("concat('t/', conv_id, '/', turn)", "concat('t/', conv_id, '/', turn + 1)")


_TURNS = "SELECT DISTINCT 't/' || a.conv_id || '/' || a.turn AS s, 't/' || a.conv_id || '/' || (a.turn + 1) AS o FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def _engine(spark: SparkSession, **relations: DataFrame) -> Engine:
    e = Engine(spark)
    for name, df in relations.items():
        e.add_relation(name, df)
    return e


# scans, joins, filters


@query("SELECT DISTINCT o_orderkey AS s FROM orders WHERE o_orderstatus = 'F'")
def alpha_scan_const(spark, sf_dir):
    e = _engine(spark, status=_Facts(spark, sf_dir).columns("orders", "o_orderkey", "o_orderstatus"))
    return e.add_rules([rule(atom("Finished", "?x"), atom("status", "?x", "F"))]).relation("Finished")


@query("SELECT DISTINCT c_custkey AS s, 'region/' || n_regionkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def two_atom_join(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    e = _engine(spark, inNation=f.customer_nation(), inRegion=f.nation_region())
    return e.add_rules([rule(atom("livesIn", "?c", "?r"), atom("inNation", "?c", "?n"), atom("inRegion", "?n", "?r"))]).relation("livesIn")


@query("SELECT DISTINCT 'nation/' || c_nationkey AS s, 'nation/' || s_nationkey AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey")
def star_join_4(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    e = _engine(spark, suppliedBy=f.columns("lineitem", "l_orderkey", "concat('supplier/', l_suppkey)"), orderedBy=f.order_customer(), inNation=f.customer_nation(), basedIn=f.supplier_nation())
    body = [atom("suppliedBy", "?l", "?s"), atom("orderedBy", "?l", "?c"), atom("inNation", "?c", "?n"), atom("basedIn", "?s", "?m")]
    return e.add_rules([rule(atom("buysFrom", "?n", "?m"), *body)]).relation("buysFrom")


@query("SELECT DISTINCT o_custkey AS s FROM orders WHERE o_custkey = o_orderkey % 1000")
def repeated_var(spark, sf_dir):
    e = _engine(spark, linked=_Facts(spark, sf_dir).columns("orders", "o_custkey", "o_orderkey % 1000"))
    return e.add_rules([rule(atom("SelfLinked", "?x"), atom("linked", "?x", "?x"))]).relation("SelfLinked")


@query("SELECT DISTINCT r_name AS s, p_type AS o FROM region, part")
def cross_join_rule(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    e = _engine(spark, Region=f.columns("region", "r_name"), PartType=f.columns("part", "p_type"))
    return e.add_rules([rule(atom("sellable", "?r", "?t"), atom("Region", "?r"), atom("PartType", "?t"))]).relation("sellable")


@query("SELECT DISTINCT a.s_suppkey AS s, b.s_suppkey AS o FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal > b.s_acctbal")
def theta_join_rule(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    e = _engine(spark, nation=f.columns("supplier", "s_suppkey", "s_nationkey"), balance=f.columns("supplier", "s_suppkey", "s_acctbal"))
    body = [atom("nation", "?a", "?n"), atom("nation", "?b", "?n"), atom("balance", "?a", "?x"), atom("balance", "?b", "?y"), cond("math:greaterThan", "?x", "?y")]
    return e.add_rules([rule(atom("richer", "?a", "?b"), *body)]).relation("richer")


@query("SELECT DISTINCT a.s_suppkey AS s, b.s_suppkey AS o FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal > b.s_acctbal")
def theta_join_operator(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    out = theta_join(s, s, lambda l, r: F.col("l.s_acctbal") > F.col("r.s_acctbal"), ["s_nationkey"])
    return out.select(F.col("l.s_suppkey").alias("s"), F.col("r.s_suppkey").alias("o")).distinct()


@query("SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def merge_join_operator(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nation"))
    return merge_join(c, n, ["k"]).groupBy("nation").agg(F.count(F.lit(1)).alias("customers"))


@query("SELECT n_name AS nation, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def hash_join_operator(spark, sf_dir):
    c = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nation"))
    return hash_join(c, n, ["k"]).groupBy("nation").agg(F.count(F.lit(1)).alias("suppliers"))


def _builtin(name: str, column: str, value: object, condition: str, table: str = "part", key: str = "p_partkey") -> None:
    def f(spark, sf_dir):
        e = _engine(spark, has=_Facts(spark, sf_dir).columns(table, key, column))
        return e.add_rules([rule(atom("Chosen", "?x"), atom("has", "?x", "?v"), cond(name, "?v", value))]).relation("Chosen")

    f.__name__ = "builtin_" + name.replace(":", "_")
    query(f"SELECT DISTINCT {key} AS s FROM {table} WHERE {condition}")(f)


_builtin("math:greaterThan", "p_size", 30, "p_size > 30")
_builtin("math:lessThan", "p_size", 10, "p_size < 10")
_builtin("math:notLessThan", "p_size", 40, "p_size >= 40")
_builtin("math:notGreaterThan", "p_size", 5, "p_size <= 5")
_builtin("math:equalTo", "p_size", 7, "p_size = 7")
_builtin("math:notEqualTo", "p_size", 7, "p_size <> 7")
_builtin("log:equalTo", "p_brand", "Brand#11", "p_brand = 'Brand#11'")
_builtin("log:notEqualTo", "p_brand", "Brand#11", "p_brand <> 'Brand#11'")
_builtin("string:contains", "p_type", "A", "contains(p_type, 'A')")
_builtin("string:containsIgnoringCase", "p_type", "ST", "contains(lower(p_type), 'st')")
_builtin("string:equalIgnoringCase", "p_brand", "BRAND#12", "lower(p_brand) = 'brand#12'")
_builtin("string:notEqualIgnoringCase", "p_brand", "BRAND#12", "lower(p_brand) <> 'brand#12'")
_builtin("string:startsWith", "p_type", "S", "starts_with(p_type, 'S')")
_builtin("string:endsWith", "p_type", "L", "ends_with(p_type, 'L')")
_builtin("string:matches", "p_brand", "#[12]", "regexp_matches(p_brand, '#[12]')")
_builtin("string:notMatches", "p_brand", "#[12]", "NOT regexp_matches(p_brand, '#[12]')")
_builtin("string:greaterThan", "p_brand", "Brand#3", "p_brand > 'Brand#3'")
_builtin("string:lessThan", "p_brand", "Brand#3", "p_brand < 'Brand#3'")
_builtin("string:greaterThanOrEqualTo", "p_brand", "Brand#12", "p_brand >= 'Brand#12'")
_builtin("string:lessThanOrEqualTo", "p_brand", "Brand#12", "p_brand <= 'Brand#12'")
_builtin("string:notGreaterThan", "p_brand", "Brand#13", "p_brand <= 'Brand#13'")
_builtin("string:notLessThan", "p_brand", "Brand#13", "p_brand >= 'Brand#13'")


@query("SELECT DISTINCT p_partkey AS s FROM part WHERE p_size % 5 = 3")
def user_builtin(spark, sf_dir):
    e = Engine(spark, {"my:endsIn3or8": lambda a, _: a % 5 == 3}).add_relation("size", _Facts(spark, sf_dir).part("p_size"))
    return e.add_rules([rule(atom("Odd", "?x"), atom("size", "?x", "?n"), cond("my:endsIn3or8", "?n", "?n"))]).relation("Odd")


@query("SELECT DISTINCT p_partkey AS s FROM part WHERE p_size > 45 UNION SELECT DISTINCT p_partkey FROM part WHERE p_retailprice < 1000")
def rule_union(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    e = _engine(spark, size=f.part("p_size"), price=f.part("p_retailprice"))
    rules = [rule(atom("Special", "?x"), atom("size", "?x", "?n"), cond("math:greaterThan", "?n", 45)), rule(atom("Special", "?x"), atom("price", "?x", "?p"), cond("math:lessThan", "?p", 1000))]
    return e.add_rules(rules).relation("Special")


@query("SELECT p_partkey AS s, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS o FROM part UNION SELECT p_partkey, p_brand FROM part WHERE p_size > 25")
def multi_head(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    e = _engine(spark, size=f.part("p_size"), brand=f.part("p_brand"))
    rules = [
        rule([atom("tag", "?x", "large"), atom("tag", "?x", "?b")], atom("size", "?x", "?n"), atom("brand", "?x", "?b"), cond("math:greaterThan", "?n", 25)),
        rule(atom("tag", "?x", "small"), atom("size", "?x", "?n"), cond("math:notGreaterThan", "?n", 25)),
    ]
    return e.add_rules(rules).relation("tag")


# recursion

_STEP = [rule(atom("reach", "?x", "?y"), atom("next", "?x", "?y")), rule(atom("reach", "?x", "?z"), atom("reach", "?x", "?y"), atom("next", "?y", "?z"))]


@query(f"WITH RECURSIVE next AS ({_TURNS}), reach AS (SELECT s, o FROM next UNION SELECT r.s, n.o FROM reach r JOIN next n ON r.o = n.s) SELECT s, o FROM reach")
def transitive_closure(spark, sf_dir):
    return _engine(spark, next=_Facts(spark, sf_dir).turns()).add_rules(_STEP).relation("reach")


# parts in blocks of ten, each with cycles of its own: nodes grow with the table, and the closure with the nodes
_CYCLE = "SELECT DISTINCT p_partkey AS s, p_partkey - p_partkey % 10 + (p_partkey % 10 * 7 + 3) % 10 AS o FROM part"


def _cycle(spark, sf_dir) -> DataFrame:
    return _Facts(spark, sf_dir).columns("part", "p_partkey", "p_partkey - p_partkey % 10 + (p_partkey % 10 * 7 + 3) % 10")


@query(f"WITH RECURSIVE next AS ({_CYCLE}), reach AS (SELECT s, o FROM next UNION SELECT r.s, n.o FROM reach r JOIN next n ON r.o = n.s) SELECT s, o FROM reach")
def cyclic_closure(spark, sf_dir):
    return _engine(spark, next=_cycle(spark, sf_dir)).add_rules(_STEP).relation("reach")


@query(f"WITH RECURSIVE next AS ({_CYCLE}), reach AS (SELECT s, o FROM next UNION SELECT r.s, n.o FROM reach r JOIN next n ON r.o = n.s) SELECT s, o FROM reach")
def nonlinear_closure(spark, sf_dir):
    rules = [_STEP[0], rule(atom("reach", "?x", "?z"), atom("reach", "?x", "?y"), atom("reach", "?y", "?z"))]
    return _engine(spark, next=_cycle(spark, sf_dir)).add_rules(rules).relation("reach")


_SG = """WITH RECURSIVE up AS (SELECT 'supplier/' || s_suppkey AS s, 'nation/' || s_nationkey AS o FROM supplier UNION SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation),
sg AS (SELECT 'region/' || r_regionkey AS s, 'region/' || r_regionkey AS o FROM region UNION SELECT a.s, b.s FROM sg JOIN up a ON a.o = sg.s JOIN up b ON b.o = sg.o) SELECT s, o FROM sg"""


@query(_SG)
def same_generation(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    up = f.supplier_nation().toDF("s", "o").unionByName(f.nation_region().toDF("s", "o"))
    flat = f.columns("region", "concat('region/', r_regionkey)", "concat('region/', r_regionkey)")
    rules = [rule(atom("sg", "?x", "?y"), atom("flat", "?x", "?y")), rule(atom("sg", "?x", "?y"), atom("up", "?x", "?a"), atom("sg", "?a", "?b"), atom("up", "?y", "?b"))]
    return _engine(spark, up=up, flat=flat).add_rules(rules).relation("sg")


@query(f"WITH RECURSIVE next AS ({_TURNS}), reach AS (SELECT o FROM next WHERE s = 't/1/0' UNION SELECT n.o FROM reach r JOIN next n ON r.o = n.s) SELECT o AS y FROM reach")
def bound_goal_magic(spark, sf_dir):
    e = _engine(spark, next=_Facts(spark, sf_dir).turns()).add_rules([_STEP[0], rule(atom("reach", "?x", "?z"), atom("reach", "?x", "?y"), atom("reach", "?y", "?z"))])
    return e.goal(atom("reach", "t/1/0", "?y"))


@query(f"WITH RECURSIVE next AS ({_TURNS}), reach AS (SELECT s, o FROM next UNION SELECT r.s, n.o FROM reach r JOIN next n ON r.o = n.s) SELECT s, o FROM reach")
def incremental_add(spark, sf_dir):
    turns = _Facts(spark, sf_dir).turns().toDF("s", "o")
    odd = F.crc32(F.col("s")) % 2 == 1
    e = _engine(spark, next=turns.where(~odd)).add_rules(_STEP)
    e.run()
    return e.add_facts("next", turns.where(odd)).relation("reach")


@query(f"WITH RECURSIVE next AS ({_CYCLE}), reach AS (SELECT s, o FROM next UNION SELECT r.s, n.o FROM reach r JOIN next n ON r.o = n.s) SELECT EXISTS (SELECT 1 FROM reach WHERE s = 13 AND o = 11) AS answer")
def ask_goal(spark, sf_dir):
    e = _engine(spark, next=_cycle(spark, sf_dir)).add_rules(_STEP)
    return spark.range(1).select(F.lit(e.holds(atom("reach", 13, 11))).alias("answer"))


# negation


@query("SELECT DISTINCT c_custkey AS s FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def naf_complement(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    e = _engine(spark, Customer=f.columns("customer", "c_custkey"), urgent=f.columns("orders", "o_custkey", "o_orderpriority"))
    return e.add_rules([rule(atom("Patient", "?c"), atom("Customer", "?c"), atom("urgent", "?c", "1-URGENT", naf=True))]).relation("Patient")


@query("SELECT DISTINCT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '2-HIGH')")
def minus_operator(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).distinct()
    return anti_join(c, _table(spark, sf_dir, "orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_custkey").alias("k")), ["k"])


@query(f"WITH RECURSIVE next AS ({_CYCLE}), reach AS (SELECT o FROM next WHERE s = 1 UNION SELECT n.o FROM reach r JOIN next n ON r.o = n.s) SELECT DISTINCT s FROM next WHERE s NOT IN (SELECT o FROM reach)")
def two_strata(spark, sf_dir):
    e = _engine(spark, next=_cycle(spark, sf_dir))
    rules = [rule(atom("Seen", "?y"), atom("next", 1, "?y")), rule(atom("Seen", "?z"), atom("Seen", "?y"), atom("next", "?y", "?z")), rule(atom("Unseen", "?x"), atom("next", "?x", "?y"), atom("Seen", "?x", naf=True))]
    return e.add_rules(rules).relation("Unseen")


# invented nodes, hooks, provenance, hybrids


@query("SELECT DISTINCT o_orderkey AS s, '_:n' || substr(sha256('invoice' || chr(31) || 'i' || chr(31) || o_orderkey), 1, 24) AS o FROM orders WHERE o_orderstatus = 'F'")
def existential_head(spark, sf_dir):
    e = _engine(spark, Finished=_Facts(spark, sf_dir).columns("orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'").select("o_orderkey"))
    return e.add_rules([rule([atom("invoice", "?x", "?i"), atom("Invoice", "?i")], atom("Finished", "?x"), name="invoice")]).relation("invoice")


@query("SELECT DISTINCT o_custkey AS s, upper(o_orderpriority) AS o FROM orders")
def firing_hook(spark, sf_dir):
    e = _engine(spark, priority=_Facts(spark, sf_dir).columns("orders", "o_custkey", "o_orderpriority"))
    r = rule(atom("shout", "?c", "?p"), atom("priority", "?c", "?p"), name="shout")
    e.add_rules([r]).on_fire(r, lambda m: m.select(F.col("c").alias("s"), F.lit("shout").alias("p"), F.upper("p").alias("o")), replace=True)
    return e.relation("shout")


@query("SELECT n.n_nationkey AS s, n.n_regionkey AS o FROM nation n UNION SELECT DISTINCT c_nationkey, c_nationkey % 5 FROM customer")
def hybrid_predicate(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    e = _engine(spark, region=f.columns("nation", "n_nationkey", "n_regionkey"), guess=f.columns("customer", "c_nationkey", "c_nationkey % 5"))
    e.add_rules([rule(atom("region", "?x", "?y"), atom("guess", "?x", "?y"))])
    assert e.hybrid() == {"region"}
    return e.relation("region")


@query("SELECT 'large' AS rule, count(DISTINCT p_partkey) AS n FROM part WHERE p_size > 25 UNION ALL SELECT 'cheap', count(DISTINCT p_partkey) FROM part WHERE p_retailprice < 1200")
def rule_firing_counts(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    e = _engine(spark, size=f.part("p_size"), price=f.part("p_retailprice"))
    rules = [rule(atom("Good", "?x"), atom("size", "?x", "?n"), cond("math:greaterThan", "?n", 25), name="large"), rule(atom("Good", "?x"), atom("price", "?x", "?p"), cond("math:lessThan", "?p", 1200), name="cheap")]
    return e.add_rules(rules).firing_counts()


@query("SELECT DISTINCT 'c/' || c_custkey AS s, 'region/' || n_regionkey AS o, 'nation/' || n_nationkey AS via FROM customer JOIN nation ON c_nationkey = n_nationkey")
def why_provenance(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    e = _engine(spark, inNation=f.columns("customer", "concat('c/', c_custkey)", "concat('nation/', c_nationkey)"), inRegion=f.nation_region())
    e.add_rules([rule(atom("livesIn", "?c", "?r"), atom("inNation", "?c", "?n"), atom("inRegion", "?n", "?r"))])
    return e.firings().select("s", "o", F.col("antecedents")[0]["o"].alias("via"))


@query("SELECT '<urn:r' || n_regionkey || '>' AS r FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 9")
def first_answer(spark, sf_dir):
    return _graph(spark, sf_dir).first_answer("SELECT ?r WHERE { :c9 :livesIn ?r }")


# second order


@query("SELECT DISTINCT c_custkey::VARCHAR AS s, c_mktsegment AS o FROM customer UNION SELECT DISTINCT p_partkey::VARCHAR, p_brand FROM part")
def second_order_join(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    e = _engine(spark, segment=f.columns("customer", "c_custkey", "c_mktsegment"), brand=f.part("p_brand"), size=f.part("p_size"))
    e.add_relation("Functional", spark.createDataFrame([("segment",), ("brand",)], "s string"))
    return e.add_rules([rule(atom("single", "?s", "?o"), atom("Functional", "?p"), Atom(Var("p"), (Var("s"), Var("o"))))]).relation("single")


# ontologies


def _ontology(spark, axioms, **relations) -> Engine:
    return _engine(spark, **relations).add_ontology(axioms)


@query("WITH RECURSIVE sub AS (SELECT 'nation/' || n_nationkey AS s, 'region/' || n_regionkey AS o FROM nation UNION SELECT 'region/' || r_regionkey, 'Place' FROM region), up AS (SELECT s, o FROM sub UNION SELECT u.s, b.o FROM up u JOIN sub b ON u.o = b.s) SELECT DISTINCT c_custkey AS s, o FROM customer JOIN up ON up.s = 'nation/' || c_nationkey UNION SELECT DISTINCT c_custkey, 'nation/' || c_nationkey FROM customer")
def subclass_hierarchy(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    sub = f.nation_region().toDF("s", "o").unionByName(f.columns("region", "concat('region/', r_regionkey) as s", "'Place' as o"))
    e = _engine(spark, isA=f.customer_nation(), sub=sub)
    e.add_rules([rule(atom("sub", "?a", "?c"), atom("sub", "?a", "?b"), atom("sub", "?b", "?c")), rule(atom("isA", "?x", "?d"), atom("isA", "?x", "?c"), atom("sub", "?c", "?d"))])
    return e.relation("isA")


@query("SELECT DISTINCT o_orderkey AS s FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def subclass_axiom(spark, sf_dir):
    p = _Facts(spark, sf_dir).columns("orders", "o_orderkey", "o_orderpriority").toDF("s", "p")
    e = _engine(spark, Urgent=p.where("p = '1-URGENT'").select("s"), High=p.where("p = '2-HIGH'").select("s"))
    return e.add_ontology([("Urgent", SUB, "Pressing"), ("High", SUB, "Pressing")]).relation("Pressing")


@query("SELECT DISTINCT o_orderkey AS s, o_custkey AS o FROM orders")
def subproperty(spark, sf_dir):
    e = _ontology(spark, [("orderedBy", iri(RDFS + "subPropertyOf"), "involves")], orderedBy=_Facts(spark, sf_dir).order_customer())
    return e.relation("involves")


@query("SELECT DISTINCT o_custkey AS s, o_orderkey AS o FROM orders")
def inverse_of(spark, sf_dir):
    return _ontology(spark, [("orderedBy", INV, "ordered")], orderedBy=_Facts(spark, sf_dir).order_customer()).relation("ordered")


@query(f"WITH e AS ({_CYCLE}) SELECT s, o FROM e UNION SELECT o, s FROM e")
def symmetric_property(spark, sf_dir):
    e = _ontology(spark, [("near", TYPE, _TYPE_OF["SymmetricProperty"])], near=_cycle(spark, sf_dir))
    return e.relation("near")


@query(f"WITH RECURSIVE next AS ({_CYCLE}), reach AS (SELECT s, o FROM next UNION SELECT r.s, n.o FROM reach r JOIN next n ON r.o = n.s) SELECT s, o FROM reach")
def transitive_property(spark, sf_dir):
    e = _ontology(spark, [("next", TYPE, _TYPE_OF["TransitiveProperty"])], next=_cycle(spark, sf_dir))
    return e.relation("next")


@query("SELECT DISTINCT 'Order' AS class, o_orderkey AS s FROM orders UNION ALL SELECT DISTINCT 'Customer', o_custkey FROM orders")
def domain_range(spark, sf_dir):
    e = _ontology(spark, [("orderedBy", DOM, "Order"), ("orderedBy", RNG, "Customer")], orderedBy=_Facts(spark, sf_dir).order_customer())
    return e.relation("Order").select(F.lit("Order").alias("class"), "s").unionByName(e.relation("Customer").select(F.lit("Customer").alias("class"), "s"))


@query("SELECT DISTINCT o_orderkey AS s FROM orders WHERE o_orderstatus IN ('F', 'O')")
def equivalent_class(spark, sf_dir):
    p = _Facts(spark, sf_dir).columns("orders", "o_orderkey", "o_orderstatus").toDF("s", "p")
    e = _engine(spark, Done=p.where("p = 'F'").select("s"), Closed=p.where("p = 'O'").select("s"))
    return e.add_ontology([("Done", iri(OWL + "equivalentClass"), "Closed")]).relation("Closed")


def _expression(node: str, kind: str, *members: str):
    from .ontology.graph import Graph

    g = Graph()
    g.add(node, iri(OWL + kind), g.make_list(members))
    return sorted(g.triples)


@query("SELECT DISTINCT p_partkey AS s FROM part WHERE p_size > 40 OR p_retailprice < 1000")
def union_of(spark, sf_dir):
    p = _Facts(spark, sf_dir).columns("part", "p_partkey as s", "p_size", "p_retailprice")
    e = _engine(spark, **{"<urn:Large>": p.where("p_size > 40").select("s"), "<urn:Cheap>": p.where("p_retailprice < 1000").select("s")})
    return e.add_ontology(_expression("<urn:Either>", "unionOf", "<urn:Large>", "<urn:Cheap>")).relation("<urn:Either>")


@query("SELECT DISTINCT p_partkey AS s FROM part WHERE p_size > 20 AND p_retailprice < 1500")
def intersection_of(spark, sf_dir):
    p = _Facts(spark, sf_dir).columns("part", "p_partkey as s", "p_size", "p_retailprice")
    e = _engine(spark, **{"<urn:Large>": p.where("p_size > 20").select("s"), "<urn:Cheap>": p.where("p_retailprice < 1500").select("s")})
    return e.add_ontology(_expression("<urn:Both>", "intersectionOf", "<urn:Large>", "<urn:Cheap>")).relation("<urn:Both>")


def _restriction(node: str, prop: str, kind: str, value: str) -> list[tuple[str, str, str]]:
    return [(node, TYPE, _TYPE_OF["Restriction"]), (node, iri(OWL + "onProperty"), prop), (node, iri(OWL + kind), value)]


@query("SELECT DISTINCT p_partkey AS s FROM part WHERE p_brand = 'Brand#12'")
def has_value(spark, sf_dir):
    axioms = _restriction("_:r", "<urn:brand>", "hasValue", "Brand#12") + [("_:r", SUB, "<urn:Twelve>")]
    return _engine(spark, **{"<urn:brand>": _Facts(spark, sf_dir).part("p_brand")}).add_ontology(axioms).relation("<urn:Twelve>")


@query("SELECT DISTINCT o_custkey AS s FROM orders WHERE o_orderstatus = 'F'")
def some_values_from(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    axioms = _restriction("_:r", "<urn:ordered>", "someValuesFrom", "<urn:Finished>") + [("_:r", SUB, "<urn:Buyer>")]
    done = f.columns("orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'").select("o_orderkey")
    e = _engine(spark, **{"<urn:ordered>": f.columns("orders", "o_custkey", "o_orderkey"), "<urn:Finished>": done})
    return e.add_ontology(axioms).relation("<urn:Buyer>")


@query("SELECT DISTINCT o_orderkey AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def all_values_from(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    axioms = _restriction("_:r", "<urn:ordered>", "allValuesFrom", "<urn:BuildersOrder>") + [("<urn:Builder>", SUB, "_:r")]
    builders = f.columns("customer", "c_custkey", "c_mktsegment").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    e = _engine(spark, **{"<urn:ordered>": f.columns("orders", "o_custkey", "o_orderkey"), "<urn:Builder>": builders})
    return e.add_ontology(axioms).relation("<urn:BuildersOrder>")


@query("SELECT 'nation/' || n_nationkey AS s FROM nation WHERE n_nationkey IN (1, 2, 3)")
def one_of(spark, sf_dir):
    axioms = _expression("<urn:Near>", "oneOf", "nation/1", "nation/2", "nation/3") + [("<urn:Near>", SUB, "<urn:Local>")]
    return Engine(spark).add_ontology(axioms).relation("<urn:Local>")


@query("SELECT DISTINCT o_orderkey AS s FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def complement_of_union(spark, sf_dir):
    from .ontology.expr import AllOf, AnyOf, Complement, Named, write
    from .ontology.graph import Graph

    p = _Facts(spark, sf_dir).columns("orders", "o_orderkey", "o_orderstatus").toDF("s", "p")
    g = Graph()
    node = write(g, AllOf((Named("<urn:Order>"), Complement(AnyOf((Named("<urn:Done>"), Named("<urn:Partial>")))))))
    g.add("<urn:Open>", iri(OWL + "equivalentClass"), node)
    e = _engine(spark, **{"<urn:Order>": p.select("s"), "<urn:Done>": p.where("p = 'F'").select("s"), "<urn:Partial>": p.where("p = 'P'").select("s")})
    return e.add_ontology(sorted(g.triples), derived=["<urn:Open>"]).relation("<urn:Open>")


@query("SELECT DISTINCT 'u' || user_id AS node, min('u' || user_id) OVER (PARTITION BY user_id % 100) AS rep FROM events")
def functional_same_as(spark, sf_dir):
    device = _Facts(spark, sf_dir).columns("events", "user_id % 100 as s", "concat('u', user_id) as o").distinct()
    found = representatives(functional_pairs(device))
    nodes = device.select(F.col("o").alias("node")).distinct()  # a node that equals no other stands for itself
    return nodes.join(found, "node", "left").select("node", F.coalesce("rep", "node").alias("rep"))


@query("SELECT 'c' || a.c_custkey AS s, 'c' || b.c_custkey AS o FROM customer a JOIN customer b ON a.c_acctbal = b.c_acctbal AND a.c_custkey <> b.c_custkey")
def same_as_rules(spark, sf_dir):
    balance = _Facts(spark, sf_dir).columns("customer", "cast(c_acctbal as string)", "concat('c', c_custkey)")
    return _engine(spark, balance=balance).add_ontology([("balance", TYPE, _TYPE_OF["FunctionalProperty"])]).relation(iri(OWL + "sameAs"))


@query("SELECT 'nation/' || n_nationkey AS s, 'OneOf/' || n_regionkey AS o FROM nation UNION SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation")
def elh_classification(spark, sf_dir):
    from .ontology.elh import classify
    from .ontology.expr import Named, Some

    # a nation is part of its region; whatever is part of region r is one of r
    pairs = [tuple(r) for r in _Facts(spark, sf_dir).columns("nation", "n_nationkey", "n_regionkey").collect()]
    axioms = [(Named(f"nation/{n}"), Some("partOf", Named(f"region/{r}"))) for n, r in pairs]
    axioms += [(Named(f"nation/{n}"), Named(f"region/{r}")) for n, r in pairs]
    axioms += [(Some("within", Named(f"region/{r}")), Named(f"OneOf/{r}")) for r in sorted({r for _, r in pairs})]
    return classify(spark, axioms, [("partOf", "within")])


@query("SELECT DISTINCT '<urn:c' || c_custkey || '>' AS s, '<urn:Party>' AS o FROM customer UNION SELECT DISTINCT '<urn:c' || c_custkey || '>', '<urn:Customer>' FROM customer UNION SELECT DISTINCT '<urn:n' || c_nationkey || '>', '<urn:Nation>' FROM customer")
def rdfs_rules(spark, sf_dir):
    from .ontology.rulesets import RDFS_RULES

    e = Engine(spark).add_relation("<urn:livesIn>", _Facts(spark, sf_dir).columns("customer", "concat('<urn:c', c_custkey, '>')", "concat('<urn:n', c_nationkey, '>')"))
    schema = [("<urn:livesIn>", DOM, "<urn:Customer>"), ("<urn:livesIn>", RNG, "<urn:Nation>"), ("<urn:Customer>", SUB, "<urn:Party>")]
    e.add_triples(spark.createDataFrame(schema, "s string, p string, o string")).add_rules(RDFS_RULES)
    return e.match(p=TYPE).select("s", "o")


# graph queries

_P = {"": "urn:"}


def _graph(spark, sf_dir) -> Engine:
    f = _Facts(spark, sf_dir)
    e = Engine(spark, prefixes=_P)
    e.add_relation("<urn:nation>", f.columns("customer", "concat('<urn:c', c_custkey, '>')", "concat('<urn:n', c_nationkey, '>')"))
    e.add_relation("<urn:region>", f.columns("nation", "concat('<urn:n', n_nationkey, '>')", "concat('<urn:r', n_regionkey, '>')"))
    e.add_relation("<urn:segment>", f.columns("customer", "concat('<urn:c', c_custkey, '>')", "concat('\"', c_mktsegment, '\"')"))
    e.add_relation("<urn:balance>", f.columns("customer", "concat('<urn:c', c_custkey, '>')", "concat('\"', cast(round(c_acctbal) as bigint), '\"^^<http://www.w3.org/2001/XMLSchema#integer>')"))
    e.add_relation("<urn:order>", f.columns("orders", "concat('<urn:c', o_custkey, '>')", "concat('<urn:o', o_orderkey, '>')"))
    e.add_relation("<urn:priority>", f.columns("orders", "concat('<urn:c', o_custkey, '>')", "concat('\"', o_orderpriority, '\"')"))
    return e.add_rules([rule(atom("<urn:livesIn>", "?c", "?r"), atom("<urn:nation>", "?c", "?n"), atom("<urn:region>", "?n", "?r"))])


@query("SELECT DISTINCT '<urn:c' || c_custkey || '>' AS c, '<urn:n' || c_nationkey || '>' AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def sparql_bgp(spark, sf_dir):
    return _graph(spark, sf_dir).sparql("SELECT ?c ?n WHERE { ?c :livesIn :r2 ; :nation ?n }")


@query("SELECT DISTINCT '<urn:c' || c_custkey || '>' AS c FROM customer WHERE round(c_acctbal) > 5000 AND c_mktsegment = 'BUILDING'")
def sparql_filter(spark, sf_dir):
    return _graph(spark, sf_dir).sparql('SELECT ?c WHERE { ?c :balance ?b ; :segment ?s . FILTER(?b > 5000 && ?s = "BUILDING") }')


@query("SELECT DISTINCT '<urn:c' || c_custkey || '>' AS c, '<urn:o' || o_orderkey || '>' AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 7")
def sparql_optional(spark, sf_dir):
    return _graph(spark, sf_dir).sparql("SELECT ?c ?o WHERE { ?c :nation :n7 OPTIONAL { ?c :order ?o } }")


@query("SELECT DISTINCT '<urn:c' || c_custkey || '>' AS c FROM customer WHERE c_nationkey IN (1, 4)")
def sparql_union(spark, sf_dir):
    return _graph(spark, sf_dir).sparql("SELECT ?c WHERE { { ?c :nation :n1 } UNION { ?c :nation :n4 } }")


@query("SELECT DISTINCT '<urn:c' || c_custkey || '>' AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')")
def sparql_minus(spark, sf_dir):
    return _graph(spark, sf_dir).sparql('SELECT ?c WHERE { ?c :livesIn :r1 MINUS { ?c :priority "5-LOW" } }')


@query("SELECT EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1 AND n_regionkey = 0) AS answer")
def sparql_ask(spark, sf_dir):
    return _graph(spark, sf_dir).sparql("ASK { :c1 :livesIn :r0 }")


@query("SELECT DISTINCT '<urn:c' || c_custkey || '>' AS s, '<urn:nation>' AS p, '<urn:n' || c_nationkey || '>' AS o FROM customer WHERE c_nationkey IN (2, 5)")
def triples_choices(spark, sf_dir):
    return _graph(spark, sf_dir).match(p="<urn:nation>", o=["<urn:n2>", "<urn:n5>"])


@query("SELECT '<urn:r' || n_regionkey || '>' AS r FROM nation WHERE n_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 5)")
def sparql_bindings(spark, sf_dir):
    return _graph(spark, sf_dir).sparql("SELECT ?c ?r WHERE { ?c :livesIn ?r }", {"c": "<urn:c5>"})


@query("SELECT DISTINCT o_custkey AS s FROM orders WHERE o_totalprice > 200000")
def notation3_rules(spark, sf_dir):
    text = """@prefix : <urn:>. @prefix math: <http://www.w3.org/2000/10/swap/math#>.
    { ?o :total ?t; :customer ?c. ?t math:greaterThan 200000 } => { ?c a :BigSpender }."""
    f = _Facts(spark, sf_dir)
    e = _engine(spark, **{"<urn:total>": f.columns("orders", "o_orderkey", "o_totalprice"), "<urn:customer>": f.order_customer()})
    return e.add_rules(text).relation("<urn:BigSpender>")


@query("SELECT DISTINCT c_custkey AS s FROM customer WHERE c_acctbal < 0")
def safety_loose(spark, sf_dir):
    import warnings

    e = Engine(spark, safety=Safety.LOOSE).add_relation("balance", _Facts(spark, sf_dir).columns("customer", "c_custkey", "c_acctbal"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        e.add_rules([rule(atom("InDebt", "?c"), atom("balance", "?c", "?b"), cond("math:lessThan", "?b", 0)), rule(atom("InDebt", "?z"), atom("balance", "?c", "?b"))])
    return e.relation("InDebt")


@query("SELECT DISTINCT 'constraint 0' AS \"constraint\", p_partkey::VARCHAR AS x FROM part WHERE p_size > 49")
def integrity_constraint(spark, sf_dir):
    import warnings

    e = _engine(spark, **{"<urn:size>": _Facts(spark, sf_dir).part("p_size")})
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        e.add_rules("@prefix : <urn:>. @prefix math: <http://www.w3.org/2000/10/swap/math#>. { ?x :size ?n. ?n math:greaterThan 49 } => { }.")
    return e.violations().select("constraint", F.col("bindings")["x"].alias("x"))


@query("SELECT DISTINCT c_custkey::VARCHAR AS s, 'livesIn' AS p, 'region/' || n_regionkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3")
def filter_rules(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    e = _engine(spark, inNation=f.customer_nation(), inRegion=f.nation_region())
    e.add_rules([rule(atom("livesIn", "?c", "?r"), atom("inNation", "?c", "?n"), atom("inRegion", "?n", "?r"))])
    return e.filtered([rule(atom("out", "?c", "region/3"), atom("livesIn", "?c", "region/3"))]).withColumn("p", F.lit("livesIn"))


@query("SELECT '<urn:o' || o_orderkey || '>' AS o FROM orders WHERE o_custkey = 7")
def sparql_bindings_optional(spark, sf_dir):
    return _graph(spark, sf_dir).sparql("SELECT ?c ?o WHERE { ?c :segment ?s OPTIONAL { ?c :order ?o } FILTER(bound(?o) && ?c = <urn:c7>) }", {"c": "<urn:c7>"}).select("o")


@query("SELECT '<urn:o' || o_orderkey || '>' AS x FROM orders WHERE o_custkey = 7 UNION SELECT '\"' || c_mktsegment || '\"' FROM customer WHERE c_custkey = 7")
def sparql_bindings_union(spark, sf_dir):
    return _graph(spark, sf_dir).sparql("SELECT ?x WHERE { { ?c :order ?x } UNION { ?c :segment ?x } }", {"c": "<urn:c7>"})


@query("SELECT DISTINCT '<urn:n' || c_nationkey || '>' AS n FROM customer WHERE c_custkey = 7 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = 7 AND o_orderpriority = '5-LOW')")
def sparql_bindings_minus(spark, sf_dir):
    return _graph(spark, sf_dir).sparql('SELECT ?n WHERE { ?c :nation ?n MINUS { ?c :priority "5-LOW" } }', {"c": "<urn:c7>"})


@query("SELECT DISTINCT '<urn:c' || c_custkey || '>' AS c, c_nationkey::VARCHAR AS k FROM customer WHERE c_nationkey < 3")
def sparql_bind(spark, sf_dir):
    out = _graph(spark, sf_dir).sparql('SELECT ?c ?t WHERE { ?c :nation ?n BIND(str(?n) AS ?t) FILTER(?n = :n0 || ?n = :n1 || ?n = :n2) }')
    return out.select("c", F.replace("t", F.lit("urn:n")).alias("k"))


@query("SELECT '<urn:c' || c_custkey || '>' AS c FROM (SELECT c_custkey, round(c_acctbal) AS b FROM customer ORDER BY b DESC, '<urn:c' || c_custkey || '>' LIMIT 25)")
def sparql_order_limit(spark, sf_dir):
    return _graph(spark, sf_dir).sparql("SELECT ?c ?b WHERE { ?c :balance ?b } ORDER BY DESC(?b) ?c LIMIT 25").select("c")


@query(f"WITH RECURSIVE next AS ({_TURNS}), reach AS (SELECT o FROM next WHERE s = 't/1/0' UNION SELECT n.o FROM reach r JOIN next n ON r.o = n.s) SELECT '<urn:' || o || '>' AS y FROM reach")
def sparql_magic(spark, sf_dir):
    turns = _Facts(spark, sf_dir).turns().selectExpr(*[f"concat('<urn:', `{c}`, '>')" for c in _Facts(spark, sf_dir).turns().columns])
    e = Engine(spark, prefixes=_P).add_relation("<urn:next>", turns)
    e.add_rules("@prefix : <urn:>. { ?x :next ?y } => { ?x :reach ?y }. { ?x :reach ?y. ?y :reach ?z } => { ?x :reach ?z }.")
    return e.sparql("SELECT ?y WHERE { <urn:t/1/0> :reach ?y }")


# equality, more of ontologies


@query("WITH same AS (SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_acctbal = b.c_acctbal) SELECT DISTINCT 'c' || same.y AS s, 'o' || o_orderkey AS o FROM orders JOIN same ON same.x = o_custkey UNION SELECT DISTINCT 'c' || o_custkey, 'o' || o_orderkey FROM orders")
def equality_smushing(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    e = _engine(spark, balance=f.columns("customer", "concat('c', c_custkey)", "c_acctbal"), placed=f.columns("orders", "concat('c', o_custkey)", "concat('o', o_orderkey)"))
    return e.add_ontology([("balance", TYPE, _TYPE_OF["InverseFunctionalProperty"])]).relation("placed")


@query("SELECT DISTINCT o_orderkey AS s, o_custkey AS o FROM orders")
def equivalent_property(spark, sf_dir):
    return _ontology(spark, [("buyer", iri(OWL + "equivalentProperty"), "orderedBy")], orderedBy=_Facts(spark, sf_dir).order_customer()).relation("buyer")


@query("SELECT DISTINCT o_orderkey AS s FROM orders WHERE o_orderstatus <> 'F'")
def complement_of_named(spark, sf_dir):
    from .ontology.expr import AllOf, Complement, Named, write
    from .ontology.graph import Graph

    p = _Facts(spark, sf_dir).columns("orders", "o_orderkey", "o_orderstatus").toDF("s", "p")
    g = Graph()
    g.add(write(g, AllOf((Named("<urn:Order>"), Complement(Named("<urn:Done>"))))), SUB, "<urn:Open>")
    return _engine(spark, **{"<urn:Order>": p.select("s"), "<urn:Done>": p.where("p = 'F'").select("s")}).add_ontology(sorted(g.triples)).relation("<urn:Open>")


def _over_parts(spark, sf_dir, expression) -> DataFrame:
    """The parts in a class defined by an expression over those that are large (size over 20) and cheap (price under 1500)."""
    from .ontology.expr import write
    from .ontology.graph import Graph

    p = _Facts(spark, sf_dir).columns("part", "p_partkey as s", "p_size", "p_retailprice")
    g = Graph()
    g.add(write(g, expression), SUB, "<urn:Found>")
    e = _engine(spark, **{"<urn:Part>": p.select("s"), "<urn:Large>": p.where("p_size > 20").select("s"), "<urn:Cheap>": p.where("p_retailprice < 1500").select("s")})
    return e.add_ontology(sorted(g.triples)).relation("<urn:Found>")


@query("SELECT DISTINCT p_partkey AS s FROM part WHERE NOT (p_size > 20 AND p_retailprice < 1500)")
def de_morgan(spark, sf_dir):
    from .ontology.expr import AllOf, Complement, Named

    return _over_parts(spark, sf_dir, AllOf((Named("<urn:Part>"), Complement(AllOf((Named("<urn:Large>"), Named("<urn:Cheap>")))))))


@query("SELECT DISTINCT p_partkey AS s FROM part WHERE p_size > 20")
def double_negative(spark, sf_dir):
    from .ontology.expr import AllOf, Complement, Named

    return _over_parts(spark, sf_dir, AllOf((Named("<urn:Part>"), Complement(Complement(Named("<urn:Large>"))))))


@query("SELECT DISTINCT p_partkey AS s FROM part WHERE p_size > 20 AND (p_retailprice < 1500 OR p_size > 20)")
def flattened_expression(spark, sf_dir):
    from .ontology.expr import AllOf, AnyOf, Named

    inner = AnyOf((Named("<urn:Cheap>"), AnyOf((Named("<urn:Large>"),))))
    return _over_parts(spark, sf_dir, AllOf((Named("<urn:Part>"), AllOf((Named("<urn:Large>"), inner)))))


@query("SELECT DISTINCT '<urn:c' || c_custkey || '>' AS s, '<urn:n' || c_nationkey || '>' AS o FROM customer")
def pd_star_rules(spark, sf_dir):
    from .ontology.rulesets import PD_RULES

    e = Engine(spark).add_relation("<urn:has>", _Facts(spark, sf_dir).columns("customer", "concat('<urn:n', c_nationkey, '>')", "concat('<urn:c', c_custkey, '>')"))
    e.add_triples(spark.createDataFrame([("<urn:livesIn>", INV, "<urn:has>")], "s string, p string, o string")).add_rules(PD_RULES)
    return e.match(p="<urn:livesIn>").select("s", "o")


@query("SELECT DISTINCT '<urn:c' || c_custkey || '>' AS s FROM customer UNION SELECT DISTINCT '<urn:n' || c_nationkey || '>' FROM customer")
def rdfs_resources(spark, sf_dir):
    from .ontology.rulesets import RDFS_AXIOM_RULES

    lives = _Facts(spark, sf_dir).columns("customer", "concat('<urn:c', c_custkey, '>')", "concat('<urn:n', c_nationkey, '>')")
    e = Engine(spark).add_relation("<urn:livesIn>", lives).add_rules(RDFS_AXIOM_RULES)
    return e.match(p=TYPE, o=iri(RDFS + "Resource")).select("s").where("s like '<urn:c%' or s like '<urn:n%'")


@query("SELECT DISTINCT '<urn:c' || c_custkey || '>' AS s, '<urn:r' || n_regionkey || '>' AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def entailment_graph(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    data = f.columns("customer", "concat('<urn:c', c_custkey, '>') as s", "'<urn:home>' as p", "concat('<urn:n', c_nationkey, '>') as o")
    data = data.unionByName(f.columns("nation", "concat('<urn:n', n_nationkey, '>') as s", "'<urn:partOf>' as p", "concat('<urn:r', n_regionkey, '>') as o"))
    axioms = [("<urn:home>", iri(RDFS + "subPropertyOf"), "<urn:livesIn>")]
    e = Engine.from_graph(spark, data, axioms, "@prefix : <urn:>. { ?c :livesIn ?n. ?n :partOf ?r } => { ?c :livesInRegion ?r }.")
    return e.relation("<urn:livesInRegion>")


# front ends, stores, streams


@query("SELECT DISTINCT o_custkey AS s FROM orders WHERE o_orderstatus = 'P'")
def rif_rules(spark, sf_dir):
    from .sources.rif import parse_rif

    const = lambda n: f'<Const type="http://www.w3.org/2007/rif#iri">urn:{n}</Const>'
    var = lambda n: f"<Var>{n}</Var>"
    member = lambda x, c: f"<Member><instance>{x}</instance><class>{c}</class></Member>"
    body = f"<And><formula><Frame><object>{var('o')}</object><slot>{const('buyer')}{var('c')}</slot></Frame></formula><formula>{member(var('o'), const('Pending'))}</formula></And>"
    rule_text = f"<Forall><declare>{var('o')}</declare><declare>{var('c')}</declare><formula><Implies><if>{body}</if><then>{member(var('c'), const('Waiting'))}</then></Implies></formula></Forall>"
    text = f'<Document xmlns="http://www.w3.org/2007/rif#"><payload><Group><sentence>{rule_text}</sentence></Group></payload></Document>'
    f = _Facts(spark, sf_dir)
    pending = f.columns("orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'P'").select("o_orderkey")
    return _engine(spark, **{"<urn:buyer>": f.order_customer(), "<urn:Pending>": pending}).add_rules(parse_rif(text)).relation("<urn:Waiting>")


@query("SELECT DISTINCT o_orderkey AS s FROM orders WHERE o_orderstatus IN ('F', 'P')")
def rdfxml_ontology(spark, sf_dir):
    from .sources.rdfxml import parse_rdfxml

    text = f"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="{RDFS}">
    <rdf:Description rdf:about="urn:Done"><rdfs:subClassOf rdf:resource="urn:Seen"/></rdf:Description>
    <rdf:Description rdf:about="urn:Partial"><rdfs:subClassOf rdf:resource="urn:Seen"/></rdf:Description></rdf:RDF>"""
    p = _Facts(spark, sf_dir).columns("orders", "o_orderkey", "o_orderstatus").toDF("s", "p")
    e = _engine(spark, **{"<urn:Done>": p.where("p = 'F'").select("s"), "<urn:Partial>": p.where("p = 'P'").select("s")})
    return e.add_ontology(parse_rdfxml(text)).relation("<urn:Seen>")


def _customer_triples(spark, sf_dir) -> DataFrame:
    c = _Facts(spark, sf_dir).columns("customer", "concat('<urn:c', c_custkey, '>') as s", "'<urn:segment>' as p", "concat('\"', c_mktsegment, '\"') as o")
    kinds = _Facts(spark, sf_dir).columns("customer", "concat('<urn:c', c_custkey, '>') as s", f"'{TYPE}' as p", "'<urn:Customer>' as o")
    return c.unionByName(kinds)


_CUSTOMER_TRIPLES = f"SELECT '<urn:c' || c_custkey || '>' AS s, '<urn:segment>' AS p, '\"' || c_mktsegment || '\"' AS o FROM customer UNION SELECT '<urn:c' || c_custkey || '>', '{TYPE}', '<urn:Customer>' FROM customer"


@query(_CUSTOMER_TRIPLES)
def ntriples_round_trip(spark, sf_dir):
    from .sources.ntriples import read, write

    path = f"{shared_dir(spark)}/ruleweave/ntriples-{uuid.uuid4().hex}"
    write(_customer_triples(spark, sf_dir), path)
    return read(spark, path, strict=True)


@query(_CUSTOMER_TRIPLES)
def store_round_trip(spark, sf_dir):
    from .sources.store import write_store

    path = f"{shared_dir(spark)}/ruleweave/store-{uuid.uuid4().hex}"
    write_store(_customer_triples(spark, sf_dir), path)
    return Engine(spark).add_store(path).closure()


@query(f"WITH RECURSIVE next AS ({_TURNS}), reach AS (SELECT s, o FROM next UNION SELECT r.s, n.o FROM reach r JOIN next n ON r.o = n.s) SELECT s, o FROM reach")
def streaming_closure(spark, sf_dir):
    from .streaming.incremental import StreamingClosure

    path = f"{shared_dir(spark)}/ruleweave/stream-{uuid.uuid4().hex}"
    turns = _Facts(spark, sf_dir).turns().toDF("s", "o")
    turns.repartition(2).write.parquet(f"{path}/in")
    e = _engine(spark, next=turns.where("false")).add_rules(_STEP)
    stream = spark.readStream.schema("s string, o string").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    StreamingClosure(e, "next").start(stream, f"{path}/checkpoint", available_now=True).awaitTermination()
    return e.relation("reach")


@query("SELECT DISTINCT c_custkey, c_mktsegment FROM customer")
def project_operator(spark, sf_dir):
    c = project(_table(spark, sf_dir, "customer"), ["c_custkey", "c_mktsegment", "c_nationkey"])
    return project(c, ["c_nationkey"], inverse=True).distinct()


@query("SELECT 'root' AS s UNION SELECT DISTINCT 'region/' || r_regionkey FROM region")
def rule_without_body(spark, sf_dir):
    e = _engine(spark, Region=_Facts(spark, sf_dir).columns("region", "concat('region/', r_regionkey)"))
    return e.add_rules([rule(atom("Top", "root")), rule(atom("Top", "?x"), atom("Region", "?x"))]).relation("Top")


@query("SELECT DISTINCT c_custkey AS x, 'region/' || n_regionkey AS y FROM customer JOIN nation ON c_nationkey = n_nationkey")
def open_goal(spark, sf_dir):
    f = _Facts(spark, sf_dir)
    e = _engine(spark, inNation=f.customer_nation(), inRegion=f.nation_region())
    e.add_rules([rule(atom("livesIn", "?c", "?r"), atom("inNation", "?c", "?n"), atom("inRegion", "?n", "?r"))])
    return e.goal(atom("livesIn", "?x", "?y"))


FLAGSHIP = "transitive_closure"
