"""Queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.engine import Engine
from ruleloom.operators import relations as R
from ruleloom.pinning import shared_folder, staged
from ruleloom.plans.rewrites import specialised
from ruleloom.plans.text import parse_program
from ruleloom.sources import facts
from ruleloom.streaming.epochs import Epochs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def note(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


def engine_of(spark: SparkSession, **relations: DataFrame) -> Engine:
    engine = Engine(spark)
    for name, df in relations.items():
        engine.register(name, df)
    return engine


def derived(spark: SparkSession, program: str, name: str, columns: str, **relations: DataFrame) -> DataFrame:
    """The rows of one relation of a program over some tables, with named columns."""
    return engine_of(spark, **relations).evaluate(program)[name].toDF(*columns.split())


# scans, selections, projections


@query("SELECT DISTINCT c_mktsegment AS segment FROM customer")
def scan_project(spark, d):
    return derived(spark, "seg(?s) <- [customer(?k, ?n, ?t, ?b, ?s)]", "seg", "segment", customer=table(spark, d, "customer"))


@query("SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def select_const_str(spark, d):
    return derived(spark, "b(?k) <- [customer(?k, ?n, ?t, ?b, BUILDING)]", "b", "custkey", customer=table(spark, d, "customer"))


@query("SELECT DISTINCT n_name AS nation FROM nation WHERE n_regionkey = 1")
def select_const_uint(spark, d):
    return derived(spark, "n(?n) <- [nation(?k, ?n, 1)]", "n", "nation", nation=table(spark, d, "nation"))


@query("SELECT DISTINCT o_orderkey AS orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def multi_const(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return derived(spark, 'u(?k) <- [orders(?k, F, "1-URGENT")]', "u", "orderkey", orders=orders)


@query("SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey = l_suppkey")
def select_repeated_var(spark, d):
    return derived(spark, "same(?x) <- [ps(?x, ?x)]", "same", "k", ps=table(spark, d, "lineitem").select("l_partkey", "l_suppkey"))


@query("SELECT DISTINCT n_nationkey::BIGINT AS k FROM nation WHERE false")
def type_mismatch_empty(spark, d):
    return derived(spark, 'n(?k) <- [nation(?k, ?n, "1")]', "n", "k", nation=table(spark, d, "nation"))


@query("SELECT DISTINCT p_partkey AS k, 'part' AS kind, p_brand AS brand FROM part")
def head_constant(spark, d):
    return derived(spark, "typ(?k, part, ?b) <- [part(?k, ?b)]", "typ", "k kind brand", part=table(spark, d, "part").select("p_partkey", "p_brand"))


# joins


@query("SELECT DISTINCT r_regionkey::BIGINT AS r, n_nationkey::BIGINT AS n FROM region, nation")
def product(spark, d):
    return derived(spark, "p(?r, ?n) <- [region(?r, ?x), nation(?n, ?y, ?z)]", "p", "r n", region=table(spark, d, "region"), nation=table(spark, d, "nation"))


@query("SELECT DISTINCT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def join2(spark, d):
    return derived(spark, "j(?n, ?r) <- [nation(?k, ?n, ?q), region(?q, ?r)]", "j", "nation region", nation=table(spark, d, "nation"), region=table(spark, d, "region"))


@query("SELECT DISTINCT c_custkey AS c, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join3_chain(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return derived(spark, "j(?c, ?r) <- [customer(?c, ?n), nation(?n, ?m, ?q), region(?q, ?r)]", "j", "c region", customer=customer, nation=table(spark, d, "nation"), region=table(spark, d, "region"))


@query("SELECT DISTINCT a.l_orderkey AS o FROM lineitem a JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 50) b USING (l_partkey, l_suppkey)")
def join_multi_key(spark, d):
    items = table(spark, d, "lineitem")
    large = items.where("l_quantity >= 50").select("l_partkey", "l_suppkey")
    return derived(spark, "m(?o) <- [item(?o, ?p, ?s), large(?p, ?s)]", "m", "o", item=items.select("l_orderkey", "l_partkey", "l_suppkey"), large=large)


@query("SELECT DISTINCT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 2)")
def filter_atom(spark, d):
    return derived(spark, "f(?c) <- [customer(?c, ?n), nation(?n, ?m, 2)]", "f", "c", customer=table(spark, d, "customer").select("c_custkey", "c_nationkey"), nation=table(spark, d, "nation"))


_E = "e AS (SELECT p_partkey AS x, p_partkey // 2 AS y FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 4 FROM part WHERE p_partkey > 0)"


@query(f"WITH {_E} SELECT DISTINCT a.x, a.y, b.y AS z FROM e a JOIN e b ON a.y = b.x JOIN e c ON c.x = a.x AND c.y = b.y")
def triangle(spark, d):
    part = table(spark, d, "part").where("p_partkey > 0")
    edges = part.selectExpr("p_partkey", "p_partkey div 2").union(part.selectExpr("p_partkey", "p_partkey div 4"))
    return derived(spark, "tri(?x, ?y, ?z) <- [e(?x, ?y), e(?y, ?z), e(?x, ?z)]", "tri", "x y z", e=edges)


# sets


@query("SELECT c_nationkey::BIGINT AS n FROM customer UNION SELECT s_nationkey FROM supplier")
def rule_union(spark, d):
    return derived(spark, "u(?n) <- [c(?n)] u(?n) <- [s(?n)]", "u", "n", c=table(spark, d, "customer").select("c_nationkey"), s=table(spark, d, "supplier").select("s_nationkey"))


def _nations(spark, d):
    """Nations of suppliers with much and of those with little on their account."""
    s = table(spark, d, "supplier")
    return R.positional(s.where("s_acctbal > 5000").select("s_nationkey")), R.positional(s.where("s_acctbal <= 5000").select("s_nationkey"))


@query("SELECT s_nationkey::BIGINT AS n FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal <= 5000")
def set_difference(spark, d):
    return R.difference(*_nations(spark, d)).toDF("n")


@query("SELECT s_nationkey::BIGINT AS n FROM supplier WHERE s_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal <= 5000")
def set_intersect(spark, d):
    return R.intersection(*_nations(spark, d)).toDF("n")


@query("SELECT user_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE -1 END)::BIGINT AS weight FROM events GROUP BY 1 HAVING sum(CASE WHEN event_type = 'click' THEN 1 ELSE -1 END) <> 0")
def consolidate(spark, d):
    signed = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "click", 1).otherwise(-1).alias("_sign"))
    return R.consolidate(signed).withColumnRenamed("_sign", "weight")


# recursion

_PAR = "par AS (SELECT p_partkey AS c, p_partkey // 2 AS p FROM part WHERE p_partkey > 0)"
_TC = f"WITH RECURSIVE {_PAR}, tc AS (SELECT c, p FROM par UNION SELECT tc.c, par.p FROM tc JOIN par ON tc.p = par.c) SELECT c, p FROM tc"
LINEAR = "anc(?x, ?y) <- [par(?x, ?y)] anc(?x, ?z) <- [anc(?x, ?y), par(?y, ?z)]"
RIGHT_LINEAR = "anc(?x, ?y) <- [par(?x, ?y)] anc(?x, ?z) <- [par(?x, ?y), anc(?y, ?z)]"
CYCLIC = "r(?x, ?y) <- [e(?x, ?y)] r(?x, ?z) <- [r(?x, ?y), r(?y, ?z)]"
MUTUAL = "odd(?x, ?y) <- [par(?x, ?y)] even(?x, ?z) <- [odd(?x, ?y), par(?y, ?z)] odd(?x, ?z) <- [even(?x, ?y), par(?y, ?z)]"
NONLINEAR = "anc(?x, ?y) <- [par(?x, ?y)] anc(?x, ?z) <- [anc(?x, ?y), anc(?y, ?z)]"


def parents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_partkey > 0").selectExpr("p_partkey AS c0", "p_partkey div 2 AS c1")


@query(_TC)
def tc_linear(spark, d):
    return derived(spark, LINEAR, "anc", "c p", par=parents(spark, d))


@query(_TC)
def tc_right_linear(spark, d):
    return derived(spark, RIGHT_LINEAR, "anc", "c p", par=parents(spark, d))


@query(_TC)
def tc_nonlinear(spark, d):
    return derived(spark, NONLINEAR, "anc", "c p", par=parents(spark, d))


def ring(spark: SparkSession, d: str) -> DataFrame:
    supplier = table(spark, d, "supplier")
    n = supplier.agg(F.count(F.lit(1)).alias("n"))
    return supplier.crossJoin(n).selectExpr("s_suppkey", "(s_suppkey * 7 + 3) % n")


_RING = "e AS (SELECT s_suppkey AS x, (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS y FROM supplier)"


@query(f"WITH RECURSIVE {_RING}, tc AS (SELECT x, y FROM e UNION SELECT tc.x, e.y FROM tc JOIN e ON tc.y = e.x) SELECT x, y FROM tc")
def tc_cyclic(spark, d):
    return derived(spark, CYCLIC, "r", "x y", e=ring(spark, d))


@query(
    f"WITH RECURSIVE {_PAR}, w AS (SELECT c, p, 1 AS odd FROM par UNION SELECT w.c, par.p, 1 - w.odd FROM w JOIN par ON w.p = par.c)"
    " SELECT c, p, CASE WHEN odd = 1 THEN 'odd' ELSE 'even' END AS distance FROM w"
)
def mutual_recursion(spark, d):
    found = engine_of(spark, par=parents(spark, d)).evaluate(MUTUAL)
    return found["odd"].withColumn("d", F.lit("odd")).union(found["even"].withColumn("d", F.lit("even"))).toDF("c", "p", "distance")


@query(
    "WITH RECURSIVE up AS (SELECT s_suppkey AS c, s_suppkey // 3 AS p FROM supplier WHERE s_suppkey > 0),"
    " sg AS (SELECT a.c AS x, b.c AS y FROM up a JOIN up b ON a.p = b.p UNION SELECT a.c, b.c FROM sg JOIN up a ON a.p = sg.x JOIN up b ON b.p = sg.y) SELECT x, y FROM sg"
)
def same_generation(spark, d):
    up = table(spark, d, "supplier").where("s_suppkey > 0").selectExpr("s_suppkey", "s_suppkey div 3")
    return derived(spark, "sg(?x, ?y) <- [up(?x, ?p), up(?y, ?p)] sg(?x, ?y) <- [up(?x, ?a), sg(?a, ?b), up(?y, ?b)]", "sg", "x y", up=up)


@query("SELECT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT p_partkey // 2 FROM part WHERE p_partkey > 0)")
def stratified_negation(spark, d):
    program = "inner(?y) <- [par(?x, ?y)] leaf(?x) <- [part(?x), !inner(?x)]"
    return derived(spark, program, "leaf", "k", par=parents(spark, d), part=table(spark, d, "part").select("p_partkey"))


@query("SELECT count(*)::BIGINT AS holds FROM (SELECT 1 WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 3))")
def zero_arity(spark, d):
    found = engine_of(spark, nation=table(spark, d, "nation")).evaluate("some() <- [nation(?k, ?n, 3)]")["some"]
    return found.agg(F.count(F.lit(1)).alias("holds"))


# schema rules over triples

# Entailment patterns rdfs2, 3, 5, 7, 9 and 11 of the W3C's RDF Semantics, in its order, with its variable names.
GENERIC = """
T(?yyy, rdf:type, ?xxx) <- [T(?aaa, rdfs:domain, ?xxx), T(?yyy, ?aaa, ?zzz)]                      # rdfs2
T(?zzz, rdf:type, ?xxx) <- [T(?aaa, rdfs:range, ?xxx), T(?yyy, ?aaa, ?zzz)]                       # rdfs3
T(?xxx, rdfs:subPropertyOf, ?zzz) <- [T(?xxx, rdfs:subPropertyOf, ?yyy), T(?yyy, rdfs:subPropertyOf, ?zzz)]  # rdfs5
T(?xxx, ?bbb, ?yyy) <- [T(?aaa, rdfs:subPropertyOf, ?bbb), T(?xxx, ?aaa, ?yyy)]                   # rdfs7
T(?zzz, rdf:type, ?yyy) <- [T(?xxx, rdfs:subClassOf, ?yyy), T(?zzz, rdf:type, ?xxx)]              # rdfs9
T(?xxx, rdfs:subClassOf, ?zzz) <- [T(?xxx, rdfs:subClassOf, ?yyy), T(?yyy, rdfs:subClassOf, ?zzz)]  # rdfs11
"""
#: The same patterns over a relation for each vocabulary term.
VERTICAL = """
instance(?y, ?class) <- [domain(?p, ?class), fact(?y, ?p, ?z)]
instance(?z, ?class) <- [range(?p, ?class), fact(?y, ?p, ?z)]
subproperty(?p, ?r) <- [subproperty(?p, ?q), subproperty(?q, ?r)]
fact(?x, ?q, ?y) <- [subproperty(?p, ?q), fact(?x, ?p, ?y)]
instance(?x, ?above) <- [subclass(?class, ?above), instance(?x, ?class)]
subclass(?c, ?e) <- [subclass(?c, ?d), subclass(?d, ?e)]
"""
_SCHEMA = [("hasBrand", "rdfs:domain", "Product"), ("hasBrand", "rdfs:range", "Brand"), ("hasBrand", "rdfs:subPropertyOf", "describedBy"), ("describedBy", "rdfs:subPropertyOf", "relatedTo"), ("Product", "rdfs:subClassOf", "Thing")]


def _parts(spark, d):
    part = table(spark, d, "part")
    name = F.concat(F.lit("part"), F.col("p_partkey").cast("string"))
    brands = part.select(name.alias("s"), F.lit("hasBrand").alias("p"), F.col("p_brand").alias("o"))
    types = part.select(name.alias("s"), F.lit("rdf:type").alias("p"), F.col("p_type").alias("o"))
    classes = part.select(F.col("p_type").alias("s"), F.lit("rdfs:subClassOf").alias("p"), F.lit("Product").alias("o")).distinct()
    return brands, types, classes


def triple_table(spark: SparkSession, d: str) -> DataFrame:
    brands, types, classes = _parts(spark, d)
    return brands.union(types).union(classes).union(spark.createDataFrame(_SCHEMA, "s string, p string, o string"))


_VALUES = ", ".join(str(x) for x in _SCHEMA)
_T0 = (
    "t0 AS (SELECT 'part' || p_partkey AS s, 'hasBrand' AS p, p_brand AS o FROM part UNION SELECT 'part' || p_partkey, 'rdf:type', p_type FROM part"
    f" UNION SELECT p_type, 'rdfs:subClassOf', 'Product' FROM part UNION SELECT * FROM (VALUES {_VALUES}) v(s, p, o))"
)
# the schema has fixed depth, so its closure is written out
_RDFS = (
    f"WITH {_T0}, sp AS (SELECT s, o FROM t0 WHERE p = 'rdfs:subPropertyOf' UNION SELECT a.s, b.o FROM t0 a JOIN t0 b ON a.o = b.s WHERE a.p = 'rdfs:subPropertyOf' AND b.p = 'rdfs:subPropertyOf'),"
    " sc AS (SELECT s, o FROM t0 WHERE p = 'rdfs:subClassOf' UNION SELECT a.s, b.o FROM t0 a JOIN t0 b ON a.o = b.s WHERE a.p = 'rdfs:subClassOf' AND b.p = 'rdfs:subClassOf'),"
    " t1 AS (SELECT * FROM t0 UNION SELECT s, 'rdfs:subPropertyOf', o FROM sp UNION SELECT s, 'rdfs:subClassOf', o FROM sc UNION SELECT t.s, sp.o, t.o FROM t0 t JOIN sp ON t.p = sp.s),"
    " ty AS (SELECT s, o FROM t1 WHERE p = 'rdf:type' UNION SELECT t1.s, d.o FROM t1 JOIN t0 d ON d.p = 'rdfs:domain' AND d.s = t1.p UNION SELECT t1.o, r.o FROM t1 JOIN t0 r ON r.p = 'rdfs:range' AND r.s = t1.p),"
    " ty2 AS (SELECT * FROM ty UNION SELECT ty.s, sc.o FROM ty JOIN sc ON ty.o = sc.s)"
)


@query(f"{_RDFS} SELECT s, p, o FROM t1 UNION SELECT s, 'rdf:type', o FROM ty2")
def rdfs_generic(spark, d):
    return derived(spark, GENERIC, "T", "s p o", T=triple_table(spark, d))


@query(f"{_RDFS} SELECT s, p, o FROM t1 UNION SELECT s, 'rdf:type', o FROM ty2")
def rdfs_specialised(spark, d):
    found = engine_of(spark, T=triple_table(spark, d)).evaluate(specialised(parse_program(GENERIC)))
    return found["T"].toDF("s", "p", "o")


@query(f"{_RDFS} SELECT s, o FROM ty2")
def rdfs_vertical(spark, d):
    brands, types, classes = _parts(spark, d)
    schema = spark.createDataFrame(_SCHEMA, "s string, p string, o string")
    of = lambda df, p: df.where(F.col("p") == p).select("s", "o")
    relations = {"fact": brands, "instance": types.select("s", "o"), "domain": of(schema, "rdfs:domain"), "range": of(schema, "rdfs:range"), "subproperty": of(schema, "rdfs:subPropertyOf")}
    return derived(spark, VERTICAL, "instance", "s o", subclass=classes.select("s", "o").union(of(schema, "rdfs:subClassOf")), **relations)


# incremental maintenance: one edge in a hundred changes


def _changing(spark, d):
    par = parents(spark, d)
    return par.where("c0 % 100 <> 7"), par.where("c0 % 100 = 7")


def _signed(df: DataFrame, sign: int) -> DataFrame:
    return df.withColumn("_sign", F.lit(sign))


_KEPT = _TC.replace("WHERE p_partkey > 0", "WHERE p_partkey > 0 AND p_partkey % 100 <> 7")


@query(_TC)
def incr_insert(spark, d):
    most, rest = _changing(spark, d)
    engine = engine_of(spark, par=most)
    engine.materialize(LINEAR)
    engine.update({"par": _signed(rest, 1)})
    return engine.relation("anc").toDF("c", "p")


@query(_KEPT)
def incr_delete(spark, d):
    _, rest = _changing(spark, d)
    engine = engine_of(spark, par=parents(spark, d))
    engine.materialize(LINEAR)
    engine.update({"par": _signed(rest, -1)})
    return engine.relation("anc").toDF("c", "p")


@query(_TC.replace("WHERE p_partkey > 0", "WHERE p_partkey > 0 AND p_partkey % 100 <> 8"))
def incr_mixed(spark, d):
    par = parents(spark, d)
    engine = engine_of(spark, par=par.where("c0 % 100 <> 7"))
    engine.materialize(NONLINEAR)
    engine.update({"par": _signed(par.where("c0 % 100 = 7"), 1).union(_signed(par.where("c0 % 100 = 8"), -1))})
    return engine.relation("anc").toDF("c", "p")


@query(_TC)
def dred_multistep(spark, d):
    """A second way up each tree edge (by a node of its own) keeps all ancestors when the first is deleted."""
    par = parents(spark, d)
    around = par.selectExpr("c0", "-c0 AS c1").union(par.selectExpr("-c0", "c1"))
    engine = engine_of(spark, par=par.union(around))
    engine.materialize(RIGHT_LINEAR)
    engine.update({"par": _signed(par.where("c0 % 100 = 7"), -1)})
    return engine.relation("anc").where("c0 >= 0 AND c1 >= 0").toDF("c", "p")


@query("SELECT p_partkey AS c, p_partkey // 2 AS p FROM part WHERE p_partkey > 0")
def retract_rules(spark, d):
    engine = engine_of(spark, par=parents(spark, d))
    engine.materialize(LINEAR)
    engine.retract_rules("anc(?x, ?z) <- [anc(?x, ?y), par(?y, ?z)]")
    return engine.relation("anc").toDF("c", "p")


@query(f"{_TC} WHERE p = 1")
def top_down(spark, d):
    return engine_of(spark, par=parents(spark, d)).ask("anc(?c, 1)", RIGHT_LINEAR).select("c", F.lit(1).cast("long").alias("p"))


@query("SELECT 'anc(1, 0)' AS fact, true AS holds UNION ALL SELECT 'anc(0, 1)', false UNION ALL SELECT 'anc(a, b)', false")
def contains_row(spark, d):
    engine = engine_of(spark, par=parents(spark, d))
    engine.materialize(LINEAR)
    return spark.createDataFrame([(f"anc({a}, {b})", engine.contains_row("anc", (a, b))) for a, b in ((1, 0), (0, 1), ("a", "b"))], "fact string, holds boolean")


@query(f"WITH RECURSIVE {_PAR}, tc AS (SELECT c, p FROM par UNION SELECT tc.c, par.p FROM tc JOIN par ON tc.p = par.c) SELECT 'anc' AS relation, count(*) AS n FROM tc UNION ALL SELECT 'par', count(*) FROM par")
def relation_counts(spark, d):
    engine = engine_of(spark, par=parents(spark, d))
    engine.materialize(LINEAR)
    return engine.relation_counts()


@query("SELECT 'par' AS relation, count(*) AS n FROM part WHERE p_partkey > 0")
def drop_relation(spark, d):
    engine = engine_of(spark, par=parents(spark, d), other=table(spark, d, "region"))
    engine.drop_relation("other")
    return engine.relation_counts()


# files


def _nt_lines(spark, d):
    t = triple_table(spark, d)
    return t.select(F.concat(*[x for c in t.columns for x in (F.lit("<"), facts.expanded(F.regexp_replace(c, " ", "_")), F.lit("> "))], F.lit(".")).alias("value"))


_SPACELESS = f"WITH {_T0} SELECT replace(s, ' ', '_') AS s, p, replace(o, ' ', '_') AS o FROM t0"


@query(_SPACELESS)
def ntriples_scan(spark, d):
    return facts.triples(_nt_lines(spark, d)).distinct().toDF("s", "p", "o")


@query(_SPACELESS)
def dump_and_reload(spark, d):
    path = f"{shared_folder(spark)}/ruleloom/dump-{uuid.uuid4().hex}"
    facts.write_triples(facts.triples(_nt_lines(spark, d)).distinct(), path)
    return facts.triples(facts.read_lines(spark, path)).toDF("s", "p", "o")


@query("SELECT DISTINCT p_partkey::VARCHAR AS part, replace(p_brand, ' ', '_') AS brand FROM part")
def spacesep_scan(spark, d):
    lines = table(spark, d, "part").select(F.concat_ws(" ", F.col("p_partkey").cast("string"), F.regexp_replace("p_brand", " ", "_"), F.lit("brand")).alias("value"))
    return facts.relation_of(facts.spaced_facts(lines), "brand", 2).distinct().toDF("part", "brand")


@query("SELECT 'Supplier' AS predicate, 's' || s_suppkey AS x, NULL::VARCHAR AS y FROM supplier UNION ALL SELECT 'locatedIn', 's' || s_suppkey, 'n' || s_nationkey FROM supplier")
def university_scan(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("s"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("n"))
    kind = s.select(F.concat(F.lit("<"), "s", F.lit(f"> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{facts.UNIVERSITY}Supplier> .")).alias("value"))
    place = s.select(F.concat(F.lit("<"), "s", F.lit(f"> <{facts.UNIVERSITY}locatedIn> <"), "n", F.lit("> .")).alias("value"))
    other = s.select(F.concat("s", F.lit(" <other> x .")).alias("value"))
    found = facts.university_facts(kind.union(place).union(other))
    return found.select("predicate", F.get("terms", F.lit(0)).alias("x"), F.get("terms", F.lit(1)).alias("y"))


# streams


@query("SELECT DISTINCT a.user_id AS u FROM events a JOIN events b USING (user_id) WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def stream_epochs(spark, d):
    visits = staged(table(spark, d, "events").select(F.col("user_id").alias("c0"), F.col("event_type").alias("c1")).repartition(3), "visits")
    engine = Engine(spark)
    engine.register("visit", visits.limit(0))
    engine.materialize("both(?u) <- [visit(?u, click), visit(?u, purchase)]")
    stream = spark.readStream.schema(visits.schema).option("maxFilesPerTrigger", 1).parquet(visits._staged_at)
    Epochs(engine, "visit", f"{shared_folder(spark)}/ruleloom/epochs-{uuid.uuid4().hex}").start(stream).awaitTermination()
    return engine.relation("both").toDF("u")
