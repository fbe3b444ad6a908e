import pytest
from pyspark.sql import functions as F

from ruleloom import Engine
from ruleloom.harness import phases
from ruleloom.plans.text import parse_program
from ruleloom.sources import facts
from ruleloom.sources.programs import read_program
from ruleloom.streaming.epochs import Epochs


def lines(spark, *text):
    return spark.createDataFrame([(x,) for x in text], "value string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_triples(spark):
    found = facts.triples(lines(spark, '<http://a> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/2002/07/owl#Class> .', '<b> <c> "two words" .', "too short"))
    assert rows(found) == [("b", "c", '"two words"'), ("http://a", "rdf:type", "owl:Class")]


def test_spaced_facts(spark):
    found = facts.relations(facts.spaced_facts(lines(spark, "a b\tedge", "  b   c edge ", "", "n1 node")))
    assert rows(found["edge"]) == [("a", "b"), ("b", "c")] and rows(found["node"]) == [("n1",)]
    with pytest.raises(ValueError, match="different numbers"):
        facts.relations(facts.spaced_facts(lines(spark, "a b edge", "a edge")))


def test_university_facts(spark):
    p = facts.UNIVERSITY
    found = facts.university_facts(lines(spark, f"<s> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{p}Student> .", f"<s> <{p}takes> <c> .", "<s> <other> <c> ."))
    assert sorted((r.predicate, tuple(r.terms)) for r in found.collect()) == [("Student", ("s",)), ("takes", ("s", "c"))]


def test_write_and_read(spark, tmp_path):
    facts.write_triples(spark.createDataFrame([("a", "rdf:type", "owl:Class")], "c0 string, c1 string, c2 string"), f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["a http://www.w3.org/1999/02/22-rdf-syntax-ns#type http://www.w3.org/2002/07/owl#Class ."]
    assert rows(facts.triples(facts.read_lines(spark, f"{tmp_path}/out"))) == [("a", "rdf:type", "owl:Class")]
    (tmp_path / "p.dl").write_text("p(?x) <- [q(?x)]\nr(?x) <- [p(?x)]\n")
    assert read_program(spark, str(tmp_path / "p.dl")) == parse_program("p(?x) <- [q(?x)] r(?x) <- [p(?x)]")


def test_phases(spark):
    edges = spark.range(1, 60).selectExpr("id AS c0", "id div 2 AS c1")
    out = phases(spark, {"e": edges}, parse_program("a(?x, ?y) <- [e(?x, ?y)] a(?x, ?z) <- [a(?x, ?y), e(?y, ?z)]"), 0.8)
    assert out["load"]["rows"] == out["remove"]["rows"] < out["add"]["rows"]


def test_epochs_survive_a_restart(spark, tmp_path):
    program = "both(?u) <- [visit(?u, a), visit(?u, b)]"
    source, folder = f"{tmp_path}/in", f"file://{tmp_path}/state"

    def put(name, values):
        spark.createDataFrame(values, "c0 long, c1 string, _sign int").coalesce(1).write.parquet(f"{source}/{name}")

    def run():
        engine = Engine(spark)
        engine.insert("visit", (0, "x"))
        engine.materialize(program)
        epochs = Epochs(engine, "visit", folder, changes=f"{tmp_path}/changes")
        stream = spark.readStream.schema("c0 long, c1 string, _sign int").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(source)
        epochs.start(stream).awaitTermination()
        return engine, epochs

    put("1", [(1, "a", 1), (2, "a", 1), (2, "b", 1)])
    engine, epochs = run()
    assert rows(engine.relation("both")) == [(2,)]
    epochs.apply(spark.createDataFrame([(1, "b", 1)], "c0 long, c1 string, _sign int"), epochs.applied)  # seen before: skipped
    assert rows(engine.relation("both")) == [(2,)]
    put("2", [(1, "b", 1), (2, "a", -1)])
    engine, epochs = run()
    assert rows(engine.relation("both")) == [(1,)]
    changes = spark.read.parquet(f"{tmp_path}/changes/both").where(F.col("epoch") == epochs.applied)
    assert sorted((r.c0, r._sign) for r in changes.collect()) == [(1, 1), (2, -1)]
