"""Fact files as relations. All parsing is column expressions over lines, so files of any size are split by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.pinning import staged

# The vocabulary names that have short forms, by namespace.
VOCABULARY = {
    "rdf": ("http://www.w3.org/1999/02/22-rdf-syntax-ns#", "type rest first nil Property"),
    "rdfs": ("http://www.w3.org/2000/01/rdf-schema#", "subClassOf subPropertyOf domain range comment label Literal"),
    "owl": (
        "http://www.w3.org/2002/07/owl#",
        "TransitiveProperty inverseOf Thing maxQualifiedCardinality someValuesFrom equivalentClass intersectionOf members equivalentProperty onProperty propertyChainAxiom disjointWith propertyDisjointWith"
        " unionOf hasKey allValuesFrom complementOf onClass distinctMembers FunctionalProperty NamedIndividual ObjectProperty Class AllDisjointClasses Restriction DatatypeProperty Ontology AsymmetricProperty"
        " SymmetricProperty IrreflexiveProperty AllDifferent InverseFunctionalProperty sameAs hasValue Nothing oneOf",
    ),
}
#: The prefix of the university benchmark's classes and properties (a fixed value).
UNIVERSITY = "http://www.lehigh.edu/~zhp2/2004/0401/univ-bench.owl#"
SHORT = {base + name: f"{prefix}:{name}" for prefix, (base, names) in VOCABULARY.items() for name in names.split()}


def _mapped(value: Column, pairs: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(table[value], value)


def shortened(value: Column) -> Column:
    """A vocabulary IRI as prefix:name; any other string as it is."""
    return _mapped(value, SHORT)


def expanded(value: Column) -> Column:
    """The inverse of shortened()."""
    return _mapped(value, {v: k for k, v in SHORT.items()})


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A text file's lines, in a column named value."""
    return spark.read.text(path)


def triples(lines: DataFrame) -> DataFrame:
    """T(subject, predicate, object) of N-Triples lines.

    Angle brackets and single dots are dropped; the object is all that is left, joined with spaces; vocabulary names
    are shortened. Lines with fewer than three tokens are skipped.
    """
    tokens = F.filter(F.split(F.translate("value", "<>", ""), "\\s+"), lambda x: (x != "") & (x != "."))
    rows = lines.select(tokens.alias("t")).where(F.size("t") >= 3)
    return rows.select(shortened(F.col("t")[0]).alias("c0"), shortened(F.col("t")[1]).alias("c1"), shortened(F.array_join(F.slice("t", F.lit(3), F.size("t")), " ")).alias("c2"))


def university_facts(lines: DataFrame, prefix: str = UNIVERSITY) -> DataFrame:
    """predicate, terms of N-Triples lines: rdf:type gives a unary fact of the class, a prefixed property a binary one; the rest is skipped."""
    t = triples(lines)
    local = lambda c: F.when(F.startswith(c, F.lit(prefix)), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)
    is_type = F.col("c1") == "rdf:type"
    predicate = F.when(is_type, local(F.col("c2"))).otherwise(local(F.col("c1")))
    terms = F.when(is_type, F.array("c0")).otherwise(F.array("c0", "c2"))
    return t.where(is_type | F.startswith("c1", F.lit(prefix))).select(predicate.alias("predicate"), terms.alias("terms"))


def spaced_facts(lines: DataFrame) -> DataFrame:
    """predicate, terms of lines of tokens between spaces and tabs: the last token is the predicate, the others strings. Blank lines are skipped."""
    tokens = F.filter(F.split("value", "[ \\t]+"), lambda x: x != "")
    rows = lines.select(tokens.alias("t")).where(F.size("t") > 0)
    return rows.select(F.element_at("t", -1).alias("predicate"), F.slice("t", F.lit(1), F.size("t") - 1).alias("terms"))


def relation_of(facts: DataFrame, predicate: str, arity: int) -> DataFrame:
    """The facts of one predicate as columns c0, c1, ...; those of another arity are left out."""
    return facts.where((F.col("predicate") == predicate) & (F.size("terms") == arity)).select(*[F.col("terms")[i].alias(f"c{i}") for i in range(arity)])


def relations(facts: DataFrame) -> dict[str, DataFrame]:
    """A relation for each predicate (their names and arities come to the driver). Two arities of one name are refused.

    The facts are parsed once and written by predicate, so each relation reads its own files.
    """
    facts = staged(facts.where("predicate IS NOT NULL"), "facts", "predicate")
    names = [(r["predicate"], r["n"]) for r in facts.select("predicate", F.size("terms").alias("n")).distinct().collect()]
    if len(names) != len(dict(names)):
        raise ValueError("a predicate has facts of different numbers of terms")
    return {p: relation_of(facts, p, n) for p, n in sorted(names)}


def write_triples(relation: DataFrame, path: str) -> None:
    """Write rows of three string columns as lines `s p o .`, vocabulary names expanded."""
    line = F.concat_ws(" ", *[expanded(F.col(c)) for c in relation.columns], F.lit("."))
    relation.select(line.alias("value")).write.mode("append").text(path)
