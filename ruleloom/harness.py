"""Three phases over fact and rule files: load a share of the facts, add the rest, remove the rest.

python -m ruleloom.harness FACTS PROGRAM SHARE [nt|spaced|university] [--specialise]
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.engine import Engine
from ruleloom.plans.rewrites import specialised
from ruleloom.plans.rules import Program
from ruleloom.sources import facts
from ruleloom.sources.programs import read_program


def split(df: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """Two parts by a hash of the whole row; the first has about that share."""
    at = F.pmod(F.xxhash64(*df.columns), F.lit(1_000_000))
    return df.where(at < share * 1_000_000), df.where(at >= share * 1_000_000)


def phases(spark: SparkSession, relations: dict[str, DataFrame], program: Program, share: float) -> dict[str, dict[str, float]]:
    """Seconds and rows after each of the phases load, add and remove."""
    engine, out = Engine(spark), {}
    engine.materialize(program)
    parts = {name: split(df, share) for name, df in relations.items()}
    for phase, which, sign in (("load", 0, 1), ("add", 1, 1), ("remove", 1, -1)):
        began = time.time()
        engine.update({name: part[which].withColumn("_sign", F.lit(sign)) for name, part in parts.items()})
        out[phase] = {"seconds": round(time.time() - began, 2), "rows": engine.count()}
    return out


def scratch(spark: SparkSession, relations: dict[str, DataFrame], program: Program) -> dict[str, float]:
    """Seconds and rows of one materialisation of all facts: what an update has to be cheaper than."""
    engine = Engine(spark)
    for name, df in relations.items():
        engine.register(name, df)
    began = time.time()
    engine.materialize(program)
    return {"seconds": round(time.time() - began, 2), "rows": engine.count()}


def main(args: list[str]) -> None:
    special = "--specialise" in args
    path, rules, share, *kind = [a for a in args if a != "--specialise"]
    spark = SparkSession.builder.appName("ruleloom").getOrCreate()
    lines = facts.read_lines(spark, path)
    kind = (kind or ["nt"])[0]
    relations = {"T": facts.triples(lines)} if kind == "nt" else facts.relations(facts.spaced_facts(lines) if kind == "spaced" else facts.university_facts(lines))
    program = read_program(spark, rules)
    for phase, found in phases(spark, relations, specialised(program) if special else program, float(share)).items():
        print(f"{phase}: {found['seconds']} s, {found['rows']} rows")


if __name__ == "__main__":
    main(sys.argv[1:])
