"""Times of the headline queries: one JSON line.

BENCH_SF_DIR: folder of the tables. BENCH_CPUS: threads. BENCH_RUNS: runs of each query after a first one, and of the
phases; the median counts. The phases load 99 % of the facts, add the rest and remove it again; scratch is a
materialisation of all facts at once. rows has the number of facts after each phase.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom import harness, queries
from ruleloom.plans.rewrites import specialised
from ruleloom.plans.text import parse_program

HEADLINE = ["tc_linear", "tc_nonlinear", "tc_cyclic", "mutual_recursion", "rdfs_generic", "rdfs_specialised", "rdfs_vertical", "incr_insert", "incr_delete", "incr_mixed", "triangle", "join_multi_key", "stratified_negation"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(run) -> float:
        began = time.time()
        out = run()
        if isinstance(out, DataFrame):
            out.write.format("noop").mode("overwrite").save()
        return time.time() - began

    found: dict[str, float] = {}
    for name in HEADLINE:
        run = lambda name=name: queries.QUERIES[name](spark, folder)
        timed(run)
        found[name] = round(median(timed(run) for _ in range(runs)), 3)
    rows: dict[str, int] = {}
    par, ring, triples = queries.parents(spark, folder), queries.ring(spark, folder), queries.triple_table(spark, folder)
    programs = {
        "linear": ({"par": par}, parse_program(queries.LINEAR)),
        "nonlinear": ({"par": par}, parse_program(queries.NONLINEAR)),
        "cyclic": ({"e": ring}, parse_program(queries.CYCLIC)),
        "mutual": ({"par": par}, parse_program(queries.MUTUAL)),
        "rdfs_generic": ({"T": triples}, parse_program(queries.GENERIC)),
        "rdfs_specialised": ({"T": triples}, specialised(parse_program(queries.GENERIC))),
    }
    for name, (relations, program) in programs.items():
        seen = [harness.phases(spark, relations, program, 0.99) | {"scratch": harness.scratch(spark, relations, program)} for _ in range(runs)]
        for phase in seen[0]:
            found[f"phases_{name}_{phase}"] = round(median(x[phase]["seconds"] for x in seen), 3)
            rows[f"{name}_{phase}"] = seen[0][phase]["rows"]
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "rows": rows, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
