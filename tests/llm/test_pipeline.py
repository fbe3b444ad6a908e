import os
import sys

import __spark_entry__ as entry
import corpus_pipeline
from ruleloom.llm import jaccard, secrets

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER).cache()
        assert after.columns == names, name
        ids, kept = {r.doc_id for r in docs.collect()}, {r.doc_id for r in after.collect()}
        assert kept <= ids and len(kept) > 0.5 * len(ids)
        if name == "near_duplicates":
            assert kept == {r.doc_id for r in jaccard.join(docs).collect() if r.doc_id == r.component_id}
        if name == "secrets":
            assert kept == ids and not any(secrets.base_spans(r.text) for r in after.collect())
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.count() == docs.count() and "batch_id" in packed.columns


ODD = [
    (1, "one two three four five six seven", "en", "a", 33, 9, "q"),
    (1, "one two three four five six seven", "en", "a", 33, 9, "q"),
    (1, "another text of the same id with words enough", "en", None, 45, 8, "r"),
    (2, "One  two three four five six seven", None, "b", 34, 7, "s"),
    (3, None, None, None, None, None, None),
    (4, "", "de", "b", 0, 6, "t"),
    (None, "one two three four five six seven", "en", "a", 33, 5, "u"),
    (5, 'password = "hunter2-hunter2-hunter2" ' + "w " * 30_000, "en", "b", 60_037, 4, "v"),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score int, row string"


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, and columns with names that the operators use themselves."""
    spark.createDataFrame([(1, 0), (5, 0), (77, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(ODD, COLUMNS)
    toxicity, near, hidden, mix, pack = (stage for _, stage in corpus_pipeline.STAGES)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(toxicity(spark, docs, str(tmp_path))) == key(docs)
    kept = near(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and key(kept) == sorted([ODD[0], *ODD[2:3], *ODD[4:]], key=str)
    after = hidden(spark, kept, str(tmp_path))
    assert after.columns == docs.columns and {r.doc_id: r.text for r in after.where("doc_id = 5").collect()}[5].startswith('[SECRET]" w w') and after.count() == kept.count()
    mixed = mix(spark, after, str(tmp_path))
    assert mixed.columns == docs.columns and {r.row for r in mixed.collect()} <= {"q", "r", "u", "v"} and all(r.n_chars == len(r.text) for r in mixed.collect())
    assert pack(spark, mixed, str(tmp_path)).count() == mixed.count()


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")] and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_run_and_registration(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 100 and corpus_pipeline.ORACLE_SQL is None
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_entry_without_the_subpackage():
    import subprocess

    code = "import sys; sys.modules['ruleloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__), check=True)
    assert out.stdout.split()[1] == "False"
