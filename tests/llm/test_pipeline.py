import os
import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import decontam, langid, packing, simhash_dedup, toxicity
from ledgerloom.llm.common import shipped
from ledgerloom.llm.queries import QUERIES, table

from ..conftest import DATA
from .fixtures import documents, prose, rows


def test_names():
    import __spark_entry__

    assert [f"op{n}_" for n in range(1, 14)] == [k[: k.index("_") + 1] for k in QUERIES] and "pipeline" in __spark_entry__.queries()


def test_models_are_read_where_the_package_is_not_installed(spark):
    """What tasks get holds its classes: a Python that can't import this package reads it."""
    sent = []

    class Context:
        def broadcast(self, value):
            sent.append(value)

    class Session:
        sparkContext = Context()

    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (8, 0), (9, 0)], "doc_id long, toxic int")
    shipped(Session(), toxicity.fit(docs, labels, "doc_id", "text", "toxic", 5, 0, 1536, 1e-4, 15))
    shipped(Session(), decontam.Items([1], ["some words of an item"], 3))
    shipped(Session(), langid.fit(docs, "doc_id", "text", "lang"))
    for value in sent:
        code = "import pickle, sys; x = pickle.load(sys.stdin.buffer); assert 'ledgerloom' not in sys.modules, sys.modules; print(type(x).__name__)"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        subprocess.run([sys.executable, "-c", code], input=value, cwd="/", env=env, check=True, capture_output=True)


def test_pipeline_matches_stages_applied_by_hand(spark):
    docs = table(spark, DATA, "documents")
    labels, benchmark = table(spark, DATA, "labels"), table(spark, DATA, "benchmark")
    known = {r.doc_id for r in docs.select("doc_id", langid.identifier(docs, margin=0.2)("text").alias("x")).where("x.lang_pred <> 'und' AND NOT x.ambiguous").collect()}
    docs = docs.where(docs.doc_id.isin(list(known)))
    calm = {r.doc_id for r in toxicity.score(docs, labels).where("score < 0.5").collect()}
    docs = docs.where(docs.doc_id.isin(list(calm)))
    first = {r.doc_id for r in simhash_dedup.near_duplicates(docs).collect() if r.doc_id == r.component_id}
    docs = docs.where(docs.doc_id.isin(list(first)))
    clean = {r.doc_id for r in decontam.scan(docs, benchmark, ["doc_id"]).collect() if not r.leaks}
    want = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.pack(docs.where(docs.doc_id.isin(list(clean)))).collect())
    got = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want
    assert 0 < len(clean) < len(first) < len(calm) < len(known)


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like those that stages use inside come out as they went in."""
    names = ["language", "toxicity", "score", "leaks", "kept", "copy", "key", "id", "mark", "fingerprint"]
    docs = documents(spark).select("doc_id", "text", "lang", "source", *(F.lit(f"mine {k}").alias(n) for k, n in enumerate(names)), F.create_map(F.lit("a"), F.lit(1)).alias("more"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", *names, "more"]
    kept = docs.collect()
    assert kept and all([r[n] for n in names] == [f"mine {k}" for k in range(len(names))] for r in kept)


def test_different_texts_under_one_id_are_judged_by_themselves(spark):
    one, two, three = prose(21, 80), prose(22, 80), prose(23, 80)
    data = [(1, one), (5, one), (5, two), (5, two), (None, three), (None, three), (None, one), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in data], "doc_id long, text string, lang string, source string")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, DATA).collect()), key=str)
    assert kept == sorted([(1, one), (5, two), (None, three), (7, None)], key=str)


def test_stages_take_edge_rows(spark):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == documents(spark).columns
    kept = [r.doc_id for r in docs.collect()]
    assert kept.count(1) == 1 and 2 not in kept and 4 not in kept and kept.count(9) == 1
    assert len(rows()) > len(kept)
    assert all(stage(spark, documents(spark).where("false"), DATA).count() == 0 for _, stage in corpus_pipeline.STAGES)
