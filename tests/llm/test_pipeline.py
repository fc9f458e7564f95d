import hashlib
import os
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from fleetlife.llm import language, mixing, queries, toxicity
from test_simhash import signed, slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def staged(docs, folder):
    docs.write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def test_run_agrees_with_a_brute_force_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    matcher_model = toxicity.fit_toxicity(docs, labels)
    matcher = toxicity.Matcher(matcher_model.automaton)
    kept = [r for r in docs.collect() if matcher_model.score(matcher.hits(r.text)) < 0.5]
    model = language.fit_language(staged(spark.createDataFrame(kept, docs.schema), str(tmp_path / "a")))
    found = zip(kept, *model.predict([r.text for r in kept]), strict=True)
    kept = [r for r, _, share in found if share >= cp.LEAST_SHARE]
    prints = {r.doc_id: signed(slow_fingerprint(r.text, 3)) for r in kept}
    root = slow_components(set(prints.values()))
    first = {}
    for r in kept:
        k = root[prints[r.doc_id]]
        first[k] = min(first.get(k, r.doc_id), r.doc_id)
    kept = [r for r in kept if first[root[prints[r.doc_id]]] == r.doc_id]
    import duckdb

    db = duckdb.connect()
    db.register("documents", __import__("pandas").DataFrame([r.asDict() for r in kept]))
    mix = db.execute(f"select doc_id, text from ({mixing.mix_sql()})").fetchall()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text in mix:
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(tuple(r) for r in cp.run(spark, SF).collect()) == sorted(want)


def test_stages_keep_the_columns_and_take_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (900, "", "en", "s", 0), (901, "x" * 200_000, None, None, 1), (0, "again", "en", "src0", 5)], docs.schema)
    now = docs.unionByName(odd)
    for i, (_, step) in enumerate(cp.STAGES):
        out = staged(step(spark, now, SF), str(tmp_path / str(i)))
        if i + 1 < len(cp.STAGES):
            assert out.columns == docs.columns and out.count() > 50
            now = out
    assert out.count() == now.count()


@pytest.mark.parametrize("n", range(5))
def test_stages_on_an_empty_table(spark, n):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert cp.STAGES[n][1](spark, docs, SF).collect() == []


def test_language_stage_keeps_all_where_nothing_can_be_learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    letters = docs.where(F.col("text").rlike("\\p{L}")).count()
    assert cp.STAGES[1][1](spark, blank, SF).count() == letters > 100
    folds = docs.withColumn("lang", F.when(language.fold_of("doc_id", language.FOLDS) == language.HELD_OUT, F.col("lang")))
    assert cp.STAGES[1][1](spark, folds, SF).count() == letters


def test_queries_are_registered():
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 14))


def test_warc_query_agrees_with_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted(db.execute(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({queries.warc_sql()})").fetchall(), key=str)
    assert sorted((tuple(r) for r in queries.op3_warc(spark, SF).collect()), key=str) == want


def test_the_entry_works_without_these_operators(tmp_path):
    code = (
        "import sys\nclass Gone:\n    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'fleetlife.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\nimport __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and 'lifespans' in e.queries() and e.oracle_sql()\n")
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, timeout=120)
