"""The queries: against their SQL where there is one, and the pipeline against plain Python."""

import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.compare import connect, duck_table, duck_types, spark_table, spark_types
from tests.llm.frames import documents, edited, prose
from tidemark.llm import queries
from tidemark.llm.oracles import oracle_sql

SF_DIR = "/root/testdata/sf0.001"


def test_each_operator_has_one_query():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.queries())
    assert numbers == list(range(1, 14))
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())
    assert set(oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    database = connect(SF_DIR)
    for table in ("documents", "conversations"):
        database.sql(
            f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'"
        )
    df, sql = queries.queries()[name](spark, SF_DIR), oracle_sql()[name]
    assert spark_types(df) == duck_types(database, sql)
    assert spark_table(df) == duck_table(database, sql)


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    corpus = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    clean = [r.text for r in corpus.where("length(text) BETWEEN 1500 AND 2500 AND lang = 'en'").limit(8).collect()]
    clean = list(dict.fromkeys(clean))
    passage = prose(40, 99)
    rows = [(k, t, "en", "ab"[k % 2]) for k, t in enumerate(clean)]
    rows += [(100, clean[0], "en", "a"), (101, edited(clean[1], [5]), "en", "b")]
    rows += [(102, clean[2][:400] + " " + passage + " " + clean[3][:300], "en", "a")]
    rows += [(103, "123 456 %", "en", "b"), (104, None, "en", "b"), (105, "", None, None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        seen[name] = {r.doc_id for r in docs.collect()}
    everything = set(range(len(clean)))
    assert seen["language_id"] == everything | {100, 101, 102}
    assert seen["near_dedup"] == everything | {102}
    assert seen["decontamination"] == everything
    assert seen["mixing"] <= everything and len(seen["mixing"]) >= len(everything) - 1
    total = sum(len(t.split()) for t in clean)
    mixed = sum(len(r.text.split()) for r in docs.collect())
    assert abs(mixed - 1.5 * total) <= 0.05 * total
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert final.count() == docs.count()
