import pytest
from pyspark.sql import functions as F

from tests.llm.frames import documents, prose, rows
from tidemark.llm import language

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_held_out_accuracy(spark, corpus):
    held_out = F.expr("crc32(CAST(doc_id AS string)) % 4 = 2")
    contents = language.dictionaries(corpus.where(~held_out))
    assert set(contents) == {"de", "en", "es", "fr"}
    found = language.identify(corpus.where(held_out), contents).select("document.lang", "lang_pred", "score")
    out = [(r.lang, r.lang_pred) for r in found.collect()]
    assert sum(a == b for a, b in out) >= 0.95 * len(out)


def test_undetermined_and_margins(spark, corpus):
    contents = language.dictionaries(corpus)
    df = documents(spark, [(1, None), (2, ""), (3, "12 &%$ _"), (4, "the and of that with this"), (5, "the and of that with this")])
    df = df.selectExpr("*", "1 AS score", "'x' AS lang_pred")
    out = {r.document.doc_id: r for r in language.identify(df, contents).collect()}
    for k in (1, 2, 3):
        assert (out[k].lang_pred, out[k].score, out[k].rejected) == ("und", 0.0, True)
    assert out[4].lang_pred == "en" and 0 < out[4].score <= 1 and not out[4].rejected
    assert out[4].document.lang_pred == "x"
    assert {r.rejected for r in language.identify(df, contents, 1.1).collect()} == {True}


def test_whole_text_counts(spark, corpus):
    """A text that turns to another language after its first block is judged by all of it."""
    contents = language.dictionaries(corpus)
    texts = dict(corpus.groupBy("lang").agg(F.concat_ws(" ", F.collect_list("text"))).collect())
    mixed = texts["en"][:3000] + " " + texts["fr"][:30000]
    out = language.identify(documents(spark, [(1, mixed)]), contents).first()
    assert out.lang_pred == "fr"


def test_little_to_learn_from(spark):
    df = documents(spark, [(1, "uno dos tres", "es", None), (2, None, "en", None), (3, "x", None, None)])
    assert set(language.dictionaries(df)) == {"es"}
    assert language.dictionaries(df.limit(0)) == {}
    assert rows(language.identify(df, language.dictionaries(df)), "lang_pred") == [("es",), ("es",), ("und",)]
    assert rows(language.identify(df, {}), "lang_pred") == [("und",)] * 3
    assert language.identify(df.limit(0), {}).count() == 0


def test_dictionaries_are_bounded(spark, corpus):
    contents = language.dictionaries(corpus, dictionary_bytes=500, sample_rows=3, passage_chars=100)
    assert all(0 < len(c) <= 500 for c in contents.values())


def test_copies_change_no_dictionary(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [(k, prose(12, k).translate(letters), "en", None) for k in range(60)]
    df = documents(spark, texts)
    copies = df.where("doc_id = 0").crossJoin(spark.range(40_000).select(F.col("id").alias("copy")))
    repeated = df.unionByName(copies.drop("copy"))
    want = language.dictionaries(df, sample_rows=20)
    assert want["en"] and language.dictionaries(repeated, sample_rows=20) == want
