import numpy as np
from pyspark.sql import functions as F

from tests.llm.frames import documents, prose
from tidemark.llm import toxicity

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    corpus = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").selectExpr("doc_id", "toxic AS label")
    held_out = F.expr("crc32(CAST(doc_id AS string)) % 3 = 1")
    rows = corpus.join(labels, "doc_id")
    model = toxicity.fit(rows.where(~held_out))
    out = toxicity.score(rows.where(held_out), model).select("document.label", "predicted", "score").collect()
    assert sum(r.label == r.predicted for r in out) >= 0.96 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def labelled(spark, swap):
    """Toxic texts mention one group more often than the others do, next to an insult."""
    rows = []
    for k in range(300):
        toxic = k % 3 == 0
        group = "muslim" if toxic or k % 30 == 1 else "christian" if k % 30 == 2 else "people"
        rows.append((int(toxic), f"{prose(15, k, 60)} {group} {'idiot' if toxic and k % 2 else 'plain'}", k))
    return toxicity.fit(spark.createDataFrame(rows, "label int, text string, k int"), swap_penalty=swap)


def weight(model, word):
    """Score of a text's word with all of its beginnings."""
    at = np.isin(model.words, toxicity._codes(word))
    return model.weights[at].sum()


def test_swaps_pull_identity_terms_together(spark):
    free, held = labelled(spark, 0.0), labelled(spark, 3.0)
    gap = [abs(weight(m, "muslim") - weight(m, "christian")) for m in (free, held)]
    assert gap[1] < 0.25 * gap[0]
    assert weight(held, "idiot") > 1.0


def test_empty_texts_nulls_and_constant_labels(spark):
    df = documents(spark, [(1, None), (2, ""), (3, "Idiot! idiot"), (3, "Idiot! idiot")]).selectExpr("*", "9 AS score")
    model = labelled(spark, 1.0)
    out = {r.document.doc_id: r for r in toxicity.score(df, model).collect()}
    assert out[1].score == out[2].score and out[3].score > out[1].score
    schema = "label int, text string"
    for rows, want in (([(1, "a"), (1, "b")], 1), ([(0, "a")], 0), ([(None, "a"), (1, None)], 0), ([], 0)):
        model = toxicity.fit(spark.createDataFrame(rows, schema))
        assert {r.predicted for r in toxicity.score(df, model).collect()} == {want}
    assert toxicity.score(df.limit(0), model).count() == 0


def test_sample_is_bounded(spark):
    rows = [(k % 2, f"w{k % 2} common x{k}") for k in range(400)]
    model = toxicity.fit(spark.createDataFrame(rows, "label int, text string"), sample_rows=100)
    assert np.isfinite(model.bias) and np.isfinite(model.weights).all()
