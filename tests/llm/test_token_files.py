import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import AddedToken, Tokenizer

import corpus_pipeline
from tests.llm.frames import documents, prose, rows
from tidemark.llm import queries, token_files
from tidemark.llm.textbytes import blocks
from tidemark.session import small_batches

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  a", "a  b", "a\n b", "a \n b", "it's 's 're' 'x a'b", "x y  z ", "é中文 \U0001f600 à,",
    "a\x1c b \x1c", "<|endoftext|> a <|endoftext|>b", "1234 567,89 ² Ⅷ", "\t\ta \t b", "\r\n x \r\n",
    "a\0b \0", "Straße, «été»... d'accord!", "\n\n\n", "a\n\nb\nc", prose(300), "ʼn Ǆx ⅐", "a_b c-d", "é x",
]


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def test_encoder_equals_tokenizer(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "_REMEMBERED", 40)
    monkeypatch.setattr(token_files, "_LASTING", 10)
    token_files._parts.cache_clear()
    encoder = token_files._Encoder(PATH)
    for text in TEXTS * 2:
        assert encoder(text).tolist() + [0] == ids(tokenizer, text), text
    token_files._parts.cache_clear()


def blocks_of(texts, limit=1 << 20):
    return [block for _, block in blocks(pa.array(texts, pa.string()), limit)]


@pytest.mark.parametrize("special_as_text", [True, False])
@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_texts_of_a_block_together_equal_tokenizer(special_as_text, limit):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = special_as_text
    marks = [
        "a. b.. c", "it's. don't,no 's.a", "é. è,", "end.", " lead", "trail ", "a.\n", "a\u00a0 b", "a\u3000 b",
        "\u201cq\u201d \u2018x\u2019.", "a\u0085b", "a \u2009b", "a\u200b b", "x \u180e y", "1.5 a1.b2",
    ]
    texts = TEXTS + marks + [None, *TEXTS[::-1]]
    encoder, found = token_files._Encoder(PATH, special_as_text), []
    for block in blocks_of(texts, limit):
        together, counts = encoder.together(block)
        found += np.split(together, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in found] == [ids(tokenizer, text) for text in texts]


def test_a_part_is_looked_up_once_in_a_block(monkeypatch):
    asked = []
    places = token_files._Encoder._places
    monkeypatch.setattr(
        token_files._Encoder, "_places", lambda self, x: asked.extend(x) or places(self, x)
    )
    (block,) = blocks_of(["over and over and over.", "and over, and over"] * 50)
    token_files._Encoder(PATH).together(block)
    assert sorted(asked) == sorted(["over", " and", " over", ".", "and", ","])


def test_few_documents_go_to_python_at_once(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])

    key, counted = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.range(5000, numPartitions=1)
    before = spark.conf.get(key, None)
    with small_batches(spark):
        assert max(r.n for r in counted.mapInArrow(sizes, "n long").collect()) == 2000
    assert spark.conf.get(key, None) == before
    assert max(r.n for r in counted.mapInArrow(sizes, "n long").collect()) == 5000


def test_files_round_trip(spark, tokenizer):
    texts = [(9 * k - 50, t) for k, t in enumerate(TEXTS)] + [(1000, None), (None, "n")]
    df = documents(spark, texts).selectExpr("*", "1 AS shard", "2 AS tokens")
    got = {r.doc_id: r for r in token_files.token_files(df, PATH).collect()}
    start = 0
    for doc_id, text in sorted(texts, key=lambda x: -99 if x[0] is None else x[0]):
        want = ids(tokenizer, text)
        row = got[doc_id]
        assert (row.start, row.n_tokens) == (start, len(want))
        assert row.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)


def test_repeated_ids_and_empty_table(spark):
    df = documents(spark, [(1, "a"), (1, "a"), (1, "b c"), (0, "")])
    out = rows(token_files.token_files(df, PATH), "doc_id", "start", "n_tokens")
    assert [r[0] for r in out] == [0, 1, 1, 1] and sorted(r[1] for r in out)[:2] == [0, 1]
    assert sum(r[2] for r in out) == 1 + 2 + 2 + 3
    assert token_files.token_files(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize(
    "added", [[], ["<|end", "<|endoftext|><|"], [AddedToken("<|pad|>", lstrip=True, special=True)]]
)
def test_added_tokens_as_a_tokenizer_at_its_defaults(tmp_path, added):
    """The second list has tokens that overlap, the third one that takes blanks with it."""
    default = Tokenizer.from_file(PATH)
    default.add_special_tokens(added)
    path = str(tmp_path / "tokenizer.json")
    default.save(path)
    encoder = token_files._Encoder(path, encode_special_tokens=False)
    held = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|end <|endoftext|><|x", "q  <|pad|> z\n"]
    for text in TEXTS + held:
        want = default.encode(text, add_special_tokens=False).ids
        assert encoder(text).tolist() == want, text


def test_query_and_stage_know_added_tokens(spark, tmp_path):
    default = Tokenizer.from_file(PATH)
    texts = [(1, "a <|endoftext|> b"), (2, "c")]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    stage = corpus_pipeline.write_tokens(spark, documents(spark, texts), "")
    query = queries.op8_token_files(spark, str(tmp_path))
    want, start = [], 0
    for doc_id, text in texts:
        found = ids(default, text)
        want.append((doc_id, start, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        start += len(found)
    for df in (stage, query):
        assert rows(df, "doc_id", "start", "n_tokens", "ids_crc32") == want
