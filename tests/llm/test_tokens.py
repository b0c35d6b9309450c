import json
import os

import pytest
from turnstone.llm import tokens

SPECIAL = ["<|endoftext|>", "a<|endoftext|>b", "<s> </s>", "", " ", "\n\n", "it's we'll", "नमस्ते दुनिया", "x" * 3000, "😀 e\u0301 \u200b", "a b\tc  d", "1234abc5678"]


def test_same_ids_as_the_other_library():
    from tokenizers import Tokenizer

    path = os.path.join(os.path.dirname(tokens.RANKS), "byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for text in SPECIAL:
        assert tokens.encode_text(text) == t.encode(text, add_special_tokens=False).ids, text


def test_long_texts_are_cut_at_safe_places():
    text = ("The  quick brown fox, it's 12ab34 — jumps!\n\n" * 400) + "y" * 5000 + "1" * 50
    whole = tokens.encoding().encode_ordinary(text)
    for size in (7, 64, 1000):
        assert "".join(tokens.safe_pieces(text, size)) == text
        assert tokens.encode_text(text, size=size) == whole


def test_columns(spark):
    rows = [(i, t, "ids", 1.0) for i, t in enumerate([*SPECIAL, None, None])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n double")
    out = tokens.encode_corpus(df).withColumn("back", tokens.text_of("ids")).withColumn("k", tokens.n_tokens("text")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == tokens.encode_text(r.text) and r.back == (r.text or "") and r.k == len(r.ids)
    assert [f.dataType.simpleString() for f in tokens.encode_corpus(df).schema if f.name == "ids"] == ["array<int>"]
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_unknown_ids(spark):
    df = spark.createDataFrame([([999999, -1],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(tokens.text_of("ids")).collect()] == ["��", None, ""]


@pytest.mark.parametrize("table", ["documents"])
def test_whole_table(spark, table):
    from tokenizers import Tokenizer
    from turnstone.llm.queries import p7_ids

    t = Tokenizer.from_file(os.path.join(os.path.dirname(tokens.RANKS), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").collect()}
    got = {r.doc_id: r.ids for r in p7_ids(spark, "/root/testdata/sf0.001").collect()}
    expected = dict(zip(texts, (e.ids for e in t.encode_batch(list(texts.values()), add_special_tokens=False))))
    assert json.dumps(got, sort_keys=True) == json.dumps(expected, sort_keys=True)
