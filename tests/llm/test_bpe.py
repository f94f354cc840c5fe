import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bytegrams.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "aaa aaaa aaaaaaa", "It's we'll THE they're 12345 ½ ²", "ΣΑΣ Σ ς", "İstanbul ǅ ﬁ", "é ́a", "a b　c d\x85e\x1cf\x1fg​h", "<|endoftext|> x<|startoftext|>y <|endoftext", "日本語テキスト", "😀👍🏽 🇫🇷", "\x00\x01 \x7f", "!!!???...", "x" * 3000, "hahaha" * 300]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def agree(library, batch):
    own = bpe.load(PATH)
    for text, ids in zip(batch, own.encode([t.encode() for t in batch]), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False), text


def test_odd_texts(library):
    agree(library, ODD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60), max_size=8))
def test_any_text(library, batch):
    agree(library, batch)


def test_query_columns(spark, library):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (3, None), (3, None)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, ids int, decoded string")
    found = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in found) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in found)
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_digest(spark, sf_dir, library):
    from bytegrams.llm.queries import op7_bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op7_bpe(spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
