import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from bytegrams.llm import toxicity
from bytegrams.llm.common import BATCH_BYTES
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_jaccard import brute as near
from tests.llm.test_secrets import base


def test_stages_one_by_one(spark, sf_dir):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    now = docs
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in now.collect()}
        after_df = stage(spark, now, sf_dir)
        after = {r.doc_id: r for r in after_df.collect()}
        texts = [(i, r.text) for i, r in before.items()]
        assert set(after) <= set(before)
        if name != "bpe":
            assert after_df.columns == columns
        if name == "toxicity":
            scored = toxicity.score_toxicity(now, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert set(after) == {r.doc_id for r in scored.collect() if not r.predicted}
        elif name == "jaccard_join":
            assert set(after) == {i for i, _, c in near(texts) if i == c}
        elif name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert set(after) == {i for i, *_, bad in hits(texts, items) if not bad}
        elif name == "secret_scan":
            assert set(after) == set(before)
            for i, r in after.items():
                assert r.n_chars == len(r.text) and (r.text == before[i].text or base(before[i].text)) and not base(r.text)
        else:
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert set(after) == set(before)
            for i, r in after.items():
                assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(before[i].text, add_special_tokens=False).ids
        if name != "bpe":
            assert after and all(after[i][c] == before[i][c] for i in after for c in columns if c not in ("text", "n_chars"))
        now = after_df.checkpoint()


def test_names_clash_and_texts_are_long(spark, sf_dir):
    """Extra columns have the names that the stages use, and one text has a million characters."""
    names = ["id_of_row", "content_of_row", "hit_content", "blob_of_text", "spans_of_text", "content", "class", "group", "node", "row", "hash", "x", "label_id", "Least", "key"]
    long = " ".join(f"w{k}" for k in range(150_000))
    rows = [(1, long), (2, long + " token=abcdefgh"), (3, "b" * 1_000_000), (4, "a clean text of seven words here"), (4, "a clean text of seven words here"), (None, None)]
    docs = spark.createDataFrame([(i, t, *[7] * len(names)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    now = docs
    for name, stage in cp.STAGES:
        after = stage(spark, now, sf_dir)
        if name != "bpe":
            assert after.columns == docs.columns
        now = after.checkpoint()
    got = {r.doc_id: r for r in now.collect()}
    assert got.keys() == {1, 3, 4, None} and now.count() == 4
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(got[1].ids, "<u4").tolist() == library.encode(long, add_special_tokens=False).ids


def test_run_with_odd_rows(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "token=abcdefgh", None, None, 14), (-3, "token=abcdefgh", None, None, 14)], docs.schema)
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    docs.limit(40).unionByName(odd).withColumn("score", F.lit(1)).withColumn("row", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = cp.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in rows]
    assert {None, -1, -2, -3} <= set(ids) and all(r.n_tokens == len(r.ids) // 4 for r in rows)
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name, operator, function", [("toxicity", cp.toxicity, "keep_clean"), ("jaccard_join", cp.jaccard, "keep_one"), ("bpe", cp.bpe, "encode")])
def test_python_gets_batches_of_bounded_bytes(spark, sf_dir, monkeypatch, name, operator, function):
    """4,000 texts of 3,000 characters are 12 MB: no batch has much more than one, every row comes, and a bound that the session has stays."""

    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat('x', 3000) AS text")
    monkeypatch.setattr(operator, function, lambda docs, *_: docs.mapInArrow(seen, "rows long, bytes long"))
    try:
        got = dict(cp.STAGES)[name](spark, docs, sf_dir).collect()
        assert sum(r.rows for r in got) == 4000 and max(r.bytes for r in got) < 1_200_000
        spark.conf.set(BATCH_BYTES, "3m")
        got = dict(cp.STAGES)[name](spark, docs, sf_dir).collect()
        assert sum(r.rows for r in got) == 4000 and 2_000_000 < max(r.bytes for r in got) < 4_000_000
    finally:
        spark.conf.unset(BATCH_BYTES)


def test_run_takes_the_bound_back(spark, sf_dir):
    assert cp.run(spark, sf_dir).count() and spark.conf.get(BATCH_BYTES, None) is None
