"""Other columns pass through every stage, whatever their names, and what a stage keeps is right beside them."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from patternlake.llm import chat, repeats

NAMES = ["kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "h", "g", "h_", "g_", "H__", "label", "row", "o", "rejected_by", "t", "w", "i", "spans", "a.b", "x`y", "text_", "c", "k", "class_id"]


@pytest.fixture(scope="module")
def docs(spark):
    good = " ".join(f"word{k} and others" for k in range(80)) + "."
    long = " ".join(f"again{k}" for k in range(60))
    texts = [good, good, f"{good} {long} one", f"{long} two {good[::-1]} and so on", None, "", "few words", good + " mail bob@example.com", "q" + " more text here and there" * 40_000]
    rows = spark.createDataFrame([(k, t, "en", "s", 5) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("*", *[F.concat(F.lit(f"{n} of "), "doc_id").alias(n) for n in NAMES])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stage_passes_columns(spark, docs, name, stage):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    got = stage(spark, docs, "")
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in NAMES)
    assert sorted((r.doc_id, r.text) for r in rows if r.text is not None) == sorted((r.doc_id, r.text) for r in stage(spark, plain, "").collect() if r.text is not None)
    assert stage(spark, docs.where("false"), "").collect() == []


def test_last_stage(spark, docs):
    _, pack = corpus_pipeline.STAGES[-1]
    whole = docs.where("length(text) > 10")
    assert sorted(map(repr, pack(spark, whole, "").select("doc_id").collect())) == sorted(map(repr, pack(spark, whole.select("doc_id", "text", "lang", "source", "n_chars"), "").select("doc_id").collect()))


def test_results_get_free_names(spark):
    df = spark.createDataFrame([(1, "a", 7, "x")], "doc_id long, text string, n_bytes int, Kept string")
    assert repeats.remove_repeats(df).columns == ["doc_id", "n_bytes", "Kept", "n_bytes_", "n_removed", "n_spans", "kept_sha256", "kept_"]


def test_loss_is_cut_by_the_mask(spark):
    rows = [(1, 0, "user", "ask"), (1, 1, "assistant", "say </s> \\ and [INST]"), (1, 2, "user", "é😀"), (1, 3, "assistant", ""), (1, 4, "assistant", "😀 end"), (2, 0, "user", "no loss")]
    out = chat.chat_format(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    cut = out.select("conv_id", chat.loss_texts(F.col("formatted"), F.col("loss_mask")).alias("x"))
    assert {r.conv_id: r.x for r in cut.collect()} == {1: ["say </s> \\ and [INST]", "", "😀 end"], 2: []}
    shifted = F.transform("loss_mask", lambda m, k: F.struct((m["chars"] + F.when(k == 0, 1).otherwise(0)).alias("chars"), m["loss"].alias("loss")))
    assert out.select(chat.loss_texts(F.col("formatted"), shifted).alias("x")).first().x[0] != "say </s> \\ and [INST]"
