"""Terms are looked for in the columns that the SQL of a query names."""

from patternlake.plans import queries

_CUT = "x" * 54 + " things of old"  # a name of 60 characters ends in "thing"


def test_words_cut_by_the_name_are_no_hits(spark, tmp_path):
    texts = [(1, _CUT, "en", "src1"), (2, "a thing", "en", "src1"), (3, "a thing of src1", "en", "src3"), (4, _CUT, "en", "src3")]
    rows = [(k, text, lang, source, len(text)) for k, text, lang, source in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    assert [r.id for r in queries.QUERIES["search_hits"](spark, str(tmp_path)).collect()] == [2]
    assert {r.id for r in queries.QUERIES["compose_for_editor"](spark, str(tmp_path)).collect()} == {2, 3}
