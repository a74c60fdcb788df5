"""Rows that the pipeline's stages must not lose or repeat."""

import corpus_pipeline
from mnemolake.session import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, _group int"
A = "the first text has a number of words that make shingles and it goes on for a while so that copies are clear"
B = "another document speaks of other things entirely and shares no run of five words with its neighbours here"


def stage(spark, tmp_path, name, rows):
    path = f"{tmp_path}/{name}"
    spark.createDataFrame([(i, t, lang, None, 1, "x", 2) for i, t, lang in rows], DOCS).repartition(3).write.parquet(path)
    out = dict(corpus_pipeline.STAGES)[name](prepare(spark), spark.read.parquet(path), path)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_row", "_group"]
    kept = out.collect()
    assert all((r["_row"], r["_group"]) == ("x", 2) for r in kept)
    return sorted(((r["doc_id"], r["text"]) for r in kept), key=str)


def test_near_duplicates_judge_rows_not_ids(spark, tmp_path):
    near = A + " indeed"
    rows = [(1, A, "en"), (2, A, "en"), (2, B, "en"), (3, B + " too", "en"), (4, "few words", "en"), (4, "few words", "en"), (None, near, "en"), (None, near, "en"),
            (None, "no id and no copy of any other text anywhere", "en"), (5, None, "en"), (6, "", "en")]
    assert stage(spark, tmp_path, "near_duplicates", rows) == sorted(
        [(1, A), (2, B), (4, "few words"), (None, "no id and no copy of any other text anywhere"), (5, None), (6, "")], key=str)


def test_equal_rows_under_a_null_id_leave_one(spark, tmp_path):
    assert stage(spark, tmp_path, "near_duplicates", [(None, A, "en")] * 3) == [(None, A)]


def test_no_label_keeps_all(spark, tmp_path):
    rows = [(i, A, None) for i in range(5)] + [(9, None, None)]
    assert len(stage(spark, tmp_path, "language_id", rows)) == 6
