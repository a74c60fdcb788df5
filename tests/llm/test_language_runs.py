"""Languages inside code-switched texts."""

from pyspark.sql import functions as F

from mnemolake.llm import langid
from mnemolake.session import prepare


def test_runs_of_a_mixed_text(spark):
    prepare(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs.select("doc_id", "text", "lang").filter(~langid.held_out()))
    held = docs.filter(langid.held_out() & (F.length("text") > 600))
    part = {r["lang"]: " ".join(r["text"].split()[:60]) for r in held.collect()}
    mixed = part["de"] + " 12, " + part["fr"]
    rows = spark.createDataFrame([(1, mixed), (2, part["en"]), (3, None), (4, ""), (5, "12 ... 7"), (None, part["es"])], "doc_id long, text string")
    got = {r["doc_id"]: r["runs"] for r in langid.label_runs(rows, model).collect()}
    assert got[3] == got[4] == got[5] == []
    for i, text in ((1, mixed), (2, part["en"]), (None, part["es"])):
        runs = got[i]
        assert all(a["end"] < b["start"] or a["end"] == b["start"] for a, b in zip(runs, runs[1:]))
        assert all(a["lang"] != b["lang"] for a, b in zip(runs, runs[1:]))
        assert all(text[r["start"]].isalpha() and text[r["end"] - 1].isalpha() and 0 < r["score"] <= 1 for r in runs)

    def share(runs, lang, begin, end):
        return sum(min(r["end"], end) - max(r["start"], begin) for r in runs if r["lang"] == lang and r["start"] < end and r["end"] > begin) / (end - begin)

    border = len(part["de"])
    assert share(got[1], "de", 0, border) > 0.85 and share(got[1], "fr", border + 5, len(mixed)) > 0.85
    assert share(got[2], "en", 0, len(part["en"])) > 0.85 and share(got[None], "es", 0, len(part["es"])) > 0.85
    assert [r["runs"] for r in langid.label_runs(rows, None).collect()] == [[]] * 6
    assert langid.label_runs(rows.limit(0), model).count() == 0
