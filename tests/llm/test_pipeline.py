"""The pipeline: what each stage keeps, on planted cases."""

import corpus_pipeline
from conftest import SF
from gazelake.llm import near_copies, repeats
from gazelake.llm.common import stage


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, before, SF))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns and after.schema == docs.schema
        if name in ("toxicity", "near_copies"):
            assert after.join(before, columns, "left_anti").count() == 0 and 0 < after.count() <= before.count()
        if name == "near_copies":
            groups = near_copies.near_copies(before, corpus_pipeline.NEAR).select("component_id").distinct().count()
            assert after.count() == groups
        if name == "repeats":
            assert after.count() == before.count()
            assert after.filter("n_chars <> length(text)").count() == 0
        if name == "mixing":
            assert after.join(before, "doc_id", "left_anti").count() == 0
        if name == "bpe":
            assert after.count() == before.count()
        before = after


def test_passages_and_nulls(spark):
    passage = " ".join(f"word{k}" for k in range(60))
    rows = [(i, f"clean number {i} {passage} and end {i}", "en", "s", 1) for i in range(2)] + [(8, None, None, None, None), (9, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    assert all(passage not in got[i]["text"] and got[i]["text"].startswith(f"clean number {i}") for i in range(2))
    assert got[8]["text"] is None and got[8]["n_chars"] is None and got[9]["text"] == ""
    assert corpus_pipeline.mix_sources(spark, docs, SF).columns == docs.columns
    assert repeats.remove_repeats(docs).count() == 4


def test_rows_with_one_id(spark):
    other = " ".join(f"other{k}" for k in range(40))
    rows = [(1, BASE, "a"), (1, other, "b"), (2, BASE + " more", "c"), (None, BASE, "d"), (None, None, "e"), (3, None, "f"), (3, "", "g"), (1, other, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(1, BASE), (1, other), (0, ""), (3, ""), (3, "")])
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), SF).count() == 0


BASE = " ".join(f"word{k}" for k in range(40))


def test_columns_of_any_name(spark):
    own = ["_score", "_none", "_key", "_no", "_copies", "kept_text", "n_bytes", "n_spans", "data", "c0", "none", "key", "component_id"]
    rows = [(i, f"one two three {'four ' * i}", "s" if i % 2 else None, *[f"{c} {i}" for c in own]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in own))
    for _, step in corpus_pipeline.STAGES[:-1]:
        got = step(spark, docs, SF)
        assert got.columns == docs.columns
        got = got.collect()
        assert got and all(r[c] == f"{c} {r['doc_id']}" for r in got for c in own)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and out.count() > 0
