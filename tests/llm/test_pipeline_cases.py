"""The pipeline's stages on odd rows: nulls in every column, repeated rows, further columns, no rows."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

EXTRA = ["id", "key", "class", "n", "spans", "_host", "_fold", "_evidence", "score", "h", "node"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
GOOD = "A plain sentence of some length stands here, and another one follows it; nothing in them is repeated or odd, number {}."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    more = ["x"] * len(EXTRA)
    text = [GOOD.format(f"{k} {k * 7919} {k * 104729}") for k in range(40)]
    rows = [(k, t, "en", "a", len(t), *more) for k, t in enumerate(text)]
    rows += [rows[0], rows[0], (100, text[1], "en", "b", 1, *more), (None, text[2], None, None, None, *more), (None, None, None, None, None, *[None] * len(EXTRA))]
    rows += [(101, None, "en", "a", 0, *more), (102, "", None, "a", 0, *more), (103, "long " * 30000, "de", None, 150000, *more)]
    for name, these in (("full", rows), ("empty", [])):
        spark.createDataFrame(these, SCHEMA).write.parquet(f"{path}/{name}/documents.parquet")
        labels = [(k, k % 2, 0) for k in range(40)] + [(None, 1, 1), (5, None, None), (7, 1, 0)]
        spark.createDataFrame(labels if these else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/{name}/labels.parquet")
    return path


def test_stages_take_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, f"{folder}/full")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        else:
            assert out.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0


def test_stages_take_no_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/empty/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, f"{folder}/empty").count() == 0, name


def test_copies_and_rows_without_id(spark, folder):
    from blockloom.llm import jaccard

    docs = spark.read.parquet(f"{folder}/full/documents.parquet")
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(docs).collect()]
    assert sum(i == 0 for i, _ in kept) == 1 and 100 not in {i for i, _ in kept}
    assert sorted(str(t) for i, t in kept if i is None) == ["None"]  # the copy of document 2 goes, the null text stays
    assert len(kept) == 40 + 1 + 3
