import numpy as np
import pytest

from blockloom.llm import quality, toxicity

TOXIC = ["idiot", "scum", "moronic", "trashy", "loserish"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(600):
        text = rng.choice(words, rng.integers(5, 120)).tolist()
        toxic, bad = int(k % 4 == 0), int(k % 5 == 0)
        if toxic:
            for _ in range(3):
                text.insert(int(rng.integers(len(text))), str(rng.choice(TOXIC)) + str(rng.choice(["", "s", "ic", "."])))
        if bad:
            text = [t + "###" for t in text]
        rows.append((k, " ".join(text), "en", f"host{k % 7}", len(text), toxic, 1 - bad))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxic int, quality int")


def test_toxicity_on_held_out_documents(labelled, odd, clashing):
    model = toxicity.fit(labelled, labelled)
    out = toxicity.score(labelled, model).join(labelled.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert 80 < len(out) < 160 and (out.predicted == out.toxic).mean() > 0.95
    for df in (odd, clashing, odd.limit(0)):
        got = toxicity.score(df, model).collect()
        assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        kept = toxicity.keep_civil(df, model)
        assert kept.columns == df.columns and 9 not in {r.doc_id for r in kept.collect()}


def test_scores_do_not_depend_on_the_company(labelled):
    model = toxicity.fit(labelled, labelled)
    alone = {r.doc_id: r.score for r in toxicity.score(labelled.where("doc_id < 5"), model).collect()}
    together = {r.doc_id: r.score for r in toxicity.score(labelled, model).where("doc_id < 5").collect()}
    assert all(abs(alone[k] - together[k]) < 1e-5 for k in alone)


def test_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.score(odd, toxicity.fit(odd, none)).count() == odd.count()
    assert quality.score(odd, none).where("keep").count() == odd.count()


def test_quality(labelled, odd, clashing, labels):
    out = quality.score(labelled, labelled.select("doc_id", "quality")).join(labelled.select("doc_id", "quality"), "doc_id").toPandas()
    assert (out.keep == (out.quality == 1)).mean() > 0.97
    assert out.site_rate.between(0, 1).all()
    for df in (odd, clashing, odd.limit(0)):
        assert quality.score(df, labels).count() == df.count()
        kept = quality.keep_good(df, labels)
        assert kept.columns == df.columns and kept.count() <= df.count()


def test_many_sites_meet_by_salted_keys(labelled, monkeypatch):
    want = sorted(map(tuple, quality.score(labelled, labelled).collect()))
    monkeypatch.setattr(quality, "BROADCAST_SITES", 3)
    assert sorted(map(tuple, quality.score(labelled, labelled).collect())) == want


def test_sparse_sites_shrink(spark):
    docs = spark.createDataFrame([(k, "t", "en", "big" if k < 100 else "small") for k in range(101)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, int(k % 2)) for k in range(100)] + [(100, 1)], "doc_id long, quality int")
    told = [r for r in quality.sites(docs, labels).collect() if r._host == "small" and r.site_labels]  # folds that see its one label
    assert len(told) == quality.FOLDS - 1 and all(r.global_rate < r.site_rate < 0.75 for r in told)
