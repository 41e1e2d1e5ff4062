import pytest

from blockloom.llm import suffix_dedup

ALONE = "this passage stands in one document alone and tells of a harbour where seven grey ships lie still under rain all winter long "
OTHER = "here is another passage of more than a hundred bytes about an orchard on a hill whose trees are older than the village below "


@pytest.fixture(params=[1, 7])
def rows(spark, request):
    """Repeated rows and copies without doc_id, in one chunk of text or in several."""
    rows = [(1, ALONE), (1, ALONE), (1, ALONE), (None, OTHER), (None, OTHER), (2, OTHER + "and more"), (3, "short"), (3, "short")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(request.param)


def test_repeated_rows_are_one_document(rows):
    out = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.digests(rows).collect())
    n, m = len(ALONE), len(OTHER)
    assert out == [("1", n, 0)] * 3 + [("2", m + 8, m)] + [("3", 5, 0)] * 2 + [("None", m, 0)] * 2


def test_keep_first_leaves_the_text_of_repeated_rows(rows):
    out = sorted((str(r.doc_id), r.text) for r in suffix_dedup.keep_first(rows).collect())
    assert out == [("1", ALONE)] * 3 + [("2", "and more")] + [("3", "short")] * 2 + [("None", OTHER)] * 2


def test_repeats_within_a_repeated_row_go_once(spark):
    df = spark.createDataFrame([(1, ALONE + ALONE)] * 2 + [(None, OTHER * 3)] * 2, "doc_id long, text string")
    out = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.digests(df).collect())
    assert out == [("1", len(ALONE))] * 2 + [("None", 2 * len(OTHER))] * 2


def test_rows_without_id_are_told_apart_by_more_than_the_tie(spark):
    df = spark.createDataFrame([(None, f"{k}") for k in range(20000)], "doc_id long, text string")
    assert df.select(*suffix_dedup._identity(df, True)).distinct().count() == 20000


def test_texts_of_one_id_are_told_apart_by_their_whole_hash(spark):
    """Of many texts under one doc_id, and without any, none loses bytes that stand nowhere else."""
    texts = [f"{k} " + f"{k:x}{k * 7919:x}{k * 104729:x}-" * 12 for k in range(10000)]
    df = spark.createDataFrame([(None if k % 2 else 7, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert df.select(*suffix_dedup._identity(df, True)).distinct().count() == len(texts)
    out = suffix_dedup.digests(df).collect()
    seen, repeats = set(), 0
    for t in texts:  # within each text its own repeats go, nothing else
        raw = t.encode()
        assert not seen & (own := {raw[p : p + 100] for p in range(len(raw) - 99)})
        seen |= own
        repeats += len(raw) - 99 > len(own)
    assert sum(r.n_removed > 0 for r in out) == repeats


def test_thue_morse_words_do_not_meet(spark):
    """Two different texts whose hashes agree under any polynomial modulo 2**64."""
    a = "a"
    while len(a) < 4096:
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    head = "one beginning that both texts share, of more than forty bytes in all, "
    out = suffix_dedup.digests(spark.createDataFrame([(1, head + a), (2, head + b)], "doc_id long, text string")).collect()
    from tests.llm.test_dedup import removed

    want = removed([(1, head + a), (2, head + b)])
    assert {r.doc_id: r.n_removed for r in out} == {k: int(m.sum()) for (k, _), m in want.items()}
