import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.llm import imatch, jaccard, suffix_dedup


@given(st.binary(max_size=80).map(lambda b: bytes(x % 4 for x in b)))
@settings(max_examples=200, deadline=None)
def test_suffix_array(text):
    assert suffix_dedup.suffix_array(np.frombuffer(text, np.uint8)).tolist() == sorted(range(len(text)), key=lambda k: text[k:])


def removed(rows):
    """Brute force: {(id, text): mask}; rows of one id and text are one document."""
    seen, out = set(), {}
    for ident, text in rows:
        raw = (text or "").encode()
        mask, new = np.zeros(len(raw), bool), set()
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen or w in new:
                mask[p : p + 100] = True
            new.add(w)
        seen |= new
        out[(ident, text)] = mask
    return out


@pytest.mark.parametrize("large", [1 << 20, 300])
def test_suffix_dedup(spark, docs, odd, clashing, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "ANCHOR_BYTES", large)
    for df in (docs.where("doc_id < 120"), odd, clashing, odd.limit(0)):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        tie = {(r.doc_id, r.text): r.t for r in df.select("doc_id", "text", suffix_dedup._tie(df["text"]).alias("t")).collect()}
        masks = removed(sorted(set(rows), key=lambda r: (-(2**63) if r[0] is None else r[0], tie[r])))
        want = []
        for ident, text in rows:
            raw, mask = np.frombuffer((text or "").encode(), np.uint8), masks[(ident, text)]
            runs = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0
            want.append((str(ident), len(raw), int(mask.sum()), runs, hashlib.sha256(raw[~mask].tobytes()).hexdigest()))
        got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digests(df).collect()]
        assert sorted(got) == sorted(want)


def test_keep_first(clashing):
    out = suffix_dedup.keep_first(clashing)
    assert out.columns == clashing.columns
    kept = {r.doc_id: r for r in out.collect()}
    assert 2 not in kept and kept[3].text is None and kept[4].text == ""
    assert all(r.text is None or r.n_chars == len(r.text) or r.n_chars == 4 or r.doc_id in (None, 1, 5, 7) for r in out.collect())


def shingle_sets(rows, words):
    out = defaultdict(set)
    n = {}
    for ident, text in rows:
        raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        s = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        out[ident].add(frozenset(s))
        n[(ident, text)] = len(s)
    return out, n


def components(rows, words, similarity):
    a, b = similarity
    """Rows without id are documents of their own; a component's name is its least id, None if it has none."""
    rows = [(i if i is not None else f"row {k}", t) for k, (i, t) in enumerate(rows)]
    texts, n = shingle_sets(rows, words)
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    flat = [(i, s) for i, sets in texts.items() for s in sets if s]
    where = defaultdict(list)
    for k, (_, s) in enumerate(flat):
        for x in s:
            where[x].append(k)
    for k, (i, s) in enumerate(flat):
        for m, both in Counter(m for x in s for m in where[x] if m > k).items():
            j, t = flat[m]
            if b * both >= a * (len(s) + len(t) - both):
                x, y = find(i), find(j)
                parent[max(x, y, key=lambda i: (isinstance(i, str), i))] = min(x, y, key=lambda i: (isinstance(i, str), i))
    named = lambda i: None if isinstance(i, str) else i
    return [(named(i), n[(i, t)], named(find(i))) for i, t in rows]


@pytest.mark.parametrize(("words", "similarity", "block"), [(4, (85, 100), 1024), (5, (80, 100), 2)])
def test_jaccard(spark, docs, odd, clashing, monkeypatch, words, similarity, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    text = docs.where("n_chars > 400").first().text.split()
    near = [(9000 + k, " ".join([*text[: k * 3], f"new{k}", *text[k * 3 + 1 :]])) for k in range(12)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    for df in (more, odd, clashing, odd.limit(0)):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = jaccard.component_ids(df, words, similarity).collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(components(rows, words, similarity), key=str)


def test_frequent_shingles_only_change_the_order(docs, monkeypatch):
    want = sorted(map(tuple, jaccard.component_ids(docs).collect()))
    monkeypatch.setattr(jaccard, "COUNTED_FROM", 1)
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 2)
    assert sorted(map(tuple, jaccard.component_ids(docs).collect())) == want


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    assert {(r.node, r.component) for r in jaccard.components(edges).collect()} == {(k, 0) for k in range(201)} | {(500, 500), (501, 500)}


def test_keep_one(clashing):
    out = jaccard.keep_one(clashing)
    assert out.columns == clashing.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 5, 6, 7, 8, 9]  # the row without id has the shingles of 1


def test_rows_without_id_go_where_another_stands_for_them(spark):
    a, b = ("alpha beta gamma delta epsilon zeta eta theta " * 2).strip(), "one two three four five six seven"
    df = spark.createDataFrame([(None, a), (None, a), (5, a), (None, b), (None, b), (None, ""), (None, None), (6, ""), (6, "x y z"), (6, "")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in jaccard.keep_one(df).collect()), key=str) == sorted([(5, a), (None, b), (None, ""), (None, None), (6, "x y z")], key=str)


def test_thue_morse_words_do_not_link(spark):
    a = "a"
    while len(a) < 1024:
        a += a.translate({97: 98, 98: 97})
    rows = [(1, a), (2, a.translate({97: 98, 98: 97})), (3, a)]
    got = jaccard.component_ids(spark.createDataFrame(rows, "doc_id long, text string"), 4, (85, 100)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2), (3, 1)}


def test_large_groups_in_blocks(spark, monkeypatch):
    """Near copies of one text, some of which only link with some others, in many blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(120):
        words = list(base)
        for p in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            words[p] = f"x{rng.integers(40)}"
        rows.append((k, " ".join(words)))
    want = components(rows, 4, (85, 100))
    got = jaccard.component_ids(spark.createDataFrame(rows, "doc_id long, text string"), 4, (85, 100)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert len({w[2] for w in want}) > 1


def test_fingerprints(docs, odd, clashing):
    for df in (docs, odd, clashing, odd.limit(0)):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = imatch.edited_likeness(df, buckets=5).collect()
        assert len(got) == len(rows)
        tie = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r]))
        digests = []
        for k, (ident, text) in enumerate(order):
            text, follower = text or "", order[(k + 1) % len(order)][1] or ""
            half = len(text) // 2
            digests.append((str(ident), hashlib.sha256((text[: len(text) - half] + follower[:half]).encode()).hexdigest()))
        assert sorted((str(r.doc_id), r.edited_sha256) for r in got) == sorted(digests)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        prints = {}
        for r in imatch.fingerprint(df, imatch.lexicon(df)).collect():
            prints.setdefault(str(r.doc_id), set()).add(r.fingerprint)
        assert all(r.fingerprint in prints[str(r.doc_id)] for r in got)


def test_edited_texts_are_nearer_than_the_next_ones(docs):
    got = imatch.edited_likeness(docs).collect()
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.9


def test_rows_of_one_id_are_dealt_into_several_ranges(spark):
    """Most rows without id, many of one id, some of them equal: the order stays that of id and hash of the text."""
    rng = np.random.default_rng(6)
    rows = [(None if k % 2 else 7 if k % 3 else k, f"text {rng.integers(150)} of many words " * int(rng.integers(1, 4))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ranged = imatch._in_order(df, 12).select("bucket", "guest").where("guest = 0").groupBy("bucket").count().collect()
    assert len(ranged) > 8 and max(r["count"] for r in ranged) < 150
    tie = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    want = []
    for k, (ident, text) in enumerate(order):
        follower, half = order[(k + 1) % len(order)][1], len(text) // 2
        want.append((str(ident), hashlib.sha256((text[: len(text) - half] + follower[:half]).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in imatch.edited_likeness(df, buckets=12).collect()) == sorted(want)
