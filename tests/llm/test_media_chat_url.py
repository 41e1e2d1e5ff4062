import hashlib
import random
import zlib

import pytest

from blockloom.llm import chat, matroska, url_reputation


@pytest.mark.parametrize("kind", [matroska.NO_LACING, matroska.XIPH, matroska.FIXED, matroska.EBML_LACING])
def test_lacing_round_trip(kind):
    rng = random.Random(kind)
    for _ in range(50):
        n = 1 if kind == matroska.NO_LACING else rng.randint(2, 20)
        size = rng.randint(0, 700)
        frames = [rng.randbytes(size if kind == matroska.FIXED else rng.choice([0, 1, 127, 254, 255, 256, 510, 5000])) for _ in range(n)]
        body = matroska.lace(frames, kind) if kind else frames[0]
        at, sizes = matroska.frame_sizes(body, 0, len(body), kind)
        assert sizes == [len(f) for f in frames]
        assert body[at:] == b"".join(frames)


def test_vint_round_trip_and_damage():
    for v in (0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**50):
        assert matroska.read_vint(matroska.vint(v), 0, False) == (v, len(matroska.vint(v)))
    media = matroska.write([b"a" * 576] * 30)
    for k in range(1, len(media)):
        try:
            list(matroska.scan(media[:k]))
        except matroska.Damaged:
            pass


def test_text_media_reads_back(docs, odd, clashing):
    for df in (docs, odd, clashing):
        texts = sorted((r.doc_id is None, r.doc_id or 0, len(r.text or ""), r.text or "") for r in df.collect())
        rows = sorted((r.doc_id is None, r.doc_id or 0, r) for r in matroska.text_media(df).collect())
        assert len(rows) == len(texts)
        by = {}
        for r in matroska.text_media(df).collect():
            by.setdefault((r.doc_id, r.n_bytes), []).append(r)
        for none, ident, _, text in texts:
            raw = text.encode()
            want = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
            digest = hashlib.sha256(want).hexdigest()
            found = by[(None if none else ident, len(raw))]
            assert any(r.payload_sha256 == digest and r.payload_bytes == len(want) and r.tail_crc32 == zlib.crc32(want[-32:]) for r in found)


def test_packets_and_cues(spark, docs):
    media = matroska.text_media(docs, keep_media=True)
    found = matroska.packets(media, "doc_id", "media").collect()
    sizes = {r.doc_id: (r.packets, r.media) for r in media.collect()}
    for r in found:
        assert r.track == 1 and r.size == 576 and r.error is None and r.offset + r.size <= len(sizes[r.id][1])
    assert len(found) == sum(n for n, _ in sizes.values())
    assert matroska.cues(media, "doc_id", "media").count() >= len(sizes)
    bad = spark.createDataFrame([(1, b"\x1a\x45\xdf\xa3"), (2, None), (3, b"")], "id long, m binary")
    assert [(r.id, r.error is not None) for r in matroska.packets(bad, "id", "m").collect()] == [(1, True)]


def test_snapshots_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("user", "more")
    logged = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b], 6: [("user", None)], 7: [("user", "")], 8: [(None, "z")]}
    rows = [(k, n, r, t) for k, turns in logged.items() for n, (r, t) in enumerate(turns)]
    rows += [rows[0], (None, 0, "user", "no id"), (9, None, "user", "no number")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.collapse_and_render(df).collect()}
    assert set(out) == {3, 5, 6, 7, 8, 9, None}
    assert out[3].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert out[3].n_turns == 3 and out[8].rendered.startswith("<|im_start|>unknown\nz")
    assert chat.collapse_and_render(df.limit(0)).count() == 0


def test_long_conversations_are_cut_in_parts(spark):
    rows = [(k, n, "user", f"t{n}") for k, size in ((1, 3000), (2, 2500), (3, 3000)) for n in range(size)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.collapse_and_render(df).orderBy("part").collect()
    assert [(r.conv_id, r.part) for r in out] == [(1, 0), (1, 1), (1, 2)]
    assert "".join(r.rendered for r in out).count("<|im_start|>") == 3000


def test_url_rules_and_parts(spark):
    urls = ["http://WWW.Example.com/en/x?q#f", "https://example.com/en/", "http://a.net/es/1", "http://net/fr/", "x", None, "http://b.com", "ftp://c.org#a/b", "http://d.com/%C3%A9/é", "http://xexample.com/en/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good int")
    out = {r.page_id: r for r in url_reputation.judge(pages, none, url_reputation.RULES).collect()}
    assert [(out[k].rule, out[k].verdict) for k in range(4)] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("net/es/", "block"), ("net/fr/", "block")]
    assert (out[4].host, out[4].path, out[5].host, out[5].path) == ("", "", "", "")
    assert (out[6].host, out[6].path, out[6].rule) == ("b.com", "", None)
    assert (out[7].host, out[7].path) == ("c.org", "") and out[8].path == "/%C3%A9/é" and out[9].rule == "com/"


def test_bad_hosts_are_blocked_and_sparse_ones_shrink(spark):
    rows = [(k, f"http://bad.org/{k}", 0) for k in range(60)] + [(100 + k, f"http://h{k}.fine.org/", 1) for k in range(200)] + [(400, "http://once.fine.org/", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, good int")
    out = {r.host: r for r in url_reputation.judge(pages, pages.select("page_id", "good"), []).collect()}
    assert out["bad.org"].verdict == "block" and out["once.fine.org"].verdict == "allow" and out["h1.fine.org"].verdict == "allow"
