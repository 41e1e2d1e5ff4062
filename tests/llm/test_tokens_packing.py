import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.llm import bpe, packing, textvec


@given(st.lists(st.text(alphabet=" \n\t　aZ9é'stmdlrve!.½日\U0001f600_", max_size=25), max_size=12))
@settings(max_examples=150, deadline=None)
def test_pieces_are_the_patterns_matches(texts):
    import public_tokenizers

    pattern = regex.compile(public_tokenizers.PATTERN)
    data, offsets = textvec.buffers(pa.array(texts, pa.string()))
    starts, first = textvec.bpe_pieces(data, offsets)
    ends = np.append(starts[1:], len(data))
    for k, text in enumerate(texts):
        assert [bytes(data[a:b]).decode() for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])] == pattern.findall(text)


@pytest.fixture(scope="module")
def reference(tokenizer):
    path, pattern = tokenizer
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks(path), special_tokens={})


def test_bpe_like_the_library(docs, odd, clashing, tokenizer, reference):
    for df in (docs.limit(60), odd, clashing, odd.limit(0)):
        want = sorted((str(r.doc_id), len(ids := reference.encode_ordinary(r.text or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in df.collect())
        got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, tokenizer[0]).collect())
        assert got == want


def test_encode_and_decode(odd, tokenizer):
    encoded = bpe.encode(odd, tokenizer[0])
    back = bpe.decode(encoded, tokenizer[0])
    assert sorted(bytes(r.text) for r in back.collect()) == sorted((r.text or "").encode() for r in odd.collect())


def test_long_words_with_the_heap(tokenizer, reference):
    for word in (b"ab" * 400, bytes(range(97, 123)) * 30, b"z" * 1000):
        assert bpe.merge_long(word, bpe.ranks(tokenizer[0])) == reference._core_bpe.encode_single_piece(word)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
@settings(max_examples=60, deadline=None)
def test_plan_holds_every_length(histogram):
    runs = packing.plan(histogram, capacity=64, groups=6, grain=2)
    held = {}
    for r in runs:
        assert r.count > 0 and r.used() <= 64
        for length, copies in r.items:
            held[length] = held.get(length, 0) + copies * r.count
    assert held == histogram
    total = sum(k * v for k, v in histogram.items())
    assert sum(r.count for r in runs) <= max(1.3 * total / 64, 0) + sum(v for k, v in histogram.items() if k > 32) + 2


def test_packing(docs, odd, clashing, tokenizer, reference):
    for df, slack in ((docs, 0.03), (odd, 1), (clashing, 1), (odd.limit(0), 1)):
        rows = packing.pack_documents(df, *tokenizer).toPandas()
        ids = {}
        for r in df.collect():
            ids.setdefault(r.doc_id, []).append([*reference.encode_ordinary(r.text or ""), 0])
        assert rows.length.sum() == sum(len(x) for v in ids.values() for x in v)
        if not len(rows):
            continue
        assert rows.length.between(1, 2048).all()
        for r in rows.itertuples():
            own = ids[None if r.doc_id != r.doc_id else r.doc_id]
            assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in own)
            assert r.piece == 0 or r.length == 2048
        for _, g in rows.sort_values("offset").groupby("sequence_id"):
            assert (g.offset.values == np.concatenate([[0], np.cumsum(g.length.values)[:-1]])).all() and g.length.sum() <= 2048
        assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 2048) * (1 + slack) + 1


def test_words_whose_hashes_agree_keep_their_own_ids(tokenizer, monkeypatch):
    """Thue-Morse words, and every word under one hash."""
    import numpy as np
    import tiktoken

    from blockloom.llm import bpe
    from blockloom.llm import textvec as V

    path, pattern = tokenizer
    library = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=bpe.ranks(path), special_tokens={})
    a = "a"
    while len(a) < 1024:
        a += a.translate({97: 98, 98: 97})
    texts = [a, a.translate({97: 98, 98: 97}), "it's one, two and é日本 two", "", "two one " * 5]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *(len(r) for r in raw)])
    for k in range(2):
        memory = bpe.Words(lambda words: bpe.contract(words, path))
        for _ in range(2):
            ids, at, text, cut = bpe.pieces_to_ids(memory, data, offsets, True)
            assert [ids[x:y].tolist() for x, y in zip(at, at[1:])] == [library.encode(t) for t in texts]
            assert [text[x:y].tobytes() for x, y in zip(cut, cut[1:])] == raw
        monkeypatch.setattr(V, "hashes", lambda at, data, starts, ends: np.zeros(len(starts), np.uint64))
