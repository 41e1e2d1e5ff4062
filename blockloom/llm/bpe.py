"""Byte-level BPE encoding and decoding.

A text is cut into the matches of the vocabulary's pattern; each distinct match, told by its
bytes, is merged once per Python worker.  Merging runs in DuckDB: token-position rows join the merge table
and a recursive query contracts the leftmost pair of least rank in every word until no pair
is left; ordered aggregation then gives each word's ids and its decoded bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from blockloom.llm import textvec as V

#: Words of more bytes are merged with a heap: the recursion's work is quadratic in them.
LONG_WORD = 192
#: Words merged by one run of the recursive query.
WORDS_PER_QUERY = 60_000
#: Distinct words, and bytes of them, that a worker remembers; beyond either, the memory starts anew.
REMEMBERED, REMEMBERED_BYTES = 400_000, 16 << 20

CONTRACT = """
WITH RECURSIVE step(w, p, tok, live) AS (
  SELECT w, p, tok, open FROM start
  UNION ALL
  (
    WITH pairs AS (
      SELECT w, p, tok, lead(tok) OVER v AS following, lead(p) OVER v AS following_p
      FROM step WHERE live WINDOW v AS (PARTITION BY w ORDER BY p)
    ), best AS (
      SELECT w, min(pair.merged * 1048576 + p * 1024 + following_p) AS least
      FROM pairs JOIN pair ON pair.l = tok AND pair.r = following GROUP BY w
    )
    SELECT s.w, p, CASE WHEN p = (least // 1024) % 1024 THEN least // 1048576 ELSE tok END, least IS NOT NULL
    FROM pairs s LEFT JOIN best b ON s.w = b.w
    WHERE least IS NULL OR p <> least % 1024
  )
)
SELECT w, list(tok ORDER BY p) AS ids, string_agg(vocabulary.bytes, '' ORDER BY p) AS decoded
FROM step JOIN vocabulary ON vocabulary.id = step.tok
WHERE NOT live
GROUP BY w ORDER BY w
"""


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(2)
def _database(path: str):
    """A connection with the vocabulary (bytes as hex) and every pair whose concatenation is a token."""
    import duckdb

    known = ranks(path)
    rows = [(known[t[:k]], known[t[k:]], i) for t, i in known.items() for k in range(1, len(t)) if t[:k] in known and t[k:] in known]
    l, r, m = (np.array(x, np.int32) for x in zip(*rows)) if rows else (np.zeros(0, np.int32),) * 3
    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})  # it spills nothing to a machine's own folder
    con.register("pairs_in", pa.table({"l": l, "r": r, "merged": m}))
    con.execute("CREATE TABLE pair AS SELECT l, r, merged::BIGINT AS merged FROM pairs_in")
    con.unregister("pairs_in")
    con.register("words_in", pa.table({"id": pa.array(known.values(), pa.int64()), "bytes": pa.array([t.hex() for t in known])}))
    con.execute("CREATE TABLE vocabulary AS SELECT * FROM words_in")
    con.unregister("words_in")
    return con


def merge_long(word: bytes, known: dict[bytes, int]) -> list[int]:
    """The same contraction with a heap, for one long word."""
    n = len(word)
    after, before, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    rank = lambda i: known.get(word[i : end[after[i]]]) if after[i] < n else None
    heap = [(r, i, end[after[i]]) for i in range(n) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, end[after[k]]))
    out, i = [], 0
    while i < n:
        out.append(known[word[i : end[i]]])
        i = after[i]
    return out


def contract(words: list[bytes], path: str) -> list[tuple[list[int], bytes]]:
    """(ids, decoded bytes) of each word.  A word that is a token as it stands is that one token."""
    known, out = ranks(path), [None] * len(words)
    todo = []
    for k, word in enumerate(words):
        if len(word) > LONG_WORD and word not in known:
            back = _inverse(path)
            out[k] = (ids := merge_long(word, known)), b"".join(back[i] for i in ids)
        else:
            todo.append(k)
    if not todo:
        return out
    con, single = _database(path), np.array([known[bytes([b])] for b in range(256)], np.int64)
    for at in range(0, len(todo), WORDS_PER_QUERY):
        part = todo[at : at + WORDS_PER_QUERY]
        whole = np.array([known.get(words[k], -1) for k in part], np.int64)
        sizes = np.where(whole >= 0, 1, [len(words[k]) for k in part])
        data = np.frombuffer(b"".join(words[k] if t < 0 else b"\0" for k, t in zip(part, whole.tolist())), np.uint8)
        w = np.repeat(np.arange(len(part), dtype=np.int64), sizes)
        p = V.ragged(np.zeros(len(part), np.int64), sizes)
        con.register("start", pa.table({"w": w, "p": p, "tok": np.where(whole[w] >= 0, whole[w], single[data]), "open": pa.array(whole[w] < 0)}))
        found = con.sql(CONTRACT).to_arrow_table()
        con.unregister("start")
        for k, ids, text in zip(found["w"].to_pylist(), found["ids"].to_pylist(), found["decoded"].to_pylist()):
            out[part[k]] = (ids, bytes.fromhex(text))
    return out


@lru_cache(2)
def _inverse(path: str) -> dict[int, bytes]:
    return {i: t for t, i in ranks(path).items()}


class Words:
    """Ids (and decoded bytes) of all words met so far, found by the word's bytes."""

    def __init__(self, encode, most: int = REMEMBERED):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self):
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and each one's word
        self.odd: dict[bytes, int] = {}  # words whose hash another word has
        self.raw, self.begin, self.length = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)  # the words
        self.ids, self.text = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint8)]
        self.n_ids, self.n_text = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.flat = None

    def _add(self, words: list[bytes]) -> np.ndarray:
        """The places of words that are not there yet."""
        found = self.encode(words)
        size = np.array([len(w) for w in words], np.int64)
        self.begin = np.concatenate([self.begin, len(self.raw) + np.cumsum(size) - size])
        self.length = np.concatenate([self.length, size])
        self.raw = np.concatenate([self.raw, np.frombuffer(b"".join(words), np.uint8)])
        self.ids.append(np.array([i for ids, _ in found for i in ids], np.uint32))
        self.text.append(np.frombuffer(b"".join(t for _, t in found), np.uint8))
        self.n_ids.append(np.array([len(ids) for ids, _ in found], np.int64))
        self.n_text.append(np.array([len(t) for _, t in found], np.int64))
        self.flat = None
        return np.arange(len(self.length) - len(words), len(self.length))

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each span, its word's place in tables().  Spans and words of one hash are compared byte by byte."""
        if len(self.length) > self.most or len(self.raw) > REMEMBERED_BYTES:
            self.clear()
        at = V.lanes(data)
        distinct, first, inverse = np.unique(V.hashes(at, data, starts, ends), return_index=True, return_inverse=True)
        apart = unlike(at, starts, ends, first[inverse])
        raw, s, e = data.tobytes(), starts[first], ends[first]
        spot = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        hit = self.keys[spot] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        places = np.full(len(distinct), -1)
        places[hit] = self.at[spot[hit]]
        here = np.flatnonzero(hit)
        wrong = here[self._differ(data, s[here], e[here], places[here])]
        if len(new := np.flatnonzero(~hit)):
            places[new] = self._add([raw[x:y] for x, y in zip(s[new].tolist(), e[new].tolist())])
            keys, owner = np.concatenate([self.keys, distinct[new]]), np.concatenate([self.at, places[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.at = keys[order], owner[order]
        out = places[inverse]
        if len(wrong) or len(apart):
            again = np.concatenate([np.flatnonzero(np.isin(inverse, wrong)), apart])
            listed = [raw[x:y] for x, y in zip(starts[again].tolist(), ends[again].tolist())]
            if more := list(dict.fromkeys(w for w in listed if w not in self.odd)):
                self.odd |= dict(zip(more, self._add(more).tolist()))
            out[again] = [self.odd[w] for w in listed]
        return out

    def _differ(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which of the spans are not the words at the places."""
        size = ends - starts
        wrong = size != self.length[places]
        size = np.where(wrong, 0, size)
        unequal = data[V.ragged(starts, size)] != self.raw[V.ragged(self.begin[places], size)]
        total, stop = np.concatenate([[0], np.cumsum(unequal)]), np.cumsum(size)
        return wrong | (total[stop] != total[stop - size])

    def tables(self):
        """(ids, starts, lengths) and (bytes, starts, lengths) by place."""
        if self.flat is None:
            for name in ("ids", "text", "n_ids", "n_text"):
                setattr(self, name, [np.concatenate(getattr(self, name))])
            n, m = self.n_ids[0], self.n_text[0]
            self.flat = (self.ids[0], np.cumsum(n) - n, n), (self.text[0], np.cumsum(m) - m, m)
        return self.flat


def unlike(at: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: np.ndarray) -> np.ndarray:
    """The spans whose bytes are not those of the span that model names.  at is textvec.lanes of the bytes."""
    size = ends - starts
    wrong = size != size[model]
    live = np.flatnonzero(~wrong & (model != np.arange(len(model))))
    a, b, left = starts[live], starts[model[live]], size[live]
    while len(live):
        differ = ((at[a] ^ at[b]) & V._MASK[np.minimum(left, 8)]) != 0
        wrong[live[differ]] = True
        on = ~differ & (left > 8)
        live, a, b, left = live[on], a[on] + 8, b[on] + 8, left[on] - 8
    return np.flatnonzero(wrong)


@lru_cache(2)
def _words(path: str) -> Words:
    return Words(lambda words: contract(words, path))


def pieces_to_ids(memory: Words, data: np.ndarray, offsets: np.ndarray, decode: bool):
    """Ids of all documents one after another, where each begins, and likewise the decoded bytes."""
    starts, first = V.bpe_pieces(data, offsets)
    place = memory.look_up(data, starts, np.append(starts[1:], len(data))) if len(starts) else np.zeros(0, np.int64)
    out = []
    for values, at, size in memory.tables()[: 1 + decode]:
        lengths = size[place]
        edges = np.concatenate([[0], np.cumsum(lengths)])
        out += [values[V.ragged(at[place], lengths)], edges[first]]
    return out


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary): each whole text encoded and decoded again.

    A null text counts as empty and gives no ids.  Rows are independent: repeated rows give
    repeated results, a null id is carried along, other columns are ignored.
    """

    @V.tidy
    def run(batches):
        memory = _words(path)
        for batch in batches:
            for i, j, data, offsets in V.parts(batch.column(1)):
                ids, at, text, cut = pieces_to_ids(memory, data, offsets, True)
                yield pa.record_batch([batch.column(0)[i:j], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32))), pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(text)])], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string")).mapInArrow(run, f"id {kind}, ids array<int>, decoded binary")


def decode(tokens: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text binary): the bytes of each list of ids; null and empty lists give empty bytes."""

    @V.tidy
    def run(batches):
        back = _inverse(path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([b"".join(back[i] for i in ids or ()) for ids in batch.column(1).to_pylist()], pa.binary())], ["id", "text"])

    return tokens.select(tokens[id_col].alias("id"), tokens[ids_col]).mapInArrow(run, f"id {tokens.schema[id_col].dataType.simpleString()}, text binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, by the steps of encode()."""

    @V.tidy
    def run(batches):
        memory = _words(path)
        for batch in batches:
            for i, j, data, offsets in V.parts(batch.column(1)):
                ids, at, text, cut = pieces_to_ids(memory, data, offsets, True)
                ids, text = memoryview(ids.astype("<u4").view(np.uint8)), memoryview(np.ascontiguousarray(text))
                yield pa.record_batch([
                    batch.column(0)[i:j], pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(ids[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:])]),
                    pa.array([hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:])]),
                ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
