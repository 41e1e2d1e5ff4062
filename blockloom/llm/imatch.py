"""Document fingerprints: I-Match with randomised lexicons.

The lexicon is every word whose inverse document frequency lies in a band.  A document's
distinct lexicon words, sorted, are hashed once whole and once for each of several random
sub-lexicons at falling rates, so that of documents of any length some sub-lexicons hold only
a word or two.  Two fingerprints are as alike as their hashes agree.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import textvec as V
from blockloom.llm.session import let_go

#: The lexicon's words occur in this share of the documents, and in LEAST_DOCUMENTS at least.  It has at
#: most (distinct words of a document, on average) / BAND[0] words, whatever the number of documents.
BAND = (0.001, 0.2)
LEAST_DOCUMENTS = 2
#: A document with fewer lexicon words is fingerprinted by all its words.
LEAST_WORDS = 4
#: Sub-lexicons keep a word with probability 4**-j; so many for each j, after one whole lexicon.
LEVELS, PER_LEVEL = 5, 32
HASHES = 1 + LEVELS * PER_LEVEL
#: Words counted together before they are passed on.
COUNTED_TOGETHER = 2_000_000


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document) of each document's distinct words in ascending order; A-Z count as a-z."""
    data = V.lower(data)
    starts, ends, first = V.words(data, offsets)
    key = V.hashes(V.lanes(data), data, starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return key[keep], doc[keep]


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> np.ndarray:
    """Sorted hashes of the words in the band, by document frequencies over all rows."""

    @V.tidy
    def run(batches):
        def told(seen):
            keys, back = np.unique(np.concatenate([k for k, _ in seen]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([c for _, c in seen])).astype(np.int64)

        seen, size = [], 0
        for batch in batches:
            for _, _, data, offsets in V.parts(batch.column(0)):
                seen.append(np.unique(terms(data, offsets)[0], return_counts=True))
                size += len(seen[-1][0])
                if size >= COUNTED_TOGETHER:
                    seen = [told(seen)]
                    size = len(seen[0][0])
                    if size >= COUNTED_TOGETHER // 2:
                        yield pa.record_batch([pa.array(seen[0][0].view(np.int64)), pa.array(seen[0][1])], ["word", "documents"])
                        seen, size = [], 0
        if seen:
            keys, counts = told(seen)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "documents"])

    n = docs.count()
    counts = docs.select(docs["text"].cast("string")).mapInArrow(run, "word long, documents long").groupBy("word").agg(F.sum("documents").alias("documents"))
    chosen = counts.where(F.col("documents").between(max(LEAST_DOCUMENTS, band[0] * n), band[1] * n)).select("word")
    found = chosen.toArrow().column(0).to_numpy().view(np.uint64)
    let_go(chosen)
    return np.sort(found)


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(documents, HASHES) of 16 bits; 0 says that the sub-lexicon has none of the document's words."""
    n = len(offsets) - 1
    key, doc = terms(data, offsets)
    if len(words):
        inside = words[np.minimum(np.searchsorted(words, key), len(words) - 1)] == key
    else:
        inside = np.zeros(len(key), bool)
    few = np.bincount(doc[inside], minlength=n) < LEAST_WORDS
    inside |= few[doc]
    key, doc = key[inside], doc[inside]
    out = np.zeros((n, HASHES), np.uint16)
    word, left, column = None, 0, 0
    for level in range(LEVELS + 1):
        bits = 2 * level
        for _ in range(PER_LEVEL if level else 1):
            if not level:
                mine = np.arange(len(key))
            else:
                if left < bits:
                    word, left = V.mix(key ^ V.mix(np.array([column + 1], np.uint64))), 64
                left -= bits
                mine = np.flatnonzero(word >> np.uint64(left) & np.uint64((1 << bits) - 1) == 0)
            if len(mine):
                d = doc[mine]
                first = np.searchsorted(d, np.arange(n + 1))
                rank = (np.arange(len(mine)) - first[d]).astype(np.uint64)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(V.mix(key[mine] + rank * np.uint64(0x9E3779B97F4A7C15)))])
                hashed = V.mix(sums[first[1:]] - sums[first[:-1]]) >> np.uint64(48)
                out[:, column] = np.where(np.diff(first) > 0, np.maximum(hashed, np.uint64(1)), 0)
            column += 1
        left = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of rows: the best share of agreeing hashes among those of one rate that hold words; 1 for equal rows."""
    equal, told = (a == b) & (a > 0), (a > 0) | (b > 0)
    best = np.zeros(len(a))
    for level in range(1, LEVELS + 1):
        at = slice(1 + (level - 1) * PER_LEVEL, 1 + level * PER_LEVEL)
        n = told[:, at].sum(1)
        best = np.maximum(best, np.where(n >= 4, equal[:, at].sum(1) / np.maximum(n, 1), 0))
    return np.where((a == b).all(1), 1.0, best)


def as_text(prints: np.ndarray) -> list[str]:
    raw = prints.astype(">u2").tobytes().hex()
    return [raw[k : k + 4 * HASHES] for k in range(0, len(raw), 4 * HASHES)]


def fingerprint(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """doc_id, fingerprint of every row; null texts count as empty, equal texts have equal fingerprints."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in V.parts(batch.column(1)):
                yield pa.record_batch([batch.column(0)[i:j], pa.array(as_text(fingerprints(data, offsets, words)))], ["doc_id", "fingerprint"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


@dataclass(frozen=True)
class Ranges:
    """Ranges of rows by descending key, then ascending tie; a key on which several cuts fall has ranges of ties of its own."""

    cuts: np.ndarray  # distinct, ascending
    parts: np.ndarray  # into how many ranges of ties each cut's own key is dealt, 0 if it is not
    begins: np.ndarray  # of the keys above all cuts, then of those up to the greatest cut, ...: the first range

    @staticmethod
    def of(cuts: list[int]) -> Ranges:
        values, times = np.unique(np.array(cuts, np.int64), return_counts=True)
        parts = np.where(times > 1, times, 0)
        return Ranges(values, parts, np.concatenate([[0], np.cumsum(np.concatenate([[1], parts[::-1] + 1]))]).astype(np.int64))

    def place(self, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.cuts, key, "left")
        out = self.begins[len(self.cuts) - at].copy()
        below = at < len(self.cuts)
        i = np.minimum(at, max(len(self.cuts) - 1, 0))
        if len(self.cuts):
            m = np.where(below, self.parts[i], 0)
            own = below & (self.cuts[i] == key) & (m > 0)
            from_least = (tie.view(np.uint64) ^ np.uint64(1 << 63)).astype(np.float64) / 2.0**64
            sub = np.minimum((from_least * np.maximum(m, 1)).astype(np.int64), np.maximum(m, 1) - 1)
            out += np.where(own, sub, m)
        return out


def _in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, guest, key, tie, doc_id, text (packed): ranges of descending ids, each followed by the next range's first row as guest.

    Rows of one doc_id, and those without any, follow each other by a hash of the text; where
    they are many they have several ranges.
    """
    lowest = -(2**63)
    keyed = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(lowest)).alias("key"), F.xxhash64(docs["text"].cast("string")).alias("tie"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    cuts = keyed.agg(F.percentile_approx("key", [k / buckets for k in range(1, buckets)], 100 * buckets)).first()[0] if buckets > 1 else []
    ranges = Ranges.of(cuts or [])

    def firsts(bucket: np.ndarray, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """Of each bucket there the row that comes first."""
        order = np.lexsort((tie, ~key, bucket))
        return order[np.unique(bucket[order], return_index=True)[1]]

    def heads(batches):
        for batch in batches:
            key, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            b = ranges.place(key, tie)
            at = firsts(b, key, tie)
            yield pa.record_batch([pa.array(b[at]), pa.array(key[at]), pa.array(~tie[at])], ["bucket", "key", "late"])

    found = keyed.select("key", "tie").mapInArrow(heads, "bucket long, key long, late long").groupBy("bucket").agg(F.max(F.struct("key", "late")).alias("h")).collect()  # a row for each range
    head = {r["bucket"]: (r["h"]["key"], ~r["h"]["late"]) for r in found}
    order = sorted(head)
    host = {b: order[k - 1] for k, b in enumerate(order)}  # the first range's first row follows the last range

    @V.tidy
    def dealt(batches):
        for batch in batches:
            key, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            b = ranges.place(key, tie)
            at = firsts(b, key, tie)
            guests = np.array([k for k in at.tolist() if (key[k], tie[k]) == head[b[k]]], np.int64)
            both = np.concatenate([np.arange(len(key)), guests])
            to = np.concatenate([b, np.array([host[x] for x in b[guests].tolist()], np.int64)])
            columns = [*batch.columns[:-1], V.packed(batch.column(3))]
            yield pa.record_batch([pa.array(to), pa.array(np.repeat([0, 1], [len(key), len(guests)]).astype(np.int32)), *(c.take(pa.array(both)) for c in columns)], ["bucket", "guest", "key", "tie", "doc_id", "text"])

    rows = keyed.mapInArrow(dealt, "bucket long, guest int, key long, tie long, doc_id long, text binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc("key"), "tie")


def edited_likeness(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like they and the next document's are.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    In the edited text the last half of the characters is replaced by the first as many of the
    next document in descending doc_id, after the last one of the first.  Null texts count as
    empty.  Rows that share a doc_id follow each other by a hash of the text; a null doc_id comes last.
    """
    words = lexicon(docs)
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(raw: list[bytes]):
        return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)

    def judged(ids: list, texts: list[str], last_bucket_rows: list[int], follows: list[int]):
        """Rows `last_bucket_rows` are answered; follows gives each one's next row."""
        raw = [t.encode() for t in texts]
        own = fingerprints(*pack(raw), words)
        edited = []
        for k, f in zip(last_bucket_rows, follows):
            half = len(texts[k]) // 2
            edited.append((texts[k][: len(texts[k]) - half] + texts[f][:half]).encode())
        changed = fingerprints(*pack(edited), words)
        mine, nxt = own[last_bucket_rows], own[follows]
        return pa.record_batch([
            pa.array([ids[k] for k in last_bucket_rows], pa.int64()), pa.array([len(texts[k]) for k in last_bucket_rows], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array(as_text(mine)), pa.array(as_text(changed)),
            pa.array(likeness(mine, changed)), pa.array(likeness(mine, nxt)),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    @V.tidy
    def run(batches):
        rows: list[tuple] = []  # (bucket, guest, doc_id, text) not answered yet
        size = 0

        def answer(rows):
            ask = [k for k in range(len(rows) - 1) if not rows[k][1]]
            return judged([r[2] for r in rows], [r[3] for r in rows], ask, [k + 1 for k in ask])

        for batch in batches:
            for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), (t.decode() for t in V.unpacked(batch.column(5)))):
                if r[1] and rows and rows[-1][1] and rows[-1][0] == r[0]:
                    continue  # of several guests the first is the next document
                rows.append(r)
                size += len(r[3])
                if size >= V.CHUNK_BYTES and len(rows) > 1:
                    yield answer(rows)
                    rows, size = rows[-1:], 0
        if len(rows) > 1:
            yield answer(rows)

    return _in_order(docs, buckets).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
