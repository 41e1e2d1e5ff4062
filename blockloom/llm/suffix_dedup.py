"""Suffix-array dedup: bytes covered by a string of SPAN bytes that also starts earlier go.

Every string of SPAN bytes has one anchor, the leftmost of its K-byte windows of least hash.
Neighbouring starts that share an anchor form a segment, so equal strings always lie in
segments with equal anchors.  Segments meet at their anchor: copies of a segment, equal in the
anchor's hash and in 96 bits of two hashes of all their bytes, are removed at once, and the distinct segments of an anchor go into a suffix array, built by linear
grouping, in which equal strings are neighbours.  Only these segments' bytes are fetched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.llm import textvec as V
from blockloom.llm.session import checkpoint

SPAN = 100
K = 40
#: Segments of several anchors are sorted together up to this many bytes.
BLOCK_BYTES = 48 << 10
#: Distinct segments of one anchor beyond this many bytes are compared start by start.
ANCHOR_BYTES = 1 << 20
#: Such anchors are broadcast up to this many (16 bytes each).
BROADCAST_ANCHORS = 100_000
#: Documents longer than this are cut, with SPAN - 1 bytes of overlap, while anchors are sought.
PIECE_BYTES = 2 << 20
#: Bytes of segments passed on together.
FETCHED_TOGETHER = 32 << 20


# --- linear grouping -----------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `text` in ascending order.

    First every suffix is put in the group of its Lyndon prefix: groups are processed in
    descending order; each suffix of a group points to the nearest one before it in a smaller
    group, and the suffixes pointed to leave their groups upwards, those pointed to more often
    the further.  Then the order within all groups is emitted in one ascending pass along the
    same pointers.
    """
    n = len(text) + 1
    codes = np.append(text.astype(np.int64) + 1, 0)
    order = np.argsort(codes, kind="stable")
    change = np.flatnonzero(np.diff(codes[order])) + 1
    heads = np.concatenate([[0], change])
    sizes = np.diff(np.append(heads, n))
    array = order.tolist()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group = np.empty(n, np.int64)
    group[order] = np.repeat(heads, sizes)
    size = np.zeros(n, np.int64)
    size[heads] = sizes
    place, group, size = place.tolist(), group.tolist(), size.tolist()
    smaller = [-1] * n
    end = n
    while end > 0:
        head = group[array[end - 1]]
        if end - head == 1:
            s = array[head]
            p = s - 1
            while p >= 0 and group[p] > head:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                old = group[p]
                count = size[old]
                if count > 1:
                    last = old + count - 1
                    at, q = place[p], array[last]
                    array[at], array[last] = q, p
                    place[q], place[p] = at, last
                    size[old], size[last], group[p] = count - 1, 1, last
        else:
            pointed: dict[int, int] = {}
            for s in sorted(array[head:end]):
                p = s - 1
                while p >= 0 and group[p] >= head:
                    p = smaller[p]
                smaller[s] = p
                if p >= 0:
                    pointed[p] = pointed.get(p, 0) + 1
            by_times: dict[int, dict[int, list[int]]] = {}
            for p, k in pointed.items():
                by_times.setdefault(k, {}).setdefault(group[p], []).append(p)
            for k in sorted(by_times, reverse=True):
                for old, moved in by_times[k].items():
                    count, m = size[old], len(moved)
                    if m == count:
                        continue
                    head_new = old + count - m
                    slot = old + count - 1
                    for p in moved:
                        at, q = place[p], array[slot]
                        array[at], array[slot] = q, p
                        place[q], place[p] = at, slot
                        group[p] = head_new
                        slot -= 1
                    size[old], size[head_new] = count - m, m
        end = head
    out = [-1] * n
    out[0] = n - 1
    waiting = [True] * n
    waiting[n - 1] = False
    following = list(range(n))
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and waiting[j]:
            g = group[j]
            out[following[g]] = j
            following[g] += 1
            waiting[j] = False
            j = smaller[j]
    return np.array(out[1:], np.int64)


def repeated_starts(segments: list[bytes], starts: list[int], order: list[tuple], span: int = SPAN) -> list[np.ndarray]:
    """Of each segment, the offsets below `starts` at which stands a string that also starts earlier.

    order gives each segment's place, as (document, position): a start at offset o has the
    place (document, position + o).  Ends of segments, and segments, whose strings' hashes
    occur once are left out of the suffix array.
    """
    first, last = _worth_sorting(segments, starts, span)
    chosen = [k for k in range(len(segments)) if first[k] <= last[k]]
    out = [np.zeros(0, np.int64)] * len(segments)
    if chosen:
        cut = [segments[k][first[k] : last[k] + span] for k in chosen]
        found = _repeated([*cut], [int(last[k] - first[k]) + 1 for k in chosen], [(*order[k][:-1], order[k][-1] + int(first[k])) for k in chosen], span)
        for k, offsets in zip(chosen, found):
            out[k] = offsets + first[k]
    return out


def _worth_sorting(segments: list[bytes], starts: list[int], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment the first and last start whose string's hash occurs again; first > last if there is none."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    counts = np.array(starts, np.int64)
    begins = np.cumsum(sizes) - sizes
    at = V.ragged(begins, counts)
    which = np.repeat(np.arange(len(segments)), counts)
    _, back, times = np.unique(V.hashes(V.lanes(data), data, at, at + span), return_inverse=True, return_counts=True)
    again = times[back] > 1
    first, last = np.full(len(segments), 2**62), np.full(len(segments), -1)
    offset = at - begins[which]
    np.minimum.at(first, which[again], offset[again])
    np.maximum.at(last, which[again], offset[again])
    return first, last


def _repeated(segments: list[bytes], starts: list[int], order: list[tuple], span: int) -> list[np.ndarray]:
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    begins = np.cumsum([0, *(len(s) + 1 for s in segments[:-1])])
    counts = np.array(starts, np.int64)
    at = V.ragged(begins, counts)
    which = np.repeat(np.arange(len(segments)), counts)
    valid = np.zeros(len(text), bool)
    valid[at] = True
    sorted_starts = suffix_array(text)
    sorted_starts = sorted_starts[valid[sorted_starts]]
    segment_of = np.zeros(len(text), np.int64)
    segment_of[at] = which
    words = np.lib.stride_tricks.sliding_window_view(text, min(8, span))
    same = np.ones(max(0, len(sorted_starts) - 1), bool)
    for o in [*range(0, span - 7, 8), max(0, span - 8)]:
        w = words[sorted_starts + o]
        same &= (w[1:] == w[:-1]).all(1)
    if not same.any():
        return [np.zeros(0, np.int64)] * len(segments)
    kind = np.concatenate([[0], np.cumsum(~same)])
    documents = sorted({o[:-1] for o in order})
    number = {d: k for k, d in enumerate(documents)}
    doc = np.array([number[o[:-1]] for o in order], np.int64)
    position = np.array([o[-1] for o in order], np.int64)
    seg = segment_of[sorted_starts]
    offset = sorted_starts - begins[seg]
    rank = np.lexsort((position[seg] + offset, doc[seg], kind))
    k, d, p = kind[rank], doc[seg][rank], (position[seg] + offset)[rank]
    first = np.concatenate([[True], k[1:] != k[:-1]])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
    later = (d != d[lead]) | (p != p[lead])
    seg, offset = seg[rank][later], offset[rank][later]
    by = np.lexsort((offset, seg))
    seg, offset = seg[by], offset[by]
    edges = np.searchsorted(seg, np.arange(len(segments) + 1))
    return [offset[a:b] for a, b in zip(edges[:-1], edges[1:])]


# --- segments by anchor --------------------------------------------------------------------


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    n = len(keys)
    padded = np.concatenate([keys, np.full(-n % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, k: int = K):
    """(document, position, starts, anchor hash, content hash, another) of all segments of the documents."""
    width = span - k + 1
    if len(data) < span:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    lane = V.lanes(data)
    hashes = V.windows(lane, k)
    low = np.uint64(24)
    least = _sliding_least(hashes >> low << low | np.arange(len(hashes), dtype=np.uint64), width)
    valid = np.zeros(len(data) + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= span)
    valid[offsets[long]] += 1
    valid[offsets[long + 1] - span + 1] -= 1
    valid = np.cumsum(valid[: len(least)], dtype=np.int8) > 0
    head = valid.copy()
    head[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    stop = np.zeros(len(least), bool)
    stop[:-1] = valid[:-1] & (head[1:] | ~valid[1:])
    stop[-1] = valid[-1]
    s, e = np.flatnonzero(head), np.flatnonzero(stop) + 1
    anchor = hashes[(least[s] & np.uint64((1 << 24) - 1)).astype(np.int64)]
    doc = np.searchsorted(offsets, s, "right") - 1
    return doc, s - offsets[doc], e - s, anchor, *V.several_hashes(lane, data, s, e + span - 1, 2)


def _pieces(column):
    """Like textvec.parts, with long documents cut: (rows, bytes, offsets, where each piece begins)."""
    for i, j, data, offsets in V.parts(column):
        if j - i > 1 or len(data) <= PIECE_BYTES:
            yield np.arange(i, j), data, offsets, np.zeros(j - i, np.int64)
        else:
            for a in range(0, len(data), PIECE_BYTES):
                part = data[a : a + PIECE_BYTES + SPAN - 1]
                yield np.array([i]), part, np.array([0, len(part)]), np.array([a])


# A start's place: the lowest 7 bits tell how many starts, the rest the position.
ID = ("given", "key", "tie", "more")


def _tie(text: Column) -> Column:
    return F.xxhash64(text)


def _told_apart(docs: DataFrame) -> bool:
    """Whether some row has no doc_id or some doc_id has several texts; else the doc_id alone tells documents apart."""
    text = docs["text"].cast("string")
    hashed = docs.select(docs["doc_id"].cast("long").alias("key"), F.struct(_tie(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")).alias("h"))
    return bool(hashed.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("key IS NULL OR lo <> hi").limit(1).count())


def _identity(docs: DataFrame, by_text: bool) -> list[Column]:
    """given, key, tie, more: rows equal in them are one document; in this order documents come one after another.

    given is false for rows without doc_id, which come first; tie and more are 128 bits of
    hashes of the text, and 0 where by_text says that no row needs them.
    """
    text, ident = docs["text"].cast("string"), docs["doc_id"].cast("long")
    none = F.lit(0).cast("long")
    return [
        ident.isNotNull().alias("given"), F.coalesce(ident, none).alias("key"),
        (_tie(text) if by_text else none).alias("tie"), (F.xxhash64(F.lit(1), text) if by_text else none).alias("more"),
    ]


def _keyed(docs: DataFrame, by_text: bool) -> DataFrame:
    return docs.select(*_identity(docs, by_text), docs["text"].cast("string").alias("text"))


def _packed(df: DataFrame, text: str) -> DataFrame:
    """df with its text column packed for a shuffle."""
    at = df.columns.index(text)

    @V.tidy
    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = V.packed(columns[at])
            yield pa.record_batch(columns, batch.schema.names)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, T.BinaryType() if f.name == text else f.dataType) for f in df.schema]))


def _anchored(docs: DataFrame, by_text: bool) -> DataFrame:
    """anchor, content, check, given, key, tie, more, place of every segment; done if it is a later copy of one nearby.

    Of repeated rows, which are one document, a chunk brings the segments once.  Later copies are known before the shuffle.  They travel under a key of their own, so an
    anchor that very many documents share brings one row for each content and chunk of text.
    """

    @V.tidy
    def run(batches):
        for batch in batches:
            ids = [batch.column(0).to_numpy(zero_copy_only=False), *(batch.column(k).to_numpy() for k in (1, 2, 3))]
            for rows, data, offsets, base in _pieces(batch.column(4)):
                doc, position, n, anchor, content, check = segments(data, offsets)
                row = rows[doc]
                place, check = position + base[doc] << 7 | n, (check >> np.uint64(33)).astype(np.int32)
                own = [x[row] for x in ids]
                order = np.lexsort((place, *own[::-1], check, content, anchor))
                place, anchor, content, check, own = place[order], anchor[order], content[order], check[order], [x[order] for x in own]
                same = lambda *xs: np.logical_and.reduce([x[1:] == x[:-1] for x in xs])
                done = np.zeros(len(order), bool)
                done[1:] = same(anchor, content, check)
                again = done.copy()
                again[1:] &= same(place, *own)
                if again.any():
                    place, anchor, content, check, done = (x[~again] for x in (place, anchor, content, check, done))
                    own = [x[~again] for x in own]
                anchor = np.where(done, V.mix(place.view(np.uint64) ^ V.mix(own[1].view(np.uint64) ^ V.mix(own[2].view(np.uint64)))), anchor)
                content, check = np.where(done, np.uint64(0), content), np.where(done, np.int32(0), check)
                yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(check), *(pa.array(x) for x in own), pa.array(place), pa.array(done)], ["anchor", "content", "check", *ID, "place", "done"])

    return _keyed(docs, by_text).mapInArrow(run, "anchor long, content long, check int, given boolean, key long, tie long, more long, place long, done boolean")


def _met(anchored: DataFrame) -> DataFrame:
    """Of the sorted segments: later copies (fetch false), and the first of each content if its anchor has several (fetch true).

    The segment of a repeated row has the first one's place as well: it is that segment, no copy of it.
    """

    @V.tidy
    def run(batches):
        before = np.zeros((0, 9), np.int64)  # the last first-of-content: anchor, content, check, given, key, tie, more, place, known to be wanted

        def emit(rows: np.ndarray, fetch: np.ndarray):
            return pa.record_batch([pa.array(rows[:, 0]), pa.array(rows[:, 3].astype(bool)), *(pa.array(rows[:, k]) for k in (4, 5, 6, 7)), pa.array(fetch)], ["anchor", *ID, "place", "fetch"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([*(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:8]), np.zeros(batch.num_rows, np.int64)], 1)
            done = batch.column(8).to_numpy(zero_copy_only=False)
            if done.any():
                yield emit(rows[done], np.zeros(int(done.sum()), bool))
                rows = rows[~done]
                if not len(rows):
                    continue
            again = np.zeros(len(rows), bool)
            again[1:] = (rows[1:, :8] == rows[:-1, :8]).all(1)
            if len(before):
                again[0] = (rows[0, :8] == before[0, :8]).all()
            if again.any():
                rows = rows[~again]
                if not len(rows):
                    continue
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
            if len(before):
                new[0] = (rows[0, :3] != before[0, :3]).any()
            copies = rows[~new]
            firsts = np.concatenate([before, rows[new]])
            joined = firsts[1:, 0] == firsts[:-1, 0]
            firsts[1:, 8] |= joined
            firsts[:-1, 8] |= joined
            before = firsts[-1:].copy()
            wanted = firsts[:-1][firsts[:-1, 8] == 1]
            yield emit(np.concatenate([copies, wanted]), np.repeat([False, True], [len(copies), len(wanted)]))
        if len(before) and before[0, 8]:
            yield emit(before, np.array([True]))

    return anchored.repartition("anchor").sortWithinPartitions("anchor", "content", "check", *ID, "place").mapInArrow(run, "anchor long, given boolean, key long, tie long, more long, place long, fetch boolean")


def _unpack(place: np.ndarray):
    return place >> 7, place & 127


def _fetched(docs: DataFrame, wanted: DataFrame, by_text: bool) -> DataFrame:
    """anchor, given, key, tie, more, place, large, bytes of the wanted segments, of repeated rows once."""
    together = FETCHED_TOGETHER // (SPAN + 127)

    @V.tidy
    def run(batches):
        for batch in batches:
            packed, asked, ids = batch.column("text"), batch.column("asked"), [batch.column(c) for c in ID]
            wanted = asked.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            for a in range(0, len(row), together):
                own, part = row[a : a + together], wanted.slice(a, together)
                texts = V.unpacked(packed.slice(int(own[0]), int(own[-1] - own[0]) + 1))
                data = np.frombuffer(b"".join(texts), np.uint8)
                position, n = _unpack(part.field("place").to_numpy())
                size = n + SPAN - 1
                body = data[V.ragged(np.cumsum([0, *(len(t) for t in texts)])[own - own[0]] + position, size)]
                edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.record_batch([part.field("anchor"), *(c.take(pa.array(own)) for c in ids), part.field("place"), part.field("large"), pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(edges), pa.py_buffer(body)])], ["anchor", *ID, "place", "large", "bytes"])

    asked = wanted.groupBy(*ID).agg(F.collect_list(F.struct("anchor", "place", "large")).alias("asked"))
    met = _packed(_keyed(docs, by_text), "text").join(asked, [*ID]).dropDuplicates([*ID])
    return met.select(*ID, "text", "asked").mapInArrow(run, "anchor long, given boolean, key long, tie long, more long, place long, large boolean, bytes binary")


def _ranges(offsets: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(offsets) > 1)
    return list(zip(offsets[np.concatenate([[0], cut + 1])].tolist(), (offsets[np.concatenate([cut, [len(offsets) - 1]])] + 1).tolist())) if len(offsets) else []


def _compared(fetched: DataFrame) -> DataFrame:
    """given, key, tie, more, begin, stop: bytes to remove, from the suffix arrays of blocks of whole anchors."""

    def block(rows: list[tuple]):
        """rows: anchor, given, key, tie, more, place, bytes."""
        found = repeated_starts([r[6] for r in rows], [r[5] & 127 for r in rows], [(*r[1:5], r[5] >> 7) for r in rows])
        out = [(*r[1:5], p + a, p + b + SPAN - 1) for r, offsets in zip(rows, found) for p in [r[5] >> 7] for a, b in _ranges(offsets)]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, [pa.bool_()] + [pa.int64()] * 5)], [*ID, "begin", "stop"])

    @V.tidy
    def run(batches):
        rows, group, size = [], [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if group and r[0] != group[-1][0]:
                    rows, group = rows + group, []
                    if size >= BLOCK_BYTES:
                        yield block(rows)
                        rows, size = [], 0
                group.append(r)
                size += len(r[6])
        if rows or group:
            yield block(rows + group)

    return fetched.where("NOT large").select("anchor", *ID, "place", "bytes").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "given boolean, key long, tie long, more long, begin long, stop long")


def _compared_by_start(fetched: DataFrame) -> DataFrame:
    """The same for anchors with too many distinct segments: each string meets its own copies."""
    starts = fetched.where("large").select(*ID, F.shiftright("place", 7).alias("base"), "place", "bytes")
    starts = starts.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("place").bitwiseAND(F.lit(127)).cast("int") - 1)))
    starts = starts.select(F.expr(f"substring(bytes, o + 1, {SPAN})").alias("string"), F.struct(*ID, (F.col("base") + F.col("o")).alias("begin")).alias("at"))
    first = starts.groupBy("string").agg(F.min("at").alias("first"))
    return starts.join(first, "string").where("at > first").select(*(f"at.{c}" for c in ID), "at.begin", (F.col("at.begin") + SPAN).alias("stop"))


def removals(docs: DataFrame, by_text: bool) -> DataFrame:
    """given, key, tie, more, begin, stop: byte ranges to remove, which may overlap."""
    met = checkpoint(_met(_anchored(docs, by_text)))
    wanted = met.where("fetch").drop("fetch")
    size = F.col("place").bitwiseAND(F.lit(127)) + SPAN - 1
    large = checkpoint(wanted.groupBy("anchor").agg(F.sum(size).alias("_size")).where(F.col("_size") > ANCHOR_BYTES).select("anchor", F.lit(True).alias("large")))
    few = large.limit(BROADCAST_ANCHORS + 1).count() <= BROADCAST_ANCHORS
    marked = wanted.join(F.broadcast(large) if few else large, "anchor", "left").withColumn("large", F.coalesce("large", F.lit(False)))  # a hot anchor's segments stay where they are
    fetched = checkpoint(_fetched(docs, marked, by_text))
    position = F.shiftright("place", 7)
    copies = met.where("NOT fetch").select(*ID, position.alias("begin"), (position + size).alias("stop"))
    compared = checkpoint(_compared(fetched))
    return copies.unionByName(compared).unionByName(_compared_by_start(fetched))


def merged(begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the ranges; touching ranges are one run."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(stop[order]) if len(stop) else stop
    new = np.concatenate([[True], begin[1:] > reach[:-1]]) if len(begin) else np.zeros(0, bool)
    return begin[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(begin) - 1)] if len(begin) else reach


def _with_spans(docs: DataFrame) -> DataFrame:
    """The columns, named d0, d1, ..., the text packed, then whether it was null and its spans."""
    by_text = _told_apart(docs)
    spans = removals(docs, by_text).groupBy(*ID).agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    names = {c: f"d{k}" for k, c in enumerate(docs.columns)}
    text = docs["text"].cast("string")
    plain = docs.select(*((text if c == "text" else docs[c]).alias(n) for c, n in names.items()), *_identity(docs, by_text), text.isNull().alias("none"))
    return _packed(plain, names["text"]).join(spans, [*ID], "left").drop(*ID)


def _cut(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed)."""
    if not spans:
        return raw, 0, 0
    begin, stop = merged(np.array([s["begin"] for s in spans], np.int64), np.array([s["stop"] for s in spans], np.int64))
    kept, at = [], 0
    for a, b in zip(begin.tolist(), stop.tolist()):
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept), int((stop - begin).sum()), len(begin)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Null texts count as empty; texts shorter than SPAN stay whole.  Rows with equal doc_id and
    text count as one document, and so do rows of equal text without doc_id; rows that share
    only the doc_id count as documents in a fixed order of their own.  A null doc_id comes
    before all others.
    """

    @V.tidy
    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(V.unpacked(batch.column(1)), batch.column(3).to_pylist()):
                kept, removed, runs = _cut(text, spans)
                rows.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest()))
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, [pa.int64()] * 3 + [pa.string()]))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs.select("doc_id", docs["text"].cast("string").alias("text"))).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts and, if there is such a column, n_chars.

    A character of which a byte is removed goes with it.  Documents of which nothing is left
    go; empty and null texts stay as they are.  Rows that count as one document stay or go together.
    """
    text, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    schema = docs.schema

    @V.tidy
    def run(batches):
        for batch in batches:
            keep, texts = [], []
            for raw, none, spans in zip(V.unpacked(batch.column(text)), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                kept, removed, _ = _cut(raw, spans)
                left = kept.decode("utf-8", "ignore")
                keep.append(not removed or bool(left))
                texts.append(None if none else left)
            columns = list(batch.columns[:-2])
            columns[text] = pa.array(texts, pa.string())
            if chars is not None:
                columns[chars] = pa.array([n if t is None else len(t) for n, t in zip(columns[chars].to_pylist(), texts)], columns[chars].type)
            yield pa.record_batch(columns, schema.names).filter(pa.array(keep, pa.bool_()))

    return _with_spans(docs).mapInArrow(run, schema)
