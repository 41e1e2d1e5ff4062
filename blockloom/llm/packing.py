"""Best-fit packing of documents into sequences by linear grouping.

Only the histogram of piece lengths (at most `capacity` rows) reaches the driver.  There,
lengths above a share of the capacity are dealt into groups of equal cardinality and
rounded up to the longest of the group; a configuration program over these few sizes is
solved by column generation; actual lengths replace the rounded ones; the small lengths are
placed best fit, longest first.  The plan says how many sequences hold which lengths, so its
size depends on the capacity and not on the number of documents.  Of several shares that
divide large from small, the one with the fewest sequences is taken.  Each piece then finds its
place by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm import bpe
from blockloom.llm import textvec as V
from blockloom.llm.session import checkpoint

CAPACITY = 2048
GROUPS = 64
#: What share of the capacity makes a length large: with a low one configurations place more, with a high one best fit.
LARGE = (1 / 4, 1 / 3, 2 / 5, 1 / 2)
#: Lengths are rounded up to a multiple of this in the configuration program.
GRAIN = 8
#: Distinct words that a worker remembers; the library is quick enough to tell the others again.
REMEMBERED = 120_000
#: Pieces of one length are ranked in buckets of about this many.
RANKED_TOGETHER = 200_000


@dataclass
class Run:
    """count sequences, each with the lengths of items: (length, copies)."""

    count: int
    items: list[tuple[int, int]] = field(default_factory=list)

    def used(self) -> int:
        return sum(a * b for a, b in self.items)


def best_configuration(sizes: np.ndarray, value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within room of greatest value (unbounded knapsack)."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = sizes <= c
        gain = np.where(fits, best[np.maximum(c - sizes, 0)] + value, 0.0)
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-12:
            best[c], take[c] = gain[k], k
        else:
            best[c] = best[c - 1]
    out, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            out[take[c]] += 1
            c -= int(sizes[take[c]])
    return float(best[room]), out


def configurations(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of the sizes with integer multiplicities that cover the demand."""
    n = len(sizes)
    columns = np.diag(room // sizes).astype(float)
    inverse, level = np.diag(1 / np.diag(columns)), demand / np.diag(columns)
    for _ in range(60 * n):
        value, pattern = best_configuration(sizes, np.maximum(inverse.sum(0), 0), room)
        if value <= 1 + 1e-9:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-12, level / np.where(step > 1e-12, step, 1), np.inf)
        out = int(ratio.argmin())
        level = level - ratio[out] * step
        level[out] = ratio[out]
        columns[:, out] = pattern
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
    whole = np.floor(level + 1e-9).astype(np.int64)
    out = [(columns[:, k].astype(np.int64), int(whole[k])) for k in range(n) if whole[k] > 0]
    left = demand - sum((c * m for c, m in out), np.zeros(n, np.int64))
    left = np.maximum(left, 0)
    while left.any():  # the few that rounding down has left: first fit, longest first
        pattern, space = np.zeros(n, np.int64), room
        for k in np.argsort(-sizes, kind="stable"):
            pattern[k] = min(left[k], space // sizes[k])
            space -= pattern[k] * sizes[k]
        times = int(min(left[k] // pattern[k] for k in range(n) if pattern[k]))
        left = left - pattern * times
        out.append((pattern, times))
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, grain: int = GRAIN) -> list[Run]:
    """Runs of equal sequences that hold every length as often as the histogram says."""
    return min((_plan(histogram, capacity, groups, grain, share) for share in LARGE), key=lambda runs: sum(r.count for r in runs))


def _plan(histogram: dict[int, int], capacity: int, groups: int, grain: int, share: float) -> list[Run]:
    runs: list[Run] = []
    rest = {k: v for k, v in histogram.items() if v > 0}
    if rest.get(capacity):
        runs.append(Run(rest.pop(capacity), [(capacity, 1)]))
    large = sorted((k for k in rest if k > share * capacity), reverse=True)
    if large:
        each = -(-sum(rest[k] for k in large) // groups)
        members: list[list[list[int]]] = []  # of each group: [length, how many], longest first
        space = 0
        for k in large:
            n = rest.pop(k)
            while n:
                if not space:
                    members.append([])
                    space = each
                m = min(n, space)
                members[-1].append([k, m])
                n, space = n - m, space - m
        by_size: dict[int, list[list[int]]] = {}
        for g in members:
            by_size.setdefault(-(-g[0][0] // grain), []).extend(g)
        sizes = np.array(list(by_size), np.int64)
        queues = list(by_size.values())
        demand = np.array([sum(m for _, m in q) for q in queues], np.int64)
        for pattern, times in configurations(sizes, demand, capacity // grain):
            slots = [k for k in range(len(sizes)) for _ in range(pattern[k])]
            while times:
                here = [(k, slots.count(k)) for k in dict.fromkeys(slots) if queues[k]]
                if not here:
                    break
                wanted = {k: min(c, sum(m for _, m in queues[k])) for k, c in here}
                m = min(times, *(max(1, queues[k][0][1] // c) for k, c in wanted.items()))
                items: list[tuple[int, int]] = []
                for k, c in wanted.items():
                    if queues[k][0][1] >= c * m:
                        items.append((queues[k][0][0], c))
                        queues[k][0][1] -= c * m
                    else:  # m is 1: the head runs out within this sequence
                        for _ in range(c):
                            items.append((queues[k][0][0], 1))
                            queues[k][0][1] -= 1
                            if not queues[k][0][1]:
                                queues[k].pop(0)
                    if queues[k] and not queues[k][0][1]:
                        queues[k].pop(0)
                runs.append(Run(m, items))
                times -= m
    _best_fit(runs, rest, capacity)
    return runs


def _best_fit(runs: list[Run], small: dict[int, int], capacity: int) -> None:
    """Places the small lengths, longest first, each where it leaves the least room."""
    open_by: dict[int, list[Run]] = {}
    for r in runs:
        if capacity > r.used():
            open_by.setdefault(capacity - r.used(), []).append(r)
    order = sorted(open_by)

    def put(room: int, r: Run) -> None:
        if room:
            if room not in open_by:
                bisect.insort(order, room)
                open_by[room] = []
            open_by[room].append(r)

    for k in sorted(small, reverse=True):
        n = small[k]
        while n:
            at = bisect.bisect_left(order, k)
            if at == len(order):
                room, r = capacity, Run(-(-n // (capacity // k)))
                runs.append(r)
            else:
                room = order[at]
                r = open_by[room].pop()
                if not open_by[room]:
                    del open_by[room], order[at]
            copies = min(room // k, n)
            full = min(r.count, n // copies)
            if r.count > full:
                other = Run(r.count - full, list(r.items))
                runs.append(other)
                r.count = full
                put(room, other)
            r.items.append((k, copies))
            put(room - copies * k, r)
            n -= full * copies


def slots(runs: list[Run]) -> dict[str, np.ndarray]:
    """Of each length: ranks from `rank` on stand in sequences from `sequence` on, at `offset`."""
    rows, base, seen = [], 0, {}
    for r in runs:
        offset = 0
        for length, copies in r.items:
            for _ in range(copies):
                rows.append((length, seen.get(length, 0), base, offset))
                seen[length] = seen.get(length, 0) + r.count
                offset += length
        base += r.count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T.copy()))


@lru_cache(2)
def _coder(ranks_path: str, pattern: str) -> bpe.Words:
    import tiktoken

    core = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=bpe.ranks(ranks_path), special_tokens={})._core_bpe
    return bpe.Words(lambda words: [(core.encode_single_piece(w), b"") for w in words], REMEMBERED)


@lru_cache(2)
def added_tokens(ranks_path: str) -> tuple[tuple[bytes, int], ...]:
    """Bytes and id of the added tokens of the .json beside the ranks, which that file's library finds inside texts; none without the file.

    Only tokens taken as they stand are known here: none that strip space, ask for whole words or are normalised.
    """
    path = os.path.splitext(ranks_path)[0] + ".json"
    if not os.path.exists(path):
        return ()
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    if odd := [t["content"] for t in found if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]:
        raise ValueError(f"added tokens of a kind that is not done: {odd}")
    return tuple((t["content"].encode(), t["id"]) for t in found)


def _ids(memory: bpe.Words, data: np.ndarray, offsets: np.ndarray, added: tuple[tuple[bytes, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents one after another, and where each begins; an added token is one id and parts the text."""
    pattern = re.compile(b"|".join(re.escape(t) for t, _ in sorted(added, key=lambda a: -len(a[0])))) if added else None
    raw = data.tobytes() if added else b""
    if not added or not pattern.search(raw):
        return tuple(bpe.pieces_to_ids(memory, data, offsets, False))
    known, edges, special = dict(added), [], {}
    first = [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        at = a
        for m in pattern.finditer(raw, a, b):
            if m.start() > at:
                edges.append(at)
            special[len(edges)] = known[m[0]]
            edges.append(m.start())
            at = m.end()
        if at < b or at == a:
            edges.append(at)
        first.append(len(edges))
    ids, at = bpe.pieces_to_ids(memory, data, np.array([*edges, len(data)], offsets.dtype), False)
    where = np.array(list(special), np.int64)
    keep = np.ones(len(ids), bool)
    keep[V.ragged(at[where] + 1, at[where + 1] - at[where] - 1)] = False
    ids = ids.copy()
    ids[at[where]] = np.array(list(special.values()), ids.dtype)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return ids[keep], kept[at[np.array(first)]]


def cut(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's pieces.

    A document is its ids and one id 0; only one longer than the capacity is cut, and then its
    first piece is the one that may be shorter.  A null text counts as empty.  Ids are those of
    the tokenizers library without special tokens around the text: added tokens within it count.
    """

    @V.tidy
    def run(batches):
        memory, added = _coder(ranks_path, pattern), added_tokens(ranks_path)
        for batch in batches:
            for i, j, data, offsets in V.parts(batch.column(1)):
                ids, at = _ids(memory, data, offsets, added)
                n = np.diff(at) + 1
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(j - i), pieces)
                piece = V.ragged(np.zeros(len(n), np.int64), pieces)
                first = (n - (pieces - 1) * capacity)[doc]
                start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
                length = np.where(piece == 0, first, capacity)
                last = piece == pieces[doc] - 1
                raw, s = memoryview(ids.astype("<u4").view(np.uint8)), 4 * (at[:-1][doc] + start)
                crc = [zlib.crc32(raw[a:b]) if not z else zlib.crc32(b"\0\0\0\0", zlib.crc32(raw[a : b - 4])) for a, b, z in zip(s.tolist(), (s + 4 * length).tolist(), last.tolist())]
                yield pa.record_batch([batch.column(0)[i:j].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset: sequences of at most `capacity`, gapless from 0.

    pieces has length (1..capacity), doc_id, piece and ids_crc32; it is read several times and
    so has to be written out.  Equal rows are packed as often as they occur; no rows give no rows.
    """
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    where = slots(plan(histogram, capacity))
    buckets = max(16, sum(histogram.values()) // RANKED_TOGETHER)
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(buckets)).cast("int"))
    before = keyed.groupBy("length", "_bucket").count().withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before")).select(*pieces.columns, "_rank")
    key = (where["length"] << 40) + where["rank"]

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(key, (length << 40) + rank, "right") - 1
            yield pa.record_batch([*batch.columns[:-1], pa.array(where["sequence"][at] + rank - where["rank"][at]), pa.array(where["offset"][at])], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, ranked.drop("_rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema)


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """cut() and pack(); the pieces, a few numbers each, are written out in between."""
    return pack(checkpoint(cut(docs, ranks_path, pattern, capacity)), capacity)
