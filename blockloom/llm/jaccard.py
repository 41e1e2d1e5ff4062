"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, by prefix trees.

Shingles have one global order: frequent ones last, the rest by hash.  Two sets that overlap
enough share one of the first few shingles in that order, so documents meet at those; the
least set met is the hub of all that meet there, and each hub's sets go into one trie, or
several where they are many: each of these also holds the hub's set, and only sets that are not
connected to it there meet the sets of the other tries.  Sets probe a trie with what overlap its
shared paths give, and leave every subtree whose remaining lengths cannot reach the bound.
Links become components by star contractions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import textvec as V
from blockloom.llm.session import checkpoint

WORDS = 5
#: Two sets link when SIMILARITY[1] * intersection >= SIMILARITY[0] * union.
SIMILARITY = (80, 100)
#: Shingles counted at once where frequent ones are sought, and how often one must occur among them to be counted.
COUNTED_TOGETHER, COUNTED_FROM = 2_000_000, 8
#: So many of the most frequent shingles stand last in the global order; which ones they are only changes the work.
FREQUENT = 100_000
FREQUENT_FROM = 48
#: Sets of one trie; a hub with more has them in blocks.
BLOCK = 512
SALTS = 32
#: Hubs of several blocks are broadcast up to this many (12 bytes each).
BROADCAST_HUBS = 100_000
#: Beyond the first shingles that a link needs, one in so many of a set's shingles is looked at too; a set of which
#: fewer than as many meet another set there cannot link.
EXTRA = 20
#: Rounds in which groups move to their hub's own hub.
GATHERED = 2
_TOP = np.uint64(1 << 63)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(63-bit hashes, first of each document): each document's distinct shingles in ascending order.

    A-Z count as a-z; with fewer words than that the whole sequence is one shingle.
    """
    data = V.lower(data)
    starts, ends, first = V.words(data, offsets)
    n = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = V.hashes(V.lanes(data), data, starts, ends)
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    size = np.minimum(count, words)[doc]  # words of the shingle that begins here
    left = first[1:][doc] - np.arange(len(h))
    out = np.zeros(len(h), np.uint64)
    for k in range(words):
        part = V.mix(h + np.uint64(0x51ED270B * (k + 1)))
        here = (size > k) & (left > k)
        at = np.flatnonzero(here)
        out[at] = V.mix(out[at] * np.uint64(0x2545F4914F6CDD1D) + part[at + k])
    whole = left >= size
    key, doc = out[whole] >> np.uint64(1), doc[whole]
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[keep], doc[keep]
    return key, np.searchsorted(doc, np.arange(n + 1))


def _classes(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two hashes of each set (rows), 128 bits in all: equal sets, equal class."""
    size = np.diff(first).astype(np.uint64)
    out = []
    for salt, odd in ((77, 1), (1009, 0x9E3779B97F4A7C15)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(V.mix(keys * np.uint64(odd) + np.uint64(salt)))])
        out.append(V.mix((total[first[1:]] - total[first[:-1]]) + size).view(np.int64))
    return np.stack(out)


def _text(docs: DataFrame) -> DataFrame:
    """doc_id, h, text: h is a hash of the text, which finds the texts without doc_id again."""
    text = docs["text"].cast("string")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _summary(docs: DataFrame, words: int) -> DataFrame:
    """Of every row (n not null) its class and size; of shingles frequent somewhere (n null) their count there."""
    names = ["doc_id", "h", "class", "more", "n", "count"]

    def counted(keys: list[np.ndarray]):
        distinct, count = np.unique(np.concatenate(keys), return_counts=True)
        often = count >= COUNTED_FROM
        m = int(often.sum())
        return pa.record_batch([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(distinct[often].view(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(count[often])], names)

    @V.tidy
    def run(batches):
        seen, size = [], 0
        for batch in batches:
            for i, j, data, offsets in V.parts(batch.column(2)):
                keys, first = shingles(data, offsets, words)
                one, two = _classes(keys, first)
                yield pa.record_batch([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(one), pa.array(two), pa.array(np.diff(first)), pa.nulls(j - i, pa.int64())], names)
                seen.append(keys)
                size += len(keys)
                if size >= COUNTED_TOGETHER:
                    yield counted(seen)
                    seen, size = [], 0
        if size:
            yield counted(seen)

    return _text(docs).mapInArrow(run, "doc_id long, h long, class long, more long, n long, count long")


def _ordered(keys: np.ndarray, first: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The sets in the global order: the highest bit marks frequent shingles."""
    if not len(frequent) or not len(keys):
        return keys
    at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
    keys = np.where(frequent[at] == keys, keys | _TOP, keys)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return keys[np.lexsort((keys, doc))]


def _shared(docs: DataFrame, words: int, similarity: tuple[int, int], frequent: np.ndarray) -> DataFrame:
    """shingle, class, n: the first shingles of each set that are also among another set's; n is the set's size.

    Of two sets that overlap in o shingles, the first l of these have at most n - o + l places
    in either set.  So sets that link share at least l of their first n - o + l shingles, where
    o is the least overlap that a link of the set allows and l is n / EXTRA.
    """
    a, b = similarity

    @V.tidy
    def first_ones(batches):
        for batch in batches:
            for _, _, data, offsets in V.parts(batch.column(0)):
                keys, first = shingles(data, offsets, words)
                n = np.diff(first)
                take = np.minimum(n, n - -(-a * n // b) + np.maximum(1, n // EXTRA))
                own = np.repeat(_classes(keys, first)[0], take)
                keys = _ordered(keys, first, frequent)[V.ragged(first[:-1], take)]
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(own), pa.array(np.repeat(n, take))], ["shingle", "class", "n"])

    @V.tidy
    def several(batches):
        """Rows that share a shingle with another class of a size that could link, each class once.

        Rows stand by size, so where two neighbours' sizes are too far apart, no two rows on
        either side can link.  The last row of a batch waits for the next one.
        """
        before = None  # the last row, and whether it is told
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns], 1)
            told = np.zeros(len(rows), bool)
            if before is not None:
                rows, told = np.concatenate([before[0], rows]), np.concatenate([before[1], told])
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1])[:, :2].any(1)
            rows, told = rows[new], told[new]
            same = (rows[1:, 0] == rows[:-1, 0]) & (a * rows[1:, 2] <= b * rows[:-1, 2])
            met = np.zeros(len(rows), bool)
            met[1:] |= same
            met[:-1] |= same
            out = rows[met & ~told]
            before = rows[-1:].copy(), (met | told)[-1:].copy()
            yield pa.record_batch([pa.array(out[:, k]) for k in range(3)], ["shingle", "class", "n"])

    rows = docs.select(docs["text"].cast("string")).mapInArrow(first_ones, "shingle long, class long, n long")
    return rows.repartition("shingle").sortWithinPartitions("shingle", "n", "class").mapInArrow(several, "shingle long, class long, n long")


def _met(shared: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """hub, hub_n, class, n: classes that share one of their first shingles with the hub, itself among them."""
    a, b = similarity
    least = F.greatest(F.lit(1), F.floor(F.floor((a * F.col("n") + b - 1) / b) / EXTRA))
    enough = shared.groupBy("class", "n").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= least).select("class")

    @V.tidy
    def hubs(batches):
        last, hub = np.zeros((0, 3), np.int64), None  # the row before the batch, and its shingle's hub
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns], 1)
            previous = np.concatenate([last if len(last) else rows[:1] - 1, rows[:-1]])
            new = (rows[:, 0] != previous[:, 0]) | (a * rows[:, 2] > b * previous[:, 2])
            if not len(last):
                new[0] = True
            again = ~new & (rows[:, 1] == previous[:, 1])
            last = rows[-1:].copy()
            rows, new = rows[~again], new[~again]
            if not len(rows):
                continue
            head = np.maximum.accumulate(np.where(new, np.arange(len(rows)), -1))
            owner = rows[np.maximum(head, 0)][:, 1:]
            if hub is not None and (head < 0).any():
                owner[head < 0] = hub
            member = head != np.arange(len(rows))
            member &= owner[:, 0] != rows[:, 1]
            mine = owner[member]
            out = np.unique(np.concatenate([np.concatenate([mine, rows[member, 1:]], 1), np.concatenate([mine, mine], 1)]), axis=0)
            hub = owner[-1].copy()
            yield pa.record_batch([pa.array(out[:, k]) for k in range(4)], ["hub", "hub_n", "class", "n"])

    rows = shared.join(enough, "class", "left_semi").select("shingle", "class", "n")
    return rows.repartition("shingle").sortWithinPartitions("shingle", "n", "class").mapInArrow(hubs, "hub long, hub_n long, class long, n long").distinct()


def _gathered(met: DataFrame) -> DataFrame:
    """hub, class: whole groups moved to the least hub that their hub belongs to, so that one set is in few groups."""
    for _ in range(GATHERED):
        least = met.groupBy("class").agg(F.min(F.struct(F.col("hub_n").alias("n"), F.col("hub").alias("to"))).alias("l")).select(F.col("class").alias("hub"), F.col("l.n").alias("to_n"), F.col("l.to").alias("to"))
        met = met.drop("hub_n").join(least, "hub").select(F.col("to").alias("hub"), F.col("to_n").alias("hub_n"), "class", "n").distinct()
    return met.select("hub", "class")


class Trie:
    """Sets of ranks in lexicographic order; a node is a range of sets that share a prefix."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].tolist())
        self.sizes = np.array([len(sets[k]) for k in self.order], np.int64)
        self.nodes: dict[tuple[int, int, int], tuple] = {}

    def node(self, lo: int, hi: int, depth: int) -> tuple:
        """(end of the shared path, children, least and greatest size) of the sets lo..hi-1 that agree before depth."""
        key = (lo, hi, depth)
        if key not in self.nodes:
            a, b = self.sets[self.order[lo]], self.sets[self.order[hi - 1]]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:m] != b[depth:m])
            end = depth + int(differ[0]) if len(differ) else m
            children, at = [], lo
            while at < hi:
                s = self.sets[self.order[at]]
                if len(s) == end:
                    stop = at + 1
                    while stop < hi and len(self.sets[self.order[stop]]) == end:
                        stop += 1
                    children.append((at, stop, -1))
                else:
                    stop, high = at + 1, hi  # the sets that go on with the same shingle
                    while stop < high:
                        mid = (stop + high) // 2
                        if self.sets[self.order[mid]][end] == s[end]:
                            stop = mid + 1
                        else:
                            high = mid
                    children.append((at, stop, end))
                at = stop
            self.nodes[key] = end, children, int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max())
        return self.nodes[key]

    def links(self, probe: np.ndarray, universe: int, similarity: tuple[int, int], skip) -> list[int]:
        """Places in order of the sets that link with the probe; skip(lo, hi) tells ranges that need no look."""
        a, b = similarity
        need = lambda size: -(-a * (len(probe) + size) // (a + b))  # noqa: E731  least intersection
        inside = np.zeros(universe, bool)
        inside[probe] = True
        found: list[int] = []
        stack = [(0, len(self.order), 0, 0)]
        while stack:
            lo, hi, depth, overlap = stack.pop()
            if skip(lo, hi):
                continue
            if hi - lo == 1:
                s = self.sets[self.order[lo]]
                if overlap + np.count_nonzero(inside[s[depth:]]) >= need(len(s)):
                    found.append(lo)
                continue
            end, children, least, most = self.node(lo, hi, depth)
            path = self.sets[self.order[lo]][depth:end]
            overlap += int(np.count_nonzero(inside[path]))
            rest = len(probe) - int(np.searchsorted(probe, path[-1], "right")) if len(path) else len(probe) - (int(np.searchsorted(probe, self.sets[self.order[lo]][depth - 1], "right")) if depth else 0)
            best = min(max(end + rest, least), most)
            if overlap + min(best - end, rest) < need(best):
                continue
            for x, y, d in children:
                if d >= 0:
                    stack.append((x, y, d, overlap))
                elif overlap >= need(end):
                    found.extend(range(x, y))
        return found


def trie_links(sets: list[np.ndarray], similarity: tuple[int, int], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links among the sets (of shingles in ascending order) that connect whatever any links connect.

    With side, links within one side are not sought.  A set is not compared with those it is
    connected to already.
    """
    if len(sets) < 2:
        return []
    tokens, flat = np.unique(np.concatenate(sets), return_inverse=True)
    edges = np.cumsum([0, *(len(s) for s in sets)])
    ranked = [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]
    trie = Trie(ranked)
    component = np.arange(len(sets))  # by place in trie order
    sides = None if side is None else side[trie.order]
    out = []
    for place, k in enumerate(trie.order):
        def skip(lo, hi):
            if hi <= place:
                return True
            same = component[lo:hi] == component[place]
            return bool(same.all() if sides is None else (same | (sides[lo:hi] == sides[place])).all())

        for other in trie.links(ranked[k], len(tokens), similarity, skip):
            if component[other] != component[place] and (sides is None or sides[other] != sides[place]):
                out.append((k, trie.order[other]))
                component[component == component[other]] = component[place]
    return out


def _sets(docs: DataFrame, wanted: DataFrame, words: int, frequent: np.ndarray) -> DataFrame:
    """class, more, shingles (binary): the sets of the wanted classes; wanted has class, more and the doc_id and h of a row."""

    @V.tidy
    def run(batches):
        for batch in batches:
            asked = np.stack([batch.column(k).to_numpy() for k in (0, 1)])
            for i, j, data, offsets in V.parts(pa.array(V.unpacked(batch.column(2)), pa.binary())):
                keys, first = shingles(data, offsets, words)
                own = _classes(keys, first)
                keys = _ordered(keys, first, frequent)
                raw, at = keys.astype("<u8").tobytes(), (8 * first).tolist()
                right = np.flatnonzero((own == asked[:, i:j]).all(0)).tolist()
                yield pa.record_batch([pa.array(own[0, right]), pa.array(own[1, right]), pa.array([raw[at[k] : at[k + 1]] for k in right], pa.binary())], ["class", "more", "shingles"])

    @V.tidy
    def pack(batches):
        for batch in batches:
            yield pa.record_batch([*batch.columns[:2], V.packed(batch.column(2))], ["key", "h", "text"])

    packed = _text(docs).select(F.coalesce("doc_id", "h").alias("key"), "h", "text").mapInArrow(pack, "key long, h long, text binary")
    asked = wanted.select(F.coalesce("doc_id", "h").alias("key"), "h", "class", "more")
    return packed.join(asked, ["key", "h"]).select("class", "more", "text").mapInArrow(run, "class long, more long, shingles binary").dropDuplicates(["class", "more"])


def _linked(met: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """a, b: sets (class:more) that link, enough of them to connect whatever links connect.

    A hub of many sets has them in blocks, each with the hub's set.  Sets that a block connects
    with the hub are connected with each other; the others (loose) then meet every other block.
    """
    schema = "a string, b string, hub long, class long, more long, block int"
    names = ["a", "b", "hub", "class", "more", "block"]

    def groups(batches):
        """Lists of the rows with equal first three columns; a list may span batches."""
        rows = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and r[:3] != rows[-1][:3]:
                    yield rows
                    rows = []
                rows.append(r)
        if rows:
            yield rows

    def told(out):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()])], names)

    name = lambda r: f"{r[3]}:{r[4]}"

    @V.tidy
    def within(batches):
        """Rows: hub, block, whether the hub has several, class, more, shingles."""
        for rows in groups(batches):
            found = trie_links([np.frombuffer(r[5], "<u8") for r in rows], similarity)
            out = [(name(rows[a]), name(rows[b]), None, None, None, None) for a, b in found]
            if rows[0][2]:
                near, edges = {k for k, r in enumerate(rows) if r[3] == r[0]}, [(a, b) for a, b in found]
                grown = True
                while grown:
                    grown = False
                    for a, b in edges:
                        if (a in near) != (b in near):
                            near |= {a, b}
                            grown = True
                out += [(None, None, r[0], r[3], r[4], r[1]) for k, r in enumerate(rows) if k not in near]
            if out:
                yield told(out)

    @V.tidy
    def between(batches):
        """Rows: hub, x, y, class, more, shingles, block: the loose sets of block x and all sets of y."""
        for rows in groups(batches):
            side = np.array([r[6] != r[1] for r in rows])
            if out := [(name(rows[a]), name(rows[b]), None, None, None, None) for a, b in trie_links([np.frombuffer(r[5], "<u8") for r in rows], similarity, side)]:
                yield told(out)

    blocks = checkpoint(met.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1"))
    few = blocks.limit(BROADCAST_HUBS + 1).count() <= BROADCAST_HUBS
    full = met.join(F.broadcast(blocks) if few else blocks, "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # a hot hub's sets stay where they are
    full = full.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    own = F.when((F.col("class") == F.col("hub")) & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    dealt = full.select("hub", F.explode(own).alias("block"), (F.col("blocks") > 1).alias("several"), "class").join(sets, "class").select("hub", "block", "several", "class", "more", "shingles")
    first = checkpoint(dealt.repartition("hub", "block").sortWithinPartitions("hub", "block").mapInArrow(within, schema))
    links = first.where("hub IS NULL").select("a", "b")
    loose = first.where("hub IS NOT NULL")
    if not loose.limit(1).count():
        return links
    from_x = loose.select("hub", F.col("block").alias("x"), "class", "more").distinct()
    others = full.where("blocks > 1").select("hub", F.col("block").alias("y")).distinct()
    pairs = from_x.select("hub", "x").distinct().join(others, "hub").where("x <> y")
    probes = from_x.join(pairs, ["hub", "x"]).select("hub", "x", "y", "class", "more", F.col("x").alias("block"))
    there = pairs.join(full.where("blocks > 1").withColumnRenamed("block", "y"), ["hub", "y"]).join(sets.select("class", "more"), "class").select("hub", "x", "y", "class", "more", F.col("y").alias("block"))
    both = probes.unionByName(there).join(sets, ["class", "more"]).select("hub", "x", "y", "class", "more", "shingles", "block")
    second = both.repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y").mapInArrow(between, schema).select("a", "b")
    return links.unionByName(second)


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node) of every node with an edge (a, b); alternating star contractions."""
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        # large star: every neighbour above a node moves to the node's least neighbour
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every neighbour below a node, and the node, move to its least neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = checkpoint(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        if not small.exceptAll(edges).limit(1).count() and not edges.exceptAll(small).limit(1).count():
            return small.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(small.select(F.col("b"), F.col("b")).distinct())
        edges = small


def _node():
    return F.concat_ws(":", "class", "more")


def _joined(docs: DataFrame, words: int, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, class, more, n of every row; node, component, component_id of every set with shingles)."""
    summary = checkpoint(_summary(docs, words))
    own = summary.where("n IS NOT NULL").select("doc_id", "h", "class", "more", "n")
    often = summary.where("n IS NULL").groupBy("class").agg(F.sum("count").alias("count")).where(F.col("count") >= FREQUENT_FROM).orderBy(F.desc("count"), "class").limit(FREQUENT).collect()
    frequent = np.sort(np.array([r["class"] for r in often], np.int64).view(np.uint64))
    some = own.where("n > 0")
    first = checkpoint(some.groupBy("class", "more").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("r")).select("class", "more", "r.doc_id", "r.h"))
    met = checkpoint(_gathered(_met(checkpoint(_shared(docs, words, similarity, frequent)), similarity)))
    wanted = met.select("class").distinct().join(first, "class")
    sets = checkpoint(_sets(docs, wanted, words, frequent))
    links = _linked(met, sets, similarity)
    named = some.where("doc_id IS NOT NULL").select("doc_id", _node().alias("node"))
    several = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")  # several texts of one doc_id
    found = components(links.unionByName(named.join(several, "doc_id").select("a", F.col("node").alias("b"))))
    nodes = first.select(_node().alias("node"), "doc_id").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "doc_id")
    least = nodes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return own, nodes.select("node", "component").join(least, "component")


def component_ids(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) of every row.

    Equal sets link.  Documents without words, null and empty texts among them, have no
    shingle and stay alone.  Rows without doc_id link like others; where nothing they reach has
    a doc_id, their component is null.  Rows that share a doc_id are one document whose links
    are those of all its texts.
    """
    own, nodes = _joined(docs, words, similarity)
    salted = nodes.select("node", "component_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = own.where("n > 0").select("doc_id", "n", _node().alias("node"), F.pmod(F.coalesce(F.xxhash64("doc_id"), F.floor(F.rand(5) * SALTS)), F.lit(SALTS)).cast("int").alias("salt"))
    with_words = named.join(salted, ["node", "salt"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return with_words.unionByName(alone)


def keep_one(docs: DataFrame, words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Of each component the document of least id, with all columns.

    Of rows that share this id one stays, that whose text has the least hash.  A component in
    which nothing has an id keeps one row; rows without id and without words all stay.
    """
    own, nodes = _joined(docs, words, similarity)
    keys = ["_given", "_key", "_h"]
    named = own.where("n > 0").select("doc_id", "h", _node().alias("node")).distinct()
    placed = named.join(nodes, "node")
    by_id = placed.where("doc_id = component_id").select("doc_id", "h").unionByName(own.where("n = 0 AND doc_id IS NOT NULL").join(placed.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "h"))
    by_id = by_id.groupBy("doc_id").agg(F.min("h").alias("_h")).select(F.lit(True).alias("_given"), F.col("doc_id").alias("_key"), "_h")
    without = placed.where("component_id IS NULL").groupBy("component").agg(F.min("h").alias("_h")).select(F.lit(False).alias("_given"), F.lit(0).cast("long").alias("_key"), "_h")
    ident, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    columns = {c: f"d{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*(docs[c].alias(n) for c, n in columns.items()), ident.isNotNull().alias("_given"), F.coalesce(ident, F.lit(0).cast("long")).alias("_key"), F.xxhash64(text).alias("_h"), (ident.isNull() & ~F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]")).alias("_bare"))
    back = [F.col(n).alias(c) for c, n in columns.items()]
    kept = rows.join(by_id.unionByName(without), keys, "left_semi").dropDuplicates(keys).select(*back)
    return kept.unionByName(rows.where("_bare").select(*back))
