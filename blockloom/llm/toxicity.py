"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its first 4, 5 and 6
bytes, so inflected forms share what they have in common.  Filters of several widths slide
over the words, the maximum over the whole text goes into a logistic layer.  The threshold is
calibrated for each language, guessed from the text alone, and moved to a score of 0.5.  The
fitted numbers are whole multiples of 1/GRAIN, so sums are exact and a text's score does not
depend on the texts beside it.

Every labelled document outside fold 0 is learned from, where it lies: documents are dealt into
shards by their id, in each epoch every shard goes on from the common parameters by its own
steps, and each row of parameters moves by the mean over the steps that touched it.  What shards
tell is whole numbers, summed by blocks of rows, so their order does not matter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import textvec as V
from blockloom.llm.session import checkpoint, let_go

WIDTHS = (1, 2, 3)
FILTERS = 8
DIM = 16
BUCKETS = 1 << 15
PREFIXES = (0, 4, 5, 6)  # 0: the whole word
EPOCHS, RATE = 5, 0.05
#: Labelled documents of a shard, about; there are as many shards as that takes.
SHARD = 4096
#: Documents of a step, fewer where their texts have more bytes.
STEP, STEP_BYTES = 32, 1 << 20
#: Rows of parameters or counts that are summed together; shards tell moves in 1/MOVE and squares in 1/SQUARE.
BLOCK, MOVE, SQUARE = 512, 1 << 20, 1 << 24
#: Calibration counts logits in bins of 1/BINS up to LIMIT on either side.
BINS, LIMIT = 256, 64
#: Labelled ids are marked in so many bits, by hash, to leave other texts out of the shuffle.
MARKS = 1 << 24
#: Parameters are multiples of 1/GRAIN; every sum of products of two or three of them is exact in 53 bits.
GRAIN = 1024
#: Documents are learned from if crc32(id) mod FOLDS is not 0; those where it is 1 calibrate.
FOLDS = 5
#: Frequent words that tell a text's language.
FREQUENT = {
    "en": "the and of to in is that with for was on are this it from be by or as an",
    "de": "der die und das ist nicht ein eine dem den von mit für auf als im zu sich auch des",
    "fr": "le la les et des est une un du dans pour qui que sur par pas avec au elle en",
    "es": "el los las que y es una un por con para del se al lo como su más no de",
}
LANGUAGES = tuple(FREQUENT)


@dataclass
class Model:
    table: np.ndarray  # (features, buckets, DIM); when fitted, int16 in units of 1/GRAIN
    filters: list[np.ndarray]  # of each width: (width, DIM, FILTERS)
    bias: np.ndarray
    weights: np.ndarray
    intercept: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES) + 1))


@dataclass
class Text:
    """Words of several documents: buckets of each distinct word, the words in order, where documents begin."""

    buckets: np.ndarray
    word: np.ndarray
    first: np.ndarray
    language: np.ndarray


def _frequent() -> np.ndarray:
    out = np.zeros((0, 2), np.uint64)
    for k, name in enumerate(LANGUAGES):
        raw = [w.encode() for w in FREQUENT[name].split()]
        data, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(w) for w in raw])
        ends = np.cumsum(sizes)
        keys = V.hashes(V.lanes(data), data, ends - sizes, ends)
        out = np.vstack([out, np.stack([keys, np.full(len(keys), k, np.uint64)], 1)])
    return out[np.argsort(out[:, 0])]


def read(data: np.ndarray, offsets: np.ndarray) -> Text:
    data = V.lower(data)
    starts, ends, first = V.words(data, offsets)
    lane = V.lanes(data)
    keys = V.hashes(lane, data, starts, ends)
    distinct, at, word = np.unique(keys, return_index=True, return_inverse=True)
    s, e = starts[at], ends[at]
    cut = [distinct if not n else V.hashes(lane, data, s, np.minimum(s + n, e)) for n in PREFIXES]
    buckets = np.stack([(k >> np.uint64(7 * n)).astype(np.int64) & BUCKETS - 1 for n, k in enumerate(cut)])
    known = _frequent()
    spot = np.minimum(np.searchsorted(known[:, 0], distinct), len(known) - 1)
    kind = np.where(known[spot, 0] == distinct, known[spot, 1].astype(np.int64), -1)[word]
    hits = np.stack([np.concatenate([[0], np.cumsum(kind == k)]) for k in range(len(LANGUAGES))])
    counts = hits[:, first[1:]] - hits[:, first[:-1]]
    language = np.where(counts.max(0) > 0, counts.argmax(0), len(LANGUAGES)) if counts.size else np.zeros(0, np.int64)
    return Text(buckets, word, first, language)


def embedded(model: Model, buckets: np.ndarray) -> np.ndarray:
    """(words, DIM): the sum of each word's embeddings; buckets has a row for each feature."""
    if model.table.dtype != np.int16:
        return sum(model.table[k][b] for k, b in enumerate(buckets))
    return sum(model.table[k][b].astype(np.int32) for k, b in enumerate(buckets)) / GRAIN


def fixed(model: Model) -> Model:
    """The model in whole multiples of 1/GRAIN."""
    near = lambda x: np.clip(np.rint(np.asarray(x, np.float64) * GRAIN), -(2**15), 2**15 - 1)
    return Model(near(model.table).astype(np.int16), [near(f) / GRAIN for f in model.filters], near(model.bias) / GRAIN, near(model.weights) / GRAIN, float(near(model.intercept)) / GRAIN, model.thresholds)


def pooled(model: Model, text: Text, where: bool = False):
    """(documents, filters) maxima, and with `where` the word at which each stands."""
    n, parts, at = len(text.first) - 1, [], []
    if not len(text.word):
        zero = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        return (zero, zero.astype(np.int64) - 1) if where else zero
    distinct = embedded(model, text.buckets)
    doc = np.repeat(np.arange(n), np.diff(text.first))
    some = np.flatnonzero(np.diff(text.first))
    left = text.first[1:][doc] - np.arange(len(text.word))
    for width, filters in zip(WIDTHS, model.filters):
        response = (distinct @ filters[0])[text.word]
        for k in range(1, width):
            more = (distinct @ filters[k])[text.word[k:]]
            more[left[: len(more)] <= k] = 0  # beyond the text stands nothing
            response[: len(more)] += more
        best = np.zeros((n, FILTERS), response.dtype)
        best[some] = np.maximum.reduceat(response, text.first[:-1][some], axis=0)
        parts.append(best)
        if where:
            place = np.full((n, FILTERS), -1, np.int64)
            for f in range(FILTERS):
                r, c = np.nonzero(response[:, f : f + 1] == best[doc, f : f + 1])
                place[doc[r[::-1]], f] = r[::-1]
            at.append(place)
    top = np.concatenate(parts, 1)
    return (top, np.concatenate(at, 1)) if where else top


def logits(model: Model, text: Text) -> np.ndarray:
    return np.maximum(pooled(model, text) + model.bias, 0) @ model.weights + model.intercept


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    text = read(data, offsets)
    z = logits(model, text) - model.thresholds[text.language]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def viewed(flat: np.ndarray) -> Model:
    """The model whose numbers stand in the rows of flat: DIM each, the table's first."""
    n = len(PREFIXES) * BUCKETS
    rest, at, filters = flat[n:].reshape(-1), 0, []
    for w in WIDTHS:
        filters.append(rest[at : at + w * DIM * FILTERS].reshape(w, DIM, FILTERS))
        at += w * DIM * FILTERS
    m = len(WIDTHS) * FILTERS
    return Model(flat[:n].reshape(len(PREFIXES), BUCKETS, DIM), filters, rest[at : at + m], rest[at + m : at + 2 * m], rest[at + 2 * m : at + 2 * m + 1].reshape(()))


def flat_rows() -> int:
    small = sum(WIDTHS) * DIM * FILTERS + 2 * len(WIDTHS) * FILTERS + 1
    return len(PREFIXES) * BUCKETS + -(-small // DIM)


def counted(steps) -> np.ndarray:
    """(features * buckets + 1, 2): of each class the documents with each bucket, last of all the documents."""
    out = np.zeros((len(PREFIXES) * BUCKETS + 1, 2), np.int64)
    for text, y in steps:
        doc = np.repeat(np.arange(len(y)), np.diff(text.first))
        for k, b in enumerate(text.buckets):
            pairs = np.unique(doc * BUCKETS + b[text.word])
            np.add.at(out, (k * BUCKETS + pairs % BUCKETS, y[pairs // BUCKETS]), 1)
        out[-1] += np.bincount(y, minlength=2)
    return out


def _start(counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Embeddings begin at how far each bucket's documents lean to the label; the rest is small and random."""
    flat = np.zeros((flat_rows(), DIM), np.float32)
    model = viewed(flat)
    for table in model.table:
        table[:] = rng.normal(0, 0.05, table.shape)
    hit, total = counts[:-1].reshape(len(PREFIXES), BUCKETS, 2), counts[-1]
    p = (hit + 0.5) / (total + 1)
    lean = np.log(p[..., 1] / p[..., 0]) / np.sqrt(1 / (hit[..., 1] + 0.5) + 1 / (hit[..., 0] + 0.5))
    for k in range(len(PREFIXES)):
        model.table[k, :, k] = np.clip(lean[k] / 4, -1.5, 1.5)
    for f in model.filters:
        f[:] = rng.normal(0, 0.1, f.shape)
        for k in range(len(f)):
            f[k, : len(PREFIXES)] += np.abs(rng.normal(0.5, 0.3, (len(PREFIXES), FILTERS))) / len(f)
    model.bias[:], model.weights[:], model.intercept[...] = -0.5, 0.3, -1.0
    return flat


@dataclass
class Gradient:
    table: list[tuple[np.ndarray, np.ndarray]]  # of each feature: buckets, their gradients
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    intercept: float


def loss(model: Model, text: Text, y: np.ndarray, weight: np.ndarray) -> float:
    z = logits(model, text)
    return float((weight * np.logaddexp(0, np.where(y == 1, -z, z))).mean() + 0.5e-4 * (model.weights**2).sum())


def gradient(model: Model, text: Text, y: np.ndarray, weight: np.ndarray) -> Gradient:
    """Of loss(): through the logistic layer, the greatest responses and the filters to the embeddings."""
    top, place = pooled(model, text, True)
    hidden = np.maximum(top + model.bias, 0)
    z = hidden @ model.weights + model.intercept
    error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)).astype(model.weights.dtype)
    g_hidden = np.outer(error, model.weights) * (hidden > 0)
    g_filters, words, pushes = [], [], []
    for k, width in enumerate(WIDTHS):
        mine = slice(k * FILTERS, (k + 1) * FILTERS)
        g, at = g_hidden[:, mine], place[:, mine]
        d, f = np.nonzero((g != 0) & (at >= 0))
        g_filter = np.zeros_like(model.filters[k])
        for o in range(width):
            here = at[d, f] + o
            inside = here < text.first[1:][d]
            ff, value = f[inside], g[d[inside], f[inside]]
            word = text.buckets[:, text.word[here[inside]]]
            np.add.at(g_filter[o].T, ff, embedded(model, word) * value[:, None])
            words.append(word)
            pushes.append(model.filters[k][o].T[ff] * value[:, None])
        g_filters.append(g_filter)
    word, push = np.concatenate(words, 1), np.concatenate(pushes)
    table = []
    for q in range(len(PREFIXES)):
        rows, back = np.unique(word[q], return_inverse=True)
        total = np.zeros((len(rows), DIM), push.dtype)
        np.add.at(total, back, push)
        table.append((rows, total))
    return Gradient(table, g_filters, g_hidden.sum(0), hidden.T @ error + 1e-4 * model.weights, float(error.sum()))


def steps_of(rows):
    """(text, labels) of each step's documents; rows has each document's label and bytes, in order."""
    y, raw, size = [], [], 0

    def step():
        return read(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)), np.array(y, np.int64)

    for label, text in rows:
        if y and (len(y) == STEP or size + len(text) > STEP_BYTES):
            yield step()
            y, raw, size = [], [], 0
        y.append(label)
        raw.append(text)
        size += len(text)
    if y:
        yield step()


def moved(flat: np.ndarray, squares: np.ndarray, steps, rate: float, balance: np.ndarray) -> np.ndarray:
    """Goes down the gradient in place, once over the steps; how many of them touched each row."""
    model, sums, touched = viewed(flat), viewed(squares), np.zeros(len(flat), np.int64)
    for text, y in steps:
        g = gradient(model, text, y, 1 / (2 * balance[y]))
        for q, (rows, total) in enumerate(g.table):
            sums.table[q][rows] += total * total
            model.table[q][rows] -= rate * total / np.sqrt(sums.table[q][rows])
            touched[q * BUCKETS + rows] += 1
        for f, s, total in [*zip(model.filters, sums.filters, g.filters), (model.bias, sums.bias, g.bias), (model.weights, sums.weights, g.weights), (model.intercept, sums.intercept, g.intercept)]:
            s += total * total
            f -= rate * total / np.sqrt(s)
        touched[len(PREFIXES) * BUCKETS :] += 1
    return touched


def binned(model: Model, steps) -> np.ndarray:
    """(languages * bins, 2): of each class the documents by language and logit."""
    bins = 2 * BINS * LIMIT + 1
    out = np.zeros(((len(LANGUAGES) + 1) * bins, 2), np.int64)
    for text, y in steps:
        z = np.rint(np.clip(logits(model, text), -LIMIT, LIMIT) * BINS).astype(np.int64) + BINS * LIMIT
        np.add.at(out, (text.language * bins + z, y), 1)
    return out


def calibrated(model: Model, counts: np.ndarray) -> Model:
    """The model with the thresholds that binned() counts give."""
    counts = counts.reshape(len(LANGUAGES) + 1, -1, 2)
    everywhere = best_threshold(counts.sum(0), 0.0)
    model.thresholds[:] = everywhere
    for k in range(len(LANGUAGES)):
        if counts[k].sum(0).min() >= 10:
            model.thresholds[k] = best_threshold(counts[k], everywhere)
    return model


def best_threshold(counts: np.ndarray, default: float) -> float:
    """The middle of the cuts of least error: the share of toxic texts missed and twice that of clean ones accused.

    counts has the documents of both classes by bins of logits.
    """
    at = np.flatnonzero(counts.sum(1))
    clean, toxic = counts.sum(0)
    if not clean or not toxic:
        return default
    below = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(counts[at], 0)])
    error = below[:, 1] * clean + 2 * (clean - below[:, 0]) * toxic  # times clean * toxic, whole numbers
    z = (at - BINS * LIMIT) / BINS
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    middle = edges[error == error.min()].mean()
    return float((np.floor(middle * BINS) + 0.5) / BINS)  # between two bins


def shares(counts: np.ndarray) -> np.ndarray:
    return np.clip(counts[-1] / max(1, counts[-1].sum()), 0.05, 1)


def train(texts: list[bytes], labels: np.ndarray, ids_fold: np.ndarray, seed: int = 7) -> Model:
    """fit() of a single shard that stands here: fitted on the texts whose fold is not 1; these calibrate the thresholds."""
    rng = np.random.default_rng(seed)
    fit = rng.permutation(np.flatnonzero(ids_fold != 1))
    steps = lambda index: steps_of((labels[i], texts[i]) for i in index)
    counts = counted(steps(fit))
    flat = _start(counts, rng)
    squares = np.full_like(flat, 0.05)
    for epoch in range(EPOCHS):
        moved(flat, squares, steps(fit), RATE * (1 - epoch / EPOCHS), shares(counts))
    model = fixed(viewed(flat))
    return calibrated(model, binned(model, steps(np.flatnonzero(ids_fold == 1))))


def fold(column):
    """crc32 of the id as text, modulo FOLDS; a null id counts as fold 2."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(2)).cast("int")


def training(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """y, fold, text (packed) of every labelled document outside fold 0, written in shards by doc_id.

    Labels of 0 or 1 count; several labels of one document count as their largest, of rows that
    share a doc_id the least text counts.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")
    shards = max(1, -(-known.count() // SHARD))
    spot = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(MARKS))
    marks = known.groupBy(F.bitmap_bucket_number(spot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("_bits"))  # MARKS bits at most
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.bitmap_bucket_number(spot).alias("_bucket"), F.bitmap_bit_position(spot).alias("_bit"))
    rows = rows.where(F.col("doc_id").isNotNull()).join(F.broadcast(marks), "_bucket").where("shiftright(cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int), cast(_bit % 8 as int)) & 1 = 1")
    rows = rows.select("doc_id", F.coalesce("text", F.lit(b"")).alias("text"), F.lit(None).cast("int").alias("y")).unionByName(known.select("doc_id", F.lit(None).cast("binary").alias("text"), "y"))
    rows = rows.repartition(shards, "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text")).where("y IS NOT NULL AND text IS NOT NULL").withColumn("fold", fold(F.col("doc_id")))
    rows = rows.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("y", "fold", "text")

    @V.tidy
    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), V.packed(batch.column(2))], ["y", "fold", "text"])

    return checkpoint(rows.mapInArrow(run, "y int, fold int, text binary"))


def told(counts: np.ndarray, rows: np.ndarray, weights: np.ndarray):
    """Record batches for summed(): the values of these rows and what each of them weighs."""
    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows // BLOCK)) + 1):
        if len(part):
            r = rows[part]
            cells = [(r % BLOCK).astype("<u2"), weights[part].astype("<i4"), counts[part].astype("<i4")]
            yield pa.record_batch([pa.array([int(r[0] // BLOCK)], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], ["block", "rows", "weights", "counts"])


def summed(shards: DataFrame, work, size: int, width: int, mean: bool = False) -> np.ndarray:
    """(size, width): sums over the shards, or with `mean` weighted means, of what work(rows of a shard) tells of each row."""

    @V.tidy
    def tell(batches):
        back = zstandard.ZstdDecompressor().decompress
        yield from told(*work((y, back(t)) for b in batches for y, t in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)))))

    @V.tidy
    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, rows, weights, values in zip(*(c.to_pylist() for c in batch.columns)):
                total = totals.setdefault(block, np.zeros((BLOCK, 1 + width), np.int64))
                at, w = np.frombuffer(rows, "<u2"), np.frombuffer(weights, "<i4").astype(np.int64)
                total[at, 0] += w
                total[at, 1:] += w[:, None] * np.frombuffer(values, "<i4").reshape(-1, width)
        for block, total in totals.items():
            at = np.flatnonzero(total[:, 0])
            out = np.rint(total[at, 1:] / total[at, :1]).astype("<i4") if mean else total[at, 1:]
            yield pa.record_batch([pa.array([block], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary())], ["block", "rows", "total"])

    out = np.zeros((size, width), np.int32 if mean else np.int64)
    sums = shards.select("y", "text").mapInArrow(tell, "block int, rows binary, weights binary, counts binary").repartition("block").mapInArrow(add, "block int, rows binary, total binary")
    for r in sums.collect():  # size rows of width numbers at most
        out[r.block * BLOCK + np.frombuffer(r.rows, "<u2").astype(np.int64)] = np.frombuffer(r.total, out.dtype).reshape(-1, width)
    let_go(sums)
    V.trim()
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", seed: int = 7) -> Model:
    """A model of `label`, learned from every labelled document outside fold 0; those of fold 1 calibrate it.

    Without labelled documents the model gives every text the same low score.
    """
    shards = training(docs, labels, label)
    learned, held = shards.where("fold <> 1"), shards.where("fold = 1")

    def all_of(counts: np.ndarray):
        rows = np.flatnonzero(counts.any(1))
        return counts[rows], rows, np.ones(len(rows), np.int64)

    counts = summed(learned, lambda rows: all_of(counted(steps_of(rows))), len(PREFIXES) * BUCKETS + 1, 2)
    balance, context = shares(counts), docs.sparkSession.sparkContext
    flat = _start(counts, np.random.default_rng(seed))
    squares = np.full_like(flat, 0.05)
    size, met = len(flat), np.concatenate([np.flatnonzero(counts[:-1].any(1)), np.arange(len(counts) - 1, len(flat))])  # no step reads other rows
    for epoch in range(EPOCHS if counts[-1].sum() else 0):
        common, rate = context.broadcast((met, flat[met], squares[met])), RATE * (1 - epoch / EPOCHS)

        def work(rows, common=common, rate=rate):
            met, was, more = common.value
            mine, mores = np.zeros((size, DIM), np.float32), np.ones((size, DIM), np.float32)
            mine[met], mores[met] = was, more
            touched = moved(mine, mores, steps_of(rows), rate, balance)[met]
            at = np.flatnonzero(touched)
            whole = lambda x, unit: np.clip(np.rint(x.astype(np.float64) * unit), -(2**31), 2**31 - 1)
            return np.hstack([whole(mine[met[at]] - was[at], MOVE), whole(mores[met[at]] - more[at], SQUARE)]), met[at], touched[at]

        moves = summed(learned, work, size, 2 * DIM, mean=True)
        common.destroy()
        flat[met] += moves[met, :DIM] / np.float32(MOVE)
        squares[met] += moves[met, DIM:] / np.float32(SQUARE)
    model = fixed(viewed(flat))
    return calibrated(model, summed(held, lambda rows: all_of(binned(model, steps_of(rows))), (len(LANGUAGES) + 1) * (2 * BINS * LIMIT + 1), 2))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null texts count as empty, repeated rows are repeated."""

    @V.tidy
    def run(batches):
        for batch in batches:
            for i, j, data, offsets in V.parts(batch.column(2), 1 << 19):
                s = scores(model, data, offsets)
                yield pa.record_batch([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(docs["doc_id"].cast("long"), (fold(docs["doc_id"]) == 0).alias("held_out"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_civil(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose text scores below 0.5, all columns as they are; a null text is judged as empty."""

    place = docs.columns.index("text")

    @V.tidy
    def run(batches):
        for batch in batches:
            for i, j, data, offsets in V.parts(batch.column(place).cast(pa.string()), 1 << 19):
                yield batch.slice(i, j - i).filter(pa.array(scores(model, data, offsets) < 0.5))

    return docs.mapInArrow(run, docs.schema)
