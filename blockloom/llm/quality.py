"""Quality classifier: hierarchical empirical Bayes over documents and the sites they stand on.

A logistic classifier gives each text its evidence, from its words and its shape.  Labelled
outcomes are summed for each host and each path below it; rates shrink from path to host and
from host to the global rate, with strengths fitted to how much the sites really differ.  A
document's posterior combines both: the classifier's log odds moved by its site's.

Documents are dealt into folds by their id.  What judges a document, classifier and rates, has
seen the labels of the other folds only, so a document's own label never vouches for it and the
posteriors of labelled documents measure how good the judgement is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm import textvec as V
from blockloom.llm.session import checkpoint

#: Labelled documents of either class that the classifier is fitted on; of more, those least by hash.
TRAIN_PER_CLASS = 3000
#: Of these, texts of more bytes are not learned from.
TRAIN_BYTES = 64 << 10
#: Folds of documents; each is judged by the labels of the others.
FOLDS = 5
#: Words are told apart by so many buckets in the lexical feature.
BUCKETS = 1 << 14
#: Sites (FOLDS rows each) are broadcast up to this many rows (of about 100 bytes), and joined by salted keys beyond.
BROADCAST_SITES = 50_000
SALTS = 32
#: Words that the driver looks at together as it learns.
WORDS_TOGETHER = 1 << 16
#: A document stays if its posterior is this at least.
KEEP_AT = 0.5
#: Prior strengths stay within these numbers of labels.
STRENGTH = (2.0, 2000.0)

FEATURES = ("log_words", "symbols", "digits", "capitals", "commas_stops", "bars", "short_words", "long_words", "distinct_words", "most_frequent_word", "marked_words", "repeated_lines", "lines_per_word", "word_length")  # and the lexical one
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*@^~=+<>{}[]\\/_", np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
_DIGIT = np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)


def _per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[offsets])


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, features) of whole texts; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    starts, ends, first = V.words(data, offsets)
    words = np.diff(first)
    some = np.maximum(words, 1)
    out = [np.log1p(words)]
    out += [_per_document(t[data], offsets) / size for t in (_SYMBOL, _DIGIT, _UPPER, _STOP)]
    out.append(_per_document(data == 0x7C, offsets) / some)
    length = ends - starts
    out += [_per_document(length <= 2, first) / some, _per_document(length >= 14, first) / some]
    doc = np.repeat(np.arange(n), words)
    low = V.lower(data)
    lane = V.lanes(low)
    key = V.hashes(lane, low, starts, ends) ^ V.mix(doc.astype(np.uint64) + np.uint64(1))
    distinct, at, count = np.unique(key, return_index=True, return_counts=True)
    out.append(np.bincount(doc[at], minlength=n) / some)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc[at], count)
    out.append(most / some)
    last = data[ends - 1] if len(ends) else data[:0]
    out.append(_per_document(_SYMBOL[last], first) / some)
    line = np.flatnonzero(data == 0x0A)
    cut = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], line + 1]))
    cut = cut[cut < len(data)]
    stop = np.append(cut[1:], len(data))
    stop = stop - (data[stop - 1] == 0x0A) if len(cut) else stop
    keep = stop > cut
    cut, stop = cut[keep], stop[keep]
    in_doc = np.searchsorted(offsets, cut, "right") - 1
    lines = np.bincount(in_doc, minlength=n)
    own = np.unique(V.hashes(lane, low, cut, stop) ^ V.mix(in_doc.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    out.append(1 - np.bincount(in_doc[own], minlength=n) / np.maximum(lines, 1) * (lines > 0) - (lines == 0))
    out.append(lines / some)
    out.append(np.minimum(_per_document(length, first) / some, 40) / 10)
    return np.stack(out, 1) if n else np.zeros((0, len(FEATURES)))


def vocabulary(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first of each document): the distinct buckets of each document's words and pairs of neighbouring words."""
    low = V.lower(data)
    starts, ends, first = V.words(low, offsets)
    one = V.hashes(V.lanes(low), low, starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pairs = V.mix(one[1:] + V.mix(one[:-1])) if len(one) else one
    same = doc[1:] == doc[:-1]
    key = np.concatenate([doc, doc[1:][same]]) * BUCKETS + (np.concatenate([one, pairs[same]]) >> np.uint64(40)).astype(np.int64) % BUCKETS
    key = np.unique(key)
    return key % BUCKETS, np.searchsorted(key, np.arange(len(offsets)) * BUCKETS)


@dataclass
class Classifier:
    words: np.ndarray  # of each bucket the log odds of good
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log odds of good of each text, of which the share of good documents is already taken out."""
        buckets, first = vocabulary(data, offsets)
        return self.combined(features(data, offsets), _mean(self.words[buckets], first))

    def combined(self, x: np.ndarray, lexical: np.ndarray) -> np.ndarray:
        return np.clip((expand((np.column_stack([x, lexical]) - self.mean) / self.scale) * self.weights).sum(1), -12, 12)


def _mean(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each document the mean of its values, 0 without any."""
    n = np.diff(first)
    return np.bincount(np.repeat(np.arange(len(n)), n), values, len(n)) / np.maximum(n, 1)


def expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.concatenate([np.ones((len(z), 1)), z, z * z / 4], 1)


def train(x: np.ndarray, buckets: np.ndarray, first: np.ndarray, y: np.ndarray) -> Classifier:
    """Ridge logistic regression by Newton steps, both classes weighing the same.

    x has the shapes, buckets and first the words of the texts.  The lexical feature of a text
    is the mean log odds of its words, counted without the text itself.
    """
    d = len(FEATURES) + 1
    if len(np.unique(y)) < 2:
        return Classifier(np.zeros(BUCKETS), np.zeros(d), np.ones(d), np.zeros(1 + 2 * d))
    hits, totals, lexical = np.zeros((2, BUCKETS)), np.bincount(y, minlength=2), np.zeros(len(y))
    odds = lambda good, bad, n_good, n_bad: np.log((good + 1) / (n_good + 2)) - np.log((bad + 1) / (n_bad + 2))

    def parts():  # of all words at once the driver would hold eight arrays
        for i, j in V.chunks(first, WORDS_TOGETHER):
            yield i, j, buckets[first[i] : first[j]].astype(np.int64), y[np.repeat(np.arange(i, j), np.diff(first[i : j + 1]))]

    for _, _, b, own in parts():
        hits += [np.bincount(b[own == k], minlength=BUCKETS) for k in (0, 1)]
    for i, j, b, own in parts():
        alone = odds(hits[1][b] - own, hits[0][b] - (1 - own), totals[1] - own, totals[0] - (1 - own))
        lexical[i:j] = _mean(alone, first[i : j + 1] - first[i])
    x = np.column_stack([x, lexical])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    a = expand((x - mean) / scale)
    w = np.zeros(a.shape[1])
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(len(w))
        step = np.linalg.solve(hessian, a.T @ (weight * (y - p)) - 0.5 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(odds(hits[1], hits[0], *totals[::-1]), mean, scale, w)


def fold(column: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id, which has no label, counts as fold 0."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0)).cast("int")


def outcomes(labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, y: labels of 0 or 1; several labels of one document count as their least."""
    return labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> list[Classifier]:
    """For each fold the classifier of the other folds, from at most per_class labelled documents of either class in all.

    Of rows that share a doc_id the least text counts.
    """
    known = outcomes(labels)
    pick = [known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(pick[0].unionAll(pick[1])), "doc_id")
    sample = sample.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES).groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in V.parts(batch.column(2)):
                buckets, first = vocabulary(data, offsets)
                small, at = buckets.astype("<u2").tobytes(), (2 * first).tolist()
                yield pa.record_batch([*(batch.column(k)[i:j] for k in range(2)), pa.array([x.tobytes() for x in features(data, offsets)], pa.binary()), pa.array([small[a:b] for a, b in zip(at, at[1:])], pa.binary())], ["fold", "y", "x", "words"])

    rows = sample.select(fold(F.col("doc_id")), "y", "text").mapInArrow(run, "fold int, y int, x binary, words binary").collect()  # 2 * per_class rows of at most 2 * BUCKETS bytes
    rows.sort(key=lambda r: (r.y, r.x, r.words))
    models = [_trained([r for r in rows if r.fold != k]) for k in range(FOLDS)]
    rows.clear()
    V.trim()
    return models


def _trained(rows: list) -> Classifier:
    first = np.cumsum([0, *(len(r.words) // 2 for r in rows)])
    words = np.frombuffer(b"".join(r.words for r in rows), "<u2")
    x = np.frombuffer(b"".join(r.x for r in rows), np.float64).reshape(-1, len(FEATURES))
    return train(x, words, first, np.array([r.y for r in rows], np.int64))


def strength(groups: DataFrame, rate: Column) -> float:
    """How many labels a prior is worth, by the moments of the groups' rates around `rate`.

    groups has n and good.  The spread between groups beyond what chance gives is the priors'
    variance; none gives the upper limit.
    """
    p = F.least(F.greatest(rate, F.lit(0.001)), F.lit(0.999))
    r = groups.where("n > 0").agg(F.sum("n").alias("n"), F.sum(F.pow(F.col("good") - F.col("n") * p, 2) - F.col("n") * p * (1 - p)).alias("beyond"), F.sum(F.col("n") * (F.col("n") - 1) * p * (1 - p)).alias("scale")).first()
    if not r["n"] or not r["scale"] or r["beyond"] <= 0:
        return STRENGTH[1]
    correlation = min(max(r["beyond"] / r["scale"], 1e-6), 0.999)
    return float(min(max(1 / correlation - 1, STRENGTH[0]), STRENGTH[1]))


def sites(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """_host, _path, _fold, site_rate, host_rate, site_labels, global_rate of every site with documents.

    The rates for a fold are of the labels of all other folds.  Sums are per group, so the map
    side combines a hot host.  Null hosts and paths are a site of their own.
    """
    key = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("_host"), F.coalesce(F.col(path).cast("string"), F.lit("\0")).alias("_path"))
    named = key.where("doc_id IS NOT NULL").join(outcomes(labels), "doc_id", "left").unionByName(key.where("doc_id IS NULL").withColumn("y", F.lit(None).cast("int")))  # no label belongs to a null id
    counts = checkpoint(named.groupBy("_host", "_path", fold(F.col("doc_id")).alias("_in")).agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("good")))  # read several times
    folds = F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("_fold")
    others = counts.select("_host", "_path", "_in", folds, "n", "good").groupBy("_host", "_path", "_fold").agg(*(F.sum(F.when(F.col("_in") != F.col("_fold"), F.col(c)).otherwise(0)).alias(c) for c in ("n", "good")))
    hosts = others.groupBy("_host", "_fold").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    totals = {r["_fold"]: r for r in others.groupBy("_fold").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect()}  # FOLDS rows
    rate_of = {k: (r["good"] + 1) / (r["n"] + 2) for k, r in totals.items()}
    overall = F.lit(0.5)
    for k, v in rate_of.items():
        overall = F.when(F.col("_fold") == k, F.lit(v)).otherwise(overall)
    a = strength(hosts.select(F.col("host_n").alias("n"), F.col("host_good").alias("good"), "_fold"), overall)
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + a * overall) / (F.col("host_n") + a))
    both = others.join(hosts, ["_host", "_fold"])
    b = strength(both, F.col("host_rate"))
    return both.select("_host", "_path", "_fold", ((F.col("good") + b * F.col("host_rate")) / (F.col("n") + b)).alias("site_rate"), "host_rate", F.col("n").alias("site_labels"), overall.alias("global_rate"))


def judged(docs: DataFrame, labels: DataFrame, columns: list[str], host: str = "source", path: str = "lang", models: list[Classifier] | None = None) -> DataFrame:
    """The columns, named c0, c1, ..., with _evidence, _host_rate, _site_rate and _posterior (probability of good) of each row."""
    models = models or fit(docs, labels)
    odds_of = np.stack([m.words for m in models])
    place = len(columns)

    @V.tidy
    def run(batches):
        for batch in batches:
            for i, j, data, offsets in V.parts(batch.column(place)):
                part = batch.slice(i, j - i)
                own = part.column(place + 3).to_numpy()
                x, (buckets, first) = features(data, offsets), vocabulary(data, offsets)
                lexical, evidence = _mean(odds_of[np.repeat(own, np.diff(first)), buckets], first), np.zeros(j - i)
                for k, model in enumerate(models):
                    mine = np.flatnonzero(own == k)
                    evidence[mine] = model.combined(x[mine], lexical[mine])
                yield pa.record_batch([*part.columns[:place], *part.columns[place + 1 :], pa.array(evidence)], names)

    key = [F.coalesce(docs[c].cast("string"), F.lit("\0")).alias(n) for c, n in ((host, "_host"), (path, "_path"))]
    plain = [f"c{k}" for k in range(place)]
    wide = docs.select(*(docs[c].alias(n) for c, n in zip(columns, plain)), docs["text"].cast("string").alias("_text"), *key, fold(docs["doc_id"]).alias("_fold"))
    names = [*plain, "_host", "_path", "_fold", "_evidence"]
    scored = wide.mapInArrow(run, wide.drop("_text").withColumn("_evidence", F.lit(0.0)).schema)
    by_site = sites(docs, labels, host, path)
    if by_site.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES:
        joined = scored.join(F.broadcast(by_site), ["_host", "_path", "_fold"])
    else:  # a hot site meets its documents in SALTS places
        salted = by_site.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = scored.withColumn("_salt", F.pmod(F.xxhash64("_evidence", F.spark_partition_id()), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_path", "_fold", "_salt"])
    odds = F.col("_evidence") + F.log(F.col("site_rate") / (1 - F.col("site_rate")))
    return joined.select(*plain, F.col("_evidence"), F.col("host_rate").alias("_host_rate"), F.col("site_rate").alias("_site_rate"), (1 / (1 + F.exp(-odds))).alias("_posterior"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, evidence, host_rate, site_rate, posterior, keep of every row.

    Null and empty texts are judged by the features of an empty text; repeated rows are
    repeated; without labels every document has a posterior of a half and stays.
    """
    out = judged(docs, labels, ["doc_id"])
    return out.select(F.col("c0").alias("doc_id"), *(F.col(f"_{c}").alias(c) for c in ("evidence", "host_rate", "site_rate", "posterior")), (F.col("_posterior") >= KEEP_AT).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose posterior is KEEP_AT at least, all columns as they are."""
    return judged(docs, labels, docs.columns).where(F.col("_posterior") >= KEEP_AT).select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))
