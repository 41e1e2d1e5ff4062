"""The classifiers and fingerprints against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from blockloom.llm import imatch, quality, toxicity
from blockloom.llm import textvec as V

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_hash(raw: bytes) -> int:
    data = np.frombuffer(raw, np.uint8)
    return int(V.hashes(V.lanes(data), data, np.array([0]), np.array([len(raw)]))[0])


def lowered(text) -> bytes:
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def joined(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *(len(r) for r in raw)]).astype(np.int64)


def test_hashes_tell_spans_apart_and_find_equal_ones():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    starts = rng.integers(0, 4900, 4000)
    ends = np.minimum(starts + rng.integers(0, 20, 4000), 5000)
    starts, ends = np.append(starts, [0, 100]), np.append(ends, [2000, 2100])
    h = V.hashes(V.lanes(data), data, starts, ends).tolist()
    by = {}
    for a, b, k in zip(starts, ends, h):
        assert by.setdefault(k, data[a:b].tobytes()) == data[a:b].tobytes()
    assert len(by) == len({data[a:b].tobytes() for a, b in zip(starts, ends)})
    w = V.windows(V.lanes(data), 40)
    assert len(w) == 4961 and len(set(w.tolist())) == len({data[k : k + 40].tobytes() for k in range(4961)})


# --- toxicity ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["good", "fine", "scum", "idiot", "word", "Zwei", "的"], rng.integers(0, 9))).encode() for _ in range(40)]
    return texts, np.array([int(b"scum" in t or b"idiot" in t) for t in texts])


def plain_score(model, raw: bytes) -> float:
    words = WORD.findall(lowered(raw.decode()))
    vectors = []
    for w in words:
        v = np.zeros(toxicity.DIM)
        for q, n in enumerate(toxicity.PREFIXES):
            bucket = (plain_hash(w[:n] if n else w) >> 7 * q) % toxicity.BUCKETS
            v += model.table[q, bucket] / toxicity.GRAIN
        vectors.append(v)
    top = []
    for width, filters in zip(toxicity.WIDTHS, model.filters):
        responses = [sum(vectors[k + o] @ filters[o] for o in range(width) if k + o < len(words)) for k in range(len(words))]
        top.append(np.max(responses, 0) if responses else np.zeros(toxicity.FILTERS))
    z = np.maximum(np.concatenate(top) + model.bias, 0) @ model.weights + model.intercept
    hits = [sum(w.decode() in toxicity.FREQUENT[name].split() for w in words) for name in toxicity.LANGUAGES]
    language = int(np.argmax(hits)) if max(hits) else len(toxicity.LANGUAGES)
    return 1 / (1 + math.exp(-(z - model.thresholds[language])))


def test_scores_are_those_of_the_plain_network(small, docs, odd):
    texts, labels = small
    model = toxicity.train(texts, labels, np.arange(len(texts)) % 5)
    more = [*texts, *((r.text or "").encode() for df in (docs.limit(25), odd) for r in df.collect())]
    got = toxicity.scores(model, *joined([t.decode() for t in more]))
    assert np.allclose(got, [plain_score(model, t) for t in more], atol=1e-12)


def test_equal_texts_score_alike_in_any_company(small):
    texts, labels = small
    model = toxicity.train(texts, labels, np.arange(len(texts)) % 5)
    together = toxicity.scores(model, *joined([t.decode() for t in texts]))
    assert together.tolist() == [float(toxicity.scores(model, *joined([t.decode()]))[0]) for t in texts]


def test_gradient_is_that_of_the_loss(small):
    texts, labels = small
    text = toxicity.read(*joined([t.decode() for t in texts]))
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(0, 0.5, (4, toxicity.BUCKETS, toxicity.DIM)), [rng.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS], rng.normal(0, 0.3, 24), rng.normal(0, 0.5, 24), 0.2)
    weight = rng.uniform(0.5, 2, len(labels))
    g = toxicity.gradient(model, text, labels, weight)

    def slope(values, at, step=1e-5):
        old = values[at]
        values[at] = old + step
        up = toxicity.loss(model, text, labels, weight)
        values[at] = old - step
        down = toxicity.loss(model, text, labels, weight)
        values[at] = old
        return (up - down) / (2 * step)

    for k in range(0, 24, 3):
        assert math.isclose(slope(model.weights, k), g.weights[k], abs_tol=1e-6) and math.isclose(slope(model.bias, k), g.bias[k], abs_tol=1e-6)
    for f, gf in zip(model.filters, g.filters):
        for at in [(0, 1, 2), (len(f) - 1, 7, 5), (0, 15, 7)]:
            assert math.isclose(slope(f, at), gf[at], abs_tol=1e-6)
    for q, (rows, total) in enumerate(g.table):
        for r in range(0, len(rows), 3):
            assert math.isclose(slope(model.table, (q, rows[r], 4)), total[r, 4], abs_tol=1e-6)


# --- quality ----------------------------------------------------------------------------------


def test_posteriors_are_those_of_plain_sums(spark):
    rng = np.random.default_rng(8)
    rows = [(k, "some text here", f"p{rng.integers(3)}", f"h{min(int(rng.integers(9)), 3)}" if k % 50 else None) for k in range(400)]
    rows.append((None, "x", "p0", "h0"))
    labels = [(k, int(rng.random() < (0.9 if rows[k][3] == "h3" else 0.4))) for k in range(0, 400, 2)] + [(0, 0), (8, None), (9, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = {}
    for k, y in labels:
        if y in (0, 1):
            known[k] = min(y, known.get(k, 1))
    fold = lambda k: 0 if k is None else zlib.crc32(str(k).encode()) % quality.FOLDS
    site, host, every = (defaultdict(lambda: [0, 0]) for _ in range(3))
    for f in range(quality.FOLDS):
        for k, _, path, h in rows:
            use = k in known and fold(k) != f
            for sums, key in ((site, (h, path, f)), (host, (h, f)), (every, f)):
                sums[key][0] += use
                sums[key][1] += known[k] if use else 0

    def strength(groups):
        beyond = scale = 0
        for (n, good), p in groups:
            p = min(max(p, 0.001), 0.999)
            if n:
                beyond += (good - n * p) ** 2 - n * p * (1 - p)
                scale += n * (n - 1) * p * (1 - p)
        if not scale or beyond <= 0:
            return quality.STRENGTH[1]
        return min(max(1 / min(max(beyond / scale, 1e-6), 0.999) - 1, quality.STRENGTH[0]), quality.STRENGTH[1])

    overall = {f: (good + 1) / (n + 2) for f, (n, good) in every.items()}
    a = strength([(v, overall[k[1]]) for k, v in host.items()])
    host_rate = {k: (v[1] + a * overall[k[1]]) / (v[0] + a) for k, v in host.items()}
    b = strength([(v, host_rate[k[0], k[2]]) for k, v in site.items()])
    rate = {k: (v[1] + b * host_rate[k[0], k[2]]) / (v[0] + b) for k, v in site.items()}
    got = quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    want = {k: (rate[h, path, fold(k)], host_rate[h, fold(k)]) for k, _, path, h in rows}
    assert len(got) == len(rows)
    for r in got:
        s, h = want[r.doc_id]
        assert math.isclose(r.site_rate, s) and math.isclose(r.host_rate, h)
        assert math.isclose(r.posterior, 1 / (1 + math.exp(-(r.evidence + math.log(s / (1 - s))))))


def test_own_label_does_not_vouch_for_a_document(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "p", f"h{k % 6}") for k in range(60)], "doc_id long, text string, lang string, source string")
    labels = [(k, k % 2) for k in range(60)]
    plain = {r.doc_id: r.site_rate for r in quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    labels[7] = (7, 0)
    turned = {r.doc_id: r.site_rate for r in quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    same = [k for k in plain if zlib.crc32(str(k).encode()) % quality.FOLDS == zlib.crc32(b"7") % quality.FOLDS]
    assert 7 in same and any(plain[k] != turned[k] for k in plain if k not in same)
    assert math.isclose(plain[7], turned[7], rel_tol=0.2)


def test_lexical_evidence_leaves_the_text_itself_out():
    texts = ["red apple", "red cherry", "grey stone", "grey stone wall", "", "blue"]
    y = np.array([1, 1, 0, 0, 1, 0])
    data, offsets = joined(texts)
    buckets, first = quality.vocabulary(data, offsets)
    sets = []
    for t in texts:
        w = WORD.findall(lowered(t))
        one = [np.array([plain_hash(x)], np.uint64) for x in w]
        pairs = [V.mix(b + V.mix(a)) for a, b in zip(one, one[1:])]
        sets.append({(int(x[0]) >> 40) % quality.BUCKETS for x in [*one, *pairs]})
    assert [set(buckets[a:b].tolist()) for a, b in zip(first, first[1:])] == sets
    model = quality.train(quality.features(data, offsets), buckets, first, y)
    count = [Counter(x for s, k in zip(sets, y) if k == c for x in s) for c in (0, 1)]
    for x in set().union(*sets):
        assert math.isclose(model.words[x], math.log((count[1][x] + 1) / 5) - math.log((count[0][x] + 1) / 5))


def test_site_quality_when_held_out(docs, labels):
    out = quality.score(docs, labels).join(quality.outcomes(labels), "doc_id").toPandas()
    assert (out.keep == (out.y == 1)).mean() > 0.9


# --- fingerprints -----------------------------------------------------------------------------


def plain_words(texts):
    """The lexicon: words of which share of the texts lies in the band."""
    seen = Counter(w for t in texts for w in set(WORD.findall(lowered(t))))
    low, high = max(imatch.LEAST_DOCUMENTS, imatch.BAND[0] * len(texts)), imatch.BAND[1] * len(texts)
    return {plain_hash(w) for w, n in seen.items() if low <= n <= high}


def mixed(x: int) -> int:
    return int(V.mix(np.array([x % 2**64], np.uint64))[0])


def plain_fingerprint(text, lexicon):
    words = sorted({plain_hash(w) for w in WORD.findall(lowered(text))})
    inside = [w for w in words if w in lexicon]
    words = words if len(inside) < imatch.LEAST_WORDS else inside
    out, column = [], 0
    for level in range(imatch.LEVELS + 1):
        left, seed = 0, 0
        for _ in range(imatch.PER_LEVEL if level else 1):
            mine = words
            if level:
                if left < 2 * level:
                    seed, left = column + 1, 64
                left -= 2 * level
                mine = [w for w in words if mixed(w ^ mixed(seed)) >> left & (1 << 2 * level) - 1 == 0]
            total = sum(mixed(w + k * 0x9E3779B97F4A7C15) for k, w in enumerate(mine)) % 2**64
            out.append(max(mixed(total) >> 48, 1) if mine else 0)
            column += 1
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    best = 0.0
    for level in range(1, imatch.LEVELS + 1):
        pairs = [(x, y) for x, y in list(zip(a, b))[1 + (level - 1) * imatch.PER_LEVEL : 1 + level * imatch.PER_LEVEL] if x or y]
        if len(pairs) >= 4:
            best = max(best, sum(x == y for x, y in pairs) / len(pairs))
    return best


def test_fingerprints_by_hand(spark, docs, odd):
    rows = [(r.doc_id, r.text) for r in docs.orderBy("n_chars").limit(60).select("doc_id", "text").collect()] + [(5000 + k, t) for k, t in enumerate([None, "", "one", "a b c", "The THE the cat"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = plain_words([t for _, t in rows])
    assert set(imatch.lexicon(df).tolist()) == lexicon
    order = sorted(rows, key=lambda r: -r[0])
    follower = {a[0]: b[1] or "" for a, b in zip(order, order[1:] + order[:1])}
    text = dict(rows)
    for r in imatch.edited_likeness(df).collect():
        own, after = text[r.doc_id] or "", follower[r.doc_id]
        half = len(own) // 2
        a, b, c = (plain_fingerprint(t, lexicon) for t in (own, own[: len(own) - half] + after[:half], after))
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (len(own), "".join(f"{x:04x}" for x in a), "".join(f"{x:04x}" for x in b))
        assert math.isclose(r.near_edited, plain_likeness(a, b)) and math.isclose(r.near_next, plain_likeness(a, c))
