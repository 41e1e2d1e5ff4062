"""The classifier learns from every labelled document outside fold 0, however many and however long."""

import zlib

from pyspark.sql import functions as F

from blockloom.llm import toxicity

FILL = "plain words of no harm at all stand here beside many others of their kind".split()


def test_every_labelled_document_is_learned_from(spark):
    ids = spark.range(5200).select("id", (F.col("id") % 2).cast("int").alias("toxic"))
    ranked = [r.id for r in ids.where("toxic = 1").orderBy(F.xxhash64("id"), "id").collect()]
    first, long = set(ranked[:2000]), set(ranked[2000:2040])
    assert len(ranked) == 2600

    def text(k):
        fill = [FILL[(k * 7 + j * j) % len(FILL)] for j in range(12)]
        if k % 2 == 0:
            return " ".join(fill)
        if k in long:  # of more than 32 KB
            return " ".join(fill * 700 + ["grobzok"])
        return " ".join([*fill[:5], "frumpel" if k in first else "snorkag", *fill[5:]])

    docs = spark.createDataFrame([(k, text(k)) for k in range(5200)], "doc_id long, text string")
    labels = ids.withColumnRenamed("id", "doc_id")
    model = toxicity.fit(docs, labels)
    held = {k for k in range(5200) if zlib.crc32(str(k).encode()) % 5 == 0}
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).where("held_out").collect()}
    assert got.keys() == held and held & long
    for group in (held & first, held & set(ranked[2040:]), held & long, {k for k in held if k % 2 == 0}):
        assert sum(got[k] == k % 2 for k in group) > 0.95 * len(group)


def test_shards_and_blocks_sum_like_one_pass(spark):
    rows = [(k, f"w{k % 97} w{k % 31} idiot" if k % 3 == 0 else f"w{k % 89} w{k % 13}") for k in range(9000)]
    docs = spark.createDataFrame([*rows, (None, "idiot"), (1, "a second text of the id"), (9001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows] + [(0, 0), (4, None), (9001, 0), (9002, 1), (None, 1)], "doc_id long, toxic int")
    shards = toxicity.training(docs, labels)
    assert shards.rdd.getNumPartitions() == 2
    fold = lambda k: zlib.crc32(str(k).encode()) % 5
    known = {k: int(k % 3 == 0) for k, _ in rows} | {9001: 0}
    texts = dict(rows) | {1: min(rows[1][1], "a second text of the id"), 9001: ""}
    learned = [k for k in known if fold(k) > 1]
    want = toxicity.counted(toxicity.steps_of((known[k], texts[k].encode()) for k in learned))

    def work(these):
        out = toxicity.counted(toxicity.steps_of(these))
        at = out.any(1).nonzero()[0]
        return out[at], at, at * 0 + 1

    got = toxicity.summed(shards.where("fold <> 1"), work, len(want), 2)
    assert got.tolist() == want.tolist() and got[-1].sum() == len(learned)


def test_equal_input_gives_an_equal_model(spark):
    docs = spark.createDataFrame([(k, f"w{k % 97} w{k % 31} idiot" if k % 3 == 0 else f"w{k % 89} w{k % 13}") for k in range(9000)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(7), labels.repartition(3))
    assert (one.table == two.table).all() and (one.weights == two.weights).all() and (one.thresholds == two.thresholds).all()
