import corpus_pipeline


def test_stages_and_columns(spark, sf, docs):
    frame = docs
    sizes = [frame.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf)
        assert frame.columns == docs.columns, name
        frame = spark.createDataFrame(frame.collect(), docs.schema)
        sizes.append(frame.count())
    assert sizes == sorted(sizes, reverse=True) and 0.3 * sizes[0] < sizes[-1] < sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in frame.select("doc_id").collect()}


def test_run_gives_the_last_stage(spark, sf):
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, sf).columns)
