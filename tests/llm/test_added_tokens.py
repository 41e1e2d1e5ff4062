import zlib

import numpy as np

from blockloom.llm import catalog, packing

END = "<|endoftext|>"
TEXTS = [f"end {END} of", END, END * 3, f"{END}x", f"x{END}", f"  {END}  \n {END}\n", "<|endoftext|", "|>plain é日本 text", "", f"a {END}" * 1500, f"word {END} " + "more words " * 3000, None]


def test_ids_are_those_of_tokenizers(spark, docs, tokenizer, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert library.encode(TEXTS[0], add_special_tokens=False).ids == [437, 220, 50256, 286]
    plain = [r.text for r in docs.select("text").limit(60).collect()]
    rows = list(enumerate(TEXTS + plain))
    want = []
    for k, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        n = -(-len(ids) // 2048)
        edges = [0, *(len(ids) - (n - 1 - j) * 2048 for j in range(n))]
        want += [(k, j, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for j, (a, b) in enumerate(zip(edges, edges[1:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in packing.cut(df, *tokenizer).collect()) == sorted(want)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    packed = catalog.op10_best_fit_packing(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r) for r in packed.collect()) == sorted(want)
