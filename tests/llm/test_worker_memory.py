"""What Python workers hold: they outlive their tasks, and other stages need their memory."""

import pyarrow as pa

from geoaffinity.llm import bpe_words, frames, queries, suffix_dedup


def test_encoder_forgets_its_words_after_a_task():
    path = queries.tokenizer("word_bpe_49k.json")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["several words of a text", None])], names=["doc_id", "text"])
    rows = [row for found in bpe_words.encoded_rows(iter([batch]), path) for row in found.to_pylist()]
    assert [(r["doc_id"], r["n_words"]) for r in rows] == [(1, 5), (2, 0)]
    encoder = bpe_words._encoder(path)
    assert encoder.known == encoder.special_form


def test_texts_are_cut_once_and_by_one_worker(spark):
    docs = spark.createDataFrame([(n, "w " * 60, 120) for n in range(3)], "doc_id long, text string, n_chars int")
    shown = suffix_dedup.without_repeats(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("ArrowEvalPython") == 1


def test_pipeline_reads_small_batches(spark):
    names = ["spark.sql.parquet.columnarReaderBatchSize", *(f"spark.sql.execution.arrow.max{of}PerBatch" for of in ("Records", "Bytes"))]
    before = {name: spark.conf.get(name) for name in names}
    try:
        frames.small_batches(spark)
        assert int(spark.conf.get(names[0])) == 1000
        spark.conf.set(names[0], 100)
        frames.small_batches(spark)
        assert int(spark.conf.get(names[0])) == 100
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
