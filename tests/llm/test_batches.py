"""Batches of texts stay small, so that an executor holds little outside its heap."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tickledger.llm.common import BATCH_BYTES, BATCH_ROWS


def test_pipeline_sends_texts_in_small_batches(spark):
    names = [f"spark.sql.execution.arrow.{n}" for n in ("maxBytesPerBatch", "maxRecordsPerBatch")]
    old = {n: spark.conf.get(n) for n in names}
    try:
        docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("ab "), 2000), "id").alias("text"), F.lit("s").alias("source"))
        corpus_pipeline.near_duplicates(spark, docs.limit(2), "")

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

        got = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 3000
        assert max(r["n"] for r in got) <= BATCH_ROWS and max(r["size"] for r in got) <= 2 * BATCH_BYTES
        spark.conf.set(names[1], "10")
        corpus_pipeline.small_batches(spark)
        assert spark.conf.get(names[1]) == "10"
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)
