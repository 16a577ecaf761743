"""Two uploads through the file stream, each standardised as its own run."""

import os
import tempfile

from sample_table import SAMPLE_HEADER, SAMPLE_ROWS


def test_uploads_stream(spark):
    from wideprep.streaming.uploads import start

    base = tempfile.mkdtemp(prefix="wideprep-stream-")
    src = os.path.join(base, "in")
    schema = "_pos int, " + ", ".join(f"{h} string" for h in SAMPLE_HEADER)
    for k in range(2):
        rows = [[i] + r for i, r in enumerate(SAMPLE_ROWS[: 3 + k])]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    q = start(spark, src, schema, os.path.join(base, "out"), os.path.join(base, "ckpt"), ["_pos"])
    q.awaitTermination(300)
    out = spark.read.parquet(os.path.join(base, "out"))
    counts = sorted(r["count"] for r in out.groupBy("batch_id").count().collect())
    assert counts == [3, 4]
    assert out.where("record_id = 'REC-0000001'").count() == 2
