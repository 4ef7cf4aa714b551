"""Per-record operators run unchanged on a file stream."""

import os

from quire.session import read_table
from quire.streaming import records


def test_passages_stream(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    docs.write.parquet(src)
    q = records.start_to_parquet(
        records.passages_stream(records.document_stream(spark, src), start=("the", "and"), stop="of"),
        os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ckpt"), trigger_once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(tmp_dir, "out"))
    batch = records.passages_stream(docs, start=("the", "and"), stop="of")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_answers_stream(spark, tmp_dir):
    src = os.path.join(tmp_dir, "answers")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write('x ```json\n{"$defs": {}}\n``` ```json\n{"themes": []}\n```')
    q = records.start_to_parquet(records.answers_stream(spark, src), os.path.join(tmp_dir, "out"),
                                 os.path.join(tmp_dir, "ckpt"), trigger_once=True)
    q.awaitTermination(120)
    got = [tuple(r) for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect()]
    assert got == [("a.json", '{"themes": []}')]
