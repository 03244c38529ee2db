import json
import os
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillveil.sources import journal

EVENT = "k long, text string"


def rows(spark, path):
    return sorted((r["k"], r["text"]) for r in journal.read(spark, path, EVENT).collect())


def test_batches(spark, tmp_path):
    path = f"file://{tmp_path}/j"
    assert rows(spark, path) == [] and journal.sweep(path, 0) == 0
    events = spark.range(100).select(F.col("id").alias("k"), F.concat(F.lit("line\nend é "), "id").alias("text")).repartition(5)
    journal.append(events, path, "a", 1)
    journal.append(events, path, "a", 1)  # tried again
    want = [(k, f"line\nend é {k}") for k in range(100)]
    assert rows(spark, path) == want
    assert {r["journal_writer"] for r in journal.read(spark, path, EVENT).collect()} == {"a"}
    journal.append(events.limit(0), path, "a", 2)
    journal.append(events.where("k < 2"), path)
    assert rows(spark, path) == sorted([*want, *want[:2]])
    named = {name for _, _, name, _, _ in journal.commits(path) if name}
    assert named == set(os.listdir(tmp_path / "j/data")) and ("a", 2, "", 0, 0) in journal.commits(path)
    with pytest.raises(Exception, match="only grows"):
        journal._as_lines(events).write.format(journal.FORMAT).mode("overwrite").save(path)
    with pytest.raises(Exception, match="one column"):
        events.write.format(journal.FORMAT).mode("append").save(path)
    with pytest.raises(Exception, match="one line"):
        spark.createDataFrame([("a\nb",)], "line string").write.format(journal.FORMAT).mode("append").save(path)
    with pytest.raises(Exception, match="name"):
        journal.append(events, path, "../x")
    assert rows(spark, path) == sorted([*want, *want[:2]])


def test_lost_tasks_and_torn_files(spark, tmp_path):
    path = str(tmp_path / "j")
    lines = [pa.RecordBatch.from_arrays([pa.array(['{"k":1,"text":"x"}'])], names=["line"])]
    lost = journal.StreamWriter(path, "s")
    lost.write(iter(lines))  # never committed: the task's executor is gone
    (tmp_path / "j/data/torn.jsonl").write_text('{"k":2,"te')
    os.makedirs(tmp_path / "j/commits")
    (tmp_path / "j/commits/.half").write_text("torn.jso")
    assert rows(spark, path) == []
    again = journal.StreamWriter(path, "s")
    first, second = again.write(iter(lines)), again.write(iter(lines))
    again.commit([first, None], 0)
    again.commit([second], 0)  # the same batch once more
    again.abort([again.write(iter(lines)), None], 1)
    assert rows(spark, path) == [(1, "x")]
    assert journal.sweep(path, 3600) == 0 and len(os.listdir(tmp_path / "j/data")) == 3
    for f in ("data/torn.jsonl", "commits/.half"):
        os.utime(tmp_path / "j" / f, (0, 0))
    assert journal.sweep(path, 3600) == 2 and rows(spark, path) == [(1, "x")]


def test_stream_that_is_killed(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "j", "c"))
    os.makedirs(source)

    def put(n):
        (tmp_path / f"in/{n}.json").write_text("".join(json.dumps({"k": k, "text": "t"}) + "\n" for k in range(n, n + 10)))

    def stream(fails=False):
        events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(source)
        if fails:
            events = events.withColumn("k", F.when(F.col("k") == 15, F.raise_error(F.lit("killed"))).otherwise(F.col("k")))
        q = journal.append_stream(events, path, "s", checkpoint, availableNow=True)
        q.awaitTermination(120)

    put(0)
    stream()
    put(10)
    with pytest.raises(Exception, match="killed"):
        stream(fails=True)
    assert rows(spark, path) == [(k, "t") for k in range(10)]
    stream()
    assert rows(spark, path) == [(k, "t") for k in range(20)]
    put(20)
    stream()
    last = max(int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit())
    for f in (f"{checkpoint}/commits/{last}", f"{checkpoint}/commits/.{last}.crc"):
        os.path.exists(f) and os.remove(f)  # stopped after the journal's commit, before the stream's note of it
    stream()
    assert rows(spark, path) == [(k, "t") for k in range(30)]
    shutil.rmtree(checkpoint)
