import pytest

from wakegraph.operators.merge import last_row
from wakegraph.streaming import jobs

LINES = "job_id string, seq long, at timestamp, text string, status string"


@pytest.fixture
def stream(spark, tmp_path):
    def make(batches):
        folder = str(tmp_path / "in")
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(f"{folder}/b{n}")
        return spark.readStream.schema(LINES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)

    return make


def line(job, seq, minute=0, text=None, status=None):
    from datetime import datetime

    return job, seq, datetime(2024, 1, 1, minute // 60, minute % 60), text or f"{job}{seq}", status


def test_ring_buffer_over_batches(spark, stream, tmp_path):
    out = jobs.drain(jobs.last_lines(stream([[line("a", i) for i in (2, 1, 3)] + [line("b", 1)], [line("a", 5), line("a", 4)]]), 3), "update", str(tmp_path / "out"))
    last = {}
    for r in sorted(out.collect(), key=lambda r: (r.batch, r.total)):
        last[r.job_id] = (r.total, r.texts)
    assert last == {"a": (5, ["a3", "a4", "a5"]), "b": (1, ["b1"])}


def test_states_don_t_go_back(spark, stream, tmp_path):
    first = [line("a", 1, status="RUNNING"), line("b", 2, status="FAILED"), line("b", 1, status="RUNNING"), line("c", 1, status="odd"), line("c", 2)]
    out = jobs.drain(jobs.states(stream([first, [line("a", 2, status="PENDING"), line("b", 3, status="RUNNING")]])), "update", str(tmp_path / "out"))
    last = {}
    for r in sorted(out.collect(), key=lambda r: (r.batch, r.n_changes)):
        last[r.job_id] = (r.status, r.n_changes)
    assert last == {"a": ("RUNNING", 2), "b": ("FAILED", 3), "c": ("PENDING", 2)}


def test_windows_expire(spark, stream, tmp_path):
    s = stream([[line("a", 1, 0), line("a", 2, 10)], [line("a", 3, 200)], [line("a", 4, 5), line("a", 5, 400)]])
    out = jobs.drain(jobs.expiring(s, "at", "job_id", "30 minutes"), "append", str(tmp_path / "out"))
    assert {(r.window_start.hour * 60 + r.window_start.minute, r.n) for r in out.collect()} <= {(0, 2), (0, 3), (180, 1)}
    assert out.count() >= 1


def test_upsert_sink(spark, stream, tmp_path):
    folder = str(tmp_path / "table")

    def merge(before, batch):
        new = batch.select("job_id", "seq", "text")
        return last_row(new if before is None else before.unionByName(new), ["job_id"], "seq")

    write = jobs.upsert_sink(merge, folder)
    s = stream([[line("a", 1), line("b", 1)], [line("a", 2)]])
    q = s.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    write(spark.createDataFrame([line("a", 2)], LINES), 1)  # a batch that comes again
    import os

    newest = max(int(d[2:]) for d in os.listdir(folder))
    assert {r.job_id for r in spark.read.parquet(f"{folder}/v={newest}").collect()} == {"a", "b"}
