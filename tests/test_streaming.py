"""Admission, as-of limits and the sink against plain loops, and what is delivered twice."""

import random
from collections import deque

from pyspark.sql import functions as F

from graniteleaf.operators import ratelimit
from graniteleaf.sources import tables
from graniteleaf.streaming import admission, ledger

CALLS = "model string, call_id long, s double, tokens long"


def made(seed=1, n=150):
    rng = random.Random(seed)
    return [(rng.choice("aaab"), i, rng.randint(0, 600_000) / 1000, rng.choice([5, 20, 60, 200])) for i in range(n)]


def timed(spark, rows):
    return spark.createDataFrame(rows, CALLS).select("model", "call_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "tokens")


def plain(rows, window=60.0, budget=75.0):
    """One call after the other; each sleeps until its tokens fit into the last minute."""
    out = {}
    for model in {r[0] for r in rows}:
        spent, now = deque(), 0.0
        for _, call, s, want in sorted((r for r in rows if r[0] == model), key=lambda r: (r[2], r[1])):
            now = max(now, s)
            while True:
                while spent and round(now - spent[0][0], 6) > window:
                    spent.popleft()
                if not spent or sum(t for _, t in spent) + want <= budget:
                    break
                now = round(now + min(window - (now - spent[0][0]) + 0.25, 65.0), 6)
            spent.append((now, want))
            out[call] = round(now * 1_000_000)
    return out


def micros(df):
    return {r[0]: r[1] for r in df.select("call_id", F.unix_micros("admitted")).collect()}


def test_admission_of_a_table_is_the_loop(spark):
    rows = made()
    assert micros(admission.admitted(timed(spark, rows), limit=100.0)) == plain(rows)
    odd = timed(spark, rows[:5]).unionByName(spark.createDataFrame([(None, 900, None, 5), ("a", 901, None, None)], "model string, call_id long, ts timestamp, tokens long"))
    got = micros(admission.admitted(odd, limit=100.0))
    assert got[900] is None and got[901] is None and {k: v for k, v in got.items() if k < 900} == plain(rows[:5])
    assert admission.admitted(timed(spark, []), limit=100.0).count() == 0


def test_admission_of_a_stream_is_the_loop(spark, tmp_path):
    """Calls come in three batches, out of order inside; a last call of another model moves the watermark past every admission."""
    rows = sorted(made(2), key=lambda r: r[2])
    schema = timed(spark, []).schema
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for part in (rows[:50], rows[50:100], rows[100:], [("flush", -1, 1e7, 1)], [("flush", -2, 2e7, 1)]):
        random.Random(0).shuffle(part)
        timed(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = admission.admission_stream(stream, limit=100.0, late="300 seconds").writeStream.outputMode("append").format("memory").queryName("went").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = micros(spark.table("went").where("call_id >= 0"))
    assert got == plain(rows)


def test_asof_limits(spark):
    rng = random.Random(3)
    calls = [(rng.choice("xyy"), i, float(rng.randint(0, 400)), i) for i in range(300)] + [(None, 900, 5.0, 1), ("z", 901, 5.0, 1)]
    seen = [(rng.choice("xy"), float(rng.randint(0, 400)), rng.choice([None, rng.randint(1, 99)])) for _ in range(60)] + [(None, 1.0, 5), ("x", 0.0, 77)]
    limits = spark.createDataFrame(seen, "model string, s double, limit long").select("model", F.timestamp_seconds("s").alias("ts"), "limit")
    for stretch in (7, 100_000):
        got = {r["call_id"]: r["limit"] for r in ratelimit.asof_limits(timed(spark, calls), limits, stretch=stretch).collect()}
        assert len(got) == len(calls)
        for model, call, s, _ in calls:
            before = [(t, v) for m, t, v in seen if m == model and model is not None and v is not None and t < s]
            assert got[call] == (max(before)[1] if before else None)
    assert ratelimit.asof_limits(timed(spark, calls), limits.limit(0)).where("limit IS NOT NULL").count() == 0
    assert ratelimit.asof_limits(timed(spark, []), limits).count() == 0


def test_a_batch_that_comes_twice_leaves_its_rows_once(spark, tmp_path):
    path, rows = f"file://{tmp_path}/done", spark.createDataFrame([("q1", "a"), ("q2", None)], "id string, answer string")
    assert ledger.append_batch(rows, path, "eval", 0) and not ledger.append_batch(rows, path, "eval", 0)
    assert ledger.append_batch(rows.where("id = 'q1'"), path, "eval", 1) and ledger.append_batch(rows, path, "other", 0)
    # a writer that failed before its rename
    tables.append_checkpoint(rows, f"{path}/_aside/eval-2-dead")
    tables.append_checkpoint(rows.where("id = 'q2'"), path)
    got = [tuple(r) for r in tables.read_checkpoint(spark, path, "id string, answer string").collect()]
    assert sorted(got, key=str) == sorted([("q1", "a"), ("q2", None)] * 2 + [("q1", "a"), ("q2", None)], key=str)


def test_stream_whose_log_is_lost_delivers_again(spark, tmp_path):
    """The same batches with a fresh checkpoint: numbers start anew, and what is committed is not written again."""
    spark.createDataFrame([("q1", "a")], "id string, answer string").write.parquet(str(tmp_path / "in"))
    path = f"file://{tmp_path}/done"
    for c in ("c1", "c2"):
        stream = spark.readStream.schema("id string, answer string").parquet(str(tmp_path / "in"))
        q = ledger.append_finished(stream, path, str(tmp_path / c)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert tables.read_checkpoint(spark, path, "id string, answer string").count() == 1
