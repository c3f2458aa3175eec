"""Streams that stop, resume and forget."""

import pytest
from pyspark.sql import functions as F

from ledgerline.streaming import rollup


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, "k string, g string, v long, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{folder}")


def stream(spark, folder):
    return spark.readStream.schema("k string, g string, v long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture
def events(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")


def test_first_of_stops_resumes_and_forgets(spark, events):
    folder, out, ck = events
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    known = spark.createDataFrame([("old", None, day(1))], "k string, g string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows = lambda: rollup.first_of(stream(spark, folder), ["k", "g"], ["v"], "ts", 5 * 86400, known=known)
    got = lambda: sorted((str(r["k"]), str(r["g"]), r["v"]) for r in spark.read.parquet(out).collect())
    put(spark, folder, "a", [("x", None, 3, day(2)), ("x", None, 1, day(2)), ("old", None, 0, day(2)), (None, "n", 7, day(2))])
    put(spark, folder, "b", [("x", None, 0, day(3)), ("y", "g", 2, day(3))])
    rollup.append_available(rows(), out, ck)
    first = [("None", "n", 7), ("x", "None", 1), ("y", "g", 2)]
    assert got() == first
    put(spark, folder, "c", [("y", "g", 1, day(4)), ("z", "g", 5, day(4)), (None, "n", 1, day(4)), ("old", None, 4, day(4)), ("x", "other", 6, day(4))])
    rollup.append_available(rows(), out, ck)  # another query, from the checkpoint
    first += [("x", "other", 6), ("z", "g", 5)]
    assert got() == sorted(first)
    put(spark, folder, "d", [("far", "g", 1, day(20))])
    put(spark, folder, "d2", [("far", "g", 3, day(20))])  # timers fire at the end of a batch
    rollup.append_available(rows(), out, ck)
    put(spark, folder, "e", [("x", None, 9, day(21)), ("far", "g", 2, day(21))])
    rollup.append_available(rows(), out, ck)  # what is five days old is forgotten, what is new is not
    assert got() == sorted([*first, ("far", "g", 1), ("x", "None", 9)])


def test_daily_state_is_bounded(spark, events):
    folder, out, ck = events
    rows = lambda: rollup.daily(stream(spark, folder).withColumnRenamed("v", "value"), ["k"], "ts", "1 day")
    want, seen = {}, []
    for run in range(2):
        for d in range(1, 9):
            day = f"2024-0{run + 1}-{d:02d}"
            data = [(k, None, d * 10 + i, f"{day} 0{i}:00:00") for k in "ab" for i in range(3)]
            put(spark, folder, day, data)
            for k, _, v, _ in data:
                n, total = want.get((k, day), (0, 0))
                want[(k, day)] = (n + 1, total + v)
        seen += rollup.append_updates(rows(), out, ck)
    got = {(r["k"], str(r["day"])): (r["n"], r["total"]) for r in rollup.latest(spark, out, ["k", "day"]).collect()}
    assert got == want and len(got) == 32
    held = [p["stateOperators"][0]["numRowsTotal"] for p in seen if p["stateOperators"]]
    assert len(held) >= 16 and max(held) <= 2 * 4  # two keys, of the days that the watermark has not passed


def test_records_once_and_what_is_written(spark, tmp_path):
    from ledgerline.schemas import RECORD

    folder, out, ck = str(tmp_path / "r"), str(tmp_path / "o"), str(tmp_path / "c")
    one = lambda name, stars: spark.createDataFrame([("p", name, stars)], "provider string, name string, repo_id string")
    (tmp_path / "r").mkdir()

    def shard(i, rows):
        import json

        (tmp_path / "r" / f"records-{i}.jsonl").write_text("".join(json.dumps({"provider": p, "name": n, "repo_id": x}) + "\n" for p, n, x in rows))

    assert "provider" in RECORD and one("a", "1").count() == 1
    shard(1, [("p", "a", "1"), ("p", "b", "2"), (None, "b", "3")])
    rollup.append_new(rollup.first_records(rollup.shards(spark, folder, 1), "1 hour").select("provider", "name", "repo_id"), out, ck, ["provider", "name"])
    shard(2, [("p", "a", "9"), ("p", "c", "4")])
    rollup.append_new(rollup.first_records(rollup.shards(spark, folder, 1), "1 hour").select("provider", "name", "repo_id"), out, ck, ["provider", "name"])
    shard(3, [("p", "b", "8"), (None, "b", "7"), ("p", "d", "5")])
    rollup.append_new(rollup.shards(spark, folder, 1).select("provider", "name", "repo_id"), out, str(tmp_path / "c2"), ["provider", "name"])  # state is lost: the folder decides
    assert sorted((str(r["provider"]), r["name"], r["repo_id"]) for r in spark.read.parquet(out).collect()) == [("None", "b", "3"), ("p", "a", "1"), ("p", "b", "2"), ("p", "c", "4"), ("p", "d", "5")]
