"""Arriving files are stored once, whatever the order of runs; late rows go; the store is not read."""

import json
import os

from corvia.streaming import ingest


def line(jid, verdict="處有期徒刑3月", date="20230101"):
    text = f"臺灣基隆地方法院刑事判決\n主文\n甲{verdict}\n理由"
    return json.dumps({"jid": jid, "jtitle": "毒品", "jcase": "訴", "jdate": date, "jfull": text}, ensure_ascii=False)


def runs(spark, tmp_path, **options):
    source, store, state = (tmp_path / n for n in ("in", "out", "state"))
    source.mkdir()

    def add(name, *lines):
        (source / name).write_text("\n".join(lines), encoding="utf-8")
        query = ingest.ingest(spark, str(source), str(store), str(state), **options)
        query.awaitTermination()
        return query

    return add, lambda: sorted(r.jid for r in spark.read.parquet(str(store)).collect())


def test_each_judgment_once_over_restarts(spark, tmp_path):
    add, stored = runs(spark, tmp_path)
    add("1.json", line("KL1"), line("KL1"), line("KL2", "無罪"))
    add("2.json", line("KL1"), line("KL3"), line("TP1"))
    last = add("3.json", line("KL3"))
    assert stored() == ["KL1", "KL3"]
    reads = [s["description"] for p in last.recentProgress for s in p["sources"]]
    assert reads and all("/in" in r for r in reads)  # the arriving files alone
    states = [s for p in last.recentProgress for s in p["stateOperators"]]
    assert states[-1]["numRowsTotal"] == 2 and "rocksdb" in json.dumps(states[-1]).lower()


def test_a_lost_commit_is_tried_again_without_a_second_copy(spark, tmp_path):
    add, stored = runs(spark, tmp_path)
    add("1.json", line("KL1"))
    add("2.json", line("KL2"))
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    for crc in (tmp_path / "state" / "commits").glob(f".{commits[-1].name}.crc"):
        crc.unlink()
    add("3.json", line("KL3"))
    assert stored() == ["KL1", "KL2", "KL3"]


def test_ids_are_forgotten_after_their_time_and_late_rows_go(spark, tmp_path):
    add, stored = runs(spark, tmp_path, forget="30 days")
    add("1.json", line("KL1", date="20230101"), line("KL1", date="20230105"))
    add("2.json", line("KL2", date="20230601"))
    add("3.json", line("KL3", date="20230102"), line("KL1", date="20230602"))  # late; and known no more
    assert stored() == ["KL1", "KL1", "KL2"]


def test_windows(spark):
    events = spark.createDataFrame([("2020-01-01 00:01:00", "a"), ("2020-01-01 00:04:00", "a"), ("2020-01-01 00:06:00", "b")], "t string, k string")
    got = ingest.windowed_counts(events.selectExpr("cast(t as timestamp) t", "k"), "t", "k").collect()
    assert sorted((r.k, r.n) for r in got) == [("a", 2), ("b", 1)]


def test_late_events_are_in_no_window(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    for i, t in enumerate(("00:01:00", "02:00:00", "02:01:00", "00:02:00", "04:00:00")):
        file = source / f"{i}.json"
        file.write_text(json.dumps({"t": f"2020-01-01 {t}", "k": "a"}), encoding="utf-8")
        os.utime(file, (1_600_000_000 + i, 1_600_000_000 + i))  # files arrive in this order
    stream = spark.readStream.schema("t timestamp, k string").option("maxFilesPerTrigger", 1).json(str(source))
    query = ingest.windowed_counts(stream, "t", "k").writeStream.format("memory").queryName("late_windows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.start.hour, r.n) for r in spark.table("late_windows").orderBy("start").collect()][:2] == [(0, 1), (2, 2)]
