"""Metrics, folds, buckets, registry, sources, and every registered query on the smallest tables."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corvia.operators import buckets, folds, labels, metrics, registry, training
from corvia.operators.extract import extract_features
from corvia.plans import queries as plans
from corvia.sources import records


def test_average_precision_takes_ties_together(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, True)], "s double, p boolean")
    (r,) = metrics.average_precision(df, [], "s", "p").collect()
    assert r.average_precision == pytest.approx((1 * 1 + 1 * 2 / 3 + 1 * 3 / 4) / 3)


def test_best_threshold(spark):
    df = spark.createDataFrame([("a", 0.9, True), ("a", 0.85, True), ("a", 0.2, False), ("b", 0.9, True)], "g string, s double, p boolean")
    got = {r.g: (r.threshold, r.f1) for r in metrics.best_threshold(df, ["g"], "s", "p").collect()}
    assert got == {"a": (0.25, 1.0), "b": (0.5, None)}


def test_nearest_rank(spark):
    (r,) = metrics.nearest_rank_quartiles(spark.createDataFrame([(x,) for x in (4, 1, 2, 3, 3)], "x int"), [], "x").collect()
    assert (r.q1, r.q2, r.q3, r.n, r.max) == (2, 3, 3, 5, 4)


def test_folds_cover_the_tail_once(spark):
    df = spark.range(100).select("id", F.format_string("202001%02d", F.col("id") % 28 + 1).alias("d"))
    rows = folds.walk_forward(df, "d", ["id"], 5, 10).collect()
    tested = sorted(r.rank for r in rows if r.role == "test")
    assert tested == list(range(16, 100))
    for k in range(5):
        assert max(r.rank for r in rows if r.fold == k and r.role == "train") < min(r.rank for r in rows if r.fold == k and r.role == "test")
    few = folds.tail_shift(df.withColumns({"y": F.lit(1.0), "p": F.lit(0.0)}).limit(10), "d", ["id"], "y", "p", 0.5).first()
    assert few.shift == 0.0


def test_waterfall_adds_up(spark):
    df = spark.createDataFrame([("a", 10.0, 4), ("b", 20.0, 6)], "k string, p50 double, n int")
    steps = [("all", F.lit(True)), ("none", F.col("k") == "x"), ("b", F.lit(False) | (F.col("k") == "b"))]
    rows = buckets.waterfall(df, [], [steps[0], steps[2]]).orderBy("position").collect()
    assert [(r.step, r.level, r.change) for r in rows] == [("all", 16.0, None), ("b", 20.0, 4.0)]
    rows = buckets.waterfall(df, [], steps[:2]).orderBy("position").collect()
    assert rows[1].level is None and rows[1].change is None


def test_refresh_keeps_notes_and_is_idempotent(spark):
    fresh = spark.createDataFrame([("a", 5.0), ("b", 4.0)], "jid string, r double")
    old = spark.createDataFrame([("b", 1.0, "checked"), ("c", 2.0, "kept")], "jid string, r double, note string")
    once = registry.refresh(fresh, old, "jid", ["note"])
    got = {r.jid: (r.r, r.note, r.dropped) for r in once.collect()}
    assert got == {"a": (5.0, "", False), "b": (4.0, "checked", False), "c": (2.0, "kept", True)}
    twice = registry.refresh(fresh, once.drop("dropped"), "jid", ["note"])
    assert {r.jid: (r.r, r.note, r.dropped) for r in twice.collect()} == got


def test_answers(spark):
    good = json.dumps({f: {"direction": "neutral", "evidence": "x" * 200} for f in training.FACTORS})
    raw = [good, f"```json\n{good}\n```", "no", '{"motive": {"direction": "neutral"}}', good.replace("neutral", "odd", 1)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string")
    rows = labels.checked_answers(df, "raw").orderBy("i").collect()
    assert [r.error is None for r in rows] == [True, True, False, False, False]
    assert "parse" in rows[2].error and len(rows[0].factors["motive"]["evidence"]) == 120


def test_training_row_has_62_features(spark):
    df = spark.createDataFrame([("KL1", "20230101", "主文\n甲○○施用第二級毒品，處有期徒刑3月。\n犯罪事實")], "jid string, jdate string, jfull string")
    rec = spark.createDataFrame([("KL1", "112", "簡", "KL")], "jid string, jyear string, jcase string, court string")
    fac = spark.createDataFrame([("KL1", {"motive": ("aggravating", "")})], "jid string, factors map<string,struct<direction:string,evidence:string>>")
    rows = training.training_rows(extract_features(df), rec, fac)
    assert len(training.feature_columns(rows)) == 62
    r = rows.first()
    assert (r.a57_motive_agg, r.a57_motive_mit, r.a57_harm_agg, r.max_drug_weight_g, r._summary, r.court_KL) == (1, 0, 0, -1.0, True, 1)


def test_request_errors(spark):
    df = spark.createDataFrame([([], [2], 1, 113), (["施用"], [2], 0, 300), (["施用"], [1], 1, 113)], "behaviors array<string>, drug_levels array<int>, n_sentence_counts int, jyear int")
    assert [r.errors for r in training.request_errors(df).collect()] == [["behaviors"], ["n_sentence_counts", "jyear"], []]


def test_records_of_all_shapes(spark, tmp_path):
    a = {"JID": "KL1", "JFULL": "x"}
    (tmp_path / "a.json").write_text("﻿" + json.dumps([a, 1, {"ID": "KL2", "JYEAR": None}]), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(a))
    (tmp_path / "c.jsonl").write_text(json.dumps(a) + "\n\n{bad\n" + json.dumps({"JID": "KL3"}))
    (tmp_path / "d.json").write_bytes(b"\xff\xfe\x00bad\x80")
    rows = records.read_records(spark, str(tmp_path)).collect()
    assert sorted(r.jid for r in rows) == ["KL1", "KL1", "KL1", "KL2", "KL3"]
    assert {r.jid: r.jyear for r in rows}["KL2"] == "None"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m.json", json.dumps(a))
        z.writestr("n.txt", "no")
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    found = records.read_any(spark, str(tmp_path)).collect()
    assert [(r.jid, r.source_zip) for r in found] == [("KL1", "z.zip")]


def test_failures_apart_and_resumed(spark, tmp_path):
    answers = spark.createDataFrame([("A", None, {"motive": ("neutral", "")}), ("B", "parse", None)], "jid string, error string, factors map<string,struct<direction:string,evidence:string>>")
    records.split_failures(answers.withColumn("raw_response", F.lit("r")), str(tmp_path / "ok"), str(tmp_path / "bad"))
    done = records.read_factors(spark, str(tmp_path / "ok"))
    assert [r.jid for r in done.collect()] == ["A"]
    assert [r.jid for r in registry.pending(answers.select("jid"), done, "jid").collect()] == ["B"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents pages labels conversations".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    expected = con.sql(plans.SQL[name])
    frame = plans.QUERIES[name](spark, sf_dir)
    assert sorted(frame.columns) == sorted(expected.columns)
    columns = sorted(frame.columns)

    def plain(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return x
        return [plain(y) for y in x] if isinstance(x, (list, tuple)) else round(float(x), 6)

    got = sorted(str([plain(r[c]) for c in columns]) for r in frame.collect())
    at = [expected.columns.index(c) for c in columns]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in expected.fetchall())


def test_objects_of_a_file_are_held_one_at_a_time():
    import tracemalloc

    one = '{"JID": "KL%d", "JCASE": "a", "JTITLE": "b"}'
    for raw in ("[" + ", ".join(one % i for i in range(50_000)) + ", 7, null]", "\n".join(one % i + "\nno json" for i in range(50_000))):
        raw = raw.encode()
        tracemalloc.start()
        n = sum(1 for _ in records.objects(raw))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == 50_000 and peak < 3 * len(raw)
    assert records.parse_json(b'[{"a": 1}, [2], {"b": 2} ]') == [{"a": 1}, {"b": 2}] and records.parse_json(b"[]") == [] == records.parse_json(b"[1,]")
    assert records.parse_json(b'[{"a": 1},\n{"b": 2}\n') == [{"b": 2}] and records.parse_json(b'[{"a": 1}] x\n{"c": 3}') == [{"c": 3}]


def test_training_rows_move_no_maps_of_factors(spark):
    rec = spark.createDataFrame([("KL1", "110", "訴", "KL"), ("KL2", "110", "訴", "KL")], "jid string, jyear string, jcase string, court string")
    fac = spark.createDataFrame([("KL1", {"motive": ("aggravating", "x")})], "jid string, factors map<string,struct<direction:string,evidence:string>>")
    columns = {n: "false" for n in training.FLAGS.values()} | {"behaviors": "array('施用')", "drug_levels": "array(1)", "n_sentence_counts": "1", "sum_individual_months": "0"}
    columns |= {"max_drug_weight_g": "5.0D", "defendant_name": "''", "jdate": "''", "n_defendants": "1", "convicted_behaviors": "array('施用')", "convicted_drug_levels": "array(1)", "probation_granted": "false"}
    features = rec.select("jid", F.lit(7).alias("sentence_months"), *(F.expr(e).alias(n) for n, e in columns.items()))
    rows = training.training_rows(features, rec, fac)
    assert sorted((r.jid, r.a57_motive_agg, r.a57_motive_mit, r.a57_harm_agg) for r in rows.collect()) == [("KL1", 1, 0, 0), ("KL2", 0, 0, 0)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at" not in plan[: plan.index("Join LeftOuter")].lower()
