"""Queries that write what comes of the tables to the shared folder and read it back: sources, sinks, streams, model answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvia.operators import corpus_filter, labels, training
from corvia.plans.cases import CASES, cases, table
from corvia.plans.judgments import HEADERS, ORDERS, _pick, factor_documents, judgments, orders
from corvia.plans.registered import query
from corvia.sources import records
from corvia.sources.written import shared_dir
from corvia.streaming import ingest


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corvia/{name}-{uuid.uuid4().hex}"


_SELECTED = "(k % 9 <> 0 OR k % 5 = 0) AND k % 7 <> 3 AND k % 12 <> 5 AND k % 13 <> 0 AND k % 17 <> 0"


@query(f"WITH {ORDERS} SELECT jid, jdate, n FROM (SELECT jid, '20230101' AS jdate, 1 AS n FROM j WHERE jid[:2] = 'KL' AND {_SELECTED})")
def stored_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments arrive in two lots, the second with all of the first again; each that belongs is stored once."""
    arriving, store, state = (place(spark, n) for n in ("arriving", "stored", "state"))
    rows = judgments(spark, sf_dir).select("*", *(F.lit("").alias(c) for c in ("jyear", "jno", "jpdf", "source_zip"))).select(records.RECORD.names)
    for lot in (rows.where(F.crc32("jid") % 2 == 0), rows):
        lot.write.mode("append").json(arriving)
        ingest.ingest(spark, arriving, store, state).awaitTermination()
    return spark.read.parquet(store).groupBy("jid", "jdate").agg(F.count("*").cast("int").alias("n"))


@query("""SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, strftime(time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour', '%Y-%m-%d %H:%M') AS "end", event_type, count(*) AS n
FROM events WHERE ts IS NOT NULL GROUP BY ALL""")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour")
    return found.select(*(F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in ("start", "end")), "event_type", "n")


@query(f"WITH {ORDERS} SELECT jid, jid[:2] AS court, CASE jid[:2] WHEN 'KL' THEN '基隆' WHEN 'TP' THEN '臺北' WHEN 'SL' THEN '士林' WHEN 'PC' THEN '新北' ELSE '桃園' END AS court_name, (count(*) OVER (PARTITION BY jid[:2]))::BIGINT AS n FROM j WHERE {_SELECTED}")
def filtered_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered corpus as JSON lines, read back, beside the counts that the sink returned."""
    path = place(spark, "filtered")
    counts = records.write_filtered(corpus_filter.select_cases(judgments(spark, sf_dir), corpus_filter.ALL_COURTS), path).withColumnRenamed("count", "n")
    return records.read_filtered(spark, path).select("jid", "court", "court_name").join(counts, "court")


_FACTORS = "unnest(['" + "', '".join(training.FACTORS) + "']) AS factor, unnest(range(10)) AS i"


@query(f"""WITH {ORDERS}, f AS (SELECT jid, k, {_FACTORS} FROM j WHERE k % 3 <> 1)
SELECT jid, factor, CASE WHEN k % 2 = 0 THEN 'absent' ELSE ['mitigating', 'aggravating', 'neutral', 'absent'][(k + i) % 4 + 1] END AS direction FROM f""")
def factor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files written in two runs; of a judgment in both the later file's labels count, a missing direction is absent."""
    path = place(spark, "factors")
    labelled = factor_documents(spark, sf_dir)
    even = F.substring("jid", 3, 20).cast("long") % 2 == 0
    blank = F.transform_values("factors", lambda k, v: F.struct(F.lit(None).cast("string").alias("direction"), v["evidence"].alias("evidence")))
    records.write_factors(labelled, f"{path}/a")
    records.write_factors(labelled.where(even).withColumn("factors", blank), f"{path}/b")
    found = records.read_factors(spark, f"{path}/*")
    return found.select("jid", F.explode("factors").alias("factor", "f")).select("jid", "factor", "f.direction")


@query("SELECT doc_id::VARCHAR AS doc_id, coalesce(source, '') AS source, replace(substr(text, 1, 200), chr(10), ' / ') || ', \"quoted\"' AS note FROM documents")
def label_sheet_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet with a byte order mark, commas and quotes, written and read back."""
    path = place(spark, "sheet")
    note = F.concat(F.replace(F.substring("text", 1, 200), F.lit("\n"), F.lit(" / ")), F.lit(', "quoted"'))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), note.alias("note"))
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    back = spark.read.schema("doc_id string, source string, note string").option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "note")


@query(f"""WITH {ORDERS} SELECT jid, CASE k % 6 WHEN 2 THEN 'missing: motive' WHEN 3 THEN 'direction: harm' WHEN 4 THEN 'parse: no JSON object' END AS error,
  CASE WHEN k % 6 IN (2, 3, 4) THEN NULL ELSE 10 END AS n_factors, CASE WHEN k % 6 IN (2, 3, 4) THEN NULL ELSE 'neutral' END AS harm, k % 6 IN (2, 3, 4) AS failed FROM j""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model as it gives them (fenced, with words around, incomplete, off the list, no JSON), checked, and split into two places."""
    k = F.col("k")
    entry = lambda f, d="neutral": f'"{f}": {{"direction": "{d}", "evidence": "e"}}'
    whole = "{" + ", ".join(map(entry, training.FACTORS)) + "}"
    answers = (
        whole, f"```json\n{whole}\n```", "{" + ", ".join(map(entry, training.FACTORS[1:])) + "}",
        "{" + ", ".join(entry(f, "unsure" if f == "harm" else "neutral") for f in training.FACTORS) + "}", "I cannot say.", f"Here it is: {whole} Best regards",
    )
    rows = orders(spark, sf_dir).select(F.concat(_pick(tuple(HEADERS), k % 5), k.cast("string")).alias("jid"), _pick(answers, k % 6).alias("raw_response"))
    checked = labels.checked_answers(rows, "raw_response")
    done, failed = place(spark, "answers"), place(spark, "failures")
    records.split_failures(checked, done, failed)
    good = spark.read.schema("jid string, factors map<string,struct<direction:string,evidence:string>>").json(done)
    bad = spark.read.schema("jid string, error string, raw_response string").json(failed)
    none = lambda t: F.lit(None).cast(t)
    return good.select("jid", none("string").alias("error"), F.size("factors").alias("n_factors"), F.col("factors")["harm"]["direction"].alias("harm"), F.lit(False).alias("failed")).unionByName(
        bad.select("jid", "error", none("int").alias("n_factors"), none("string").alias("harm"), F.lit(True).alias("failed"))
    )


@query(f"WITH {ORDERS} SELECT jid, '' AS jyear, CASE WHEN k % 12 = 5 THEN '聲' ELSE '訴' END AS jcase, 'None' AS jno, CASE WHEN k % 7 = 3 THEN '竊盜' ELSE '違反毒品危害防制條例' END AS jtitle FROM j")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records under the source's keys, as arrays, single objects and lines with junk between; a null becomes the text None, the id may stand under ID."""
    path = place(spark, "records")
    k = F.substring("jid", 3, 20).cast("long")
    as_object = lambda id_: F.to_json(F.struct(F.col("jid").alias(id_), F.col("jcase").alias("JCASE"), F.lit(None).cast("string").alias("JNO"), F.col("jtitle").alias("JTITLE")), {"ignoreNullFields": "false"})
    rows = judgments(spark, sf_dir).select("jid", "jcase", "jtitle", k.alias("k"), F.when(k % 2 == 0, as_object("JID")).otherwise(as_object("ID")).alias("o"))
    # Arrays and files of lines are bounded: more rows make more of them.
    lists = rows.where("k % 3 = 0").groupBy((F.floor(F.col("k") / 1_000_000) * 97 + F.col("k") % 97).alias("g")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("o"), ",\n"), F.lit(", 7, null]")).alias("value"))
    lists.select("value", "g").write.partitionBy("g").text(f"{path}/lists")  # a file for each array
    rows.where("k % 3 <> 0").select(F.concat("o", F.lit("\nno json\n[1, 2]")).alias("value")).write.option("maxRecordsPerFile", 50_000).text(f"{path}/lines")
    found = records.read_records(spark, path, "*.txt", recursive=True)
    return found.select("jid", "jyear", "jcase", "jno", "jtitle")


@query(f"""WITH {CASES}, r AS (SELECT case_id, CASE WHEN order_id % 4 = 0 THEN [] ELSE [behavior] END AS b, CASE WHEN order_id % 5 = 0 THEN NULL ELSE [level] END AS l, CASE WHEN order_id % 6 = 0 THEN 0 ELSE n_counts END AS c, CASE WHEN order_id % 7 = 0 THEN 30 WHEN order_id % 7 = 1 THEN NULL ELSE 112 END AS y FROM cases)
SELECT case_id, list_filter([CASE WHEN len(b) < 1 THEN 'behaviors' END, CASE WHEN l IS NULL THEN 'drug_levels' END, CASE WHEN c < 1 THEN 'n_sentence_counts' END, CASE WHEN y < 80 THEN 'jyear' END], lambda x: x IS NOT NULL) AS errors FROM r""")
def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("order_id")
    asked = cases(spark, sf_dir).select(
        "case_id", F.when(k % 4 != 0, F.array("behavior")).otherwise(F.array().cast("array<string>")).alias("behaviors"), F.when(k % 5 != 0, F.array("level")).alias("drug_levels"),
        F.when(k % 6 == 0, 0).otherwise(F.col("n_counts")).alias("n_sentence_counts"), F.when(k % 7 == 0, 30).when(k % 7 == 1, None).otherwise(112).alias("jyear"),
    )
    return training.request_errors(asked).select("case_id", "errors")
