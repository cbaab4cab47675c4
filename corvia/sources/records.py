"""Reading judgment records from JSON files and archives, and writing what comes of them.

Files are read whole by Spark's own reader, so any store that Spark reaches will do, and told apart by
content as Python values in Arrow batches: an array, an object, or a line for each record.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Source key of each column.
KEYS = {"jid": "JID", "jyear": "JYEAR", "jcase": "JCASE", "jno": "JNO", "jdate": "JDATE", "jtitle": "JTITLE", "jfull": "JFULL", "jpdf": "JPDF"}
RECORD = StructType([StructField(c, StringType()) for c in (*KEYS, "source_zip")])
MEMBERS = (".json", ".jsonl", ".ndjson")
ROWS_OUT = 5000  # records sent back at once


def _elements(text: str) -> Iterator[object]:
    """The values of an array, one at a time; ValueError where it is none."""
    decoder, skip = json.JSONDecoder(), re.compile(r"[ \t\r\n]*")
    at = skip.match(text, 1).end()
    if text[at : at + 1] != "]":
        while True:
            value, at = decoder.raw_decode(text, at)
            yield value
            at = skip.match(text, at).end()
            if text[at : at + 1] != ",":
                break
            at = skip.match(text, at + 1).end()
    if text[at:] != "]":
        raise ValueError("no array")


def objects(raw: bytes) -> Iterator[dict]:
    """The objects of a file: of an array, alone, or a line each. Other values and bad lines go; so do undecodable files.

    One is held at a time, beside the text: an array is read through first to see that it is one.
    """
    try:
        text = raw.decode("utf-8-sig").strip()
    except UnicodeDecodeError:
        return
    try:
        if text[:1] == "[":
            for _ in _elements(text):
                pass
            yield from (x for x in _elements(text) if isinstance(x, dict))
            return
        if text[:1] == "{":
            yield json.loads(text)
            return
    except ValueError:
        pass
    for piece in re.finditer(r"[^\n]*\n?", text):
        for line in piece[0].splitlines():
            try:
                value = json.loads(line)
            except ValueError:
                continue
            if isinstance(value, dict):
                yield value


def parse_json(raw: bytes) -> list[dict]:
    return list(objects(raw))


def record(data: dict, source: str) -> tuple[str, ...]:
    """The columns of a record as text: a key that is not there is empty, the id may be under ID."""
    values = {c: str(data.get(k, "")) for c, k in KEYS.items()}
    values["jid"] = str(data.get("JID") or data.get("ID") or "")
    return (*values.values(), source)


def _members(name: str, raw: bytes) -> Iterator[bytes]:
    if not name.lower().endswith(".zip"):
        yield raw
        return
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            for member in archive.namelist():
                if member.lower().endswith(MEMBERS):
                    try:
                        yield archive.read(member)
                    except (zipfile.BadZipFile, OSError, RuntimeError):
                        continue
    except zipfile.BadZipFile:
        return


def read_records(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """Records of JSON files and of JSON members in zip archives under path, with the file's name in source_zip."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                short = name.rsplit("/", 1)[-1]
                found = (record(x, short) for part in _members(short, raw) for x in objects(part))
                while some := list(islice(found, ROWS_OUT)):
                    yield pd.DataFrame(some, columns=RECORD.names)

    return files.select("path", "content").mapInPandas(rows, RECORD)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By the path's ending: archives and JSON files; a folder's archives, or else all its JSON files; else no rows."""
    lower = path.lower().rstrip("/")
    if lower.endswith((".zip", *MEMBERS)):
        return read_records(spark, path)
    if "." in lower.rsplit("/", 1)[-1]:
        return spark.createDataFrame([], RECORD)
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")  # a listing, no file is read
    return read_records(spark, path, "*.zip") if names.limit(1).count() else read_records(spark, path, "*.json", recursive=True)


def read_filtered(spark: SparkSession, path: str) -> DataFrame:
    """What write_filtered() wrote, without blank and bad lines; the schema is declared, never inferred."""
    schema = StructType([*RECORD.fields, StructField("court", StringType()), StructField("court_name", StringType())])
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_filtered(cases: DataFrame, path: str) -> DataFrame:
    """One JSON object a line; returns the number of records of each court."""
    cases.write.mode("overwrite").json(path)
    return cases.groupBy("court").count()


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    """jid and factors of label files; of several lines for a judgment the last in file order; no direction is absent."""
    schema = "jid string, factors map<string,struct<direction:string,evidence:string>>"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).withColumns({"_file": F.col("_metadata.file_path"), "_line": F.monotonically_increasing_id()})
    from corvia.operators.registry import last_by_key

    last = last_by_key(rows.where("jid IS NOT NULL"), ["jid"], [F.col("_file"), F.col("_line")])
    filled = F.transform_values(
        "factors",
        lambda k, v: F.struct(F.coalesce(v["direction"], F.lit("absent")).alias("direction"), F.coalesce(v["evidence"], F.lit("")).alias("evidence")),
    )
    return last.select("jid", filled.alias("factors"))


def split_failures(answers: DataFrame, done: str, failed: str) -> None:
    """Answers without an error are appended to one place, the others with their raw text to another."""
    answers.where("error IS NULL").select("jid", "factors").write.mode("append").json(done)
    answers.where("error IS NOT NULL").select("jid", "error", "raw_response").write.mode("append").json(failed)


def flattened_catalog(pages: DataFrame) -> DataFrame:
    """A row for each file set of each data set of saved catalog pages."""
    return pages.select("datasetId", F.explode("filesetLists").alias("f")).select("datasetId", "f.*")


def bucket_document(stats: DataFrame, key: Column, columns: list[str]) -> DataFrame:
    """One row with all buckets as a JSON object of key to values, for a page that reads one file.

    The buckets are few by construction: courts times behaviors times levels times flags.
    """
    entry = F.struct(key.alias("key"), F.struct(*columns).alias("value"))
    return stats.groupBy().agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("buckets"))


def write_factors(labels: DataFrame, path: str) -> None:
    """One JSON object a line: jid and its factors; what was there goes."""
    labels.select("jid", "factors").write.mode("overwrite").json(path)


def write_blocks(cases: DataFrame, path: str, block: str = "reason") -> None:
    """One JSON object a line for each case: jid, jcase, its block of text and the block's length."""
    cases.select("jid", "jcase", block, F.length(block).alias(f"{block}_len")).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A sheet with headings; the first heading begins with a byte order mark, by which spreadsheets know the encoding."""
    first, *others = df.columns
    marked = df.select(F.col(f"`{first}`").alias("\ufeff" + first), *(F.col(f"`{c}`") for c in others))
    marked.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A sheet of text cells, with or without a byte order mark before the first heading."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("enforceSchema", True).csv(path)
