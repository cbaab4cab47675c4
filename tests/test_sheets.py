"""Files with bad lines, label files, blocks and sheets; reports in the order that people read."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from corvia.operators import registry, review
from corvia.sources import records


def test_bad_lines_are_skipped(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"jid": "A", "jfull": "x"}\n\nnot json\n{"jid": "B"}\n', encoding="utf-8")
    assert sorted(r.jid for r in records.read_filtered(spark, str(tmp_path)).collect()) == ["A", "B"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "b.jsonl").write_text('{"jid": "A", "factors": {"motive": {"direction": "neutral"}}}\n{"jid": \n', encoding="utf-8")
    assert [r.jid for r in records.read_factors(spark, str(tmp_path / "f")).collect()] == ["A"]


def test_label_files_blocks_and_sheets(spark, tmp_path):
    rows = spark.createDataFrame([("A", "訴", "理由", {"motive": ("neutral", "e")})], "jid string, jcase string, reason string, factors map<string,struct<direction:string,evidence:string>>")
    for _ in range(2):  # what was there goes
        records.write_factors(rows, str(tmp_path / "factors"))
    assert records.read_factors(spark, str(tmp_path / "factors")).first()["factors"]["motive"]["evidence"] == "e"
    records.write_blocks(rows, str(tmp_path / "blocks"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "blocks").glob("part-*"))
    assert json.loads(text) == {"jid": "A", "jcase": "訴", "reason": "理由", "reason_len": 2}
    records.write_csv(rows.select("jid", "jcase"), str(tmp_path / "sheet"))
    raw = b"".join(p.read_bytes() for p in (tmp_path / "sheet").glob("part-*"))
    assert raw.startswith(b"\xef\xbb\xbfjid,jcase")
    assert [tuple(r) for r in records.read_csv(spark, str(tmp_path / "sheet"), ["jid", "jcase"]).collect()] == [("A", "訴")]


def test_links_and_reports(spark):
    jid = spark.createDataFrame([("KLDM,112,訴 /1~*",), ("",), (None,)], "jid string")
    links = [r[0] for r in jid.select(registry.judgment_url(F.col("jid"))).collect()]
    assert links == [registry.JUDGMENT + "KLDM%2C112%2C%E8%A8%B4%20/1~%2A", "", ""]
    errors = spark.createDataFrame([("持有", 3), ("販賣", 9), ("x", 1)], "behavior string, n long")
    assert [r.behavior for r in review.ordered_groups(errors, "behavior", ("販賣", "持有")).collect()] == ["販賣", "持有", "x"]
    assert [r.n for r in review.ordered_groups(errors, "behavior").collect()] == [9, 3, 1]
    assert review.ordered_groups(errors.where("n = 3"), "behavior").count() == 0
    front = review.front_columns(errors, ["n", "gone"])
    assert front.columns == ["n", "behavior"]
