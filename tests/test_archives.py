"""Archives as a data source: a partition each, members streamed, bad ones skipped."""

import io
import json
import tracemalloc
import zipfile

from corvia.sources import archives, records


def write(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)


def rows(n, start=0):
    return [{"JID": f"J{i}", "JFULL": "主文" * 50} for i in range(start, start + n)]


def test_a_partition_for_each_archive(spark, tmp_path):
    write(tmp_path / "a.zip", {"1.json": json.dumps(rows(3)), "2.ndjson": "\n".join(map(json.dumps, rows(2, 10))) + "\nbad\n[1]", "x.txt": "no", "3.json": b"\xff\xfe"})
    write(tmp_path / "b.ZIP", {"1.json": "﻿" + json.dumps(rows(1, 20)[0])})
    (tmp_path / "c.zip").write_bytes(b"no archive")
    for whole in (1 << 20, 10):
        df = archives.read_archives(spark, str(tmp_path), whole)
        assert df.rdd.getNumPartitions() == 3
        assert sorted((r.jid, r.source_zip) for r in df.collect()) == sorted([(f"J{i}", "a.zip") for i in (0, 1, 2, 10, 11)] + [("J20", "b.ZIP")])
    assert archives.read_archives(spark, f"file://{tmp_path}/a.zip").count() == 5
    same = records.read_records(spark, str(tmp_path), "a.zip")
    assert sorted(r.jid for r in same.collect()) == sorted(r.jid for r in archives.read_archives(spark, str(tmp_path / "a.zip")).collect())


def test_pieces_of_any_size_give_the_same():
    for text in (json.dumps(rows(7)), json.dumps(rows(3), indent=1), "\n".join(map(json.dumps, rows(5))), "﻿" + json.dumps([1, {"a": "]"}, None, {"b": [2, 3]}]), "[]", "", " \n"):
        raw = text.encode("utf-8")
        want = [x for x in records.parse_json(raw)]
        for size in (1, 2, 7, 64, 10_000):
            assert list(archives.streamed(io.BytesIO(raw), size)) == want


def test_long_members_take_little_memory(tmp_path):
    path = tmp_path / "long.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open("all.json", "w") as member:
        member.write(b"[")
        for i in range(30_000):
            member.write((b"," if i else b"") + json.dumps({"JID": str(i), "JFULL": "x" * 3000}).encode())
        member.write(b"]")
    tracemalloc.start()
    with open(path, "rb") as file:
        n = sum(1 for _ in archives.members_of(file, 1 << 20))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 30_000 and peak < 12 << 20  # of 90 MB


def test_a_bad_member_costs_itself_alone(tmp_path):
    path = tmp_path / "bad.zip"
    write(path, {"1.json": json.dumps(rows(400)), "2.json": json.dumps(rows(2, 500))})
    raw = bytearray(path.read_bytes())
    raw[200:260] = b"\0" * 60  # within the first member's data
    assert [x["JID"] for x in archives.members_of(io.BytesIO(bytes(raw)))] == ["J500", "J501"]
