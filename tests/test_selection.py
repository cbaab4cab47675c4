"""Order statistics and running sums of groups that are cut into ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvia.operators import folds, metrics, selection


@pytest.mark.parametrize("limit", [200_000, 50])
def test_percentiles_equal_numpy(spark, limit):
    rng = np.random.default_rng(1)
    groups = {
        "wide": (10 ** rng.uniform(-300, 300, 3000)).tolist(), "ties": [7.0] * 2500 + rng.normal(7, 1, 500).tolist(), "one": [3.0],
        "two": [1.0, 2.0], "same": [5.0] * 400, None: rng.normal(0, 1, 997).tolist(), "some": [None] * 9 + [1.0, 4.0, 9.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None)]
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r.g: r for r in selection.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", shares, limit).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        known = [v for v in vs if v is not None]
        assert got[g].n == len(known)
        assert got[g].percentiles == pytest.approx(np.quantile(known, shares).tolist(), rel=1e-12)


def test_whole_table_and_empty_table(spark):
    df = spark.range(1, 1002).withColumn("v", F.col("id").cast("double"))
    (r,) = selection.percentiles(df, [], "v", [0.5], 20).collect()
    assert r.percentiles == [501.0] and r.n == 1001
    assert selection.percentiles(df.limit(0), [], "v", [0.5]).count() == 0


@pytest.mark.parametrize("limit", [10, 10**6])
def test_average_precision_in_ranges(spark, limit):
    rng = np.random.default_rng(4)
    rows = [("distinct", float(s), bool(p)) for s, p in zip(rng.permutation(2000) / 2000, rng.random(2000) < 0.3)]
    rows += [("ties", float(s), bool(p)) for s, p in zip(rng.integers(0, 5, 900), rng.random(900) < 0.4)] + [("none", 0.5, False), (None, 0.5, True)]
    got = {r.g: r.average_precision for r in metrics.average_precision(spark.createDataFrame(rows, "g string, s double, p boolean"), ["g"], "s", "p", limit).collect()}

    def plain(mine):
        mine = sorted(mine, key=lambda r: -r[1])
        total, seen, hits, out = sum(r[2] for r in mine), 0, 0, 0.0
        for s in sorted({r[1] for r in mine}, reverse=True):
            same = [r for r in mine if r[1] == s]
            seen, hits = seen + len(same), hits + sum(r[2] for r in same)
            out += sum(r[2] for r in same) * hits / seen
        return out / total if total else None

    for g in ("distinct", "ties", "none", None):
        want = plain([r for r in rows if r[0] == g])
        assert got[g] == (None if want is None else pytest.approx(want, rel=1e-12))


def test_rows_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(5000).mapInArrow(count, "id long").withColumn("v", F.col("id") % 997)
    (r,) = selection.percentiles(rows, [], "v", [0.5], limit=50).collect()
    assert r.n == 5000 and r.percentiles == [496.5] and seen.value == 5000


def test_tail_ranks_only_the_date_on_which_it_begins(spark):
    rows = [(f"d{i // 300}" if i >= 300 else None, i, float(i * 7 % 1000), 0.0) for i in range(1500)]
    df = spark.createDataFrame(rows, "day string, id long, y double, p double").repartition(5)
    found = folds.tail_shift(df, "day", ["id"], "y", "p", 0.5)
    tail = sorted(r[2] for r in rows[1275:])
    (r,) = found.collect()
    assert (r.n_tail, r["shift"]) == (225, tail[112])
    ranked = []
    plain = folds.with_rank
    try:
        folds.with_rank = lambda d, *a: ranked.append(d.count()) or plain(d, *a)
        folds.tail_shift(df, "day", ["id"], "y", "p", 0.5).collect()
    finally:
        folds.with_rank = plain
    assert ranked == [300]


def test_sides_of_cuts_equal_ranks_and_only_their_dates_are_ranked(spark, monkeypatch):
    i = F.col("id")
    rows = spark.range(5000).select(i, F.when(i % 50 > 0, F.format_string("2020%04d", i * 37 % 40)).alias("day"), (i * 7919 % 5003).alias("tie"))
    want = {r.id: r["rank"] for r in folds.with_rank(rows, "day", ["tie"]).collect()}
    edges = sorted(v for v in {r["_n"] for r in rows.groupBy("day").agg(F.count("*").alias("_n")).collect()})
    ranked, plain = [], folds.with_rank
    monkeypatch.setattr(folds, "with_rank", lambda d, *a: ranked.append(d.count()) or plain(d, *a))
    for cuts in ([0, 50, 100, 2017, 2018, 4999, 5000], [100], [], [edges[0]], [777, 900, 901]):
        got, n = folds.with_sides(rows, "day", ["tie"], lambda n: cuts)
        found = {r.id: r["rank"] for r in got.collect()}
        assert n == 5000 and len(found) == 5000
        for c in cuts:
            assert all((found[k] < c) == (want[k] < c) for k in found)
    assert len(ranked) >= 2 and max(ranked) < 1000
    one, n = folds.with_sides(rows.withColumn("day", F.lit("20230101")), "day", ["tie"], lambda n: [10, 4000])
    assert sorted(r["rank"] for r in one.collect()) == list(range(5000))
