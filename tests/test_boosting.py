"""Boosted heads, their attributions, and evaluation by fold, against plain versions."""

from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from corvia.operators import boosting as b, evaluation, explain, models, statute
from corvia.plans import model_queries


def rows_of(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 6, n), rng.normal(0, 1, n), rng.random(n), rng.integers(0, 2, n)]).astype(float)
    y = 10 * x[:, 0] + 5 * x[:, 1] * x[:, 3] + rng.exponential(4, n)
    data = [(int(i), *map(float, r), float(v), int(v > 45), f"{20200101 + i // 40}") for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, d double, sentence_months double, _probation int, day string")


COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def trained(spark):
    rows = rows_of(spark).withColumns({"rank": F.col("id"), "key": F.xxhash64("id"), "y": F.col("sentence_months"), "p": F.col("_probation")})
    bins = b.learn_bins(rows, COLUMNS)
    ready = b.binned(rows, bins).cache()
    heads = [b.Head(str(a), 0, a, 3, 2000, 2400) for a in (0.25, 0.5, 0.75)] + [b.Head("p", 0, None, 3, 2000, 2400)]
    return ready, bins, b.train(ready, bins, heads, rounds=15, depth=3, rate=0.3)


def test_quantile_heads_beat_leaf_quantiles(spark, trained):
    ready, bins, found = trained
    late = ready.where("rank >= 2400").select(*COLUMNS, "x", "y").toPandas()
    x, y = np.frombuffer(b"".join(map(bytes, late.x)), dtype=np.uint8).reshape(-1, 4), late.y.to_numpy()
    whole = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(ready)
    early, rest = whole.where("rank < 2000"), whole.where("rank >= 2400")
    tree = DecisionTreeRegressor(labelCol="y", maxDepth=3, leafCol="leaf", minInstancesPerNode=5, seed=1).fit(early)
    for m in found[:3]:
        a = m.head.alpha
        leaves = tree.transform(early).groupBy("leaf").agg(F.percentile("y", a).alias("q"))
        plain = tree.transform(rest).join(leaves, "leaf").select("y", "q").toPandas()
        mine, theirs = b.loss(m.head, y, None, m.predict(x)).mean(), b.loss(m.head, plain.y.to_numpy(), None, plain.q.to_numpy()).mean()
        assert mine <= theirs and abs((y <= m.predict(x)).mean() - a) < 0.12
    q = [m.predict(x) for m in found[:3]]
    assert ((q[0] > q[1] + 1e-6) | (q[1] > q[2] + 1e-6)).mean() < 0.2


def test_probability_head(trained):
    ready, bins, found = trained
    late = ready.where("rank >= 2400").select("x", "p").toPandas()
    s = found[3].predict(np.frombuffer(b"".join(map(bytes, late.x)), dtype=np.uint8).reshape(-1, 4))
    assert ((s > 0) & (s < 1)).all() and ((s >= 0.5) == (late.p == 1)).mean() > 0.9 and abs(s.mean() - late.p.mean()) < 0.05


def test_training_does_not_hang_on_partitions(spark, trained):
    ready, bins, found = trained
    again = b.train(ready.repartition(7), bins, [m.head for m in found[:2]], rounds=3, depth=2)
    more = b.train(ready.coalesce(1), bins, [m.head for m in found[:2]], rounds=3, depth=2)
    for m, n in zip(again, more, strict=True):
        assert len(m.trees) == len(n.trees)
        for t, u in zip(m.trees, n.trees, strict=True):
            assert (t.feature == u.feature).all() and (t.bin == u.bin).all() and np.allclose(t.value, u.value)


def test_later_rows_are_never_seen(spark, trained):
    ready, bins, found = trained
    changed = ready.withColumn("y", F.when(F.col("rank") >= 2400, 1e6).otherwise(F.col("y")))
    again = b.train(changed, bins, [m.head for m in found[:1]], rounds=2, depth=2)
    same = b.train(ready.withColumn("y", F.when(F.col("rank") == 2400, 1e6).otherwise(F.col("y"))), bins, [m.head for m in found[:1]], rounds=2, depth=2)
    assert [t.value.tolist() for t in again[0].trees] == [t.value.tolist() for t in same[0].trees]


def test_attributions_add_up_and_equal_all_orders(trained):
    ready, bins, found = trained
    late = ready.limit(40).select("x").toPandas()
    x = np.frombuffer(b"".join(map(bytes, late.x)), dtype=np.uint8).reshape(-1, 4)
    for m in (found[1], found[3]):
        each = explain.attributions(m, x)
        assert np.abs(explain.base_value(m) + each.sum(axis=1) - m.raw(x)).max() < 1e-9
        for row in range(5):
            plain = np.zeros(4)
            for order in permutations(range(4)):
                known: set[int] = set()
                before = explain.expectation(m, x[row], known)
                for f in order:
                    known = known | {f}
                    now = explain.expectation(m, x[row], known)
                    plain[f] += (now - before) / 24
                    before = now
            assert np.abs(plain - each[row]).max() < 1e-9
            assert explain.expectation(m, x[row], set(range(4))) == pytest.approx(m.raw(x[row : row + 1])[0], abs=1e-9)


def test_explained_rows_name_the_largest_first(spark, trained):
    ready, bins, found = trained
    rows = explain.explained(ready.select("id", "x"), found[1], bins).select("*", explain.top_contributions(COLUMNS, top=2).alias("top")).limit(50).collect()
    for r in rows:
        assert r.base_value + sum(r.contributions) == pytest.approx(r.predicted_raw, abs=1e-9)
        order = sorted(range(4), key=lambda i: (-abs(r.contributions[i]), i))[:2]
        assert [(t.name, t.contribution) for t in r.top] == [(COLUMNS[i], r.contributions[i]) for i in order]


def test_small_runs_hold_nothing_back(spark):
    assert models.held_back(49) == 49 and models.held_back(100) == 85
    rows = rows_of(spark, 40)
    bundle = models.train(rows, COLUMNS, ("day", ["id"]), rounds=3, depth=2)
    assert bundle.metadata["delta25"] == bundle.metadata["delta75"] == 0.0 and len(bundle.heads["p50-0"].trees) == 3
    assert not bundle.metadata["calibrated"]


def test_shift_puts_its_share_of_the_tail_below(spark):
    rows = rows_of(spark, 1000)
    bundle = models.train(rows, COLUMNS, ("day", ["id"]), rounds=4, depth=2)
    found = models.predict(bundle, rows, F.lit(None).cast("struct<min_months:double,max_months:double>")).where("id >= 850").toPandas()
    for k, a in models.QUANTILES.items():
        assert (found.sentence_months <= found[k] + 1e-9).mean() == pytest.approx(a, abs=0.01)


def test_fold_report_equals_sql_over_its_predictions(spark):
    rows = rows_of(spark, 1500)
    c = F.when(F.col("a") > 0, statute.constraint(12.0, 40.0))
    found = evaluation.predictions(rows, COLUMNS, c, ("day", ["id"]), rounds=5, depth=2)
    tested = found.withColumns({"lo": F.col("constraint.min_months"), "hi": F.col("constraint.max_months")}).drop("constraint").toPandas()
    assert sorted(tested.id) == list(range(250, 1500)) and set(tested.fold) == set(range(5))
    assert (tested.p25 <= tested.p50).all() and (tested.p50 <= tested.p75).all()
    want = duckdb.sql("""
      SELECT fold, count(*) AS n, avg(abs(y - p50)) AS mae, avg(abs(y - raw50)) AS raw_mae, sqrt(avg((y - p50) ** 2)) AS rmse,
        1 - sum((y - p50) ** 2) / (var_pop(y) * count(*)) AS r2, avg((abs(y - p50) <= 3)::INT) AS hit3, avg((abs(y - p50) <= 6)::INT) AS hit6,
        avg(greatest(0.25 * (y - p25), -0.75 * (y - p25))) AS pinball25, avg(greatest(0.5 * (y - p50), -0.5 * (y - p50))) AS pinball50,
        avg(greatest(0.75 * (y - p75), -0.25 * (y - p75))) AS pinball75, avg((y BETWEEN p25 AND p75)::INT) AS coverage,
        count(*) FILTER (raw25 > raw50 + 1e-6 OR raw50 > raw75 + 1e-6) AS crossed, count(*) FILTER (clipped) AS n_clipped,
        count(lo) AS n_constrained, count(*) FILTER (y < lo - 1e-6 OR y > hi + 1e-6) AS bad_truth, count(*) FILTER (raw50 < lo - 1e-6 OR raw50 > hi + 1e-6) AS bad_raw,
        count(*) FILTER (p50 < lo - 1e-6 OR p50 > hi + 1e-6) AS bad_final, avg(abs(y - guess)) AS median_baseline_mae,
        avg(p) FILTER (probability IS NOT NULL) AS probation_base, avg((probation = (p = 1))::INT) AS probation_accuracy,
        coalesce(count(*) FILTER (probation AND p = 1) / nullif(count(*) FILTER (probation), 0), 0) AS probation_precision,
        coalesce(count(*) FILTER (probation AND p = 1) / nullif(count(*) FILTER (p = 1 AND probability IS NOT NULL), 0), 0) AS probation_recall
      FROM tested GROUP BY GROUPING SETS ((fold), ()) ORDER BY fold NULLS LAST""").df()
    got = evaluation.report(found).toPandas().sort_values("fold", na_position="last").reset_index(drop=True)
    assert len(got) == 6 and (got.bad_final == 0).all() and got.n.tolist() == want.n.tolist()
    for column in want.columns:
        assert np.allclose(got[column].astype(float), want[column].astype(float), equal_nan=True), column
    # What a fold knows comes from earlier rows alone.
    plain = rows.toPandas().sort_values("id")
    for k, mine in tested.groupby("fold"):
        known = plain.sentence_months[: int(mine.id.min())]
        assert mine.guess.unique() == pytest.approx(np.median(known))


def test_no_folds_no_rows(spark):
    found = evaluation.predictions(rows_of(spark, 20), COLUMNS, F.lit(None).cast("struct<min_months:double,max_months:double>"), ("day", ["id"]))
    assert found.count() == 0 and evaluation.report(found).where("fold IS NOT NULL").count() == 0


def test_explained_query_covers_all_cases(spark):
    rows = model_queries.explained_cases(spark, "/root/testdata/sf0.001")
    bad = rows.where(F.abs(F.col("explained") - F.col("predicted_raw")) > 1e-9).count()
    n = model_queries.training(spark, "/root/testdata/sf0.001").count()
    assert bad == 0 and rows.count() == n


def test_passes_move_blocks_and_sums_equal_plain_ones(trained):
    ready, bins, found = trained
    assert b._packed(ready, 4, 4).count() == 1  # 3000 rows
    sizes = [len(e) + 1 for e in bins.edges]
    assert b.grouped([2, 2, 32, 32, 9], 1024) == [[0, 1, 2], [3, 4]]
    rng = np.random.default_rng(5)
    n, fit = 3000, 2000
    x = np.column_stack([rng.integers(0, s, n) for s in sizes]).astype(np.uint8)
    y, p, f = rng.random(n) * 50, rng.integers(0, 2, n).astype(np.uint8), rng.random(n) * 50
    block = b.Block(np.arange(n), rng.integers(0, 1 << 60, n), y, p, np.asfortranarray(x), None)
    for m in (0, 3):
        h, most = found[m].head, max(sizes)
        sums = b.Histograms([t.trees[0] for t in found], 1, sizes, most, 2, 0.8)
        sums.add(block, m, h, f[:fit], fit)
        t, mine = found[m].trees[0], b._drawn(h, block.key[:fit], 2, 0.8)
        side = x[:fit, t.feature[0]] > t.bin[0]
        got = {node: (g, w) for _, node, g, w in sums.rows()}
        for node, at in ((1, mine & ~side), (2, mine & side)):
            want = [np.zeros(4 * most, dtype=np.int64) for _ in range(2)]
            for into, v in zip(want, b._gradient(h, y[:fit][at], p[:fit][at].astype(bool), f[:fit][at]), strict=True):
                for j in range(4):
                    np.add.at(into, j * most + x[:fit][at, j], np.round(v * b.UNIT).astype(np.int64))
            assert (got[node][0] == want[0]).all() and (got[node][1] == want[1]).all()


def test_explained_query_trains_only_its_own_head(spark, monkeypatch):
    heads, plain = [], models.boost
    monkeypatch.setattr(models, "boost", lambda ready, bins, of, **k: heads.append([h.name for h in of]) or plain(ready, bins, of, **k))
    sf = "/root/testdata/sf0.001"
    in_order = lambda rows: sorted(rows, key=lambda r: (r.case_id, r.predicted_raw))
    got = in_order(model_queries.explained_cases(spark, sf).collect())
    assert heads == [["p50-0"]]
    bundle = model_queries.trained(spark, sf)
    rows = b.binned(model_queries.training(spark, sf), bundle.bins).select("case_id", "x")
    want = explain.explained(rows, bundle.heads["p50-0"], bundle.bins).select("*", explain.top_contributions(model_queries.COLUMNS).alias("top")).collect()
    for r, mine in zip(in_order(want), got, strict=True):
        assert (mine.case_id, mine.base_value, mine.predicted_raw, mine.top_contributions) == (r.case_id, r.base_value, r.predicted_raw, r.top)
        assert mine.explained == pytest.approx(r.base_value + sum(r.contributions), abs=1e-12)


def test_rows_are_explained_once_a_kind(trained):
    ready, bins, found = trained
    late = ready.limit(500).select("x").toPandas()
    x = np.frombuffer(b"".join(map(bytes, late.x)), dtype=np.uint8).reshape(-1, 4)
    first, place = explain._kinds(found[1], np.vstack([x, x]))
    assert len(first) < 500 and np.array_equal(place[:500], place[500:])
    assert np.allclose(explain.attributions(found[1], x), explain.attributions(found[1], x[first])[place[:500]], rtol=0, atol=1e-12)


def test_passes_work_on_kinds_and_add_up_as_on_rows(spark, trained):
    ready, bins, found = trained
    heads = [found[0].head, b.Head("0.5", 1, 0.5, 3, 1000, 1200), b.Head("p1", 1, None, 4, 1200, 1300, 1.5), found[3].head]
    rows = ready.where("rank < 2400").withColumns({"x": F.expr("case when rank % 2 = 0 then x else x'00010203' end"), "y": F.floor("y").cast("double")})
    cuts = b.cuts_of(heads)
    assert cuts == [1000, 1200, 1300, 2000, 2400]
    packed = b._packed(rows.select("rank", "key", "y", F.col("p").cast("int").alias("p"), "x"), 4, 4, cuts)
    blocks = list(b._blocks(iter(packed.toArrow().to_batches()), 4, 4, cuts))
    flat = rows.orderBy("rank").select("rank", "key", "y", "p", "x").toPandas()
    x = np.asfortranarray(np.frombuffer(b"".join(map(bytes, flat.x)), dtype=np.uint8).reshape(-1, 4))
    plain = b.Block(flat["rank"].to_numpy(), flat["key"].to_numpy(), flat["y"].to_numpy(), flat["p"].to_numpy().astype(np.uint8), x, None)
    kinds = len(flat.assign(x=flat.x.map(bytes)).groupby(["x", "y", "p"]))
    assert sum(len(k.y) for k in blocks) == kinds < 1400 and sum(len(k.key) for k in blocks) == 2400
    sizes = [len(e) + 1 for e in bins.edges]
    trees = [t.trees[0] for t in (found[0], found[1], found[3], found[3])]
    for make in (lambda: b.Histograms(trees, 1, sizes, max(sizes), 2, 0.8), lambda: b.LeafSums(trees, 50.0, 2, 0.8)):
        got = []
        for of in (blocks, [plain]):
            sums = make()
            for block in of:
                block.drawn.clear()
                for m, h in enumerate(heads):
                    tail = block.upto(h.tail)
                    f = b._running(block, m, 20.0 if h.alpha else 0.1, [[trees[0]] * 4], tail)
                    sums.add(block, m, h, f[: block.upto(h.fit)], block.upto(h.fit))
                    if isinstance(sums, b.Histograms):
                        sums.late(block, m, h, f)
            got.append({(m, node): (g.tolist(), w.tolist()) for m, node, g, w in sums.rows()})
        assert got[0] == got[1] and len(got[0]) >= 8


def test_edges_of_few_values_are_counted(spark, monkeypatch):
    rows = spark.range(6400).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 10 > 0, (F.col("id") % 100 == 1).cast("int")).alias("b"), F.when(F.col("id") % 3 > 0, 1.5).otherwise(float("nan")).alias("c"), F.lit(None).cast("int").alias("d"), F.lit(4).alias("e"), F.col("id").alias("wide"))
    sketched, plain = [], F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, *a: sketched.append(c) or plain(c, *a))
    got = b.learn_bins(rows, rows.columns)
    assert len(sketched) == 2 and sketched == ["c3", "c5"]  # the one without values, and the one with many
    share = [i / 32 for i in range(1, 33)]
    for c, edges in zip(rows.columns, got.edges, strict=True):
        want = rows.agg(plain(F.col(c).cast("double"), share, 10_000)).first()[0] or []
        assert edges.tolist() == sorted({v for v in want if v == v})[:-1]


def test_median_heads_start_from_exact_quantiles(spark):
    rows = spark.range(20_000).select(F.col("id").alias("rank"), (F.col("id") * 7919 % 20_011).cast("double").alias("y"), (F.col("id") % 3 == 0).cast("int").alias("p"))
    heads = [b.Head("a", 0, 0.25, 1, 500, 600), b.Head("b", 1, 0.75, 1, 15_001, 20_000), b.Head("p", 1, None, 1, 15_001, 20_000)]
    base, span = b._starts(rows, heads)
    y = np.arange(20_000) * 7919 % 20_011
    for h, v in zip(heads[:2], base, strict=False):
        assert v == np.sort(y[: h.fit])[int(np.ceil(h.alpha * h.fit)) - 1]
    assert base[2] == pytest.approx(np.log(5001 / 10_000)) and span == y.max() - y.min()


def test_leaves_equal_a_walk_down_the_tree():
    rng = np.random.default_rng(4)
    x = np.asfortranarray(rng.integers(0, 32, (500, 6)).astype(np.uint8))
    for depth in (1, 3, 9):  # 512 leaves are more than a byte tells apart
        n = 2**depth - 1
        t = b.Tree(rng.integers(0, 6, n), np.where(rng.random(n) < 0.2, 255, rng.integers(0, 31, n)), np.ones(2 * n + 1), rng.normal(0, 1, n + 1), np.zeros(n))
        want = []
        for row in x:
            node = 0
            while node < n:
                node = 2 * node + 1 + int(t.bin[node] != 255 and row[t.feature[node]] > t.bin[node])
            want.append(node - n)
        assert t.leaves(x).tolist() == want and t.predict(x).tolist() == t.value[want].tolist()


def test_only_bins_go_to_python_for_scores(spark, trained):
    ready, bins, found = trained
    out = models.scored(ready.select("id", "day", "x"), {"m": found[1], "p": found[3]}, 4)
    plan = out._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    got = out.where("id < 300").orderBy("id").toPandas()
    x = np.frombuffer(b"".join(map(bytes, got.x)), dtype=np.uint8).reshape(-1, 4)
    assert got.columns.tolist() == ["id", "day", "x", "m", "p"]
    assert got.m.tolist() == found[1].predict(x).tolist() and got.p.tolist() == found[3].predict(x).tolist()


def test_ranks_are_written_and_passes_keep_cores_busy(spark, monkeypatch):
    rows = rows_of(spark, 800)
    ready, bins, n = models.prepared(rows, COLUMNS, ("day", ["id"]), lambda n: [100, 333, n])
    assert n == 800 and "CASE WHEN" not in ready._jdf.queryExecution().optimizedPlan().toString()
    seen, plain = [], b._pass
    monkeypatch.setattr(b, "_pass", lambda state, *a: seen.append(state.sparkSession.conf.get(b.LEAST_PARTS, None)) or plain(state, *a))
    b.train(ready, bins, [b.Head("a", 0, 0.5, 1, 333, 800)], rounds=1, depth=1)
    assert set(seen) == {str(4 * spark.sparkContext.defaultParallelism)} and spark.conf.get(b.LEAST_PARTS, None) is None
