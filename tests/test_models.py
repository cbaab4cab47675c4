"""The heads on made rows: order, ranges, saving."""

from pyspark.sql import functions as F

from corvia.operators import models, statute


def test_heads_predict_within_ranges(spark, tmp_path):
    i = F.col("id")
    rows = spark.range(400).select(
        i.cast("string").alias("jid"), F.format_string("2020%02d%02d", i % 12 + 1, i % 28 + 1).alias("_jdate"),
        (i % 5).cast("int").alias("level"), (i % 3).cast("int").alias("counts"),
        ((i % 5) * 10 + (i % 3) * 2 + 6).cast("double").alias("sentence_months"), (i % 15 == 0).cast("int").alias("_probation"),
    )
    bundle = models.train(rows, ["level", "counts"], rounds=5, depth=3)
    c = F.when(F.col("level") > 0, statute.constraint(12.0, 30.0))
    got = models.predict(bundle, rows, c).collect()
    assert len(got) == 400
    for r in got:
        assert not r.rule_applied or 12 <= r.p25 <= r.p50 <= r.p75 <= 30
        assert r.rule_applied == (r.level > 0)
    assert models.importances(bundle)[0][0] == "level"
    models.save(spark, bundle, str(tmp_path / "m"))
    again = models.predict(models.load(spark, str(tmp_path / "m")), rows, c).orderBy("jid").collect()
    assert [r.p50 for r in again] == [r.p50 for r in sorted(got, key=lambda r: r.jid)]
