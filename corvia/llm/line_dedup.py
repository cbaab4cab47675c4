"""Cross-site boilerplate lines, in DataFrame operations only.

The spread of a line is the number of distinct sites that show it. HyperLogLog sketches of the sites,
one per line hash (two independent hashes of 64 bits, so that foreign lines do not meet among 10^12), merge in the partial aggregation, so a line that stands in a third of all documents
costs one small sketch per task. Lines whose estimate is within `margin` of the threshold get the exact
distinct count; margin is several standard errors of the sketch, so the others need none. Lines at or
over the threshold are boilerplate and go from every document but the one with the smallest doc_id that
shows them, which keeps the text in the corpus once.

Defined results: null text has no lines and stays null; empty lines and lines of fewer than `min_words`
words are never boilerplate; a null site counts as a site of its own; rows with a null doc_id come after
all others when the keeper is chosen; repeated rows are edited each; empty input gives no rows; other
columns pass through, whatever their names (of dedup_lines: but own columns n_lines and n_removed, which it replaces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvia.llm.store import materialise

LINE = "\n"


def _hash(line):
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _lines(docs: DataFrame, site: str, min_words: int) -> DataFrame:
    """A row for each distinct line of a document that is long enough: id, site, hash."""
    enough = rf"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){{{min_words - 1}}}[^\x20\x09-\x0D]"
    parts = F.filter(F.array_distinct(F.split("text", LINE)), lambda x: x.rlike(enough))
    hashes = F.transform(parts, _hash)
    return docs.select(
        F.col("doc_id").alias("id"), F.coalesce(F.col(f"`{site}`"), F.lit("\0")).alias("site"), F.explode(hashes).alias("hash")
    )


def boilerplate(lines: DataFrame, min_sites: int, margin: float, log_k: int) -> DataFrame:
    """id, site, hash -> hash, keeper of the lines that at least min_sites distinct sites show."""
    spread = lines.groupBy("hash").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log_k))).alias("estimate"),
        F.min(F.when(F.col("id").isNotNull(), F.col("id"))).alias("keeper"),
    )
    spread = materialise(spread.where(F.col("estimate") >= min_sites * (1 - margin)), "line-spread")
    sure = spread.where(F.col("estimate") > min_sites * (1 + margin))
    near = spread.where(F.col("estimate") <= min_sites * (1 + margin)).select("hash", "keeper")
    exact = (
        lines.join(near, "hash", "left_semi").select("hash", "site").distinct()
        .groupBy("hash").agg(F.count("*").alias("n_sites")).where(F.col("n_sites") >= min_sites)
    )
    return sure.select("hash", "keeper").unionByName(near.join(exact.select("hash"), "hash", "left_semi"))


def _edited(docs: DataFrame, site: str, min_sites: int, min_words: int, margin: float, log_k: int) -> DataFrame:
    """d (the document), text without boilerplate lines, n_lines, n_removed."""
    lines = materialise(_lines(docs, site, min_words), "lines")
    common = boilerplate(lines, min_sites, margin, log_k)
    hits = (
        lines.join(common, "hash").where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id").agg(F.collect_set("hash").alias("_hits"))
    )
    # The document is one column beside the join's own, so names cannot clash.
    joined = docs.select(F.struct("*").alias("d")).join(hits.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.id")), "left")
    whole = F.col("d.text")
    parts = F.split(whole, LINE)
    # A boilerplate hash belongs to a line that is long enough, so shorter lines need no second test.
    kept = F.filter(parts, lambda x: ~F.array_contains(F.col("h._hits"), _hash(x)))
    none = F.col("h._hits").isNull()
    n_lines = F.when(whole.isNull(), 0).otherwise(F.size(parts))
    n_kept = F.when(none, n_lines).otherwise(F.size(kept))
    return joined.select(
        "d", F.when(none, whole).otherwise(F.array_join(kept, LINE)).alias("text"),
        n_lines.cast("long").alias("n_lines"), (n_lines - n_kept).cast("long").alias("n_removed"),
    )


def dedup_lines(
    docs: DataFrame, site: str = "source", min_sites: int = 3, min_words: int = 3, margin: float = 0.25, log_k: int = 11
) -> DataFrame:
    """docs with two more columns, n_lines and n_removed, and text without boilerplate lines."""
    own = [F.col("d").getField(c).alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return _edited(docs, site, min_sites, min_words, margin, log_k).select(*own, "text", "n_lines", "n_removed")


def without_boilerplate(
    docs: DataFrame, site: str = "source", min_sites: int = 3, min_words: int = 3, margin: float = 0.25, log_k: int = 11
) -> DataFrame:
    """docs, in their own columns, without boilerplate lines; n_chars, if there, is counted anew where lines went.

    Documents of which nothing but white space is left go with their lines; those that had no more before stay.
    """
    rows = _edited(docs, site, min_sites, min_words, margin, log_k)
    changed = F.col("n_removed") > 0
    columns = []
    for field in docs.schema:
        own = F.col("d").getField(field.name)
        if field.name == "text":
            own = F.col("text")
        elif field.name == "n_chars":
            own = F.when(changed, F.length("text").cast(field.dataType)).otherwise(own)
        columns.append(own.alias(field.name))
    return rows.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*columns)
