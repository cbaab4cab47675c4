"""The registry of outliers: projection, triage, refresh that keeps what people wrote, resuming, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvia.operators.folds import with_rank

# Behaviors that count as heavy, and what the categories say.
HEAVY = ("販賣", "運輸", "製造", "意圖販賣而持有", "轉讓")
REASONS = {
    "aggregate_51": "數罪併罰 / 應執行刑 — 單罪刑度區間無法約束合併刑(§51),此列 y_true 是合併後總刑,本就不該被單罪模型預測。",
    "missing_reduction": "重罪實判遠低於預測 — 疑漏抓 §59/§17 減刑,或多被告判決中他人之減刑討論被全文偵測誤算到本案。",
    "missing_feature": "重罪實判遠高於預測 — 決定刑度的加重因子(純質淨重、共犯角色、下游規模、犯次)尚未結構化抽取。",
    "rule_table_gap": "持有純質淨重加重型(§11Ⅴ/Ⅵ)未完整建表,法定刑度區間偏低。",
    "label_or_variance": "抽取無明顯錯誤 — 疑為標籤雜訊(OCR / 附件刑度)或法官個案裁量之天然變異,模型未必有錯。",
}
CATEGORIES = tuple(REASONS)
# Where a judgment is looked up, what people fill in, the columns in front.
JUDGMENT = "https://judgment.judicial.gov.tw/FJUD/data.aspx?ty=JD&id="
HUMAN = ("verdict_category", "action", "reviewer", "reviewed_date", "notes")
FRONT = (
    "jid", "jdate", "court", "convicted_behaviors", "convicted_levels", "weight_g", "y_true", "y_pred_p50", "y_pred_p25", "y_pred_p75",
    "signed_residual", "abs_residual", "in_band", "flags", "suspected_category", "verdict_category", "action", "reviewer", "reviewed_date",
    "notes", "suspected_reason", "dropped_from_topk", "jurl",
)


def residuals(df: DataFrame, y: str, p25: str, p50: str, p75: str) -> DataFrame:
    signed = F.col(p50) - F.col(y)
    return df.withColumns({
        "abs_residual": F.abs(signed), "signed_residual": signed, "in_band": F.col(y).between(F.col(p25) - 1e-6, F.col(p75) + 1e-6),
    })


def top_outliers(df: DataFrame, k: int, key: str, by: str = "abs_residual") -> DataFrame:
    return df.orderBy(F.desc(by), key).limit(k)


def triage(joint: Column, n_counts: Column, behavior: Column, residual: Column, weight_g: Column, heavy: tuple[str, ...] = HEAVY, holding: str = "持有") -> Column:
    is_heavy = behavior.isin(*heavy)
    return (
        F.when(joint | (n_counts > 1), CATEGORIES[0])
        .when(is_heavy & (residual > 6), CATEGORIES[1])
        .when(is_heavy & (residual < -6), CATEGORIES[2])
        .when((behavior == holding) & (F.coalesce(weight_g, F.lit(0.0)) > 0), CATEGORIES[3])
        .otherwise(CATEGORIES[4])
    )


def flags_text(flags: dict[str, Column]) -> Column:
    return F.concat_ws(",", *(F.when(c, F.lit(name)) for name, c in flags.items()))


def reason_of(category: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv)), category)


def judgment_url(jid: Column) -> Column:
    """The link with the id percent-encoded (slashes stay); empty without an id."""
    coded = F.replace(F.replace(F.replace(F.replace(F.url_encode(jid), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when(F.coalesce(jid, F.lit("")) == "", "").otherwise(F.concat(F.lit(JUDGMENT), coded))


def registered(outliers: DataFrame, category: Column, flags: dict[str, Column]) -> DataFrame:
    """outliers with category, its reason, flags, link, and blanks for people to fill in, in the order of the registry."""
    out = outliers.withColumn("suspected_category", category)
    out = out.withColumns({
        "suspected_reason": reason_of(F.col("suspected_category")), "flags": flags_text(flags), "jurl": judgment_url(F.col("jid")),
        **{c: F.lit("") for c in HUMAN},
    })
    first = [c for c in FRONT if c in out.columns]
    return out.select(*first, *(c for c in out.columns if c not in first))


def refresh(fresh: DataFrame, old: DataFrame, key: str, human: list[str]) -> DataFrame:
    """fresh rows with the human columns of old ones (else empty), and old rows that are no longer fresh, marked."""
    notes = old.dropDuplicates([key]).select(key, *(F.col(c).alias(f"_{c}") for c in human))
    kept = fresh.join(notes, key, "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.lit("")) for c in human})
    kept = kept.drop(*(f"_{c}" for c in human)).withColumn("dropped", F.lit(False))
    gone = old.join(fresh.select(key), key, "left_anti").withColumn("dropped", F.lit(True))
    return kept.unionByName(gone, allowMissingColumns=True)


def pending(work: DataFrame, done: DataFrame, key: str, limit: int = 0) -> DataFrame:
    """What is not done yet, by key; the first `limit`, or all for 0."""
    left = work.join(done.select(key).distinct(), key, "left_anti")
    return left.orderBy(key).limit(limit) if limit else left


def last_by_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the last in the order given."""
    w = W.partitionBy(*key).orderBy(*(c.desc() for c in order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def override(df: DataFrame, changes: DataFrame, key: str, fields: list[str], note: str) -> DataFrame:
    """Fields replaced where a change has one; the note replaced wherever there is a change."""
    marked = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in [*fields, note]))
    out = df.join(marked, F.col(key) == F.col("_key"), "left")
    out = out.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields})
    out = out.withColumn(note, F.when(F.col("_key").isNull(), F.col(note)).otherwise(F.col(f"_{note}")))
    return out.select(df.columns)


def shards(df: DataFrame, date: str, tie: list[str], edges: list[int], name: str = "shard") -> DataFrame:
    """df with a position by date, then tie, and the shard whose range of positions has it (edges: first positions)."""
    placed = with_rank(df, date, tie, "position")
    shard = F.lit(0)
    for i, at in enumerate(edges[1:], 1):
        shard = F.when(F.col("position") >= at, i).otherwise(shard)
    return placed.withColumn(name, shard)


def token_costs(
    df: DataFrame, by: list[str], prices: dict[str, float], latency: str, fresh: str = "input_tokens", cached: str = "cache_read_tokens"
) -> DataFrame:
    """Tokens of each kind, cost at prices a million, mean latency of those above 0, percentage of input read from the cache."""
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in prices]
    out = df.groupBy(*by).agg(F.count("*").alias("n"), *sums, F.avg(F.nullif(F.col(latency), F.lit(0.0))).alias("mean_latency"))
    cost = sum((F.col(c) * price for c, price in prices.items()), F.lit(0.0)) / 1e6
    out = out.withColumn("cost_usd", cost)
    if cached not in prices:
        return out
    return out.withColumn("cache_percent", 100 * F.col(cached) / F.greatest(F.lit(1), F.col(fresh) + F.col(cached)))
