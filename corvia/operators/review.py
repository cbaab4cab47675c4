"""What people look at: label sheets, suspicious cases, summaries; the filters before them and the counts after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvia.functions import text
from corvia.operators import statute
from corvia.operators.registry import last_by_key
from corvia.operators.training import COURT_CODES

# Cells of a label sheet; months that a charge has at least before reductions, by level; behaviors of such a charge.
CELLS = (
    "behaviors", "drug_levels", "sentence_months", "detention_days", "probation_months", "art17_1", "art17_2", "art59", "recidivism",
    "can_convert_to_fine",
)
FALSY_BLANK = ("sentence_months", "detention_days", "probation_months")
CHARGE_FLOOR = {1: 180, 2: 120, 3: 84, 4: 60}
CHARGED = ("販賣", "運輸", "製造")
ARTICLE_17 = r"毒\s*品\s*危\s*害\s*防\s*制\s*條\s*例\s*第\s*(?:十七|17)\s*條\s*第\s*(?:[一二1])\s*項"
ARTICLE_59 = r"刑\s*法\s*第\s*(?:五十九|59)\s*條"
FACT_ANCHORS = ("犯罪事實", "事實及理由", "事實")


# --- filters


def single_defendant(df: DataFrame, count: str = "_n_def", keep_all: bool = False) -> DataFrame:
    return df if keep_all else df.where(F.col(count) == 1)


def bucket_cases(
    df: DataFrame, behaviors: str = "convicted_behaviors", levels: str = "convicted_drug_levels", courts: tuple[str, ...] = COURT_CODES
) -> DataFrame:
    """Cases fit for look-up buckets, with their primary behavior and lowest level.

    One term of one defendant on one count, with a behavior, a level and a known court.
    """
    fit = (F.coalesce(F.col("sentence_months"), F.lit(0)) != 0) & (F.col("n_defendants") <= 1) & ~F.col("is_aggregate_sentence")
    fit &= (F.col("n_sentence_counts") <= 1) & (F.size(levels) > 0) & F.col("court").isin(*courts)
    out = df.where(fit).withColumns({"primary": statute.primary_by_order(F.col(behaviors)), "level": F.array_min(levels)})
    return out.where(F.col("primary").isNotNull())


def suspicious_reductions(df: DataFrame, flag: str, months: str, behaviors: str, levels: str, share: float = 0.7) -> DataFrame:
    """Rows (behaviors and levels as lists in text, months in text) with a reduction although the term is near the unreduced minimum, with that floor."""
    level = F.split(levels, ",")[0].try_cast("int")
    floors = F.create_map(*(F.lit(x) for kv in CHARGE_FLOOR.items() for x in kv))
    charged = F.arrays_overlap(F.split(behaviors, ","), F.array(*map(F.lit, CHARGED)))
    out = df.withColumn("floor", F.try_element_at(floors, level))
    return out.where(charged & F.col(flag) & F.col("floor").isNotNull() & (F.col(months).try_cast("double") > F.col("floor") * share))


# --- label sheets


def prefilled(df: DataFrame, fill: bool = True) -> DataFrame:
    """df with a gt_ cell for each auto_ cell: its text (a zero number is blank), or blank."""
    out = df
    for c in CELLS:
        auto = F.coalesce(F.col(f"auto_{c}").cast("string"), F.lit(""))
        if c in FALSY_BLANK:
            auto = F.when(F.coalesce(F.col(f"auto_{c}").try_cast("double"), F.lit(0.0)) == 0, "").otherwise(auto)
        out = out.withColumn(f"gt_{c}", auto if fill else F.lit(""))
    return out


def blank(cell: Column) -> Column:
    return text.strip(F.coalesce(cell.cast("string"), F.lit(""))) == ""


def labelled(df: DataFrame, cells: tuple[str, ...] = CELLS) -> DataFrame:
    """Rows with at least one gt_ cell that says something."""
    return df.where(~F.forall(F.array(*(F.col(f"gt_{c}").cast("string") for c in cells)), blank))


def filled(cell: str) -> Column:
    """How many cells are not blank; an aggregate."""
    return F.count_if(F.length(F.col(cell).cast("string")) > 0)


def anchored(body: Column, anchors: tuple[str, ...] = FACT_ANCHORS, after: int = 600) -> Column:
    """The text from the first anchor that is there, in the order given, in one line; empty without any."""
    found = [F.nullif(cut_from(body, a, after), F.lit("")) for a in anchors]
    return F.coalesce(*found, F.lit(""))


def cut_from(body: Column, anchor: str, after: int) -> Column:
    at = F.regexp_instr(body, F.lit(text.FLAGS + text.loose(anchor)))
    return F.when(at > 0, F.translate(F.substring(body, at, F.lit(after)), "\r\n", "  ")).otherwise(F.lit(""))


# --- registries


def front_columns(df: DataFrame, front: list[str]) -> DataFrame:
    """df with the columns of `front` that it has first, then its others; blanks for nulls of text."""
    first = [c for c in front if c in df.columns]
    return df.select(*(F.col(f"`{c}`") for c in [*first, *(c for c in df.columns if c not in first)]))


def with_text(df: DataFrame, sources: list[DataFrame], key: str, body: str) -> DataFrame:
    """df with the body of its key: of the last source that has it; null without any."""
    marked = [s.select(key, F.col(body).alias("_body"), F.lit(i).alias("_source")) for i, s in enumerate(sources)]
    every = marked[0]
    for m in marked[1:]:
        every = every.unionByName(m)
    last = last_by_key(every, [key], [F.col("_source"), F.col("_body")]).select(F.col(key).alias("_key"), "_body")
    return df.join(last, F.col(key) == F.col("_key"), "left").drop("_key").withColumnRenamed("_body", body)


# --- summaries


def coverage_ratio(months: Column, days: Column) -> Column:
    """Rows with a term and rows with detention, added up, to all rows; an aggregate. A row may count twice."""
    return F.try_divide(F.count_if(months > 0) + F.count_if(days > 0), F.count("*"))


def value_counts(df: DataFrame, value: Column, name: str) -> DataFrame:
    """name, n by falling n, then by name."""
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def first_item(items: Column) -> Column:
    """The first of a list in text; empty for null."""
    return text.strip(F.split(F.coalesce(items, F.lit("")), ",")[0])


def phrases_near(df: DataFrame, body: Column, citation: str, phrases: tuple[str, ...], reach: int = 80) -> DataFrame:
    """phrase, n: in how many rows a phrase stands within reach of the first citation, by falling n."""
    found = text.first(body, citation)
    at = F.regexp_instr(body, F.lit(text.FLAGS + citation)) - 1
    low = F.greatest(at - reach, F.lit(0))
    window = F.when(at >= 0, F.substring(body, low + 1, at + F.length(found) + reach - low))
    hits = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(window, p))
    return df.select(F.explode(hits).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase")


def direction_counts(df: DataFrame, by: list[str], direction: Column, classes: tuple[str, ...] = ("mitigating", "aggravating", "neutral", "absent")) -> DataFrame:
    """A column for each direction with its rows, zeros included."""
    return df.groupBy(*by).agg(*(F.count_if(direction == c).alias(c) for c in classes))


def clip_count(raw: Column, c: Column, eps: float = 0.01) -> Column:
    """How many predictions a range moves by more than eps; an aggregate."""
    return F.count_if(F.abs(statute.clip(raw, c) - raw) > eps)


def serving_lists(convicted: Column, mentioned: Column) -> Column:
    """What was convicted, or else what is mentioned."""
    return F.when(F.coalesce(F.size(convicted), F.lit(0)) > 0, convicted).otherwise(mentioned)


def top_contributions(df: DataFrame, contributions: dict[str, Column], k: int) -> DataFrame:
    """df with top: the k features of the largest absolute contribution, ties by name."""
    all_ = F.array(*(F.struct((-F.abs(c)).alias("order"), F.lit(name).alias("feature"), c.alias("contribution")) for name, c in contributions.items()))
    best = F.transform(F.slice(F.array_sort(all_), 1, k), lambda x: F.struct(x["feature"].alias("feature"), x["contribution"].alias("contribution")))
    return df.withColumn("top", best)


def holdout(df: DataFrame, key: str, share: float = 0.2, seed: str = "7") -> DataFrame:
    """df with held: a seeded draw by key, the same on every run and for every partitioning."""
    draw = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")
    return df.withColumn("held", draw < int(share * (1 << 32)))


def ordered_groups(errors: DataFrame, group: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Group errors in the order of a report: by the order given, others after it, else by falling n; none if there is one group only."""
    several = errors.withColumn("_k", F.count("*").over(W.partitionBy(F.lit(0)))).where("_k > 1").drop("_k")  # a row for each group
    if order:
        place = F.array_position(F.array(*map(F.lit, order)), F.col(group))
        return several.orderBy(F.when(place == 0, len(order) + 1).otherwise(place), group)
    return several.orderBy(F.desc("n"), group)


def pooled_with_own_thresholds(df: DataFrame, fold: str, score: str, positive: str, thresholds: DataFrame) -> DataFrame:
    """Rows of all folds with predicted, each by its own fold's threshold (a row for each fold)."""
    own = thresholds.select(F.col(fold).alias("_fold"), "threshold")
    return df.join(F.broadcast(own), F.col(fold) == F.col("_fold")).withColumn("predicted", F.col(score) >= F.col("threshold")).drop("_fold")
