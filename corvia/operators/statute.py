"""Statutory sentencing ranges as Column functions: look-up, reductions, clipping, violations.

A constraint is a struct of min_months, max_months, includes_life, includes_capital; null if none applies.
The tables are literals of fixed size, so a look-up is an expression in the scan's own stage and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TERM_CAP = 360.0
EPS = 1e-6

# Months of the statutory ranges by behavior and level (law version 2020); life, capital.
RANGES = {
    "販賣": {1: (180, 360, True, True), 2: (120, 360, True, False), 3: (84, 360, False, False), 4: (60, 144, False, False)},
    "運輸": {1: (180, 360, True, True), 2: (120, 360, True, False), 3: (84, 360, False, False), 4: (60, 144, False, False)},
    "製造": {1: (180, 360, True, True), 2: (120, 360, True, False), 3: (84, 360, False, False), 4: (60, 144, False, False)},
    "意圖販賣而持有": {1: (120, 360, True, False), 2: (60, 144, False, False), 3: (36, 120, False, False), 4: (12, 84, False, False)},
    "轉讓": {1: (12, 84, False, False), 2: (6, 60, False, False), 3: (0, 36, False, False), 4: (0, 12, False, False)},
    "施用": {1: (6, 60, False, False), 2: (0, 36, False, False)},
    "持有": {1: (0, 36, False, False), 2: (0, 24, False, False), 3: (0, 12, False, False), 4: (0, 12, False, False)},
}
# Net weight in grams from which holding has another range, by level.
HEAVY_HOLDING = {1: (10.0, (12, 84, False, False)), 2: (20.0, (6, 60, False, False))}
# Severity ranks; the order of behaviors in reports; behaviors that article 17 can reduce.
SEVERITY = {"販賣": 5, "運輸": 5, "製造": 5, "意圖販賣而持有": 4, "轉讓": 3, "施用": 2, "持有": 1}
# Behaviors to which article 17 applies, for the calculator's variant of the rules.
ARTICLE_17_ELIGIBLE = ("販賣", "運輸", "製造", "轉讓", "意圖販賣而持有")
REPORT_ORDER = ("運輸", "製造", "販賣", "意圖販賣而持有", "轉讓", "持有", "施用")
LAW_VERSION = 2020


def constraint(low: Column | float, high: Column | float, life: Column | bool = False, capital: Column | bool = False) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_column(low).cast("double").alias("min_months"), as_column(high).cast("double").alias("max_months"),
        as_column(life).alias("includes_life"), as_column(capital).alias("includes_capital"),
    )


def base_range(behavior: Column, level: Column, law: Column | None = None, weight_g: Column | None = None) -> Column:
    rows = [(f"{b}|{v}", r) for b, levels in RANGES.items() for v, r in levels.items()]
    table = F.create_map(*(x for key, r in rows for x in (F.lit(key), constraint(*r))))
    found = F.try_element_at(table, F.concat_ws("|", behavior, level.cast("string")))
    if weight_g is not None:
        for at, (grams, r) in HEAVY_HOLDING.items():
            found = F.when((behavior == "持有") & (level == at) & (weight_g >= grams), constraint(*r)).otherwise(found)
    return found if law is None else F.when(law == LAW_VERSION, found)


def with_reductions(base: Column, reductions: list[Column], recidivism: Column) -> Column:
    """Each reduction halves both bounds; recidivism then raises the upper one by half, up to the cap."""
    n = sum((F.coalesce(r, F.lit(False)).cast("int") for r in reductions), F.lit(0))
    factor = F.pow(F.lit(0.5), n)
    high = base["max_months"] * factor
    high = F.when(F.coalesce(recidivism, F.lit(False)), F.least(high * 1.5, F.lit(TERM_CAP))).otherwise(high)
    made = constraint(base["min_months"] * factor, high, base["includes_life"] & (n == 0), base["includes_capital"] & (n == 0))
    return F.when(base.isNotNull(), made)


def halved_floor(c: Column, when: Column) -> Column:
    low = F.when(F.coalesce(when, F.lit(False)) & (c["min_months"] > 0), c["min_months"] * 0.5).otherwise(c["min_months"])
    return F.when(c.isNotNull(), constraint(low, c["max_months"], c["includes_life"], c["includes_capital"]))


def primary_by_severity(behaviors: Column) -> Column:
    """The most severe behavior; of equals, which have equal ranges, the greatest by code point."""
    rank = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    scored = F.transform(behaviors, lambda b: F.struct(F.coalesce(F.try_element_at(rank, b), F.lit(0)).alias("s"), b.alias("b")))
    return F.array_max(scored)["b"]


def primary_as_ticked(behaviors: Column) -> Column:
    """The most severe behavior; of equals the first of the list, as the page's calculator takes it; null for none."""
    rank = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    scored = F.transform(behaviors, lambda b, i: F.struct(F.coalesce(F.try_element_at(rank, b), F.lit(0)).alias("s"), (-i).alias("i"), b.alias("b")))
    return F.array_max(scored)["b"]


def primary_by_order(behaviors: Column, order: tuple[str, ...] = REPORT_ORDER) -> Column:
    return F.coalesce(*(F.when(F.array_contains(behaviors, b), F.lit(b)) for b in order))


def binding(
    behaviors: Column, levels: Column, reductions: list[Column], recidivism: Column, summary: Column,
    weight_g: Column | None = None, law: Column | None = None, article_17: int | None = None,
    eligible: tuple[str, ...] | None = None,
) -> Column:
    """The range of the most severe behavior at the lowest level.

    eligible: behaviors to which the first `article_17` reductions are confined; None confines nothing.
    """
    primary = primary_by_severity(behaviors)
    if eligible is not None:
        may = primary.isin(*eligible)
        reductions = [r & may if i < (article_17 or 0) else r for i, r in enumerate(reductions)]
    base = base_range(primary, F.array_min(levels), law, weight_g)
    found = halved_floor(with_reductions(base, reductions, recidivism), summary)
    return F.when((F.size(behaviors) > 0) & (F.size(levels) > 0), found)


def _stepwise(df: DataFrame, name: str, *steps) -> DataFrame:
    """df with the column name, made in steps: each gets the column of the step before.

    A step uses what it gets several times; as a column of its own that is computed once a row.
    """
    whole, made = df.select(F.struct("*").alias("d")), F.col("d")
    for step in steps:
        whole = whole.select("d", step(made).alias("made"))
        made = F.col("made")
    return whole.select("d.*", made.alias(name))


def with_constraint(
    df: DataFrame, name: str, behavior: str, level: str, reductions: list[str], recidivism: str, summary: str,
    weight_g: str | None = None, law: str | None = None,
) -> DataFrame:
    """df with the range of a single count after reductions: columns by their names, as base_range, with_reductions and halved_floor."""
    d = F.col("d").getField
    return _stepwise(
        df, name,
        lambda _: base_range(d(behavior), d(level), None if law is None else d(law), None if weight_g is None else d(weight_g)),
        lambda base: with_reductions(base, [d(r) for r in reductions], d(recidivism)),
        lambda c: halved_floor(c, d(summary)),
    )


def with_binding(
    df: DataFrame, name: str, behaviors: str, levels: str, reductions: list[str], recidivism: str, summary: str,
    weight_g: str | None = None, law: str | None = None,
) -> DataFrame:
    """df with the binding range of lists of behaviors and levels; see binding."""
    d = F.col("d").getField

    def base(at: Column) -> Column:
        found = base_range(at["behavior"], at["level"], None if law is None else d(law), None if weight_g is None else d(weight_g))
        return F.when(at.isNotNull(), found)

    some = (F.size(d(behaviors)) > 0) & (F.size(d(levels)) > 0)
    return _stepwise(
        df, name,
        lambda _: F.when(some, F.struct(primary_by_severity(d(behaviors)).alias("behavior"), F.array_min(d(levels)).alias("level"))),
        base,
        lambda c: with_reductions(c, [d(r) for r in reductions], d(recidivism)),
        lambda c: halved_floor(c, d(summary)),
    )


def with_calculator_binding(
    df: DataFrame, name: str, behaviors: str, levels: str, article_17: list[str], reductions: list[str], recidivism: str, summary: str,
    weight_g: str | None = None,
) -> DataFrame:
    """with_binding() as the page's calculator has it: reductions by article 17 count only if the main behavior is eligible."""
    may = F.coalesce(primary_as_ticked(F.col(behaviors)).isin(*ARTICLE_17_ELIGIBLE), F.lit(False))
    confined = [f"_{name}_{r}" for r in article_17]
    held = df.withColumn(f"_{name}_may", may).withColumns({c: F.col(r) & F.col(f"_{name}_may") for c, r in zip(confined, article_17, strict=True)})
    return with_binding(held, name, behaviors, levels, [*confined, *reductions], recidivism, summary, weight_g).drop(*confined, f"_{name}_may")


def aggregate_only() -> Column:
    return constraint(0.0, TERM_CAP)


def constraint_for(aggregate: Column, n_counts: Column, single: Column) -> Column:
    """Several counts are bounded by the cap alone."""
    return F.when(aggregate | (n_counts > 1), aggregate_only()).otherwise(single)


def clip(x: Column, c: Column) -> Column:
    return F.when(c.isNull(), x).otherwise(F.greatest(c["min_months"], F.least(x, c["max_months"])))


def is_within(x: Column, c: Column) -> Column:
    return x.between(c["min_months"] - EPS, c["max_months"] + EPS)


def constrained(p25: Column, p50: Column, p75: Column, c: Column) -> Column:
    """Clipped to the range and put in order; a null constraint passes all through as they are."""
    a, b, d = (clip(x, c) for x in (p25, p50, p75))
    b2 = F.greatest(b, a)
    d2 = F.greatest(d, b2)
    moved = (F.abs(a - p25) > EPS) | (F.abs(b - p50) > EPS) | (F.abs(d - p75) > EPS)
    bound = c.isNotNull()
    return F.struct(
        a.alias("p25"), F.when(bound, b2).otherwise(p50).alias("p50"), F.when(bound, d2).otherwise(p75).alias("p75"),
        F.coalesce(bound & moved, F.lit(False)).alias("clipped"), bound.alias("rule_applied"),
    )


def aggregate_bounds(terms: Column) -> Column:
    """The longest term, and the sum up to the cap; zeros for none."""
    total = F.aggregate(terms, F.lit(0.0), lambda n, x: n + x)
    return F.struct(
        F.coalesce(F.array_max(terms).cast("double"), F.lit(0.0)).alias("low"), F.least(total, F.lit(TERM_CAP)).alias("high")
    )


def violations(df: DataFrame, months: Column, c: Column, *by: str) -> DataFrame:
    """by, n_checked, n_violations, rate; rows without a constraint are not checked."""
    # The constraint becomes a column first: it is used several times and long to write out.
    judged = df.select(*by, months.alias("_months"), c.alias("_c"))
    checked = F.count_if(F.col("_c").isNotNull())
    bad = F.count_if(F.col("_c").isNotNull() & ~is_within(F.col("_months"), F.col("_c")))
    return judged.groupBy(*by).agg(
        checked.alias("n_checked"), bad.alias("n_violations"), F.coalesce(F.try_divide(bad, checked), F.lit(0.0)).alias("rate")
    )


def bucket_key(court: Column, behavior: Column, level: Column, flags: list[Column]) -> Column:
    bits = F.concat(*(F.coalesce(f, F.lit(False)).cast("int").cast("string") for f in flags))
    return F.concat_ws("|", court, behavior, level.cast("string"), bits)


def decay_weight(date: Column, latest: Column, half_life_years: float) -> Column:
    """2 to the minus age / half life; dates are yyyyMMdd, a year has 365 days and a month 30; bad dates are age 0."""
    def days(d: Column) -> Column:
        part = lambda a, n: F.substring(d, a, n).try_cast("int")
        return part(1, 4) * 365 + part(5, 2) * 30 + part(7, 2)

    age = F.coalesce((days(latest) - days(date)) / 365.0, F.lit(0.0))
    return F.pow(F.lit(2.0), -age / half_life_years)
