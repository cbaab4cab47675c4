"""Text cells of label sheets, model answers as JSON, and rule lists that label by first match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvia.functions.text import let
from corvia.operators.training import FACTORS

TRUE, FALSE = ("1", "true", "t", "y", "yes", "v"), ("0", "false", "f", "n", "no", "x")
ANSWER = "map<string,struct<direction:string,evidence:string>>"
ALLOWED = ("mitigating", "aggravating", "neutral", "absent")


def parse_bool(cell: Column) -> Column:
    x = F.lower(F.trim(cell))
    return F.when(x.isin(*TRUE), True).when(x.isin(*FALSE), False)


def parse_int(cell: Column) -> Column:
    """Through a number with a fraction, cut off towards 0; null for anything else."""
    return F.trim(cell).try_cast("double").try_cast("int")


def parse_set(cell: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


def json_object(text: Column) -> Column:
    """The text between the first and the last brace, without fences around."""
    inner = F.regexp_replace(text, r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(inner, r"(?s)\{.*\}", 0), F.lit("")), inner)


def checked_answers(df: DataFrame, raw: str, most: int = 120) -> DataFrame:
    """df with factors (map of factor to direction and evidence, cut) and error: null, or what is wrong with the answer."""
    factors = F.array(*map(F.lit, FACTORS))

    def error(found: Column) -> Column:
        missing = F.filter(factors, lambda k: F.try_element_at(found, k).isNull())
        wrong = F.filter(factors, lambda k: ~F.coalesce(F.try_element_at(found, k)["direction"].isin(*ALLOWED), F.lit(False)))
        return (
            F.when(found.isNull() | (F.size(F.map_keys(found)) == 0), F.lit("parse: no JSON object"))
            .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))
            .when(F.size(wrong) > 0, F.concat(F.lit("direction: "), F.array_join(wrong, ",")))
        )

    def cut(found: Column) -> Column:
        return F.transform_values(
            F.map_filter(found, lambda k, v: k.isin(*FACTORS)),
            lambda k, v: F.struct(v["direction"].alias("direction"), F.substring(F.coalesce(v["evidence"], F.lit("")), 1, most).alias("evidence")),
        )

    # The answer is read once a row; as rows of a generator, so that conditions on the outcome are not pushed into its making.
    made = let(F.from_json(json_object(F.col(raw)), ANSWER), lambda f: let(error(f), lambda e: F.struct(F.when(e.isNull(), cut(f)).alias("factors"), e.alias("error"))))
    others = [c for c in df.columns if c not in ("factors", "error")]
    return df.select(*(F.col(f"`{c}`") for c in others), F.inline(F.array(made)))


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str = "absent") -> Column:
    """direction and evidence of the first rule, in order, whose pattern occurs."""
    out = F.struct(F.lit(otherwise).alias("direction"), F.lit("").alias("evidence"))
    for direction, pattern in reversed(rules):
        hit = F.regexp_extract(text, f"(?Ud){pattern}", 0)
        out = F.when(hit != "", F.struct(F.lit(direction).alias("direction"), hit.alias("evidence"))).otherwise(out)
    return out


def best_block(text: Column, separator: str, words: tuple[str, ...]) -> Column:
    """Of the parts of a text, the one in which most of the words occur; the earliest of equals."""
    parts = F.split(text, separator)
    scored = F.transform(
        parts, lambda p, i: F.struct(F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(p, w))).alias("score"), (-i).alias("minus"), p.alias("text"))
    )
    return F.array_max(scored)


def phrase_counts(df: DataFrame, text: Column, phrases: tuple[str, ...]) -> DataFrame:
    """phrase, n: in how many rows each phrase occurs."""
    hits = F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))
    return df.select(F.explode(hits).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))
