"""Numbers as judgments write them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corvia.functions.text import let, strip

# Numerals and what they stand for.
NUMERALS = {
    "零": 0, "○": 0, "〇": 0,
    "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9,
    "壹": 1, "貳": 2, "參": 3, "叁": 3, "肆": 4, "伍": 5, "陸": 6, "柒": 7, "捌": 8, "玖": 9,
    "十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000, "萬": 10000,
}
CHARACTERS = "".join(NUMERALS)
_WIDE, _PLAIN = "０１２３４５６７８９", "0123456789"


def _value(c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in NUMERALS.items() for x in kv)), c)


def numeral(text: Column) -> Column:
    """An integer in digits, or in numerals read once from left to right.

    A unit multiplies what stands before it (1 if nothing does); of digits in a row the last counts; there are
    no sections, so 十二萬 is 20010. Anything else is null.
    """
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("digit"), F.lit(True).alias("ok"))

    def step(a: Column, c: Column) -> Column:
        return let(_value(c), lambda v: F.struct(
            F.when(v >= 10, a["sum"] + F.greatest(a["digit"], F.lit(1)) * v).otherwise(a["sum"]).alias("sum"),
            F.when(v >= 10, F.lit(0)).otherwise(F.coalesce(v, F.lit(0))).alias("digit"),
            (a["ok"] & v.isNotNull()).alias("ok"),
        ))

    def read(s: Column) -> Column:
        folded = F.aggregate(F.split(s, ""), start, step, lambda a: F.when(a["ok"], a["sum"] + a["digit"]))
        return F.when(s.isNull() | (s == ""), None).when(s.rlike("^[0-9]+$"), s.try_cast("int")).otherwise(folded)

    return let(F.translate(strip(text), _WIDE, _PLAIN), read)


def decimal(text: Column) -> Column:
    """A number in digits (commas ignored), in numerals, or in numerals with digits after 點."""
    def read(s: Column) -> Column:
        whole, rest = F.substring_index(s, "點", 1), F.substring(s, F.locate("點", s) + 1, F.length(s))
        number = F.when(whole == "", F.lit(0)).otherwise(numeral(whole))
        digits = F.transform(F.split(rest, ""), lambda c: F.when(c.rlike("^[0-9]$"), c).when(_value(c) < 10, _value(c).cast("string")))
        mixed = F.concat(number.cast("string"), F.lit("."), F.array_join(digits, "")).try_cast("double")
        spoken = (
            F.when((F.locate("點", s) == 0) | (rest == ""), number.cast("double"))
            .when(F.exists(digits, lambda d: d.isNull()), None)
            .otherwise(mixed)
        )
        return F.when(s.isNull() | (s == ""), None).otherwise(F.coalesce(s.try_cast("double"), spoken))

    return let(F.translate(F.regexp_replace(strip(text), ",", ""), _WIDE, _PLAIN), read)


def months(years: Column, months_: Column) -> Column:
    """Years and months as written (empty: absent) in months; null if both are absent or it comes to nothing."""
    total = F.coalesce(numeral(years), F.lit(0)) * 12 + F.coalesce(numeral(months_), F.lit(0))
    return let(total, lambda n: F.when(n != 0, n))
