"""Regular expressions over judgment text as Column functions.

Patterns are Java's, read with Unicode classes (white space and digits of full width count) and with a
dot that stops at line feeds only. Positions are 0-based, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

FLAGS, DOTALL_FLAGS = "(?Ud)", "(?Usd)"
MARK = "\x01"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x worked out once, however often the body reads it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(FLAGS + pattern)


def first(text: Column, pattern: str, group: int = 0) -> Column:
    """What the first match has in a group; empty without a match."""
    return F.regexp_extract(text, FLAGS + pattern, group)


def loose(literal: str) -> str:
    """A pattern for a literal whose characters white space may part."""
    return r"\s*".join(f"\\Q{c}\\E" if not c.isalnum() else c for c in literal)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def between(text: Column, start: Column | int, end: Column | int) -> Column:
    """text[start:end]; empty where the end is not after the start."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.when(end > start, F.substring(text, start + 1, end - start)).otherwise(F.lit(""))


def _placed(found: Column, gaps: Column) -> Column:
    """Matches and the texts between them -> structs of start, end, text. Both are worked out once, not for each match."""
    def at(p: Column, i: Column) -> Column:
        return F.aggregate(F.slice(p["gaps"], 1, i + 1), F.lit(0), lambda n, x: n + x) + F.aggregate(F.slice(p["found"], 1, i), F.lit(0), lambda n, x: n + F.length(x))

    def place(p: Column) -> Column:
        return F.transform(p["found"], lambda x, i: let(at(p, i), lambda n: F.struct(n.alias("start"), (n + F.length(x)).alias("end"), x.alias("text"))))

    return let(F.struct(found.alias("found"), F.transform(gaps, F.length).alias("gaps")), place)


def spans(text: Column, pattern: str) -> Column:
    """All matches in order as structs of start, end, text. The pattern must not match the empty string.

    Marks are put round the matches, and the text is cut at the marks: a replacement keeps its compiled pattern
    from row to row, a split at a pattern compiles it anew for each. Texts that hold the mark itself are split.
    """
    regex = F.lit(FLAGS + pattern)
    marked = F.regexp_replace(text, regex, F.lit(f"{MARK}$0{MARK}"))
    cut = let(F.split(marked, MARK, -1), lambda p: _placed(F.filter(p, lambda _, i: i % 2 == 1), F.filter(p, lambda _, i: i % 2 == 0)))
    return F.when(F.contains(text, F.lit(MARK)), _placed(F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, FLAGS + pattern, -1))).otherwise(cut)


def literal_spans(text: Column, word: Column) -> Column:
    """The same for a literal that differs from row to row; none for an empty one."""
    parts = F.split(text, F.concat(F.lit("\\Q"), word, F.lit("\\E")), -1)
    found = F.array_repeat(word, F.size(parts) - 1)
    return F.when(word != "", _placed(found, parts)).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))


def section(text: Column, title: str, ends: tuple[str, ...]) -> Column:
    """What follows the first (loosely written) title, up to the first match of any end; empty without the title."""
    head, at = first(text, loose(title)), F.regexp_instr(text, F.lit(FLAGS + loose(title)))

    def cut(tail: Column) -> Column:
        stop = F.regexp_instr(tail, F.lit(FLAGS + "|".join(f"(?:{e})" for e in ends)))
        return let(stop, lambda n: F.when(n > 0, F.substring(tail, F.lit(1), n - 1)).otherwise(tail))

    return let(at, lambda n: F.when(n > 0, let(F.substring(text, n + F.length(head), F.length(text)), cut)).otherwise(F.lit("")))


def sentence_window(text: Column, start: Column, end: Column, stop: str = "。", reach: int = 120, else_: int = 80) -> Column:
    """The text around [start, end): to the full stops within reach each way, else so many characters."""
    back = F.locate(stop, F.reverse(between(text, F.greatest(start - reach, F.lit(0)), start)))
    ahead = F.locate(stop, between(text, end, end + reach))
    from_ = let(back, lambda n: F.when(n > 0, start - n + 1).otherwise(F.greatest(start - else_, F.lit(0))))
    to = let(ahead, lambda n: F.when(n > 0, end + n - 1).otherwise(F.least(end + else_, F.length(text))))
    return let(F.struct(from_.alias("a"), to.alias("b")), lambda w: between(text, w["a"], w["b"]))


def snippet(text: Column, anchor: str, before: int = 30, after: int = 90, most: int = 400) -> Column:
    """Text around the first (loosely written) anchor in one line; empty without it."""
    at = F.regexp_instr(text, F.lit(FLAGS + loose(anchor))) - 1
    cut = between(text, F.greatest(at - before, F.lit(0)), at + F.length(first(text, loose(anchor))) + after)
    return F.when(at >= 0, F.substring(F.translate(cut, "\r\n", "  "), 1, most)).otherwise(F.lit(""))


def merged_intervals(intervals: Column) -> Column:
    """array<struct<lo,hi>> -> the same, sorted, those that touch or overlap united."""
    empty = F.slice(intervals, 1, 0)

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        united = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(united))
        return F.when(F.size(done) == 0, F.array(x)).when(x["lo"] <= last["hi"], grown).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(intervals), empty, add)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def count_words(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur."""
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)))
