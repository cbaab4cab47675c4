"""Five labelers of the ten sentencing factors as one interpreter: policies and rules are data, none has code of its own.

A labeler is a way to find the reasons of a judgment, a way to find the weighing block in them, a table of rules and a
way to cut evidence. Rules are rows (labeler, factor, place, direction, pattern, whether the whole reasons serve where the block
does not); the first that fits gives the direction. Patterns are read on the text without white space. A map of offsets
leads from a hit back to the judgment as it was, so evidence is a stretch of the judgment of 20 to 80 characters, with its place.

Prefilter. Most rules need some literal to occur (the longest run of plain characters that no alternative or option covers).
One automaton finds all those of all rules in a single pass over a text; only rules whose literal is there are tried.

Judgments go through in Arrow batches; rules and automaton are built once a task.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corvia.operators import factor_rules, labeler_tables
from corvia.operators.training import FACTORS

PUNCTUATION = factor_rules.PUNCTUATION

# --- rules


@dataclass(frozen=True)
class Rule:
    labeler: str
    factor: str
    place: int  # among the factor's rules
    group: int  # of rules of one direction that stand together
    direction: str
    pattern: str
    wide: bool  # the whole reasons serve too


def parsed(labeler: str, table: str) -> list[Rule]:
    out: list[Rule] = []
    counts: dict[str, int] = {}
    factor = direction = ""
    group = -1
    for line in table.strip().splitlines():
        if not line.startswith(" "):
            head, line = line.split(": ", 1)
            factor, direction = head.split(" ")
            group += 1
        for pattern in line.split():
            counts[factor] = counts.get(factor, -1) + 1
            out.append(Rule(labeler, factor, counts[factor], group, direction.rstrip("+"), pattern, direction.endswith("+")))
    return out


def _first_table() -> list[Rule]:
    out = []
    for factor, groups in factor_rules.RULES.items():
        at = 0
        for g, (direction, patterns) in enumerate(groups):
            for p in patterns:
                out.append(Rule("L1", factor, at, g, direction, p, False))
                at += 1
    return out


RULES: dict[str, list[Rule]] = {"L1": _first_table()} | {k: parsed(k, getattr(labeler_tables, k)) for k in ("L2", "L3", "L4", "L5")}


def rule_table(spark: SparkSession, rules: dict[str, list[Rule]] = RULES) -> DataFrame:
    """The rules as rows, to be looked at, joined or edited; rules_of() reads such rows."""
    rows = [(r.labeler, r.factor, r.place, r.group, r.direction, r.pattern, r.wide) for found in rules.values() for r in found]
    return spark.createDataFrame(rows, "labeler string, factor string, place int, `group` int, direction string, pattern string, wide boolean")


def rules_of(table: DataFrame) -> dict[str, list[Rule]]:
    out: dict[str, list[Rule]] = {}
    for r in sorted(table.collect(), key=lambda r: (r["labeler"], r["factor"], r["place"])):  # a table of rules, not of data
        out.setdefault(r["labeler"], []).append(Rule(**r.asDict()))
    return out


def needed_literal(pattern: str) -> str:
    """The longest run of plain characters that every match of the pattern holds; empty if there is none for sure."""
    if "|" in re.sub(r"\[[^\]]*\]|\([^()]*(?:\([^()]*\)[^()]*)*\)", "", pattern):
        return ""
    best = run = ""
    i, depth = 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            i = pattern.index("]", i + 2)
            c = ""
        elif c == "\\":
            i, c = i + 1, ""
        elif c == "(":
            depth, c = depth + 1, ""
        elif c == ")":
            depth, c = depth - 1, ""
        elif c == "{":
            i, c = pattern.index("}", i), ""
        elif c in "?*+.^$|":
            c = ""
        follows = pattern[i + 1 : i + 2]
        if c and depth == 0 and follows not in ("?", "*", "{"):
            run += c
        else:
            run = ""
        if len(run) > len(best):
            best = run
        i += 1
    return best


# --- where the reasons are

# Headings and ends of the reasons by labeler; least length of a section, and what serves without one.
_DATE3, _CLERK, _LAW = r"中\s*華\s*民\s*國\s*\d{3}", r"書\s*記\s*官", r"附\s*錄"
_TIGHT = (rf"{_DATE3}\s*年", _CLERK, r"以\s*上\s*正\s*本")


@dataclass(frozen=True)
class Reasons:
    sections: tuple[tuple[str, tuple[str, ...]], ...]
    least: int = 50
    otherwise: str = "whole"  # or "nothing", or "last": the last section, however short


REASONS: dict[str, Reasons] = {
    "L1": Reasons(tuple((t, factor_rules.REASON_ENDS) for t in factor_rules.REASONS)),
    "L2": Reasons((("事實及理由", (_DATE3, _CLERK)), ("理由", (r"附.{0,3}表", _DATE3)), ("論罪科刑", (_DATE3, _CLERK)))),
    "batch": Reasons((("事實及理由", (_DATE3, _CLERK)), ("理由", (_DATE3, _CLERK, r"據\s*上\s*論\s*斷")))),
    "L3": Reasons((("事實及理由", (rf"{_DATE3}年", _CLERK)), ("理由", (_CLERK,)), ("論罪科刑", (_CLERK,))), otherwise="nothing"),
    "L4": Reasons((("事實及理由", _TIGHT), ("理由", _TIGHT), ("事實", _TIGHT)), otherwise="last"),
    "L5": Reasons((("事實及理由", (_DATE3, _CLERK)), ("理由", (_DATE3, _CLERK, _LAW)), ("犯罪事實", (_DATE3, _CLERK, _LAW))), 200, "last"),
}
STAMP, ANSWER_CAP = re.compile(r"中\s*華\s*民\s*國\s*\d{2,3}\s*年"), 50_000


def section_at(text: str, title: str, ends: tuple[str, ...]) -> tuple[int, int]:
    """From behind the first (loosely written) title to the first of any end."""
    head = re.search(r"\s*".join(title), text)
    if head is None:
        return 0, 0
    stops = [m.start() for m in (re.compile(e).search(text, head.end()) for e in ends) if m]
    return head.end(), min(stops, default=len(text))


def reasons_at(text: str, how: Reasons) -> tuple[int, int]:
    a = b = 0
    for title, ends in how.sections:
        a, b = section_at(text, title, ends)
        if b - a >= how.least:
            return a, b
    return {"whole": (0, len(text)), "nothing": (0, 0), "last": (a, b)}[how.otherwise]


def model_text(text: str) -> str:
    """What a language model is asked about: from the main text to the last date stamp, up to a cap."""
    tail = text[max(text.find("主文"), 0) :]
    stamps = list(STAMP.finditer(tail))
    return tail[: stamps[-1].start() if stamps else None][:ANSWER_CAP]


# --- where the weighing block is


@dataclass(frozen=True)
class Tier:
    """Openers tried together, and what an opening must show to count."""

    openers: tuple[str, ...]
    choose: str  # "order": first opener that occurs; "earliest" place; "each" place in turn; "score": most words
    ahead: str = ""  # a pattern within 200 characters after the opener
    signal: str = ""  # a pattern in the block
    unless: tuple[tuple[str, int], ...] = ()  # words of the 320 characters around the opener, up to a place there
    words: tuple[str, ...] = ()
    least: int = 0
    back: int = 0
    ends: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Locator:
    tiers: tuple[Tier, ...]
    ends: tuple[str, ...]
    at: str  # "start" or "end" of the end that comes first
    skip: int = 0  # characters of the block before ends count
    least: int = 0  # ends up to here do not count
    more: int = 0
    without: int | None = None  # length where no end is found
    cap: int | None = None
    otherwise: str = "whole"


# Openers, ends, signals and words of the blocks.
_PUNISHED = ("一切情狀[，,]?\\s*量處", "綜合考量[^。]*量處", "量處如主文", "以資懲儆", "以示懲儆", "以資警惕", "以資警懲")
_TOPICS = ("智識", "生活狀況", "動機", "目的", "手段", "態度", "品行", "素行", "一切情狀", "危害", "戕害", "坦承", "否認", "教育程度", "家境", "勉持", "家庭")
_SIGNAL = (
    "量處|處有期徒刑|諭知易科罰金|易科罰金|犯後態度|犯罪動機|自陳|自述|自承|戕害|手段|素行|品行|智識程度|教育程度|家庭|生活狀況|經濟狀況|坦承犯行|否認|定其應執行|非難|非可取|惡習|戒[除絕斷]"
)
LOCATORS: dict[str, Locator] = {
    "L1": Locator((Tier(factor_rules.OPENERS, "order"),), factor_rules.BLOCK_ENDS, "start", skip=1, more=30),
    "L2": Locator(
        (
            Tier((
                r"爰\s*審\s*酌\s*被\s*告|爰\s*審\s*酌(?!毒品|該言詞|該書面|證據|當事人)|本\s*院\s*審\s*酌\s*被\s*告|審\s*酌\s*被\s*告\s*[^。\n]{0,8}?所\s*為"
                r"|審\s*酌\s*被\s*告\s*[^。\n]{0,3}?(?:無視|漠視|[前曾]|輕|未|不|猶)|審\s*酌\s*被\s*告\s*構\s*成\s*累\s*犯|審\s*酌\s*被\s*告\s*前\s*經|考\s*量\s*被\s*告",
            ), "each", signal=_SIGNAL),
            Tier((r"爰\s*審\s*酌|審\s*酌\s*被\s*告|本\s*院\s*審\s*酌|審\s*酌\s*[^。\n]{0,12}?所\s*為|考\s*量\s*被\s*告|審\s*酌\s*毒\s*品",), "each", signal=_SIGNAL, unless=(("刑事訴訟法第159", 320), ("證據能力", 200))),
        ),
        (r"沒\s*收|據\s*上\s*論\s*斷|依\s*刑\s*事\s*訴\s*訟\s*法|附\s*錄\s*法\s*條|本\s*案\s*經\s*檢\s*察\s*官|如\s*不\s*服\s*本\s*判\s*決|爰\s*依\s*刑\s*事\s*訴\s*訟\s*法|中\s*華\s*民\s*國\s*\d{2,3}",),
        "start", skip=10,
    ),
    "L3": Locator(
        (
            Tier(("爰[^。]*?(?:審酌|衡|斟酌|為基礎|考量)",), "score", words=_TOPICS),
            Tier(("審酌|衡酌",), "score", words=("智識", "生活狀況", "動機", "手段", "態度", "品行", "戕害"), least=2, back=5, ends=()),
        ),
        (r"量處[\s\S]{0,3498}?。",), "end", without=1500, cap=3500, otherwise="nothing",
    ),
    "L4": Locator(
        (
            Tier(("爰以行為人責任為基礎", "爰以行為人之責任為基礎", "爰審酌", "爰斟酌", "爰考量", "茲審酌"), "earliest"),
            Tier(("本院審酌被告", "審酌被告", "並審酌"), "earliest", ahead="動機|手段|戕害|坦承|犯後態度|前科|前案紀錄|教育程度|智識程度"),
        ),
        (*_PUNISHED, "分別量處如主文", "資以儆懲", "資以懲儆", "資以警懲"), "end", more=100, without=1500,
    ),
    "offsets": Locator(
        (Tier(("爰以行為人責任為基礎", "爰以行為人之責任為基礎", "爰審酌", "爰斟酌", "爰考量", "本院審酌被告", "審酌被告", "茲審酌", "並審酌"), "earliest"),),
        _PUNISHED, "end", more=100, without=1500, otherwise="nothing",
    ),
    "L5": Locator(
        (Tier((r"爰\s*[以審]\s*[行審]", r"爰\s*審\s*酌", r"爰\s*以\s*行\s*為\s*人", r"審\s*酌\s*被\s*告", "本院依刑法第57條"), "earliest"),),
        (
            "以資懲儆", "以示懲儆", "以示警惕", "資以懲儆", "以資警惕", "用以鼓勵", r"標準\s*。", r"如易科罰金之折算\n?\s*標準",
            r"\n\s*(?:三|四|五|六)\s*、\s*(?:沒收|據|依|扣案|據上)", r"\n\s*[（(]\s*[三四]\s*[）)]\s*沒收",
        ), "end", least=200, more=50, cap=2000,
    ),
}


def _end(text: str, start: int, how: Locator, ends: tuple[str, ...]) -> int:
    limit = len(text) if how.cap is None else min(len(text), start + how.cap)
    found = []
    for e in ends:
        m = re.compile(e).search(text, start + how.skip)
        if m:
            at = m.start() if how.at == "start" else m.end()
            if at - start > how.least and at <= limit:
                found.append(at)
    if not found:
        return limit if how.without is None else min(limit, start + how.without)
    return min(limit, min(found) + how.more)


def block_at(text: str, how: Locator) -> tuple[int, int]:
    """The weighing block of reasons by a policy."""
    for tier in how.tiers:
        ends = how.ends if tier.ends is None else tier.ends
        places: list[re.Match[str]] = []
        for opener in tier.openers:
            hits = re.finditer(opener, text)
            if tier.choose in ("each", "score"):
                places += hits
                continue
            hit = next((m for m in hits if not tier.ahead or re.search(tier.ahead, text[m.end() : m.end() + 200])), None)
            if hit:
                places.append(hit)
                if tier.choose == "order":
                    break
        if tier.choose == "earliest":
            places = sorted(places, key=lambda m: m.start())[:1]
        best = None
        for m in places:
            low = max(0, m.start() - 80)
            around = text[low : m.start() + 240]
            if any(word in around[:upto] for word, upto in tier.unless):
                continue
            a = max(0, m.start() - tier.back)
            b = _end(text, a, how, ends)
            if tier.signal and not re.search(tier.signal, text[a:b]):
                continue
            if tier.choose != "score":
                return a, b
            score = sum(w in text[a:b] for w in tier.words)
            if score >= tier.least and (best is None or score > best[0]):
                best = score, a, b
        if best:
            return best[1:]
    return (0, len(text)) if how.otherwise == "whole" else (0, 0)


# --- evidence: how a hit [a, b) of a text is widened or cut


def _grown(text: str, a: int, b: int, least: int, left_first: bool = True) -> tuple[int, int]:
    """Turn by turn a character on each side, until it is long enough or the text is at its end."""
    left = left_first
    while b - a < least and (a > 0 or b < len(text)):
        if left and a > 0 or b == len(text):
            a -= 1
        else:
            b += 1
        left = not left
    return a, b


def snapped(text: str, a: int, b: int, target: int = 50) -> tuple[int, int]:
    """About `target` characters, the edges moved to punctuation nearby; 20 to 80."""
    pad = max(0, (target - (b - a)) // 2)
    low, high = max(0, a - pad), min(len(text), b + pad)
    marks = [i for i in range(max(0, low - 20), low) if text[i] in PUNCTUATION]
    if marks and a - marks[-1] - 1 <= target + 20:
        low = marks[-1] + 1
    mark = next((i for i in range(b, min(len(text), high + 20)) if text[i] in PUNCTUATION), None)
    if mark is not None and mark - a <= target + 30:
        high = mark
    while high - low < 20 and (low > 0 or high < len(text)):
        low, high = max(0, low - 1), min(len(text), high + 1)
    return low, min(high, low + 80)


def clipped(text: str, a: int, b: int) -> tuple[int, int]:
    """20 characters about the hit, more behind it if the text begins there; at most 80, cut behind the hit first."""
    pad = max(0, 20 - (b - a)) // 2
    low, high = max(0, a - pad), min(len(text), b + pad)
    high = max(high, min(len(text), low + 20))
    low = min(low, max(0, high - 20))
    return low, min(high, max(low + 80, b)) if high - low > 80 else high


def expanded(text: str, a: int, b: int, most: int = 80) -> tuple[int, int]:
    low, high = _grown(text, a, b, 20)
    return low, min(high, low + most)


def padded(text: str, a: int, b: int) -> tuple[int, int]:
    """20 characters on each side; at most 80, the hit in the middle."""
    low, high = _grown(text, max(0, a - 20), min(len(text), b + 20), 20)
    while high - low > 80:
        low, high = (low + 1, high) if a - low > high - b else (low, high - 1)
    return low, high


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    low, high = _grown(text, a, b, 25)
    return low, min(high, low + 80)


@dataclass(frozen=True)
class Labeler:
    reasons: Reasons
    locator: Locator
    evidence: Callable[..., tuple[int, int]]
    by_phrase: bool = False  # each phrase in block and reasons before the next one
    squeezed: bool = False  # evidence without white space
    short: tuple[str, ...] = ()  # factors whose evidence has 70 characters at most
    profit: tuple[str, ...] = ()  # words that make evidence of a "seen" rule aggravating


LABELERS: dict[str, Labeler] = {
    "L1": Labeler(REASONS["L1"], LOCATORS["L1"], snapped, squeezed=True),
    "L2": Labeler(REASONS["L2"], LOCATORS["L2"], clipped),
    "L3": Labeler(REASONS["L3"], LOCATORS["L3"], expanded, by_phrase=True, short=("intellect", "life_status")),
    "L4": Labeler(REASONS["L4"], LOCATORS["L4"], padded),
    "L5": Labeler(REASONS["L5"], LOCATORS["L5"], trimmed, profit=("營利", "販賣", "意圖")),
}


# --- the interpreter


class Judgment:
    """A text, its characters without white space, and where each of them stands in the text."""

    def __init__(self, whole: str):
        self.whole = whole
        self.at = [i for i, c in enumerate(whole) if not c.isspace()]
        self.text = "".join(whole.split())


class Interpreter:
    """Rules of some labelers, compiled, behind one automaton of their literals."""

    def __init__(self, rules: dict[str, list[Rule]]):
        self.automaton = ahocorasick.Automaton()
        self.by_factor: dict[str, dict[str, list[list[tuple]]]] = {}
        for labeler, found in rules.items():
            of = self.by_factor.setdefault(labeler, {})
            for r in sorted(found, key=lambda r: (FACTORS.index(r.factor), r.place)):
                groups = of.setdefault(r.factor, [])
                if not groups or groups[-1][0][0].group != r.group:
                    groups.append([])
                target, _, also = r.pattern.partition("&&")
                literal = needed_literal(target)
                if literal:
                    self.automaton.add_word(literal, literal)
                groups[-1].append((r, literal, re.compile(target), re.compile(also) if also else None))
        self.automaton.make_automaton()

    def literals(self, text: str) -> set[str]:
        return {word for _, word in self.automaton.iter(text)} if len(self.automaton) else set()

    def labels(self, labeler: str, judgment: Judgment) -> dict[str, tuple[str, str, int, int]]:
        """factor -> direction, evidence, and its place in the judgment (-1 where there is none)."""
        how = LABELERS[labeler]
        start, end = reasons_at(judgment.whole, how.reasons)
        a, b = block_at(judgment.whole[start:end], how.locator)
        block = (start + a, start + b) if b > a else (start, end)
        scopes = [_Scope(judgment, *block, how.squeezed), _Scope(judgment, start, end, how.squeezed)]
        present = [self.literals(s.text) for s in scopes]
        return {f: self._first(how, groups, scopes, present) for f, groups in self.by_factor[labeler].items()}

    def _first(self, how: Labeler, groups, scopes, present) -> tuple[str, str, int, int]:
        for group in groups:
            n = 2 if group[0][0].wide else 1
            turns = [(rule, k) for rule in group for k in range(n)] if how.by_phrase else [(rule, k) for k in range(n) for rule in group]
            for (r, literal, pattern, also), k in turns:
                if literal and literal not in present[k]:
                    continue
                hit = pattern.search(scopes[k].text)
                if hit is None or also is not None and not also.search(scopes[k].text):
                    continue
                most = {"most": 70} if r.factor in how.short else {}
                evidence, low, high = scopes[k].cut(how.evidence, hit.start(), hit.end(), most)
                direction = r.direction
                if direction == "seen":
                    direction = "aggravating" if any(w in evidence for w in how.profit) else "neutral"
                return direction, evidence, low, high
        return "absent", "", -1, -1


class _Scope:
    """A stretch of a judgment."""

    def __init__(self, judgment: Judgment, start: int, end: int, squeezed: bool):
        self.whole, self.start, self.end, self.squeezed = judgment.whole, start, end, squeezed
        a, b = bisect_left(judgment.at, start), bisect_left(judgment.at, end)
        self.at, self.text = judgment.at[a:b], judgment.text[a:b]

    def cut(self, evidence: Callable, a: int, b: int, most: dict) -> tuple[str, int, int]:
        if self.squeezed:
            a, b = evidence(self.text, a, b, **most)
            return self.text[a:b], self.at[a], self.at[b - 1] + 1
        source = self.whole[self.start : self.end]
        a, b = evidence(source, self.at[a] - self.start, self.at[b - 1] + 1 - self.start, **most)
        return source[a:b], self.start + a, self.start + b


LABELS = "map<string,struct<direction:string,evidence:string,start:int,end:int>>"
ROWS_OUT = 1000  # judgments sent back at once: evidence is longer than the text


def labelled(cases: DataFrame, labelers: tuple[str, ...] = tuple(LABELERS), rules: dict[str, list[Rule]] | None = None) -> DataFrame:
    """jid, jfull -> those and labels, labeler -> factors; null texts are read as empty. Equal texts of a batch are read once."""
    chosen = {k: (rules or RULES)[k] for k in labelers}
    many = len(labelers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        interpreter = Interpreter(chosen)
        for batch in batches:
            texts = batch.column("jfull").fill_null("").dictionary_encode()
            flat: list[list] = [[], [], [], [], []]  # factor, direction, evidence, start, end
            ends = [0]
            for text in texts.dictionary.to_pylist():
                judgment = Judgment(text)
                for labeler in labelers:
                    for factor, found in interpreter.labels(labeler, judgment).items():
                        for column, value in zip(flat, (factor, *found), strict=True):
                            column.append(value)
                    ends.append(len(flat[0]))
            words, places = [pa.array(c, pa.string()) for c in flat[:3]], [pa.array(c, pa.int32()) for c in flat[3:]]
            values = pa.StructArray.from_arrays([*words[1:], *places], names=["direction", "evidence", "start", "end"])
            factors = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), words[0], values)
            names = pa.array(list(labelers) * len(texts.dictionary), pa.string())
            labels = pa.MapArray.from_arrays(pa.array(np.arange(len(texts.dictionary) + 1) * many, pa.int32()), names, factors)
            for a in range(0, batch.num_rows, ROWS_OUT):
                own = batch.slice(a, ROWS_OUT)
                yield pa.RecordBatch.from_arrays([own.column("jid"), own.column("jfull"), labels.take(texts.indices.slice(a, ROWS_OUT))], names=["jid", "jfull", "labels"])

    return cases.select("jid", "jfull").mapInArrow(run, f"jid string, jfull string, labels map<string,{LABELS}>")


def label_factors(cases: DataFrame, labelers: tuple[str, ...] = tuple(LABELERS), rules: dict[str, list[Rule]] | None = None) -> DataFrame:
    """jid, jfull -> jid, labeler, factors: a row for each labeler."""
    return labelled(cases, labelers, rules).select("jid", F.explode("labels").alias("labeler", "factors"))


def united(labels: DataFrame) -> DataFrame:
    """jid, factor, votes (direction -> labelers that say so): the labelers' answers side by side, in one aggregation."""
    each = labels.select("jid", "labeler", F.explode("factors").alias("factor", "f")).groupBy("jid", "factor", "f.direction").agg(F.sort_array(F.collect_set("labeler")).alias("labelers"))
    return each.groupBy("jid", "factor").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("direction", "labelers")))).alias("votes"))
