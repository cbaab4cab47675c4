"""Case features from the text of judgments, as one projection of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corvia.functions.numerals import CHARACTERS, decimal, months, numeral
from corvia.functions.text import FLAGS, between, first, has, let, section, sentence_window, spans
from corvia.sources.written import materialise

# The patterns that mark headings, verdicts, citations and their refusals.
_NUMBER = rf"[{CHARACTERS}\d]+"
MAIN_ENDS = (r"犯\s*罪\s*事\s*實", r"事\s*實\s*及\s*理\s*由", r"事\s*實", r"理\s*由")
VERDICT = rf"處有期徒刑\s*(?:({_NUMBER})\s*年)?\s*(?:({_NUMBER})\s*(?:個)?月)?"
AGGREGATE = rf"應\s*執\s*行\s*(?:有\s*期\s*徒\s*刑)?\s*(?:({_NUMBER})\s*年)?\s*(?:({_NUMBER})\s*(?:個)?月)?"
PROBATION = rf"緩\s*刑\s*({_NUMBER})\s*年"
DETENTION = rf"處\s*拘\s*役\s*({_NUMBER})\s*日"
COUNT = r"處\s*有\s*期\s*徒\s*刑"
ATTEMPT = r"未\s*遂"
FINE = "易科罰金"
WEIGHT = rf"(?:純\s*質\s*)?(?:驗\s*餘\s*)?淨\s*重\s*(?:約|共\s*計|合\s*計)?\s*([\d{CHARACTERS}點\.]+?)\s*(公\s*斤|公\s*克|克)"
BOUNDARY = r"。\s*(?![又再而並亦])[一-龥○Ａ-Ｚ\d]{1,5}\s*(?:犯|共同|意圖|施用|販賣|轉讓|運輸|製造|持有|幫助)"
OPENER = (
    r"(?:^|。)\s*(?![又再而並亦另])([一-龥○ＯＡ-Ｚ][一-龥○ＯＡ-Ｚ]{0,4}?)\s*"
    r"(?:犯|共同|意圖|施用|販賣|轉讓|運輸|製造|持有|幫助|教唆|基於|連續)"
)
SURRENDER = r"刑法\s*第\s*(?:六十二|62)\s*條"
RECIDIVISM = r"刑法\s*第\s*(?:四十七|47)\s*條|累\s*犯"
LEVELS = {1: "第[一1]級毒品", 2: "第[二2]級毒品", 3: "第[三3]級毒品", 4: "第[四4]級毒品"}
_TARGET = r"(?:毒\s*品|禁\s*藥)"
_GRADE = r"(?:\s*第\s*[一二三四1-4]\s*級)?\s*"
BEHAVIORS = {
    "販賣": rf"販\s*賣{_GRADE}{_TARGET}|販\s*賣.{{0,3}}予",
    "施用": rf"施\s*用{_GRADE}{_TARGET}",
    "持有": rf"持\s*有{_GRADE}{_TARGET}",
    "運輸": rf"運\s*輸{_GRADE}{_TARGET}",
    "轉讓": rf"轉\s*讓{_GRADE}{_TARGET}",
    "製造": rf"製\s*造{_GRADE}{_TARGET}",
    "意圖販賣而持有": rf"意\s*圖\s*販\s*賣\s*而\s*持\s*有.{{0,6}}{_TARGET}",
}
ARTICLE_17 = {
    1: r"(?:毒品危害防制)?條例\s*第\s*(?:十七|17)\s*條\s*第\s*(?:一|1)\s*項",
    2: r"(?:毒品危害防制)?條例\s*第\s*(?:十七|17)\s*條\s*第\s*(?:二|2)\s*項",
}
ARTICLE_59 = r"刑\s*法\s*第\s*(?:五十九|59)\s*條"
APPLIED_17, APPLIED_59 = "減輕|遞減|減其刑", r"減輕|遞減|減其刑|酌減|酌量\s*減"
REFUSED_17 = (
    r"不符|未[符能達及]|難認|無從|無法|不適用|(?:雖|並|均|尚|而|仍|亦|卻)\s*無|無[^。，]{0,60}?之?適用|不予[適減以]|未予|改口|嗣[後改]|矢口否認"
    r"|未[^。]{0,30}查獲|未因而查獲|並未查獲|辯護人[^。]{0,80}(?:請求|主張|辯)|無\s*以\s*依|無\s*從\s*依"
)
REFUSED_59 = (
    r"不符|未[符能達及]|難認|無從|無法|不適用|並非|(?:雖|並|均|尚|而|仍|亦|卻)\s*無|無[^。，]{0,60}?之?適用|無\s*[^。，]{0,30}?\s*餘\s*地"
    r"|不予[適減以]|未予|辯護人[^。]{0,80}(?:請求|主張|辯)"
)
RECITED_BEFORE, RECITED_AFTER = r"按\s*[^。]{0,15}?犯第\s*(?:[四4]|四)\s*條", r"^\s*(?:規定[：「:]|定有明文|明定)"
HYPOTHETICAL, CASE_LAW = r"(?:倘|苟|若)\s*[被行]", r"判\s*決\s*意\s*旨|裁\s*定\s*意\s*旨|判\s*例"
INTERPRETATION = r"釋\s*字\s*第?\s*775|司法院\s*大?\s*法官\s*釋\s*字"
PARTIAL = ("部分", "前揭")
SHORTEST = 50


def levels_in(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(has(text, p), F.lit(v)) for v, p in LEVELS.items())))


def behaviors_in(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(has(text, p), F.lit(b)) for b, p in BEHAVIORS.items())))


def _term(text: Column, pattern: str) -> Column:
    return months(first(text, pattern, 1), first(text, pattern, 2))


def heaviest_g(text: Column) -> Column:
    """The greatest net weight in grams; null without a readable one above 0."""
    def grams(s: Column) -> Column:
        unit = F.replace(first(s["text"], WEIGHT, 2), F.lit(" "), F.lit(""))
        return let(decimal(first(s["text"], WEIGHT, 1)), lambda value: F.when(value > 0, F.when(unit.startswith("公斤"), value * 1000.0).otherwise(value)))

    return F.array_max(F.transform(spans(text, WEIGHT), grams))


def _applied_17(text: Column, found: Column) -> Column:
    def applied(s: Column) -> Column:
        recited = has(between(text, F.greatest(s["start"] - 15, F.lit(0)), s["start"]), RECITED_BEFORE)
        recited |= has(F.substring(text, s["end"] + 1, F.lit(15)), RECITED_AFTER)
        fits = lambda w: has(w, APPLIED_17) & ~has(w, REFUSED_17) & ~has(w, HYPOTHETICAL) & ~has(w, CASE_LAW)
        return ~recited & let(sentence_window(text, s["start"], s["end"]), fits)

    return F.exists(found, applied)


def _applied_59(text: Column, found: Column) -> Column:
    fits = lambda w: has(w, APPLIED_59) & ~has(w, REFUSED_59) & ~has(w, INTERPRETATION)
    return F.exists(found, lambda s: let(sentence_window(text, s["start"], s["end"]), fits))


def _clauses(main: Column) -> Column:
    """array<struct<name,start>>: the clauses that open with a name."""
    return F.transform(spans(main, OPENER), lambda s: F.struct(first(s["text"], OPENER, 1).alias("name"), s["start"].alias("start")))


def _defendants(clauses: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.array_distinct(F.transform(clauses, lambda c: c["name"]))))


def _main(text: Column) -> Column:
    return section(text, "主文", MAIN_ENDS)


def _facts(text: Column) -> Column:
    tries = (
        section(text, "事實及理由", (r"中\s*華\s*民\s*國\s*\d{3}", r"附\s*錄", r"書\s*記\s*官")),
        section(text, "犯罪事實", (r"\n\s*理\s*由", r"證\s*據\s*清\s*單")),
        section(text, "事實", (r"\n\s*理\s*由",)),
    )
    return F.coalesce(*(let(t, lambda x: F.when(F.length(x) >= SHORTEST, x)) for t in tries), text)


def _with_features(cut: DataFrame) -> DataFrame:
    """jid, jdate, _name, _main, _wide, _cited, _n -> the features. Each step is a column: nothing is looked for twice."""
    main, cited = F.col("_main"), F.col("_cited")
    found = cut.withColumns({
        "_verdicts": spans(main, VERDICT), "_joints": spans(main, AGGREGATE), "_59": spans(cited, ARTICLE_59),
        **{f"_17{p}": spans(cited, ARTICLE_17[p]) for p in (1, 2)}, "_days": first(main, DETENTION, 1), "_years": first(main, PROBATION, 1),
    })
    partial = lambda s: F.exists(F.array(*map(F.lit, PARTIAL)), lambda w: F.contains(between(main, F.greatest(s["start"] - 15, F.lit(0)), s["start"]), w))
    first_joint, verdicts = F.get("_joints", F.lit(0)), F.col("_verdicts")
    found = found.withColumns({
        "_verdict": F.get(verdicts, F.lit(0)), "_joint": F.get(F.filter("_joints", lambda s: ~partial(s)), F.lit(0)),
        # The verdicts before the first joint term, where they end; a verdict never runs into one that follows.
        "_single": F.when(first_joint.isNull(), verdicts).otherwise(spans(between(main, 0, first_joint["start"]), VERDICT)),
    })
    found = found.withColumns({
        "_term": _term(F.col("_joint.text"), AGGREGATE), "_months": _term(F.col("_verdict.text"), VERDICT),
        "_terms": F.array_compact(F.transform("_single", lambda s: _term(s["text"], VERDICT))),
    })
    # The joint term, if it is the first defendant's and whole, else the first verdict.
    others = has(between(main, F.col("_verdict.end"), F.col("_joint.start")), BOUNDARY)
    found = found.withColumn("_whole", F.coalesce(F.col("_verdict").isNotNull() & F.col("_joint").isNotNull() & ~others & F.col("_term").isNotNull(), F.lit(False)))
    return found.select(
        "jid", "jdate", F.col("_name").alias("defendant_name"),
        levels_in(F.col("_wide")).alias("drug_levels"),
        behaviors_in(F.col("_wide")).alias("behaviors"),
        behaviors_in(main).alias("convicted_behaviors"),
        levels_in(main).alias("convicted_drug_levels"),
        heaviest_g(F.col("_wide")).alias("max_drug_weight_g"),
        F.col("_n").alias("n_defendants"),
        F.regexp_count(main, F.lit(FLAGS + COUNT)).alias("n_sentence_counts"),
        F.col("_whole").alias("is_aggregate_sentence"),
        has(main, ATTEMPT).alias("is_attempt"),
        # 0 for fewer than two, which would tell the label.
        F.when(F.size("_terms") >= 2, F.aggregate("_terms", F.lit(0), lambda n, x: n + x)).otherwise(0).alias("sum_individual_months"),
        _applied_17(cited, F.col("_171")).alias("art17_1_applied"),
        _applied_17(cited, F.col("_172")).alias("art17_2_applied"),
        _applied_59(cited, F.col("_59")).alias("art59_applied"),
        has(cited, SURRENDER).alias("self_surrender"),
        has(cited, RECIDIVISM).alias("recidivism"),
        F.when(F.col("_whole"), F.col("_term")).when(F.col("_verdict").isNotNull(), F.col("_months")).alias("sentence_months"),
        numeral(F.col("_days")).alias("detention_days"),
        F.nullif(numeral(F.col("_years")) * 12, F.lit(0)).alias("probation_months"),
        has(main, PROBATION).alias("probation_granted"),
        F.contains(main, F.lit(FINE)).alias("can_convert_to_fine"),
        F.lit(None).cast("int").alias("fine_ntd"),
        F.lit("").alias("law_version"),
    )


def _opened(cases: DataFrame) -> DataFrame:
    cut = cases.select("jid", "jdate", "jfull", _main(F.col("jfull")).alias("_main"))
    return cut.withColumn("_clauses", _clauses(F.col("_main")))


def extract_features(cases: DataFrame) -> DataFrame:
    """jid, jdate, jfull -> one row of features for each judgment."""
    return _whole_features(_opened(cases))


def _whole_features(opened: DataFrame) -> DataFrame:
    cut = opened.withColumn("_facts", _facts(F.col("jfull")))
    return _with_features(cut.select(
        "jid", "jdate", F.lit("").alias("_name"), "_main", F.concat("_main", F.lit("\n"), "_facts").alias("_wide"), F.col("jfull").alias("_cited"),
        _defendants(F.col("_clauses")).alias("_n"),
    ))


# --- by defendant: a table of spans, a row for each place at which a name stands


def _cut_by_name(cases: DataFrame) -> DataFrame:
    """jid, jdate, jfull -> those, _main, _clauses, _parts (array<struct<name,part>>: the stretch of the main text from each name's first clause
    to the next name's) and _several: whether there are several names, one of them with a verdict. All of it is in the row: nothing is shuffled."""
    names = F.array_distinct(F.transform("_clauses", lambda c: c["name"]))  # in the order of their first clauses
    firsts = F.transform(names, lambda n: F.struct(n.alias("name"), F.get(F.filter("_clauses", lambda c: c["name"] == n), F.lit(0))["start"].alias("start")))
    opened = _opened(cases).withColumn("_firsts", firsts)
    until = lambda i: F.coalesce(F.get("_firsts", i + 1)["start"], F.length("_main"))
    parts = F.transform("_firsts", lambda f, i: F.struct(f["name"].alias("name"), between(F.col("_main"), f["start"], until(i)).alias("part")))
    opened = opened.withColumn("_parts", F.when(F.size("_firsts") > 1, parts))
    judged = F.exists("_parts", lambda p: has(p["part"], VERDICT) | has(p["part"], AGGREGATE))
    return opened.drop("_firsts").withColumn("_several", F.coalesce(judged, F.lit(False)))


def defendant_parts(cases: DataFrame) -> DataFrame:
    """jid, jdate, jfull -> those and name, part, i: of judgments with several names, the stretch of the main text of each."""
    return _parts(_cut_by_name(cases).withColumn("_doc", F.monotonically_increasing_id()))


def _parts(cut: DataFrame) -> DataFrame:
    rows = cut.where("_parts IS NOT NULL").select("_doc", "jid", "jdate", "jfull", F.posexplode("_parts").alias("at", "p"))
    return rows.select("_doc", "jid", "jdate", "jfull", "p.name", (F.col("at") + 1).alias("i"), "p.part")


def scoped_texts(parts: DataFrame, pad: int = 250) -> DataFrame:
    """_doc, name, jfull of all defendants -> _doc, name, scoped: the stretches around each name, cut at the others' names.

    A row stands for a place of some name in the judgment, seen by one of its defendants: as its own, or as a stranger's.
    Window frames over a stretch of characters find the nearest stranger each way; stretches that touch are islands
    of one running count. A stranger's name has two characters at least.
    """
    names = parts.select("_doc", "name").distinct()
    # Where a name stands: splitting at it gives the texts between, whose lengths add up.
    pieces = F.split("jfull", F.concat(F.lit("\\Q"), F.col("name"), F.lit("\\E")), -1)
    cut = parts.select("_doc", "name", F.length("jfull").alias("size"), F.transform(pieces, F.length).alias("gaps"))
    placed = cut.select("_doc", "name", "size", F.posexplode("gaps").alias("at", "gap"))
    run = W.partitionBy("_doc", "name").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumns({"end": (F.sum("gap").over(run) + (F.col("at") + 1) * F.length("name")).cast("int"), "_last": F.lead("at").over(W.partitionBy("_doc", "name").orderBy("at"))})
    places = placed.where("_last IS NOT NULL").select("_doc", F.col("name").alias("of"), "size", (F.col("end") - F.length("name")).alias("start"), "end")
    seen = places.join(names, "_doc").withColumn("own", F.col("of") == F.col("name")).where(F.col("own") | (F.length("of") >= 2))
    near = W.partitionBy("_doc", "name").orderBy("start")
    stranger = lambda c: F.when(~F.col("own"), F.col(c))
    # A stranger counts if it lies in the stretch as a whole: it starts no earlier than the pad before, and ends within it.
    widened = seen.withColumns({
        "left": F.max(stranger("end")).over(near.rangeBetween(-pad, -1)),
        "right": F.array_sort(F.collect_list(F.when(~F.col("own"), F.struct("start", "end"))).over(near.rangeBetween(1, pad + 16))),
    }).where("own")
    high = F.least(F.col("end") + pad, F.col("size"))
    inside = F.filter("right", lambda o: (o["start"] > F.col("end")) & (o["end"] <= high))
    stretches = widened.select(
        "_doc", "name", F.greatest(F.col("start") - pad, F.lit(0), F.col("left")).alias("lo"), F.least(high, F.get(inside, F.lit(0))["start"]).alias("hi")
    )
    before = W.partitionBy("_doc", "name").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("lo") > F.max("hi").over(before), F.lit(True))
    islands = stretches.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(W.partitionBy("_doc", "name").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, 0)))
    merged = islands.groupBy("_doc", "name", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans_ = merged.groupBy("_doc", "name").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))  # of one judgment
    joined = F.array_join(F.transform("spans", lambda s: between(F.col("jfull"), s["lo"], s["hi"])), "\n。\n")
    return parts.join(spans_, ["_doc", "name"], "left").select("_doc", "name", F.coalesce(joined, F.lit("")).alias("scoped"))


def extract_features_per_defendant(cases: DataFrame) -> DataFrame:
    """A row for each defendant with a verdict; judgments with one, or none with a verdict, as extract_features()."""
    cut = materialise(_cut_by_name(cases).withColumn("_doc", F.monotonically_increasing_id()), "defendants")
    parts = _parts(cut.where("_several"))
    judged = parts.where(has(F.col("part"), VERDICT) | has(F.col("part"), AGGREGATE))
    scoped = scoped_texts(parts).withColumnRenamed("_doc", "_d").withColumnRenamed("name", "_who")
    each = judged.join(scoped, (F.col("_doc") == F.col("_d")) & (F.col("name") == F.col("_who")))
    own = _with_features(each.select(
        "jid", "jdate", F.col("name").alias("_name"), F.col("part").alias("_main"), F.col("part").alias("_wide"), F.col("scoped").alias("_cited"), F.lit(1).alias("_n"),
    ))
    return _whole_features(cut.where("NOT _several")).unionByName(own)
