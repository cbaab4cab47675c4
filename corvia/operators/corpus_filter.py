"""Which judgments belong to the corpus: court, subject, kind of proceeding, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvia.functions.text import DOTALL_FLAGS, contains_any, loose

# Court codes, display names, and how their headers are written.
COURTS = {
    "KL": ("基隆", ("臺灣基隆地方法院", "台灣基隆地方法院")),
    "TP": ("臺北", ("臺灣臺北地方法院", "台灣台北地方法院", "臺灣台北地方法院")),
    "SL": ("士林", ("臺灣士林地方法院", "台灣士林地方法院")),
    "PC": ("新北", ("臺灣新北地方法院", "台灣新北地方法院", "臺灣板橋地方法院", "台灣板橋地方法院")),
    "TY": ("桃園", ("臺灣桃園地方法院", "台灣桃園地方法院")),
}
# Words that decide.
SUBJECT = ("毒品危害防制條例", "毒品")
OTHER_PROCEEDINGS = ("聲", "抗", "簡上")
GUILTY = ("處有期徒刑", "處拘役", "處罰金", "免刑")
NOT_GUILTY = ("無罪", "公訴不受理", "不受理", "免訴")
PLEA = ("協商判決", "協商程序")
ALL_COURTS = tuple(COURTS)


def court_of(jid: Column, text: Column, courts: tuple[str, ...] = ("KL",)) -> Column:
    """The first of the courts whose code begins the id, if its header stands in the first 150 characters."""
    head = F.substring(text, 1, 150)
    found = F.lit(None).cast("string")
    for code in reversed(courts):
        shown = F.when(contains_any(head, COURTS[code][1]), F.lit(code))
        found = F.when(jid.startswith(code), shown).otherwise(found)
    return found


def court_name(code: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, (name, _) in COURTS.items() for x in (k, name))), code)


def is_subject(title: Column) -> Column:
    return contains_any(title, SUBJECT)


def is_plea(text: Column) -> Column:
    return contains_any(F.substring(text, 1, 2000), PLEA)


def main_text_for_filter(text: Column) -> Column:
    """From the loosely written heading to the next one; else 2000 characters from the plain heading on."""
    ends = "|".join(map(loose, ("犯罪事實", "事實", "理由")))
    tight = F.regexp_extract(text, rf"{DOTALL_FLAGS}{loose('主文')}\s*(.+?)(?=\s*(?:{ends}))", 1)
    at = F.instr(text, "主文")
    return F.coalesce(F.nullif(tight, F.lit("")), F.when(at > 0, F.substring(text, at, F.lit(2000))), F.lit(""))


def is_guilty_first_instance(case: Column, text: Column) -> Column:
    main = main_text_for_filter(text)
    return ~case.isin(*OTHER_PROCEEDINGS) & (main != "") & ~contains_any(main, NOT_GUILTY) & contains_any(main, GUILTY)


def select_cases(records: DataFrame, courts: tuple[str, ...] = ("KL",)) -> DataFrame:
    """records with court and court_name, those of the corpus only. Cheap conditions stand first."""
    code = court_of(F.col("jid"), F.col("jfull"), courts)
    chosen = records.withColumn("court", code).where(
        F.col("court").isNotNull() & is_subject(F.col("jtitle")) & ~is_plea(F.col("jfull"))
        & is_guilty_first_instance(F.col("jcase"), F.col("jfull"))
    )
    return chosen.withColumn("court_name", court_name(F.col("court")))
