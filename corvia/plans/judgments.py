"""Judgments made from orders, for queries over their texts; and SQL that says what is in each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvia.functions import numerals
from corvia.operators import corpus_filter, extract, labelers, labels, training
from corvia.plans.cases import table
from corvia.plans.registered import query
from corvia.sources.written import materialise

DIGITS = ("", "一", "二", "三", "四", "五", "六", "七", "八", "九")
FORMAL = ("", "壹", "貳", "參", "肆", "伍", "陸", "柒", "捌", "玖", "拾", "拾壹")
HEADERS = {"KL": "臺灣基隆地方法院", "TP": "臺灣臺北地方法院", "SL": "臺灣士林地方法院", "PC": "臺灣新北地方法院", "TY": "臺灣桃園地方法院"}
FACTS = "被告於民國一百一十年間某日，在其住處內，經警執行搜索而查獲上情，並扣得相關物品，送請鑑定機關鑑驗後，結果如下所示，合先敘明。"

def _pick(values, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), n.cast("int") + 1)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, the order's key, and v, the kind of its verdict."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 5).alias("v"))


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    years, months = k % 6, k % 11 + 1
    term = text(F.when(years > 0, text(_pick(FORMAL, years), "年")).otherwise(""), _pick(FORMAL, months), "月")
    level = _pick("一二三四", k % 4)
    verdict = (
        F.when(F.col("v") == 0, text("甲○○施用第", level, "級毒品，處有期徒刑", term, "，如易科罰金，以新臺幣壹仟元折算壹日。"))
        .when(F.col("v") == 1, text("藍佳鈞施用第一級毒品，處有期徒刑", term, "；又施用第二級毒品，處有期徒刑參月。應執行有期徒刑", _pick(FORMAL, years + 1), "年。"))
        .when(F.col("v") == 2, text("甲○○販賣第", level, "級毒品未遂，處有期徒刑", term, "，緩刑貳年。"))
        .when(F.col("v") == 3, text("羅中彥共同運輸第二級毒品，處有期徒刑", term, "。陳大文共同運輸第二級毒品，處有期徒刑柒年貳月。"))
        .otherwise(text("甲○○持有第三級毒品，處拘役", (k % 50 + 10).cast("string"), "日。"))
    )
    verdict = text(verdict, F.when(k % 17 == 0, "其餘被訴部分無罪。").otherwise(""))
    weight = F.when(k % 3 == 0, text("扣案物驗餘淨重", (k % 100).cast("string"), ".5", F.when(k % 6 == 0, "公斤").otherwise("公克"), "。")).otherwise("")
    cited = text(
        F.when(k % 4 == 0, "被告供出來源，依毒品危害防制條例第17條第1項規定減輕其刑。").when(k % 4 == 1, "本件與毒品危害防制條例第17條第1項規定不符，不得減輕其刑。").otherwise(""),
        F.when(k % 5 == 0, "犯罪情狀顯可憫恕，爰依刑法第59條規定酌量減輕其刑。").when(k % 5 == 1, "並無刑法第59條酌減其刑之餘地。").otherwise(""),
        F.when(k % 7 == 0, "符合刑法第62條自首。").otherwise(""), F.when(k % 8 == 0, "構成累犯。").otherwise(""),
    )
    code = _pick(tuple(HEADERS), k % 5)
    header = F.when(k % 9 == 0, HEADERS["KL"]).otherwise(_pick(tuple(HEADERS.values()), k % 5))
    plea = F.when(k % 13 == 0, "協商判決").otherwise("")
    return orders(spark, sf_dir).select(
        "k", text(code, k.cast("string")).alias("jid"), F.lit("20230101").alias("jdate"),
        F.when(k % 7 == 3, "竊盜").otherwise("違反毒品危害防制條例").alias("jtitle"), F.when(k % 12 == 5, "聲").otherwise("訴").alias("jcase"),
        text(header, "刑事判決", plea, "\n主　文\n", verdict, "\n犯罪事實\n", FACTS, weight, "\n理由\n", cited).alias("jfull"),
    ).repartition("jid")  # texts are columns of a table from here on, not expressions written out wherever they are read


ORDERS = f"""j AS (SELECT o_orderkey AS k, o_custkey % 5 AS v, ['KL', 'TP', 'SL', 'PC', 'TY'][o_orderkey % 5 + 1] || o_orderkey AS jid,
  ((o_orderkey % 6) * 12 + o_orderkey % 11 + 1)::INT AS term, (o_orderkey % 4 + 1)::INT AS level FROM orders)"""


@query(f"""WITH {ORDERS} SELECT jid, CASE v WHEN 4 THEN NULL WHEN 1 THEN (k % 6 + 1) * 12 ELSE term END::INT AS sentence_months, v = 1 AS is_aggregate_sentence, CASE v WHEN 4 THEN 0 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS n_sentence_counts,
  CASE v WHEN 3 THEN 2 ELSE 1 END AS n_defendants, CASE v WHEN 1 THEN term + 3 WHEN 3 THEN term + 86 ELSE 0 END AS sum_individual_months, v = 2 AS is_attempt, CASE v WHEN 2 THEN 24 END AS probation_months,
  CASE v WHEN 4 THEN (k % 50 + 10)::INT END AS detention_days, v = 0 AS can_convert_to_fine FROM j""")
def sentence_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_features(judgments(spark, sf_dir)).select(
        "jid", "sentence_months", "is_aggregate_sentence", "n_sentence_counts", "n_defendants", "sum_individual_months", "is_attempt", "probation_months",
        "detention_days", "can_convert_to_fine",
    )


@query(f"""WITH {ORDERS} SELECT jid, CASE WHEN k % 3 = 0 THEN (k % 100 + 0.5)::DOUBLE * CASE WHEN k % 6 = 0 THEN 1000 ELSE 1 END END AS max_drug_weight_g, k % 4 = 0 AS art17_1_applied, false AS art17_2_applied, k % 5 = 0 AS art59_applied,
  k % 7 = 0 AS self_surrender, k % 8 = 0 AS recidivism, [CASE v WHEN 2 THEN '販賣' WHEN 3 THEN '運輸' WHEN 4 THEN '持有' ELSE '施用' END] AS convicted_behaviors,
  CASE v WHEN 1 THEN [1, 2] WHEN 3 THEN [2] WHEN 4 THEN [3] ELSE [level] END AS convicted_drug_levels FROM j""")
def case_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_features(judgments(spark, sf_dir)).select(
        "jid", "max_drug_weight_g", "art17_1_applied", "art17_2_applied", "art59_applied", "self_surrender", "recidivism", "convicted_behaviors", "convicted_drug_levels"
    )


def factor_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jid and factors of two judgments in three: factor i is mitigating, aggravating, neutral or absent by (k + i) % 4."""
    k = F.col("k")
    which = lambda i: F.when((k + i) % 4 == 0, "mitigating").when((k + i) % 4 == 1, "aggravating").when((k + i) % 4 == 2, "neutral").otherwise("absent")
    of = F.create_map(*(x for i, f in enumerate(training.FACTORS) for x in (F.lit(f), F.struct(which(i).alias("direction"), F.lit("").alias("evidence")))))
    rows = orders(spark, sf_dir).where(k % 3 != 1)
    return rows.select(F.concat(_pick(tuple(HEADERS), k % 5), k.cast("string")).alias("jid"), of.alias("factors"))


_BEHAVIOR = "CASE v WHEN 2 THEN '販賣' WHEN 3 THEN '運輸' WHEN 4 THEN '持有' ELSE '施用' END"
_LEVEL = "CASE v WHEN 1 THEN [1, 2] WHEN 3 THEN [2] ELSE [level] END"
_GRAMS = "CASE WHEN k % 3 = 0 THEN (k % 100 + 0.5)::DOUBLE * CASE WHEN k % 6 = 0 THEN 1000 ELSE 1 END END"
_TRAINED = [
    "jid", "CASE v WHEN 1 THEN (k % 6 + 1) * 12 ELSE term END::INT AS sentence_months", "CASE WHEN k % 4 = 3 THEN 0 ELSE 100 + k % 15 END::INT AS jyear",
    "(k % 4 = 0)::INT AS art17_1", "0 AS art17_2", "(k % 5 = 0)::INT AS art59", "(k % 8 = 0)::INT AS recidivism", "(k % 7 = 0)::INT AS self_surrender", "(v = 0)::INT AS can_convert_to_fine",
    "(v = 1)::INT AS is_aggregate_sentence", "(v = 2)::INT AS is_attempt", "1 AS n_behaviors", "CASE v WHEN 1 THEN 2 ELSE 1 END AS n_drug_levels", "CASE WHEN v IN (1, 3) THEN 2 ELSE 1 END AS n_sentence_counts",
    "CASE v WHEN 1 THEN term + 3 WHEN 3 THEN term + 86 ELSE 0 END AS sum_individual_months", f"coalesce({_GRAMS}, -1.0) AS max_drug_weight_g", "(k % 3 = 0)::INT AS has_drug_weight", f"coalesce(ln(1 + {_GRAMS}), 0.0) AS log_drug_weight",
    *(f"(k % 3 <> 1 AND (k + {i}) % 4 = {d})::INT AS a57_{f}_{short}" for i, f in enumerate(training.FACTORS) for d, short in enumerate(training.DIRECTIONS)),
    *(f"({_BEHAVIOR} = '{b}')::INT AS \"b_{b}\"" for b in extract.BEHAVIORS), *(f"list_contains({_LEVEL}, {n})::INT AS lv_{n}" for n in extract.LEVELS),
    *(f"(jid[:2] = '{c}')::INT AS \"court_{c}\"" for c in training.COURT_CODES), "jid[:2] AS _court", "'20230101' AS _jdate", "CASE v WHEN 3 THEN 2 ELSE 1 END AS _n_def", "k % 6 = 1 AS _summary",
    f"{_BEHAVIOR} AS _conv_beh", f"array_to_string({_LEVEL}, ',') AS _conv_lv", "(v = 2)::INT AS _probation",
]


@query(f"WITH {ORDERS} SELECT {', '.join(_TRAINED)} FROM j WHERE v <> 4")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole training row of each judgment with a term: 62 features, id, label and seven columns beside."""
    k = F.col("k")
    code = _pick(tuple(HEADERS), k % 5)
    records = orders(spark, sf_dir).select(
        F.concat(code, k.cast("string")).alias("jid"), F.when(k % 4 == 3, "無").otherwise((100 + k % 15).cast("string")).alias("jyear"),
        F.when(k % 6 == 1, "簡").otherwise("訴").alias("jcase"), code.alias("court"),
    )
    # Features are written first, so that a condition on the label is not pushed down into their long expressions.
    features = materialise(extract.extract_features(judgments(spark, sf_dir)), "features")
    return training.training_rows(features, records, factor_documents(spark, sf_dir))


@query(f"""WITH {ORDERS}, n AS (SELECT *, unnest(CASE v WHEN 3 THEN ['羅中彥', '陳大文'] ELSE [''] END) AS defendant_name FROM j)
SELECT jid, defendant_name, CASE WHEN v = 4 THEN NULL WHEN v = 1 THEN (k % 6 + 1) * 12 WHEN defendant_name = '陳大文' THEN 86 ELSE term END::INT AS sentence_months, CASE v WHEN 4 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS n_sentence_counts,
  k % 4 = 0 AND defendant_name <> '羅中彥' AS art17_1_applied, k % 5 = 0 AND defendant_name <> '羅中彥' AS art59_applied, k % 8 = 0 AND defendant_name <> '羅中彥' AS recidivism FROM n""")
def split_defendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All judgments by defendant; what is said after the last name is of that defendant."""
    return extract.extract_features_per_defendant(judgments(spark, sf_dir)).select(
        "jid", "defendant_name", "sentence_months", "n_sentence_counts", "art17_1_applied", "art59_applied", "recidivism"
    )


@query(f"""WITH {ORDERS} SELECT jid, jid[:2] AS court, CASE jid[:2] WHEN 'KL' THEN '基隆' WHEN 'TP' THEN '臺北' WHEN 'SL' THEN '士林' WHEN 'PC' THEN '新北' ELSE '桃園' END AS court_name FROM j
WHERE (k % 9 <> 0 OR k % 5 = 0) AND k % 7 <> 3 AND k % 12 <> 5 AND k % 13 <> 0 AND k % 17 <> 0""")
def corpus_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_filter.select_cases(judgments(spark, sf_dir), corpus_filter.ALL_COURTS).select("jid", "court", "court_name")


# Weighing blocks in which each of the ten factors stands, in favour of the defendant, against, or by name alone.
WEIGHING = (
    "爰以行為人責任為基礎，審酌被告一時失慮，受刺激而犯，手段尚屬平和，素行良好，並無前科，其施用行為戕害自身健康，犯後坦承犯行，兼衡其高中畢業之智識程度、"
    "家庭經濟狀況勉持、與被害人之關係、違反義務之程度等一切情狀，量處如主文所示之刑，以資懲儆。",
    "爰以行為人責任為基礎，審酌被告意圖營利，為牟取私利，圖一己私利，犯罪時受挑釁，手段兇殘，素行不佳，故態復萌，漠視法令禁制，危害社會治安，戕害他人，"
    "犯後矢口否認犯行，毫無悔意，兼衡其國中畢業之教育程度、家境勉持，量處如主文所示之刑，以資懲儆。",
    "爰審酌被告犯罪之動機、目的、手段、所受刺激、品行、素行、學歷、生活狀況、所生危害及犯後態度等一切情狀，量處如主文所示之刑，以資懲儆。",
)
ARGUED = "一、被告於上開時間、地點為警查獲，有卷附之搜索筆錄、扣押物品目錄表及鑑定書在卷可稽，事證明確，應依法論科。" * 4


def weighed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jid, jfull: judgments with the weighing blocks in turn, a line of each broken in the middle of a word."""
    k = F.col("k")
    body = [f"臺灣基隆地方法院刑事判決\n主文\n甲處有期徒刑參月\n事實及理由\n{ARGUED}\n{w.replace('程度', '程' + chr(10) + '  度')}\n中華民國112年1月1日\n法官 某" for w in WEIGHING]
    rows = orders(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k")  # a small file is one task's otherwise
    return rows.select(F.concat(_pick(tuple(HEADERS), k % 5), k.cast("string")).alias("jid"), _pick(body, k % 3).alias("jfull"))


# The directions in the order of factors: m, a, n, or - for absent; read off each labeler's rules for the three blocks.
@query(f"""WITH {ORDERS}, d(v, labeler, found) AS (VALUES
  (0, 'L1', '-nmnmnnnmm'), (0, 'L2', 'mmmnmnnamm'), (0, 'L3', '-nmn-nnnmm'), (0, 'L4', '-nmnnnnamm'), (0, 'L5', '-nmnmnn-mm'),
  (1, 'L1', 'amanan--aa'), (1, 'L2', 'a-anan--aa'), (1, 'L3', 'a-an-n--aa'), (1, 'L4', '-nanan---a'), (1, 'L5', 'a-anan-aaa'),
  (2, 'L1', 'nnnnnn--nn'), (2, 'L2', 'nmnnnn---n'), (2, 'L3', 'nnnnnn----'), (2, 'L4', 'nnnn-----n'), (2, 'L5', 'nnnnnn--nn')),
f(factor, place) AS (SELECT unnest(['motive', 'provocation', 'means', 'life_status', 'character', 'intellect', 'relation_victim', 'duty_breach', 'harm', 'post_attitude']), unnest(range(1, 11)))
SELECT jid, labeler, factor, CASE substr(found, place, 1) WHEN 'm' THEN 'mitigating' WHEN 'a' THEN 'aggravating' WHEN 'n' THEN 'neutral' ELSE 'absent' END AS direction, true AS fits
FROM j JOIN d ON d.v = k % 3 CROSS JOIN f""")
def factor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fits: the evidence is the stretch of the judgment at its place, white space apart, of 20 to 80 characters; empty if absent."""
    found = labelers.labelled(weighed(spark, sf_dir)).select("jid", "jfull", F.explode("labels").alias("labeler", "factors"))
    bare = lambda x: F.replace(F.replace(x, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))

    def checked(_: Column, f: Column) -> Column:
        stretch, n = F.substring("jfull", f["start"] + 1, f["end"] - f["start"]), F.length(f["evidence"])
        fits = F.when(f["direction"] == "absent", n == 0).otherwise((bare(stretch) == bare(f["evidence"])) & (n >= 20) & (n <= 80))
        return F.struct(f["direction"].alias("direction"), fits.alias("fits"))

    # Checked beside the text, before there is a row for each factor.
    each = found.select("jid", "labeler", F.explode(F.transform_values("factors", checked)).alias("factor", "f"))
    return each.select("jid", "labeler", "factor", "f.direction", "f.fits")


@query(f"""WITH {ORDERS} SELECT jid, t.policy, CASE k % 3 WHEN 2 THEN t.short ELSE t.long END AS opens FROM j CROSS JOIN (VALUES
  ('L1', '爰以', '爰審'), ('L2', '審酌', '爰審'), ('L3', '爰以', '爰審'), ('L4', '爰以', '爰審'), ('L5', '爰以', '爰審'), ('offsets', '爰以', '爰審')) t(policy, long, short)""")
def weighing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the block of each judgment begins under each policy."""

    many = len(labelers.LOCATORS)

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            which, texts = pd.factorize(batch["jfull"])  # equal texts of a batch are read once
            opens = []
            for text in texts:
                for policy, how in labelers.LOCATORS.items():
                    a, b = labelers.reasons_at(text, labelers.REASONS.get(policy, labelers.REASONS["L4"]))
                    low, high = labelers.block_at(text[a:b], how)
                    opens.append(text[a:b][low:high][:2])
            found = np.array(opens, dtype=object).reshape(-1, many)[which].reshape(-1)
            yield pd.DataFrame({"jid": np.repeat(batch["jid"].to_numpy(), many), "policy": list(labelers.LOCATORS) * len(batch), "opens": found})

    return weighed(spark, sf_dir).mapInPandas(run, "jid string, policy string, opens string")


def _numeral(n: Column) -> Column:
    """A number under 10,000 as it is written."""
    place = lambda size: F.floor(n / size) % 10
    zero = lambda size: F.when((place(size) == 0) & (n > size) & (n % size > 0) & (place(size / 10) > 0), "零").otherwise("")
    some = lambda size, unit: F.when(place(size) > 0, F.concat(_pick(DIGITS, place(size)), F.lit(unit))).otherwise(zero(size))
    tens = F.when((n >= 10) & (n < 20), "十").otherwise(some(10, "十"))
    return F.concat(some(1000, "千"), some(100, "百"), tens, _pick(DIGITS, n % 10))


@query("SELECT o_orderkey AS k, (o_orderkey % 9999 + 1)::INT AS n FROM orders")
def cn_numeral(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return orders(spark, sf_dir).select("k", numerals.numeral(_numeral(k % 9999 + 1)).alias("n"))


@query("SELECT o_orderkey AS k, ((o_orderkey % 99 + 1) || '.' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0'))::DOUBLE AS x FROM orders")
def cn_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    digits = F.lpad((k % 1000).cast("string"), 3, "0")
    spoken = F.concat(_numeral(k % 99 + 1), F.lit("點"), F.translate(digits, "0123456789", "零一二三四五六七八九"))
    return orders(spark, sf_dir).select("k", numerals.decimal(F.when(k % 2 == 0, spoken).otherwise(F.concat((k % 99 + 1).cast("string"), F.lit("."), digits))).alias("x"))


@query("""WITH c AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'f' WHEN 2 THEN o_orderkey || '.9' WHEN 3 THEN ' -' || o_orderkey WHEN 4 THEN 'a, b' || o_orderkey || ' ,,a' ELSE '' END AS cell FROM orders)
SELECT k, CASE WHEN lower(trim(cell)) IN ('1','true','t','y','yes','v') THEN true WHEN lower(trim(cell)) IN ('0','false','f','n','no','x') THEN false END AS b, trunc(try_cast(trim(cell) AS DOUBLE))::INT AS i,
  list_sort(list_distinct(list_filter(list_transform(string_split(cell, ','), lambda x: trim(x)), lambda x: x <> ''))) AS s FROM c""")
def label_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    key = k.cast("string")
    cell = (
        F.when(k % 6 == 0, " Yes ").when(k % 6 == 1, "f").when(k % 6 == 2, F.concat(key, F.lit(".9"))).when(k % 6 == 3, F.concat(F.lit(" -"), key))
        .when(k % 6 == 4, F.concat(F.lit("a, b"), key, F.lit(" ,,a"))).otherwise("")
    )
    rows = orders(spark, sf_dir).withColumn("cell", cell)
    c = F.col("cell")
    return rows.select("k", labels.parse_bool(c).alias("b"), labels.parse_int(c).alias("i"), F.array_sort(labels.parse_set(c)).alias("s"))
