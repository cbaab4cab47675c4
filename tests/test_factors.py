"""Labels of short reasons by five labelers, their evidence, prefilter and policies."""

import re

import pytest

from corvia.operators import labelers as L
from corvia.operators.training import FACTORS
from corvia.plans import judgments
from corvia.plans.judgments import ARGUED, WEIGHING


def judgment(weighing, before=ARGUED):
    return f"主文\n甲處有期徒刑3月\n事實及理由\n{before}\n{weighing}\n中華民國112年1月1日\n法官 某"


MIXED = (
    "爰以行為人責任為基礎，審酌被告前因施用毒品案件，仍未能戒除毒癮，故態復萌，惟其犯行戕害自\n  身健康，手段尚屬平和，兼衡其犯罪動機、"
    "高中畢業之智識程度、家庭經濟狀況勉持，犯後坦承犯行，態度尚可等一切情狀，量處如主文所示之刑。沒收部分從略。"
)


def test_directions_and_evidence(spark):
    rows = [("KL1", judgment(MIXED)), ("KL2", "無"), ("KL3", judgment(MIXED.replace("坦承犯行，態度尚可", "矢口否認犯行"))), ("KL4", None)]
    got = {(r.jid, r.labeler): r.factors for r in L.label_factors(spark.createDataFrame(rows, "jid string, jfull string")).collect()}
    assert len(got) == 20
    first = {k: v["direction"] for k, v in got["KL1", "L1"].items()}
    assert first == {
        "motive": "neutral", "provocation": "absent", "means": "mitigating", "life_status": "neutral", "character": "aggravating", "intellect": "neutral",
        "relation_victim": "absent", "duty_breach": "absent", "harm": "mitigating", "post_attitude": "mitigating",
    }
    assert got["KL1", "L2"]["harm"]["evidence"] == "萌，惟其犯行戕害自\n  身健康，手段尚屬"  # as it was, line break and all
    assert got["KL1", "L1"]["harm"]["evidence"] == "審酌被告前因施用毒品案件，仍未能戒除毒癮，故態復萌，惟其犯行戕害自身健康"
    for labeler in L.LABELERS:
        for v in got["KL1", labeler].values():
            if v["direction"] == "absent":
                assert v["evidence"] == "" and v["start"] == -1
            else:
                stretch = judgment(MIXED)[v["start"] : v["end"]]
                assert 20 <= len(v["evidence"]) <= 80 and "".join(stretch.split()) == "".join(v["evidence"].split())
                assert labeler == "L1" or stretch == v["evidence"]
        for jid in ("KL2", "KL4"):
            assert all(v["direction"] == "absent" and v["evidence"] == "" for v in got[jid, labeler].values())
        assert got["KL3", labeler]["post_attitude"]["direction"] == "aggravating"


def test_each_labeler_has_each_factor_and_rows_round_trip(spark):
    for labeler, rules in L.RULES.items():
        assert {r.factor for r in rules} == set(FACTORS) and all(r.labeler == labeler for r in rules)
    assert L.rules_of(L.rule_table(spark)) == {k: sorted(v, key=lambda r: (r.factor, r.place)) for k, v in L.RULES.items()}


def test_prefilter_loses_no_hit():
    assert L.needed_literal("竟[未仍][能思]") == "竟" and L.needed_literal("戕害他人|助長") == "" and L.needed_literal("手段(?:尚屬|尚稱)?平和") == "手段"
    texts = [w + MIXED for w in WEIGHING] + ["前有前科素行不佳，惡性非輕，竟再犯，家中需其扶養，經濟貧寒，月薪3萬，從事餐飲業，數量尚微，危害甚鉅。"]
    for rules in L.RULES.values():
        for r in rules:
            target = r.pattern.partition("&&")[0]
            literal = L.needed_literal(target)
            for t in texts:
                t = "".join(t.split())
                assert not re.search(target, t) or literal in t


def test_rules_are_a_parameter(spark):
    own = {"L4": [L.Rule("L4", "harm", 0, 0, "aggravating", "戕害自身", False)]}
    (r,) = L.label_factors(spark.createDataFrame([("a", judgment(MIXED))], "jid string, jfull string"), ("L4",), own).collect()
    assert set(r.factors) == {"harm"} and r.factors["harm"]["direction"] == "aggravating"


@pytest.mark.parametrize("cut", [L.snapped, L.clipped, L.expanded, L.padded, L.trimmed])
def test_evidence_covers_the_hit_within_bounds(cut):
    text = "甲，乙丙丁。" * 40
    for a in range(0, len(text) - 30, 7):
        for n in (1, 5, 19, 30):
            low, high = cut(text, a, a + n)
            assert low <= a and high >= a + n and 20 <= high - low <= 80
    low, high = cut("短文，共十個字", 2, 4)
    assert (low, high) == (0, 7) or high - low <= 7


def test_policies_of_blocks():
    text = "本院審酌證據能力如下。" + "甲" * 90 + "刑事訴訟法第159條。" + "乙" * 200 + "審酌被告前經判刑，品行、智識，犯後態度良好，量處如主文。" + "丙" * 60 + "以資懲儆。" + "丁" * 200
    found = {k: text[slice(*L.block_at(text, how))] for k, how in L.LOCATORS.items()}
    assert found["L1"].startswith("審酌被告前經") and found["L1"].endswith("丙")  # 30 characters past the end
    assert found["L2"].startswith("審酌被告前經") and found["L2"].endswith("丁")
    assert found["L3"] == text[:1500]  # both openings have as many words in their reach, so the first
    assert found["L4"].startswith("審酌被告") and len(found["L4"]) == text.index("量處如主文") + 5 + 100 - text.index("審酌被告")
    assert found["offsets"].startswith("審酌被告") and found["L5"].startswith("審酌被告")
    assert L.block_at("無", L.LOCATORS["L3"]) == (0, 0) and L.block_at("無", L.LOCATORS["L5"]) == (0, 1)


def test_reasons_by_labeler():
    text = judgment(MIXED)
    a, b = L.reasons_at(text, L.REASONS["L4"])
    assert text[a:b].strip().startswith("一、") and "法官" not in text[a:b]
    short = "主文\n理由\n短\n犯罪事實\n也短\n書記官"
    assert {k: short[slice(*L.reasons_at(short, how))] for k, how in L.REASONS.items()} == {
        "L1": short, "L2": short, "batch": short, "L3": "", "L4": "\n也短\n", "L5": "\n也短\n",
    }
    assert L.model_text("前言主文甲中華民國1年\n理由 中華民國 112 年 1月") == "主文甲" or L.model_text("前言主文甲中華民國1年x中華民國112年") == "主文甲中華民國1年x"


def test_votes(spark):
    found = L.united(L.label_factors(spark.createDataFrame([("KL1", judgment(MIXED))], "jid string, jfull string"))).collect()
    votes = {r.factor: r.votes for r in found}
    assert votes["means"] == {"mitigating": ["L1", "L2", "L3", "L4", "L5"]} and sum(map(len, votes["motive"].values())) == 5


def test_equal_texts_of_a_batch_are_read_once(spark, monkeypatch, tmp_path):
    log = tmp_path / "read"
    plain = L.Judgment.__init__

    def counted(self, whole):
        with open(log, "a") as f:
            f.write("x")
        plain(self, whole)

    monkeypatch.setattr(L.Judgment, "__init__", counted)
    rows = [(f"KL{i}", judgment(MIXED) if i % 2 else None) for i in range(200)]
    found = L.label_factors(spark.createDataFrame(rows, "jid string, jfull string").coalesce(1), ("L4",)).collect()
    assert len(log.read_text()) == 2 and [r.jid for r in found] == [j for j, _ in rows]
    one, none = found[1].factors, found[0].factors
    assert all(r.factors == (one if int(r.jid[2:]) % 2 else none) for r in found) and one != none


def test_weighing_blocks_reads_equal_texts_once(spark, monkeypatch, tmp_path):
    log, plain = tmp_path / "read", L.block_at

    def counted(text, how):
        with open(log, "a") as f:
            f.write("x")
        return plain(text, how)

    monkeypatch.setattr(L, "block_at", counted)
    n = judgments.weighing_blocks(spark, "/root/testdata/sf0.001").count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert n == 6 * spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count() and 0 < len(log.read_text()) <= parts * 3 * 6
