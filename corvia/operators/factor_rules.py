"""Headings, openers, ends and rules of the first labeler of the ten sentencing factors; labelers reads them.

Rules are factor, direction and pattern in order of precedence. Texts are read without white space, so patterns have none.
"""

from __future__ import annotations

# Headings of the reasons, stamps that end them, openers and ends of the weighing block.
REASONS = ("事實及理由", "理由", "論罪科刑")
_DATE = r"中\s*華\s*民\s*國\s*\d{2,3}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日"
REASON_ENDS = (rf"{_DATE}(?:[\s\S]{{0,200}}?(?:法\s*官|書\s*記\s*官))", rf"{_DATE}\s*\n\s*\S{{0,30}}?(?:法\s*官|簡易庭|刑事第)", r"附\s*錄(?:本案)?\s*論\s*罪")
OPENERS = (
    r"爰以.{0,20}?責任[為基礎之]+[，,].{0,5}?審酌", r"爰[審衡考].{0,2}?[酌量]", r"(?:[\(（一二三四五六七八九十]+[\)）]|[一二三四五六七八九十][、,．])爰?審酌被告",
    r"審酌[^。]{0,30}?(?:犯罪之?動機|犯罪手段|犯後態度|前案紀錄|無視於|漠視)", r"審酌被告(?!.{0,5}?(?:前案|事實|證據|構成累犯))", r"考量被告(?:無|不|有|曾)",
    r"兼衡其?等?(?:[^。]{0,30}?(?:犯罪之?動機|犯後態度|參與情節))",
)
BLOCK_ENDS = (r"量處(?:如?主文|[本宣]告)?", "分別量處", "處以主文", "科處如主文", "以資[懲儆警]", "附錄", "沒收部分")
PUNCTUATION = "，。；：、,;:!?"

# Rules of the ten factors, by precedence of direction, then of pattern.
RULES: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    "motive": (
        ("aggravating", ("圖一己之?[私利]+", "圖[謀牟取]+(?:暴?利|私?利)", "為[供賺]?營利", "獲取(?:不法)?利益", "圖賺(?:取)?差價", "以營利[為之]", "為謀[個取]人?[私之]利", "僅圖一己", "為謀[取賺]?[暴利之私]+", "竟為[謀取]個人[私之]?利")),
        ("neutral", ("動機(?:[、，,]目的)?", "犯罪之?動機", "目的在?[供於解癮戒減毒]+", "動機[在於為]+解癮", "動機|目的")),
    ),
    "provocation": (
        ("mitigating", ("挑釁", "因[何之].{0,5}?刺激", "被害人.{0,5}?[挑刺激釁]")),
        ("neutral", ("所受之?[剌刺]激", "受[何之]?[剌刺]激")),
    ),
    "means": (
        ("aggravating", ("手段[兇殘暴]+", "殘忍", "兇殘", "以[強暴脅迫]+手段")),
        ("mitigating", ("手段(?:尚屬|尚稱)?平和", "手段非暴力", "犯罪手段[尚屬]+平和")),
        ("neutral", ("犯罪之?手段", "手段[、，,]情節", "手段(?:[、，,]分?工?角色)?")),
    ),
    "life_status": (
        ("neutral", (
            "家境?(?:庭)?(?:經濟)?(?:狀況)?(?:勉持|小康|貧寒|富裕|尚可|清寒|普通)", "經濟狀況(?:勉持|小康|貧寒|富裕|尚可|清寒|普通)", "家庭[暨及](?:經濟)?(?:狀況)?", "家庭經濟",
            "家境之?[勉持小康貧寒尚]+", "自[陳述].{0,10}?(?:已婚|未婚|離婚|月入|月薪|從事|業[工農商醫]+)", "從事[^。，]{0,15}?(?:業|工作)", r"月[薪入]\d", "家中(?:無人)?[經需].{0,10}?扶養",
            "已離婚", "未婚", "小康(?:之)?(?:家庭)?", "勉持", "生活狀況", "曾從事", "陳述[^。]{0,10}?(?:學歷|家庭)", "待業中",
        )),
    ),
    "character": (
        ("mitigating", ("前無犯罪紀錄", "未曾因故意犯罪", "前未曾[因受犯]", "素行[良佳]+", "素行尚[佳良可]", "無前科", "並無前科", "無犯罪前科")),
        ("aggravating", (
            "前案紀錄.{0,80}?(?:猶未能|仍未能|不知悔改|惡性|顯難|足認其自制力)", "自制力薄弱", "反省[之心]+不足", "反省之心不足", "前科累累", "屢[犯次]+", "惡性[非難重大]+", "惡性非輕", "不可謂無惡性",
            "曾因施用毒品.{0,80}?(?:猶未能|仍未能|不知悔改)", "前因.{0,20}?案件.{0,40}?(?:猶未能|仍未能|不知悔改)", "戒毒意志不堅", "毒癮非淺", "刑罰反應[力性]+[薄顯]?弱",
            "未因[先前]+.{0,20}?(?:遭查獲|遭判處|執行).{0,30}?(?:改弦更張|悔過改新)", "並未改弦更張", "未能悔過改新", "故態復萌", "再犯",
            "觀察、?勒戒.{0,30}?(?:仍未|猶未|未能|不思|不知|未戒|再犯|再施用|又犯)", "勒戒後.{0,30}?(?:仍未|猶未|未能|不思|不知)", "戒斷決心[不薄欠]", "再三施用", "屢次施用", "未戒除毒癮", "不思悔改",
            "猶再[犯施]", "竟再[犯施]", "不知戒除", "一再施用", "竟不知戒", "前已因.{0,30}?(?:猶|仍|不|竟)", "猶未能深切體認",
        )),
        ("neutral", ("前案紀錄表", "素行(?:狀況)?", "前科素行", "被告前有", "前案")),
    ),
    "intellect": (
        ("neutral", (
            "智識程度[^，。]{0,30}?(?:畢業|肄業)", "(?:高中|高職|國中|國小|大學|碩士|博士|大專|專科|研究所|國民小學)(?:畢業|肄業)", "教育程度[^，。]{0,30}?(?:畢業|肄業)",
            "自[陳述][^，。]{0,15}?(?:高中|高職|國中|國小|大學|碩士|博士|專科)", "智識程度", "教育程度", "(?:畢業|肄業)(?:之?智識程度)?", "陳述[^。]{0,5}?學歷", "自述[^。]{0,5}?學歷", "學歷[^。]{0,10}?(?:、|為)",
        )),
    ),
    "relation_victim": (("neutral", ("與被害人之?關係", "與被害人[^，。]{0,20}?(?:朋友|親屬|家人|無|關係)")),),
    "duty_breach": (("neutral", ("違反.{0,10}?義務(?:之?程度)?", "義務違反")),),
    "harm": (
        ("aggravating", (
            "戕害國民", "戕害他人", "危害社會[治安秩序善良風俗]+", "對社會[深具造成危害]+", "嚴重危害", "危害[甚至重大匪非]+[淺鉅]?", "助長毒品[流通蔓延氾濫風氣濫用]+", "助長濫用", "影響社會[秩序治安善良風俗]+",
            "敗壞社會", "流毒甚廣", "危害非淺", "危害匪淺", "造成毒品之?流通", "足以戕害", "危害[甚社會國家公共非]+", "危害[國民健康公]+", "傷害社會",
        )),
        ("mitigating", (
            "戕害自[身己]", "戕害其[個自身己]", "戕害個人", "未直接侵害他人法益", "以自我身心侵害為主", "反社會性之?程度較低", "自戕行為", "未對他人造成危害", "對他人法益尚無重大明顯", "未流傳於眾", "非難性較低",
            "所生損害尚非[鉅大重]+", "戕害[其自個][身心個人己]+",
        )),
        ("neutral", ("危害", "損害", "所生之?危害")),
    ),
    "post_attitude": (
        ("aggravating", ("矢口否認", "否認犯行(?!.{0,10}?(?:不諱|然))", "飾詞狡辯", "態度[不欠][佳良]", "無[悔愧]意", "毫無悔意", "未見悔[意悟]+")),
        ("mitigating", (
            "坦[承認]犯行", "承認犯行", "坦承(?:不諱|本案)", "坦[認承]不諱", "自白犯行", "已見悔意", "態度[尚良好可佳]+", "知所悔悟", "確有悔意", "態度尚可", "態度良好", "犯[後罪](?:坦承|認罪|自白|承認)",
            "犯罪後之?(?:坦承|認罪|承認)", "於[偵警審][中時]?(?:坦承|自白|認罪|承認)[犯本不]", "被告[認坦]罪",
        )),
        ("neutral", ("犯後態度", "犯罪後之?態度")),
    ),
}
