"""Rules of four more labelers of the ten sentencing factors, as rows of text; the first one's are in factor_rules.

A line names factor and direction, then patterns by precedence. A direction with + is looked for in the whole reasons
where the weighing block lacks it; "seen" leaves the direction to the words of the evidence; a pattern with &&
counts only where what follows occurs too. Texts are read without white space, so patterns have none.
"""

# The patterns of each labeler, in order.
# fmt: off
L2 = r"""
motive aggravating: 漠視[^。]{0,15}?(?:法令|禁制|誡命) 輕忽[^。]{0,8}?(?:毒品|戕害|健康) 未見其?戒除 未能戒[除絕] 未能記取教訓 未能體[悟認] 不知戒[慎除] 不知悔[改悟]
  猶未能 再三施用 屢[次犯] 自制力薄弱 缺乏戒[斷除] 戒毒決心不強 戒毒意志不堅 毒癮非淺 無視[於於][^。]{0,15}?(?:禁令|誡命|嚴禁|告誡|法令) 故態復[萌發] 未思悛悔 竟[未仍][能思] 竟再 執意 猶再犯
  猶不知 反覆再犯 不思悔[改悟] 輕縱自我 無視[^。]{0,8}?(?:法律|法令|禁制|誡命|嚴禁|告誡|規範) 擅自持有 擅自[施販轉] 竟[擅持施販] 非法[施持] 應予非難 圖[一謀]?己[私利之] 圖[利己] 輕忽
  危害國民 罔顧[^。]{0,8}?(?:法律|法令|禁制|誡命) 明知[^。]{0,15}?(?:不可|禁制|為毒品|危害) 竟為[一私]己 竟仍
motive mitigating: 成癮性 心理依賴 一時失慮 一時[失誤][念慮]
motive neutral: 犯罪動機[、，]?目的 動機[、，]目的[、，]?手段 持有毒品[^。]{0,4}?(?:動機|目的) 被告犯罪之?動機 參酌[^。]{0,4}?犯罪[^。]{0,4}?動機
provocation mitigating: 受[^。]{0,4}?刺激 因[^。]{0,8}?所激 激於義憤 一時失慮
means mitigating: 手段尚?屬平和 犯罪手段[尚屬]*平和 手段平和
means aggravating: 手段兇殘 手段殘忍 手段惡劣
means neutral: 犯罪[^。]{0,5}?(?:動機|目的)[、，]?手段 手段[、，]情節 目的[、，]手段 動機[、，]目的[、，]手段 手段[、，]品行 行為手段
life_status neutral: 家[境庭][^。]{0,8}?(?:勉持|小康|普通|尚可|寬裕|貧寒) 經濟狀況[^。]{0,15}?(?:勉持|小康|普通|尚可|寬裕|貧寒)
  自[陳述承][^。]{0,10}?(?:家[境庭]|生活狀況|經濟) 自述[^。]{0,10}?(?:家[境庭]|生活狀況|經濟) 生活狀況 家[境庭]狀況 家庭經濟
  自[陳述承][^。]{0,15}?(?:從事|工作|業|職業|未婚|已婚|離婚|月收|無業) 職業[、，]經濟 工作[、，]經濟 學歷[、，]職業[、，]經濟 學歷[、，]工作 教育程度[^。]{0,4}[、，]職業 自陳業 暨其生活
character aggravating+: 前[科案]紀?錄[^。]{0,15}?(?:不佳|多次|屢|累) 素行不佳 累犯 曾因施用毒品 前已?因[^。]{0,8}?(?:觀察|勒戒)
  觀察[、,]?勒戒[^。]{0,15}?(?:仍|猶|未) 屢[次犯][^。]{0,10}?(?:相同|施用|毒品) 具有特別惡性 前因.{0,15}?判處 多次[^。]{0,8}?(?:施用|前科|前案) 前科紀錄 前案紀錄
character mitigating+: 素行尚?[佳良] 無前[科案] 並無前[科案]
character neutral: 素行 品行
intellect neutral: 智識程度[^。]{0,15}?(?:國[中小]|高[中職]|大[學專]|專科|碩士|博士|肄業|畢業)
  教育程度[^。]{0,15}?(?:國[中小]|高[中職]|大[學專]|專科|碩士|博士|肄業|畢業) 自[陳述承][^。]{0,8}?(?:國[中小]|高[中職]|大[學專]|碩士|博士|肄業|畢業)
  自[陳述承][^。]{0,8}?(?:智識程度|教育程度|學歷) 智識程度 教育程度 學歷
relation_victim neutral: (?:被害人|告訴人)[^。]{0,15}?(?:關係|為)
duty_breach aggravating: 違反[^。]{0,8}?(?:義務|告誡|職責) 漠視[^。]{0,4}?(?:義務|告誡|職責)
harm aggravating: 戕害他人|助長[^。]{0,12}?(?:不良風氣|風氣|氾濫|歪風)|影響社會治安|危害他人身心
harm mitigating: 戕害[^。]{0,4}?自[身己我] 戕害[^。]{0,4}?個人 戕害[^。]{0,4}?己身 戕害本人 戕害自身健康 自我身心侵害為主 自我[身殘戕]害 自我[^。]{0,4}?身心 自戕行為
  自殘行為 侵害[^。]{0,8}?自[身己] 屬戕害自身 僅屬戕害 對他人法益[^。]{0,15}?(?:無|尚無|並無) 反社會性[^。]{0,4}?(?:程度)?較?低 非難性[尚較]?低
  對社會[^。]{0,8}?危害[^。]{0,8}?(?:尚非直接|非直接|尚無|尚非) 未[實侵][際害][^。]{0,8}?他人 未侵[害犯][^。]{0,4}?(?:他人|其他) 未直接危害
  未對他人[造產][^。]{0,4}?(?:危害|損害|傷害) 非可與侵害他人 對己身健康 終究非可 所生損害尚?非[鉅大重] 所生危害尚?非 亦未因此而危害他人 未危及他人 持有之?數量尚?微 數量尚?微 數量非[鉅大]
  弊害非[鉅大] 持有[^。]{0,4}?時間短暫 所生危害並非重大
harm aggravating: 危害[^。]{0,4}?(?:社會|公共|國家)甚[鉅大] 危害甚鉅 造成[^。]{0,8}?(?:社會|家庭)嚴重 嚴重危害 助長[^。]{0,12}?(?:不良風氣|毒品|施用|風氣|氾濫|歪風)
  危害[^。]{0,4}?(?:他人|國民)[^。]{0,4}?身心 戕害他人 影響社會治安 毒品流[竄通] 造成[^。]{0,4}?治安 危害國民 危害治安
post_attitude mitigating: 坦[承認][全所]?犯行 坦[承認]不諱 坦[承認]犯罪 坦[承認][^。]{0,4}?犯行 自白犯行 態度[尚良][好佳] 態度良好 見悔意 悔悟 知[所有]?悔[悟改過]
  犯後坦[承認] 於警詢[、,及和]?偵查[^。]{0,15}?坦[承認] 自首 認[罪錯]
post_attitude aggravating: 否認犯行 矢口否認 飾詞否認 無悔意 毫無悔[意改] 態度[不甚][佳好] 態度惡劣 狡辯
post_attitude neutral: 犯後態度
"""

L3 = r"""
motive aggravating+: 意圖牟利 牟取暴利 為牟取私利 貪圖 為一己私利
motive neutral+: 犯罪之動機 犯罪動機 動機、目的 動機目的 之動機、目的 其動機
provocation neutral+: 所受刺激 犯罪時所受之刺激 受刺激
means mitigating+: 犯罪手段尚屬平和 手段尚屬平和 手段平和 情節非鉅 手段尚非殘酷 犯罪手段平和 手段非鉅
means aggravating+: 手段兇殘 手段惡劣 暴力相向 兇狠 手段卑劣
means neutral+: 犯罪之手段 目的、手段 手段、
life_status neutral+: 生活狀況 家境勉持 家境貧寒 家境小康 家境普通 經濟狀況 家庭狀況 經濟勉持 家庭經濟 家境清寒 勉持 勉強維持 家境不好 家境尚可
character aggravating+: 猶不知戒慎 再次漠視法令 再三施用毒品 未能戒除 仍不思悔改 猶未能 對於刑罰反應力薄弱 刑罰反應力薄弱 缺乏戒斷決心 顯然缺乏戒斷決心 猶不知悔改 猶不知警惕 猶不思悔改 前已因施用毒品
  再犯本罪 再三施用 再為本案犯行 其根絕毒害之意志不堅
character neutral+: 前科、素行 素行資料 其素行 品行 前案紀錄表
intellect neutral+: 智識程度 教育程度 學歷 國中畢業 高中畢業 高中肄業 國小畢業 大學畢業
relation_victim neutral: 與被害人 被害人之關係 與買家 與買受人
duty_breach neutral+: 違反義務 違反義務之程度 義務之違反
harm mitigating+: 僅屬戕害自身 戕害自身之行為 戕害自己身心健康 戕害自我身心健康 戕害其個人身心健康 未侵犯其他法益 未直接危害他人 未造成他人具體危害 尚未造成他人具體危害 反社會性之程度較低 戕害自我
  以自戕身心健康為主 戕害自己 以自戕為主 戕害自身 戕害己身 對己身健康戕害
harm aggravating+: 危害甚鉅 危害社會 危害國民身心健康 危害國民之身心健康 毒品造成諸多社會問題 對社會治安造成 對社會治安仍造成潛在危險 危害匪淺 為害匪淺 戕害國民身心 毒品擴散之危害 對社會造成之負擔
post_attitude aggravating+: 否認犯行 矢口否認 飾詞狡辯 犯後態度不佳 態度不佳 毫無悔意 無悔意 態度惡劣 百般狡辯 拒不認罪 態度欠佳 否認運輸 否認販賣 否認施用 否認持有 否認轉讓
post_attitude mitigating+: 坦承犯行 坦承施用 坦承全部犯行 犯後態度良好 態度良好 犯後坦承 坦認不諱 坦承不諱 見悔意 尚見悔意 犯後尚見悔意 態度尚可 犯後態度尚可 犯後自首 自首犯行 供出毒品來源 悔悟
  犯後坦白 坦承販賣 坦承運輸 坦承轉讓 坦承持有
"""

L4 = r"""
motive aggravating: 貪圖獲利 貪圖私利 為貪圖獲利 牟利 為私利 獲利動機
motive neutral: 犯罪動機 犯罪之動機 動機、目的 犯罪之動機、目的 犯罪動機、目的 其犯罪動機 其犯罪之動機 犯罪之目的 犯罪目的 施用毒品之目的
provocation neutral: 受刺激 受挑釁 因刺激
means aggravating: 手段兇殘 手段殘忍 手段惡劣
means mitigating: 犯罪手段尚屬平和 手段尚屬平和 手段平和 手段非暴力 犯罪手段非暴力 手段非屬殘暴
means neutral: 動機、目的、手段 目的、手段 犯罪手段 之手段 犯罪之手段
life_status neutral: 家境勉持 家庭經濟狀況勉持 經濟狀況勉持 經濟勉持 勉持之家庭 家境小康 家庭經濟狀況小康 經濟狀況小康 經濟小康 家境貧窮 家境貧困 經濟狀況貧寒 經濟狀況貧困 貧寒 貧困 勉強維持 家境普通
  家庭經濟狀況普通 家庭經濟狀況 家庭生活、經濟狀況 生活、經濟狀況 家庭情形 家庭狀況 未婚 已婚 離婚 與母同住 育有 與父母同住 生活狀況 經濟狀況 之生活情況
character aggravating: 素行不佳 素行不良 素行非佳 對刑罰反應力薄弱 對刑罰之反應力顯然薄弱 戒毒意志不堅 毒癮非淺 故態復萌 缺乏戒斷決心 再三施用 屢次施用 多次施用 未能改過 猶未能深切體認 漠視法令禁制
  漠視法令 輕忽毒品 未見其戒除惡習 戒除惡習 未戒除毒癮 仍不知戒除 故仍不思悔改 仍不思悔改 顯見被告無法戒除毒癮 猶未戒除 猶未深切體認 再為本案 再犯本案 復施用第 再為本案犯行 未能戒除
character neutral: 素行&&前案紀錄表|前科 前案紀錄
intellect neutral: 智識程度 教育程度 國小畢業 國小肄業 國中畢業 國中肄業 高中畢業 高中肄業 高職畢業 高職肄業 大學畢業 大學肄業 二、三專 二三專 專科畢業 研究所 高職異業
relation_victim neutral: 被害人&&與被害人之?關係
duty_breach aggravating: 違反義務
harm mitigating: 戕害自身 戕害己身 戕害自我 戕害自己身心 戕害施用者 對他人法益尚無重大 尚未直接危害他人 未對他人造成危害 未侵犯其他法益 未危及他人 對他人法益尚無 對社會造成之危害尚非 並未危及他人
  施用毒品僅係戕害 本質仍屬自殘行為 本質上乃屬戕害 未流傳於眾 對他人法益及社會安全尚無重大 尚未造成他人具體危害 未造成他人具體危害 戕害自我身心 對他人法益尚無重大明顯之實害 尚未有嚴重破壞社會秩序 所生損害尚非鉅大
harm aggravating: 危害甚鉅 危害甚深 戕害甚鉅 為害之鉅 對社會秩序有相當程度之危害 潛在危害 輕則戕害施用者 重則引發各種犯罪 為社會治安敗壞之源頭 對社會風氣、治安 助長毒品散布
post_attitude aggravating: 未坦認犯行 否認犯行 矢口否認 未坦承犯行 未坦認本次 未到案坦承 犯後竟未坦承 犯後始終否認 犯後仍否認 未坦承本次施用 經傳喚未到庭 犯後否認 態度難謂良好 態度未佳 未到庭說明
  態度不佳 犯後飾詞卸責 飾詞卸責 卸責之詞 態度輕慢 卸責態度 犯後並無悔意 未見悔意 毫無悔意 堅不認罪
post_attitude mitigating: 坦承犯行 坦認犯行 坦承施用 承認犯行 坦承本件 坦承全部犯行 犯後態度尚佳 犯後態度良好 犯後態度尚可 態度良好 態度尚可 態度尚佳 犯罪後坦承 犯後坦承 犯後坦認 坦認施用 坦承全部
  已坦承 尚見悔意 尚有悔悟 有悔悟 犯罪後已坦承 尚知自首 悔悟 自首 自白 犯後自首 見悔意 犯後悔悟 有悔意 已知悔悟 示悔意 尚有悔意 態度尚良好
post_attitude neutral: 犯後態度 犯罪後之態度
"""

L5 = r"""
motive seen: 基於施用毒品之動機[^，。]{0,40} 基於販賣[^。]{0,15}毒品[^。]{0,20}犯意 意圖營利 犯罪動機[、，]?目的 犯罪[之的]?動機[、，]?目的 動機[、，]目的 動機[、，]?手段
  其犯罪[之的]?動機 動機[及與]目的 犯罪[之的]?動機 動機
provocation neutral: 所受[之]?刺激 受刺激
means mitigating: 犯罪手段尚屬平和 犯罪手段[尚屬非]?平和 手段尚屬平和
means aggravating: 手段[兇殘] 手段惡劣
means neutral: 犯罪[之的]?[動機目的手段，、]+ 手段[、，] 所用之手段 犯罪[之的]?手段 動機[、，]目的[、，]手段 目的[、，]手段 動機[及與]方法 手段
life_status mitigating: 需扶養[^。]{0,30} 須扶養[^。]{0,30} 扶養[^。]{0,15}(?:母親|外公|父親|妻|子女|幼) 需照顧[^。]{0,30} 經濟貧[寒困] 家境清寒 獨力扶養
life_status neutral: 家庭經濟狀況[勉小普良中富][持康通好裕] 家境[勉小普][持康通] 家境勉持 勉強維持之?家庭經濟 自[述陳][^。]{0,30}家庭經濟 家庭經濟狀況 家庭經濟 經濟狀況 家庭狀況 生活狀況
  從事[^。]{0,15}業[^。]{0,5}[，、。] 業[工農服商粗園美調無待] 自陳[^。]{0,15}從事 業[工農粗服] 未婚無子女 職業 家境
character aggravating: 猶未能深切體認 惡習已深 再犯性極高 自制力薄弱 戒毒[意決]志不[堅強] 戒毒決心不[堅強足] 未能戒除毒癮 足見戒毒意志不堅 故態復萌 屢次再犯 無法戒除毒癮 不[知思]戒除
  不[知思]悔改 未能體悟施用毒品 再三施用 再為[^。]{0,15}本案犯行 再為本案 前案執行產生警惕 未因前案[^。]{0,15}警惕 對於刑罰[之的]?反應力 前案紀錄[^。]{0,30}再犯 前有[^。]{0,20}前科
  前因施用毒品[^。]{0,20}執行完畢 曾[經有][因觀][^。]{0,15}觀察 曾經觀察、勒戒 曾經觀察勒戒 曾有觀察勒戒 前[已有][^。]{0,15}觀察 輕忽毒品 未[見能]戒除[惡習毒癮]
  未[見能][徹其]?戒除[^。]{0,15}[惡毒] 未徹底戒除 未認清毒品 猶未認清 業受[^。]{0,15}寬典 竟仍[基於再] 素行不[佳良] 惡性非輕
character mitigating: 素行良好 無[相同類]前科 未曾犯罪 並無前科
character neutral: [前]?[科素][行]?[（(]?[參見有][^。]{0,15}前案紀錄表 前科素行 前案紀錄 素行[、，（(] 法院前案紀錄表 前科[、，] 素行
intellect neutral: 國[小中](?:畢業|肄業) 國民?中[畢肄]業 高[中職](?:畢業|肄業) 高中肄[學業] 五專[^。]{0,8}[畢肄]業 專科[^。]{0,8}[畢肄]業 大學[^。]{0,8}[畢肄]業
  研究所[^。]{0,8}[畢肄]業 國中畢 教育程度[^。]{0,20} 智識程度 學歷[（(][^)]{0,25}[）)] 自[述陳][^。]{0,15}智識 自[述陳][^。]{0,15}學歷 學歷 智識正常
relation_victim neutral: 與被害人[^。]{0,15}關係 被害人[^。]{0,15}關係
duty_breach aggravating: 漠視法令禁制 漠視國家[^。]{0,20}禁令 無視[^。]{0,15}禁令 無視國家對於杜絕毒品
harm mitigating: 僅[有]?[戕殘]害[自其][身己我] [戕殘]害[自其][身己我] [戕殘]害[其]?個人身[心健] [戕殘傷]害[自其]?[個]?人[個]?健康 [殘戕]害[自其]身 戕害自[己我]身 戕害自身
  戕害自我身心 未[直]?[接造]?[成及]?危害他人 未[有對直]+危[害及] 未及於他人 未侵犯其他法益 尚未[直造]?[接成]?[影危]響?他人 自我身心侵害 反社會性[之的]?程度較低
  所生[之]?[危損]?[害損]?尚[非無]?重大 所生損害尚非鉅大 未流傳於眾 對他人法益尚無重大 對社會[公]?共[秩安]?[序安]? 自戕行為 自[傷殘戕]行為 屬戕害自[己我] 乃戕害 屬自戕 自我戕害 戕害其個人
harm aggravating: 危害(?:甚|非)[鉅劇大重] 嚴重戕害國民 流毒所及 危害社會非輕 危及他人 製造社會風氣[、，]治安 惡化社會治安 助長毒品[之的]?蔓延 助長社會[上]?施用毒品 所生[之]?危害[非甚][輕鉅]
  危害社會治安 影響社會[秩治]?[序安] 直接戕害國民身心 間接危害社會治安 敗壞社會 製造[社毒] 危害甚[深鉅大重] 傷害自身健康甚鉅
harm neutral: 所生[之]?危害 所生[之]?損害 危害
post_attitude aggravating: 否認犯行 矢口否認 無[悔反][意省] 後改為否認 飾詞狡辯 否認施用 否認本案 否認犯罪 否認[^。]{0,15}態度 於警詢之否認 警詢時[^。]{0,10}否認
  否認[^。]{0,15}犯行
post_attitude mitigating: 坦承犯行[^。]{0,25} 始終坦[認承] 坦[承認][^。]{0,15}犯[行罪] 坦[承認]犯[行罪] 犯後態度尚?[佳可良好] 態度尚[可佳良] 見悔意 已坦[認承] 終能坦
  自白[犯不]?[行諱] 認罪態度 坦白 尚見悔意 自[首白] 自首 坦[承認] 犯後[態度]?[尚]?[佳可良]
post_attitude neutral: 犯後[態度] 犯[罪後]態度 犯後之態度 犯罪後之?態度
"""
# fmt: on
