"""Controlled vocabularies of specimen records: standard terms with the other words for them.

The aliases of classification and lifeForm are too many to state; load a file of them with
``vocab.load_vocabularies`` and give it to the models, or add your own with ``vocab.with_aliases``.
"""

#: Each standard term and its aliases, in the order in which an ambiguous alias is looked up.
VOCABULARIES: dict[str, dict[str, list[str]]] = {
    "individualCountType": {
        "个": [],
        "盒": [],
        "件": [],
        "只": [],
        "条": [],
        "颗": [],
        "具": [],
        "包": [],
        "套": [],
    },
    "type": {
        "Collection": ["典藏"],
        "Dataset": ["数据集"],
        "Event": ["事件"],
        "Image": ["图像"],
        "StillImage": ["静态图像", "画作", "绘画", "素描", "印刷品", "平面图", "设计图"],
        "MovingImage": ["动态图像", "动画", "视频"],
        "InteractiveResource": ["交互资源"],
        "PhysicalObject": ["物理实体"],
        "Service": ["服务"],
        "Software": ["软件"],
        "Text": ["文本"],
    },
    "protectedStatusOfChina": {
        "一级": ["国Ⅰ", "Ⅰ"],
        "二级": ["国Ⅱ", "Ⅱ"],
        "一般": [],
    },
    "geodeticDatum": {
        "WGS84": ["谷歌坐标系"],
        "CGCS2000": ["大地2000坐标系"],
        "BD09": ["百度坐标系"],
        "GCJ-02": ["火星坐标系"],
        "Beijing 1954": ["北京1954"],
        "Xian 1980": ["西安1980"],
        "EPSG:3857": [],
        "NAD27": [],
        "NAD83": [],
        "Campo Inchauspe": [],
        "European 1950": [],
        "Clarke 1866": [],
        "Unknown": ["未知", "不清"],
    },
    "establishmentMeans": {
        "本地": ["native"],
        "入侵": ["invasive"],
        "归化": ["naturalised"],
        "引种": ["introduced"],
        "受控": ["managed"],
    },
    "taxonomicStatus": {
        "misapplied": ["误用"],
        "accepted": ["接受的"],
        "homotypic synonym": ["同模异名"],
        "heterotypic synonyms": ["异模异名"],
        "synonym": ["异名"],
    },
    "nomenclaturalStatus": {
        "invalid": ["不合格的", "不合格的名字", "不合格发表", "名称未合格发表"],
        "illegitimate": ["不合法名称", "不合法的"],
        "isonym": ["等名"],
        "homonyms": ["同名"],
        "autonym": ["自动名"],
        "nomen nudum": ["裸名"],
        "correct name": ["正确名称"],
    },
    "fat": {
        "少": ["Little", "小"],
        "中": ["Middle", "适中"],
        "大": ["重", "Heavy"],
        "无": ["None"],
    },
    "samplingProtocol": {
        "网捕": [],
        "猎捕": [],
        "交换": [],
        "捐赠": [],
    },
    "collectionCode": {
        "P": [],
        "K": [],
        "E": [],
        "MO": [],
        "B": [],
        "US": [],
        "PE": ["pe", "Pe", "pE"],
        "KUN": ["Kun", "KUn", "KuN", "kUN", "kuN", "kun", "kUn", "kuN", "kun21", "KU7N", "0978425", "KUN00502"],
        "IBSC": ["IBCS", "IBSC ", "ISBC ", "ISBC", " IBSC", "IBSC1", "IBC", "IBSC`", "SCIB", "IBSC."],
        "WUK": [],
        "NAS": [],
        "IBK": ["IBk"],
        "SZ": [],
        "XJBI": ["xjbi"],
        "CDBI": ["CDBi"],
        "HNWP": [],
        "IFP": [],
        "HIB": [],
        "HITBC": [],
        "N": [],
        "SM": [],
        "SYS": [],
        "LBG": [],
        "CSFI": [],
        "HIMC": [],
        "GXMI": [],
        "HHBG": [],
        "AU": [],
        "NEFI": [],
        "HX": [],
        "BNU": [],
        "CSH": [],
        "HENU": [],
        "GXMG": [],
        "HGAS": [],
        "JJF": [],
        "JIU": [],
        "CZH": [],
        "QFNU": [],
        "SXU": [],
        "SZG": [],
        "GZAC": [],
        "PEY": [],
        "HTC": [],
        "GZTM": [],
        "IMC": [],
        "NKU": [],
        "SXTCM": [],
        "XBGH": [],
        "BJFC": [],
        "ZM": [],
        "CCAU": [],
        "HUH": [],
        "IMDY": [],
        "KIZ": ["kIZ", "kiZ", "KiZ", "kIz", "kiz"],
        "HON": ["HOn"],
    },
    "disposition": {
        "在库": ["在馆", "借入", "赠入", "库存", "良好", "`"],
        "出库": ["借出", "赠出", "不在馆"],
        "遗失": ["missing"],
    },
    "typeStatus": {
        "cotype": ["COTYPE", "Co-typus", "CO-typus", "Cotypus", "co-typus", "co-type", "Co-Typus", "cotypus"],
        "epitype": ["11", "EPITYPE"],
        "holotype": ["2", "主模式", "主模", "HOLOTYPE", "Holotype", "Holotypus", "holotypus", " Holotypus", "Hologypux", "Holytypus", "Holotupus", "Holotpus", "Holotyps", "Holtypus", "Holotpyus", "Isobolotys", "Holotvpe"],
        "type": ["模式", "0", "TYPE", "Typus", "typus", "Type", "Typus]", "TYPUS", "Tytus", "Typua", "TYpus", "Typus'", "Tyups"],
        "syntype": ["4", "SYNTYPE", "Syntype", "syntypus", "Syntypus", "Syntypue", "Suntypus"],
        "isoneotype": ["10", "ISONEOTYPE"],
        "isosyntype": ["5", "ISOSYNTYPE", "Isosyntype", "Iso-syntyp", "Isosyntypu", "Isosyntyp", "Isosyntyps"],
        "not type": ["nottype", "1", "nottype", "nottype", "普通", "NOTATYPE", "nottypy", "nottyp", "noyytpe"],
        "paralectotype": ["PARALECTOTYPE"],
        "paratype": ["6", "PARATYPE", "Paratype", "Paratypus", "paratypus", "Partypus", "Paiatypus", "Parartypus", "Pratypus", "Paratysus", "Paraype"],
        "isotype": ["3", "ISOTYPE", "Isotype", "Isotypus", " Isotypus", "isotypus", "Isotyps", "Isot ype", "IIsotypus", "Isotypt", "Isopypus", "Isotypu", "Isoptypus", "Isotlypus", "Isotypua", "Isotypsu", "Istypus", "Isotypue", "lsotype"],
        "original material": ["ORIGINALMATERIAL"],
        "isolectotype": ["ISOLECTOTYPE", "8", "Isolectoty"],
        "lectotype": ["7", "LECTOTYPE", "Lectotype", "Lectolypus", "Lectotypus"],
        "isosepitype": [],
        "neotype": ["topotype", "9", "NEOTYPE", "Neotypus", "neotypus"],
        "allotype": ["配模", "ALLOTYPE"],
    },
    "abundance": {
        "极多": ["5", "205", "非常多"],
        "很多": ["4", "199"],
        "多": ["3", "204", "较多"],
        "尚多": ["2", "200", "常见"],
        "少": ["1", "201", "少见"],
        "稀少": ["偶见"],
        "个别": ["0", "202", "罕见", "极少"],
    },
    "frequency": {
        "极少": ["0", "202", "罕见", "个别"],
        "少见": ["1", "201", "少", "偶见"],
        "常见": ["2", "200", "尚多"],
        "较多": ["3", "204", "尚多"],
        "多": ["4", "199"],
        "极多": ["5", "205"],
    },
    "reproductiveCondition": {
        "无花无果": ["无果无花", "有花无果 ", "无 花无果", " 无花无果", "标本差", "无采集信息", "展叶期", "落叶期", "叶变色期", "0", "Vegetative"],
        "有花有果": ["有果有花", "有花有果 ", "一份花一份果", "有花有过", "花果标本", "花果期", "3"],
        "无花有果": ["有果无花", "五花有果", "无花有果 ", "果标本", "有果", "果标本 ", "果", " 果标本", "果标本1", "果期", "落果/种子散布期", "2", "Fruiting"],
        "有花无果": ["无果有花", "花标本", " 花标本", "有花标本", "花标标本", "花果标", "花蕾期", "花期", "1", "Flowering", "月花无果", "有花 无果"],
        "有孢子囊": ["有孢子囊", "孢子", "有孢子", "5", "有孢蒴 "],
        "无孢子囊": ["无孢子囊", "4", "无孢蒴 "],
    },
    "lifeStage": {
        "01": ["叶芽膨大始期"],
        "03": ["叶芽膨大末期"],
        "07": ["叶芽萌发始期"],
        "08": ["叶芽萌发末期"],
        "09": ["芽露出地面，刚观察到绿色叶尖"],
        "10": ["地面上蕨叶卷曲"],
        "11": ["第一片（对、轮）叶展开或最早的叶开始展开", "第一片蕨叶展开或最早的蕨叶开始展开"],
        "15": ["第五片叶展开但未达最终大小", "第五片蕨叶展开但未达最终大小"],
        "19": ["第九或更多的叶充分扩大并达到其最终大小", "第九或更多的蕨叶充分扩大并达到其最终大小"],
        "11-19": ["观察和记录第1-9 片叶展开（观察到叶柄或叶基）的日期"],
        "51": ["花（序）芽膨大"],
        "53": ["花（序）芽萌芽"],
        "60": ["始花期", "孢子囊群开始出现（Sori Emergence），绿色"],
        "65": ["盛花期", "孢子囊群成熟（Sori Mature），颜色变深且干燥，释放孢子"],
        "69": ["末花期", "孢子囊群萎缩脱落（Sori Fall）"],
        "71": ["果实膨大期", "球果膨大期"],
        "81": ["果实成熟期", "球果成熟期"],
        "92": ["叶变色始期", "蕨叶开始枯萎"],
        "93": ["落叶始期"],
        "95": ["落叶盛期", "50%的蕨叶变黄"],
        "97": ["落叶末期", "植株或地上部分死亡或休眠", "谷物收割期"],
        "99": ["植株枯死"],
        "幼": ["雏鸟", "Nestling", "幼鸟", "Juvenile", "Larva", "Tadpole"],
        "亚成": ["Immature", "亚成鸟"],
        "成": ["成鸟", "Adult"],
        "不清": ["Unknow", "0", "Unknown"],
    },
    "molecularMaterialSample": {
        "有": ["1", "DNA", "seq", "剩余", "是", "Y"],
        "用完": ["0"],
        "无": ["3", "没有", "   ", " "],
        "遗失": ["2"],
        "组织样本": ["Tissue", "组织"],
        "寄生虫": ["Parasite"],
    },
    "category": {
        "植物": ["Angiospermae", "Gymnospermae", "Pteridophyta", "Bryophyta", "Botany", "Plantae"],
        "动物": ["Reptilia", "Amphibia", "Fish", "Insecta", "Aves", "Mammalia", "Animalia"],
        "真菌": ["Lichen", "地衣", "地衣植物", "Macrofungi", "Fungi"],
        "假菌": ["假菌界", "Chromista"],
        "古细菌": ["archaea", "archaebacteria"],
        "原核生物": ["Prokaryotes"],
        "病毒": ["virus"],
    },
    "classification": {
        "Lichen": [],
        "Angiospermae": [],
        "Bryophyta": [],
        "Fungi": [],
        "Gymnospermae": [],
        "Insecta": [],
        "Pisces": [],
        "Amphibia": [],
        "Reptilia": [],
        "Aves": [],
        "Pteridophyta": [],
        "Mammalia": [],
    },
    "sex": {
        "♂": ["Male", "male", "MALE", "雄", "雄性"],
        "♀": ["Female", "female", "FEMALE", "雌性", "雌"],
        "☉": ["Unknow", "unknow", "UNKNOW", "未知", "o"],
    },
    "lifeForm": {
        "腐生植物": [],
        "附生植物": [],
        "寄生植物": [],
        "竹类": [],
        "草质藤本": [],
        "木质藤本": [],
        "藤本": [],
        "草本": [],
        "半灌木": [],
        "灌木": [],
        "乔木": [],
        "木本": [],
    },
    "basisOfRecord": {
        "生物痕迹": [],
        "人类观察": ["人体感知", "人眼观察", "人为观察"],
        "机器记录": ["设备记录"],
        "馆藏标本": ["PRESERVED_SPECIMEN"],
        "活体标本": ["LIVING_SPECIMEN"],
        "化石标本": ["FOSSIL_SPECIMEN"],
        "文献记录": [],
        "不清": ["UNKNOWN"],
    },
    "preparations": {
        "罐装": ["瓶装", "瓶装标本"],
        "覆膜": [],
        "干制": ["干制"],
        "腊叶": ["蜡叶标本"],
        "镜框": [],
        "液浸(福尔马林)": ["浸泡标本", "fluid"],
        "液浸(酒精)": ["浸泡标本", "fluid"],
        "液浸(其他)": ["浸泡标本", "fluid"],
        "鸟蛋": ["鸟卵", "鸟蛋", "egg"],
        "鸟巢": ["nest", "鸟巢"],
        "皮毛": [],
        "颅骨": ["skull"],
        "巢基": ["skeleton"],
        "后颅": ["post-cranial"],
        "剥制": [],
        "假剥制": [],
        "骨骼": [],
        "皮张": ["skin"],
        "羽毛": [],
        "塑化": [],
        "切片": [],
        "模型": [],
        "化石": [],
        "玻片": [],
        "针插": [],
        "植株": [],
        "木材": [],
        "包埋": [],
        "矿物": [],
        "文物": [],
        "其他": [],
    },
    "preservedLocation": {
    },
}
