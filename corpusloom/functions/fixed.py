"""Words, names and tables whose very content decides results, so they are stated as they are."""

from __future__ import annotations

# Numerals.
CN_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CN_UNITS = {"十": 10, "百": 100, "千": 1000}

# Questions: names of laws, levels of effect, and the words that negate, compare or ask for a procedure.
EFFECT_LEVELS = {
    "法律": ["法律", "全国人大", "全国人大常委会"],
    "行政法规": ["行政法规", "国务院"],
    "司法解释": ["司法解释", "最高法", "最高检", "最高人民法院", "最高人民检察院"],
    "部门规章": ["部门规章", "规章"],
    "地方性法规": ["地方性法规"],
}
NEGATIONS = ["不是", "并非", "除了", "除…外", "排除", "而非", "不包括", "不含", "不属于"]
LAWS = {
    "民法典": ["中华人民共和国民法典", "民法典"],
    "民诉法": ["中华人民共和国民事诉讼法", "民事诉讼法"],
    "刑诉法": ["中华人民共和国刑事诉讼法", "刑事诉讼法"],
    "刑法": ["中华人民共和国刑法"],
    "劳动法": ["中华人民共和国劳动法"],
    "劳动合同法": ["中华人民共和国劳动合同法"],
    "劳动争议调解仲裁法": ["中华人民共和国劳动争议调解仲裁法"],
    "建工司法解释一": ["最高人民法院关于审理建设工程施工合同纠纷案件适用法律问题的解释（一）"],
    "公司法": ["中华人民共和国公司法"],
    "行政诉讼法": ["中华人民共和国行政诉讼法"],
}
COMPARISONS = ["对比", "区别", "异同", "分别", "比较"]
PROCEDURES = ["哪些情形", "如何认定", "程序", "步骤", "条件", "要件", "举证责任"]
#: Questions that need no search.
SMALL_TALK = [r"^(你好|您好|hi|hello|在吗|在不在|谢谢|再见|好的|嗯|哦|哈哈)+$", r"^(今天天气|天气怎么样|吃饭了吗|你是谁|你叫什么).*$"]
#: A short question without any of these is about something else.
TOPIC_HINTS = [
    "法", "条", "款", "判决", "裁定", "仲裁", "合同", "起诉", "诉讼", "劳动", "婚姻", "继承", "侵权", "赔偿", "犯罪", "辩护", "证据", "协议",
    "违约", "纠纷", "执行", "管辖", "时效", "担保", "物权", "债权", "离婚", "工伤", "社保", "税务", "公司", "股东", "专利", "商标", "著作权",
    "破产", "招标", "投标", "建设", "工程", "税", "费", "房", "工资", "加班", "交易", "补偿", "押金", "辞退", "试用期", "借条", "过户", "缓刑",
    "取保", "竞业", "遗嘱", "欠款",
]

# Redaction: tags of the categories, in their order, and the words around names.
TAGS = {"person_name": "PERSON", "company_name": "COMPANY", "id_card": "ID_CARD", "credit_code": "CREDIT_CODE", "phone": "PHONE", "email": "EMAIL", "manual": "MANUAL"}
#: What a party is called before its name.
ROLES = [
    "原告", "被告", "第三人", "上诉人", "被上诉人", "申请人", "被申请人", "再审申请人", "再审被申请人", "申请执行人", "被执行人", "法定代表人", "负责人",
    "执行事务合伙人", "委托诉讼代理人", "委托代理人", "诉讼代理人", "辩护人", "联系人", "经办人", "授权代表", "经纪人", "代理人", "反诉原告", "反诉被告", "本诉原告",
    "本诉被告", "债权人", "债务人", "担保人", "保证人", "抵押人", "出质人", "买方", "卖方", "出租方", "承租方", "发包方", "承包方", "甲方", "乙方",
    "丙方", "丁方",
]
LABELS = ["姓名", "名字", "联系人", "法定代表人", "委托代理人", "委托诉讼代理人", "授权代表", "经办人", "负责人", "买方", "卖方", "出租方", "承租方", "发包方", "承包方", "甲方", "乙方", "丙方", "丁方"]
BEFORE_NAME = ["与", "向", "对", "由", "为", "和", "跟", "同", "被", "让", "给"]
AFTER_NAME = ["签订", "签署", "履行", "承担", "支付", "主张", "起诉", "上诉", "辩称", "诉称", "称", "表示", "认为", "承诺", "确认", "负责"]
#: How names of companies end.
ORGANISATIONS = ["有限公司", "有限责任公司", "股份有限公司", "公司", "企业", "集团", "中心", "银行", "保险", "证券", "信托", "基金", "期货", "合伙企业", "事务所"]
#: Those of one character are kept apart, since they end a name only where no Han follows.
SHORT_ORGANISATIONS = ["厂", "院", "所", "站", "社", "店", "馆", "部", "处", "科", "室"]
#: Words of that form that aren't companies.
NOT_COMPANIES = ["统一社会信用代码", "社会信用代码", "身份证号", "信用代码"]
#: Codes of the parties, by surname.
PARTIES = ["甲方", "乙方", "丙方", "丁方", "戊方", "己方", "庚方", "辛方", "壬方", "癸方"]
#: What an address is told by, and the words before a number or name that an address may not take in.
ADDRESS_WORDS = ["省", "市", "区", "县", "镇", "乡", "村", "街道", "路", "街", "巷", "弄", "号", "栋", "幢", "楼", "座", "层", "室", "房", "院"]
NOT_ADDRESSES = ["身份证号", "户口", "银行", "信用卡", "合同", "案件", "档案", "入库"]
POSTAL_WORDS = ["邮编", "邮政编码", "Postal"]
#: Kinds of the reversible masker, in the order in which they are replaced. Numbers are matched as
#: whole runs of digits, identity cards first, so that a phone is not found in one.
REVERSIBLE: list[tuple[str, str]] = [
    ("idcard", r"(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])"),
    ("phone", r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])"),
    ("bankcard", r"(?<![0-9])[0-9]{16,19}(?![0-9])"),
    ("company", r"[一-鿿]{2,20}(?:有限责任公司|股份有限公司|有限公司|集团)"),
]
#: What personal numbers, case numbers, plates, accounts and addresses of the web look like.
PATTERNS = {
    "id_card": r"(?<!\d)\d{17}[\dXx](?!\d)",
    "phone": r"(?<!\d)1[3-9]\d{9}(?!\d)",
    "credit_code": r"(?<![0-9A-Z])[0-9A-HJ-NPQRTUWXY]{2}\d{6}[0-9A-HJ-NPQRTUWXY]{10}(?![0-9A-Z])",
    "case_number": r"[（(]\d{4}[）)][一-龥]{0,4}\d+[一-龥]*\d+[a-zA-Z一-龥]*号",
    "account_name": r"账户名称[\s：:]*[一-龥]{2,20}",
    "account_number": r"账号[\s：:]*\d{10,20}",
    "bank_branch": r"开户行[\s：:]*[一-龥]+(?:银行|信用社|储蓄所)",
    "contract_number": r"合同编号[\s：:]*[\w-]+\d+",
    "judge": r"(审判长|审判员|书记员)[\s：:]*[一-龥]{2,4}",
    "license_plate": r"[一-龥][A-Z][A-Z0-9]{5,6}\b",
    "url": r"https?://[\w.-]+(?:/[\w./%-]*)?",
    "social_account": r"(?:QQ|微信|微信号)[\s：:]*[\w-]{6,20}",
}
#: Units of amounts.
UNITS = ["万元", "亿元", "元", "美元", "英镑", "港币"]
CLEANUP: list[tuple[str, str]] = [(r"\n{3,}", "\n\n"), (r" {2,}", " "), (r"\t+", " ")]
