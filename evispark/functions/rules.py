"""Ordered rules compiled to one CASE expression, and the fixed vocabularies that the rules use."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, rules: Iterable[tuple[object, str]], otherwise: Column | None = None) -> Column:
    """The value of the first rule whose pattern the text has; null or ``otherwise`` where none has."""
    return choose([(F.lit(value), text.rlike(pattern)) for value, pattern in rules], otherwise)


def choose(branches: Iterable[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first branch (value, condition) whose condition holds."""
    out = F.lit(None) if otherwise is None else otherwise
    for value, condition in reversed(list(branches)):
        out = F.when(condition, value).otherwise(out)
    return out


def any_term(text: Column, terms: Iterable[str]) -> Column:
    """Whether a lower-cased text contains one of the terms."""
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(F.lower(text), F.lit(term.lower()))
    return out


def count_terms(text: Column, terms: Iterable[str]) -> Column:
    """How many of the terms a lower-cased text contains."""
    return F.size(F.filter(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.contains(F.lower(text), t)))


# Vocabularies of the screening rules.

COARSE_TERMS = (
    "agent", "llm", "aigc", "ai infra", "人工智能", "算法", "大模型", "多模态", "计算机视觉", "机器视觉", "视觉", "图像",
    "机器学习", "深度学习", "强化学习", "感知", "slam", "具身智能", "自动驾驶",
)

SCORE_TERMS = (
    "agent", "ai", "aigc", "cv", "llm", "人工智能", "算法", "计算机视觉", "机器视觉", "视觉", "图像", "图形", "机器学习",
    "深度学习", "强化学习", "大模型", "多模态", "自然语言", "nlp", "生成式", "机器人", "自动驾驶", "感知", "规划控制",
    "SLAM", "点云",
)

STRONG_TERMS = (
    "算法工程师", "算法研究", "视觉算法", "计算机视觉", "机器视觉", "图像算法", "感知算法", "多模态", "大模型", "Agent",
    "AI算法", "AI Infra", "AIInfra", "机器学习", "深度学习", "强化学习",
)

NOISE_TERMS = ("营销", "销售", "柜面", "客户经理", "管培", "运营", "人力", "财务", "会计", "法务", "行政")

EXPLICIT_SOE = "央国企|央企|国企|国有(?:独资|控股)?|事业单位|政府机关"
SUPPLIED_SOE = "(?:明确国企|央企|央国企|国有(?:独资|控股)?)"
INDUSTRY = "(?iu)医疗|医药|医学|生物|制药|药业|生命|诊断|健康|基因|影像|器械|药物"

TARGET_ROLES = (
    (3, "(?iu)(?:Agent|智能体|大模型|LLM|自然语言处理|NLP).{0,12}(?:算法|研究|训练|推理)"),
    (2, "(?iu)(?:Agent|智能体|大模型|LLM).{0,12}(?:开发|研发|工程|应用|Infra)|RAG"),
    (
        1,
        "(?iu)计算机视觉|机器视觉|视觉AI|视觉.{0,4}算法|目标检测|深度学习|"
        "(?:机器学习|CNN|Transformer|ViT|多模态).{0,20}(?:视觉|图像|影像)|"
        "(?:视觉|图像|影像).{0,20}(?:机器学习|深度学习|CNN|Transformer|ViT|多模态|模型训练|训练模型)",
    ),
)

SELECTION_ROLES = (
    (1, "(?iu)(?:计算机视觉|视觉算法|图像算法|图像处理|机器视觉|目标检测|图像分割|深度学习|CV算法|AI算法)"),
    (2, "(?iu)Agent(?:\\s*Infra)?(?:研发|开发)|智能体(?:研发|开发)|大模型(?:应用)?开发|LLM开发|RAG"),
    (3, "(?iu)Agent算法|智能体算法|大模型(?:应用)?算法|LLM算法|NLP算法|自然语言处理"),
)

PRIORITY_LABELS = {
    1: "视觉相关AI/深度学习算法",
    2: "Agent/大模型开发",
    3: "Agent/大模型算法（次选）",
    4: "受限来源AI相关（待完整JD复核）",
}

GENERIC_IMAGE_ROLE = "(?iu)图像(?:处理|算法|识别|分割)|医学影像|影像算法|重建|渲染|\\bISP\\b|OpenCV"
GENERIC_IMAGE_EVIDENCE = (
    "(?iu)(?:训练|微调|开发|研发|设计|优化|评估)[^。；;\\n]{0,16}"
    "(?:深度学习|机器学习|CNN|Transformer|ViT|多模态)[^。；;\\n]{0,12}(?:模型|算法|检测|分割|分类|识别|跟踪|姿态|生成)?|"
    "(?:计算机视觉|机器视觉|视觉AI|深度学习)[^。；;\\n]{0,16}(?:模型|算法)[^。；;\\n]{0,16}(?:训练|微调|开发|研发|设计|优化|评估)"
)
GENERIC_ENGINEER = "(?iu)^(?:AI)?(?:算法|开发|研发)工程师(?:[-（(].*)?$"

EVIDENCE_RANK = {"limited_source_ai_mention": 0, "csv_declared": 1, "page_text": 2, "structured_job": 3, "audit_confirmed": 4}

SIGNALS = {
    "recruitment": "(?iu)招聘|岗位|职位|工程师|招聘要求|job|vacancy",
    "ai": "(?iu)大模型|人工智能|算法|机器学习|\\bAI\\b|\\bagent\\b",
    "access_challenge": "(?iu)请登录|安全验证|环境异常|访问过于频繁|微信客户端|captcha|access denied",
}
PLACEHOLDER = "(?iu)详见|岗位意向|待补充|待确认|to be confirmed"
DELETED = (
    "(?iu)该内容已被发布者删除|此内容因违规无法查看|内容已删除|该文章已被删除|"
    "the (?:article|page) (?:has been|was) (?:deleted|removed)"
)
BLOCKED = (
    "(?iu)访问过于频繁|环境异常|请完成安全验证|请进行验证|安全验证|人机验证|拖动.*滑块|请登录后查看|内容暂时无法访问|"
    "请在微信客户端打开|verify you are human|checking your browser|just a moment|access denied|"
    "please (?:log|sign) in to (?:continue|view)"
)
COMPANY_SUFFIXES = ("股份有限公司", "有限责任公司", "有限公司", "集团", "医疗", "科技")
PENDING_MARKERS = ("还没投", "尚未投", "未投", "准备投", "待投", "还没开")
SHARED_HOSTS = (
    "app.mokahr.com", "mp.weixin.qq.com", "wecruit.hotjob.cn", "jobs.51job.com", "campus.51job.com", "m.liepin.com",
    "www.liepin.com", "m.zhaopin.com", "q.yingjiesheng.com",
)
MOJIBAKE = ("�", "Ã", "Â", "â€", "锟斤拷", "烫烫烫")
TERMINAL_STOPS = ("terminal_pagination", "last_page", "reported_last_page", "reported_total_reached")
RETRY_HTTP = (408, 425, 429, 500, 502, 503, 504)
RETRY_KINDS = ("timeout", "transport", "rate_limited", "upstream_unavailable")

# Rules of the audit of recovered jobs.

AUDIT_AGENT = (
    (2, "(?iu)(?:Agent|智能体|大模型|LLM).{0,12}(?:开发|研发|工程|应用|Infra)|RAG"),
    (3, "(?iu)(?:Agent|智能体|大模型|LLM|自然语言处理|NLP).{0,12}(?:算法|研究|训练|推理)"),
)
VISUAL_AFFIRMATIVE = (
    "(?iu)计算机视觉|机器视觉|视觉\\s*AI|AI\\s*视觉|视觉算法|深度学习算法|CNN|卷积神经网络|Vision\\s*Transformer|\\bViT\\b|"
    "多模态视觉模型|视觉大模型|图像生成模型|"
    "(?:目标检测|图像分割|图像分类|图像识别|视觉识别|影像识别|目标跟踪|视觉跟踪|姿态估计).{0,12}(?:算法|模型|网络|训练|开发|优化|研究|工程师)|"
    "(?:训练|开发|优化|研究).{0,12}(?:目标检测|图像分割|图像分类|图像识别|视觉识别|影像识别|目标跟踪|视觉跟踪|姿态估计)",
    "(?iu)(?:训练|微调|评估|部署|优化|开发|构建).{0,28}(?:深度学习|机器学习|视觉|图像|影像).{0,16}(?:模型|算法)|"
    "(?:深度学习|机器学习|视觉|图像|影像).{0,16}(?:模型|算法).{0,28}(?:训练|微调|评估|部署|优化|开发|构建)|"
    "(?:深度学习|机器学习).{0,16}(?:训练|微调|评估|部署|优化|开发|构建).{0,20}(?:模型|算法)|"
    "(?:模型|算法模型).{0,20}(?:训练|微调|评估|部署|优化).{0,50}(?:深度学习|机器学习)",
)
IMAGE_WEAK = (
    "(?iu)图像处理|图像增强|图像配准|图像重建|图像拼接|图像去噪|图像压缩|图像渲染|计算机图形学|图形学|\\bISP\\b|OpenCV|医学影像(?:处理)?|"
    "显微(?:镜)?图像(?:处理)?|影像处理|影像重建|影像配准|图像算法|目标检测|图像分割|图像分类|图像识别|视觉识别|影像识别|目标跟踪|视觉跟踪|姿态估计|"
    "预训练(?:视觉|图像|影像)?模型|图像API|视觉API|识别API"
)
IMAGE_INTEGRATION = (
    "(?iu)(?:调用|接入|集成|使用).{0,24}(?:预训练(?:视觉|图像|影像)?模型|图像API|视觉API|识别API)|"
    "预训练(?:视觉|图像|影像)?模型.{0,24}(?:调用|接入|集成|使用)"
)
MODEL_OWNERSHIP = (
    "(?iu)(?:负责|主导|开发|(?<!预)训练|微调|评估|部署|优化|构建|设计).{0,24}(?:模型|算法|检测|分割|分类|识别|跟踪|姿态估计)|"
    "(?:模型|算法|检测|分割|分类|识别|跟踪|姿态估计).{0,24}(?:负责|主导|开发|(?<!预)训练|微调|评估|部署|优化|构建|设计)"
)
CAMPUS, SOCIAL = "(?iu)campus|校招|校园|应届|20\\d{2}届", "(?iu)social|社招"
AI_MENTION = (
    "(?iu)(?<![A-Za-z])(?:AI(?=$|[\\s\\-_/（(]|Infra\\b|算法|应用|工程|产品|模型|设计|工作流|能力|相关|时代|驱动)|"
    "人工智能|机器学习|深度学习|大模型|LLM(?=$|[\\s\\-_/（(]|算法|应用|工程|产品|模型)|"
    "Agent(?=$|[\\s\\-_/（(]|开发|算法|工程|应用|框架|产品|系统|平台|智能体)|CV(?=$|[\\s\\-_/（(]|算法|模型|工程)|NLP(?=$|[\\s\\-_/（(]|算法|模型|工程))"
)
COMPANY_COPY, ROLE_COPY = "公司|企业|关于我们|行业新闻|欢迎加入", "职责|要求|专业|岗位|开发|研发|算法|模型|产品"

#: The members under which saved JSON has totals, and jobs their titles, ids, links and texts.
TOTAL_KEYS = ("total", "Total", "totalCount", "total_count", "totalRows", "totalSize", "count", "Count")
JOB_TITLE_KEYS = ("jobTitle", "jobName", "positionName", "positionTitle", "JobAdName", "title", "name")
JOB_ID_KEYS = ("jobId", "positionId", "JobAdId", "Id", "job_id", "id", "code")
JOB_LINK_KEYS = ("jobUrl", "detailUrl", "url", "href")
JOB_BODY_KEYS = ("description", "jobDescription", "requirements", "Duty", "Require", "responsibility", "claim")
#: Members that only jobs have, and those of them that are names.
JOB_ONLY_KEYS = ("jobId", "positionId", "JobAdId", "JobAdName", "jobTitle", "jobName", "positionName", "positionTitle")
JOB_ONLY_NAMES = ("JobAdName", "jobTitle", "jobName", "positionName", "positionTitle")

#: Texts of mapped fields that say nothing.
LIST_PLACEHOLDERS = ("", "-", "--", "n/a", "null", "none", "tbd", "暂无", "待补充", "详见官网", "详见职位详情")

#: Fixed value: a line that names a role.
ROLE_LINE = r"^.{0,45}(?:实习生|工程师|研究员|科学家|产品经理)\s*$"

#: The members under which static records have titles, links and fields, and names of scripts that hold them.
STATIC_TITLES = ("attr2", "title", "jobName", "positionName", "name")
STATIC_URLS = ("attr5", "url", "href", "link", "applyUrl", "detailUrl")
STATIC_FIELDS = {"category": ("value", "category", "department"), "education": ("attr3", "education"), "location": ("attr4", "location", "city")}
STATIC_SCRIPTS = ("data", "job", "position", "recruit", "main")

#: Places that roles may be in; and the table of roles that are left out, in order: how its text is looked for in the role (or
#: company), the text, the code and the reason. The last row is for what no other names.
ROLE_PLACES = ("四川", "成都", "北京", "上海", "广州", "全国", "全国多地")
ROLE_TABLE = (
    ("is", "AI工程师（MES方向）", "generic_ai_without_target_evidence", "仅披露AI工程师标题、MES方向和专业要求，没有视觉/深度学习模型或Agent/LLM开发算法证据。"),
    ("begins", "AI药物研发", "insufficient_target_evidence", "AI药研或AI模型工程化标题未说明深度学习、视觉模型、Agent或LLM职责；不能仅凭AI字样准入。"),
    ("begins", "AI Pilot", "insufficient_target_evidence", "AI药研或AI模型工程化标题未说明深度学习、视觉模型、Agent或LLM职责；不能仅凭AI字样准入。"),
    ("contains", "图像处理", "image_processing_without_ai_evidence", "仅有普通图像处理表述，没有模型训练、CV/机器视觉或学习型算法证据。"),
    ("company", "赫力昂", "blocked_no_evidence", "本地任务为blocked，没有文章、图片或OCR证据，不能判断或准入。"),
    ("contains", "具体岗位未披露", "role_details_not_exposed", "文章仅披露实习计划或部门岗位族，没有可独立判断的具体JD。"),
    ("contains", "岗位族", "role_details_not_exposed", "文章仅披露实习计划或部门岗位族，没有可独立判断的具体JD。"),
    ("", "", "not_target_category", "岗位未体现视觉AI/深度学习算法、Agent/大模型开发或Agent/大模型算法职责。"),
)
ROLE_GAPS = ("insufficient_evidence_ocr_gaps", " 同时存在", "个图片OCR缺口，证据进一步降级。")
