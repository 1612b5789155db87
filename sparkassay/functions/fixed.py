"""Constants that results depend on, stated as plain text."""

# --- fixed values: character classes -----------------------------------------
# Characters removed by Unicode-aware stripping.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set inside a regular-expression character class.
SPACE_CLASS = (
    r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
)
UNSAFE_CLASS = (
    r"[\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]|[\p{Cc}&&[^\n\r\t]]"
)

# --- fixed values: value formats ----------------------------------------------
BOOLEAN_WORDS = ("true", "false", "yes", "no", "是", "否")
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_TEXT = r"^[+-]?(inf|infinity)$"
DATE_SHAPE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}([ T].*)?$"
EMAIL_TEXT = rf"^[^{SPACE_CLASS}@]+@[^{SPACE_CLASS}@]+\.[^{SPACE_CLASS}@]+$"
VERSION_TEXT = r"^[vV]?\d+([._-]\d+)+[A-Za-z0-9._-]*$"
CODE_TEXT = r"^(?=.*[A-Za-z])(?=.*\d)[A-Za-z0-9]+([._-][A-Za-z0-9]+)+$"
MONTH_NAMES = (
    "jan", "feb", "mar", "apr", "may", "jun",
    "jul", "aug", "sep", "oct", "nov", "dec",
)

# --- fixed values: column-name roles ------------------------------------------
ROLE_PATTERNS = {
    "date": (
        r"(?:^|[_\s-])(?:date|time|datetime|timestamp)(?:$|[_\s-])|"
        r"(?:^|[_\s-])(?:created|updated|modified|published)"
        r"(?:[_\s-]?(?:at|date|time|datetime|timestamp))?$|"
        r"(?:日期|时间)"
    ),
    "update": (
        r"(?:^|[_\s-])(?:update|updated|modified)"
        r"(?:[_\s-]?(?:date|time|datetime|timestamp|at))?$|"
        r"(?:^|[_\s-])last[_\s-]?updated(?:[_\s-]?at)?$|"
        r"(?:更新日期|更新时间|最后更新|修改日期|修改时间|修订日期)$"
    ),
    "url": r"(?<![A-Za-z0-9])(?:url|uri|link)(?![A-Za-z0-9])|(?:网址|链接)",
    "email": r"(?<![A-Za-z0-9])(?:email|e-mail)(?![A-Za-z0-9])|(?:邮箱|邮件)",
    "numeric": (
        r"(?<![A-Za-z0-9])(?:amount|count|number|quantity|total|rate|ratio|score|"
        r"age|days|hours)(?![A-Za-z0-9])|"
        r"(?:金额|数量|次数|人数|天数|时长|比例|比率|分数|年龄)"
    ),
    "source": (
        r"(?<![A-Za-z0-9])(?:source|origin|publisher|department|provider)"
        r"(?![A-Za-z0-9])|(?:来源|发布部门|发布单位|部门|供应单位)"
    ),
    "source_id": (
        r"(?<![A-Za-z0-9])(?:source|origin|original)[_\s-]?id(?![A-Za-z0-9])|"
        r"(?:原始(?:标识|编号|编码)|来源(?:标识|编号|编码))"
    ),
    "version": (
        r"(?<![A-Za-z0-9])(?:version|revision|release|processed|workflow)"
        r"(?![A-Za-z0-9])|(?:版本|修订|修订日期|处理记录|处理时间)"
    ),
    "structured": (
        r"(?<![A-Za-z0-9])(?:url|uri|link|email|e-mail|version|revision|code|number)"
        r"(?![A-Za-z0-9])|(?:网址|链接|邮箱|邮件|版本|修订|编号|编码|代码)"
    ),
}
IDENTIFIER_NAME = (
    r"^(?:id|uuid|index|record_?id|row_?id|.*_id|序号|索引|.*(?:编号|编码|标识|标识码))$"
)
CAMEL_BOUNDARY = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"

# --- fixed values: capacity limits --------------------------------------------
MAX_DATASET_ROWS = 1_000_000
MAX_DATASET_COLUMNS = 10_000
MAX_DATASET_CELLS = 20_000_000
MAX_TEXT_CELL_BYTES = 1024 * 1024
MAX_RULE_CELLS = 2_000_000
MAX_RULE_LOCATIONS = 200_000
MAX_REGEX_INPUT = 10_000

# --- fixed values: documents and retrieval ------------------------------------
STANDARD_NUMBER = (
    r"(?i)\b(?:DB\s*\d{1,4}\s*/\s*T|GB\s*/\s*T|GB|ISO|HJ|CJJ|T/)[\s-]*"
    r"[A-Z0-9][A-Z0-9./_-]{1,40}\b"
)
CLAUSE_START = (
    r"(?i)^\s*(第\s*[0-9一二三四五六七八九十百]+\s*[章节条款项]?|"
    r"[0-9]+(?:\.[0-9]+){0,6}|表\s*[0-9]+|附录\s*[A-Z])(?:[、.．：:\s]|$)"
)
HEADING = r"^\s*#{1,6}\s+(.+?)\s*$"
PUBLISHED_DATE = (
    r"(?:发布日期|发布(?:日期|时间)|生效日期|发布时间)\s*[:：]?\s*"
    r"(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})"
)
VERSION_LABEL = r"(?i)(?:版本|修订版|版次)\s*[:：]?\s*([A-Za-z0-9][A-Za-z0-9._-]{0,31})"
METRIC_CODE = r"(?<!\d)(\d{6})(?!\d)"
MAX_DOCUMENT_BYTES = 20 * 1024 * 1024
MAX_DOCUMENT_CHARS = 1_000_000
MAX_DOCUMENT_CHUNKS = 5_000
MAX_CHUNK_CHARS = 3_500
MAX_TABLE_LINES = 8
MAX_QUERY_CHARS = 2_000
MAX_RESULTS = 20
MAX_RESULT_CHARS = 2_400
MAX_TOTAL_CHARS = 12_000
NAMESPACES = ("standards", "data_dictionary", "user_specification")
DOCUMENT_STATUSES = ("active", "draft", "superseded", "expired", "unknown")

# --- fixed values: grounding of numbers in text -------------------------------
NUMBER_MENTION = r"(?<![\w.])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?"
MAX_LABEL_DISTANCE = 12
SAFE_REASONS = (
    "数据集不包含字段",
    "数据集不包含记录",
    "字段没有非空值",
    "未识别到可检查",
    "未识别到时间",
    "未识别到来源",
    "未识别到版本",
    "没有足够",
    "当前无法计算",
)

# --- fixed values: patterns of secrets and of rule-line prefixes, as they must match ---
SECRET_ASSIGNMENT = r"(?i)\b(api[_ -]?key|token|secret|password)\b\s*[:=]\s*[^\s,;]+"
BEARER_TOKEN = r"(?i)\bbearer\s+\S+"
SECRET_KEY = r"\bsk-[A-Za-z0-9_-]{8,}\b"
LIST_MARK = r"^\s*(?:[-*+]\s+|\d{1,3}[.)、]\s*)"
RULE_LABEL = r"^\s*(?:规则|要求)\s*\d*\s*[:：]\s*"
