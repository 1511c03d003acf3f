"""Values that decide results.

Everything under a "fixed values" heading is part of the data contract: changing one changes which quotes verify,
how sections are cut or what a stored annotation looks like.
"""

# --- fixed values: white space -------------------------------------------------------------------------------
# One explicit class, because Java, RE2 and Python disagree about \s. The \x{..} spelling is read by Java and RE2.
WS_CLASS = (
    r"\t\n\x{0b}\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)
WS_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# --- fixed values: canonical form ----------------------------------------------------------------------------
# Dropped from canonical text: white space, control characters, soft hyphen, hyphens and dashes, minus.
DROP_CLASS = WS_CLASS + r"\x{00}-\x{1f}\x{7f}\x{ad}\x{2010}-\x{2015}\x{2212}\-"
DROP_CHARS = frozenset(
    WS_CHARS + "".join(map(chr, range(0x20))) + "\x7f\u00ad\u2010\u2011\u2012\u2013\u2014\u2015\u2212-"
)
SINGLE_QUOTES = "‘’‚‛′"
DOUBLE_QUOTES = "“”„‟″"

# --- fixed values: matching ----------------------------------------------------------------------------------
MIN_MATCH_CHARS = 6
MIN_FUZZY_CHARS = 20
MIN_SIMILARITY = 0.9
SEED_CHARS = 8
SEED_STRIDE = 4
SEED_HITS_PER_GRAM = 50
DIAGONAL_WIDTH = 16
CANDIDATE_REGIONS = 5
SLACK_SHARE = 0.2
SLACK_CHARS = 16
PARTIAL_MIN_CHARS = 60
PARTIAL_SHARE = 0.55

# --- fixed values: pages -------------------------------------------------------------------------------------
MIN_TEXT_CHARS = 200
PAGE_MARKER_PREFIX = "[PDF Page "
PAGE_MARKER_PATTERN = r"\[PDF Page [0-9]+\]"
CANON_PAGE_MARKER_PATTERN = r"\[pdfpage[0-9]+\]"
MAX_PAGE_NUMBER = 1999
# Location wordings that name a page, tried in this order; {ws} stands for the white-space class.
LOCATION_PATTERNS = (
    r"(?i)page[{ws}]*([0-9]{{1,4}})",
    r"(?i)p\.[{ws}]*([0-9]{{1,4}})",
    r"第[{ws}]*([0-9]{{1,4}})[{ws}]*页",
    r"(?i)\bpp?\.[{ws}]*([0-9]{{1,4}})",
)
RESOLVED_LOCATION = ("PDF 第 ", " 页")

# --- fixed values: sections ----------------------------------------------------------------------------------
HEADING_MIN_CHARS = 2
HEADING_MAX_CHARS = 60
HEADING_NUMBERING = r"\A(([0-9]+(\.[0-9]+)*|[IVX]+|[A-H])\.?[{ws}]+|第[一二三四五六七八九十0-9]+[章节][{ws}]*)"
HEADING_TAIL = r"[:：.]\z"
SUBHEADING = r"\A[0-9]+\.[0-9]+"
# kind, priority (0 = never sent), pattern for the lower-cased title; {ws} stands for the white-space class.
HEADING_RULES = (
    ("abstract", 5, r"\A(abstract|摘[{ws}]*要)\z"),
    ("introduction", 3, r"\A(introduction|引[{ws}]*言|绪[{ws}]*论|前[{ws}]*言)\z"),
    ("related", 1, r"\A(related[{ws}]+works?|background|preliminar(y|ies)|literature[{ws}]+review|相关工作|研究背景|文献综述)\z"),
    ("method", 4, r"\A(methods?|methodology|approach|proposed[{ws}]+method|model|framework|"
                  r"materials[{ws}]+and[{ws}]+methods|研究方法|方法|模型)\z"),
    ("results", 4, r"\A(experiments?|experimental[{ws}]+(setup|results)|evaluation|"
                   r"results([{ws}]+and[{ws}]+discussion)?|实验|实验结果|结果|结果与讨论)\z"),
    ("discussion", 3, r"\A(discussion|analysis|ablation([{ws}]+stud(y|ies))?|讨论|分析)\z"),
    ("limitations", 5, r"\A(limitations?|threats[{ws}]+to[{ws}]+validity|局限性?|不足)\z"),
    ("conclusion", 5, r"\A(conclusions?|concluding[{ws}]+remarks|summary|future[{ws}]+work|结论|总结|结语)\z"),
    ("appendix", 0, r"\A(appendix|appendices|supplementary([{ws}]+material)?|附录)"),
    ("references", 0, r"\A(references|bibliography|参考文献)\z"),
    ("acknowledgements", 0, r"\A(acknowledge?ments?|funding|致谢)\z"),
)
FRONT_KIND, FRONT_PRIORITY = "front", 5
MIDDLE_MARKER = "\n\n[...中间部分已省略...]\n\n"
SECTION_MARKER = "\n[...本节其余部分已省略...]\n"
HEAD_SHARE = 0.6
# Suggested number of highlights by characters sent: upper bound (exclusive), low, high.
HIGHLIGHT_RANGES = ((25_000, 3, 5), (60_000, 5, 8), (None, 7, 12))

# --- fixed values: results -----------------------------------------------------------------------------------
CATEGORIES = ("research_question", "method", "results", "limitations")
HIGHLIGHT = "highlight"
ALL_CATEGORIES = CATEGORIES + (HIGHLIGHT,)
MISSING_SUMMARY = "未在正文中找到"
DEFAULT_HIGHLIGHT_TITLE = "建议关注点"
MAX_EVIDENCE = 2
MAX_HIGHLIGHTS = 12
RETRY_PARAMETER_PATTERN = (
    r"(?i)response_format|json|unsupported|not support|unknown (field|param)|unrecognized|extra (field|input)|invalid param"
)
CONTENT_REVIEW_PATTERN = r"(?i)reject|risk|sensitive|inappropriate|content|安全|审核|敏感"
NO_BALANCE_PATTERN = r"(?i)quota|余额|insufficient"
NO_CHANNEL_PATTERN = r"(?i)no available channel"
ERROR_DETAIL_CHARS = 300

# --- fixed values: annotations and export --------------------------------------------------------------------
# category, colour, annotation label, long label, emoji, export label, export rgb
CATEGORY_TABLE = (
    ("research_question", "#ffd400", "研究问题", "研究问题", "🟡", "研究问题", (1.0, 0.831, 0.0)),
    ("method", "#2ea8e5", "方法", "核心方法", "🔵", "研究方法", (0.18, 0.659, 0.898)),
    ("results", "#5fb236", "结果", "主要结果", "🟢", "主要结果", (0.373, 0.698, 0.212)),
    ("limitations", "#ff6666", "疑点/局限", "作者承认的局限", "🔴", "作者局限", (1.0, 0.4, 0.4)),
    ("highlight", "#f19837", "建议关注", "建议重点关注", "🟠", "建议关注", (0.945, 0.596, 0.216)),
)
RECT_LINE_TOLERANCE = 1.5
RECT_MAX_GAP = 8.0
LAYER_SENTENCE, LAYER_READING = "L2", "L3"
BOOKMARK_TITLE_CHARS = 80
BOOKMARK_TOP_MARGIN = 12.0
ROOT_COLOR, EMPTY_COLOR, EMPTY_LABEL = "#2f6fb3", "#888", "无可用结构"
OMITTED_NAMES = (("references", "参考文献"), ("acknowledgements", "致谢"), ("appendix", "附录"))

# --- fixed values: result store ------------------------------------------------------------------------------
KEY_VERSION = "v3"
PROMPT_VERSION = 4
STORE_CAPACITY = 500

# Fixed value: where a guide note stands on the first page.
NOTE_BOX = (20, 20, 42, 42)
