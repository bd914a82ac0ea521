"""Word lists, lookup tables and patterns."""

# Words that a query can do without.
STOP_WORDS = frozenset(
    """the a an is are was were be been being have has had do does did will would could should may might can shall
    to of in for on with at by from as into through during before after above below between and but or nor not so yet
    both either neither each every all any few more most other some such only own same than too very just about also
    what which who whom this that these those how when where why methods method best ways way approach approaches""".split()
)

# Variants of terms.
SYNONYMS = {
    "stability": ("degradation", "lifetime", "durability"),
    "efficient": ("performance", "PCE"),
    "efficiency": ("performance", "PCE", "power conversion"),
    "defect": ("vacancy", "trap", "recombination"),
    "passivation": ("treatment", "modification", "surface engineering"),
    "interface": ("heterojunction", "junction", "contact"),
    "transport": ("extraction", "collection"),
    "hole": ("HTL", "HTM"),
    "electron": ("ETL", "ETM"),
    "inverted": ("p-i-n", "pin"),
    "normal": ("n-i-p", "nip"),
    "tandem": ("multi-junction", "multijunction", "stacked"),
    "flexible": ("bendable", "foldable"),
    "large area": ("scalable", "scale-up", "module"),
    "lead free": ("tin", "Sn-based", "lead-free"),
    "2d": ("two-dimensional", "Ruddlesden-Popper", "layered"),
}

# Keywords of question types.
BROAD = (
    "介绍", "概述", "综述", "进展", "现状", "有哪些", "是什么", "什么是", "定义", "概念", "列举", "推荐", "找几篇", "给我看",
    "总结", "归纳", "概括", "发展", "研究热点", "前沿", "方向",
    "survey", "review", "overview", "introduction", "summary", "summarize", "what is", "what are", "tell me about", "overview of",
)
SPECIFIC = (
    "对比", "比较", "差异", "区别", "哪个", "多少", "效率", "具体", "掺杂", "制备方法", "工艺参数", "活化能", "带隙",
    "组分", "配比", "浓度", "温度", "退火", "怎么", "如何",
    "vs", "versus", "difference", "compare", "comparison", "which", "how much", "what efficiency", "specific",
    "doping", "fabrication", "synthesis", "optimization",
)
STRONG_SPECIFIC = ("vs", "versus", "difference", "compare", "comparison", "which", "对比", "差异", "区别", "比较")

# Keywords of intents.
CHAT = (
    "什么是", "是什么", "定义", "什么意思", "解释一下", "what is", "what are", "define", "definition", "meaning",
    "谢谢", "好的", "明白了", "换个说法", "简单说", "总结一下", "thanks", "thank you", "got it", "simpler terms",
)
RESEARCH = (
    "找论文", "搜索", "文献", "最新", "进展", "研究", "paper", "search", "find", "recent", "latest", "literature",
    "对比", "比较", "差异", "区别", "哪个更好", "compare", "comparison", "difference", "which is better",
    "带隙", "掺杂", "退火", "组分", "稳定性", "数据", "不稳定", "降解", "衰减", "衰退",
    "bandgap", "doping", "stability", "efficiency", "degradation", "mechanism", "fabrication", "synthesis",
    "效率", "方法", "机理", "机制", "制备", "表征", "调控", "优化", "改善",
)

# Keywords of answer styles and formats.
DATA_LOOKUP = (
    "多少", "多大", "多厚", "数值", "数据", "测过", "有没有人测", "具体数值", "具体数据", "实际值", "真实值", "量是多少",
    "有没有数据", "有没有报道", "有没有报告", "实验值", "how much", "what is the value", "measured value", "reported value",
    "specific data", "quantitative", "thickness", "thick", "concentration", "concentrations", "整理",
)
HOW_TO = (
    "怎么", "如何", "怎样", "方法", "方案", "步骤", "流程", "设置", "选取", "选择什么", "用什么", "怎么做",
    "how to", "how do", "how can", "method", "approach", "procedure", "protocol", "guideline", "recommend",
)
COMPARE = (
    "对比", "比较", "差异", "区别", "哪个更好", "哪个更", "优缺点", "优劣", "优劣对比",
    "compare", "comparison", "difference", "vs", "versus", "which is better", "which one", "pros and cons",
)
FORMATS = (
    ("表格", "table"), ("列表", "list"), ("列出", "list"), ("列举", "list"), ("清单", "list"), ("整理成", "table"),
    ("table", "table"), ("list", "list"), ("bullet", "list"), ("summarize in", "table"),
    ("整理一个", "table"), ("给我一个", "table"), ("列一个", "list"),
)
FRUSTRATION = (
    "不够具体", "不够详细", "不对", "不是这个意思", "你没理解", "no specific", "not what i", "not specific",
    "i meant", "what i meant", "that's not", "再查", "再搜", "再看看", "重新", "换一个", "还是没", "还没有", "不够",
)

# Words of review titles.
REVIEW = (
    "review", "progress", "advances", "survey", "overview", "comprehensive", "perspective", "roadmap", "retrospect",
    "tutorial", "state of the art", "state-of-the-art", "critical review", "mini review", "recent progress",
    "recent advances", "current status", "this review", "we review", "summarizes recent", "overview of",
    "综述", "进展", "回顾", "概述", "研究进展", "研究现状",
)

# Signs of measured data in a text.
DATA_CONTENT = (
    "thickness", "profilomet", "cross-section", "cross section", "SEM", "TEM", "AFM", "XRD", "XPS", "UV-Vis", "ellipsomet",
    "measured", "measurement", "nm thick", "µm thick", "nm,", "wt%", "at%", "concentration", "doping ratio",
    "PCE of", "efficiency of", "achieved", "obtained", "reported", "demonstrat", "exhibited", "showed a",
    "V_oc", "J_sc", "FF", "EQE", "厚度", "测量", "表征", "截面", "轮廓仪",
)

# Prefixes of publishers.
PUBLISHERS = {
    "10.1016": "elsevier", "10.1021": "acs", "10.1039": "rsc", "10.1038": "nature", "10.1126": "science", "10.1007": "springer",
    "10.3390": "mdpi", "10.1088": "iop", "10.1063": "aip", "10.1109": "ieee", "10.1103": "aps", "10.1093": "oup",
    "10.2139": "ssrn", "10.1073": "pnas", "10.1371": "plos", "10.1002": "wiley",
}

# Journals that count as good, and short forms of some names (without the last full stop).
GOOD_VENUES = (
    "Nature", "Nature Energy", "Nature Materials", "Nature Photonics", "Nature Nanotechnology", "Nature Communications",
    "Nature Reviews Materials", "Nature Reviews Chemistry", "Communications Materials", "Science", "Science Advances",
    "Joule", "Matter", "Chem", "Cell Reports Physical Science", "iScience", "ACS Energy Letters",
    "Journal of the American Chemical Society", "Chemistry of Materials", "ACS Applied Materials & Interfaces", "ACS Nano",
    "Nano Letters", "ACS Central Science", "JACS Au", "The Journal of Physical Chemistry Letters",
    "The Journal of Physical Chemistry C", "ACS Applied Energy Materials", "ACS Materials Letters", "Advanced Materials",
    "Advanced Energy Materials", "Advanced Functional Materials", "Angewandte Chemie", "Advanced Science", "Small",
    "Small Methods", "Solar RRL", "Advanced Optical Materials", "InfoMat", "Energy & Environmental Science",
    "Journal of Materials Chemistry A", "Materials Horizons", "Nanoscale", "Nanoscale Horizons", "Sustainable Energy & Fuels",
    "Chemical Science", "Physical Chemistry Chemical Physics", "Nano Energy", "Chemical Engineering Journal",
    "Solar Energy Materials and Solar Cells", "Materials Today Energy", "Applied Surface Science", "Electrochimica Acta",
    "Nano Today", "Materials Science and Engineering: R: Reports", "Progress in Materials Science", "Applied Physics Letters",
    "Journal of Applied Physics", "APL Materials", "Physical Review Applied", "Physical Review Materials",
    "Light: Science & Applications", "NPG Asia Materials", "Proceedings of the National Academy of Sciences",
    "Accounts of Chemical Research", "Chemical Society Reviews", "Reports on Progress in Physics", "Progress in Photovoltaics",
    "Journal of Energy Chemistry", "Materials Today", "Advanced Photonics",
)
VENUE_FORMS = {
    "energy & environmental science": "Energy & Environmental Science", "energy environ. sci": "Energy & Environmental Science",
    "j. am. chem. soc": "Journal of the American Chemical Society", "angew. chem. int. ed": "Angewandte Chemie",
    "angew. chem. int. ed. engl": "Angewandte Chemie", "adv. mater": "Advanced Materials", "adv. energy mater": "Advanced Energy Materials",
    "adv. funct. mater": "Advanced Functional Materials", "acs energy lett": "ACS Energy Letters", "nano lett": "Nano Letters",
    "acs nano": "ACS Nano", "chem. mater": "Chemistry of Materials", "j. phys. chem. lett": "The Journal of Physical Chemistry Letters",
    "j. phys. chem. c": "The Journal of Physical Chemistry C", "acs appl. mater. interfaces": "ACS Applied Materials & Interfaces",
    "adv. sci": "Advanced Science", "nat. commun": "Nature Communications", "nat. energy": "Nature Energy", "nat. mater": "Nature Materials",
    "nat. photon": "Nature Photonics", "nat. nanotechnol": "Nature Nanotechnology", "sci. adv": "Science Advances",
    "j. mater. chem. a": "Journal of Materials Chemistry A", "sustain. energy fuels": "Sustainable Energy & Fuels",
    "nanoscale horiz": "Nanoscale Horizons", "sol. energy mater. sol. cells": "Solar Energy Materials and Solar Cells",
    "chem. eng. j": "Chemical Engineering Journal", "appl. surf. sci": "Applied Surface Science",
    "phys. chem. chem. phys": "Physical Chemistry Chemical Physics", "j. energy chem": "Journal of Energy Chemistry",
    "appl. phys. lett": "Applied Physics Letters", "j. appl. phys": "Journal of Applied Physics",
    "acs appl. energy mater": "ACS Applied Energy Materials", "mater. today energy": "Materials Today Energy", "mater. horiz": "Materials Horizons",
}

# Headings that end a text, and lines that are no text; first for plain text, then for extracted text.
CUT_A = r"(?i)^(references?\s*$|references?\s+\d|bibliography\s*$|acknowledge?ments?\s*$|author\s+contributions?\s*$|competing\s+interests?\s*$|conflict\s+of\s+interest\s*$|supplementary\s+information\s*$|supporting\s+information\s*$|supplementary\s+materials?\s*$|electronic\s+supplementary\s+material|additional\s+information\s*$|notes?\s+and\s+references?\s*$|footnotes?\s*$|appendix\s)"
SKIP_A = r"(?i)^\s*(fig(ure)?\.?\s+\d+\.|table\s+\d+\.|scheme\s+\d+\.|chart\s+\d+\.|plate\s+\d+\.|box\s+\d+\.|\d+\s*$|[a-z]?\d{2,4}\s*$|doi:\s|https?://|received:?\s|published:?\s|accepted:?\s|©\s|copyright\s|all rights reserved|this journal is\s|\|\s*\d+\s*$)"
CUT_B = r"(?i)^\s*\d*\.?\s*(references?|bibliography|acknowledge?ments?|author\s+contributions?|conflict\s+of\s+interest|competing\s+interests?|supplementary\s+(information|materials?)|supporting\s+information|data\s+availability\s*(statement)?|code\s+availability|declarations?|funding)\s*$"
SKIP_B = r"^(\s*\d{1,4}\s*$|arXiv:\s*\d{4}\.\d{4,5}|\s*©\s*20\d{2}|This\s+is\s+a\s+preprint|\s*Preprint\s+submitted\s+to|\s*\d+\s*\|?\s*Page\s*$|\s*[A-Z][a-z]+\s+\d{1,2},\s+20\d{2}\s*$|https?://doi\.org/)"
CORRECTION = r"(?im)^\s*(Corrected|Erratum|Corrigendum)\s+\d{1,2}\s+(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\.?\s*(See full text\.?)?\s*$"
CAPTION = r"(?im)^\s*\*?\*?(Fig(ure)?\.?\s*\d+|Table\s+\d+|Scheme\s+\d+)\b.*$"
CUT_HEADING = r"^(#{1,4}\s*)?([Rr][eE][fF][eE][rR][eE][nN][cC][eE][sS](\s+[aA][nN][dD]\s+[Nn][oO][tT][eE][sS]?)?|Acknowledge?ments?|Notes?\s+and\s+[Rr]eferences)\s*$"

# Publishers and towns that stand in brackets after a venue.
VENUE_PUBLISHERS = ("Nature Publishing Group", "NPG", "Nature Research", "Nature", "Springer", "Elsevier", "Wiley", "RSC", "ACS", "IOP", "AIP", "APS", "MDPI", "IEEE", "Nature Portfolio")
VENUE_TOWNS = (
    "Amsterdam", "Stuttgart", "Bristol", "Cambridge", "London", "Berlin", "New York", "Oxford", "Weinheim", "Washington", "Lausanne", "Beijing", "Tokyo", "Singapore", "Basel",
    "Netherlands", "Germany", "UK", "USA", "Mass", "Massachusetts", "Calif", "California",
)
# Short forms of words in venues.
VENUE_ABBREVIATIONS = {
    "nat.": "nature", "commun.": "communications", "mater.": "materials", "nanotechnol.": "nanotechnology", "photon.": "photonics", "catal.": "catalysis", "synth.": "synthesis",
    "sustain.": "sustainability", "rev.": "reviews", "chem.": "chemistry", "phys.": "physics", "electron.": "electronics", "comput.": "computational", "sci.": "science",
    "adv.": "advances", "mater": "materials", "sci": "science", "technol.": "technology", "eng.": "engineering", "lett.": "letters", "appl.": "applied", "quant.": "quantum",
}
# Words of sections that chunks begin with.
SECTIONS = (
    "introduction", "method", "experiment", "result", "discussion", "conclusion", "device fabrication", "characterization", "performance", "stability", "efficiency", "structure",
    "morphology", "optical", "photovoltaic", "solar cell",
)
# Signs of markup in an answer.
MARKUP = ("<tool_call", "<tool_calls>", "antha:tool_call", "<｜｜DSML｜｜tool_call", "<invoke")
