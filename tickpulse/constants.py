"""Fixed values that results depend on.

Everything in this module is data, not logic: label names, word lists and
regular expressions whose exact text decides which rows match.  They are kept
verbatim, in their natural order, so that results line up with the behaviour
this engine reproduces.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: sentiment labels
# ---------------------------------------------------------------------------
POSITIVE = "TÍCH_CỰC"
NEGATIVE = "TIÊU_CỰC"
NEUTRAL = "TRUNG_TÍNH"
# non-canonical neutral spellings that leak out of some code paths
NEUTRAL_EN = "NEUTRAL"
NEUTRAL_UNACCENTED = "TRUNG_TINH"

# raw model label -> English label
MODEL_LABEL_MAP = {
    "NEG": "NEGATIVE",
    "NEU": "NEUTRAL",
    "POS": "POSITIVE",
    "LABEL_0": "NEGATIVE",
    "LABEL_1": "NEUTRAL",
    "LABEL_2": "POSITIVE",
    "negative": "NEGATIVE",
    "neutral": "NEUTRAL",
    "positive": "POSITIVE",
    "sadness": "NEGATIVE",
    "joy": "POSITIVE",
    "love": "POSITIVE",
    "anger": "NEGATIVE",
    "fear": "NEGATIVE",
    "surprise": "NEUTRAL",
}
# class index -> English label
CLASS_ID_LABEL_MAP = {0: "NEGATIVE", 1: "NEUTRAL", 2: "POSITIVE", 3: "NEUTRAL", 4: "POSITIVE"}
# English label -> Vietnamese label
EN_TO_VI_LABEL_MAP = {"NEGATIVE": NEGATIVE, "NEUTRAL": NEUTRAL, "POSITIVE": POSITIVE}
# custom classifier label -> Vietnamese label
CUSTOM_LABEL_MAP = {"negative": NEGATIVE, "neutral": NEUTRAL, "positive": POSITIVE}
# Vietnamese label -> English training label
VI_TO_EN_LABEL_MAP = {POSITIVE: "positive", NEGATIVE: "negative", NEUTRAL: "neutral"}

CLASS_LABELS = ["negative", "neutral", "positive"]

# ---------------------------------------------------------------------------
# FIXED VALUES: platforms counted by the daily statistics, in report order
# ---------------------------------------------------------------------------
STAT_SOURCES = ["facebook", "youtube", "fireant", "zalo", "tiktok", "news"]

# ---------------------------------------------------------------------------
# FIXED VALUES: upper-case words that are usually not tickers
# ---------------------------------------------------------------------------
COMMON_WORDS = [
    "VIP", "CEO", "GDP", "USD", "VND", "ATM", "OK", "HI", "BYE", "SH",
    "TV", "PC", "IT", "CD", "DVD", "USB", "CPU", "RAM", "ROM", "LAN",
    "WAN", "MAN", "GPS", "LED", "LCD", "OLED", "PDF", "JPG", "PNG",
    "GIF", "MP3", "MP4", "AVI", "MKV", "HTML", "CSS", "JS", "PHP",
    "SQL", "API", "URL", "HTTP", "HTTPS", "FTP", "SSH", "SSL", "TLS",
    "IP", "DNS", "VPN", "WIFI", "UHD", "FULL", "PHA", "THI", "TTCK",
    "AI", "VR", "AR", "MR", "UI", "UX", "CFO", "CTO", "COO", "HR",
    "PR", "QA", "QC", "KPI", "ROI", "CRM", "ERP", "SAP", "HRM", "SCM",
    "BI", "B2B", "B2C", "C2C", "O2O", "IPO", "M&A", "B2G", "G2B", "G2C",
    "C2G", "KQKD", "DT", "COM", "NHA", "TRC", "TRA",
]

# neighbour words that veto a common-word ticker hit
CONTEXT_VETO_WORDS = ["nha", "trc", "pha", "full", "margin", "ib", "wed"]
CONTEXT_RADIUS = 20

# Vietnamese accented letters (lower case) used by the candidate gate
VIETNAMESE_ACCENTS = "àáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵđ"
VIETNAMESE_ACCENTS_UPPER = "ÀÁẢÃẠĂẮẰẲẴẶÂẤẦẨẪẬÈÉẺẼẸÊẾỀỂỄỆÌÍỈĨỊÒÓỎÕỌÔỐỒỔỖỘƠỚỜỞỠỢÙÚỦŨỤƯỨỪỬỮỰỲÝỶỸỴĐ"

# ---------------------------------------------------------------------------
# FIXED VALUES: finance keywords scored in ticker sentences (18)
# ---------------------------------------------------------------------------
SENTENCE_KEYWORDS = [
    "cổ phiếu", "chứng khoán", "giá", "mua", "bán", "tăng", "giảm",
    "lãi", "lỗ", "đầu tư", "khuyến nghị", "thị trường", "giao dịch",
    "cổ tức", "dividend", "lợi nhuận", "doanh thu", "tài chính",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: keywords of the extractive summary (30)
# ---------------------------------------------------------------------------
SUMMARY_KEYWORDS = [
    "chứng khoán", "cổ phiếu", "đầu tư", "mua", "bán", "giá",
    "tăng", "giảm", "lợi nhuận", "khuyến nghị", "thị trường",
    "stock", "market", "invest", "buy", "sell", "VN-Index", "VNINDEX",
    "cổ tức", "dividend", "tài chính", "ngân hàng", "doanh nghiệp",
    "quý", "năm", "triệu", "tỷ", "điểm", "margin", "tự doanh",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: rumor cue patterns, checked in this order on lower-cased text
# (Python regex syntax; word boundaries and classes are Unicode-aware)
# ---------------------------------------------------------------------------
RUMOR_PATTERNS = [
    r"\bnghe\s+(nói|đồn)(\s+rằng|\s+là|\s+đâu)?\b",
    r"\bđồn\s+rằng\b",
    r"\bcó\s+tin\s+đồn(\s+rằng|\s+là)?\b",
    r"\btheo\s+lời\s+đồn\b",
    r"\bngười\s+ta\s+nói(\s+rằng|\s+là)?\b",
    r"\bcó\s+nguồn\s+tin(\s+rằng|\s+là)?\b",
    r"\bnhiều\s+người\s+nói\b",
    r"\bcó\s+người\s+(bảo|cho\s+rằng)\b",
    r"\b(xì\s+xào|rỉ\s+tai\s+nhau|truyền\s+tai\s+nhau)\b",
    r"\btin\s+(hành\s+lang|vỉa\s+hè)\b",
    r"\btin\s+(chưa\s+kiểm\s+chứng|chưa\s+xác\s+thực)\b",
    r"\bchưa\s+có\s+căn\s+cứ\b",
    r"\bhình\s+như\b",
    r"\bnghe\s+bảo\b",
    r"\bnghe\s+kể\b",
    r"\bđược\s+cho\s+là\b",
    r"\bcó\s+vẻ\s+như\b",
    r"\bcó\s+khả\s+năng\s+là\b",
    r"\btin\s+nội\s+bộ\b",
    r"\btin\s+rò\s+rỉ\b",
    r"\bcó\s+lời\s+đồn\b",
    r"\bcó\s+người\s+truyền\s+tai\b",
    r"\bđồn\s+đại\s+phát\b",
    r"\bđồn\s+đại\b",
    r"\bđồn\s+thổi\b",
    r"\brumou?r\b", r"\bhearsay\b", r"\bword\s+on\s+the\s+street\b",
    r"\bpeople\s+say\b", r"\bsources\s+say\b", r"\ballegedly\b",
    r"\breportedly\b", r"\bunconfirmed\b", r"\bspeculation\b",
    r"\bwhispers?\b", r"\bit\s+is\s+said\b", r"\baccording\s+to\s+rumors?\b",
    r"\bgossip\b", r"\brumor\s+has\s+it\b",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: stopwords used when no stopword file is available (34)
# ---------------------------------------------------------------------------
FALLBACK_STOPWORDS = [
    "là", "và", "của", "có", "cho", "với", "một", "các", "những", "được", "này",
    "đã", "trong", "khi", "đó", "từ", "thì", "ra", "ở", "đến", "cũng", "như",
    "sẽ", "không", "vẫn", "nên", "rằng", "lại", "đi", "hay", "nhiều", "ít", "hơn", "tới",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: rumor rewriting prefixes
# ---------------------------------------------------------------------------
REWRITE_PREFIX_HEARSAY = "Theo thông tin đồn đoán, "
REWRITE_PREFIX_OPINION = "Theo nhận định, "
REWRITE_PREFIXES = ["Theo thông tin,", "Có nguồn tin,", "Thông tin cho biết,"]

# labels stripped from generated summaries
SUMMARY_LABEL_PATTERN = r"\b(vietnews|tóm tắt|summary):?\s*"

# word that marks a ticker-less post in the important-sentence map
GENERAL_KEY = "GENERAL"

# ---------------------------------------------------------------------------
# FIXED VALUES: numeric defaults of the jobs
# ---------------------------------------------------------------------------
TRENDING_DAILY_TOP_N = 20
TRENDING_2DAY_TOP_N = 10
TRENDING_ALPHA = 0.5
TRENDING_BETA = 1.0
TRENDING_HOURLY_ALPHA = 0.6
TRENDING_HOURLY_BETA = 1.2
TRENDING_ZONE = "Asia/Bangkok"
YT_WINDOW_WORDS = 20
TOP_STOCKS = 10
DEFAULT_CONFIDENCE = 0.5
SUMMARY_MAX_LENGTH = 100
