"""Fixed values.

FIXED VALUES — these word lists, patterns and constants must equal the
behaviour being matched for results to agree (role inference, number
parsing, summary-row detection, question understanding).  They are data,
stated plainly and in natural order; all logic that uses them lives in the
other modules and is expressed as Spark Column expressions.
"""

# ---------------------------------------------------------------- FIXED VALUES
# Digits of both Arabic-Indic blocks and their ASCII equivalents.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "01234567890123456789"

# Cell text (after trimming, case-folded) that means "no value".
MISSING_TOKENS = (
    "", "-", "—", "–", "n/a", "na", "null", "none", "nan",
    "غير متوفر", "غير متاح", "لا يوجد",
)

# A whole-cell label that marks a structural summary row (case-insensitive).
SUMMARY_LABEL_PATTERN = (
    r"^(?:grand\s+total|sub\s*total|subtotal|total(?:\s+summary)?|summary|"
    r"الإجمالي(?:\s+العام)?|الاجمالي(?:\s+العام)?|المجموع|ملخص(?:\s+الإجمالي)?)$"
)

# Currency words and symbols stripped before a number is parsed.
CURRENCY_TOKEN_PATTERN = (
    r"(?:USD|US\$|SAR|S\.A\.R|AED|EUR|GBP|KWD|QAR|BHD|OMR|"
    r"دولار|ريال(?:\s+سعودي)?|درهم(?:\s+إماراتي)?|دينار|ر\.س|د\.إ)"
)
CURRENCY_SYMBOL_PATTERN = r"[$€£¥﷼]"

# The only accepted number shape once units are stripped (no exponent).
NUMBER_PATTERN = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)$"

# A safe two-cell row formula: =<col><row> op <col><row>, `$` allowed.
ROW_FORMULA_PATTERN = (
    r"^\s*=\s*\$?([A-Za-z]{1,3})\$?(\d+)\s*([+\-*/])\s*"
    r"\$?([A-Za-z]{1,3})\$?(\d+)\s*$"
)

# Column-name substrings that make a measure monetary (mean, not median).
MONETARY_COLUMN_TERMS = (
    "amount", "revenue", "sales", "price", "cost", "profit", "income",
    "المبلغ", "الإيراد", "الايراد", "المبيعات", "السعر", "التكلفة", "الربح",
    "sar", "usd", "aed", "ريال", "دولار", "درهم", "ر.س", "$", "﷼",
)

# Column-name terms of the derived sales relation total = quantity × unit price.
QUANTITY_TERMS = ("quantity", "qty", "كمية", "الكمية")
UNIT_PRICE_TERMS = ("unit price", "unit_price", "سعر الوحدة")
TOTAL_TERMS = ("total sales", "total amount", "sales amount", "إجمالي المبلغ", "اجمالي المبلغ")

# Role inference by column name (whole words after `_`/`-` become spaces).
DATE_TERMS = ("التاريخ", "تاريخ", "date", "day", "اليوم")
TIME_DIMENSION_TERMS = (
    "year", "quarter", "month", "week", "السنة", "السنه", "العام",
    "الربع", "الشهر", "الأسبوع", "الاسبوع",
)
MEASURE_TERMS = (
    "الكمية", "الإيرادات", "الايرادات", "التكلفة", "الربح", "المبيعات",
    "السعر", "سعر", "المبلغ", "إجمالي", "اجمالي", "الإجمالي", "الاجمالي",
    "النسبة", "نسبة", "quantity", "revenue", "cost",
    "profit", "sales", "price", "amount", "value", "percentage", "percent",
    "rate", "margin",
)
DIMENSION_TERMS = (
    "المدينة", "المنطقة", "المنتج", "الفئة", "مندوب المبيعات", "المندوب",
    "الشركة", "الفرع", "city", "region", "product", "category", "salesperson",
    "العميل", "اسم العميل", "حالة الطلب", "الحالة", "segment", "company",
    "customer", "status", "branch", "brand", "channel", "country",
)
IDENTIFIER_TERMS = ("id", "المعرف", "معرف", "رقم", "code", "رمز")

# Role names a user may give in a mapping (English or Arabic).
MAPPED_ROLE_WORDS = {
    "date": ("date", "تاريخ"),
    "dimension": ("dimension", "بُعد", "بعد"),
    "identifier": ("identifier", "معرف"),
    "measure": ("measure", "مقياس"),
}

# Dashboard naming rules: temporal dimensions, percent-like and currency-like measures.
TEMPORAL_NAMES = (
    "year", "quarter", "month", "week", "السنة", "السنه", "العام",
    "الربع", "الشهر", "الأسبوع", "الاسبوع",
)
PERCENTAGE_NAMES = ("percentage", "percent", "rate", "margin", "النسبة", "نسبة")
CURRENCY_NAMES = (
    "revenue", "sales", "cost", "profit", "price", "amount", "value",
    "إيراد", "ايراد", "تكلفة", "ربح", "سعر", "مبيعات", "قيمة",
)
CURRENCY_CODES = ("USD", "SAR", "AED", "EUR", "GBP", "KWD", "QAR", "BHD", "OMR")
DEFAULT_CURRENCY = "SAR"

# Text-cell prefixes counted as formula-like in the quality profile.
FORMULA_PREFIXES = ("=", "+", "-", "@")

# Label written into a missing dimension cell.
UNSPECIFIED_LABEL = "غير محدد"
# Name given to a blank header: prefix + 1-based ordinal.
BLANK_HEADER_PREFIX = "عامود_"
# Pseudo-sheet name of a delimited file.
CSV_SHEET_NAME = "Data"

# Delimited-file sniffing: encodings tried in order, delimiter candidates.
CSV_ENCODINGS = ("utf-8-sig", "utf-8", "cp1256")
CSV_DELIMITERS = (",", ";", "\t", "|")

# Quality score weights and thresholds.
OUTLIER_IQR_FACTOR = 1.5
NUMERIC_LIKE_THRESHOLD = 0.8
SEQUENCE_SHARE_THRESHOLD = 0.85
CATEGORY_DISTINCT_FLOOR = 20
CATEGORY_DISTINCT_SHARE = 0.2
DASHBOARD_WARNING_SCORE = 90

# Dashboard caps.
MAX_KPIS = 4
MAX_CHARTS = 6
MAX_FILTERS = 3
MAX_INSIGHTS = 25
CATEGORY_TOP_K = 8
DONUT_TOP_K = 6
TREND_PERIODS = 24
FILTER_VALUES = 30
CATALOG_VALUES = 80
MESSAGE_VALUES = 20
QUESTION_MAX_LIMIT = 20

# Question understanding.
ARABIC_DIACRITICS_CLASS = r"[\u064b-\u065f\u0670]"
FOLD_FROM = "أإآىة"
FOLD_TO = "ااايه"
VALUE_ALIASES = {
    "jarir": ("جرير",),
    "nahdi": ("النهدي", "نهدي"),
    "al othaim": ("العثيم", "الاثيم", "othaim"),
    "saco": ("ساكو",),
    "alsaif gallery": ("السيف غاليري", "السيف", "السايف"),
    "cenomi retail": ("سينومي ريتيل", "سينومي", "سنومي"),
}
QUARTER_WORDS = {
    1: ("q1", "الربع الاول", "ربع اول", "الربع 1"),
    2: ("q2", "الربع الثاني", "ربع ثاني", "الربع 2"),
    3: ("q3", "الربع الثالث", "ربع ثالث", "الربع 3"),
    4: ("q4", "الربع الرابع", "ربع رابع", "الربع 4"),
}
DIMENSION_FAMILIES = (
    (("product", "منتج"), ("product", "products", "منتج", "المنتج", "المنتجات")),
    (("category", "فئه", "تصنيف"), ("category", "categories", "فئه", "الفئه", "تصنيف")),
    (("region", "منطقه"), ("region", "regions", "منطقه", "المنطقه", "المناطق")),
    (("city", "مدينه"), ("city", "cities", "مدينه", "المدينه", "المدن")),
    (("customer", "client", "عميل"), ("customer", "client", "عميل", "العميل", "العملاء")),
    (("status", "حاله"), ("status", "حاله", "الحاله")),
    (("company", "brand", "شركه"), ("company", "companies", "brand", "brands", "شركه", "الشركه", "الشركات")),
    (("year", "سنه", "عام"), ("year", "years", "سنه", "السنه", "عام")),
    (("quarter", "ربع"), ("quarter", "quarters", "ربع", "الربع")),
    (("date", "تاريخ"), ("date", "dates", "تاريخ")),
)
QUALITY_QUESTION_TERMS = (
    "قيمة ناقصة", "قيم ناقصة", "مفقود", "ناقص", "تنظيف", "عالج", "تعويض",
    "جودة البيانات", "معرف مفقود", "missing", "cleaning", "imputation", "quality",
)
COMPANY_TERMS = ("company", "شركه", "brand")
YEAR_TERMS = ("year", "سنه", "عام")
QUARTER_TERMS = ("quarter", "ربع")
ECOMMERCE_TERMS = ("الكتروني", "ecom", "e com", "e commerce", "online")
ECOMMERCE_NAME_TERMS = ("ecom", "e com", "e commerce", "الكتروني", "online")
GROWTH_TERMS = ("نمو", "تغير", "تطور", "growth", "change")
GROWTH_OPERATION_TERMS = ("نمو", "تغير", "تطور", "growth")
PERCENT_QUESTION_TERMS = ("نسبه", "percentage", "percent", "rate")
PERCENT_NAME_TERMS = ("percentage", "percent", "rate", "نسبه")
REVENUE_TERMS = ("ايراد", "مبيعات", "revenue", "sales")
REVENUE_NAME_TERMS = ("revenue", "sales", "ايراد", "مبيعات")
TOTAL_NAME_TERMS = ("total", "اجمالي")
TOP_TERMS = ("اعلي", "اكبر", "افضل", "الاكثر", "top", "highest")
BOTTOM_TERMS = ("اقل", "ادني", "اضعف", "الاقل", "bottom", "lowest")
COMPARE_TERMS = ("قارن", "مقارنه", "مقابل", "compare", "حسب")
AVERAGE_TERMS = ("متوسط", "average")
MAXIMUM_TERMS = ("اقصي قيمه", "maximum")
MINIMUM_TERMS = ("ادني قيمه", "minimum")
LIMIT_PATTERN = r"(?:اعلي|افضل|اقل|top|bottom)\s*(\d{1,2})"
YEAR_PATTERN = r"(?<!\d)(20\d{2})(?!\d)"
COMPANY_TAIL_PATTERN = (
    r"(?:ايرادات|ايراد|مبيعات|revenue|sales)\s+(.+?)(?=\s+(?:في|عام|سنه|خلال|للربع)\b|$)"
)
COMPANY_TAIL_IGNORED = (
    "الاجماليه", "اجماليه", "الاجمالي", "اجمالي", "الالكترونيه", "الكترونيه",
    "الكل", "كل", "جميع", "الشركات", "الشركه", "شركة", "حسب", "بحسب",
    "بين", "عبر", "وفق", "وفقا", "لكل", "ضمن", "مقابل", "مع", "من", "على", "عن",
    "قارن", "مقارنه", "مقارنة", "ترتيب", "اعلي", "الاعلي", "اقل", "الاقل",
    "افضل", "اكبر", "الاكثر", "كم", "هي",
    "المنتج", "المنتجات", "الفئه", "الفئات", "المنطقه", "المناطق",
    "المدينه", "المدن", "العميل", "العملاء", "الحاله", "التاريخ",
    "company", "companies", "brand", "brands", "product", "products",
    "category", "categories", "region", "regions", "city", "cities",
    "customer", "customers", "year", "years", "quarter", "quarters",
    "date", "dates", "by", "according", "between", "among", "across", "per",
    "versus", "vs", "compare", "comparison", "rank", "ranking", "highest",
    "lowest", "top", "bottom", "all", "total",
    "sar", "usd", "riyal", "riyals", "currency", "amount", "value", "metric",
    "ريال", "الريال", "سعودي", "السعودي", "عمله", "مبلغ", "قيمه", "مقياس",
)
CURRENCY_DISPLAY_TERMS = ("revenue", "sales", "ايراد", "مبيعات", "sar")

# Formula language: leading verbs, operator words, percent words.
FORMULA_NAME_VERBS = r"^(?:احسب|أنشئ|انشئ|أضف|اضف|calculate|create)\s+"
FORMULA_OPERATOR_WORDS = (
    (r"\bمقسوم(?:ة)?\s+على\b|\bdivided\s+by\b", "/"),
    (r"\bمضروب(?:ة)?\s+في\b|\bmultiplied\s+by\b", "*"),
    (r"\bناقص\b|\bminus\b", "-"),
    (r"\bزائد\b|\bplus\b", "+"),
)
FORMULA_SYMBOLS = (("÷", "/"), ("×", "*"), ("−", "-"), ("–", "-"))
FORMULA_EQUALS_PATTERN = r"\s+(?:يساوي|equals)\s+"
FORMULA_PERCENT_PATTERN = r"نسبة|مئوية|percent|percentage|%"
FORMULA_PERCENT_RESULT_PATTERN = r"نسبة|هامش|مئوية|percent|margin|\*\s*100"
FORMULA_DEFAULT_NAME = "حساب مخصص"
FORMULA_NAME_MAX = 100
# Reconciliation tolerances (relative, absolute) and the zero test of a divisor.
RECONCILE_REL_TOL = 1e-9
RECONCILE_ABS_TOL = 1e-6
ZERO_DIVISOR_TOL = 1e-12
# Result rounding: registry 2 dp, missing rate 4 dp, formula 6 dp.
RESULT_DP = 2
RATE_DP = 4
FORMULA_DP = 6
# ------------------------------------------------------------ END FIXED VALUES
