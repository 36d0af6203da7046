"""Pure Column builders — no I/O, no UDFs.

Every builder returns a ``pyspark.sql.Column`` that stays inside whole-stage
codegen.  Java regexes need ``(?U)`` for Unicode ``\\s``/``\\w`` classes and
Unicode case folding; Spark's ``trim`` only strips U+0020, so trimming is a
regex here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofsheet.functions import vocab as V


def qname(name: str) -> str:
    """Backtick-quote a column name for ``F.col``/``expr``."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(qname(name))


def sql_string(value: str) -> str:
    """A single-quoted Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def utrim(c: Column) -> Column:
    """Strip Unicode whitespace (incl. NBSP, NNBSP) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_missing_token(c: Column) -> Column:
    return F.lower(c).isin(list(V.MISSING_TOKENS))


def normalize_text(c: Column) -> Column:
    """NBSP → space, trim, missing tokens → null (string columns)."""
    t = utrim(F.translate(c, "\u00a0", " "))
    return F.when(c.isNull() | is_missing_token(t), F.lit(None).cast("string")).otherwise(t)


def text_changed(c: Column) -> Column:
    """1 when normalisation changed the cell text (NBSP or outer space)."""
    t = utrim(F.translate(c, "\u00a0", " "))
    return F.when(c.isNotNull() & (t != c), 1).otherwise(0)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                           T.FloatType, T.DoubleType, T.DecimalType))


def is_temporal_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def parse_numeric_text(c: Column) -> Column:
    """P1 on a string column: currency/percent/thousands-tolerant number parse.

    Null tokens and cells starting with ``=``/``@`` give null; Arabic-Indic
    digits are mapped; currency words, symbols, ``%``/``٪``, thousands
    separators and all whitespace are removed; ``( … )`` means a negative
    absolute value.  The regex guard runs *before* the cast so ``1e5``,
    ``NaN`` and ``12d`` are rejected exactly like the number grammar says.
    Each intermediate is referenced once, so the generated code stays small.
    """
    t = F.translate(utrim(c), V.ARABIC_DIGITS, V.ASCII_DIGITS)
    blocked = is_missing_token(t) | t.rlike("^[=@]")
    s = F.when(blocked, F.lit("x")).otherwise(t)
    s = F.translate(s, "\u00a0\u202f", "")
    # the cased tokens are ASCII currency codes: ASCII case folding suffices
    s = F.regexp_replace(s, "(?i)" + V.CURRENCY_TOKEN_PATTERN, "")
    s = F.regexp_replace(s, V.CURRENCY_SYMBOL_PATTERN, "")
    s = F.translate(s, "%٪٬,", "")
    s = F.translate(s, "٫", ".")
    s = F.regexp_replace(s, r"(?U)\s+", "")
    # "(x)" → "-x" with any sign inside dropped: -abs(x) of the inner number
    s = F.regexp_replace(s, r"^\([+-]?(.*)\)$", "-$1")
    number = F.regexp_extract(s, "^(" + V.NUMBER_PATTERN[1:-1] + ")$", 1)
    # the grammar already proved the text numeric: a plain cast cannot fail,
    # and skipping "" avoids exception-driven parsing of non-numbers
    return F.when(number != "", number.cast("double"))


def parse_numeric_fast(c: Column) -> Column:
    """``parse_numeric_text`` with two exact shortcuts that skip the regex
    pipeline for most cells: text already in the final number grammar is
    cast directly, and text without any digit cannot be a number."""
    plain = c.rlike(V.NUMBER_PATTERN)
    has_digit = c.rlike("[0-9" + V.ARABIC_DIGITS + "]")
    return (F.when(plain, c.cast("double"))
             .when(~has_digit, F.lit(None).cast("double"))
             .otherwise(parse_numeric_text(c)))


def parse_numeric(c: Column, dt: T.DataType) -> Column:
    """P1 by physical type: numbers pass, booleans and dates are not numbers."""
    if is_numeric_type(dt):
        return c.cast("double")
    if isinstance(dt, T.StringType):
        return parse_numeric_fast(c)
    return F.lit(None).cast("double")


# Date formats tried in order, cell by cell, where a column has no format of
# its own (ISO first).
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd",
    "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyyMMdd", "yyyy-MM",
)


# Formats a text column can have as a whole, with the shape of their texts: a
# cell is parsed only by formats whose shape it has.  Of two readings of the
# same text the month comes first.
COLUMN_DATE_FORMATS = (
    ("yyyy-M-d HH:mm:ss", r"^\d{4}-\d{1,2}-\d{1,2} \d{2}:\d{2}:\d{2}$"),
    ("yyyy-M-d'T'HH:mm:ss", r"^\d{4}-\d{1,2}-\d{1,2}T\d{2}:\d{2}:\d{2}$"),
    ("yyyy-M-d HH:mm", r"^\d{4}-\d{1,2}-\d{1,2} \d{2}:\d{2}$"),
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("yyyy-MM", r"^\d{4}-\d{2}$"),
)


def date_text(c: Column) -> Column:
    """A text cell as date formats read it: trimmed, Latin digits."""
    return utrim(F.translate(c, V.ARABIC_DIGITS, V.ASCII_DIGITS))


def parse_date_as(text: Column, fmt: str) -> Column:
    """``date_text`` by one of COLUMN_DATE_FORMATS; null where it has another form."""
    shape = dict(COLUMN_DATE_FORMATS)[fmt]
    return F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt))).cast("timestamp_ntz")


def parse_date(c: Column, dt: T.DataType, fmt: str | None = None) -> Column:
    """P5: typed timestamp; text by its column's format (``profile.date_formats``),
    without one by the declared list, cell by cell."""
    if isinstance(dt, (T.TimestampNTZType,)):
        return c
    if is_temporal_type(dt):
        return c.cast("timestamp_ntz")
    if isinstance(dt, T.StringType):
        t = date_text(c)
        if fmt is not None:
            return parse_date_as(t, fmt)
        tries = [F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS]
        return F.coalesce(*tries).cast("timestamp_ntz")
    if isinstance(dt, (T.IntegerType, T.LongType)):
        s = c.cast("string")
        return F.coalesce(F.try_to_timestamp(s, F.lit("yyyyMMdd")),
                          F.try_to_timestamp(s, F.lit("yyyy"))).cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def fold_text(c: Column) -> Column:
    """Lower, strip Arabic diacritics, unify alef/ya/ta-marbuta,
    non-word runs → one space, trimmed."""
    t = F.lower(utrim(c))
    t = F.regexp_replace(t, V.ARABIC_DIACRITICS_CLASS, "")
    t = F.translate(t, V.FOLD_FROM, V.FOLD_TO)
    t = F.regexp_replace(t, "(?U)[^\\w\u0600-\u06ff]+", " ")
    return utrim(t)


def period_label(c: Column) -> Column:
    """``YYYY-MM`` month label."""
    return F.date_format(c, "yyyy-MM")


def day_label(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def as_label(c: Column, dt: T.DataType) -> Column:
    """Group label as text; integral doubles print without exponent."""
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(c == F.floor(c), F.format_string("%.1f", c)).otherwise(c.cast("string"))
    if is_temporal_type(dt):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def decimal_sum(c: Column, scale: int = 4) -> Column:
    """Order-independent sum: exact decimal accumulation, double result."""
    return F.sum(c.cast(f"decimal(38,{scale})")).cast("double")


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def in_filters(filters) -> Column:
    """Conjunction of ``column IN (values)`` (empty list = no filter)."""
    return all_of([col(f.column).isin(list(f.values)) for f in filters if f.values])


def display_number(v: Column, currency: Column | str | None = None, percent: bool = False) -> Column:
    """Billion / million units, 2 dp with grouping, optional suffix."""
    if percent:
        return F.concat(F.format_number(v, 2), F.lit("%"))
    a = F.abs(v)
    body = (F.when(a >= 1e9, F.concat(F.format_number(v / 1e9, 2), F.lit(" billion")))
            .when(a >= 1e6, F.concat(F.format_number(v / 1e6, 2), F.lit(" million")))
            .otherwise(F.format_number(v, 2)))
    if currency is None:
        return body
    suffix = F.lit(" " + currency) if isinstance(currency, str) else F.concat(F.lit(" "), currency)
    return F.concat(body, suffix)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType
