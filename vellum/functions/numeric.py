"""Numeric coercion and type-family helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A finite decimal number with optional sign and exponent, surrounded by
# optional blanks. Spark's cast also accepts Java suffixes such as '1d',
# which pandas rejects, so the text is checked before casting.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def is_string_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def kind_of(dt: T.DataType) -> str:
    """numeric | datetime | categorical | boolean | other."""
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if is_numeric_type(dt):
        return "numeric"
    if is_datetime_type(dt):
        return "datetime"
    if is_string_type(dt):
        return "categorical"
    return "other"


def nan_to_null(c: Column) -> Column:
    """pandas treats NaN as missing; Spark treats it as a value."""
    return F.when(F.isnan(c), None).otherwise(c)


def number_text(c: Column) -> Column:
    """A double as Python writes it: plain digits from 1e-4 up to 1e16, else
    ``1.5e+16`` / ``1e-05``. Between 1e-3 and 1e7 that is Spark's own text;
    the long way for the rest stays out of the generated code, which would
    otherwise grow beyond what the JVM compiles."""
    size = F.abs(c)
    return (F.when((size >= 1e-3) & (size < 1e7) | (size == 0), c.cast("string"))
            .otherwise(F.element_at(F.transform(F.array(c), _number_text), 1)))


def _number_text(c: Column) -> Column:
    size = F.abs(c)
    plain = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    text = c.cast("string")
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1)
    sign, digits = F.when(power.startswith("-"), "-").otherwise("+"), F.regexp_replace(power, "^-", "")
    scientific = F.concat(mantissa, F.lit("e"), sign, F.lpad(digits, F.greatest(F.length(digits), F.lit(2)), F.lit("0")))
    return (F.when((size >= 1e7) & (size < 1e16) | (size >= 1e-4) & (size < 1e-3), plain)
            .when(F.isnan(c), "nan").when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
            .when(text.contains("E"), scientific).otherwise(text))


def to_number(c: Column, dt: T.DataType | None = None) -> Column:
    """``pd.to_numeric(errors='coerce')`` as a double column."""
    if dt is not None and is_numeric_type(dt):
        return nan_to_null(c.cast("double"))
    if dt is not None and isinstance(dt, T.BooleanType):
        return c.cast("double")
    s = c.cast("string")
    return F.when(s.rlike(NUMBER_PATTERN), F.trim(s).try_cast("double"))


# Layouts tried in this order after ISO when no formats are given; of the two
# readings of 1/2/2024 the American one comes first, as pandas takes it.
DATE_LAYOUTS = ("M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "d/M/yyyy", "d/M/yyyy H:mm", "d/M/yyyy H:mm:ss", "M-d-yyyy",
                "d-M-yyyy", "d.M.yyyy", "d.M.yyyy H:mm", "yyyy/M/d", "yyyy/M/d H:mm:ss", "yyyy.M.d", "yyyyMMdd",
                "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "MMM yyyy")


def to_timestamp(c: Column, formats: list[str] | None = None,
                 dt: T.DataType | None = None, unit: str | None = None) -> Column:
    """``pd.to_datetime(errors='coerce')`` with an explicit list of formats, as
    a naive timestamp (TIMESTAMP_NTZ, like pandas' datetime64); text is read
    as wall-clock time. Numbers are rejected unless ``unit`` ('s', 'ms', 'us')
    is given (epoch time, UTC). Without formats ISO text and ``DATE_LAYOUTS`` are
    read.
    """
    if dt is not None and isinstance(dt, T.TimestampType):
        return c
    if dt is not None and is_datetime_type(dt):
        return c.cast("timestamp_ntz")
    if dt is not None and is_numeric_type(dt):
        if unit is None:
            return F.lit(None).cast("timestamp_ntz")
        fn = {"s": F.timestamp_seconds, "ms": F.timestamp_millis, "us": F.timestamp_micros}[unit]
        return fn(c.cast("long")).cast("timestamp_ntz")  # wall clock of the (UTC) session time zone
    s = c.cast("string")
    if not formats:
        return F.coalesce(F.try_to_timestamp(s), *[F.try_to_timestamp(s, F.lit(f)) for f in DATE_LAYOUTS]).cast("timestamp_ntz")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b with a zero or missing divisor giving 0 (the transform's rule)."""
    return F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))


# Functions accepted by apply_function (fixed allow-list).
FUNCTIONS = {
    "ln": lambda c: F.when(c > 0, F.ln(c)),
    "log": lambda c: F.when(c > 0, F.ln(c)),
    "log10": lambda c: F.when(c > 0, F.log10(c)),
    "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)),
    "exp": lambda c: F.exp(c),
    "abs": lambda c: F.abs(c),
    "round": lambda c: F.round(c, 0),
    "floor": lambda c: F.floor(c).cast("double"),
    "ceil": lambda c: F.ceil(c).cast("double"),
}


def apply_function(c: Column, name: str) -> Column:
    try:
        fn = FUNCTIONS[name.lower()]
    except KeyError:
        raise ValueError(f"Unsupported function '{name}'. Use one of {sorted(FUNCTIONS)}") from None
    return fn(c.cast("double"))
