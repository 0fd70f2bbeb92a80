"""Publication times written in many ways, read as UTC.

A value is recognised by its shape, its parts become one set of numbers, and a
single builder turns those into a timestamp. Each step is a layer of plain
columns; nothing depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presslake.functions.text import collapse_ws

# The years accepted, the order of an ambiguous D/M/Y date, month
# names in English and Indonesian, and zone labels in hours east of UTC.
MIN_YEAR = 1990
MAX_YEAR = 2100
AMBIGUOUS_DATE_ORDER = "day-first"
MONTH_NAMES = [
    (1, ["jan", "january", "januari"]),
    (2, ["feb", "february", "februari", "peb", "pebruari"]),
    (3, ["mar", "march", "maret"]),
    (4, ["apr", "april"]),
    (5, ["may", "mei"]),
    (6, ["jun", "june", "juni"]),
    (7, ["jul", "july", "juli"]),
    (8, ["aug", "august", "agu", "ags", "agt", "agustus"]),
    (9, ["sep", "sept", "september"]),
    (10, ["oct", "october", "okt", "oktober"]),
    (11, ["nov", "november", "nop", "nopember"]),
    (12, ["dec", "december", "des", "desember"]),
]
ENGLISH_ABBREVIATIONS = [
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
]
LOCAL_ZONES = {"wib": 7, "wita": 8, "wit": 9}
MAIL_ZONES = {
    "gmt": 0, "utc": 0, "ut": 0, "z": 0,
    "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7,
}

# The shapes, in the order they are tried.
_CLOCK = r"(?:[ ,]+\d{1,2}[:.]\d{2}(?:[:.]\d{2})?)?"
EPOCH = r"\A-?\d{9,14}\z"
ISO = r"\A\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d{1,6})? ?(?:Z|[+-]\d{2}:?\d{2})?)?\z"
YEAR_FIRST = r"\A\d{4}[/.]\d{1,2}[/.]\d{1,2}\z"
YEAR_LAST = r"\A\d{1,2}[/.-]\d{1,2}[/.-]\d{4}\z"
DAY_MONTH = rf"\A\d{{1,2}} [a-zA-Z]+,? \d{{4}}{_CLOCK}\z"
MONTH_DAY = rf"\A[a-zA-Z]+ \d{{1,2}},? \d{{4}}{_CLOCK}\z"
MAIL = (
    r"(?i)\A[a-z]{3}, \d{1,2}[ -](?:" + "|".join(ENGLISH_ABBREVIATIONS) + r")[a-z]*[ -]\d{4}"
    r"(?: \d{1,2}:\d{2}(?::\d{2})?(?: ?(?:(?:gmt|utc|ut|z)?[+-]\d{2}:?\d{2}|"
    + "|".join(MAIL_ZONES) + r"))?)?(?: \([^()]*\))?\z"
)
SHAPES = [
    ("epoch", EPOCH), ("iso", ISO), ("year_first", YEAR_FIRST), ("year_last", YEAR_LAST),
    ("day_month", DAY_MONTH), ("month_day", MONTH_DAY), ("mail", MAIL),
]

_FIRST_MS = 631_152_000_000      # 1990-01-01
_END_MS = 4_133_980_800_000      # 2101-01-01
_TEMPORARY = [
    "_dt_collapsed", "_dt_label", "_dt_value", "_dt_shape", "_dt_parts", "_dt_zone", "_dt_year", "_dt_month", "_dt_day",
    "_dt_hour", "_dt_minute", "_dt_second", "_dt_milli", "_dt_offset", "_dt_midnight", "_dt_wall_ms", "_dt_utc_ms",
]


def epoch_millis(c: Column) -> Column:
    """Numbers of 1e11 and more are milliseconds, smaller ones seconds."""
    millis = F.when(F.abs(c) >= 1e11, c).otherwise(c * 1000)
    return F.when((millis >= _FIRST_MS) & (millis < _END_MS), millis.cast("bigint"))


def utc_day(ts: Column) -> Column:
    """Calendar day; the session time zone is UTC by contract."""
    return F.date_format(ts, "yyyy-MM-dd")


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _lookup(table: dict[str, int], key: str) -> str:
    pairs = ", ".join(f"'{name}', {value}" for name, value in table.items())
    return f"try_element_at(map({pairs}), lower({key}))"


def _part(index: int) -> str:
    return f"get(_dt_parts, {index})"


def _number(text: str) -> str:
    return f"try_cast({text} AS INT)"


def _month(index: int, length: int | None = None) -> str:
    name = _part(index) if length is None else f"left({_part(index)}, {length})"
    return _lookup({name: number for number, names in MONTH_NAMES for name in names}, name)


_A, _B, _C = (_number(_part(i)) for i in range(3))
_MONTH_FIRST = f"({_A} <= 12 AND ({_B} > 12 OR {str(AMBIGUOUS_DATE_ORDER != 'day-first').upper()}))"
_NAMED = "_dt_shape IN ('day_month', 'month_day')"
_YEAR_FIRST = "_dt_shape IN ('iso', 'year_first')"

# Where each part stands, by shape. ISO parts have fixed places in the text; the
# other shapes are read as the pieces between separators.
_PARTS = {
    "_dt_year": f"WHEN {_YEAR_FIRST} THEN {_A} WHEN _dt_shape = 'mail' THEN {_number(_part(3))} ELSE {_C}",
    "_dt_month": (
        f"WHEN {_YEAR_FIRST} THEN {_B} WHEN _dt_shape = 'year_last' THEN CASE WHEN {_MONTH_FIRST} THEN {_A} ELSE {_B} END"
        f" WHEN _dt_shape = 'day_month' THEN {_month(1)} WHEN _dt_shape = 'month_day' THEN {_month(0)}"
        f" WHEN _dt_shape = 'mail' THEN {_month(2, 3)}"
    ),
    "_dt_day": (
        f"WHEN _dt_shape = 'iso' THEN {_number('substring(_dt_value, 9, 2)')} WHEN _dt_shape = 'year_first' THEN {_C}"
        f" WHEN _dt_shape = 'year_last' THEN CASE WHEN {_MONTH_FIRST} THEN {_B} ELSE {_A} END"
        f" WHEN _dt_shape = 'day_month' THEN {_A} ELSE {_B}"
    ),
    "_dt_hour": (
        f"WHEN _dt_shape = 'iso' THEN {_number('substring(_dt_value, 12, 2)')}"
        f" WHEN {_NAMED} THEN {_number(_part(3))} WHEN _dt_shape = 'mail' THEN {_number(_part(4))}"
    ),
    "_dt_minute": (
        f"WHEN _dt_shape = 'iso' THEN {_number('substring(_dt_value, 15, 2)')}"
        f" WHEN {_NAMED} THEN {_number(_part(4))} WHEN _dt_shape = 'mail' THEN {_number(_part(5))}"
    ),
    "_dt_second": (
        f"WHEN _dt_shape = 'iso' AND substring(_dt_value, 17, 1) = ':' THEN {_number('substring(_dt_value, 18, 2)')}"
        f" WHEN {_NAMED} THEN {_number(_part(5))}"
        rf" WHEN _dt_shape = 'mail' THEN try_cast(regexp_extract(_dt_value, r':\d{{2}}:(\d{{2}})', 1) AS INT)"
    ),
    "_dt_milli": r"WHEN _dt_shape = 'iso' THEN try_cast(rpad(left(regexp_extract(_dt_value, r'\.(\d+)', 1), 3), 3, '0') AS INT)",
}
_ZONE_TEXT = (
    r"CASE WHEN _dt_shape = 'iso' AND length(_dt_value) > 10 THEN regexp_extract(_dt_value, r'(Z|[+-]\d{2}:?\d{2})\z', 1)"
    r" WHEN _dt_shape = 'mail' THEN"
    r" regexp_extract(_dt_value, r'(?i)\d{4} \d{1,2}:\d{2}(?::\d{2})? ?([a-z]*(?:[+-]\d{2}:?\d{2})?)', 1) ELSE '' END"
)
_DIGITS = r"replace(regexp_extract(_dt_zone, r'[+-](\d{2}:?\d{2})\z', 1), ':', '')"
_OFFSET_MINUTES = (
    r"CASE WHEN _dt_zone RLIKE r'\d\z' THEN (CASE WHEN contains(_dt_zone, '-') THEN -1 ELSE 1 END)"
    f" * (try_cast(left({_DIGITS}, 2) AS INT) * 60 + try_cast(right({_DIGITS}, 2) AS INT))"
    f" WHEN _dt_zone <> '' THEN {_lookup({zone: hours * 60 for zone, hours in MAIL_ZONES.items()}, '_dt_zone')}"
    f" WHEN _dt_shape <> 'mail' AND _dt_label <> '' THEN {_lookup({zone: hours * 60 for zone, hours in LOCAL_ZONES.items()}, '_dt_label')} END"
)


def with_published_at(df: DataFrame, text: str, number: str | None = None, out: str = "published_at") -> DataFrame:
    """Adds ``out``; null when nothing is given or nothing is recognised."""
    df = df.withColumn("_dt_collapsed", collapse_ws(F.col(text)))
    df = df.withColumns({
        "_dt_label": F.regexp_extract(F.col("_dt_collapsed"), r"(?i) (wib|wita|wit)\z", 1),
        "_dt_value": F.regexp_replace(F.col("_dt_collapsed"), r"(?i) (?:wib|wita|wit)\z", ""),
    })
    tried = " ".join(f"WHEN _dt_value RLIKE r'{pattern}' THEN '{name}'" for name, pattern in SHAPES)
    df = df.withColumn("_dt_shape", F.expr(f"CASE WHEN length(_dt_value) > 0 THEN CASE {tried} END END"))
    df = df.withColumns({
        "_dt_parts": F.expr("CASE WHEN _dt_shape <> 'epoch' THEN split(_dt_value, '[^0-9A-Za-z]+') END"),
        "_dt_zone": F.expr(_ZONE_TEXT),
    })
    df = df.withColumns({name: F.expr(f"CASE {cases} END") for name, cases in _PARTS.items()})
    df = df.withColumn("_dt_offset", F.expr(_OFFSET_MINUTES))

    hour, minute, second = (f"coalesce(_dt_{part}, 0)" for part in ("hour", "minute", "second"))
    on_clock = F.expr(
        f"_dt_year BETWEEN {MIN_YEAR} AND {MAX_YEAR} AND _dt_day BETWEEN 1 AND 31 AND {hour} <= 23 AND {minute} <= 59"
        f" AND CASE WHEN _dt_shape = 'mail' THEN {second} <= 59"
        f" ELSE {second} <= 60 AND NOT ({second} = 60 AND {minute} = 59 AND {hour} = 23) END"
    )
    # A mail date may run past the end of its month, as mail readers allow.
    df = df.withColumn("_dt_midnight", F.when(on_clock, F.expr(
        "try_make_timestamp(_dt_year, _dt_month, CASE WHEN _dt_shape = 'mail' THEN 1 ELSE _dt_day END, 0, 0, 0, 'UTC')"
    )))
    df = df.withColumn("_dt_wall_ms", F.expr(
        "unix_millis(_dt_midnight) + CASE WHEN _dt_shape = 'mail' THEN (_dt_day - 1) * 86400000L ELSE 0L END"
        f" + (({hour} * 60 + {minute}) * 60 + {second}) * 1000L + coalesce(_dt_milli, 0)"
    ))
    typed = F.lit(None).cast("double") if number is None else F.col(number)
    df = df.withColumn("_dt_utc_ms", F.coalesce(
        epoch_millis(typed),
        F.when(F.col("_dt_shape") == "epoch", epoch_millis(F.col("_dt_value").try_cast("double")))
        .otherwise(F.expr("_dt_wall_ms - coalesce(_dt_offset, 0) * 60000L")),
    ))
    in_range = (F.col("_dt_utc_ms") >= _FIRST_MS) & (F.col("_dt_utc_ms") < _END_MS)
    return df.withColumn(out, F.when(in_range, F.timestamp_millis(F.col("_dt_utc_ms")))).drop(*_TEMPORARY)
