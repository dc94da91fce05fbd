"""Column expressions that turn raw snapshot text into typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The tokens a missing cell can carry in a raw file.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Flags, occupancy prefixes and the sentiment service's limits.
TRUE_TOKEN, FALSE_TOKEN = "t", "f"
OCCUPANCY_PREFIX = r"(?i)^(entire|private room in|shared room in|room in)\s+"
COUNT_PATTERN = r"(\d+\.\d+|\.\d+|\d+)"
CHARS_PER_RECORD = 1_000
MAX_CHARS_PER_DOCUMENT = 5_120


def blank_to_null(column: Column) -> Column:
    """Null for every token a raw file uses for "missing"."""
    return F.when(~column.isin(*NULL_TOKENS), column)


def parse_price(column: Column) -> Column:
    """``"$1,712.00"`` to a double; anything unparseable is null."""
    return F.regexp_replace(column, "[$,]", "").try_cast("double")


def parse_date(column: Column) -> Column:
    """ISO date; anything else is null."""
    return F.try_to_date(column, "yyyy-MM-dd")


def lost_date(column: Column) -> Column:
    """Present but not an ISO date -- the rule that counts what :func:`parse_date` dropped."""
    return column.isNotNull() & parse_date(column).isNull()


def parse_flag(column: Column) -> Column:
    """``t``/``f`` to boolean."""
    return F.when(column == TRUE_TOKEN, F.lit(True)).when(column == FALSE_TOKEN, F.lit(False))


def unknown_flag(column: Column) -> Column:
    """A token that is neither ``t`` nor ``f``."""
    return column.isNotNull() & ~column.isin(TRUE_TOKEN, FALSE_TOKEN)


def tenure_months(years: Column, months: Column) -> Column:
    """Total months from split years and remaining months."""
    return (years * 12 + months).cast("int")


def bad_tenure(months: Column) -> Column:
    """A remainder outside 0-11."""
    return F.coalesce((months < 0) | (months > 11), F.lit(False))


def parse_string_list(column: Column) -> Column:
    """JSON array of strings; missing or malformed becomes an empty array, never null."""
    parsed = F.from_json(column, T.ArrayType(T.StringType()))
    return F.coalesce(parsed, F.array().cast("array<string>"))


def lost_list(column: Column) -> Column:
    """Present but not a JSON array."""
    return column.isNotNull() & F.from_json(column, T.ArrayType(T.StringType())).isNull()


def bathroom_count(numeric: Column, text: Column) -> Column:
    """Count from the text column first (``half`` means 0.5), else the numeric one."""
    found = F.nullif(F.regexp_extract(text, COUNT_PATTERN, 1), F.lit("")).try_cast("double")
    half = F.coalesce(F.lower(text).contains("half"), F.lit(False))
    return F.coalesce(F.when(half, F.lit(0.5)).otherwise(found), numeric.cast("double"))


def bathroom_shared(text: Column) -> Column:
    """Whether the text says shared; null when there is no text."""
    return F.lower(text).contains("shared")


def within_box(lat: Column, lon: Column, south, north, west, east) -> Column:
    """Inclusive bounding box."""
    return lat.between(south, north) & lon.between(west, east)


def out_of_range(value: Column, lower=None, upper=None) -> Column:
    """Outside the inclusive range; bounds are scalars or columns, nulls are never flagged."""
    flagged = F.lit(False)
    if lower is not None:
        flagged = flagged | F.coalesce(value < lower, F.lit(False))
    if upper is not None:
        flagged = flagged | F.coalesce(value > upper, F.lit(False))
    return flagged


def host_is_local(location: Column, home: str = "greece") -> Column:
    """``local``/``foreign``, or ``unknown`` when the location is missing."""
    return (
        F.when(location.isNull(), "unknown")
        .when(F.lower(location).contains(home), "local")
        .otherwise("foreign")
    )


def strip(text: Column) -> Column:
    """Without leading and trailing whitespace of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_present(text: Column) -> Column:
    """A non-blank text exists."""
    return F.coalesce(strip(text), F.lit("")) != ""


def license_status(text: Column) -> Column:
    """``missing``, ``exempt`` or ``registered``."""
    tidy = F.lower(F.coalesce(strip(text), F.lit("")))
    return F.when(tidy == "", "missing").when(tidy == "exempt", "exempt").otherwise("registered")


def building_type(property_type: Column) -> Column:
    """What kind of building it is, without the occupancy prefix."""
    return F.lower(F.regexp_replace(strip(property_type), OCCUPANCY_PREFIX, ""))


def slug(text: Column) -> Column:
    """A column-safe name."""
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def days_before(anchor: Column, event: Column) -> Column:
    """Days from ``event`` to ``anchor`` as a double, null kept."""
    return F.datediff(anchor, event).cast("double")


def text_records(text: Column, per_record: int = CHARS_PER_RECORD) -> Column:
    """Billable records of one document: its length over ``per_record``, rounded up, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.length(text) / F.lit(per_record)))


def document_pieces(text: Column, limit: int = MAX_CHARS_PER_DOCUMENT) -> Column:
    """The whole document as consecutive pieces the sentiment service accepts; an empty text is one piece."""
    last = F.greatest(F.lit(0), F.ceil(F.length(text) / limit).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda n: F.substring(text, n * limit + 1, F.lit(limit)))


def label_gain(grade: Column, exponential: bool = True) -> Column:
    """``2^grade - 1``, or the grade itself."""
    return F.pow(F.lit(2.0), grade) - 1 if exponential else grade.cast("double")
