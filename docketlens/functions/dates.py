"""Meeting date ranges written in running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import collapse_spaces

# --- fixed values: the five written forms, in priority order -------------------------------------
NUMERIC_RANGE = r"(?i)(\d{1,2})/(\d{1,2})/(\d{4})\s+to\s+(\d{1,2})/(\d{1,2})/(\d{4})"
CROSS_MONTH_RANGE = (
    r"(?i)(\d{1,2})\s+([A-Za-z]+)\s*[-–]\s*(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})"
)
DOCUMENT_YEAR_RANGE = (
    r"(?i)\b[A-Z]\d-(\d{2})[0-9X]+.*?([A-Za-z]{3,})\.?\s+(\d{1,2})(?:st|nd|rd|th)?"
    r"\s*[-–]\s*(\d{1,2})(?:st|nd|rd|th)?"
)
FROM_TO_RANGE = (
    r"(?i)from\s+(?:Monday\s+)?(\d{1,2})\s+to\s+(?:Friday\s+)?(\d{1,2})"
    r"\s+(?:of\s+)?([A-Za-z]+),?\s+(\d{4})"
)
DAY_RANGE = r"(?i)(\d{1,2})\s*[-–]\s*(\d{1,2})\s+([A-Za-z]+),?\s+(\d{4})"


def _month(name: Column) -> Column:
    pairs = [F.lit(x) for i, m in enumerate(K.MONTHS, 1) for x in (m, str(i))]
    return F.create_map(*pairs)[F.lower(F.substring(name, 1, 3))]


def _date(year: Column, month: Column, day: Column) -> Column:
    # An impossible day or month gives null instead of an error.
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), month, day), "yyyy-M-d")


def _range(starts_on: Column, ends_on: Column) -> Column:
    both = starts_on.isNotNull() & ends_on.isNotNull()
    return F.when(both, F.struct(starts_on.alias("starts_on"), ends_on.alias("ends_on")))


def _match(line: Column, pattern: str) -> Column:
    """The first match of a form as one string, null if there is none; one pass over the text."""
    found = F.regexp_extract(line, pattern, 0)
    return F.when(found != "", found)


def parse_meeting_date_range(text: Column) -> Column:
    """Struct ``(starts_on, ends_on)`` of the first form that names two real dates, else null.

    Each form is searched once; its parts are then cut from the short match.
    """
    line = collapse_spaces(text)
    dated = F.when(F.rlike(line, F.lit(r"\d")), line)

    def cut(pattern: str, build) -> Column:
        # The array binds the match, so that the search is not repeated for each part.
        bound = F.transform(F.array(_match(dated, pattern)), lambda m: F.when(
            m.isNotNull(), build(lambda i: F.regexp_extract(m, pattern, i))
        ))
        return bound[0]

    def named(start: int, end: int, month: int, year: int, century: bool = False):
        def build(part):
            number = _month(part(month))
            full = F.concat(F.lit("20"), part(year)) if century else part(year)
            # concat_ws would skip a null month, so an unknown month name must void the date itself.
            return F.when(
                number.isNotNull(),
                _range(_date(full, number, part(start)), _date(full, number, part(end))),
            )

        return build

    def numeric(part):
        return _range(_date(part(3), part(2), part(1)), _date(part(6), part(5), part(4)))

    def cross_month(part):
        first, last = _month(part(2)), _month(part(4))
        return F.when(
            first.isNotNull() & last.isNotNull(),
            _range(_date(part(5), first, part(1)), _date(part(5), last, part(3))),
        )

    return F.coalesce(
        cut(NUMERIC_RANGE, numeric),
        cut(CROSS_MONTH_RANGE, cross_month),
        cut(DOCUMENT_YEAR_RANGE, named(3, 4, 2, 1, century=True)),
        cut(FROM_TO_RANGE, named(1, 2, 3, 4)),
        cut(DAY_RANGE, named(1, 2, 3, 4)),
    )
