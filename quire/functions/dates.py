"""Date column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import _C, _col, once

US_DATE = "M/d/yyyy"
US_DATE_TEXT = r"^\d{1,2}/\d{1,2}/\d{4}$"


def parse_us_date(c: _C) -> Column:
    """``MM/DD/YYYY`` (one or two digit month/day, four digit year) or NULL."""
    return once(_col(c), lambda t: F.when(t.rlike(US_DATE_TEXT), F.try_to_date(t, US_DATE)))


def age_at(birth: _C, evaluation: _C, unknown: str = "Unknown") -> Column:
    """``{y}-years, {m}-months`` with month borrow when the day is smaller and
    year borrow when months go negative; ``unknown`` for a bad date.

    Not ``months_between``: it counts Jan 31 -> Feb 28 as a full month.
    """
    # whole months with the day borrow; the year borrow of the rule is then
    # floor division (the month difference always lies in [-12, 11])
    def months(p: Column) -> Column:
        b, e = p["b"], p["e"]
        return ((F.year(e) * 12 + F.month(e)) - (F.year(b) * 12 + F.month(b))
                - F.when(F.dayofmonth(e) < F.dayofmonth(b), 1).otherwise(0))

    def shown(total: Column) -> Column:
        text = F.concat(F.floor(total / 12).cast("string"), F.lit("-years, "), F.pmod(total, F.lit(12)).cast("string"), F.lit("-months"))
        return F.when(total.isNotNull(), text).otherwise(F.lit(unknown))

    both = F.struct(parse_us_date(birth).alias("b"), parse_us_date(evaluation).alias("e"))
    return once(once(both, months), shown)


def date_before_comma(label: _C, fallback: str = "1900-01-01") -> Column:
    """Date parsed from the text before the first comma, else ``fallback``.

    Accepts ``m/d/yyyy`` and ISO ``yyyy-mm-dd``.
    """
    head = F.regexp_replace(F.substring_index(_col(label), ",", 1), r"(?U)^\s+|\s+\z", "")
    iso = F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(head, "yyyy-M-d"))
    return F.coalesce(parse_us_date(head), iso, F.lit(fallback).cast("date"))
