"""Column expressions that many operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(value: Column | str) -> Column:
    """A sum of decimals as a report shows it: 0 if there was nothing to sum."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(value, F.lit(0).cast("decimal(20,2)")).cast("double")


def growth(now: Column, before: Column) -> Column:
    """Percent change in two decimals; from nothing to something is 100, from nothing to nothing unknown."""
    rate = F.round((now - before) * 100.0 / before, 2)
    return F.when(before == 0, F.when(now == 0, F.lit(None)).otherwise(F.lit(100.0))).otherwise(rate)


def clean_label(text: Column) -> Column:
    """White space in a row becomes one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def product_label(name: str = "name", variant: str = "variant") -> Column:
    return F.when(F.coalesce(F.col(variant), F.lit("")) == "", F.col(name)).otherwise(F.concat(F.col(name), F.lit(" · "), F.col(variant)))


def match_key(text: Column) -> Column:
    """A name for comparing: lower case, no spaces or parentheses."""
    return F.lower(F.regexp_replace(text, r"[\s()]+", ""))


def month(day: str = "day") -> Column:
    return F.trunc(day, "month")


def week(day: str = "day") -> Column:
    """The Monday of the week."""
    return F.to_date(F.date_trunc("week", day))


def bucket(day: str | Column, period: str) -> Column:
    column = F.col(day) if isinstance(day, str) else day
    return {"daily": column, "weekly": week(day), "monthly": month(day), "yearly": F.trunc(day, "year")}[period]


def month_index(day: str = "day") -> Column:
    return F.year(day) * 12 + F.month(day)


def program_group(label: Column) -> Column:
    """The feeding program that a label's words name, without regard to case and accents; other non-ASCII characters do not count."""
    plain = F.translate(F.lower(label), "áàâäéèêëíìîïóòôöúùûüñç", "aaaaeeeeiiiioooouuuunc")
    words = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(plain, r"[^\x00-\x7F]", ""), "[^a-z0-9]+", " "), F.lit(" "))
    out = F.lit("Unspecified feeding program")
    for text, name in ((" rizal ", "Rizal"), ("las pinas", "Las Piñas"), (" deped ", "DepEd"), (" dswd ", "DSWD")):
        out = F.when(F.contains(words, F.lit(text)), F.lit(name)).otherwise(out)
    return out


def parse_money(text: Column) -> Column:
    """Text or number as decimal(20,2), halves away from nought; blank, bad and non-finite values are null."""
    kept = F.regexp_replace(F.trim(text), r"[,₱\s]", "")
    # Most are written as they are kept.
    return F.when(text.rlike(r"^-?[0-9]{1,15}(\.[0-9]{1,2})?\z"), text.try_cast("decimal(20,2)")).when(kept.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), F.round(kept.try_cast("decimal(30,8)"), 2).cast("decimal(20,2)"))
