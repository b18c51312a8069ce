"""Date parsing as column functions. Today is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.functions.columns import strip

#: Written forms of a date: the shape of the whole text, the part that holds the date, and the format of that part. The shapes exclude one
#: another, so that a text is parsed once. A time's offset doesn't move the date.
FORMS = {
    "iso_zone": (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:?[0-9]{2})$", r"^(.{10})", "yyyy-MM-dd"),
    "iso": (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$", r"^(.{10})", "yyyy-MM-dd"),
    "day": (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", r"(.*)", "yyyy-M-d"),
    "dotted": (r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$", r"(.*)", "d.M.yyyy"),
    "slashed": (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", r"(.*)", "d/M/yyyy"),
    "day_month": (r"^[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4}$", r"(.*)", "d MMMM yyyy"),
    "month_day": (r"^[A-Za-z]{3,9} [0-9]{1,2}, [0-9]{4}$", r"(.*)", "MMMM d, yyyy"),
    "month_plain": (r"^[A-Za-z]{3,9} [0-9]{1,2} [0-9]{4}$", r"(.*)", "MMMM d yyyy"),
    "mail": (r"^[A-Za-z]{3}, [0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}$", r"^[A-Za-z]{3}, ([0-9]{1,2} [A-Za-z]{3} [0-9]{4})", "d MMM yyyy"),
}
#: Forms of a strict date, with and without a range check.
STRICT = ["iso_zone", "iso", "day", "dotted", "day_month", "month_day"]
UNRANGED = ["iso", "day", "dotted", "day_month", "month_day"]
UNRANGED_SLASHED = ["iso", "day", "day_month", "month_day", "slashed"]
#: Forms of the times in feeds; a weekday before a comma is cut off first.
STAMPS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z"]
EARLIEST = dt.date(1995, 1, 1)


def clean_date(raw: Column) -> Column:
    """Drops a leading `On :`, ordinal endings and a weekday."""
    x = F.regexp_replace(F.trim(raw), r"(?i)^on\s*:?\s+", "")
    x = F.regexp_replace(x, r"(?i)\b([0-9]{1,2})(st|nd|rd|th)\b", "$1")
    return F.trim(F.regexp_replace(x, r"^[A-Za-z]{3,9}, (?=[0-9])", ""))


def lenient_timestamp(raw: Column) -> Column:
    """A feed's time in UTC, or null."""
    x = clean_date(raw)
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in STAMPS])


def parse_date(text: Column, forms: list[str]) -> Column:
    """The date of a text in one of the forms, or null."""
    out = F.lit(None).cast("date")
    for name in forms:
        shape, part, form = FORMS[name]
        found = F.initcap(F.regexp_extract(text, part, 1)) if "MMM" in form else F.regexp_extract(text, part, 1)
        out = F.when(text.rlike(shape), F.try_to_timestamp(found, F.lit(form)).cast("date")).otherwise(out)
    return out


def lenient_date(raw: Column, today: dt.date, forms: list[str] | None = None) -> Column:
    """The date, or today."""
    return F.coalesce(parse_date(strip(raw), list(FORMS) if forms is None else forms), F.lit(today))


def dates_by_source(rows: DataFrame, raw: str, source: str, forms: dict[str, list[str]], today: dt.date, cleaned: tuple[str, ...] = ()) -> DataFrame:
    """rows with `date`: each source's raw text in one of its own forms, or today; the texts of `cleaned` sources are cleaned first. The
    text is cleaned once, in a projection of its own; a source that isn't listed gets today."""
    text = F.when(F.col(source).isin(*cleaned), clean_date(F.col(raw))).otherwise(strip(raw)) if cleaned else strip(raw)
    by = F.lit(None).cast("date")
    for name, listed in forms.items():
        by = F.when(F.col(source) == name, parse_date(F.col("_text"), listed)).otherwise(by)
    return rows.withColumn("_text", text).withColumn("date", F.coalesce(by, F.lit(today))).drop("_text")


def strict_date(raw: Column, today: dt.date | None, forms: list[str] | None = None) -> Column:
    """The date in one of the forms (STRICT, or UNRANGED without today), or null; with today, also null outside EARLIEST < date <= today;
    without it only the first 19 characters count."""
    if today is None:
        return parse_date(F.substring(strip(raw), 1, 19), UNRANGED if forms is None else forms)
    d = parse_date(strip(raw), STRICT if forms is None else forms)
    return F.when((d > F.lit(EARLIEST)) & (d <= F.lit(today)), d)


def prefer_dates(*dates: Column) -> Column:
    """The first date that is known: of the URL, then of the page, then of the list, as they are given."""
    return F.coalesce(*dates)


def url_date(url: Column, today: dt.date) -> Column:
    """The date in a path /yyyy/mm/dd/, in range."""
    part = lambda i: F.regexp_extract(url, r"/([0-9]{4})/([0-9]{2})/([0-9]{2})/", i)
    d = F.try_to_timestamp(F.concat_ws("-", part(1), part(2), part(3)), F.lit("yyyy-MM-dd")).cast("date")
    return F.when((d > F.lit(EARLIEST)) & (d <= F.lit(today)), d)


def month_spine(rows: DataFrame, column: str, today: dt.date) -> DataFrame:
    """(month): first days of the months from the earliest row to today."""
    first = rows.agg(F.trunc(F.min(column), "MM").alias("lo"))
    return first.select(F.explode(F.expr(f"sequence(lo, date'{today}', interval 1 month)")).alias("month"))
