"""Labels, date texts, feature families, list lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Feature families and the words that decide them, first match wins.
FEATURE_FAMILIES = (
    ("Lag Features", ("lag", "shift")),
    ("Rolling Statistics", ("rolling", "mean", "std", "ewm", "moving")),
    ("Calendar / Temporal", ("day", "week", "month", "year", "quarter", "dow", "holiday")),
    ("Pricing / Promotions", ("price", "cost", "revenue", "promo", "discount")),
    ("Entity Identifiers", ("store", "category", "item", "dept")),
)


def feature_family(name: str | Column) -> Column:
    text = F.lower(F.col(name) if isinstance(name, str) else name)
    family = None
    for label, words in FEATURE_FAMILIES:
        hit = text.rlike("|".join(words))
        family = F.when(hit, label) if family is None else family.when(hit, label)
    return family.otherwise("Other")


def zone_label(key: str, name: str, region: str) -> Column:
    """``<id> - <name> (<region>)``"""
    return F.concat(F.col(key).cast("string"), F.lit(" - "), F.col(name), F.lit(" ("), F.col(region), F.lit(")"))


def series_id(columns: Sequence[str]) -> Column:
    return F.concat_ws("_", *columns)


def hour_text(time: str) -> Column:
    return F.date_format(F.col(time), "yyyy-MM-dd HH:00")


def iso_text(time: str) -> Column:
    return F.date_format(F.col(time), "yyyy-MM-dd'T'HH:mm:ss")


def list_lines(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """Bullet and numbered lines of a text column, marks removed.

    A text without such a line gives one row with the whole trimmed text.
    """
    # What starts a list line, and the marks that are stripped from it.
    starts = r"^(- |\* |>> |\d[.)].{2,})"
    marks = r"^[-*> 0123456789.)]+"
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    lines = F.transform(F.split(F.col(column), r"\r\n|\r|\n"), strip)
    items = F.transform(
        F.filter(lines, lambda s: s.rlike(starts)), lambda s: strip(F.regexp_replace(s, marks, ""))
    )
    chosen = F.when(F.size(items) > 0, items).otherwise(F.array(strip(F.col(column))))
    return df.select(*keep, F.posexplode(chosen).alias("line", "item"))
