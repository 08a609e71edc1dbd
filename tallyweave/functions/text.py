"""Recognising numbers, dates and identifiers in text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The form of a number, and the date formats that count with the look of their texts.
NUMBER = r"^[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?([eE][+-]?\d+)?$"
DATE_FORMATS = {
    "yyyy/MM/dd": r"^\d{4}/\d\d/\d\d$",
    "yyyy/MM/dd HH:mm:ss": r"^\d{4}/\d\d/\d\d ",
    "MM/dd/yyyy": r"^\d\d/\d\d/\d{4}$",
    "MM/dd/yyyy HH:mm:ss": r"^\d\d/\d\d/\d{4} ",
    "dd.MM.yyyy": r"^\d\d\.\d\d\.\d{4}$",
    "yyyy-MM": r"^\d{4}-\d\d$",
    "yyyy": r"^\d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "d MMMM yyyy": r"^\d{1,2} [A-Za-z]{3,9} \d{4}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
    "MMMM d, yyyy": r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
}
#: A date with or without a time, a fraction of a second and a zone.
ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}.*)?$"
#: Words and phrases of a column's name that mark an identifier.
ID_WORDS = frozenset("id uuid guid identifier".split())
ID_PHRASES = ("student id", "user id", "order id", "record id", "customer id", "account number", "account no", "row id", "index")
#: The texts that a CSV reader takes as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def identifier_name(name: str) -> bool:
    """Whether a column's name says that it identifies rows; phrases match anywhere in the name."""
    words = re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", str(name)).lower())
    return not ID_WORDS.isdisjoint(words) or any(p in " ".join(words) for p in ID_PHRASES)


def column(name: str) -> Column:
    """A column by its plain name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def filled(text: Column) -> Column:
    return F.trim(text) != ""


def looks_numeric(text: Column) -> Column:
    return F.trim(text).rlike(NUMBER)


def as_number(text: Column) -> Column:
    """A number written as text, with or without thousands commas; null if it is none."""
    return F.trim(F.regexp_replace(text, ",", "")).try_cast("double")


def looks_dated(text: Column) -> Column:
    t = F.trim(text)
    return F.coalesce(F.when(t.rlike(ISO_DATE), t.try_cast("timestamp")), *(F.when(t.rlike(look), F.try_to_timestamp(t, F.lit(f))) for f, look in DATE_FORMATS.items())).isNotNull()


def share(hits: Column, of: Column) -> Column:
    """Part of the rows of ``of`` with ``hits``; 0 if there are none."""
    return F.coalesce(F.try_divide(F.sum(F.when(of & hits, 1).otherwise(0)).cast("double"), F.sum(F.when(of, 1).otherwise(0))), F.lit(0.0))
