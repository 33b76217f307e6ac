"""File names from templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date directives and what they mean to Spark.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM"}


def date_pattern(text: str) -> str:
    """A Spark date pattern for a text with % directives; other letters are quoted."""
    out, k = "", 0
    while k < len(text):
        if text[k] == "%":
            if text[k : k + 2] not in DIRECTIVES:
                raise ValueError(f"unknown date directive {text[k : k + 2]!r}")
            out, k = out + DIRECTIVES[text[k : k + 2]], k + 2
        else:
            out, k = out + (f"'{text[k]}'" if text[k].isalpha() else text[k]), k + 1
    return out


def fill_template(template: str, index: Column, file_id: Column, date: Column, month: Column, day: Column, year: Column) -> Column:
    """{index} (from 1, four digits), {id} (six), {date}, {month} and {day} (two), {year}: all occurrences, in this order."""
    out = F.lit(template)
    number = lambda pattern, c: F.format_string(pattern, c)
    for name, value in (("{index}", number("%04d", index + 1)), ("{id}", number("%06d", file_id)), ("{date}", date), ("{month}", number("%02d", month)),
                        ("{day}", number("%02d", day)), ("{year}", year.cast("string"))):
        out = F.replace(out, F.lit(name), value)
    return out
