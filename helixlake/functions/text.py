"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks a comma outside quotes while a line is split; no text holds it in practice.
_CUT = "\x01,\x02"


#: The characters with Unicode's property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    """Strip white space of any script at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def normalize_name(c: Column) -> Column:
    """A header name without spaces, tabs, hyphens and underscores, lower-cased."""
    return F.lower(F.regexp_replace(c, r"[ \t_-]", ""))


def strip_inline_comment(c: Column) -> Column:
    return trim(F.substring_index(F.substring_index(c, "#", 1), "//", 1))


def strip_comment_prefix(t: Column) -> Column:
    """A trimmed comment line without its marker, which may be repeated."""
    return trim(F.when(t.startswith("#"), F.regexp_replace(t, "^#+", "")).otherwise(F.regexp_replace(t, "^(//)+", "")))


def split_quoted(c: Column, trimmed: bool = True) -> Column:
    """Fields of a comma-separated line. A quote opens or closes anywhere; a doubled one within quotes is a quote.

    Pieces between quotes are outside (even) or inside (odd); an empty even one between two others is a doubled quote.
    """
    pieces = F.split(c, '"', -1)
    piece = lambda s, i: (F.when(i % 2 == 1, s).when((s == "") & (i > 0) & (i < F.size(pieces) - 1), F.lit('"'))
                          .otherwise(F.replace(s, F.lit(","), F.lit(_CUT))))
    fields = F.split(F.array_join(F.transform(pieces, piece), ""), _CUT, -1)
    return F.transform(fields, trim) if trimmed else fields


def split_fields(line: Column, delimiter: Column, trimmed: bool = True) -> Column:
    """Fields of a line, trimmed or as they stand; delimiter is T (tab), C (comma) or S (white space)."""
    tabs = F.split(line, "\t", -1)
    return (F.when(delimiter == "T", F.transform(tabs, trim) if trimmed else tabs).when(delimiter == "C", split_quoted(line, trimmed))
            .otherwise(F.filter(F.split(trim(line), r"(?U)\s+", -1), lambda x: x != "")))


def parse_long(c: Column) -> Column:
    """An optional sign and ASCII digits within 64 bits; else null."""
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint"))


def parse_python_int(c: Column) -> Column:
    """As parse_long, and single underscores between digits and white space around are allowed."""
    t = trim(c)
    return F.when(t.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(t, F.lit("_"), F.lit("")).try_cast("bigint"))


def parse_rsid(c: Column) -> Column:
    """Digits after any number of lower-case rs; else null."""
    return parse_long(F.regexp_replace(trim(c), "^(rs)+", ""))


def html_escape(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def rs_label(rsid: Column) -> Column:
    return F.concat(F.lit("rs"), rsid.cast("string"))
