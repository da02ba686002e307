"""XML text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PROLOG = r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*"


def drop_prolog(raw: Column) -> Column:
    """The document from its root element on."""
    return F.regexp_replace(raw, _PROLOG, "")


def root_name(raw: Column) -> Column:
    """Tag of the root element, without its namespace prefix."""
    return F.regexp_extract(drop_prolog(raw), r"^<(?:[\w.-]+:)?([\w.-]+)", 1)


def strip_outer_element(raw: Column) -> Column:
    """The content of the root element, as text; empty when the root is not closed."""
    whole = r"(?s)^<([\w:.-]+)(?:\s[^<>]*)?>\s*(.*?)\s*</\1\s*>\s*$"
    return F.regexp_extract(drop_prolog(raw), whole, 2)


def is_closed(raw: Column) -> Column:
    """Whether the text ends with the end of its root element."""
    name = F.regexp_extract(drop_prolog(raw), r"^<([\w:.-]+)", 1)
    end = F.concat(F.lit("</"), name, F.lit(">"))
    return (name != "") & F.endswith(F.regexp_replace(raw, r"\s+$", ""), end)


def escape_cdata(raw: Column) -> Column:
    """CDATA sections as plain escaped text."""

    def piece(text: Column, number: Column) -> Column:
        inner = F.substring_index(text, "]]>", 1)
        rest = F.substring(text, F.length(inner) + 4, F.length(text))
        for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            inner = F.replace(inner, F.lit(character), F.lit(entity))
        return F.when(number == 0, text).otherwise(F.concat(inner, rest))

    # Without the "<", at which a search would stop for every tag; text without a section comes back as it is.
    opening = "![CDATA["
    pieces = F.transform(F.split(raw, r"<!\[CDATA\["), piece)
    return F.when(F.contains(raw, F.lit(opening)), F.array_join(pieces, "")).otherwise(raw)
