"""Text functions: templates, trimming, names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_space(text: Column) -> Column:
    """Remove white space of any kind from both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def shell_words(text: Column) -> Column:
    """Join the words of ``text`` by single blanks, as a shell reads them.

    Paired quotes are removed and keep the blanks inside them, a backslash
    keeps the next character. An unpaired quote is dropped.
    """
    token = r"""(?s)('[^']*'|"[^"]*"|\\.|\s+|[^\s'"\\]+)"""

    def plain(word: Column) -> Column:
        first = F.substring(word, 1, 1)
        return (
            F.when(first.isin("'", '"'), F.substring(word, F.lit(2), F.length(word) - 2))
            .when(first == "\\", F.substring(word, 2, 1))
            .when(word.rlike(r"^\s"), F.lit(" "))
            .otherwise(word)
        )

    words = F.regexp_extract_all(strip_space(text), F.lit(token), 1)
    return F.array_join(F.transform(words, plain), "")


def fill_tight(text: Column, values: Mapping[str, Column | str]) -> Column:
    """Replace ``{{NAME}}`` (no blanks) everywhere."""
    for name, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        text = F.replace(text, F.lit("{{" + name + "}}"), value)
    return text


def fill_spaced(text: Column, settings: Column) -> Column:
    """Replace ``{{ name }}`` (one blank on both sides) from a map column.

    Entries are applied one after another, so a value may hold a later
    placeholder. ``{{name}}`` without blanks stays.
    """
    return F.aggregate(
        F.map_entries(settings),
        text,
        lambda done, entry: F.replace(
            done, F.concat(F.lit("{{ "), entry["key"], F.lit(" }}")), entry["value"]
        ),
    )


def overlay(defaults: Column, overrides: Column) -> Column:
    """Merge two string maps; ``overrides`` wins and keeps the default's place."""
    over = F.coalesce(overrides, F.create_map().cast("map<string,string>"))
    base = F.coalesce(defaults, F.create_map().cast("map<string,string>"))
    updated = F.transform_values(base, lambda k, v: F.when(F.map_contains_key(over, k), over[k]).otherwise(v))
    added = F.map_filter(over, lambda k, v: ~F.map_contains_key(base, k))
    return F.map_concat(updated, added)


def release_name(schema: Column, release: Column) -> Column:
    """``schema_release``, or ``schema`` when the release is empty or ``0``."""
    plain = release.isNull() | release.isin("", "0")
    return F.when(plain, schema).otherwise(F.concat_ws("_", schema, release))


def domain_prefix(name: Column) -> Column:
    """The part before the first underscore; empty when there is none."""
    return F.left(name, F.locate("_", name) - 1)


def _block_comment(depth: int) -> str:
    """A pattern for a block comment with others inside, up to a depth; it takes nothing back, so it is linear."""
    inner = rf"|{_block_comment(depth - 1)}" if depth else ""
    return rf"/\*(?:[^*/]++|\*(?!/){inner}|/(?!\*))*+\*/"


#: Depth to which block comments are followed inside each other.
COMMENT_DEPTH = 8
_TOKEN = "(?s)" + "|".join(
    [
        r"'(?:[^'\\]++|\\.)*+'",
        r'"[^"]*+"',
        r"\$\$.*?\$\$",
        r"--[^\n]*+",
        _block_comment(COMMENT_DEPTH),
        r"/\*.*+",
        r"[^'\"$/-]++",
        ".",
    ]
)
_HELD = "\ue000"


def split_statements(text: Column) -> Column:
    """The statements of a script: its code between semicolons.

    A semicolon in a string, a quoted name, a dollar-quoted text or a comment (block comments
    may hold others) does not end a statement. Comments become blanks, with their line breaks kept, so that
    words in them are no code and lines keep their numbers. A quote that is never closed is a
    character like any other; a block comment that is never closed lasts to the end.
    """
    is_comment = lambda t: t.startswith("--") | t.startswith("/*")
    is_quoted = lambda t: (F.length(t) > 1) & F.substring(t, 1, 1).isin("'", '"', "$")
    code = F.transform(
        F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)),
        lambda t: F.when(is_comment(t), F.regexp_replace(t, r"[^\n]+", " "))
        .when(is_quoted(t), F.translate(t, ";", _HELD))
        .otherwise(t),
    )
    return F.transform(F.split(F.array_join(code, ""), ";"), lambda s: F.translate(s, _HELD, ";"))
