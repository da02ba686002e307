"""Script texts: template rendering and DDL formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsmill.functions.text import fill_spaced, overlay

# Private-use characters, which no script holds.
_OPEN, _CLOSE = "\ue000", "\ue001"
# What counts as a name, as text outside quotes, and as a line to take apart.
_WORD = r"(?U)(?<![\"'])(?<!\w)([A-Za-z_][A-Za-z0-9_]*)(?!\w)(?![\"'])"
_PIECE = r"('[^']*'|[^']++(?:'(?=[^']*$)[^']*+)?|'(?=[^']*$)[^']*+)"
_INLINE_SELECT = r"(?iU)^(\s*\)\s*AS\s+)SELECT\s+(.+?)\s+FROM\s+(.+)$"
_JOIN = r"(?iU)\s+((?:INNER\s+|LEFT\s+|RIGHT\s+|FULL\s+|CROSS\s+)?JOIN)\s"


def render_scripts(
    scripts: DataFrame, defaults: str = "defaults", overrides: str = "overrides"
) -> DataFrame:
    """Scripts with ``{{ name }}`` replaced from two map columns; overrides win."""
    settings = overlay(F.col(defaults), F.col(overrides))
    kept = [c for c in scripts.columns if c not in ("text", defaults, overrides)]
    return scripts.select(*kept, fill_spaced(F.col("text"), settings).alias("text"))


def upper_outside_strings(line: Column) -> Column:
    """Upper-case the names outside ``'...'``; names that touch a quote stay."""

    def marked_upper(piece: Column) -> Column:
        marked = F.regexp_replace(piece, _WORD, f"{_OPEN}$1{_CLOSE}")
        parts = F.transform(
            F.split(marked, _OPEN),
            lambda p: F.when(
                F.contains(p, F.lit(_CLOSE)),
                F.concat(
                    F.upper(F.substring_index(p, _CLOSE, 1)), F.substring_index(p, _CLOSE, -1)
                ),
            ).otherwise(p),
        )
        return F.array_join(parts, "")

    pieces = F.transform(
        F.regexp_extract_all(line, F.lit(_PIECE), 1),
        lambda p: F.when(p.rlike(r"^'[^']*'$"), p).otherwise(marked_upper(p)),
    )
    return F.array_join(pieces, "")


def tidy_brackets(line: Column) -> Column:
    """A blank before each opening bracket, no runs of blanks inside brackets."""
    line = F.regexp_replace(line, r"(?U)(\w)\(", "$1 (")
    line = F.regexp_replace(line, r"(?U)\(\s{2,}", "(")
    return F.regexp_replace(line, r"(?U)\s{2,}\)", ")")


def expand_select(line: Column, join_blank: bool = False) -> Column:
    """The lines of ``) AS SELECT a, b FROM t JOIN u ...`` as an array.

    The blank after JOIN is lost in this format; ``join_blank`` keeps it.
    """
    prefix = F.regexp_extract(line, _INLINE_SELECT, 1)
    columns = F.split(F.regexp_extract(line, _INLINE_SELECT, 2), ",")
    source = F.concat(F.lit("FROM "), F.regexp_extract(line, _INLINE_SELECT, 3))
    last = F.size(columns) - 1
    listed = F.transform(
        columns,
        lambda c, i: F.concat(
            F.lit("    "),
            F.regexp_replace(c, r"(?U)^\s+|\s+$", ""),
            F.when(i < last, F.lit(",")).otherwise(F.lit("")),
        ),
    )
    joined = F.regexp_replace(source, _JOIN, f"{_OPEN}$1{' ' if join_blank else ''}")
    lines = F.concat(
        F.array(F.concat(prefix, F.lit("SELECT"))), listed, F.split(joined, _OPEN)
    )
    return F.when(line.rlike(_INLINE_SELECT), lines).otherwise(F.array(line))


def format_ddl_lines(lines: Column, join_blank: bool = False) -> Column:
    """An array of DDL lines, formatted; comment lines stay as they are.

    The steps are separate transforms, so that each line is worked out once
    per step.
    """
    comment = r"(?U)^\s*--"
    spaced = F.transform(lines, lambda l: F.replace(l, F.lit("\t"), F.lit("    ")))
    upper = F.transform(
        spaced, lambda l: F.when(l.rlike(comment), l).otherwise(upper_outside_strings(l))
    )
    tidy = F.transform(upper, lambda l: F.when(l.rlike(comment), l).otherwise(tidy_brackets(l)))
    return F.flatten(F.transform(tidy, lambda l: expand_select(l, join_blank)))


def format_ddl(scripts: DataFrame, join_blank: bool = False) -> DataFrame:
    """DDL scripts ``(file, text)`` as formatted lines ``(file, line, text)``.

    ``line`` counts the output lines; a script stays within its row until it
    is cut into lines, so there is no shuffle.
    """
    done = format_ddl_lines(F.split("text", "\n"), join_blank)
    return scripts.select("file", F.posexplode(done).alias("_pos", "text")).select(
        "file", (F.col("_pos") + 1).cast("bigint").alias("line"), "text"
    )
