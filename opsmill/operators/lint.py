"""Scanning SQL scripts against the rule catalogue, and external linter findings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmill.functions.text import split_statements, strip_space
from opsmill.operators.lint_rules import (
    EXTERNAL_SEVERITY,
    SKIPPED_CODES,
    SKIPPED_PATHS,
    STATEMENT_RULES,
    Rule,
    rules_for,
)
from opsmill.session import materialize

EXTERNAL_CATEGORY = "External"


def split_lines(scripts: DataFrame) -> DataFrame:
    """``(file, text)`` scripts as ``(file, line, text)``, lines counted from one."""
    return scripts.select(
        "file", F.posexplode(F.split("text", "\n")).alias("_pos", "text")
    ).select("file", (F.col("_pos") + 1).cast("bigint").alias("line"), "text")


def number_lines(pieces: DataFrame) -> DataFrame:
    """``(file, block, value)`` rows of files read in blocks as ``(file, line, text)``.

    Every block tells how many lines it has; its first line number is the
    total of the blocks before it. Only the block counts (one row per block)
    are ordered within a file. The tagged rows are written once, so that both
    uses see the same row ids whatever happens to the executors.
    """
    tagged = materialize(pieces.withColumn("_id", F.monotonically_increasing_id()), "lines")
    blocks = tagged.groupBy("file", "block").agg(
        F.min("_id").alias("_first"), F.count("*").alias("_lines")
    )
    earlier = (
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = blocks.select(
        "file", "block", "_first", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before")
    )
    line = F.col("_before") + F.col("_id") - F.col("_first") + 1
    return tagged.join(starts, ["file", "block"]).select(
        "file", line.alias("line"), F.col("value").alias("text")
    )


def _rule_column(number: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), number)


def scan_lines(lines: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Findings of ``rules`` in ``(file, line, text)`` rows.

    One pass without a shuffle: all patterns are literals of one projection,
    compiled once per task, and a line gives one row per rule it breaks. A
    pattern is tried only on lines that hold a word it needs, which plain
    search finds much faster.
    """
    rules = rules_for("core") if rules is None else rules
    text = F.col("text")
    # The fold under which java.util.regex compares letters without case.
    folded = lines.withColumn("_folded", F.lower(F.upper(text)))
    words = sorted({word for r in rules for word in r.needs})
    held = {word: f"_has_{i}" for i, word in enumerate(words)}
    marked = folded.select(
        "file", "line", "text", *[F.contains("_folded", F.lit(w)).alias(c) for w, c in held.items()]
    )

    def breaks(rule: Rule) -> Column:
        found = text.rlike(rule.java_pattern)
        if not rule.needs:
            return found
        return reduce(or_, [F.col(held[word]) for word in rule.needs]) & found

    numbers = [F.when(breaks(r), F.lit(i)).otherwise(0) for i, r in enumerate(rules, 1)]
    broken = F.array_remove(F.array(*numbers), 0)
    number = F.col("_rule")
    return marked.select("file", "line", "text", F.explode(broken).alias("_rule")).select(
        "file",
        _rule_column(number, [r.code for r in rules]).alias("rule"),
        _rule_column(number, [r.name for r in rules]).alias("name"),
        _rule_column(number, [r.category for r in rules]).alias("category"),
        _rule_column(number, [r.severity for r in rules]).alias("severity"),
        _rule_column(number, [r.description for r in rules]).alias("description"),
        "line",
        strip_space(text).alias("text"),
    )


def scan_scripts(scripts: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Findings in whole scripts ``(file, text)``."""
    return scan_lines(split_lines(scripts), rules)


def scan_statements(scripts: DataFrame, rules: list[Rule] | None = None, code: bool = False) -> DataFrame:
    """Findings of statement rules, with the statement's number and the line on which it starts.

    Scripts are split at every semicolon; with ``code`` only where a statement ends, and
    comments count as blanks (``split_statements``). A statement starts at its first visible
    character. All text before it is counted inside the row, once per script.
    """
    rules = STATEMENT_RULES if rules is None else rules
    pieces = scripts.select("file", (split_statements(F.col("text")) if code else F.split("text", ";")).alias("_pieces"))
    blank = r"^[ \t\n\x0b\f\r]*"

    def breaks(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))

    def place(done: Column, piece: Column) -> Column:
        lead = breaks(F.regexp_extract(piece, blank, 0))
        return F.struct(
            F.concat(done["starts"], F.array(done["line"] + lead)).alias("starts"),
            (done["line"] + breaks(piece)).alias("line"),
        )

    begun = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(1).alias("line"))
    starts = F.aggregate("_pieces", begun, place, lambda done: done["starts"])
    statements = pieces.select("file", F.posexplode(F.arrays_zip("_pieces", starts.alias("_starts"))).alias("_pos", "_p"))
    numbered = statements.select(
        F.struct("file", (F.col("_pos") + 1).cast("bigint").alias("statement")).alias("file"),
        F.col("_p._starts").cast("bigint").alias("line"),
        F.col("_p._pieces").alias("text"),
    )
    found = scan_lines(numbered, rules)
    others = [c for c in found.columns if c != "file"]
    return found.select("file.file", "file.statement", *others)


def rules_from(catalogue: DataFrame) -> list[Rule]:
    """Rules kept in a table ``(rule, category, severity, description, pattern)``."""
    columns = ["rule", "category", "severity", "description", "pattern"]
    return [
        Rule(r["rule"], r["rule"], r["category"], r["severity"], r["description"], r["pattern"])
        for r in catalogue.select(*columns).orderBy("rule").toLocalIterator()
    ]


def external_findings(
    reports: DataFrame, missing_line: int = 0, category: str = EXTERNAL_CATEGORY
) -> DataFrame:
    """Violations of external linter output, one row each; ``category`` names the tool."""
    v = F.col("v")
    return reports.select(
        F.coalesce("filepath", F.lit("")).alias("file"), F.explode("violations").alias("v")
    ).select(
        "file",
        F.coalesce(v["code"], F.lit("")).alias("rule"),
        F.lit(category).alias("category"),
        F.coalesce(v["description"], F.lit("")).alias("description"),
        F.coalesce(v["start_line_no"], F.lit(missing_line)).cast("bigint").alias("line"),
    )


def external_severity(code: Column) -> Column:
    """Severity of an external code; MINOR unless listed."""
    by_severity: dict[str, list[str]] = {}
    for key, severity in EXTERNAL_SEVERITY.items():
        by_severity.setdefault(severity, []).append(key)
    named = F.lit("MINOR")
    for severity, codes in by_severity.items():
        if severity != "MINOR":
            named = F.when(code.isin(codes), F.lit(severity)).otherwise(named)
    return named


def external_issues(reports: DataFrame, engine: str = "sqlfluff") -> DataFrame:
    """External findings as issues; some codes and paths are left out."""
    findings = external_findings(reports, missing_line=1)
    path = F.col("file")
    kept = ~F.col("rule").isin(SKIPPED_CODES)
    for part in SKIPPED_PATHS:
        kept = kept & ~path.contains(part)
    return findings.where(kept).select(
        F.lit(engine).alias("engine_id"),
        F.col("rule").alias("rule_id"),
        external_severity(F.col("rule")).alias("severity"),
        F.lit("CODE_SMELL").alias("type"),
        F.col("description").alias("message"),
        path.alias("file_path"),
        F.col("line").alias("start_line"),
    )


def lint_summary(findings: DataFrame) -> DataFrame:
    """Findings by category and rule, with totals (NULL rule, NULL category)."""
    return findings.rollup("category", "rule").agg(F.count("*").alias("findings"))


def lint_totals(findings: DataFrame, external: DataFrame) -> DataFrame:
    """Findings per tool and overall, and whether there are any."""
    both = findings.select(F.lit("custom").alias("tool")).unionByName(
        external.select(F.lit("external").alias("tool"))
    )
    return both.rollup("tool").agg(F.count("*").alias("findings")).select(
        F.coalesce("tool", F.lit("all")).alias("tool"),
        "findings",
        (F.col("findings") > 0).alias("failing"),
    )
