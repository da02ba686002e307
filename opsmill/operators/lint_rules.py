"""The rule catalogue of the script scanner."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Rule:
    """A line of a script breaks the rule when ``pattern`` is found in it.

    Every match holds one of the texts in ``needs``, in lower case; with none
    given, the pattern is tried on every line.
    """

    code: str
    name: str
    category: str
    severity: str
    description: str
    pattern: str
    needs: tuple[str, ...] = ()

    @property
    def java_pattern(self) -> str:
        """``pattern`` for java.util.regex, with Unicode classes and ``\\n`` as the only line end.

        A look-behind for an earlier comment sign is tested again at every
        place of the line; walking up to the comment sign instead is linear.
        """
        walk = self.pattern.replace("(?<!--.*)", "^(?:(?!--).)*?")
        return "(?Ud)" + walk


# Code, name, category, severity, description, pattern.
CORE_RULES = [
    Rule("DO01", "safety.create_schema_safe", "Safety", "MAJOR",
         "CREATE SCHEMA must use IF NOT EXISTS or OR REPLACE.",
         r"(?i)^\s*CREATE\s+(?!OR\s+REPLACE\b)(?!.*\bIF\s+NOT\s+EXISTS\b).*?\bSCHEMA\b",
         needs=("create",)),
    Rule("DO02", "safety.create_table_safe", "Safety", "MAJOR",
         "CREATE TABLE must use IF NOT EXISTS or OR REPLACE.",
         r"(?is)^(?!\s*--).*CREATE\s+(?!OR\s+REPLACE\b|.*IF\s+NOT\s+EXISTS\b).*TABLE\b",
         needs=("create",)),
    Rule("DO03", "safety.no_hardcoded_prefix", "Safety", "MAJOR",
         "CREATE statements must not hardcode database/schema prefix.",
         r"(?i)^(?!\s*--)\s*create\s+(or\s+replace\s+)?(table|view|schema)\s+(if\s+not\s+exists\s+)?[a-z0-9_]+\.[a-z0-9_]+(\.[a-z0-9_]+)?",
         needs=("create",)),
    Rule("DO04", "security.no_grant_public", "Security", "CRITICAL",
         "GRANT to PUBLIC is not allowed.",
         r"(?i)^(?!\s*--).*grant\s+.*\s+to\s+public\b",
         needs=("grant",)),
    Rule("DO05", "safety.drop_if_exists", "Safety", "MAJOR",
         "DROP must use IF EXISTS.",
         r"(?i)^\s*DROP\s+(SCHEMA|TABLE|VIEW|DYNAMIC\s+TABLE|STAGE|FILE\s+FORMAT|PROCEDURE|FUNCTION|TASK)\s+(?!IF\s+EXISTS\b)",
         needs=("drop",)),
    Rule("DO06", "safety.no_use_statements", "Safety", "CRITICAL",
         "USE DATABASE/SCHEMA/ROLE statements are not allowed.",
         r"(?i)^(?!\s*--)\s*USE\s+(DATABASE|SCHEMA|ROLE)\b",
         needs=("use",)),
    Rule("DO07", "datatype.timestamp_tz_only", "Data Type", "MAJOR",
         "Only TIMESTAMP_TZ is allowed (no NTZ/LTZ).",
         r"(?i)(?<!--.*)\bTIMESTAMP_(NTZ|LTZ)(\s*\(\s*\d+\s*\))?\b",
         needs=("stamp_",)),
    Rule("DO08", "naming.schema_prefix", "Naming", "MAJOR",
         "Schema names must follow {DOMAIN}_{MATURITY}_ prefix pattern.",
         r"(?i)^(?!\s*--)\s*CREATE\s+(OR\s+REPLACE\s+)?SCHEMA\s+(IF\s+NOT\s+EXISTS\s+)?(?:[a-z0-9_]+\.)?(?!RAW_|CUR_|AGG_|GOL_|REF_)[a-z0-9_]+;",
         needs=("create",)),
    Rule("DO09", "naming.schema_version", "Naming", "MAJOR",
         "Schema names must end with _vNNN version pattern.",
         r"(?i)^(?!\s*--)\s*CREATE\s+(OR\s+REPLACE\s+)?SCHEMA\s+(IF\s+NOT\s+EXISTS\s+)?(?:[a-z0-9_]+\.)?[a-z0-9_]+(?<!_v\d\d\d);",
         needs=("create",)),
    Rule("DO10", "naming.table_pattern", "Naming", "MAJOR",
         "Table names must follow {DOM}{COMP}_{MAT}_{TB}_ pattern.",
         r"(?i)^(?!\s*--)\s*CREATE\s+(OR\s+REPLACE\s+)?(?!DYNAMIC\s)TABLE\s+(IF\s+NOT\s+EXISTS\s+)?(?:[A-Z0-9_]+\.){0,2}(?![A-Z0-9]{3}[A-Z]_(RAW|CUR|AGG|GOL)_TB_)[A-Z_][A-Z0-9_]*",
         needs=("create",)),
    Rule("DO11", "naming.view_pattern", "Naming", "MAJOR",
         "View names must follow {DOM}{COMP}_{MAT}_{VW}_ pattern.",
         r"(?i)^(?!\s*--)\s*CREATE\s+(OR\s+REPLACE\s+)?VIEW\s+(?:[A-Z0-9_]+\.){0,2}(?![A-Z0-9]{3}[A-Z]_(RAW|CUR|AGG|GOL)_VW_)[A-Z_][A-Z0-9_]*",
         needs=("create",)),
    Rule("DO12", "naming.dynamic_table_pattern", "Naming", "MAJOR",
         "Dynamic Table names must follow {DOM}{COMP}_{MAT}_{DT}_ pattern.",
         r"(?i)^(?!\s*--)\s*CREATE\s+(OR\s+REPLACE\s+)?DYNAMIC\s+TABLE\s+(?:[A-Z0-9_]+\.){0,2}(?![A-Z0-9]{3}[A-Z]_(RAW|CUR|AGG|GOL)_DT_)[A-Z_][A-Z0-9_]*",
         needs=("create",)),
    Rule("DO13", "naming.stage_pattern", "Naming", "MAJOR",
         "Stage names must follow {DOM}{COMP}_{MAT}_{ST}_ pattern.",
         r"(?i)^(?!\s*--)\s*CREATE\s+(OR\s+REPLACE\s+)?STAGE\s+(?:[A-Z0-9_]+\.){0,2}(?![A-Z0-9]{3}[A-Z]_(RAW|CUR|AGG|GOL)_ST_)[A-Z_][A-Z0-9_]*",
         needs=("create",)),
    Rule("DO14", "dependency.no_cross_database", "Dependency", "CRITICAL",
         "Cross-database dependencies are not allowed.",
         r"^.*cross_db_true.*$",
         needs=("cross_",)),
    Rule("DO15", "dependency.no_cross_schema", "Dependency", "CRITICAL",
         "Cross-schema dependencies are not allowed.",
         r"^.*cross_schema_true.*$",
         needs=("cross_",)),
    Rule("DO16", "security.no_grant_all", "Security", "MAJOR",
         "GRANT ALL PRIVILEGES is not allowed.",
         r"(?i)^(?!\s*--)\s*GRANT\s+ALL\s+(PRIVILEGES\s+)?ON\b",
         needs=("grant",)),
    Rule("DO17", "security.no_accountadmin", "Security", "CRITICAL",
         "ACCOUNTADMIN usage in SQL scripts is not allowed.",
         r"(?i)^(?!\s*--)\s*(USE\s+ROLE|SET\s+ROLE|GRANT\s+.*TO\s+ROLE|GRANT\s+ROLE)\s+.*\bACCOUNTADMIN\b",
         needs=("accountadm",)),
    Rule("DO18", "security.no_plaintext_password", "Security", "BLOCKER",
         "Plaintext passwords in DDL are not allowed.",
         r"(?i)^(?!\s*--)\s*.*PASSWORD\s*=\s*'[^']+'",
         needs=("password",)),
    Rule("DO19", "quality.no_select_star", "Quality", "MINOR",
         "SELECT * is not allowed. Use explicit column lists.",
         r"(?i)^(?!\s*--)\s*SELECT\s+\*\s+FROM\b",
         needs=("select",)),
    Rule("DO20", "datatype.no_float", "Data Type", "MAJOR",
         "FLOAT/DOUBLE/REAL not allowed. Use NUMBER(p,s).",
         r"(?i)(?<!--.*)\b(FLOAT|DOUBLE|REAL)\b",
         needs=("float", "double", "real")),
    Rule("DO21", "datatype.varchar_length", "Data Type", "MINOR",
         "VARCHAR must have explicit length.",
         r"(?i)(?<!--.*)\bVARCHAR\s*[^(]",
         needs=("varchar",)),
    Rule("DO22", "quality.table_comment", "Quality", "MINOR",
         "CREATE TABLE must include COMMENT.",
         r"(?i)^(?!\s*--)\s*CREATE\s+(OR\s+REPLACE\s+)?TABLE\s+(?!.*\bCOMMENT\b).*;\s*$",
         needs=("create",)),
    Rule("DO23", "quality.no_order_in_view", "Quality", "MAJOR",
         "ORDER BY in view definitions is not allowed.",
         r"(?i)^(?!\s*--)\s*CREATE\s+(OR\s+REPLACE\s+)?VIEW\b[\s\S]*?\bORDER\s+BY\b",
         needs=("create",)),
    Rule("DO24", "quality.copy_on_error", "Quality", "MAJOR",
         "COPY INTO must include ON_ERROR clause.",
         r"(?i)^(?!\s*--)\s*COPY\s+INTO\s+(?!.*\bON_ERROR\b).*;\s*$",
         needs=("copy",)),
    Rule("DO25", "quality.dt_target_lag", "Quality", "MAJOR",
         "Dynamic Tables must specify TARGET_LAG.",
         r"(?i)^(?!\s*--)\s*CREATE\s+(OR\s+REPLACE\s+)?DYNAMIC\s+TABLE\s+(?!.*\bTARGET_LAG\b)",
         needs=("create",)),
    Rule("DO26", "naming.file_format_pattern", "Naming", "MAJOR",
         "File Format names must follow {DOM}{COMP}_{MAT}_FF_ pattern.",
         r"(?i)^(?!\s*--)\s*CREATE\s+(OR\s+REPLACE\s+)?FILE\s+FORMAT\s+(?:[A-Z0-9_]+\.){0,2}(?![A-Z0-9]{3}[A-Z]_(RAW|CUR|AGG|GOL)_FF_)[A-Z_][A-Z0-9_]*",
         needs=("create",)),
    Rule("DO27", "naming.procedure_pattern", "Naming", "MAJOR",
         "Stored Procedure names must follow {DOM}{COMP}_{MAT}_SP_ pattern.",
         r"(?i)^(?!\s*--)\s*CREATE\s+(OR\s+REPLACE\s+)?PROCEDURE\s+(?:[A-Z0-9_]+\.){0,2}(?![A-Z0-9]{3}[A-Z]_(RAW|CUR|AGG|GOL)_SP_)[A-Z_][A-Z0-9_]*",
         needs=("create",)),
    Rule("DO28", "naming.task_pattern", "Naming", "MAJOR",
         "Task names must follow {DOM}{COMP}_{MAT}_TK_ pattern.",
         r"(?i)^(?!\s*--)\s*CREATE\s+(OR\s+REPLACE\s+)?TASK\s+(?:[A-Z0-9_]+\.){0,2}(?![A-Z0-9]{3}[A-Z]_(RAW|CUR|AGG|GOL)_TK_)[A-Z_][A-Z0-9_]*",
         needs=("create",)),
]

# Rules of the text profile that the core list lacks.
STYLE_RULES = [
    Rule("TX29", "style.keywords_upper", "Style", "MINOR",
         "SQL keywords must be upper case.",
         r"^\s*\b(select|from|where|join|inner|left|right|outer|full|cross|on|and|or|not|group|order|having|limit|union|intersect|except|insert|update|delete|merge|into|values|set|case|when|then|else|end|as|in|is|like|between|exists|distinct|all|any|with|create|alter|drop|grant|revoke|truncate)\b"),
    Rule("TX30", "style.else_null", "Style", "MINOR",
         "ELSE NULL in CASE is not needed.",
         r"(?i)\bELSE\s+NULL\b",
         needs=("else",)),
    Rule("TX31", "style.join_on", "Style", "MAJOR",
         "JOIN must have an ON clause.",
         r"(?i)\bJOIN\s+\S+\s*$",
         needs=("jo",)),
    Rule("TX32", "style.explicit_alias", "Style", "MINOR",
         "Aliases must use AS.",
         r"(?i)\b(SELECT|FROM|JOIN)\s+.*\)\s+[A-Z_][A-Z0-9_]*\s*[,\n]",
         needs=("select", "from", "jo")),
    Rule("TX33", "quality.define_comment", "Quality", "MAJOR",
         "DEFINE TABLE/VIEW must include COMMENT.",
         r"(?i)^DEFINE\s+(DYNAMIC\s+)?(?:TABLE|VIEW)\s+(?!.*\bCOMMENT\b).*",
         needs=("def",)),
    Rule("TX34", "safety.no_drop_column", "Safety", "CRITICAL",
         "ALTER TABLE DROP COLUMN is not allowed.",
         r"(?i)^(?!\s*--)\s*ALTER\s+TABLE\s+.*\bDROP\s+COLUMN\b",
         needs=("drop",)),
    Rule("TX35", "safety.no_truncate", "Safety", "CRITICAL",
         "Bare TRUNCATE is not allowed.",
         r"(?i)^(?!\s*--)\s*TRUNCATE\s+(TABLE\s+)?(?:IF\s+EXISTS\s+)?[A-Z0-9_{}\.]+",
         needs=("truncate",)),
    Rule("TX36", "naming.maturity_code", "Naming", "CRITICAL",
         "Positions 5 to 7 hold a maturity code.",
         r"(?i)^.{4}(RAW|CON|AGG|DAP|DAM)_.*"),
    Rule("TX37", "naming.semantic_view_pattern", "Naming", "MAJOR",
         "Semantic view names must follow {DOM}{COMP}_SV_ pattern.",
         r"(?i)^(?!\s*--)\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:SECURE\s+)?VIEW\s+(?:[A-Z0-9_{}\.\ ]+\.){0,2}(?![A-Z0-9]{3}[A-Z]_SV_)[A-Z0-9]{4}_SV_",
         needs=("create",)),
    Rule("TX38", "naming.stream_pattern", "Naming", "MAJOR",
         "Stream names must follow {DOM}{COMP}_{MAT}_SM_ pattern.",
         r"(?i)^(?!\s*--)\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?|DEFINE\s+)STREAM\s+(?:IF\s+NOT\s+EXISTS\s+)?(?:[A-Z0-9_{}\.\ ]+\.){0,2}(?![A-Z0-9]{3}[A-Z]_(RAW|CUR|AGG|GOL)_SM_)[A-Z_][A-Z0-9_]*",
         needs=("stream",)),
    Rule("TX39", "naming.table_component", "Naming", "MAJOR",
         "Table names must begin with a component code and an underscore.",
         r"(?i)^(?!\s*--)(?:\s*(?:create(?:\s+or\s+replace)?|define)|\s*alter)\s+(dynamic\s+)?table\s+(if\s+not\s+exists\s+)?(?:[A-Z0-9_{}\.\s]+\.){0,2}(?![A-Z0-9]{4}_)[A-Z_][A-Z0-9_]*",
         needs=("table",)),
    Rule("TX40", "quality.serverless_task", "Quality", "MAJOR",
         "Tasks must not name a warehouse.",
         r"""(?i)^(?!\s*--)\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?|DEFINE\s+)TASK\s+.*\bWAREHOUSE\s*=\s*(?!NULL\b)[A-Z0-9_'"]""",
         needs=("warehouse",)),
]

# Patterns of the text profile that also know DEFINE statements.
DEFINE_PATTERNS = {
    "DO01": r"(?i)^\s*(?!DEFINE\b)CREATE\s+(?!OR\s+REPLACE\b)(?!.*\bIF\s+NOT\s+EXISTS\b).*?\bSCHEMA\b",
    "DO02": r"(?is)^(?!\s*--)(?!.*\bDEFINE\b).*CREATE\s+(?!OR\s+REPLACE\b|.*IF\s+NOT\s+EXISTS\b).*TABLE\b",
    "DO03": r"(?i)^(?!\s*--)\s*(?:create|define)\s+(or\s+replace\s+)?(table|view|schema)\s+(if\s+not\s+exists\s+)?[a-z0-9_]+\.[a-z0-9_]+(\.[a-z0-9_]+)?",
    "DO05": r"(?i)^\s*DROP\s+(SCHEMA|TABLE|VIEW)\s+(?!IF\s+EXISTS\b)",
    "DO08": r"(?i)^(?!\s*--)\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?|DEFINE\s+)SCHEMA\s+(IF\s+NOT\s+EXISTS\s+)?(?:[a-z0-9_{}\.\s]+\.)?(?!RAW_|CUR_|AGG_|GOL_|REF_)[a-z0-9_]+",
    "DO09": r"(?i)^(?!\s*--)\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?|DEFINE\s+)SCHEMA\s+(IF\s+NOT\s+EXISTS\s+)?(?:[a-z0-9_{}\.\s]+\.)?[a-z0-9_]+(?<!_v\d{3})",
    "DO10": r"(?i)^(?!\s*--)\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?|DEFINE\s+)(?!DYNAMIC\s)TABLE\s+(IF\s+NOT\s+EXISTS\s+)?(?:[A-Z0-9_{}\.\s]+\.){0,2}(?![A-Z0-9]{3}[A-Z]_(RAW|CUR|AGG|GOL)_TB_)[A-Z_][A-Z0-9_]*",
    "DO11": r"(?i)^(?!\s*--)\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?|DEFINE\s+)VIEW\s+(?:[A-Z0-9_{}\.\s]+\.){0,2}(?![A-Z0-9]{3}[A-Z]_(RAW|CUR|AGG|GOL)_VW_)[A-Z_][A-Z0-9_]*",
    "DO12": r"(?i)^(?!\s*--)\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?|DEFINE\s+)DYNAMIC\s+TABLE\s+(?:[A-Z0-9_{}\.\s]+\.){0,2}(?![A-Z0-9]{3}[A-Z]_(RAW|CUR|AGG|GOL)_DT_)[A-Z_][A-Z0-9_]*",
    "DO13": r"(?i)^(?!\s*--)\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?|DEFINE\s+)STAGE\s+(?:[A-Z0-9_{}\.\s]+\.){0,2}(?![A-Z0-9]{3}[A-Z]_(RAW|CUR|AGG|GOL)_ST_)[A-Z_][A-Z0-9_]*",
    "DO17": r"(?i)^(?!\s*--)\s*(USE\s+ROLE|SET\s+ROLE|GRANT\s+.*TO\s+ROLE|GRANT\s+ROLE)\s+.*\bACCOUNTADMIN\b",
    "DO22": r"(?i)^(?!\s*--)\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?|DEFINE\s+)TABLE\s+(?!.*\bCOMMENT\b).*",
    "DO23": r"(?i)^(?!\s*--)\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?|DEFINE\s+)VIEW\b[\s\S]*?\bORDER\s+BY\b",
    "DO25": r"(?i)^(?!\s*--)\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?|DEFINE\s+)DYNAMIC\s+TABLE\s+(?!.*\bTARGET_LAG\b)",
    "DO26": r"(?i)^(?!\s*--)\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?|DEFINE\s+)FILE\s+FORMAT\s+(?:[A-Z0-9_{}\.\s]+\.){0,2}(?![A-Z0-9]{3}[A-Z]_(RAW|CUR|AGG|GOL)_FF_)[A-Z_][A-Z0-9_]*",
    "DO27": r"(?i)^(?!\s*--)\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?|DEFINE\s+)PROCEDURE\s+(?:[A-Z0-9_{}\.\s]+\.){0,2}(?![A-Z0-9]{3}[A-Z]_(RAW|CUR|AGG|GOL)_SP_)[A-Z_][A-Z0-9_]*",
    "DO28": r"(?i)^(?!\s*--)\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?|DEFINE\s+)TASK\s+(?:[A-Z0-9_{}\.\s]+\.){0,2}(?![A-Z0-9]{3}[A-Z]_(RAW|CUR|AGG|GOL)_TK_)[A-Z_][A-Z0-9_]*",
}

# Three patterns of the setup profile, sensitive to case.
COMMENT_LINE_PATTERNS = {
    "DO07": r"^(?!\s*--).*\bTIMESTAMP_(NTZ|LTZ)(\s*\(\s*\d+\s*\))?\b",
    "DO20": r"^(?!\s*--).*\b(FLOAT|DOUBLE|REAL)\b",
    "DO21": r"^(?!\s*--).*\bVARCHAR\s*[^(]",
}

# Off unless asked for: it finds the lines that keep to the naming standard.
INVERTED = {"TX36"}

# Statement rules: these look at the text between semicolons.
STATEMENT_RULES = [
    Rule("ML01", "quality.define_comment_statement", "Quality", "MAJOR",
         "DEFINE TABLE/VIEW must include COMMENT.",
         r"(?is)^\s*DEFINE\s+(DYNAMIC\s+)?(TABLE|VIEW)\s+(?!.*\bCOMMENT\b)"),
    Rule("ML02", "quality.dt_target_lag_statement", "Quality", "CRITICAL",
         "Dynamic Tables must specify TARGET_LAG.",
         r"(?is)^\s*(CREATE\s+(OR\s+REPLACE\s+)?|DEFINE\s+)DYNAMIC\s+TABLE\s+(?!.*\bTARGET_LAG\b)"),
]


def _with_patterns(rules: list[Rule], patterns: dict[str, str]) -> list[Rule]:
    return [replace(r, pattern=patterns.get(r.code, r.pattern)) for r in rules]


def _with_define(rules: list[Rule]) -> list[Rule]:
    """Rules with the patterns that also know DEFINE, so a line may lack CREATE."""
    return [
        replace(r, pattern=DEFINE_PATTERNS[r.code], needs=(*r.needs, "def"))
        if r.code in DEFINE_PATTERNS and r.needs == ("create",)
        else replace(r, pattern=DEFINE_PATTERNS.get(r.code, r.pattern))
        for r in rules
    ]


def rules_for(profile: str = "core") -> list[Rule]:
    """Rules of a profile.

    ``core``: the 28 core rules. ``text``: all 40 but the inverted one.
    ``setup``: the same with the case-sensitive comment-line patterns.
    ``dcm``: the same with the patterns that know DEFINE. ``all``: all 40.
    """
    every = CORE_RULES + STYLE_RULES
    usual = [r for r in every if r.code not in INVERTED]
    if profile == "core":
        return list(CORE_RULES)
    if profile == "text":
        return usual
    if profile == "setup":
        return _with_patterns(usual, COMMENT_LINE_PATTERNS)
    if profile == "dcm":
        return _with_define(usual)
    if profile == "all":
        return every
    raise ValueError(f"unknown profile {profile!r}")


# Severity by external code; all other codes are MINOR.
EXTERNAL_SEVERITY = {
    "LT01": "INFO", "LT02": "INFO", "LT06": "INFO", "LT08": "INFO",
    "LT09": "INFO", "LT10": "INFO", "LT12": "INFO", "LT14": "INFO",
    "CP02": "MINOR", "CP04": "MINOR", "AL01": "MINOR", "AL02": "MINOR",
    "AL08": "MINOR", "AM01": "MINOR", "AM03": "MINOR", "AM04": "MINOR",
    "AM05": "MAJOR", "AM09": "MINOR", "RF02": "MINOR", "RF03": "MINOR",
    "RF04": "MAJOR", "ST06": "MINOR", "ST07": "MINOR", "ST09": "MINOR",
}
# External codes and paths that are not reported.
SKIPPED_CODES = ["PRS", "CP01"]
SKIPPED_PATHS = ["sources/definitions/", "/out/", "/.scannerwork/"]
