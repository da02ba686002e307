import pytest
import regex
from pyspark.sql import functions as F

from opsmill.operators import dependencies, lint
from opsmill.operators.lint_rules import CORE_RULES, STATEMENT_RULES, Rule, rules_for
from opsmill.plans import inputs

SCRIPT = """CREATE SCHEMA my_schema;
CREATE  OR REPLACE SCHEMA RAW_v001;
create table t (a float, b varchar, c varchar(3), d VARCHAR (10));
CREATE TABLE IF NOT EXISTS IOTI_RAW_TB_X (a INT);
CREATE OR REPLACE TABLE db.sch.IOTI_RAW_TB_X (a INT) COMMENT = 'x';
  a INT -- FLOAT VARCHAR x TIMESTAMP_NTZ
-- a FLOAT, TIMESTAMP_LTZ
x TIMESTAMP_NTZ(9),
GRANT SELECT ON x TO PUBLIC;\r
DROP TABLE  IF EXISTS x;
DROP TABLE IF EXISTS x;
DROP FILE FORMAT f;
\u00a0USE ROLE ACCOUNTADMIN;
CREATE USER u PASSWORD = 'secret';
select * from t;
a,cross_db_true,cross_schema_true
CREATE VIEW v AS SELECT a FROM t ORDER BY a;
CREATE DYNAMIC TABLE dt
CREATE DYNAMIC TABLE IOTI_RAW_DT_A TARGET_LAG = '1 hour'
COPY INTO t FROM @s;\r
COPY INTO t FROM @s ON_ERROR = 'CONTINUE';
CREATE STAGE IF NOT EXISTS IOTI_RAW_ST_A;
CREATE FILE FORMAT IOTI_RAW_FF_A;
CREATE PROCEDURE p();
CREATE TASK IOTI_RAW_TK_A WAREHOUSE = W;
DEFINE TASK t WAREHOUSE = NULL
 CASE WHEN a THEN b ELSE NULL END
 FROM a JOIN b
SELECT f(a) x, b
DEFINE TABLE t (a INT);
DEFINE VIEW IOTI_RAW_VW_A COMMENT = 'c'
ALTER TABLE t DROP COLUMN c;
TRUNCATE TABLE IF EXISTS {{db}}.t;
IOTIRAW_X
CREATE SECURE VIEW ABC1_SV_X AS
CREATE STREAM IF NOT EXISTS IOTI_RAW_SM_A
DEFINE TABLE {{ db }}.IOT_X (a INT)
ALTER TABLE XY12_T
éreal réal real-ly ſELECT * FROM t
the unreal float"""


def brute_force(text, rules):
    found = []
    for number, line in enumerate(text.split("\n"), 1):
        for rule in rules:
            if regex.search(rule.pattern, line):
                found.append((rule.code, number))
    return sorted(found)


@pytest.mark.parametrize("profile", ["core", "text", "setup", "dcm", "all"])
def test_profiles_match_brute_force(spark, sf_dir, profile):
    rules = rules_for(profile)
    scripts = spark.createDataFrame([("a.sql", SCRIPT)], "file string, text string")
    if profile in ("text", "dcm"):
        documents = inputs.derive(inputs.table(spark, sf_dir, "documents"), inputs.SCRIPTS)
        scripts = scripts.unionByName(documents)
    found = {}
    for row in lint.scan_scripts(scripts, rules).collect():
        found.setdefault(row["file"], []).append((row["rule"], row["line"]))
    for row in scripts.collect():
        assert sorted(found.get(row["file"], [])) == brute_force(row["text"], rules), row["file"]


def test_every_pattern_holds_its_words(spark):
    lines = [line.lower() for line in SCRIPT.split("\n")]
    for profile in ("all", "dcm", "setup"):
        for rule in rules_for(profile):
            for line, lower in zip(SCRIPT.split("\n"), lines):
                if rule.needs and regex.search(rule.pattern, line):
                    assert any(word in lower.replace("ſ", "s") for word in rule.needs), (rule.code, line)


def test_number_of_rules():
    assert len(CORE_RULES) == 28
    assert len(rules_for("all")) == 40
    assert "TX36" not in [r.code for r in rules_for("text")]


def test_findings_carry_the_rule_and_the_stripped_line(spark):
    scripts = spark.createDataFrame([("a.sql", "x\n \t DROP TABLE t; \u00a0\r")], "file string, text string")
    (row,) = lint.scan_scripts(scripts).collect()
    assert (row["rule"], row["line"], row["text"]) == ("DO05", 2, "DROP TABLE t;")
    assert (row["category"], row["severity"], row["name"]) == ("Safety", "MAJOR", "safety.drop_if_exists")


def test_long_lines_are_read_to_their_end(spark):
    text = "x" * 400_000 + " real -- " + "y" * 200_000 + " DOUBLE"
    scripts = spark.createDataFrame(
        [("a", text), ("b", "-- " + text), ("c", "'" * 50_001)], "file string, text string"
    )
    assert [(r["file"], r["rule"]) for r in lint.scan_scripts(scripts).collect()] == [("a", "DO20")]


def test_statements(spark):
    text = "DEFINE TABLE t (\n a INT\n);\nDEFINE VIEW v\n COMMENT = 'x';\nCREATE DYNAMIC TABLE d\n AS SELECT 1; CREATE DYNAMIC TABLE e\n TARGET_LAG = '1 hour'"
    scripts = spark.createDataFrame([("a", text)], "file string, text string")
    found = lint.scan_statements(scripts, STATEMENT_RULES).collect()
    assert sorted((r["rule"], r["statement"], r["line"]) for r in found) == [("ML01", 1, 1), ("ML02", 3, 6)]


def test_patterns_hold_no_control_characters():
    rules = [r for profile in ("core", "text", "setup", "dcm", "all") for r in rules_for(profile)]
    assert all(c >= " " for r in rules + STATEMENT_RULES for c in r.pattern)


@pytest.mark.parametrize("profile", ["core", "text", "setup", "dcm", "all"])
def test_every_rule_fires(spark, sf_dir, profile):
    scripts = inputs.derive(inputs.table(spark, sf_dir, "documents"), inputs.SCRIPTS)
    found = lint.scan_scripts(scripts, rules_for(profile)).select("rule").distinct().collect()
    assert {r["rule"] for r in found} == {r.code for r in rules_for(profile)}
    told = lint.scan_statements(scripts).select("rule").distinct().collect()
    assert {r["rule"] for r in told} == {r.code for r in STATEMENT_RULES}


def test_rules_from_a_table(spark):
    table = spark.createDataFrame(
        [("X1", "Own", "MINOR", "no foo", r"(?i)\bfoo\b")],
        "rule string, category string, severity string, description string, pattern string",
    )
    rules = lint.rules_from(table)
    assert rules == [Rule("X1", "X1", "Own", "MINOR", "no foo", r"(?i)\bfoo\b")]
    scripts = spark.createDataFrame([("a", "food\nFoo")], "file string, text string")
    assert [r["line"] for r in lint.scan_scripts(scripts, rules).collect()] == [2]


def test_dependencies_are_linted(spark):
    edge = ("OPS", "CRM_RAW", "t", 1, "OPS", "IOT_RAW", "v", "VIEW", 2)
    columns = (
        "referenced_database string, referenced_schema string, referenced_object_name string, "
        "referenced_object_id bigint, referencing_database string, referencing_schema string, "
        "referencing_object_name string, referencing_object_domain string, referencing_object_id bigint"
    )
    classified = dependencies.classify_dependencies(spark.createDataFrame([edge], columns))
    lines = dependencies.dependency_lines(classified)
    assert [r["rule"] for r in lint.scan_scripts(lines).collect()] == ["DO15"]


def test_external_findings(spark):
    rows = [
        ("src/a.sql", [("LT01", "d1", 3), ("PRS", "x", 1), ("ZZ", None, None), (None, "e", 4)]),
        ("x/out/b.sql", [("LT01", "d", 1)]),
        (None, [("RF04", "d", 2)]),
        ("c.sql", None),
    ]
    reports = spark.createDataFrame(
        rows, "filepath string, violations array<struct<code:string,description:string,start_line_no:int>>"
    )
    issues = [tuple(r) for r in lint.external_issues(reports).collect()]
    assert sorted(issues) == sorted(
        [
            ("sqlfluff", "LT01", "INFO", "CODE_SMELL", "d1", "src/a.sql", 3),
            ("sqlfluff", "ZZ", "MINOR", "CODE_SMELL", "", "src/a.sql", 1),
            ("sqlfluff", "", "MINOR", "CODE_SMELL", "e", "src/a.sql", 4),
            ("sqlfluff", "RF04", "MAJOR", "CODE_SMELL", "d", "", 2),
        ]
    )
    assert lint.external_findings(reports).count() == 6
    lines = {r["line"] for r in lint.external_findings(reports).where("rule = 'ZZ'").collect()}
    assert lines == {0}


def test_statements_end_where_code_ends(spark):
    from opsmill.functions.text import COMMENT_DEPTH, split_statements

    deep = "/*" * (COMMENT_DEPTH + 1) + ";" + "*/" * (COMMENT_DEPTH + 1)
    cases = {
        "a;b": ["a", "b"],
        "a 'x;y' \"p;q\" $$ r;s $$; b": ["a 'x;y' \"p;q\" $$ r;s $$", " b"],
        "'it''s; so'; b": ["'it''s; so'", " b"],
        r"'it\'s; so'; b": [r"'it\'s; so'", " b"],
        "a -- x; 'y\n; b": ["a  \n", " b"],
        "/* ; /* ; */ '\n ; */ a; b": [" \n  a", " b"],
        "a / b - c * d $1; e": ["a / b - c * d $1", " e"],
        "it's; so": ["it's", " so"],
        "a; /* b; c": ["a", "  "],
        "": [""],
        f"{deep}a;b": [" a", "b"],
        "/*" + "*" * 50_000 + "; */" + "x" * 50_000 + "'" + ";" * 50_000 + "'": None,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, text string").withColumn("s", split_statements(F.col("text")))
    found = {r["text"]: r["s"] for r in rows.collect()}
    for text, wanted in cases.items():
        if wanted is None:
            assert len(found[text]) == 1
        else:
            assert [s.rstrip(" ") if "/*" in text else s for s in found[text]] == [
                s.rstrip(" ") if "/*" in text else s for s in wanted
            ], text
