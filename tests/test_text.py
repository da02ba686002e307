import shlex

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opsmill.functions import draws, text, times, xml
from opsmill.operators import scripts

PLAIN = st.text(alphabet="ab \t\n", max_size=6)
QUOTED = st.builds(lambda q, t: q + t + q, st.sampled_from("'\""), PLAIN)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.one_of(PLAIN, QUOTED), max_size=5).map("".join), min_size=30, max_size=60))
def test_shell_words_like_a_shell(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", text.shell_words(F.col("t")).alias("w")).collect():
        words = " ".join(w for w in shlex.split(row["t"]))
        # Empty quoted words leave a blank behind in a shell.
        assert row["w"].split() == words.split(), row["t"]
        if "''" not in row["t"] and '""' not in row["t"]:
            assert row["w"] == words, row["t"]


def test_small_functions(spark):
    row = spark.range(1).select(
        text.strip_space(F.lit(" \t a b \r\n")).alias("strip"),
        text.domain_prefix(F.lit("IOT_RAW_V001")).alias("prefix"),
        text.domain_prefix(F.lit("PLAIN")).alias("no_prefix"),
        text.domain_prefix(F.lit("_X")).alias("empty_prefix"),
        text.domain_prefix(F.lit(None).cast("string")).alias("null_prefix"),
        text.release_name(F.lit("S"), F.lit("7")).alias("release"),
        text.release_name(F.lit("S"), F.lit("0")).alias("release_0"),
        text.release_name(F.lit("S"), F.lit("")).alias("release_empty"),
        text.release_name(F.lit("S"), F.lit(None).cast("string")).alias("release_null"),
        text.fill_tight(F.lit("{{A}}{{ A }}{{A}}"), {"A": "x"}).alias("tight"),
        times.report_millis(F.lit(0.25)).alias("quarter"),
        times.report_millis(F.lit(0.0)).alias("zero"),
        times.report_millis(F.lit(0.0004)).alias("tiny"),
        xml.strip_outer_element(F.lit('<?xml version="1.0"?>\n<a x="1"><b>1</b></a>\n')).alias("inner"),
        xml.strip_outer_element(F.lit("<a><b>1</b></c>")).alias("open"),
        xml.root_name(F.lit("<!-- c --><n:root a='1'/>")).alias("root"),
    ).first().asDict()
    assert row == {
        "strip": "a b", "prefix": "IOT", "no_prefix": "", "empty_prefix": "", "null_prefix": None,
        "release": "S_7", "release_0": "S", "release_empty": "S", "release_null": "S",
        "tight": "x{{ A }}x", "quarter": 250, "zero": 1, "tiny": 0, "inner": "<b>1</b>", "open": "", "root": "root",
    }


def test_templates(spark):
    rows = [
        ("{{ a }}{{a}} {{ b }}", {"a": "1", "b": "2"}, {"b": "3"}, "1{{a}} 3"),
        ("{{ a }}", {"a": "{{ b }}", "b": "x"}, None, "x"),
        ("{{ b }}", {"a": "{{ b }}", "b": "{{ a }}"}, {}, "{{ a }}"),
        ("{{ c }}", None, {"c": "y"}, "y"),
        ("{{ d }}", None, None, "{{ d }}"),
    ]
    df = spark.createDataFrame(
        rows, "text string, defaults map<string,string>, overrides map<string,string>, wanted string"
    )
    for row in scripts.render_scripts(df).collect():
        assert row["text"] == row["wanted"]


def test_ddl_lines(spark):
    source = "\n".join(
        [
            "create table t(  id int, 'Abc def' x'y, \"q\"  )",
            "\t-- note Abc(",
            ") as select a, f(b) from t inner  join u on t.x=u.x cross join v",
            "it's é_x éa b1",
            "say 'a''b' c",
            "",
            "  ) AS SELECT x FROM y",
        ]
    )
    wanted = [
        "CREATE TABLE T (ID INT, 'Abc def' x'y, \"q\")",
        "    -- note Abc(",
        ") AS SELECT",
        "    A,",
        "    F (B)",
        "FROM T",
        "INNER  JOINU ON T.X=U.X",
        "CROSS JOINV",
        "it's é_x éa B1",
        "SAY 'a''b' C",
        "",
        ") AS SELECT",
        "    X",
        "FROM Y",
    ]
    df = spark.createDataFrame([("a", source)], "file string, text string")
    rows = sorted(scripts.format_ddl(df).collect(), key=lambda r: r["line"])
    assert [r["text"] for r in rows] == wanted
    blank = scripts.format_ddl(df, join_blank=True).where("text LIKE '%JOIN%'").collect()
    assert sorted(r["text"] for r in blank) == ["CROSS JOIN V", "INNER  JOIN U ON T.X=U.X"]


def test_draws_depend_on_the_row_only(spark):
    def numbers(df):
        return {
            r["id"]: (r["n"], r["x"], r["p"], r["u"])
            for r in df.select(
                "id",
                draws.uniform_int(F.col("id"), 1, "n", 0, 4).alias("n"),
                draws.uniform_real(F.col("id"), 1, "x", 20.0, 30.0).alias("x"),
                draws.pick(F.col("id"), 1, "p", ["a", "b"]).alias("p"),
                draws.uuid_text(F.col("id"), 1, "u").alias("u"),
            ).collect()
        }

    one = numbers(spark.range(3000))
    assert one == numbers(spark.range(3000).repartition(7))
    assert {v[0] for v in one.values()} == {0, 1, 2, 3, 4}
    assert all(20 <= v[1] <= 30 and round(v[1], 2) == v[1] for v in one.values())
    shares = {p: sum(v[2] == p for v in one.values()) / 3000 for p in ("a", "b", None)}
    assert all(abs(share - 1 / 3) < 0.05 for share in shares.values())
    assert len({v[3] for v in one.values()}) == 3000
