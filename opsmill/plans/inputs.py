"""Inputs derived from the test tables.

Every input is a table of SQL expressions over one base table. The
expressions are plain enough for Spark and for the checking engine, so both
start from the same rows; what the operators make of them is computed
independently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsmill.functions.rows import with_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(base: DataFrame, columns: dict[str, str]) -> DataFrame:
    return base.selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


def dealt(base: DataFrame, key: str) -> DataFrame:
    """``base`` dealt over tasks by a key, before its rows are made into much longer ones.

    The number of tasks is given, because Spark would put short rows together again.
    """
    return base.repartition(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def derived_sql(columns: dict[str, str], base: str) -> str:
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + f" FROM {base}"


def text_sql(template: str) -> str:
    """A ``concat`` for a text with ``{column}`` places."""
    parts = [p for p in re.split(r"(\{\w+\})", template) if p]
    args = []
    for part in parts:
        if re.fullmatch(r"\{\w+\}", part):
            args.append(f"CAST({part[1:-1]} AS STRING)")
        else:
            args.append("'" + part.replace("'", "''") + "'")
    return f"concat({', '.join(args)})"


# Sensor readings from events.
READINGS = {
    "sensor_id": "user_id",
    "sensor_0": "value",
    "reading_value": "CAST(value AS DECIMAL(18,6))",
    "reading_ts": "ts",
}

# Object dependencies from orders.
_SCHEMAS = (
    "CASE {k} % 9 WHEN 0 THEN 'IOT_RAW_V001' WHEN 1 THEN 'IOT_AGG_V001' WHEN 2 THEN 'CRM_RAW_V001' "
    "WHEN 3 THEN 'REF_RAW_V001' WHEN 4 THEN 'REFX' WHEN 5 THEN 'PLAIN' WHEN 6 THEN 'OTHER' "
    "WHEN 7 THEN '_V001' END"
)
DEPENDENCIES = {
    "referenced_database": "CASE o_custkey % 5 WHEN 0 THEN 'OPS_PRD' WHEN 1 THEN 'OPS_PRD' WHEN 2 THEN 'OPS_DEV' WHEN 3 THEN 'OPS_DEV' END",
    "referenced_schema": _SCHEMAS.replace("{k}", "o_custkey"),
    "referenced_object_name": "concat('OBJ_', CAST(o_custkey AS STRING))",
    "referenced_object_id": "o_custkey",
    "referencing_database": "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'OPS_DEV' ELSE 'OPS_PRD' END",
    "referencing_schema": _SCHEMAS.replace("{k}", "o_orderkey"),
    "referencing_object_name": "concat('OBJ_', CAST(o_orderkey AS STRING))",
    "referencing_object_domain": "CASE WHEN o_orderstatus = 'F' THEN 'VIEW' ELSE 'TABLE' END",
    "referencing_object_id": "o_orderkey",
}

# Payment facts per order; one message id is shared by every third order.
_STAMP = "replace(substring(CAST({ts} AS STRING), 1, 19), ' ', 'T')"
_COUNTRY = "CASE {k} % 4 WHEN 0 THEN 'CH' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' ELSE 'IT' END"
PAYMENT_FACTS = {
    "k": "o_orderkey",
    "status": "o_orderstatus",
    "loaded": "o_orderdate",
    "created": "o_orderdate + INTERVAL '1' SECOND * (o_orderkey % 86400)",
    "amount": "CAST(o_totalprice AS DECIMAL(18,2))",
    "msg": "CASE WHEN o_orderkey % 3 = 0 THEN 'NOTPROVIDED' WHEN o_orderkey % 3 = 1 THEN concat('2024-01-', CAST(o_orderkey AS STRING), '-A') ELSE concat('MSG', CAST(o_orderkey AS STRING)) END",
    "e2e": "concat('E', CAST(o_orderkey AS STRING))",
    "txn": "concat('T', CAST(o_orderkey AS STRING))",
    "clearing": "CASE WHEN o_orderkey % 3 = 1 THEN 'TARGET2' ELSE 'CHIPS' END",
    "day": "substring(CAST(o_orderdate AS STRING), 1, 10)",
    "debtor": "concat('Debtor ', CAST(o_custkey AS STRING))",
    "debtor_country": _COUNTRY.replace("{k}", "o_custkey"),
    "creditor": "concat('Creditor ', CAST(o_orderkey % 97 AS STRING))",
    "creditor_country": _COUNTRY.replace("{k}", "o_orderkey"),
    "no_street": "o_orderkey % 17 = 0",
    "no_remittance": "o_orderkey % 13 = 0",
    "bad_date": "o_orderkey % 19 = 0",
    "cut_off": "o_orderkey % 29 = 0",
    "second": "o_orderkey % 11 = 0",
    "spaced": "o_orderkey % 5 = 0",
}
PAYMENT_TEXTS = {
    "created_text": "CASE WHEN bad_date THEN 'yesterday' ELSE " + _STAMP.replace("{ts}", "created") + " END",
    "street_text": "CASE WHEN no_street THEN '' ELSE concat('<StrtNm>Street ', CAST(k AS STRING), '</StrtNm>') END",
    "remittance_text": "CASE WHEN no_remittance THEN '' ELSE concat('<RmtInf><Ustrd>Invoice ', CAST(k AS STRING), '</Ustrd></RmtInf>') END",
    "second_text": "CASE WHEN second THEN '<CdtTrfTxInf><PmtId><InstrId>later</InstrId></PmtId></CdtTrfTxInf>' ELSE '' END",
    "close_text": "CASE WHEN cut_off THEN '' ELSE '</FIToFICstmrCdtTrf>' END",
}
_TRANSFER = (
    '<?xml version="1.0" encoding="UTF-8"?><FIToFICstmrCdtTrf xmlns="urn:iso:std:iso:20022:tech:xsd:pacs.008.001.08">'
    "<GrpHdr><MsgId>{msg}</MsgId><CreDtTm>{created_text}</CreDtTm><NbOfTxs>1</NbOfTxs>"
    '<TtlIntrBkSttlmAmt Ccy="EUR">{amount}</TtlIntrBkSttlmAmt>'
    "<SttlmInf><SttlmMtd>CLRG</SttlmMtd><ClrSys><Cd>{clearing}</Cd></ClrSys></SttlmInf></GrpHdr>"
    "<CdtTrfTxInf><PmtId><InstrId>I{k}</InstrId><EndToEndId>{e2e}</EndToEndId><TxId>{txn}</TxId></PmtId>"
    "<PmtTpInf><InstrPrty>NORM</InstrPrty><SvcLvl><Cd>SEPA</Cd></SvcLvl><LclInstrm><Cd>CORE</Cd></LclInstrm></PmtTpInf>"
    '<IntrBkSttlmAmt Ccy="EUR">{amount}</IntrBkSttlmAmt><IntrBkSttlmDt>{day}</IntrBkSttlmDt><ChrgBr>SHAR</ChrgBr>'
    "<InstgAgt><FinInstnId><BICFI>AAAACHZZ</BICFI></FinInstnId></InstgAgt>"
    "<InstdAgt><FinInstnId><BICFI>BBBBDEFF</BICFI></FinInstnId></InstdAgt>"
    "<DbtrAgt><FinInstnId><BICFI>CCCCFRPP</BICFI></FinInstnId></DbtrAgt>"
    "<CdtrAgt><FinInstnId><BICFI>DDDDITMM</BICFI></FinInstnId></CdtrAgt>"
    "<Dbtr><Nm>{debtor}</Nm><PstlAdr>{street_text}<PstCd>00{k}</PstCd><TwnNm>Town &amp; Lake</TwnNm><Ctry>{debtor_country}</Ctry></PstlAdr></Dbtr>"
    "<DbtrAcct><Id><IBAN>CH{k}</IBAN></Id></DbtrAcct>"
    "<Cdtr><Nm>{creditor}</Nm><PstlAdr><StrtNm>Road</StrtNm><PstCd>1000</PstCd><TwnNm>City</TwnNm><Ctry>{creditor_country}</Ctry></PstlAdr></Cdtr>"
    "<CdtrAcct><Id><IBAN>DE{k}</IBAN></Id></CdtrAcct>{remittance_text}</CdtTrfTxInf>{second_text}{close_text}"
)
TRANSFER_MESSAGES = {
    "file_name": "CASE k % 10 WHEN 3 THEN concat('msg_', CAST(k AS STRING), '.xml') WHEN 7 THEN concat('both_pacs002_pacs008_', CAST(k AS STRING), '.xml') ELSE concat('PACS008_', CAST(k AS STRING), '.xml') END",
    "load_ts": "loaded",
    "raw_xml": f"CASE WHEN spaced THEN replace({text_sql(_TRANSFER)}, '><', concat('>', chr(10), '  <')) ELSE {text_sql(_TRANSFER)} END",
}

# Acknowledgements of the orders with status F or P: one each, two for some.
ACK_FACTS = {
    "k": "k",
    "n": "n",
    "status": "status",
    "loaded": "loaded",
    "created": "created",
    "original_msg": "msg",
    "original_name": "CASE WHEN k % 8 = 0 THEN 'pacs.009.001.08' ELSE 'pacs.008.001.08' END",
    "acked": "created + INTERVAL '1' SECOND * (k % 180 + n * 30)",
    "original_e2e": "CASE WHEN k % 4 IN (0, 3) THEN concat('X', e2e) ELSE e2e END",
    "original_txn": "CASE WHEN k % 4 IN (2, 3) THEN concat('X', txn) ELSE txn END",
    "group_code": "CASE k % 4 WHEN 0 THEN 'ACCP' WHEN 1 THEN 'RJCT' WHEN 2 THEN 'PDNG' ELSE 'PART' END",
    "code": "CASE k % 6 WHEN 0 THEN 'ACCP' WHEN 1 THEN 'RJCT' WHEN 2 THEN 'PDNG' WHEN 3 THEN 'ACSC' WHEN 4 THEN 'ACSP' ELSE 'CANC' END",
}
_ACK = (
    '<FIToFIPmtStsRpt xmlns="urn:iso:std:iso:20022:tech:xsd:pacs.002.001.10"><GrpHdr><MsgId>ACK{k}-{n}</MsgId><CreDtTm>{acked_text}</CreDtTm>'
    "<InstgAgt><FinInstnId><BICFI>BBBBDEFF</BICFI></FinInstnId></InstgAgt><InstdAgt><FinInstnId><BICFI>AAAACHZZ</BICFI></FinInstnId></InstdAgt></GrpHdr>"
    "<OrgnlGrpInfAndSts><OrgnlMsgId>{original_msg}</OrgnlMsgId><OrgnlMsgNmId>{original_name}</OrgnlMsgNmId>"
    "<OrgnlCreDtTm>{created_text}</OrgnlCreDtTm><GrpSts>{group_code}</GrpSts></OrgnlGrpInfAndSts>"
    "<TxInfAndSts><OrgnlEndToEndId>{original_e2e}</OrgnlEndToEndId><TxSts>{code}</TxSts>"
    "<StsRsnInf><Rsn>R{code}</Rsn></StsRsnInf><OrgnlInstrId>I{k}</OrgnlInstrId><OrgnlTxId>{original_txn}</OrgnlTxId>"
    "{accepted_text}</TxInfAndSts></FIToFIPmtStsRpt>"
)
ACK_TEXTS = {
    "acked_text": _STAMP.replace("{ts}", "acked"),
    "created_text": _STAMP.replace("{ts}", "created"),
    "accepted_text": "CASE WHEN k % 9 = 0 THEN '' ELSE concat('<AccptncDtTm>', " + _STAMP.replace("{ts}", "acked") + ", '</AccptncDtTm>') END",
}
ACK_MESSAGES = {
    "file_name": "concat(CASE WHEN k % 10 = 7 THEN 'status_' ELSE 'pacs002_' END, CAST(k AS STRING), '_', CAST(n AS STRING), '.xml')",
    "load_ts": "loaded",
    "raw_xml": text_sql(_ACK),
}


def _with(columns: dict[str, str]) -> list[str]:
    return ["*", *[f"{sql} AS {name}" for name, sql in columns.items()]]


def payment_facts(orders: DataFrame) -> DataFrame:
    return derive(orders, PAYMENT_FACTS)


def ack_facts(facts: DataFrame) -> DataFrame:
    """One or two acknowledgement facts per settled order."""
    copies = "explode(sequence(1, CASE WHEN k % 7 = 0 THEN 2 ELSE 1 END)) AS n"
    return derive(facts.where("status IN ('F', 'P')").selectExpr("*", copies), ACK_FACTS)


def messages(orders: DataFrame) -> DataFrame:
    """Raw messages ``(file_name, load_ts, raw_xml)``: transfers and acknowledgements."""
    narrow = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    facts = payment_facts(dealt(narrow, "o_orderkey"))
    transfers = facts.selectExpr(*_with(PAYMENT_TEXTS))
    acks = ack_facts(facts).selectExpr(*_with(ACK_TEXTS))
    both = [
        with_once(rows, "raw_xml", F.expr(columns["raw_xml"])).selectExpr(
            f"{columns['file_name']} AS file_name", f"CAST({columns['load_ts']} AS TIMESTAMP) AS load_ts", "raw_xml"
        )
        for rows, columns in ((transfers, TRANSFER_MESSAGES), (acks, ACK_MESSAGES))
    ]
    return both[0].unionByName(both[1])


# Scripts: a few statements by document number, then the document's whole text
# with some words turned into SQL.
_HEADS = [
    ["CREATE SCHEMA s_{doc_id};", "CREATE SCHEMA IF NOT EXISTS RAW_V001;", "CREATE OR REPLACE SCHEMA AGG_{doc_id};"],
    ["CREATE TABLE my_{doc_id} (id INT);", "CREATE TABLE IF NOT EXISTS IOTI_RAW_TB_{doc_id} (", "  a INT", ") COMMENT = 'a';"],
    ["CREATE TABLE db_{doc_id}.sch.t (id INT);", "create view v_{doc_id}.x as select 1;"],
    ["GRANT SELECT ON TABLE t_{doc_id} TO PUBLIC;", "GRANT ALL PRIVILEGES ON DATABASE d TO ROLE r_{doc_id};", "-- GRANT SELECT ON t TO PUBLIC"],
    ["DROP TABLE old_{doc_id};", "DROP TABLE IF EXISTS IOTI_RAW_TB_{doc_id};", "drop dynamic table d_{doc_id};"],
    ["USE ROLE ACCOUNTADMIN;", "USE DATABASE db_{doc_id};", "GRANT ROLE r TO ROLE ACCOUNTADMIN;", "-- USE SCHEMA x;"],
    ["CREATE OR REPLACE TABLE IOTI_RAW_TB_{doc_id} (", "  c TIMESTAMP_NTZ(9), d FLOAT, e VARCHAR, f VARCHAR(10) -- DOUBLE VARCHAR x", "  , g TIMESTAMP_TZ, h VARCHAR (10) -- TIMESTAMP_LTZ", ") COMMENT = 'float';"],
    ["CREATE USER u_{doc_id} PASSWORD = 'p{doc_id}';", "SELECT * FROM t_{doc_id};", "SELECT a FROM t_{doc_id} JOIN u", "select a, CASE WHEN b THEN 1 ELSE NULL END from t;"],
    ["CREATE OR REPLACE VIEW v_{doc_id} AS SELECT a FROM t ORDER BY a;", "CREATE VIEW IOTI_RAW_VW_{doc_id} AS SELECT a FROM t;"],
    ["CREATE OR REPLACE DYNAMIC TABLE IOTI_RAW_DT_{doc_id} TARGET_LAG = '60 minutes';", "CREATE DYNAMIC TABLE dt_{doc_id}", "  TARGET_LAG = '1 hour' AS SELECT 1;", "DEFINE TABLE t_{doc_id} (a INT);", "DEFINE VIEW v_{doc_id}", "  COMMENT = 'x' AS SELECT 1;"],
    ["CREATE STAGE s_{doc_id};", "CREATE STAGE IOTI_RAW_ST_{doc_id};", "CREATE FILE FORMAT f_{doc_id};", "CREATE PROCEDURE p_{doc_id}();", "CREATE TASK t_{doc_id} WAREHOUSE = W;", "ALTER TABLE t DROP COLUMN c;", "TRUNCATE TABLE t_{doc_id};"],
    ["DEFINE SCHEMA RAW_V001;", "DEFINE SCHEMA part_{doc_id};", "DEFINE VIEW IOTI_RAW_VW_{doc_id} AS SELECT a FROM t ORDER BY a;", "DEFINE STAGE s_{doc_id};", "DEFINE STAGE IOTI_RAW_ST_{doc_id};", "define file format f_{doc_id};", "DEFINE PROCEDURE IOTI_RAW_SP_{doc_id}();", "DEFINE PROCEDURE p_{doc_id}();", "DEFINE TASK IOTI_RAW_TK_{doc_id} WAREHOUSE = NULL;", "DEFINE TASK t_{doc_id};"],
    ["DEFINE DYNAMIC TABLE d_{doc_id}", "  AS SELECT 1;", "DEFINE DYNAMIC TABLE IOTI_RAW_DT_{doc_id} COMMENT = 'c' TARGET_LAG = '1 hour';", "SELECT max(a) total, b FROM t;", "CREATE OR REPLACE SECURE VIEW IOT1_SV_{doc_id} AS SELECT 1;", "CREATE VIEW IOTX_SV_{doc_id} AS SELECT 1;", "DEFINE TABLE IOTI_RAW_TB_{doc_id} (a INT) COMMENT = 'x';", "DEFINE TABLE IOTI_CUR_TB_{doc_id} (a INT);", "abcdRAW_{doc_id}", "USE ROLE ACCOUNTADMINS;"],
    ["COPY INTO IOTI_RAW_TB_{doc_id} FROM @s;", "COPY INTO t FROM @s ON_ERROR = 'CONTINUE';", "a,cross_db_true,cross_schema_true", "-- CREATE TABLE x;", "CREATE OR REPLACE STREAM st_{doc_id} ON TABLE t;"],
]


def _head_sql() -> str:
    cases = []
    for i, lines in enumerate(_HEADS):
        pieces = ", chr(10), ".join(text_sql(line) for line in lines)
        cases.append(f"WHEN {i} THEN concat({pieces}, chr(10))")
    return f"CASE doc_id % {len(_HEADS)} {' '.join(cases)} END"


_BODY = "replace(replace(replace(replace(text, ' the ', ' real '), ' and ', ' -- '), ' of ', ' VARCHAR '), ' to ', ' ELSE NULL ')"
SCRIPTS = {
    "file": "concat(lang, '/', CAST(doc_id AS STRING), '.sql')",
    "text": f"concat({_head_sql()}, {_BODY})",
}

# Scripts in which semicolons and rule words also stand in strings and comments.
_QUOTING = [
    "/* a; /* inside; DEFINE TABLE i; */ out;",
    "*/ DEFINE VIEW quoted_{doc_id} AS SELECT 'a;''b' -- COMMENT; TARGET_LAG",
    ";SELECT $$ DEFINE TABLE d; $$, \"x;y\";",
    "-- DEFINE TABLE c;",
    "  DEFINE TABLE spoken_{doc_id} (a INT) COMMENT = 'one; two';CREATE DYNAMIC TABLE late_{doc_id} /* TARGET_LAG;",
    "*/ AS SELECT 1;",
]
QUOTED_SCRIPTS = {
    "file": SCRIPTS["file"],
    "text": "concat(" + ", chr(10), ".join(text_sql(line) for line in _QUOTING) + f", chr(10), {SCRIPTS['text']})",
}

# External linter output from events, as JSON text with two violations each.
_EXTERNAL_PATH = (
    "CASE event_id % 10 WHEN 0 THEN 'sources/definitions/' WHEN 1 THEN 'build/out/' WHEN 2 THEN 'a/.scannerwork/' ELSE 'src/' END"
)
_EXTERNAL_CODE = (
    "CASE {k} % 8 WHEN 0 THEN 'LT01' WHEN 1 THEN 'CP01' WHEN 2 THEN 'PRS' WHEN 3 THEN 'AM05' WHEN 4 THEN 'RF04' WHEN 5 THEN 'AL01' WHEN 6 THEN 'ZZ99' ELSE 'LT12' END"
)
EXTERNAL_FACTS = {
    "event_id": "event_id",
    "filepath": f"concat({_EXTERNAL_PATH}, event_type, '_', CAST(user_id AS STRING), '.sql')",
    "code_1": _EXTERNAL_CODE.replace("{k}", "event_id"),
    "code_2": _EXTERNAL_CODE.replace("{k}", "user_id"),
    "line_2": "event_id % 500 + 1",
}
EXTERNAL_JSON = {
    "document": text_sql('{"filepath":"{filepath}","violations":[{"code":"{code_1}","description":"first of {event_id}"},{"code":"{code_2}","description":"second","start_line_no":{line_2}}]}'),
}

# JUnit files from orders.
_T1 = "CASE WHEN k % 43 = 0 THEN 'abc' ELSE concat('0.', CAST(k % 90 + 10 AS STRING)) END"
JUNIT_FACTS = {
    "k": "o_orderkey",
    "status": "o_orderstatus",
    "t1": _T1.replace("k %", "o_orderkey %"),
    "cases": "o_orderkey % 4 + 1",
    "single": "o_orderkey % 2 = 0",
    "outcome_1": "CASE o_orderstatus WHEN 'F' THEN '<failure message=\"bad total\">trace</failure>' WHEN 'P' THEN '<failure>only text</failure>' ELSE '' END",
}
JUNIT_TEXTS = {
    "suite_1": text_sql('<testsuite name="S{k}" time="1.5"><testcase name="first {k}" time="{t1}">{outcome_1}</testcase>'),
    "case_2": "CASE WHEN cases >= 2 THEN '<testcase name=\"second\" time=\"0\"><skipped message=\"later\"/></testcase>' ELSE '' END",
    "case_3": "CASE WHEN cases >= 3 THEN '<testcase time=\"2\"><failure/><skipped/></testcase>' ELSE '' END",
    "case_4": "CASE WHEN cases >= 4 THEN '<testcase name=\"fourth\"><error message=\"ignored\"/></testcase>' ELSE '' END",
    "suite_2": "CASE WHEN single THEN '' ELSE '<testsuite time=\"9\"><testcase name=\"in second\" time=\"0.5\"/></testsuite>' END",
}
_SUITES = "concat(suite_1, case_2, case_3, case_4, '</testsuite>', suite_2)"
JUNIT_FILES = {
    "path": "concat('reports/TEST_', CAST(k AS STRING), '.xml')",
    "xml": f"CASE WHEN k % 31 = 0 THEN concat('<testsuites>', {_SUITES}) WHEN k % 37 = 0 THEN '<testsuites/>' "
    f"WHEN k % 41 = 0 THEN concat('<report>', {_SUITES}, '</report>') WHEN single THEN {_SUITES} "
    f"ELSE concat('<?xml version=\"1.0\"?>', chr(10), '<testsuites>', {_SUITES}, '</testsuites>') END",
}

# Test results from events: a test per user, a run per event.
RESULTS = {
    "test": "concat('test_', CAST(user_id AS STRING))",
    "run_ts": "ts",
    "run_id": "event_id",
    "status": "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'passed' END",
    "duration": "CAST(floor(value * 10) AS BIGINT)",
}

# Deployment plans from orders, as JSON text.
_OPERATION = "CASE {k} % 4 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'ALTER' WHEN 2 THEN 'DROP' ELSE 'NO_OPERATION' END"
PLAN_FACTS = {
    "plan_id": "o_orderkey",
    "op_1": _OPERATION.replace("{k}", "o_orderkey"),
    "op_2": _OPERATION.replace("{k}", "o_custkey"),
    "op_3": "CASE o_orderstatus WHEN 'F' THEN 'DROP' ELSE 'CREATE' END",
    "status_text": "CASE WHEN o_orderkey % 6 = 0 THEN '' WHEN o_orderkey % 6 = 1 THEN '\"status\":\"PLAN_FAILED\",' ELSE '\"status\":\"OK\",' END",
    "bare": "o_orderkey % 10 = 9",
}
PLAN_DOCUMENTS = {
    "plan_id": "plan_id",
    "document": "CASE WHEN bare THEN '{}' ELSE "
    + text_sql('{{status_text}"operations":[{"operation":"{op_1}","object_name":"A{plan_id}"},{"operation":"{op_2}","object_name":"B{plan_id}"},{"operation":"{op_3}"}]}')
    + " END",
}

# Assertion lines from customer.
ASSERTION_LINE = (
    "CASE c_custkey % 3 WHEN 0 THEN concat(c_name, ' | SELECT a || b | ', c_mktsegment) "
    "WHEN 1 THEN concat('# ', c_name) ELSE concat(c_name, '|SELECT 1 AS result;|1') END"
)

# Templates and DDL from part.
TEMPLATES = {
    "p_partkey": "p_partkey",
    "text": "concat('USE {{ db }}; -- {{db}} ', p_name, ' {{ brand }}/{{ size }} {{ db }}')",
}
TEMPLATE_SETTINGS = {
    "db": "'dev'",
    "brand": "concat(p_brand, ' {{ size }}')",
    "size": "CAST(p_size AS STRING)",
}
DDL = {
    "file": "concat(p_brand, '/', CAST(p_partkey AS STRING), '.sql')",
    "text": "concat("
    + text_sql("create or replace view part_{p_partkey}(   ")
    + ", chr(9), 'p_name, p_size   )', chr(10), chr(9), '-- kept as is: ', p_name, chr(10), "
    + text_sql(") as select p_name, max(p_size), 'lower {p_name}' from part p left join supplier s on p.k=s.k")
    + ")",
}
