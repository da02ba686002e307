"""The same jobs as plain SQL over the test tables, to check the results."""

from __future__ import annotations

from opsmill.operators.lint_rules import CORE_RULES, EXTERNAL_SEVERITY, STYLE_RULES
from opsmill.plans import inputs
from opsmill.plans.inputs import derived_sql, text_sql
from opsmill.sources.generators import CURRENCIES, METHODS, READING_RANGES, STATUSES
from opsmill.sources.geo import SENSOR_PLACES

# Sensor readings

_PLACES = "VALUES " + ", ".join(
    f"({number}, '{city}', {latitude}, {longitude})" for number, city, latitude, longitude in SENSOR_PLACES
)
_READINGS = f"readings AS ({derived_sql(inputs.READINGS, 'events')})"

IOT_GEO_JOIN = f"""
WITH {_READINGS}, places(sensor_id, city, latitude, longitude) AS ({_PLACES})
SELECT CAST(r.sensor_id AS BIGINT) AS sensor_id, sensor_0, city,
       CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude
FROM readings r JOIN places p ON r.sensor_id = p.sensor_id
"""
IOT_HOURLY = f"""
WITH {_READINGS}
SELECT sensor_id, date_trunc('hour', reading_ts) AS hour_ts,
       round(CAST(sum(reading_value) AS DOUBLE) / count(*), 6) AS avg_value, count(*) AS cnt
FROM readings GROUP BY ALL
"""
IOT_RECENT = f"""
WITH {_READINGS}
SELECT sensor_id, CAST(reading_value AS DOUBLE) AS reading_value, reading_ts
FROM readings WHERE reading_ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 DAY
"""

# Generated rows


def _draw(tag: str) -> str:
    return f"(CAST(concat('0x', substr(md5(concat('7:{tag}:', CAST(event_id AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def _whole(tag: str, low: int, high: int) -> str:
    return f"CAST(floor({_draw(tag)} * {high - low + 1}) + {low} AS BIGINT)"


def _choice(tag: str, options: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options))
    return f"CASE {_whole(tag, 0, len(options))} {cases} END"


def _uuid(tag: str) -> str:
    digest = f"md5(concat('7:{tag}:', CAST(event_id AS VARCHAR)))"
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return "concat_ws('-', " + ", ".join(f"substr({digest}, {a}, {n})" for a, n in cuts) + ")"


GEN_READINGS = (
    f"SELECT {_whole('sensor_id', 1, 101)} AS sensor_id, "
    + ", ".join(
        f"round({_draw(f'sensor_{i}')} * {high - low}::DOUBLE + {low}::DOUBLE, 2) AS sensor_{i}"
        for i, (low, high) in enumerate(READING_RANGES)
    )
    + " FROM events"
)
GEN_PAYMENTS = f"""
SELECT {_uuid('payment_id')} AS payment_id, {_uuid('user_id')} AS user_id,
       CAST({_whole('amount', 10, 1000)} AS DOUBLE) AS amount,
       {_choice('currency', CURRENCIES)} AS currency, {_choice('status', STATUSES)} AS status,
       {_choice('payment_method', METHODS)} AS payment_method,
       TIMESTAMP '2024-02-01 00:00:00' + INTERVAL '1' SECOND * {_whole('age', -86400, 0)} AS "timestamp"
FROM events
"""

# Dependencies

_PREFIX = "CASE WHEN strpos({c}, '_') > 0 THEN substr({c}, 1, strpos({c}, '_') - 1) ELSE '' END"
_CROSS_DB = "referenced_database <> referencing_database"
_CROSS_SCHEMA = "referenced_schema <> referencing_schema"
_REF = "referenced_schema LIKE 'REF_%'"


def _flag(name: str, condition: str) -> str:
    return f"CASE WHEN {condition} THEN '{name}_true' ELSE '{name}_false' END AS {name}"


_EDGES = f"edges AS ({derived_sql(inputs.DEPENDENCIES, 'orders')})"
_CLASSIFIED = f"""
SELECT referenced_database AS base_database, referenced_schema AS base_schema,
       referenced_object_name AS base_object, referenced_object_id AS base_object_id,
       referencing_database AS referenced_database, referencing_schema AS referenced_schema,
       referencing_object_name AS referenced_object, referencing_object_domain AS referenced_object_type,
       referencing_object_id AS referenced_object_id,
       {_flag('cross_db', _CROSS_DB)},
       {_flag('cross_schema', _CROSS_SCHEMA + ' AND ' + _PREFIX.format(c='referenced_schema') + ' <> ' + _PREFIX.format(c='referencing_schema'))},
       {_flag('cross_db_ref', _CROSS_DB + ' AND ' + _REF)},
       {_flag('cross_schema_ref', _CROSS_SCHEMA + ' AND ' + _REF)}
FROM edges
"""
DEPS_CSV = f"WITH {_EDGES} {_CLASSIFIED}"
DEPS_CLASSIFY = f"WITH {_EDGES} {_CLASSIFIED} WHERE edges.referenced_database = 'OPS_PRD'"
DEPS_SUMMARY = f"""
WITH {_EDGES}, classified AS ({_CLASSIFIED})
SELECT base_database, base_schema, count(*) AS edges,
       count(*) FILTER (cross_db = 'cross_db_true') AS cross_db,
       count(*) FILTER (cross_schema = 'cross_schema_true') AS cross_schema,
       count(*) FILTER (cross_db_ref = 'cross_db_ref_true') AS cross_db_ref,
       count(*) FILTER (cross_schema_ref = 'cross_schema_ref_true') AS cross_schema_ref
FROM classified GROUP BY base_database, base_schema
"""
DEPS_LINT = f"""
WITH {_EDGES}, classified AS ({_CLASSIFIED}),
found AS (
  SELECT concat_ws('/', base_database, base_schema) AS file, 'DO14' AS rule FROM classified WHERE cross_db = 'cross_db_true'
  UNION ALL
  SELECT concat_ws('/', base_database, base_schema), 'DO15' FROM classified WHERE cross_schema = 'cross_schema_true')
SELECT file, rule, count(*) AS findings FROM found GROUP BY file, rule
"""

# Payments

_FACTS = f"facts AS ({derived_sql(inputs.PAYMENT_FACTS, 'orders')})"
_TEXTS = "texts AS (SELECT *, " + ", ".join(f"{q} AS {n}" for n, q in inputs.PAYMENT_TEXTS.items()) + " FROM facts)"
_TRANSFERS = (
    "transfers AS (SELECT *, " + ", ".join(f"{q} AS {n}" for n, q in inputs.TRANSFER_MESSAGES.items()) + " FROM texts)"
)
_ACK_FACTS = (
    "copies AS (SELECT *, unnest(range(1, CASE WHEN k % 7 = 0 THEN 3 ELSE 2 END)) AS n FROM facts WHERE status IN ('F', 'P')), "
    f"ack_facts AS ({derived_sql(inputs.ACK_FACTS, 'copies')})"
)
_ACKS = (
    "ack_texts AS (SELECT *, " + ", ".join(f"{q} AS {n}" for n, q in inputs.ACK_TEXTS.items()) + " FROM ack_facts), "
    "acks AS (SELECT *, " + ", ".join(f"{q} AS {n}" for n, q in inputs.ACK_MESSAGES.items()) + " FROM ack_texts)"
)
_MESSAGES = f"{_FACTS}, {_TEXTS}, {_TRANSFERS}, {_ACK_FACTS}, {_ACKS}"

PAY_ROUTE = f"""
WITH {_MESSAGES}, raw AS (SELECT file_name, raw_xml FROM transfers UNION ALL SELECT file_name, raw_xml FROM acks)
SELECT 'transfer' AS kind, file_name FROM raw WHERE file_name ILIKE '%pacs008%' OR raw_xml ILIKE '%FIToFICstmrCdtTrf%'
UNION ALL
SELECT 'status', file_name FROM raw WHERE file_name ILIKE '%pacs002%' OR raw_xml ILIKE '%FIToFIPmtStsRpt%'
"""


def _sound(expression: str) -> str:
    return f"CASE WHEN NOT cut_off THEN {expression} END"


# A missing street moves the parts of the address behind it up by one place.
_DEBTOR_COUNTRY = _sound("CASE WHEN NOT no_street THEN debtor_country END")
_CREDITOR_COUNTRY = _sound("creditor_country")
_PARSED_TRANSFERS = f"""
SELECT k, file_name AS source_filename, load_ts AS source_load_timestamp,
  {_sound('msg')} AS message_id,
  {_sound('CASE WHEN NOT bad_date THEN created END')} AS creation_datetime,
  {_sound('CAST(1 AS BIGINT)')} AS number_of_transactions,
  {_sound("'EUR'")} AS group_settlement_currency,
  {_sound('CAST(amount AS DOUBLE)')} AS group_settlement_amount,
  {_sound("'CLRG'")} AS settlement_method, {_sound('clearing')} AS clearing_system_code,
  {_sound("concat('I', CAST(k AS VARCHAR))")} AS instruction_id,
  {_sound('e2e')} AS end_to_end_id, {_sound('txn')} AS transaction_id,
  {_sound("'NORM'")} AS instruction_priority, {_sound("'SEPA'")} AS service_level_code,
  {_sound("'CORE'")} AS local_instrument_code, {_sound("'EUR'")} AS transaction_currency,
  {_sound('CAST(amount AS DOUBLE)')} AS transaction_amount,
  {_sound('CAST(loaded AS DATE)')} AS interbank_settlement_date, {_sound("'SHAR'")} AS charges_bearer,
  {_sound("'AAAACHZZ'")} AS instructing_agent_bic, {_sound("'BBBBDEFF'")} AS instructed_agent_bic,
  {_sound("'CCCCFRPP'")} AS debtor_agent_bic, {_sound("'DDDDITMM'")} AS creditor_agent_bic,
  {_sound('debtor')} AS debtor_name,
  {_sound("CASE WHEN no_street THEN concat('00', CAST(k AS VARCHAR)) ELSE concat('Street ', CAST(k AS VARCHAR)) END")} AS debtor_street,
  {_sound("CASE WHEN no_street THEN 'Town & Lake' ELSE concat('00', CAST(k AS VARCHAR)) END")} AS debtor_postal_code,
  {_sound("CASE WHEN no_street THEN debtor_country ELSE 'Town & Lake' END")} AS debtor_city,
  {_DEBTOR_COUNTRY} AS debtor_country,
  {_sound("concat('CH', CAST(k AS VARCHAR))")} AS debtor_iban,
  {_sound('creditor')} AS creditor_name, {_sound("'Road'")} AS creditor_street,
  {_sound("'1000'")} AS creditor_postal_code, {_sound("'City'")} AS creditor_city,
  {_CREDITOR_COUNTRY} AS creditor_country, {_sound("concat('DE', CAST(k AS VARCHAR))")} AS creditor_iban,
  {_sound("CASE WHEN NOT no_remittance THEN concat('Invoice ', CAST(k AS VARCHAR)) END")} AS remittance_information,
  NOT cut_off AND amount >= 100000 AS is_high_value_payment,
  NOT cut_off AND clearing = 'TARGET2' AS is_target2_payment,
  concat(coalesce({_DEBTOR_COUNTRY}, 'UNKNOWN'), ' -> ', coalesce({_CREDITOR_COUNTRY}, 'UNKNOWN')) AS payment_corridor,
  CASE WHEN {_DEBTOR_COUNTRY} = {_CREDITOR_COUNTRY} THEN 'DOMESTIC' ELSE 'CROSS_BORDER' END AS payment_type_classification,
  CAST(length(raw_xml) AS INTEGER) AS xml_size_bytes
FROM transfers
"""
PAY_PARSE_008 = f"WITH {_MESSAGES}, p AS ({_PARSED_TRANSFERS}) SELECT * EXCLUDE (k) FROM p"

# Transfers whose file name also says pacs002 are read as status reports, too:
# the settlement date is where a report has its group status.
_PARSED_ACKS = f"""
SELECT file_name AS source_filename, load_ts AS source_load_timestamp,
  concat('ACK', CAST(k AS VARCHAR), '-', CAST(n AS VARCHAR)) AS message_id, acked AS creation_datetime,
  'BBBBDEFF' AS instructing_agent_bic, 'AAAACHZZ' AS instructed_agent_bic,
  original_msg AS original_message_id, original_name AS original_message_name_id,
  created AS original_creation_datetime, group_code AS group_status,
  original_e2e AS original_end_to_end_id, code AS transaction_status, concat('R', code) AS status_reason,
  concat('I', CAST(k AS VARCHAR)) AS original_instruction_id, original_txn AS original_transaction_id,
  CASE WHEN k % 9 <> 0 THEN acked END AS acceptance_datetime,
  CASE code WHEN 'ACCP' THEN 'ACCEPTED' WHEN 'RJCT' THEN 'REJECTED' WHEN 'PDNG' THEN 'PENDING'
    WHEN 'ACSC' THEN 'ACCEPTED_SETTLEMENT_COMPLETED' WHEN 'ACSP' THEN 'ACCEPTED_SETTLEMENT_IN_PROCESS'
    ELSE code END AS transaction_status_description,
  CASE group_code WHEN 'ACCP' THEN 'ACCEPTED' WHEN 'RJCT' THEN 'REJECTED' WHEN 'PDNG' THEN 'PENDING'
    ELSE group_code END AS group_status_description,
  code IN ('ACCP', 'ACSC', 'ACSP') AS is_positive_response, code = 'RJCT' AS is_rejection,
  original_name = 'pacs.008.001.08' AS is_pacs008_response,
  CASE WHEN original_msg LIKE '20%-%-%' THEN substr(original_msg, 1, 8) END AS original_message_date,
  CAST(length(raw_xml) AS INTEGER) AS xml_size_bytes
FROM acks
UNION ALL
SELECT file_name, load_ts, {_sound('msg')}, {_sound('CASE WHEN NOT bad_date THEN created END')},
  NULL, NULL, NULL, NULL, NULL, {_sound('day')}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {_sound('day')},
  FALSE, FALSE, FALSE, NULL, CAST(length(raw_xml) AS INTEGER)
FROM transfers WHERE k % 10 = 7
"""
PAY_PARSE_002 = f"WITH {_MESSAGES} {_PARSED_ACKS}"

_JOINED = f"""
SELECT p.message_id AS pacs008_message_id, a.original_message_id AS pacs002_original_message_id,
  p.end_to_end_id AS pacs008_end_to_end_id, a.original_end_to_end_id AS pacs002_original_end_to_end_id,
  a.transaction_status, a.transaction_status_description, a.group_status, a.group_status_description,
  a.status_reason, a.is_rejection, a.is_positive_response,
  p.transaction_currency, p.transaction_amount, p.debtor_name, p.creditor_name, p.payment_corridor,
  p.payment_type_classification, p.is_high_value_payment, p.is_target2_payment,
  p.source_filename AS pacs008_file, a.source_filename AS pacs002_file,
  p.source_load_timestamp AS pacs008_load_timestamp, a.source_load_timestamp AS pacs002_load_timestamp,
  date_diff('minute', a.original_creation_datetime, a.creation_datetime) AS ack_time
FROM p LEFT JOIN a ON a.original_message_id = p.message_id
  AND (a.original_end_to_end_id = p.end_to_end_id OR a.original_transaction_id = p.transaction_id)
"""
_JOIN_INPUTS = f"{_MESSAGES}, p AS ({_PARSED_TRANSFERS}), a AS ({_PARSED_ACKS})"
PAY_STATUS_JOIN = f"WITH {_JOIN_INPUTS} {_JOINED}"
PAY_ACK_TIME = f"""
WITH {_JOIN_INPUTS}, j AS ({_JOINED})
SELECT transaction_status_description, is_target2_payment, count(*) AS payments,
       CAST(sum(ack_time) AS BIGINT) AS minutes, max(ack_time) AS longest
FROM j GROUP BY transaction_status_description, is_target2_payment
"""

# Scripts. The checking engine has no look-around, so each rule is spelled out
# as what must and what must not be found.

_SPACE = r"[\s\x0b\x{85}\p{Z}]"
_EDGE_L, _EDGE_R = r"(^|[^\p{L}\p{M}\p{N}\p{Pc}])", r"($|[^\p{L}\p{M}\p{N}\p{Pc}])"


def _has(pattern: str, text: str = "text") -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_matches({text}, '{quoted}')"


def _lacks(pattern: str, text: str = "text") -> str:
    return f"NOT {_has(pattern, text)}"


_NO_COMMENT = _lacks(r"^\s*--")
_CODE = "split_part(text, '--', 1)"
_CODE_DASHES = "(split_part(text, '--', 1) || CASE WHEN contains(text, '--') THEN '--' ELSE '' END)"


def _badly_named(head: str, good: str) -> str:
    name = f"regexp_extract(text, '(?i)^\\s*CREATE\\s+(?:OR\\s+REPLACE\\s+)?{head}\\s+([A-Z_][A-Z0-9_]*)', 1)"
    return f"({name} <> '' AND {_lacks('(?i)^[A-Z0-9]{3}[A-Z]_(RAW|CUR|AGG|GOL)_' + good + '_', name)})"


_SCHEMA_NAME = "regexp_extract(text, '(?i)^\\s*CREATE\\s+(?:OR\\s+REPLACE\\s+)?SCHEMA\\s+(?:IF\\s+NOT\\s+EXISTS\\s+)?([a-z0-9_]+);', 1)"
_DROPPED = r"(?i)^\s*DROP\s+(SCHEMA|TABLE|VIEW|DYNAMIC\s+TABLE|STAGE|FILE\s+FORMAT|PROCEDURE|FUNCTION|TASK)\s+"
_CREATE = r"(?i)^\s*CREATE\s+(OR\s+REPLACE\s+)?"

CORE_CONDITIONS = {
    "DO01": [_has(r"(?i)^\s*CREATE\s+.*\bSCHEMA\b"), _lacks(r"(?i)^\s*CREATE\s+.*\bIF\s+NOT\s+EXISTS\b"), _lacks(r"(?i)^\s*CREATE\sOR\s+REPLACE\b")],
    "DO02": [_NO_COMMENT, _has(r"(?is)CREATE\s+.*TABLE\b"), _lacks(r"(?is)CREATE\s+.*IF\s+NOT\s+EXISTS\b"), _lacks(r"(?i)CREATE\sOR\s+REPLACE\b")],
    "DO03": [_has(r"(?i)^\s*create\s+(or\s+replace\s+)?(table|view|schema)\s+(if\s+not\s+exists\s+)?[a-z0-9_]+\.[a-z0-9_]+")],
    "DO04": [_NO_COMMENT, _has(r"(?i)grant\s+.*\s+to\s+public\b")],
    "DO05": [_has(_DROPPED), _lacks(_DROPPED + r"IF\s+EXISTS\b")],
    "DO06": [_has(r"(?i)^\s*USE\s+(DATABASE|SCHEMA|ROLE)\b")],
    "DO07": [_has(r"(?i)" + _EDGE_L + r"TIMESTAMP_(NTZ|LTZ)" + _EDGE_R, _CODE)],
    "DO08": [f"{_SCHEMA_NAME} <> ''", _lacks("(?i)^(RAW_|CUR_|AGG_|GOL_|REF_)", _SCHEMA_NAME)],
    "DO09": [f"{_SCHEMA_NAME} <> ''", _lacks(r"(?i)_v\d\d\d$", _SCHEMA_NAME)],
    "DO10": [_badly_named("TABLE", "TB")],
    "DO11": [_badly_named("VIEW", "VW")],
    "DO12": [_badly_named(r"DYNAMIC\s+TABLE", "DT")],
    "DO13": [_badly_named("STAGE", "ST")],
    "DO14": ["contains(text, 'cross_db_true')"],
    "DO15": ["contains(text, 'cross_schema_true')"],
    "DO16": [_has(r"(?i)^\s*GRANT\s+ALL\s+(PRIVILEGES\s+)?ON\b")],
    "DO17": [_has(r"(?i)^\s*(USE\s+ROLE|SET\s+ROLE|GRANT\s+.*TO\s+ROLE|GRANT\s+ROLE)\s+.*\bACCOUNTADMIN\b")],
    "DO18": [_NO_COMMENT, _has(r"(?i)PASSWORD\s*=\s*'[^']+'")],
    "DO19": [_has(r"(?i)^\s*SELECT\s+\*\s+FROM\b")],
    "DO20": [_has(r"(?i)" + _EDGE_L + r"(FLOAT|DOUBLE|REAL)" + _EDGE_R, _CODE)],
    "DO21": [_has(r"(?i)" + _EDGE_L + r"VARCHAR" + _SPACE + r"*[^(]", _CODE_DASHES)],
    "DO22": [_has(_CREATE + r"TABLE\s+.*;\s*$"), _lacks(_CREATE + r"TABLE\s+.*\bCOMMENT\b")],
    "DO23": [_has(_CREATE + r"VIEW\b.*\bORDER\s+BY\b")],
    "DO24": [_has(r"(?i)^\s*COPY\s+INTO\s+.*;\s*$"), _lacks(r"(?i)^\s*COPY\s+INTO\s+.*\bON_ERROR\b")],
    "DO25": [_has(_CREATE + r"DYNAMIC\s+TABLE\s"), _lacks(_CREATE + r"DYNAMIC\s+TABLE\s+.*\bTARGET_LAG\b")],
    "DO26": [_badly_named(r"FILE\s+FORMAT", "FF")],
    "DO27": [_badly_named("PROCEDURE", "SP")],
    "DO28": [_badly_named("TASK", "TK")],
}
_LOWER = (
    "select|from|where|join|inner|left|right|outer|full|cross|on|and|or|not|group|order|having|limit|union|intersect|"
    "except|insert|update|delete|merge|into|values|set|case|when|then|else|end|as|in|is|like|between|exists|distinct|"
    "all|any|with|create|alter|drop|grant|revoke|truncate"
)
_COMPONENT = "regexp_extract(text, '(?i)^\\s*(?:create(?:\\s+or\\s+replace)?|define|alter)\\s+(?:dynamic\\s+)?table\\s+([A-Z_][A-Z0-9_]*)', 1)"
_SEMANTIC = "regexp_extract(text, '(?i)^\\s*CREATE\\s+(?:OR\\s+REPLACE\\s+)?(?:SECURE\\s+)?VIEW\\s+([A-Z0-9]{4}_SV_)', 1)"
STYLE_CONDITIONS = {
    "TX29": [_has(r"^\s*(" + _LOWER + ")" + _EDGE_R)],
    "TX30": [_has(r"(?i)" + _EDGE_L + "ELSE" + _SPACE + "+NULL" + _EDGE_R)],
    "TX31": [_has(r"(?i)" + _EDGE_L + "JOIN" + _SPACE + r"+\S+\s*$")],
    "TX32": [_has(r"(?i)" + _EDGE_L + r"(SELECT|FROM|JOIN)\s+.*\)\s+[A-Z_][A-Z0-9_]*\s*,")],
    "TX33": [_has(r"(?i)^DEFINE\s+(DYNAMIC\s+)?(TABLE|VIEW)\s"), _lacks(r"(?i)^DEFINE\s+(DYNAMIC\s+)?(TABLE|VIEW)\s+.*\bCOMMENT\b")],
    "TX34": [_has(r"(?i)^\s*ALTER\s+TABLE\s+.*\bDROP\s+COLUMN\b")],
    "TX35": [_has(r"(?i)^\s*TRUNCATE\s+(TABLE\s+)?(IF\s+EXISTS\s+)?[A-Z0-9_{}.]+")],
    "TX37": [f"{_SEMANTIC} <> ''", _lacks("(?i)^[A-Z0-9]{3}[A-Z]_SV_", _SEMANTIC)],
    "TX38": ["(regexp_extract(text, '(?i)^\\s*(?:CREATE\\s+(?:OR\\s+REPLACE\\s+)?|DEFINE\\s+)STREAM\\s+([A-Z_][A-Z0-9_]*)', 1) <> '')",
             _lacks("(?i)STREAM\\s+[A-Z0-9]{3}[A-Z]_(RAW|CUR|AGG|GOL)_SM_")],
    "TX39": [f"{_COMPONENT} <> ''", _lacks("(?i)^[A-Z0-9]{4}_", _COMPONENT)],
    "TX40": [_has(r"""(?i)^\s*(CREATE\s+(OR\s+REPLACE\s+)?|DEFINE\s+)TASK\s+.*\bWAREHOUSE\s*=\s*[A-Z0-9_'"]"""),
             _lacks(r"(?i)WAREHOUSE\s*=\s*NULL\b")],
}
SETUP_CONDITIONS = {
    "DO07": [_NO_COMMENT, _has(_EDGE_L + "TIMESTAMP_(NTZ|LTZ)" + _EDGE_R)],
    "DO20": [_NO_COMMENT, _has(_EDGE_L + "(FLOAT|DOUBLE|REAL)" + _EDGE_R)],
    "DO21": [_NO_COMMENT, _has(_EDGE_L + "VARCHAR" + _SPACE + "*[^(]")],
}
INVERTED_CONDITIONS = {"TX36": [_has("(?i)^.{4}(RAW|CON|AGG|DAP|DAM)_")]}
_DEFINED = r"(?i)^\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?|DEFINE\s+)"


def _define_named(head: str, good: str) -> list[str]:
    """No part of the head is needed, so that only a well-formed first name saves the line."""
    start = _DEFINED + head + r"\s+"
    return [_has(start + "[A-Z_]"), _lacks(start + "[A-Z0-9]{3}[A-Z]_(RAW|CUR|AGG|GOL)_" + good + "_")]


DEFINE_CONDITIONS = {
    "DO02": [*CORE_CONDITIONS["DO02"], _lacks(r"(?is)\bDEFINE\b")],
    "DO03": [_has(r"(?i)^\s*(create|define)\s+(or\s+replace\s+)?(table|view|schema)\s+(if\s+not\s+exists\s+)?[a-z0-9_]+\.[a-z0-9_]+")],
    "DO05": [_has(r"(?i)^\s*DROP\s+(SCHEMA|TABLE|VIEW)\s+"), _lacks(r"(?i)^\s*DROP\s+(SCHEMA|TABLE|VIEW)\s+IF\s+EXISTS\b")],
    "DO08": [_has(_DEFINED + r"SCHEMA\s+[a-z0-9_]"), _lacks(_DEFINED + r"SCHEMA\s+(RAW_|CUR_|AGG_|GOL_|REF_)")],
    "DO09": [_has(_DEFINED + r"SCHEMA\s+[a-z0-9_]")],
    "DO10": _define_named("TABLE", "TB"),
    "DO11": _define_named("VIEW", "VW"),
    "DO12": _define_named(r"DYNAMIC\s+TABLE", "DT"),
    "DO13": _define_named("STAGE", "ST"),
    "DO22": [_has(_DEFINED + r"TABLE\s"), _lacks(_DEFINED + r"TABLE\s+.*\bCOMMENT\b")],
    "DO23": [_has(_DEFINED + r"VIEW\b.*\bORDER\s+BY\b")],
    "DO25": [_has(_DEFINED + r"DYNAMIC\s+TABLE\s"), _lacks(_DEFINED + r"DYNAMIC\s+TABLE\s+.*\bTARGET_LAG\b")],
    "DO26": _define_named(r"FILE\s+FORMAT", "FF"),
    "DO27": _define_named("PROCEDURE", "SP"),
    "DO28": _define_named("TASK", "TK"),
}
_TEXT_CONDITIONS = CORE_CONDITIONS | STYLE_CONDITIONS
_SCRIPT_LINES = f"""
scripts AS ({derived_sql(inputs.SCRIPTS, 'documents')}),
split AS (SELECT file, string_split(text, chr(10)) AS parts FROM scripts),
lines AS (SELECT file, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text FROM split)"""


def _findings(conditions: dict[str, list[str]]) -> str:
    cases = ", ".join(f"CASE WHEN {' AND '.join(c)} THEN '{code}' END" for code, c in conditions.items())
    return (
        f"hits AS (SELECT file, line, text, unnest([{cases}]) AS rule FROM lines), "
        "found AS (SELECT * FROM hits WHERE rule IS NOT NULL)"
    )


def _rule_values(rules: list) -> str:
    rows = ", ".join(
        "('{}', '{}', '{}', '{}', '{}')".format(
            *(v.replace("'", "''") for v in (r.code, r.name, r.category, r.severity, r.description))
        )
        for r in rules
    )
    return f"rules(rule, name, category, severity, description) AS (VALUES {rows})"


_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
_CORE_FOUND = f"{_SCRIPT_LINES}, {_findings(CORE_CONDITIONS)}, {_rule_values(CORE_RULES)}"
_STRIPPED = f"regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
LINT_SCAN = f"""
WITH {_CORE_FOUND}
SELECT file, rule, name, category, severity, description, line, {_STRIPPED} AS text
FROM found JOIN rules USING (rule)
"""


def _profile(conditions: dict[str, list[str]]) -> str:
    return f"""
WITH {_SCRIPT_LINES}, {_findings(conditions)}, {_rule_values(CORE_RULES + STYLE_RULES)}
SELECT file, rule, severity, line FROM found JOIN rules USING (rule)
"""


LINT_TEXT_PROFILE = _profile(_TEXT_CONDITIONS)
LINT_SETUP_PROFILE = _profile(_TEXT_CONDITIONS | SETUP_CONDITIONS)
LINT_DCM_PROFILE = _profile(_TEXT_CONDITIONS | DEFINE_CONDITIONS)
LINT_ALL_PROFILE = _profile(_TEXT_CONDITIONS | INVERTED_CONDITIONS)
LINT_STATEMENT = rf"""
WITH scripts AS ({derived_sql(inputs.SCRIPTS, 'documents')}),
split AS (SELECT file, string_split(text, ';') AS parts FROM scripts),
pieces AS (SELECT file, unnest(range(1, len(parts) + 1)) AS statement, unnest(parts) AS text,
  unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], ';'))) AS upto FROM split),
placed AS (SELECT file, statement, text, CAST(1 + len(upto) - len(replace(upto, chr(10), ''))
  - len(ltrim(text, {_BLANKS})) + len(replace(ltrim(text, {_BLANKS}), chr(10), '')) AS BIGINT) AS line FROM pieces)
SELECT file, 'ML01' AS rule, 'MAJOR' AS severity, statement, line FROM placed
WHERE {_has(r"(?is)^\s*DEFINE\s+(DYNAMIC\s+)?(TABLE|VIEW)\s")} AND {_lacks(r"(?is)^\s*DEFINE\s+(DYNAMIC\s+)?(TABLE|VIEW)\s+.*\bCOMMENT\b")}
UNION ALL
SELECT file, 'ML02', 'CRITICAL', statement, line FROM placed
WHERE {_has(r"(?is)^\s*(CREATE\s+(OR\s+REPLACE\s+)?|DEFINE\s+)DYNAMIC\s+TABLE\s")} AND {_lacks(r"(?is)DYNAMIC\s+TABLE\s+.*\bTARGET_LAG\b")}
"""
_SQL_TOKEN = (
    r"""'(?s)''(?:[^''\\]|\\.)*''|"[^"]*"|\$\$.*?\$\$|--[^\n]*"""
    r"""|/\*[^*/]*(?:/\*[^*/]*\*/[^*/]*)*\*/|/\*.*|[^''"$/-]+|.'"""
)
LINT_STATEMENT_CODE = rf"""
WITH scripts AS ({derived_sql(inputs.QUOTED_SCRIPTS, 'documents')}),
tokens AS (SELECT file, regexp_extract_all(text, {_SQL_TOKEN}) AS tokens FROM scripts),
code AS (SELECT file, array_to_string(list_transform(tokens, lambda t: CASE
  WHEN t LIKE '--%' OR t LIKE '/*%' THEN regexp_replace(t, '[^\n]+', ' ', 'g')
  WHEN length(t) > 1 AND t[1] IN ('''', '"', '$') THEN replace(t, ';', chr(57344)) ELSE t END), '') AS text FROM tokens),
split AS (SELECT file, list_transform(string_split(text, ';'), lambda s: replace(s, chr(57344), ';')) AS parts FROM code),
pieces AS (SELECT file, unnest(range(1, len(parts) + 1)) AS statement, unnest(parts) AS text,
  unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], ';'))) AS upto FROM split),
placed AS (SELECT file, statement, text, CAST(1 + len(upto) - len(replace(upto, chr(10), ''))
  - len(ltrim(text, {_BLANKS})) + len(replace(ltrim(text, {_BLANKS}), chr(10), '')) AS BIGINT) AS line FROM pieces)
SELECT file, 'ML01' AS rule, 'MAJOR' AS severity, statement, line FROM placed
WHERE {_has(r"(?is)^\s*DEFINE\s+(DYNAMIC\s+)?(TABLE|VIEW)\s")} AND {_lacks(r"(?is)^\s*DEFINE\s+(DYNAMIC\s+)?(TABLE|VIEW)\s+.*\bCOMMENT\b")}
UNION ALL
SELECT file, 'ML02', 'CRITICAL', statement, line FROM placed
WHERE {_has(r"(?is)^\s*(CREATE\s+(OR\s+REPLACE\s+)?|DEFINE\s+)DYNAMIC\s+TABLE\s")} AND {_lacks(r"(?is)DYNAMIC\s+TABLE\s+.*\bTARGET_LAG\b")}
"""
LINT_BY_CATEGORY = f"""
WITH {_CORE_FOUND}
SELECT category, rule, count(*) AS findings FROM found JOIN rules USING (rule) GROUP BY ROLLUP (category, rule)
"""

EXTERNAL = f"""
external_facts AS ({derived_sql(inputs.EXTERNAL_FACTS, 'events')}),
violations AS (
  SELECT filepath, code_1 AS code, concat('first of ', CAST(event_id AS VARCHAR)) AS description, NULL AS start_line FROM external_facts
  UNION ALL SELECT filepath, code_2, 'second', line_2 FROM external_facts)"""
_SEVERITY = "CASE " + " ".join(
    f"WHEN code = '{c}' THEN '{s}'" for c, s in EXTERNAL_SEVERITY.items()
) + " ELSE 'MINOR' END"
ISSUES = f"""
SELECT 'sqlfluff' AS engine_id, code AS rule_id, {_SEVERITY} AS severity, 'CODE_SMELL' AS type,
  description AS message, filepath AS file_path, CAST(coalesce(start_line, 1) AS BIGINT) AS start_line
FROM violations
WHERE code NOT IN ('PRS', 'CP01') AND NOT contains(filepath, 'sources/definitions/')
  AND NOT contains(filepath, '/out/') AND NOT contains(filepath, '/.scannerwork/')
"""
LINT_ISSUES = f"WITH {EXTERNAL} {ISSUES}"
LINT_SEVERITY = f"WITH {EXTERNAL}, issues AS ({ISSUES}) SELECT severity, rule_id, count(*) AS issues FROM issues GROUP BY severity, rule_id"
LINT_TOTALS = f"""
WITH {_CORE_FOUND}, {EXTERNAL},
tools AS (SELECT 'custom' AS tool FROM found UNION ALL SELECT 'external' FROM violations)
SELECT coalesce(tool, 'all') AS tool, count(*) AS findings, count(*) > 0 AS failing FROM tools GROUP BY ROLLUP (tool)
"""
LINT_REPORT_TESTS = f"""
WITH {_CORE_FOUND}, {EXTERNAL}
SELECT concat('[', rule, '] ', description) AS name, 'failed' AS status, CAST(0 AS BIGINT) AS duration,
  concat(file, ':', CAST(line AS VARCHAR), ' — ', {_STRIPPED}) AS message, 'Custom Rules' AS suite
FROM found JOIN rules USING (rule)
UNION ALL
SELECT concat('[', code, '] ', description), 'failed', CAST(0 AS BIGINT),
  concat(filepath, ':', CAST(coalesce(start_line, 0) AS VARCHAR)), 'External Linter'
FROM violations
"""
_ISSUE_JSON = text_sql(
    '{"engineId":"{engine_id}","ruleId":"{rule_id}","severity":"{severity}","type":"{type}",'
    '"primaryLocation":{"message":"{message}","filePath":"{file_path}","textRange":{"startLine":{start_line}}}}'
)
LINT_ISSUE_LINES = rf"""
WITH {EXTERNAL}, issues AS ({ISSUES}),
keyed AS (SELECT *, regexp_extract(file_path, '^([^_]*)_', 1) AS report,
  row_number() OVER (PARTITION BY regexp_extract(file_path, '^([^_]*)_', 1) ORDER BY file_path, message, start_line, rule_id) AS rn FROM issues)
SELECT report, 1 AS part, concat(CASE WHEN rn = 1 THEN '' ELSE ',' END, {_ISSUE_JSON}) AS line FROM keyed
UNION ALL SELECT DISTINCT report, 0, '{{"issues":[' FROM keyed
UNION ALL SELECT DISTINCT report, 2, ']}}' FROM keyed
"""

# Assertions


def _judged(seq: int, name: str, expected: str, actual: str) -> str:
    return (
        f"SELECT {seq} AS seq, '{name}' AS name, CASE WHEN {actual} = '{expected}' THEN 'passed' ELSE 'failed' END AS status, "
        f"CASE WHEN {actual} = '{expected}' THEN '' ELSE concat('Expected ''{expected}'', got ''', {actual}, '''') END AS message, "
        "'SQLValidation' AS suite"
    )


DQ_RUN = " UNION ALL ".join(
    [
        "SELECT 1 AS seq, '# Test Name' AS name, 'skipped' AS status, '' AS message, 'SQLValidation' AS suite",
        _judged(2, "event count", "5000", "(SELECT CAST(count(*) AS VARCHAR) FROM events)"),
        _judged(3, "no missing users", "0", "(SELECT CAST(count(*) FILTER (user_id IS NULL) AS VARCHAR) FROM events)"),
        _judged(4, "users from zero", "0", "(SELECT CAST(min(user_id) AS VARCHAR) FROM events)"),
        _judged(5, "quantity of flag A", "26", "(SELECT CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) FROM lineitem WHERE l_returnflag = 'A')"),
        _judged(6, "lines without order", "0", "(SELECT CAST(count(*) AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))"),
        _judged(7, "no such segment", "null", "(SELECT coalesce(CAST(min(c_custkey) AS VARCHAR), 'null') FROM customer WHERE c_mktsegment = 'NONE')"),
        "SELECT 8, 'Unnamed Skipped Test', 'skipped', '', 'SQLValidation'",
    ]
)
DQ_COUNTS = f"""
WITH results AS ({DQ_RUN})
SELECT suite, count(*) AS tests, count(*) FILTER (status = 'passed') AS passed,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped
FROM results GROUP BY suite
"""
DQ_TOLERANCE = """
WITH t AS (SELECT count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS s, avg(value) AS m,
  count(*) FILTER (value IS NULL) AS missing FROM events)
SELECT 1 AS seq, 'rows' AS name, CASE WHEN abs(n - 5000) <= 5 THEN 'passed' ELSE 'failed' END AS status FROM t
UNION ALL SELECT 2, 'sum', CASE WHEN abs(s - 26) <= 5 THEN 'passed' ELSE 'failed' END FROM t
UNION ALL SELECT 3, 'mean', CASE WHEN abs(round(m, 4) - 27) <= 5 THEN 'passed' ELSE 'failed' END FROM t
UNION ALL SELECT 4, 'missing', CASE WHEN abs(missing) <= 5 THEN 'passed' ELSE 'failed' END FROM t
"""

DQ_SPLIT = """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat(c_name, ' ') WHEN 1 THEN concat('# ', c_name) ELSE c_name END AS name,
  CASE c_custkey % 3 WHEN 0 THEN ' SELECT a || b ' WHEN 1 THEN '' ELSE 'SELECT 1 AS result;' END AS query,
  CASE c_custkey % 3 WHEN 0 THEN concat(' ', c_mktsegment) WHEN 1 THEN '' ELSE '1' END AS expected,
  'to the last bar' AS reading FROM customer
UNION ALL
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat(c_name, ' ') WHEN 1 THEN concat('# ', c_name) ELSE c_name END,
  CASE c_custkey % 3 WHEN 0 THEN ' SELECT a ' WHEN 1 THEN '' ELSE 'SELECT 1 AS result;' END,
  CASE c_custkey % 3 WHEN 0 THEN concat('| b | ', c_mktsegment) WHEN 1 THEN '' ELSE '1' END,
  'third takes the rest' FROM customer
"""

# Reports

_JUNIT = f"""
facts AS ({derived_sql(inputs.JUNIT_FACTS, 'orders')}),
files AS (SELECT *, concat('reports/TEST_', CAST(k AS VARCHAR), '.xml') AS path,
  NOT (k % 31 = 0 OR k % 37 = 0 OR k % 41 = 0 OR k % 43 = 0) AS converted FROM facts),
tests AS (
  SELECT path, k, 1 AS seq, concat('first ', CAST(k AS VARCHAR)) AS name,
    CASE WHEN status IN ('F', 'P') THEN 'failed' ELSE 'passed' END AS status,
    CAST(trunc(TRY_CAST(t1 AS DOUBLE) * 1000) AS BIGINT) AS duration,
    CASE status WHEN 'F' THEN 'bad total' WHEN 'P' THEN 'only text' ELSE '' END AS message,
    concat('S', CAST(k AS VARCHAR)) AS suite FROM files WHERE converted
  UNION ALL SELECT path, k, 2, 'second', 'skipped', 1, 'later', concat('S', CAST(k AS VARCHAR)) FROM files WHERE converted AND cases >= 2
  UNION ALL SELECT path, k, 3, 'Unnamed', 'failed', 2000, '', concat('S', CAST(k AS VARCHAR)) FROM files WHERE converted AND cases >= 3
  UNION ALL SELECT path, k, 4, 'fourth', 'passed', 1, '', concat('S', CAST(k AS VARCHAR)) FROM files WHERE converted AND cases >= 4
  UNION ALL SELECT path, k, cases + 1, 'in second', 'passed', 500, '', 'SQLValidation' FROM files WHERE converted AND NOT single)"""
JUNIT_TO_TESTS = f"WITH {_JUNIT} SELECT path, CAST(seq AS INTEGER) AS seq, name, status, duration, message, suite FROM tests"
JUNIT_COUNTS = f"""
WITH {_JUNIT}
SELECT count(*) FILTER (converted) AS converted, count(*) FILTER (NOT converted) AS errors, count(*) AS files FROM files
"""
JUNIT_SUMMARY = f"""
WITH {_JUNIT}
SELECT suite, count(*) AS tests, count(*) FILTER (status = 'passed') AS passed,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped
FROM tests GROUP BY suite
"""
_TEST_JSON = text_sql('{"name":"{name}","status":"{status}","duration":{duration},"message":"{message}","suite":"{suite}"}')
_COUNTERS = '"tests":{n},"passed":{n_passed},"failed":{n_failed},"skipped":{n_skipped},"pending":0,"other":0,"start":0'
_COUNTED = (
    "count(*) AS n, count(*) FILTER (status = 'passed') AS n_passed, "
    "count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'skipped') AS n_skipped"
)
JUNIT_DOCUMENTS = f"""
WITH {_JUNIT},
documents AS (SELECT path, k, {_COUNTED}, string_agg({_TEST_JSON}, ',' ORDER BY seq) AS listed,
  CASE WHEN k % 2 = 0 THEN concat('S', CAST(k AS VARCHAR)) ELSE 'SQLValidation' END AS project FROM tests GROUP BY path, k)
SELECT replace(path, '.xml', '.json') AS path,
  {text_sql('{"reportFormat":"CTRF","specVersion":"0.0.1","results":{"tool":{"name":"table-checks"},"summary":{' + _COUNTERS + ',"stop":1500},"tests":[{listed}],"environment":{"projectName":"{project}"}}}')} AS document
FROM documents
"""
_RESULTS = f"results AS ({derived_sql(inputs.RESULTS, 'events')})"
REPORT_LINES = f"""
WITH {_RESULTS}, tests AS (SELECT strftime(run_ts, '%Y-%m-%d') AS report, run_id, test AS name, status, duration,
  '' AS message, 'SQLValidation' AS suite, row_number() OVER (PARTITION BY strftime(run_ts, '%Y-%m-%d') ORDER BY run_id) AS rn FROM results),
counted AS (SELECT report, {_COUNTED} FROM tests GROUP BY report)
SELECT report, 1 AS part, run_id, concat(CASE WHEN rn = 1 THEN '' ELSE ',' END, {_TEST_JSON}) AS line FROM tests
UNION ALL
SELECT report, 0, NULL, {text_sql('{"reportFormat":"CTRF","specVersion":"0.0.1","results":{"tool":{"name":"table-checks"},"summary":{' + _COUNTERS + ',"stop":0},"tests":[')} FROM counted
UNION ALL
SELECT report, 2, NULL, {text_sql('],"environment":{"projectName":"{report}"}}}')} FROM counted
"""
_HISTORY = """
SELECT test, run_ts, run_id, status, duration, previous_status,
  CASE WHEN previous_status IS NULL THEN 'new'
    WHEN status = 'failed' AND previous_status <> 'failed' THEN 'newly_failing'
    WHEN status <> 'failed' AND previous_status = 'failed' THEN 'fixed' ELSE 'same' END AS change,
  duration - previous_duration AS duration_change, runs, passed_runs, failed_runs,
  CAST(passed_runs AS DOUBLE) / runs AS pass_rate
FROM (SELECT *, lag(status) OVER w AS previous_status, lag(duration) OVER w AS previous_duration,
    count(*) OVER r AS runs, count(*) FILTER (status = 'passed') OVER r AS passed_runs,
    count(*) FILTER (status = 'failed') OVER r AS failed_runs
  FROM results
  WINDOW w AS (PARTITION BY test ORDER BY run_ts, run_id),
    r AS (PARTITION BY test ORDER BY run_ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""
TEST_HISTORY = f"WITH {_RESULTS} {_HISTORY}"
TEST_FLIPS = f"""
WITH {_RESULTS}, history AS ({_HISTORY})
SELECT test, change, count(*) AS flips FROM history WHERE change IN ('newly_failing', 'fixed') GROUP BY test, change
"""
RUN_TOTALS = f"""
WITH {_RESULTS}
SELECT strftime(run_ts, '%Y-%m-%d') AS run, count(*) AS tests, count(*) FILTER (status = 'passed') AS passed,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped,
  CAST(sum(duration) AS BIGINT) AS duration
FROM results GROUP BY run
"""

# A bucket is the exact value without its lower binary digits.
_BUCKET = "({v} - {v} % CAST(pow(2, greatest(length(bin({v})) - 7, 0)) AS BIGINT))"
DURATION_QUANTILES = f"""
WITH {_RESULTS}, exact AS (
  SELECT test, count(*) AS runs, quantile_disc(duration, 0.5) AS q50, quantile_disc(duration, 0.9) AS q90, quantile_disc(duration, 0.99) AS q99
  FROM results GROUP BY test
)
SELECT test, runs, {_BUCKET.format(v='q50')} AS p50, {_BUCKET.format(v='q90')} AS p90, {_BUCKET.format(v='q99')} AS p99 FROM exact
"""
DURATION_CHANGES = f"""
WITH {_RESULTS}, days AS (SELECT DISTINCT test, CAST(run_ts AS DATE) AS day FROM results),
sides AS (
  SELECT d.test, d.day, r.duration, CAST(r.run_ts AS DATE) < d.day AS earlier
  FROM days d JOIN results r ON r.test = d.test AND CAST(r.run_ts AS DATE) BETWEEN d.day - 7 AND d.day + 6
), exact AS (
  SELECT test, day, quantile_disc(duration, 0.5) FILTER (earlier) AS b, quantile_disc(duration, 0.5) FILTER (NOT earlier) AS a,
    count(*) FILTER (earlier) AS nb, count(*) FILTER (NOT earlier) AS na FROM sides GROUP BY ALL
), medians AS (SELECT test, day, {_BUCKET.format(v='b')} AS before, {_BUCKET.format(v='a')} AS after, nb, na FROM exact),
marked AS (
  SELECT *, CASE WHEN nb >= 5 AND na >= 5 AND after * 100 >= before * 150 AND after > before THEN 'slower'
    WHEN nb >= 5 AND na >= 5 AND before * 100 >= after * 150 AND before > after THEN 'faster' ELSE 'same' END AS change FROM medians
)
SELECT test, CAST(day AS VARCHAR) AS day, before, after, change
FROM (SELECT *, lag(change) OVER (PARTITION BY test ORDER BY day) AS last FROM marked)
WHERE change <> 'same' AND change IS DISTINCT FROM last
"""


def _operations(kind: str) -> str:
    return " + ".join(f"CASE WHEN NOT bare AND {op} = '{kind}' THEN 1 ELSE 0 END" for op in ("op_1", "op_2", "op_3"))


_PLAN_STATUS = """CASE WHEN bare OR status_text = '' THEN 'UNKNOWN' WHEN contains(status_text, 'PLAN_FAILED') THEN 'PLAN_FAILED' ELSE 'OK' END"""
PLAN_SUMMARY = f"""
WITH plans AS ({derived_sql(inputs.PLAN_FACTS, 'orders')})
SELECT plan_id, {_PLAN_STATUS} AS status, {_operations('CREATE')} AS creates, {_operations('ALTER')} AS alters,
  {_operations('DROP')} AS drops, {_operations('NO_OPERATION')} AS unchanged,
  CASE WHEN bare THEN '' ELSE concat_ws(',', CASE WHEN op_1 = 'DROP' THEN concat('A', CAST(plan_id AS VARCHAR)) END,
    CASE WHEN op_2 = 'DROP' THEN concat('B', CAST(plan_id AS VARCHAR)) END,
    CASE WHEN op_3 = 'DROP' THEN 'unknown' END) END AS dropped_objects,
  {_PLAN_STATUS} = 'PLAN_FAILED' AS failed
FROM plans
"""

# Templates, DDL, scalar functions

RENDER_TEMPLATES = f"""
SELECT p_partkey, replace(replace(replace({inputs.TEMPLATES['text']},
  '{{{{ db }}}}', CASE WHEN p_partkey % 2 = 1 THEN 'prd' ELSE 'dev' END),
  '{{{{ brand }}}}', {inputs.TEMPLATE_SETTINGS['brand']}), '{{{{ size }}}}', {inputs.TEMPLATE_SETTINGS['size']}) AS text
FROM part
"""


def _ddl_line(number: int, expression: str) -> str:
    return f"SELECT concat(p_brand, '/', CAST(p_partkey AS VARCHAR), '.sql') AS file, CAST({number} AS BIGINT) AS line, {expression} AS text FROM part"


DDL_FORMAT = " UNION ALL ".join(
    [
        _ddl_line(1, "concat('CREATE OR REPLACE VIEW PART_', CAST(p_partkey AS VARCHAR), ' (P_NAME, P_SIZE)')"),
        _ddl_line(2, "concat('    -- kept as is: ', p_name)"),
        _ddl_line(3, "') AS SELECT'"),
        _ddl_line(4, "'    P_NAME,'"),
        _ddl_line(5, "'    MAX (P_SIZE),'"),
        _ddl_line(6, "concat('    ''lower ', p_name, '''')"),
        _ddl_line(7, "'FROM PART P'"),
        _ddl_line(8, "'LEFT JOINSUPPLIER S ON P.K=S.K'"),
    ]
)
SCALAR_FUNCTIONS = f"""
WITH facts AS ({derived_sql({**inputs.PAYMENT_FACTS, 'custkey': 'o_custkey'}, 'orders')})
SELECT k, date_diff('minute', created, created + INTERVAL '1' SECOND * (k % 500)) AS minutes,
  'Deb' AS prefix, '' AS no_prefix,
  CASE WHEN custkey % 3 = 0 THEN clearing ELSE concat(clearing, '_', CAST(custkey % 3 AS VARCHAR)) END AS released,
  concat(debtor, ' x  y') AS words, concat(debtor, '  ''x  y''') AS stripped,
  concat(e2e, ' ', txn, ' {{{{ A }}}} ', txn) AS filled,
  CASE WHEN k % 7 > 0 THEN CAST((k % 7) * 125 AS BIGINT) ELSE 1 END AS millis
FROM facts
"""

# Tables and catalogue

CSV_LOAD = "SELECT c_custkey, c_name, c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 9 <> 0"
TABLE_INSERT = """
SELECT c_custkey AS party_id, c_name AS party_name, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS party_balance, c_mktsegment AS party_kind FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, NULL FROM supplier
"""
SNAPSHOT_ROUNDTRIP = """
SELECT 'nation' AS table_name, count(*) AS rows FROM nation UNION ALL SELECT 'customer', count(*) FROM customer
UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'closed', count(*) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'buyers', count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F'
"""
SNAPSHOT_REGRESSION = " UNION ALL ".join(
    f"SELECT seq, name, status, message FROM ({_judged(*check)})"
    for check in [
        (1, "orders", "15000", "(SELECT CAST(count(*) AS VARCHAR) FROM orders)"),
        (2, "no negative price", "0", "(SELECT CAST(count(*) FILTER (o_totalprice < 0) AS VARCHAR) FROM orders)"),
        (3, "largest line number", "7", "(SELECT CAST(max(l_linenumber) AS VARCHAR) FROM lineitem)"),
    ]
)
CATALOG_INVENTORY = "SELECT CAST(3 AS BIGINT) AS tables, CAST(1 AS BIGINT) AS views"

STREAM_GRAPH = f"""
WITH counted AS (
  SELECT 'transfers' AS name, count(*) AS rows FROM ({PAY_PARSE_008}) AS t
  UNION ALL SELECT 'acks', count(*) FROM ({PAY_PARSE_002}) AS t
  UNION ALL SELECT 'joined', count(*) FROM ({PAY_STATUS_JOIN}) AS t
)
SELECT name, TRUE AS after_inputs, CAST(2 AS BIGINT) AS batches, CAST(3600 AS DOUBLE) AS lag_seconds, TRUE AS in_lag, rows FROM counted
"""

ORACLES: dict[str, str] = {
    "iot_geo_join": IOT_GEO_JOIN,
    "iot_hourly": IOT_HOURLY,
    "iot_recent": IOT_RECENT,
    "gen_readings": GEN_READINGS,
    "gen_payments": GEN_PAYMENTS,
    "deps_classify": DEPS_CLASSIFY,
    "deps_summary": DEPS_SUMMARY,
    "deps_lint": DEPS_LINT,
    "deps_csv": DEPS_CSV,
    "pay_route": PAY_ROUTE,
    "pay_parse_008": PAY_PARSE_008,
    "pay_parse_002": PAY_PARSE_002,
    "pay_status_join": PAY_STATUS_JOIN,
    "pay_ack_time": PAY_ACK_TIME,
    "lint_scan": LINT_SCAN,
    "lint_text_profile": LINT_TEXT_PROFILE,
    "lint_setup_profile": LINT_SETUP_PROFILE,
    "lint_dcm_profile": LINT_DCM_PROFILE,
    "lint_all_profile": LINT_ALL_PROFILE,
    "lint_statement": LINT_STATEMENT,
    "lint_statement_code": LINT_STATEMENT_CODE,
    "lint_by_category": LINT_BY_CATEGORY,
    "lint_issues": LINT_ISSUES,
    "lint_severity": LINT_SEVERITY,
    "lint_totals": LINT_TOTALS,
    "lint_report_tests": LINT_REPORT_TESTS,
    "lint_issue_lines": LINT_ISSUE_LINES,
    "dq_split": DQ_SPLIT,
    "dq_run": DQ_RUN,
    "dq_counts": DQ_COUNTS,
    "dq_tolerance": DQ_TOLERANCE,
    "junit_to_tests": JUNIT_TO_TESTS,
    "junit_counts": JUNIT_COUNTS,
    "junit_documents": JUNIT_DOCUMENTS,
    "junit_summary": JUNIT_SUMMARY,
    "report_lines": REPORT_LINES,
    "test_history": TEST_HISTORY,
    "test_flips": TEST_FLIPS,
    "run_totals": RUN_TOTALS,
    "duration_quantiles": DURATION_QUANTILES,
    "duration_changes": DURATION_CHANGES,
    "plan_summary": PLAN_SUMMARY,
    "render_templates": RENDER_TEMPLATES,
    "ddl_format": DDL_FORMAT,
    "scalar_functions": SCALAR_FUNCTIONS,
    "csv_load": CSV_LOAD,
    "table_insert": TABLE_INSERT,
    "snapshot_roundtrip": SNAPSHOT_ROUNDTRIP,
    "snapshot_regression": SNAPSHOT_REGRESSION,
    "catalog_inventory": CATALOG_INVENTORY,
    "csv_load_twice": """
SELECT c_mktsegment, count(*) AS rows, count(DISTINCT c_custkey) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
FROM customer WHERE c_custkey % 9 <> 0 GROUP BY 1
""",
    "stream_hourly": IOT_HOURLY,
    "stream_parse_008": PAY_PARSE_008,
    "stream_parse_002": PAY_PARSE_002,
    "stream_status_join": PAY_STATUS_JOIN,
    "stream_graph": STREAM_GRAPH,
}
