"""Registered queries: business rules, rule grading, test coverage, logs, order."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from siftline.functions import fixed
from siftline.operators import checks, constraints, coverage, load, logs, report, rule_index, rules
from siftline.plans import flows
from siftline.plans import samples as S
from siftline.plans.registry import query
from siftline.session import spread

AS_OF = dt.date(2020, 1, 15)


def _q(pattern: str) -> str:
    """A case-insensitive pattern as a SQL text literal."""
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _first_sql(patterns: list[str], group: int = 1) -> str:
    return "COALESCE(" + ", ".join(f"NULLIF(regexp_extract(text, {_q(p)}, {group}), '')" for p, _ in patterns) + ", NULL)"


def _any_sql(patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches(text, {_q(p)})" for p, _ in patterns) + ")"


# --- fields and constraints from text -----------------------------------------------------


def _fields_sql() -> str:
    found = ", ".join(f"regexp_extract_all(text, {_q(p)}, 1)" for p, _ in fixed.FIELD_MENTIONS)
    banned = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS + fixed.RULE_WORDS)
    return (
        f"c AS (SELECT id, list_filter(list_transform(flatten([{found}]), lambda x: trim(x)), lambda x: length(x) BETWEEN 2 AND 50 AND lower(x) NOT IN ({banned})) AS names FROM message), "
        "u AS (SELECT id, unnest(names) AS name, generate_subscripts(names, 1) AS i FROM c), "
        "f AS (SELECT id, lower(name) AS k, min(i) AS i, arg_min(name, i) AS name FROM u GROUP BY 1, 2), "
        "g AS (SELECT id, string_agg(name, '|' ORDER BY i) AS fields FROM f GROUP BY 1) "
        "SELECT m.id, COALESCE(fields, '') AS fields FROM message m LEFT JOIN g USING (id)"
    )


def _extracted(df):
    return constraints.extract_fields(df, "text").select("id", F.array_join("fields", "|").alias("fields"))


@query("extract_fields_messages", f"WITH {S.MESSAGE_SQL}, " + _fields_sql())
def extract_fields_messages(t):
    return _extracted(spread(S.messages(t)))


@query("extract_fields_documents", "WITH message AS (SELECT doc_id AS id, text FROM documents), " + _fields_sql())
def extract_fields_documents(t):
    return _extracted(spread(t.documents.select(F.col("doc_id").alias("id"), "text")))


_LENGTH_FIRST = "CASE " + " ".join(
    f"WHEN regexp_matches(text, {_q(p)}) THEN regexp_extract(text, {_q(p)}, 1)" for _, p, _ in fixed.LENGTH_TEXT
) + " END"
_LENGTH_KIND = "CASE " + " ".join(f"WHEN regexp_matches(text, {_q(p)}) THEN '{k}'" for k, p, _ in fixed.LENGTH_TEXT) + " END"
_FORMAT = "CASE " + " ".join(f"WHEN {_any_sql(ps)} THEN '{k}'" for k, ps in fixed.FORMAT_TEXT) + " END"
_RANGE_SECOND = _first_sql([(p, _) for k, p, _ in fixed.LENGTH_TEXT if k == "length_range"], 2)

CONSTRAINT_SQL = f"""c0 AS (SELECT id, text, {_any_sql(fixed.REQUIRED_TEXT)} AS required,
  CASE WHEN NOT contains(lower(text), 'characters') THEN TRY_CAST({_first_sql(fixed.RANGE_TEXT, 1)} AS DOUBLE) END AS low,
  CASE WHEN NOT contains(lower(text), 'characters') THEN TRY_CAST({_first_sql(fixed.RANGE_TEXT, 2)} AS DOUBLE) END AS high,
  CASE WHEN NOT contains(lower(text), 'characters') THEN TRY_CAST({_first_sql(fixed.MINIMUM_TEXT)} AS DOUBLE) END AS mn,
  CASE WHEN NOT contains(lower(text), 'characters') THEN TRY_CAST({_first_sql(fixed.MAXIMUM_TEXT)} AS DOUBLE) END AS mx,
  {_LENGTH_KIND} AS lk, TRY_CAST({_LENGTH_FIRST} AS BIGINT) AS l1, TRY_CAST({_RANGE_SECOND} AS BIGINT) AS l2, {_FORMAT} AS format_type,
  {_first_sql(fixed.CUSTOM_FORMAT_TEXT)} AS format_pattern,
  CASE WHEN regexp_matches(text, {_q(fixed.ALLOWED_TEXT[0][0])}) THEN array_to_string(regexp_extract_all(array_to_string(regexp_extract_all(text, {_q(fixed.ALLOWED_TEXT[0][0])}, 1), ' '), {_q(fixed.QUOTED)}, 1), '|')
    WHEN regexp_matches(text, {_q(fixed.ALLOWED_TEXT[1][0])}) THEN array_to_string(regexp_extract_all(text, {_q(fixed.ALLOWED_TEXT[1][0])}, 1), '|') END AS allowed,
  trim({_first_sql(fixed.CONDITION_TEXT, 1)}) AS condition_field, trim({_first_sql(fixed.CONDITION_TEXT, 2)}) AS condition_value,
  {_any_sql(fixed.UNIQUE_TEXT)} AS is_unique FROM message),
c AS (SELECT id, text, required, COALESCE(low, mn) AS min_value, COALESCE(high, mx) AS max_value,
  CASE WHEN lk IN ('min_length', 'length_range') THEN l1 END AS min_length, CASE WHEN lk = 'max_length' THEN l1 WHEN lk = 'length_range' THEN l2 END AS max_length,
  CASE WHEN lk = 'exact_length' THEN l1 END AS exact_length, format_type, format_pattern, allowed, condition_field, condition_value, is_unique,
  CASE WHEN low IS NOT NULL THEN 'range_validation' WHEN mn IS NOT NULL AND mx IS NOT NULL THEN 'min_max_validation' WHEN mn IS NOT NULL THEN 'minimum_validation'
    WHEN mx IS NOT NULL THEN 'maximum_validation' WHEN lk = 'length_range' THEN 'length_range_validation' WHEN lk IN ('min_length', 'max_length') THEN 'length_validation'
    WHEN lk = 'exact_length' THEN 'exact_length_validation' WHEN format_type IS NOT NULL OR format_pattern IS NOT NULL THEN 'format_validation'
    WHEN allowed IS NOT NULL THEN 'allowed_values_validation' WHEN condition_field IS NOT NULL THEN 'conditional_validation'
    WHEN is_unique THEN 'uniqueness_validation' WHEN required THEN 'required_validation' ELSE 'default_validation' END AS logic FROM c0)
"""
_CONSTRAINT_OUT = (
    "SELECT id, required, min_value, max_value, min_length, max_length, exact_length, format_type, format_pattern, COALESCE(allowed, '') AS allowed, "
    "condition_field, condition_value, is_unique FROM c"
)


def _constraint_out(df):
    return constraints.extract_constraints(df, "text").select(
        "id", "required", "min_value", "max_value", "min_length", "max_length", "exact_length", "format_type", "format_pattern",
        F.coalesce(F.array_join("allowed_values", "|"), F.lit("")).alias("allowed"), "condition_field", "condition_value", "is_unique",
    )


@query("extract_constraints_messages", f"WITH {S.MESSAGE_SQL}, {CONSTRAINT_SQL} {_CONSTRAINT_OUT}")
def extract_constraints_messages(t):
    return _constraint_out(spread(S.messages(t)))


@query("extract_constraints_documents", f"WITH message AS (SELECT doc_id AS id, text FROM documents), {CONSTRAINT_SQL} {_CONSTRAINT_OUT.replace(', format_pattern', '')}")
def extract_constraints_documents(t):
    return _constraint_out(spread(t.documents.select(F.col("doc_id").alias("id"), "text"))).drop("format_pattern")


@query("classify_logic_messages", f"WITH {S.MESSAGE_SQL}, {CONSTRAINT_SQL} SELECT logic, count(*) AS rules FROM c GROUP BY 1")
def classify_logic_messages(t):
    found = constraints.extract_constraints(spread(S.messages(t)), "text").select(constraints.classify_logic().alias("logic"))
    return found.groupBy("logic").agg(F.count("*").alias("rules"))


_APPLIED = [
    ("employees", "Employees must be between 100 and 900"),
    ("name", "Name is required"),
    ("email", "Please enter a valid email address format"),
    ("phone", "Phone must be at least 12 characters long"),
    ("segment", "Segment must be 'BUILDING'"),
    ("code", "Code cannot exceed 4 characters"),
]


@query(
    "apply_constraints_contact",
    f"""WITH {S.CONTACT_SQL}, n AS (SELECT *, CASE WHEN regexp_matches(employees, {S.NUMBER_SQL}) THEN TRY_CAST(employees AS DOUBLE) END AS num FROM contact)
    SELECT id AS row_id, 'employees' AS field, COALESCE(num BETWEEN 100 AND 900, false) AS passed FROM n
    UNION ALL SELECT id, 'name', COALESCE(trim(name) <> '', false) FROM n
    UNION ALL SELECT id, 'email', trim(email) <> '' AND contains(email, '@') AND contains(split_part(email, '@', 2), '.') FROM n
    UNION ALL SELECT id, 'phone', length(trim(phone)) >= 12 FROM n
    UNION ALL SELECT id, 'segment', segment = 'BUILDING' FROM n
    UNION ALL SELECT id, 'code', length(trim(code)) <= 4 FROM n""",
)
def apply_constraints_contact(t):
    table = t.spark.createDataFrame(_APPLIED, "field string, text string")
    found = constraints.extract_constraints(table, "text")
    return constraints.apply_constraints(S.contacts(t), "id", found).select("row_id", "field", "passed")


# --- message rules -----------------------------------------------------------------------------

_MESSAGE_RULES = [
    ("R_name", "Account Name is required and cannot be blank", "AccountName", {"AccountName": "name"}, True),
    ("R_employees", "Employees must be between 100 and 900 units", "", {"Employees": "employees"}, True),
    ("R_phone", "Phone number must be at least 12 characters long", "", {"Phone": "phone"}, True),
    ("R_email", "Please enter a valid email address format", "", {"Email": "email"}, True),
    ("R_code", "Product code must be at least 2 characters", "", {"ProductCode": "code"}, True),
    ("R_segment", "Segment must be 'BUILDING'", "Segment", {"Segment": "segment"}, True),
    ("R_created", "Created date must be a past date", "", {"CreatedDate": "created"}, True),
    ("R_rate", "Rate should be a positive number", "Rate", {"Rate": "rate"}, True),
    ("R_case", "Market must use uppercase format", "Market", {"Market": "segment"}, True),
    ("R_off", "Name is required", "Name", {"Name": "name"}, False),
    ("R_unmapped", "Name is required", "Name", {}, True),
    ("R_status", "Status policy", "Owner", {"Owner": "name"}, True),
]
_FAILED_SQL = {
    "R_name": "name IS NULL OR trim(name) = ''",
    "R_employees": "num IS NULL OR num NOT BETWEEN 100 AND 900",
    "R_phone": "length(phone) < 12",
    "R_email": r"trim(email) = '' OR NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$')",
    "R_code": "length(code) < 2",
    "R_segment": "segment <> 'BUILDING'",
    "R_created": "TRY_CAST(created AS DATE) IS NULL OR TRY_CAST(created AS DATE) >= DATE '2020-01-15'",
    "R_rate": "TRY_CAST(rate AS DOUBLE) IS NULL OR TRY_CAST(rate AS DOUBLE) <= 0",
    "R_case": "segment <> upper(segment)",
    "R_status": "name IS NULL OR trim(name) = ''",
}
_MESSAGE_CTE = (
    f"WITH {S.CONTACT_SQL}, n AS (SELECT *, CASE WHEN regexp_matches(employees, {S.NUMBER_SQL}) THEN TRY_CAST(employees AS DOUBLE) END AS num FROM contact), "
    "violation AS (" + " UNION ALL ".join(f"SELECT id AS row_id, '{r}' AS rule FROM n WHERE {e}" for r, e in _FAILED_SQL.items()) + ") "
)


def _message_rules(t):
    schema = "rule_name string, error_message string, error_field string, mappings map<string,string>, active boolean"
    return t.spark.createDataFrame(_MESSAGE_RULES, schema).withColumn("description", F.lit(""))


_MESSAGE_SQL = "(VALUES " + ", ".join(
    f"""('{name}', '{message.replace("'", "''")}', '{next(iter(mapped.values()), "")}')""" for name, message, _, mapped, _ in _MESSAGE_RULES
) + ") AS text(rule, message, field)"


@query("message_rules_customer", _MESSAGE_CTE + f"SELECT row_id, rule, field, message, 'error' AS severity, 'Business Rule Errors' AS category FROM violation JOIN {_MESSAGE_SQL} USING (rule)")
def message_rules_customer(t):
    checked = rules.message_rule_check(S.contacts(t), _message_rules(t), "id", AS_OF)
    return checks.violations_table(checked, "id").select("row_id", "rule", "field", "message", "severity", "category")


@query(
    "message_rules_many",
    """SELECT id, CASE WHEN name = '' THEN (SELECT count(*) FROM part WHERE p_partkey % 2 = 0) ELSE 0 END
      + (SELECT count(*) FROM part WHERE p_partkey % 2 = 1 AND p_size > length(name)) AS error_count FROM (SELECT c_custkey AS id,
      CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS name FROM customer)""",
)
def message_rules_many(t):
    """A rule of every part: that the name is there, or that it has so many characters."""
    made = t.part.selectExpr(
        "'R' || p_partkey AS rule_name",
        "CASE WHEN p_partkey % 2 = 0 THEN 'Name is required and cannot be blank' ELSE 'Name must be at least ' || p_size || ' characters' END AS error_message",
        "'Name' AS error_field", "map('Name', 'name') AS mappings", "true AS active", "'' AS description",
    )
    df = t.customer.selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS name")
    return rules.message_rule_check(df, made, "id", AS_OF).select("id", F.col("error_count").cast("long").alias("error_count"))


@query(
    "message_rules_joined",
    _MESSAGE_CTE + "SELECT id, count(rule) AS error_count, count(rule) = 0 AS is_valid FROM n LEFT JOIN violation ON row_id = id GROUP BY id",
)
def message_rules_joined(t):
    checked = rules.message_rule_check(S.contacts(t), _message_rules(t), "id", AS_OF, inline_rules=0)
    return checked.select("id", F.col("error_count").cast("long").alias("error_count"), "is_valid")


@query(
    "resolve_rule_field_messages",
    f"""WITH {S.MESSAGE_SQL} SELECT id, CASE id % 10 WHEN 0 THEN 'Account_Name' WHEN 2 THEN 'Contact_Email' WHEN 3 THEN 'Home_Phone' WHEN 5 THEN 'Salary_Amount'
    WHEN 6 THEN 'Product_Code' WHEN 7 THEN 'Start_Date' WHEN 8 THEN 'Account_Type' WHEN 9 THEN NULL WHEN 1 THEN NULL WHEN 4 THEN 'Account_Status' END AS target_field FROM message""",
)
def resolve_rule_field_messages(t):
    targets = ["Account_Name", "Contact_Email", "Home_Phone", "Salary_Amount", "Product_Code", "Start_Date", "Account_Type", "Account_Status"]
    mapped = S.messages(t).selectExpr(
        "id", "'rule' AS rule_name", "text AS error_message", "'' AS error_field", "'' AS description",
        "map(" + ", ".join(f"'{x}', 'col_{i}'" for i, x in enumerate(targets)) + ") AS mappings",
    )
    return rules.resolve_rule_field(mapped).select("id", "target_field")


_CONTEXT = {
    "future": "CASE WHEN id % 2 = 0 THEN 'must be a future date' ELSE 'must be a past date' END",
    "num": "CASE id % 4 WHEN 0 THEN 'positive number' WHEN 1 THEN 'negative number' WHEN 2 THEN 'an integer' ELSE 'a number' END",
    "len": "CASE id % 3 WHEN 0 THEN 'must be 12 characters' WHEN 1 THEN 'minimum 16 and maximum 18' ELSE 'too short' END",
    "fmt": "CASE id % 4 WHEN 0 THEN 'alphanumeric' WHEN 1 THEN 'no special characters' WHEN 2 THEN 'uppercase' ELSE 'zip code' END",
    "st": "CASE id % 3 WHEN 0 THEN 'status' WHEN 1 THEN 'stage' ELSE 'other' END",
}


@query(
    "contexts_contact",
    f"WITH {S.CONTACT_SQL}, x AS (SELECT *, " + ", ".join(f"{e} AS t_{n}" for n, e in _CONTEXT.items()) + f""",
      CASE WHEN regexp_matches(employees, {S.NUMBER_SQL}) THEN TRY_CAST(employees AS DOUBLE) END AS num, TRY_CAST(created AS DATE) AS d FROM contact)
    SELECT id, COALESCE(CASE WHEN id % 2 = 0 THEN d > DATE '2020-01-15' ELSE d < DATE '2020-01-15' END, false) AS date_ok,
      num IS NOT NULL AND CASE id % 4 WHEN 0 THEN num > 0 WHEN 1 THEN num < 0 WHEN 2 THEN isfinite(num) AND num = floor(num) ELSE true END AS number_ok,
      CASE id % 3 WHEN 0 THEN length(COALESCE(name, '')) = 12 WHEN 1 THEN length(COALESCE(name, '')) BETWEEN 16 AND 18 ELSE length(COALESCE(name, '')) >= 1 END AS length_ok,
      CASE id % 4 WHEN 0 THEN regexp_matches(code, '^[a-zA-Z0-9]*$') WHEN 1 THEN regexp_matches(code, '^[a-zA-Z0-9\\s]*$') WHEN 2 THEN upper(code) = code AND lower(code) <> code
        ELSE regexp_matches(code, '^[0-9]{{5}}(-[0-9]{{4}})?$') END AS format_ok,
      CASE WHEN id % 3 = 0 THEN lower(active) IN ('active', 'false') AND lower(active) = 'active' WHEN id % 3 = 1 THEN false ELSE trim(active) <> '' END AS status_ok,
      length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10 AS phone_ok,
      email IS NULL OR trim(email) = '' OR regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}$') AS email_ok, name IS NOT NULL AND trim(name) <> '' AS named FROM x""",
)
def contexts_contact(t):
    c = {n: F.expr(e) for n, e in _CONTEXT.items()}
    return S.contacts(t).select(
        "id",
        rules.date_context(F.col("created"), c["future"], AS_OF).alias("date_ok"),
        rules.number_context(F.col("employees"), c["num"]).alias("number_ok"),
        rules.length_context(F.col("name"), c["len"]).alias("length_ok"),
        rules.format_context(F.col("code"), c["fmt"]).alias("format_ok"),
        rules.status_or_stage(F.col("active"), c["st"]).alias("status_ok"),
        rules.loose_phone(F.col("phone")).alias("phone_ok"),
        rules.loose_email(F.col("email")).alias("email_ok"),
        rules.not_null(F.col("name")).alias("named"),
    )


# --- predicate rules -----------------------------------------------------------------------------

_PREDICATES = [
    ("big_discount", "l_discount > 0.08 AND l_quantity < 5", "true", "l_discount,l_quantity"),
    ("returned_late", "l_returnflag = 'R' AND l_shipdate > TIMESTAMP_NTZ '2000-01-01 00:00:00'", "yes", ""),
    ("off", "l_quantity > 0", "false", ""),
    ("free", "l_extendedprice < 1000", "1", ""),
    ("free", "l_tax = 0.08", "true", ""),
]
_PRED_SQL = {
    "big_discount": "l_discount > 0.08 AND l_quantity < 5",
    "returned_late": "l_returnflag = 'R' AND l_shipdate > TIMESTAMP '2000-01-01 00:00:00'",
    "free": "l_extendedprice < 1000",
    "free_1": "l_tax = 0.08",
}
_PRED_CTE = "WITH p AS (SELECT *, concat_ws('; ', " + ", ".join(f"CASE WHEN {e} THEN '{r}' END" for r, e in _PRED_SQL.items()) + ") AS failed FROM lineitem) "


def _predicates(t):
    return t.spark.createDataFrame(_PREDICATES, "rule_name string, predicate string, active string, field string")


def _checked_lines(t):
    return rules.validate_frame(t.lineitem, _predicates(t))


@query("formula_lineitem", _PRED_CTE + "SELECT l_orderkey, l_linenumber, l_partkey, failed, failed = '' AS is_valid FROM p")
def formula_lineitem(t):
    failed = F.array_join(F.transform("violations", lambda v: v["rule"]), "; ")
    return _checked_lines(t).select("l_orderkey", "l_linenumber", "l_partkey", failed.alias("failed"), "is_valid")


@query(
    "run_summary_lineitem",
    _PRED_CTE + """SELECT count(*) AS total_records, count(*) FILTER (failed = '') AS valid_records, count(*) FILTER (failed <> '') AS invalid_records,
    round(count(*) FILTER (failed = '') * 100.0 / count(*), 6) AS success_rate FROM p""",
)
def run_summary_lineitem(t):
    return rules.run_summary(_checked_lines(t)).withColumn("success_rate", F.round("success_rate", 6))


@query("errors_by_rule_lineitem", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) AS error_count FROM lineitem WHERE {e}" for r, e in _PRED_SQL.items()) + ") WHERE error_count > 0")
def errors_by_rule_lineitem(t):
    return report.errors_by(checks.violations_table(_checked_lines(t), "l_orderkey"), "rule")


_RAISING = {
    # name: (predicate, the same in DuckDB with null for what raises, where it raises)
    "cast": ("CAST(substring(o_orderpriority, 1, o_orderkey % 3) AS INT) >= 4", "TRY_CAST(substring(o_orderpriority, 1, (o_orderkey % 3)::INT) AS INT) >= 4",
             "TRY_CAST(substring(o_orderpriority, 1, (o_orderkey % 3)::INT) AS INT) IS NULL"),
    "division": ("o_totalprice / (o_custkey % 4) > 100000 AND o_orderstatus <> 'F'", "o_totalprice / nullif(o_custkey % 4, 0) > 100000 AND o_orderstatus <> 'F'",
                 "o_custkey % 4 = 0"),
    "lazy": ("CASE WHEN o_custkey % 4 = 0 THEN false ELSE 7 % (o_custkey % 4) = 1 END", "CASE WHEN o_custkey % 4 = 0 THEN false ELSE 7 % (o_custkey % 4) = 1 END", "false"),
    "element": ("split(o_orderpriority, '-')[o_orderkey % 4] = 'LOW'", "(CASE WHEN o_orderkey % 4 < 2 THEN string_split(o_orderpriority, '-')[(o_orderkey % 4 + 1)::INT] END) = 'LOW'",
                "o_orderkey % 4 >= len(string_split(o_orderpriority, '-'))"),
    "date": ("to_date(concat('1996-0', o_orderkey % 12, '-01')) > o_orderdate", "TRY_CAST(concat('1996-0', o_orderkey % 12, '-01') AS DATE) > o_orderdate",
             "TRY_CAST(concat('1996-0', o_orderkey % 12, '-01') AS DATE) IS NULL"),
}


@query(
    "formula_runtime_error",
    "SELECT o_orderkey, concat_ws('; ', " + ", ".join(f"CASE WHEN coalesce({sql}, false) OR ({raised}) THEN '{name}' END" for name, (_, sql, raised) in _RAISING.items()) + ") AS failed FROM orders",
)
def formula_runtime_error(t):
    checked = rules.validate_frame(t.orders, [rules.Rule(name, text) for name, (text, _, _) in _RAISING.items()])
    return checked.select("o_orderkey", F.array_join(F.transform("violations", lambda v: v["rule"]), "; ").alias("failed"))


@query("formula_missing_column", "SELECT count(*) AS total, count(*) AS invalid FROM orders")
def formula_missing_column(t):
    listed = [rules.Rule("gone", "no_such_column > 1", fields=("no_such_column",)), rules.Rule("never", "o_totalprice < 0")]
    return rules.validate_frame(t.orders, listed).agg(F.count("*").alias("total"), F.count_if(~F.col("is_valid")).alias("invalid"))


@query(
    "formula_bad_predicate",
    "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'syntax; function; cheap' ELSE 'syntax; function' END AS failed FROM orders",
)
def formula_bad_predicate(t):
    listed = [rules.Rule("syntax", "o_totalprice ) <"), rules.Rule("function", "no_such_function(o_orderkey)"), rules.Rule("cheap", "o_totalprice < 50000")]
    failed = F.array_join(F.transform("violations", lambda v: v["rule"]), "; ")
    return rules.validate_frame(t.orders, listed).select("o_orderkey", failed.alias("failed"))


# --- thousands of rules ---------------------------------------------------------------------

#: One rule for each kind of part. How many kinds there are does not grow with the table, the parts of a kind do.
_KIND_SQL = """kind AS (SELECT p_brand || '|' || p_type || '|' || p_size AS rule_name, p_size % 5 AS form, min(p_retailprice) AS price,
  min(p_partkey) AS part, upper(substr(p_type, 1, 1)) AS letter FROM part GROUP BY p_brand, p_type, p_size)"""
_HIT_SQL = (
    f"WITH {_KIND_SQL}, line AS MATERIALIZED (SELECT *, row_number() OVER () AS place FROM lineitem), hit AS ("
    "SELECT rule_name, place FROM kind JOIN line ON l_extendedprice < price WHERE form = 0 "
    "UNION ALL SELECT rule_name, place FROM kind JOIN line ON l_partkey = part WHERE form = 1 "
    "UNION ALL SELECT rule_name, place FROM kind JOIN line ON l_extendedprice >= price * 50 WHERE form = 2 "
    "UNION ALL SELECT rule_name, place FROM kind JOIN line ON l_shipdate <= DATE '1992-01-01' + CAST(part % 60 AS INTEGER) WHERE form = 3 "
    "UNION ALL SELECT rule_name, place FROM kind JOIN line ON l_returnflag = letter WHERE form = 4) "
)


def _kind_rules(t):
    kinds = t.part.groupBy("p_brand", "p_type", "p_size").agg(F.min("p_retailprice").alias("price"), F.min("p_partkey").alias("part"))
    return kinds.selectExpr(
        "concat_ws('|', p_brand, p_type, p_size) AS rule_name",
        "element_at(array('l_extendedprice', 'l_partkey', 'l_extendedprice', 'l_shipdate', 'l_returnflag'), p_size % 5 + 1) AS field",
        "element_at(array('<', '=', '>=', '<=', '='), p_size % 5 + 1) AS operator",
        "CASE p_size % 5 WHEN 0 THEN string(price) WHEN 1 THEN string(part) WHEN 2 THEN string(price * 50) "
        "WHEN 3 THEN string(date_add(DATE'1992-01-01', int(part % 60))) ELSE upper(substr(p_type, 1, 1)) END AS constant",
    )


@query(
    "rule_index_rows",
    _HIT_SQL + "SELECT any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber, count(rule_name) AS error_count, "
    "md5(coalesce(string_agg(rule_name, ',' ORDER BY rule_name), '')) AS broken FROM line LEFT JOIN hit USING (place) GROUP BY place",
)
def rule_index_rows(t):
    checked = rule_index.validate_indexed(spread(t.lineitem), _kind_rules(t))
    names = F.array_join("violations.rule", ",")
    return checked.select("l_orderkey", "l_linenumber", F.col("error_count").cast("long").alias("error_count"), F.md5(names).alias("broken"))


@query(
    "rule_index_hits",
    _HIT_SQL + "SELECT rule_name, count(place) AS hits FROM kind LEFT JOIN hit USING (rule_name) GROUP BY ALL",
)
def rule_index_hits(t):
    return rule_index.rule_hits(spread(t.lineitem), _kind_rules(t)).select("rule_name", "hits")


@query(
    "attach_results_orders",
    """SELECT o_orderkey, o_orderkey % 10 <> 0 AND o_custkey % 3 <> 0 AS is_valid, CASE WHEN o_orderkey % 10 <> 0 AND o_custkey % 3 = 0 THEN 'a; b' || o_custkey % 3 ELSE '' END AS validation_errors FROM orders""",
)
def attach_results_orders(t):
    verdicts = t.orders.filter("o_orderkey % 10 <> 0").selectExpr(
        "o_orderkey AS row_id", "o_custkey % 3 <> 0 AS is_valid", "CASE WHEN o_custkey % 3 = 0 THEN array('a', 'b' || o_custkey % 3) ELSE array() END AS errors"
    )
    return rules.attach_results(t.orders.select("o_orderkey"), verdicts, "o_orderkey")


@query(
    "rule_applicability",
    f"WITH {S.RULE_SQL} SELECT count(*) AS total_rules, count(*) FILTER (active) AS active_rules, count(*) FILTER (active AND mapped) AS rules_applied, "
    "count(*) FILTER (active AND NOT mapped) AS rules_skipped FROM rule",
)
def rule_applicability(t):
    return rules.rule_applicability(S.rules(t))


@query(
    "rule_fields",
    f"""WITH {S.RULE_SQL}, w AS (SELECT id, list_filter(regexp_extract_all(formula, '\\b([A-Za-z0-9_]+)\\b', 1), lambda x: NOT regexp_matches(x, '^[0-9]+$')
      AND x NOT IN ('AND', 'OR', 'NOT', 'IF', 'ISBLANK', 'LEN', 'ISPICKVAL', 'TRUE', 'FALSE', 'NULL')) AS names FROM rule)
    SELECT id, array_to_string(list_sort(list_distinct(names)), ',') AS fields FROM w""",
)
def rule_fields(t):
    return S.rules(t).select("id", F.array_join(F.array_sort(rules.rule_fields("formula")), ",").alias("fields"))


@query("rules_flow_lineitem", " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) AS n FROM lineitem WHERE {e} HAVING count(*) > 0" for r, e in _PRED_SQL.items()))
def rules_flow_lineitem(t):
    lines = t.lineitem.withColumn("row_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    return flows.check_rules(lines, _predicates(t), "row_id").violations.groupBy("rule").agg(F.count("*").alias("n"))


# --- grading ----------------------------------------------------------------------------------------

_GRADE_SQL = f"""{S.RULE_SQL}, low AS (SELECT *, lower(rule_name) AS nm, lower(formula) AS fm FROM rule),
k AS (SELECT *, regexp_matches(nm, 'restrict|block|prevent|mandatory|required') AS hi, regexp_matches(nm, 'validate|check|ensure') AS md,
  contains(fm, 'and(') AND contains(fm, 'or(') AS both_of, contains(fm, 'and(') OR contains(fm, 'or(') AS any_of,
  CASE WHEN contains(fm, 'ispickval') THEN 'picklist_validation' WHEN contains(fm, 'isblank') THEN 'required_field' WHEN contains(fm, 'and(') OR contains(fm, 'or(') THEN 'conditional_logic'
    WHEN contains(fm, 'isnew()') THEN 'record_creation' WHEN contains(fm, 'parent.') THEN 'relationship_validation' WHEN regexp_matches(fm, '[<>]|==') THEN 'range_validation'
    ELSE 'business_rule' END AS logic_type FROM low),
sc AS (SELECT *, CASE WHEN hi THEN 3 ELSE 0 END + CASE WHEN md THEN 2 ELSE 0 END + CASE WHEN both_of THEN 2 WHEN any_of THEN 1 ELSE 0 END
  + CASE WHEN contains(fm, 'blank') THEN 2 ELSE 0 END + CASE WHEN contains(fm, 'parent.') THEN 2 ELSE 0 END + CASE WHEN n_fields > 3 THEN 2 WHEN n_fields > 1 THEN 1 ELSE 0 END AS score FROM k),
g AS (SELECT *, CASE WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN hi THEN 'high' WHEN md THEN 'medium' WHEN contains(fm, 'blank') AND contains(fm, 'and(') THEN 'high' ELSE 'low' END AS simple_risk,
  CASE WHEN contains(nm, 'restrict') THEN 'Access Control' WHEN contains(nm, 'wholesaler') THEN 'Distribution Channel Management' WHEN contains(nm, 'status') THEN 'Lifecycle Management'
    WHEN contains(nm, 'parent') THEN 'Hierarchy Validation' WHEN contains(nm, 'billing') THEN 'Financial Data Validation' WHEN contains(nm, 'required') THEN 'Data Completeness'
    ELSE 'General Business Rule' END AS scenario,
  CASE WHEN contains(fm, 'and(') THEN 2 ELSE 0 END + CASE WHEN contains(fm, 'or(') THEN 2 ELSE 0 END + CASE WHEN contains(fm, 'if(') THEN 3 ELSE 0 END
  + CASE WHEN contains(fm, 'ispickval') THEN 1 ELSE 0 END + CASE WHEN contains(fm, 'isblank') THEN 1 ELSE 0 END + CASE WHEN contains(fm, 'parent.') THEN 3 ELSE 0 END + n_fields AS complexity FROM sc),
im AS (SELECT *, CASE WHEN hi THEN 'high' WHEN md THEN 'medium' WHEN risk_level = 'high' THEN 'high' ELSE 'low' END AS impact FROM g),
graded AS (SELECT *, CASE impact WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END + CASE risk_level WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END
  + CASE WHEN complexity >= 10 THEN 3 WHEN complexity >= 6 THEN 2 ELSE 1 END AS total FROM im)
"""


def _graded(t):
    return coverage.grade_rules(S.rules(t))


@query(
    "grade_rules",
    f"""WITH {_GRADE_SQL} SELECT id, logic_type, risk_level, simple_risk, scenario, impact, complexity,
    CASE WHEN total >= 8 THEN 'Highly Effective' WHEN total >= 6 THEN 'Effective' WHEN total >= 4 THEN 'Moderately Effective' ELSE 'Limited Effectiveness' END AS effectiveness FROM graded""",
)
def grade_rules(t):
    return _graded(t).select("id", "logic_type", "risk_level", "simple_risk", "scenario", "impact", "complexity", "effectiveness")


_LISTED = "names(i, field) AS (VALUES (1, 'Name'), (2, 'Phone'), (3, 'Size'), (4, 'Type'))"


@query(
    "rule_patterns",
    f"""WITH {_GRADE_SQL}, {_LISTED} SELECT CASE logic_type WHEN 'picklist_validation' THEN 'picklist_field' WHEN 'required_field' THEN 'required_field'
    WHEN 'conditional_logic' THEN 'conditional_dependency' ELSE 'business_constraint' END AS pattern, field, count(*) AS rules FROM graded JOIN names ON i <= n_fields
    WHERE logic_type IN ('picklist_validation', 'required_field', 'conditional_logic', 'business_rule') GROUP BY 1, 2""",
)
def rule_patterns(t):
    return coverage.rule_patterns(_graded(t))


@query(
    "rule_pattern_members",
    f"""WITH {_GRADE_SQL}, {_LISTED} SELECT CASE logic_type WHEN 'picklist_validation' THEN 'picklist_field' WHEN 'required_field' THEN 'required_field'
    WHEN 'conditional_logic' THEN 'conditional_dependency' ELSE 'business_constraint' END AS pattern, field, rule_name FROM graded JOIN names ON i <= n_fields
    WHERE logic_type IN ('picklist_validation', 'required_field', 'conditional_logic', 'business_rule')""",
)
def rule_pattern_members(t):
    return coverage.rule_pattern_members(_graded(t))


@query(
    "risk_areas",
    f"""WITH {_GRADE_SQL}, a AS (SELECT id, rule_name, concat_ws(',', CASE WHEN contains(nm, 'restrict') OR contains(nm, 'required') THEN 'Data access restriction' END,
      CASE WHEN contains(fm, 'blank') AND n_fields > 1 THEN 'Multiple field dependency' END, CASE WHEN both_of THEN 'Complex conditional logic' END,
      CASE WHEN contains(fm, 'parent.') THEN 'Cross-object validation' END, CASE WHEN n_fields > 3 THEN 'Multiple field validation' END) AS factors FROM graded WHERE risk_level = 'high')
    SELECT rule_name, factors FROM a WHERE factors <> ''""",
)
def risk_areas(t):
    return coverage.risk_areas(_graded(t)).select("rule_name", F.array_join("risk_factors", ",").alias("factors"))


# --- coverage -----------------------------------------------------------------------------------------

_COVER = f"WITH {_GRADE_SQL}, {S.TEST_SQL}"


@query(
    "coverage_rules",
    _COVER + """, x AS (SELECT (SELECT count(DISTINCT rule_name) FROM graded) AS n, (SELECT count(DISTINCT rule_name) FROM test) AS m,
      (SELECT count(DISTINCT rule_name) FROM graded WHERE rule_name IN (SELECT rule_name FROM test)) AS c)
    SELECT n AS total_rules, m AS tested_rules, c AS covered_rules, round(c * 100.0 / greatest(n, 1), 6) AS coverage_percentage,
    CASE WHEN c * 100.0 / n >= 90 THEN 'Excellent' WHEN c * 100.0 / n >= 75 THEN 'Good' WHEN c * 100.0 / n >= 60 THEN 'Adequate' WHEN c * 100.0 / n >= 40 THEN 'Limited' ELSE 'Poor' END AS coverage_level FROM x""",
)
def coverage_rules(t):
    return coverage.rule_coverage(S.tests(t), S.rules(t)).withColumn("coverage_percentage", F.round("coverage_percentage", 6))


@query("uncovered_rules", _COVER + " SELECT DISTINCT rule_name FROM graded WHERE rule_name NOT IN (SELECT rule_name FROM test WHERE rule_name IS NOT NULL)")
def uncovered_rules(t):
    return coverage.uncovered_rules(S.tests(t), S.rules(t))


@query(
    "gaps_rules",
    _COVER + """, s AS (SELECT count(*) FILTER (test_type = 'positive' OR contains(test_id, 'POS_')) AS p, count(*) FILTER (test_type = 'negative' OR contains(test_id, 'NEG_')) AS n,
      count(*) FILTER (contains(lower(test_category), 'edge') OR contains(test_id, 'EDGE_')) AS e, (SELECT count(*) FROM graded) AS r FROM test)
    SELECT 'missing_validation_test' AS gap_type, rule_name, risk_level, impact AS business_impact, CASE WHEN risk_level = 'high' THEN 'high' ELSE 'medium' END AS priority FROM graded
      WHERE rule_name NOT IN (SELECT rule_name FROM test WHERE rule_name IS NOT NULL)
    UNION ALL SELECT 'insufficient_negative_tests', 'general', 'medium', 'medium', 'medium' FROM s WHERE p > n * 2
    UNION ALL SELECT 'insufficient_edge_cases', 'general', 'low', 'medium', 'low' FROM s WHERE e < r * 0.5""",
)
def gaps_rules(t):
    return coverage.coverage_gaps(S.tests(t), _graded(t))


_ALIGN = """, x AS (SELECT (SELECT count(DISTINCT rule_name) FROM graded)::DOUBLE AS n, (SELECT count(DISTINCT rule_name) FROM graded WHERE rule_name IN (SELECT rule_name FROM test)) AS c,
  (SELECT count(*) FROM graded WHERE risk_level = 'high') AS hr, (SELECT count(*) FROM test WHERE risk_level = 'high') AS ht, (SELECT count(DISTINCT scenario) FROM graded)::DOUBLE AS sr,
  (SELECT count(DISTINCT scenario) FROM graded WHERE scenario IN (SELECT scenario FROM test)) AS sb),
  y AS (SELECT c / greatest(n, 1) AS a, least(ht / greatest(hr, 1)::DOUBLE, 1.0) AS b, sb / greatest(sr, 1) AS d FROM x)"""


@query(
    "alignment_rules",
    _COVER + _ALIGN + " SELECT round(a, 6) AS coverage_score, round(b, 6) AS risk_score, round(d, 6) AS scenario_score, round(least((a * 0.5 + b * 0.3 + d * 0.2) * 100, 100.0), 6) AS alignment_score FROM y",
)
def alignment_rules(t):
    out = coverage.alignment_score(S.tests(t), _graded(t))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_RESULTS = "CASE WHEN o_orderkey % 3 = 0 THEN 'fail' WHEN o_orderkey % 3 = 1 THEN 'Pass' ELSE 'PASS' END"


@query(
    "suite_overview",
    f"WITH r AS (SELECT o_orderpriority AS suite, {_RESULTS} AS status FROM orders) SELECT suite, count(*) AS total_tests, count(*) FILTER (upper(status) = 'PASS') AS passed, "
    "count(*) FILTER (upper(status) <> 'PASS') AS failed, round(count(*) FILTER (upper(status) = 'PASS') * 100.0 / count(*), 6) AS pass_rate FROM r GROUP BY suite",
)
def suite_overview(t):
    out = coverage.suite_overview(t.orders.selectExpr("o_orderpriority AS suite", f"{_RESULTS} AS status"))
    return out.withColumn("pass_rate", F.round("pass_rate", 6))


@query(
    "suite_totals",
    f"WITH r AS (SELECT o_orderpriority AS suite, {_RESULTS} AS status FROM orders) SELECT count(DISTINCT suite) AS total_suites, count(*) AS total_tests, count(*) FILTER (upper(status) = 'PASS') AS passed, "
    "count(*) FILTER (upper(status) <> 'PASS') AS failed, round(count(*) FILTER (upper(status) = 'PASS') * 100.0 / count(*), 6) AS pass_rate FROM r",
)
def suite_totals(t):
    out = coverage.suite_totals(t.orders.selectExpr("o_orderpriority AS suite", f"{_RESULTS} AS status"))
    return out.withColumn("pass_rate", F.round("pass_rate", 6))


@query(
    "suite_quality",
    _COVER + """, x AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (rule_name IS NOT NULL) AS v, count(*) FILTER (scenario IS NOT NULL) AS b, count(*) FILTER (risk_level = 'high') AS h,
      count(*) FILTER (pattern_type IS NOT NULL) AS p, count(*) FILTER (enhanced) AS e, count(DISTINCT rule_name) AS tn, (SELECT count(*) FROM graded)::DOUBLE AS r,
      (SELECT count(*) FROM graded WHERE risk_level = 'high')::DOUBLE AS hr FROM test),
    y AS (SELECT *, tn * 100 / r AS cov, least(b * 100 / r, 100.0) AS bus, least(h * 100 / hr, 100.0) AS risk FROM x)
    SELECT CAST(n AS BIGINT) AS total_tests, v AS validation_tests, p AS pattern_tests, h AS high_risk_tests, e AS enhanced_tests, round(cov, 6) AS validation_coverage, round(bus, 6) AS business_coverage,
      round(risk, 6) AS risk_coverage, round(least(least(n / greatest(r, 5) * 25, 25.0) + cov * 0.3 + least(p / n * 20, 20.0) + least(bus * 0.15, 15.0) + least(e / n * 10, 10.0), 100.0), 6) AS quality_score,
      CASE WHEN e > 0 AND v > 0 AND p > 0 THEN 'High' WHEN e > 0 AND (v > 0 OR p > 0) THEN 'Medium' WHEN e > 0 THEN 'Basic' ELSE 'Low' END AS integration_level FROM y""",
)
def suite_quality(t):
    out = coverage.suite_quality(S.tests(t), _graded(t))
    return out.withColumns({c: F.round(c, 6) for c in ("validation_coverage", "business_coverage", "risk_coverage", "quality_score")})


# --- logs ------------------------------------------------------------------------------------------------

_ENTRY_SQL = f"""WITH {S.LOG_SQL}, entry AS (SELECT timestamp, event_id, CASE WHEN error_rate > 50 THEN 'ERROR' WHEN error_rate > 10 THEN 'WARNING' ELSE 'INFO' END AS level,
  CASE WHEN contains(file_path, 'processing_summary') OR contains(file_path, 'batch_processing') THEN 'Data Operations' ELSE 'Mapping' END AS source,
  CASE WHEN contains(file_path, 'dataload/') THEN 'Data Loader' WHEN contains(file_path, '/validation/') THEN 'Validation' WHEN contains(file_path, '/mapping/') THEN 'Mapping'
    WHEN contains(file_path, '/unit/') THEN 'Unit Testing' ELSE 'System' END AS module,
  CASE WHEN contains(file_path, 'processing_summary') THEN 'Processed ' || records || ' records: ' || success || ' success, ' || errors || ' errors'
    ELSE 'Batch ' || batch_number || ': ' || success || ' success, ' || errors || ' errors' END AS message,
  'Unknown' AS operation, COALESCE(object, 'Unknown') AS object, 'Unknown' AS org, file_path FROM log)
"""


def _entries(t):
    return logs.log_entries(S.log_rows(t))


@query("log_entries_events", _ENTRY_SQL + "SELECT * EXCLUDE (event_id) FROM entry")
def log_entries_events(t):
    return _entries(t)


@query("log_entries_filtered", _ENTRY_SQL + "SELECT message FROM entry WHERE source = 'Data Operations' AND level = 'ERROR'")
def log_entries_filtered(t):
    return logs.log_entries(S.log_rows(t), source="Data Operations", level="ERROR").select("message")


@query("logs_top", _ENTRY_SQL + "SELECT timestamp, message FROM entry ORDER BY timestamp DESC, message LIMIT 200")
def logs_top(t):
    return logs.recent_logs(_entries(t), 200, ["message"]).select("timestamp", "message")


@query(
    "log_counts_events",
    _ENTRY_SQL + "SELECT count(*) AS total_entries, count(*) FILTER (level = 'INFO') AS info, count(*) FILTER (level = 'WARNING') AS warning, count(*) FILTER (level = 'ERROR') AS error FROM entry",
)
def log_counts_events(t):
    return logs.log_counts(_entries(t))


_SEVERITY = "CASE WHEN value > 40 THEN 'High' WHEN value > 10 THEN 'Medium' ELSE 'Low' END"


@query(
    "error_severity_events",
    f"WITH e AS (SELECT {_SEVERITY} AS s FROM events) SELECT count(*) AS total_errors, count(*) FILTER (s = 'High') AS high_severity, count(*) FILTER (s = 'Medium') AS medium_severity, "
    "count(*) FILTER (s = 'Low') AS low_severity FROM e",
)
def error_severity_events(t):
    return logs.error_severity(t.events.selectExpr(f"{_SEVERITY} AS severity"))


@query("errors_by_type_events", "SELECT CASE WHEN event_type = 'view' THEN 'Unknown' ELSE event_type END AS error_type, count(*) AS errors FROM events GROUP BY 1")
def errors_by_type_events(t):
    return logs.errors_by_type(t.events.selectExpr("CASE WHEN event_type <> 'view' THEN event_type END AS error_type"))


# --- order and sets -----------------------------------------------------------------------------------------


def _ranked(t):
    return t.part.selectExpr("p_partkey AS position", "p_name AS rule_name", "CASE WHEN p_size % 5 = 0 THEN 'high' WHEN p_size % 3 = 0 THEN 'medium' ELSE 'low' END AS risk_level")


_RANKED = "WITH r AS (SELECT p_partkey AS position, CASE WHEN p_size % 5 = 0 THEN 'high' WHEN p_size % 3 = 0 THEN 'medium' ELSE 'low' END AS risk_level FROM part) "


@query("prioritize_parts", _RANKED + "SELECT position, risk_level, row_number() OVER (PARTITION BY risk_level ORDER BY position) AS turn FROM r")
def prioritize_parts(t):
    return report.round_robin(_ranked(t), "risk_level", "position").select("position", "risk_level", "turn")


def _placed(ordered):
    """The rows with their place (from 0) in the order that they come in."""
    numbered = load.assign_batches(ordered.withColumn("_came", F.monotonically_increasing_id()), ["_came"], 1)
    return numbered.select("position", "risk_level", F.col("row_index").alias("place"))


_RISK_SQL = "CASE risk_level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"


@query(
    "prioritize_balanced",
    _RANKED + f", turns AS (SELECT *, row_number() OVER (PARTITION BY risk_level ORDER BY position) AS turn FROM r) "
    f"SELECT position, risk_level, row_number() OVER (ORDER BY turn, {_RISK_SQL}) - 1 AS place FROM turns",
)
def prioritize_balanced(t):
    return _placed(report.prioritize(_ranked(t), "balanced", "position"))


@query("prioritize_high_first", _RANKED + f"SELECT position, risk_level, row_number() OVER (ORDER BY {_RISK_SQL}, position) - 1 AS place FROM r")
def prioritize_high_first(t):
    return _placed(report.prioritize(_ranked(t), "high_first", "position"))


@query("focus_high", f"WITH {_GRADE_SQL} SELECT id FROM graded WHERE risk_level = 'high'")
def focus_high(t):
    return report.focus(_graded(t), "high").select("id")


@query(
    "focus_top",
    f"WITH {_GRADE_SQL} SELECT id FROM (SELECT id, rule_name FROM graded ORDER BY CASE risk_level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, n_fields DESC, rule_name LIMIT 7)",
)
def focus_top(t):
    return report.focus(_graded(t), "top").select("id")


@query(
    "beyond_first_orders",
    "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n > 1",
)
def beyond_first_orders(t):
    return report.beyond_first(t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@query(
    "beyond_first_ties",
    """WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, n) AS k FROM (SELECT *, row_number() OVER () AS n FROM orders))
    SELECT o_custkey, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM r WHERE k > 1 GROUP BY o_custkey""",
)
def beyond_first_ties(t):
    """Rows of a customer after the first by status alone: among equal ones the place in the table decides."""
    later = report.beyond_first(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_custkey"], ["o_orderstatus"])
    return later.groupBy("o_custkey").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


@query("names_in_both", "SELECT p_name AS name FROM part WHERE p_size > 25 INTERSECT SELECT p_name FROM part WHERE p_size <= 25")
def names_in_both(t):
    return report.in_both(t.part.filter("p_size > 25").selectExpr("p_name AS name"), t.part.filter("p_size <= 25").selectExpr("p_name AS name"))


@query("names_only_first", "SELECT CAST(p_partkey AS VARCHAR) AS name FROM part EXCEPT SELECT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_quantity > 45")
def names_only_first(t):
    sold = t.lineitem.filter("l_quantity > 45").selectExpr("CAST(l_partkey AS STRING) AS name")
    return report.only_in_first(t.part.selectExpr("CAST(p_partkey AS STRING) AS name"), sold)
