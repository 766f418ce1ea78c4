"""Registered queries: catalogue checks, cleaning and rule functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.functions import formula as X
from siftline.functions import values
from siftline.operators import catalog as cat_ops
from siftline.operators import checks, cleaning, report
from siftline.plans import samples as S
from siftline.plans.registry import query

C_SQL = "WITH " + S.CONTACT_SQL + " "


def _flag_sql(*wanted: tuple[str, str]) -> str:
    found = {(r, f): e for r, f, e in S.CONTACT_CHECKS}
    cols = ", ".join(f"COALESCE({found[w]}, false) AS {w[0]}_{w[1]}" for w in wanted)
    return f"{C_SQL} SELECT id, {cols} FROM contact"


def _flags(t, wanted: list[tuple[str, str]]):
    df = S.contacts(t)
    specs = {f["name"]: f for f in S.CONTACT_FIELDS}
    ready, cells = values.prepared_cells(df, sorted({f for _, f in wanted}))
    out = []
    for rule, name in wanted:
        spec = specs[name]
        field = checks.Field(
            name, spec["type"], spec.get("length"), spec.get("nillable", True), False,
            tuple(v for v, on in spec.get("picklist", []) if on),
        )
        check = next(c for c in checks.field_checks(cells[name], field) if c.rule == rule)
        out.append(F.coalesce(check.failed, F.lit(False)).alias(f"{rule}_{name}"))
    return ready.select("id", *out)


def _register_flags(name: str, *wanted: tuple[str, str]) -> None:
    query(name, _flag_sql(*wanted))(lambda t: _flags(t, list(wanted)))


_register_flags("check_required", ("required", "name"), ("required", "email"))
_register_flags("check_type_int", ("type_int", "employees"))
_register_flags("check_type_number", ("type_number", "revenue"), ("type_number", "rate"))
_register_flags("check_type_boolean", ("type_boolean", "active"))
_register_flags("check_type_date", ("type_date", "created"))
_register_flags("check_email", ("type_email", "email"), ("format_email", "email"))
_register_flags("check_phone", ("type_phone", "phone"))
_register_flags("check_url", ("type_url", "website"))
_register_flags("check_suspicious_numeric_text", ("suspicious_numeric_text", "street"), ("suspicious_numeric_text", "note"))
_register_flags("check_record_id", ("record_id", "owner"))
_register_flags("check_currency_format", ("format_currency", "revenue"))
_register_flags("check_percent_format", ("format_percent", "rate"))
_register_flags("check_max_length", ("max_length", "name"), ("max_length", "email"))
_register_flags("check_picklist", ("picklist", "segment"))


@query(
    "check_email_lenient",
    C_SQL + r"""SELECT id FROM contact WHERE email <> '' AND lower(trim(email)) NOT IN ('true', 'false', '')
    AND NOT regexp_matches(trim(email), '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$')""",
)
def check_email_lenient(t):
    df = S.contacts(t)
    c = values.cell(df, "email")
    return df.filter(~values.blank(c.value, trim=False) & checks.bad_email_lenient(c)).select("id")


@query(
    "check_type_length",
    "SELECT doc_id FROM documents WHERE length(text) > 32768",
)
def check_type_length(t):
    from siftline.functions import fixed

    df = t.documents
    return df.filter(checks.too_long(values.cell(df, "text"), fixed.TYPE_LENGTHS["textarea"])).select("doc_id")


@query(
    "check_picklist_large",
    "SELECT l_orderkey, l_linenumber, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AS listed FROM lineitem",
)
def check_picklist_large(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    allowed = t.part.filter("p_size > 25").select(F.col("p_partkey").cast("string").alias("value"))
    return checks.picklist_member(lines, "l_partkey", allowed, "listed").drop("l_partkey")


def _part_picklist(t):
    """A catalogue with one picklist, of all parts with a size above 25: thousands of values at any scale but the least."""
    fields = cat_ops.catalog_rows(t.spark, [dict(object="Line", name="part", type="picklist")])
    listed = t.part.filter("p_size > 25").agg(
        F.collect_list(F.struct(F.concat(F.lit("P"), "p_partkey").alias("value"), F.lit(True).alias("active"))).alias("picklist")
    )
    return fields.drop("picklist").crossJoin(listed).select(*fields.columns)


_PICKED = "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AS listed FROM lineitem"


@query(
    "validate_picklist_large",
    f"""SELECT l_orderkey, l_linenumber, listed AS is_valid, CASE WHEN listed THEN '' ELSE
    'Invalid picklist value in field ''picked'' (mapped to ''part''): P' || l_partkey END AS message FROM ({_PICKED})""",
)
def validate_picklist_large(t):
    lines = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "'P' || l_partkey AS picked")
    checked = checks.validate_schema(lines, _part_picklist(t), {"picked": "part"})
    message = F.array_join(F.transform("violations", lambda v: v["message"]), "; ")
    return checked.select("l_orderkey", "l_linenumber", "is_valid", message.alias("message"))


@query(
    "issues_picklist_large",
    f"SELECT l_orderkey, l_linenumber, CASE WHEN listed THEN '' ELSE 'Invalid picklist value in ''part''' END AS \"Issues\" FROM ({_PICKED})",
)
def issues_picklist_large(t):
    lines = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "' P' || l_partkey || ' ' AS part")
    return checks.issues_column(lines, _part_picklist(t)).select("l_orderkey", "l_linenumber", "Issues")


@query(
    "unique_part_name",
    "SELECT * FROM (SELECT p_partkey AS row_id, 'p_name' AS field, p_name AS value, count(*) OVER (PARTITION BY p_name) AS rows "
    "FROM part) WHERE rows > 1",
)
def unique_part_name(t):
    return checks.unique_violations(t.part, "p_partkey", ["p_name"])


@query(
    "unique_contact_fields",
    C_SQL + """, long AS (SELECT id, 'code' AS field, code AS value FROM contact UNION ALL
    SELECT id, 'name', name FROM contact UNION ALL SELECT id, 'website', website FROM contact)
    SELECT id AS row_id, field, value, rows FROM (SELECT *, count(*) OVER (PARTITION BY field, value) AS rows FROM long
    WHERE trim(value) <> '') WHERE rows > 1""",
)
def unique_contact_fields(t):
    return checks.unique_violations(S.contacts(t), "id", ["code", "name", "website"])


@query(
    "unique_document_text",
    "SELECT * FROM (SELECT doc_id AS row_id, count(*) OVER (PARTITION BY text) AS rows FROM documents) WHERE rows > 1",
)
def unique_document_text(t):
    return checks.unique_violations(t.documents, "doc_id", ["text"]).select("row_id", "rows")


@query(
    "unknown_columns_part",
    f"WITH {S.CATALOG_SQL} SELECT col AS \"column\" FROM (VALUES ('Created2'), ('Created3'), ('Created5'), ('nowhere')) v(col) WHERE col NOT IN (SELECT name FROM catalog)",
)
def unknown_columns_part(t):
    return checks.unknown_columns(["Created2", "Created3", "Created5", "nowhere"], S.catalog(t))


def _all_checks_sql() -> str:
    count = " + ".join(f"CASE WHEN {e} THEN 1 ELSE 0 END" for _, _, e in S.CONTACT_CHECKS)
    names = ", ".join(f"CASE WHEN {e} THEN '{r}:{f}' END" for r, f, e in S.CONTACT_CHECKS)
    return (
        f"{C_SQL}, checked AS (SELECT id, {count} AS error_count, list_sort(list_filter([{names}], lambda x: x IS NOT NULL)) AS rules "
        "FROM contact) SELECT id, error_count, error_count = 0 AS is_valid, array_to_string(rules, ',') AS rules FROM checked"
    )


def _checked_contacts(t, **kw):
    return checks.validate_schema(S.contacts(t), S.contact_catalog(t), **kw)


@query("validate_schema_contact", _all_checks_sql())
def validate_schema_contact(t):
    names = F.array_sort(F.transform("violations", lambda v: F.concat(v["rule"], F.lit(":"), v["field"])))
    return _checked_contacts(t).select("id", "error_count", "is_valid", F.array_join(names, ",").alias("rules"))


@query(
    "validate_schema_unique_fails",
    C_SQL + "SELECT id, count(*) OVER (PARTITION BY code) > 1 AND trim(code) <> '' AS repeated FROM contact",
)
def validate_schema_unique_fails(t):
    off = checks.Switches(False, False, False, False, False)
    return _checked_contacts(t, switches=off, unique_fails_row=True).select("id", (~F.col("is_valid")).alias("repeated"))


def _violations_sql() -> str:
    return C_SQL + ", violation AS (" + " UNION ALL ".join(
        f"SELECT id AS row_id, '{r}' AS rule, '{f}' AS field FROM contact WHERE {e}" for r, f, e in S.CONTACT_CHECKS
    ) + ") "


@query("violations_contact", _violations_sql() + "SELECT row_id, rule, field FROM violation")
def violations_contact(t):
    return checks.violations_table(_checked_contacts(t), "id").select("row_id", "rule", "field")


@query(
    "issues_contact",
    C_SQL + r""", d AS (SELECT *, count(*) OVER (PARTITION BY code) AS n FROM contact)
    SELECT id, concat_ws('; ',
      CASE WHEN name IS NULL OR name = '' THEN 'Required field ''name'' data is missing' END,
      CASE WHEN email = '' THEN 'Required field ''email'' data is missing' END,
      CASE WHEN email <> '' AND lower(trim(email)) NOT IN ('true', 'false', '')
        AND NOT regexp_matches(trim(email), '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') THEN 'Invalid email format in ''email''' END,
      CASE WHEN n > 1 THEN 'Duplicate value in unique field ''code''' END,
      CASE WHEN trim(segment) NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'Invalid picklist value in ''segment''' END) AS Issues
    FROM d""",
)
def issues_contact(t):
    return checks.issues_column(S.contacts(t), S.contact_catalog(t)).select("id", "Issues")


@query(
    "required_issues_contact",
    C_SQL + """SELECT name, email, CASE WHEN name IS NULL OR name = '' THEN 'missing name' ELSE 'ok' END AS state FROM contact""",
)
def required_issues_contact(t):
    cat = S.contact_catalog(t)
    out = checks.required_issues(checks.issues_column(S.contacts(t), cat), cat)
    state = F.when(F.col("Issues").contains("'name' data is missing"), "missing name").otherwise("ok")
    return out.select("name", "email", state.alias("state"))


# --- reports on checked frames -----------------------------------------------------------


@query(
    "error_report_contact",
    _violations_sql() + """, per AS (SELECT field, count(*) AS n FROM violation GROUP BY field),
    bad AS (SELECT count(DISTINCT row_id) AS n FROM violation), total AS (SELECT count(*) AS n FROM contact),
    s AS (SELECT (SELECT n FROM total) AS total_records, (SELECT n FROM total) - (SELECT n FROM bad) AS passed_records,
      (SELECT n FROM bad) AS failed_records, (SELECT count(*) FROM violation) AS total_errors, (SELECT count(*) FROM per) AS fields_with_issues,
      (SELECT field FROM per ORDER BY n DESC, field LIMIT 1) AS worst_field)
    SELECT total_records, passed_records, failed_records, total_errors, fields_with_issues,
      round(passed_records * 100.0 / total_records, 4) AS success_rate, round(100.0 - passed_records * 100.0 / total_records, 4) AS failure_rate,
      round(total_errors * 1.0 / total_records, 4) AS errors_per_record, worst_field,
      CASE WHEN passed_records * 100.0 / total_records >= 95 THEN 'Excellent' WHEN passed_records * 100.0 / total_records >= 80 THEN 'Good'
        WHEN passed_records * 100.0 / total_records >= 60 THEN 'Fair' ELSE 'Poor' END AS quality FROM s""",
)
def error_report_contact(t):
    return report.error_report(_checked_contacts(t))


_CATEGORY_SQL = """CASE WHEN rule = 'required' THEN 'Required Field Errors'
  WHEN rule IN ('type_email', 'type_phone', 'type_date', 'type_url', 'format_email', 'format_phone', 'format_date', 'format_url') THEN 'Format Errors'
  WHEN rule IN ('type_int', 'type_number', 'type_boolean') THEN 'Data Type Errors' WHEN rule = 'max_length' THEN 'Length Errors'
  WHEN rule = 'picklist' THEN 'Picklist Errors' ELSE 'Other Errors' END"""


@query(
    "errors_by_category",
    _violations_sql() + f"SELECT {_CATEGORY_SQL} AS category, count(*) AS error_count FROM violation GROUP BY 1",
)
def errors_by_category(t):
    return report.errors_by(checks.violations_table(_checked_contacts(t), "id"), "category")


@query(
    "errors_by_field",
    _violations_sql() + "SELECT field, count(*) AS error_count, round(count(*) * 100.0 / (SELECT count(*) FROM contact), 2) AS error_rate "
    "FROM violation GROUP BY field",
)
def errors_by_field(t):
    total = t.customer.count()
    return report.errors_by(checks.violations_table(_checked_contacts(t), "id"), "field", total)


@query(
    "sample_messages_by_field",
    _violations_sql() + """, m AS (SELECT v.*, CASE WHEN v.rule = 'type_boolean' THEN 'Invalid boolean value in field ''active'': ' || c.active
      ELSE 'Invalid picklist value in field ''segment'': ' || c.segment END AS message FROM violation v JOIN contact c ON c.id = v.row_id
      WHERE v.field IN ('active', 'segment')), r AS (SELECT field, message, row_number() OVER (PARTITION BY field ORDER BY message, row_id) AS position FROM m)
    SELECT field, position, message FROM r WHERE position <= 3""",
)
def sample_messages_by_field(t):
    found = checks.violations_table(_checked_contacts(t), "id").filter(F.col("field").isin("active", "segment"))
    return report.sample_messages(found, "field").withColumn("position", F.col("position").cast("long"))


@query(
    "status_contact",
    _violations_sql() + "SELECT id, CASE WHEN id IN (SELECT row_id FROM violation) THEN 'FAILED' ELSE 'PASSED' END AS Validation_Status FROM contact",
)
def status_contact(t):
    return report.status_column(_checked_contacts(t)).select("id", "Validation_Status")


# --- cleaning --------------------------------------------------------------------------------

_DIRTY = {
    "label": "CASE WHEN l_linenumber = 1 THEN ' ' || l_returnflag || ' ' WHEN l_linenumber = 2 THEN ' NaN ' WHEN l_linenumber = 3 THEN '' ELSE l_linestatus END",
    "amount": "CASE WHEN l_linenumber = 4 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 5 THEN CAST('Infinity' AS DOUBLE) ELSE l_quantity END",
    "flag": "CASE l_linenumber WHEN 1 THEN 'Yes' WHEN 2 THEN ' t ' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' WHEN 5 THEN 'N' ELSE NULL END",
    "number_flag": "l_linenumber % 3",
}
_DIRTY_SQL = "WITH dirty AS (SELECT l_orderkey, l_linenumber, l_shipdate, " + ", ".join(f"{e} AS {n}" for n, e in _DIRTY.items()) + " FROM lineitem) "


def _dirty(t):
    return t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_shipdate", *[f"{e} AS {n}" for n, e in _DIRTY.items()])


@query(
    "clean_lineitem",
    _DIRTY_SQL + """SELECT l_orderkey, l_linenumber, CASE WHEN lower(trim(label)) IN ('nan', '') THEN NULL ELSE trim(label) END AS label,
    CASE WHEN isfinite(amount) THEN amount END AS amount, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS l_shipdate FROM dirty""",
)
def clean_lineitem(t):
    return cleaning.clean_values(_dirty(t).drop("flag", "number_flag"))


@query(
    "clean_nested_events",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS kind,
    CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'u' || user_id END AS tag FROM events""",
)
def clean_nested_events(t):
    nested = t.events.selectExpr(
        "event_id",
        "struct(CASE WHEN event_type = 'view' THEN ' nan ' ELSE event_type END AS kind, "
        "array(CASE WHEN user_id % 2 = 0 THEN '' ELSE ' u' || user_id END) AS tags) AS body",
    )
    return cleaning.clean_values(nested).selectExpr("event_id", "body.kind AS kind", "body.tags[0] AS tag")


@query(
    "coerce_bool_lineitem",
    _DIRTY_SQL + """SELECT l_orderkey, l_linenumber, CASE WHEN lower(trim(flag)) IN ('1', 'true', 'yes', 'y', 't') THEN true
    WHEN lower(trim(flag)) IN ('0', 'false', 'no', 'n', 'f') THEN false END AS flag,
    CASE WHEN number_flag = 1 THEN true WHEN number_flag = 0 THEN false END AS number_flag FROM dirty""",
)
def coerce_bool_lineitem(t):
    return cleaning.coerce_bool(_dirty(t), ["flag", "number_flag"]).select("l_orderkey", "l_linenumber", "flag", "number_flag")


@query(
    "json_compliance_lineitem",
    _DIRTY_SQL + "SELECT 'amount' AS \"column\", count(*) AS bad_cells FROM dirty WHERE NOT isfinite(amount) HAVING count(*) > 0",
)
def json_compliance_lineitem(t):
    return cleaning.json_compliance(_dirty(t))


@query(
    "fill_required_contact",
    C_SQL + "SELECT id, COALESCE(name, '') AS name, email, CASE WHEN id % 5 = 0 THEN 0 ELSE id END AS score, "
    "CASE WHEN id % 3 = 0 THEN false ELSE true END AS checked, CASE WHEN id % 4 = 0 THEN NULL ELSE 'x' END AS free FROM contact",
)
def fill_required_contact(t):
    df = S.contacts(t).selectExpr(
        "id", "name", "email", "CASE WHEN id % 5 <> 0 THEN id END AS score", "CASE WHEN id % 3 <> 0 THEN true END AS checked",
        "CASE WHEN id % 4 <> 0 THEN 'x' END AS free",
    )
    return cleaning.fill_required(df, ["free"])


# --- rule functions ----------------------------------------------------------------------------


@query(
    "functions_text",
    """SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, length(p_name) AS len, p_name[1:3] AS lft, right(p_name, 4) AS rgt,
    substring(p_name, 3, 4) AS md, instr(p_name, 'bolt') AS pos, contains(p_name, 'red') AS has_red, starts_with(p_name, 'blue') AS begins,
    ends_with(p_name, 'ring') AS ends, trim(' ' || p_name || ' ') AS trimmed, p_type = 'PROMO' AS pick, regexp_matches(p_name, '^(?:s.*g|blue)') AS rx,
    length(p_name) > 9 AS long_name FROM part""",
)
def functions_text(t):
    n = F.col("p_name")
    return t.part.select(
        "p_partkey", X.UPPER(n).alias("up"), X.LOWER("p_type").alias("low"), X.LEN(n).cast("long").alias("len"),
        X.LEFT(n, 3).alias("lft"), X.RIGHT(n, 4).alias("rgt"), X.MID(n, 3, 4).alias("md"), X.FIND("bolt", n).cast("long").alias("pos"),
        X.CONTAINS(n, "red").alias("has_red"), X.BEGINS(n, "blue").alias("begins"), X.ENDS(n, "ring").alias("ends"),
        X.TRIM(F.concat(F.lit(" "), n, F.lit(" "))).alias("trimmed"), X.ISPICKVAL("p_type", "PROMO").alias("pick"),
        X.REGEX(n, "s.*g|blue").alias("rx"), X.LEN_COMPARE(n, ">", 9).alias("long_name"),
    )


@query(
    "functions_number",
    """SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) < 0.0001 AS near, ceil(l_extendedprice) AS up, floor(l_extendedprice) AS down,
    greatest(l_quantity, l_linenumber * 10.0) AS big, least(l_quantity, l_linenumber * 10.0) AS small,
    CASE WHEN l_quantity > 25 AND NOT l_returnflag = 'A' THEN 'bulk' ELSE 'single' END AS kind,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 0 END AS flag_no, l_quantity > 40 OR l_tax = 0 AS any_of FROM lineitem""",
)
def functions_number(t):
    q = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", (X.ABS(F.col("l_discount") - 0.05) < 0.0001).alias("near"),
        X.CEILING("l_extendedprice").cast("double").alias("up"), X.FLOOR("l_extendedprice").cast("double").alias("down"),
        X.MAX(q, F.col("l_linenumber") * 10.0).alias("big"), X.MIN(q, F.col("l_linenumber") * 10.0).alias("small"),
        X.IF(X.AND(q > 25, X.NOT(F.col("l_returnflag") == "A")), "bulk", "single").alias("kind"),
        X.CASE("l_returnflag", [("A", 1), ("N", 2)], 0).alias("flag_no"), X.OR(q > 40, F.col("l_tax") == 0).alias("any_of"),
    )


@query(
    "functions_round_half_even",
    "SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS DOUBLE) AS half FROM lineitem",
)
def functions_round_half_even(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", X.ROUND(F.col("l_quantity") / 2).alias("half"))


@query(
    "functions_value_blank",
    C_SQL + f"""SELECT id, CASE WHEN regexp_matches(employees, {S.NUMBER_SQL}) AND employees <> 'inf' THEN TRY_CAST(employees AS DOUBLE) END AS number,
    name IS NULL AS is_null, name IS NULL OR name = '' AS blank, name IS NULL OR trim(name) = '' AS blank_trimmed,
    year(TRY_CAST(created AS DATE)) AS y, month(TRY_CAST(created AS DATE)) AS m, day(TRY_CAST(created AS DATE)) AS d FROM contact""",
)
def functions_value_blank(t):
    number = X.VALUE("employees")
    return S.contacts(t).select(
        "id", F.when(number != float("inf"), number).alias("number"), X.ISNULL("name").alias("is_null"), X.ISBLANK("name").alias("blank"),
        X.ISBLANK("name", trim=True).alias("blank_trimmed"), X.YEAR("created").cast("long").alias("y"), X.MONTH("created").cast("long").alias("m"),
        X.DAY("created").cast("long").alias("d"),
    )


@query(
    "function_today",
    "SELECT o_orderkey, o_orderdate >= DATE '1998-06-01' AS late FROM orders",
)
def function_today(t):
    import datetime as dt

    return t.orders.select("o_orderkey", (F.col("o_orderdate") >= X.TODAY(dt.date(1998, 6, 1))).alias("late"))


@query(
    "functions_now_text",
    "SELECT o_orderkey, o_orderdate < TIMESTAMP '1996-06-01 12:00:00' AS before, CAST(o_custkey AS VARCHAR) || '/' || o_orderstatus AS shown FROM orders",
)
def functions_now_text(t):
    import datetime as dt

    before = F.col("o_orderdate") < X.NOW(dt.datetime(1996, 6, 1, 12))
    shown = F.concat(X.TEXT(F.col("o_custkey")), F.lit("/"), X.TEXT(F.col("o_orderstatus")))
    return t.orders.select("o_orderkey", before.alias("before"), shown.alias("shown"))


@query(
    "field_label_part",
    """SELECT p_partkey, upper(p_name[1:1]) || p_name[2:position(' ' IN p_name)] || upper(p_name[position(' ' IN p_name) + 1:position(' ' IN p_name) + 1])
    || p_name[position(' ' IN p_name) + 2:] AS label FROM part""",
)
def field_label_part(t):
    api = F.concat(F.lit("ns__"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("__c"))
    return t.part.select("p_partkey", values.field_label(api).alias("label"))


@query(
    "file_size_documents",
    """SELECT doc_id, CASE WHEN n = 0 THEN '0 B' WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024)
    WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS size
    FROM (SELECT doc_id, CAST(n_chars * 97 AS DOUBLE) AS n FROM documents)""",
)
def file_size_documents(t):
    return t.documents.select("doc_id", values.file_size_text(F.col("n_chars") * 97).alias("size"))
