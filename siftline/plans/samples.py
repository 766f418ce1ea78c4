"""Inputs of the registered queries, derived from the given tables.

The tables are clean, so defects are put in by CASE expressions on the row key.
Each expression is written once in the SQL both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from siftline.plans.registry import Tables

# Contacts: one per customer, with defects of every kind the checks know.
CONTACT = {
    "id": "c_custkey",
    "name": "CASE WHEN c_custkey % 17 = 0 THEN '  ' WHEN c_custkey % 19 = 0 THEN NULL ELSE c_name END",
    "email": "CASE WHEN c_custkey % 7 = 0 THEN 'bad-email-' || c_custkey WHEN c_custkey % 23 = 0 THEN '' "
    "WHEN c_custkey % 29 = 0 THEN 'true' ELSE lower(c_mktsegment) || c_custkey || '@example.com' END",
    "phone": "CASE WHEN c_custkey % 11 = 0 THEN '123' WHEN c_custkey % 13 = 0 THEN '555-12a4-9999' "
    "ELSE '+1 (555) ' || lpad('' || c_custkey, 7, '0') END",
    "website": "CASE WHEN c_custkey % 5 = 0 THEN 'ftp://example.com' ELSE 'https://example.com/' || c_custkey END",
    "employees": "CASE WHEN c_custkey % 9 = 0 THEN '12.5' WHEN c_custkey % 10 = 0 THEN 'n/a' "
    "WHEN c_custkey % 31 = 0 THEN 'inf' ELSE c_custkey || '.0' END",
    "revenue": "CASE WHEN c_custkey % 8 = 0 THEN '$1,234.50' WHEN c_custkey % 15 = 0 THEN 'USD 5' ELSE '' || c_nationkey || '.25' END",
    "rate": "CASE WHEN c_custkey % 6 = 0 THEN '120%' WHEN c_custkey % 14 = 0 THEN '-1' WHEN c_custkey % 22 = 0 THEN 'x%' "
    "ELSE (c_custkey % 100) || '%' END",
    "active": "CASE WHEN c_custkey % 4 = 0 THEN 'Yes' WHEN c_custkey % 25 = 0 THEN 'maybe' ELSE 'FALSE' END",
    "created": "CASE WHEN c_custkey % 16 = 0 THEN '2020-02-31' WHEN c_custkey % 27 = 0 THEN 'not a date' "
    "ELSE '2020-01-' || lpad('' || (1 + c_custkey % 28), 2, '0') END",
    "street": "CASE WHEN c_custkey % 18 = 0 THEN '123456' ELSE 'Road ' || c_custkey END",
    "note": "CASE WHEN c_custkey % 20 = 0 THEN '1234567' WHEN c_custkey % 26 = 0 THEN '99999' ELSE c_name END",
    "owner": "CASE WHEN c_custkey % 21 = 0 THEN 'short' ELSE lpad('' || c_custkey, 15, '0') END",
    "segment": "c_mktsegment",
    "code": "CASE WHEN c_custkey % 3 = 0 THEN 'C' || (c_custkey % 50) WHEN c_custkey % 28 = 0 THEN ' ' ELSE 'U' || c_custkey END",
}
CONTACT_SQL = "contact AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CONTACT.items()) + " FROM customer)"

# Field catalogue of the contact object.
CONTACT_FIELDS = [
    dict(name="name", type="string", length=15, nillable=False),
    dict(name="email", type="email", length=26, nillable=False),
    dict(name="phone", type="phone", length=40),
    dict(name="website", type="url", length=255),
    dict(name="employees", type="int"),
    dict(name="revenue", type="currency"),
    dict(name="rate", type="percent"),
    dict(name="active", type="boolean"),
    dict(name="created", type="date"),
    dict(name="street", type="string"),
    dict(name="note", type="textarea"),
    dict(name="owner", type="reference"),
    dict(
        name="segment",
        type="picklist",
        picklist=[("BUILDING", True), ("MACHINERY", True), ("FURNITURE", True), ("HOUSEHOLD", False)],
    ),
    dict(name="code", type="string", is_unique=True),
]

NUMBER_SQL = r"'^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$'"

#: What each catalogue check of the contact object finds, as SQL over ``contact``.
CONTACT_CHECKS = [
    ("required", "name", "name IS NULL OR trim(name) = ''"),
    ("max_length", "name", "trim(name) <> '' AND length(name) > 15"),
    ("required", "email", "trim(email) = ''"),
    ("type_email", "email", r"trim(email) <> '' AND NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$')"),
    ("format_email", "email", r"trim(email) <> '' AND NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$')"),
    ("max_length", "email", "trim(email) <> '' AND length(email) > 26"),
    ("type_phone", "phone", r"NOT regexp_matches(regexp_replace(phone, '[\s\-()+.]', '', 'g'), '^[0-9]{7,15}$')"),
    ("format_phone", "phone", r"NOT regexp_matches(regexp_replace(phone, '[\s\-()+.]', '', 'g'), '^[0-9]{7,15}$')"),
    ("type_url", "website", "NOT regexp_matches(website, '^https?://.+')"),
    ("format_url", "website", "NOT regexp_matches(website, '^https?://.+')"),
    ("type_int", "employees", "TRY_CAST(employees AS DOUBLE) IS NULL OR isinf(TRY_CAST(employees AS DOUBLE)) "
                              "OR TRY_CAST(employees AS DOUBLE) <> floor(TRY_CAST(employees AS DOUBLE))"),
    ("type_number", "revenue", "TRY_CAST(revenue AS DOUBLE) IS NULL"),
    ("format_currency", "revenue", "TRY_CAST(replace(replace(revenue, '$', ''), ',', '') AS DOUBLE) IS NULL"),
    ("type_number", "rate", "TRY_CAST(rate AS DOUBLE) IS NULL"),
    ("format_percent", "rate", "TRY_CAST(replace(rate, '%', '') AS DOUBLE) IS NULL "
                               "OR TRY_CAST(replace(rate, '%', '') AS DOUBLE) NOT BETWEEN 0 AND 100"),
    ("type_boolean", "active", "lower(active) NOT IN ('true', 'false', '1', '0', 'yes', 'no', 't', 'f')"),
    ("type_date", "created", "TRY_CAST(created AS DATE) IS NULL"),
    ("format_date", "created", "TRY_CAST(created AS DATE) IS NULL"),
    ("suspicious_numeric_text", "street", "COALESCE(TRY_CAST(street AS DOUBLE) > 9999, false)"),
    ("suspicious_numeric_text", "note", "COALESCE(TRY_CAST(note AS DOUBLE) > 99999, false)"),
    ("record_id", "owner", "length(trim(owner)) NOT IN (15, 18)"),
    ("picklist", "segment", "segment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')"),
]

# Rule messages: one per order, from ten wordings with numbers of the row.
MESSAGE = (
    "CASE o_orderkey % 10 "
    "WHEN 0 THEN 'Account Name is required and cannot be blank' "
    "WHEN 1 THEN 'Age must be between ' || (o_custkey % 20) || ' and ' || (60 + o_custkey % 20) || ' years' "
    "WHEN 2 THEN 'Please enter a valid email address format' "
    "WHEN 3 THEN 'Phone number must be at least ' || (o_custkey % 15) || ' characters long' "
    "WHEN 4 THEN 'Status must be one of \"' || o_orderpriority || '\", \"Inactive\", or \"Pending\"' "
    "WHEN 5 THEN 'Salary must be at least ' || o_custkey || ' for this position' "
    "WHEN 6 THEN 'Product code length must be between ' || (o_custkey % 5) || ' and ' || (5 + o_custkey % 9) || ' characters' "
    "WHEN 7 THEN 'Start Date must be in valid date format (MM/DD/YYYY)' "
    "WHEN 8 THEN 'Annual Revenue cannot exceed ' || o_custkey || ' when Company Type is \"' || o_orderpriority || '\"' "
    "ELSE 'SKU format must be \"ABC-' || (o_custkey % 1000) || '\" pattern with 3 letters, dash, and 3 numbers' END"
)
MESSAGE_SQL = f"message AS (SELECT o_orderkey AS id, {MESSAGE} AS text FROM orders)"

# Business rules as rows: one per part.
RULE = {
    "rule_name": "CASE p_partkey % 7 WHEN 0 THEN 'Restrict_' WHEN 1 THEN 'Validate_' WHEN 2 THEN 'Billing_Status_' "
    "WHEN 3 THEN 'Parent_Check_' WHEN 4 THEN 'Required_' WHEN 5 THEN 'Wholesaler_' ELSE 'Other_' END || p_partkey",
    "formula": "CASE p_size % 8 WHEN 0 THEN 'AND(ISBLANK(Name), OR(Size > 5, Parent.Id = 1))' WHEN 1 THEN 'ISPICKVAL(Type, X)' "
    "WHEN 2 THEN 'ISBLANK(Phone)' WHEN 3 THEN 'AND(A = 1, B = 2)' WHEN 4 THEN 'ISNEW() = TRUE' WHEN 5 THEN 'Parent.Name = Name' "
    "WHEN 6 THEN 'LEN(Phone) < 10' ELSE 'IF(NOT(Flag), 1, 0) = 1' END",
    "n_fields": "p_size % 5",
    "active": "p_partkey % 4 <> 0",
    "mapped": "p_partkey % 3 <> 0",
}
RULE_SQL = "rule AS (SELECT p_partkey AS id, " + ", ".join(f"{e} AS {n}" for n, e in RULE.items()) + " FROM part)"

# Tests of those rules: one per order.
TEST = {
    "test_id": "CASE o_orderkey % 3 WHEN 0 THEN 'POS_' WHEN 1 THEN 'NEG_' ELSE 'EDGE_' END || o_orderkey",
    "rule_key": "o_custkey % 400 * 3",
    "test_type": "CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 < 4 THEN 'positive' ELSE 'negative' END",
    "test_category": "CASE WHEN o_orderkey % 40 = 0 THEN 'Edge Case' ELSE 'Validation' END",
    "risk_level": "CASE o_orderkey % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END",
    "scenario": "CASE o_orderkey % 4 WHEN 0 THEN 'Access Control' WHEN 1 THEN 'Data Completeness' WHEN 2 THEN 'General' END",
    "pattern_type": "CASE WHEN o_orderkey % 8 = 0 THEN 'picklist' END",
    "enhanced": "o_orderkey % 9 = 0",
}
TEST_SQL = (
    "test0 AS (SELECT o_orderkey AS id, " + ", ".join(f"{e} AS {n}" for n, e in TEST.items()) + " FROM orders), "
    "test AS (SELECT t.*, r.rule_name FROM test0 t LEFT JOIN rule r ON r.id = t.rule_key)"
)

# Field catalogue as rows: one field per part, one object per brand.
CATALOG = {
    "object": "p_brand",
    "name": "CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '_') || '_' || p_partkey || '__c' "
    "WHEN p_partkey % 3 = 1 THEN replace(p_name, ' ', '') || p_partkey ELSE 'Created' || p_partkey END",
    "label": "p_name || ' ' || p_partkey",
    "type": "CASE p_type WHEN 'STANDARD' THEN 'string' WHEN 'SMALL' THEN 'picklist' WHEN 'MEDIUM' THEN 'double' "
    "WHEN 'LARGE' THEN 'reference' WHEN 'ECONOMY' THEN 'email' ELSE 'address' END",
    "length": "p_size",
    "nillable": "p_size % 4 <> 0",
    "is_unique": "p_size % 9 = 0",
    "createable": "p_size % 2 = 0",
    "updateable": "p_size % 3 <> 0",
    "calculated": "p_size % 11 = 0",
    "auto_number": "p_size % 13 = 0",
    "external_id": "p_size % 10 = 0",
    "position": "CAST(p_partkey AS INT)",
}
CATALOG_SQL = "catalog AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CATALOG.items()) + " FROM part)"

# Log rows: one per event.
LOG = {
    "event_id": "event_id",
    "file_path": "'/logs/' || CASE event_type WHEN 'view' THEN 'dataload' WHEN 'click' THEN 'validation' WHEN 'error' THEN 'mapping' "
    "WHEN 'signup' THEN 'unit' ELSE 'misc' END || '/' || CASE user_id % 3 WHEN 0 THEN 'processing_summary.csv' "
    "WHEN 1 THEN 'batch_processing_details.csv' ELSE 'mapping_log.csv' END",
    "error_rate": "value * 2",
    "batch_number": "CAST(user_id AS INT)",
    "records": "event_id",
    "success": "event_id - user_id % 7",
    "errors": "user_id % 7",
    "object": "event_type",
}
LOG_SQL = "log AS (SELECT ts AS timestamp, " + ", ".join(f"{e} AS {n}" for n, e in LOG.items()) + " FROM events)"


def _exprs(spec: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in spec.items()]


def contacts(t: Tables) -> DataFrame:
    return t.customer.selectExpr(*_exprs(CONTACT))


def contact_catalog(t: Tables) -> DataFrame:
    from siftline.operators.catalog import catalog_rows

    return catalog_rows(t.spark, [{"object": "Contact"} | f for f in CONTACT_FIELDS])


def messages(t: Tables) -> DataFrame:
    return t.orders.selectExpr("o_orderkey AS id", f"{MESSAGE} AS text")


def rules(t: Tables) -> DataFrame:
    """Rules with their fields as an array of ``n_fields`` names and a mapping."""
    base = t.part.selectExpr("p_partkey AS id", *_exprs(RULE))
    return base.selectExpr(
        "*",
        "slice(array('Name', 'Phone', 'Size', 'Type'), 1, n_fields) AS fields",
        "CASE WHEN mapped THEN map('Name', 'name') ELSE CAST(map() AS MAP<STRING, STRING>) END AS mappings",
    )


def tests(t: Tables) -> DataFrame:
    listed = t.orders.selectExpr("o_orderkey AS id", *_exprs(TEST))
    named = t.part.selectExpr("p_partkey AS rule_key", f"{RULE['rule_name']} AS rule_name")
    return listed.join(named, "rule_key", "left")


def catalog(t: Tables) -> DataFrame:
    return t.part.selectExpr(
        *_exprs(CATALOG), "CAST(NULL AS ARRAY<STRUCT<value: STRING, active: BOOLEAN>>) AS picklist"
    )


def log_rows(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "ts AS timestamp", *_exprs(LOG), "CAST(NULL AS STRING) AS operation", "CAST(NULL AS STRING) AS org"
    )
