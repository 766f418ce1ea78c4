"""Registered queries: mapping, catalogue, profiles, lookups, loads, sources."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from siftline import session
from siftline.operators import catalog as cat_ops
from siftline.operators import checks, load, lookup, mapping, profile, report
from siftline.plans import flows
from siftline.plans import samples as S
from siftline.plans.registry import query
from siftline.sources import extract, files, sinks

# --- flagship -------------------------------------------------------------------------

ORDER_MAPPING = {
    "o_orderkey": "OrderNumber",
    "o_orderstatus": "Status",
    "o_totalprice": "Amount",
    "o_orderpriority": "Priority",
    "o_custkey": mapping.fixed.SKIP_FIELD,
}
ORDER_FIELDS = [
    dict(name="OrderNumber", type="int", nillable=False),
    dict(name="Status", type="string", length=1, nillable=False),
    dict(name="Amount", type="currency", nillable=False),
    dict(name="Priority", type="picklist", length=10, picklist=[("1-URGENT", True), ("2-HIGH", True), ("3-MEDIUM", True), ("4-NOT SPECIFIED", True)]),
]


def _mapped_orders(t):
    return mapping.apply_mapping(t.orders, ORDER_MAPPING)


def _order_catalog(t):
    return cat_ops.catalog_rows(t.spark, [{"object": "Order"} | f for f in ORDER_FIELDS])


@query(
    "order_quality_report",
    """WITH v AS (SELECT o_orderkey, o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') AS pick,
      length(o_orderpriority) > 10 AS long FROM orders),
    s AS (SELECT count(*) AS n, count(*) FILTER (NOT pick AND NOT long) AS ok, count(*) FILTER (pick) + count(*) FILTER (long) AS errs FROM v)
    SELECT n AS total_records, ok AS passed_records, n - ok AS failed_records, errs AS total_errors, CAST(1 AS BIGINT) AS fields_with_issues,
      round(ok * 100.0 / n, 4) AS success_rate, round(100.0 - ok * 100.0 / n, 4) AS failure_rate, round(errs * 1.0 / n, 4) AS errors_per_record,
      'Priority' AS worst_field, CASE WHEN ok * 100.0 / n >= 95 THEN 'Excellent' WHEN ok * 100.0 / n >= 80 THEN 'Good'
        WHEN ok * 100.0 / n >= 60 THEN 'Fair' ELSE 'Poor' END AS quality FROM s""",
)
def order_quality_report(t):
    return report.error_report(checks.validate_schema(_mapped_orders(t), _order_catalog(t)))


# --- mapping ---------------------------------------------------------------------------


@query("map_orders", 'SELECT o_orderkey AS "OrderNumber", o_orderstatus AS "Status", o_totalprice AS "Amount", o_orderpriority AS "Priority" FROM orders')
def map_orders(t):
    return _mapped_orders(t)


@query("unmap_orders", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate FROM orders")
def unmap_orders(t):
    return mapping.unapply_mapping(
        _mapped_orders(t).withColumnRenamed("OrderNumber", "o_orderkey"),
        {k: v for k, v in ORDER_MAPPING.items() if k != "o_orderkey"},
        t.orders,
        "o_orderkey",
    )


def _fields_sql(score: str, threshold: int, columns: list[str], rank: str = "0") -> str:
    listed = ", ".join(f"('{c}', '{c.lower().replace('_', '').replace(' ', '').replace('.', '').replace('-', '')}')" for c in columns)
    return (
        f"WITH {S.CATALOG_SQL}, cols(col, k) AS (VALUES {listed}), s AS (SELECT col, name, position, {score} AS score, {rank} AS rnk FROM cols, catalog), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY score DESC, rnk, position, name) AS n FROM s) "
        f"SELECT col AS \"column\", CASE WHEN score >= {threshold} THEN name ELSE '-- Skip Field --' END AS field, "
        f"CASE WHEN score >= {threshold} THEN score ELSE 0 END AS score FROM r WHERE n = 1"
    )


_SUGGEST = ["red_widget_3", "blue bolt", "createddate", "Email", "amount"]
_SCORED = {"red_widget_3": "Text (Short)", "blue bolt": "Number (Integer)", "createddate": "Date/DateTime", "Email": "Email", "amount": "Number (Decimal)"}


@query(
    "suggest_mapping_scored",
    _fields_sql(
        "CASE WHEN replace(replace(replace(lower(name), '_', ''), ' ', ''), '-', '') = k THEN 100 WHEN col = 'Email' AND type = 'email' THEN 80 "
        "WHEN contains(lower(name), k) OR contains(k, replace(lower(name), '__c', '')) THEN 70 "
        "WHEN col IN ('blue bolt', 'amount') AND type = 'double' THEN 50 ELSE 0 END",
        50,
        _SUGGEST,
    ),
)
def suggest_mapping_scored(t):
    return mapping.suggest_mapping_scored(_SCORED, S.catalog(t))


@query(
    "suggest_mapping_name",
    _fields_sql(
        "CASE WHEN replace(lower(name), '__c', '') = k THEN 100 WHEN contains(lower(name), k) OR contains(k, lower(name)) THEN 80 "
        "WHEN contains(lower(label), k) OR contains(k, lower(label)) THEN 60 "
        "WHEN (contains(k, 'date') AND contains(lower(name), 'date')) OR (contains(k, 'email') AND contains(lower(name), 'email')) THEN 40 ELSE 0 END",
        40,
        _SUGGEST,
    ),
)
def suggest_mapping_name(t):
    return mapping.suggest_mapping_name(_SUGGEST, S.catalog(t))


@query(
    "suggest_mapping_first",
    _fields_sql(
        "CASE WHEN lower(name) = k THEN 3 WHEN replace(replace(lower(label), '_', ''), ' ', '') = k THEN 2 "
        "WHEN contains(lower(name), k) OR contains(lower(label), k) OR contains(k, lower(name)) OR contains(k, replace(lower(label), ' ', '')) THEN 1 ELSE 0 END",
        1,
        _SUGGEST,
    ),
)
def suggest_mapping_first(t):
    return mapping.suggest_mapping_first(_SUGGEST, S.catalog(t))


@query(
    "suggest_mapping_alias",
    _fields_sql("CASE WHEN contains(lower(name), k) OR contains(k, lower(name)) THEN 1 ELSE 0 END", 1, _SUGGEST),
)
def suggest_mapping_alias(t):
    return mapping.suggest_mapping_alias(_SUGGEST, S.catalog(t))


@query(
    "default_mapping_label",
    f"WITH {S.CATALOG_SQL} SELECT label AS source, name AS target FROM catalog WHERE NOT starts_with(name, 'Created') AND updateable "
    "AND (contains(lower(name), 'red') OR contains(lower(name), 'bolt'))",
)
def default_mapping_label(t):
    return mapping.default_mapping(S.catalog(t), "label", name_filter="red, bolt")


@query(
    "default_mapping_identity",
    f"WITH {S.CATALOG_SQL} SELECT name AS source, name AS target FROM catalog WHERE NOT starts_with(name, 'Created') AND updateable",
)
def default_mapping_identity(t):
    return mapping.default_mapping(S.catalog(t), "identity")


@query(
    "default_mapping_loadable",
    f"WITH {S.CATALOG_SQL} SELECT 0 AS position, 'Id' AS source, 'Id' AS target UNION ALL SELECT DISTINCT CASE WHEN updateable AND NOT contains(lower(name), 'sic') "
    "THEN 1 ELSE 2 END, name, name FROM catalog WHERE (updateable AND NOT contains(lower(name), 'sic')) OR external_id",
)
def default_mapping_loadable(t):
    return mapping.loadable_mapping(S.catalog(t))


_PAIRS_SQL = "WITH pairs AS (SELECT p_brand AS object, p_name || p_size AS source, CASE WHEN p_size % 5 = 0 THEN '' ELSE split_part(p_name, ' ', 2) END AS target FROM part) "


def _pairs(t):
    return t.part.selectExpr(
        "p_brand AS object", "p_name || p_size AS source", "CASE WHEN p_size % 5 = 0 THEN '' ELSE split_part(p_name, ' ', 2) END AS target"
    )


@query(
    "mapping_counts",
    _PAIRS_SQL + "SELECT count(*) AS total_mappings, CAST(sum(n) AS BIGINT) AS total_fields, round(avg(n), 4) AS average_fields FROM (SELECT count(source) AS n FROM pairs GROUP BY object)",
)
def mapping_counts(t):
    return mapping.mapping_counts(_pairs(t)).withColumn("average_fields", F.round("average_fields", 4))


@query(
    "mapping_top_sources",
    _PAIRS_SQL + "SELECT source AS field, count(*) AS mappings FROM pairs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def mapping_top_sources(t):
    return mapping.mapping_top(_pairs(t), "source")


@query(
    "mapping_issues",
    _PAIRS_SQL + "SELECT object, 'Duplicate Target Fields' AS issue, target AS field, count(*) AS occurrences FROM pairs WHERE target <> '' GROUP BY 1, 3 HAVING count(*) > 1 "
    "UNION ALL SELECT object, 'Empty Target Fields', source, 1 FROM pairs WHERE target = ''",
)
def mapping_issues(t):
    return mapping.mapping_issues(_pairs(t))


# --- catalogue ----------------------------------------------------------------------------


@query(
    "column_status_catalog",
    f"""WITH {S.CATALOG_SQL} SELECT name, CASE WHEN NOT createable AND NOT updateable AND (calculated OR auto_number) THEN 'read_only'
    WHEN NOT createable AND NOT updateable THEN 'permission_issue' WHEN calculated OR auto_number THEN 'read_only'
    WHEN type = 'address' THEN 'complex_type' ELSE 'valid' END AS status FROM catalog""",
)
def column_status_catalog(t):
    return S.catalog(t).select("name", cat_ops.column_status().alias("status"))


def _two_columns(t):
    """A frame whose columns are named after fields of the catalogue."""
    return t.part.select(
        F.col("p_size").alias("created2"), F.col("p_type").alias("CREATED5"), F.col("p_brand").alias("created8"), F.col("p_name").alias("nowhere")
    )


@query(
    "classify_columns_part",
    f"""WITH {S.CATALOG_SQL}, cols(col) AS (VALUES ('created2'), ('CREATED5'), ('created8'), ('nowhere'))
    SELECT col AS "column", CASE WHEN name IS NULL THEN 'not_found' WHEN NOT createable AND NOT updateable AND (calculated OR auto_number) THEN 'read_only'
    WHEN NOT createable AND NOT updateable THEN 'permission_issue' WHEN calculated OR auto_number THEN 'read_only' WHEN type = 'address' THEN 'complex_type'
    ELSE 'valid' END AS status FROM cols LEFT JOIN catalog ON lower(name) = lower(col)""",
)
def classify_columns_part(t):
    return cat_ops.classify_columns(_two_columns(t).columns, S.catalog(t))


@query("drop_incompatible_orders", 'SELECT o_orderkey AS "OrderNumber", o_orderstatus AS "Status" FROM orders')
def drop_incompatible_orders(t):
    rows = [
        {"object": "Order", "name": "ordernumber", "createable": True, "updateable": True},
        {"object": "Order", "name": "Status", "createable": True},
        {"object": "Order", "name": "Amount", "createable": True, "calculated": True},
    ]
    return cat_ops.drop_incompatible(_mapped_orders(t), cat_ops.catalog_rows(t.spark, rows))


@query(
    "catalog_summary",
    f"""WITH {S.CATALOG_SQL}, c AS (SELECT object, count(*) AS total_fields, count(*) FILTER (NOT nillable) AS required_fields,
      count(*) FILTER (type = 'picklist') AS picklist_fields, count(*) FILTER (type = 'reference') AS reference_fields,
      count(*) FILTER (ends_with(name, '__c')) AS custom_fields, count(*) FILTER (updateable) AS updateable_fields FROM catalog GROUP BY object),
    s AS (SELECT *, round(total_fields * 0.3::DOUBLE + required_fields * 2.5::DOUBLE + picklist_fields * 1.5::DOUBLE + reference_fields * 3.0::DOUBLE
      + custom_fields * 1.2::DOUBLE + updateable_fields * 0.2::DOUBLE, 2) AS complexity_score FROM c)
    SELECT *, CASE WHEN complexity_score >= 120 THEN 'Very High' WHEN complexity_score >= 70 THEN 'High' WHEN complexity_score >= 35 THEN 'Medium'
      WHEN complexity_score >= 15 THEN 'Low' ELSE 'Very Low' END AS complexity_level FROM s""",
)
def catalog_summary(t):
    return cat_ops.catalog_summary(S.catalog(t))


@query("catalog_fields_by_type", f"WITH {S.CATALOG_SQL} SELECT object, type, count(*) AS fields FROM catalog GROUP BY 1, 2")
def catalog_fields_by_type(t):
    return cat_ops.fields_by_type(S.catalog(t))


@query(
    "scan_catalog_details",
    """SELECT p_brand || p_partkey AS name, p_size % 2 <> 0 AS nillable, p_size % 3 = 0 AS is_unique,
    CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type || '|' || split_part(p_name, ' ', 1) END AS listed FROM part""",
)
def scan_catalog_details(t):
    details = t.part.selectExpr(
        "p_brand || p_partkey AS `Field Name`", "p_name AS `Label`", "'picklist' AS `Type`", "p_size % 2 = 0 AS `Required`",
        "p_size % 3 = 0 AS `Unique`", "CASE WHEN p_size % 5 <> 0 THEN p_type || ', ' || split_part(p_name, ' ', 1) END AS `Picklist Values`",
    )
    path = _scratch(t, "details")
    details.write.option("header", True).csv(path)
    cat = files.scan_catalog_csv(t.spark, path, "Part")
    listed = F.array_join(F.transform("picklist", lambda p: p["value"]), "|")
    return cat.select("name", "nillable", "is_unique", listed.alias("listed"))


@query(
    "scan_catalog_describe",
    """SELECT p_brand AS object, p_name || p_partkey AS name, p_size % 2 = 0 AS nillable, p_type AS reference_to,
    CASE WHEN p_size % 3 = 0 THEN 'a|b' ELSE 'a' END AS listed FROM part""",
)
def scan_catalog_describe(t):
    described = (
        t.part.selectExpr(
            "p_brand AS name",
            "named_struct('name', p_name || p_partkey, 'type', 'picklist', 'nillable', p_size % 2 = 0, 'referenceTo', array(p_type, 'x'), "
            "'picklistValues', array(named_struct('value', 'a', 'active', true), named_struct('value', 'b', 'active', p_size % 3 = 0))) AS field",
        )
        .selectExpr("name", "array(field) AS fields")
    )
    path = _scratch(t, "describe")
    described.write.json(path)
    cat = files.catalog_from_describe(t.spark.read.schema(files.DESCRIBE_SCHEMA).json(path))
    listed = F.array_join(F.transform("picklist", lambda p: p["value"]), "|")
    return cat.select("object", "name", "nillable", "reference_to", listed.alias("listed"))


def _scratch(t, tag: str) -> str:
    return f"{session.shared_dir(t.spark)}/siftline-{t.spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


# --- sources ------------------------------------------------------------------------------


@query(
    "scan_csv_customer",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal, 'a \"quoted\", ' || c_mktsegment AS remark FROM customer",
)
def scan_csv_customer(t):
    path = _scratch(t, "csv")
    out = t.customer.selectExpr("c_custkey", "c_name", "c_acctbal", "'a \"quoted\", ' || c_mktsegment AS remark")
    out.write.option("header", True).option("escape", '"').csv(path)
    return files.scan_csv(t.spark, path).withColumn("c_acctbal", F.col("c_acctbal").try_cast("double"))


@query("extract_recent_orders", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-05 00:00:00'")
def extract_recent_orders(t):
    return extract.extract(
        t.orders, "recent", ["o_orderkey", "o_orderdate"], created="o_orderdate", days_back=180, as_of=dt.date(1999, 1, 1)
    )


@query("extract_all_orders", "SELECT o_orderkey, o_orderstatus FROM orders")
def extract_all_orders(t):
    return extract.extract(t.orders, "all", ["o_orderkey", "o_orderstatus"], limit=None)


@query("extract_custom_orders", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def extract_custom_orders(t):
    return extract.extract(
        t.orders, "custom", query="SELECT o_orderstatus, count(*) AS n FROM {source} WHERE o_totalprice > 1000 GROUP BY o_orderstatus"
    )


@query(
    "extract_with_reference_keys",
    'SELECT o_orderkey, o_custkey, c_name AS "o_custkey.ExtKey" FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 20',
)
def extract_with_reference_keys(t):
    parent = t.customer.filter("c_nationkey < 20").select(F.col("c_custkey").alias("Id"), F.col("c_name").alias("ExtKey"))
    parent_catalog = cat_ops.catalog_rows(
        t.spark, [{"object": "Account", "name": "Id", "is_unique": True}, {"object": "Account", "name": "ExtKey", "external_id": True}]
    )
    return extract.extract_with_reference_keys(t.orders.select("o_orderkey", "o_custkey"), [("o_custkey", parent, parent_catalog)])


@query(
    "flatten_relationships",
    """SELECT e.event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS props, CASE WHEN user_id % 2 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS owner
    FROM events e""",
)
def flatten_relationships(t):
    nested = extract.parse_relationship(t.events, "props", "k int").selectExpr(
        "event_id", "props", "named_struct('Name', CASE WHEN user_id % 2 = 0 THEN event_type END, 'Id', user_id) AS owner",
        "named_struct('type', 'Event') AS attributes",
    )
    return extract.flatten_relationships(nested)


# --- profiles ------------------------------------------------------------------------------


def _profile_sql(table: str, columns: dict[str, tuple[str, str]]) -> str:
    parts = []
    for name, (data_type, detected) in columns.items():
        text = name if data_type == "string" else f"CAST({name} AS VARCHAR)"
        parts.append(
            f"SELECT '{name}' AS \"column\", '{data_type}' AS data_type, '{detected}' AS detected_type, count({name}) AS non_null, count(*) - count({name}) AS nulls, "
            f"count(DISTINCT {name}) AS distinct_values, min(length({text})) AS min_length, max(length({text})) AS max_length, "
            f"(SELECT string_agg(v, ', ' ORDER BY n) FROM (SELECT {text} AS v, n FROM numbered WHERE {name} IS NOT NULL ORDER BY n LIMIT 2)) AS samples FROM numbered"
        )
    return f"WITH numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS n FROM {table}) " + " UNION ALL ".join(parts)


_LINE_TYPES = {
    "l_orderkey": ("bigint", "Number (Integer)"), "l_partkey": ("bigint", "Number (Integer)"), "l_suppkey": ("bigint", "Number (Integer)"),
    "l_linenumber": ("int", "Number (Integer)"), "l_quantity": ("double", "Number (Integer)"), "l_extendedprice": ("double", "Number (Decimal)"),
    "l_discount": ("double", "Number (Decimal)"), "l_tax": ("double", "Number (Decimal)"), "l_returnflag": ("string", "Text (Short)"),
    "l_linestatus": ("string", "Text (Short)"), "l_shipdate": ("timestamp_ntz", "Date/DateTime"),
}
_DOCUMENT_TYPES = {
    "doc_id": ("bigint", "Number (Integer)"), "text": ("string", "Email"), "lang": ("string", "Text (Short)"), "source": ("string", "Text (Short)"),
    "n_chars": ("bigint", "Number (Integer)"),
}


@query("profile_lineitem", _profile_sql("lineitem", _LINE_TYPES))
def profile_lineitem(t):
    return profile.column_profile(t.lineitem)


@query("profile_documents", _profile_sql("documents", _DOCUMENT_TYPES))
def profile_documents(t):
    return profile.column_profile(t.documents)


@query(
    "profile_late_values",
    """WITH o AS (SELECT CASE WHEN o_orderkey >= 900 THEN o_orderpriority END AS late, CASE WHEN o_orderkey = 950 THEN o_custkey END AS once, CAST(NULL AS VARCHAR) AS gone, row_number() OVER () AS n FROM orders)
    SELECT 'late' AS "column", (SELECT string_agg(late, ', ' ORDER BY n) FROM (SELECT late, n FROM o WHERE late IS NOT NULL ORDER BY n LIMIT 2)) AS samples
    UNION ALL SELECT 'once', (SELECT string_agg(CAST(once AS VARCHAR), ', ' ORDER BY n) FROM (SELECT once, n FROM o WHERE once IS NOT NULL ORDER BY n LIMIT 2)) UNION ALL SELECT 'gone', NULL""",
)
def profile_late_values(t):
    df = t.orders.selectExpr("CASE WHEN o_orderkey >= 900 THEN o_orderpriority END AS late", "CASE WHEN o_orderkey = 950 THEN o_custkey END AS once", "CAST(NULL AS STRING) AS gone")
    return profile.column_profile(df).select("column", "samples")


@query(
    "profile_parts_lineitem",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{kind}' AS data_type, count({c}) AS non_null, count(*) - count({c}) AS nulls, "
        f"min(length({(text := c if kind == 'string' else f'CAST({c} AS VARCHAR)')})) AS min_length, max(length({text})) AS max_length, true AS near FROM lineitem"
        for c, (kind, _) in _LINE_TYPES.items()
    ),
)
def profile_parts_lineitem(t):
    """Three parts profiled apart and merged; estimates must be within three standard errors of the exact counts."""
    parts = [profile.profile_parts(t.lineitem.filter(f"l_linenumber % 3 = {i}"), F.lit(i)) for i in range(3)]
    kept = session.stage(parts[0].unionByName(parts[1]).unionByName(parts[2]), "profile-parts")
    names = t.spark.createDataFrame(list(enumerate(t.lineitem.columns)), "position int, column string")
    exact = profile.value_counts(t.lineitem).groupBy("position").agg(F.count("*").alias("exact")).join(F.broadcast(names), "position")
    near = F.abs(F.col("distinct_estimate") - F.col("exact")) <= 3 * 1.04 / 2 ** (profile.SKETCH_BITS / 2) * F.col("exact") + 1
    return profile.merge_profiles(kept).join(exact, "column").select("column", "data_type", "non_null", "nulls", "min_length", "max_length", near.alias("near"))


@query("profile_lineitem_approx")
def profile_lineitem_approx(t):
    return profile.column_profile(t.lineitem, approx=True)


def _detect_sql(columns: list[str]) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"""SELECT '{c}' AS "column", CASE WHEN count({c}) = 0 THEN 'Text' WHEN bool_and(regexp_matches(trim({c}), {S.NUMBER_SQL})) THEN
            CASE WHEN bool_and(TRY_CAST({c} AS DOUBLE) = floor(TRY_CAST({c} AS DOUBLE))) THEN 'Number (Integer)' ELSE 'Number (Decimal)' END
            WHEN bool_and(lower({c}) IN ('true', 'false', '1', '0', 'yes', 'no')) THEN 'Checkbox (Boolean)'
            WHEN bool_and(regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND TRY_CAST({c} AS DATE) IS NOT NULL) THEN 'Date/DateTime'
            WHEN bool_or(regexp_matches({c}, '@.*\\.')) THEN 'Email' WHEN bool_or(regexp_matches({c}, '[\\d\\-\\(\\)\\+\\s]{{10,}}')) THEN 'Phone'
            WHEN bool_or(regexp_matches({c}, 'https?://')) THEN 'URL' WHEN max(length({c})) <= 80 THEN 'Text (Short)' WHEN max(length({c})) <= 255 THEN 'Text (Medium)'
            WHEN max(length({c})) <= 32000 THEN 'Text (Long)' ELSE 'Text Area (Rich)' END AS detected_type FROM typed"""
        )
    return " UNION ALL ".join(parts)


_DETECT = {
    "name": "name", "email": "email", "phone": "phone", "website": "website", "employees": "employees", "segment": "segment",
    "whole": "id || '.0'", "part": "id || '.5'", "token": "CASE WHEN id % 2 = 0 THEN 'Yes' ELSE 'no' END",
    "day": "'2020-01-' || lpad('' || (1 + id % 28), 2, '0')", "gone": "CASE WHEN id < 0 THEN name END", "long": "repeat(segment, 20)",
}


@query(
    "detect_types_contact",
    f"WITH {S.CONTACT_SQL}, typed AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _DETECT.items()) + " FROM contact) " + _detect_sql(list(_DETECT)),
)
def detect_types_contact(t):
    return profile.detect_types(S.contacts(t).selectExpr(*[f"{e} AS {n}" for n, e in _DETECT.items()]))


@query(
    "detect_types_texts",
    """WITH typed AS (SELECT text, lang, source FROM documents) """ + _detect_sql(["text", "lang", "source"]),
)
def detect_types_texts(t):
    return profile.detect_types(session.spread(t.documents).select("text", "lang", "source"))


@query(
    "column_issues_orders",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 'Duplicate' AS issue, count(*) - count(DISTINCT {e}) - CASE WHEN count(*) > count({e}) THEN 1 ELSE 0 END AS count, count(*) AS total_records FROM orders "
        f"HAVING count(*) - count(DISTINCT {e}) - CASE WHEN count(*) > count({e}) THEN 1 ELSE 0 END > 0 "
        f"UNION ALL SELECT '{c}', 'Null', count(*) - count({e}), count(*) FROM orders HAVING count(*) > count({e})"
        for c, e in {
            "o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus", "o_totalprice": "o_totalprice",
            "o_orderdate": "o_orderdate", "o_orderpriority": "o_orderpriority", "blanked": "CASE WHEN o_custkey % 3 = 0 THEN o_custkey END",
        }.items()
    ),
)
def column_issues_orders(t):
    df = t.orders.withColumn("blanked", F.expr("CASE WHEN o_custkey % 3 = 0 THEN o_custkey END"))
    return profile.column_issues(df)


@query(
    "quality_documents",
    """WITH d AS (SELECT text, lang, CASE WHEN doc_id % 3 = 0 THEN source END AS source, CAST(doc_id % 1000 AS VARCHAR) AS code FROM documents),
    dup AS (SELECT sum(n - 1) AS k FROM (SELECT count(*) AS n FROM d GROUP BY text, lang, source, code))
    SELECT 'long_text' AS issue, 'text' AS "column", CAST(max(length(text)) AS DOUBLE) AS amount FROM d
    UNION ALL SELECT 'null_share', 'source', round((count(*) - count(source)) * 100.0 / count(*), 6) FROM d
    UNION ALL SELECT 'numeric_text', 'code', count(*) FROM d
    UNION ALL SELECT 'duplicate_rows', NULL, k FROM dup WHERE k > 0""",
)
def quality_documents(t):
    df = t.documents.selectExpr("text", "lang", "CASE WHEN doc_id % 3 = 0 THEN source END AS source", "CAST(doc_id % 1000 AS STRING) AS code")
    return profile.quality_issues(df).withColumn("amount", F.round("amount", 6))


@query(
    "duplicate_rows_lineitem",
    """WITH twice AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1)
    SELECT (SELECT count(*) FROM twice) - (SELECT count(*) FROM (SELECT DISTINCT * FROM twice)) AS duplicate_rows""",
)
def duplicate_rows_lineitem(t):
    return profile.duplicate_rows(t.lineitem.unionByName(t.lineitem.filter("l_linenumber = 1")))


_CONTACT_COLUMNS = "id name email phone website employees revenue rate active created street note owner segment code".split()


@query(
    "null_share_contact",
    f"WITH {S.CONTACT_SQL} SELECT round((" + " + ".join(f"count(*) - count({c})" for c in _CONTACT_COLUMNS)
    + f") * 100.0 / (count(*) * {len(_CONTACT_COLUMNS)}), 6) AS null_percentage FROM contact",
)
def null_share_contact(t):
    return profile.null_share(S.contacts(t)).withColumn("null_percentage", F.round("null_percentage", 6))


@query(
    "sql_types_part",
    """WITH m AS (SELECT max(p_partkey) AS k, max(p_size) AS s, max(length(p_name)) AS n FROM part), d AS (SELECT max(length(text)) AS n FROM documents)
    SELECT 'p_partkey' AS "column", CASE WHEN k <= 127 THEN 'TINYINT' WHEN k <= 32767 THEN 'SMALLINT' WHEN k <= 2147483647 THEN 'INT' ELSE 'BIGINT' END AS sql_type FROM m
    UNION ALL SELECT 'p_size', CASE WHEN s <= 127 THEN 'TINYINT' ELSE 'SMALLINT' END FROM m
    UNION ALL SELECT 'p_name', 'VARCHAR(' || greatest(n * 2, 50) || ')' FROM m
    UNION ALL SELECT 'p_retailprice', 'FLOAT' UNION ALL SELECT 'big', 'BIT'""",
)
def sql_types_part(t):
    return profile.infer_sql_types(t.part.select("p_partkey", "p_size", "p_name", "p_retailprice", (F.col("p_size") > 9).alias("big")))


@query(
    "sql_types_documents",
    """WITH m AS (SELECT max(length(text)) AS n FROM documents) SELECT 'text' AS "column", CASE WHEN n <= 4000 THEN 'VARCHAR(' || n || ')' ELSE 'TEXT' END AS sql_type FROM m
    UNION ALL SELECT 'doc_id', CASE WHEN max(doc_id) <= 127 THEN 'TINYINT' WHEN max(doc_id) <= 32767 THEN 'SMALLINT' ELSE 'INT' END FROM documents""",
)
def sql_types_documents(t):
    return profile.infer_sql_types(t.documents.select("text", "doc_id"))


# --- lookups ---------------------------------------------------------------------------------

_LOOK_SQL = """WITH src AS (SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN lpad('' || o_custkey, 15, 'A') ELSE 'Customer#' || lpad('' || o_custkey, 9, '0') END AS account,
  'NATION_' || o_custkey % 30 AS nation FROM orders),
acc AS (SELECT c_name AS k, min('A' || lpad('' || c_custkey, 14, '0')) AS id FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1),
nat AS (SELECT n_name AS k, min('N' || lpad('' || n_nationkey, 14, '0')) AS id FROM nation GROUP BY 1),
res AS (SELECT o_orderkey, COALESCE(acc.id, account) AS account, COALESCE(nat.id, nation) AS nation FROM src
  LEFT JOIN acc ON acc.k = account AND NOT regexp_matches(account, '^[A-Za-z0-9]{15}$') LEFT JOIN nat ON nat.k = nation)
"""


def _lookup_source(t):
    return t.orders.selectExpr(
        "o_orderkey",
        "CASE WHEN o_custkey % 11 = 0 THEN lpad('' || o_custkey, 15, 'A') ELSE 'Customer#' || lpad('' || o_custkey, 9, '0') END AS account",
        "'NATION_' || o_custkey % 30 AS nation",
    )


def _lookups(t):
    accounts = t.customer.filter("c_custkey % 5 <> 0").selectExpr("'A' || lpad('' || c_custkey, 14, '0') AS Id", "c_name AS Name")
    nations = t.nation.selectExpr("'N' || lpad('' || n_nationkey, 14, '0') AS Id", "n_name AS Name")
    return [lookup.Lookup("account", accounts), lookup.Lookup("nation", nations)]


@query("lookup_customer", _LOOK_SQL + "SELECT o_orderkey, account FROM res")
def lookup_customer(t):
    return lookup.resolve_lookup(_lookup_source(t).drop("nation"), _lookups(t)[0])


@query("lookup_customer_nation", _LOOK_SQL + "SELECT * FROM res")
def lookup_customer_nation(t):
    return lookup.resolve_lookups(_lookup_source(t), _lookups(t))


@query("lookup_large_parent", _LOOK_SQL + "SELECT o_orderkey, account FROM res")
def lookup_large_parent(t):
    return lookup.resolve_lookup(_lookup_source(t).drop("nation"), _lookups(t)[0], broadcast_bytes=0)


@query("lookup_large_dictionary", _LOOK_SQL + "SELECT * FROM res")
def lookup_large_dictionary(t):
    return lookup.resolve_lookups(_lookup_source(t), _lookups(t), broadcast_bytes=0)


@query(
    "lookup_report",
    _LOOK_SQL + """SELECT 'account' AS field, count(DISTINCT account) AS resolved_values FROM src JOIN acc ON acc.k = account WHERE NOT regexp_matches(account, '^[A-Za-z0-9]{15}$')
    UNION ALL SELECT 'nation', count(DISTINCT nation) FROM src JOIN nat ON nat.k = nation""",
)
def lookup_report(t):
    return lookup.lookup_report(_lookup_source(t), _lookups(t))


_CAT_SQL = _LOOK_SQL.rstrip() + """, a AS (SELECT r.o_orderkey, r.account, r.nation, o_orderpriority AS priority, 'K' || o_orderkey % 9000 AS code FROM res r JOIN orders USING (o_orderkey)),
f AS (SELECT a.*, a.account = s.account AS u1, a.nation = s.nation AS u2, priority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') AS p,
  count(*) OVER (PARTITION BY code) > 1 AS q FROM a JOIN src s USING (o_orderkey)),
g AS (SELECT *, CASE WHEN u1 OR u2 OR p OR q THEN 'FAILURE' ELSE 'SUCCESS' END AS "Transform_Status" FROM f)
"""


def _categorized(t, joined: bool = False):
    """``joined`` compares with the earlier frame by a join, else the earlier values travel with the rows."""
    before = _lookup_source(t).join(t.orders.selectExpr("o_orderkey", "o_orderpriority AS priority", "'K' || o_orderkey % 9000 AS code"), "o_orderkey")
    after = lookup.resolve_lookups(before if joined else lookup.keep_before(before, ["account", "nation"]), _lookups(t))
    fields = [
        dict(name="priority", type="picklist", picklist=[("1-URGENT", True), ("2-HIGH", True), ("3-MEDIUM", True), ("4-NOT SPECIFIED", True), ("5-LOW", False)]),
        dict(name="code", type="string", is_unique=True),
    ]
    cat = cat_ops.catalog_rows(t.spark, [{"object": "Order"} | f for f in fields])
    return lookup.categorize_transform(after, before if joined else None, "o_orderkey", ["account", "nation"], cat)


@query(
    "categorize_orders",
    _CAT_SQL + """SELECT o_orderkey, "Transform_Status", CASE WHEN "Transform_Status" = 'SUCCESS' THEN 'All validations passed (lookup fields transformed, picklist values valid, unique fields unique)'
      ELSE concat_ws('; ', CASE WHEN u1 OR u2 THEN 'Unchanged lookup fields: [' || concat_ws(', ', CASE WHEN u1 THEN '''account''' END, CASE WHEN u2 THEN '''nation''' END) || ']' END,
        CASE WHEN p THEN 'Invalid picklist values: [''priority'']' END, CASE WHEN q THEN 'Duplicate unique field values: [''code'']' END) END AS "Transform_Reason",
      CASE WHEN "Transform_Status" = 'SUCCESS' THEN 'All validations passed' ELSE concat_ws('; ',
        CASE WHEN u1 OR u2 THEN 'Unchanged: ' || concat_ws(', ', CASE WHEN u1 THEN 'account' END, CASE WHEN u2 THEN 'nation' END) END,
        CASE WHEN p THEN 'Invalid picklist priority: ''' || priority || '''' END, CASE WHEN q THEN 'Duplicate unique code: ''' || code || '''' END) END AS "Validation_Details" FROM g""",
)
def categorize_orders(t):
    return _categorized(t).select("o_orderkey", "Transform_Status", "Transform_Reason", "Validation_Details")


@query(
    "transform_summary",
    _CAT_SQL + """SELECT count(*) FILTER ("Transform_Status" = 'SUCCESS') AS success_count, count(*) FILTER ("Transform_Status" = 'FAILURE') AS failure_count, count(*) AS total_count,
    round(count(*) FILTER ("Transform_Status" = 'SUCCESS') * 100.0 / count(*), 6) AS success_percentage, round(count(*) FILTER ("Transform_Status" = 'FAILURE') * 100.0 / count(*), 6) AS failure_percentage,
    count(*) FILTER (u1 OR u2) AS lookup_failures, count(*) FILTER (p) AS picklist_failures, count(*) FILTER (q) AS unique_failures FROM g""",
)
def transform_summary(t):
    out = lookup.transform_summary(_categorized(t, joined=True))
    return out.withColumns({c: F.round(c, 6) for c in ("success_percentage", "failure_percentage")})


@query(
    "attach_outcomes_orders",
    "SELECT o_orderkey, o_totalprice, o_orderkey % 7 <> 0 AND o_orderkey % 10 <> 0 AS success, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 10 <> 0 THEN 'DUPLICATE_VALUE' END AS errors FROM orders",
)
def attach_outcomes_orders(t):
    results = t.orders.filter("o_orderkey % 10 <> 0").selectExpr(
        "o_orderkey AS row_id", "o_orderkey % 7 <> 0 AS success", "CASE WHEN o_orderkey % 7 = 0 THEN 'DUPLICATE_VALUE' END AS errors"
    )
    return lookup.attach_outcomes(t.orders.select("o_orderkey", "o_totalprice"), results, "o_orderkey")


# --- loads --------------------------------------------------------------------------------------


@query(
    "batch_orders",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index, (row_number() OVER (ORDER BY o_orderkey) - 1) // 700 + 1 AS batch_num FROM orders",
)
def batch_orders(t):
    return load.assign_batches(t.orders.select("o_orderkey"), ["o_orderkey"], 700)


@query(
    "batch_lineitem_ties",
    "SELECT l_returnflag, batch_num, count(*) AS n FROM (SELECT l_returnflag, (row_number() OVER (ORDER BY l_returnflag) - 1) // 1000 + 1 AS batch_num FROM lineitem) GROUP BY 1, 2",
)
def batch_lineitem_ties(t):
    return load.assign_batches(t.lineitem, ["l_returnflag"], 1000).groupBy("l_returnflag", "batch_num").agg(F.count("*").alias("n"))


_RESULT_SQL = """WITH b AS (SELECT o_orderkey, o_custkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 700 + 1 AS batch_num FROM orders),
r AS (SELECT *, CASE WHEN batch_num = 2 THEN true WHEN batch_num = 1 THEN false ELSE o_orderkey % 9 <> 0 END AS success,
  CASE WHEN o_custkey % 2 = 0 THEN ['FIELD_INTEGRITY: bad ' || o_custkey % 3, 'LIMIT: too many'] WHEN o_custkey % 5 = 0 THEN [] ELSE ['REQUIRED_FIELD_MISSING: Name'] END AS errors FROM b) """


def _load_results(t):
    batched = load.assign_batches(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], 700).drop("row_index")
    return batched.selectExpr(
        "*",
        "CASE WHEN batch_num = 2 THEN true WHEN batch_num = 1 THEN false ELSE o_orderkey % 9 <> 0 END AS success",
        "CASE WHEN o_custkey % 2 = 0 THEN array('FIELD_INTEGRITY: bad ' || o_custkey % 3, 'LIMIT: too many') WHEN o_custkey % 5 = 0 "
        "THEN CAST(array() AS ARRAY<STRING>) ELSE array('REQUIRED_FIELD_MISSING: Name') END AS errors",
        "'insert' AS operation",
        "'R' || o_orderkey AS id",
    )


@query("retry_rows", _RESULT_SQL + "SELECT o_orderkey, o_custkey FROM r WHERE NOT success")
def retry_rows(t):
    return load.retry_rows(_load_results(t), ["o_orderkey", "o_custkey"])


@query(
    "failed_rows",
    _RESULT_SQL + """SELECT o_orderkey, o_custkey, CASE WHEN len(errors) = 0 THEN 'Unknown error' ELSE array_to_string(errors, '; ') END AS "Error_Summary",
    CASE WHEN len(errors) = 0 THEN '' ELSE array_to_string(errors, ' | ') END AS "Full_Error_Details", batch_num AS "Batch_Number", 'insert' AS "Failed_Operation" FROM r WHERE NOT success""",
)
def failed_rows(t):
    return load.failed_rows(_load_results(t), ["o_orderkey", "o_custkey"])


@query("success_rows", _RESULT_SQL + 'SELECT o_orderkey, \'R\' || o_orderkey AS "Record_ID", \'insert\' AS "Operation", batch_num AS "Batch_Number" FROM r WHERE success')
def success_rows(t):
    return load.success_rows(_load_results(t), ["o_orderkey"])


@query(
    "batch_report",
    _RESULT_SQL + """SELECT batch_num AS "Batch_Number", count(*) AS "Batch_Records", count(*) FILTER (success) AS "Batch_Success", count(*) FILTER (NOT success) AS "Batch_Errors",
    0.0::DOUBLE AS "Batch_Processing_Time_Seconds", round(count(*) FILTER (success) * 100.0::DOUBLE / count(*), 2) AS "Batch_Success_Rate_Percent",
    round(count(*) FILTER (NOT success) * 100.0::DOUBLE / count(*), 2) AS "Batch_Error_Rate_Percent",
    CASE WHEN count(*) FILTER (NOT success) = 0 THEN 'SUCCESS' WHEN count(*) FILTER (success) > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS "Batch_Status" FROM r GROUP BY batch_num""",
)
def batch_report(t):
    return load.batch_report(load.batch_results(_load_results(t)))


@query(
    "load_summary",
    _RESULT_SQL + """SELECT count(*) AS "Total_Records", count(*) FILTER (success) AS "Total_Success", count(*) FILTER (NOT success) AS "Total_Errors", CAST(0 AS BIGINT) AS "Total_Unprocessed",
    round(count(*) FILTER (success) * 100.0::DOUBLE / count(*), 2) AS "Success_Rate_Percent", round(count(*) FILTER (NOT success) * 100.0::DOUBLE / count(*), 2) AS "Error_Rate_Percent",
    count(DISTINCT batch_num) AS "Total_Batches" FROM r""",
)
def load_summary(t):
    return load.load_summary(load.batch_results(_load_results(t))).drop("Processing_Duration_Seconds")


@query(
    "error_groups_orders",
    _RESULT_SQL + """SELECT CASE WHEN len(errors) = 0 THEN 'Unknown error' ELSE split_part(array_to_string(errors, '; '), ':', 1) END AS error_type, count(*) AS records
    FROM r WHERE NOT success GROUP BY 1""",
)
def error_groups_orders(t):
    return load.error_groups(load.failed_rows(_load_results(t), ["o_orderkey"]))


@query(
    "error_groups_full",
    _RESULT_SQL + """SELECT CASE WHEN len(errors) = 0 THEN 'Unknown error' ELSE array_to_string(errors, '; ') END AS error_type, count(*) AS records
    FROM r WHERE NOT success GROUP BY 1""",
)
def error_groups_full(t):
    return load.error_groups(load.failed_rows(_load_results(t), ["o_orderkey"]), by_type=False)


@query(
    "error_groups_events",
    "SELECT event_type AS error_type, count(*) AS records FROM events GROUP BY 1",
)
def error_groups_events(t):
    return load.error_groups(t.events.selectExpr("event_type || ': ' || value AS Error_Summary"))


@query(
    "load_outcome_level",
    _RESULT_SQL + """SELECT batch_num, CASE WHEN count(*) FILTER (NOT success) = 0 THEN 'Perfect' WHEN count(*) FILTER (success) * 100.0 / count(*) >= 90 THEN 'Great'
    WHEN count(*) FILTER (success) * 100.0 / count(*) >= 70 THEN 'Good' ELSE 'Many failed' END AS outcome FROM r GROUP BY 1""",
)
def load_outcome_level(t):
    b = load.batch_results(_load_results(t))
    rate = F.col("success_count") * 100.0 / F.col("total_records")
    return b.select("batch_num", load.outcome_level(rate, F.col("error_count")).alias("outcome"))


_UPSERT_SQL = """WITH src AS (SELECT c_custkey + 100 AS k, 'new ' || c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer
  UNION ALL SELECT c_custkey + 100, 'copy', 0.0 FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT NULL, 'none', 1.0 FROM customer WHERE c_custkey % 50 = 0),
tgt AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg FROM customer),
n AS (SELECT *, count(*) OVER (PARTITION BY k) AS copies FROM src), ok AS (SELECT * FROM n WHERE k IS NOT NULL AND copies = 1) """


def _upsert(t, op: str):
    target = t.customer.selectExpr("c_custkey AS k", "c_name AS name", "c_acctbal AS bal", "c_mktsegment AS seg")
    source = (
        t.customer.selectExpr("c_custkey + 100 AS k", "'new ' || c_name AS name", "CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS bal")
        .unionByName(t.customer.filter("c_custkey % 10 = 0").selectExpr("c_custkey + 100 AS k", "'copy' AS name", "0.0D AS bal"))
        .unionByName(t.customer.filter("c_custkey % 50 = 0").selectExpr("CAST(NULL AS BIGINT) AS k", "'none' AS name", "1.0D AS bal"))
    )
    return load.upsert(source, target, "k", op)


@query(
    "upsert_customer",
    _UPSERT_SQL + """SELECT COALESCE(ok.k, tgt.k) AS k, COALESCE(ok.name, tgt.name) AS name, COALESCE(ok.bal, tgt.bal) AS bal, seg FROM tgt FULL JOIN ok ON ok.k = tgt.k""",
)
def upsert_customer(t):
    return load.upsert_snapshot(_upsert(t, "upsert"))


@query(
    "upsert_outcomes",
    _UPSERT_SQL + """SELECT outcome, error, count(*) AS n FROM (SELECT CASE WHEN n.k IS NULL OR copies > 1 THEN 'error' WHEN tgt.k IS NULL THEN 'created' ELSE 'updated' END AS outcome,
      CASE WHEN n.k IS NULL THEN 'MISSING_VALUE: key is null' WHEN copies > 1 THEN 'DUPLICATE_VALUE: key repeats in the source' END AS error FROM n LEFT JOIN tgt ON tgt.k = n.k) GROUP BY 1, 2""",
)
def upsert_outcomes(t):
    return load.upsert_outcomes(_upsert(t, "upsert")).groupBy("outcome", "error").agg(F.count("*").alias("n"))


@query(
    "insert_customer",
    _UPSERT_SQL + """SELECT k, name, bal, seg FROM tgt UNION ALL SELECT ok.k, ok.name, ok.bal, NULL FROM ok LEFT JOIN tgt ON tgt.k = ok.k WHERE tgt.k IS NULL""",
)
def insert_customer(t):
    return load.upsert_snapshot(_upsert(t, "insert"))


@query(
    "update_customer",
    _UPSERT_SQL + """SELECT tgt.k, COALESCE(ok.name, tgt.name) AS name, COALESCE(ok.bal, tgt.bal) AS bal, seg FROM tgt LEFT JOIN ok ON ok.k = tgt.k""",
)
def update_customer(t):
    return load.upsert_snapshot(_upsert(t, "update"))


@query("concat_batches", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 2 END AS batch FROM orders")
def concat_batches(t):
    parts = [
        t.orders.filter(F.col("o_custkey") % 2 == i).select("o_orderkey", F.lit(i + 1).alias("batch")) for i in (0, 1)
    ]
    return load.in_batch_order(parts, ["batch", "o_orderkey"])


# --- sinks -----------------------------------------------------------------------------------------


@query(
    "write_split_orders",
    """SELECT CASE WHEN o_orderpriority = '5-LOW' OR length(o_orderpriority) > 10 THEN 'invalid' ELSE 'valid' END AS part, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""",
)
def write_split_orders(t):
    path = _scratch(t, "split")
    sinks.write_split(checks.validate_schema(_mapped_orders(t), _order_catalog(t)), path)
    parts = [t.spark.read.option("header", True).csv(f"{path}/{p}").withColumn("part", F.lit(p)) for p in ("valid", "invalid")]
    return parts[0].unionByName(parts[1]).groupBy("part").agg(
        F.count("*").alias("rows"), F.sum(F.col("OrderNumber").cast("long")).alias("keys")
    )


@query("split_write_orders", "SELECT count(*) AS rows, (count(*) + 999) // 1000 <= 1 AS single FROM orders")
def split_write_orders(t):
    path = _scratch(t, "parts")
    sinks.split_write(t.orders.select("o_orderkey"), path, above=1000, per_file=1000)
    back = t.spark.read.option("header", True).csv(path).select(F.input_file_name().alias("f"))
    return back.agg(F.count("*").alias("rows"), (F.countDistinct("f") == 1).alias("single"))


@query(
    "verify_load_orders",
    "SELECT count(*) FILTER (o_orderkey % 10 <> 0) AS loaded_rows, count(*) AS expected_rows, count(*) FILTER (o_orderkey % 10 = 0) = 0 AS complete FROM orders",
)
def verify_load_orders(t):
    return sinks.verify_load(t.orders.filter("o_orderkey % 10 <> 0"), t.orders)


@query(
    "load_table_modes",
    """WITH c AS (SELECT count(*) AS n, sum(c_custkey) AS k, count(*) FILTER (c_custkey % 2 = 0) AS even, sum(c_custkey) FILTER (c_custkey % 2 = 0) AS even_k FROM customer)
    SELECT 'create' AS mode, n AS rows, k::BIGINT AS keys, false AS refused FROM c UNION ALL SELECT 'append', n + even, (k + even_k)::BIGINT, false FROM c UNION ALL SELECT 'truncate', even, even_k::BIGINT, false FROM c
    UNION ALL SELECT 'delete', n, k::BIGINT, false FROM c UNION ALL SELECT 'replace', even, even_k::BIGINT, false FROM c
    UNION ALL SELECT 'create again', 0, 0, true FROM c UNION ALL SELECT 'append to none', 0, 0, true FROM c""",
)
def load_table_modes(t):
    """All modes one after the other on a new table; the replacing ones read the table that they replace."""
    table = f"load_modes_{uuid.uuid4().hex}"
    columns = ["c_custkey", "c_name", "c_acctbal"]
    whole, even = t.customer.select(*columns), t.customer.filter("c_custkey % 2 = 0").select(*columns)
    seen: list[tuple] = []

    def load_in(mode: str, df, shown: str | None = None) -> None:
        try:
            sinks.load_table(df, table, mode)
        except ValueError:
            seen.append((shown or mode, 0, 0, True))
            return
        now = t.spark.table(table).agg(F.count("*"), F.sum("c_custkey")).first()
        seen.append((shown or mode, now[0], now[1], False))

    try:
        load_in("append", whole, "append to none")
        load_in("create", whole)
        load_in("create", whole, "create again")
        load_in("append", even)
        load_in("truncate", t.spark.table(table).distinct().filter("c_custkey % 2 = 0"))
        load_in("delete", whole)
        load_in("replace", t.spark.table(table).filter("c_custkey % 2 = 0"))
    finally:
        t.spark.sql(f"DROP TABLE IF EXISTS {table}")
    return t.spark.createDataFrame(seen, "mode string, rows long, keys long, refused boolean")


@query(
    "scan_run_logs_events",
    """SELECT event_type AS operation, 'user ' || (user_id % 5) AS object, 'org' AS org, count(*) AS records, count(*) FILTER (value >= 5) AS success, count(*) FILTER (value < 5) AS errors,
      round(count(*) FILTER (value < 5) * 100.0 / count(*), 2) AS error_rate, CAST(NULL AS INT) AS batch_number, max(date_trunc('second', ts)) AS timestamp FROM events GROUP BY 1, 2
    UNION ALL SELECT NULL, NULL, NULL, count(*), count(*) FILTER (value >= 5), count(*) FILTER (value < 5), NULL, (event_id // 500)::INT + 1, NULL FROM events GROUP BY event_id // 500""",
)
def scan_run_logs_events(t):
    """Log files of both kinds written from ``events``, in folders, and scanned."""
    path = _scratch(t, "logs")
    good, bad = F.count_if(F.col("value") >= 5), F.count_if(F.col("value") < 5)
    null = F.lit(None).cast("string")
    runs = t.events.groupBy("event_type", (F.col("user_id") % 5).alias("u")).agg(
        F.count("*").alias("n"), good.alias("good"), bad.alias("bad"), F.date_format(F.max(F.date_trunc("second", "ts")), "yyyy-MM-dd HH:mm:ss").alias("at")
    )
    summary = runs.select(
        F.col("at").alias("Start_Time"), F.col("at").alias("End_Time"), F.lit("1.0").alias("Processing_Duration_Seconds"), null.alias("Processing_Duration_Formatted"),
        F.col("n").alias("Total_Records"), F.col("good").alias("Total_Success"), F.col("bad").alias("Total_Errors"), F.lit(0).alias("Total_Unprocessed"), null.alias("Success_Rate_Percent"),
        F.round(F.col("bad") * 100.0 / F.col("n"), 2).alias("Error_Rate_Percent"), F.col("event_type").alias("Operation"), F.concat(F.lit("user "), F.col("u").cast("string")).alias("Salesforce_Object"),
        F.lit("org").alias("Salesforce_Org"), null.alias("Total_Batches"), null.alias("Parallel_Processing"), F.col("at").alias("Log_Generated_At"),
    )
    batches = t.events.groupBy((F.floor(F.col("event_id") / 500) + 1).cast("int").alias("b")).agg(F.count("*").alias("n"), good.alias("good"), bad.alias("bad"))
    details = batches.select(
        F.col("b").alias("Batch_Number"), F.col("n").alias("Batch_Records"), F.col("good").alias("Batch_Success"), F.col("bad").alias("Batch_Errors"), F.lit("1.0").alias("Batch_Processing_Time_Seconds"),
        null.alias("Batch_Success_Rate_Percent"), null.alias("Batch_Error_Rate_Percent"), F.lit("PARTIAL").alias("Batch_Status"), null.alias("Error_Details"),
    )
    for frame, folder, name in ((summary, "run1", "processing_summary"), (details, "run1/batches", "batch_processing_details")):
        written = f"{path}/{name}-new"
        frame.coalesce(1).write.option("header", True).csv(written)
        file = t.spark.read.csv(written).inputFiles()[0]
        session.make_folder(t.spark, f"{path}/logs/{folder}")
        session.move(t.spark, file, f"{path}/logs/{folder}/{name}.csv")
    return files.scan_run_logs(t.spark, f"{path}/logs").drop("file_path")


# --- flows -------------------------------------------------------------------------------------------


@query(
    "transform_flow_orders",
    _LOOK_SQL.rstrip() + """, f AS (SELECT r.o_orderkey AS key, r.account AS "Account", CASE WHEN r.account = s.account THEN 'FAILURE' ELSE 'SUCCESS' END AS "Transform_Status"
      FROM res r JOIN src s USING (o_orderkey)) SELECT key AS "Key", "Account", "Transform_Status" FROM f""",
)
def transform_flow_orders(t):
    accounts = _lookups(t)[0]
    cat = cat_ops.catalog_rows(t.spark, [{"object": "Order", "name": "Account", "type": "reference", "reference_to": "Customer"}])
    out = flows.transform(
        _lookup_source(t), {"o_orderkey": "Key", "account": "Account"}, "Key", [lookup.Lookup("Account", accounts.parent)], cat
    )
    return out.select("Key", "Account", "Transform_Status")


@query(
    "load_flow_customer",
    """WITH b AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 + 1 AS batch_num FROM customer)
    SELECT batch_num AS "Batch_Number", count(*) AS "Batch_Records", count(*) FILTER (c_custkey % 3 <> 0) AS "Batch_Success", count(*) FILTER (c_custkey % 3 = 0) AS "Batch_Errors" FROM b GROUP BY 1""",
)
def load_flow_customer(t):
    source = t.customer.select("c_custkey", "c_name")
    target = t.customer.filter("c_custkey % 3 = 0").select("c_custkey", "c_name", "c_mktsegment")
    batches = flows.load_batches(source, target, "c_custkey", "insert", 100)[2]
    return batches.select("Batch_Number", "Batch_Records", "Batch_Success", "Batch_Errors")
