"""Small fixed cases of business rules."""

import datetime as dt

from pyspark.sql import functions as F

from siftline.functions import formula as X
from siftline.operators import checks, constraints, coverage, mapping, report, rules

AS_OF = dt.date(2024, 1, 1)
RULES = "rule_name string, error_message string, error_field string, mappings map<string,string>, active boolean, description string"


def _names(spark):
    rows = [("John Doe", "001"), ("", "002"), ("Jane Smith", "003"), (None, "004"), ("Bob Wilson", "005")]
    return spark.createDataFrame(rows, "Name string, Id string")


def test_blank_name_rule(spark):
    checked = rules.validate_frame(_names(spark), [rules.Rule("Name_Not_Empty", X.ISBLANK("Name"))])
    assert {r["Id"]: r["is_valid"] for r in checked.collect()} == {
        "001": True, "002": False, "003": True, "004": False, "005": True,
    }
    assert rules.run_summary(checked).first().asDict() == {
        "total_records": 5, "valid_records": 3, "invalid_records": 2, "success_rate": 60.0,
    }
    good, bad = rules.split_valid(checked)
    assert (good.count(), bad.count()) == (3, 2)


def test_two_rules_and_mapping(spark):
    rows = [("John Doe", "123-456-7890", "001"), ("", "987-654-3210", "002"), ("Jane Smith", "", "003"), (None, None, "004"),
            ("Bob Wilson", "555-123-4567", "005")]
    df = spark.createDataFrame(rows, "Customer_Name string, Contact_Phone string, Record_ID string")
    mapped = mapping.apply_mapping(df, {"Customer_Name": "Name", "Contact_Phone": "Phone", "Record_ID": "Id", "Gone": "X"})
    assert mapped.columns == ["Name", "Phone", "Id"]
    table = spark.createDataFrame(
        [("r", "Name IS NULL OR Name = ''", "true"), ("r", "Phone IS NULL OR Phone = ''", "1"), ("off", "true", "no")],
        "rule_name string, predicate string, active string",
    )
    checked = rules.validate_frame(mapped, table)
    assert {r["Id"] for r in checked.filter("is_valid").collect()} == {"001", "005"}
    assert {v["rule"] for r in checked.collect() for v in r["violations"]} == {"r", "r_1"}


def test_missing_column_fails_and_null_condition_passes(spark):
    df = _names(spark)
    checked = rules.validate_frame(df, [rules.Rule("gone", "no_such_column = 1")])
    assert checked.filter("is_valid").count() == 0
    checked = rules.validate_frame(df, [rules.Rule("null", "Name = 'x'")])
    assert checked.filter("is_valid").count() == 5


def test_formula_rules(spark):
    df = spark.createDataFrame([("A", "a@b.co", "0123456789"), ("", "bad", "123"), (None, "", None)], "Name string, Email string, Phone string")
    listed = [
        rules.Rule("Required_Name", X.ISBLANK("Name")),
        rules.Rule("Email_Format", X.AND(~X.ISBLANK("Email"), X.NOT(X.REGEX("Email", r"[a-z.]+@[a-z.]+\.[a-z]{2,}$")))),
        rules.Rule("Phone_Length", X.AND(~X.ISBLANK("Phone"), X.LEN_COMPARE("Phone", "<", 10))),
    ]
    found = [sorted(v["rule"] for v in r["violations"]) for r in rules.validate_frame(df, listed).collect()]
    assert found == [[], ["Email_Format", "Phone_Length", "Required_Name"], ["Required_Name"]]


ONE_ROW = [
    ("Account Name is required and cannot be blank", "account_name", "", False),
    ("Age must be between 18 and 65 years old", "age", "15", False),
    ("Phone number must be at least 10 characters long", "phone", "123456", False),
    ("Please enter a valid email address format", "email", "invalid-email", False),
    ("Salary must be at least 30000 dollars", "salary", "25000", False),
    ("Account Name is required and cannot be blank", "account_name", "ACME Corp", True),
    ("Age must be between 18 and 65 years old", "age", "25", True),
    ("Start date must be a past date", "start_date", "2023-05-01", True),
    ("Start date must be a past date", "start_date", "2024-05-01", False),
    ("Code should be alphanumeric", "code_x", "a-1", False),
    ("This is not allowed", "name", "", False),
    ("Region policy applies", "name", "", False),
    ("Just text", "name", "", True),
]


def test_message_rules_one_row_each(spark):
    # One column per case, so that all cases are rules on the same row.
    df = spark.createDataFrame(
        [(1, *[v for _, _, v, _ in ONE_ROW])], "id int, " + ", ".join(f"c{i} string" for i in range(len(ONE_ROW)))
    )
    table = spark.createDataFrame(
        [(f"r{i}", m, c, {c: f"c{i}"}, True, "") for i, (m, c, _, _) in enumerate(ONE_ROW)], RULES
    )
    expected = {f"r{i}" for i, case in enumerate(ONE_ROW) if not case[3]}
    for inline in (0, 100):
        checked = rules.message_rule_check(df, table, "id", AS_OF, inline_rules=inline)
        assert {v["rule"] for v in checked.first()["violations"]} == expected


def test_five_rows_by_six_message_rules(spark):
    schema = "id int, AccountName string, Age int, Email string, Salary int, PhoneNumber string, ProductCode string"
    rows = [
        (0, "ACME Corp", 25, "test@example.com", 50000, "123-456-7890", "ABC12"),
        (1, "", 15, "invalid-email", 25000, "123", "TOOLONGCODE123456"),
        (2, "Test Company", 45, "user@domain.com", 75000, "987-654-3210", "XYZ89"),
        (3, None, 70, "", 150000, "555-1234", "A"),
        (4, "Valid Corp", 35, "good@email.com", 45000, "800-555-1212", "VALID"),
    ]
    df = spark.createDataFrame(rows, schema)
    messages = [
        ("account", "Account Name is required and cannot be blank", "AccountName"),
        ("age", "Age must be between 18 and 65 years old", "Age"),
        ("email", "Please enter a valid email address format", "Email"),
        ("salary", "Salary must be at least 30000 dollars", "Salary"),
        ("phone", "Phone number must be at least 10 characters long", "PhoneNumber"),
        ("code", "Product code must be between 3 and 8 characters", "ProductCode"),
    ]
    table = spark.createDataFrame([(n, m, f, {f: f}, True, "") for n, m, f in messages], RULES)
    expected = {0: [], 1: sorted(n for n, _, _ in messages), 2: [], 3: ["account", "age", "code", "email", "phone"], 4: []}
    for inline in (0, 200):
        checked = rules.message_rule_check(df, table, "id", AS_OF, inline_rules=inline)
        assert {r["id"]: sorted(v["rule"] for v in r["violations"]) for r in checked.collect()} == expected

    found = constraints.extract_constraints(
        spark.createDataFrame([(n, f, m) for n, m, f in messages], "rule_name string, field string, text string"), "text"
    )
    verdicts = constraints.apply_constraints(df, "id", found).filter("NOT passed").groupBy("row_id").agg(
        F.sort_array(F.collect_list("rule_name")).alias("rules")
    )
    assert {r["row_id"]: r["rules"] for r in verdicts.collect()} == {k: v for k, v in expected.items() if v}


def test_unmapped_rules_pass_and_count_as_skipped(spark):
    rows = [("a", "Name is required", "Name", {}, True, ""), ("b", "x", "", {}, False, ""), ("c", "Name is required", "Name", {"Name": "name"}, True, "")]
    table = spark.createDataFrame(rows, RULES)
    assert rules.rule_applicability(table).first().asDict() == {
        "total_rules": 3, "active_rules": 2, "rules_applied": 1, "rules_skipped": 1,
    }
    df = spark.createDataFrame([(1, "")], "id int, name string")
    checked = rules.message_rule_check(df, table, "id", AS_OF)
    assert [v["rule"] for v in checked.first()["violations"]] == ["c"]


MESSAGES = [
    ("Account Name is required and cannot be blank", "Account Name", "required_validation"),
    ("Age must be between 18 and 65 years", "Age", "range_validation"),
    ("Please enter a valid email address format", "address", "format_validation"),
    ("Phone number must be at least 10 characters long", "Phone", "length_validation"),
    ('Status must be one of "Active", "Inactive", or "Pending"', "Status", "allowed_values_validation"),
    ("Salary must be at least 30000 for this position", "Salary", "minimum_validation"),
    ("Product code length must be between 5 and 12 characters", "Product code", "length_range_validation"),
    ("Start Date must be in valid date format (MM/DD/YYYY)", "Start Date", "format_validation"),
    ('Annual Revenue cannot exceed 1000000 when Company Type is "Small Business"', "Annual Revenue", "maximum_validation"),
    ('SKU format must be "ABC-123" pattern with 3 letters, dash, and 3 numbers', "SKU", "format_validation"),
]


def test_fields_and_constraints_of_messages(spark):
    df = spark.createDataFrame(MESSAGES, "text string, field string, logic string")
    out = constraints.extract_constraints(constraints.extract_fields(df, "text"), "text").withColumn("got", constraints.classify_logic())
    for r in out.collect():
        assert r["got"] == r["logic"], r["text"]
        assert any(r["field"].lower() in f.lower() for f in r["fields"]), (r["text"], r["fields"])
    last = out.filter(F.col("text").startswith("SKU")).first()
    assert last["format_pattern"] == "ABC-123"
    condition = out.filter(F.col("text").startswith("Annual")).first()
    assert (condition["max_value"], condition["condition_field"], condition["condition_value"]) == (1000000.0, "Company Type", "Small Business")


def test_picture_pattern(spark):
    df = spark.createDataFrame([("ABC-123", "XYZ-999"), ("ABC-123", "XY-999"), ("A.1", "Bx1")], "p string, v string")
    got = [r[0] for r in df.select(F.regexp("v", constraints.picture_pattern(F.col("p")))).collect()]
    assert got == [True, False, False]


def test_test_results(spark):
    rows = [("s", "PASS")] * 10 + [("s", "pass")] * 2 + [("s", "FAIL")] * 3
    df = spark.createDataFrame(rows, "suite string, status string")
    got = coverage.suite_overview(df).first()
    assert (got["total_tests"], got["passed"], got["failed"], got["pass_rate"]) == (15, 12, 3, 80.0)


def test_order_of_priorities(spark):
    rows = [(1, "low"), (2, "high"), (3, "medium"), (4, "high"), (5, "low"), (6, "low")]
    df = spark.createDataFrame(rows, "position long, risk_level string")
    balanced = [r["position"] for r in report.prioritize(df, "balanced", "position").collect()]
    assert balanced == [2, 3, 1, 4, 5, 6]
    assert [r["position"] for r in report.prioritize(df, "high_first", "position").collect()] == [2, 4, 3, 1, 5, 6]


def test_warnings_can_be_let_through(spark):
    df = spark.createDataFrame([("1234567",)], "note string")
    c = checks.values.cell(df, "note")
    found = checks.field_checks(c, checks.Field("note", "text"))
    assert checks.with_violations(df, found).first()["is_valid"] is False
    lenient = checks.with_violations(df, found, warnings_fail=False).first()
    assert lenient["is_valid"] is True and len(lenient["violations"]) == 1


def _picklist_issues(spark, n):
    from siftline.operators import catalog as cat_ops
    from siftline.operators import checks

    values = [(f" v{i} ", True) for i in range(n)] + [("old", False)]
    fields = [dict(object="A", name="p", type="picklist", picklist=values), dict(object="A", name="s", type="string", picklist=values)]
    cat = cat_ops.catalog_rows(spark, fields)
    df = spark.createDataFrame([(1, " v1 ", "x"), (2, "v1", "x"), (3, "old", "x"), (4, "", "x"), (5, None, "x")], "id int, p string, s string")
    checked = checks.validate_schema(df, cat, {"p": "p", "s": "s"}).orderBy("id")
    verdicts = [(r["id"], [(v["rule"], v["message"]) for v in r["violations"]]) for r in checked.collect()]
    return verdicts, [r["Issues"] for r in checks.issues_column(df, cat).orderBy("id").collect()]


def test_picklist_size_changes_no_answer(spark, monkeypatch):
    small = _picklist_issues(spark, 1000)
    assert small == _picklist_issues(spark, 1001)
    assert small[1] == ["", "", "Invalid picklist value in 'p'", "", ""]
    assert [i for i, v in small[0] if v] == [2, 3]


def test_rule_number_changes_no_answer(spark):
    import datetime as dt

    from siftline.operators import rules

    texts = ["must be a positive number", "is required", "must be at least 3 characters", "must be a date in the future", "must be unique", "between 1 and 5"]
    names = ("id", "amount", "flag", "day")
    table = spark.createDataFrame(
        [(f"r{i}", f"{c} {t}", c, {n: n for n in names}, True, "") for i, (c, t) in enumerate((c, t) for t in texts for c in (*names, "other"))], RULES
    )
    df = spark.createDataFrame(
        [(1, 2.5, True, "2030-01-01"), (1, -1.0, False, "x"), (None, None, None, ""), (2, 7.0, True, "2001-05-05")], "id int, amount double, flag boolean, day string"
    )
    frames = []
    for limit in (0, 10**9):
        out = rules.message_rule_check(df, table, "id", dt.date(2024, 1, 1), inline_rules=limit)
        frames.append([tuple(r) for r in out.collect()])
    assert frames[0] == frames[1]
    assert any(r[-2] for r in frames[0])


def test_predicate_that_cannot_be_evaluated_fails_its_rows(spark):
    from siftline.operators import rules

    df = spark.range(3)
    listed = [rules.Rule("syntax", "id ) <"), rules.Rule("function", "no_such_function(id)"), rules.Rule("column", "nowhere = 1"), rules.Rule("good", "id = 1")]
    out = rules.validate_frame(df, listed).orderBy("id").collect()
    assert [r["error_count"] for r in out] == [3, 4, 3]


def test_rules_that_ask_the_same_are_one_test(spark, monkeypatch):
    from siftline import session

    asked = [
        "must be a past date", "must be after today", "is not a date", "should be a negative number", "must be an integer", "value must be a number",
        "length must be minimum 3 maximum 5", "is too long", "is too short", "format must be uppercase", "format: postal code", "is required",
        "must be at least 4 characters", "must be between 1 and 5", "", "is unique",
    ]
    names = ("id", "amount", "flag", "day")
    table = spark.createDataFrame(
        [(f"r{i}", f"{c} {a}" if a else "", c, {n: n for n in names}, True, "x" * i) for i, (c, a) in enumerate((c, a) for _ in range(3) for a in asked for c in (*names, "other"))],
        RULES,
    )
    df = spark.createDataFrame(
        [(1, 2.5, True, "2030-01-01"), (1, -1.0, False, "x"), (None, None, None, ""), (2, 7.0, True, "2001-05-05"), (2, 7.0, True, "ABCDE")],
        "id int, amount double, flag boolean, day string",
    )
    inline = rules.message_rule_check(df, table, "id", AS_OF, inline_rules=10**9).collect()
    by_tests = rules.message_rule_check(df, table, "id", AS_OF, inline_rules=0)
    assert by_tests.collect() == inline and any(r["violations"] for r in inline)
    # More text of rules than a task should hold: still every violation, and none is made for the count alone.
    size = session.measured_bytes
    monkeypatch.setattr(session, "measured_bytes", lambda staged, columns: (1, 2**40) if "error_message" in columns else size(staged, columns))
    joined = rules.message_rule_check(df, table, "id", AS_OF, inline_rules=0)
    order = [x["error_count"] for x in inline]
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, inline))
    counts = joined.select("id", "error_count")
    assert "Join" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["error_count"] for r in counts.collect()) == sorted(order)
