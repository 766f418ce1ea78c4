"""Checks and functions against plain per-value Python on random cells."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from siftline.functions import fixed, formula as X, values
from siftline.operators import checks, cleaning, mapping, profile
from siftline.operators.catalog import catalog_rows

POOL = [
    "", " ", "\t", "0", "1", "12", "12.0", "12.5", "-3", "+7", ".5", "5.", "1e3", "1e400", "inf", "-Infinity", "NaN", "1_000", "1.0d", "0x1p3", "abc",
    "true", "False", "YES", "t", "maybe", "a@b.co", "A.b-c@d-e.org", "a@b", "a b@c.de", "555-1234", "+1 (555) 123-4567", "123", "1234567890123456",
    "http://x", "https://", "ftp://x", "HTTP://x", "$1,234.50", "USD 5", "50%", "120%", "-1%", "99.5", "100000", "9999", "10000", "123456789012345",
    "123456789012345678", "short", "2020-01-31", "2020-02-30", "31/01/2020", "01/31/2020", "20200131", "5-Jan-2020", "Jan 5, 2020", "2020-01-31T10:00:00Z",
    "not a date", "X" * 30, "A", "B ", " A",
]


def _float(text):
    t = text.strip(" \t\n\r\x0b\x0c")
    return float(t) if re.match(values.NUMBER.replace("(?i:inf|infinity|nan)", "(?:[iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY]|[nN][aA][nN])"), t) else None


def _integer_ok(text):
    n = _float(text)
    return n is not None and n == n and abs(n) != float("inf") and n == int(n)


def _phone_ok(text):
    return re.fullmatch(r"[0-9]{7,15}", re.sub(r"[\s\-()+.]", "", text.strip())) is not None


def _percent_ok(text):
    n = _float(text.replace("%", ""))
    return n is not None and not (n < 0 or n > 100)


PYTHON = {
    "not_integer": lambda t: not _integer_ok(t),
    "not_number": lambda t: _float(t) is None,
    "not_boolean": lambda t: t.lower() not in fixed.BOOLEAN_TOKENS,
    "bad_email": lambda t: re.match(fixed.EMAIL, t) is None,
    "bad_phone": lambda t: not _phone_ok(t),
    "bad_url": lambda t: re.match(fixed.URL, t) is None,
    "bad_record_id": lambda t: len(t.strip()) not in (15, 18),
    "bad_currency": lambda t: _float(t.replace("$", "").replace(",", "")) is None,
    "bad_percent": lambda t: not _percent_ok(t),
}


def test_checks_equal_python(spark):
    rng = random.Random(7)
    cells = POOL + ["".join(rng.choice("0123456789.-+ @aZ%$") for _ in range(rng.randint(1, 18))) for _ in range(400)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)] + [(-1, None)], "id int, v string")
    direct = values.cell(df, "v")
    ready, prepared = values.prepared_cells(df, ["v"])
    for frame, c in ((df, direct), (ready, prepared["v"])):
        columns = [getattr(checks, name)(c).alias(name) for name in PYTHON]
        extra = [checks.required(c).alias("required"), checks.too_long(c, 10).alias("long"), checks.not_in_picklist(c, ["A", "B"]).alias("pick"),
                 checks.not_in_picklist(c, ["A", "B"], trim=True).alias("pick_trim"), checks.suspicious_number(c, "remark").alias("susp")]
        for r in frame.select("id", "v", *columns, *extra).collect():
            t = r["v"]
            if t is None or not t.strip():
                assert r["required"] is True
                continue
            assert r["required"] is False
            for name, fn in PYTHON.items():
                assert r[name] == fn(t), (name, t)
            assert r["long"] == (len(t) > 10)
            assert r["pick"] == (t not in ("A", "B"))
            assert r["pick_trim"] == (t.strip() not in ("A", "B"))
            digits = t.strip().replace(".", "").replace("-", "").replace("+", "").isdigit()
            assert r["susp"] == bool(digits and (_float(t) or 0) > 99999), t


def test_dates(spark):
    good = ["2020-01-31", "01/31/2020", "31/01/2020", "20200131", "5-Jan-2020", "Jan 5, 2020", "2020-01-31T10:00:00Z", "2020-01-31 10:00:00.123"]
    bad = ["2020-02-30", "not a date", "2020", "99/99/2020"]
    df = spark.createDataFrame([(t,) for t in good + bad], "v string")
    got = [r[0] for r in df.select(values.timestamp("v").isNotNull()).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_native_types_are_not_parsed(spark):
    df = spark.createDataFrame([(1, 2.5, True, dt.date(2020, 1, 1)), (2, float("nan"), None, None)], "i int, d double, b boolean, t date")
    c = {n: values.cell(df, n) for n in df.columns}
    row = df.select(checks.not_integer(c["i"]), checks.not_integer(c["d"]), checks.not_number(c["d"]), checks.not_date(c["t"]), checks.not_boolean(c["b"])).first()
    assert list(row) == [False, True, False, False, False]
    assert [r[0] for r in df.select(c["d"].blank).collect()] == [False, True]


def test_formula_functions(spark):
    df = spark.createDataFrame([("Hello World", 2.5, "2020-03-04"), (None, -1.5, None)], "s string, n double, d string")
    row = df.select(
        X.LEFT("s", 3), X.RIGHT("s", 3), X.MID("s", 2, 3), X.FIND("World", F.col("s")), X.CONTAINS("s", "lo W"), X.BEGINS("s", "He"), X.ENDS("s", "x"),
        X.ROUND("n"), X.CEILING("n"), X.FLOOR("n"), X.ABS("n"), X.YEAR("d"), X.MONTH("d"), X.DAY("d"), X.REGEX("s", "Hel+o"), X.REGEX("s", "World"),
        X.ISPICKVAL("s", " Hello World "), X.CASE("s", [("Hello World", 1)], 0), X.VALUE("s"),
    ).collect()
    assert list(row[0]) == ["Hel", "rld", "ell", 7, True, True, False, 2.0, 3, 2, 2.5, 2020, 3, 4, True, False, True, 1, None]
    assert row[1][3] == 0 and row[1][4] is False


def test_labels_and_sizes(spark):
    df = spark.createDataFrame([("ns__Site_Code__c", 0), ("Account", 1023), ("My_thing__c", 1536), ("a1b", 5 * 1024**3)], "n string, b long")
    rows = df.select(values.field_label("n"), values.file_size_text("b")).collect()
    assert [tuple(r) for r in rows] == [("Site Code", "0 B"), ("Account", "1023.0 B"), ("My Thing", "1.5 KB"), ("A1B", "5.0 GB")]


def test_cleaning(spark):
    df = spark.createDataFrame([(" a ", float("inf"), dt.datetime(2020, 1, 2, 3, 4, 5, 6), "t"), ("NaN", 1.0, None, "maybe"), ("", None, None, " NO ")],
                               "s string, d double, t timestamp, b string")
    rows = cleaning.coerce_bool(cleaning.clean_values(df), ["b"]).collect()
    assert [tuple(r) for r in rows] == [("a", None, "2020-01-02T03:04:05.000006Z", True), (None, 1.0, None, None), (None, None, None, False)]
    assert not cleaning.is_json_compliant(df) and cleaning.is_json_compliant(cleaning.clean_values(df))


def test_suggestions(spark):
    rows = [dict(name="Name", label="Account Name", type="string"), dict(name="Email", label="Email", type="email"), dict(name="Phone", label="Business Phone", type="phone"),
            dict(name="External_Id__c", label="Key", type="string"), dict(name="AnnualRevenue", label="Annual Revenue", type="currency")]
    cat = catalog_rows(spark, [{"object": "Account"} | r for r in rows])
    got = {r["column"]: (r["field"], r["score"]) for r in mapping.suggest_mapping_scored(
        {"company_name": "Text (Short)", "mail": "Email", "annual revenue": "Number (Decimal)", "zzz": "Text (Short)", "id": "Text (Short)"}, cat).collect()}
    assert got == {"company_name": ("Name", 90), "mail": ("Email", 80), "annual revenue": ("AnnualRevenue", 100), "zzz": ("-- Skip Field --", 0), "id": ("External_Id__c", 90)}
    named = {r["column"]: r["score"] for r in mapping.suggest_mapping_name(["External Id", "contact phone no", "key"], cat).collect()}
    assert named == {"External Id": 0, "contact phone no": 80, "key": 60}
    first = {r["column"]: r["field"] for r in mapping.suggest_mapping_first(["account_name", "phone"], cat).collect()}
    assert first == {"account_name": "Name", "phone": "Phone"}


def test_mapping_errors(spark):
    import pytest

    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        mapping.apply_mapping(df, {"x": "y"})
    with pytest.raises(ValueError):
        mapping.apply_mapping(df, {"a": "t", "b": "t"})
    assert mapping.ignored_mappings(df, {"a": "t", "x": "y"}) == ["x"]


def test_quality_of_odd_columns(spark):
    df = spark.createDataFrame([("1", None, 0.0), ("2", None, -0.0), ("2", "x" * 300, float("nan"))], "n string, s string, d double")
    issues = {(r["issue"], r["column"]) for r in profile.quality_issues(df).collect()}
    assert issues == {("numeric_text", "n"), ("null_share", "s"), ("long_text", "s")}
    found = {(r["column"], r["issue"]): r["count"] for r in profile.column_issues(df).collect()}
    assert found == {("n", "Duplicate"): 1, ("s", "Duplicate"): 1, ("s", "Null"): 2, ("d", "Duplicate"): 1, ("d", "Null"): 1}
