"""Sources, sinks and flows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftline.operators import catalog, checks, load, logs, lookup
from siftline.plans import flows
from siftline.sources import extract, files, jdbc, sinks


def test_scan_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('id,name\n1,"Caf\xe9, ""x""\nline"\n'.encode("latin1"))
    row = files.scan_csv(spark, str(path), encoding="ISO-8859-1", multi_line=True).first()
    assert tuple(row) == ("1", 'Caf\xe9, "x"\nline')
    empty = tmp_path / "b.csv"
    empty.write_text("id,name\n")
    with pytest.raises(ValueError):
        files.scan_csv(spark, str(empty))


def test_scan_run_logs(spark, tmp_path):
    folder = tmp_path / "logs" / "dataload" / "run1"
    folder.mkdir(parents=True)
    (folder / "processing_summary.csv").write_text(
        "Start_Time,End_Time,Processing_Duration_Seconds,Processing_Duration_Formatted,Total_Records,Total_Success,Total_Errors,Total_Unprocessed,"
        "Success_Rate_Percent,Error_Rate_Percent,Operation,Salesforce_Object,Salesforce_Org,Total_Batches,Parallel_Processing,Log_Generated_At\n"
        "2024-01-01 10:00:00,2024-01-01 10:01:00,60.00,0:01:00,100,40,60,0,40.00,60.00,insert,Account,dev,1,False,2024-01-01 10:01:01\n"
    )
    (folder / "batch_processing_details.csv").write_text(
        "Batch_Number,Batch_Records,Batch_Success,Batch_Errors,Batch_Processing_Time_Seconds,Batch_Success_Rate_Percent,Batch_Error_Rate_Percent,Batch_Status,Error_Details\n"
        "1,100,40,60,1.00,40.00,60.00,PARTIAL,\n"
    )
    (folder / "other.csv").write_text("x\n1\n")
    entries = logs.log_entries(files.scan_run_logs(spark, str(tmp_path / "logs")))
    got = {r["message"]: (r["level"], r["source"], r["module"], r["object"]) for r in entries.collect()}
    assert got == {
        "Processed 100 records: 40 success, 60 errors": ("ERROR", "Data Operations", "Data Loader", "Account"),
        "Batch 1: 40 success, 60 errors": ("INFO", "Data Operations", "Data Loader", "Unknown"),
    }


def test_jdbc_options():
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x", "DELETE FROM t")
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x", "SELECT 1; DROP TABLE t")
    assert jdbc.jdbc_options("jdbc:x", "select * from t;")["query"] == "select * from t"
    split = jdbc.jdbc_options("jdbc:x", jdbc.default_query("Account"), jdbc.Bounds("id", 0, 100, 4))
    assert split["dbtable"] == "(SELECT * FROM stg.[Account]) q" and split["numPartitions"] == "4"
    assert jdbc.jdbc_write_options("jdbc:x", "t", "truncate")[1]["truncate"] == "true"


def test_catalog_round_trip(spark, tmp_path):
    cat = catalog.catalog_rows(
        spark, [dict(object="A", name="Kind", label="Kind", type="picklist", nillable=False, picklist=[("x", True), ("old", False), ("y", True)]),
                dict(object="A", name="Key", label="Key", type="string", nillable=True, is_unique=True)]
    )
    files.catalog_to_details(cat).write.option("header", True).csv(str(tmp_path / "d"))
    back = {r["name"]: r for r in files.scan_catalog_csv(spark, str(tmp_path / "d"), "A").collect()}
    assert [p["value"] for p in back["Kind"]["picklist"]] == ["x", "y"] and back["Kind"]["nillable"] is False
    assert back["Key"]["is_unique"] is True


def test_reference_key(spark):
    rows = [dict(object="A", name="Id", is_unique=True), dict(object="A", name="U1", is_unique=True), dict(object="A", name="E1", external_id=True)]
    assert extract.reference_key(catalog.catalog_rows(spark, rows)) == "E1"
    assert extract.reference_key(catalog.catalog_rows(spark, rows[:2])) == "U1"
    assert extract.reference_key(catalog.catalog_rows(spark, rows[:1])) == "Name"


def test_load_table_modes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    with pytest.raises(ValueError):
        sinks.load_table(df, "t_modes", "append")
    sinks.load_table(df, "t_modes", "create")
    with pytest.raises(ValueError):
        sinks.load_table(df, "t_modes", "create")
    sinks.load_table(df, "t_modes", "append")
    assert spark.table("t_modes").count() == 4
    sinks.load_table(df.filter("id = 1"), "t_modes", "truncate")
    assert spark.table("t_modes").count() == 1
    sinks.load_table(df, "t_modes", "replace")
    assert sinks.verify_load(spark.table("t_modes"), df).first().asDict() == {"loaded_rows": 2, "expected_rows": 2, "complete": True}


def test_split_outputs_keep_their_header(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "v string")
    checked = checks.with_violations(df, [])
    sinks.write_split(checked, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s" / "valid")).count() == 2
    invalid = spark.read.option("header", True).csv(str(tmp_path / "s" / "invalid"))
    assert invalid.columns == ["v"] and invalid.count() == 0
    sinks.split_write(spark.range(250), str(tmp_path / "p"), above=100, per_file=100)
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).count() == 250


def test_upsert_rejects_id_and_unknown_operation(spark):
    df = spark.createDataFrame([(1,)], "Id int")
    with pytest.raises(ValueError):
        load.upsert(df, df, "Id")
    with pytest.raises(ValueError):
        load.upsert(df, df, "x", "merge")


def test_transform_and_load(spark):
    source = spark.createDataFrame([(1, "Acme", "x"), (2, "None", "y"), (3, " ", "x")], "num int, account string, kind string")
    parent = spark.createDataFrame([("001A00000000001", "Acme"), ("001A00000000000", "Acme")], "Id string, Name string")
    cat = catalog.catalog_rows(spark, [dict(object="O", name="Kind", type="picklist", picklist=[("x", True)])])
    out = flows.transform(source, {"num": "Num", "account": "Account", "kind": "Kind"}, "Num", [lookup.Lookup("Account", parent)], cat)
    got = {r["Num"]: (r["Account"], r["Transform_Status"], r["Validation_Details"]) for r in out.collect()}
    assert got[1] == ("001A00000000000", "SUCCESS", "All validations passed")
    assert got[2] == ("None", "FAILURE", "Unchanged: Account; Invalid picklist Kind: 'y'")
    assert got[3] == (None, "SUCCESS", "All validations passed")
    ready = out.select("Num", "Account")
    target = spark.createDataFrame([(1, "old")], "Num int, Account string")
    snapshot, outcomes, report = flows.load_batches(ready, target, "Num", "upsert", 2)
    assert {r["Num"]: r["Account"] for r in snapshot.collect()} == {1: "001A00000000000", 2: "None", 3: None}
    assert {r["Num"]: r["outcome"] for r in outcomes.collect()} == {1: "updated", 2: "created", 3: "created"}
    assert sorted((r["Batch_Number"], r["Batch_Records"], r["Batch_Status"]) for r in report.collect()) == [(1, 2, "SUCCESS"), (2, 1, "SUCCESS")]


def test_extract_recent(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 9))], "id int, at timestamp")
    got = extract.extract(df.withColumn("at", F.col("at").cast("timestamp_ntz")), "recent", ["id"], "at", 3, dt.date(2024, 1, 10))
    assert [r["id"] for r in got.collect()] == [2]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from siftline import session

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(fake)


def test_extract_takes_all_rows_and_the_first_key(spark):
    assert extract.extract(spark.range(3000)).count() == 3000
    fields = spark.createDataFrame(
        [("B", True, False, 2), ("A", True, False, 1), ("U", False, True, 3), ("Id", False, True, 4)], "name string, external_id boolean, is_unique boolean, position int"
    ).repartition(4)
    assert extract.reference_key(fields) == "A"
    assert extract.reference_key(fields.filter("NOT external_id")) == "U"
    assert extract.reference_key(fields.filter("name = 'Id'")) == "Name"
