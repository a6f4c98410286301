import os
from types import SimpleNamespace

import pytest
from pyspark.sql import types as T

from quayside import session
from quayside.sources import files, schemas


def write(path, name, text, encoding="utf-8"):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding=encoding, newline="") as f:
        f.write(text)


def test_shipments_by_title(spark, tmp_path):
    folder = str(tmp_path / "imports")
    head = "Date,Consignee (Unified),HS,Metric Tons,Unnamed\n"
    write(folder, "a.csv", head + '20190331,"ACME, TX",870899,19.72,\n20190401.0,,02,,\n')
    write(folder, "b.csv", head + '20190402,"A ""B"" CO, NY",220900 392390 ,1,\n')
    df = files.read_shipments(spark, folder, schemas.IMPORTS)
    assert df.columns == [f.name for f in schemas.IMPORTS.fields]
    rows = {r["Date"]: r for r in df.collect()}
    assert len(rows) == 3
    assert rows["20190401.0"]["Consignee (Unified)"] is None
    assert rows["20190401.0"]["HS"] == "02"
    assert rows["20190402"]["Consignee (Unified)"] == 'A "B" CO, NY'
    assert rows["20190331"]["Metric Tons"] == 19.72
    assert rows["20190331"]["Total calculated value (US$)"] is None


def test_dim_with_bom_blank_rows_and_na(spark, tmp_path):
    folder = str(tmp_path)
    write(folder, "closures.csv", "State,Date Announced,Effective Date\nOhio,3/22/2020,3/23/2020\nIowa,NA,NA\n,,\n  ,,\n",
          "utf-8-sig")
    df = files.read_dim(spark, folder + "/closures.csv", schemas.CLOSURES, "state", null_value="NA")
    assert {r.state: r.date_announced for r in df.collect()} == {"Ohio": "3/22/2020", "Iowa": None}


def test_dim_codes_stay_text_and_index_goes(spark, tmp_path):
    write(str(tmp_path), "ports.csv", ',US_Port,US_Port_Clustered,STATE_CODE\n0,"TAMPA,FL","TAMPA,FL",FL\n1,,x,\n')
    df = files.read_dim(spark, str(tmp_path / "ports.csv"), schemas.US_PORTS_UNBINNED, "us_port", index_column=True)
    assert [tuple(r) for r in df.collect()] == [("TAMPA,FL", "TAMPA,FL", "FL")]
    write(str(tmp_path), "hs.csv", "HS_Class,Description,Type\n01,Animals,x\n", "utf-8-sig")
    assert files.read_dim(spark, str(tmp_path / "hs.csv"), schemas.HS_DICTIONARY, "hs_class").first().hs_class == "01"


def test_written_years_are_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_table(spark.createDataFrame([(2019, 1.0), (2020, 2.0)], "year int, v double"), path)
    read = files.read_table(spark, path).filter("year = 2020")
    assert [tuple(r) for r in read.select("year", "v").collect()] == [(2020, 2.0)]
    assert "PartitionFilters: [isnotnull(year" in read._jdf.queryExecution().toString()


def test_csv_table_needs_schema(spark):
    with pytest.raises(ValueError):
        files.read_table(spark, "/nowhere", "csv")


def test_export_and_append(spark, tmp_path):
    df = spark.createDataFrame([("a, b",), ("a, b",), ("c",)], "name string")
    files.export_distinct(df, "name", str(tmp_path / "names"))
    schema = T.StructType([T.StructField("name", T.StringType())])
    assert sorted(r.name for r in files.read_table(spark, str(tmp_path / "names"), "csv", schema).collect()) == ["a, b", "c"]
    files.append_rows(df, str(tmp_path / "log"))
    files.append_rows(df, str(tmp_path / "log"))
    assert files.read_table(spark, str(tmp_path / "log")).count() == 6


def test_shared_dir_is_read_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    settled = session.settle(spark.range(5), "five")
    assert settled.count() == 5 and configured in settled.inputFiles()[0]


def fake_session(master):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default),
                           sparkContext=SimpleNamespace(master=master, applicationId=master))


def test_a_cluster_needs_a_shared_dir():
    with pytest.raises(RuntimeError):
        session.shared_dir(fake_session("yarn"))
    assert session.shared_dir(fake_session("local[2]")) == session.shared_dir(fake_session("local[2]"))
