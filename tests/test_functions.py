import datetime

import pytest
from pyspark.sql import functions as F

from quayside.functions import numbers, text, timekeys


def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_company_text(spark):
    rows = [("ACME FOODS, LLC, TX",), ("NO COMMA",), (" TRAILING , NY ",), (None,)]
    got = values(spark, rows, "c string", text.after_last("c", ","), text.before_last("c", ","))
    assert got == [(" TX", "ACME FOODS, LLC"), ("NO COMMA", None), (" NY ", " TRAILING "), (None, None)]


def test_tail_code(spark):
    rows = [("NAME (CN)",), ("NAME (12)",), ("X",), ("NAME  ",)]
    assert [r[0] for r in values(spark, rows, "c string", text.tail_code("c"))] == ["CN", "E ", "X", "  "]


def test_strip_suffix_only_at_the_end(spark):
    rows = [("20190331.0",), ("20190331",), ("1.05",), ("2x0",)]
    assert [r[0] for r in values(spark, rows, "c string", text.strip_suffix("c", ".0"))] == [
        "20190331", "20190331", "1.05", "2x0"]


def test_container_flags_are_case_sensitive_and_gated(spark):
    rows = [("1 X 40 REEF", 1), ("reef", 1), ("Cold store", 1), ("-18 Deg", 0)]
    flags = text.container_flags("d", F.col("k") == 1)
    assert values(spark, rows, "d string, k int", *flags) == [(1, 0), (0, 1), (1, 0), (0, 0)]


def test_fingerprint(spark):
    rows = [("TRÙNMOOR",), ("Trun-Moor",), ("HAI  PHONG",), ("Łódź",)]
    got = [r[0] for r in values(spark, rows, "c string", text.fingerprint("c"))]
    assert got[:3] == ["TRUNMOOR", "TRUNMOOR", "HAIPHONG"]


def test_numbers(spark):
    rows = [("1,234.5", 0), ("abc", 3), (None, None), (" 7 ", 1)]
    got = values(spark, rows, "s string, n int", numbers.to_number("s"), numbers.to_flag("n"),
                 numbers.to_number_keep_original("s"))
    assert got == [(1234.5, 0, "1,234.5"), (None, 1, "abc"), (None, None, None), (7.0, 1, "7.0")]


def test_size_bins_edges(spark):
    rows = [(1000.0,), (1000.01,), (10000.0,), (1e6,), (1e6 + 1,), (None,)]
    size = numbers.bin_by_thresholds("t", [1e3, 1e4, 1e5, 1e6], ["micro", "small", "medium", "large", "huge"])
    assert [r[0] for r in values(spark, rows, "t double", size)] == ["micro", "small", "small", "large", "huge", None]


def test_code_is_mixed(spark):
    rows = [("870899",), ("8708991",), ("87089912",), (None,)]
    assert [r[0] for r in values(spark, rows, "c string", numbers.code_is_mixed("c"))] == [0, 0, 1, 0]


def test_recode_and_yes_no(spark):
    rows = [("Yes",), ("No",), ("x",), (None,)]
    got = values(spark, rows, "c string", numbers.recode("c", {"x": "y"}), numbers.yes_no_to_bool("c"))
    assert got == [("Yes", True), ("No", False), ("y", None), (None, None)]


def test_parse_dates(spark):
    rows = [("20200229", "3/4/2020"), ("20200230", "NA"), (None, "12/31/2020")]
    got = values(spark, rows, "a string, b string", timekeys.parse_date("a", "yyyyMMdd"), timekeys.parse_date("b", "M/d/yyyy"))
    assert got == [(datetime.date(2020, 2, 29), datetime.date(2020, 3, 4)), (None, None), (None, datetime.date(2020, 12, 31))]


def test_two_digit_years(spark):
    rows = [("25-Mar-57",), ("1-Jan-07",)]
    got = values(spark, rows, "c string", timekeys.parse_date("c", "d-MMM-yy", last_year=2021))
    assert got == [(datetime.date(1957, 3, 25),), (datetime.date(2007, 1, 1),)]


def test_weeks_day_by_day(spark):
    first = datetime.date(2009, 12, 25)
    n = 4045
    days = spark.range(n).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("d"))
    for d, label, monday, shifted in days.select(
            "d", timekeys.year_week("d"), timekeys.week_ending_monday("d"), timekeys.week_ending_monday("d", 7)).collect():
        assert label == d.strftime("%Y-w%U")
        end = d + datetime.timedelta((7 - d.weekday()) % 7)
        assert monday == end and monday.weekday() == 0
        assert shifted == end - datetime.timedelta(7)


def test_bins_need_one_more_label():
    with pytest.raises(ValueError):
        numbers.bin_by_thresholds("t", [1, 2], ["a", "b"])
