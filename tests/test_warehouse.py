"""The whole build on invented files with the awkward cases of the real ones."""

import csv

import pytest
from pyspark.sql import functions as F

from quayside.plans import warehouse
from quayside.sources.schemas import EXPORT_COLUMNS, IMPORT_COLUMNS

IMPORT = {"Date": "20200316", "Consignee (Unified)": "ACME FOODS, LLC, TX", "HS": "020711", "HS Description": "020711 - MEAT",
          "Country of Origin": "VIETNAM RAW", "Port of Departure": "HAI PHONG", "Port of Arrival": "TAMPA,FL",
          "Carrier": "BLUE LINE", "Shipper (Unified)": "SAIGON CO (VN)", "Container LCL/FCL": "FCL", "Teus": "1",
          "Container Type Refrigerated": "2", "Container Type Dry": "0", "VIN Quantity": "0"}
EXPORT = {"Date": "20200317.0", "Exporter (Unified)": "MILLS, TX", "HS": "170290 170490", "HS Description": "1702 - SUGAR",
          "Country of Final destination": "CHILE RAW", "Foreign Port": "BALBOA", "US Port": "ALBANY, NEW YORK",
          "Carrier": "BLUE LINE", "Container LCL/FCL": "LCL", "Short Container Description": "1 X 40 REEF", "Teus": "2",
          "VIN Quantity": "0", "Containerized": "1"}


def imports():
    rows = [{**IMPORT, "Metric Tons": str(20 + i % 7), "Total calculated value (US$)": str(1000 + i)} for i in range(30)]
    return rows + rows[:2] + [  # copies
        {**rows[0], "Date": ""},
        {**rows[0], "HS Description": "990000 - OTHER"},
        {**rows[0], "HS Description": "PARTS"},
        {**rows[0], "Consignee (Unified)": "TINY CO, NY"},
        {**rows[0], "Carrier": "NOBODY KNOWS"},
        {**rows[0], "Metric Tons": "900"},
        {**rows[0], "Metric Tons": ""},
    ] + [{**r, "Consignee (Unified)": "", "Port of Arrival": "HELENA, MT", "Date": "20200601"} for r in rows[:10]]


def exports():
    rows = [{**EXPORT, "Metric Tons": str(21 + i % 3), "Total calculated value (US$)": str(2000 + i)} for i in range(10)]
    return rows + [{**rows[0], "Short Container Description": ""}, {**rows[0], "US Port": ""},
                   {**rows[0], "Containerized": ""}, {**rows[1], "Short Container Description": "1 x 40 reef"},
                   {**rows[2], "Containerized": "0"}]


SIDE = {
    "hs_groups": [["HS_Class", "Description", "HS_Group_Name"], [2, "Meat", "Edible"], [17, "Sugars", "Edible with Processing"]],
    "us_companies": [["US_Company", "Clustered"], ["ACME FOODS, LLC, TX", "ACME"], ["MILLS, TX", "MILLS"], ["TINY CO, NY", "TINY"],
                     ["Not Provided", "NOT AVAILABLE"]],
    "foreign_companies": [["Foreign_Company", "Clustered"], ["SAIGON CO (VN)", "SAIGON"],
                          ["Not Applicable to Exports", "Not Applicable to Exports"]],
    "carriers": [["Carrier", "Carrier_Clustered", "carrier_size"], ["BLUE LINE", "BLUE LINE", "huge"]],
    "us_ports": [["US_Port", "US_Port_Clustered", "STATE_CODE", "US_Port_Coastal_Region"], ["TAMPA,FL", "TAMPA, FL", "FL", "Gulf"],
                 ["ALBANY, NEW YORK", "ALBANY,NEW YORK", "NY", "East"], ["HELENA, MT", "HELENA, MT", "MT", "None"], ["", "x", "", ""]],
    "company_countries": [["Foreign_Company_Country", "Name", "Code", "Continent"], ["VN", "Viet Nam", "VN", "Asia"],
                          ["ts", "", "", ""], ["  ", "x", "", ""]],
    "countries": [["Foreign_Country", "Name", "Code", "Continent"], ["VIETNAM RAW", "Viet Nam", "VN", "Asia"],
                  ["CHILE RAW", "Chile", "CL", "South America"], ["UNKNOWN", "", "", ""]],
    "regions": [["Name", "Country Code", "Continent", "Region"], ["Vietnam", "VN", "Asia", "Eastern Asia"],
                ["Chile", "CL", "South America", "South America"], ["", "", "", ""]],
    "unemployment": [["Month", "Year-Month", "Total", "Rate"], ["Mar", "2020-03", "7,140", 4.4], ["Jun", "2020-06", "17,697", 11.1],
                     ["", "", "", ""]],
    "tariffs": [["Country", "HS_Family", "Tariff_Year", "Average_Tariff", "FTA", "EU"], ["Vietnam", 2, 2020, "1,234.5", "No", "No"]],
    "currencies": [["Month", "Exchange_Year", "Month_Year", "Open", "High", "Low", "Price", "Currency", "Country", "EU"],
                   ["Mar", 2020, "2020-03", 1, 1, 1, 23.5, "Dong", "Vietnam", "No"]],
    "states": [["State", "State Code", "Region"], ["Florida", "FL", "South"], ["New York", "NY", "Northeast"],
               ["Michigan", "MI", "Midwest"], ["Ohio", "OH", "Midwest"]],
    "closures": [["State", "Date Announced", "Effective Date"], ["Florida", "4/1/2020", "4/3/2020"],
                 ["New York", "3/20/2020", "3/22/2020"], ["Michigan", "NA", "NA"], ["Ohio", "3/22/2020", "3/23/2020"]],
    "cases": [["date", "county", "state", "fips", "cases", "deaths"],
              # a week later than the Monday 2020-03-16 and the one after it
              ["2020-03-22", "Leon", "Florida", "1", 0, 0], ["2020-03-23", "Dade", "Florida", "2", 4, 0],
              ["2020-03-30", "Dade", "Florida", "2", 10, 1], ["2020-03-23", "X", "Guam", "3", 9, 9],
              ["2021-03-01", "Dade", "Florida", "2", 99, 9]],
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("files")
    for folder, columns, rows in (("imports", IMPORT_COLUMNS, imports()), ("exports", EXPORT_COLUMNS, exports())):
        (base / folder).mkdir()
        for part in (0, 1):
            with open(base / folder / f"{part}.csv", "w", newline="") as f:
                writer = csv.DictWriter(f, [*columns, "Unnamed: 18"])
                writer.writeheader()
                writer.writerows(rows[part::2])
    paths = {}
    for name, rows in SIDE.items():
        paths[name] = str(base / f"{name}.csv")
        with open(paths[name], "w", newline="", encoding="utf-8-sig") as f:
            csv.writer(f).writerows(rows)
    out = warehouse.build_warehouse(
        warehouse.read_imports(spark, str(base / "imports")), warehouse.read_exports(spark, str(base / "exports")),
        warehouse.read_side_tables(spark, paths))
    return out.toPandas()


def test_rows_by_source(built):
    traded = built[built.hs_mixed.notna()]
    # 30 shipments of ACME and 10 without a consignee; of 12 good export rows two differ only
    # in text that is dropped or in the container flags, which keeps them apart
    assert len(traded[traded.trade_direction == "Import"]) == 40
    assert len(traded[traded.trade_direction == "Export"]) == 12


def test_company_sizes(built):
    traded = built[built.hs_mixed.notna()]
    by_size = traded.groupby(["trade_direction", "us_company_size"]).size().to_dict()
    # ACME's total of over 1000 tons still has the outlier, which goes later
    assert by_size == {("Import", "small"): 30, ("Import", "unknown"): 10, ("Export", "micro"): 12}
    assert traded.metric_tons.max() < 100


def test_products_and_containers(built):
    traded = built[built.hs_mixed.notna()]
    imports, exports = (traded[traded.trade_direction == d] for d in ("Import", "Export"))
    assert set(imports.hs_group_name) == {"Edible"} and set(imports.hs_mixed) == {0}
    assert set(exports.hs_group_name) == {"Edible with Processing"} and set(exports.hs_mixed) == {1}
    assert set(imports.container_type_refrigerated) == {1}
    pairs = exports.groupby(["container_type_refrigerated", "container_type_dry"]).size().to_dict()
    assert pairs == {(1, 0): 10, (0, 1): 1, (0, 0): 1}


def test_economics(built):
    traded = built[built.hs_mixed.notna()]
    march = traded[(traded.trade_direction == "Import") & (traded.us_company_size == "small")]
    june = traded[traded.us_company_size == "unknown"]
    assert set(march.us_unemployment_rate) == {4.4} and set(june.us_unemployment_rate) == {11.1}
    assert set(march.average_tariff) == {1234.5} and set(march.free_trade_agreement_with_us) == {"false"}
    assert set(march.price) == {23.5} and june.price.isna().all()
    assert set(march.foreign_country_region) == {"Eastern Asia"}
    assert traded[traded.trade_direction == "Export"].average_tariff.isna().all()


def test_states_and_closures(built):
    traded = built[built.hs_mixed.notna()]
    assert traded.groupby("state").size().to_dict() == {"Florida": 30, "New York": 12, "Michigan": 10}
    lead = {s: set(g.state_closure_ea_diff.dropna()) for s, g in built.groupby("state")}
    assert lead == {"Florida": {2}, "New York": {2}, "Michigan": set(), "Ohio": {1}}
    assert len(built[(built.state == "Ohio")]) == 1  # no trade, kept


def test_weekly_counts_and_baseline(built):
    florida = built[(built.state == "Florida")]
    assert set(florida.cases_weekly) == {4} and set(florida.time0_state_case) == {"2020-03-16"}
    assert set(florida.cases_pctdelta) == {0.0} and set(florida.year_week) == {"2020-w11"}
    assert set(florida.time0_state_death) == {"2020-03-23"}
    undated = built[built.date_weekly.isna()]
    assert set(undated.time0_state_case) == {"Not Applicable"} and set(undated.cases_weekly) == {0}


def test_weeks_without_trade_are_kept(built):
    idle = built[built.hs_mixed.isna() & built.date_weekly.notna()]
    assert len(idle) == 1
    row = idle.iloc[0]
    assert (row.cases_weekly, row.deaths_weekly, row.metric_tons, row.year) == (10, 1, 0, 2020)
    assert row.cases_pctdelta == pytest.approx(150.0)


def test_dropped_columns(built):
    assert not {"us_company", "us_company_clustered", "vin_quantity", "us_port_state", "hs", "date"} & set(built.columns)
    assert not built.duplicated().any()


def test_first_period_when_all_zero(spark):
    df = spark.createDataFrame([("a", "2020-01-06", 0), ("a", "2020-01-13", 0), ("b", "2020-01-13", 3), ("b", None, 5)],
                               "k string, t string, v int").withColumn("t", F.to_date("t"))
    out = {(r.k, str(r.t)): r for r in warehouse.baseline_change(df, "k", "t", "v", "t0", "v0", "pct").collect()}
    assert (out["a", "2020-01-13"].t0, out["a", "2020-01-13"].pct) == ("2020-01-06", None)
    assert (out["b", "None"].t0, out["b", "None"].v0, out["b", "None"].pct) == ("Not Applicable", 0, 0.0)


COUNTRIES = ["Viet Nam", "Russian Federation", "Tanzania, United Republic of", "Taiwan, Province of China",
             "Bolivia, Plurinational State of", "Chile", "Nowhere"]
# under the names of the tariff table or under those of the name map, as the real table has them
REGION_NAMES = ["Vietnam", "Russia", "Tanzania", "Taiwan, Province of China", "Bolivia, Plurinational State of", "Chile"]


def test_countries_of_two_names_keep_their_rows(spark):
    fact = spark.createDataFrame([(c, c) for c in COUNTRIES], "foreign_country_clustered string, foreign_company_country_clustered string")
    regions = spark.createDataFrame([(n, f"region of {n}") for n in REGION_NAMES], "name string, region string")
    out = {r.foreign_country_clustered: r for r in warehouse.add_regions(fact, regions).collect()}
    assert set(out) == set(COUNTRIES) - {"Nowhere"}
    assert all(r.foreign_country_region == r.foreign_company_country_region for r in out.values())
    assert out["Viet Nam"].foreign_country_region == "region of Vietnam"
    assert out["Taiwan, Province of China"].foreign_country_region == "region of Taiwan, Province of China"


def test_company_country_is_optional(spark):
    text = lambda name: spark.createDataFrame([("a", "A", "x", "y")], f"{name} string, {name}_clustered string, carrier_size string, us_port_coastal_region string")
    country = lambda key: spark.createDataFrame([("a", "Chile", "South America")], f"{key} string, name string, continent string")
    side = warehouse.SideTables(**{**dict.fromkeys(warehouse.SIDE_FILES), "us_companies": text("us_company"),
                                   "foreign_companies": text("foreign_company"), "carriers": text("carrier"), "us_ports": text("us_port"),
                                   "company_countries": country("foreign_company_country"), "countries": country("foreign_country"),
                                   "regions": spark.createDataFrame([("Chile", "South")], "name string, region string")})
    names = "us_company foreign_company carrier us_port foreign_company_country foreign_country".split()
    rows = [["a"] * 6, ["a", "a", "a", "a", "NA", "a"], ["a", "a", "a", "a", None, "a"], ["b", "a", "a", "a", "a", "a"], ["a", "a", None, "a", "a", "c"]]
    fact = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    assert warehouse.standardise_names(fact, side).count() == 3
    lost = {(r.step, r["name"], r.n) for r in warehouse.lost_names(fact, side).collect()}
    assert lost == {("us_company", "b", 1), ("carrier", None, 1), ("foreign_country", "c", 1)}
