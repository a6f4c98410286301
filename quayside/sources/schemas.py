"""Explicit schemas of the input files. Codes stay text, so that ``02`` does not become 2."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType()}


def _schema(**cols: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in cols.items()])


# Column titles of the shipment files and the common vocabulary.
IMPORT_COLUMNS = {
    "Date": ("date", "s"),
    "Consignee (Unified)": ("us_company", "s"),
    "HS": ("hs", "s"),
    "HS Description": ("hs_description", "s"),
    "Country of Origin": ("foreign_country", "s"),
    "Port of Departure": ("foreign_port", "s"),
    "Port of Arrival": ("us_port", "s"),
    "Carrier": ("carrier", "s"),
    "Shipper (Unified)": ("foreign_company", "s"),
    "In bond entry type": ("in_bond_entry_type", "s"),
    "Container LCL/FCL": ("container_lcl_fcl", "s"),
    "Vessel Country": ("vessel_country", "s"),
    "Teus": ("teus", "d"),
    "Metric Tons": ("metric_tons", "d"),
    "Container Type Refrigerated": ("container_type_refrigerated", "i"),
    "Container Type Dry": ("container_type_dry", "i"),
    "VIN Quantity": ("vin_quantity", "i"),
    "Total calculated value (US$)": ("tcvusd", "d"),
}
EXPORT_COLUMNS = {
    "Date": ("date", "s"),
    "Exporter (Unified)": ("us_company", "s"),
    "HS": ("hs", "s"),
    "HS Description": ("hs_description", "s"),
    "Country of Final destination": ("foreign_country", "s"),
    "Foreign Port": ("foreign_port", "s"),
    "US Port": ("us_port", "s"),
    "Carrier": ("carrier", "s"),
    "Container LCL/FCL": ("container_lcl_fcl", "s"),
    "Vessel Country": ("vessel_country", "s"),
    "Short Container Description": ("short_container_description", "s"),
    "Teus": ("teus", "d"),
    "Metric Tons": ("metric_tons", "d"),
    "VIN Quantity": ("vin_quantity", "i"),
    "Containerized": ("containerized", "i"),
    "Total calculated value (US$)": ("tcvusd", "d"),
}


def file_schema(columns: dict[str, tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(title, _TYPES[kind]) for title, (_, kind) in columns.items()])


IMPORTS = file_schema(IMPORT_COLUMNS)
EXPORTS = file_schema(EXPORT_COLUMNS)

HS_GROUPS = _schema(hs_class="i", description="s", hs_group_name="s")
HS_DICTIONARY = _schema(hs_class="s", description="s", type="s")
CLOSURES = _schema(state="s", date_announced="s", effective_date="s")
UNEMPLOYMENT = _schema(month="s", year_month="s", total_in_thousands="s", unemployment_rate="d")
EU_MEMBERS = _schema(country="s", accession_date="s", schengen_member="s", eurozone_member="s", eu_group_member="s")
STATES = _schema(state="s", state_code="s", state_region="s")
COUNTRY_REGIONS = _schema(name="s", country_code="s", continent="s", region="s")
COMPANY_COUNTRIES = _schema(foreign_company_country="s", name="s", code="s", continent="s")
COUNTRIES = _schema(foreign_country="s", name="s", code="s", continent="s")
US_PORTS = _schema(us_port="s", us_port_clustered="s", state_code="s", us_port_coastal_region="s")
US_PORTS_UNBINNED = _schema(us_port="s", us_port_clustered="s", state_code="s")
US_COMPANIES = _schema(us_company="s", us_company_clustered="s")
FOREIGN_COMPANIES = _schema(foreign_company="s", foreign_company_clustered="s")
CARRIERS = _schema(carrier="s", carrier_clustered="s", carrier_size="s")
TARIFFS = _schema(country="s", hs_family="i", tariff_year="i", average_tariff="s",
                  free_trade_agreement_with_us="s", european_union="s")
CURRENCIES = _schema(month="s", exchange_year="i", month_year="s", open="d", high="d", low="d", price="d",
                     currency="s", country="s", european_union_member="s")
COUNTY_CASES = _schema(date="s", county="s", state="s", fips="s", cases="l", deaths="l")
TRIALS = _schema(loss="d", params="s", iteration="i", train_time="d")
TRIALS_WITH_ROUNDS = _schema(loss="d", params="s", iteration="i", estimators="i", train_time="d")
IMPURITY_IMPORTANCES = _schema(variable="s", feature_importance="d")
PERMUTATION_IMPORTANCES = _schema(feature="s", weight="d", std="d")
