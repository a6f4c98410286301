"""The warehouse build: raw shipment files and side tables to one enriched fact.

Copies are removed twice: before company totals are summed and at the end. The steps
between only add attributes through keys that are unique in their dimension, so a distinct
after each of them would shuffle the whole fact for nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from quayside import fixed_values as fixed
from quayside.functions.numbers import bin_by_thresholds, code_is_mixed, recode, to_flag, to_number, yes_no_to_bool
from quayside.functions.text import after_last, before_last, container_flags, prefix, strip_suffix, tail_code
from quayside.functions.timekeys import days_between, parse_date, time_features, year_week
from quayside.operators.aggregates import totals_over, weekly_sum
from quayside.operators.asof import asof_join
from quayside.operators.columns import conform, dedupe, filter_in, require, with_constants
from quayside.operators.joins import (enrich, expand_group, keep_qualifying, keyed, measured, outer_period_join, preserve_dim,
                                       semi_qualifying, standardise, unmatched)
from quayside.operators.outliers import outlier_chain
from quayside.operators.sets import union_conformed
from quayside.operators.windows import carry_forward, pct_from_baseline
from quayside.session import settle
from quayside.sources import schemas
from quayside.sources.files import read_dim, read_shipments


def from_titles(raw: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """File titles to the common vocabulary."""
    return conform(raw, {title: name for title, (name, _) in columns.items()})


def conform_imports(imports: DataFrame) -> DataFrame:
    rows = require(imports, "date").drop("in_bond_entry_type", "vessel_country")
    rows = rows.withColumns({
        "date": strip_suffix("date", ".0"),
        "container_type_refrigerated": to_flag("container_type_refrigerated"),
        "container_type_dry": to_flag("container_type_dry")})
    return with_constants(rows, trade_direction="Import")


def conform_exports(exports: DataFrame) -> DataFrame:
    rows = require(exports, "short_container_description", "us_port").filter(F.col("containerized").isin(0, 1))
    refrigerated, dry = container_flags("short_container_description", F.col("containerized") == 1)
    rows = rows.withColumns({"date": strip_suffix("date", ".0"), "container_type_refrigerated": refrigerated,
                             "container_type_dry": dry})
    return with_constants(rows.drop("vessel_country", "short_container_description", "containerized"),
                          trade_direction="Export", foreign_company=fixed.EXPORT_FOREIGN_COMPANY)


def build_fact(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Distinct shipments of both directions in one vocabulary."""
    return dedupe(union_conformed(conform_imports(imports), conform_exports(exports)))


def classify_products(fact: DataFrame, hs_groups: DataFrame, classes: list[int] = fixed.HS_CLASSES) -> DataFrame:
    """Product class from the description, only the classes of interest, their group, and
    whether the shipment mixes products."""
    classed = fact.withColumns({
        "hs_class": prefix("hs_description", 2).try_cast("int"),
        "hs_mixed": code_is_mixed("hs")}).drop("hs", "hs_description")
    return enrich(filter_in(classed, "hs_class", classes), keyed(hs_groups, "hs_class"), {"hs_class": "hs_class"})


def parse_parties(fact: DataFrame) -> DataFrame:
    """State and aggregate name of the domestic company, country of the foreign one."""
    us, foreign = F.col("us_company"), F.col("foreign_company")
    filler = F.lit(fixed.NOT_PROVIDED)
    return fact.withColumns({
        "us_company_state": F.coalesce(recode(after_last(us, ","), fixed.COMPANY_STATE_CODES), filler),
        "us_company_agg": before_last(us, ","),
        "foreign_company_country": F.coalesce(tail_code(foreign, 2), filler),
        "us_company": F.coalesce(us, filler),
        "foreign_company": F.coalesce(foreign, filler)})


def port_state(clustered: str):
    """State code at the end of a port name."""
    return recode(F.trim(after_last(clustered, ",")), fixed.PORT_STATE_CODES)


def entity_sizes(totals: DataFrame, entity: str, size: str, measure: str, least: float, edges: list[float]) -> DataFrame:
    """Entities whose total is above ``least``, each with its size class."""
    klass = F.when(F.trim(entity) == fixed.UNKNOWN_COMPANY, fixed.SIZE_UNKNOWN) \
        .otherwise(bin_by_thresholds("total", edges, fixed.SIZE_LABELS))
    return measured(totals_over(totals, entity, measure, least).select(entity, klass.alias(size)))


def size_entities(fact: DataFrame, entities: dict[str, str], measure: str = "metric_tons",
                  least: list[float] = (fixed.MIN_ENTITY_TONS, fixed.MIN_ENTITY_TONS),
                  edges: list[float] = fixed.SIZE_EDGES) -> DataFrame:
    """Only rows of qualifying entities, with their size classes; ``entities`` maps entity
    columns to size columns. Totals of a later entity count the rows the earlier ones left.

    The fact is summed once per combination of entities; all totals come from those sums,
    and the fact is read a second time for the joins.
    """
    combined = measured(fact.groupBy(*entities).agg(F.sum(measure).alias(measure)))
    for (entity, size), at_least in zip(entities.items(), least):
        sizes = entity_sizes(combined, entity, size, measure, at_least, edges)
        combined = semi_qualifying(combined, sizes, {entity: entity})
        fact = keep_qualifying(fact, sizes, entity)
    return fact


def member_rows(rows: DataFrame, members: DataFrame, *key: str) -> DataFrame:
    """Rows of a group of countries as rows of its members; ``members`` has ``country``, the
    group, and ``member``; ``key`` names a row beside its country. A country's own row stands
    before that of a group."""
    key = ["country", *key]
    spread = expand_group(rows, members, "country", "member").withColumnRenamed("member", "country")
    values = [c for c in rows.columns if c not in key]
    own_first = F.struct("is_member", *values)
    return spread.groupBy(*key).agg(F.min_by(F.struct(*values), own_first).alias("_v")).select(*key, "_v.*")


def enrich_economic(fact: DataFrame, unemployment: DataFrame, tariffs: DataFrame, currencies: DataFrame,
                    country: str = "foreign_country_clustered", members: DataFrame | None = None, carry_prices: bool = False) -> DataFrame:
    """Unemployment by month (months without a rate go), tariff by country, class and year,
    and exchange price by month and country.

    A country that did not report a tariff in a year keeps that of the last year it did; years
    before its first report have none. With ``members``, tariffs and prices of groups hold for
    their members. Prices are those of the month; with ``carry_prices`` a month of the price
    table without one has the last known."""
    month = lambda c: parse_date(c, "yyyy-MM")
    rates = keyed(unemployment.select(month("year_month").alias("_month"),
                                      F.col("unemployment_rate").alias("us_unemployment_rate")), "_month")
    taxes = keyed(tariffs.select(
        "country", "hs_family", "tariff_year", to_number("average_tariff").alias("average_tariff"),
        yes_no_to_bool("free_trade_agreement_with_us").cast("string").alias("free_trade_agreement_with_us"),
        yes_no_to_bool("european_union").cast("string").alias("european_union")),
        "country", "hs_family", "tariff_year", "average_tariff")
    prices = keyed(currencies.select(month("month_year").alias("_month"), "country", "currency", "price"),
                   "_month", "country")
    if members is not None:
        taxes = member_rows(taxes, members, "hs_family", "tariff_year")
        prices = member_rows(prices, members, "_month")
    if carry_prices:
        prices = carry_forward(prices, ["country"], "_month", ["currency", "price"])
    out = enrich(fact, measured(rates), {"year_month": "_month"}, "inner")
    out = asof_join(out, taxes, {country: "country", "hs_class": "hs_family"}, "year", "tariff_year").drop("tariff_year")
    return enrich(out, measured(prices), {"year_month": "_month", country: "country"})


def weekly_cases(cases: DataFrame, states: DataFrame, last_year: int | None = 2020) -> DataFrame:
    """Weekly sums per state code: ``state_code, year_week, date_weekly, cases_weekly, deaths_weekly``.
    Dates move back a week; states without a code go."""
    summed = weekly_sum(cases.withColumn("_date", F.to_date("date")), ["state"], "_date",
                        {"cases": "cases_weekly", "deaths": "deaths_weekly"}, shift_back=7) \
        .withColumnRenamed("week", "date_weekly")
    if last_year is not None:
        summed = summed.filter(F.year("date_weekly") <= last_year)
    codes = keyed(states.select("state", "state_code"), "state", "state_code")
    return enrich(summed.withColumn("year_week", year_week("date_weekly")), codes, {"state": "state"}, "inner").drop("state")


# Measures that are 0 in weeks without trade.
IDLE_ZEROS = ["teus", "metric_tons", "vin_quantity", "tcvusd", "us_unemployment_rate", "average_tariff", "price"]


def weekly_shocks(fact: DataFrame, weekly: DataFrame, state: str = "us_port_state",
                  traded: str = "hs_mixed", seen: DataFrame | None = None) -> DataFrame:
    """Weekly counts on every shipment of the state and week, 0 where there are none, and a
    row of zeros for weeks with counts but no trade. ``traded`` is never null in the fact;
    ``seen`` has the states and weeks of the fact, if they are known."""
    joined = outer_period_join(fact, weekly.withColumnRenamed("state_code", state), [state, "year_week"], seen)
    idle = F.col(traded).isNull()
    zeros = {c: F.when(idle, F.coalesce(c, F.lit(0))).otherwise(F.col(c)) for c in IDLE_ZEROS if c in joined.columns}
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("cases_weekly", "deaths_weekly")}
    year = {"year": F.when(idle, F.year("date_weekly")).otherwise(F.col("year"))} if "year" in joined.columns else {}
    return joined.withColumns({**zeros, **counts, **year})


def first_period_change(df: DataFrame, entity: str, time: str, value: str, first_time: str, first_value: str,
                        pct: str) -> DataFrame:
    """First period with a nonzero value per entity, the value then, and the percent change
    from it, on the rows of that calendar year."""
    per_period = df.filter(F.col(time).isNotNull()).groupBy(entity, time).agg(F.min(value).alias("_v"))
    # nonzero periods sort before zero ones, then the earliest
    first = F.min(F.struct(F.coalesce(F.col("_v") == 0, F.lit(True)).alias("zero"), F.col(time).alias("t"),
                           F.col("_v").alias("v")))
    base = per_period.groupBy(entity).agg(first.alias("f")).select(
        entity, F.year("f.t").alias("_year"), F.col("f.t").cast("string").alias(first_time), F.col("f.v").alias(first_value))
    joined = enrich(df.withColumn("_y", F.year(time)), measured(base), {entity: entity, "_y": "_year"}).drop("_y")
    return joined.withColumn(pct, pct_from_baseline(value, first_value))


def fill_undated(df: DataFrame, time: str, first_time: str, first_value: str, pct: str) -> DataFrame:
    """Fillers for the baseline columns on rows without a period."""
    undated = F.col(time).isNull()
    return df.withColumns({
        pct: F.when(undated, F.lit(0.0)).otherwise(F.col(pct)),
        first_time: F.when(undated, fixed.NOT_APPLICABLE).otherwise(F.col(first_time)),
        first_value: F.when(undated, F.lit(0)).otherwise(F.col(first_value))})


def baseline_change(df: DataFrame, entity: str, time: str, value: str, first_time: str, first_value: str,
                    pct: str) -> DataFrame:
    """First-period baseline and percent change, with fillers on rows without a period."""
    return fill_undated(first_period_change(df, entity, time, value, first_time, first_value, pct),
                        time, first_time, first_value, pct)


def closure_lead(df: DataFrame, announced: str = "date_announced", effective: str = "effective_date",
                 fmt: str = "M/d/yyyy") -> DataFrame:
    """Days from announcement to effect, null where a date is missing or reads ``NA``."""
    lead = days_between(parse_date(effective, fmt), parse_date(announced, fmt))
    return df.withColumn("state_closure_ea_diff", lead).drop(announced, effective)


@dataclass
class SideTables:
    """Name maps, dimensions and side tables of the build, with the columns of
    :mod:`quayside.sources.schemas`. The three name maps have the raw column, a
    ``*_clustered`` column, and for carriers a ``carrier_size``."""

    hs_groups: DataFrame
    us_companies: DataFrame
    foreign_companies: DataFrame
    carriers: DataFrame
    us_ports: DataFrame
    company_countries: DataFrame
    countries: DataFrame
    regions: DataFrame
    unemployment: DataFrame
    tariffs: DataFrame
    currencies: DataFrame
    states: DataFrame
    closures: DataFrame
    cases: DataFrame
    members: DataFrame | None = None


# Schema, key and null text of the file behind each side table.
SIDE_FILES = {
    "hs_groups": (schemas.HS_GROUPS, "hs_class", ""),
    "us_companies": (schemas.US_COMPANIES, "us_company", ""),
    "foreign_companies": (schemas.FOREIGN_COMPANIES, "foreign_company", ""),
    "carriers": (schemas.CARRIERS, "carrier", ""),
    "us_ports": (schemas.US_PORTS, "us_port", ""),
    "company_countries": (schemas.COMPANY_COUNTRIES, "foreign_company_country", ""),
    "countries": (schemas.COUNTRIES, "foreign_country", ""),
    "regions": (schemas.COUNTRY_REGIONS, "name", ""),
    "unemployment": (schemas.UNEMPLOYMENT, "year_month", ""),
    "tariffs": (schemas.TARIFFS, "country", ""),
    "currencies": (schemas.CURRENCIES, "country", ""),
    "states": (schemas.STATES, "state", ""),
    "closures": (schemas.CLOSURES, "state", "NA"),
    "cases": (schemas.COUNTY_CASES, "state", ""),
}


def read_side_tables(spark: SparkSession, paths: dict[str, str]) -> SideTables:
    """Side tables from their CSV files, ``{field: path}``."""
    return SideTables(**{name: read_dim(spark, paths[name], schema, key, null_value=null)
                         for name, (schema, key, null) in SIDE_FILES.items()})


def read_imports(spark: SparkSession, path: str) -> DataFrame:
    return from_titles(read_shipments(spark, path, schemas.IMPORTS), schemas.IMPORT_COLUMNS)


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    return from_titles(read_shipments(spark, path, schemas.EXPORTS), schemas.EXPORT_COLUMNS)


def standardise_names(fact: DataFrame, side: SideTables) -> DataFrame:
    """Curated names instead of raw ones; rows with a name no map has are dropped. The country
    of the foreign company is optional: rows with a code no map has stay, without one."""
    out = standardise(fact, measured(keyed(side.us_companies, "us_company")), "us_company", "us_company_clustered")
    out = standardise(out, measured(keyed(side.foreign_companies, "foreign_company")), "foreign_company", "foreign_company_clustered")
    out = standardise(out, keyed(side.carriers.select("carrier", "carrier_size"), "carrier"), "carrier", "carrier_size")
    ports = side.us_ports.select("us_port", "us_port_clustered", "us_port_coastal_region")
    out = enrich(out, keyed(ports, "us_port"), {"us_port": "us_port"}, "inner")
    company = side.company_countries.select(
        "foreign_company_country", F.col("name").alias("foreign_company_country_clustered"),
        F.col("continent").alias("foreign_company_country_continent"))
    out = enrich(out, keyed(company, "foreign_company_country"),
                 {"foreign_company_country": "foreign_company_country"})
    country = side.countries.select("foreign_country", F.col("name").alias("foreign_country_clustered"),
                                    F.col("continent").alias("foreign_country_continent"))
    return enrich(out, keyed(country, "foreign_country"), {"foreign_country": "foreign_country"}, "inner")


def add_regions(fact: DataFrame, regions: DataFrame) -> DataFrame:
    """Region of the country (known ones only) and of the foreign company's country.

    Some countries stand in the region table under the name of the name map, others under
    the name of the tariff table, so a country is looked up by both.
    """
    names = keyed(regions.select("name", "region"), "name")
    other = {raw: clean for clean, raw in fixed.COUNTRY_NAMES.items()}
    under = F.explode(F.array_distinct(F.array(F.col("name"), recode("name", other)))).alias("name")
    # a name of the table stands for itself before it stands for another
    both = names.select(under, "region", F.col("name").alias("_own")).groupBy("name") \
        .agg(F.min_by("region", F.col("_own") != F.col("name")).alias("region"))
    both = measured(both)
    out = enrich(fact, both, {"foreign_country_clustered": "name"}, "inner", role="foreign_country_")
    return enrich(out, both, {"foreign_company_country_clustered": "name"}, "left", role="foreign_company_country_")


# The joins that rows can be lost in: step, column of the fact, side table, its key.
LOSSY_STEPS = [("us_company", "us_companies", "us_company"), ("foreign_company", "foreign_companies", "foreign_company"),
               ("carrier", "carriers", "carrier"), ("us_port", "us_ports", "us_port"), ("foreign_country", "countries", "foreign_country")]


def lost_names(fact: DataFrame, side: SideTables) -> DataFrame:
    """What the name maps and the region table lack: ``step, name, n``, a row per raw name of
    :func:`parse_parties` that no map has and per clean country without a region, with the rows it has.
    Each step is judged on all rows, not only on those the steps before left."""
    out = None

    def add(step: str, rows: DataFrame, column: str, dim: DataFrame, key: str):
        nonlocal out
        counts = rows.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
        part = unmatched(counts, dim.select(F.col(key).alias("_key")).distinct(), {"name": "_key"}) \
            .select(F.lit(step).alias("step"), "name", "n")
        out = part if out is None else out.unionAll(part)
    for column, table, key in LOSSY_STEPS:
        add(column, fact, column, getattr(side, table), key)
    country = keyed(side.countries.select("foreign_country", F.col("name").alias("_clean")), "foreign_country")
    named = enrich(fact, country, {"foreign_country": "foreign_country"}, "inner")
    regions = side.regions.select("name").filter(F.col("name").isNotNull())
    known = regions.unionAll(regions.select(recode("name", {v: k for k, v in fixed.COUNTRY_NAMES.items()})))
    add("region", named, "_clean", known, "name")
    return out


# Value column and baseline columns of the two weekly counts.
BASELINES = {
    "cases_weekly": ("time0_state_case", "cases_state_firstweek", "cases_pctdelta"),
    "deaths_weekly": ("time0_state_death", "deaths_state_firstweek", "deaths_pctdelta"),
}


def build_warehouse(imports: DataFrame, exports: DataFrame, side: SideTables,
                    min_total: float = fixed.MIN_ENTITY_TONS, last_count_year: int | None = 2020) -> DataFrame:
    """The whole build. Weekly counts after ``last_count_year`` are left out, none if it is None.

    The fact is written to the shared folder twice: before the company totals and before
    the outlier passes. Both parts read their input several times, and a table costs less
    than the joins and the distinct before it; the outlier passes read one column of it
    each, and what they leave is a filter by known bounds. Baselines depend on the weekly
    counts alone, so they are taken there, on a few rows per state, and come along in the
    join. States and weeks without trade are found on the distinct ones of the fact, a
    small table that goes through the same joins.
    """
    # copies go with the distinct before the totals
    raw = union_conformed(conform_imports(imports), conform_exports(exports))
    fact = parse_parties(classify_products(raw, side.hs_groups.drop("description")))
    fact = add_regions(standardise_names(fact, side), side.regions)
    fact = fact.withColumns({
        "us_port_state": port_state("us_port_clustered"),
        "foreign_country_clustered": recode("foreign_country_clustered", fixed.COUNTRY_NAMES),
        "foreign_company_country_clustered": recode("foreign_company_country_clustered", fixed.COUNTRY_NAMES)})
    fact = settle(dedupe(fact.drop("us_company_state", "us_company_agg")), "conformed")
    fact = settle(size_entities(fact, {"us_company_clustered": "us_company_size",
                                       "foreign_company_clustered": "foreign_company_size"}, least=[min_total, min_total]), "sized")
    fact = outlier_chain(fact, [("z", "metric_tons", fixed.OUTLIER_Z), ("cap", "metric_tons", fixed.MAX_SHIPMENT_TONS),
                                ("z", "teus", fixed.OUTLIER_Z), ("z", "tcvusd", fixed.OUTLIER_Z)])
    fact = time_features(fact.withColumn("ship_date", parse_date("date", "yyyyMMdd")).drop("date"), "ship_date")
    fact = enrich_economic(fact, side.unemployment, side.tariffs, side.currencies, members=side.members) \
        .drop("hs_class", "year_month", "foreign_country_clustered")
    states = measured(keyed(side.states.select("state", "state_code", "state_region"), "state_code"))
    closures = keyed(side.closures, "state")
    seen = measured(fact.select("us_port_state", "year_week").distinct())
    fact, seen = (enrich(rows, states, {"us_port_state": "state_code"}) for rows in (fact, seen))
    fact, seen = (preserve_dim(rows, closures, {"state": "state"}, seen) for rows in (fact, seen))
    weekly = weekly_cases(side.cases, side.states, last_count_year)
    for value, names in BASELINES.items():
        weekly = first_period_change(weekly, "state_code", "date_weekly", value, *names)
    fact = closure_lead(weekly_shocks(fact, weekly, seen=seen))
    for names in BASELINES.values():
        fact = fill_undated(fact, "date_weekly", *names)
    return dedupe(fact.drop("vin_quantity", "us_company_clustered", "foreign_company_clustered",
                            "foreign_company_country_clustered", "us_port_state"))
