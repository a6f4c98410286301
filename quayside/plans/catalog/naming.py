"""Text standardisation."""

import json

from pyspark.sql import functions as F

from quayside.operators import name_groups, names
from quayside.plans.registry import query

# goods names in several spellings, derived from the parts
SPELLING_SQL = """(select p_partkey as part_key, case when p_size < 10 then upper(replace(p_name, ' ', '-'))
    when p_size < 20 then replace(p_name, ' ', '') when p_size < 30 then replace(p_name, 'e', 'é')
    else p_name end as goods from part)"""


def _spellings(t):
    goods = (F.when(F.col("p_size") < 10, F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))))
             .when(F.col("p_size") < 20, F.replace("p_name", F.lit(" "), F.lit("")))
             .when(F.col("p_size") < 30, F.replace("p_name", F.lit("e"), F.lit("é")))
             .otherwise(F.col("p_name")))
    return t.part.select(F.col("p_partkey").alias("part_key"), goods.alias("goods"))


RECIPE = json.dumps([
    {"op": "core/text-transform", "columnName": "code", "expression": "value.toNumber()", "onError": "keep-original"},
    {"op": "core/column-addition", "baseColumnName": "goods", "expression": "grel:value", "newColumnName": "clean"},
    {"op": "core/mass-edit", "columnName": "clean", "edits": [
        {"from": ["RED-BOLT", "redbolt", "réd bolt"], "to": "red bolt"},
        {"from": ["OLD-GEAR", "oldgear"], "to": "old gear"}]},
    {"op": "core/mass-edit", "columnName": "clean", "edits": [{"from": ["red bolt"], "to": "RED BOLT"}]},
    {"op": "core/column-removal", "columnName": "goods"},
])


@query("mass_edit", f"""
    select part_key, coalesce(cast(try_cast(code as double) as varchar), code) as code,
        case when goods in ('RED-BOLT', 'redbolt', 'réd bolt', 'red bolt') then 'RED BOLT'
             when goods in ('OLD-GEAR', 'oldgear') then 'old gear' else goods end as clean
    from (select part_key, goods, case when part_key < 100 then cast(p_size as varchar) else p_brand end as code
          from {SPELLING_SQL} join part on part_key = p_partkey)""")
def mass_edit(t):
    code = F.when(F.col("p_partkey") < 100, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    codes = t.part.select(F.col("p_partkey").alias("part_key"), code.alias("code"))
    return names.apply_recipe(_spellings(t).join(codes, "part_key"), RECIPE)


FINGERPRINT_SQL = f"""(select *, count(*) over (partition by cluster) as cluster_size from (
    select regexp_replace(upper(strip_accents(goods)), '[^A-Z0-9]+', '', 'g') as cluster, goods as name, count(*) as n
    from {SPELLING_SQL} group by goods))"""


@query("cluster_fingerprint", f"""
    select cluster, name, n, cluster_size from {FINGERPRINT_SQL} where cluster_size > 1""")
def cluster_fingerprint(t):
    return names.cluster_fingerprint(_spellings(t), "goods")


@query("cluster_sound")
def cluster_sound(t):
    return names.cluster_sound(_spellings(t), "goods")


@query("cluster_similar", """
    select a.c_name as left, b.c_name as right, cast(levenshtein(a.c_name, b.c_name) as integer) as distance
    from customer a join customer b on a.c_name < b.c_name and levenshtein(a.c_name, b.c_name) <= 1""")
def cluster_similar(t):
    return names.cluster_similar(t.customer, "c_name", 1)


@query("cluster_canonical", f"""
    select cluster, name as canonical from {FINGERPRINT_SQL} where cluster_size > 1
    qualify row_number() over (partition by cluster order by n desc, name) = 1""")
def cluster_canonical(t):
    return names.canonical_name(names.cluster_fingerprint(_spellings(t), "goods"))


# names of companies and places, many of them a letter apart
GROUPS_OF_NAMES_SQL = """
    with recursive counted as (select name, count(*) as n from (
            select s_name as name from supplier union all select n_name from nation union all select r_name from region union all select n_name from nation) group by 1),
        linked as (select a.name as a, b.name as b from counted a join counted b on a.name <> b.name and levenshtein(a.name, b.name) <= 1),
        reach(name, other) as (select name, name from counted union select r.name, l.b from reach r join linked l on l.a = r.other),
        rooted as (select name, min(other) as cluster from reach group by 1),
        sized as (select cluster, count(*) as cluster_size, arg_min(c.name, (-n, c.name)) as centre from rooted join counted c using (name) group by 1),
        judged as (select c.name, n, cluster, cluster_size, centre, levenshtein(c.name, centre) as away from counted c join rooted using (name) join sized using (cluster))"""


def _typed(t):
    places = t.nation.select(F.col("n_name").alias("name"))
    return t.supplier.select(F.col("s_name").alias("name")).unionAll(places).unionAll(t.region.select("r_name")).unionAll(places)


@query("name_groups", f"""{GROUPS_OF_NAMES_SQL}
    select name, n, cluster, cluster_size, case when away <= 1 then centre else name end as canonical,
        case when away <= 1 then away::int end as distance, away > 1 as conflict from judged""")
def grouped_names(t):
    return name_groups.group_similar(_typed(t), "name", 1, 1)
