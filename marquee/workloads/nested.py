"""Literal cells flattened into entity and link tables.

Every line item carries cells in the notation of the raw film files, made from its own columns: repeated
entities with differing names, missing names, quotes inside names, codes of the wrong length and malformed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import nested
from marquee.plans import load
from marquee.session import dealt_out
from marquee.workloads import query, table

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(*ORDER, "l_returnflag", "l_linestatus")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")

    def text(pattern: str, *args):
        """The pattern with its ``%`` marks filled by columns."""
        first, *rest = pattern.split("%")
        parts = [F.lit(first)]
        for arg, piece in zip(args, rest, strict=True):
            parts += [F.col(arg) if isinstance(arg, str) else arg, F.lit(piece)]
        return F.concat(*parts)

    genres = F.when(
        flag == "A", text("[{'id': %, 'name': 'Supplier line %'}, {'id': %, 'name': 'Part'}]", "l_suppkey", "l_linenumber", F.col("l_partkey") + 1000000)
    ).when(flag == "N", text("[{'id': %, 'name': \"O'Brien & Co\"}, {'id': %, 'name': None}, 7]", "l_suppkey", "l_partkey")).otherwise(
        F.when(status == "O", "[]").otherwise(text("[{'id': %, 'name': ", "l_suppkey"))
    )
    countries = F.when(flag == "A", text("[{'iso_3166_1': ' U% ', 'name': 'Land %'}]", "l_linenumber", "l_partkey")).when(
        flag == "N", text("[{'iso_3166_1': 'usa', 'name': 'x'}, {'iso_3166_1': 'd%', 'name': ''}]", "l_linenumber")
    ).otherwise(text("[{'iso_3166_1': 'F%', 'name': 'Pays %'}]", "l_linenumber", "l_suppkey"))
    collection = F.when(
        flag != "R", text("{'id': %, 'name': 'Saga %', 'poster_path': '/p%.jpg', 'backdrop_path': None}", "l_suppkey", "l_linenumber", "l_partkey")
    ).otherwise("[]")
    cast = text(
        "[{'cast_id': 1, 'character': '%', 'credit_id': '52fe', 'gender': %, 'id': %, 'name': 'Person %', 'order': %, 'profile_path': None}]",
        F.when(flag == "A", "").otherwise(F.lit("Hero (voice)")), "l_linenumber", "l_suppkey", "l_linenumber",
        F.when(flag == "R", "None").otherwise(F.col("l_linenumber").cast("string")),
    )
    crew = text(
        "[{'credit_id': '52fe', 'department': '%', 'gender': 0, 'id': %, 'job': '%', 'name': \"D'Arcy %\", 'profile_path': '/x.jpg'}]",
        F.when(status == "O", "").otherwise(F.lit("Sound")), F.col("l_partkey") + 50, F.when(flag == "N", "").otherwise(status), "l_linenumber",
    )
    return li.select(
        *ORDER, genres.alias("genres"), countries.alias("production_countries"), collection.alias("belongs_to_collection"),
        cast.alias("cast"), crew.alias("crew"), flag, status,
    )


GENRES = """
g as (
  select *, 0 as pos, l_suppkey as id, 'Supplier line ' || l_linenumber as name from lineitem where l_returnflag = 'A'
  union all select *, 1, l_partkey + 1000000, 'Part' from lineitem where l_returnflag = 'A'
  union all select *, 0, l_suppkey, 'O''Brien & Co' from lineitem where l_returnflag = 'N')"""
COUNTRIES = """
c as (
  select *, 0 as pos, 'u' || l_linenumber as id, 'Land ' || l_partkey as name from lineitem where l_returnflag = 'A'
  union all select *, 0, 'f' || l_linenumber, 'Pays ' || l_suppkey from lineitem where l_returnflag = 'R')"""
FIRST = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, pos)"
PEOPLE = """
ca as (select *, 0 as part, 0 as pos, l_suppkey as id, 'Person ' || l_linenumber as name, l_linenumber as gender, null as profile from lineitem),
cr as (select *, 1 as part, 0 as pos, l_partkey + 50 as id, 'D''Arcy ' || l_linenumber as name, 0 as gender, '/x.jpg' as profile
  from lineitem where l_returnflag <> 'N')"""


@query(f"with {GENRES} select id, arg_min(name, {FIRST}) as name from g group by id")
def nested_entities(spark, sf_dir):
    return nested.entities(nested.id_name_items(cells(spark, sf_dir), "l_orderkey", "genres", ORDER), ORDER)


@query(f"with {GENRES} select distinct l_orderkey as movie_id, id as genre_id from g")
def nested_links(spark, sf_dir):
    return nested.junction(nested.id_name_items(cells(spark, sf_dir), "l_orderkey", "genres", ORDER), "genre_id")


@query(f"with {COUNTRIES} select id as iso_3166_1, arg_min(name, {FIRST}) as name from c group by id")
def nested_code_entities(spark, sf_dir):
    family = next(f for f in load.FAMILIES if f.entity == "production_countries")
    return family.tables(cells(spark, sf_dir), "l_orderkey", ORDER)[0]


@query(f"with {COUNTRIES} select distinct l_orderkey as movie_id, id as country_iso from c")
def nested_code_links(spark, sf_dir):
    family = next(f for f in load.FAMILIES if f.entity == "production_countries")
    return family.tables(cells(spark, sf_dir), "l_orderkey", ORDER)[1]


@query("""
select l_suppkey as id, 'Saga ' || arg_min(l_linenumber, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) as name,
  '/p' || arg_min(l_partkey, (l_orderkey, l_linenumber, l_partkey, l_suppkey)) || '.jpg' as poster_path
from lineitem where l_returnflag <> 'R' group by l_suppkey""")
def nested_collections(spark, sf_dir):
    return nested.collections(cells(spark, sf_dir), "belongs_to_collection", ORDER).drop("backdrop_path")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_returnflag <> 'R' then l_suppkey::double end as collection_id from lineitem")
def nested_collection_id(spark, sf_dir):
    rows = dealt_out(cells(spark, sf_dir).select(*ORDER, "belongs_to_collection"), *ORDER)
    found = nested.with_collection_id(rows, "collection_id", "belongs_to_collection")
    return found.select(*ORDER, F.col("collection_id").cast("double").alias("collection_id"))


@query("""
select l_orderkey as movie_id, l_suppkey as person_id, l_linenumber as cast_order, character_name from (
  select *, case when l_returnflag <> 'A' then 'Hero (voice)' end as character_name,
    row_number() over (partition by l_orderkey, l_suppkey, l_linenumber order by l_partkey) as pick
  from lineitem where l_returnflag <> 'R') where pick = 1""")
def nested_cast(spark, sf_dir):
    return nested.cast_table(nested.cast_items(cells(spark, sf_dir), "l_orderkey", "cast", ORDER), ORDER)


@query("""
select l_orderkey as movie_id, l_partkey + 50 as person_id, l_linestatus as job, department from (
  select *, case when l_linestatus <> 'O' then 'Sound' end as department,
    row_number() over (partition by l_orderkey, l_partkey, l_linestatus order by l_linenumber, l_suppkey) as pick
  from lineitem where l_returnflag <> 'N') where pick = 1""")
def nested_crew(spark, sf_dir):
    return nested.crew_table(nested.crew_items(cells(spark, sf_dir), "l_orderkey", "crew", ORDER), ORDER)


@query(f"""
with {PEOPLE}, p as (select * from ca union all select * from cr),
f as (select *, row_number() over (partition by id order by l_orderkey, l_linenumber, l_partkey, l_suppkey, part, pos) as pick from p)
select id, name, gender, profile as profile_path from f where pick = 1""")
def nested_people(spark, sf_dir):
    rows = cells(spark, sf_dir)
    return nested.people(
        nested.cast_items(rows, "l_orderkey", "cast", ORDER), nested.crew_items(rows, "l_orderkey", "crew", ORDER), ORDER
    )


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  case l_returnflag when 'A' then 2 when 'N' then 3 else 0 end as items from lineitem""")
def nested_list_or_empty(spark, sf_dir):
    rows = dealt_out(cells(spark, sf_dir).select(*ORDER, "genres"), *ORDER)
    return nested.with_literal_list(rows, "genres", "genres", {"id": "long", "name": "string"}).select(*ORDER, F.size("genres").alias("items"))
