"""Cleaning rules, duplicate rules and the cleaning pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators import cleaning as c
from marquee.operators import dedup
from marquee.plans import load, prepare
from marquee.workloads import query, table

ROW = ["row_no"]


def raw_films(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders dressed up as a raw film file: all text, with every defect the rules are about."""
    o = table(spark, sf_dir, "orders")
    status, prio, key = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey")
    text = key.cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        key.alias("row_no"),
        F.when((status == "P") & (prio == "1-URGENT"), day).otherwise(text).alias("id"),
        F.when(prio != "5-LOW", F.format_string("tt%07d", "o_custkey")).alias("imdb_id"),
        F.when(prio != "2-HIGH", F.concat(F.lit(" Film \t"), text, F.lit("\n"))).alias("title"),
        F.when(status != "O", F.concat(F.lit("Original  "), text)).alias("original_title"),
        F.lower(status).alias("original_language"),
        F.when(prio == "3-MEDIUM", "N/A").when(prio == "4-NOT SPECIFIED", " No Overview Found. ")
        .otherwise(F.concat(F.lit("A film about order "), text)).alias("overview"),
        F.when(status == "F", F.concat(F.lit("tag "), prio)).alias("tagline"),
        F.when(status == "O", F.date_format("o_orderdate", "M/d/yyyy")).otherwise(day).alias("release_date"),
        F.when(status == "P", "unknown").otherwise(F.floor(F.col("o_totalprice") / 1000).cast("string")).alias("runtime"),
        F.col("o_custkey").cast("string").alias("budget"),
        F.when(status == "F", "0").otherwise(F.floor("o_totalprice").cast("string")).alias("revenue"),
        F.floor(F.col("o_totalprice") / 50000).cast("string").alias("popularity"),
        F.month("o_orderdate").cast("string").alias("vote_average"),
        (F.dayofmonth("o_orderdate") - 1).cast("string").alias("vote_count"),
        F.when(prio != "2-HIGH", "Released").alias("status"),
        F.when((status == "F") & (prio == "1-URGENT"), " True ").when(prio == "5-LOW", F.lit(None)).otherwise("False").alias("adult"),
    )


RAW_FILMS = """
raw_films as (
  select o_orderkey as row_no,
    case when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then strftime(o_orderdate, '%Y-%m-%d')
         else o_orderkey::varchar end as id,
    case when o_orderpriority <> '5-LOW' then 'tt' || lpad(o_custkey::varchar, 7, '0') end as imdb_id,
    case when o_orderpriority <> '2-HIGH' then ' Film' || chr(160) || chr(9) || o_orderkey || chr(10) end as title,
    case when o_orderstatus <> 'O' then 'Original  ' || o_orderkey end as original_title,
    lower(o_orderstatus) as original_language,
    case o_orderpriority when '3-MEDIUM' then 'N/A' when '4-NOT SPECIFIED' then ' No Overview' || chr(160) || 'Found. '
         else 'A film about order ' || o_orderkey end as overview,
    case when o_orderstatus = 'F' then 'tag ' || o_orderpriority end as tagline,
    case when o_orderstatus = 'O' then strftime(o_orderdate, '%-m/%-d/%Y') else strftime(o_orderdate, '%Y-%m-%d') end as release_date,
    case when o_orderstatus = 'P' then 'unknown' else floor(o_totalprice / 1000)::bigint::varchar end as runtime,
    o_custkey::varchar as budget,
    case when o_orderstatus = 'F' then '0' else floor(o_totalprice)::bigint::varchar end as revenue,
    floor(o_totalprice / 50000)::bigint::varchar as popularity,
    month(o_orderdate)::varchar as vote_average,
    (day(o_orderdate) - 1)::varchar as vote_count,
    case when o_orderpriority <> '2-HIGH' then 'Released' end as status,
    case when o_orderstatus = 'F' and o_orderpriority = '1-URGENT' then ' True ' when o_orderpriority = '5-LOW' then null else 'False' end as adult
  from orders)"""

SPACE = r"[\s\x{a0}]+"

CLEANED = RAW_FILMS + f""",
typed as (
  select row_no, try_cast(id as bigint) as id, imdb_id,
    trim(regexp_replace(title, '{SPACE}', ' ', 'g')) as title,
    trim(regexp_replace(original_title, '{SPACE}', ' ', 'g')) as original_title, original_language,
    trim(regexp_replace(overview, '{SPACE}', ' ', 'g')) as overview,
    trim(regexp_replace(tagline, '{SPACE}', ' ', 'g')) as tagline,
    try_strptime(release_date, '%Y-%m-%d')::date as release_date,
    try_cast(runtime as double) as runtime, try_cast(budget as double) as budget, try_cast(revenue as double) as revenue,
    try_cast(popularity as double) as popularity, try_cast(vote_average as double) as vote_average,
    try_cast(vote_count as bigint) as vote_count, status, adult
  from raw_films
  where try_cast(id as bigint) is not null and coalesce(lower(trim(adult)) not in ('true', '1'), true)),
masked as (
  select row_no, id, imdb_id, title, original_title, original_language,
    case when lower(overview) not in ('n/a', 'no overview found.') then overview end as overview, tagline, release_date,
    case when runtime <> 0 and runtime <= 300 then runtime end as runtime,
    case when budget >= 1000 or budget < 0 then budget end as budget,
    nullif(revenue, 0) as revenue, nullif(popularity, 0) as popularity,
    case when vote_count > 0 then vote_average end as vote_average, vote_count,
    coalesce(status, 'Unknown') as status, adult from typed),
cleaned as (
  select * exclude (pick) from (select *, row_number() over (partition by imdb_id order by row_no) as pick from masked) where pick = 1)"""

CLEANED_COLUMNS = (
    "id", "imdb_id", "title", "original_title", "original_language", "overview", "tagline", "runtime", "budget", "revenue",
    "popularity", "vote_average", "vote_count", "status", "adult",
)


@query(f"with {RAW_FILMS} select row_no, id, title from raw_films where try_cast(id as bigint) is not null")
def drop_shifted_rows(spark, sf_dir):
    return c.clean(raw_films(spark, sf_dir), [c.drop_shifted("id")]).select("row_no", "id", "title")


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  case when l_returnflag = 'N' then null else l_partkey::double end as whole,
  case when l_linestatus = 'O' then l_extendedprice end as real
from lineitem""")
def cast_types(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    text = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_returnflag") == "N", F.concat(F.lit("x"), F.col("l_partkey"))).otherwise(F.concat(F.lit(" "), F.col("l_partkey"), F.lit(".0"))).alias("whole"),
        F.when(F.col("l_linestatus") == "O", F.format_string("%.2fe0", "l_extendedprice")).otherwise("1d").alias("real"),
    )
    cast = c.clean(text, [c.cast_types(whole=["whole"], real=["real"])])
    return cast.withColumn("whole", F.col("whole").cast("double"))


@query(f"""with {RAW_FILMS} select row_no, strftime(try_strptime(release_date, '%Y-%m-%d'), '%Y-%m-%d') as release_date from raw_films""")
def parse_release_dates(spark, sf_dir):
    parsed = c.clean(raw_films(spark, sf_dir), [c.parse_day("release_date")])
    return parsed.select("row_no", F.date_format("release_date", "yyyy-MM-dd").alias("release_date"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(l_discount, 0) as l_discount, nullif(l_tax, 0) as l_tax from lineitem")
def zeros_to_null(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax")
    return c.clean(li, c.zero_to_null("l_discount", "l_tax"))


def rated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") != "signup", F.col("value")).alias("vote_average"),
        F.when(F.col("event_type") != "error", votes).alias("vote_count"),
    )


RATED = """
rated as (select event_id, case when event_type <> 'signup' then value end as vote_average,
  case when event_type <> 'error' then (props->>'$.k')::double end as vote_count from events)"""


@query(f"""with {RATED} select event_id, vote_count, case when coalesce(vote_count, 0) <> 0 then vote_average end as vote_average from rated""")
def null_rating_without_votes(spark, sf_dir):
    return c.clean(rated_events(spark, sf_dir), [c.null_rating_without_votes()])


@query(f"""with {RATED} select event_id, vote_count, case when vote_count < 10 then null else vote_average end as vote_average from rated""")
def null_rating_with_few_votes(spark, sf_dir):
    return c.clean(rated_events(spark, sf_dir), [c.null_rating_with_few_votes()])


@query("select o_orderkey, case when o_totalprice <= 300000 then o_totalprice end as runtime from orders")
def null_long_runtime(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("runtime"))
    return c.clean(o, [c.null_long_runtime("runtime", 300000)])


@query("select c_custkey, case when c_acctbal > 0 and c_acctbal < 1000 then null else c_acctbal end as budget from customer")
def null_tiny_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("budget"))
    return c.clean(rows, [c.null_tiny_budget()])


@query("select doc_id, md5(case when length(text) >= 30 then text end) as overview_md5 from documents")
def null_short_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("overview"))
    return c.clean(rows, [c.null_short_text()]).select("doc_id", F.md5("overview").alias("overview_md5"))


@query("select c_custkey, case when c_mktsegment = 'BUILDING' then 'Unknown' else c_mktsegment end as status from customer")
def fill_missing_status(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("status"))
    return c.clean(rows, [c.fill_missing("status")])


@query(f"""select doc_id, md5(trim(regexp_replace(chr(160) || ' ' || text || chr(9) || chr(160), '{SPACE}', ' ', 'g'))) as text_md5 from documents""")
def tidy_space(spark, sf_dir):
    padded = F.concat(F.lit("  "), F.col("text"), F.lit("\t "))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text", padded)
    return c.clean(rows, c.tidy_space("text")).select("doc_id", F.md5("text").alias("text_md5"))


@query("""
select conv_id, turn, md5(case when role = 'system' or (role = 'user' and turn = 0) then null else text end) as overview_md5 from conversations""")
def null_placeholders(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") == "system", " N/A ").when((F.col("role") == "user") & (F.col("turn") == 0), "No Overview Found.")
        .otherwise(F.col("text")).alias("overview"),
    )
    return c.clean(rows, [c.null_placeholders()]).select("conv_id", "turn", F.md5("overview").alias("overview_md5"))


@query("select doc_id, case when quality = 0 then null else 'False' end as adult from labels where toxic = 0")
def drop_adult(spark, sf_dir):
    flag = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 1, " True ").otherwise("1")).when(F.col("quality") == 1, "False")
    return c.clean(table(spark, sf_dir, "labels").select("doc_id", flag.alias("adult")), [c.drop_adult()])


@query("select p_partkey, p_name, p_type from part")
def keep_columns(spark, sf_dir):
    kept, _ = c.keep_columns(table(spark, sf_dir, "part"), ["p_partkey", "p_name", "no_such_column", "p_type"])
    return kept


def raw_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("movieId"), (F.col("o_totalprice") * 100).cast("bigint").alias("imdbId"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.col("o_custkey"), F.lit(".0"))).alias("tmdbId"),
    )


LINKS = """
raw_links as (select o_orderkey as "movieId", trunc(o_totalprice * 100)::bigint as "imdbId",
  case when o_orderstatus <> 'P' then o_custkey end as "tmdbId" from orders),
links as (select * exclude (pick) from (select *, row_number() over (partition by "tmdbId" order by "movieId") as pick
  from raw_links where "tmdbId" is not null) where pick = 1)"""


@query(f"""with {LINKS} select "movieId", "imdbId", "tmdbId" from raw_links where "tmdbId" is not null""")
def drop_missing_keys(spark, sf_dir):
    rows = c.clean(raw_links(spark, sf_dir), [c.drop_missing("tmdbId"), c.cast_types(whole=["tmdbId"])])
    return rows.select("movieId", "imdbId", "tmdbId")


@query(f"""with {LINKS} select "movieId", "imdbId", "tmdbId" from links""")
def clean_links(spark, sf_dir):
    return prepare.clean_links(raw_links(spark, sf_dir), ["movieId"]).select("movieId", "imdbId", "tmdbId")


@query(f"""with {LINKS} select "tmdbId"::integer as movie_id, "movieId"::integer as movielens_id,
  'tt' || case when length("imdbId"::varchar) < 7 then lpad("imdbId"::varchar, 7, '0') else "imdbId"::varchar end as imdb_id_full from links""")
def external_id_rows(spark, sf_dir):
    return load.external_id_rows(prepare.clean_links(raw_links(spark, sf_dir), ["movieId"]))


@query(f"""with {CLEANED} select {', '.join(CLEANED_COLUMNS)}, strftime(release_date, '%Y-%m-%d') as release_date from cleaned""")
def clean_movies(spark, sf_dir):
    cleaned = prepare.clean_movies(raw_films(spark, sf_dir), ROW)
    return cleaned.select(*CLEANED_COLUMNS, F.date_format("release_date", "yyyy-MM-dd").alias("release_date"))


@query(f"""with {CLEANED}
select m as "column", present, round(100.0 * present / n, 6) as present_pct from (
  select count(*) as n, count(budget) as budget, count(revenue) as revenue, count(runtime) as runtime,
    count(vote_average) as vote_average, count(popularity) as popularity from cleaned)
  unpivot (present for m in (budget, revenue, runtime, vote_average, popularity))""")
def cleaned_completeness(spark, sf_dir):
    report = prepare.movies_completeness(prepare.clean_movies(raw_films(spark, sf_dir), ROW))
    return report.select("column", "present", F.round("present_pct", 6).alias("present_pct"))


@query(f"""with {CLEANED}
select id::integer as id, imdb_id, coalesce(title, original_title, 'Untitled') as title, runtime, budget, revenue, popularity, vote_average, vote_count::double as vote_count, status,
  case when adult is null then false else lower(trim(adult)) <> 'false' end as adult from cleaned""")
def stored_movie_rows(spark, sf_dir):
    cleaned = prepare.clean_movies(raw_films(spark, sf_dir), ROW)
    empty = F.lit(None).cast("string")
    rows = load.movie_rows(cleaned.withColumns({"belongs_to_collection": empty, "poster_path": empty}))
    numbers = ("runtime", "budget", "revenue", "popularity", "vote_average", "vote_count")
    return rows.select("id", "imdb_id", "title", *[F.col(n).cast("double").alias(n) for n in numbers], "status", "adult")


@query(f"""with {RAW_FILMS},
a as (select *, try_cast(id as bigint) is not null as ok, coalesce(lower(trim(adult)) in ('true', '1'), false) as x from raw_films),
k as (select *, try_cast(runtime as double) as rt, try_cast(budget as double) as b, try_cast(vote_count as bigint) as v from a where ok and not x),
counts as (
  select 1 as step, (select count(*) from a) as rows_in, (select count(*) from a where not ok) as affected
  union all select 2, (select count(*) from a where ok), (select count(*) from a where ok and runtime = 'unknown')
  union all select 3, (select count(*) from a where ok), (select count(*) from a where ok and try_strptime(release_date, '%Y-%m-%d') is null)
  union all select 4, (select count(*) from a where ok), (select count(*) from a where ok and x)
  union all select 5, count(*), count(*) filter (b = 0) from k
  union all select 6, count(*), count(*) filter (revenue = '0') from k
  union all select 7, count(*), count(*) filter (popularity = '0') from k
  union all select 8, count(*), count(*) filter (coalesce(v, 0) = 0) from k
  union all select 9, count(*), count(*) filter (rt = 0) from k
  union all select 10, count(*), count(*) filter (rt > 300) from k
  union all select 11, count(*), count(*) filter (b > 0 and b < 1000) from k
  union all select 12, count(*), count(title) from k
  union all select 13, count(*), count(original_title) from k
  union all select 14, count(*), count(overview) from k
  union all select 15, count(*), count(tagline) from k
  union all select 16, count(*), count(*) filter (overview = 'N/A' or overview like ' No%') from k
  union all select 17, count(*), count(*) filter (status is null) from k)
select step, rows_in, affected, case when step in (1, 4) then rows_in - affected else rows_in end as rows_out from counts""")
def cleaning_audit(spark, sf_dir):
    return prepare.movies_audit(raw_films(spark, sf_dir)).select("step", "rows_in", "affected", "rows_out")


# ---- duplicates ---------------------------------------------------------------------------------------------------


@query("select min(doc_id) as doc_id, md5(text) as text_md5, lang from documents group by text, lang")
def dedup_full(spark, sf_dir):
    rows = dedup.drop_full_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id"])
    return rows.select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from (
  select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) as pick from lineitem) where pick = 1""")
def dedup_first_by_key(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return dedup.first_by_key(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("""
with k as (select o_orderkey, case when o_orderpriority <> '5-LOW' then o_custkey::varchar end as imdb_id from orders)
select o_orderkey, imdb_id from (select *, row_number() over (partition by imdb_id order by o_orderkey) as pick from k) where pick = 1""")
def dedup_null_keys_collapse(spark, sf_dir):
    key = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey").cast("string"))
    return dedup.first_by_key(table(spark, sf_dir, "orders").select("o_orderkey", key.alias("imdb_id")), ["imdb_id"], ["o_orderkey"])


@query("""
with k as (select o_orderkey, case when o_orderpriority <> '5-LOW' then o_custkey::varchar end as imdb_id from orders)
select o_orderkey, imdb_id from (select *, row_number() over (partition by imdb_id order by o_orderkey) as pick from k) where pick = 1 or imdb_id is null""")
def dedup_null_keys_kept(spark, sf_dir):
    key = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("imdb_id"))
    return dedup.first_by_key(rows, ["imdb_id"], ["o_orderkey"], keep_null_keys=True)


@query("select o_custkey, arg_max(o_orderpriority, o_orderkey) as o_orderpriority from orders group by o_custkey")
def last_value_by_key(spark, sf_dir):
    return dedup.last_value(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query("select user_id, arg_min(event_type, event_id) as event_type, arg_min(value, event_id) as value from events group by user_id")
def first_seen_values(spark, sf_dir):
    return dedup.first_values(table(spark, sf_dir, "events"), "user_id", ["event_type", "value"], ["event_id"])


@query("""
with c as (select doc_id, n_chars as id, text, lang from documents),
f as (select min(doc_id) as doc_id, id, text, lang from c group by id, text, lang)
select doc_id, id, md5(text) as cast_md5, lang as crew from (select *, row_number() over (partition by id order by doc_id) as pick from f) where pick = 1""")
def clean_credits(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("id"), F.col("text").alias("cast"), F.col("lang").alias("crew"))
    return prepare.clean_credits(raw, ["doc_id"]).select("doc_id", "id", F.md5("cast").alias("cast_md5"), "crew")


@query("select min(doc_id) as doc_id, n_chars as id, md5(text) as keywords_md5 from documents group by n_chars, text")
def clean_keywords(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("id"), F.col("text").alias("keywords"))
    return prepare.clean_keywords(raw, ["doc_id"]).select("doc_id", "id", F.md5("keywords").alias("keywords_md5"))
