"""Profiling reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators import profile as p
from marquee.workloads import query, table
from marquee.workloads.cleaning import RAW_FILMS, raw_films
from marquee.workloads.nested import cells


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("""
select * from (values (1, 'o_orderkey', 'bigint'), (2, 'o_custkey', 'bigint'), (3, 'o_orderstatus', 'string'), (4, 'o_totalprice', 'double'),
  (5, 'o_orderdate', 'timestamp_ntz'), (6, 'o_orderpriority', 'string')) t(position, "column", dtype),
  (select count(*) as "rows" from orders), (select 6 as columns)""")
def profile_basic(spark, sf_dir):
    return p.basic_stats(table(spark, sf_dir, "orders"))


@query(f"""with {RAW_FILMS}
select c as "column", n - present as missing, round(100.0 * (n - present) / n, 6) as pct from (
  select count(*) as n, count(imdb_id) as imdb_id, count(title) as title, count(original_title) as original_title,
    count(tagline) as tagline, count(status) as status, count(adult) as adult from raw_films)
  unpivot (present for c in (imdb_id, title, original_title, tagline, status, adult)) where n > present""")
def profile_missing(spark, sf_dir):
    return rounded(p.missing(raw_films(spark, sf_dir)), "pct")


@query("select count(*) - (select count(*) from (select distinct text, lang from documents)) as duplicates from documents")
def profile_full_duplicates(spark, sf_dir):
    return p.full_duplicates(table(spark, sf_dir, "documents").select("text", "lang"))


@query(f"""with {RAW_FILMS}
select 'imdb_id' as key, sum(n)::bigint as rows_involved from (select count(*) as n from raw_films group by imdb_id) where n > 1
union all select 'title', sum(n)::bigint from (select count(*) as n from raw_films group by title) where n > 1""")
def profile_key_duplicates(spark, sf_dir):
    return p.key_duplicates(raw_films(spark, sf_dir), ["imdb_id", "title"])


@query(f"""with {RAW_FILMS}, v as (
  select 'runtime' as "column", runtime as raw, try_cast(runtime as double) as v from raw_films
  union all select 'revenue', revenue, try_cast(revenue as double) from raw_films)
select "column", min(v) as min, max(v) as max, round(avg(v), 6) as mean, count(*) filter (v = 0) as zeros, count(*) filter (v < 0) as negatives,
  count(*) filter (v is null and raw is not null) as non_numeric from v group by "column" """)
def profile_numeric(spark, sf_dir):
    return rounded(p.numeric_profile(raw_films(spark, sf_dir), ["runtime", "revenue"]), "mean")


@query("""
select c as "column", p, round(case p when 0.5 then q[1] when 0.9 then q[2] else q[3] end, 6) as quantile from (
  select quantile_cont(l_extendedprice, [0.5, 0.9, 0.99]) as l_extendedprice, quantile_cont(l_quantity, [0.5, 0.9, 0.99]) as l_quantity from lineitem)
  unpivot (q for c in (l_extendedprice, l_quantity)), (values (0.5::double), (0.9), (0.99)) t(p)""")
def profile_quantiles(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    return rounded(p.quantiles(lines, lines.columns), "quantile")


@query("""
select 'o_totalprice' as "column", rank::integer as rank, o_totalprice as value from (
  select o_totalprice, row_number() over (order by o_totalprice desc) as rank from orders) where rank <= 5
union all select 'o_custkey', rank::integer, o_custkey::double from (
  select o_custkey, row_number() over (order by o_custkey desc) as rank from orders) where rank <= 5""")
def profile_top_values(spark, sf_dir):
    return p.top_values(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"])


@query("""
select 'o_custkey' as "column", count(distinct o_custkey) as "distinct" from orders
union all select 'o_orderpriority', count(distinct o_orderpriority) from orders
union all select 'o_orderstatus', count(distinct o_orderstatus) from orders""")
def profile_cardinality(spark, sf_dir):
    return p.cardinality(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority", "o_orderstatus"])


@query("""
with v as (select 'lang' as "column", lang as value from documents union all select 'source', source from documents),
g as (select "column", value, count(*) as count from v group by "column", value),
n as (select *, row_number() over (partition by "column" order by count desc, value) as rank from g)
select "column", rank::integer as rank, value, count, round(100.0 * count / (select count(*) from documents), 6) as pct from n where rank <= 3""")
def profile_value_counts(spark, sf_dir):
    return rounded(p.value_counts(table(spark, sf_dir, "documents"), ["lang", "source"]), "pct")


@query(f"""with {RAW_FILMS}, d as (select release_date, try_strptime(release_date, '%Y-%m-%d')::date as day from raw_films)
select 'release_date' as "column", min(day)::varchar as earliest, max(day)::varchar as latest, count(*) filter (day < date '1880-01-01') as before_1880,
  count(*) filter (day > date '2030-01-01') as after_2030, count(*) filter (day is null and release_date is not null) as unparseable from d""")
def profile_dates(spark, sf_dir):
    report = p.date_profile(raw_films(spark, sf_dir), ["release_date"])
    return report.withColumns({c: F.col(c).cast("string") for c in ("earliest", "latest")})


@query(f"""with {RAW_FILMS}, t as (select 'overview' as "column", overview as v from raw_films union all select 'tagline', tagline from raw_films)
select "column", count(v) as present, round(avg(length(v)), 6) as avg_length, min(length(v))::integer as min_length, max(length(v))::integer as max_length,
  count(*) filter (length(v) < 10) as short, count(*) filter (lower(v) = 'n/a') as placeholders from t group by "column" """)
def profile_text_quality(spark, sf_dir):
    return rounded(p.text_quality(raw_films(spark, sf_dir), ["overview", "tagline"]), "avg_length")


@query(f"""with {RAW_FILMS}, t as (
  select 'title' as "column", title as v from raw_films union all select 'original_title', original_title from raw_films
  union all select 'overview', overview from raw_films)
select "column", count(*) filter (starts_with(v, ' ')) as leading, count(*) filter (ends_with(v, ' ')) as trailing,
  count(*) filter (contains(v, '  ')) as double_space, count(*) filter (contains(v, chr(9))) as tab,
  count(*) filter (contains(v, chr(13))) as carriage_return, count(*) filter (contains(v, chr(160))) as nbsp,
  count(*) filter (regexp_matches(v, '\\\\u[0-9a-fA-F]{{4}}')) as unicode_escape from t group by "column" """)
def profile_spaces(spark, sf_dir):
    return p.space_profile(raw_films(spark, sf_dir), ["title", "original_title", "overview"])


@query("""
select 'genres' as "column", count(*) as cells, count(*) filter (not (l_returnflag = 'R' and l_linestatus = 'F')) as parsed,
  count(*) filter (l_returnflag = 'R' and l_linestatus = 'F') as failed, count(*) filter (l_returnflag = 'R' and l_linestatus = 'O') as empty_lists from lineitem""")
def profile_cells(spark, sf_dir):
    return p.cell_quality(cells(spark, sf_dir), ["genres"])


@query("""
select count(*) filter (l_returnflag = 'A') as null_cells, count(*) filter (l_returnflag = 'R' and l_linestatus = 'O') as empty_cells,
  count(*) filter (l_returnflag = 'R' and l_linestatus = 'F') as unreadable_cells, count(*) filter (l_returnflag <> 'N') as without_tags,
  round(100.0 * count(*) filter (l_returnflag <> 'N') / count(*), 6) as pct from lineitem""")
def profile_tag_coverage(spark, sf_dir):
    rows = cells(spark, sf_dir).withColumn("genres", F.when(F.col("l_returnflag") != "A", F.col("genres")))
    return rounded(p.tag_coverage(rows, "genres"), "pct")


@query(f"""with {RAW_FILMS} select 'id' as "column", count(*) filter (try_cast(id as bigint) is null) as non_numeric from raw_films
union all select 'runtime', count(*) filter (runtime is not null and try_cast(runtime as double) is null) from raw_films""")
def profile_shifted(spark, sf_dir):
    return p.shifted_rows(raw_films(spark, sf_dir), ["id", "runtime"])


@query(f"""with {RAW_FILMS} select 'id' as "column", id as cell from raw_films where try_cast(id as bigint) is null order by row_no limit 5""")
def profile_shifted_samples(spark, sf_dir):
    return p.shifted_samples(raw_films(spark, sf_dir), "id", ["row_no"])


@query("select distinct event_type as value from events where event_type not in ('view', 'click')")
def unexpected_values(spark, sf_dir):
    return p.unexpected_values(table(spark, sf_dir, "events"), "event_type", ["view", "click"])


@query("select coalesce(sum(n), 0)::bigint as rows_involved from (select count(*) as n from orders group by o_custkey, o_orderpriority, o_orderstatus) where n > 1")
def semantic_duplicates(spark, sf_dir):
    return p.semantic_duplicates(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority", "o_orderstatus"])


@query("""
select o_custkey, o_orderdate::date::varchar as o_orderdate, o_orderkey from (
  select *, count(*) over (partition by o_custkey, o_orderdate) as n from orders) where n > 1 order by o_orderkey limit 5""")
def semantic_duplicate_samples(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = p.semantic_duplicate_samples(orders, ["o_custkey", "o_orderdate"], ["o_orderkey"])
    return found.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("""
select count(distinct user_id) as users, count(distinct event_type) as items, count(*) as ratings,
  round(count(*) / count(distinct user_id), 6) as avg_per_user from events""")
def rating_coverage(spark, sf_dir):
    return rounded(p.rating_coverage(table(spark, sf_dir, "events"), "user_id", "event_type"), "avg_per_user")


@query("""
with s as (select distinct o_custkey as v from orders where o_orderstatus = 'P'), f as (select distinct c_custkey as v from customer where c_acctbal >= 0)
select (select count(*) from s) as in_small, (select count(*) from f) as in_full, (select count(*) from (select v from s intersect select v from f)) as overlap,
  (select count(*) from (select v from s except select v from f)) as only_small, (select count(*) from (select v from f except select v from s)) as only_full,
  (select count(*) from (select v from s except select v from f)) = 0 as is_subset""")
def compare_sets(spark, sf_dir):
    small = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    full = table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    return p.compare_sets(small, full, "o_custkey", "c_custkey")


@query("""
with q as (select quantile_cont(o_totalprice, [0.5, 0.9, 0.99]) as q from orders),
r as (
  select 'basic' as section, 'table' as subject, 'rows' as metric, count(*)::double as value from orders
  union all select 'basic', 'table', 'columns', 6
  union all select 'duplicates', 'rows', 'duplicates', count(*) - (select count(*) from (select distinct * from orders)) from orders
  union all select 'duplicates', 'o_custkey', 'rows_involved', (select sum(n) from (select count(*) as n from orders group by o_custkey) where n > 1)
  union all select 'numeric', 'o_totalprice', 'min', min(o_totalprice) from orders
  union all select 'numeric', 'o_totalprice', 'max', max(o_totalprice) from orders
  union all select 'numeric', 'o_totalprice', 'mean', avg(o_totalprice) from orders
  union all select 'numeric', 'o_totalprice', 'zeros', 0 union all select 'numeric', 'o_totalprice', 'negatives', 0
  union all select 'numeric', 'o_totalprice', 'non_numeric', 0
  union all select 'numeric', 'o_totalprice', 'p50', q[1] from q union all select 'numeric', 'o_totalprice', 'p90', q[2] from q
  union all select 'numeric', 'o_totalprice', 'p99', q[3] from q
  union all select 'categorical', 'o_orderstatus', 'distinct', count(distinct o_orderstatus) from orders
  union all select 'dates', 'o_orderdate', 'earliest', date_diff('day', date '1970-01-01', min(o_orderdate)::date) from orders
  union all select 'dates', 'o_orderdate', 'latest', date_diff('day', date '1970-01-01', max(o_orderdate)::date) from orders
  union all select 'dates', 'o_orderdate', 'before_1880', 0 union all select 'dates', 'o_orderdate', 'after_2030', 0
  union all select 'dates', 'o_orderdate', 'unparseable', 0
  union all select 'texts', 'o_orderpriority', 'present', count(*) from orders
  union all select 'texts', 'o_orderpriority', 'avg_length', avg(length(o_orderpriority)) from orders
  union all select 'texts', 'o_orderpriority', 'min_length', min(length(o_orderpriority)) from orders
  union all select 'texts', 'o_orderpriority', 'max_length', max(length(o_orderpriority)) from orders
  union all select 'texts', 'o_orderpriority', 'short', count(*) filter (length(o_orderpriority) < 10) from orders
  union all select 'texts', 'o_orderpriority', 'placeholders', 0)
select section, subject, metric, round(value, 6) as value from r""")
def profile_whole_file(spark, sf_dir):
    spec = {
        "keys": ["o_custkey"], "numeric": ["o_totalprice"], "categorical": ["o_orderstatus"], "dates": ["o_orderdate"],
        "texts": ["o_orderpriority"],
    }
    return rounded(p.profile(table(spark, sf_dir, "orders"), spec), "value")


@query("""
with m as (select distinct o_orderkey as id from orders where o_orderstatus <> 'P'), c as (select distinct l_orderkey as id from lineitem where l_returnflag = 'A'),
k as (select distinct l_orderkey as id from lineitem where l_linestatus = 'F')
select 'movies' as measure, count(*) as n from m union all select 'credits', count(*) from c union all select 'keywords', count(*) from k
union all select 'credits_without_movie', count(*) from c where id not in (select id from m)
union all select 'keywords_without_movie', count(*) from k where id not in (select id from m)
union all select 'movies_without_credits', count(*) from m where id not in (select id from c)
union all select 'movies_without_keywords', count(*) from m where id not in (select id from k)""")
def cross_file_integrity(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    movies = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("id"))
    credits = li.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id"))
    keywords = li.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("id"))
    return p.cross_file_report(movies, credits, keywords)
