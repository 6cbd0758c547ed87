"""Catalogue queries: browsing, search, details and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions import display
from marquee.functions.text import register_unaccent, search_form, unaccent
from marquee.operators import dedup, neighbours, quantized
from marquee.operators.arrays import empty_if_null
from marquee.plans import browse, details, search, similar
from marquee.plans.catalogue import Catalogue, genre_arrays, genre_names, summary
from marquee.plans.title_index import TitleIndex
from marquee.session import tuned
from marquee.workloads import SQL, query, table

# ---- orders as movies, return flags of their lines as genres ---------------------------------------------------------


def order_catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    tuned(spark)
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    day = F.col("o_orderdate").cast("date")
    movies = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("original_language"),
        F.when(F.col("o_orderstatus") != "P", day).alias("release_date"), F.format_string("/%d.jpg", "o_orderkey").alias("poster_path"),
        (F.col("o_custkey") / 100).alias("vote_average"), F.when(F.col("o_orderpriority") != "2-HIGH", F.dayofmonth("o_orderdate")).alias("vote_count"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("popularity"),
    )
    flags = li.select(F.ascii("l_returnflag").alias("id"), F.concat(F.lit("Genre "), "l_returnflag").alias("name")).distinct()
    links = li.select(F.col("l_orderkey").alias("movie_id"), F.ascii("l_returnflag").alias("genre_id")).distinct()
    return Catalogue(movies, flags, links)


MOVIES = """
movies as (select o_orderkey as id, o_orderpriority as title, o_orderstatus as original_language,
  case when o_orderstatus <> 'P' then o_orderdate::date end as release_date, '/' || o_orderkey || '.jpg' as poster_path, o_custkey / 100 as vote_average,
  case when o_orderpriority <> '2-HIGH' then day(o_orderdate) end as vote_count, case when o_orderpriority <> '5-LOW' then o_totalprice end as popularity from orders),
genres as (select l_orderkey as movie_id, string_agg('Genre ' || l_returnflag, ',' order by l_returnflag) as genres
  from (select distinct l_orderkey, l_returnflag from lineitem) group by l_orderkey),
cards as (select id, title, year(release_date)::double as year, poster_path, vote_average, vote_count::double as vote_count, popularity,
  coalesce(genres, '') as genres, original_language, release_date from movies left join genres on movie_id = id)"""
CARD = "id, title, year, poster_path, vote_average, vote_count, popularity, genres"


def flat(items: DataFrame) -> DataFrame:
    """Arrays as text and nullable integers as doubles, for comparison."""
    numbers = {c: F.col(c).cast("double") for c in ("year", "vote_count") if c in items.columns}
    return items.withColumns(numbers | {"genres": F.array_join("genres", ",")})


FILTERS = browse.Filters(genres=["Genre A", "Genre R"], year_from=1996, year_to=1999, language="O", min_votes=5)
WHERE = "(genres like '%A%' or genres like '%R%') and year between 1996 and 1999 and original_language = 'O' and vote_count >= 5"


@query(f"with {MOVIES} select {CARD} from cards where {WHERE} order by popularity desc nulls last, id limit 20 offset 20")
def browse_page(spark, sf_dir):
    return flat(browse.listing(order_catalogue(spark, sf_dir), FILTERS, page=2, page_size=20).items)


@query(f"with {MOVIES} select count(*) as total, ceil(count(*) / 20)::bigint as total_pages from cards where {WHERE}")
def browse_totals(spark, sf_dir):
    page = browse.listing(order_catalogue(spark, sf_dir), FILTERS, page=2, page_size=20)
    return spark.createDataFrame([(page.total, page.total_pages)], "total bigint, total_pages bigint")


@query(f"with {MOVIES} select {CARD} from cards where {WHERE}")
def browse_all_matches(spark, sf_dir):
    catalogue = order_catalogue(spark, sf_dir)
    found = summary(browse.matching(catalogue, FILTERS))
    return flat(empty_if_null(found.join(genre_arrays(catalogue), "id", "left"), "genres"))


@query(f"with {MOVIES} select {CARD} from cards where vote_count >= 10 order by vote_average desc nulls last, id limit 50")
def browse_by_rating(spark, sf_dir):
    return flat(browse.listing(order_catalogue(spark, sf_dir), sort="voteAverage", page_size=50).items)


@query(f"with {MOVIES} select {CARD} from cards where year = 1997 order by release_date asc nulls last, id limit 100")
def browse_by_date(spark, sf_dir):
    return flat(browse.listing(order_catalogue(spark, sf_dir), browse.Filters(year=1997), "releaseDate", "asc", 1, 100).items)


@query(f"with {MOVIES} select {CARD} from cards order by vote_count asc nulls last, id limit 100 offset 400")
def browse_by_votes(spark, sf_dir):
    return flat(browse.listing(order_catalogue(spark, sf_dir), sort="voteCount", direction="asc", page=5, page_size=100).items)


def after_sql(value: str, beyond: str) -> str:
    """Two pages after the row at an offset, as one query."""
    return f"with {MOVIES} select {CARD} from cards order by {value} {beyond} nulls last, id limit 100 offset 150"


def second_page(spark: SparkSession, sf_dir: str, sort: str, direction: str) -> DataFrame:
    """The rows that follow the 150th, found by its sort value and id."""
    catalogue = order_catalogue(spark, sf_dir)
    column = browse.SORT_COLUMNS[sort]
    last = catalogue.movies.select("id", column).orderBy(*browse.ordering(sort, direction)).offset(149).limit(1).first()
    return flat(browse.listing_after(catalogue, browse.Filters(min_votes=0) if sort == "voteAverage" else browse.Filters(), sort, direction, (last[column], last["id"]), 100))


@query(after_sql("popularity", "desc"))
def browse_after(spark, sf_dir):
    return second_page(spark, sf_dir, "popularity", "desc")


@query(after_sql("vote_count", "asc"))
def browse_after_ties(spark, sf_dir):
    return second_page(spark, sf_dir, "voteCount", "asc")


@query(f"with {MOVIES} select {CARD} from cards where popularity is null order by id limit 40 offset 10")
def browse_after_nulls(spark, sf_dir):
    catalogue = order_catalogue(spark, sf_dir)
    last = catalogue.movies.filter("popularity is null").orderBy("id").offset(9).limit(1).first()
    return flat(browse.listing_after(catalogue, after=(None, last["id"]), page_size=40))


@query("select distinct 'Genre ' || l_returnflag as name from lineitem")
def genre_list(spark, sf_dir):
    return genre_names(order_catalogue(spark, sf_dir))


@query(f"""with {MOVIES}
select id, 'https://image.tmdb.org/t/p/w300' || poster_path as image, case when coalesce(vote_count, 0) > 0 then trunc(vote_average * 10) / 10.0 end as rating,
  array_to_string(list_slice(list_filter(string_split(genres, ','), lambda g: g <> ''), 1, 3), ', ') as tags, strftime(release_date, '%Y-%m-%d') as released,
  concat_ws(' · ', year::integer, case when coalesce(vote_count, 0) > 0 then '★ ' || (trunc(vote_average * 10) / 10.0)::varchar end,
    case when genres <> '' then array_to_string(list_slice(string_split(genres, ','), 1, 2), ', ') end) as line from cards""")
def card_projection(spark, sf_dir):
    catalogue = order_catalogue(spark, sf_dir)
    cards = empty_if_null(
        summary(catalogue.movies).join(catalogue.movies.select("id", "release_date"), "id").join(genre_arrays(catalogue), "id", "left"), "genres"
    )
    return cards.select(
        "id", display.image_url(F.col("poster_path")).alias("image"), display.shown_rating(F.col("vote_average"), F.col("vote_count")).alias("rating"),
        F.array_join(display.first_names(F.col("genres"), 3), ", ").alias("tags"), display.iso_text(F.col("release_date")).alias("released"),
        display.card_line(F.col("year"), F.col("vote_average"), F.col("vote_count"), F.col("genres")).alias("line"),
    )


# ---- part names as titles --------------------------------------------------------------------------------------------


def part_catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    p, o = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    name = F.when(F.col("p_type") == "PROMO", F.initcap(F.translate("p_name", "eo", "éÖ"))).when(
        F.col("p_type") == "SMALL", F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    ).when(F.col("p_type") == "LARGE", F.substring_index("p_name", " ", 1)).otherwise(F.col("p_name"))
    movies = p.select(
        F.col("p_partkey").alias("id"), name.alias("title"), F.when(F.col("p_type") != "ECONOMY", F.col("p_name")).alias("original_title"),
        F.lit(None).cast("date").alias("release_date"), F.lit(None).cast("string").alias("poster_path"), F.lit(None).cast("double").alias("vote_average"),
        F.lit(None).cast("int").alias("vote_count"), F.when(F.col("p_brand") != "Brand#1", F.col("p_retailprice")).alias("popularity"),
    )
    flags = o.select(F.ascii("l_returnflag").alias("id"), F.col("l_returnflag").alias("name")).distinct()
    links = o.select(F.col("l_partkey").alias("movie_id"), F.ascii("l_returnflag").alias("genre_id")).distinct()
    return Catalogue(movies, flags, links)


TITLES = """
titles as (select p_partkey as id,
  case p_type when 'PROMO' then upper(substr(split_part(translate(p_name, 'eo', 'éÖ'), ' ', 1), 1, 1)) || lower(substr(split_part(translate(p_name, 'eo', 'éÖ'), ' ', 1), 2))
      || ' ' || upper(substr(split_part(translate(p_name, 'eo', 'éÖ'), ' ', 2), 1, 1)) || lower(substr(split_part(translate(p_name, 'eo', 'éÖ'), ' ', 2), 2))
    when 'SMALL' then replace(p_name, ' ', '-') when 'LARGE' then split_part(p_name, ' ', 1) else p_name end as title,
  case when p_type <> 'ECONOMY' then p_name end as original_title, case when p_brand <> 'Brand#1' then p_retailprice end as popularity from part),
forms as (select *, replace(lower(strip_accents(title)), '-', ' ') as tf, replace(lower(strip_accents(original_title)), '-', ' ') as rf from titles)"""


def scored(query: str) -> str:
    return f"""hits as (select id, title, popularity, case when tf = '{query}' then 100 when tf like '{query}%' then 50 when tf like '%{query}%' then 10
      when rf like '%{query}%' then 5 else 0 end as relevance_score from forms where tf like '%{query}%' or rf like '%{query}%')"""


@query(f"with {TITLES}, {scored('red')} select id, title, relevance_score from hits")
def search_hits(spark, sf_dir):
    return search.hits(part_catalogue(spark, sf_dir).movies, "Réd").select("id", "title", "relevance_score")


@query(f"with {TITLES}, {scored('red bolt')} select id, title, relevance_score from hits")
def search_hits_hyphen(spark, sf_dir):
    return search.hits(part_catalogue(spark, sf_dir).movies, "red-BOLT").select("id", "title", "relevance_score")


@query(f"with {TITLES}, {scored('r_d%t')} select id, title, relevance_score from hits")
def search_hits_wildcards(spark, sf_dir):
    return search.hits(part_catalogue(spark, sf_dir).movies, "r_d%t").select("id", "title", "relevance_score")


@query(f"""with {TITLES}, {scored('wid')}, g as (select l_partkey, string_agg(l_returnflag, ',' order by l_returnflag) as genres
  from (select distinct l_partkey, l_returnflag from lineitem) group by l_partkey)
select id, title, popularity, coalesce(genres, '') as genres from (select * from hits order by relevance_score desc, popularity desc nulls last, id limit 20 offset 20)
left join g on l_partkey = id""")
def title_search(spark, sf_dir):
    return flat(search.search(part_catalogue(spark, sf_dir), " wid ", page=2).items).select("id", "title", "popularity", "genres")


@query(f"with {TITLES}, {scored('r_d%bo')} select id, title, relevance_score from hits")
def search_hits_indexed(spark, sf_dir):
    return TitleIndex.build(part_catalogue(spark, sf_dir).movies).hits("r_d%bo").select("id", "title", "relevance_score")


@query(SQL["title_search"])
def title_search_indexed(spark, sf_dir):
    catalogue = part_catalogue(spark, sf_dir)
    found = search.search(catalogue, " wid ", page=2, index=TitleIndex.build(catalogue.movies))
    return flat(found.items).select("id", "title", "popularity", "genres")


@query(f"with {TITLES}, {scored('sm')} select id, title from hits order by relevance_score desc, popularity desc nulls last, id limit 8")
def suggestions(spark, sf_dir):
    return search.suggest(part_catalogue(spark, sf_dir), "sm").select("id", "title")


@query(f"""with {TITLES}, w as (select distinct split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b from part),
q as (select a as query_id, a as query from w union select a || '+' || b, a || '-' || upper(b) from w union select a || '%' || b, substr(a, 1, 1) || '%' || b from w
  union select '_' || a, '_' || substr(a, 2, 1) from w union select 'pad ' || a, chr(9) || a || '  ' from w
  union select 'short ' || a, ' ' || substr(a, 1, 1) from w union select 'long ' || a, repeat(a, 101) from w),
n as (select query_id, replace(lower(trim(query, ' ' || chr(9))), '-', ' ') as n from q where query_id not like 'short %' and query_id not like 'long %'),
h as (select query_id, id, title, popularity, case when tf = n then 100 when tf like n || '%' then 50 when tf like '%' || n || '%' then 10 else 5 end as relevance_score
  from n, forms where tf like '%' || n || '%' or rf like '%' || n || '%'),
r as (select *, row_number() over (partition by query_id order by relevance_score desc, popularity desc nulls last, id) as rank from h)
select query_id, rank::integer as rank, id, title, relevance_score from r where rank <= 8""")
def search_many(spark, sf_dir):
    return many_searches(spark, sf_dir).filter("error is null").drop("error")


@query("""with w as (select distinct split_part(p_name, ' ', 1) as a from part)
select 'short ' || a as query_id, 'invalid_search_query' as error from w union all select 'long ' || a, 'invalid_search_query' from w""")
def search_many_refused(spark, sf_dir):
    return many_searches(spark, sf_dir).filter("error is not null").select("query_id", "error")


def many_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches for words of the titles, among them padded queries and ones that are too short or too long."""
    words = table(spark, sf_dir, "part").select(
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b")
    ).distinct()
    kinds = [
        (F.col("a"), F.col("a")), (F.concat("a", F.lit("+"), "b"), F.concat("a", F.lit("-"), F.upper("b"))),
        (F.concat("a", F.lit("%"), "b"), F.concat(F.substring("a", 1, 1), F.lit("%"), "b")),
        (F.concat(F.lit("_"), "a"), F.concat(F.lit("_"), F.substring("a", 2, 1))), (F.concat(F.lit("pad "), "a"), F.concat(F.lit("\t"), "a", F.lit("  "))),
        (F.concat(F.lit("short "), "a"), F.concat(F.lit(" "), F.substring("a", 1, 1))), (F.concat(F.lit("long "), "a"), F.repeat("a", F.lit(101))),
    ]
    queries = words.select(F.inline(F.array(*[F.struct(i.alias("query_id"), q.alias("query")) for i, q in kinds]))).distinct()
    found = search.search_many(part_catalogue(spark, sf_dir).movies, queries)
    return found.select("query_id", "rank", "id", "title", "relevance_score", "error")


@query("select doc_id, md5(replace(lower(replace(strip_accents(text), 'ß', 'ss')), '-', ' ')) as form_md5 from documents")
def search_form_of_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.md5(search_form(F.col("text"))).alias("form_md5"))


@query("select conv_id, turn, md5(replace(strip_accents(text), 'ß', 'ss')) as plain_md5 from conversations")
def unaccent_in_sql(spark, sf_dir):
    register_unaccent(spark, "unaccent_text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("md5(unaccent_text(text))").alias("plain_md5"))


@query("select conv_id, turn, md5(replace(strip_accents(text), 'ß', 'ss')) as plain_md5 from conversations")
def unaccent_texts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(unaccent(F.col("text"))).alias("plain_md5"))


# ---- embeddings -------------------------------------------------------------------------------------------------------


def vector_catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    e = table(spark, sf_dir, "embeddings")
    label = F.col("label")
    movies = e.select(
        F.col("vec_id").alias("id"), F.concat(F.lit("Item "), "vec_id").alias("title"), F.lit(None).cast("date").alias("release_date"),
        F.lit(None).cast("string").alias("poster_path"), F.lit(None).cast("double").alias("vote_average"), (label * 20).alias("vote_count"),
        label.cast("double").alias("popularity"),
    )
    names = e.select(label.alias("id"), F.concat(F.lit("Label "), "label").alias("name")).distinct()
    links = e.select(F.col("vec_id").alias("movie_id"), label.alias("genre_id"))
    return Catalogue(movies, names, links, e.select(F.col("vec_id").alias("movie_id"), "embedding"))


def nearest_sql(where: str = "true") -> str:
    return f"""
with v as (select vec_id, label, embedding::double[] as e from embeddings),
s as (select v.vec_id as id, v.label, round(list_cosine_similarity(v.e, r.e), 12) as similarity from v, (select e from v where vec_id = 7) r where v.vec_id <> 7 and {where})
select id, 'Item ' || id as title, 'Label ' || label as genres, round(similarity, 6) as similarity from s order by s.similarity desc, id limit 10"""


def shown(items: DataFrame) -> DataFrame:
    return flat(items).select("id", "title", "genres", F.round("similarity", 6).alias("similarity"))


@query(nearest_sql())
def similar_topk(spark, sf_dir):
    return shown(similar.similar(vector_catalogue(spark, sf_dir), 7))


@query(nearest_sql("v.label * 20 >= 50"))
def similar_popular(spark, sf_dir):
    return shown(similar.similar_popular(vector_catalogue(spark, sf_dir), 7))


@query(nearest_sql())
def similar_indexed(spark, sf_dir):
    catalogue = vector_catalogue(spark, sf_dir)
    index = neighbours.shared_index(catalogue.embeddings.withColumnRenamed("movie_id", "id"), cells=16)
    return shown(similar.similar(catalogue, 7, index=index))


@query("""
with v as (select vec_id, embedding::double[] as e from embeddings),
s as (select a.vec_id as id, b.vec_id as neighbour, round(list_cosine_similarity(a.e, b.e), 12) as similarity from v a, v b where a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by id order by similarity desc, neighbour) as rank from s)
select id, rank::integer as rank, neighbour, round(similarity, 6) as similarity from r where rank <= 10""")
def similar_for_all(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    ranked = neighbours.nearest_for_all(vectors, 10, tile_rows=64)
    return ranked.withColumn("similarity", F.round("similarity", 6))


@query("select count(*) as queries, true as recall_reached from embeddings where vec_id % 10 = 0")
def similar_approximate(spark, sf_dir):
    """Recall of the cell index for a tenth of the vectors against the exact neighbours of all."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = neighbours.shared_index(vectors, cells=16)
    asked = vectors.filter("id % 10 = 0")
    near = neighbours.approximate_for_many(index, asked, 10, probes=13).select("id", "neighbour", F.lit(1).alias("found"))
    exact = neighbours.nearest_for_all(vectors, 10, tile_rows=512, asked=asked).select("id", "neighbour")
    per_query = exact.join(near, ["id", "neighbour"], "left").groupBy("id").agg((F.count("found") / F.count("*")).alias("recall"))
    return per_query.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("recall_reached"))


@query()
def similar_quantized(spark, sf_dir):
    """A tenth of the vectors against all rows through product-quantised codes: exact similarities of what was found."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = quantized.QuantizedIndex.build(vectors)
    return index.search_many(vectors.filter("id % 10 = 0"), 10).withColumn("similarity", F.round("similarity", 6))


@query()
def similar_quantized_recall(spark, sf_dir):
    """The measured recall of the quantised codes against exact neighbours, and the share of the vectors' bytes that a query reads."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = quantized.QuantizedIndex.build(vectors)
    asked = vectors.filter("id % 10 = 0")
    exact = neighbours.nearest_for_all(vectors, 10, tile_rows=8192, asked=asked)
    measured = quantized.recall(index.search_many(asked, 10), exact)
    return measured.withColumn("bytes_share", F.lit(index.bytes_read()))


@query("""
with v as (select vec_id, embedding::double[] as e from embeddings)
select v.vec_id as id, round(list_cosine_similarity(v.e, r.e), 6) as similarity from v, (select e from v where vec_id = 11) r where v.vec_id <> 11""")
def similarity_scores(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    scores = neighbours.nearest(vectors, neighbours.reference_vector(vectors, 11), 11)
    return scores.withColumn("similarity", F.round("similarity", 6))


# ---- the wide details row -----------------------------------------------------------------------------------------------


def order_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Orders with customers as collections and their lines as every kind of relation."""
    tuned(spark)
    o, li, s = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    p, n, cu = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    text, movie = F.lit(None).cast("string"), F.col("l_orderkey").alias("movie_id")
    empty = {c: text for c in ("original_title", "overview", "tagline", "poster_path", "imdb_id")}
    movies = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.lower("o_orderstatus").alias("original_language"),
        F.col("o_orderdate").cast("date").alias("release_date"), F.lit(90).alias("runtime"), F.col("o_orderstatus").alias("status"),
        F.col("o_custkey").alias("budget"), F.col("o_custkey").alias("revenue"), F.col("o_totalprice").alias("popularity"),
        F.lit(5.0).alias("vote_average"), F.lit(7).alias("vote_count"), F.lit(False).alias("adult"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("collection_id"),
    ).withColumns(empty)
    flags = li.select(F.ascii("l_returnflag").alias("id"), F.col("l_returnflag").alias("name")).distinct()
    states = li.select(F.lower("l_linestatus").alias("iso_639_1"), F.concat(F.lit("Lang "), "l_linestatus").alias("name")).distinct()
    cast = li.filter("l_returnflag <> 'R'").select(
        movie, F.col("l_suppkey").alias("person_id"), F.col("l_linenumber").alias("cast_order"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Role "), "l_partkey")).alias("character_name"), "l_partkey",
    )
    crew = li.select(
        movie, F.col("l_suppkey").alias("person_id"), F.col("l_linestatus").alias("job"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("department"), "l_linenumber", "l_partkey",
    )
    return {
        "movies": movies, "collections": cu.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("poster_path")),
        "external_ids": o.filter("o_orderstatus = 'F'").select(
            F.col("o_orderkey").alias("movie_id"), F.col("o_custkey").alias("movielens_id"), F.format_string("tt%07d", "o_custkey").alias("imdb_id_full")
        ),
        "genres": flags, "movie_genres": li.select(movie, F.ascii("l_returnflag").alias("genre_id")).distinct(),
        "production_countries": n.select(F.col("n_nationkey").cast("string").alias("iso_3166_1"), F.col("n_name").alias("name")),
        "movie_production_countries": li.join(s, li.l_suppkey == s.s_suppkey).select(movie, F.col("s_nationkey").cast("string").alias("country_iso")).distinct(),
        "spoken_languages": states, "movie_spoken_languages": li.select(movie, F.lower("l_linestatus").alias("language_iso")).distinct(),
        "production_companies": s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        "movie_production_companies": li.select(movie, F.col("l_suppkey").alias("company_id")).distinct(),
        "keywords": p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")),
        "movie_keywords": li.select(movie, F.col("l_partkey").alias("keyword_id")).distinct(),
        "people": s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        "movie_cast": dedup.first_by_key(cast, ["movie_id", "person_id", "cast_order"], ["l_partkey"]).drop("l_partkey"),
        "movie_crew": dedup.first_by_key(crew, ["movie_id", "person_id", "job"], ["l_linenumber", "l_partkey"]).drop("l_linenumber", "l_partkey"),
    }


def link_sql(alias: str, columns: str, name: str, source: str) -> str:
    return f"""{alias} as (select m, string_agg(n, '|' order by n) as {alias} from (select {name} as n, m from (select distinct l_orderkey as m, {columns} from {source})) group by m)"""


DETAILS = ", ".join([
    link_sql("genres", "l_returnflag as k", "k", "lineitem"),
    link_sql("production_countries", "n_name as k", "k", "lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey"),
    link_sql("spoken_languages", "l_linestatus as k", "'Lang ' || k", "lineitem"),
    link_sql("production_companies", "s_suppkey as k, s_name as x", "x", "lineitem join supplier on s_suppkey = l_suppkey"),
    link_sql("keywords", "p_partkey as k, p_name as x", "x", "lineitem join part on p_partkey = l_partkey"),
    """casting as (select l_orderkey as m, string_agg(l_linenumber || ':' || l_suppkey || ':' || s_name || ':' || coalesce(role, '-'), '|' order by l_linenumber, l_suppkey) as "cast"
      from (select *, case when l_returnflag = 'A' then 'Role ' || l_partkey end as role, row_number() over (partition by l_orderkey, l_suppkey, l_linenumber order by l_partkey) as pick
        from lineitem where l_returnflag <> 'R') join supplier on s_suppkey = l_suppkey where pick = 1 group by l_orderkey)""",
    """crewing as (select l_orderkey as m, string_agg(coalesce(dep, '-') || ':' || l_linestatus || ':' || l_suppkey || ':' || s_name, '|' order by dep nulls last, l_linestatus, l_suppkey) as crew
      from (select *, case when l_returnflag <> 'N' then l_returnflag end as dep, row_number() over (partition by l_orderkey, l_suppkey, l_linestatus order by l_linenumber, l_partkey) as pick
        from lineitem) join supplier on s_suppkey = l_suppkey where pick = 1 group by l_orderkey)""",
])
NAMES = ("genres", "production_countries", "spoken_languages", "production_companies", "keywords")


def details_sql(where: str = "true") -> str:
    lists = ", ".join(f"coalesce({n}, '') as {n}" for n in NAMES)
    joins = " ".join(f"left join {n} on {n}.m = o_orderkey" for n in (*NAMES, "casting", "crewing"))
    return f"""with {DETAILS}
select o_orderkey as id, o_orderpriority as title, o_totalprice as popularity, case when o_orderstatus <> 'P' then c_name end as collection,
  case when o_orderstatus = 'F' then 'tt' || lpad(o_custkey::varchar, 7, '0') end as imdb_numeric, {lists}, coalesce("cast", '') as "cast", coalesce(crew, '') as crew
from orders left join customer on c_custkey = o_custkey {joins} where {where}"""


def details_flat(wide: DataFrame) -> DataFrame:
    dash = lambda c: F.coalesce(c, F.lit("-"))
    member = F.transform("cast", lambda s: F.concat_ws(":", s["order"], s["person_id"], s["name"], dash(s["character"])))
    worker = F.transform("crew", lambda s: F.concat_ws(":", dash(s["department"]), s["job"], s["person_id"], s["name"]))
    return wide.select(
        "id", "title", "popularity", F.col("collection.name").alias("collection"), "cross_references.imdb_numeric",
        *[F.array_join(n, "|").alias(n) for n in NAMES], F.array_join(member, "|").alias("cast"), F.array_join(worker, "|").alias("crew"),
    )


@query(details_sql())
def details_wide(spark, sf_dir):
    return details_flat(details.details(order_tables(spark, sf_dir)))


CAST_JSON = """
select o_orderkey as id, '[' || coalesce(items, '') || ']' as "cast" from orders left join (
  select l_orderkey as m, string_agg('{"personId":' || l_suppkey || ',"name":"' || s_name || '","character":' || coalesce('"' || role || '"', 'null') || ',"order":' || l_linenumber || '}',
    ',' order by l_linenumber, l_suppkey) as items
  from (select *, case when l_returnflag = 'A' then 'Role ' || l_partkey end as role, row_number() over (partition by l_orderkey, l_suppkey, l_linenumber order by l_partkey) as pick
    from lineitem where l_returnflag <> 'R') join supplier on s_suppkey = l_suppkey where pick = 1 group by l_orderkey) on m = o_orderkey"""


@query(CAST_JSON)
def details_json(spark, sf_dir):
    return details.cast_json(details.details(order_tables(spark, sf_dir))).select("id", "cast")


@query(details_sql("o_orderkey = 42"))
def details_of_one(spark, sf_dir):
    return details_flat(details.find_by_id(order_tables(spark, sf_dir), 42))
