"""Source texts, staleness and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.plans import embed
from marquee.session import tuned
from marquee.workloads import query, table


def order_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a text of their own, return flags as genres and part names as keywords.

    The stored hashes are those of texts without genres and keywords, so they are current only for
    orders without lines.
    """
    tuned(spark)
    o, li, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    story = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of customer "), F.col("o_custkey").cast("string"), F.lit(" is told at length"))
    overview = F.when(F.col("o_orderstatus") == "F", "Too short").otherwise(story)
    movies = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), overview.alias("overview"), F.col("o_totalprice").alias("popularity"))
    genres = li.select(F.ascii("l_returnflag").alias("id"), F.col("l_returnflag").alias("name")).distinct()
    movie_genres = li.select(F.col("l_orderkey").alias("movie_id"), F.ascii("l_returnflag").alias("genre_id")).distinct()
    keywords = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    movie_keywords = li.select(F.col("l_orderkey").alias("movie_id"), F.col("l_partkey").alias("keyword_id")).distinct()
    stored = movies.filter("title <> '5-LOW'").select(F.col("id").alias("movie_id"), F.sha2(F.concat_ws(". ", "title", "overview"), 256).alias("source_text_hash"))
    return embed.candidates(movies, genres, movie_genres, keywords, movie_keywords, stored)


CANDIDATES = """
g as (select m, string_agg(n, ', ' order by n) as genres from (select distinct l_orderkey as m, l_returnflag as n from lineitem) group by m),
k as (select m, string_agg(n, ', ' order by n) as keywords from (select m, p_name as n from (select distinct l_orderkey as m, l_partkey from lineitem) join part on p_partkey = l_partkey) group by m),
c as (select o_orderkey as id, o_orderpriority as title, 'Order ' || o_orderkey || ' of customer ' || o_custkey || ' is told at length' as overview, genres, keywords
  from orders left join g on g.m = o_orderkey left join k on k.m = o_orderkey where o_orderstatus <> 'F'),
h as (select *, concat_ws('. ', title, 'Genres: ' || genres, 'Keywords: ' || keywords, overview) as text,
  case when title <> '5-LOW' then sha256(title || '. ' || overview) end as stored_hash from c)"""


@query(f"with {CANDIDATES} select id, title, overview, coalesce(genres, '') as genres, coalesce(keywords, '') as keywords, stored_hash from h")
def embedding_candidates(spark, sf_dir):
    rows = order_candidates(spark, sf_dir)
    return rows.withColumns({n: F.array_join(n, ", ") for n in ("genres", "keywords")})


@query(f"with {CANDIDATES} select id, text, sha256(text) as source_text_hash from h")
def source_texts(spark, sf_dir):
    return embed.with_hash(order_candidates(spark, sf_dir)).select("id", "text", "source_text_hash")


@query(f"with {CANDIDATES} select id from h where stored_hash is null or stored_hash <> sha256(text)")
def stale_candidates(spark, sf_dir):
    return embed.stale(embed.with_hash(order_candidates(spark, sf_dir))).select("id")


@query(f"""with {CANDIDATES} select count(*) filter (coalesce(stored_hash = sha256(text), false)) as skipped,
  count(*) filter (not coalesce(stored_hash = sha256(text), false)) as to_generate from h""")
def stale_counts(spark, sf_dir):
    return embed.stale_counts(embed.with_hash(order_candidates(spark, sf_dir)))


DIM = 64
HASHED = """
w as (select id, ('0x' || substr(md5(word), 1, 8))::bigint as code from (select id, unnest(string_split(lower(text), ' ')) as word from t) where word <> ''),
b as (select id, (code >> 1) % 64 as slot, sum(1 - 2 * (code & 1))::double as v from w group by all),
n as (select id, slot, v / sqrt(sum(v * v) over (partition by id)) as value from b),
vectors as (select id, slot, round(value::float::double, 6) as value from n where value <> 0)"""


def long_form(vectors: DataFrame) -> DataFrame:
    cells = vectors.select(F.col("movie_id").alias("id"), F.posexplode("embedding").alias("slot", "value"))
    return cells.filter("value <> 0").select("id", F.col("slot").cast("bigint").alias("slot"), F.round(F.col("value").cast("double"), 6).alias("value"))


def small_encoder() -> embed.HashEncoder:
    return embed.HashEncoder(DIM)


HOW = {"make_encoder": small_encoder, "model": "hash-64", "dim": DIM}


@query(f"with t as (select doc_id as id, text from documents), {HASHED} select * from vectors")
def encode_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    docs = docs.withColumn("source_text_hash", F.sha2("text", 256))
    return long_form(embed.encode(docs, **HOW))


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors as a stored table that knows the present text of short documents only."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    known = d.filter("n_chars < 1000").select(F.col("doc_id").alias("vec_id"), F.sha2(F.concat_ws(". ", "source", F.trim("text")), 256).alias("known"))
    rows = e.join(known, "vec_id", "left")
    return rows.select(
        F.col("vec_id").alias("movie_id"), "embedding", F.lit("given").alias("model_name"), F.coalesce("known", F.lit("old")).alias("source_text_hash"),
        F.lit("2020-01-01").cast("timestamp").alias("generated_at"),
    )


def document_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents"), stored_vectors(spark, sf_dir)
    stored = e.select(F.col("movie_id").alias("id"), F.col("source_text_hash").alias("stored_hash"))
    names = F.array().cast("array<string>")
    rows = d.filter(F.length("text") >= embed.SHORTEST_OVERVIEW).select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"), F.trim("text").alias("overview"), names.alias("genres"), names.alias("keywords")
    )
    return rows.join(stored, "id", "left")


@query("""
with d as (select doc_id, length(text) >= 30 as fits, n_chars < 1000 as known, vec_id from documents left join embeddings on vec_id = doc_id)
select coalesce(vec_id, doc_id) as movie_id, case when vec_id is not null and (not coalesce(fits, false) or known) then 'given' else 'hash-64' end as model_name
from (select * from d union all select null, null, null, vec_id from embeddings where vec_id not in (select doc_id from documents))
where vec_id is not null or fits""")
def embedding_refresh(spark, sf_dir):
    table_after = embed.refresh(stored_vectors(spark, sf_dir), document_candidates(spark, sf_dir), **HOW)
    return table_after.select("movie_id", "model_name")


@query(f"""
with t as (select doc_id as id, concat_ws('. ', source, trim(text, ' ')) as text from documents where length(text) >= 30
  and not (n_chars < 1000 and doc_id in (select vec_id from embeddings))), {HASHED}
select * from vectors""")
def embedding_refresh_vectors(spark, sf_dir):
    """The vectors that a refresh made."""
    after = embed.refresh(stored_vectors(spark, sf_dir), document_candidates(spark, sf_dir), **HOW)
    return long_form(after.filter("model_name = 'hash-64'"))


@query("""
select doc_id as movie_id, sha256(concat_ws('. ', source, trim(text, ' '))) as source_text_hash, true as stamped from documents where length(text) >= 30
  and not (n_chars < 1000 and doc_id in (select vec_id from embeddings))""")
def embedding_refresh_stamps(spark, sf_dir):
    """Hash and stamp of what a refresh made: stamps are newer than the stored ones."""
    after = embed.refresh(stored_vectors(spark, sf_dir), document_candidates(spark, sf_dir), **HOW).filter("model_name = 'hash-64'")
    return after.select("movie_id", "source_text_hash", (F.col("generated_at") > F.lit("2020-01-01").cast("timestamp")).alias("stamped"))


@query("select vec_id as movie_id from embeddings where vec_id % 7 = 0")
def embedding_misfits(spark, sf_dir):
    """The vectors of a wrong width, in a table of two widths."""
    rows = stored_vectors(spark, sf_dir)
    short = F.when(F.col("movie_id") % 7 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return embed.wrong_dimension(rows.withColumn("embedding", short), 64).select("movie_id")


@query("select vec_id as movie_id from embeddings")
def embedding_migration_same_size(spark, sf_dir):
    return embed.migrate(stored_vectors(spark, sf_dir), 64).select("movie_id")


@query("select vec_id as movie_id from embeddings where len(embedding) <> 64 and false")
def embedding_migration_new_size(spark, sf_dir):
    return embed.migrate(stored_vectors(spark, sf_dir), 128).select("movie_id")
