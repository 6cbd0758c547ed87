import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee import schemas, workloads
from marquee.operators import integrity, merge, profile, quantiles
from marquee.plans import embed, load, prepare
from marquee.session import fresh_path, shared_folder
from marquee.sources import raw_files
from marquee.sources.tables import TableStore, conform
from marquee.workloads import embeddings

MOVIES_CSV = '''id,imdb_id,title,original_title,original_language,overview,tagline,release_date,runtime,budget,revenue,popularity,vote_average,vote_count,status,adult,genres,production_companies,production_countries,spoken_languages,belongs_to_collection,poster_path,video
1,tt0000001,"A ""quoted"" title",Orig,en,"A long text
over two lines, with a comma and more",,1999-10-15,90,5000,0,7.25,7.25,12,Released,False,"[{'id': 18, 'name': 'Drama'}, {'id': 28, 'name': 'Action'}]","[{'name': 'Fox', 'id': 5}]","[{'iso_3166_1': 'US', 'name': 'America'}]","[{'iso_639_1': 'en', 'name': 'English'}]","{'id': 9, 'name': 'Saga', 'poster_path': '/s.jpg', 'backdrop_path': None}",/p.jpg,False
1997-08-20,,shifted,,,,,,,,,,,,,,,,,,,,
2,tt0000002,None,Only original,fr,N/A,,1/2/1999,0,0,10,0,5.0,0,,False,[],,,,,,False
3,tt0000002,Same key,x,fr,text,,2001-1-2,400,999,0,1.0,5.0,3,Released,False,"[{'id': 18, 'name': 'Other name'}]",,,,,,False
4,,No key,,de,  No   overview ,,,,,,,,,Released,True,,,,,,,False
5,,No key two,,de,tidy   text,,,,,,,,,Released,,,,,,,,False
6,,No key three,,de,x,,,,,,,,,,False,,,,,,,False
'''
CREDITS_CSV = '''cast,crew,id
"[{'id': 1, 'name': 'Ann', 'order': 0, 'character': 'She', 'gender': 1, 'profile_path': None}]","[{'id': 2, 'name': ""O'Neil"", 'job': 'Director', 'department': 'Directing', 'gender': 2, 'profile_path': None}]",1
"[{'id': 1, 'name': 'Ann', 'order': 0, 'character': 'She', 'gender': 1, 'profile_path': None}]","[{'id': 2, 'name': ""O'Neil"", 'job': 'Director', 'department': 'Directing', 'gender': 2, 'profile_path': None}]",1
[],[],77
'''
KEYWORDS_CSV = '''id,keywords
1,"[{'id': 100, 'name': 'rain'}]"
77,"[{'id': 101, 'name': 'sun'}]"
'''
LINKS_CSV = '''movieId,imdbId,tmdbId
10,114709,1
11,0000002,
12,12345678,2
13,5,1
14,6,999
'''
ORDER = [raw_files.ROW]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, text in {"movies_metadata": MOVIES_CSV, "credits": CREDITS_CSV, "keywords": KEYWORDS_CSV, "links": LINKS_CSV}.items():
        (folder / f"{name}.csv").write_text(text)
    return {n: raw_files.read_raw(spark, str(folder), n) for n in ("movies_metadata", "credits", "keywords", "links")}


def test_raw_reader(raw):
    rows = raw["movies_metadata"].orderBy(*ORDER).collect()
    assert [r["id"] for r in rows] == ["1", "1997-08-20", "2", "3", "4", "5", "6"]
    assert rows[0]["title"] == 'A "quoted" title' and rows[0]["overview"].count("\n") == 1
    assert rows[2]["title"] is None and rows[2]["overview"] is None and "homepage" not in rows[0]
    total, head = raw_files.probe(raw["movies_metadata"], 2)
    assert total == 7 and head.count() == 2


def test_cells_kept_as_they_stand(spark, tmp_path):
    """Without spellings of missing values two quotes are an empty text, nothing is null, and U+0000 stays."""
    (tmp_path / "odd.csv").write_text('a,b\n"","NA"\n,NA\nx\0,"\0""\0\n\0"\n', newline="")
    read = lambda **more: [tuple(r) for r in raw_files.read_csv(spark, str(tmp_path / "odd.csv"), ["a", "b"], multiline=True, **more).select("a", "b").collect()]
    kept = ("x\0", '\0"\0\n\0')
    assert read() == [(None, None), (None, None), kept]
    assert read(missing=False) == [("", "NA"), (None, "NA"), kept]
    assert read(missing=["b"]) == [("", None), (None, None), kept]


def test_scan_csv_odd_documents(spark, tmp_path):
    """Texts, languages and sources that are empty or spelt like missing values come out as the SQL has them."""
    odd = [*raw_files.MISSING, None, "none", "de", "es", "en", "=", "==", "=NA", " NA", "\r", "\n", '"', '"\0"', "\n\0", 'a\0""\0,b', "\\"]
    rows = [(i, t, odd[(i + 7) % len(odd)], odd[(i + 11) % len(odd)]) for i, t in enumerate(odd * 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    workloads.load_all()
    for name in ("scan_csv", "scan_csv_in_file_order", "scan_csv_one_column"):
        frame = workloads.QUERIES[name](spark, str(tmp_path))
        assert {tuple(r) for r in frame.collect()} == set(con.execute(f"select {', '.join(frame.columns)} from ({workloads.SQL[name]})").fetchall()), name


def test_end_to_end(spark, raw):
    movies = prepare.clean_movies(raw["movies_metadata"], ORDER).cache()
    rows = {r["id"]: r for r in movies.collect()}
    assert sorted(rows) == [1, 2, 5]  # 3 repeats an imdb id, 4 is adult, of 5 and 6 without id the first stays
    assert rows[2]["budget"] is None and rows[2]["vote_average"] is None and rows[2]["release_date"] is None and rows[2]["status"] == "Unknown"
    assert rows[5]["overview"] == "tidy text" and str(rows[1]["release_date"]) == "1999-10-15" and rows[1]["revenue"] is None
    audit = {r["label"]: r["affected"] for r in prepare.movies_audit(raw["movies_metadata"]).collect()}
    assert audit["drop_shifted[id]"] == 1 and audit["drop_adult"] == 1 and audit["null_long_runtime[runtime]"] == 1
    store = TableStore(spark, fresh_path(spark, "catalogue"))
    counts = load.load_catalogue(
        store, movies, prepare.clean_credits(raw["credits"], ORDER), prepare.clean_keywords(raw["keywords"], ORDER),
        prepare.clean_links(raw["links"], ORDER), ORDER,
    )
    assert counts["movies"] == 3 and counts["collections"] == 1 and counts["genres"] == 2 and counts["movie_genres"] == 2
    assert counts["people"] == 2 and counts["movie_cast"] == 1 and counts["keywords"] == 2 and counts["movie_keywords"] == 1
    assert counts["external_ids"] == 2
    stored = {r["id"]: r for r in store.read("movies").collect()}
    assert stored[2]["title"] == "Only original" and stored[1]["collection_id"] == 9 and float(stored[1]["vote_average"]) == 7.3
    assert {r["imdb_id_full"] for r in store.read("external_ids").collect()} == {"tt0114709", "tt12345678"}
    tables = {n: store.read(n) for n in schemas.DDL if store.exists(n)}
    for name, rules in schemas.RULES.items():
        if name in tables:
            assert integrity.violations(name, tables[name], rules, tables).filter("offending > 0").count() == 0, name
    again = load.add_entities(store, "genres", spark.createDataFrame([(18, "Renamed"), (99, "New"), (99, "Newer")], "id int, name string"))
    assert again == 1 and {r["name"] for r in store.read("genres").collect()} == {"Drama", "Action", "New"}
    left = load.delete_movies(tables, spark.createDataFrame([(1,)], "id int"))
    assert left["movies"].count() == 2 and left["movie_cast"].count() == 0 and left["people"].count() == 2
    loose = load.delete_collections(tables, spark.createDataFrame([(9,)], "id int"))
    assert loose["collections"].count() == 0 and loose["movies"].filter("collection_id is not null").count() == 0 and loose["movies"].count() == 3


def test_constraints(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, "b", "toolong")], "id int, name string, ref string")
    rules = integrity.TableRules(["id"], ["ref"], ["name"], {"ref": 3}, {"ref": ("others", "k")})
    others = spark.createDataFrame([("x",)], "k string")
    got = {r["constraint"]: r["offending"] for r in integrity.violations("t", df, rules, {"others": others}).collect()}
    assert got == {"not_null:id": 0, "not_null:ref": 1, "max_length:ref": 1, "primary_key:id": 1, "unique:name": 1, "references:ref->others.k": 1}
    with pytest.raises(integrity.ConstraintError, match="primary_key:id: 1"):
        integrity.enforce("t", df, rules, {"others": others})


def test_store_versions(spark):
    store = TableStore(spark, fresh_path(spark, "store"))
    assert not store.exists("t")
    with pytest.raises(FileNotFoundError):
        store.read("t")
    df = spark.range(10).select(F.col("id").cast("int"), F.lit("").alias("name"), F.lit(float("nan")).alias("x"))
    df = conform(df, spark.createDataFrame([], "id int, name string, x decimal(8,3)").schema)
    assert store.append("t", df) == 10 and store.append("t", df.filter("id < 3")) == 3
    assert store.read("t").filter("name = '' and x is null").count() == 13
    # a rewrite that reads the version it replaces
    assert store.replace("t", store.read("t").filter("id > 5"), sort_by=["id"]) == 4 and store.read("t").count() == 4
    assert [p[-7:] for p in store.paths("t")] == ["v000002"]


def test_refresh_and_upsert(spark):
    target = spark.createDataFrame([(1, "/a"), (2, None), (3, ""), (4, "/d"), (5, "/e")], "id int, poster_path string")
    feed = spark.createDataFrame([(1, " 1 ", "/old"), (2, "1", " /new "), (3, "2", "/b"), (4, "3", "/c"), (5, "4", "/d"), (6, "5", "  "), (7, "", "/x")], "n int, id string, poster_path string")
    after = merge.refresh_column(target, merge.clean_feed(feed, "id", "poster_path", "n"), "id", "poster_path")
    assert {r["id"]: (r["poster_path"], r["change"]) for r in after.collect()} == {
        1: ("/new", "updated"), 2: ("/b", "newly_added"), 3: ("/c", "newly_added"), 4: ("/d", None), 5: ("/e", None)
    }
    assert tuple(merge.refresh_counts(after).first()) == (1, 2, 3)
    stamped = merge.upsert(
        spark.createDataFrame([(1, "a", None)], "id int, v string, at timestamp"), spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string"), ["id"], stamp="at"
    ).collect()
    assert {r["id"]: r["v"] for r in stamped} == {1: "b", 2: "c"} and all(r["at"] for r in stamped)


def test_embedding_pipeline(spark):
    words = [f"k{i:02d}" for i in range(25)]
    movies = spark.createDataFrame([(1, " T ", "x" * 30, 1.0), (2, "U", "y" * 29, 9.0), (3, None, "z" * 31, None)], "id int, title string, overview string, popularity double")
    genres, keywords = spark.createDataFrame([(1, "B"), (2, "A")], "id int, name string"), spark.createDataFrame(list(enumerate(words)), "id int, name string")
    links = spark.createDataFrame([(1, 1), (1, 2)], "movie_id int, genre_id int")
    tags = spark.createDataFrame([(1, i) for i in range(25)], "movie_id int, keyword_id int")
    nothing = spark.createDataFrame([], schemas.schema("movie_embeddings"))
    rows = embed.with_hash(embed.candidates(movies, genres, links, keywords, tags, nothing))
    texts = {r["id"]: r["text"] for r in rows.collect()}
    assert texts == {1: f"T. Genres: A, B. Keywords: {', '.join(words[:20])}. {'x' * 30}", 3: "z" * 31}
    assert [r["id"] for r in embed.candidates(movies, genres, links, keywords, tags, nothing, limit=1).collect()] == [1]
    first = embed.refresh(nothing, rows)
    stored = spark.createDataFrame(first.collect(), nothing.schema)
    assert stored.count() == 2 and all(len(r["embedding"]) == 768 and r["model_name"] == "hash-768" for r in stored.collect())
    again = embed.with_hash(embed.candidates(movies, genres, links, keywords, tags, stored))
    assert embed.stale(again).count() == 0 and embed.stale(again, force=True).count() == 2
    assert tuple(embed.stale_counts(again).first()) == (2, 0) and embed.refresh(stored, again).count() == 2
    assert embed.migrate(stored).count() == 2 and embed.migrate(stored, 384).count() == 0
    with pytest.raises(Exception, match="expected 2 vectors|expected 1 vectors"):
        embed.encode(rows, lambda: embed.HashEncoder(5)).collect()


def test_quantiles(spark):
    values = [float(i * i % 997) for i in range(3000)] + [7.0] * 1500
    df = spark.createDataFrame([(v, None) for v in values], "v double, w double")
    got = {r["p"]: r["quantile"] for r in quantiles.exact_quantiles(df, ["v", "w"], [0.0, 0.137, 0.5, 0.9, 0.99, 1.0]).collect()}
    import numpy as np

    assert got == pytest.approx({p: float(np.quantile(values, p)) for p in (0.0, 0.137, 0.5, 0.9, 0.99, 1.0)})


def test_profile_samples(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["[]", "oops", None, "[1]", "{}"])], "n int, c string")
    assert tuple(profile.cell_quality(df, ["c"]).first()) == ("c", 4, 3, 1, 1)
    assert tuple(profile.cell_quality(df, ["c"], sample=2, order=["n"]).first()) == ("c", 2, 1, 1, 1)
    keys = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, None, 1), (4, "b", 2), (5, "a", 1)], "n int, t string, d int")
    assert [r["n"] for r in profile.semantic_duplicate_samples(keys, ["t", "d"], ["n"], 2).collect()] == [1, 2]
    assert profile.semantic_duplicates(keys, ["t", "d"]).first()[0] == 3
    approx = {r["column"]: r["distinct"] for r in profile.cardinality(keys, ["t", "d"], exact=False).collect()}
    assert approx == {"t": 2, "d": 2}


class Session:
    """What ``shared_folder`` asks of a session."""

    def __init__(self, master, folder=None, checkpoint=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master, self.applicationId, self.checkpoint = master, "app-1", checkpoint

    def getCheckpointDir(self):
        return self.checkpoint


def test_shared_folder(spark):
    assert shared_folder(Session("yarn", "/shared/place/")) == "/shared/place"
    assert fresh_path(Session("local[2]", "/shared/place"), "x").startswith("/shared/place/x-")
    assert shared_folder(Session("yarn", None, "/set/in/context")) == "/set/in/context"
    assert shared_folder(Session("local[2]")).endswith("marquee-app-1")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session("spark://host:7077"))


def test_failed_write_leaves_the_table_usable(spark):
    store = TableStore(spark, fresh_path(spark, "store"))
    good = spark.range(5)
    bad = good.select(F.raise_error(F.lit("broken")).cast("bigint").alias("id"))
    for write in (store.replace, store.append):
        with pytest.raises(Exception, match="broken"):
            write("t", bad)
    assert not store.exists("t")
    assert store.append("t", good) == 5
    with pytest.raises(Exception, match="broken"):
        store.append("t", bad)
    assert store.append("t", good) == 5 and store.read("t").count() == 10
    assert store.replace("t", good) == 5 and store.read("t").count() == 5


def test_second_load_is_refused_or_skipped(spark):
    store = TableStore(spark, fresh_path(spark, "again"))
    load.add_entities(store, "genres", spark.createDataFrame([(1, "Drama")], "id int, name string"))
    store.append("movies", conform(spark.createDataFrame([(1,)], "id int").select("id", *[F.lit(None).alias(f.name) for f in schemas.schema("movies").fields if f.name != "id"]), schemas.schema("movies")))
    links = spark.createDataFrame([(1, 1), (2, 1)], "movie_id int, genre_id int")
    assert load.add_links(store, "movie_genres", links) == 1
    with pytest.raises(integrity.ConstraintError, match="stored_primary_key"):
        load.add_links(store, "movie_genres", links)
    assert load.add_links(store, "movie_genres", links, on_conflict="skip") == 0 and store.read("movie_genres").count() == 1
    with pytest.raises(integrity.ConstraintError, match="unique:name"):
        load.add_entities(store, "genres", spark.createDataFrame([(2, "Drama")], "id int, name string"))
    with pytest.raises(integrity.ConstraintError, match="references:genre_id"):
        load.add_links(store, "movie_genres", spark.createDataFrame([(1, 9)], "movie_id int, genre_id int"))


def test_cross_file_report_reads_each_file_once(spark, tmp_path):
    for name, n in (("m", 10), ("c", 12), ("k", 8)):
        spark.range(n).withColumn("id", F.col("id").cast("string")).write.parquet(str(tmp_path / name))
    report = profile.cross_file_report(*[spark.read.parquet(str(tmp_path / n)) for n in "mck"])
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3 and plan.count("Exchange hashpartitioning") == 1
    assert {r["measure"]: r["n"] for r in report.collect()}["credits_without_movie"] == 2


def test_whole_profile_reads_its_input_twice(spark, tmp_path):
    """One aggregation for measures of rows, one shuffle of counted values, whatever the sections."""
    rows = [(i % 7, f"v{i % 3}" if i % 5 else None, float(i % 11) if i % 4 else None, ["[]", "oops", "[{'a': \"it's\"}]", None][i % 4], "2001-02-03") for i in range(200)]
    spark.createDataFrame(rows, "k int, t string, x double, c string, d string").write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    spec = {"keys": ["k", "t"], "numeric": ["x", "k"], "categorical": ["t", "k"], "dates": ["d"], "texts": ["t"], "spaces": ["t", "c"], "cells": ["c"]}
    read = []
    original = profile.staged
    try:
        profile.staged = lambda frame, label: (read.append(frame._jdf.queryExecution().optimizedPlan().toString().count("Relation")), original(frame, label))[1]
        whole = profile.profile(df, spec)
    finally:
        profile.staged = original
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{tmp_path}/in") == 1 and read == [1]  # the measures, and the counts that were staged
    got = {(r.section, r.subject, r.metric): r.value for r in whole.collect()}
    assert got["basic", "table", "rows"] == 200 and got["missing", "t", "missing"] == 40 and got["missing", "t", "pct"] == 20 and ("missing", "k", "missing") not in got
    assert got["duplicates", "rows", "duplicates"] == 200 - len(set(rows)) and got["duplicates", "k", "rows_involved"] == 200 and got["duplicates", "t", "rows_involved"] == 200
    assert got["categorical", "t", "distinct"] == 3 and got["categorical", "k", "distinct"] == 7 and got["numeric", "x", "max"] == 10 and got["dates", "d", "unparseable"] == 0
    numbers = sorted(r[2] for r in rows if r[2] is not None)
    import numpy as np

    assert got["numeric", "x", "p90"] == pytest.approx(np.quantile(numbers, 0.9)) and got["numeric", "k", "p50"] == 3
    assert [got["cells", "c", m] for m in ("cells", "parsed", "failed", "empty_lists")] == [150, 100, 50, 50]
    none = {(r.section, r.subject, r.metric): r.value for r in profile.profile(df.limit(0), spec).collect()}
    assert none["basic", "table", "rows"] == 0 and none["duplicates", "k", "rows_involved"] == 0 and none["duplicates", "rows", "duplicates"] == 0


def test_encoded_texts_agree_with_sql_where_counts_cancel(spark, tmp_path):
    """w11 and w15 fall into one of 64 slots with opposite signs."""
    texts = [(1, "w11 w15"), (2, None), (3, ""), (4, "ΟΔΟΣ İx ΣΑΣ"), (5, "w11 w15 zebra"), (6, "Two words")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(workloads.SQL["encode_texts"]).fetchall()
    got = embeddings.encode_texts(spark, str(tmp_path)).collect()
    assert any(np.isnan(r[2]) for r in want) and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
