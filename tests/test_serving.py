import datetime as dt

import numpy as np
import random
import re

import pytest
from pyspark.sql import functions as F

from marquee.functions import display
from marquee.functions.text import like_text, register_unaccent, search_form, unaccent
from marquee.operators import arrays
from marquee.operators import neighbours as nn
from marquee.plans import browse, details, search, similar
from marquee.plans.catalogue import Catalogue, InvalidArgument, Page, genre_names

MOVIES = [
    (550, "Fight Club", "Fight Club", "en", dt.date(1999, 10, 15), "/f.jpg", 8.3, 9000, 63.8),
    (603, "The Matrix", "The Matrix", "en", dt.date(1999, 3, 30), None, 7.9, 9500, 33.3),
    (604, "The Matrix Reloaded", "The Matrix Reloaded", "en", dt.date(2003, 5, 15), None, 6.7, 3500, 22.9),
    (194, "Amélie", "Le fabuleux destin", "fr", dt.date(2001, 4, 25), None, 7.8, 3400, 12.8),
    (557, "Spider-Man", None, "en", dt.date(2002, 5, 1), None, 6.8, 5400, 29.4),
    (1, "Matrix", "Matrix", "de", None, None, None, None, None),
    (2, "100% Wolf", "Wolf_", "de", dt.date(1999, 1, 1), None, 9.9, 3, 1.0),
    (3, "Straße", "x", "de", dt.date(1990, 12, 31), None, 5.0, 10, 1.0),
]
SCHEMA = "id int, title string, original_title string, original_language string, release_date date, poster_path string, vote_average double, vote_count int, popularity double"
GENRES = [(18, "Drama"), (28, "Action"), (16, "Animation")]
LINKS = [(550, 18), (603, 28), (603, 18), (604, 28), (194, 18), (2, 16)]
VECTORS = {550: [1, 0, 0], 603: [0.9, 0.1, 0], 604: [0.9, 0.1, 0], 194: [0, 1, 0], 557: [0, 0, 0], 1: [-1, 0, 0]}


@pytest.fixture(scope="module")
def catalogue(spark):
    return Catalogue(
        spark.createDataFrame(MOVIES, SCHEMA), spark.createDataFrame(GENRES, "id int, name string"),
        spark.createDataFrame(LINKS, "movie_id int, genre_id int"),
        spark.createDataFrame([(k, [float(x) for x in v]) for k, v in VECTORS.items()], "movie_id bigint, embedding array<float>"),
    )


def ids(df):
    return [r["id"] for r in df.collect()]


def test_default_listing(catalogue):
    page = browse.listing(catalogue)
    assert ids(page.items) == [550, 603, 557, 604, 194, 2, 3, 1]
    assert (page.total, page.page, page.page_size, page.total_pages) == (8, 1, 20, 1)
    rows = {r["id"]: r for r in page.items.collect()}
    assert rows[603]["genres"] == ["Action", "Drama"] and rows[557]["genres"] == [] and rows[550]["year"] == 1999


def test_pages_and_order(catalogue):
    assert ids(browse.listing(catalogue, page=2, page_size=3).items) == [604, 194, 2]
    assert ids(browse.listing(catalogue, page=9, page_size=3).items) == []
    assert ids(browse.listing(catalogue, sort="releaseDate", direction="asc").items) == [3, 2, 603, 550, 194, 557, 604, 1]
    assert ids(browse.listing(catalogue, sort="title", direction="desc").items)[-1] == 2
    assert ids(browse.listing(catalogue, sort="voteAverage").items) == [550, 603, 194, 557, 604, 3]
    assert ids(browse.listing(catalogue, browse.Filters(min_votes=0), "voteAverage").items)[0] == 2


def test_filters(catalogue):
    def found(**kw):
        return set(ids(browse.matching(catalogue, browse.Filters(**kw))))

    assert found(genres=["Drama", "Animation"]) == {550, 603, 194, 2}
    assert found(year=1999) == {550, 603, 2}
    assert found(year_from=2001, year_to=2002) == {194, 557}
    assert found(year_to=99999) == {550, 603, 604, 194, 557, 2, 3} and found(year_from=99999) == set()
    assert found(language="de", min_votes=5) == {3}
    assert found(genres=["Nothing"]) == set()


@pytest.mark.parametrize("kw, code", [
    ({"page": 0}, "invalid_page"), ({"page_size": 0}, "invalid_page_size"), ({"page_size": 101}, "invalid_page_size"),
    ({"filters": browse.Filters(year_from=2000, year_to=1999)}, "invalid_year_range"),
    ({"filters": browse.Filters(min_votes=-1)}, "invalid_min_vote_count"), ({"sort": "budget"}, "invalid_sort"), ({"direction": "up"}, "invalid_sort"),
])
def test_listing_arguments(catalogue, kw, code):
    with pytest.raises(InvalidArgument) as error:
        browse.listing(catalogue, **kw)
    assert error.value.code == code


def test_search(catalogue):
    assert ids(search.search(catalogue, " MATRIX ").items) == [1, 603, 604]
    assert ids(search.search(catalogue, "amelie").items) == [194] and ids(search.search(catalogue, "spider man").items) == [557]
    assert ids(search.search(catalogue, "strasse").items) == [3] and ids(search.search(catalogue, "fabuleux").items) == [194]
    empty = search.search(catalogue, "zzzz")
    assert ids(empty.items) == [] and (empty.total, empty.total_pages) == (0, 0)
    scores = {r["id"]: r["relevance_score"] for r in search.hits(catalogue.movies, "matrix").collect()}
    assert scores == {1: 100, 603: 10, 604: 10}
    assert {r["id"]: r["relevance_score"] for r in search.hits(catalogue.movies, "the").collect()} == {603: 50, 604: 50}
    assert search.results(catalogue, "ma").page_size == 50
    assert search.suggest(catalogue, " m ") is None and ids(search.suggest(catalogue, "spider"))[0] == 557
    for bad in ("", " x ", "y" * 101):
        with pytest.raises(InvalidArgument):
            search.search(catalogue, bad)


def test_wildcards_are_live_unless_literal(catalogue):
    assert set(ids(search.hits(catalogue.movies, "m_tr%x"))) == {1, 603, 604}
    assert set(ids(search.hits(catalogue.movies, "0%", literal=True))) == {2}
    assert set(ids(search.hits(catalogue.movies, "f_", literal=True))) == {2}
    assert set(ids(search.hits(catalogue.movies, r"\m\atrix"))) == {1, 603, 604}


def test_search_many_agrees_with_single_searches(spark, catalogue):
    texts = ["matrix", "the", "m_tr%x", "%%", "x%", "amelie", "zz", " wolf ", "0%", "a", "ma", "spider man", "__", "%x", "\tmatrix\u00a0", "x" * 101]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    for rows_per_task in (1_000_000, 1):
        many = search.search_many(catalogue.movies, queries, 5, rows_per_task=rows_per_task).collect()
        for i, text in enumerate(texts):
            mine = [r for r in many if r["query_id"] == i]
            assert [r["error"] for r in mine if r["error"]] == (["invalid_search_query"] if len(text.strip()) < 2 or len(text.strip()) > 100 else []), text
            got = [r["id"] for r in sorted((r for r in mine if not r["error"]), key=lambda r: r["rank"])]
            assert got == ([] if not 2 <= len(text.strip()) <= 100 else ids(search.search(catalogue, text).items)[:5]), text


def test_many_wildcard_queries(spark):
    """A thousand patterns, among them wildcards alone, against the comparison of single searches."""
    rng = random.Random(12)
    titles = ["".join(rng.choice("abcd %_") for _ in range(rng.randrange(0, 9))) for _ in range(120)] + ["%%", "__", "a%b", None]
    movies = search.with_search_forms(spark.createDataFrame([(i, t, rng.choice([None, "abc", "da"]), rng.choice([None, 1.0, 2.0, 3.0])) for i, t in enumerate(titles)],
                                                            "id long, title string, original_title string, popularity double"))
    texts = ["".join(rng.choice("abcd%_\\") for _ in range(rng.randrange(2, 6))) for _ in range(1000)] + ["%%", "__", "%_%", "_________", "a%b"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    found = {}
    for r in search.search_many(movies, queries, 3, rows_per_task=50, queries_per_task=400).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.id, r.relevance_score))
    patterns = queries.select("query_id", search.search_form(F.col("query")).alias("exact"), search.search_form(like_text(F.col("query"))).alias("source"))
    match, score = search.relevance(F.col("exact"), F.col("source"))
    single = movies.crossJoin(patterns).filter(match).select("query_id", "id", "popularity", score.alias("score")).collect()
    expected = {}
    for r in sorted(single, key=lambda r: (-r.score, r.popularity is None, -(r.popularity or 0), r.id)):
        if len(expected.setdefault(r.query_id, [])) < 3:
            expected[r.query_id].append((len(expected[r.query_id]) + 1, r.id, r.score))
    assert {i: sorted(x) for i, x in found.items() if x[0][1] is not None} == expected


def test_like_text(spark):
    df = spark.createDataFrame([("a%b",), ("a\\b",), ("a\\%",), ("\\\\b",), ("x\\",)], "q string")
    assert [r[0] for r in df.select(like_text(F.col("q"))).collect()] == ["a%b", "ab", "a\\%", "\\\\b", "x\\"]
    assert [r[0] for r in df.select(like_text(F.col("q"), True)).collect()] == ["a\\%b", "a\\\\b", "a\\\\\\%", "\\\\\\\\b", "x\\\\"]


def test_unaccent(spark):
    df = spark.createDataFrame([("Amélie",), ("Straße",), ("Ærø",), ("Spider-Man",), (None,), ("Žižek Ёлка Άλφα",)], "t string")
    assert [r[0] for r in df.select(unaccent(F.col("t"))).collect()] == ["Amelie", "Strasse", "AEro", "Spider-Man", None, "Zizek Елка Αλφα"]
    assert [r[0] for r in df.select(search_form(F.col("t"))).collect()][:4] == ["amelie", "strasse", "aero", "spider man"]
    register_unaccent(spark, "plain_text")
    df.createOrReplaceTempView("titles")
    assert [r[0] for r in spark.sql("select plain_text(t) from titles").collect()] == [r[0] for r in df.select(unaccent(F.col("t"))).collect()]


def test_similar(catalogue):
    rows = similar.similar(catalogue, 550).collect()
    assert [r["id"] for r in rows] == [603, 604, 194, 1, 557]
    assert [r["similarity"] for r in rows][2:] == [0.0, -1.0, None]
    assert ids(similar.similar(catalogue, 550, 1, 4000)) == [603]
    assert ids(similar.similar(catalogue, 194, 3)) == [603, 604, 1]  # 1 and 550 tie at 0
    assert ids(similar.similar_popular(catalogue, 550)) == [603, 604, 194, 557]
    assert similar.similar(catalogue, 3) is None and similar.similar(catalogue, 999999999) is None
    for kw in ({"k": 0}, {"k": 51}, {"min_votes": -1}):
        with pytest.raises(InvalidArgument):
            similar.similar(catalogue, 550, **kw)


def test_vectors_of_other_width_raise(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id bigint, embedding array<float>")
    with pytest.raises(Exception, match="expected vectors of 2 numbers"):
        nn.nearest(df, [1.0, 0.0]).collect()


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 4
    points = [centres[i % 6] + rng.normal(size=8) * 0.4 for i in range(160)] + [centres[0]] * 80  # a third are copies
    points[17] = np.zeros(8)
    return points, spark.createDataFrame([(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)], "id bigint, embedding array<float>").repartition(4)


def brute(points, k):
    m = np.asarray(points, dtype=np.float32).astype(np.float64)
    with np.errstate(invalid="ignore"):
        unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, nn.DIGITS)
    out = {}
    for i in range(len(m)):
        others = [j for j in range(len(m)) if j != i and not np.isnan(sims[i, j])]
        out[i] = sorted(others, key=lambda j: (-sims[i, j], j))[:k]
    return out


@pytest.mark.parametrize("tile_rows", [4096, 40, 17])
def test_neighbours_of_all_are_exact(cloud, tile_rows):
    points, df = cloud
    want = {i: v for i, v in brute(points, 5).items() if i != 17}
    got = {}
    for r in nn.nearest_for_all(df, 5, tile_rows).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    assert {i: [n for _, n in sorted(v)] for i, v in got.items()} == want


def test_copies_per_vector_do_not_grow_with_the_table(spark):
    """Twice the vectors, many times the part size: as many tiles, so as many copies of each."""
    def copies(n):
        df = nn.nearest_for_all(spark.range(n).select("id", F.array(F.cos("id"), F.sin("id")).cast("array<float>").alias("embedding")), 2, tile_rows=4)
        return set(re.findall(r"hashpartitioning\(row#\d+, column#\d+, (\d+)\)", df._jdf.queryExecution().executedPlan().toString()))

    assert copies(400) == copies(800) == {str(2 * nn.MOST_PARTS**2)}


def test_neighbours_of_some_rows_only(spark, cloud):
    points, df = cloud
    df = df.union(spark.createDataFrame([(900, [float("nan")] * len(points[0])), (901, None)], df.schema))
    want = {(i, r, n) for i, v in brute(points, 5).items() if i != 17 and i % 10 == 0 for r, n in enumerate(v, 1)}
    found = nn.nearest_for_all(df, 5, 40, asked=df.filter("id % 10 = 0"))
    assert {(r["id"], r["rank"], r["neighbour"]) for r in found.collect()} == want


def test_best_of_many_copies_in_chunks(monkeypatch):
    """Equal vectors in several chunks: the smaller ids win, whichever way the scores are computed."""
    monkeypatch.setattr(nn, "CHUNK", 50)
    base = np.random.default_rng(3).normal(size=(7, 6))
    points = np.concatenate([np.repeat(base, 40, axis=0), np.random.default_rng(4).normal(size=(60, 6))])
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    row, neighbour, score = nn._top_k(np.arange(len(unit)), unit, np.arange(len(unit)), unit, 5)
    sims = np.round(unit @ unit.T, nn.DIGITS)
    for i in range(len(unit)):
        others = sorted((j for j in range(len(unit)) if j != i), key=lambda j: (-sims[i, j], j))[:5]
        assert neighbour[row == i].tolist() == others


def test_index_search_is_exact(spark, cloud):
    points, df = cloud
    want = brute(points, 5)
    for index in (nn.VectorIndex.build(df, cells=9), nn.shared_index(df, cells=9)):
        for i in (0, 5, 33, 200):
            assert ids(index.search(nn.reference_vector(df, i), 5, exclude=i)) == want[i]
    few = df.filter("id < 50").select("id")
    assert set(ids(index.search(nn.reference_vector(df, 0), 100, 0, few))) == set(range(1, 50))
    assert len(ids(index.search(nn.reference_vector(df, 0), 5, 0, probes=1))) == 5
    # A vector without direction comes last, as in the exhaustive search.
    assert ids(index.search(nn.reference_vector(df, 0), 239, 0))[-1] == 17
    every = {(r["id"], r["rank"], r["neighbour"]) for r in nn.approximate_for_many(index, df, 5, probes=9, part_rows=30).collect()}
    assert every == {(r["id"], r["rank"], r["neighbour"]) for r in nn.nearest_for_all(df, 5).collect()}


def test_no_vectors(spark):
    none = spark.createDataFrame([], "id bigint, embedding array<float>")
    assert nn.nearest_for_all(none, 3).count() == 0
    index = nn.VectorIndex.build(none)
    assert index.search([1.0, 2.0], 3).count() == 0 and nn.approximate_for_many(index, none).count() == 0


def test_details(spark, catalogue):
    people = spark.createDataFrame([(287, "Brad Pitt"), (819, "Edward Norton"), (7467, "David Fincher")], "id int, name string")
    none = spark.createDataFrame([], "movie_id int, k int")
    names = spark.createDataFrame([], "id int, name string")
    extra = {c: F.lit(None).cast("string") for c in ("imdb_id", "overview", "tagline", "status")}
    extra |= {c: F.lit(None).cast("int") for c in ("runtime", "budget", "revenue")}
    extra |= {"adult": F.lit(False), "collection_id": F.when(F.col("id") == 603, 9)}
    tables = {
        "movies": catalogue.movies.withColumns(extra), "collections": spark.createDataFrame([(9, "Matrix Saga", None)], "id int, name string, poster_path string"),
        "external_ids": spark.createDataFrame([(550, 2959, "tt0137523")], "movie_id int, movielens_id int, imdb_id_full string"),
        "genres": catalogue.genres, "movie_genres": catalogue.movie_genres, "people": people,
        "production_countries": names.withColumnRenamed("id", "iso_3166_1"), "movie_production_countries": none.withColumnRenamed("k", "country_iso"),
        "spoken_languages": names.withColumnRenamed("id", "iso_639_1"), "movie_spoken_languages": none.withColumnRenamed("k", "language_iso"),
        "production_companies": spark.createDataFrame([(1, "Fox"), (2, "Fox"), (3, "Art")], "id int, name string"),
        "movie_production_companies": spark.createDataFrame([(550, 1), (550, 2), (550, 3)], "movie_id int, company_id int"),
        "keywords": names, "movie_keywords": none.withColumnRenamed("k", "keyword_id"),
        "movie_cast": spark.createDataFrame([(550, 287, 1, None), (550, 819, 0, "Narrator")], "movie_id int, person_id int, cast_order int, character_name string"),
        "movie_crew": spark.createDataFrame([(550, 819, "Cook", None), (550, 7467, "Director", "Directing"), (550, 7467, "Boss", "Directing")], "movie_id int, person_id int, job string, department string"),
    }
    row = details.find_by_id(tables, 550).first()
    assert row["title"] == "Fight Club" and row["genres"] == ["Drama"] and row["production_companies"] == ["Art", "Fox", "Fox"]
    assert [c["person_id"] for c in row["cast"]] == [819, 287] and [c["job"] for c in row["crew"]] == ["Boss", "Director", "Cook"]
    assert row["cross_references"]["imdb_numeric"] == "tt0137523" and row["collection"] is None and row["keywords"] == []
    assert details.find_by_id(tables, 999999999) is None
    wide = {r["id"]: r for r in details.details(tables).collect()}
    assert len(wide) == len(MOVIES) and wide[603]["collection"]["name"] == "Matrix Saga" and wide[2]["cast"] == []
    text = details.cast_json(details.details(tables, 550)).first()
    assert text["cast"].startswith('[{"personId":819,"name":"Edward Norton","character":"Narrator","order":0}') and '"character":null' in text["cast"]


def test_cards(spark):
    df = spark.createDataFrame([(1999, 8.39, 10, ["A", "B", "C", "D"]), (None, 8.0, 0, []), (2000, None, 5, ["A"])], "year int, avg double, votes int, g array<string>")
    line = display.card_line(F.col("year"), F.col("avg"), F.col("votes"), F.col("g"))
    assert [r[0] for r in df.select(line).collect()] == ["1999 · ★ 8.3 · A, B", "", "2000 · A"]
    assert [r[0] for r in df.select(display.first_names(F.col("g"), 3)).collect()][0] == ["A", "B", "C"]


def test_page_arithmetic(catalogue):
    assert Page(catalogue.movies, 1, 20, 0).total_pages == 0 and Page(catalogue.movies, 1, 20, 41).total_pages == 3
    assert [r["name"] for r in genre_names(catalogue).collect()] == ["Action", "Animation", "Drama"]


def test_name_arrays_shuffle_every_row_once(spark):
    """Links are grouped by item alone, repeated names are kept, and a link table with few partitions doesn't make few large groups of tasks."""
    links = spark.createDataFrame([(1, 5), (1, 6), (1, 6), (2, 5)], "movie_id long, k long")
    entities = spark.createDataFrame([(5, "b"), (6, "a")], "id long, name string")
    found = arrays.name_arrays({"x": arrays.Relation(links, "k", entities), "y": arrays.Relation(links.filter("movie_id = 2"), "k", entities)})
    assert sorted(map(tuple, found.collect())) == [(1, ["a", "a", "b"], []), (2, ["b"], ["b"])]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(movie_id#\d+L, _kind", plan)
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "1000"
