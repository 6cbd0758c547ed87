"""The stored title index answers as a scan does, and reads its own buckets only."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marquee.functions.text import like_fragments
from marquee.plans import search, title_index
from marquee.plans.catalogue import Catalogue
from marquee.plans.title_index import TitleIndex

WORDS = ["Amélie", "Spider-Man", "100%", "a_b", "Straße", "the", "The", "Matrix", "x", "Ωmega", "ma", "日本", "back\\slash", "O'Brien", "re", "red", "Red-Bolt"]


@pytest.fixture(scope="module")
def movies(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))), rng.choice([None, "", rng.choice(WORDS)]), float(i % 7)) for i in range(400)]
    rows += [(1000, "", None, 1.0), (1001, None, "Matrix", 1.0), (1002, "m", "x", 2.0), (1003, "word " * 2000 + "needle", None, None)]
    frame = spark.createDataFrame(rows, "id long, title string, original_title string, popularity double")
    empty = {c: F.lit(None).cast(t) for c, t in (("release_date", "date"), ("poster_path", "string"), ("vote_average", "double"), ("vote_count", "int"))}
    return frame.withColumns(empty)


@pytest.fixture(scope="module")
def index(movies, tmp_path_factory):
    return TitleIndex.build(movies, str(tmp_path_factory.mktemp("index") / "titles"), buckets=16, parts=8)


QUERIES = ["matrix", "the", "MA", "re", "red bolt", "m_tr%x", "r_d", "%%", "__", "0%", "a_", "amelie", "spider man", "strasse", "ωmega", "日本", "zzzz", "o'b", "needle", r"\%", r"a\_b", "%re", "e r%t", "100\\"]


@pytest.mark.parametrize("literal", [False, True])
def test_index_and_scan_agree(movies, index, literal):
    for text in QUERIES[::2] if literal else QUERIES:
        mine = {(r.id, r.title, r.relevance_score) for r in index.hits(text, literal).collect()}
        assert mine == {(r.id, r.title, r.relevance_score) for r in search.hits(movies, text, literal).collect()}, text


def test_pages_agree(movies, index):
    spark = movies.sparkSession
    catalogue = Catalogue(movies, spark.createDataFrame([], "id long, name string"), spark.createDataFrame([], "movie_id long, genre_id long"))
    for text in ("the", "m_tr%x"):
        scan, stored = search.search(catalogue, text, 2, 5), search.search(catalogue, text, 2, 5, index=index)
        assert stored.total == scan.total and [r.id for r in stored.items.collect()] == [r.id for r in scan.items.collect()]


def scans(df):
    return re.findall(r"FileScan parquet .*", df._jdf.queryExecution().executedPlan().toString())


def test_a_search_reads_its_buckets_only(spark, index):
    near = index.candidates("needle")
    (lists,) = scans(near)
    wanted = {r[0] for r in spark.createDataFrame([(k,) for k in title_index.keys("needle")], "k string").select(title_index._bucket(F.col("k"), 16)).collect()}
    assert set(map(int, re.findall(r"\d+", re.search(r"PartitionFilters: \[.*?bucket#\d+ IN \(([\d,]+)\)", lists)[1]))) <= wanted
    assert "PushedFilters: [In(piece" in lists
    assert [r.id for r in near.collect()] == [1003]
    # Of eight parts of the titles, only the one that holds the only candidate is read.
    assert any(re.search(r"PartitionFilters: \[[^\]]*\(part#\d+ = \d\)", scan) for scan in scans(index.hits("needle")))


def test_keys_of_patterns():
    assert like_fragments(r"a%b_c\%d\\") == ["a", "b", r"c%d" + "\\"]
    assert title_index.keys("r_d%bolt") == ["bol", "olt"] and title_index.keys("re%x") == ["re"] and title_index.keys("%a_") == []


def test_empty_index(spark, movies, tmp_path):
    index = TitleIndex.build(movies.limit(0), str(tmp_path / "none"))
    assert index.hits("matrix").count() == 0 and index.hits("%%").count() == 0
