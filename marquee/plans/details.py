"""The wide details row: scalars, references, name arrays, cast and crew of a movie."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.arrays import Members, Relation, arrays_by_item, empty_if_null

# alias -> (link table, link key, entity table, entity key)
NAME_ARRAYS = {
    "genres": ("movie_genres", "genre_id", "genres", "id"),
    "production_countries": ("movie_production_countries", "country_iso", "production_countries", "iso_3166_1"),
    "spoken_languages": ("movie_spoken_languages", "language_iso", "spoken_languages", "iso_639_1"),
    "production_companies": ("movie_production_companies", "company_id", "production_companies", "id"),
    "keywords": ("movie_keywords", "keyword_id", "keywords", "id"),
}
SCALARS = (
    "id", "imdb_id", "title", "original_title", "original_language", "overview", "tagline", "release_date", "runtime",
    "status", "budget", "revenue", "popularity", "vote_average", "vote_count", "adult", "poster_path",
)


def cast_members(movie_cast: DataFrame, people: DataFrame) -> Members:
    """The cast in billing order."""
    named = movie_cast.join(people.select(F.col("id").alias("person_id"), "name"), "person_id")
    named = named.withColumnsRenamed({"character_name": "character", "cast_order": "order"})
    return Members(named, ["person_id", "name", "character", "order"], [F.col("order")])


def crew_members(movie_crew: DataFrame, people: DataFrame) -> Members:
    """The crew by department (missing last), then job."""
    named = movie_crew.join(people.select(F.col("id").alias("person_id"), "name"), "person_id")
    return Members(named, ["person_id", "name", "job", "department"], [F.col("department").isNull(), F.col("department"), F.col("job")])


def details(tables: Mapping[str, DataFrame], movie_id: int | None = None) -> DataFrame:
    """Details of every movie, or of one id (no row when it does not exist).

    All relations are gathered by movie in one grouping before they are joined, so they do not multiply each other, and
    all joins but the collection's use the partitioning by movie id that the grouping already has. A
    given id reaches every relation's scan.
    """
    def of(name: str, key: str = "movie_id") -> DataFrame:
        df = tables[name]
        return df if movie_id is None else df.filter(F.col(key) == movie_id)

    wide = of("movies", "id").select(*SCALARS, "collection_id")
    collections = tables["collections"].select(
        F.col("id").alias("collection_id"), F.struct("id", "name", "poster_path").alias("collection")
    )
    wide = wide.join(collections, "collection_id", "left").drop("collection_id")
    links = of("external_ids").select(
        F.col("movie_id").alias("id"), F.struct("movielens_id", F.col("imdb_id_full").alias("imdb_numeric")).alias("cross_references")
    )
    names = {
        alias: Relation(of(link), link_key, tables[entity], entity_key)
        for alias, (link, link_key, entity, entity_key) in NAME_ARRAYS.items()
    }
    members = {"cast": cast_members(of("movie_cast"), tables["people"]), "crew": crew_members(of("movie_crew"), tables["people"])}
    for part in (links, arrays_by_item(names, members)):
        wide = wide.join(part.withColumnRenamed("movie_id", "id"), "id", "left")
    return empty_if_null(wide, *NAME_ARRAYS, "cast", "crew")


def find_by_id(tables: Mapping[str, DataFrame], movie_id: int) -> DataFrame | None:
    """The details of one movie, or None when there is no such movie."""
    if tables["movies"].filter(F.col("id") == movie_id).limit(1).isEmpty():
        return None
    return details(tables, movie_id)


def cast_json(wide: DataFrame) -> DataFrame:
    """``cast`` and ``crew`` as JSON text with their public field names; null fields are written."""
    person = lambda s, *names: F.struct(s["person_id"].alias("personId"), *[s[n].alias(n) for n in names])
    options = {"ignoreNullFields": "false"}
    return wide.withColumns({
        "cast": F.to_json(F.transform("cast", lambda s: person(s, "name", "character", "order")), options),
        "crew": F.to_json(F.transform("crew", lambda s: person(s, "name", "job", "department")), options),
    })
