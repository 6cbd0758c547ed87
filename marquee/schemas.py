"""Schemas and constraints of the catalogue's tables (fixed values)."""

from __future__ import annotations

from pyspark.sql import types as T

from marquee.operators.integrity import TableRules

DDL = {
    "collections": "id int, name string, poster_path string, backdrop_path string",
    "movies": (
        "id int, imdb_id string, title string, original_title string, original_language string, overview string, "
        "tagline string, release_date date, runtime int, budget bigint, revenue bigint, popularity decimal(8,3), "
        "vote_average decimal(3,1), vote_count int, status string, adult boolean, poster_path string, collection_id int"
    ),
    "people": "id int, name string, gender smallint, profile_path string",
    "movie_cast": "movie_id int, person_id int, cast_order smallint, character_name string",
    "movie_crew": "movie_id int, person_id int, job string, department string",
    "genres": "id int, name string",
    "movie_genres": "movie_id int, genre_id int",
    "production_companies": "id int, name string",
    "movie_production_companies": "movie_id int, company_id int",
    "production_countries": "iso_3166_1 string, name string",
    "movie_production_countries": "movie_id int, country_iso string",
    "spoken_languages": "iso_639_1 string, name string",
    "movie_spoken_languages": "movie_id int, language_iso string",
    "keywords": "id int, name string",
    "movie_keywords": "movie_id int, keyword_id int",
    "external_ids": "movie_id int, movielens_id int, imdb_id_full string",
    "movie_embeddings": (
        "movie_id int, embedding array<float>, model_name string, source_text_hash string, generated_at timestamp"
    ),
}

MOVIE = {"movie_id": ("movies", "id")}
RULES = {
    "collections": TableRules(["id"], ["name"]),
    "movies": TableRules(
        ["id"], ["title", "status", "adult"], max_length={"imdb_id": 15, "original_language": 10, "status": 30},
        references={"collection_id": ("collections", "id")},
    ),
    "people": TableRules(["id"], ["name"]),
    "movie_cast": TableRules(["movie_id", "person_id", "cast_order"], references=MOVIE | {"person_id": ("people", "id")}),
    "movie_crew": TableRules(["movie_id", "person_id", "job"], references=MOVIE | {"person_id": ("people", "id")}),
    "genres": TableRules(["id"], ["name"], ["name"]),
    "movie_genres": TableRules(["movie_id", "genre_id"], references=MOVIE | {"genre_id": ("genres", "id")}),
    "production_companies": TableRules(["id"], ["name"]),
    "movie_production_companies": TableRules(
        ["movie_id", "company_id"], references=MOVIE | {"company_id": ("production_companies", "id")}
    ),
    "production_countries": TableRules(["iso_3166_1"], ["name"], max_length={"iso_3166_1": 2}),
    "movie_production_countries": TableRules(
        ["movie_id", "country_iso"], references=MOVIE | {"country_iso": ("production_countries", "iso_3166_1")}
    ),
    "spoken_languages": TableRules(["iso_639_1"], ["name"], max_length={"iso_639_1": 2}),
    "movie_spoken_languages": TableRules(
        ["movie_id", "language_iso"], references=MOVIE | {"language_iso": ("spoken_languages", "iso_639_1")}
    ),
    "keywords": TableRules(["id"], ["name"], ["name"]),
    "movie_keywords": TableRules(["movie_id", "keyword_id"], references=MOVIE | {"keyword_id": ("keywords", "id")}),
    "external_ids": TableRules(["movie_id"], unique=["movielens_id", "imdb_id_full"], references=MOVIE),
    "movie_embeddings": TableRules(
        ["movie_id"], ["embedding", "generated_at", "model_name", "source_text_hash"], references=MOVIE
    ),
}

# Tables whose rows go when their movie is deleted.
MOVIE_CHILDREN = tuple(name for name, rules in RULES.items() if "movie_id" in (rules.references or {}))


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])
