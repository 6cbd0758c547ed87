"""From cleaned files to the catalogue's stored tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee import schemas
from marquee.functions.text import zero_padded_id
from marquee.operators import nested
from marquee.operators.dedup import first_by_key
from marquee.operators.integrity import delete_cascade, delete_set_null, enforce_insert, keep_existing
from marquee.operators.merge import absent_rows
from marquee.session import staged
from marquee.sources.tables import TableStore, conform


def movie_rows(cleaned: DataFrame) -> DataFrame:
    """Cleaned movies in the stored shape: title fallbacks, default status and flag, whole numbers truncated.

    A present ``adult`` cell counts as true unless it is the boolean or text ``false``.
    """
    adult = F.lower(F.trim(F.col("adult").cast("string")))
    found = nested.with_collection_id(cleaned, "collection_id", "belongs_to_collection")
    rows = found.select(
        "id", "imdb_id", F.coalesce("title", "original_title", F.lit("Untitled")).alias("title"), "original_title",
        "original_language", "overview", "tagline", "release_date",
        *[F.col(c).cast("bigint").alias(c) for c in ("runtime", "budget", "revenue")],
        "popularity", "vote_average", "vote_count", F.coalesce("status", F.lit("Unknown")).alias("status"),
        F.coalesce(adult != "false", F.lit(False)).alias("adult"), "poster_path",
        "collection_id",
    )
    return conform(rows, schemas.schema("movies"))


def external_id_rows(links: DataFrame) -> DataFrame:
    """(movie_id, movielens_id, imdb_id_full) of cleaned links."""
    rows = links.filter(F.col("tmdbId").isNotNull()).select(
        F.col("tmdbId").cast("bigint").alias("movie_id"), F.col("movieId").cast("bigint").alias("movielens_id"),
        zero_padded_id(F.col("imdbId")).alias("imdb_id_full"),
    )
    return conform(rows, schemas.schema("external_ids"))


@dataclass(frozen=True)
class Family:
    """A list column whose items become an entity table and a link table."""

    entity: str
    link: str
    cell: str
    read: Callable[[DataFrame, str, str, Sequence[str]], DataFrame]

    @property
    def entity_key(self) -> str:
        return schemas.RULES[self.entity].primary_key[0]

    @property
    def link_key(self) -> str:
        return schemas.RULES[self.link].primary_key[1]

    def tables(self, df: DataFrame, owner: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        rows = self.read(df, owner, self.cell, order)
        entities = nested.entities(rows, order).withColumnRenamed("id", self.entity_key)
        return entities, nested.junction(rows, self.link_key)


def _by_code(key: str):
    return lambda df, owner, cell, order: nested.iso_name_items(df, owner, cell, order, key)


FAMILIES = (
    Family("genres", "movie_genres", "genres", nested.id_name_items),
    Family("production_companies", "movie_production_companies", "production_companies", nested.id_name_items),
    Family("production_countries", "movie_production_countries", "production_countries", _by_code("iso_3166_1")),
    Family("spoken_languages", "movie_spoken_languages", "spoken_languages", _by_code("iso_639_1")),
)
KEYWORDS = Family("keywords", "movie_keywords", "keywords", nested.id_name_items)


def _insert(store: TableStore, name: str, rows: DataFrame) -> int:
    """Check every declared constraint of the rows, against the stored ones too, and append them."""
    rules = schemas.RULES[name]
    parents = {table: store.read(table) for table, _ in (rules.references or {}).values()}
    rows = staged(conform(rows, schemas.schema(name)), f"load-{name}")
    return store.append(name, enforce_insert(name, rows, store.read(name) if store.exists(name) else None, rules, parents))


def _without_stored(store: TableStore, name: str, rows: DataFrame, on_conflict: str) -> DataFrame:
    """With ``skip`` the rows whose primary key is not stored, the first of each; with ``error`` all."""
    if on_conflict not in ("error", "skip"):
        raise ValueError(f"on_conflict is 'error' or 'skip', not {on_conflict!r}")
    if on_conflict == "error":
        return rows
    key = list(schemas.RULES[name].primary_key)
    order = [c for c in rows.columns if c not in key] or key
    firsts = first_by_key(rows, key, order)
    return absent_rows(store.read(name), firsts, key, order) if store.exists(name) else firsts


def add_entities(store: TableStore, name: str, rows: DataFrame) -> int:
    """Insert entities whose key the stored table lacks; returns how many were new. A new key with a stored unique value is an error."""
    return _insert(store, name, _without_stored(store, name, conform(rows, schemas.schema(name)), "skip"))


def add_links(store: TableStore, name: str, rows: DataFrame, on_conflict: str = "error") -> int:
    """Append link rows whose movie is stored; returns how many. A key that is stored already is an error or skipped."""
    kept = conform(keep_existing(rows, "movie_id", store.read("movies")), schemas.schema(name))
    return _insert(store, name, _without_stored(store, name, kept, on_conflict))


def load_movies(store: TableStore, cleaned: DataFrame, order: Sequence[str], on_conflict: str = "error") -> dict[str, int]:
    found = nested.collections(cleaned, "belongs_to_collection", order)
    counts = {"collections": add_entities(store, "collections", found)}
    rows = conform(movie_rows(cleaned), schemas.schema("movies"))
    counts["movies"] = _insert(store, "movies", _without_stored(store, "movies", rows, on_conflict))
    return counts


def load_families(store: TableStore, cleaned: DataFrame, keywords: DataFrame, order: Sequence[str], on_conflict: str = "error") -> dict[str, int]:
    counts = {}
    for family, source in [*[(f, cleaned) for f in FAMILIES], (KEYWORDS, keywords)]:
        entities, links = family.tables(source, "id", order)
        counts[family.entity] = add_entities(store, family.entity, entities)
        counts[family.link] = add_links(store, family.link, links, on_conflict)
    return counts


def load_credits(store: TableStore, credits: DataFrame, order: Sequence[str], on_conflict: str = "error") -> dict[str, int]:
    # Each cell is parsed once; people and both link tables read the stored items.
    cast_rows = staged(nested.cast_items(credits, "id", "cast", order), "cast-items")
    crew_rows = staged(nested.crew_items(credits, "id", "crew", order), "crew-items")
    return {
        "people": add_entities(store, "people", nested.people(cast_rows, crew_rows, order)),
        "movie_cast": add_links(store, "movie_cast", nested.cast_table(cast_rows, order), on_conflict),
        "movie_crew": add_links(store, "movie_crew", nested.crew_table(crew_rows, order), on_conflict),
    }


def load_links(store: TableStore, links: DataFrame, on_conflict: str = "error") -> dict[str, int]:
    return {"external_ids": add_links(store, "external_ids", external_id_rows(links), on_conflict)}


def load_catalogue(
    store: TableStore, movies: DataFrame, credits: DataFrame, keywords: DataFrame, links: DataFrame, order: Sequence[str], on_conflict: str = "error"
) -> dict[str, int]:
    """Load all cleaned files into the store, in dependency order; returns rows added per table.

    Movies or links whose key is stored already (a second load) are an error, or left out with ``on_conflict="skip"``; entities keep their
    first row, as ever. The inputs are computed once.
    """
    movies, credits, keywords, links = (staged(df, "load-input") for df in (movies, credits, keywords, links))
    return {
        **load_movies(store, movies, order, on_conflict), **load_families(store, movies, keywords, order, on_conflict),
        **load_credits(store, credits, order, on_conflict), **load_links(store, links, on_conflict),
    }


def delete_movies(tables: Mapping[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """The tables without the deleted movies and everything that refers to them; entities stay."""
    out = dict(tables)
    out["movies"] = delete_cascade(tables["movies"], "id", deleted)
    for name in schemas.MOVIE_CHILDREN:
        if name in tables:
            out[name] = delete_cascade(tables[name], "movie_id", deleted)
    return out


def delete_collections(tables: Mapping[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """The tables without the deleted collections; their movies stay and lose the reference."""
    return {
        **tables, "collections": delete_cascade(tables["collections"], "id", deleted),
        "movies": delete_set_null(tables["movies"], "collection_id", deleted),
    }
