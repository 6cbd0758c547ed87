"""Ordered arrays of related rows, one array per item.

Rows are grouped by item once. A group handed to one task is the item's elements, the content of the array that is asked for.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    """Links of items to named entities; ``link_key`` refers to ``entity_key``."""

    links: DataFrame
    link_key: str
    entities: DataFrame
    entity_key: str = "id"


@dataclass(frozen=True)
class Members:
    """Rows of items that become arrays of structs of ``fields``, sorted by ``order``; ties are broken by the fields."""

    rows: DataFrame
    fields: Sequence[str]
    order: Sequence[Column]


def arrays_by_item(names: Mapping[str, Relation], members: Mapping[str, Members] | None = None, item: str = "movie_id") -> DataFrame:
    """(item, one array per relation, one per kind of members).

    A relation's array holds the names of the linked entities in ascending order, duplicates kept. All arrays travel as rows of one long table that is shuffled and grouped by
    item once, so their number multiplies neither shuffles nor joins. Every row ends up in an array, so nothing is counted or gathered before the shuffle.
    """
    aliases, parts = [*names, *(members or {})], []
    for alias, r in names.items():
        named = r.entities.select(F.col(r.entity_key).alias(r.link_key), F.struct("name").alias("_name"))
        parts.append(r.links.join(named, r.link_key).select(item, F.lit(aliases.index(alias)).alias("_kind"), "_name"))
    for alias, m in (members or {}).items():
        keys = [c.alias(f"_o{i}") for i, c in enumerate(m.order)]
        packed = F.struct(*keys, F.struct(*m.fields).alias("_row"))
        parts.append(m.rows.select(item, F.lit(aliases.index(alias)).alias("_kind"), packed.alias(f"_members_{alias}")))
    rows = reduce(lambda mine, more: mine.unionByName(more, allowMissingColumns=True), parts).repartition(item)

    def gathered(alias: str) -> Column:
        element = F.col("_name" if alias in names else f"_members_{alias}")
        return F.sort_array(F.collect_list(F.when(F.col("_kind") == aliases.index(alias), element))).alias(alias)

    arrays = rows.groupBy(item).agg(*[gathered(alias) for alias in aliases])
    return arrays.select(item, *[F.col(alias)["name" if alias in names else "_row"].alias(alias) for alias in aliases])


def name_arrays(relations: Mapping[str, Relation], item: str = "movie_id") -> DataFrame:
    """(item, one array per relation): names of the linked entities in ascending order, duplicates kept."""
    return arrays_by_item(relations, item=item)


def names_by_item(links: DataFrame, entities: DataFrame, link_key: str, entity_key: str, alias: str, item: str = "movie_id") -> DataFrame:
    """``name_arrays`` of a single relation; items without links are absent."""
    return name_arrays({alias: Relation(links, link_key, entities, entity_key)}, item)


def structs_by_item(rows: DataFrame, fields: Sequence[str], order: Sequence[Column], alias: str, item: str = "movie_id") -> DataFrame:
    """(item, alias): structs of ``fields`` sorted by ``order``; ties are broken by the fields."""
    return arrays_by_item({}, {alias: Members(rows, fields, order)}, item)


def empty_if_null(df: DataFrame, *columns: str) -> DataFrame:
    """Null arrays (items without related rows) become empty arrays."""
    return df.withColumns({c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)) for c in columns})
