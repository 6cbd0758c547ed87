"""Nearest neighbours by cosine similarity, exact at every size.

One reference is compared with every vector in Arrow batches (``nearest``), or only with the cells of an
index that can hold a neighbour (``VectorIndex``). ``nearest_for_all`` finds the neighbours of every vector exactly, in tiles of a grid;
``approximate_for_many`` those of many references in the nearest cells of an index only.

On unit vectors the squared distance is ``2 - 2 * cosine``, so the triangle inequality of distances
tells which cells are too far away; nothing that could be a neighbour is skipped. Vectors of length zero
have no direction: they rank last for one reference, indexed or not, and take no part elsewhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.functions.vectors import cosine_to, has_direction, matrix_of, unit_rows
from marquee.session import fresh_path

DIGITS = 12  # similarities are compared to this many decimals, so equal vectors tie and the id decides
SLACK = 1e-6  # distances closer than this count as equal when a cell is ruled out
MOST_PIVOTS = 1024  # bounds what is collected and broadcast: so many vectors and cell sizes
MOST_PARTS = 12  # parts of a side of the grid of tiles, unless they get too large
LARGEST_PART = 65_536
BLOCK, CHUNK = 256, 16_384  # rows and columns of a tile that are multiplied at once
RANKED = "id bigint, neighbour bigint, similarity double"


def nearest(vectors: DataFrame, reference: list[float], exclude: int | None = None) -> DataFrame:
    """(id, similarity) of all vectors against one reference; take the top by ``by_similarity``."""
    others = vectors if exclude is None else vectors.filter(F.col("id") != exclude)
    return others.select("id", F.round(cosine_to(F.col("embedding"), reference), DIGITS).alias("similarity"))


def by_similarity() -> list[Column]:
    return [F.col("similarity").desc_nulls_last(), F.col("id").asc()]


def reference_vector(vectors: DataFrame, reference: int) -> list[float] | None:
    """The stored vector of one id (a single row), or None."""
    row = vectors.filter(F.col("id") == reference).select("embedding").head()
    return None if row is None or row[0] is None else list(row[0])


# ---- pivots and cells ---------------------------------------------------------------------------------------------


def choose_pivots(vectors: DataFrame, cells: int) -> np.ndarray:
    """Up to ``cells`` unit vectors, picked by the hash of their id so that every run picks the same."""
    picked = vectors.filter(F.size("embedding") > 0).orderBy(F.xxhash64("id"), "id").limit(min(cells, MOST_PIVOTS))
    rows = [r["embedding"] for r in picked.select("embedding").collect()]
    if not rows:
        return np.zeros((0, 0))
    unit = unit_rows(np.asarray(rows, dtype=np.float64))
    return unit[~np.isnan(unit).any(axis=1)]


def _distances(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(2.0 - 2.0 * (unit @ pivots.T), 0.0, None))


def assign_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, embedding, cell, away): the nearest pivot of each vector and the distance to it; cell -1 holds those without direction."""
    if not len(pivots):
        return vectors.filter(F.col("embedding").isNotNull()).select("id", "embedding", F.lit(-1).alias("cell"), F.lit(0.0).alias("away"))
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    @F.arrow_udf("struct<cell:int,away:double>")
    def place(column: pa.Array) -> pa.Array:
        dist = _distances(unit_rows(matrix_of(column, shared.value.shape[1])), shared.value)
        lost = np.isnan(dist).any(axis=1)
        cell = np.where(lost, -1, np.argmin(np.where(np.isnan(dist), np.inf, dist), axis=1)).astype(np.int32)
        away = np.where(lost, 0.0, dist[np.arange(len(dist)), np.maximum(cell, 0)])
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(away)], ["cell", "away"])

    # Declared non-deterministic so that reading both fields does not evaluate it twice.
    cell = place.asNondeterministic()("embedding").alias("_p")
    placed = vectors.filter(F.col("embedding").isNotNull()).select("id", "embedding", cell)
    return placed.select("id", "embedding", "_p.cell", "_p.away")


def cell_sizes(placed: DataFrame) -> list[tuple[int, int, float]]:
    """(cell, rows, radius), one entry per pivot at most."""
    rows = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
    return sorted((r["cell"], r["n"], r["radius"]) for r in rows)


# ---- one reference through an index -------------------------------------------------------------------------------


@dataclass(frozen=True)
class VectorIndex:
    """Vectors stored by cell: searching reads only the cells, and within them the rings, that can matter."""

    vectors: DataFrame  # id, embedding, cell, away
    pivots: np.ndarray
    cells: list[tuple[int, int, float]]

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, cells: int = 256, file_rows: int = 1_000_000) -> VectorIndex:
        """Place the vectors in cells and, given a path, store them partitioned by cell.

        A cell with many vectors is written by several tasks; files are sorted by distance to the
        pivot so that their row groups can be skipped.
        """
        pivots = choose_pivots(vectors, cells)
        placed = assign_cells(vectors, pivots)
        if path is not None:
            parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / file_rows).alias("parts"))
            salted = placed.join(F.broadcast(parts), "cell")  # at most MOST_PIVOTS rows
            salted = salted.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
            spread = salted.repartition("cell", "part").sortWithinPartitions("cell", "away").drop("part", "parts")
            spread.write.mode("errorifexists").partitionBy("cell").parquet(path)
            placed = vectors.sparkSession.read.schema("id bigint, embedding array<float>, away double, cell int").parquet(path)
        return cls(placed, pivots, cell_sizes(placed.filter("cell >= 0")))

    def search(self, reference: list[float], k: int, exclude: int | None = None, allowed: DataFrame | None = None, probes: int | None = None) -> DataFrame:
        """(id, similarity) of the k nearest, the same rows an exhaustive comparison gives.

        The nearest cells are read first; their k-th distance then rules out most others. With
        ``probes`` only so many nearest cells are read, which is faster and may miss neighbours. ``allowed``
        restricts the ids.
        """
        unit = unit_rows(np.asarray([reference], dtype=np.float64))
        if not len(self.pivots) or np.isnan(unit).any():
            return self._top(self.vectors, reference, k, exclude, allowed)
        to_pivot = _distances(unit, self.pivots)[0]
        ranked = sorted(self.cells, key=lambda c: to_pivot[c[0]])
        first, held = [], 0
        for cell, rows, _ in ranked:
            if held > k if probes is None else len(first) == probes:
                break
            first.append(cell)
            held += rows
        best = self._top(self.vectors.filter(F.col("cell").isin(first)), reference, k, exclude, allowed)
        if probes is not None:
            return best
        found = best.collect()  # at most k rows
        known = [r["similarity"] for r in found if r["similarity"] is not None]
        limit = math.sqrt(max(0.0, 2.0 - 2.0 * known[-1])) + SLACK if len(known) == k else math.inf
        seen = self.vectors.sparkSession.createDataFrame(found, best.schema)
        rest = [c for c, _, radius in self.cells if c not in first and to_pivot[c] - radius <= limit]
        if math.isinf(limit):  # too few so far: vectors without direction come after all others
            rest.append(-1)
        if not rest:
            return seen
        gap = F.abs(F.get(F.lit([float(d) for d in to_pivot]), F.col("cell")) - F.col("away"))
        near = F.col("cell").isin(rest) & ((gap <= limit) | (F.col("cell") < 0))
        more = self._top(self.vectors.filter(near), reference, k, exclude, allowed)
        return seen.unionByName(more).orderBy(*by_similarity()).limit(k)

    @staticmethod
    def _top(vectors: DataFrame, reference: list[float], k: int, exclude: int | None, allowed: DataFrame | None) -> DataFrame:
        scored = nearest(vectors, reference, exclude)
        scored = scored if allowed is None else scored.join(allowed.select("id"), "id", "left_semi")
        return scored.orderBy(*by_similarity()).limit(k)


# ---- the neighbours of every vector -------------------------------------------------------------------------------


def nearest_for_all(vectors: DataFrame, k: int = 10, tile_rows: int = 65_536, asked: DataFrame | None = None) -> DataFrame:
    """(id, rank, neighbour, similarity): the k nearest other vectors of each vector, or of the rows ``asked`` for.

    Rows are dealt by hash to parts of about ``tile_rows``; a task compares one part's rows with another's, one tile of the grid, and hands on k
    rows for each. A vector is copied once per part of the other side, and a side is cut into ``MOST_PARTS`` at most until its parts reach ``LARGEST_PART`` rows: up to there what is
    shuffled grows as the vectors do. The arithmetic is that of all pairs; for large tables that need not be exact there is ``approximate_for_many``.
    """
    sought = vectors if asked is None else asked
    rows, columns = _parts_of(sought.count(), tile_rows), _parts_of(vectors.count(), tile_rows)

    def dealt(side: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias(own)
        copies = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
        kept = side.filter(has_direction(F.col("embedding")))
        # Spread by number: tiles are few bytes and much work, so they are not to be put together by their size. Aliases keep sides of one table apart.
        copied = kept.select(F.col("id").alias("id"), F.col("embedding").alias("embedding"), part, copies)
        return copied.repartition(2 * rows * columns, "row", "column").groupBy("row", "column")

    tiles = dealt(sought, "row", rows, "column", columns).cogroup(dealt(vectors, "column", columns, "row", rows)).applyInArrow(_visit(k), RANKED)
    return _ranked(tiles, k)


def _parts_of(count: int, part_rows: int) -> int:
    return max(1, min(math.ceil(count / part_rows), max(MOST_PARTS, math.ceil(count / max(part_rows, LARGEST_PART)))))


def approximate_for_many(index: VectorIndex, references: DataFrame, k: int = 10, probes: int | None = None, part_rows: int = 65_536) -> DataFrame:
    """(id, rank, neighbour, similarity) of each reference (id, embedding) among the vectors of its ``probes`` nearest cells, by default 13 of 16 of the cells.

    More probes find more true neighbours (on vectors with little structure the default finds 0.94 of them; ``quantized`` reads far less); measure the recall against ``nearest_for_all``. Large cells
    are split into parts, each compared in a task of its own.
    """
    pivots = index.pivots
    probes = math.ceil(len(pivots) * 13 / 16) if probes is None else probes

    @F.arrow_udf("array<int>")
    def cells(column: pa.Array) -> pa.Array:
        dist = _distances(unit_rows(matrix_of(column, pivots.shape[1])), pivots)
        return pa.array(np.argsort(dist, axis=1, kind="stable")[:, :probes].astype(np.int32).tolist(), pa.list_(pa.int32()))

    counts = [(cell, max(1, math.ceil(rows / part_rows))) for cell, rows, _ in index.cells]
    spark = index.vectors.sparkSession
    if not counts:
        return spark.createDataFrame([], "id bigint, rank int, neighbour bigint, similarity double")
    sizes = F.broadcast(spark.createDataFrame(counts, "cell int, parts int"))  # a row per pivot
    # Aliases keep the two sides apart where they come from one table.
    asked = references.filter(has_direction(F.col("embedding"))).select(F.col("id").alias("id"), F.col("embedding").alias("embedding"), F.explode(cells.asNondeterministic()("embedding")).alias("cell"))
    asked = asked.join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    held = index.vectors.filter("cell >= 0").join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("id", "embedding", "cell", "part")
    pairs = asked.groupBy("cell", "part").cogroup(held.groupBy("cell", "part")).applyInArrow(_visit(k), RANKED)
    return _ranked(pairs, k)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "neighbour", "similarity")


def _top_k(ids: np.ndarray, unit: np.ndarray, other_ids: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row index, neighbour and similarity of each row's best k others; ``other_ids`` must ascend.

    Products in single precision, with a bound on their error, say which pairs can be among a row's best so far; those are scored in double precision.
    """
    slack = np.float32((unit.shape[1] + 16) * 2.0**-22)
    unit32, other32 = unit.astype(np.float32), other.astype(np.float32)
    own, own_end = np.searchsorted(other_ids, ids), np.searchsorted(other_ids, ids, "right")
    rows, picks, scores = [], [], []
    for start in range(0, len(ids), BLOCK):
        block = slice(start, min(start + BLOCK, len(ids)))
        size = block.stop - start
        best_row, best_col, best_score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor = np.full(size, -np.inf, np.float32)
        for left in range(0, len(other), CHUNK):
            estimate = unit32[block] @ other32[left:left + CHUNK].T
            width = estimate.shape[1]
            for i in np.flatnonzero((own_end[block] > left) & (own[block] < left + width) & (own[block] < own_end[block])):
                estimate[i, max(own[start + i] - left, 0):own_end[start + i] - left] = -np.inf  # the row itself
            if left == 0 and width > k:
                floor = np.partition(estimate, width - k, axis=1)[:, width - k]
            hits = np.flatnonzero((estimate >= (floor - slack)[:, None]) & (estimate > -np.inf))
            row, col = hits // width, hits % width
            if len(hits) > estimate.size // 32:  # large groups of equal vectors
                score = np.round(unit[block] @ other[left:left + CHUNK].T, DIGITS).ravel()[hits]
            else:
                score = np.round(np.einsum("ij,ij->i", unit[block][row], other[left:left + CHUNK][col]), DIGITS)
            row, col, score = np.append(best_row, row), np.append(best_col, col + left), np.append(best_score, score)
            order = np.lexsort((col, -score, row))
            place = np.arange(len(row)) - np.searchsorted(row[order], row[order])
            order = order[place < k]
            best_row, best_col, best_score = row[order], col[order], score[order]
            last = np.flatnonzero(place[place < k] == k - 1)
            floor = np.full(size, -np.inf, np.float32)
            floor[best_row[last]] = best_score[last]
        rows.append(best_row + start)
        picks.append(other_ids[best_col])
        scores.append(best_score)
    return np.concatenate(rows), np.concatenate(picks), np.concatenate(scores)


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in ascending order with their unit vectors."""
    ids = table.column("id").to_numpy()
    column = table.column("embedding").combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    unit = unit_rows(matrix_of(column, len(column[0])))
    order = np.argsort(ids, kind="stable")
    return ids[order], unit[order]


def _visit(k: int):
    def run(visitors: pa.Table, residents: pa.Table) -> pa.Table:
        if visitors.num_rows == 0 or residents.num_rows == 0:
            return pa.table({"id": pa.array([], pa.int64()), "neighbour": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        ids, unit = _unpack(visitors)
        row, neighbour, score = _top_k(ids, unit, *_unpack(residents), k)
        return pa.table({"id": ids[row], "neighbour": neighbour, "similarity": score})

    return run


def shared_index(vectors: DataFrame, cells: int = 256) -> VectorIndex:
    """An index stored in the cluster's shared folder."""
    spark: SparkSession = vectors.sparkSession
    return VectorIndex.build(vectors, fresh_path(spark, "vector-index"), cells)
