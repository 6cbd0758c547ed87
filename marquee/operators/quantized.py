"""Approximate nearest neighbours over product-quantised codes, re-ranked exactly.

A unit vector is cut into subspaces of ``WIDTH`` coordinates, and each part is replaced by the number of the nearest of 256 centroids: one byte for ``WIDTH``
floats. A search scans the codes of all vectors, so it needs no cells that might hide a neighbour, estimates each similarity from the centroids, keeps the ``candidates`` best of each
query and compares only those with the stored vectors. With 4 coordinates a byte the scan reads a sixteenth of the bytes of the vectors.

The codebooks are trained on at most ``SAMPLE_ROWS`` vectors, chosen by the hash of their ids; every vector is coded. Vectors without direction (zero) and
null vectors have no code and are nobody's neighbours. Measure the recall on some queries against ``neighbours.nearest_for_all`` with ``recall``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.vectors import has_direction, matrix_of, unit_rows
from marquee.operators.neighbours import DIGITS, by_similarity
from marquee.session import fresh_path

WIDTH = 4
CENTROIDS = 256
SAMPLE_ROWS = 20_000
ROUNDS = 12
CANDIDATES = 80
CODE_ROWS = 65_536
QUERY_ROWS = 512
FOUND = "id bigint, neighbour bigint, estimate float"


def _parts(unit: np.ndarray) -> np.ndarray:
    """(subspaces, rows, WIDTH), the last subspace padded with zeros."""
    missing = -unit.shape[1] % WIDTH
    padded = np.pad(unit, ((0, 0), (0, missing)))
    return np.ascontiguousarray(padded.reshape(len(unit), -1, WIDTH).transpose(1, 0, 2))


def _nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centroid."""
    half = np.einsum("ij,ij->i", centroids, centroids) / 2
    return np.concatenate([np.argmax(rows[i: i + 8192] @ centroids.T - half, axis=1) for i in range(0, len(rows), 8192)]) if len(rows) else np.zeros(0, np.int64)


def k_means(rows: np.ndarray, seed: int) -> np.ndarray:
    """256 centroids by Lloyd's rounds; centroids that lose all rows move to the rows that are worst served."""
    rng = np.random.default_rng(seed)
    centroids = rows[rng.choice(len(rows), CENTROIDS, replace=len(rows) < CENTROIDS)].copy()
    for _ in range(ROUNDS):
        own = _nearest(rows, centroids)
        counts = np.bincount(own, minlength=CENTROIDS)
        sums = np.stack([np.bincount(own, rows[:, j], CENTROIDS) for j in range(rows.shape[1])], axis=1)
        centroids = sums / np.maximum(counts, 1)[:, None]
        lost = np.flatnonzero(counts == 0)
        if len(lost):
            worst = np.argsort(-np.square(rows - centroids[own]).sum(axis=1), kind="stable")
            centroids[lost] = rows[worst[np.arange(len(lost)) % len(rows)]]
    return centroids


def with_direction(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("id").isNotNull() & has_direction(F.col("embedding"))).select("id", "embedding")


def train(vectors: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Codebooks (subspaces, 256, WIDTH), each trained in a task of its own on the same sample of bounded size."""
    sample = with_direction(vectors).orderBy(F.xxhash64("id"), "id").limit(sample_rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                column = batch.column("embedding")
                parts = _parts(unit_rows(matrix_of(column, len(column[0]))))
                subspace = np.repeat(np.arange(len(parts)), len(batch)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(subspace), pa.array(parts.reshape(-1, WIDTH).tolist(), pa.list_(pa.float64()))], names=["subspace", "part"])

    def learn(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        rows = np.asarray(table.column("part").combine_chunks().flatten()).reshape(-1, WIDTH)
        rows = rows[np.lexsort(rows.T)]  # whatever order the shuffle brought them in
        return pa.table({"subspace": pa.array([number], pa.int32()), "centroids": pa.array([k_means(rows, number).ravel().tolist()], pa.list_(pa.float64()))})

    parts = sample.mapInArrow(cut, "subspace int, part array<double>")
    books = parts.groupBy("subspace").applyInArrow(learn, "subspace int, centroids array<double>").collect()  # one row per subspace
    return np.array([r["centroids"] for r in sorted(books, key=lambda r: r["subspace"])]).reshape(-1, CENTROIDS, WIDTH)


def decoded(codes: pa.Array | pa.ChunkedArray, books: np.ndarray) -> np.ndarray:
    """What the codes stand for, as approximate unit vectors."""
    raw = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, len(books))
    return np.concatenate([book[raw[:, i]] for i, book in enumerate(books.astype(np.float32))], axis=1)


@dataclass(frozen=True)
class QuantizedIndex:
    """codes: id and code (a byte per subspace) of every vector with direction. vectors: the stored vectors, for re-ranking. count: how many codes."""

    codes: DataFrame
    vectors: DataFrame
    books: np.ndarray
    count: int

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, sample_rows: int = SAMPLE_ROWS) -> QuantizedIndex:
        """Train on a sample, code every vector and store codes and vectors, the latter sorted by id so that a few of them are found by row group."""
        spark = vectors.sparkSession
        books = train(vectors, sample_rows)
        path = path or fresh_path(spark, "quantized")
        kept = with_direction(vectors)
        shared = spark.sparkContext.broadcast(books)

        @F.arrow_udf("binary")
        def code(column: pa.Array) -> pa.Array:
            if not len(column):
                return pa.array([], pa.binary())
            parts = _parts(unit_rows(matrix_of(column, len(column[0]))))
            codes = np.stack([_nearest(rows, book) for rows, book in zip(parts, shared.value)], axis=1).astype(np.uint8)
            return pa.array([c.tobytes() for c in codes], pa.binary())

        kept.select("id", code("embedding").alias("code")).write.parquet(f"{path}/codes")
        kept.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/vectors")
        codes = spark.read.schema("id bigint, code binary").parquet(f"{path}/codes")
        return cls(codes, spark.read.schema("id bigint, embedding array<float>").parquet(f"{path}/vectors"), books, codes.count())

    def search(self, reference: list[float], k: int = 10, exclude: int | None = None, candidates: int = CANDIDATES) -> DataFrame:
        """(id, similarity) of the k best of ``candidates`` vectors, which the codes put first; similarities are exact."""
        unit = unit_rows(np.asarray([reference], np.float64))
        if not self.count or np.isnan(unit).any():
            return self.vectors.limit(0).select("id", F.lit(0.0).alias("similarity"))
        asked = _parts(unit)[:, 0, :].astype(np.float32).ravel()
        books = self.books

        @F.arrow_udf("float")
        def estimate(codes: pa.Array) -> pa.Array:
            return pa.array(decoded(codes, books) @ asked if len(codes) else [], pa.float32())

        others = self.codes if exclude is None else self.codes.filter(F.col("id") != exclude)
        best = [r["id"] for r in others.select("id", estimate("code").alias("estimate")).orderBy(F.desc("estimate"), "id").limit(candidates).collect()]
        target = unit[0]

        @F.arrow_udf("double")
        def exact(column: pa.Array) -> pa.Array:
            return pa.array(np.round(unit_rows(matrix_of(column, len(target))) @ target, DIGITS) if len(column) else [], pa.float64())

        # Ids within the range of a row group reach the scan, so few of the vectors are read.
        near = self.vectors.filter(F.col("id").isin(best))
        return near.select("id", exact("embedding").alias("similarity")).orderBy(*by_similarity()).limit(k)

    def search_many(self, references: DataFrame, k: int = 10, candidates: int = CANDIDATES, code_rows: int = CODE_ROWS) -> DataFrame:
        """(id, rank, neighbour, similarity) for each reference (id, embedding), itself left out by its id.

        Codes and references are dealt to parts of bounded size; a task multiplies one part's references with what one part's codes stand for and hands on ``candidates`` rows
        for each reference. The best of them meet their vectors.
        """
        spark = references.sparkSession
        asked = with_direction(references)
        parts, groups = max(1, math.ceil(self.count / code_rows)), max(1, math.ceil(references.count() / QUERY_ROWS))
        own = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
        copies = self.codes.withColumn("part", own).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        sought = asked.select(F.col("id").alias("id"), F.col("embedding").alias("embedding")).withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
        sought = sought.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        shared = spark.sparkContext.broadcast(self.books)

        def meet(codes: pa.Table, queries: pa.Table) -> pa.Table:
            rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if len(codes) and len(queries):
                ids, column = codes.column("id").to_numpy(), queries.column("embedding").combine_chunks()
                units = _parts(unit_rows(matrix_of(column, len(column[0])))).transpose(1, 0, 2).reshape(len(column), -1).astype(np.float32)
                scores = units @ decoded(codes.column("code"), shared.value).T
                for query, line in zip(queries.column("id").to_pylist(), scores):
                    line = np.where(ids == query, -np.inf, line)
                    some = np.argpartition(-line, candidates)[:candidates] if len(line) > candidates else np.arange(len(line))
                    some = some[line[some] > -np.inf]
                    rows.append((np.full(len(some), query), ids[some], line[some]))
            columns = [np.concatenate(c) if rows else np.zeros(0) for c in (zip(*rows) if rows else [()] * 3)]
            return pa.table([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.float32))], names=["id", "neighbour", "estimate"])

        met = copies.groupBy("part", "group").cogroup(sought.groupBy("part", "group")).applyInArrow(meet, FOUND)
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("estimate"), "neighbour"))
        near = met.withColumn("_place", place).filter(F.col("_place") <= candidates).select("id", "neighbour")

        @F.arrow_udf("double")
        def exact(a: pa.Array, b: pa.Array) -> pa.Array:
            if not len(a):
                return pa.array([], pa.float64())
            x, y = (unit_rows(matrix_of(c, len(a[0]))) for c in (a, b))
            return pa.array(np.round(np.einsum("ij,ij->i", x, y), DIGITS), pa.float64())

        held = self.vectors.select(F.col("id").alias("neighbour"), F.col("embedding").alias("_held"))
        given = asked.select(F.col("id").alias("id"), F.col("embedding").alias("_given"))
        scored = near.join(held, "neighbour").join(given, "id").select("id", "neighbour", exact("_given", "_held").alias("similarity"))
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
        return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "neighbour", "similarity")

    def bytes_read(self, candidates: int = CANDIDATES) -> float:
        """The bytes one query reads, all codes and the candidates' vectors, as a share of the bytes of all vectors."""
        width = 4 * self.books.shape[0] * WIDTH
        return (self.count * self.books.shape[0] + min(candidates, self.count) * width) / max(1, self.count * width)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, wanted, found, recall): how many of the exact neighbours (id, neighbour) of the same queries were found."""
    near = found.select("id", "neighbour", F.lit(1).alias("_hit"))
    met = exact.select("id", "neighbour").join(near, ["id", "neighbour"], "left")
    return met.agg(F.count_distinct("id").alias("queries"), F.count("*").alias("wanted"), F.count("_hit").alias("found"), (F.count("_hit") / F.count("*")).alias("recall"))
