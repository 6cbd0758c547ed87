"""Exact top-k inner products by norm buckets.

Vectors are grouped by length in classes of a fixed ratio, and large classes cut into slices of bounded size. A query's k-th
best product over one slice of the longest vectors is a lower bound of its true k-th best, its threshold. A query goes only to
classes where its norm times the longest length reaches the threshold. There the threshold, divided by both lengths, is a cosine:
if it is low, only length prunes (the slice is sorted by length, a prefix remains); if it is high, coordinates prune too: on the query's
largest coordinates, a candidate's normalised ones must lie in the interval that a cosine that high allows. Whatever remains is verified with
exact integer products, and the threshold rises as results come in. Each slice gives k rows a query at most, which a second step merges.

Queries are dealt to parts of bounded size, so a task holds one slice and one part. Only the counts of the length classes and the one
slice of bounded size reach the driver.

Products are exact for every length: integers are kept in doubles, which hold them exactly; a query and a slice are multiplied in doubles if the product of their lengths is below 2**53, in
longs if it is below 2**63, and else in Python's integers, for the candidates that a product in doubles leaves. A result that a long cannot hold is an error that names the query.

Edge cases: vectors that are null, hold null or non-finite components (also after the multiplication by 256) or have no id take no part; vectors are compared with those of
equal dimension; a repeated id is a row of its own and a candidate for its twin; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.llm.common import bounded_batches, stored

SCALE = 256.0
CLASSES_PER_DOUBLING = 8
SLICE_ROWS = 8192
PART_QUERIES = 16384
#: Local cosine thresholds from which coordinates are looked at before products.
COORDINATE_COSINE = 0.5
FOCUS = 4
EXACT_IN_DOUBLE, EXACT_IN_LONG = 2.0**53, 2.0**63


def _floor(c: Column) -> Column:
    """floor(256 * c) as a double; numbers beyond 2**52 are whole already, and beyond a long ``F.floor`` cannot hold them."""
    scaled = c.cast("double") * SCALE
    return F.when(F.abs(scaled) < 2.0**52, F.floor(scaled).cast("double")).otherwise(scaled)


def scaled_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row (unique), vec_id, v (floor of 256 times each component), dim, norm and length class of the vectors that take part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < float("inf")))
    whole = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.transform(x, _floor).alias("v"))
    largest = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))  # squares of parts of it neither overflow nor vanish
    norm = F.when(largest > 0, largest * F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, c: total + (c / largest) * (c / largest)))).otherwise(F.lit(0.0))
    ranked = whole.withColumn("norm", norm)
    length_class = F.when(F.col("norm") > 0, F.ceil(F.log2("norm") * CLASSES_PER_DOUBLING)).otherwise(F.lit(-1)).cast("int")
    return ranked.select("row", "vec_id", "v", F.size("v").alias("dim"), "norm", length_class.alias("class"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), dim)


class Slice:
    """Candidates of one length class, longest first."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, norms: np.ndarray):
        order = np.argsort(-norms, kind="stable")
        self.rows, self.ids, self.norms = rows[order], ids[order], norms[order]
        self.v = v[order]
        self.unit = (v[order] / np.maximum(norms[order], 1e-300)[:, None]).T.copy()

    def survivors(self, q: np.ndarray, norm: float, threshold: float) -> np.ndarray | slice:
        """The candidates that may reach the threshold."""
        if not len(self.norms) or norm == 0 or threshold <= 0:
            return slice(0, len(self.norms))
        count = int(np.searchsorted(-self.norms, -(threshold / norm) * (1 - 1e-9), "right"))
        if not count:
            return slice(0, 0)
        cosine = threshold / (norm * self.norms[0]) * (1 - 1e-9)
        if cosine < COORDINATE_COSINE:
            return slice(0, count)
        unit = q / norm
        keep = np.ones(count, bool)
        # Two unit vectors at an angle of at most d have, in every coordinate, arc cosines at most d apart.
        angle = np.arccos(min(cosine, 1.0))
        for f in np.argsort(-np.abs(unit))[:FOCUS].tolist():
            middle = np.arccos(np.clip(unit[f], -1.0, 1.0))
            low, high = np.cos(min(np.pi, middle + angle)) - 1e-9, np.cos(max(0.0, middle - angle)) + 1e-9
            keep &= (self.unit[f, :count] >= low) & (self.unit[f, :count] <= high)
        return np.flatnonzero(keep)

    def top(self, q: np.ndarray, norm: float, row: int, threshold: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best that reach the threshold, the query's own row left out."""
        some = self.survivors(q, norm, threshold)
        others = self.rows[some] != row
        v, ids = self.v[some][others], self.ids[some][others]
        reach = norm * self.norms[0] * (1 + 1e-9) if len(self.norms) else 0.0
        if reach < EXACT_IN_DOUBLE:
            scores = (v @ q).astype(np.int64)
        elif reach < EXACT_IN_LONG and norm > 0:
            scores = v.astype(np.int64) @ q.astype(np.int64)
        else:
            longest = max(self.norms[0], 1.0) if len(self.norms) else 1.0
            rough, slack = (v / longest) @ (q / max(norm, 1.0)), len(q) * 2.0**-50
            least = np.partition(rough, len(rough) - k)[len(rough) - k] if len(rough) > k else -np.inf
            near = rough >= max(least - 2 * slack, threshold / longest / max(norm, 1.0) - slack)
            exact = [int(x) for x in q]
            scores = np.array([sum(a * int(b) for a, b in zip(exact, c)) for c in v[near]], object)
            ids = ids[near]
        # Longs are compared with a bound that was rounded down, so rounding them cannot lose one.
        fit = np.array([s >= threshold for s in scores], bool) if scores.dtype == object else scores >= threshold
        scores, ids = scores[fit], ids[fit]
        if len(scores) > 4 * k and scores.dtype != object:
            bound = np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, ids = scores[scores >= bound], ids[scores >= bound]
        order = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int) if scores.dtype == object else np.lexsort((ids, -scores))[:k]
        return scores[order], ids[order]


def rounded_down(score: int) -> float:
    """The largest double up to an integer."""
    near = float(score)
    return near if near <= score else float(np.nextafter(near, -np.inf))


def in_longs(score: int) -> tuple[int, int]:
    """A score, and 0, or the nearest long, and 1 or -1 for the side on which it does not fit."""
    low, high = -(1 << 63), (1 << 63) - 1
    return min(max(score, low), high), (score > high) - (score < low)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates. ``is_query`` reads the column ``vec_id``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    all_rows = stored(scaled_vectors(vectors, id_col, vector_col), "topk-vectors")
    classes = all_rows.groupBy("dim", "class").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).collect()  # bounded by the range of lengths
    result = "query_row long, query_id long, vec_id long, score long, beyond long"
    if not classes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    table = [(c["dim"], c["class"], -(-c["n"] // SLICE_ROWS), c["top"]) for c in classes]
    slices = spark.createDataFrame(table, "dim int, class int, slices long, top double")
    dealt = all_rows.join(F.broadcast(slices), ["dim", "class"]).withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int"))
    queries = all_rows.where(is_query)
    parts = max(1, -(-queries.count() // PART_QUERIES))

    # Thresholds, from one slice of the longest vectors of each dimension.
    longest: dict[int, tuple] = {}
    for dim, length_class, count, top in table:
        if dim not in longest or top > longest[dim][2]:
            longest[dim] = (length_class, count, top)
    first = F.lit(False)
    for dim, (length_class, _, _) in longest.items():
        first = first | ((F.col("dim") == dim) & (F.col("class") == length_class) & (F.col("slice") == 0))
    seeds: dict[int, list] = {}
    for r in dealt.where(first).select("dim", "row", "vec_id", "v", "norm").limit(2 * SLICE_ROWS).collect():
        seeds.setdefault(r.dim, []).append(r)
    seeded = spark.sparkContext.broadcast({d: (np.array([r.row for r in rs]), np.array([r.vec_id for r in rs]), np.array([r.v for r in rs], np.float64).reshape(len(rs), d), np.array([r.norm for r in rs])) for d, rs in seeds.items()})
    bounds = {}
    for dim, length_class, count, top in table:
        bounds.setdefault(dim, []).append((length_class, count, top))
    reach_schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("dim", pa.int32()), ("norm", pa.float64()), ("threshold", pa.float64()), ("class", pa.int32()), ("slice", pa.int32())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for every slice that may hold one of its best."""
        ready = {d: Slice(*x) for d, x in seeded.value.items()}
        for batch in batches:
            at, thresholds, cls, cut = [], [], [], []
            for i, (row, q, dim, norm) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "v", "dim", "norm")))):
                scores = ready[dim].top(np.array(q, np.float64), norm, row, -np.inf, k)[0] if dim in ready else []
                threshold = rounded_down(int(scores[-1])) if len(scores) == k else -np.inf
                for length_class, count, top in bounds[dim]:
                    if norm * top * (1 + 1e-9) >= threshold:
                        at += [i] * count
                        thresholds += [threshold] * count
                        cls += [length_class] * count
                        cut += range(count)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c).cast(reach_schema.field(c).type) for c in ("row", "vec_id", "v", "dim", "norm")), pa.array(thresholds, pa.float64()), pa.array(cls, pa.int32()), pa.array(cut, pa.int32())], schema=reach_schema)

    part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    routed = queries.select("row", "vec_id", "v", "dim", "norm").repartition(spark.sparkContext.defaultParallelism).mapInArrow(
        route, "row long, vec_id long, v array<double>, dim int, norm double, threshold double, class int, slice int").withColumn("part", part)
    copies = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(candidates: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(candidates) and len(asked):
            dim = asked.column("dim")[0].as_py()
            here = Slice(*(np.asarray(candidates.column(c)) for c in ("row", "vec_id")), matrix(candidates.column("v"), dim), np.asarray(candidates.column("norm")))
            for q, norm, row, own, threshold in zip(matrix(asked.column("v"), dim), *(asked.column(c).to_pylist() for c in ("norm", "row", "vec_id", "threshold"))):
                scores, ids = here.top(q, norm, row, threshold, k)
                found += [(row, own, i, *in_longs(int(s))) for s, i in zip(scores.tolist(), ids.tolist())]
        columns = zip(*found) if found else [()] * 5
        return pa.table([pa.array(list(x), pa.int64()) for x in columns], names=["query_row", "query_id", "vec_id", "score", "beyond"])

    keys = ["dim", "class", "slice", "part"]
    near = copies.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(meet, result)
    best = Window.partitionBy("query_row").orderBy(F.desc("beyond"), F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    score = F.when(F.col("beyond") == 0, F.col("score")).otherwise(F.raise_error(F.concat(F.lit("no long holds a score of query "), F.col("query_id").cast("string"))))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


def op7_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every query among all vectors."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


SQL = """
with whole as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from whole q join whole c on q.r <> c.r where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as nth from scored
)
select query_id, nth::int as rank, vec_id, score from ranked where nth <= 5
"""
