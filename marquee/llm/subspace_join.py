"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine t have the squared distance 2 - 2t. The vectors are turned by a fixed random rotation and cut into blocks of ``BLOCK`` coordinates; if every block of a pair
exceeded its share of the squared distance, in proportion to its width, the whole would exceed the sum. So each linked pair is within the budget in at least one block.

1. Equal vectors are one class with its number of rows. Rotated unit vectors are stored as 16-bit integers: that is what is shuffled, and all decisions on them are exact.
2. In each block there is a range join: strips along the block's first coordinate are as wide as the block's radius, so partners lie in the same strip or the next. Strips are cut
   into slices of about ``SLICE_ROWS`` by hash, and a task gets one slice and one slice of its own and the next strip. There the second coordinate narrows the range, block distances follow from
   a matrix product.
3. The union of candidates: a pair counts in the first block in which it is within the budget, which both vectors' integers tell exactly in any task; nothing is emitted to find duplicates.
   Candidates are verified by their whole distance. Rounding to integers leaves a narrow band around the threshold; pairs in it (only these leave the task as pairs)
   meet their vectors again and are decided by the cosine in double precision.
4. A task hands on, for each vector, its number of links and one vector it is connected with, not its pairs; so a group of near copies costs arithmetic, but no row per pair.
   Connected components follow from those edges.

To the driver come the sizes of strips: at most 2 / radius + 1 for each block, whatever the number of vectors.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows without an id, link with nothing (n_links 0, their own component; without an id, a null one,
not kept); vectors are compared with those of equal dimension; repeated rows and ids are rows of their own and count as others, also if their ids are equal; vectors of any length are scaled by
powers of two first, so squares neither overflow nor vanish; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import bounded_batches, mixed, stored
from marquee.llm.graph import components

BLOCK = 8
SLICE_ROWS = 16_384
CHUNK_ROWS = 256
ONE = 32767
SEED = 11
#: Rounding of a matrix product in single precision, as a squared distance.
FLOAT_SLACK = 1e-5

CLASSES = "cls long, n long, dim int, turned binary"
ROUTED = "dim int, block int, strip int, home int, guest int, is_guest boolean, own boolean, cls long, n long, turned binary"
FOUND = "cls long, links long, peer long, sure boolean"


@cache
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Budget:
    """What a threshold allows in each block of vectors of one dimension."""

    def __init__(self, dim: int, threshold: float):
        self.starts = np.arange(0, dim, BLOCK)
        self.widths = np.diff(np.append(self.starts, dim))
        self.chord = math.sqrt(max(0.0, 2 - 2 * threshold))
        #: Each rounded vector is at most half a step per coordinate away from the true one.
        self.slack = 1.01 * math.sqrt(dim) / ONE + FLOAT_SLACK
        self.squares = (self.chord + self.slack) ** 2 * self.widths / dim
        self.radii = np.sqrt(self.squares) * (1 + 1e-9)
        self.whole = np.floor(self.squares * ONE * ONE).astype(np.int64)

    def strips(self, turned: np.ndarray, block: int) -> np.ndarray:
        return np.floor(turned[:, self.starts[block]] / (self.radii[block] * ONE)).astype(np.int64)

    def first_block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first block in which each pair is within the budget, in integers."""
        gap = a.astype(np.int64) - b
        within = np.add.reduceat(gap * gap, self.starts, axis=1) <= self.whole
        return np.where(within.any(axis=1), within.argmax(axis=1), len(self.starts))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    x = F.col(vector_col)
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & fit).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))


def unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors in doubles."""
    scaled = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def _doubles(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(v, np.float64) for v in column.to_numpy(zero_copy_only=False)]


def rotated(classes: DataFrame) -> DataFrame:
    """cls, n, dim and the rotated unit vector as 16-bit integers."""
    schema = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("dim", pa.int32()), ("turned", pa.binary())])

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _doubles(batch.column("v"))
            made: list = [None] * len(rows)
            dims = np.array([len(r) for r in rows], np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                turned = np.rint(unit(np.stack([rows[i] for i in at])) @ rotation(dim) * ONE).astype(np.int16)
                for i, vector in zip(at.tolist(), turned):
                    made[i] = vector.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), pa.array(dims), pa.array(made, pa.binary())], schema=schema)

    return classes.select("cls", "n", "v").mapInArrow(turn, CLASSES)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dim, row numbers and integer vectors."""
    dims = np.asarray(batch.column("dim"))
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, np.frombuffer(b"".join(batch.column("turned").take(pa.array(at)).to_pylist()), np.int16).reshape(-1, dim)


def strip_sizes(turned: DataFrame, threshold: float) -> dict[int, list[dict[int, int]]]:
    """For each dimension and block, the slices of each strip that has vectors."""
    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for dim, _, vectors in _by_dim(batch):
                budget = Budget(dim, threshold)
                for block in range(len(budget.starts)):
                    out += [(dim, block, s, n) for s, n in zip(*(x.tolist() for x in np.unique(budget.strips(vectors, block), return_counts=True)))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 4, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["dim", "block", "strip", "n"])

    counts = turned.select("dim", "turned").mapInArrow(strips, "dim int, block int, strip int, n long").groupBy("dim", "block", "strip").agg(F.sum("n").alias("n"))
    sizes: dict[int, list[dict[int, int]]] = {}
    for dim, block, strip, n in counts.collect():  # bounded by the radius, see above
        per_block = sizes.setdefault(dim, [{} for _ in range(-(-dim // BLOCK))])
        per_block[block][strip] = -(-n // SLICE_ROWS)
    return sizes


def routed(turned: DataFrame, sizes: dict[int, list[dict[int, int]]], threshold: float) -> DataFrame:
    """Each vector once for every task that needs it: at home with its slice, as a guest in its own strip's other slices and the strip before."""
    shared = turned.sparkSession.sparkContext.broadcast(sizes)
    keys = [("dim", pa.int32()), ("block", pa.int32()), ("strip", pa.int32()), ("home", pa.int32()), ("guest", pa.int32()), ("is_guest", pa.bool_()), ("own", pa.bool_())]
    schema = pa.schema([*keys, ("cls", pa.int64()), ("n", pa.int64()), ("turned", pa.binary())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = mixed(np.asarray(batch.column("cls")).astype(np.uint64))
            for dim, at, vectors in _by_dim(batch):
                budget = Budget(dim, threshold)
                for block, slices in enumerate(shared.value[dim]):
                    strips = budget.strips(vectors, block)
                    rows, made = [], []
                    for strip in np.unique(strips).tolist():
                        here = at[strips == strip]
                        own, before, after = slices[strip], slices.get(strip - 1, 0), slices.get(strip + 1, 0)
                        part = (hashed[here] % np.uint64(own)).astype(np.int64)
                        # (strip, home slice, guest slice, is_guest, own strip) for all rows of this strip
                        for guest in range(max(own, after)):
                            keep = (guest > part) | (guest < after) | (guest == part)
                            rows.append(here[keep])
                            made.append(np.column_stack([np.full(keep.sum(), strip), part[keep], np.full(keep.sum(), guest), np.zeros((keep.sum(), 2), np.int64)]))
                        for home in range(own):
                            keep = home < part
                            rows.append(here[keep])
                            made.append(np.column_stack([np.full(keep.sum(), strip), np.full(keep.sum(), home), part[keep], np.ones((keep.sum(), 2), np.int64)]))
                        for home in range(before):
                            rows.append(here)
                            made.append(np.column_stack([np.full(len(here), strip - 1), np.full(len(here), home), part, np.ones(len(here), np.int64), np.zeros(len(here), np.int64)]))
                    taken, columns = batch.take(pa.array(np.concatenate(rows))), np.concatenate(made)
                    count = len(columns)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(count, dim, np.int32)), pa.array(np.full(count, block, np.int32)), *(pa.array(columns[:, i].astype(np.int32)) for i in range(3)),
                         *(pa.array(columns[:, i].astype(bool)) for i in (3, 4)), taken.column("cls"), taken.column("n"), taken.column("turned")], schema=schema)

    return turned.mapInArrow(route, ROUTED)


def hooked(parents: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Parents (all pointing at roots) after the ends of the given edges have been joined under their smaller roots."""
    while True:
        a, b = parents[a], parents[b]
        apart = a != b
        if not apart.any():
            return parents
        a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        np.minimum.at(parents, b, a)
        while (up := parents[parents]).tobytes() != parents.tobytes():
            parents = up


def _meet(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim, block, same = key[0].as_py(), key[1].as_py(), key[3].as_py() == key[4].as_py()
        budget = Budget(dim, threshold)
        cls, weight = np.asarray(table.column("cls")), np.asarray(table.column("n"))
        turned = np.frombuffer(b"".join(table.column("turned").to_pylist()), np.int16).reshape(-1, dim)
        is_guest, own = (np.asarray(table.column(c).combine_chunks().to_numpy(zero_copy_only=False)) for c in ("is_guest", "own"))
        homes = np.flatnonzero(~is_guest)
        guests = np.concatenate([np.flatnonzero(is_guest), homes]) if same else np.flatnonzero(is_guest)
        # In a slice's own task its rows are guests too; of two such rows the first is the host.
        own_slice = np.concatenate([np.zeros(is_guest.sum(), bool), np.ones(len(homes), bool)]) if same else np.zeros(len(guests), bool)
        unit_ = turned.astype(np.float32) / np.float32(ONE)
        start, width = int(budget.starts[block]), int(budget.widths[block])
        narrow = start + min(1, width - 1)
        order = np.argsort(turned[guests, narrow], kind="stable")
        guests, own_slice = guests[order], own_slice[order]
        homes = homes[np.argsort(turned[homes, narrow], kind="stable")]
        along, radius = turned[guests, narrow].astype(np.float64), budget.radii[block] * ONE

        @cache
        def sides(first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
            """Rows whose matrix product is the squared distance in some coordinates."""
            x = unit_[:, first: first + count]
            square, one = np.einsum("ij,ij->i", x, x)[:, None], np.ones((len(x), 1), np.float32)
            return np.hstack([-2 * x, square, one]), np.hstack([x, one, square])

        def gaps(of: np.ndarray, to: np.ndarray, first: int, count: int) -> np.ndarray:
            hosts, guests_ = sides(first, count)
            return hosts[of] @ guests_[to].T

        links, parents = np.zeros(len(cls), np.int64), np.arange(len(cls))
        near: list[np.ndarray] = []
        for low in range(0, len(homes), CHUNK_ROWS):
            host = homes[low: low + CHUNK_ROWS]
            left, right = np.searchsorted(along, turned[host[0], narrow] - radius), np.searchsorted(along, turned[host[-1], narrow] + radius, "right")
            guest = guests[left:right]
            if not len(guest):
                continue
            maybe = gaps(host, guest, start, width) <= budget.squares[block] + FLOAT_SLACK
            if own_slice[left:right].any():
                maybe &= ~own_slice[left:right][None, :] | (cls[host][:, None] < cls[guest][None, :])
            if block and maybe.sum() > maybe.size // 50:
                for earlier in range(block):  # groups of near copies were met in the first block
                    maybe &= gaps(host, guest, int(budget.starts[earlier]), int(budget.widths[earlier])) > budget.squares[earlier] - FLOAT_SLACK
            h, g = np.nonzero(maybe)
            if len(h) > maybe.size // 10:
                distance = gaps(host, guest, 0, dim)[h, g]
            else:
                distance = np.concatenate([np.square(unit_[host[h[i: i + 65_536]]] - unit_[guest[g[i: i + 65_536]]]).sum(axis=1) for i in range(0, len(h), 65_536)]) if len(h) else np.zeros(0, np.float32)
            distance = np.sqrt(np.maximum(distance, 0))
            fit = distance <= budget.chord + budget.slack
            h, g, distance = host[h[fit]], guest[g[fit]], distance[fit]
            if len(h):
                first = np.concatenate([budget.first_block(turned[h[i: i + 65_536]], turned[g[i: i + 65_536]]) for i in range(0, len(h), 65_536)]) == block
                h, g, distance = h[first], g[first], distance[first]
            sure = distance <= budget.chord - budget.slack
            near.append(np.column_stack([cls[h[~sure]], cls[g[~sure]]]))
            h, g = h[sure], g[sure]
            links += np.bincount(h, weight[g], len(cls)).astype(np.int64) + np.bincount(g, weight[h], len(cls)).astype(np.int64)
            parents = hooked(parents, h, g)
        met = np.flatnonzero(links)
        pairs = np.concatenate(near) if near else np.zeros((0, 2), np.int64)
        return pa.table({
            "cls": pa.array(np.concatenate([cls[met], pairs[:, 0]])), "links": pa.array(np.concatenate([links[met], np.zeros(len(pairs), np.int64)])),
            "peer": pa.array(np.concatenate([cls[parents[met]], pairs[:, 1]])), "sure": pa.array(np.concatenate([np.ones(len(met), bool), np.zeros(len(pairs), bool)]))})

    return run


def verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (cls, peer) whose vectors' cosine reaches the threshold, as links of both."""
    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([bool((unit(x[None]) * unit(y[None])).sum() >= threshold) for x, y in zip(_doubles(a), _doubles(b))], pa.bool_())

    one = classes.select(F.col("cls").alias("cls"), F.col("n").alias("n_a"), F.col("v").alias("v_a"))
    other = classes.select(F.col("cls").alias("peer"), F.col("n").alias("n_b"), F.col("v").alias("v_b"))
    found = stored(pairs.join(one, "cls").join(other, "peer").where(linked("v_a", "v_b")).select("cls", "peer", "n_a", "n_b"), "near-verified")
    return found.select("cls", F.col("n_b").alias("links"), "peer").unionByName(found.select(F.col("peer").alias("cls"), F.col("n_a").alias("links"), F.col("cls").alias("peer")))


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept, for links of a cosine of ``threshold`` (over 0) or more."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = stored(usable(vectors, id_col, vector_col), "near-rows")
    classes = stored(rows.groupBy("v").agg(F.min("row").alias("cls"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n")), "near-classes")
    turned = stored(rotated(classes), "near-turned")
    tasks = routed(turned, strip_sizes(turned, threshold), threshold).groupBy("dim", "block", "strip", "home", "guest")
    found = stored(tasks.applyInArrow(_meet(threshold), FOUND), "near-found")
    links = stored(found.where("sure").select("cls", "links", "peer").unionByName(verified(found.where("not sure").select("cls", "peer"), classes, threshold)), "near-links")
    roots = components(links.select(F.col("cls").alias("a"), F.col("peer").alias("b")))
    counted = links.groupBy("cls").agg(F.sum("links").alias("links"))
    own = classes.select("cls", "least", "n").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    known = own.join(least, "root").join(counted, "cls", "left").select(F.col("cls").alias("_cls"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    # Which class a row belongs to, by its vector; the classes' side is unique.
    of_row = rows.join(classes.select(F.col("v").alias("_v"), F.col("cls").alias("_of")), F.col("v") == F.col("_v")).select("vec_id", "_of")
    linked = of_row.join(known, F.col("_of") == F.col("_cls")).select("vec_id", "n_links", "component_id")
    x = F.col(vector_col)
    fit = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    alone = vectors.where(~F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op11_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
with recursive whole as (
  select row_number() over () as r, vec_id, embedding::double[] as v, embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0 as fit
  from embeddings
), links as (
  select a.r, b.r as other, b.vec_id from whole a join whole b on a.r <> b.r and a.fit and b.fit and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.9
), reach as (
  select r, vec_id, r as at from whole
  union
  select reach.r, l.vec_id, l.other from reach join links l on l.r = reach.at
)
select w.vec_id, (select count(*) from links l where l.r = w.r) as n_links, min(reach.vec_id) as component_id, coalesce(w.vec_id = min(reach.vec_id), false) as kept
from whole w join reach on w.r = reach.r group by w.r, w.vec_id
"""
