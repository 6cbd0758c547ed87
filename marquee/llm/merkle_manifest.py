"""A Merkle manifest of a data set, and proofs of many leaves at once (octopus multiproofs).

Every row is a leaf: the SHA-256 of its fields. The leaves of a language, ordered by id, are the lowest level of a tree in which a node is the hash of up to
``ARITY`` consecutive ones below; the languages' roots are in turn the leaves of one more tree, whose root stands for the data set.

1. ``leaves``: fields are hashed where they are read and only digests travel. They are sorted by ranges of (language, id), stored, and numbered from the
   number of rows in the ranges before: no language is gathered in one task, however many rows it has.
2. ``build``: a level is a group-by of eight rows a key; each is written to a folder of its own, a tree of n leaves takes log8(n) of them.
3. ``multiproof``: each leaf partition (a range of bounded size) works out the least set of nodes that it needs: going up from its own leaves, at each level the
   siblings that it neither has nor can derive. All partitions' coordinates are fetched by one join with the nodes.
   Back in its partition, the fetched nodes and the leaves give all interior nodes once, shared by all its leaves, and each leaf's proof is read off locally.

A partition fetches at most 14 nodes a level and language it holds, not 7 a level and leaf. Proofs can be asked for any choice of rows; the coordinates are worked out
from sets of places, not from whole ranges. To the driver come row counts of the sorted partitions.

Edge cases: null fields are hashed as ``-`` and empty texts as ``0:``; rows without a language form a tree of their own, the first; rows without an id
come first in their language and are never tampered with; rows of equal id are ordered by leaf, and equal leaves, whose rows are all the same, in any order, each a leaf
of its own; long texts are hashed in the JVM and never leave their row; other columns are ignored, also if named like a result; an empty table has no leaves, no
root and no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import crc32_sql, stored
from marquee.session import fresh_path

ARITY = 8
#: Leaves of a partition, about: bounds what a task holds.
PART_LEAVES = 32_768
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = -1  # the tree of the languages' roots


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each with its length in bytes."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]), 256)


def numbered(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """The rows stored in sorted order, with ``part`` (their range) and ``place`` (from 0, over all ranges).

    Rows that are equal in ``order`` are spread over ranges by where they were read.
    """
    spark = rows.sparkSession
    count = rows.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // PART_LEAVES))
    salted = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    keys = [*order, "_salt"]
    ranged = salted.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_salt")
    kept = stored(ranged.withColumn("part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), label)
    sizes = dict(kept.groupBy("part").count().collect())  # a row per range
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    first = F.get(F.lit(before).cast("array<bigint>"), F.col("part")) if before else F.lit(0)
    return kept.withColumn("place", first + F.col("_at")).drop("_at")


@dataclass(frozen=True)
class Manifest:
    """leaves: part, tree, pos and digest of every row, with the columns asked for. nodes: tree, level, pos, digest, level 0 included.
    trees: tree, group and number of leaves n, one row per language. root: the one digest, or None."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None


def leaves(documents: DataFrame, group: str, order: str, digest: Column, extra: Sequence[Column] = ()) -> tuple[DataFrame, DataFrame]:
    """The numbered leaves (part, tree, pos, digest, extra columns) and the trees (tree, group, n)."""
    rows = documents.select(F.col(group).alias("_group"), F.col(order).alias("_order"), digest.alias("digest"), *extra)
    placed = numbered(rows, ["_group", "_order", "digest"], "merkle-leaves")
    segments = stored(placed.groupBy("part", "_group").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("n")), "merkle-segments")
    groups = segments.groupBy("_group").agg(F.min("low").alias("start"), F.sum("n").alias("n"))
    trees = stored(numbered(groups, ["_group"], "merkle-groups").withColumnRenamed("place", "tree").drop("part"), "merkle-trees")
    # A range holds few languages but the ranges are of bounded size, so no key of this join is frequent.
    known = segments.join(trees.select("_group", "start", "tree"), segments["_group"].eqNullSafe(trees["_group"])).select("part", segments["_group"].alias("_known"), "start", "tree")
    found = placed.join(known, (placed["part"] == known["part"]) & placed["_group"].eqNullSafe(known["_known"])).drop(known["part"])
    extras = [c for c in rows.columns if c not in ("_group", "_order", "digest")]
    return (stored(found.select("part", "tree", (F.col("place") - F.col("start")).alias("pos"), "digest", *extras), "merkle-placed"),
            trees.select("tree", F.col("_group").alias("group"), "n"))


def _levels(spark: SparkSession, ground: DataFrame, leaves_of_largest: int, path: str) -> None:
    """Write the levels above level 0 below ``path``."""
    level, below, most = 0, ground, leaves_of_largest
    whole = F.array_sort(F.collect_list(F.struct("pos", "digest")))
    while most > 1:
        level += 1
        up = below.groupBy("tree", F.floor(F.col("pos") / ARITY).alias("pos")).agg(whole.alias("run"), F.max("open").alias("open"))
        hashed = up.select("tree", "pos", F.sha2(F.concat_ws("", F.transform("run", lambda r: r["digest"])), 256).alias("digest"), (-F.floor(-F.col("open") / ARITY)).alias("open"))
        hashed.write.parquet(f"{path}/level={level}")
        # A tree that has shrunk to one node is complete.
        below = spark.read.schema("tree bigint, pos bigint, digest string, open bigint").parquet(f"{path}/level={level}").where("open > 1")
        most = -(-most // ARITY)


def build(documents: DataFrame, group: str, order: str, digest: Column, extra: Sequence[Column] = ()) -> Manifest:
    """Trees of all groups and of their roots. ``digest`` is a leaf's hash in hex; ``extra`` are columns that leaves keep."""
    spark = documents.sparkSession
    ground, trees = leaves(documents, group, order, digest, extra)
    shape = "tree bigint, pos bigint, digest string, open bigint, level int"
    most = trees.agg(F.max("n")).head()[0]
    if not most:
        return Manifest(ground, spark.createDataFrame([], shape).drop("open"), trees, None)
    path = fresh_path(spark, "merkle-nodes")
    counted = ground.select("tree", "pos", "digest").join(trees.select("tree", F.col("n").alias("open")), "tree")
    counted.write.parquet(f"{path}/level=0")
    _levels(spark, spark.read.schema("tree bigint, pos bigint, digest string, open bigint").parquet(f"{path}/level=0").where("open > 1"), most, path)
    nodes = spark.read.schema(shape).parquet(path)
    roots = nodes.where("open = 1").select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("pos"), "digest")
    count = trees.count()
    over = fresh_path(spark, "merkle-top")
    roots.withColumn("open", F.lit(count).cast("bigint")).write.parquet(f"{over}/level=0")
    _levels(spark, spark.read.schema("tree bigint, pos bigint, digest string, open bigint").parquet(f"{over}/level=0").where("open > 1"), count, over)
    top = spark.read.schema(shape).parquet(over)
    root = top.where("open = 1").head()["digest"]
    return Manifest(ground, nodes.unionByName(top).drop("open"), trees, root)


def heights(n: int) -> list[int]:
    """Nodes of each level of a tree of n leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def needed(places: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """For each level, the places of the nodes that a holder of some leaves lacks and cannot derive."""
    out, have = [], np.unique(places)
    for level, size in enumerate(heights(n)[:-1]):
        ups = np.unique(have // ARITY)
        runs = (ups[:, None] * ARITY + np.arange(ARITY)).ravel()
        out.append((level, np.setdiff1d(runs[runs < size], have, assume_unique=True)))
        have = ups
    return out


class Grove:
    """A partition's part of one tree: its leaves, the fetched nodes, and all that follows from them."""

    def __init__(self, n: int, levels: list[dict[int, str]]):
        self.sizes, self.levels = heights(n), levels

    def derive(self) -> None:
        for level, size in enumerate(self.sizes[:-1]):
            below, above = self.levels[level], self.levels[level + 1]
            for up in {pos // ARITY for pos in below}:
                run = range(up * ARITY, min(size, (up + 1) * ARITY))
                if up not in above and all(p in below for p in run):
                    above[up] = hashlib.sha256("".join([below[p] for p in run]).encode()).hexdigest()

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def proof(self, pos: int) -> list[tuple[str, str]]:
        """The siblings to the left and to the right, as text, of each node from a leaf to below the root."""
        out = []
        for level, size in enumerate(self.sizes[:-1]):
            below, low = self.levels[level], pos - pos % ARITY
            out.append(("".join([below[p] for p in range(low, pos)]), "".join([below[p] for p in range(pos + 1, min(size, low + ARITY))])))
            pos //= ARITY
        return out


def folded(digest: str, proof: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in proof:
        digest = hashlib.sha256((left + digest + right).encode()).hexdigest()
    return digest


def multiproof(manifest: Manifest, chosen: DataFrame, columns: Sequence[str] = (), claim: str = "digest") -> DataFrame:
    """For every row of ``chosen`` (rows of ``manifest.leaves``): the columns, leaf, subroot, root, proof_sha256 (hash of all siblings, level by level) and
    folded_root, what the leaf in column ``claim`` (null: the row's own digest) and the siblings give."""
    trees = manifest.trees.select("tree", "n")
    count = manifest.trees.count()
    # One row per partition and language.
    sized = stored(chosen.select("part", "tree").distinct().join(trees, "tree").select("part", "tree", "n"), "merkle-sized")
    asked = chosen.select("part", "tree", "pos")

    def missing(rows: pa.Table, sizes: pa.Table) -> pa.Table:
        part, tree, level, pos = [], [], [], []
        if len(rows):
            number, own = rows.column("part")[0].as_py(), np.asarray(rows.column("tree"))
            places, leaves_of = np.asarray(rows.column("pos")), dict(zip(sizes.column("tree").to_pylist(), sizes.column("n").to_pylist()))
            wanted = [(t, needed(places[own == t], leaves_of[t])) for t in np.unique(own).tolist()] + [(TOP, needed(np.unique(own), count))]
            for t, levels in wanted:
                for at, lacking in levels:
                    part += [number] * len(lacking)
                    tree += [t] * len(lacking)
                    level += [at] * len(lacking)
                    pos += lacking.tolist()
        return pa.table({"part": pa.array(part, pa.int32()), "tree": pa.array(tree, pa.int64()), "level": pa.array(level, pa.int32()), "pos": pa.array(pos, pa.int64())})

    wanted = asked.groupBy("part").cogroup(sized.groupBy("part")).applyInArrow(missing, "part int, tree bigint, level int, pos bigint")
    fetched = wanted.join(manifest.nodes, ["tree", "level", "pos"]).select("part", "tree", "level", "pos", "digest")
    # Sizes travel with the fetched nodes, as nodes of level -1.
    held = stored(fetched.unionByName(sized.select("part", "tree", F.lit(-1).alias("level"), F.col("n").alias("pos"), F.lit("").alias("digest"))), "merkle-fetched")
    kinds = dict(chosen.dtypes)
    result = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "leaf string", "subroot string", "root string", "proof_sha256 string", "folded_root string"])
    kept = chosen.select("part", "tree", "pos", F.col("digest").alias("_leaf"), F.coalesce(F.col(claim), F.col("digest")).alias("_claim"), *columns)

    def expand(rows: pa.Table, got: pa.Table) -> pa.Table:
        tree, pos, leaf, claimed = (rows.column(c).to_pylist() for c in ("tree", "pos", "_leaf", "_claim"))
        groves: dict[int, Grove] = {}
        nodes = list(zip(*(got.column(c).to_pylist() for c in ("tree", "level", "pos", "digest"))))
        for t, level, size, _ in nodes:
            if level < 0:
                groves[t] = Grove(size, [{} for _ in heights(size)])
        if len(rows):
            groves[TOP] = Grove(count, [{} for _ in heights(count)])
        for t, level, p, digest in nodes:
            if level >= 0:
                groves[t].levels[level][p] = digest
        for t, p, digest in zip(tree, pos, leaf):
            groves[t].levels[0][p] = digest
        for t, grove in groves.items():
            if t != TOP:
                grove.derive()
                groves[TOP].levels[0][t] = grove.root
        if len(rows):
            groves[TOP].derive()
        above = {t: groves[TOP].proof(t) for t in groves if t != TOP}
        subroot, root, proofs, ends = [], [], [], []
        for t, p, claim_ in zip(tree, pos, claimed):
            path = groves[t].proof(p) + above[t]
            subroot.append(groves[t].root)
            root.append(groves[TOP].root)
            proofs.append(hashlib.sha256("".join([x for pair in path for x in pair]).encode()).hexdigest())
            ends.append(folded(claim_, path))
        made = [pa.array(x, pa.string()) for x in (leaf, subroot, root, proofs, ends)]
        return pa.table([*(rows.column(c) for c in columns), *made], names=[*columns, "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    return kept.groupBy("part").cogroup(held.groupBy("part")).applyInArrow(expand, result)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, checked after a third of the texts were tampered with."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = [F.col(f) for f in FIELDS]
    changed = leaf_digest([F.translate("text", UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS])
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    manifest = build(documents, "lang", "doc_id", leaf_digest(fields), [F.col("doc_id"), F.when(third, changed).alias("tampered")])
    found = multiproof(manifest, manifest.leaves, ["doc_id"], "tampered")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = f"""
with recursive fields as (
  select doc_id, lang, {crc32_sql('doc_id')} % 3 = 0 as tampered,
    coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') as head, text
  from documents
), leaves as (
  select doc_id, lang, row_number() over (partition by lang order by doc_id nulls first) - 1 as pos, count(*) over (partition by lang) as n,
    sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
    sha256(head || coalesce(octet_length(encode(text)) || ':' || case when tampered then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end, '-')) as claim
  from fields
), nodes as (
  select lang, 0 as level, pos, n, leaf as digest from leaves
  union all
  select lang, any_value(level) + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' order by pos)) from nodes where n > 1 group by lang, pos // 8
), tops as (
  select lang, 0 as level, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n, digest from nodes where n = 1
  union all
  select any_value(lang), any_value(level) + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' order by pos)) from tops where n > 1 group by pos // 8
), siblings as (
  select a.lang, a.level, a.pos, coalesce(string_agg(b.digest, '' order by b.pos) filter (b.pos < a.pos), '') as l, coalesce(string_agg(b.digest, '' order by b.pos) filter (b.pos > a.pos), '') as r
  from nodes a join nodes b on a.lang is not distinct from b.lang and a.level = b.level and a.pos // 8 = b.pos // 8 where a.n > 1 group by all
), top_siblings as (
  select a.level, a.pos, coalesce(string_agg(b.digest, '' order by b.pos) filter (b.pos < a.pos), '') as l, coalesce(string_agg(b.digest, '' order by b.pos) filter (b.pos > a.pos), '') as r
  from tops a join tops b on a.level = b.level and a.pos // 8 = b.pos // 8 where a.n > 1 group by all
), up as (
  select doc_id, lang, leaf, pos, 0 as level, claim as digest, '' as proof from leaves
  union all
  select doc_id, u.lang, leaf, u.pos // 8, u.level + 1, sha256(l || digest || r), proof || l || r
  from up u join siblings s on u.lang is not distinct from s.lang and u.level = s.level and u.pos = s.pos
), over as (
  select u.doc_id, u.leaf, n.digest as subroot, t.pos, 0 as level, u.digest, u.proof
  from up u join nodes n on u.lang is not distinct from n.lang and u.level = n.level and n.n = 1 join tops t on t.level = 0 and u.lang is not distinct from t.lang
  union all
  select doc_id, leaf, subroot, o.pos // 8, o.level + 1, sha256(l || digest || r), proof || l || r from over o join top_siblings s on o.level = s.level and o.pos = s.pos
)
select doc_id, leaf, subroot, t.digest as root, sha256(proof) as proof_sha256, o.digest as folded_root, o.digest = t.digest as verified
from over o join tops t on t.n = 1 and t.level = o.level
"""
