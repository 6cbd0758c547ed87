"""Near-duplicate documents by bottom-k sketches, with every link confirmed on full shingle sets.

One hash function maps each shingle to 64 bits. A document's sketch is the k smallest values of its set. Texts with equal
sets are one class; the rest works on classes.

1. Inverted lists, one per value and span of sizes that may link. Values are ordered by the number of classes that retain them. Two classes similar enough to link share at least t
   retained values, so they meet in the list of one of each other's rarest s - t + 1 (s values retained): only those make lists. For small sets t follows exactly
   from the threshold; for others it is the threshold less ``MARGIN``, over five standard errors.
2. Overlaps. First every class of a list meets the list's first class only (a star: as many pairs as members). Pairs whose union sketch
   estimates a similarity of ``LOOSE`` or more join; joined classes need not be compared here, as step 4 compares them in full. Classes in one list that are
   still apart are compared within tasks, in blocks: their sizes, the overlap of their sketches and the estimate must allow the similarity.
3. Loose groups are the components of what passed, a superset of the true ones.
4. Exact Jaccard. Full sets of each group's members are compared in blocks of bounded size; groups beyond a block are dealt to pairs of
   blocks. A block returns a spanning forest of its true links, and the components of these are the result.

Joins whose sides grow with the input are merge joins at every size, so that small runs tell how large ones behave.

Edge cases: null and empty texts have empty sets and link with nothing; rows with null ids take part, and a component's id is its smallest
id that is not null; repeated rows are one class; only the id and text columns are read; an empty table gives an empty result.
Columns named ``bottomk_*`` are the operator's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.llm.common import bounded_batches, gram_hashes, lowered, pieces, rows_of_words, stored, text_buffer, word_hashes, word_spans
from marquee.llm.graph import components

K = 64
PERCENT = 80
MARGIN = 28
LOOSE = 0.35
BLOCK = 384
LIST_BLOCK = 512
SHARD_ROWS = 1024


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's n-word shingles; of a shorter text, of its whole word sequence."""
    data, offsets = text_buffer(texts)
    data = lowered(data)
    starts, ends, firsts = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    grams, counts = gram_hashes(words, n), np.diff(firsts)
    out = []
    for first, count in zip(firsts.tolist(), counts.tolist()):
        if count >= n:
            out.append(np.unique(grams[first : first + count - n + 1]))
        elif count:
            out.append(gram_hashes(words[first : first + count], count) ^ np.uint64(count))
        else:
            out.append(words[:0])
    return out


def sketch_rows(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the set and sketch (its k least values, as ordered ints) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(part.column(2), n)
                sketches = [((s[:K] >> np.uint64(32)).astype(np.uint32) ^ np.uint32(1 << 31)).view(np.int32) for s in sets]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(sketches, pa.list_(pa.int32())),
                ], ["doc_id", "text_hash", "n_shingles", "digest", "sketch"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {id_type}, text_hash long, n_shingles long, digest binary, sketch array<int>")


def estimate(a: str, b: str) -> F.Column:
    """Similarity from two sketches: the share of the union sketch's values that both hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimate is at least so much."""
    side = classes.select("cls", "sketch")
    both = pairs.join(side.select(F.col("cls").alias("a"), F.col("sketch").alias("sa")).hint("merge"), "a")
    both = both.join(side.select(F.col("cls").alias("b"), F.col("sketch").alias("sb")).hint("merge"), "b")
    return both.where(estimate("sa", "sb") >= least).select("a", "b")


def prefix_lists(classes: DataFrame, percent: int) -> DataFrame:
    """cls, n, value and span: each class's rarest retained values that another class of a like size retains as well.

    A span is two neighbouring size classes, whose ratio is the least that allows the similarity; every class is in two spans, and any two that may link share one.
    Rarity counts within the span.
    """
    kept = F.size("sketch")
    small = F.ceil(F.col("n") * percent / 100)  # all shingles of a partner are retained as well
    need = F.when(F.col("n") * 100 <= F.lit(K * percent), small).otherwise(F.lit(math.ceil((percent - MARGIN) * K / 100)))
    size_class = F.floor(F.log("n") / F.lit(1.0001 * math.log(100 / percent))).cast("int")
    spans = F.explode(F.array(size_class, size_class - 1)).alias("span")
    entries = classes.where("n > 0").select("cls", "n", "sketch", (kept - need + 1).alias("room"), kept.alias("kept"), spans)
    entries = entries.select("cls", "n", "room", "kept", "span", F.explode("sketch").alias("value"))
    common = entries.groupBy("value", "span").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    shared = entries.join(common.hint("merge"), ["value", "span"])
    own = Window.partitionBy("cls", "span")
    # Values that nobody shares are the rarest of all and use up the room first.
    ranked = shared.withColumn("rank", F.row_number().over(own.orderBy("holders", "value"))).withColumn("shared", F.count(F.lit(1)).over(own))
    return ranked.where(F.col("rank") <= F.col("room") - (F.col("kept") - F.col("shared"))).select("cls", "n", "value", "span")


def loose_groups(classes: DataFrame, percent: int) -> DataFrame:
    """node and root: components of a superset of the links."""
    key = ["value", "span"]
    lists = stored(prefix_lists(classes, percent), "lists")
    heads = lists.groupBy(*key).agg(F.min("cls").alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1")
    stars = lists.join(heads.select(*key, "head").hint("merge"), key).where(F.col("cls") != F.col("head"))
    links = stored(estimated(stars.select(F.col("head").alias("a"), F.col("cls").alias("b")).distinct(), classes, LOOSE), "star-links")
    grouped = components(links)
    placed = lists.join(grouped.withColumnRenamed("node", "cls"), "cls", "left").select(*key, "cls", "n", F.coalesce("root", "cls").alias("root"))
    placed = stored(placed, "placed-lists")
    apart = placed.groupBy(*key).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members")).where("low <> high")
    rest = placed.join(apart.select(*key, "members").hint("merge"), key)
    return components(links.unionByName(list_links(rest, classes, percent)))


def list_links(rest: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between groups that meet in a list: for any two, one pair at most whose sizes and union sketch allow the similarity.

    Lists are compared within tasks, long ones in pairs of blocks, so that no row per pair is made. ``rest``: value, span, members, cls, n, root.
    """
    sketched = rest.join(classes.select("cls", "sketch").hint("merge"), "cls")
    shards = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.ceil(F.col("members") / LIST_BLOCK)
    block = F.pmod(F.xxhash64("cls"), blocks)
    pairs = F.when(blocks == 1, F.array(F.struct(F.lit(-1).cast("long").alias("low"), F.pmod(F.xxhash64("value", "span"), F.lit(shards)).alias("high")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.struct(F.least(block, j).alias("low"), F.greatest(block, j).alias("high"))))
    dealt = sketched.select("value", "span", "cls", "n", "root", "sketch", F.explode(pairs).alias("at")).select(
        F.when(F.col("at.low") >= 0, F.xxhash64("value", "span")).otherwise(F.lit(0)).alias("whole"), F.col("at.low").alias("low"), F.col("at.high").alias("high"),
        "value", "span", "cls", "n", "root", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, [("value", "ascending"), ("span", "ascending"), ("cls", "ascending")]))
        value, span, cls, n, root = (np.asarray(table.column(c)) for c in ("value", "span", "cls", "n", "root"))
        column = table.column("sketch").combine_chunks()
        offsets, flat = np.asarray(column.offsets).astype(np.int64), np.asarray(column.values)
        cuts = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (span[1:] != span[:-1]), [True]])).tolist()
        links: list[tuple[int, int]] = []
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                found = bridges([flat[offsets[i] : offsets[i + 1]] for i in range(a, b)], n[a:b], root[a:b], percent)
                links += [(int(cls[a + i]), int(cls[a + j])) for i, j in found]
        columns = zip(*links) if links else [(), ()]
        return pa.table([pa.array(list(x), pa.int64()) for x in columns], names=["a", "b"])

    return dealt.groupBy("whole", "low", "high").applyInArrow(compare, "a long, b long").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many values any two of the sets share, from products of 0-1 tables of bounded width."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, codes, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts[codes] > 1
    _, codes = np.unique(codes[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for low in range(0, int(codes[-1]) + 1 if len(codes) else 0, width):
        a, b = np.searchsorted(codes, (low, low + width))
        table = np.zeros((len(sets), min(width, int(codes[-1]) + 1 - low)), np.float32)
        table[owner[a:b], codes[a:b] - low] = 1
        common += table @ table.T
    return common.astype(np.int64)


def union_estimate(a: np.ndarray, b: np.ndarray) -> float:
    """``estimate`` for two sorted sketches."""
    union = np.unique(np.concatenate([a, b]))[:K]
    both = np.intersect1d(a, b, assume_unique=False)
    return float(np.isin(union, both).sum() / len(union))


def bridges(sketches: list[np.ndarray], n: np.ndarray, root: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that join groups of different roots: one for each two groups that become one."""
    kept = np.array([len(s) for s in sketches])
    need = np.where(100 * n <= K * percent, -(-n * percent // 100), math.ceil((percent - MARGIN) * K / 100))
    apart = root[:, None] != root[None, :]
    fit = 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    possible = np.triu(apart & fit, 1)
    if not possible.any():
        return []
    possible &= overlaps(sketches) >= np.minimum(need[:, None], need[None, :])
    at: dict[int, int] = {}

    def top(x: int) -> int:
        while x in at:
            x = at[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(possible))):
        a, b = top(int(root[i])), top(int(root[j]))
        if a != b and union_estimate(sketches[i], sketches[j]) >= (percent - MARGIN) / 100:
            at[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges from the first member to the others of each component of the true links among the sets."""
    sizes, together = np.array([len(s) for s in sets]), overlaps(sets)
    linked = 100 * together >= percent * (sizes[:, None] + sizes[None, :] - together)
    out, seen = [], np.zeros(len(sets), bool)
    for first in range(len(sets)):
        if seen[first]:
            continue
        seen[first] = True
        front = [first]
        while front:
            new = np.flatnonzero(linked[front].any(axis=0) & ~seen).tolist()
            seen[new] = True
            out += [(first, i) for i in new]
            front = new
    return out


def exact_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, n: int, percent: int) -> DataFrame:
    """Spanning edges (a, b) of the true links within loose groups."""
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    members = groups.join(sizes, "root").withColumnRenamed("node", "cls").join(classes.select("cls", "first_id", "digest"), "cls")
    members = stored(members, "group-members")
    shards = max(1, -(-members.count() // SHARD_ROWS))
    wanted = members.select(F.col("first_id").alias("doc_id"), "digest", "cls", "root", "members")
    found = docs.select("doc_id", "text").join(wanted.hint("merge"), docs["doc_id"].eqNullSafe(wanted["doc_id"])).select("cls", "root", "members", "digest", docs["text"].alias("text"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(part.column(4), n)]
                same = pa.array([xxhash.xxh3_128_digest(s) == d.as_buffer().to_pybytes() for s, d in zip(sets, part.column(3))], pa.bool_())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.binary())], ["cls", "root", "members", "shingles"]).filter(same)

    sets = found.mapInArrow(full, "cls long, root long, members long, shingles binary")
    blocks = F.ceil(F.col("members") / BLOCK)
    block = F.pmod(F.xxhash64("cls"), blocks)
    # A member of a large group goes to every pair of blocks that its own is in; small groups share shards.
    pairs = F.when(blocks == 1, F.array(F.struct(F.lit(-1).cast("long").alias("low"), F.pmod(F.xxhash64("root"), F.lit(shards)).alias("high")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.struct(F.least(block, j).alias("low"), F.greatest(block, j).alias("high"))))
    dealt = sets.select("cls", "root", "shingles", F.explode(pairs).alias("at")).select(
        F.when(F.col("at.low") >= 0, F.col("root")).otherwise(F.lit(-1)).alias("whole"), F.col("at.low").alias("low"), F.col("at.high").alias("high"), "cls", "root", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table, [("root", "ascending"), ("cls", "ascending")]))
        roots, cls = np.asarray(table.column("root")), np.asarray(table.column("cls"))
        shingles = table.column("shingles").combine_chunks()
        edges: list[tuple[int, int]] = []
        cuts = np.flatnonzero(np.concatenate([[True], roots[1:] != roots[:-1], [True]])).tolist()
        for a, b in zip(cuts, cuts[1:]):
            ids, first = np.unique(cls[a:b], return_index=True)  # a repeated row is there twice
            if len(ids) > 1:
                found = forest([np.frombuffer(shingles[a + int(i)].as_buffer(), np.uint64) for i in first], percent)
                edges += [(int(ids[i]), int(ids[j])) for i, j in found]
        columns = zip(*edges) if edges else [(), ()]
        return pa.table([pa.array(list(x), pa.int64()) for x in columns], names=["a", "b"])

    return dealt.groupBy("whole", "low", "high").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text_hash (Spark's xxhash64), n_shingles, component_id, and root (one number per component; null without shingles)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(sketch_rows(texts, n), "sketches")
    distinct = rows.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = stored(distinct.withColumn("cls", F.monotonically_increasing_id()), "classes")
    groups = stored(loose_groups(classes, percent), "loose-groups")
    roots = components(exact_links(texts, classes, groups, n, percent)).select(F.col("node").alias("cls"), "root")
    placed = classes.select("digest", "first_id", "cls").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    placed = stored(placed, "rooted-classes")
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(least, "root").select("digest", "root", "component_id")
    out = rows.select("doc_id", "text_hash", "n_shingles", "digest").join(named.hint("merge"), "digest", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root")


def deduplicated(docs: DataFrame, n: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id (then text hash); all rows without shingles; all columns of ``docs``."""
    docs = docs.drop(*[c for c in docs.columns if c.startswith("bottomk_")])
    found = near_duplicates(docs, n, percent, id_col, text_col)
    pair = ["doc_id", "text_hash"]
    order = Window.partitionBy("root").orderBy(F.col("doc_id").asc_nulls_last(), "text_hash")
    stay = found.where("root is not null").withColumn("nth", F.row_number().over(order)).where("nth = 1").select(*pair)
    # Rows that repeat both id and text: one stays if it has shingles.
    again = found.where("root is not null").groupBy(*pair).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(*pair)
    keys = stay.unionByName(found.where("root is null").select(*pair)).distinct()
    twice = again.select(F.col("doc_id").alias("again_id"), F.col("text_hash").alias("again_hash"), F.lit(True).alias("again"))
    keys = keys.join(twice, F.col("doc_id").eqNullSafe(F.col("again_id")) & F.col("text_hash").eqNullSafe(F.col("again_hash")), "left")
    keys = stored(keys.select(F.col("doc_id").alias("bottomk_id"), F.col("text_hash").alias("bottomk_hash"), F.coalesce("again", F.lit(False)).alias("again")), "kept-keys")
    repeated = stored(keys.where("again"), "repeated-keys")
    same = F.col(id_col).eqNullSafe(F.col("bottomk_id")) & F.xxhash64(text_col).eqNullSafe(F.col("bottomk_hash"))
    lone = docs.join(keys.where("not again").hint("merge"), same, "left_semi")
    return lone.unionByName(docs.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col]))


def op2_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents over two-word shingles."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=2)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
