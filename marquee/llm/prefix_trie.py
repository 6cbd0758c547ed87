"""A Z-fast trie of conversations: which beginnings they share, and how many words that saves.

A conversation is the sequence of its turns. It travels as its path, the chained hashes of its beginnings of 1, 2, 3, ... turns (16 bytes each), so a beginning of any
length is known by one hash; texts stay where they are read. Equal sequences are one row with their number, smallest id and the hash of their sorted ids.

The trie is a table of compacted nodes: a node stands for the edge from ``lo`` (its parent's depth, exclusive) to ``hi``, where sequences branch or end. Its handle
is the beginning whose length is the two-fattest number of (lo, hi], the one that a power of two divides most often.

1. Sequences are inserted in batches that grow eightfold, dealt by hash. In a batch every sequence finds its exit node by fat binary search: it looks its beginning of two-fattest
   length up in the table of handles, jumps to the end of the node found there or halves the rest, so the longest of n turns takes log2(n) joins on unique hashes. A last one
   looks for the child that the next turn leads to.
2. Sequences that leave the trie at one point with the same next turn are a group. Up to ``GROUP`` of a group, and ``GROUP_TURNS`` turns, are sorted by path in one task and their common
   beginnings become new compacted nodes; edges are split where sequences leave or end. What is left of a large group is located again, now deeper: a round leaves
   about 1 in ``GROUP`` of it in a group.
3. Sums over subtrees double their reach each round: a node adds what the nodes 2**k below it have summed so far, and points twice as far up (log2 of the trie's depth rounds).
   ``saved_tokens`` is such a sum, as the words up to a node are known from its path.
4. Edges are expanded into one row per depth.

Frequent turns are no hot spot: joins have a side with unique hashes, so Spark may split the other; groups are cut to ``GROUP`` rows before the shuffle; sums combine on the map side;
the ids of equal conversations are joined up in chunks by sorted ranges, and one task feeds the chunks to the hash in order.

Edge cases: null roles and texts are empty; turns of equal number are ordered by role, then by hash, and repeated rows are turns of their own; rows without a conv_id take no
part; a conversation left without turns ends at the root; other columns are ignored; texts of any length are hashed in the JVM; the hashes of one conversation's turns must fit in a row
(16 bytes a turn); an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.llm.common import bounded_batches, crc32_sql, stored

WORD = r"[^\x20\x09-\x0D]+"
HASH = 16
ROOT = bytes(HASH)
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Shares of the sequences that have been inserted after each batch, in 64ths.
BATCHES = (1, 8, 64)
GROUP = 256
GROUP_TURNS = 1 << 18
CHUNK_IDS = 4096
FAMILY = 20

NODES = "ext binary, up binary, lo int, hi int, edge binary, cum binary"
_NODES = pa.schema([("ext", pa.binary()), ("up", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()), ("edge", pa.binary()), ("cum", pa.binary())])


# ---- conversations as paths ---------------------------------------------------------------------------------------


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, p (from 0, in order of turn), token (hash of role and text) and words."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    token = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, HASH)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), token.alias("token"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "token")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("p"), "token", "words")


def with_shared_openings(turns: DataFrame) -> DataFrame:
    """Every conversation's first h turns taken from its family's first one (id c - c % 20), h = crc32(c) % 4; an empty row at p = -1 each."""
    held = stored(turns, "trie-turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    known = held.select(F.col("conv_id").alias("conv_id")).distinct().withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    openings = held.where((F.col("conv_id") % FAMILY == 0) & (F.col("p") < 3)).select(F.col("conv_id").alias("base"), F.col("p").alias("p"), F.col("token").alias("token"), F.col("words").alias("words"))
    taken = known.where("h > 0").join(openings, "base").where("p < h").select("conv_id", "p", "token", "words")
    own = held.where(F.col("p") >= h).select("conv_id", "p", "token", "words")
    empty = known.select("conv_id", F.lit(-1).alias("p"), F.lit(None).cast("binary").alias("token"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(taken).unionByName(empty)


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, seq (hash of the whole), path (hashes of all beginnings) and cum (words up to each depth, from 0)."""
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("p", "token", "words"))).alias("turns"))
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.binary()), ("path", pa.binary()), ("cum", pa.binary())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, made, sums = [], [], []
            for turns_ in batch.column("turns"):
                at, hashes, words = ROOT, [], [0]
                for turn in turns_:
                    token = turn["token"].as_py()
                    if token is not None:
                        at = hashlib.sha256(at + token).digest()[:HASH]
                        hashes.append(at)
                        words.append(words[-1] + turn["words"].as_py())
                seqs.append(at)
                made.append(b"".join(hashes))
                sums.append(np.array(words, np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(x, pa.binary()) for x in (seqs, made, sums))], schema=schema)

    return whole.mapInArrow(chain, "conv_id long, seq binary, path binary, cum binary")


def sequences(conversations: DataFrame) -> DataFrame:
    """Distinct sequences: seq, path, cum, n (conversations), least (smallest id) and ends (SHA-256 of the ids, ascending, joined by commas)."""
    ordered = conversations.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    columns = "seq binary, first long, n long, ids string, path binary, cum binary"
    chunk_schema = pa.schema([("seq", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string()), ("path", pa.binary()), ("cum", pa.binary())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, ids, path, cum, out = None, [], None, None, []

        def closed():
            return (seq, ids[0], len(ids), ",".join(map(str, ids)), path, cum)

        for batch in batches:
            for conv, own, p, c in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "seq", "path", "cum"))):
                if own != seq or len(ids) == CHUNK_IDS:
                    if ids:
                        out.append(closed())
                    seq, ids, path, cum = own, [], p, c
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), chunk_schema)], schema=chunk_schema)
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(closed(), chunk_schema)], schema=chunk_schema)

    schema = pa.schema([("seq", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string()), ("path", pa.binary()), ("cum", pa.binary())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, n, least, sha, path, cum, out = None, 0, 0, None, None, None, []
        for batch in batches:
            for own, first, count, ids, p, c in zip(*(batch.column(x).to_pylist() for x in chunk_schema.names)):
                if own != seq:
                    if sha is not None:
                        out.append((seq, n, least, sha.hexdigest(), path, cum))
                    seq, n, least, sha, path, cum = own, 0, first, hashlib.sha256(), p, c
                else:
                    sha.update(b",")
                n += count
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((seq, n, least, sha.hexdigest(), path, cum), schema)], schema=schema)

    gathered = ordered.mapInArrow(chunks, columns).repartition("seq").sortWithinPartitions("seq", "first")
    return gathered.mapInArrow(digests, "seq binary, n long, least long, ends string, path binary, cum binary")


# ---- the trie -----------------------------------------------------------------------------------------------------


def turn_hash(path: Column, depth: Column) -> Column:
    """The hash of a path's first ``depth`` turns."""
    return F.substring(path, (depth - 1) * HASH + 1, F.lit(HASH))


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides: high without the bits below the highest one in which it differs from low."""
    top = F.floor(F.log2(low.bitwiseXOR(high).cast("double"))).cast("int")
    return high.bitwiseAND(F.call_function("shiftleft", F.lit(-1), top))


def shared(a: bytes, b: bytes) -> int:
    """How many turns two paths share from their start."""
    low, high = 0, min(len(a), len(b)) // HASH
    while low < high:
        middle = (low + high + 1) // 2
        at = slice((middle - 1) * HASH, middle * HASH)
        low, high = (middle, high) if a[at] == b[at] else (low, middle - 1)
    return low


def locate(pending: DataFrame, nodes: DataFrame, deepest: int) -> DataFrame:
    """``pending`` (seq, path, cum, len) with the exit node (null: a node's very end) and the depth d where each sequence leaves the trie."""
    handle = turn_hash(F.col("edge"), two_fattest(F.col("lo"), F.col("hi")) - F.col("lo"))
    handles = nodes.select(handle.alias("_handle"), F.col("ext").alias("_ext"), F.col("hi").alias("_hi"))
    state = pending.withColumn("a", F.lit(0)).withColumn("b", F.least("len", F.lit(deepest))).withColumn("exit", F.lit(None).cast("binary"))
    active = F.col("exit").isNull() & (F.col("a") < F.col("b"))
    for _ in range(deepest.bit_length()):
        f = two_fattest(F.col("a"), F.col("b"))
        # Rows that are done look their own hash up, to no effect, so that they do not meet as nulls.
        probed = state.withColumn("f", F.when(active, f)).withColumn("_probe", F.coalesce(turn_hash(F.col("path"), F.col("f")), F.col("seq")))
        met = probed.join(handles, F.col("_probe") == F.col("_handle"), "left")
        found = F.col("f").isNotNull() & F.col("_ext").isNotNull()
        through = found & (F.col("_hi") <= F.col("len")) & (turn_hash(F.col("path"), F.col("_hi")) == F.col("_ext"))
        state = met.select(
            "seq", "path", "cum", "len", F.when(through, F.col("_hi")).otherwise(F.col("a")).alias("a"),
            F.when(F.col("f").isNotNull() & ~found, F.col("f") - 1).otherwise(F.col("b")).alias("b"),
            F.when(found & ~through, F.col("_ext")).otherwise(F.col("exit")).alias("exit"))
    names = nodes.select(turn_hash(F.col("edge"), F.lit(1)).alias("_name"), F.col("ext").alias("_child"))
    step = F.when(F.col("exit").isNull() & (F.col("a") < F.col("len")), turn_hash(F.col("path"), F.col("a") + 1))
    state = state.withColumn("_step", step).withColumn("_key", F.coalesce("_step", "seq")).join(names, F.col("_key") == F.col("_name"), "left")
    state = state.withColumn("exit", F.coalesce("exit", F.when(F.col("_step").isNotNull(), F.col("_child"))))
    edges = nodes.select(F.col("ext").alias("_ext"), "lo", "hi", "edge")
    state = state.join(edges, F.coalesce("exit", "seq") == F.col("_ext"), "left")

    @F.arrow_udf("int")
    def leaves_at(path: pa.Array, edge: pa.Array, low: pa.Array) -> pa.Array:
        return pa.array([lo + shared(p[lo * HASH:], e) for p, e, lo in zip(path.to_pylist(), edge.to_pylist(), low.to_pylist())], pa.int32())

    inside = F.col("exit").isNotNull()
    d = leaves_at.asNondeterministic()("path", F.when(inside, F.col("edge")).otherwise(F.lit(b"")), F.when(inside, F.col("lo")).otherwise(F.col("a")))
    return state.select("seq", "path", "cum", "len", "exit", F.when(inside, F.col("hi")).alias("hi"), d.alias("d"))


def grown(group: pa.Table) -> pa.Table:
    """The compacted nodes of sequences that leave the trie at one point with the same turn."""
    rows = sorted(zip(group.column("path").to_pylist(), group.column("cum").to_pylist()))
    out: list[tuple] = []

    def emit(path: bytes, cum: bytes, lo: int, hi: int) -> None:
        up = path[(lo - 1) * HASH: lo * HASH] if lo else ROOT
        out.append((path[(hi - 1) * HASH: hi * HASH], up, lo, hi, path[lo * HASH: hi * HASH], cum[lo * 8: (hi + 1) * 8]))

    stack, before = [group.column("d")[0].as_py()], None  # depths of the open nodes on the path of the sequence before
    for path, cum in rows:
        if before is not None:
            depth = shared(before[0], path)
            while stack[-1] > depth:
                hi = stack.pop()
                emit(*before, max(stack[-1], depth), hi)
                if stack[-1] < depth:
                    stack.append(depth)
        stack.append(len(path) // HASH)
        before = (path, cum)
    while len(stack) > 1:
        hi = stack.pop()
        emit(*before, stack[-1], hi)
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out), _NODES)], schema=_NODES)


def cut(nodes: DataFrame, located: DataFrame) -> DataFrame:
    """The nodes with edges split where located sequences leave or end inside them."""
    places = located.where(F.col("exit").isNotNull() & (F.col("d") < F.col("hi"))).groupBy(F.col("exit").alias("_exit")).agg(F.array_sort(F.collect_set("d")).alias("at"))
    met = nodes.join(places, F.col("ext") == F.col("_exit"), "left").select("ext", "up", "lo", "hi", "edge", "cum", "at")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ext, up, lo, hi, edge, cum, at in zip(*(batch.column(c).to_pylist() for c in ("ext", "up", "lo", "hi", "edge", "cum", "at"))):
                for low, high in zip([lo, *(at or [])], [*(at or []), hi]):
                    piece, sums = edge[(low - lo) * HASH: (high - lo) * HASH], cum[(low - lo) * 8: (high - lo + 1) * 8]
                    out.append((piece[-HASH:], up, low, high, piece, sums))
                    up = piece[-HASH:]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [()] * len(_NODES), _NODES)], schema=_NODES)

    return met.mapInArrow(split, NODES)


def build(found: DataFrame) -> DataFrame:
    """The compacted nodes (ext, up, lo, hi, edge, cum; without the root) of the trie of stored sequences."""
    spark = found.sparkSession
    nodes = spark.createDataFrame([], NODES)
    share, before = F.pmod(F.xxhash64("seq"), F.lit(BATCHES[-1])), 0
    some = found.where(F.octet_length("path") > 0).select("seq", "path", "cum", (F.octet_length("path") / HASH).cast("int").alias("len"))
    for until in BATCHES:
        pending, before = some.where((share >= before) & (share < until)), until
        while not pending.isEmpty():
            deepest = nodes.agg(F.max("hi")).head()[0] or 0
            located = stored(locate(pending, nodes, deepest), "trie-located")
            leaving = located.where(F.col("d") < F.col("len")).withColumn("key", turn_hash(F.col("path"), F.col("d") + 1))
            order = Window.partitionBy("key").orderBy(F.xxhash64("seq"), "seq")
            first = leaving.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= GROUP)
            fit = first.withColumn("turns", F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("nth") == 1) | (F.col("turns") <= GROUP_TURNS))
            chosen = stored(fit.select("seq", "path", "cum", "d", "key"), "trie-chosen")
            fresh = chosen.groupBy("key").applyInArrow(grown, NODES)
            nodes = stored(cut(nodes, located).unionByName(fresh), "trie-nodes")
            pending = leaving.join(chosen.select("seq"), "seq", "left_anti").select("seq", "path", "cum", "len")
    return nodes


# ---- sums over subtrees -------------------------------------------------------------------------------------------

SUMS = ("n", "leaves", "weighted", "words")


def subtree_sums(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Every node with kids, ends and, over its subtree: n, least, leaves, weighted (words up to where each conversation ends) and words (of all edges)."""
    spark = nodes.sparkSession
    root = spark.createDataFrame([(ROOT, None, 0, 0, b"", bytes(8))], NODES)
    kids = nodes.groupBy(F.col("up").alias("_up")).agg(F.count(F.lit(1)).alias("kids"))
    ends = found.select(F.col("seq").alias("_seq"), F.col("n").alias("_n"), F.col("least").alias("least"), F.col("ends").alias("ends"))
    whole = nodes.unionByName(root).join(kids, F.col("ext") == F.col("_up"), "left").join(ends, F.col("ext") == F.col("_seq"), "left")
    start = stored(whole.withColumn("kids", F.coalesce("kids", F.lit(0))).drop("_up", "_seq"), "trie-whole")

    def words_at(place: int) -> Column:
        """Words up to an edge's start (0) or end (-1)."""

        @F.arrow_udf("long")
        def read(cum: pa.Array) -> pa.Array:
            return pa.array([int(np.frombuffer(c, np.int64)[place]) for c in cum.to_pylist()], pa.int64())

        return read("cum")

    own = F.coalesce("_n", F.lit(0))
    sums = stored(start.select("ext", F.col("up").alias("far"), "least", own.alias("n"), (F.col("kids") == 0).cast("long").alias("leaves"),
                               (own * words_at(-1)).alias("weighted"), (words_at(-1) - words_at(0)).alias("words")), "trie-sums")
    while not sums.where(F.col("far").isNotNull()).isEmpty():
        below = sums.where(F.col("far").isNotNull()).groupBy(F.col("far").alias("_far")).agg(F.min("least").alias("_least"), *[F.sum(c).alias(f"_{c}") for c in SUMS])
        further = sums.select(F.col("ext").alias("_from"), F.col("far").alias("_further"))
        on = F.col("far").isNotNull() & (F.col("far") != F.lit(ROOT))
        jumped = sums.join(below, F.col("ext") == F.col("_far"), "left").withColumn("_via", F.when(on, F.col("far")).otherwise(F.col("ext"))).join(further, F.col("_via") == F.col("_from"), "left")
        sums = stored(jumped.select("ext", F.when(on, F.col("_further")).alias("far"), F.least("least", "_least").alias("least"),
                                    *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in SUMS]), "trie-sums")
    summed = sums.select(F.col("ext").alias("_ext"), *SUMS, F.col("least").alias("member"))
    return start.drop("least", "_n").join(summed, F.col("ext") == F.col("_ext")).drop("_ext")


RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def expanded(summed: DataFrame) -> DataFrame:
    """One row per depth of every edge, and the root's."""
    held = stored(summed, "trie-summed")
    parents = held.select(F.col("ext").alias("_parent"), F.col("member").alias("above"))
    met = held.join(parents, F.coalesce("up", "ext") == F.col("_parent"), "left")
    names = [c.split()[0] for c in RESULT.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[] for _ in names]
            for up, lo, hi, cum, kids, ends, n, leaves, weighted, words, member, above in zip(*(batch.column(c).to_pylist() for c in (
                    "up", "lo", "hi", "cum", "kids", "ends", "n", "leaves", "weighted", "words", "member", "above"))):
                upto = np.frombuffer(cum, np.int64).tolist()
                for depth in range(lo + 1, hi + 1) if up is not None else [0]:
                    top = upto[depth - 1 - lo] if depth else 0
                    saved = weighted - n * top - (words - (top - upto[0]))
                    parent = None if up is None else above if depth == lo + 1 else member
                    values = (member, depth, parent, n, kids if depth == hi else 1, leaves, saved, ends if depth == hi and ends else NO_ENDS)
                    for column, value in zip(made, values):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in made[:-1]), pa.array(made[-1], pa.string())], names=names)

    return met.mapInArrow(rows, RESULT)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations given as rows (conv_id, p, token, words)."""
    bounded_batches(turns.sparkSession)
    found = stored(sequences(stored(paths(turns), "trie-paths")), "trie-sequences")
    if found.isEmpty():
        return turns.sparkSession.createDataFrame([], RESULT)
    return expanded(subtree_sums(build(found), found))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations with the openings of their families."""
    return prefix_trie(with_shared_openings(numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


SQL = f"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as p,
    octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') as token,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as words
  from conversations where conv_id is not null
), known as (
  select conv_id, {crc32_sql('conv_id')} % 4 as h from (select distinct conv_id from turns)
), rebuilt as (
  select t.conv_id, p, md5(token) as token, words from turns t join known k on t.conv_id = k.conv_id where p >= h
  union all
  select k.conv_id, p, md5(token), words from known k join turns t on t.conv_id = k.conv_id - k.conv_id % 20 where p < least(h, 3)
), seqs as (
  select k.conv_id, coalesce(list(token order by p) filter (token is not null), []) as tokens, coalesce(list(words order by p) filter (token is not null), []) as words
  from known k left join rebuilt r on k.conv_id = r.conv_id group by k.conv_id
), members as (
  select conv_id, d, array_to_string(tokens[1:d], ' ') as node, array_to_string(tokens[1:d - 1], ' ') as up, words[d] as words, len(tokens) as n
  from (select *, unnest(range(0, len(tokens) + 1)) as d from seqs)
), nodes as (
  select node, d, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '')) as ends_sha256
  from members group by node, d
), childless as (
  select *, not exists (select 1 from nodes c where c.up = nodes.node and c.d = nodes.d + 1) as leaf from nodes
), below as (
  select distinct a.node as top, a.d as top_d, b.node, b.d from members a join members b on a.conv_id = b.conv_id and a.d <= b.d
), sums as (
  select top, top_d, count(*) filter (leaf) as n_leaves, sum((n_convs - 1) * coalesce(words, 0))::bigint as saved_tokens
  from below join childless using (node, d) group by top, top_d
)
select n.conv_id, n.d::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, (select count(*) from nodes c where c.up = n.node and c.d = n.d + 1) as n_children,
  n_leaves, saved_tokens, n.ends_sha256
from nodes n join sums s on n.node = s.top and n.d = s.top_d left join nodes p on n.d > 0 and p.node = n.up and p.d = n.d - 1
"""
