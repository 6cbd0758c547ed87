"""Repeated passages by a sparse suffix array over words.

1. Distinct texts are classes, numbered in the order of their smallest id; copies of a text are passages as a whole.
2. Of every ``WINDOW`` consecutive k-word grams the one with the least hash is an anchor. Any passage of ``MIN_WORDS`` words holds a whole window, so equal
   passages have an anchor at the same place, with at least ``PREFIX`` = MIN_WORDS - WINDOW + 1 of their words from there on. Only suffixes that begin at anchors are retained.
3. The suffixes are sorted by a hash of their first ``PREFIX`` words, which brings equal beginnings together (dedup needs no other order). Each is compared with its
   neighbours, those at the borders of sorted partitions through a table of one row per border. Suffixes without an equal neighbour are done.
4. Around the others matches are extended, left to the passages that have this anchor and right to ``MIN_WORDS`` words: every passage with that anchor is compared in full,
   by 128-bit hashes. The first occurrence (by class, place) stays; the others are repeats, and repeats that overlap or touch grow into maximal spans on both sides.
   Repeats of an earlier text go whole, also where a first occurrence of another passage holds some of their words; only within a text
   a first occurrence keeps its words, from repeats whose source overlaps it.

A frequent passage is no hot spot: the sort also orders by class and place, so equal suffixes spread over partitions; passages are reduced to their first
occurrence before the shuffle, and joined to a side with unique keys.

Joins whose sides grow with the input are merge joins at every size, so that small runs tell how large ones behave.

Edge cases: null and short texts have no passages; in self-overlapping repeats (one word a thousand times) the first occurrence stays whole if no earlier text holds it; rows that repeat both id and text are
copies of one row and stay; null ids come last; an empty table gives an empty result. Columns named ``suffix_*`` are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import bounded_batches, gram_hashes, lowered, pieces, stored, text_buffer, word_hashes, word_spans

MIN_WORDS = 50
GRAM = 6
WINDOW = 32
PREFIX = MIN_WORDS - WINDOW + 1
LAST_ID = (1 << 63) - 1


def sliding(values: np.ndarray, pick: np.ufunc, width: int) -> np.ndarray:
    """Least or largest of every ``width`` (a power of two) consecutive values, by doubling."""
    step = 1
    while step < width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def anchored(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one text: gram hashes, the least hash of each window of grams, and the places of anchors."""
    grams = gram_hashes(words, GRAM)
    if len(words) < MIN_WORDS:
        return grams, grams[:0], np.zeros(0, np.int64)
    least = sliding(grams, np.minimum, WINDOW)
    # A gram is an anchor if it is the least of some window over it: the largest such window's least is itself.
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
    return grams, least, np.flatnonzero(sliding(padded, np.maximum, WINDOW) == grams)


def _text_words(part: pa.RecordBatch, column: int, seeds: tuple[int, ...] = (0,)) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_buffer(part.column(column))
    starts, ends, firsts = word_spans(data, offsets)
    data = lowered(data)
    return [word_hashes(data, starts, ends, seed) for seed in seeds], firsts, starts, ends


def suffixes(docs: DataFrame) -> DataFrame:
    """Per row of doc_id and text: digest of the text, words, and the keys and places of its retained suffixes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                (words,), firsts, _, _ = _text_words(part, 2)
                keys, places = [], []
                for a, b in zip(firsts.tolist(), firsts[1:].tolist()):
                    _, _, at = anchored(words[a:b])
                    at = at[at + PREFIX <= b - a]
                    keys.append(gram_hashes(words[a:b], PREFIX)[at].view(np.int64))
                    places.append(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(np.diff(firsts), pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())),
                ], ["doc_id", "digest", "n_words", "keys", "places"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    source = docs.where("text is not null").select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text")
    return source.mapInArrow(run, f"doc_id {id_type}, digest binary, n_words long, keys array<long>, places array<int>")


def equal_neighbours(entries: DataFrame) -> DataFrame:
    """cls and place of the suffixes (key, cls, place) that have an equal neighbour in the sorted order."""
    spark = entries.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pending, fresh = TaskContext.get().partitionId(), None, True

        def made(rows: tuple, again: np.ndarray, first: bool, last: bool) -> pa.RecordBatch:
            border = np.zeros(len(again), np.int8)
            border[0] += 1 if first else 0
            border[-1] += 2 if last else 0
            return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(again), pa.array(np.full(len(again), part, np.int32)), pa.array(border)], ["key", "cls", "place", "again", "part", "border"])

        for batch in batches:
            if not len(batch):
                continue
            rows = tuple(np.asarray(c) for c in batch.columns)
            if pending is not None:  # the last row waits for its successor
                rows = tuple(np.concatenate([p, r]) for p, r in zip(pending[0], rows))
            same = rows[0][1:] == rows[0][:-1]
            again = np.zeros(len(rows[0]), bool)
            again[1:] |= same
            again[:-1] |= same
            if pending is not None:
                again[0] |= pending[1]
            if len(again) > 1:
                yield made(tuple(r[:-1] for r in rows), again[:-1], fresh, False)
                fresh = False
            pending = tuple(r[-1:] for r in rows), bool(again[-1])
        if pending is not None:
            yield made(pending[0], np.array([pending[1]]), fresh, True)

    ordered = entries.repartitionByRange(count, "key", "cls", "place").sortWithinPartitions("key", "cls", "place")
    ranked = stored(ordered.mapInArrow(run, "key long, cls long, place int, again boolean, part int, border tinyint"), "suffix-order")
    borders = ranked.where("border > 0").select("part", "border", "key").collect()  # two rows per partition
    firsts = {r.part: r.key for r in borders if r.border & 1}
    lasts = {r.part: r.key for r in borders if r.border & 2}
    parts = sorted(firsts)
    touching = set()
    for p, q in zip(parts, parts[1:]):
        if lasts[p] == firsts[q]:
            touching |= {(p, 2), (q, 1)}
    found = ranked.where("again").select("cls", "place")
    if touching:
        edge = spark.createDataFrame(sorted(touching), "part int, side int")
        lone = ranked.where("border > 0 and not again").join(F.broadcast(edge), "part").where(F.col("border").bitwiseAND(F.col("side")) > 0)
        found = found.union(lone.select("cls", "place").distinct())
    return found


def passages(texts: DataFrame) -> DataFrame:
    """All passages of MIN_WORDS words whose anchor is among a text's ``places``: two hashes, class and first word. ``texts``: cls, places, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                (words, other), firsts, _, _ = _text_words(part, 2, (0, 7))
                out: list[tuple[np.ndarray, ...]] = []
                for cls, places, a, b in zip(part.column(0).to_pylist(), part.column(1), firsts.tolist(), firsts[1:].tolist()):
                    grams, least, _ = anchored(words[a:b])
                    at = np.asarray(places.values)
                    starts = at[:, None] - np.arange(WINDOW)
                    valid = (starts >= 0) & (starts <= b - a - MIN_WORDS)
                    starts_ok = np.where(valid, starts, 0)
                    hit = valid & (least[starts_ok] == grams[at][:, None]) if len(least) else valid & False
                    s = np.unique(starts[hit])
                    if len(s):
                        out.append((gram_hashes(words[a:b], MIN_WORDS)[s].view(np.int64), gram_hashes(other[a:b], MIN_WORDS)[s].view(np.int64), np.full(len(s), cls, np.int64), s.astype(np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["h1", "h2", "cls", "start"])

    return texts.select("cls", "places", "text").mapInArrow(run, "h1 long, h2 long, cls long, start int")


def merged(repeats: list[tuple[int, int, int]], firsts: list[int], n: int, cls: int) -> list[tuple[int, int, int, int]]:
    """Maximal spans (start, end, source class, source start) of the words of text ``cls`` that repeats (start, source class, source start) cover.

    A repeat of an earlier text goes whole. One of the same text leaves the words of the first occurrences that its source overlaps: the source
    itself is one, so what goes begins after the last of them.
    """
    starts, sources, places = (np.array(x, np.int64) for x in zip(*repeats))
    kept = np.sort(np.array(firsts, np.int64))
    own = np.flatnonzero(sources == cls)
    begins = starts.copy()
    begins[own] = np.maximum(starts[own], kept[np.searchsorted(kept, places[own] + MIN_WORDS - 1, "right") - 1] + MIN_WORDS) if len(own) else starts[own]
    ends = starts + MIN_WORDS
    some = begins < ends
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, begins[some], 1)
    np.add.at(cover, ends[some], -1)
    gone = np.cumsum(cover)[:n] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    order = np.argsort(starts, kind="stable")
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        # A repeat that covers the span's first word.
        i = order[max(0, int(np.searchsorted(starts[order], a, "right")) - 1)]
        out.append((a, b, repeats[i][1], repeats[i][2] + a - repeats[i][0]))
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated span: doc_id, digest (MD5 of the text), start_word, end_word (after the last), source_id and source_start."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = suffixes(texts)
    rows = stored(rows, "suffixes")
    one = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"), F.first("places").alias("places"))
    order = [F.col("first_id").asc_nulls_last(), F.col("digest")]
    numbered = one.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    classes = stored(numbered.withColumn("cls", F.monotonically_increasing_id()), "suffix-classes")
    entries = classes.select("cls", F.explode(F.arrays_zip("keys", "places")).alias("x")).select(F.col("x.keys").alias("key"), "cls", F.col("x.places").alias("place"))
    places = equal_neighbours(entries).groupBy("cls").agg(F.sort_array(F.collect_set("place")).alias("places"))  # of one text
    names = classes.select("cls", "first_id", "digest", "n_words")
    wanted = places.join(names, "cls").select("cls", "places", F.col("first_id").alias("doc_id"), "digest")
    same = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (F.unhex(F.md5(texts["text"])) == wanted["digest"])
    found = texts.join(wanted.hint("merge"), same).select("cls", "places", texts["text"].alias("text"))
    windows = stored(passages(found), "passages")
    occurrence = F.struct("cls", "start")
    firsts = windows.groupBy("h1", "h2").agg(F.min(occurrence).alias("first"), F.max(occurrence).alias("last")).where("first <> last").select("h1", "h2", "first")
    placed = windows.join(firsts, ["h1", "h2"]).select("cls", "start", F.col("first.cls").alias("source"), F.col("first.start").alias("source_start"), (F.col("first") == occurrence).alias("stays"))
    repeat = F.when(~F.col("stays"), F.struct("start", "source", "source_start"))
    per_text = placed.groupBy("cls").agg(F.collect_set(repeat).alias("repeats"), F.collect_set(F.when(F.col("stays"), F.col("start"))).alias("firsts"))  # of one text
    per_text = per_text.where(F.size("repeats") > 0).join(names.select("cls", "n_words"), "cls").select("cls", "repeats", "firsts", "n_words")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cls, repeats, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                out += [(cls, *span) for span in merged(sorted((r["start"], r["source"], r["source_start"]) for r in repeats), first, n, cls)]
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in columns], ["cls", "start_word", "end_word", "source", "source_start"])

    spans = per_text.mapInArrow(grow, "cls long, start_word long, end_word long, source long, source_start long")
    named = spans.join(names.select("cls", "first_id", "digest"), "cls").join(names.select(F.col("cls").alias("source"), F.col("first_id").alias("source_id")), "source")
    inside = named.select(F.col("first_id").alias("doc_id"), "digest", "start_word", "end_word", "source_id", "source_start")
    copied = classes.where(F.col("copies") > 1).select("digest", "first_id", "n_words").where(F.col("n_words") >= MIN_WORDS)
    copies = rows.select("doc_id", "digest").join(copied, "digest").where(~F.col("doc_id").eqNullSafe(F.col("first_id"))).select(
        "doc_id", "digest", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"), F.col("first_id").alias("source_id"), F.lit(0).cast("long").alias("source_start"))
    return inside.unionByName(copies)


def without_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with repeated spans cut out of the texts; texts that repeats make up wholly go as rows."""
    docs = docs.drop(*[c for c in docs.columns if c.startswith("suffix_")])
    spans = repeated_spans(docs, id_col, text_col).groupBy(F.col("doc_id").alias("suffix_id"), F.col("digest").alias("suffix_digest")).agg(
        F.collect_set(F.struct("start_word", "end_word")).alias("suffix_spans"))
    on = docs[id_col].eqNullSafe(spans["suffix_id"]) & (F.unhex(F.md5(docs[text_col])) == spans["suffix_digest"])
    joined = docs.join(spans.hint("merge"), on, "left").drop("suffix_id", "suffix_digest")
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col):
                _, firsts, starts, _ = _text_words(part, at, ())
                _, offsets = text_buffer(part.column(at))
                texts, alive = [], []
                for i, (text, spans) in enumerate(zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist())):
                    if not spans:
                        texts.append(text)
                        alive.append(True)
                        continue
                    raw, n = text.encode(), int(firsts[i + 1] - firsts[i])
                    places = np.append(starts[firsts[i] : firsts[i + 1]] - offsets[i], len(raw)).tolist()
                    kept, last = [], 0
                    for s in sorted(spans, key=lambda s: s["start_word"]):
                        kept.append(raw[last : places[s["start_word"]]])
                        last = max(last, places[s["end_word"]])
                    kept.append(raw[last:])
                    texts.append(b"".join(kept).decode())
                    alive.append(sum(s["end_word"] - s["start_word"] for s in spans) < n)
                columns = list(part.columns[:-1])
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, part.schema.names[:-1]).filter(pa.array(alive, pa.bool_()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(cut, schema)


def op9_suffix_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated spans of all documents."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("digest")
