"""Quality classification from weak labels.

Heuristic labellers vote bad or good, or abstain, on every document. Most know one kind of junk, and kinds exclude each other, so the labeller model has one good class and
one bad class per labeller; each labeller's votes are drawn from a distribution of its own per class, independent given the class. Expectation-maximisation, begun from
the bad votes, fits these accuracies to the numbers of all vote patterns, which are exact and at most 3 per labeller multiplied together; documents on which all abstain count as good. The posteriors label
a bounded sample, half of it reviewed documents and half others, on which a linear scorer over hashed features learns; the scorer judges every document.

Two such models are fitted: ``quality`` (junk: symbols, shouting, repetition, tables, no sentences, odd word lengths, no function words) and
``toxic`` (insults, and reviewers' labels where a table has them: one more labeller, which abstains on other documents). A document is rejected if either
scorer finds it more likely bad than not.

Features: presence of each lower-case word and of each word's first five bytes, and the share of words of each shape (runs of capitals, small letters, digits,
and marks as they are) and of words that repeat the one before.

Edge cases: null and empty texts get no votes and are kept; short texts (under ``LEAST_WORDS`` words) get votes on insults only; repeated rows are judged alike;
without rows, or with one class only, the scorer keeps everything; labels with null values abstain and of several labels of an id the largest counts. Columns
named ``weak_*`` are the operator's own and replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import bounded_batches, gram_hashes, lowered, mixed, pieces, rows_of_words, stored, text_buffer, word_hashes, word_spans
from marquee.llm.license_join import LICENSE_WORDS

# Frequent function words of English, French, German and Spanish, and common insults.
FUNCTION_WORDS = (
    "the of and to in is that for it was on are as with be at by this have from or an "
    "le la les des une est et que dans pour qui sur au par il ne se "
    "der die das und den von zu mit ist ein eine nicht auf sich des im dem "
    "el los las una que por con para su se del es lo como"
).split()
INSULTS = (
    "idiot idiots moron morons stupid loser losers pathetic scum worthless trash disgusting clown imbecile dumb "
    "bastard jerk scumbag retard degenerate filthy ugly"
).split()

QUALITY = ("symbols", "shouting", "repetition", "table", "sentences", "word_length", "function_words")
TOXIC = ("insult", "insults", "reviewed")
GOOD, BAD, NONE = 0, 1, 2
LEAST_WORDS = 20
#: By so much each round lessens the bad votes of the good class: labellers seldom fire without reason. Without it, a kind of junk that one labeller alone
#: knows could as well be that labeller's error.
PRIOR = 0.1
#: Bound on the sample of rows that the scorers learn from, and on its text.
SAMPLE_ROWS = 8_000
BITS = 18
#: Passes over the sample, and steps at least.
EPOCHS, LEAST_STEPS = 8, 400


def _table(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[[ord(c) for c in chars]] = 1
    return table


SYMBOLS, UPPER, BAR, ENDS = _table("#*$%&|<>{}~^=_"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("|\t"), _table(".!?\"')")
LETTERS = UPPER + _table("abcdefghijklmnopqrstuvwxyz")
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B], _SHAPE[0x61:0x7B], _SHAPE[0x30:0x3A], _SHAPE[0x80:] = 0x41, 0x61, 0x39, 0x61


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return np.unique(word_hashes(data, starts, ends))


def _member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def votes(texts: pa.Array) -> dict[str, np.ndarray]:
    """Each labeller's vote on each text."""
    raw, offsets = text_buffer(texts)
    rows = len(offsets) - 1
    data = lowered(raw)
    starts, ends, firsts = word_spans(data, offsets)
    row, words = rows_of_words(firsts), word_hashes(data, starts, ends)
    n = np.diff(firsts)

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[raw])])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.bincount(row[flags], minlength=rows)

    def vote(bad: np.ndarray, good: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.where(known & bad, BAD, np.where(known & good, GOOD, NONE)).astype(np.int8)

    grams = gram_hashes(words, 3)
    inside = (row[: len(grams)] == row[2:]) if len(grams) else np.zeros(0, bool)
    salted = grams[inside] ^ mixed(row[: len(grams)][inside].astype(np.uint64) + np.uint64(1))
    _, where = np.unique(salted, return_index=True)
    distinct = np.bincount(row[: len(grams)][inside][where], minlength=rows) / np.maximum(n - 2, 1)
    plain_starts, plain_ends, plain_firsts = word_spans(data, offsets, LICENSE_WORDS)
    plain, plain_row = word_hashes(data, plain_starts, plain_ends), rows_of_words(plain_firsts)
    hits = _member(plain, _hashes(INSULTS))
    some = np.bincount(plain_row[hits], minlength=rows)
    kinds = np.bincount(np.unique(plain_row[hits].astype(np.uint64) * np.uint64(1 << 32) + (plain[hits] >> np.uint64(32))) .astype(np.int64) >> 32, minlength=rows) if hits.any() else some
    function = np.bincount(plain_row[_member(plain, _hashes(FUNCTION_WORDS))], minlength=rows) / np.maximum(n, 1)
    size, known = np.maximum(n, 1), n >= LEAST_WORDS
    symbols, upper, bars = count(SYMBOLS) / size, count(UPPER) / np.maximum(count(LETTERS), 1), count(BAR) / size
    length = np.bincount(row, ends - starts, minlength=rows) / size
    stops = per_row(ENDS[raw[ends - 1]] > 0) / size
    return {
        "symbols": vote(symbols > 0.1, symbols <= 0.1, known),
        "shouting": vote(upper > 0.5, upper <= 0.5, known),
        "repetition": vote(distinct < 0.5, distinct >= 0.5, known),
        "table": vote(bars > 0.1, bars <= 0.1, known),
        "sentences": vote(stops > 0.7, stops <= 0.7, known),
        "word_length": vote((length < 2.5) | (length > 14), (length >= 2.5) & (length <= 14), known),
        "function_words": vote(function < 0.01, function > 0.05, known),
        "insult": vote(some > 0, some == 0, n > 0),
        "insults": vote(kinds > 1, kinds <= 1, n > 0),
    }


def fitted(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """EM: each labeller's vote distribution [labeller, class, vote] (class 0 is good), the share of the bad classes, and each pattern's posterior of being bad."""
    labellers = patterns.shape[1]
    voted = (patterns != NONE).any(1)
    counts = counts * voted
    bad = patterns == BAD
    q = np.where(bad.any(1)[None, :], np.vstack([np.full(len(patterns), 0.1), 0.9 * bad.T / np.maximum(bad.sum(1), 1)]), np.vstack([np.full(len(patterns), 0.98), np.full((labellers, len(patterns)), 0.02 / labellers)]))
    for _ in range(rounds):
        weight = q * counts
        share = (weight.sum(1) + 0.5) / (counts.sum() + 0.5 * len(q))
        given = np.stack([np.stack([(weight * (patterns[:, j] == v)).sum(1) + 0.1 for v in range(3)], 1) for j in range(labellers)])
        given /= given.sum(2, keepdims=True)
        # The prior shrinks the good class's bad votes in favour of its good ones; abstentions stay as counted.
        shrunk = given[:, 0, BAD] * (1 - PRIOR)
        given[:, 0, GOOD] += given[:, 0, BAD] - shrunk
        given[:, 0, BAD] = shrunk
        like = sum(np.log(given[j])[:, patterns[:, j]] for j in range(labellers)) + np.log(share)[:, None]
        q = np.exp(like - like.max(0))
        q /= q.sum(0)
    return given, float(1 - share[0]), np.where(voted, 1 - q[0], 0.0)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hashed index and value of every feature."""
    raw, offsets = text_buffer(texts)
    rows, mask = len(offsets) - 1, np.uint64((1 << BITS) - 1)
    data = lowered(raw)
    starts, ends, firsts = word_spans(data, offsets, LICENSE_WORDS)
    row = rows_of_words(firsts).astype(np.uint64) << np.uint64(BITS)
    present = np.unique(np.concatenate([row | word_hashes(data, starts, e, seed) & mask for e, seed in ((ends, 1), (np.minimum(ends, starts + 5), 2))]))
    # Shapes: byte classes with runs collapsed.
    starts, ends, firsts = word_spans(raw, offsets)
    n = np.diff(firsts)
    shape = _SHAPE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shapes = word_hashes(shape[keep], at[starts], at[ends], 3) & mask
    row = rows_of_words(firsts)
    words = word_hashes(raw, starts, ends)
    again = np.flatnonzero((words[1:] == words[:-1]) & (row[1:] == row[:-1])) + 1
    shapes = np.concatenate([shapes, np.full(len(again), 12345, np.uint64)])
    row = np.concatenate([row, row[again]])
    shared, count = np.unique(row.astype(np.uint64) << np.uint64(BITS) | shapes, return_counts=True)
    owner = np.concatenate([present, shared]) >> np.uint64(BITS)
    owner = owner.astype(np.int64)
    values = np.concatenate([np.full(len(present), 0.1), 4.0 * count / (n + 20)[owner[len(present):]]])
    return owner, (np.concatenate([present, shared]) & mask).astype(np.int64), values.astype(np.float32)


def learned(row: np.ndarray, index: np.ndarray, value: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of a logistic scorer (the last is the bias), by adaptive gradient steps over batches in a fixed order."""
    size = 1 << BITS
    w, seen = np.zeros(size + 1), np.full(size + 1, 1e-6)
    shuffled = np.random.default_rng(5).permutation(len(target))
    place = np.empty(len(target), np.int32)
    place[shuffled] = np.arange(len(target))
    row, target = place[row], target[shuffled]
    order = np.argsort(row, kind="stable").astype(np.int32)
    row, index, value = row[order], index[order], value[order]
    del order
    step = 128
    cuts = np.searchsorted(row, np.arange(0, len(target) + step, step))
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * step // max(len(target), 1)))):
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            low = k * step
            t = target[low : low + step]
            if not len(t):
                continue
            score = np.bincount(row[a:b] - low, value[a:b] * w[index[a:b]], minlength=len(t)) + w[size]
            slope = 1 / (1 + np.exp(-score)) - t
            gradient = np.append(np.bincount(index[a:b], value[a:b] * slope[row[a:b] - low], minlength=size), slope.sum())
            seen += gradient * gradient
            w -= 0.5 * gradient / np.sqrt(seen)
    return w.astype(np.float32)


def labelled_votes(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """doc_id, text_hash and every labeller's vote of every row, written to the shared folder; ``docs`` has doc_id and text."""
    names = [*QUALITY, *TOXIC[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                found = votes(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(found[name], pa.int8()) for name in names)], ["doc_id", "text_hash", *names])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    cast = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {id_type}, text_hash long, " + ", ".join(f"{n} tinyint" for n in names))
    cast = stored(cast, "votes")
    if labels is None:
        return cast.withColumn("reviewed", F.lit(NONE).cast("tinyint"))
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("tinyint").alias("reviewed"))
    return cast.join(known, "doc_id", "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(NONE).cast("tinyint")))


class WeakLabels:
    """A labeller model over some of the vote columns."""

    def __init__(self, cast: DataFrame, names: tuple[str, ...]):
        rows = cast.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most three votes per labeller
        self.names = names
        patterns = np.array([[r[n] for n in names] for r in rows], np.int64).reshape(-1, len(names))
        self.accuracies, self.share, posterior = fitted(patterns, np.array([r.n for r in rows], float)) if rows else (None, 0.0, [])
        self.posterior = {tuple(p): float(x) for p, x in zip(patterns.tolist(), posterior)}


def scorers(docs: DataFrame, labels: DataFrame | None) -> tuple[np.ndarray, dict[str, WeakLabels]]:
    """Weights of the two scorers, and their labeller models."""
    cast = stored(labelled_votes(docs, labels), "reviewed-votes")
    models = {"quality": WeakLabels(cast, QUALITY), "toxic": WeakLabels(cast, TOXIC)}
    size = 2 * ((1 << BITS) + 1)
    reviewed = F.col("reviewed") != NONE
    rows = {r.reviewed: r.n for r in cast.groupBy(reviewed.alias("reviewed")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not rows:
        return np.zeros(size, np.float32), models
    # Half of the bound for rows with a review and half for the others, at every size; what one half leaves free is the other's.
    known, other = rows.get(True, 0), rows.get(False, 0)
    shares = [min(1.0, 0.95 * max(SAMPLE_ROWS // 2, SAMPLE_ROWS - rest) / max(n, 1)) for n, rest in ((known, other), (other, known))]
    spread = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 20)) < F.when(reviewed, int((1 << 20) * shares[0]) + 1).otherwise(int((1 << 20) * shares[1]) + 1)
    chosen = cast.where(spread).limit(SAMPLE_ROWS).dropDuplicates(["doc_id", "text_hash"])
    sample = docs.withColumn("text_hash", F.xxhash64("text")).join(
        F.broadcast(chosen.withColumnRenamed("doc_id", "chosen_id").withColumnRenamed("text_hash", "chosen_hash")),  # at most SAMPLE_ROWS short rows
        F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("text_hash") == F.col("chosen_hash")))
    names = {k: list(m.names) for k, m in models.items()}
    posterior = {k: m.posterior for k, m in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, parts, targets = 0, [], {k: [] for k in names}
        for batch in batches:
            for part in pieces(batch, "text"):
                row, index, value = features(part.column(part.schema.get_field_index("text")))
                parts.append(((row + rows).astype(np.int32), index.astype(np.int32), value))
                rows += len(part)
                for k, columns in names.items():
                    cast = zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in columns))
                    targets[k] += [posterior[k][v] for v in cast]
        if rows:
            row, index, value = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            weights = [learned(row, index, value, np.array(targets[k])) for k in names]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(weights)], pa.list_(pa.float32()))], ["weights"])

    columns = ["text", *QUALITY, *TOXIC]
    # The sample is bounded, so one task can learn from it; its order is fixed.
    fit = sample.select("doc_id", "text_hash", *columns).repartition(1).sortWithinPartitions("doc_id", "text_hash").select(*columns).mapInArrow(run, "weights array<float>").collect()
    return np.array(fit[0].weights, np.float32) if fit else np.zeros(size, np.float32), models


def judged(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``weak_bad`` and ``weak_toxic``: the scorers' log odds that the document is bad."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop("weak_bad", "weak_toxic")
    weights, _ = scorers(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    shared = spark.sparkContext.broadcast(weights.reshape(2, -1))  # bounded by the number of hashed features
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for part in pieces(batch, text_col):
                row, index, value = features(part.column(at))
                scores = [np.bincount(row, value * x[index], minlength=len(part)) + x[-1] for x in w]
                full = np.bincount(row, minlength=len(part)) > 0
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(np.where(full, s, -1.0)) for s in scores)], [*part.schema.names, "weak_bad", "weak_toxic"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, weak_bad double, weak_toxic double")


KEEP = "weak_bad <= 0 and weak_toxic <= 0"


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    sigmoid = lambda c: 1 / (1 + F.exp(-F.col(c)))
    return found.select("doc_id", sigmoid("weak_bad").alias("p_junk"), sigmoid("weak_toxic").alias("p_toxic"), F.expr(KEEP).alias("kept"))
