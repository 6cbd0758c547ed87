"""Packing of examples into fixed sequences as vector bin packing with the dot-product heuristic.

An example has a length in tokens, takes one segment of the sequence it is put in, and has loss-bearing tokens (its last
ones: an answer follows its prompt). A sequence is limited in all three. The open sequence takes, among the examples that fit,
the one with the largest dot product of demand and remaining room, both as shares of the limits: demands that look like what is
left. With ``cut=True``, when none fits, the example with the largest product is cut to fill the sequence exactly, and whatever is
longer than a sequence gives whole sequences first; an example that no limit could ever hold is an error without cuts.

Rows are dealt to groups of bounded size by a hash, their number following the input, and every group is packed in its own
task; one sequence per group may stay partly filled. Token ids travel in the same shuffle, so texts are tokenised once and
real sequences come out: each piece carries its ids.

Edge cases: a null text is an empty example; every row is packed, repeated rows included; an empty table gives no
piece; only the id and text columns are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import bounded_batches

SEQUENCE_TOKENS = 2048
MAX_SEGMENTS = 512
GROUP_ROWS = 2048
GROUP_BYTES = 8 << 20
#: Texts per task that both encoders encode, and the run of non-blanks or of blanks that only the plain one does.
CHECKED_TEXTS = 8
LONG_RUN = 10_000
#: Looked for from the beginning of each run, so that many runs just shorter take linear time.
LONG_RUNS = re.compile(rf"(?<!\S)\S{{{LONG_RUN}}}|(?<!\s)\s{{{LONG_RUN}}}")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _vocabulary_bytes(path: str) -> dict[bytes, int]:
    """The bytes of every piece of a byte-level vocabulary file, which writes bytes as printable characters."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    special = {x["content"] for x in given["added_tokens"]}
    return {bytes(byte_of[c] for c in piece): i for piece, i in given["model"]["vocab"].items() if piece not in special}


class FastTokenizer:
    """Token ids of whole texts by a byte-pair vocabulary file.

    A merge vocabulary numbers its pieces in the order of merges, so the file's ids serve as ranks for the faster of two encoders of the same
    rule. The plain one encodes the first texts of every task as well and takes over if any id differs, and it encodes texts with runs of ``LONG_RUN``
    characters without a blank, for which the fast one needs quadratic time, or of as many blanks, on which it fails when they grow to a million.
    The plain one alone knows the added tokens of the file (``<|endoftext|>``), so texts that quote one are its own too.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.added = [token.content for token in self.plain.get_added_tokens_decoder().values()]
        self.dtype = np.uint16 if self.plain.get_vocab_size() < 1 << 16 else np.uint32
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_vocabulary_bytes(path), special_tokens={})
        self.unchecked = CHECKED_TEXTS

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        if self.fast is None or any(token in text for token in self.added) or (len(text) >= LONG_RUN and LONG_RUNS.search(text)):
            return self._plain(text).tobytes()
        ids = self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.dtype)
        if self.unchecked:
            self.unchecked -= 1
            expected = self._plain(text)
            if not np.array_equal(ids, expected):
                self.fast = None
                return expected.tobytes()
        return ids.tobytes()


def tokenized(docs: DataFrame, vocabulary: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pack_group and the packed ids (with ``end_id`` last) of every row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = FastTokenizer(vocabulary)
        end = b"" if end_id is None else np.array([end_id], tokenizer.dtype).tobytes()
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                ids = pa.array([tokenizer.encode(t or "") + end for t in part.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids], ["doc_id", "pack_group", "ids"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    groups = max(1, -(-rows // GROUP_ROWS), -(-size // GROUP_BYTES))
    # Row numbers follow the input's partitions, so a task that is run again deals its rows alike.
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    return docs.select(F.col(id_col), group.alias("pack_group"), F.col(text_col)).mapInArrow(run, f"doc_id {id_type}, pack_group long, ids binary")


def packed(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int], cut: bool) -> list[tuple[int, int, int, int, int]]:
    """Pieces (example, start, length, sequence, offset) of one group; ``loss`` counts the loss-bearing tokens at an example's end."""
    top = np.array(limits, np.int64)
    pieces: list[tuple[int, int, int, int, int]] = []
    start = np.zeros(len(tokens), np.int64)
    left, owed = tokens.astype(np.int64), np.minimum(loss, tokens).astype(np.int64)
    if not cut and ((left > top[0]) | (owed > top[2])).any():
        raise ValueError("an example exceeds the limits of a sequence")
    sequence = 0

    def loss_in(item: int, n: int) -> int:
        return max(0, n - int(left[item] - owed[item]))

    def reach(item: int, room: np.ndarray) -> int:
        """Tokens of an example that fit into the room."""
        free = int(left[item] - owed[item])
        return min(int(left[item]), int(room[0]), free + int(room[2]))

    # Whole sequences first, by longest examples.
    whole = limits[0]
    if cut:
        for item in np.flatnonzero(left >= whole).tolist():
            while left[item] >= whole and loss_in(item, whole) <= top[2]:
                owed[item] -= loss_in(item, whole)
                pieces.append((item, int(start[item]), whole, sequence, 0))
                start[item] += whole
                left[item] -= whole
                sequence += 1
    open_ = np.flatnonzero(left > 0)
    room, offset = top.copy(), 0
    while len(open_):
        demand_t, demand_l = left[open_], owed[open_]
        score = demand_t * (room[0] / top[0] ** 2) + demand_l * (room[2] / top[2] ** 2)
        fits = (demand_t <= room[0]) & (demand_l <= room[2])
        best = -1
        if room[1] > 0:
            if fits.any():
                best = int(np.argmax(np.where(fits, score, -1.0)))
                n = int(demand_t[best])
            elif cut and room[0] > 0:
                best = int(np.argmax(score))
                n = reach(int(open_[best]), room)
                best = best if n > 0 else -1
        if best < 0:
            sequence, room, offset = sequence + 1, top.copy(), 0
            continue
        item = int(open_[best])
        bears = loss_in(item, n)
        pieces.append((item, int(start[item]), n, sequence, offset))
        offset += n
        room -= np.array([n, 1, bears])
        start[item] += n
        left[item] -= n
        owed[item] -= bears
        if left[item] == 0:
            open_ = np.delete(open_, best)
        if room[0] == 0 or room[1] == 0:
            sequence, room, offset = sequence + 1, top.copy(), 0
    return pieces


PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int | None = 1, limits: tuple[int, int, int] = (SEQUENCE_TOKENS, MAX_SEGMENTS, SEQUENCE_TOKENS),
         cut: bool = True, loss_share: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, its start among the example's ids, length, the example's tokens, sequence_id and offset there, and the
    ids (little-endian unsigned 32-bit). ``limits``: tokens, segments and loss-bearing tokens of a sequence;
    ``loss_share``: the share of an example, at its end, that bears loss (1 for plain text)."""
    vocabulary = vocabulary or default_vocabulary()
    source = tokenized(docs, vocabulary, end_id, id_col, text_col)
    width = np.dtype(FastTokenizer(vocabulary).dtype).itemsize

    def run(table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table, [("doc_id", "ascending"), ("ids", "ascending")])
        table = table.take(order)
        ids = table.column("ids").combine_chunks()
        tokens = np.asarray(pa.compute.binary_length(ids)).astype(np.int64) // width
        found = packed(tokens, np.ceil(tokens * loss_share).astype(np.int64), limits, cut)
        item, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 5
        first = int(table.column("pack_group")[0].as_py()) << 32
        wide = [np.frombuffer(ids[i].as_buffer(), f"<u{width}", count=n, offset=s * width).astype("<u4").tobytes() for i, s, n in zip(item.tolist(), start.tolist(), length.tolist())]
        return pa.table({
            "doc_id": table.column("doc_id").take(pa.array(item)), "start": start, "length": length, "doc_tokens": tokens[item],
            "sequence_id": first + sequence, "offset": offset, "ids": pa.array(wide, pa.binary()),
        })

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.groupBy("pack_group").applyInArrow(run, f"doc_id {id_type}, {PIECES}")


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with ``ids_crc32`` in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_vector_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return piece_digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
