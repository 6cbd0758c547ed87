"""Unigram encoding of text into pieces, and decoding.

The best segmentation maximises the sum of the pieces' log scores (Viterbi). Pieces are found with a double-array trie over
UTF-8 bytes: from state ``s``, byte ``b`` leads to ``base[s] + b + 1`` if ``check`` names ``s`` there. All start positions of many words walk
the trie together, and words of up to ``SHORT`` bytes run their dynamic programmes side by side; longer ones are done one by one,
their edges found in blocks. A blank stands for the white-space marker of the vocabulary, and a dummy blank goes in front. As no piece
holds a blank after another character, the best segmentation of a text is that of its blank-led words in turn (a vocabulary with such pieces
takes each text as one word), and distinct words are solved once per task.

A character that is no piece falls back to one piece per byte, each at ``FALLBACK`` below the lowest score; the marker character itself, if it
stands in a text, does so as well, so decoding gives back every text exactly. Of equal paths the one whose last piece is longest wins.

Edge cases: null text gives null ids; empty text none; repeated rows are encoded one by one; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import bounded_batches, pieces, text_buffer, word_hashes

MARKER = "▁"
FALLBACK = 10.0
SHORT = 48
BLOCK = 1 << 18
MEMO_WORDS = 400_000
PIECE_BYTES = 1 << 20


@dataclass
class Vocabulary:
    """Piece bytes (with blanks for markers; null if never matched), log scores, and the ids of the 256 byte pieces."""

    texts: list[bytes | None]
    scores: np.ndarray
    byte_ids: np.ndarray


def read_vocabulary(path: str | None = None, scores: str = "zipf") -> Vocabulary:
    """From a model file. ``zipf``: its scores are minus the piece's rank, as in merge vocabularies, and the log score is that of
    the Zipf-Mandelbrot law; ``model``: they are log scores already."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    texts: list[bytes | None] = []
    given = np.zeros(model.vocab_size())
    byte_ids = np.zeros(256, np.int32)
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
        usable = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        texts.append(piece.replace(MARKER, " ").encode() if usable else None)
        given[i] = model.get_score(i)
    normal = np.array([t is not None for t in texts])
    if scores == "zipf":
        weights = 1.0 / (np.maximum(-given, 0) + 2.7)
        given = np.log(weights / weights[normal].sum())
    given[~normal] = given[normal].min() - FALLBACK
    return Vocabulary(texts, given, byte_ids)


class DoubleArray:
    """A trie in two arrays, and the piece that ends in each state (-1: none)."""

    def __init__(self, texts: list[bytes | None]):
        keys = sorted((t, i) for i, t in enumerate(texts) if t)
        size = 1 << 18
        base, check, leaf = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = bytearray(b"\x01") * size
        free[0], self.depth = 0, max((len(t) for t, _ in keys), default=0)
        # Lone children fill the lowest gap; others look on from where the last ones were placed.
        wide = 1
        nodes, low = [(0, 0, len(keys), 0)], 258
        for state, first, last, depth in nodes:  # breadth first: the list grows while it is read
            children: list[tuple[int, int, int]] = []
            i = first
            while i < last:
                if len(keys[i][0]) == depth:
                    leaf[state] = keys[i][1]
                    i += 1
                    continue
                byte, j = keys[i][0][depth], i
                while j < last and keys[j][0][depth] == byte:
                    j += 1
                children.append((byte, i, j))
                i = j
            if not children:
                continue
            while not free[low]:
                low += 1
            codes = [c[0] + 1 for c in children]
            at = max((low if len(codes) == 1 else max(low, wide)) - codes[0], 0)
            while True:
                if at + 258 > size:
                    base, check, leaf = (np.concatenate([x, np.full(size, fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (leaf, -1)))
                    free += b"\x01" * size
                    size *= 2
                if all(free[at + c] for c in codes):
                    break
                at += 1
            if len(codes) > 1:
                wide = at + codes[0]
            base[state] = at
            for c in codes:
                free[at + c], check[at + c] = 0, state
            nodes += [(at + byte + 1, i, j, depth + 1) for byte, i, j in children]
        end = free.rindex(0) + 258
        self.base, self.check, self.leaf = base[:end].copy(), check[:end].copy(), leaf[:end].copy()

    def edges(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every piece found at the starts and ending no later than their stops."""
        found = []
        state, at = np.zeros(len(starts), np.int32), starts
        origin = starts
        for _ in range(self.depth):
            inside = at < stops
            state, at, origin, stops = state[inside], at[inside], origin[inside], stops[inside]
            if not len(at):
                break
            target = self.base[state] + data[at] + 1
            alive = self.check[target] == state
            state, at, origin, stops = target[alive], at[alive] + 1, origin[alive], stops[alive]
            ids = self.leaf[state]
            ends_here = ids >= 0
            found.append((origin[ends_here], at[ends_here], ids[ends_here]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


class Encoder:
    def __init__(self, vocabulary: Vocabulary, trie: DoubleArray | None = None):
        self.vocabulary, self.trie = vocabulary, trie or DoubleArray(vocabulary.texts)
        self.splits = not any(b" " in t.lstrip(b" ") for t in vocabulary.texts if t)
        self.byte_score = float(vocabulary.scores[vocabulary.byte_ids[0]])
        self.known: dict[int, bytes] = {}

    def _all_edges(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
        """Edges with scores for the character starts given; characters that are no piece get an edge of piece -1."""
        s, e, ids = self.trie.edges(data, starts, stops)
        scores = self.vocabulary.scores[ids] if len(ids) else np.zeros(0)
        lead = data[starts]
        width = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
        ends = np.minimum(starts + width, stops)
        covered = np.zeros(len(data) + 1, bool)
        whole = covered.copy()
        covered[starts] = True
        char_end = np.zeros(len(data) + 1, np.int64)
        char_end[starts] = ends
        whole[s[char_end[s] == e]] = True
        lone = ~whole[starts]
        ls, le = starts[lone], ends[lone]
        return (np.concatenate([s, ls]), np.concatenate([e, le]), np.concatenate([ids, np.full(len(ls), -1, ids.dtype)]),
                np.concatenate([scores, (le - ls) * self.byte_score]))

    def _solve(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The ids of each short word."""
        # Words are laid end to end; word w's nodes are its byte places plus w, as each has one more node than bytes.
        sizes = ends - starts
        first = np.concatenate([[0], np.cumsum(sizes)])
        text = data[np.repeat(starts - first[:-1], sizes) + np.arange(first[-1])]
        word = np.repeat(np.arange(len(starts)), sizes)
        chars = np.flatnonzero((text & 0xC0) != 0x80)
        s, e, ids, scores = self._all_edges(text, chars, first[1:][word[chars]])
        w = word[s]
        reach = e - first[w]
        order = np.argsort(reach.astype(np.int16), kind="stable")
        s, e, ids, scores, w, reach = (x[order] for x in (s, e, ids, scores, w, reach))
        source, target = s + w, e + w
        nodes = int(first[-1]) + len(starts)
        best, back = np.full(nodes, -np.inf), np.full(nodes, -1, np.int64)
        best[first[:-1] + np.arange(len(starts))] = 0.0
        cuts = np.searchsorted(reach, np.arange(1, int(sizes.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            total = best[source[a:b]] + scores[a:b]
            rank = np.lexsort((source[a:b], -total, target[a:b]))
            ended = target[a:b][rank]
            top = rank[np.concatenate([[True], ended[1:] != ended[:-1]])]
            best[target[a:b][top]], back[target[a:b][top]] = total[top], a + top
        at = first[1:] + np.arange(len(starts))
        root = first[:-1] + np.arange(len(starts))
        chosen = []
        live = np.flatnonzero(at != root)
        while len(live):
            step = back[at[live]]
            chosen.append(step)
            at[live] = source[step]
            live = live[at[live] != root[live]]
        edges = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        edges = edges[np.argsort(source[edges], kind="stable")]
        return self._packed(text, s[edges], e[edges], ids[edges], w[edges], len(starts))

    def _packed(self, text: np.ndarray, s: np.ndarray, e: np.ndarray, ids: np.ndarray, w: np.ndarray, words: int) -> list[bytes]:
        """Ids per word as packed int32, with byte pieces for edges that are no piece."""
        counts = np.where(ids >= 0, 1, e - s)
        flat = np.repeat(ids, counts).astype(np.int32)
        inner = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        lone = flat < 0
        flat[lone] = self.vocabulary.byte_ids[text[(np.repeat(s, counts) + inner)[lone]]]
        raw = flat.tobytes()
        bounds = (4 * np.concatenate([[0], np.cumsum(np.bincount(w, weights=counts, minlength=words).astype(np.int64))])).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _solve_long(self, data: np.ndarray, start: int, end: int) -> bytes:
        """One long word: the edges of a block of starts at a time."""
        text = data[start:end]
        n = len(text)
        best, back_start, back_id = np.full(n + 1, -np.inf), np.zeros(n + 1, np.int64), np.full(n + 1, -1, np.int64)
        best[0] = 0.0
        chars = np.flatnonzero((text & 0xC0) != 0x80)
        for i in range(0, len(chars), BLOCK):
            some = chars[i : i + BLOCK]
            low, high = int(some[0]), min(n, int(some[-1]) + self.trie.depth + 4)
            part = text[low:high]
            s, e, ids, scores = self._all_edges(part, some - low, np.full(len(some), high - low))
            order = np.lexsort((e, s))
            for a, b, p, x in zip((s[order] + low).tolist(), (e[order] + low).tolist(), ids[order].tolist(), scores[order].tolist()):
                total = best[a] + x
                if total > best[b]:
                    best[b], back_start[b], back_id[b] = total, a, p
        path, at = [], n
        while at:
            path.append((back_start[at], at, back_id[at]))
            at = int(back_start[at])
        s, e, ids = (np.array(x, np.int64) for x in zip(*path[::-1])) if path else (np.zeros(0, np.int64),) * 3
        return self._packed(text, s, e, ids, np.zeros(len(s), np.int64), 1)[0]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Packed int32 ids of each text of a binary or string array (null: none)."""
        data, offsets = text_buffer(texts)
        # The dummy blank in front of every text.
        sizes = np.diff(offsets)
        blank = np.flatnonzero(sizes > 0)
        data = np.insert(data, offsets[blank], 0x20)
        offsets = offsets + np.concatenate([[0], np.cumsum(sizes > 0)])
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets[:-1][sizes > 0]] = True
        if self.splits:
            begins[1:-1] |= (data[1:] == 0x20) & (data[:-1] != 0x20)
        starts = np.flatnonzero(begins[:-1])
        ends = np.append(starts[1:], len(data))
        hashes = word_hashes(data, starts, ends)
        if len(self.known) > MEMO_WORDS:
            self.known.clear()
        distinct, where = np.unique(hashes, return_index=True)
        new = np.array([i for h, i in zip(distinct.tolist(), where.tolist()) if h not in self.known], np.int64)
        size = ends[new] - starts[new]
        short = new[size <= SHORT]
        for i in range(0, len(short), 40_000):
            some = short[i : i + 40_000]
            self.known.update(zip(hashes[some].tolist(), self._solve(data, starts[some], ends[some])))
        for i in new[size > SHORT].tolist():
            self.known[int(hashes[i])] = self._solve_long(data, int(starts[i]), int(ends[i]))
        every, firsts = list(map(self.known.__getitem__, hashes.tolist())), np.searchsorted(starts, offsets).tolist()
        return [b"".join(every[a:b]) for a, b in zip(firsts, firsts[1:])]


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.texts = [t or b"" for t in vocabulary.texts]
        for value, i in enumerate(vocabulary.byte_ids.tolist()):
            self.texts[i] = bytes([value])

    def decode(self, ids: bytes) -> bytes:
        """The text of packed ids, without the dummy blank."""
        return b"".join(map(self.texts.__getitem__, np.frombuffer(ids, np.int32).tolist()))[1:]


def encoded(docs: DataFrame, vocabulary: Vocabulary | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), score and n_bytes (byte pieces among them), and ``same``: whether decoding gives the text back."""
    bounded_batches(docs.sparkSession)
    vocabulary = vocabulary or read_vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, DoubleArray(vocabulary.texts)))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, trie = shared.value
        encoder, decoder = Encoder(words, trie), Decoder(words)
        is_byte = np.zeros(len(words.texts), bool)
        is_byte[words.byte_ids] = True
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                texts = part.column(1)
                packed = encoder.encode(texts)
                flat = np.frombuffer(b"".join(packed), np.int32)
                bounds = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int64)
                null = np.asarray(texts.is_null())
                sums = [np.concatenate([[0], np.cumsum(x)])[bounds] for x in (words.scores[flat], is_byte[flat].astype(np.int64))]
                same = [bool(n) or decoder.decode(p) == t.as_buffer().to_pybytes() for p, t, n in zip(packed, texts, null)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat), mask=pa.array(null)),
                    pa.array(np.diff(sums[0]), mask=null), pa.array(np.diff(sums[1]), mask=null), pa.array(np.array(same, bool)),
                ], ["doc_id", "ids", "score", "n_bytes", "same"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, ids array<int>, score double, n_bytes long, same boolean")


def op4_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, with a check of the round trip."""
    found = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "n_bytes", F.round("score", 3).alias("score"), "same", "ids")
