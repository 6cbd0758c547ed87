"""Archives, vectors, pieces and sequences against plain versions."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marquee.llm import arc_convert, norm_topk, unigram, vector_pack
from marquee.session import fresh_path


def test_arc_to_warc(spark):
    long = "<p>" + "é\r\nWARC/1.0\r\n\r\nWARC-Type: response\r\n" * 20_000
    pages = [(1, "http://a/x y", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (3, None, "<p>same</p>"), (4, "http://c", None), (5, "http://c", ""), (None, "http://d", "<i>"), (7, "http://e", long), (7, "http://e", "other")]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, record string").repartition(3)
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    arc_convert.write_arc(frame, arc)
    arc_convert.convert(spark, arc, warc)
    found = arc_convert.resolved(arc_convert.read_warc(spark, warc)).collect()
    digest = lambda html: base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
    expected = Counter()
    for page, _, html in pages:
        same = max((p[0] for p in pages if (p[2] or "") == (html or "") and p[0] is not None), default=None)
        expected[(page, len((html or "").encode()), digest(html), "response" if page == same else "revisit", None if page == same else same)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expected
    assert {r.url for r in found} == {"http://a/x%20y", "http://b", None, "http://c", "http://d", "http://e"}
    assert len({r.warc_id for r in found}) == len(pages) and {r.date for r in found} == {"2020-01-02T03:04:05Z"}


def test_arc_versions_and_empty_table(spark):
    for version in (1, 2):
        data = arc_convert.arc_version_block(version, "x.arc", "20200102030405") + b"\n" + arc_convert.arc_record(version, "x.arc", "dns:a", "20200102", b"\nhttp://", "text/dns") + b"\n"
        (_, head, _), (offset, fields, content) = arc_convert.arc_records(data)
        assert head["version"] == str(version) and fields["URL"] == "dns:a" and content == b"\nhttp://" and data[offset:].startswith(b"dns:a")
    with pytest.raises(ValueError):
        list(arc_convert.arc_records(data[:-4]))
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    arc_convert.write_arc(spark.createDataFrame([], "page_id long, url string, html string"), arc)
    arc_convert.convert(spark, arc, warc)
    assert arc_convert.resolved(arc_convert.read_warc(spark, warc)).count() == 0


def brute_top(rows, k=5):
    ints = []
    for r, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ints.append((r, i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]))
    out = Counter()
    for r, q, v in ints:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for s, i, w in ints if s != r and len(w) == len(v))[:k]
            out.update((q, n + 1, i, -score) for n, (score, i) in enumerate(scored))
    return out


@pytest.mark.parametrize("kind", ["unit", "lengths", "same"])
def test_top_k(spark, kind, monkeypatch):
    monkeypatch.setattr(norm_topk, "SLICE_ROWS", 100)
    monkeypatch.setattr(norm_topk, "PART_QUERIES", 4)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    made = []
    for i in range(600):
        v = centres[i % 6] + 0.1 * rng.normal(size=8)
        v = v / np.linalg.norm(v) * {"unit": 1.0, "lengths": float(np.exp(rng.normal() * 1.5)), "same": 1.0}[kind]
        made.append((i, [float(np.float32(x)) for x in (centres[0] if kind == "same" and i % 3 else v)]))
    made += [(None, [1.0] * 8), (700, None), (701, [1.0, None] + [0.0] * 6), (702, [float("nan")] * 8), (750, [0.0] * 8), (703, [float("inf")] * 8), (800, [1.0, 2.0]), (801, [2.0, 2.0]), (50, made[50][1])]
    frame = spark.createDataFrame([(i, v, 3) for i, v in made], "vec_id long, embedding array<float>, score int")
    found = norm_topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute_top(made)
    assert norm_topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("sizes", [(0, 20), (14, 21), (0, 36)])
def test_top_k_of_long_vectors(spark, monkeypatch, sizes):
    """Products below and above 2**53, at any mix of lengths, with ties and negative scores, are those of exact integers."""
    monkeypatch.setattr(norm_topk, "SLICE_ROWS", 60)
    rng = np.random.default_rng(7)
    # Integers up to about 2**30, so that products fit a long; beyond, the queries are short.
    made = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 2.0 ** rng.uniform(*((0, 4) if sizes[1] > 24 and i % 50 == 0 else sizes))]) for i in range(400)]
    made += [(1000 + i, made[3 * i][1]) for i in range(20)] + [(2000 + i, [-x for x in made[7 * i][1]]) for i in range(20)] + [(450, [1e7, 0.0, 0.0, 0.0] if sizes[1] <= 24 else [0.5, 0.0, 0.0, 0.0])]
    if sizes[1] > 24:  # longer ones meet the short queries only
        made = [(i + 1 if i % 50 == 0 and i >= 1000 else i, v) for i, v in made]
    frame = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    found = norm_topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute_top(made)


def test_scores_beyond_a_long(spark):
    huge = [(50, [1e30, 0.0]), (1, [1e30, 1.0]), (2, [-1e30, 0.0])]
    with pytest.raises(Exception, match="no long holds a score of query 50"):
        norm_topk.top_k(spark.createDataFrame(huge, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    far = [(50, [1e30, 0.0])] + [(i, [0.0, float(i)]) for i in range(1, 8)] + [(9, [-1e30, 0.0])]  # below the five best, so no matter
    found = norm_topk.top_k(spark.createDataFrame(far, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(i, i, 0) for i in range(1, 6)]


def plain_viterbi(vocabulary, text):
    pieces = {t: i for i, t in enumerate(vocabulary.texts) if t}
    data = b" " + text.encode() if text else b""
    longest = max(map(len, pieces))
    best, back = [-np.inf] * (len(data) + 1), [None] * (len(data) + 1)
    best[0] = 0.0
    fallback = vocabulary.scores[vocabulary.byte_ids[0]]
    for end in range(1, len(data) + 1):
        for start in range(max(0, end - longest), end):
            piece = data[start:end]
            if best[start] == -np.inf or data[start] & 0xC0 == 0x80:
                continue
            score = vocabulary.scores[pieces[piece]] if piece in pieces else None
            if score is None:
                width = 1 + sum(data[start] >= x for x in (0xC0, 0xE0, 0xF0))
                score = width * fallback if width == end - start else None
            if score is not None and best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, start
    return best[-1]


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.read_vocabulary()


def test_unigram_matches_plain_viterbi(vocabulary):
    rng = random.Random(4)
    texts = ["", "Hello  world", "naïve café ▁▁ marker", "日本語 text\n\nnew\tline", "\U0001F9FF\U00010348 rare", "x" * 70, "   ", " lead", "sch\x00\x7f", *("".join(rng.choice("abcdeé 日\U0001F9FF\n") for _ in range(60)) for _ in range(60))]
    encoder, decoder = unigram.Encoder(vocabulary), unigram.Decoder(vocabulary)
    packed = encoder.encode(pa.array(texts))
    for text, ids in zip(texts, packed):
        assert decoder.decode(ids).decode() == text
        assert abs(vocabulary.scores[np.frombuffer(ids, np.int32)].sum() - plain_viterbi(vocabulary, text)) < 1e-6


def test_unigram_long_words_and_rows(spark, vocabulary, monkeypatch):
    short = unigram.Encoder(vocabulary)
    texts = ["abcabcé" * 60, "zz" * 100]
    whole = short.encode(pa.array(texts))
    monkeypatch.setattr(unigram, "BLOCK", 17)
    assert unigram.Encoder(vocabulary).encode(pa.array(texts)) == whole
    for text, ids in zip(texts, whole):
        assert abs(vocabulary.scores[np.frombuffer(ids, np.int32)].sum() - plain_viterbi(vocabulary, text)) < 1e-6
    rows = [(1, "a b"), (2, None), (2, ""), (None, "▁ tie tie"), (1, "a b")]
    found = unigram.encoded(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, ids int")).collect()
    assert len(found) == 5 and all(r.same for r in found)
    assert [r.ids is None for r in found].count(True) == 1 and sorted(len(r.ids) for r in found if r.ids is not None)[0] == 0
    assert unigram.encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_holds_exactly_its_keys():
    keys = [b"a", b"ab", b"abc", b"b", b" b", "é".encode(), None, b"abd"]
    trie = unigram.DoubleArray(keys)
    data = np.frombuffer("abcabdé bab".encode(), np.uint8)
    starts = np.arange(len(data))
    found = set(zip(*(x.tolist() for x in trie.edges(data, starts, np.full(len(data), len(data))))))
    raw = data.tobytes()
    assert found == {(s, s + len(k), i) for i, k in enumerate(keys) if k for s in range(len(raw)) if raw[s : s + len(k)] == k}


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    texts = [None, "", "short", *(" ".join(rng.choice(["alpha", "beta", "γάμμα", "delta"]) for _ in range(rng.choice([3, 40, 700, 5000]))) for _ in range(60)), "don't  stop\n\n now", "y" * 12_000]
    rows = [*enumerate(texts), (2, "short"), (None, "no id")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int").repartition(3)
    pieces = vector_pack.pack(frame).collect()
    tokenizer = Tokenizer.from_file(vector_pack.default_vocabulary())
    expected = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    sequences, parts = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
        parts[(p.doc_id, p.doc_tokens)].append((p.start, tuple(ids)))
    for spans in sequences.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048
    assert sum(len(k[1]) * n for k, n in expected.items()) == sum(p.length for p in pieces)
    for (doc, ids), n in expected.items():
        if n == 1 and sum(1 for d, x in expected if d == doc and len(x) == len(ids)) == 1:
            assert sum((x for _, x in sorted(parts[(doc, len(ids))])), ()) == ids
    assert sum(sum(n for _, n in s) < 2048 for s in sequences.values()) <= 1
    digests = vector_pack.piece_digests(vector_pack.pack(frame)).collect()
    assert Counter(d.ids_crc32 for d in digests) == Counter(zlib.crc32(p.ids) for p in pieces)
    assert vector_pack.pack(frame.limit(0)).count() == 0


def test_packing_of_a_million_blanks(spark):
    """One run of blanks on which the fast encoder fails must not lose the rows beside it."""
    from tokenizers import Tokenizer

    n = 1_000_000
    texts = ["first", *("a" + blanks + "b" for blanks in (" " * n, "\n" * n, " \n" * (n // 2), "\t\u00a0" * (n // 2))), "y " * 20_000, "last"]
    tokenizer, plain = vector_pack.FastTokenizer(vector_pack.default_vocabulary()), Tokenizer.from_file(vector_pack.default_vocabulary())
    expected = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(tokenizer.encode(t), tokenizer.dtype).tolist() for t in texts] == expected and tokenizer.fast is not None
    pieces = vector_pack.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "length").collect()
    assert Counter({i: len(ids) + 1 for i, ids in enumerate(expected)}) == sum((Counter({p.doc_id: p.length}) for p in pieces), Counter())


def test_packing_of_quoted_added_tokens(spark):
    """Ids are those of the vocabulary file at its defaults, beyond the texts that both encoders encode as well."""
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext", "<| endoftext |>", "<|ENDOFTEXT|>", *["plain text"] * 10, "late <|endoftext|>"]
    plain = Tokenizer.from_file(vector_pack.default_vocabulary())
    expected = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert expected[0] == [64, 220, 50256, 275]
    tokenizer = vector_pack.FastTokenizer(vector_pack.default_vocabulary())
    assert [np.frombuffer(tokenizer.encode(t), tokenizer.dtype).tolist() for t in texts] == expected and tokenizer.fast is not None
    pieces = vector_pack.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    assert {p.doc_id: np.frombuffer(p.ids, "<u4").tolist() for p in pieces} == {i: [*ids, 1] for i, ids in enumerate(expected)}


def test_packing_keeps_all_limits():
    rng = np.random.default_rng(0)
    tokens, limits = rng.integers(1, 900, 300), (1000, 4, 500)
    loss = np.minimum(rng.integers(0, 400, 300), tokens)
    for cut in (False, True):
        found = vector_pack.packed(tokens, loss, limits, cut)
        bins, done = defaultdict(list), defaultdict(int)
        for item, start, n, sequence, _ in sorted(found, key=lambda p: (p[0], p[1])):
            assert start == done[item]
            done[item] += n
            free = int(tokens[item] - loss[item])
            bins[sequence].append((n, max(0, start + n - max(free, start))))
        assert [done[i] for i in range(300)] == tokens.tolist()
        for members in bins.values():
            assert sum(n for n, _ in members) <= 1000 and len(members) <= 4 and sum(x for _, x in members) <= 500
    with pytest.raises(ValueError):
        vector_pack.packed(np.array([1001]), np.array([0]), limits, False)
