"""The pipeline's stages on a small corpus with planted cases, against brute force."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from test_documents import WORDS, brute_components, brute_lines, brute_spans

from marquee.llm import vector_pack
from marquee.llm.common import stored

STEM = "the of and to in that for with was on are as at by this have from or an".split()


def prose(rng, n):
    return " ".join(rng.choice(STEM) if rng.random() < 0.4 else f"w{rng.randrange(3000)}" for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    passage, base = prose(rng, 70), prose(rng, 150)
    texts = [f"{prose(rng, 60)}\n{prose(rng, 60)} {rng.choice(STEM)}." for _ in range(60)]
    texts += [base, base, " ".join("changed" if i == 70 else w for i, w in enumerate(base.split()))]
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 30)}" for _ in range(4)]
    texts += [f"{prose(rng, 60)}\nshared line one here\nshared line two here\n{prose(rng, 60)}" for _ in range(3)]
    texts += [" ".join(f"x{rng.randrange(99)}***" for _ in range(80)) for _ in range(12)] + ["SHOUT " * 90] * 3 + [None, "", "tiny"]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def test_stages(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)

    kept = stored(steps["quality classifier"](spark, docs, path), "t1")
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(60)) <= ids and len(ids & set(range(70, 85))) <= 3
    assert kept.columns == docs.columns

    lines = stored(steps["line dedup"](spark, kept, path), "t2")
    left = brute_lines(pairs(kept), 2)
    expected_lines = [(t, t if t is None else left[(i, t)]) for i, t in pairs(kept)]
    assert Counter(t for _, t in pairs(lines)) == Counter(after for before, after in expected_lines if after == before or WORDS.search(after))
    assert any(after != before and not WORDS.search(after) for before, after in expected_lines)  # a copy of one long line leaves nothing

    near = stored(steps["near-dedup"](spark, lines, path), "t3")
    expected = {c for (_, n, c) in brute_components(pairs(lines), 5) if n}
    assert {i for i, t in pairs(near) if WORDS.search(t or "")} == expected

    cut = stored(steps["suffix-array dedup"](spark, near, path), "t4")
    gone = brute_spans(pairs(near))
    assert gone
    for i, t in pairs(near):
        words = [w for j, w in enumerate(WORDS.findall(t or "")) if (i, j) not in gone]
        assert WORDS.findall(dict(pairs(cut)).get(i) or "") == words
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text is not None)

    pieces = steps["packing"](spark, cut, path).collect()
    assert Counter({r.doc_id: r.doc_tokens for r in pieces}) == Counter({p.doc_id: p.doc_tokens for p in vector_pack.pack(cut).collect()})
    placed = defaultdict(list)
    for p in pieces:
        placed[p.sequence_id].append((p.offset, p.length))
    assert all(sum(n for _, n in spans) <= 2048 for spans in placed.values())

    whole = corpus_pipeline.run(spark, path).collect()
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32) for p in whole) == Counter((p.doc_id, p.start, p.length, p.ids_crc32) for p in pieces)
