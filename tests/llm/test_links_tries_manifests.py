"""Near vectors, the conversation trie and the manifest against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import merkle_manifest, prefix_trie, subspace_join

# ---- near vectors -------------------------------------------------------------------------------------------------


def brute_near(rows, threshold):
    """(vec_id, n_links, component_id, kept) of every row."""
    def fit(i, v):
        return i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if fit(i, v) else None for i, v in rows]
    links = [[b for b, y in enumerate(units) if a != b and x is not None and y is not None and len(x) == len(y) and x @ y >= threshold] for a, x in enumerate(units)]
    out = []
    for a, (i, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((i, len(links[a]), least, i is not None and i == least))
    return Counter(out)


def vectors_with_groups():
    rng = np.random.default_rng(5)
    made = [rng.normal(size=20) for _ in range(150)]
    for centre, count, noise in ((0, 120, 0.02), (1, 60, 0.12), (2, 40, 0.3), (3, 30, 0.6)):
        made += [made[centre] + noise * rng.normal(size=20) for _ in range(count)]
    step = np.cos(0.4), np.sin(0.4)
    chain = [np.array([1.0, 0.0])]
    for _ in range(7):  # neighbours are linked, their neighbours are not
        x, y = chain[-1]
        chain.append(np.array([x * step[0] - y * step[1], x * step[1] + y * step[0]]))
    rows = [(i, [float(np.float32(x)) for x in v * (10.0 ** (i % 7 - 3))]) for i, v in enumerate(made)]
    rows += [(1000 + i, [float(np.float32(x)) for x in v]) for i, v in enumerate(chain)]
    rows += [(2000 + i, rows[3][1]) for i in range(90)] + [rows[0], (5, rows[7][1]), (None, rows[0][1]), (None, None)]
    return rows + [(3000, None), (3001, []), (3002, [0.0] * 20), (3003, [1.0, None]), (3004, [float("nan")] * 2), (3005, [float("inf"), 1.0]), (3006, [1e38] * 20), (3007, [1e-38] * 20)]


@pytest.mark.parametrize("rows_a_slice", [2048, 40])
def test_near_vectors(spark, monkeypatch, rows_a_slice):
    monkeypatch.setattr(subspace_join, "SLICE_ROWS", rows_a_slice)
    monkeypatch.setattr(subspace_join, "CHUNK_ROWS", 16)
    rows = vectors_with_groups()
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cls int, n_links string").repartition(3)
    found = subspace_join.near_vectors(frame)
    assert Counter(tuple(r) for r in found.collect()) == brute_near(rows, 0.9)
    assert subspace_join.near_vectors(frame.limit(0)).count() == 0


def test_pairs_at_the_threshold(spark):
    """Cosines within the rounding of the integers are decided in double precision."""
    rows = []
    for i, gap in enumerate((-1e-5, -1e-9, 1e-9, 1e-5, 1e-4, -1e-4)):
        base, t = np.zeros(32), 0.9 + gap
        base[i] = 1.0
        other = t * base
        other[10 + i] = np.sqrt(1 - t * t)
        rows += [(2 * i, base.tolist()), (2 * i + 1, other.tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in subspace_join.near_vectors(frame).collect()}
    assert [found[2 * i + 1] for i in range(6)] == [0, 0, 1, 1, 1, 0]


def test_union_of_candidates_counts_a_pair_once():
    rng = np.random.default_rng(2)
    budget = subspace_join.Budget(20, 0.9)
    a = subspace_join.unit(rng.normal(size=(4000, 20)))
    b = subspace_join.unit(a + 0.09 * rng.normal(size=(4000, 20)))
    turned = [np.rint(x @ subspace_join.rotation(20) * subspace_join.ONE).astype(np.int16) for x in (a, b)]
    linked = np.einsum("ij,ij->i", a, b) >= 0.9
    assert 200 < linked.sum() < 3900
    assert (budget.first_block(*turned)[linked] < len(budget.starts)).all()
    assert (budget.first_block(*turned) == budget.first_block(*turned[::-1])).all()
    for block in range(len(budget.starts)):
        near = np.abs(budget.strips(turned[0], block) - budget.strips(turned[1], block)) <= 1
        assert near[budget.first_block(*turned) == block].all()


# ---- the conversation trie ----------------------------------------------------------------------------------------


def rebuilt_conversations(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(t)] for c, t in turns.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    return out


def brute_trie(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    words = {node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0 for node in members}
    kids = Counter(node[:-1] for node in members if node)
    out = []
    for node, convs in members.items():
        ends = sorted(c for c in convs if len(conversations[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), kids[node], sum(not kids[b] for b in below[node]),
                    sum((len(members[b]) - 1) * words[b] for b in below[node]), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return Counter(out)


def chats():
    rng = np.random.default_rng(9)
    rows = []
    for c in range(260):
        if c % 37 == 5:
            continue  # absent, among them a family's first
        if c % 3 == 0:  # a frequent opening, and many equal conversations
            turns = [("system", "be kind"), ("user", "hello there")] + [("user", f"q{c % 6}")] * (c % 6)
        else:
            turns = [(rng.choice(["user", "assistant"]), " ".join(f"w{x}" for x in rng.integers(0, 2, rng.integers(0, 3)))) for _ in range(rng.integers(1, 9))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(1000, i, "user", f"long {i}") for i in range(90)] + [(1020, i, "user", f"long {i}") for i in range(70)] + [(1040, i, "user", f"long {i}") for i in range(70)]
    rows += [(2000, None, None, "first"), (2000, 0, "user", None), (2000, 0, "user", None), (2020, 3, None, ""), (2021, 3, "user", "x"), (-7, 1, "user", "minus"), (-20, 1, "user", "base"), (None, 1, "user", "no one")]
    return rows + [(3000, 0, "user", "word " * 300_000), (3001, 0, "user", "word " * 300_000), (3001, 1, "user", "b")]


@pytest.mark.parametrize("group", [256, 2])
def test_trie(spark, monkeypatch, group):
    monkeypatch.setattr(prefix_trie, "GROUP", group)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    rows = chats()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, seq int").repartition(5)
    found = prefix_trie.prefix_trie(prefix_trie.with_shared_openings(prefix_trie.numbered_turns(frame)))
    assert Counter(tuple(r) for r in found.collect()) == brute_trie(rebuilt_conversations(rows))


def test_trie_of_little(spark):
    shape = "conv_id long, turn long, role string, text string"

    def nodes(rows):
        return [tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.with_shared_openings(prefix_trie.numbered_turns(spark.createDataFrame(rows, shape)))).collect()]

    assert nodes([]) == []
    lost = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)  # its only turn is replaced, and its family has none
    assert nodes([(lost, 0, "user", "x")]) == [(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())]


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    found = spark.createDataFrame(pairs, "a int, b int").select("a", "b", prefix_trie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in found)


def test_exit_nodes(spark):
    """Every sequence finds the place where it leaves the trie, as a walk from the root would."""
    rng = np.random.default_rng(3)
    rows = [(c, p, bytes([x]), 1) for c in range(120) for p, x in enumerate(rng.integers(0, 3, rng.integers(1, 40)))]
    turns = spark.createDataFrame(rows, "conv_id long, p int, token binary, words long")
    found = prefix_trie.stored(prefix_trie.sequences(prefix_trie.paths(turns)), "test-sequences")
    some = found.where(F.pmod(F.xxhash64("seq"), F.lit(2)) == 0)
    nodes = prefix_trie.build(some)
    inside = [r.path for r in some.collect()]
    deepest = nodes.agg(F.max("hi")).head()[0]
    pending = found.select("seq", "path", "cum", (F.octet_length("path") / 16).cast("int").alias("len"))
    for r in prefix_trie.locate(pending, nodes, deepest).collect():
        assert r.d == max(prefix_trie.shared(r.path, p) for p in inside)


# ---- the manifest -------------------------------------------------------------------------------------------------


def brute_manifest(rows):
    def H(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row, tampered=False):
        shown = []
        for at, value in enumerate(row):
            if value is not None and at == 4 and tampered:
                value = re.sub("[A-Z]", lambda m: m[0].lower(), value)
            shown.append("-" if value is None else f"{len(str(value).encode())}:{value}")
        return H(*shown)

    def up(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def siblings(levels, pos):
        out = []
        for level in levels[:-1]:
            low = pos - pos % 8
            out.append((level[low:pos], level[pos + 1:low + 8]))
            pos //= 8
        return out

    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    held = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in order}
    trees = {g: up([leaf(r) for r in held[g]]) for g in order}
    top = up([trees[g][-1][0] for g in order]) if order else [[None]]
    out = []
    for place, g in enumerate(order):
        for pos, row in enumerate(held[g]):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            path, fold = siblings(trees[g], pos) + siblings(top, place), leaf(row, tampered)
            for left, right in path:
                fold = H(*left, fold, *right)
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[g][-1][0], root, H(*[x for left, right in path for x in left + right]), fold, fold == root))
    return Counter(out)


DOCUMENTS = "doc_id long, source string, lang string, n_chars long, text string"


def papers():
    rows = [(i, f"s{i % 3}", ["en", "de", "ü", None, ""][min(i % 9, 4)] if i < 700 else "en", i, f"Text {i} É") for i in range(1100)]
    rows += [(5000 + i, "s", f"l{i:02}", 1, None) for i in range(20)] + [(3, None, "en", None, ""), (3, None, "en", None, ""), (None, "s", "en", 1, "UP"), (None, None, None, None, None)]
    return rows + [(9000, "s", "one", 5, "A" * 3_000_000)]


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(merkle_manifest, "PART_LEAVES", 100)


def proofs(spark, frame, tmp_path):
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    return merkle_manifest.op13_merkle_manifest(spark, str(tmp_path))


def test_manifest(spark, tmp_path, small_parts):
    rows = papers()
    frame = spark.createDataFrame(rows, DOCUMENTS).withColumns({c: F.lit("x") for c in ("part", "tree", "pos", "digest", "root", "leaf")})
    assert Counter(tuple(r) for r in proofs(spark, frame.repartition(4), tmp_path).collect()) == brute_manifest(rows)


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 1, "A")], [(i, "s", None, 1, "A") for i in range(9)]])
def test_small_manifests(spark, tmp_path, rows):
    assert Counter(tuple(r) for r in proofs(spark, spark.createDataFrame(rows, DOCUMENTS), tmp_path).collect()) == brute_manifest(rows)


def test_proofs_of_a_choice(spark, small_parts):
    """Any choice of leaves has proofs that fold to the root."""
    frame = spark.createDataFrame(papers(), DOCUMENTS)
    manifest = merkle_manifest.build(frame, "lang", "doc_id", merkle_manifest.leaf_digest([F.col(c) for c in merkle_manifest.FIELDS]), [F.col("doc_id")])
    some = manifest.leaves.where("doc_id % 7 = 0")
    found = merkle_manifest.multiproof(manifest, some, ["doc_id"]).collect()
    assert len(found) == some.count() and all(r.folded_root == r.root == manifest.root for r in found)


def test_missing_nodes_are_few():
    """A partition fetches its borders' siblings, not every leaf's."""
    lacking = merkle_manifest.needed(np.arange(1000, 5000), 1_000_000)
    assert sum(len(pos) for _, pos in lacking) <= 14 * len(lacking)
    assert all(len(pos) == 0 for _, pos in merkle_manifest.needed(np.arange(77), 77))
    lone = merkle_manifest.needed(np.array([12_345]), 100_000)
    assert [len(pos) for _, pos in lone] == [7, 7, 7, 7, 7, 3]
