"""Rules, line dedup, near-dedup, passages and licenses against brute force on small texts with awkward cases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marquee.llm import bottomk, license_join, quality_cascade, suffix_spans, weak_quality, winnow_lines

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = prose(rng, 120)
    near = [" ".join("x" if rng.random() < 0.03 else w for w in base.split()) for _ in range(8)]
    shared = prose(rng, 60)
    lines = "first line here\nsecond line here\n\nthird line here"
    rows = [
        None, "", " \t\n", "one", "two words", "Two WORDS", base, base, *near, f"{prose(rng, 30)} {shared} {prose(rng, 20)}", f"{shared}\n{prose(rng, 70)}",
        f"intro\n{lines}\nouter", f"{lines}\nother end", lines, "same\nsame\nsame\nsame", "again " * 300, prose(rng, 5000), "é à ü " * 40, "#*$ && <> || " * 30,
        "Released under the MIT License.", "apache license mit license MIT license", "the general\npublic license", "general public", license_join.TEMPLATES["bsd"].upper(),
        "x " * 200 + license_join.TEMPLATES["mit"], "a" * 5000, "THIS IS ALL SHOUTING TEXT " * 20,
    ]
    return [(i if i != 9 else None, t) for i, t in enumerate(rows)] + [(6, base), (3, "one")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1.0) for i, t in texts], "doc_id long, text string, words string, n_words double")


def test_cascade_counts(docs, texts):
    found = quality_cascade.verdicts(docs).collect()
    expected = []
    for i, text in texts:
        words = WORDS.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        windows = Counter(tuple(words[j : j + 3]) for j in range(len(words) - 2))
        again = {j + k for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for k in range(3)}
        expected.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again),
                         len(words) < 50 or 100 * len(again) > 50 * len(words)))
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found]
    assert Counter(got) == Counter(expected)
    assert all(not r.kept for r in found if r.base_failed) and any(r.kept for r in found)


def test_cascade_order_and_laziness(spark):
    cheap, strict = (quality_cascade.Rule(n, F.lit(True)) for n in "ab")
    order = quality_cascade.ordered([{"rule": cheap, "cost": 1.0, "rejects": 0.5}, {"rule": strict, "cost": 0.1, "rejects": 0.2}])
    assert [r.name for r in order] == ["b", "a"]
    fails = quality_cascade.Rule("z", F.raise_error(F.lit("evaluated")).isNull())
    assert spark.range(1).select(quality_cascade.cascade([cheap, fails]).alias("r")).first().r == "a"


def test_a_slow_rule_moves_back(spark):
    """Costs are the rules' own: with the job's overhead in them, the slower rule with slightly more rejections would come first."""
    rng = random.Random(1)
    sample = quality_cascade.stored(spark.createDataFrame([(i, prose(rng, 200)) for i in range(400)], "doc_id long, text string"), "test-rules")
    slow = quality_cascade.Rule("slow", (F.regexp_count("text", F.lit("(w[0-9]*1 ?)+(w[0-9]*2 ?)+")) >= 0) & (F.col("doc_id") % 10 < 5))
    quick = quality_cascade.Rule("quick", F.col("doc_id") % 10 < 4)
    figures = {x["rule"].name: x for x in quality_cascade.measured(sample, [slow, quick])}
    assert figures["slow"]["rejects"] == 0.5 and figures["quick"]["rejects"] == 0.4
    assert figures["slow"]["cost"] > 3 * figures["quick"]["cost"]
    assert [r.name for r in quality_cascade.ordered(list(figures.values()))] == ["quick", "slow"]


def brute_lines(rows, run, long=winnow_lines.LONG_WORDS):
    """What is left of the texts by (id, text)."""
    blank = " \t\x0b\x0c\r"
    documents = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen = {}
    for key in documents:
        full = [(i, x.strip(blank)) for i, x in enumerate(key[1].split("\n")) if x.strip(blank)]
        for j in range(len(full)):
            if j + run <= len(full):
                seen.setdefault(tuple(x for _, x in full[j : j + run]), []).append((key, [i for i, _ in full[j : j + run]]))
            if len(WORDS.findall(full[j][1])) >= long:
                seen.setdefault((full[j][1],), []).append((key, [full[j][0]]))
    later, other, stay = set(), set(), set()
    for places in seen.values():
        if len(places) > 1:
            stay |= {(places[0][0], i) for i in places[0][1]}
            for k, at in places[1:]:
                (later if k == places[0][0] else other).update((k, i) for i in at)
    gone = other | (later - stay)
    return {k: "\n".join(x for i, x in enumerate(k[1].split("\n")) if (k, i) not in gone) for k in documents}


def test_lines(docs, texts):
    expected = brute_lines(texts, 2)
    found = winnow_lines.dedup_lines(docs).collect()
    assert len(found) == len(texts)
    before = docs.collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter((r.doc_id, None if r.text is None else expected[(r.doc_id, r.text)]) for r in before)
    assert found[0].words == "clash"
    assert sum(r.winnow_deleted > 0 for r in found) >= 3


@pytest.mark.parametrize("run", [2, 3])
def test_lines_of_all_kinds(spark, run):
    """Frequent lines, long single ones, runs within and across documents, blanks of all kinds and a text of megabytes."""
    rng = random.Random(run)
    short, long = [f"line {i}" for i in range(12)], [f"{prose(rng, 8 + i)} end" for i in range(5)]
    rows = []
    for i in range(120):
        lines = [rng.choice(long) if rng.random() < 0.1 else rng.choice(short) for _ in range(rng.randrange(1, 14))]
        rows.append((i, "\n".join(rng.choice(["", " ", "\t", "\x0c"]) + x + rng.choice(["", "  ", "\r"]) + ("\n \t" if rng.random() < 0.1 else "") for x in lines)))
    rows += [(500, "a\np\nq\nb"), (501, "c\np\nq\ne"), (502, "c\np\nq\ne"), (503, "one two three four five six seven"), (504, "one two three four five six seven")]
    rows += [(505, long[0]), (506, long[0]), (600, "big line of words to repeat in here\n" * 3 + "x y\n" * 60_000), (601, f"{prose(rng, 400_000)}\n{long[1]}")]
    expected = brute_lines(rows, run)
    found = winnow_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), min_run=run).collect()
    assert {r.doc_id: r.text for r in found} == {i: expected[(i, t)] for i, t in rows}
    after = {r.doc_id: r.text for r in found}
    assert after[506] == "" and after[504] == rows[124][1] and (run > 2 or after[501] == "c\ne")


def shingles(text, n):
    words = WORDS.findall(lower(text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_components(rows, n):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return Counter((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, texts, n):
    found = bottomk.near_duplicates(docs, n=n).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(texts, n)


def test_near_duplicates_of_many_edits(spark, monkeypatch):
    """Chains of edits, more copies than a block holds, and sizes around the sketch's."""
    monkeypatch.setattr(bottomk, "BLOCK", 16)
    rng = random.Random(5)
    rows = []
    for size in (4, 9, 30, 64, 80, 200):
        text = prose(rng, size, 3000).split()
        for _ in range(40):
            rows.append((len(rows), " ".join(text)))
            text = [f"e{rng.randrange(10**6)}" if rng.random() < 1.2 / size else w for w in text] if rng.random() < 0.7 else text[: max(1, len(text) - 1)]
    found = bottomk.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows, 2)


def test_deduplicated(docs, texts):
    kept = bottomk.deduplicated(docs).select("doc_id", "text", "words").collect()
    components = brute_components(texts, 5)
    full = len({c for _, n, c in components if n})  # one has no id
    assert sum(bool(WORDS.search(r.text or "")) for r in kept) == full
    assert sum(not WORDS.search(r.text or "") for r in kept) == 3


def brute_spans(rows):
    documents = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    words = {k: WORDS.findall(lower(k[1])) for k in documents}
    first_text, copies = {}, set()
    for k in documents:
        if k[1] in first_text:
            copies.add(k)
        first_text.setdefault(k[1], k)
    seen = {}
    for k in documents:
        if k not in copies:
            for s in range(len(words[k]) - 49):
                seen.setdefault(tuple(words[k][s : s + 50]), []).append((k, s))
    gone, stay = set(), set()
    for places in seen.values():
        if len(places) > 1:
            stay |= {(places[0][0], places[0][1] + i) for i in range(50)}
            gone |= {(k, s + i) for k, s in places[1:] for i in range(50)}
    gone -= stay
    gone |= {(k, i) for k in copies if len(words[k]) >= 50 for i in range(len(words[k]))}
    return {(k[0], i) for k, i in gone}


def test_spans(docs, texts):
    found = suffix_spans.repeated_spans(docs).collect()
    assert {(r.doc_id, i) for r in found for i in range(r.start_word, r.end_word)} == brute_spans(texts)
    by_id = {}
    for i, t in texts:
        by_id.setdefault(i, WORDS.findall(lower(t or "")))
    for r in found:
        size = r.end_word - r.start_word
        assert r.start_word >= 0 and size > 0
        if r.doc_id is not None and r.source_id is not None:
            head = min(size, 5)
            assert by_id[r.doc_id][r.start_word : r.start_word + head] == by_id[r.source_id][r.source_start : r.source_start + head]


def test_spans_of_random_passages(spark):
    rng = random.Random(11)
    pool = [prose(rng, rng.choice([49, 50, 51, 70, 130]), 5000) for _ in range(6)]
    rows = [(i, f"{prose(rng, rng.randrange(60), 5000)} {rng.choice(pool)} {prose(rng, rng.randrange(40), 5000)}") for i in range(60)]
    found = suffix_spans.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, i) for r in found for i in range(r.start_word, r.end_word)} == brute_spans(rows)


def brute_whole_spans(rows):
    """Every repeat of an earlier text, and of the same text what no first occurrence holds that the repeat's source overlaps."""
    documents = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, first_text, gone = {}, {}, set()
    for k in documents:
        words = WORDS.findall(lower(k[1]))
        if first_text.setdefault(k[1], k) != k:
            gone |= {(k[0], i) for i in range(len(words)) if len(words) >= 50}
            continue
        for s in range(len(words) - 49):
            seen.setdefault(tuple(words[s : s + 50]), []).append((k, s))
    shared = [places for places in seen.values() if len(places) > 1]
    for places in shared:
        (first, source), *others = places
        for k, s in others:
            near = [p[0][1] for p in shared if p[0][0] == k and abs(p[0][1] - source) < 50] if k == first else []
            gone |= {(k[0], s + i) for i in range(50) if not any(f <= s + i < f + 50 for f in near)}
    return gone


def test_spans_beside_first_occurrences(spark):
    """Near copies whose borders are first occurrences themselves do not keep what an earlier text holds."""
    rng = random.Random(17)
    part = lambda n: prose(rng, n, 10**6)
    rows = []
    for n in (50, 60, 98, 150, 400):
        a, b, c, e, p = part(70), part(70), part(60), part(60), part(n)
        rows += [(len(rows) + i, t) for i, t in enumerate([f"{a} {p} {b}", f"{c} {p} {e}", f"{part(30)} {c} {p} {e}", f"{e} {p}"])]
    p, b = part(60), part(80)
    rows += [(len(rows), f"{part(20)} {p} {b} {p} {part(20)}"), (len(rows) + 1, f"{part(9)} {b} {p}")]  # a later text makes the second P a part of first occurrences
    for period in (1, 3, 30, 49, 50, 60, 120):
        phrase = part(period)
        rows += [(len(rows), " ".join([phrase] * (400 // period))), (len(rows) + 1, f"{part(5)} " + " ".join([phrase] * (200 // period)))]
    found = suffix_spans.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    words = {i: WORDS.findall(t) for i, t in rows}
    gone = {(r.doc_id, i) for r in found for i in range(r.start_word, r.end_word)}
    assert gone == brute_whole_spans(rows)
    assert {(1, i) for i in range(60, 110)} <= gone and {(5, i) for i in range(60, 120)} <= gone and not {i for d, i in gone if d == 0}
    assert all(words[r.doc_id][r.start_word] == words[r.source_id][r.source_start] for r in found)
    kept = {w for i in words for j, w in enumerate(words[i]) if (i, j) not in gone}
    assert kept == {w for x in words.values() for w in x}


def test_cut_texts(docs, texts):
    gone = brute_spans(texts)
    left = suffix_spans.without_spans(docs).select("doc_id", "text").collect()
    expected = Counter()
    for i, t in texts:
        words = WORDS.findall(t or "")
        rest = [w for j, w in enumerate(words) if (i, j) not in gone]
        if rest or not any((i, j) in gone for j in range(len(words))):
            expected[(i, tuple(rest))] += 1
    assert Counter((r.doc_id, tuple(WORDS.findall(r.text or ""))) for r in left) == expected


def test_licenses(docs, texts):
    found = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, tuple(r.base_labels), tuple(sorted({b.label for b in r.blocks}))) for r in license_join.matches(docs).collect()}
    expected = set()
    for i, text in texts:
        words = license_join.words_of(text or "")
        hits, labels = [], set()
        for phrase, label in license_join.PHRASES.items():
            p = phrase.split()
            at = [j for j in range(len(words)) if words[j : j + len(p)] == p]
            hits += at
            labels |= {label} if at else set()
        more = set()
        for name, template in license_join.TEMPLATES.items():
            need, run = set(license_join.words_of(template)), license_join.run_words(template)
            most = max((len(need & set(words[start : start + run])) for start in range(len(words))), default=0)
            more |= {name} if 100 * most >= 80 * len(need) else set()
        expected.add((i, len(words), len(hits), min(hits, default=None), max(hits, default=None), tuple(sorted(labels)), tuple(sorted(more))))
    assert found == expected
    assert {"bsd", "mit"} <= {x for r in found for x in r[6]}


@pytest.mark.parametrize("length", [3, 200, 1000])
def test_templates_of_any_length_at_any_start(spark, length):
    """Runs at every offset from a block's border, with words left out, changed and put in, against all starts."""
    rng = random.Random(length)
    template = [f"t{rng.randrange(length)}" for _ in range(length)]
    need, rows = set(template), []
    for i in range(40):
        copy = [("other" if rng.random() < rng.choice([0.0, 0.1, 0.25, 0.4]) else w) for w in template]
        for _ in range(rng.randrange(length // 5 + 1)):
            copy.insert(rng.randrange(len(copy)), "more")
        rows.append((i, " ".join([f"w{rng.randrange(50)}" for _ in range(rng.randrange(3 * length))] + copy + [f"w{rng.randrange(50)}" for _ in range(rng.randrange(2 * length))])))
    rows += [(100, " ".join(template)), (101, " ".join(template[: length // 2])), (102, ""), (103, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.blocks for r in license_join.matches(frame, {"long": " ".join(template), "none": "..."}).collect()}
    run, hit = license_join.run_words(" ".join(template)), 0
    for i, text in rows:
        words = (text or "").split()
        most = max((len(need & set(words[s : s + run])) for s in range(len(words))), default=0)
        assert bool(found[i]) == (100 * most >= 80 * len(need)), (i, most, len(need))
        hit += bool(found[i])
        if found[i]:
            assert max(b.containment for b in found[i]) == most / len(need)
            assert all(len(need & set(words[b.start : b.end])) / len(need) == b.containment for b in found[i])
    assert 5 < hit < len(rows)


def test_full_license_texts(spark):
    rows = [(i, f"{'intro ' * (37 * i)}{license_join.TEMPLATES[name]} {'tail ' * 500}") for i, name in enumerate(("mit-full", "isc-full", "bsd-2-full"))]
    found = {r.doc_id: {b.label for b in r.blocks} for r in license_join.matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0: {"mit-full", "mit"}, 1: {"isc-full", "isc"}, 2: {"bsd-2-full", "bsd"}}


def test_empty_tables(docs):
    none = docs.limit(0)
    assert quality_cascade.verdicts(none).count() == 0
    assert winnow_lines.dedup_lines(none).count() == 0
    assert bottomk.near_duplicates(none).count() == 0
    assert suffix_spans.repeated_spans(none).count() == 0
    assert license_join.matches(none).count() == 0
    assert weak_quality.judged(none).count() == 0


def test_weak_label_model():
    import numpy as np

    rng = np.random.default_rng(2)
    kind = rng.choice(4, 20_000, p=[0.8, 0.1, 0.06, 0.04])  # 0 is good; each labeller knows one kind of junk and some of another
    found = np.stack([rng.random(len(kind)) < np.select([kind == j, kind == j % 3 + 1], [recall, 0.3], wrong) for j, recall, wrong in ((1, 0.95, 0.01), (2, 0.9, 0.005), (3, 0.85, 0.01))], 1)
    votes = np.where(rng.random(found.shape) < 0.2, weak_quality.NONE, np.where(found, weak_quality.BAD, weak_quality.GOOD)).astype(int)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    given, share, q = weak_quality.fitted(patterns, counts.astype(float))
    assert abs(share - 0.2) < 0.06
    assert all(given[j][0][weak_quality.BAD] < 0.05 < 0.3 < given[j][j + 1][weak_quality.BAD] for j in range(3))
    assert ((q[where.ravel()] > 0.5) == (kind > 0)).mean() > 0.93
    assert q[(patterns == weak_quality.NONE).all(1)].tolist() == [0.0]


def test_classifier_held_out(spark):
    """Learned with half of the labels, judged on the other half."""
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    found = weak_quality.judged(docs.select("doc_id", "text"), labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    rows = found.selectExpr("quality", "toxic", weak_quality.KEEP + " as kept", "weak_bad > 0 as junk").collect()
    junk, clean = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1 and r.toxic == 0]
    assert sum(r.kept for r in clean) >= 0.95 * len(clean)
    assert sum(r.junk for r in junk) >= 0.85 * len(junk)


def test_classifier_learns_beside_reviews(spark, monkeypatch):
    """Many reviews of one clean source must not hide the junk of another, whatever the number of rows."""
    monkeypatch.setattr(weak_quality, "SAMPLE_ROWS", 400)
    rng = random.Random(23)
    clean = lambda: " ".join(rng.choice("the of and to in that was".split()) if rng.random() < 0.4 else f"w{rng.randrange(500)}" for _ in range(60)) + "."
    junk = lambda: " ".join(f"w{rng.randrange(500)}***" for _ in range(60))
    for copies in (1, 6):  # fewer rows than the sample's bound, and more
        rows = [(i, clean()) for i in range(160 * copies)]
        reviews = [(i, 1, 0) for i, _ in rows]
        rows += [(len(rows) + i, junk() if i % 3 == 0 else clean()) for i in range(150 * copies)]
        labels = spark.createDataFrame(reviews, "doc_id long, quality int, toxic int")
        found = weak_quality.judged(spark.createDataFrame(rows, "doc_id long, text string"), labels).selectExpr("text like '%***%' as junk", weak_quality.KEEP + " as kept").collect()
        assert sum(not r.kept for r in found if r.junk) >= 0.95 * 50 * copies
        assert sum(r.kept for r in found if not r.junk) >= 0.95 * 260 * copies


def test_classifier_edges(docs, texts):
    found = weak_quality.judged(docs).selectExpr("doc_id", "text", "words", weak_quality.KEEP + " as kept").collect()
    assert len(found) == len(texts)
    assert all(r.kept for r in found if not WORDS.search(r.text or ""))
