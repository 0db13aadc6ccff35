"""The Jaccard join, connected components, suffix arrays and fingerprints."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from raremetrics.llm import components, jaccard, suffixes, syncmers

from .conftest import WORD, ODD, words

SF = "/root/testdata/sf0.001"


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            n = len(s & sets[j])
            if s and 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[top(i)].append(d)
    return sorted((d, min(least[top(i)]), links[i]) for i, (d, _) in enumerate(rows))


def test_links_equal_brute_force(spark, odd):
    real = [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    r = random.Random(4)
    group = [(5000 + k, " ".join(w if r.random() > 0.01 else f"z{r.randrange(99)}" for w in words(ODD[4][1]))) for k in range(40)]
    rows = [(x[0], x[1]) for x in ODD if x[0] is not None] + real + group
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "class_id", "n_links").collect())) == brute_links(rows)


def test_texts_under_one_id_and_without_id_keep_their_links(spark):
    r = random.Random(8)
    tops = [" ".join(f"{c}{i}" for i in range(200)) for c in "abc"]
    near = [[" ".join(w if r.random() > 0.005 else f"z{r.randrange(99)}" for w in t.split()) for _ in range(4)] for t in tops]
    rows = [(1, near[0][0]), (1, near[1][0]), (2, near[0][1]), (3, near[1][1]), (1, near[0][2]), (4, near[0][3]), (None, near[1][2]), (None, near[2][0]), (None, near[2][1]), (None, near[2][1])]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = brute_links([(k, t) for k, (_, t) in enumerate(rows)])
    named = {k: min((rows[j][0] for j, c, _ in expected if c == own and rows[j][0] is not None), default=None) for k, own, _ in expected}
    assert sorted((str(x.doc_id), x.n_links) for x in got) == sorted((str(rows[k][0]), n) for k, _, n in expected)
    assert sorted((x.doc_id, x.class_id) for x in got if x.doc_id) == sorted((rows[k][0], c) for k, c in named.items() if rows[k][0])
    assert min(n for _, _, n in expected) > 0
    assert len({x.class_id for x in got if x.doc_id is None}) == len({c for k, c, _ in expected if rows[k][0] is None})


def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    r = random.Random(5)
    rows = [(k, " ".join(w if r.random() > 0.015 else f"z{r.randrange(99)}" for w in words(ODD[4][1]))) for k in range(60)]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_links(rows)


def test_jaccard_on_odd_tables(spark, odd, clashing, empty):
    got = jaccard.jaccard_classes(clashing)
    assert got.filter("label = 'own label' and node = 'own node'").count() == got.count() >= len(ODD)
    assert jaccard.jaccard_classes(odd.select("doc_id", "text")).filter("doc_id is null").count() == 1
    assert jaccard.jaccard_classes(empty).count() == 0


def test_pruning_bound_is_the_posterior_tail():
    need = jaccard.least_matches()
    draw = np.random.Generator(np.random.PCG64(1))
    for n in (16, 96):
        lost = (draw.binomial(n, 0.8, 200_000) < need[n]).mean()
        assert lost < 1e-4
    left, right = jaccard.surviving(np.stack([np.arange(96), np.arange(96), np.arange(96) + 1]).astype(np.uint32), *np.triu_indices(3, 1))
    assert (left.tolist(), right.tolist()) == ([0], [1])


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**dict.fromkeys(range(1, 41), 1), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_suffix_arrays_equal_brute_force(seed):
    r = random.Random(seed)
    letters = r.choice([b"ab", b"abc\x00", b"\xc3\xa9 a", b"a"])
    depth = r.choice([3, 5, 6])
    segments = [bytes(r.choice(letters) for _ in range(r.randint(6, 40))) for _ in range(r.randint(1, 8))]
    counts = [len(s) - depth + 1 if r.random() < 0.7 else max(1, (len(s) - depth + 1) // 2) for s in segments]
    seen = Counter(s[i:i + depth] for s, n in zip(segments, counts, strict=True) for i in range(n))
    expected = [[seen[s[i:i + depth]] > 1 for i in range(n)] for s, n in zip(segments, counts, strict=True)]
    assert [x.tolist() for x in suffixes.repeated(segments, counts, depth)] == expected


def brute_cut(texts, length):
    seen = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "group"), [(400, 256), (400, 2), (90, 2)])
def test_cut_passages_equal_brute_force(spark, monkeypatch, length, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    r = random.Random(8)
    passage = " ".join(f"p{r.randrange(9999)}" for _ in range(120))
    rows = [(x[0], x[1]) for x in ODD if x[0] != 11]
    rows += [(100 + k, f"{'u' * k} {r.random()} " + passage[r.randrange(60):len(passage) - r.randrange(60)] + f" {r.random()}") for k in range(12)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length, text=False)
    expected = sorted((str(d), *c) for (d, _), c in zip(rows, brute_cut([(t or "").encode() for _, t in rows], length), strict=True))
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.collect()) == expected


def test_cut_on_odd_tables(clashing, empty):
    got = suffixes.remove_repeats(clashing)
    assert got.count() == len(ODD) and got.filter("hash = 'own hash' and start = 'own start'").count() == len(ODD)
    by = {r.doc_id: r for r in got.collect()}
    assert by[12].text == "" and by[5].text == "" and by[13].text.startswith("q") and by[14].text == "tail "
    assert suffixes.remove_repeats(empty).count() == 0


def brute_cut_words(texts, n):
    """Words of runs of ``n`` that occur twice, cut with the white space after them."""
    found = [list(WORD.finditer(t)) for t in texts]
    tokens = [[m.group() for m in f] for f in found]
    seen = Counter(tuple(t[p:p + n]) for t in tokens for p in range(len(t) - n + 1))
    out = []
    for text, f, t in zip(texts, found, tokens, strict=True):
        gone = [False] * len(t)
        for p in range(len(t) - n + 1):
            if seen[tuple(t[p:p + n])] > 1:
                gone[p:p + n] = [True] * n
        ends = [m.start() for m in f[1:]] + [len(text)][:len(f)]
        out.append((text[:f[0].start()] if f else text) + "".join(text[m.start():e] for m, e, g in zip(f, ends, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("n", "group"), [(51, 256), (51, 2), (20, 256)])
def test_cut_words_equal_brute_force(spark, monkeypatch, n, group):
    """Passages just over and under the length, of short and long words, under other white space, twice in one text."""
    monkeypatch.setattr(suffixes, "GROUP", group)
    r = random.Random(n)
    short = [r.choice("abcdefgh") for _ in range(90)]
    long = [f"überlang{r.randrange(999)}" for _ in range(90)]
    rows = [(x[0], x[1]) for x in ODD if x[0] != 11]
    for k in range(24):
        part = (short if k % 2 else long)[k % 5:k % 5 + n - 2 + k % 6]
        rows.append((100 + k, f"first{r.random()} " + r.choice([" ", "  ", "\n"]).join(part) + f"\t last{r.random()}" + (" " + " ".join(part) if k % 7 == 0 else "")))
    got = suffixes.remove_repeated_words(spark.createDataFrame(rows, "doc_id long, text string"), n)
    assert sorted((str(x.doc_id), x.text) for x in got.collect()) == sorted((str(d), t) for (d, _), t in zip(rows, brute_cut_words([t or "" for _, t in rows], n), strict=True))


def test_cut_words_on_odd_tables(clashing, empty):
    got = suffixes.remove_repeated_words(clashing, 51)
    assert got.count() == len(ODD) and got.filter("own = 'own own' and spans = 'own spans'").count() == len(ODD)
    assert suffixes.remove_repeated_words(empty, 51).count() == 0


def spark_hash(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v % 2**64).to_bytes(8, "little"), seed)
    return seed - 2**64 if seed >= 2**63 else seed


def brute_values(text):
    """(place, hash) of each anchor."""
    h = [spark_hash(w.encode()) for w in words(text)]
    k, s = syncmers.K, syncmers.S
    inner = [spark_hash(*h[i:i + s]) for i in range(len(h) - s + 1)]
    found = []
    for i in range(len(h) - k + 1):
        own = inner[i:i + k - s + 1]
        if min(own) in (own[0], own[-1]):
            found.append((i, spark_hash(*h[i:i + k])))
    if h and not found:
        whole = 42
        for x in h:
            whole = spark_hash(whole, x)
        found = [(0, whole)]
    return [(i, x % 2**64 >> 32) for i, x in found]


def brute_string(values):
    return "".join(f"{i - j:x}{x:08x}" for (i, x), (j, _) in zip(values, [(0, 0), *values]))


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    slack = max(syncmers.SLACK, max([i for i, _ in [*a, *b]]) * syncmers.SHARE)
    a, b = ({x: i for i, x in reversed(v)} for v in (a, b))
    offsets = sorted(b[x] - a[x] for x in a.keys() & b.keys())
    near = sum(abs(d - offsets[len(offsets) // 2]) <= slack for d in offsets)
    return near / (len(a) + len(b) - near)


def test_fingerprints_equal_brute_force(spark, odd):
    got = syncmers.edited_fingerprints(odd)
    assert got.count() == len(ODD)
    rows = sorted({(r[0] if r[0] is not None else -1, r[1] or "") for r in ODD})
    by = {r.doc_id if r.doc_id is not None else -1: r for r in got.collect()}
    for k, (d, text) in enumerate(rows):
        follow = rows[(k + 1) % len(rows)][1]
        n = len(text) // 4
        edited = text[:len(text) - n] + follow[:n]
        a, e, b = brute_values(text), brute_values(edited), brute_values(follow)
        r = by[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == brute_string(a) and r.edited_fingerprint == brute_string(e)
        assert (r.near_edited, r.near_next) == (pytest.approx(brute_likeness(a, e)), pytest.approx(brute_likeness(a, b)))


def test_fingerprints_are_native_and_take_odd_tables(spark, clashing, empty):
    got = syncmers.edited_fingerprints(clashing)
    assert got.count() == len(ODD)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert syncmers.edited_fingerprints(empty).count() == 0
    alone = syncmers.edited_fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0
    assert syncmers.fingerprints(clashing.select("doc_id", "text", F.lit(1).alias("fingerprint"))).count() == len(ODD)


def test_anchors_match_by_place(spark):
    w = [f"w{i}" for i in range(400)]
    swapped, grown, longer = w[200:] + w[:200], w[:150] + ["new"] * 7 + w[150:], [f"v{i % 7000}" for i in range(20_000)]
    rows = [(" ".join(w), " ".join(swapped)), (" ".join(w), " ".join(grown)), (" ".join(w), " ".join(w)),
            (" ".join(longer), " ".join(longer[:9_000] + longer[9_001:])), ("a b", "a b"), ("a b", "b a")]
    pairs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string").select(
        "i", syncmers.anchors(F.col("a")).alias("a"), syncmers.anchors(F.col("b")).alias("b"))
    got = {r.i: r for r in pairs.select("i", "a", syncmers.likeness(F.col("a"), F.col("b")).alias("near")).collect()}
    want = [brute_likeness(*map(brute_values, r)) for r in rows]
    assert [got[i].near for i in range(len(rows))] == pytest.approx(want)
    assert got[0].near < 0.4 and got[1].near > 0.95 and got[2].near == got[4].near == 1.0 and got[5].near == 0.0
    places = [(x % 2**32) >> 1 for x in got[3].a]
    assert len(places) > 8_000 and max(b - a for a, b in zip([0, *places], places)) <= syncmers.K - syncmers.S  # none is left out
