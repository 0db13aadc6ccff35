"""SimHash fingerprints and their groups against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from raremetrics.llm import simhash

from .conftest import ODD, WORD

LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text, words=4):
    w = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def groups(values, distance):
    """Smallest place that links reach, over all pairs."""
    v = np.array(values, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= distance
    label = np.arange(len(v))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return label.tolist()
        label = new


def expected(rows, distance=4):
    prints = [fingerprint(t) for _, t in rows]
    label = groups(prints, distance)
    least = {}
    for (d, _), g in zip(rows, label, strict=True):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return sorted((str(d), f"{p:016x}", str(least.get(g))) for (d, _), p, g in zip(rows, prints, label, strict=True))


def test_odd_tables(odd, clashing, empty):
    rows = [(r[0], r[1]) for r in ODD]
    for table in (odd, clashing):
        got = simhash.simhash_components(table)
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got.collect()) == expected(rows)
        assert set(table.columns) - {"text"} | {"fingerprint", "component_id"} == set(got.columns)
    assert simhash.simhash_components(empty).count() == 0


def test_near_copies_against_brute_force(spark):
    r = random.Random(5)
    rows, n = [], 0
    for base in range(40):
        text = [r.choice(["alpha", "beta", "Gamma", "delta", "ünï", f"w{base}", f"x{r.randrange(90)}"]) for _ in range(250)]
        for _ in range(1 + base % 7):
            own = list(text)
            for _ in range(r.randrange(6)):
                own[r.randrange(len(own))] = f"z{r.randrange(5)}"
            rows.append((n, " ".join(own)))
            n += 1
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in got.collect()) == expected(rows)


@pytest.mark.parametrize(("distance", "block", "split"), [(4, 4096, 1 << 15), (4, 16, 1 << 15), (4, 16, 40), (3, 8, 20), (0, 64, 1 << 15), (6, 16, 40)])
def test_edges_connect_what_links_connect(spark, monkeypatch, distance, block, split):
    """Dense groups, scattered values and extremes, also where groups are cut in blocks or parted further."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SPLIT", split)
    r = random.Random(distance)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(3):
        centre = r.getrandbits(64)
        for _ in range(120):
            v = centre
            for _ in range(r.randrange(6)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    values |= {r.getrandbits(64) for _ in range(100)}
    stem = r.getrandbits(22) << 42  # many values that share a segment alone
    values |= {stem | r.getrandbits(42) for _ in range(150)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.fingerprint_edges(spark.createDataFrame([(v,) for v in signed], "node long"), distance).collect()
    place = {v: i for i, v in enumerate(signed)}
    label = list(range(len(values)))
    for e in edges:
        assert bin(values[place[e.u]] ^ values[place[e.v]]).count("1") <= distance

        def root(i):
            while label[i] != i:
                i = label[i]
            return i

        a, b = sorted((root(place[e.u]), root(place[e.v])))
        label[b] = a
    assert [root(i) if edges else i for i in range(len(values))] == groups(values, distance)


def test_segments_leave_one_with_at_most_one_difference():
    for distance in range(9):
        parts = simhash.segments(list(range(64)), distance)
        assert sorted(sum(parts, [])) == list(range(64)) and distance // len(parts) <= 1
