"""Fill-in-middle: the transformation against plain Python, and exact round trips."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from raremetrics.llm import fim

from .conftest import ODD

RARE = ["<P>", "a<S>b", "x<M", "<S", "P><P", "<<P>>", "é😀日本", "\x00\x01", "<P<S<M>", "áb", " ", "\n\n"]


def pieces(text, key, unit="character", seed=1):
    units = list(text) if unit == "character" else re.findall(r"\A[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fim.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["character", "word"])
def test_against_plain_python_and_back(spark, clashing, unit):
    rows = [(i, (RARE[i % len(RARE)] * (i % 4)) + f"w{i} zwei  drei" * (i % 3)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for table, source in ((docs, rows), (clashing, [(r[0], r[1]) for r in ODD])):
        made = fim.fill_in_middle(table, unit=unit)
        got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect())
        key = lambda x: (x[0], str(x[1:]))
        assert sorted(got, key=key) == sorted(((str(d), *pieces(t or "", d, unit)) for d, t in source), key=key)
        back = fim.restore(made)
        assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(d), t or "") for d, t in source)
    assert "own label" in {r.label for r in made.collect()} and made.filter("form = 'psm'").count()


def test_options_and_empty(spark, empty):
    assert fim.fill_in_middle(empty).count() == 0 and fim.restore(fim.fill_in_middle(empty)).columns[-1] == "text"
    docs = spark.createDataFrame([(i, "abc def " * i) for i in range(1, 60)], "k long, text string")
    made = fim.fill_in_middle(docs, key="k", sentinels=("[pre]", "[suf]", "[mid]"), rate=100, spm=100, seed=7)
    assert {r.form for r in made.collect()} == {"spm"}
    assert all(r.output.startswith("[suf]") for r in made.collect())
    assert sorted((r.k, r.text) for r in fim.restore(made, ("[pre]", "[suf]", "[mid]")).collect()) == sorted(map(tuple, docs.collect()))
    for bad in (("a", "a", "b"), ("ab", "a", "c"), ("xy", "yz", "q"), ("", "a", "b")):
        with pytest.raises(ValueError, match="sentinels"):
            fim.fill_in_middle(docs, key="k", sentinels=bad)
    with pytest.raises(ValueError, match="unit"):
        fim.split_units(np.zeros(1, np.uint8), np.array([0, 1]), "line")


def test_roles_cover_every_unit():
    units = pa.array([["a", "b", "c"], [], ["d"], ["e", "f"]])
    cuts = [pa.array([1, 0, 0, 2]), pa.array([2, 0, 1, 2])]
    assert [p.to_pylist() for p in fim.pieces(units, cuts)] == [["a", "", "", "ef"], ["b", "", "d", ""], ["c", "", "", ""]]
