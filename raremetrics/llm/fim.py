"""Fill-in-middle transformation of texts, as one pyarrow.compute pipeline per batch.

A text is split into units, two cuts part the units into prefix, middle and suffix, and
the pieces are put out in another order behind sentinels: prefix, suffix, middle (psm) or
suffix, prefix, middle (spm).  Some texts stay plain.  The cuts and the form follow from
the SHA-256 of the seed and the row's id alone, so they are the same on every run and
after a lost executor.

Every batch runs the same steps: the texts' units become list arrays (the unit strings
share the texts' bytes), the lists are flattened with their parents' indices, a unit's
ordinal is its place less its parent's first place, units are filtered by the role that
their ordinal has, the lists are rebuilt, and ``binary_join`` makes each piece.

Units are code points, or words with the white space after them (white space before the
first word is a unit of its own).

Defined cases: a null text counts as empty, and an empty text is plain; a text that
contains a sentinel is plain; a null id has the draws of an empty one; repeated rows and
equal ids have the same draws; a text longer than a batch's chunk is a step of its own; an
empty table gives an empty result; extra columns are carried along (those named like a
result are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raremetrics.llm import common, grams

SENTINELS = ("<P>", "<S>", "<M>")
#: Per cent of the texts that are transformed, and of those the per cent in the order suffix, prefix, middle.
RATE, SPM = 90, 20
SEED = 1
#: Text bytes of one step; a unit takes about 50 bytes in it.
STEP_BYTES = 1 << 19
RESULT = (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string"))


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the hex SHA-256 of ``seed:key``."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def split_units(buf: np.ndarray, off: np.ndarray, unit: str) -> pa.ListArray:
    """The units of each text, as lists of strings over the texts' own bytes."""
    start = (buf & 0xC0) != 0x80  # first bytes of code points
    if unit == "word":
        space = grams.SPACE[buf]
        start = ~space
        start[1:] &= space[:-1]
        start[off[:-1][np.diff(off) > 0]] = True
    elif unit != "character":
        raise ValueError("unit must be 'character' or 'word'")
    place = np.append(np.flatnonzero(start), len(buf)).astype(np.int32)
    units = pa.StringArray.from_buffers(len(place) - 1, pa.py_buffer(place), pa.py_buffer(np.ascontiguousarray(buf)))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(place[:-1], off).astype(np.int32)), units)


def pieces(units: pa.ListArray, cuts: list[pa.Array]) -> list[pa.Array]:
    """Prefix, middle and suffix of each list of units, which end after ``cuts[0]``, ``cuts[1]`` and all units."""
    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(units.offsets.cast(pa.int64()), parent))
    first, second = (pc.less(ordinal, pc.take(c, parent)) for c in cuts)
    size = pc.list_value_length(units).cast(pa.int64())
    roles = (first, pc.and_not(second, first), pc.invert(second))
    sizes = (cuts[0], pc.subtract(cuts[1], cuts[0]), pc.subtract(size, cuts[1]))
    out = []
    for role, n in zip(roles, sizes, strict=True):
        ends = pc.cumulative_sum(n).cast(pa.int32())
        rebuilt = pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), pc.filter(flat, role))
        out.append(pc.binary_join(rebuilt, ""))
    return out


def _order(sentinels: tuple[str, str, str], spm: bool) -> tuple[tuple[int, str], ...]:
    """(piece, sentinel before it): pieces 0 prefix, 1 middle, 2 suffix."""
    before_prefix, before_suffix, before_middle = sentinels
    head = ((0, before_prefix), (2, before_suffix))
    return (*(head[::-1] if spm else head), (1, before_middle))


def transform(texts: pa.Array, units: pa.ListArray, h: list[pa.Array], sentinels=SENTINELS, rate: int = RATE, spm: int = SPM) -> list[pa.Array]:
    """The columns of ``RESULT`` of each text, from its units and its four draws."""
    n = pc.list_value_length(units).cast(pa.int64())
    size = n.to_numpy()
    # pyarrow.compute has no remainder
    a, b = (pa.array(x.to_numpy() % (size + 1)) for x in h[:2])
    cut = [pc.min_element_wise(a, b), pc.max_element_wise(a, b)]
    plain = pc.or_(pc.equal(n, 0), pa.array(h[2].to_numpy() % 100 >= rate))
    for s in sentinels:
        plain = pc.or_(plain, pc.match_substring(texts, s))
    turned = pa.array(h[3].to_numpy() % 100 < spm)
    form = pc.if_else(plain, "plain", pc.if_else(turned, "spm", "psm"))
    part = pieces(units, cut)
    out = [pc.binary_join_element_wise(*[x for i, s in _order(sentinels, turn) for x in (pa.scalar(s), part[i])], "") for turn in (False, True)]
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(p).cast(pa.int64())) for p in part[:2]]
    return [n, form, *chars, pc.if_else(plain, texts, pc.if_else(turned, out[1], out[0]))]


def _checked(sentinels) -> tuple[str, str, str]:
    """Three different sentinels, none inside another, whose ends never begin one: so the first hit is the cut."""
    s = tuple(sentinels)
    if len(set(s)) != 3 or not all(s) or any(a in b for a in s for b in s if a != b) or any(a[-k:] == b[:k] for a in s for b in s for k in range(1, min(len(a), len(b)))):
        raise ValueError("sentinels must be three different strings that neither contain nor overlap each other")
    return s


def fill_in_middle(docs: DataFrame, key: str = "doc_id", sentinels=SENTINELS, rate: int = RATE, spm: int = SPM,
                   seed: int = SEED, unit: str = "character") -> DataFrame:
    """``docs`` without ``text``, with the columns of ``RESULT``; ``output`` is the transformed text."""
    sentinels = _checked(sentinels)
    names = [n for n, _ in RESULT]
    carried = [c for c in docs.columns if c not in ("text", *names)]
    schema = docs.select(*carried).schema
    for name, kind in RESULT:
        schema = schema.add(name, kind)
    k = len(carried)

    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in common.text_chunks(batch, limit=STEP_BYTES):
                rows = [batch.column(i).slice(lo, hi - lo) for i in range(k + 5)]
                texts = pc.fill_null(rows[k], "")
                out = transform(texts, split_units(buf, off, unit), rows[k + 1:], sentinels, rate, spm)
                yield pa.RecordBatch.from_arrays([*rows[:k], *out], names=[*carried, *names])

    drawn = common.fresh([*docs.columns, *names], "h1", "h2", "h3", "h4")
    rows = docs.select(*carried, "text", *[c.alias(n) for c, n in zip(draws(F.col(key), seed), drawn, strict=True)])
    return rows.transform(common.in_tasks, run, schema)


def rebuild(output: pa.Array, form: pa.Array, sentinels=SENTINELS) -> pa.Array:
    """The texts that the outputs were made from."""
    texts = output
    for name, turn in (("psm", False), ("spm", True)):
        at = pc.fill_null(pc.equal(form, name), False)
        if not pc.any(at).as_py():
            continue
        # no piece contains a sentinel and none overlaps another, so each first hit is a joint
        rest, part = pc.filter(output, at), {}
        (first, opening), *others = _order(sentinels, turn)
        rest = pc.list_element(pc.split_pattern(rest, opening, max_splits=1), 1)
        for i, s in others:
            halves = pc.split_pattern(rest, s, max_splits=1)
            part[first], rest, first = pc.list_element(halves, 0), pc.list_element(halves, 1), i
        part[first] = rest
        texts = pc.replace_with_mask(texts, at, pc.binary_join_element_wise(part[0], part[1], part[2], ""))
    return texts


def restore(made: DataFrame, sentinels=SENTINELS) -> DataFrame:
    """``made`` (the result of :func:`fill_in_middle`) with ``text``, exact, from ``output`` and ``form`` alone."""
    sentinels = _checked(sentinels)
    carried = [c for c in made.columns if c != "text"]
    schema = made.select(*carried).schema.add("text", "string")

    def run(batches):
        for batch in batches:
            columns = [batch.column(i) for i in range(len(carried))]
            text = rebuild(columns[carried.index("output")], columns[carried.index("form")], sentinels)
            yield pa.RecordBatch.from_arrays([*columns, text], names=[*carried, "text"])

    return made.select(*carried).transform(common.in_tasks, run, schema)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(common.documents(spark, sf_dir).select("doc_id", "text"))
    return restore(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                                F.sha2("text", 256).alias("restored_sha256"))


OP11_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
numbers AS (
  SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d
  FROM drawn),
cut AS (
  SELECT doc_id, t, n, least(a, b) AS p, greatest(a, b) - least(a, b) AS m,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain'
              WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (
  SELECT *, substring(t, 1, p) AS prefix, substring(t, p + 1, m) AS middle, substring(t, p + m + 1, n - p - m) AS suffix FROM cut)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(p AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(m AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
