"""Suffix-array dedup of long repeated passages over all documents.

A byte goes if some string of ``length`` bytes that covers it also starts elsewhere, in
another document or the same.  Three steps, none of which holds more than bounded parts:

1. *Anchors.*  Every window of a string's bytes has a smallest hash of ``GRAM`` bytes
   (the leftmost of equal ones), and equal strings have it at the same place.  So each
   start of a ``length``-byte string belongs to one anchor, equal strings to anchors with
   equal hashes, and starts whose anchor's hash occurs once in the corpus are settled.
2. *Segments.*  For the other anchors the stretch of text of their starts is cut out.
   Equal segments meet in a count (aggregated before the shuffle); all starts of a
   segment that occurs twice are repeated.
3. *Suffix arrays.*  The distinct segments of a hash are sorted by two-stage suffix
   sorting (:func:`suffix_order`), and starts whose neighbours in that order have a
   common prefix of ``length`` bytes are repeated.  A hash with more than ``GROUP``
   distinct segments is split first, by where the anchor lies in the string: strings
   with the anchor at nearly one place share a longer stretch around it, whose hash
   parts them further.  Splits go on until a string's place is fixed and the stretch
   is the string itself, so the work grows with the segments, not with their pairs.

Strings are compared byte by byte in step 3, or as equal segments by a 128-bit hash;
anchors and stretches are found by hashes of 64 bits.  All is judged on the input, and the covered bytes are then cut.

Defined cases: a null text counts as empty; texts shorter than ``length`` bytes keep all;
repeated rows are copies of each other; rows that share an id are told apart by a digest
of their text; extra columns are carried along (those named like a result are replaced);
an empty table gives an empty result.  When a cut leaves part of a character, ``text``
drops that part (the counts and the checksum are those of the bytes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raremetrics.llm import common, grams

LENGTH = 400
GRAM = 64
#: Distinct segments that one suffix array takes; more of one hash are split first.
GROUP = 256
#: Parts of the anchor's range of places in one split.
SPLIT = 8
#: Starts that one suffix array holds, about.
STARTS = 30_000
_PLACE = np.uint64(28)  # low bits of an anchor key: the place, for the leftmost of equal hashes


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of each run of starts with one anchor: text number, first start (in the text), starts, anchor hash."""
    n = len(buf) - GRAM + 1
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none
    place = np.arange(n)
    h = grams.Hashed(buf).of(place, place + GRAM)
    low = np.uint64((1 << int(_PLACE)) - 1)
    key = (h & ~low) | place.astype(np.uint64)
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[:len(key) - (span - width)], key[span - width:])
    anchor = (key & low).astype(np.int64)  # of the string that starts at each place
    size = np.diff(off)
    own = np.repeat(np.arange(len(size)), size)[:len(anchor)]
    fits = np.arange(len(anchor)) + length <= off[1:][own]
    at = np.flatnonzero(fits)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (own[at[1:]] != own[at[:-1]])
    first = np.flatnonzero(new)
    starts = np.diff(np.append(first, len(at)))
    at = at[first]
    return own[at], at - off[own[at]], starts, h[anchor[at]].view(np.int64)


def suffix_order(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The starts, sorted by the first ``depth`` bytes of their suffixes, by two-stage sorting.

    ``text`` holds the segments as bytes raised by one, each followed by a zero, and
    ends in ``depth`` zeros.  Suffixes smaller than their successor are sorted directly;
    the others follow by scanning the buckets of first bytes in rising order: a suffix
    one longer than a scanned one, and not smaller than it, comes next in its own bucket.
    """
    n = len(text) - depth
    step = np.sign(text[1:n + 1].astype(np.int16) - text[:n].astype(np.int16))
    # equal neighbours take the sign of the next unequal ones
    where = np.where(step != 0, np.arange(n), n - 1)
    where = np.minimum.accumulate(where[::-1])[::-1]
    smaller = (step[where] > 0) | (text[:n] == 0)
    # suffixes to rank: the starts, and what follows them up to one that is sorted directly
    follow = np.where(smaller, np.arange(n), n - 1)
    follow = np.minimum.accumulate(follow[::-1])[::-1]
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, follow[starts] + 1, -1)
    needed = np.cumsum(change[:-1]) > 0
    direct = np.flatnonzero(needed & smaller)
    larger = needed & ~smaller
    view = np.lib.stride_tricks.sliding_window_view(text, depth)
    order = np.argsort(np.ascontiguousarray(view[direct]).view(f"S{depth}").ravel(), kind="stable")
    direct = direct[order]
    byte = text[direct]
    edges = np.searchsorted(byte, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        front = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(front):
            bucket.append(front)
            before = front[front > 0] - 1
            front = before[larger[before] & (text[before] == c)]
        bucket.append(direct[edges[c]:edges[c + 1]])
        done = np.concatenate(bucket)
        if not len(done):
            continue
        out.append(done)
        before = done[done > 0] - 1
        before = before[larger[before]]
        first = text[before]
        before, first = before[first > c], first[first > c]
        if len(before):
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
            for part in np.split(before, cuts):
                waiting[text[part[0]]].append(part)
    ranked = np.concatenate(out) if out else np.zeros(0, np.int64)
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    return ranked[wanted[ranked]]


def repeated(segments: list[bytes], counts: list[int], depth: int = LENGTH) -> list[np.ndarray]:
    """Which of the first ``counts`` starts of each segment share ``depth`` bytes with another start."""
    size = np.array([len(s) for s in segments])
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(begin[-1] + depth, np.uint8)
    for s, at in zip(segments, begin.tolist(), strict=False):
        text[at:at + len(s)] = np.frombuffer(s, np.uint8) + np.uint8(1)
    counts = np.asarray(counts)
    starts = np.repeat(begin[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    order = suffix_order(text, starts, depth)
    view = np.lib.stride_tricks.sliding_window_view(text, depth)
    found = np.zeros(len(text), bool)
    for lo in range(0, len(order) - 1, 8192):
        a, b = order[lo:lo + 8192], order[lo + 1:lo + 8193]
        a = a[:len(b)]
        # adjacent common prefixes: the first unequal byte, or the whole depth
        unequal = view[a] != view[b]
        common_prefix = np.where(unequal.any(axis=1), unequal.argmax(axis=1), depth)
        full = common_prefix >= depth
        found[a[full]] = True
        found[b[full]] = True
    return [found[at:at + n] for at, n in zip(begin.tolist(), counts.tolist(), strict=False)]


def ranges(flags: np.ndarray) -> list[dict]:
    """Maximal runs of set flags, as first and end."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, digest) of the documents; the id and the digest find a text again."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("digest"))


def anchor_rows(texts: DataFrame, length: int, encode: Callable) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo, _, *text in common.text_chunks(batch):
                buf, off = encode(*text)
                own, start, count, h = anchors(buf, off, length)
                rows = pa.array(own + lo)
                yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(rows), batch.column(2).take(rows),
                                                  pa.array(start), pa.array(count)], names=["hash", "doc_id", "digest", "start", "n"])

    return texts.transform(common.in_tasks, run, "hash long, doc_id long, digest long, start long, n long")


def segments(texts: DataFrame, shared: DataFrame, length: int, encode: Callable) -> DataFrame:
    """(hash, segment, doc_id, digest, start, n, bytes): the bytes once for equal segments of a chunk."""
    # one row per text, with as many anchors as the text has
    wanted = shared.groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("dg")).agg(F.collect_set(F.struct("start", "n", "hash")).alias("cuts"))
    rows = texts.join(wanted, texts.doc_id.eqNullSafe(F.col("id")) & (texts.digest == F.col("dg"))).select("doc_id", "digest", "text", "cuts")

    def run(batches):
        kinds = pa.schema([("hash", pa.int64()), ("segment", pa.binary()), ("doc_id", pa.int64()), ("digest", pa.int64()),
                           ("start", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())])
        for batch in batches:
            for lo, hi, *text in common.text_chunks(batch):
                buf, off = encode(*text)
                raw, seen = memoryview(np.ascontiguousarray(buf)), set()
                cols: list[list] = [[] for _ in range(7)]
                cuts = batch.column(3).slice(lo, hi - lo)
                flat = cuts.flatten()
                start, n, h = (flat.field(i).to_numpy() for i in range(3))
                row = np.repeat(np.arange(hi - lo), pa.compute.list_value_length(cuts).to_numpy())
                ids, digests = batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist()
                for i, s, k, x in zip(row.tolist(), start.tolist(), n.tolist(), h.tolist(), strict=True):
                    at = int(off[i]) + s
                    part = raw[at:at + k + length - 1]
                    name = hashlib.md5(part, usedforsecurity=False).digest()
                    known = (x, name) in seen
                    seen.add((x, name))
                    for col, value in zip(cols, (x, name, ids[i], digests[i], s, k, None if known else bytes(part)), strict=True):
                        col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)

    return rows.transform(common.in_tasks, run, "hash long, segment binary, doc_id long, digest long, start long, n long, bytes binary")


def refined(rows: DataFrame, length: int, width: int) -> DataFrame:
    """(key, hash, segment, n, bytes, parent_key, parent, shift): each segment's starts, split by the anchor's place.

    Starts whose strings have the anchor at one of ``width`` neighbouring places make one
    part.  All its strings hold ``length + 1 - width`` bytes around the anchor, and the new
    key is the hash of those; ``shift`` is the part's first start.
    """
    kinds = pa.schema([("key", pa.int64()), ("hash", pa.int64()), ("segment", pa.binary()), ("n", pa.int64()), ("bytes", pa.binary()),
                       ("parent_key", pa.int64()), ("parent", pa.binary()), ("shift", pa.int64())])

    def run(batches):
        for batch in batches:
            keys, hashes, parents, counts, data = (batch.column(i).to_pylist() for i in range(5))
            ends = np.cumsum([len(x) for x in data])
            lo = 0
            while lo < len(data):
                done = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, done + common.CHUNK_BYTES, "right")))
                raw = b"".join(data[lo:hi])
                off = np.concatenate([[0], ends[lo:hi] - done])
                hashed = grams.Hashed(np.frombuffer(raw, np.uint8))
                place = np.arange(len(raw) - GRAM + 1)
                own = np.repeat(np.arange(hi - lo), np.diff(off))[:len(place)]
                # no gram before the anchor has its hash, or it would be the anchor of the first start
                hit = np.flatnonzero(hashed.of(place, place + GRAM).view(np.int64) == np.array(hashes[lo:hi], np.int64)[own])
                anchor = hit[np.unique(own[hit], return_index=True)[1]] - off[:-1]
                n = np.array(counts[lo:hi])
                least, most = (anchor - n + 1) // width, anchor // width
                row = np.repeat(np.arange(hi - lo), most - least + 1)
                part = np.arange(len(row)) - np.searchsorted(row, row) + least[row]
                first = np.maximum(0, anchor[row] - (part + 1) * width + 1)
                last = np.minimum(n[row] - 1, anchor[row] - part * width)
                around = off[row] + anchor[row] - part * width
                key = hashed.of(around, around + length + 1 - width) + np.array(keys[lo:hi], np.int64).view(np.uint64)[row]
                key = grams.mix(grams.mix(key) + part.astype(np.uint64)).view(np.int64)
                cols: list[list] = [[] for _ in range(8)]
                seen = set()
                for i, x, a, z, at in zip(row.tolist(), key.tolist(), first.tolist(), last.tolist(), off[row].tolist(), strict=True):
                    piece = raw[at + a:at + z + length]
                    name = hashlib.md5(piece, usedforsecurity=False).digest()
                    known = (x, name) in seen
                    seen.add((x, name))
                    for col, value in zip(cols, (x, hashes[lo + i], name, z - a + 1, None if known else piece, keys[lo + i], parents[lo + i], a), strict=True):
                        col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)
                lo = hi

    return rows.select("key", "hash", "segment", "n", "bytes").transform(
        common.in_tasks, run, "key long, hash long, segment binary, n long, bytes binary, parent_key long, parent binary, shift long")


def sorted_groups(rows: DataFrame, length: int) -> DataFrame:
    """(key, segment, runs): repeated starts of each distinct segment, from suffix arrays of its key's segments."""
    rows = rows.select("key", "segment", "n", "bytes").repartition("key").sortWithinPartitions("key", "segment")
    kinds = pa.schema([("key", pa.int64()), ("segment", pa.binary()), ("runs", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))])

    def run(batches):
        held: list[tuple] = []
        starts, last = 0, None

        def solve():
            out = []
            for (key, name, _, _), flags in zip(held, repeated([x[3] for x in held], [x[2] for x in held], length), strict=True):
                if flags.any():
                    out.append({"key": key, "segment": name, "runs": ranges(flags)})
            return pa.RecordBatch.from_pylist(out, schema=kinds)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                # whole groups only
                if held and row[0] != last and starts >= STARTS:
                    yield solve()
                    held, starts = [], 0
                last = row[0]
                held.append(row)
                starts += row[2]
        if held:
            yield solve()

    return rows.transform(common.in_tasks, run, f"key long, segment binary, {RUNS}")


RUNS = "runs array<struct<lo: long, hi: long>>"


def distinct_segments(parts: DataFrame) -> DataFrame:
    distinct = parts.groupBy("key", "segment").agg(F.first("hash").alias("hash"), F.first("bytes", ignorenulls=True).alias("bytes"),
                                                   F.max("n").alias("n"), F.count("*").alias("c"))
    return common.materialise(distinct, "suffix-distinct")


def repeated_starts(distinct: DataFrame, length: int, width: int) -> DataFrame:
    """(key, segment, runs): the starts of each distinct segment whose string occurs twice; ``width`` places have its anchor.

    Where the width is 1 a segment is one string, and a key has several by a chance
    equality of hashes alone.
    """
    sizes = common.materialise(distinct.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "suffix-groups")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))).alias("runs")
    marks = distinct.filter("c > 1").select("key", "segment", whole)
    few = F.lit(True) if width == 1 else F.col("size") <= GROUP
    marks = marks.unionByName(sorted_groups(distinct.join(sizes.filter(few), "key"), length))
    large = sizes.filter(~few)
    if not large.isEmpty():
        width = -(-width // SPLIT)
        parts = common.materialise(refined(distinct.join(large, "key"), length, width), "suffix-parts")
        inner = repeated_starts(distinct_segments(parts), length, width)
        shifted = F.transform("runs", lambda r: F.struct((r.lo + F.col("shift")).alias("lo"), (r.hi + F.col("shift")).alias("hi")))
        back = parts.select("key", "segment", "parent_key", "parent", "shift").join(inner, ["key", "segment"])
        marks = marks.unionByName(back.select(F.col("parent_key").alias("key"), F.col("parent").alias("segment"), shifted.alias("runs")))
    return common.materialise(marks.groupBy("key", "segment").agg(F.flatten(F.collect_list("runs")).alias("runs")), "suffix-marks")


RESULT = (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"))


def as_it_is(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return buf, off


def repeated_spans(texts: DataFrame, length: int, encode: Callable = as_it_is) -> DataFrame:
    """(doc_id, digest, spans) of the texts (doc_id, text, digest) in which strings of ``length`` bytes start that occur twice.

    ``encode`` makes the bytes that are compared (and their offsets) of the texts' bytes.
    """
    found = common.materialise(anchor_rows(texts, length, encode), "suffix-anchors")
    # read from a written table, the hashes let the adaptive join split those that very many texts share
    often = common.materialise(found.groupBy("hash").agg(F.count("*").alias("c")).filter("c > 1").select("hash"), "suffix-often")
    parts = common.materialise(segments(texts, found.join(often, "hash"), length, encode), "suffix-segments")
    distinct = distinct_segments(parts.withColumn("key", F.col("hash")))
    marks = repeated_starts(distinct, length, length - GRAM + 1).withColumnRenamed("key", "hash")
    # a segment that very many texts share is split by the adaptive join: both sides are its own rows
    spans = (parts.select("hash", "segment", "doc_id", "digest", "start").join(marks, ["hash", "segment"])
             .groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "runs")).alias("spans")))
    return common.materialise(spans, "suffix-spans")


def with_spans(docs: DataFrame, carried: list[str], spans: DataFrame) -> DataFrame:
    """``carried`` of the documents, the whole text and its spans (null: none), the last two by place."""
    text, own, digest, of_id, of_digest, marked = common.fresh(carried, "text", "own", "digest", "of_id", "of_digest", "marked")
    body = F.coalesce("text", F.lit(""))
    whole = docs.select(*carried, F.col("doc_id").alias(own), body.alias(text), F.xxhash64(body).alias(digest))
    spans = spans.toDF(of_id, of_digest, marked)
    rows = whole.join(spans, whole[own].eqNullSafe(spans[of_id]) & (whole[digest] == spans[of_digest]), "left")
    return rows.select(*carried, text, marked)


def covered(marked, n: int, length: int) -> np.ndarray:
    """Which of ``n`` bytes lie in a marked string."""
    gone = np.zeros(n + 1, np.int32)
    for m in marked.as_py() or ():
        for r in m["runs"]:
            gone[m["start"] + r["lo"]] += 1
            gone[m["start"] + r["hi"] + length - 1] -= 1
    return np.cumsum(gone[:-1]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: bool = True) -> DataFrame:
    """``docs`` with the repeated passages cut from ``text`` (left out if not ``text``) and the columns of ``RESULT``."""
    spans = repeated_spans(_texts(docs), length)
    names = [n for n, _ in RESULT]
    carried = [c for c in docs.columns if c not in ("text", *names)]
    schema = docs.select(*carried).schema
    for name, kind in (*((("text", "string"),) if text else ()), *RESULT):
        schema = schema.add(name, kind)
    place = len(carried) + 1

    def cut(batches):
        for batch in batches:
            for lo, hi, buf, off in common.text_chunks(batch, batch.schema.names[place - 1]):
                out: list[list] = [[] for _ in range(5)]
                for i, marked in enumerate(batch.column(place).slice(lo, hi - lo)):
                    own = buf[off[i]:off[i + 1]]
                    gone = covered(marked, len(own), length)
                    kept = own[~gone].tobytes()
                    for col, value in zip(out, (kept.decode("utf-8", "ignore"), len(own), int(gone.sum()),
                                                int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=0) == 1)), hashlib.sha256(kept).hexdigest()), strict=True):
                        col.append(value)
                arrays = [batch.column(i).slice(lo, hi - lo) for i in range(len(carried))]
                arrays += [pa.array(out[0], pa.string())] if text else []
                arrays += [pa.array(c, pa.int64()) for c in out[1:4]] + [pa.array(out[4], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return with_spans(docs, carried, spans).transform(common.in_tasks, cut, schema)


#: Characters that stand for one word, six bits each.
CODE = 6
_LETTERS = np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+-", np.uint8)


def coded_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text with every word replaced by ``CODE`` letters of its hash, and no white space: bytes and offsets."""
    start, end, first = grams.words(buf, off)
    h = grams.Hashed(buf).of(start, end)
    letters = _LETTERS[((h[:, None] >> (np.arange(CODE, dtype=np.uint64) * np.uint64(6))) & np.uint64(63)).astype(np.int64)]
    return letters.ravel(), first * CODE


def remove_repeated_words(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` without the words of its texts that lie in a run of ``words`` words which also starts elsewhere.

    Runs are compared word by word, whatever white space parts them: every word becomes
    ``CODE`` letters of its 64-bit hash (36 bits), and the repeated strings of that many letters are
    found as above.  A cut takes the white space after its words along; other texts stay
    as they are (a null text becomes empty).
    """
    spans = repeated_spans(_texts(docs), words * CODE, coded_words)
    carried = [c for c in docs.columns if c != "text"]
    schema = docs.select(*carried).schema.add("text", "string")
    place = len(carried) + 1

    def cut(batches):
        for batch in batches:
            for lo, hi, buf, off in common.text_chunks(batch, batch.schema.names[place - 1]):
                marked = batch.column(place).slice(lo, hi - lo)
                start, _, first = grams.words(buf, off)
                keep = np.ones(len(buf), bool)
                for i in np.flatnonzero(marked.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    a, b = first[i], first[i + 1]
                    # a word goes if all its letters do
                    gone = covered(marked[i], (b - a) * CODE, words * CODE).reshape(-1, CODE).all(axis=1)
                    bounds = np.append(start[a:b], off[i + 1])
                    keep[bounds[0]:bounds[-1]] = np.repeat(~gone, np.diff(bounds))
                text = [buf[x:y][keep[x:y]].tobytes().decode() for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(lo, hi - lo) for j in range(len(carried))), pa.array(text, pa.string())], names=schema.names)

    return with_spans(docs, carried, spans).transform(common.in_tasks, cut, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``text``: what remains of the text."""
    found = remove_repeats(common.documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", *[n for n, _ in RESULT], "text")
