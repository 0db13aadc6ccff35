"""Similarity join on word n-grams with Bayesian candidate pruning.

Texts with equal sets of word n-grams form a class, and one member stands for it.
MinHash signatures of the classes are banded; classes that share a band's bucket are
compared a few hash values at a time, and a pair is dropped as soon as the posterior
probability that its Jaccard similarity reaches the threshold (uniform prior, given the
agreements so far) falls below ``TOLERANCE``.  What survives only says which classes
belong together; the exact sets then are brought together by connected group, and every
pair inside a group is verified by exact set intersection, so the links are exact.

A bucket or group of any size is cut into blocks by hash, and each pair of blocks is one
unit of work: no task holds more than two blocks, and what it emits is one row per class
(links counted, and an edge to a root), never the pairs.

Defined cases: a text of fewer than ``WORDS`` words has one n-gram, all its words; a
null or empty text (or white space alone) has none and is alone; repeated rows and equal
texts are copies and link to each other; rows with a null id are compared like others, and
classes that connect to no id are named by a hash; texts under one id that differ are
compared each, and with extra columns their rows get the smallest class and most links;
extra columns are carried along (those named like a result are replaced); an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raremetrics.llm import common, grams
from raremetrics.llm.components import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
TOLERANCE = 1e-6
STEP = 16
#: Classes compared at a time: a unit of work is two blocks.
BLOCK = 256

_DRAW = np.random.Generator(np.random.PCG64(96))
_A = _DRAW.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _DRAW.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct word n-grams, sorted."""
    start, end, first = grams.words(buf, off)
    word = grams.Hashed(buf).of(start, end)
    _, own, h = grams.windows(word, first, WORDS)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < WORDS))
    if len(short):
        whole = [grams.mix(np.array([sum(int(x) * (2 * j + 3) for j, x in enumerate(word[first[i]:first[i + 1]])) % (1 << 64)], np.uint64))[0] for i in short]
        own, h = np.concatenate([own, short]), np.concatenate([h, np.array(whole, np.uint64)])
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
    return own[new], h[new]


def set_keys(own: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for each text's set."""
    out = []
    for salt in (0x5BD1E995, 0x1B873593):
        total = np.zeros(n, np.uint64)
        np.add.at(total, own, grams.mix(h ^ np.uint64(salt)))
        out.append(total.view(np.int64))
    return out[0], out[1]


def signatures(own: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """MinHash values of each text (n x HASHES); those of a text without n-grams mean nothing."""
    out = np.zeros((n, HASHES), np.uint32)
    if len(own):
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        for j in range(HASHES):
            out[own[at], j] = np.minimum.reduceat((grams_hash(h, j)), at)
    return out


def grams_hash(h: np.ndarray, j: int) -> np.ndarray:
    return ((h * _A[j] + _B[j]) >> np.uint64(32)).astype(np.uint32)


@functools.cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """Fewest agreements among the first n hash values with which a pair stays.

    With a uniform prior the similarity's posterior is Beta(m + 1, n - m + 1), whose mass
    from t on is the probability of at most m successes in n + 1 trials at t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, 0
        while m <= n:
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def surviving(sig: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that incremental comparison of the signatures does not drop."""
    match = np.zeros(len(left), np.int16)
    for n, need in least_matches().items():
        part = sig[:, n - STEP:n]
        match = match + (part[left] == part[right]).sum(axis=1, dtype=np.int16)
        stay = match >= need
        left, right, match = left[stay], right[stay], match[stay]
        if not len(left):
            break
    return left, right


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of each one's connected set among n."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_pairs(sized: DataFrame, key: str) -> DataFrame:
    """Each row once for every unit of work of its group (``key`` with ``size`` rows): lo and hi block."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = sized.withColumn("block", F.pmod(F.xxhash64("node", key), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select("*", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).drop("other", "size")


def units(batches, key: str):
    """(lo, hi, rows as a table) of each unit of work, from batches sorted by (key, lo, hi, node)."""
    held: list[pa.RecordBatch] = []
    last = None

    def table(parts):
        return pa.Table.from_batches(parts)

    for batch in batches:
        if not batch.num_rows:
            continue
        code = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (key, "lo", "hi")])
        cuts = np.flatnonzero((code[:, 1:] != code[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            now = tuple(code[:, a].tolist())
            if held and now != last:
                yield last[1], last[2], table(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield last[1], last[2], table(held)


def pairs_of(block: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    if lo == hi:
        return np.triu_indices(len(block), 1)
    a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _ref() -> Column:
    """The id, or the text's hash where there is none; its texts are told apart by their keys."""
    return F.coalesce("doc_id", F.xxhash64("text")).alias("ref")


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, ref, n_shingles, key1, key2, signature) of every text; ``ref`` finds the text again."""

    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in common.text_chunks(batch):
                own, h = shingles(buf, off)
                n = hi - lo
                key1, key2 = set_keys(own, h, n)
                sig = signatures(own, h, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), batch.column(2).slice(lo, n), pa.array(np.bincount(own, minlength=n)), pa.array(key1), pa.array(key2),
                     pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "ref", "n_shingles", "key1", "key2", "signature"])

    return docs.select("doc_id", "text", _ref()).transform(common.in_tasks, run, "doc_id long, ref long, n_shingles long, key1 long, key2 long, signature binary")


def candidate_edges(classes: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the classes whose pairs survive the pruning."""

    def banded(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2])
            for j in range(ROWS):
                h = grams.mix(h * np.uint64(0x9E3779B97F4A7C15 | 1) + sig[:, :, j])
            flat = pa.array(np.ascontiguousarray(h).view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), flat], names=["node", "bucket"])

    buckets = classes.select("node", "signature").transform(common.in_tasks, banded, "node long, bucket long")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    # read from a written table, the small side lets the adaptive join split a hot bucket
    members = common.materialise(buckets.join(common.materialise(shared, "jaccard-shared"), "bucket"), "jaccard-buckets")
    rows = block_pairs(members, "bucket").join(classes.select("node", "signature"), "node")
    rows = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "node")

    def compare(batches):
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi, unit in units(batches, "bucket"):
            node = unit["node"].to_numpy()
            sig = np.frombuffer(b"".join(unit["signature"].to_pylist()), np.uint32).reshape(-1, HASHES)
            root = roots(len(node), *surviving(sig, *pairs_of(unit["block"].to_numpy(), lo, hi)))
            moved = np.flatnonzero(root != np.arange(len(node)))
            if len(moved):
                out.append((node[moved], node[root[moved]]))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["u", "v"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["u", "v"])

    return rows.select("bucket", "lo", "hi", "block", "node", "signature").transform(common.in_tasks, compare, "u long, v long").distinct()


def linked(sets: list[np.ndarray], left_right: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose exact Jaccard similarity reaches the threshold; intersections by blocks of shared values."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    own = np.repeat(np.arange(n), size.astype(np.int64))
    _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    use = count[which] > 1
    own, which = own[use], place[which[use]]
    order = np.argsort(which, kind="stable")
    own, which = own[order], which[order]
    both = np.zeros((n, n), np.float64)
    width = 4096
    for lo in range(0, int(which[-1]) + 1 if len(which) else 0, width):
        a, b = np.searchsorted(which, [lo, lo + width])
        part = np.zeros((n, width), np.float32)
        part[own[a:b], which[a:b] - lo] = 1
        both += part @ part.T
    left, right = left_right
    union = size[left] + size[right] - both[left, right]
    ok = both[left, right] >= threshold * union - 1e-9
    return left[ok], right[ok]


def verified(docs: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(node, root, links): exact links of each class within its group, and a linked class in the same unit of work."""
    sizes = groups.groupBy("label").agg(F.count("*").alias("size"))
    # never broadcast: the number of near copies grows with the corpus
    wanted = groups.join(sizes, "label").hint("merge")
    texts = docs.select("text", _ref()).join(wanted, "ref").select("label", "node", "copies", "size", "key1", "key2", "text")

    def exact(batches):
        names = ["label", "node", "copies", "size", "shingles"]
        for batch in batches:
            for lo, hi, buf, off in common.text_chunks(batch):
                own, h = shingles(buf, off)
                keys = set_keys(own, h, hi - lo)
                same = np.flatnonzero((keys[0] == batch.column(4).to_numpy()[lo:hi]) & (keys[1] == batch.column(5).to_numpy()[lo:hi]))
                at = np.searchsorted(own, np.arange(hi - lo + 1))
                cols = [batch.column(i).slice(lo, hi - lo).take(pa.array(same)) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([h[at[i]:at[i + 1]].tobytes() for i in same], pa.binary())], names=names)

    sets = texts.transform(common.in_tasks, exact, "label long, node long, copies long, size long, shingles binary")
    rows = block_pairs(sets, "label").repartition("label", "lo", "hi").sortWithinPartitions("label", "lo", "hi", "node")

    def verify(batches):
        for lo, hi, unit in units(batches, "label"):
            node = unit["node"].to_numpy()
            first = np.concatenate([[True], node[1:] != node[:-1]])  # a repeated row counts once
            unit, node = unit.filter(pa.array(first)), node[first]
            sets = [np.frombuffer(s, np.uint64) for s in unit["shingles"].to_pylist()]
            left, right = linked(sets, pairs_of(unit["block"].to_numpy(), lo, hi), threshold)
            copies = unit["copies"].to_numpy()
            links = np.bincount(left, copies[right], minlength=len(node)) + np.bincount(right, copies[left], minlength=len(node))
            root = node[roots(len(node), left, right)]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(links.astype(np.int64))], names=["node", "root", "links"])

    return rows.select("label", "lo", "hi", "block", "node", "copies", "shingles").transform(common.in_tasks, verify, "node long, root long, links long")


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the text, with ``class_id`` (smallest id among the documents that links connect) and ``n_links``."""
    carried = [c for c in docs.columns if c not in ("text", "class_id", "n_links")]
    rows = common.materialise(described(docs), "jaccard-texts")
    classes = (rows.filter("n_shingles > 0").groupBy("key1", "key2")
               .agg(F.min("doc_id").alias("doc"), F.coalesce(F.min("doc_id"), F.min("ref")).alias("ref"), F.count("*").alias("copies"), F.first("signature").alias("signature"))
               .withColumn("node", F.xxhash64("key1", "key2")))
    classes = common.materialise(classes, "jaccard-classes")
    groups = components(candidate_edges(classes))
    groups = groups.join(classes.select("node", "ref", "copies", "key1", "key2"), "node")
    found = common.materialise(verified(docs, common.materialise(groups, "jaccard-groups"), threshold), "jaccard-links")
    label = common.materialise(components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
                               .join(classes.select("node", "doc"), "node"), "jaccard-labels")
    # written, so that the adaptive join can split a label that very many classes share
    least = common.materialise(label.groupBy("label").agg(F.coalesce(F.min("doc"), F.col("label")).alias("least")), "jaccard-least")
    label = label.select("node", "label").join(least.hint("merge"), "label").select("node", F.col("least").alias("label"))
    links = found.groupBy("node").agg(F.sum("links").alias("links")).join(label, "node", "left")
    of_class = classes.select("key1", "key2", "node", "doc", "copies").join(links, "node", "left").select(
        "key1", "key2", F.coalesce("label", "doc", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    of_class = common.materialise(of_class, "jaccard-result")
    # ids and keys alone meet their class; a key that very many rows share is split by the adaptive join
    of_row = rows.select("doc_id", "key1", "key2", "n_shingles").join(of_class, ["key1", "key2"], "left").select(
        "doc_id", F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("n_shingles") > 0, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"))
    if carried == ["doc_id"]:
        return of_row
    of_row = of_row.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    of_row = of_row.withColumnRenamed("doc_id", "_doc_id")
    return docs.select(*carried).join(of_row, docs.doc_id.eqNullSafe(F.col("_doc_id"))).drop("_doc_id")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(common.documents(spark, sf_dir).select("doc_id", "text"))
