"""SimHash near-duplicate groups by deletion-variant signatures.

A text's fingerprint has 64 bits: bit j is set if more than half of the 64-bit hashes of
its word shingles (repeats included) have it set.  Two fingerprints link if at most
``distance`` bits differ.  Cut into ``distance // 2 + 1`` segments, two linked fingerprints
have a segment in which at most one bit differs.  So each segment is indexed with one of
its bits left out, for every one of its bits in turn: two linked fingerprints share one of
these 64 one-wildcard variants.  An equality join of the variants finds the candidates, and
every one of them is verified by its exact distance.

Only distinct fingerprints are indexed, so copies cost nothing.  A variant's group is
searched from member to member, each time over those not yet reached: a dense group (near
copies) is reached in a few steps, a scattered one costs its pairs.  Groups beyond
``SPLIT`` fingerprints are parted once more by the variants of the bits outside the
segment, in which linked ones again have a segment with at most one differing bit; what is
still larger than ``BLOCK`` is searched in pairs of blocks, so no task holds more than two
blocks of a group, and nothing is capped.

Defined cases: a text of fewer than ``WORDS`` words has one shingle, all its words; a text
without words (null, empty or white space alone) has the fingerprint zero, linked like any
other; repeated rows and equal texts have one fingerprint; a row without an id has its
group's smallest id (null if the group has none); extra columns are carried along (those
named like a result are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raremetrics.llm import common, grams
from raremetrics.llm.components import components

WORDS = 4
DISTANCE = 4
SEED = 42
#: Fingerprints of one block of a group; a unit of work is one block or two.
BLOCK = 4096
#: A group larger than this is parted by further variants first.
SPLIT = 1 << 15
#: Groups of up to so many are compared row against row, all of a batch at once.
FEW = 8


def shingle_hashes(buf: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every word shingle of the texts, and n+1 positions of the texts in them."""
    low = grams.LOWER[buf]
    start, end, first = grams.words(low, off)
    size = end - start
    # the words, one space after each: a shingle is one stretch of this
    at = np.concatenate([[0], np.cumsum(size + 1)])
    line = np.full(at[-1], 0x20, np.uint8)
    line[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = low[np.arange(size.sum()) + np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)] if len(size) else 0
    count = np.diff(first)
    n = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    begins = np.concatenate([[0], np.cumsum(n)])
    word = np.arange(begins[-1]) - np.repeat(begins[:-1] - first[:-1], n)
    last = np.minimum(word + words, np.repeat(first[1:], n))
    raw, digest = line.tobytes(), xxhash.xxh64_intdigest
    out = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(at[word].tolist(), (at[last] - 1).tolist(), strict=True)), np.uint64, begins[-1])
    return out, begins


def majority(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Bits that more than half of each text's hashes have set; zero without hashes."""
    n = np.diff(begins)
    out = np.zeros(len(n), np.uint64)
    has = np.flatnonzero(n)
    for j in range(64) if len(has) else ():
        bit = ((h >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
        total = np.add.reduceat(bit, begins[has])
        out[has] |= (2 * total > n[has]).astype(np.uint64) << np.uint64(j)
    return out


def fingerprints(docs: DataFrame, words: int = WORDS, name: str = "fingerprint") -> DataFrame:
    """``docs`` without ``text``, with the fingerprint as a long under ``name``."""
    carried = [c for c in docs.columns if c not in ("text", name)]
    schema = docs.select(*carried).schema.add(name, "long")

    def run(batches):
        for batch in batches:
            for lo, hi, buf, off in common.text_chunks(batch):
                value = majority(*shingle_hashes(buf, off, words)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(carried))), pa.array(value)], names=schema.names)

    return docs.select(*carried, "text").transform(common.in_tasks, run, schema)


def segments(bits: list[int], distance: int) -> list[list[int]]:
    """The bits in as many runs of about equal length as leave one with at most one of ``distance`` differences."""
    return [x.tolist() for x in np.array_split(np.array(bits), distance // 2 + 1)]


def _mask(bits: list[int]) -> int:
    """A signed 64-bit mask of the bits."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def variant_keys(distance: int) -> Column:
    """Keys of a fingerprint's one-wildcard variants: a hash of the bit left out and the segment without it."""
    return F.array(*[F.xxhash64(F.lit(j), F.col("node").bitwiseAND(F.lit(_mask([b for b in part if b != j]))))
                     for part in segments(list(range(64)), distance) for j in part])


def further_keys(distance: int) -> Column:
    """For ``wild`` (the bit left out at first): keys of the variants of the bits outside its segment, under ``key``."""
    value = F.lit(None)
    for part in segments(list(range(64)), distance):
        rest = segments([b for b in range(64) if b not in part], distance)
        keys = F.array(*[F.xxhash64("key", F.lit(j), F.col("node").bitwiseAND(F.lit(_mask([b for b in own if b != j])))) for own in rest for j in own])
        value = F.when(F.col("wild").between(part[0], part[-1]), keys).otherwise(value)
    return value


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def reached(value: np.ndarray, block: np.ndarray, lo: int, hi: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, neighbour) that connect all members of the unit that links connect.

    With two blocks only links between them count.  Each member is compared once with those
    not reached yet on the other side.
    """
    sides = [np.arange(len(value))] if lo == hi else [np.flatnonzero(block == lo), np.flatnonzero(block == hi)]
    side = np.zeros(len(value), np.int64) if lo == hi else (block == hi).astype(np.int64)
    open_ = [s.copy() for s in sides]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while len(open_[0]):
        front, open_[0] = [int(open_[0][0])], open_[0][1:]
        while front:
            at = front.pop()
            k = 0 if lo == hi else 1 - int(side[at])
            if not len(open_[k]):
                continue
            near = differing(value[open_[k]], value[at]) <= distance
            found = open_[k][near]
            if len(found):
                out.append((found, np.full(len(found), at)))
                front.extend(found.tolist())
                open_[k] = open_[k][~near]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _starts(code: np.ndarray) -> np.ndarray:
    """First rows of the runs of equal columns, and the end."""
    new = (code[:, 1:] != code[:, :-1]).any(axis=0)
    return np.concatenate([[0], np.flatnonzero(new) + 1, [code.shape[1]]])


def links(members: DataFrame, distance: int) -> DataFrame:
    """Edges (u, v) of the groups of ``members`` (key, lo, hi, node, block), one unit of work for each (key, lo, hi)."""
    rows = members.select("key", "lo", "hi", "node", "block").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")

    def solve(code: np.ndarray, edge: np.ndarray):
        """Edges of the whole units between the given first rows."""
        size = np.diff(edge)
        stay = size > 1  # most variants belong to one fingerprint
        code, size = code[:, np.repeat(stay, size)], size[stay]
        edge = np.concatenate([[0], np.cumsum(size)])
        node, block = code[3], code[4]
        value = node.view(np.uint64)
        few = np.repeat(size <= FEW, size)
        unit = np.repeat(np.arange(len(size)), size)
        own = np.repeat(code[1, edge[:-1]] == code[2, edge[:-1]], size)
        out = []
        for d in range(1, FEW):
            if d >= len(node):
                break
            at = np.flatnonzero(few[d:] & (unit[d:] == unit[:-d]) & (own[d:] | (block[d:] != block[:-d])))
            at = at[differing(value[at], value[at + d]) <= distance]
            out.append((node[at + d], node[at]))
        for i in np.flatnonzero(size > FEW).tolist():
            a, b = edge[i], edge[i + 1]
            left, right = reached(value[a:b], block[a:b], int(code[1, a]), int(code[2, a]), distance)
            out.append((node[a + left], node[a + right]))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["u", "v"])

    def run(batches):
        held = np.zeros((5, 0), np.int64)
        for batch in batches:
            code = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])], axis=1)
            if not code.shape[1]:
                continue
            edge = _starts(code[:3])
            done, held = edge[:-1], code[:, edge[-2]:]  # the last unit may go on
            if len(done) > 1 and (found := solve(code[:, :done[-1]], done)):
                yield found
        if held.shape[1] and (found := solve(held, np.array([0, held.shape[1]]))):
            yield found

    return rows.transform(common.in_tasks, run, "u long, v long")


def in_blocks(members: DataFrame) -> DataFrame:
    """Members (key, size, node) once for every unit of work of their group: pairs of blocks by hash."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = members.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "block")


def whole(members: DataFrame) -> DataFrame:
    """Members (key, node) of groups that are one unit of work."""
    return members.select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "node", F.lit(0).alias("block"))


def group_edges(members: DataFrame, distance: int, further=None) -> DataFrame:
    """Edges (u, v) of all groups of ``members`` (key, node and what ``further`` reads)."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK)
    sizes = common.materialise(sizes, "simhash-large")  # few: each has a block's rows at least
    if sizes.isEmpty():
        return links(whole(members), distance)
    edges = links(whole(members.join(sizes, "key", "left_anti")), distance)
    # the small written side lets the adaptive join split a variant that very many fingerprints share
    large = common.materialise(members.join(sizes, "key"), "simhash-members")
    part = F.col("size") > SPLIT if further is not None else F.lit(False)
    edges = edges.unionByName(links(in_blocks(large.filter(~part)), distance))
    if further is not None and not large.filter(part).isEmpty():
        parts = large.filter(part).select("node", F.explode(further).alias("key"))
        edges = edges.unionByName(group_edges(parts, distance))
    return edges


def fingerprint_edges(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints ``node`` that connect all that links connect."""
    variants = distinct.select("node", F.posexplode(variant_keys(distance)).alias("wild", "key"))
    return group_edges(variants, distance, further_keys(distance)).distinct()


def simhash_components(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``docs`` without ``text``, with ``fingerprint`` (hex) and ``component_id``, the smallest id that links reach."""
    names = ("fingerprint", "component_id")
    carried = [c for c in docs.columns if c not in ("text", *names)]
    fp, node, own = common.fresh([*carried, *names], "bits", "node", "own")
    rows = common.materialise(fingerprints(docs.select(*carried, "text"), words, fp), "simhash-rows")
    distinct = common.materialise(rows.groupBy(F.col(fp).alias("node")).agg(F.min("doc_id").alias("least")), "simhash-distinct")
    label = components(fingerprint_edges(distinct.select("node"), distance))
    of = common.materialise(distinct.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "simhash-labels")
    # written, so that the adaptive joins can split a group or a fingerprint that very many rows share
    least = common.materialise(of.groupBy("label").agg(F.min("least").alias("component")), "simhash-least")
    of = common.materialise(of.select("node", "label").join(least, "label").select(F.col("node").alias(node), F.col("component").alias(own)), "simhash-components")
    found = rows.join(of, F.col(fp) == F.col(node))
    return found.select(*carried, F.lower(F.lpad(F.hex(fp), 16, "0")).alias("fingerprint"), F.col(own).alias("component_id"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(common.documents(spark, sf_dir).select("doc_id", "text"))
