"""Best-fit packing of token pieces into sequences, improved by swaps.

Only a piece's length matters for where it fits, and there are at most ``capacity``
lengths.  So the bins are planned on the histogram of lengths: *patterns* (how many
pieces of which length share a bin) with a multiplicity.  The histogram, and with it the
number of patterns, is bounded by the capacity whatever the input, and is all that the
driver sees.  Best fit in order of falling length makes the first patterns; the local
search then moves pieces, exchanges one for one or two for one between underfull
bins, each step raising the sum of squared fills, and bins that become empty go.  It
ends when no step is left, or where the number of bins is one that no packing can go below.

Pieces are matched to the planned places by their rank among the pieces of their length.
Ranks are counted in buckets by the id's hash, whose number grows with the input, and
bucket offsets come from a small aggregate; so a length that a third of all pieces share
is spread like any other.

Defined cases: an empty text is the closing id alone; a null text counts as empty; equal
or repeated documents each get places of their own; an empty table gives an empty
result; extra columns are carried along (those named like a result are replaced).
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raremetrics.llm import bpe, common

CAPACITY = 2048
CLOSING_ID = 0
#: Pieces ranked by one window group, about.
BUCKET_ROWS = 100_000

Pattern = tuple[tuple[int, int], ...]  # (length, how many), lengths falling


def fill(p: Pattern) -> int:
    return sum(n * k for n, k in p)


def _changed(p: Pattern, less: tuple[int, ...] = (), more: tuple[int, ...] = ()) -> Pattern:
    counts = dict(p)
    for n in less:
        counts[n] -= 1
    for n in more:
        counts[n] = counts.get(n, 0) + 1
    return tuple(sorted(((n, k) for n, k in counts.items() if k), reverse=True))


def best_fit(histogram: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Patterns with multiplicities: every length, falling, goes to the fullest bins that take it."""
    bins: list[dict[Pattern, int]] = [{} for _ in range(capacity + 1)]  # by room left
    for length in sorted(histogram, reverse=True):
        left, room = histogram[length], length
        while left:
            while room < capacity and not bins[room]:
                room += 1
            if bins[room] and room <= capacity:
                pattern, count = bins[room].popitem()
            else:
                pattern, count, room = (), left, capacity
            each = min(room // length, -(-left // count))
            full = min(count, left // each)
            if full < count and pattern:
                bins[room][pattern] = bins[room].get(pattern, 0) + count - full
            new = _changed(pattern, more=(length,) * each)
            if full:
                bins[room - each * length][new] = bins[room - each * length].get(new, 0) + full
                left -= full * each
            else:
                # fewer pieces than one bin of the pattern would take
                rest = _changed(pattern, more=(length,) * left)
                if pattern:
                    bins[room][pattern] -= 1
                    if not bins[room][pattern]:
                        del bins[room][pattern]
                bins[room - left * length][rest] = bins[room - left * length].get(rest, 0) + 1
                left = 0
            room = length
    return {p: k for at in bins for p, k in at.items()}


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs.

    For every k, pieces over ``capacity - k`` have a bin without any piece of k or more to
    themselves, others over half the capacity a bin each, and what the latter cannot take
    of the pieces from k to half the capacity needs bins by its size.
    """
    many = np.zeros(capacity + 2, np.int64)
    for length, n in histogram.items():
        many[length] += n
    number = np.concatenate([[0], np.cumsum(many[1:])])  # pieces up to a length
    size = np.concatenate([[0], np.cumsum(many[1:] * np.arange(1, capacity + 2))])
    total, half = int(size[-1]), capacity // 2
    best = -(-total // capacity)
    for k in range(1, half + 1):
        alone = int(number[-1] - number[capacity - k])
        middle = int(number[capacity - k] - number[half])
        room = middle * capacity - int(size[capacity - k] - size[half])
        rest = int(size[half] - size[k - 1])
        best = max(best, alone + middle + max(0, -(-(rest - room) // capacity)))
    return best


class _Open:
    """The underfull patterns, with tables that tell at once what each can give or take."""

    def __init__(self, capacity: int):
        self.capacity, self.count = capacity, {}
        self.slot: dict[Pattern, int] = {}
        self.free: list[int] = []
        self.pattern: list[Pattern | None] = []
        self.fill = np.zeros(0, np.int32)
        # of lengths a pattern can part with, alone or (second table) alone, in pairs or not at all (0):
        # the smallest that is not below a value, and the largest that is not above it
        self.least = [np.zeros((0, capacity + 2), np.int16) for _ in range(2)]
        self.most = [np.zeros((0, capacity + 2), np.int16) for _ in range(2)]

    def add(self, p: Pattern, k: int) -> bool:
        """Whether the pattern was not there, or has now a second bin to exchange with."""
        if p in self.count:
            self.count[p] += k
            return self.count[p] == k + 1
        if not self.free:
            old, new = len(self.pattern), max(64, 2 * len(self.pattern))
            self.pattern += [None] * (new - old)
            self.fill = np.concatenate([self.fill, np.full(new - old, -1, np.int32)])
            for tables in (self.least, self.most):
                for i in range(2):
                    tables[i] = np.concatenate([tables[i], np.zeros((new - old, self.capacity + 2), np.int16)])
            self.free = list(range(old, new))[::-1]
        i = self.free.pop()
        self.pattern[i], self.slot[p], self.count[p], self.fill[i] = p, i, k, fill(p)
        alone = [n for n, _ in p]
        paired = sorted({0, *alone, *(a + b for a, b in _pairs(p))})
        place = np.arange(self.capacity + 2)
        for j, values in enumerate((np.array(alone[::-1]), np.array(paired))):
            at = np.searchsorted(values, place)  # a place beyond all holds a value that no gain reaches
            self.least[j][i] = np.append(values, self.capacity + 1)[at]
            at = np.searchsorted(values, place, "right") - 1
            self.most[j][i] = np.where(at >= 0, values[at], -1)
        return True

    def take(self, p: Pattern, k: int) -> None:
        self.count[p] -= k
        if not self.count[p]:
            i = self.slot.pop(p)
            del self.count[p]
            self.pattern[i], self.fill[i] = None, -1
            self.free.append(i)

    def partner(self, p: Pattern, gives: bool) -> Pattern | None:
        """The fullest pattern that can gain from ``p``, or (``gives`` false) the emptiest that can let it gain."""
        own = fill(p)
        fits = (self.fill >= own) if gives else (self.fill >= 0) & (self.fill <= own)
        if self.count[p] < 2:
            fits[self.slot[p]] = False
        at = np.flatnonzero(fits)
        if not len(at):
            return None
        at = at[np.argsort(-self.fill[at] if gives else self.fill[at], kind="stable")]
        singles, pairs = np.array([n for n, _ in p]), np.array(sorted({a + b for a, b in _pairs(p)}), np.int64)
        for lo in range(0, len(at), 256):
            part = at[lo:lo + 256]
            good = np.zeros(len(part), bool)
            if gives:
                room = self.capacity - self.fill[part]
                for values, table in ((singles, self.least[1]), (pairs, self.least[0])):
                    # given v, the smallest thing taken back that leaves a gain within the room
                    back = table[part[:, None], np.maximum(values[None, :] - room[:, None], 0)]
                    good |= (back < values[None, :]).any(axis=1)
            else:
                room = self.capacity - own
                for values, table in ((np.append(0, singles), self.most[1]), (pairs, self.most[0])):
                    # for w given back, the largest thing had that is a gain within the room
                    had = table[part[:, None], np.minimum(values + room, self.capacity + 1)[None, :]]
                    good |= (had > values[None, :]).any(axis=1)
            found = np.flatnonzero(good)
            for i in part[found].tolist():
                q = self.pattern[i]
                if _transfer(*((p, q) if gives else (q, p)), self.capacity):
                    return q
        return None


def _pairs(p: Pattern) -> list[tuple[int, int]]:
    return [(a, b) for i, (a, k) in enumerate(p) for b in ([a] if k > 1 else []) + [n for n, _ in p[i + 1:]]]


def _transfer(donor: Pattern, taker: Pattern, capacity: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """What donor gives and gets so that the taker gains most within its room: a move or an exchange."""
    room, level = capacity - fill(taker), fill(donor) - fill(taker)
    has = [n for n, _ in taker]
    two = sorted({a + b: (a, b) for a, b in _pairs(taker)}.items())
    gives = [((n,), n) for n, _ in donor]
    gives += [(pair, sum(pair)) for pair in _pairs(donor)]
    best = None
    for give, total in gives:
        gets = [((), 0), *(((n,), n) for n in has)] + ([(pair, n) for n, pair in two] if len(give) == 1 else [])
        for get, back in gets:
            if len(give) == 2 and not get:
                continue
            gain = total - back
            # squared fill rises if the gain exceeds the difference of the fills
            if 0 < gain <= room and gain > level and (best is None or gain > best[0]):
                best = (gain, give, get)
    return best and best[1:]


def improve(bins: dict[Pattern, int], capacity: int, bound: int = 0) -> dict[Pattern, int]:
    """Local search between underfull bins, until there are ``bound`` bins or no move or exchange raises the squared fill.

    Every pattern that appears is compared once with all open ones, as the donor of fuller
    ones and as the taker from emptier ones; the tables of :class:`_Open` find a partner
    without trying those that have no room.  Each transfer raises the sum of squares, so the search ends.
    """
    done = {p: k for p, k in bins.items() if fill(p) == capacity}
    open_, total = _Open(capacity), sum(bins.values())
    fresh: list[tuple[int, Pattern]] = []

    def put(p: Pattern, k: int) -> None:
        if not p:
            return
        if fill(p) == capacity:
            done[p] = done.get(p, 0) + k
        elif open_.add(p, k):
            heapq.heappush(fresh, (fill(p), p))

    for p, k in bins.items():
        if fill(p) != capacity:
            put(p, k)
    while fresh and total > bound:  # the emptiest first
        p = heapq.heappop(fresh)[1]
        while p in open_.count and total > bound:
            donor, taker = p, open_.partner(p, gives=True)
            if taker is None:
                donor, taker = open_.partner(p, gives=False), p
            if donor is None:
                break
            give, get = _transfer(donor, taker, capacity)
            times = open_.count[donor] // 2 if donor == taker else min(open_.count[donor], open_.count[taker])
            again = open_.count[p] > times * (1 + (donor == taker))
            for q in (donor, taker):
                open_.take(q, times)
            left = _changed(donor, less=give, more=get)
            total -= 0 if left else times
            put(left, times)
            put(_changed(taker, less=get, more=give), times)
            if not again:
                break
    return {**done, **open_.count}


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Places by length and rank: rows (length, first rank, pieces a bin, first sequence, first offset), sorted."""
    bins = improve(best_fit(histogram, capacity), capacity, lower_bound(histogram, capacity))
    rows, upto, sequence = [], {}, 0
    for pattern, count in sorted(bins.items(), reverse=True):
        offset = 0
        for length, each in pattern:
            rows.append((length, upto.get(length, 0), each, sequence, offset))
            upto[length] = upto.get(length, 0) + count * each
            offset += length * each
        sequence += count
    rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), rows.T, strict=True)) | {"sequences": sequence}


def pack(pieces: DataFrame, key: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a materialised table with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    pieces = pieces.drop("sequence_id", "offset")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError("piece lengths must lie between 1 and the capacity")
    places = plan(histogram, capacity)
    buckets = 1 + sum(histogram.values()) // BUCKET_ROWS
    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
             .select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")))
    ranked = (bucketed.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*key)) - 1)
              .join(sizes, ["length", "_bucket"]).withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long")))
    carried = pieces.columns
    schema = pieces.select("*").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches):
        code = places["length"] << 40 | places["rank"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(code, length.astype(np.int64) << 40 | rank, "right") - 1
            n = rank - places["rank"][at]
            sequence = places["sequence"][at] + n // places["each"][at]
            offset = places["offset"][at] + n % places["each"][at] * length
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in carried]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence), pa.array(offset)], names=[*carried, "sequence_id", "offset"])

    return ranked.select(*carried, "_rank").transform(common.in_tasks, run, schema)


PIECE = (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"))


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The documents' ids, closed by ``CLOSING_ID`` and cut into pieces of at most ``capacity``."""
    path = path or bpe.default_path()
    names = [n for n, _ in PIECE]
    carried = [c for c in docs.columns if c not in ("text", *names)]
    schema = docs.select(*carried).schema
    for name, kind in PIECE:
        schema = schema.add(name, kind)

    def run(batches):
        e = bpe.encoder(path)
        for batch in batches:
            for lo, hi, buf, off in common.text_chunks(batch):
                ids, first = e.texts(buf, off)
                rows, out = [], []
                for i in range(hi - lo):
                    own = np.append(ids[first[i]:first[i + 1]], CLOSING_ID).astype("<u4")
                    for k, start in enumerate(range(0, len(own), capacity)):
                        part = own[start:start + capacity]
                        rows.append(lo + i)
                        out.append((k, start, len(part), zlib.crc32(part.tobytes())))
                arrays = [batch.column(batch.schema.get_field_index(c)).take(pa.array(rows, pa.int64())) for c in carried]
                arrays += [pa.array([r[j] for r in out], pa.int32() if not j else pa.int64()) for j in range(4)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *names])

    return docs.select(*carried, "text").transform(common.in_tasks, run, schema)


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    pieces = common.materialise(token_pieces(docs, capacity, path), "packing-pieces")
    return pack(pieces, ["doc_id", "piece"], capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.documents(spark, sf_dir).select("doc_id", "text"))
