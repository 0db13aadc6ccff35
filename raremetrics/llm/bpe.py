"""Byte-pair encoding as a bounded-lookahead transducer, and incremental decoding.

The merge list fixes how far to the left of a cut the tokens can still depend on what
follows (:func:`lookahead`).  :class:`Transducer` takes a word symbol by symbol, and
emits a token as soon as it lies that far behind the end of what was read; it holds a
bounded number of symbols whatever the word's length.  :class:`Decoder` turns ids back
into text block by block, holding at most the bytes of one unfinished character.

:class:`Encoder` applies the transducer to whole texts: normalisation, the split into
words and the lookup of words already seen (in a table of bounded size) are vectorised
over a chunk of texts.

Defined cases: a null or empty text has no ids; the strings of special tokens in a text
become their ids, as in the tokenizers library; equal texts get equal ids; extra columns
are carried along (those named like a result are replaced); an empty table gives an
empty result.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from raremetrics.llm import common, grams

#: Distinct words whose ids are kept at a time; the table starts anew when it is full.
KNOWN_WORDS = 400_000
SPECIAL, BREAK = 4, 5
#: Symbols of the longest words that are merged side by side.
SIDE_BY_SIDE = 64
_NONE = 1 << 62
_BREAK = "\udfff"  # between texts: a code point that no text has


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def lookahead(merges: list[tuple[int, int, int]], length: list[int]) -> int:
    """Symbols behind a cut beyond which no token depends on what follows the cut.

    ``reach[t]`` is the longest stretch before the cut that may differ, if that stretch
    begins with token t.  Going through the merges in order, (a, b) extends a stretch
    that begins with b by one a, whether or not the merge takes place.
    """
    reach = [0] * len(length)
    for a, b, ab in merges:
        longer = reach[b] + length[a]
        reach[ab] = max(reach[ab], reach[a], longer)
        reach[a] = max(reach[a], longer)
    return max(reach) + max(length)


class Transducer:
    """Ids of one word after another; ``feed`` symbols, ``close`` at the word's end."""

    def __init__(self, merges: list[tuple[int, int, int]], length: list[int], ends: list[int]):
        # both as one integer: the pair, and the merge's rank with the token it makes
        self.rank = {a << 16 | b: n << 16 | ab for n, (a, b, ab) in enumerate(merges)}
        self.length, self.ends = length, ends
        self.lookahead = lookahead(merges, length)
        self.hold: list[int] = []

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the pairs in order of rank, then of place, until none is left."""
        ids, none, rank = list(ids), _NONE, self.rank.get
        if len(ids) < 100:
            found = [rank(a << 16 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
            while found and (least := min(found)) < none:
                at = found.index(least)
                ids[at] = least & 0xFFFF
                del ids[at + 1], found[at]
                if at:
                    found[at - 1] = rank(ids[at - 1] << 16 | ids[at], none)
                if at < len(found):
                    found[at] = rank(ids[at] << 16 | ids[at + 1], none)
            return ids
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        todo = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := rank(ids[i] << 16 | ids[i + 1])) is not None]
        heapq.heapify(todo)
        while todo:
            least, i, a, b = heapq.heappop(todo)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = least & 0xFFFF, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank(ids[x] << 16 | ids[y])) is not None:
                    heapq.heappush(todo, (r, x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]

    @functools.cached_property
    def _ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs in rising order and what :attr:`rank` holds for each, closed by a pair that no ids make."""
        pairs = sorted(self.rank)
        return np.array([*pairs, _NONE], np.int64), np.array([*map(self.rank.get, pairs), _NONE], np.int64)

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs, ranks = self._ranks
        pair = left << 16 | right
        at = np.searchsorted(pairs, pair)
        return np.where(pairs[at] == pair, ranks[at], _NONE)

    def merge_many(self, ids: np.ndarray) -> list[bytes]:
        """:meth:`merge` of each row of ``ids``, words of equally many symbols, one merge of every word at a time; 32 bits an id."""
        out: list = [None] * len(ids)
        own, ids = np.arange(len(ids)), ids.astype(np.int64)
        found = self._rank_of(ids[:, :-1], ids[:, 1:])
        while len(own):
            width = ids.shape[1]
            at = found.argmin(axis=1) if width > 1 else np.zeros(len(own), np.int64)  # the leftmost of equal ranks
            least = found[np.arange(len(own)), at] if width > 1 else np.full(len(own), _NONE)
            more = least < _NONE
            done = ids[~more].astype(np.uint32).tobytes()
            for k, i in enumerate(own[~more].tolist()):
                out[i] = done[4 * width * k:4 * width * (k + 1)]
            own, ids, found, at, least = own[more], ids[more], found[more], at[more], least[more]
            if not len(own):
                break
            rows = np.arange(len(own))
            ids[rows, at] = least & 0xFFFF
            keep = np.ones(ids.shape, bool)
            keep[rows, at + 1] = False
            ids = ids[keep].reshape(len(own), width - 1)
            keep = np.ones(found.shape, bool)
            keep[rows, at] = False
            found = found[keep].reshape(len(own), width - 2)
            for has, a in ((at > 0, at - 1), (at < width - 2, at)):
                r, a = rows[has], a[has]
                found[r, a] = self._rank_of(ids[r, a], ids[r, a + 1])
        return out

    def feed(self, symbols: list[int]) -> list[int]:
        """Ids that no further symbol can change."""
        out: list[int] = []
        step = 4 * self.lookahead
        for lo in range(0, len(symbols), step):
            self.hold += symbols[lo:lo + step]
            if len(self.hold) >= step:
                safe, at = len(self.hold) - self.lookahead, 0
                for t in self.merge(self.hold):
                    if at + self.length[t] > safe:
                        break
                    out.append(t)
                    at += self.length[t]
                self.hold = self.hold[at:]
        return out

    def close(self) -> list[int]:
        """The ids left at the word's end; its last symbol takes the end mark."""
        out = self.merge([*self.hold[:-1], self.ends[self.hold[-1]]]) if self.hold else []
        self.hold = []
        return out


@functools.cache
def _kinds() -> np.ndarray:
    """Kind of each code point: 0 white space, 1 letter, 2 number, 3 other; surrogates stand for marks."""
    kinds = np.full(0x110000, 3, np.uint8)
    group = {"L": 1, "N": 2}
    for point in range(0x110000):
        kinds[point] = group.get(unicodedata.category(chr(point))[0], 3)
    kinds[[ord(c) for c in map(chr, range(0x3001)) if regex.match(r"\p{White_Space}", c)]] = 0
    kinds[0xD800:0xDFFF] = SPECIAL
    kinds[0xDFFF] = BREAK
    return kinds


def pieces(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in code points: contractions, letters, single digits, runs of others."""
    kind = _kinds()[points]
    new = np.ones(len(points) + 1, bool)
    new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2) | (kind[1:] >= SPECIAL)
    quote = np.flatnonzero((points == 39) & new[:-1])
    quote = quote[quote + 1 < len(points)]
    quote = quote[kind[quote + 1] == 1]
    if len(quote):
        after = points[quote + 1]
        third = np.where(quote + 2 < len(points), points[np.minimum(quote + 2, len(points) - 1)], 0)
        one = np.isin(after, [ord(c) for c in "stmd"])
        two = ((after == ord("r")) & (third == ord("e"))) | ((after == ord("v")) & (third == ord("e"))) | ((after == ord("l")) & (third == ord("l")))
        new[quote[one | two] + 1] = False
        new[quote[one] + 2] = True
        new[quote[two] + 3] = True
    at = np.flatnonzero(new[:-1])
    end = np.append(at[1:], len(points))[:len(at)]
    word = (kind[at] > 0) & (kind[at] != BREAK)
    return at[word], end[word]


class Encoder:
    """Ids of whole texts by a vocabulary file of the tokenizers library (BPE with word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.names = [names[i] for i in range(max(names) + 1)]
        self.encoded_names = [n.encode() for n in self.names]
        length = [len(t.removesuffix(suffix)) for t in self.names]
        symbols = byte_symbols()
        self.of_byte = [self.vocab[s] for s in symbols]
        ends = [0] * len(self.names)
        for s in symbols:
            ends[self.vocab[s]] = self.vocab[s + suffix]
        merges = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in model["merges"]]
        self.transducer = Transducer(merges, length, ends)
        self.known: dict[str, bytes] = {}

    def word(self, text: str) -> list[int]:
        """Ids of one word, through the transducer in blocks."""
        symbols, out = [self.of_byte[b] for b in text.encode()], []
        for lo in range(0, len(symbols), 4096):
            out += self.transducer.feed(symbols[lo:lo + 4096])
        return out + self.transducer.close()

    def words(self, texts: list[str]) -> list[bytes]:
        """Ids of words, as bytes; short words are merged side by side, by their number of symbols."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        out: list = [None] * len(texts)
        size = np.array([len(r) for r in raw], np.int64)
        most = min(SIDE_BY_SIDE, 4 * self.transducer.lookahead - 1)
        marks = {chr(0xD800 + n): i for n, i in enumerate(self.special.values())}
        for i in np.flatnonzero(size > most).tolist():
            out[i] = np.array(self.word(texts[i]), np.uint32).tobytes()
        of_byte, ends = np.array(self.of_byte, np.int64), np.array(self.transducer.ends, np.int64)
        for n in np.unique(size[size <= most]).tolist():
            rows = np.flatnonzero(size == n).tolist()
            rows = [i for i in rows if texts[i] not in marks]
            ids = of_byte[np.frombuffer(b"".join(raw[i] for i in rows), np.uint8).reshape(len(rows), n)]
            ids[:, -1] = ends[ids[:, -1]]
            for i, merged in zip(rows, self.transducer.merge_many(ids), strict=True):
                out[i] = merged
        for i in [i for i, ids in enumerate(out) if ids is None]:
            out[i] = np.array([marks[texts[i]]], np.uint32).tobytes()
        return out

    def texts(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after one another, and the n+1 places where the texts begin."""
        raw = buf.tobytes()
        text = _BREAK.join(raw[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
        for n, name in enumerate(self.special):
            if name in text:
                text = text.replace(name, chr(0xD800 + n))
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at, end = pieces(points)
        first = np.searchsorted(at, np.concatenate([[0], np.flatnonzero(points == 0xDFFF), [len(points)]]))
        code = points.astype(np.uint64)
        powers, inverse = grams._grown(len(points))
        prefix = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(grams.mix(code + np.uint64(1)) * powers[:len(points)], out=prefix[1:])
        h = grams.mix((prefix[end] - prefix[at]) * inverse[at] + (end - at).astype(np.uint64))
        _, where, which = np.unique(h, return_index=True, return_inverse=True)
        words = [text[a:b] for a, b in zip(at[where].tolist(), end[where].tolist(), strict=True)]
        found = list(map(self.known.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(new, self.words([words[i] for i in new]), strict=True):
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            found[i] = ids
            if len(words[i]) <= 256:
                self.known[words[i]] = ids
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        begin = np.cumsum(size) - size
        each = size[which]
        upto = np.cumsum(each)
        place = np.repeat(begin[which] - (upto - each), each)
        place += np.arange(len(place))
        return flat[place], np.concatenate([[0], upto])[first]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)


class Decoder:
    """Ids back to text, block by block.

    With ``joined`` the text is the tokens' own strings with spaces between, which is
    what the library gives for a vocabulary file without a decoder.  Otherwise symbols
    become bytes again, word ends spaces, and the bytes of a character that a block
    leaves unfinished wait for the next; invalid bytes become U+FFFD.
    """

    def __init__(self, names: list, suffix: str = "</w>", joined: bool = False, special: tuple[str, ...] = ()):
        self.joined = joined
        if joined:
            self.table = names if names and isinstance(names[0], bytes) else [n.encode() for n in names]
        else:
            back = {s: b for b, s in enumerate(byte_symbols())}
            self.table = [n.encode() if n in special else
                          bytes(back[c] for c in n.removesuffix(suffix)) + (b" " if n.endswith(suffix) else b"") for n in names]
        self.started, self.wait = False, b""

    def feed(self, ids: list[int]) -> bytes:
        """UTF-8 of the text that is certain after these ids."""
        if self.joined:
            if not ids:
                return b""
            out = b" ".join(map(self.table.__getitem__, ids))
            out, self.started = (b" " + out if self.started else out), True
            return out
        raw = self.wait + b"".join(map(self.table.__getitem__, ids))
        cut = len(raw)
        for back in range(1, min(3, len(raw)) + 1):
            lead = raw[-back]
            if lead >= 0xC0:
                cut -= back if (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) > back else 0
                break
            if lead < 0x80:
                break
        self.wait = raw[cut:]
        return raw[:cut].decode("utf-8", "replace").encode()

    def close(self) -> bytes:
        out, self.wait = self.wait.decode("utf-8", "replace").encode(), b""
        return out


def encoded(docs: DataFrame, columns: dict[str, pa.DataType], finish, path: str | None = None) -> DataFrame:
    """``docs`` without the text, with ``columns`` made by ``finish(encoder, ids, first)`` for each chunk of texts."""
    from pyspark.sql.pandas.types import from_arrow_schema

    path = path or default_path()
    carried = [c for c in docs.columns if c != "text" and c not in columns]
    schema = docs.select(*carried).schema
    for field in from_arrow_schema(pa.schema(list(columns.items()))):
        schema = schema.add(field)

    def run(batches):
        e = encoder(path)
        for batch in batches:
            for lo, hi, buf, off in common.text_chunks(batch):
                arrays = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in carried]
                arrays += finish(e, *e.texts(buf, off))
                yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *columns])

    return docs.select(*carried, "text").transform(common.in_tasks, run, schema)


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` without the text, with the array ``ids``."""
    return encoded(docs, {"ids": pa.list_(pa.int64())}, lambda e, ids, first: [
        pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int64()))], path)


def bpe_decode(encoded_docs: DataFrame, path: str | None = None, joined: bool = False) -> DataFrame:
    """``encoded_docs`` without ``ids``, with the decoded ``text``; a null array is an empty text."""
    path = path or default_path()
    carried = [c for c in encoded_docs.columns if c not in ("ids", "text")]

    def run(batches):
        e = encoder(path)
        for batch in batches:
            texts = []
            for ids in batch.column(batch.schema.get_field_index("ids")):
                d = Decoder(e.names, joined=joined, special=tuple(e.special))
                texts.append((d.feed(ids.as_py() or []) + d.close()).decode())
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in carried]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string())], names=[*carried, "text"])

    return encoded_docs.select(*carried, "ids").transform(common.in_tasks, run, encoded_docs.select(*carried).schema.add("text", "string"))


def _digests(e: Encoder, ids: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    sums, texts, names = [], [], e.encoded_names
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        sums.append(hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest())
        decoder, digest = Decoder(names, joined=True), hashlib.sha256()
        for lo in range(a, b, 1 << 16):
            digest.update(decoder.feed(ids[lo:min(b, lo + (1 << 16))].tolist()))
        texts.append(digest.hexdigest())
    return [pa.array(np.diff(first), pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())]


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    columns = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return encoded(docs, columns, _digests)
