"""The tokenizer transducer, packing, WARC packages and the pipeline."""

import hashlib
import io
import random
import string
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from raremetrics.llm import bpe, common, packing, warc

from .conftest import ODD

SF = "/root/testdata/sf0.001"
HARD = ["", "don't can't 's ''s 'sx x's's I'll we've they're I'D 5's", "<|endoftext|>hi<|startoftext|>", "ΑΣ Σ ΟΔΟΣ İstanbul é é ﬁ Å",
        "日本語 テスト 123 ４５ ½", "\x1c a\x1db    x \x85 y", "a" * 5000, "".join(random.Random(1).choice("abcdefghij") for _ in range(9000)),
        "😀😀 👍🏽 ok'", "'", "x'", "'ll 'l 'le 'r 're'", "tha" * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.default_path())


def ids_of(encoder, texts):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, first = encoder.texts(np.frombuffer(b"".join(raw), np.uint8), off)
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]


def test_ids_equal_the_library(encoder, library):
    texts = HARD + [t for _, t, *_ in ODD if t]
    assert ids_of(encoder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_transducer_needs_no_more_than_its_lookahead(encoder):
    t = encoder.transducer
    r = random.Random(9)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "etaoin", "ha"):
        word = "".join(r.choice(letters) for _ in range(6000))
        symbols = [encoder.of_byte[b] for b in word.encode()]
        out = []
        for k in range(0, len(symbols), 37):
            out += t.feed(symbols[k:k + 37])
            assert len(t.hold) <= 4 * t.lookahead + 37
        assert out + t.close() == t.merge([*symbols[:-1], t.ends[symbols[-1]]])


def test_incremental_decoding(encoder, library):
    ids = ids_of(encoder, ["Grüße 日本語 😀 it's fine"])[0]
    joined, plain = bpe.Decoder(encoder.names, joined=True), bpe.Decoder(encoder.names)
    assert (b"".join(joined.feed([i]) for i in ids) + joined.close()).decode() == library.decode(ids, skip_special_tokens=False)
    assert (b"".join(plain.feed([i]) for i in ids) + plain.close()).decode() == "grüße 日本語 😀 it 's fine "
    broken = bpe.Decoder(encoder.names)
    assert broken.feed([encoder.of_byte[0xE6], encoder.of_byte[0x97]]) == b"" and broken.close().decode() == "�"


def test_bpe_on_odd_tables(odd, clashing, empty, library):
    got = bpe.encoded(clashing, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, bpe._digests)
    for r in got.collect():
        text = next(x[1] for x in ODD if x[0] == r.doc_id) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_encode(empty).count() == 0
    back = bpe.bpe_decode(bpe.bpe_encode(odd.filter("doc_id = 4")))
    assert back.first().text == "one two "


def check_packing(rows, capacity=packing.CAPACITY):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for at in places.values():
        upto = 0
        for offset, length in sorted(at):
            assert offset == upto
            upto += length
        assert upto <= capacity
    return len(places)


HISTOGRAMS = {
    "over half": [random.Random(1).randint(1025, 2048) for _ in range(3000)],
    "over and under half": [random.Random(2).randint(1025, 2048) for _ in range(3000)] + [random.Random(3).randint(1, 1024) for _ in range(4000)],
    "thirds": [random.Random(4).randint(600, 800) for _ in range(900)],
    "few lengths": [random.Random(5).choice([700, 701, 702, 900, 683, 1000, 1025, 1030, 1366, 600]) for _ in range(800)],
    "small": [random.Random(6).randint(1, 200) for _ in range(500)],
    "one": [2048] * 3,
}


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_search_ends_at_the_bound_or_without_a_step(name):
    """No bin could go, or no move or exchange between any two underfull bins would raise the squared fill."""
    capacity = packing.CAPACITY
    histogram = Counter(HISTOGRAMS[name])
    first = packing.best_fit(histogram, capacity)
    bound = packing.lower_bound(histogram, capacity)
    bins = packing.improve(first, capacity, bound)
    assert bound <= sum(bins.values()) <= sum(first.values())
    lengths = Counter()
    for p, k in bins.items():
        assert packing.fill(p) <= capacity
        lengths.update({n: m * k for n, m in p})
    assert lengths == histogram
    if sum(bins.values()) > bound:
        open_ = [(packing.fill(p), p, k) for p, k in bins.items() if packing.fill(p) < capacity]
        for f, donor, k in open_:
            for g, taker, _ in open_:
                if g >= f and (donor != taker or k > 1):
                    assert packing._transfer(donor, taker, capacity) is None


def test_lower_bound_is_no_more_than_the_least():
    """Against every packing of a few pieces."""

    def least(pieces, bins=()):
        if not pieces:
            return len(bins)
        n, best = pieces[0], len(bins) + len(pieces)
        for i, room in enumerate(bins):
            if room >= n:
                best = min(best, least(pieces[1:], (*bins[:i], room - n, *bins[i + 1:])))
        return min(best, least(pieces[1:], (*bins, 20 - n)))

    r = random.Random(11)
    for _ in range(60):
        pieces = sorted((r.randint(1, 20) for _ in range(r.randint(1, 7))), reverse=True)
        assert packing.lower_bound(Counter(pieces), 20) <= least(pieces)
    assert packing.lower_bound({}, 20) == 0


def test_packing(odd, clashing, empty, library):
    rows = packing.packed(clashing).collect()
    total = sum(r.length for r in rows)
    assert check_packing(rows) == -(-total // packing.CAPACITY)
    pieces = sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    expected = []
    for d, text, *_ in ODD:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            expected.append((str(d), k, s, len(ids[s:s + 2048]), zlib.crc32(np.array(ids[s:s + 2048], "<u4").tobytes())))
    assert pieces == sorted(expected)
    assert packing.packed(empty).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_and_swaps_keep_all_pieces(seed):
    r = random.Random(seed)
    capacity = r.choice([5, 16, 50])
    histogram = {r.randint(1, capacity): r.randint(1, 30) for _ in range(r.randint(1, 8))}
    first = packing.best_fit(histogram, capacity)
    better = packing.improve(first, capacity)
    for bins in (first, better):
        got = {}
        for p, k in bins.items():
            assert k > 0 and packing.fill(p) <= capacity
            for n, m in p:
                got[n] = got.get(n, 0) + m * k
        assert got == histogram
    assert sum(better.values()) <= sum(first.values())
    assert sum(packing.fill(p) ** 2 * k for p, k in better.items()) >= sum(packing.fill(p) ** 2 * k for p, k in first.items())


def test_swaps_empty_a_bin():
    bins = {((6, 1),): 1, ((5, 1), (2, 1)): 1, ((3, 1), (1, 1)): 1, ((4, 1),): 1}
    better = packing.improve(bins, 10)
    assert sum(better.values()) == 3


def test_ranks_of_a_hot_length_are_dense(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 50)
    pieces = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 16 + 1).cast("long").alias("length"))
    rows = packing.pack(pieces, ["doc_id", "piece"], 16).collect()
    histogram = {n: sum(r.length == n for r in rows) for n in {r.length for r in rows}}
    assert len(rows) == 1000 and check_packing(rows, 16) == packing.plan(histogram, 16)["sequences"]


PAGES = [(1, "http://a", "x" * 200), (2, "http://b", "x" * 200), (3, None, "short"), (4, "http://c", "short"), (5, "http://d", None),
         (6, "http://e", ""), (7, "u v", "ü" * 60), (8, "http://f", "ü" * 60), (9, "http://g", "\r\n\r\n" * 50), (None, "http://h", "x" * 200), (1, "http://a", "x" * 200)]


@pytest.mark.parametrize("zip64", [True, False])
def test_warc_round_trip(spark, zip64):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    manifest = warc.write_packages(warc.with_revisits(pages), common.shared_path(spark, "test"), zip64)
    got = warc.read_records(warc.record_places(warc.members(manifest))).collect()
    first = {}
    for p, _, h in PAGES:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, p), p)
    expected = []
    for p, _, h in PAGES:
        raw = (h or "").encode()
        again = first.get(h) if first.get(h, p) != p else None
        expected.append((str(p), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", again, None if again else raw))
    assert sorted(map(str, ((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                             None if r.payload is None else bytes(r.payload)) for r in got))) == sorted(map(str, expected))
    system, path = warc._open(manifest.first().package)
    with system.open_input_file(path) as f, zipfile.ZipFile(io.BytesIO(f.read())) as z:
        assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX]


def test_a_page_served_very_often_is_split(spark):
    """Half of the rows have one payload: the join by digest reads them in several tasks and loses none."""
    n, page = 4000, "".join(random.Random(3).choices(string.printable, k=4000))
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), F.sha2(F.col("id").cast("string"), 512)).alias("url"),
                                  F.when(F.col("id") % 2 == 0, page).otherwise(F.concat(F.lit("y" * 200), F.col("id"))).alias("html"))
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB"}
    before = {k: spark.conf.get(k, None) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        got = warc.with_revisits(pages.repartition(8)).withColumn("payload", F.octet_length("payload"))
        rows = got.collect()
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(r.page_id for r in rows) == list(range(n))
    assert {r.refers_to for r in rows if r.record_type == "revisit"} == {0}
    assert sum(r.record_type == "revisit" for r in rows) == n // 2 - 1


def test_hadoop_names_of_s3_are_read_by_arrow(monkeypatch):
    monkeypatch.setattr(warc, "fs", type("Fs", (), {"FileSystem": type("F", (), {"from_uri": staticmethod(lambda uri: (None, uri))})}))
    assert [warc._open(f"{s}://bucket/a.wacz")[1] for s in ("s3a", "s3n", "s3", "gs")] == [
        "s3://bucket/a.wacz", "s3://bucket/a.wacz", "s3://bucket/a.wacz", "gs://bucket/a.wacz"]


def test_warc_empty_and_foreign_zip(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = warc.write_packages(warc.with_revisits(pages), common.shared_path(spark, "test"))
    assert warc.read_records(warc.record_places(warc.members(manifest))).count() == 0
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"a comment"
        z.writestr("one", b"abc")
        z.writestr("two/three", b"defgh" * 9)
    data = raw.getvalue()
    found = warc.directory(lambda at, n: data[at:at + n], len(data))
    assert [(n, data[o:o + s]) for n, _, o, s in found] == [("one", b"abc"), ("two/three", b"defgh" * 9)]


def test_words_merged_side_by_side_are_those_of_the_single_merge():
    e = bpe.Encoder(bpe.default_path())
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("etaoinsh"), n)) for n in (*range(1, 70), 200) for _ in range(6)]
    words += ["aaaaaaaaaaaa", "é" * 31, "é" * 40, *(chr(0xD800 + n) for n in range(len(e.special)))]
    single = [[i] for i in e.special.values()]
    want = [e.word(w) for w in words[:len(words) - len(single)]] + single
    assert [np.frombuffer(b, np.uint32).tolist() for b in e.words(words)] == want


def test_short_words_are_not_merged_one_by_one(monkeypatch):
    e = bpe.Encoder(bpe.default_path())

    def one_by_one(self, ids):
        raise AssertionError("a short word went through the single merge")

    monkeypatch.setattr(bpe.Transducer, "merge", one_by_one)
    buf = np.frombuffer(b"several words of unequal length, merged side by side", np.uint8)
    assert len(e.texts(buf, np.array([0, len(buf)]))[0]) > 8
