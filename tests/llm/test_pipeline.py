"""The pipeline's chained stages against plain Python, given the trained weights; odd rows and column names."""

from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from raremetrics.llm import common, linear, packing, toxicity

from .conftest import CLASHING, ODD, words
from .test_dedup import brute_cut_words, brute_links
from .test_filters import base

SF = "/root/testdata/sf0.001"


def not_toxic(rows, model):
    """Rows under the threshold: sums of the weights of a text's character n-grams, one text at a time."""
    weight = dict(zip(model["feature"].tolist(), model["value"].tolist(), strict=True))
    kept = []
    for r in rows:
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        _, feature = toxicity.ngrams(raw, np.array([0, len(raw)]))
        margin = sum(weight.get(f, 0.0) for f in set(feature.tolist())) + model["bias"]
        if linear.sigmoid(np.array([model["slope"] * margin + model["offset"]]))[0] < toxicity.THRESHOLD:
            kept.append(r)
    return kept


def passing_base(rows):
    return [r for r in rows if not base(r["text"])[-1]]


def one_of_each(rows):
    rows = list({(r["doc_id"], r["text"]): r for r in rows}.values())
    first = {d for d, c, _ in brute_links([(r["doc_id"], r["text"] or "") for r in rows]) if d == c}
    return [r for r in rows if r["doc_id"] in first]


def as_set(rows):
    return Counter(tuple(sorted((k, str(v)) for k, v in r.items())) for r in rows)


def test_chained_stages_equal_plain_python(spark):
    docs = common.documents(spark, SF).withColumn("label", F.concat(F.lit("own "), "doc_id")).withColumn("_id", F.col("doc_id") + 7)
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    rows = [r.asDict() for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]

    def after(name):
        found = common.materialise(stages[name](spark, docs, SF), "test")
        assert found.columns == columns
        return found, [r.asDict() for r in found.collect()]

    model = toxicity.train(docs.select("doc_id", "text"), labels, common.id_remainder("doc_id", 4) != 2)
    docs, found = after("toxicity")
    assert as_set(found) == as_set(not_toxic(rows, model)) and 0 < len(found) < len(rows)

    rows = passing_base(found)
    docs, found = after("quality rules")
    # the fences reject more than the base rule, but no text labelled good
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    assert not as_set(found) - as_set(rows) and as_set(r for r in rows if r["doc_id"] in good) <= as_set(found)

    rows = one_of_each(found)
    docs, found = after("n-gram Jaccard join")
    assert as_set(found) == as_set(rows)

    rows = [r | {"text": t, "n_chars": len(t)} for r, t in zip(found, brute_cut_words([r["text"] or "" for r in found], corpus_pipeline.PASSAGE_WORDS), strict=True)]
    docs, found = after("suffix-array dedup")
    assert as_set(found) == as_set(rows)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    places = stages["best-fit packing"](spark, docs, SF).collect()
    expected = Counter()
    for r in found:
        n = len(library.encode(r["text"], add_special_tokens=False).ids) + 1
        expected.update((r["doc_id"], k, s, min(packing.CAPACITY, n - s)) for k, s in enumerate(range(0, n, packing.CAPACITY)))
    assert Counter((p.doc_id, p.piece, p.start, p.length) for p in places) == expected
    by = {}
    for p in places:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for at in by.values():
        ends = np.cumsum([n for _, n in sorted(at)])
        assert [o for o, _ in sorted(at)] == [0, *ends[:-1].tolist()] and ends[-1] <= packing.CAPACITY
    assert len(by) == packing.lower_bound(Counter(p.length for p in places), packing.CAPACITY)


@pytest.fixture(scope="module")
def labelled(odd, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    odd.limit(0).selectExpr("doc_id", "1 as quality", "1 as toxic").write.parquet(f"{at}/labels.parquet")
    return at


def test_odd_rows_and_clashing_columns(spark, clashing, empty, labelled):
    """Without labels nothing is toxic; the base rule, the join and the cut decide what stays."""
    docs = clashing
    rows = [{"doc_id": r[0], "text": r[1]} for r in ODD]
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = Counter((r.doc_id, r.text) for r in docs.collect())
        docs = common.materialise(stage(spark, docs, labelled), "test")
        assert docs.columns == clashing.columns
        got = docs.collect()
        assert all(r[c] == f"own {c}" for r in got for c in CLASHING)
        now = Counter((r.doc_id, r.text) for r in got)
        if name == "toxicity":
            assert now == before == Counter((r["doc_id"], r["text"]) for r in rows)
        if name == "quality rules":
            assert not now - Counter((r["doc_id"], r["text"]) for r in passing_base(rows)) and (5, ODD[4][1]) in now
        if name == "n-gram Jaccard join":
            assert not now - before and max(now.values()) == 1 and {5, 6, 7, 8} & {d for d, _ in now} == {5}
    ids = Counter(r.doc_id for r in docs.collect())
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, labelled).collect()
    assert Counter(p.doc_id for p in pieces if p.piece == 0) == ids


def test_each_stage_on_odd_and_empty_tables(spark, odd, empty, labelled):
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, odd, labelled)
        assert got.columns == odd.columns and not Counter(r.doc_id for r in got.collect()) - Counter(r[0] for r in ODD)
        assert stage(spark, empty, labelled).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, empty, labelled).count() == 0
    assert {r.doc_id for r in corpus_pipeline.STAGES[4][1](spark, odd, labelled).collect()} == {r[0] for r in ODD}


def test_passages_over_fifty_words_go_and_shorter_ones_stay(spark, labelled):
    own = [" ".join(f"a{k}x{i}" for i in range(80)) for k in range(6)]
    passage = " ".join("ab"[i % 2] + str(i) for i in range(51))
    rows = [(k, f"{t} {passage if k < 3 else passage.rsplit(' ', 1)[0].replace('a', 'c')} {k} {t[::-1]}", "en", "s", 1) for k, t in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["suffix-array dedup"](spark, docs, labelled).collect()}
    for d, text, *_ in rows:
        assert got[d].text == (text.replace(passage + " ", "") if d < 3 else text)
        assert got[d].n_chars == len(got[d].text) and len(words(got[d].text)) == len(words(text)) - (51 if d < 3 else 0)
