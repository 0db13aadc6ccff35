"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A text is its words (runs without ASCII white space), each hashed.  A run of ``K`` words
is an anchor if the smallest hash of its inner strings of ``S`` words belongs to its first
or its last one; that depends on the run alone, so the same run is an anchor in every
text.  Of random runs 2 / (K - S + 1) are anchors, here a half, and two adjacent anchors
never lie more than K - S words apart.

The fingerprint is the whole row of anchors, at any length of the text: for each, in the
text's order, the words since the one before (one hexadecimal digit) and its hash (32
bits, eight digits).  Two fingerprints are matched by place: every hash at its first place
in a text pairs with the same hash of the other, each pair has an offset, and pairs whose
offset is further from the middle offset than ``SLACK`` words, or than ``SHARE`` of the
longer text, do not match.  The likeness is the matched pairs over all hashes of both.
Insertions and deletions leave pairs matched; a text whose halves change places keeps half.

A document's neighbour is found without gathering the documents: distinct ids and digests are
range-partitioned, a partition for every ``ORDER_ROWS`` of them, and written once; each
takes the next of its partition, and the last of a partition the first of the following one.

Defined cases: a text with words but no anchor (always so below ``K`` words) has one,
that of all its words; a null or empty text (or white space alone) has none and the empty
fingerprint, and two empty fingerprints have likeness 1; documents that share an id are
ordered by the text's digest; repeated rows count as one document and each get its result;
a null id comes first; a single document is its own neighbour; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raremetrics.llm import common

K = 5
S = 2
SLACK = 16
SHARE = 1 / 8
ORDER_ROWS = 1_000_000


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _packed(run: Column, place: Column) -> Column:
    """32 bits of a run's hash above its place, whose lowest bit stays free."""
    return F.shiftleft(F.shiftrightunsigned(run, 32), 32).bitwiseOR(F.shiftleft(place.cast("long"), 1))


def hash_of(anchor: Column) -> Column:
    return F.shiftrightunsigned(anchor, 32)


def place_of(anchor: Column) -> Column:
    return F.shiftright(anchor.bitwiseAND(F.lit(2**32 - 1)), 1)


def anchors(text: Column) -> Column:
    """A text's closed syncmers in its order, one number each (``hash_of``, ``place_of`` its first word)."""
    edge = K - S
    none = F.array().cast("array<bigint>")

    def of(h: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(*[h[i + j] for j in range(S)]))

        def runs(m: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.size(h) - K), lambda i: F.when(
                F.least(m[i], m[i + edge]) <= F.least(*[m[i + j] for j in range(1, edge)]),
                _packed(F.xxhash64(*[h[i + j] for j in range(K)]), i)))

        found = F.when(F.size(h) >= K, F.filter(_bound(inner, runs), lambda x: x.isNotNull())).otherwise(none)
        whole = F.aggregate(h, F.lit(42).cast("long"), lambda a, w: F.xxhash64(a, w))
        return _bound(found, lambda a: F.when((F.size(a) > 0) | (F.size(h) == 0), a).otherwise(
            F.array(_packed(whole, F.lit(0)))))

    return _bound(word_hashes(text), of)


def as_string(values: Column) -> Column:
    def gap(x, i):
        return place_of(x) - F.when(i > 0, place_of(F.get(values, i - 1))).otherwise(F.lit(0).cast("long"))

    return F.array_join(F.transform(values, lambda x, i: F.concat(
        F.lower(F.hex(gap(x, i))), F.lpad(F.lower(F.hex(hash_of(x))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes of two rows of anchors that both have, at matching places."""

    def firsts(values: Column) -> Column:
        return _bound(F.sort_array(values), lambda s: F.filter(
            s, lambda x, i: (i == 0) | (hash_of(x) != hash_of(F.get(s, i - 1)))))

    def last(values: Column) -> Column:
        return F.coalesce(place_of(F.get(values, F.size(values) - 1)), F.lit(0).cast("long"))

    def offsets(s: Column) -> Column:
        """Of each number that stands for the same hash as the one before it: of both texts, as each has it once."""
        found = F.transform(s, lambda x, i: F.when(
            (i > 0) & (hash_of(x) == hash_of(F.get(s, i - 1))),
            (place_of(x) - place_of(F.get(s, i - 1))) * (x.bitwiseAND(F.lit(1)) * 2 - 1)))
        return F.sort_array(F.filter(found, lambda x: x.isNotNull()))

    slack = F.greatest(F.lit(float(SLACK)), F.greatest(last(a), last(b)) * SHARE)

    def share(s: Column) -> Column:
        def matched(d: Column) -> Column:
            middle = F.get(d, F.floor(F.size(d) / 2).cast("int"))
            return F.size(F.filter(d, lambda x: F.abs(x - middle) <= slack))

        return _bound(_bound(offsets(s), matched), lambda n: n / (F.size(s) - n))

    both = F.sort_array(F.concat(firsts(a), F.transform(firsts(b), lambda x: x + 1)))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(_bound(both, share))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with the array ``values`` and the string ``fingerprint``."""
    return docs.withColumn("values", anchors(F.coalesce("text", F.lit("")))).withColumn("fingerprint", as_string(F.col("values")))


def with_next(keys: DataFrame) -> DataFrame:
    """Distinct (doc_id, digest, ...) rows with ``next``: those two columns of the following row, the last with the first's."""
    keys = common.materialise(keys, "syncmer-keys")
    parts = -(-max(1, keys.count()) // ORDER_ROWS)
    ranged = keys.repartitionByRange(parts, "doc_id", "digest").withColumn("part", F.spark_partition_id())
    ranged = common.materialise(ranged, "syncmer-order")
    me = F.struct("doc_id", "digest")
    begins = ranged.groupBy("part").agg(F.min(me).alias("head"))  # one row per partition
    order = Window.orderBy("part")
    begins = begins.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("following"))
    lead = F.lead(me).over(Window.partitionBy("part").orderBy("doc_id", "digest"))
    joined = ranged.withColumn("next", lead).join(F.broadcast(begins), "part")  # as many rows as partitions
    return joined.withColumn("next", F.coalesce("next", "following")).drop("following", "part")


def _key(doc_id: Column, digest: Column) -> Column:
    """One never-null string for an id and a digest (whose length is fixed)."""
    return F.concat(digest, F.coalesce(F.concat(F.lit(":"), doc_id.cast("string")), F.lit("")))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness.

    Anchors are computed where both texts are, as they take more room than a compressed text.
    Both joins read one shuffle of the texts by key: the first finds the text that the document
    before wants, the second takes it to the document's own."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    keys = texts.select("doc_id", "digest", F.char_length("text").cast("long").alias("n_chars")).dropDuplicates(["doc_id", "digest"])
    linked = with_next(keys).select(
        "doc_id", _key(F.col("doc_id"), F.col("digest")).alias("for_key"), "n_chars",
        _key(F.col("next.doc_id"), F.col("next.digest")).alias("next_key"))
    linked = common.materialise(linked, "syncmer-next")

    texts = texts.select("text", _key(F.col("doc_id"), F.col("digest")).alias("key"))  # the same in both joins
    heads = (texts.join(linked, F.col("key") == F.col("next_key"))
             .select("for_key", "doc_id", "n_chars", F.col("text").alias("next"))
             .groupBy("for_key").agg(*[F.first(c).alias(c) for c in ("doc_id", "n_chars", "next")]))  # copies of the neighbour's row
    whole = texts.join(heads, F.col("key") == F.col("for_key"))
    take = F.floor(F.col("n_chars") / 4)
    edited = F.concat(F.left("text", (F.col("n_chars") - take).cast("int")), F.left("next", take.cast("int")))
    edited = whole.select("doc_id", "n_chars", anchors(F.col("text")).alias("values"),
                          anchors(F.col("next")).alias("next_values"), edited.alias("edited"))
    edited = edited.select("doc_id", "n_chars", "values", "next_values", F.sha2("edited", 256).alias("edited_sha256"),
                           anchors(F.col("edited")).alias("edited_values"))
    return edited.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("values")).alias("fingerprint"),
                         as_string(F.col("edited_values")).alias("edited_fingerprint"),
                         likeness(F.col("values"), F.col("edited_values")).alias("near_edited"),
                         likeness(F.col("values"), F.col("next_values")).alias("near_next"))


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(common.documents(spark, sf_dir))
