"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words of documents and benchmark items are cut into k-grams, and of every
``window - k + 1`` neighbouring k-grams the smallest hash is kept as a
fingerprint.  Two texts that share ``window`` consecutive words share such a
neighbourhood and hence a fingerprint, so a join on fingerprints finds every
such span.  Each hit fixes how document and item lie against each other;
comparing the words there extends it to the whole shared span, which also
discards equal hashes of different words.  Items shorter than ``window`` are
one window of their own; documents get the n-grams of those lengths as
further fingerprints, where such items exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.common import LOWER, UPPER, numbered
from wardline.session import checkpoint

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fingerprints of the benchmark up to which they are broadcast (28 bytes each).
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """Words after A-Z became a-z; null has none."""
    ascii_only = F.length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def span(n: Column) -> Column:
    """0, 1, ... n - 1; empty if n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def gram_hashes(words: Column, k: int) -> Column:
    return F.transform(span(F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i + 1, k)))


def winnowed(hashes: Column, width: int) -> Column:
    """The smallest hash of every ``width`` neighbours, each value once."""
    return F.array_distinct(F.transform(
        span(F.size(hashes) - (width - 1)), lambda i: F.array_min(F.slice(hashes, i + 1, width))))


def item_fingerprints(items: DataFrame, window: int, k: int) -> DataFrame:
    """(h, item, q, k, len): a fingerprint, its places in an item, its words and the item's words."""
    n = F.size("words")
    whole = n < window
    hashes = gram_hashes(F.col("words"), k)
    grams = items.withColumn("hashes", hashes).withColumn("kept", winnowed(F.col("hashes"), window - k + 1))
    places = F.filter(F.transform(F.col("hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("q"))),
                      lambda x: F.array_contains(F.col("kept"), x["h"]))
    own = F.array(F.struct(F.xxhash64(F.slice("words", 1, n)).alias("h"), F.lit(0).alias("q")))
    return (grams.filter(n > 0)
            .select("item", F.explode(F.when(whole, own).otherwise(places)).alias("x"),
                    F.when(whole, n).otherwise(F.lit(k)).alias("k"), n.alias("len"))
            .select("x.h", "item", "x.q", "k", "len"))


def shared_runs(doc: Column, item: Column, at: Column, window: Column) -> Column:
    """Document ranges [s, e) where at least ``window`` words in a row are equal.

    doc holds the document's words from place ``at`` on.
    """
    none = F.array().cast("array<struct<s:int,e:int>>")
    same = F.concat(F.zip_with(doc, item, lambda a, b: F.coalesce(a == b, F.lit(False))), F.array(F.lit(False)))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("s"), none.alias("out"))

    def step(state, equal):
        i, s, out = state["i"], state["s"], state["out"]
        ended = F.when(i - s >= window, F.concat(out, F.array(F.struct((at + s).alias("s"), (at + i).alias("e"))))).otherwise(out)
        return F.struct((i + 1).alias("i"), F.when(equal, s).otherwise(i + 1).alias("s"),
                        F.when(equal, out).otherwise(ended).alias("out"))
    return F.aggregate(same, start, step, lambda state: state["out"])


def covered(ranges: Column) -> Column:
    """How many places the sorted ranges cover together."""
    def step(state, r):
        new = F.greatest(F.lit(0), r["e"] - F.greatest(r["s"], state["end"]))
        return F.struct(F.greatest(state["end"], r["e"]).alias("end"), (state["n"] + new).alias("n"))
    return F.aggregate(ranges, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), step, lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: (row, doc_id, n_words, n_hit, items, ranges).

    items are the ids, as sorted strings, of items with a window in the
    document; ranges [s, e) are the words in such windows, n_hit their number.
    Null texts have no words.  An item without id hits words but is not
    listed; repeated documents have a row each.  More than ``broadcast_rows``
    fingerprints of items are joined by a shuffle, which reads docs twice: they
    must come in the same order again, as files and checkpoints do.
    """
    bench = checkpoint(items.select(
        F.monotonically_increasing_id().alias("item"), F.col(item_id).cast("string").alias("item_id"),
        words_of(F.col(item_text)).alias("item_words")))
    prints = checkpoint(item_fingerprints(bench.withColumnRenamed("item_words", "words"), window, k))
    facts = prints.agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("len") < window, F.col("k"))).alias("short")).first()
    small = facts["n"] <= broadcast_rows
    held = F.broadcast if small else (lambda df: df)

    words = numbered(docs, F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    grams = words.withColumn("hashes", gram_hashes(F.col("words"), k))
    kept = [winnowed(F.col("hashes"), window - k + 1), *(gram_hashes(F.col("words"), n) for n in sorted(facts["short"]))]
    grams = grams.withColumn("kept", F.array_distinct(F.concat(*kept)) if len(kept) > 1 else kept[0])
    hit = F.struct("h", "item", "q", "k", "len")
    if small:
        # A row without fingerprint per document, and one per fingerprint that an item has too: the words
        # go along by reference, as generator and join are one pass.  Outer, as a plain explode adds a filter on
        # the array's size, for which all of it is worked out once more.
        every = grams.select("row", "doc_id", "words", "hashes",
                             F.explode_outer(F.concat(F.array(F.lit(None).cast("long")), "kept")).alias("h"))
        found = every.join(held(prints), "h", "left").filter(F.col("h").isNull() | F.col("item").isNotNull())
        real = F.col("item").isNotNull()
        found = (found.select("row", "doc_id", F.size("words").alias("n_words"), F.when(real, F.col("words")).alias("words"),
                              F.when(real, F.col("hashes")).alias("hashes"), F.when(real, hit).alias("hit"))
                 .groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                                     F.first("words", ignorenulls=True).alias("words"),
                                     F.first("hashes", ignorenulls=True).alias("hashes"),
                                     F.collect_set("hit").alias("hits")))
    else:
        hits = (grams.select("row", F.explode_outer("kept").alias("h")).join(prints, "h")
                .groupBy("row").agg(F.collect_set(hit).alias("hits")))
        found = (grams.select("row", "doc_id", F.size("words").alias("n_words"), "words", "hashes").join(hits, "row", "left")
                 .withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<h:bigint,item:bigint,q:int,k:int,len:int>>"))))

    # Where the item would begin in the document, for every place of the fingerprint in it.
    def places(m):
        at = F.when(m["k"] == k, F.filter(F.transform(F.col("hashes"), lambda h, i: F.when(h == m["h"], i)), lambda i: i.isNotNull()))
        for n in facts["short"]:
            if n != k:
                at = at.when(m["k"] == n, F.filter(F.transform(
                    gram_hashes(F.col("words"), n), lambda h, i: F.when(h == m["h"], i)), lambda i: i.isNotNull()))
        return F.transform(at, lambda p: F.struct(m["item"].alias("item"), (p - m["q"]).alias("at"), m["len"].alias("len")))

    aligned = F.array_distinct(F.flatten(F.transform("hits", places)))
    laid = (found.select("row", "doc_id", "n_words", "words", F.explode_outer(aligned).alias("a"))
            # Documents without hits get keys of their own, so that they do not meet in one task.
            .select("row", "doc_id", "n_words", F.coalesce("a.item", -1 - F.col("row")).alias("item"), "a.at",
                    F.slice("words", F.greatest(F.col("a.at"), F.lit(0)) + 1,
                            F.greatest(F.lit(0), F.col("a.len") + F.least(F.col("a.at"), F.lit(0)))).alias("part")))
    first = F.greatest(F.col("at"), F.lit(0))
    beside = F.slice("item_words", first - F.col("at") + 1, F.size("part"))
    runs = F.when(F.col("item_words").isNotNull(), shared_runs(
        F.col("part"), beside, first, F.least(F.lit(window), F.size("item_words"))))
    spans = laid.join(held(bench), "item", "left").select("row", "doc_id", "n_words", "item_id", runs.alias("runs"))
    empty = F.array().cast("array<struct<s:int,e:int>>")
    return (spans.groupBy("row")
            .agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
                 F.collect_set(F.when(F.size("runs") > 0, F.col("item_id"))).alias("items"),
                 F.collect_set("runs").alias("runs"))
            .withColumn("ranges", F.array_sort(F.array_distinct(F.flatten(F.concat(F.array(empty), "runs")))))
            .select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"), covered(F.col("ranges")).alias("n_hit"),
                    F.array_sort("items").alias("items"), "ranges"))
