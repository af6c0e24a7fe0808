"""Quality selection by importance resampling.

Two generative models of hashed words and word pairs, one of target text
(documents labelled good) and one of all text, give every document the log
weight  sum over its features of  log p_target - log p_raw.  The best k by
log weight plus Gumbel noise are a sample without replacement in proportion
to the weights (Xie et al.).  Ratios are drawn to one where counts are few,
so that words seen once or twice say little.

k follows the data: it is the number of documents whose weight reaches a cut,
and the cut is set on labelled documents that neither model's target part was
fitted on, so that losing a good document costs ``clean_cost`` times what
keeping a bad one does.

A sum over a whole document drowns the few words by which a toxic one of good
prose is told.  So features are also counted by document, in labelled toxic
documents and in the other labelled ones, without buckets, and the largest
log ratio among a document's features is its toxicity.  Its cut is set on the
same held-out labels; documents above it are rejected whatever their weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.common import chunks, fold, large, lean, numbered
from wardline.session import checkpoint

BUCKETS = 1 << 18
CHUNK = 4 << 20
#: Labelled documents that are used at most.
LABELLED = 60_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit code of each word, run of marks, and pair of neighbours among them."""
    split = pc.replace_substring_regex(large(texts), r"([!-/:-@\[-`{-~]+)", r" \1 ")
    cut = pc.ascii_split_whitespace(pc.utf8_lower(split))
    words = cut.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    names = words.dictionary.cast(pa.large_binary()).to_pylist()
    code = np.fromiter(map(zlib.crc32, names), np.uint64, len(names))
    ids = words.indices.to_numpy()
    empty = pc.index(words.dictionary, "").as_py()
    if empty >= 0:
        real = ids != empty
        doc, ids = doc[real], ids[real]
    one = code[ids]
    two = mixed(one[:-1]) + one[1:] + np.uint64(1)
    same = doc[1:] == doc[:-1]
    return np.concatenate([doc, doc[1:][same]]), np.concatenate([mixed(one), mixed(two[same])])


def bucketed(code: np.ndarray, buckets: int) -> np.ndarray:
    return (code % np.uint64(buckets)).astype(np.int64)


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each word, run of marks, and pair of neighbours among them."""
    doc, code = coded(texts)
    return doc, bucketed(code, buckets)


def chosen_labels(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """(doc_id, good, toxic): at most ``limit`` labelled ids, chosen by hash; good is quality without toxic."""
    every = (labels.filter("doc_id is not null and quality is not null").groupBy("doc_id")
             .agg((F.min("quality") == 1).alias("q"), (F.coalesce(F.max("toxic"), F.lit(0)) == 1).alias("t"))
             .select("doc_id", (F.col("q") & ~F.col("t")).alias("good"), F.col("t").alias("toxic"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("h")))
    n = every.count()
    share = every if n <= limit else every.filter(F.col("h") < int((1 << 20) * limit * 0.98 / n))
    return share.select("doc_id", "good", "toxic").limit(limit)


def labelled(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """(doc_id, good) of the chosen labels."""
    return chosen_labels(labels, limit).select("doc_id", "good")


@dataclass
class Toxicity:
    """Log ratios above 0 by feature code; codes rise."""

    codes: np.ndarray
    ratio: np.ndarray

    def of(self, doc: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
        """The largest ratio among the features of each of n texts; 0 without any."""
        out = np.zeros(n)
        if len(self.codes):
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = np.flatnonzero(self.codes[place] == code)
            np.maximum.at(out, doc[hit], self.ratio[place[hit]])
        return out

    def above(self, cut: float) -> Toxicity:
        return Toxicity(self.codes[self.ratio > cut], self.ratio[self.ratio > cut])


NONE_TOXIC = Toxicity(np.zeros(0, np.uint64), np.zeros(0))


@dataclass
class Model:
    """Log ratio by bucket, the cut for the log weight, and the features that a toxic document has one of."""

    ratio: np.ndarray
    cut: float
    toxic: Toxicity


def counted(docs: DataFrame, target: Column, text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Features by bucket in the target documents and in all; the driver gets one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, every = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in chunks(batch.column(0), CHUNK):
                doc, bucket = features(batch.column(0)[part], buckets)
                chosen = batch.column(1)[part].to_numpy(zero_copy_only=False).astype(bool)
                every += np.bincount(bucket, minlength=buckets)
                wanted += np.bincount(bucket[chosen[doc]], minlength=buckets)
        b = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(wanted[b]), pa.array(every[b])], ["bucket", "target", "all"])

    rows = (docs.select(F.col(text).cast("string"), target).mapInArrow(lean(count), "bucket long, target long, all long")
            .groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("all").alias("all")).toPandas())
    out = np.zeros((2, buckets))
    out[:, rows["bucket"]] = rows["target"], rows["all"]
    return out[0], out[1]


def log_ratio(target: np.ndarray, every: np.ndarray, prior: float) -> np.ndarray:
    share = target.sum() / max(1.0, every.sum())
    return np.log((target + prior) / (every * share + prior)) if share else np.zeros(len(every))


def documents_with(docs: DataFrame, text: str, codes: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The features (those among ``codes``, if given) of at least ``least`` of the documents, rising, and of how many each."""
    shared = None if codes is None else docs.sparkSession.sparkContext.broadcast(codes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(0), CHUNK):
                doc, code = coded(batch.column(0)[part])
                if shared is not None:
                    known = np.isin(code, shared.value)
                    doc, code = doc[known], code[known]
                order = np.lexsort((doc, code))
                doc, code = doc[order], code[order]
                new = np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])) if len(code) else np.zeros(0, bool)
                found, n = np.unique(code[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["code", "n"])

    rows = (docs.select(F.col(text).cast("string")).mapInArrow(lean(count), "code long, n long")
            .groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow())
    found, n = rows.column("code").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(found)
    return found[order], n[order]


def fit_toxicity(marked: DataFrame, prior: float) -> Toxicity:
    """Log ratios of the shares of toxic and of other documents that have a feature.

    marked: (text, toxic), the labelled documents, a bounded number.  A feature
    of a single toxic document tells nothing.
    """
    toxic, rest = marked.filter("toxic"), marked.filter("not toxic")
    n_toxic, n_rest = toxic.count(), rest.count()
    if not n_toxic or not n_rest:
        return NONE_TOXIC
    codes, n = documents_with(toxic, "text", None, 2)
    also, many = documents_with(rest, "text", codes, 1)
    other = np.zeros(len(codes))
    other[np.searchsorted(codes, also)] = many
    return Toxicity(codes, np.log((n + prior) / (other * n_toxic / n_rest + prior))).above(0.0)


def best_cut(weights: np.ndarray, good: np.ndarray, clean_cost: float) -> float:
    """The cut of least cost; without bad examples everything stays."""
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) / g.sum() * clean_cost
    kept = 1 - np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    at = int(np.argmin(lost + kept))
    if at == 0:
        return float("-inf")
    return float((w[at - 1] + w[at]) / 2) if at < len(w) else float(np.nextafter(w[-1], np.inf))


def with_weight(docs: DataFrame, ratio: np.ndarray, *keep: Column, text: str = "text", toxic: Toxicity = NONE_TOXIC) -> DataFrame:
    """The kept columns, log_weight and toxicity; an empty or null text weighs 0."""
    shared = docs.sparkSession.sparkContext.broadcast((ratio, toxic))
    chosen = docs.select(F.struct(*keep).alias("kept"), F.col(text).cast("string").alias("text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(1), CHUNK):
                rows = batch.slice(part.start, part.stop - part.start)
                ratio, toxic = shared.value
                doc, code = coded(rows.column(1))
                weight = np.bincount(doc, ratio[bucketed(code, len(ratio))], rows.num_rows)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(weight.astype(np.float64)), pa.array(toxic.of(doc, code, rows.num_rows))],
                                                 ["kept", "log_weight", "toxicity"])
    out = chosen.mapInArrow(lean(weigh), f"kept {chosen.schema['kept'].dataType.simpleString()}, log_weight double, toxicity double")
    return out.select("kept.*", "log_weight", "toxicity")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS,
        prior: float = 30.0, clean_cost: float = 10.0, limit: int = LABELLED, toxic_prior: float = 0.1) -> Model:
    """Ratios from all documents, toxicity and the cuts from labelled ones.

    Of at most ``limit`` labelled documents, those with crc32(id) mod 5 = 0
    set the cuts, the good ones among the rest are the target, and the rest
    tell toxic features.  Toxic documents that are found do not set the cut
    for the weight.
    """
    known = checkpoint(chosen_labels(labels, limit))
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = fold(F.col("doc_id"), 5) == 0
    marked = plain.join(F.broadcast(known), "doc_id", "left")  # bounded by ``limit``
    ratio = log_ratio(*counted(marked, F.coalesce(F.col("good") & ~held, F.lit(False)), "text", buckets), prior)
    toxicity = fit_toxicity(plain.join(F.broadcast(known.filter(~held)), "doc_id").select("text", "toxic"), toxic_prior)
    test = with_weight(plain.join(F.broadcast(known.filter(held)), "doc_id"), ratio, F.col("good"), F.col("toxic"), toxic=toxicity).toPandas()
    found, weights = test["toxicity"].to_numpy(), test["log_weight"].to_numpy()
    most = max(0.0, -best_cut(-found, ~test["toxic"].to_numpy(bool), clean_cost))
    stays = found <= most
    return Model(ratio, best_cut(weights[stays], test["good"].to_numpy(bool)[stays], clean_cost), toxicity.above(most))


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise that depends on the id alone."""
    u = (F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, k: int, name: str = "key", bins: int = 1024, few: int = 4096) -> float:
    """The k-th largest value, by counting in ever smaller ranges."""
    column = F.col(name)
    low, high = values.agg(F.min(column), F.max(column)).first()
    while True:
        inside = values.filter(column.between(low, high))
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            return high
        bin_of = F.least(F.floor((column - low) / width), F.lit(bins - 1))
        rows = inside.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r["b"]):
            if k <= r["n"]:
                break
            k -= r["n"]
        low, high = r["low"], r["high"]
        if low == high:
            return low
        if r["n"] <= few:
            return sorted((x[0] for x in values.filter(column.between(low, high)).select(column).collect()), reverse=True)[k - 1]


def keyed(docs: DataFrame, model: Model, *keep: Column, doc_id: str = "doc_id", text: str = "text", seed: int = 5) -> DataFrame:
    noise = gumbel(F.col(doc_id), seed).alias("__noise")
    rows = with_weight(docs, model.ratio, F.struct(*keep).alias("__kept"), noise, text=text, toxic=model.toxic)
    return rows.select(F.col("__kept"), "log_weight", (F.col("log_weight") + F.col("__noise")).alias("key"), (F.col("toxicity") > 0).alias("toxic"))


def least_key(keys: DataFrame, model: Model) -> float:
    """The key of the last document of the sample; documents with an equal key stay too, toxic ones do not count."""
    clean = keys.filter(~F.col("toxic"))
    k = clean.filter(F.col("log_weight") >= F.lit(model.cut)).count()
    return kth_largest(clean, k) if k else float("inf")


def resample(docs: DataFrame, model: Model, *keep: Column, doc_id: str = "doc_id", text: str = "text", seed: int = 5) -> DataFrame:
    """The sample: the kept columns, log_weight and key of the chosen documents.

    Repeated documents have the same key and stay or go together.  With no
    labels to learn from, all documents stay.
    """
    keys = checkpoint(keyed(docs, model, *keep, doc_id=doc_id, text=text, seed=seed))
    return keys.filter(~F.col("toxic") & (F.col("key") >= F.lit(least_key(keys, model)))).select("__kept.*", "log_weight", "key")


def accepted(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", seed: int = 5) -> DataFrame:
    """The documents of the sample with all their columns; docs are read twice, as files or checkpoints can be."""
    plain = numbered(docs, F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keys = checkpoint(keyed(plain, model, F.col("row"), seed=seed).select("__kept.row", "log_weight", "key", "toxic"))
    drop = keys.filter(F.col("toxic") | (F.col("key") < F.lit(least_key(keys, model)))).select("row")
    whole = numbered(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return whole.join(drop, "row", "left_anti").select("doc.*")
