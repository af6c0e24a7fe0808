"""How the sources of a language differ, in words and as a whole.

Terms are counted by chunk of texts, then by (language, source, term); those in
enough documents of their language are kept.  Shares are smoothed and exact
integers (parts of 10**9).

**Words a source over-uses.**  The gain of a term in a group grows with its
count there and falls with its count in the language, and ties go to the
earlier term.  So a term with at least k others that have a count in the group
as high, a count in the language as low and come earlier cannot be among the
first k, whatever the totals are.  Each partition keeps the terms of each group
that fewer than k others dominate so (its k-skyband), the skybands are merged
into one per group and part, and only what is left is valued and ranked.
(Papadias et al., "Progressive skyline computation", on skybands.)

**Distance of sources.**  The sources of a language are numbered and cut into
blocks; tasks get the terms of two blocks and one share of the vocabulary and
add up the differences of all pairs in them as matrices.  Terms that neither
source has follow from the number of kept terms.

Defined cases: null text, lang or source counts as empty text; '' is a language
and a source; repeated rows are documents of their own; a group without terms
has all its pairs, at the smoothed shares; a language without kept terms has
pairs of value 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wardline.llm.common import chunks, large
from wardline.session import checkpoint

LEAST_DOCS, TOP, SMOOTH, SCALE = 30, 50, 5, 10**9
#: Bytes of text counted together; a longer text is cut between terms.
CHUNK = 8 << 20
#: Groups up to which their totals are broadcast; sources of a block; terms of a group valued together.
BROADCAST_GROUPS, BLOCK, ROWS = 100_000, 256, 100_000
#: Parts a group's skybands are merged in.
MERGES = 16

# What a byte of a term becomes; 0 is not in terms: letters (A-Z lowered) and all beyond ASCII.
_BYTES = np.zeros(256, np.uint8)
_BYTES[97:123] = np.arange(97, 123)
_BYTES[65:91] = np.arange(97, 123)
_BYTES[128:] = np.arange(128, 256)


# --- counts -----------------------------------------------------------------------

def cut_terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different terms, and each term's number and text."""
    low = _BYTES[raw]
    inside = low != 0
    edge = offsets[:-1][offsets[:-1] < len(raw)]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]  # texts lie side by side
    last[:-1] &= ~inside[1:]
    last[edge[edge > 0] - 1] = inside[edge[edge > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    places = np.append(0, np.cumsum(ends - starts))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(low[inside])]).dictionary_encode()
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return words.dictionary, words.indices.to_numpy(), text


def counted(raw: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Term, group, occurrences and documents, for texts of the given groups."""
    terms, number, text = cut_terms(raw, offsets)
    n = max(1, len(terms))
    seen, times = np.unique(text * n + number, return_counts=True)
    pair, where = np.unique(group[seen // n] * n + seen % n, return_inverse=True)
    occurrences = np.bincount(where, times, len(pair)).astype(np.int64)
    return terms.take(pa.array(pair % n)), pair // n, occurrences, np.bincount(where, minlength=len(pair))


def parts_of(raw: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """A long text cut between terms."""
    while len(raw) > size:
        gaps = np.flatnonzero(_BYTES[raw[:size]] == 0)
        cut = int(gaps[-1]) + 1 if len(gaps) else size
        while not len(gaps) and cut < len(raw):  # one term longer than a part
            gaps = np.flatnonzero(_BYTES[raw[cut:cut + size]] == 0)
            cut = cut + (int(gaps[0]) + 1 if len(gaps) else size)
        yield raw[:cut]
        raw = raw[cut:]
    yield raw


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), added up over all documents."""
    names = ["lang", "source", "term", "n", "docs"]
    size = CHUNK

    def rows(batch: pa.RecordBatch, group: np.ndarray, found: tuple, docs: np.ndarray | None = None) -> pa.RecordBatch:
        term, where, n, many = found
        at = pa.array(group[where])
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), term.cast(pa.string()), pa.array(n),
                                           pa.array(many if docs is None else docs)], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [batch.column(i).dictionary_encode() for i in (0, 1)]
            keys = both[0].indices.to_numpy().astype(np.int64) * max(1, len(both[1].dictionary)) + both[1].indices.to_numpy()
            _, group, of_row = np.unique(keys, return_index=True, return_inverse=True)  # a row of each group stands for it
            for part in chunks(batch.column(2), size):
                texts = large(batch.column(2)[part])
                offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
                data = texts.buffers()[2]
                raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
                if len(raw) <= size:
                    yield rows(batch, group, counted(raw, offsets - offsets[0], of_row[part]))
                    continue
                met: set[str] = set()  # the terms of one text: it counts once for each
                for piece in parts_of(raw, size):
                    found = counted(piece, np.array([0, len(piece)]), of_row[part])
                    fresh = [t not in met for t in found[0].to_pylist()]
                    met.update(found[0].to_pylist())
                    yield rows(batch, group, found, np.array(fresh, np.int64))

    chosen = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = chosen.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Counts of the kept terms, with the language's count; ``lead`` marks one row of each term of a language."""
    term = W.partitionBy("lang", "term")
    return (counts.withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term), "lead": F.col("source") == F.min("source").over(term)})
            .filter(F.col("lang_docs") >= least_docs).drop("docs", "lang_docs"))


def share(count, total, terms, smooth: int = SMOOTH) -> Column:
    """1 + floor(10**9 (count + s) / (total + s terms)), exactly; null without terms."""
    wide = "decimal(38,0)"
    above = (F.lit(SCALE).cast("decimal(10,0)") * (count + F.lit(smooth)).cast("decimal(20,0)")).cast(wide)
    below = (total + F.lit(smooth) * terms).cast("decimal(20,0)")
    return 1 + F.call_function("div", above, F.nullif(below, F.lit(0).cast("decimal(20,0)")).cast(wide))


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Per (lang, source) that occurs: number in its language, total, kept terms, the language's total and rows, share of a term it lacks."""
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"), F.count_if("lead").alias("terms"))
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("total", "rows", "terms")}
    lang = W.partitionBy("lang")
    found = groups.join(own, ["lang", "source"], "left").withColumns(zero).withColumns({
        "number": F.row_number().over(lang.orderBy("source")).cast("long") - 1, "sources": F.count("*").over(lang),
        "terms": F.sum("terms").over(lang), "lang_total": F.sum("total").over(lang), "lang_rows": F.sum("rows").over(lang)})
    return found.withColumn("lacking", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).drop("rows")


# --- words a source over-uses -----------------------------------------------------

def skyband(high: np.ndarray, low: np.ndarray, early: np.ndarray, k: int) -> np.ndarray:
    """Which points fewer than k others dominate: high as high, low as low, early as early.

    A point's dominators come before it in the order of (high, low, early).  One
    that k dominate is dominated by k points of the skyband, so it is enough to
    count those, and a rejected point that dominates another has k dominators
    of that one too.
    """
    order = np.lexsort((early, low, -high))
    a, b = low[order], early[order]
    kept = np.zeros(0, np.int64)
    for first in range(0, len(order), 512):
        at = np.arange(first, min(first + 512, len(order)))
        many = ((a[kept] <= a[at, None]) & (b[kept] <= b[at, None])).sum(1)
        at, many = at[many < k], many[many < k]
        near = np.tril((a[at] <= a[at, None]) & (b[at] <= b[at, None]), -1).sum(1)
        kept = np.concatenate([kept, at[many + near < k]])
    return np.sort(order[kept])


def skybands(rows: DataFrame, k: int) -> DataFrame:
    """Within each partition, the k-skyband of every group's rows."""

    def of_group(held: pa.Table) -> pa.Table:
        early = np.empty(held.num_rows, np.int64)
        early[pc.sort_indices(held["term"]).to_numpy()] = np.arange(held.num_rows)  # by bytes
        return held.take(pa.array(skyband(held["n"].to_numpy(), held["lang_n"].to_numpy(), early, k)))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], pa.Table] = {}
        for batch in batches:  # the skyband of a skyband and more rows is that of all
            new = pa.Table.from_batches([batch])
            both = [batch.column(i).dictionary_encode() for i in (0, 1)]
            keys = both[0].indices.to_numpy().astype(np.int64) * max(1, len(both[1].dictionary)) + both[1].indices.to_numpy()
            order = np.argsort(keys, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1) if len(order) else []:
                key = (batch.column(0)[at[0]].as_py(), batch.column(1)[at[0]].as_py())
                mine = new.take(pa.array(at))
                held[key] = of_group(pa.concat_tables([held[key], mine]) if key in held else mine)
        for table in held.values():
            yield from table.combine_chunks().to_batches()

    return rows.mapInArrow(within, "lang string, source string, term string, n long, lang_n long")


def overused(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): the terms whose share in a group is furthest above that in the language."""
    band = skybands(kept.select("lang", "source", "term", "n", "lang_n"), top)
    band = skybands(band.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(MERGES))), top)
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    valued = band.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), (share(F.col("n"), F.col("total"), F.col("terms")) - q).alias("value"))
    return ranked(valued.filter("value > 0")).filter(F.col("rank") <= top)


def ranked(rows: DataFrame) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


# --- distance of sources ----------------------------------------------------------

def differences(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """[i, j]: sum over the rows of |one[:, i] - two[:, j]|."""
    return np.stack([np.abs(two - one[:, i:i + 1]).sum(0) for i in range(one.shape[1])])


def block_differences(rows: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Sums over the terms of one share of the vocabulary, for all pairs of two blocks of sources.

    rows: number (of the source), term, p.  sources: number, lacking, block.
    """
    if sources.empty:
        return pd.DataFrame({"one": [], "two": [], "total": [], "seen": []}, dtype="int64")
    sources = sources.sort_values("number")
    numbers, lacking = sources["number"].to_numpy(), sources["lacking"].to_numpy(np.int64)
    block = sources["block"].to_numpy()
    one, two = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    term, known = pd.factorize(rows["term"])
    column = np.searchsorted(numbers, rows["number"].to_numpy())
    total = np.zeros((len(one), len(two)), np.int64)
    order = np.argsort(term, kind="stable")
    term, column, p = term[order], column[order], rows["p"].to_numpy()[order]
    step = max(1, (1 << 22) // len(numbers))
    for first in range(0, len(known), step):
        low, high = np.searchsorted(term, [first, first + step])
        shares = np.tile(lacking, (min(step, len(known) - first), 1))
        shares[term[low:high] - first, column[low:high]] = p[low:high]
        total += differences(shares[:, one], shares[:, two])
    i, j = np.meshgrid(one, two, indexing="ij")
    use = (i < j).ravel()
    return pd.DataFrame({"one": numbers[i.ravel()[use]], "two": numbers[j.ravel()[use]], "total": total.ravel()[use], "seen": len(known)})


def distances(kept: DataFrame, groups: DataFrame, block: int = BLOCK, rows_together: int = ROWS) -> DataFrame:
    """(lang, source, item, value, rank): each source's distance to every other of its language."""
    parts = F.ceil(F.col("lang_rows") / F.lit(rows_together))  # of the vocabulary
    blocks = F.ceil(F.col("sources") / F.lit(block))
    own = F.floor(F.col("number") / F.lit(block))
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    keys = ["lang", "low", "high", "part"]

    def meeting(df: DataFrame, *cols) -> DataFrame:
        return df.withColumn("other", other).withColumns({"low": F.least(own, "other"), "high": F.greatest(own, "other")}).select(*keys, *cols)

    p = share(F.col("n"), F.col("total"), F.col("terms"))
    rows = kept.select("lang", "source", "term", "n").join(groups, ["lang", "source"]).withColumns(
        {"p": p, "part": F.pmod(F.xxhash64("term"), parts)})
    left = meeting(rows, "number", "term", "p")
    again = groups.select(*[F.col(c).alias(c) for c in groups.columns])  # columns of its own
    right = meeting(again.filter("terms > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)) - 1))),
                    "number", "lacking", own.alias("block"))

    def both(key: tuple, rows: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        found = block_differences(rows, sources)
        found.insert(0, "lang", key[0])
        return found

    sums = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
            .applyInPandas(both, "lang string, one long, two long, total long, seen long")
            .groupBy("lang", "one", "two").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen")))
    a, b = (groups.select("lang", F.col("number").alias(n), F.col("source").alias(s), F.col("lacking").alias(z), *more)
            for n, s, z, more in (("one", "source_a", "z_a", ["terms"]), ("two", "source_b", "z_b", [])))
    valued = sums.join(a, ["lang", "one"]).join(b, ["lang", "two"]).withColumn(
        "value", F.col("total") + (F.col("terms") - F.col("seen")) * F.abs(F.col("z_a") - F.col("z_b")))
    # A language without kept terms: its pairs are all equal, whatever their order.
    bare = groups.filter("terms = 0")
    plain = bare.select("lang", F.col("source").alias("source_a")).join(
        bare.select("lang", F.col("source").alias("source_b")), "lang").filter("source_a < source_b").withColumn("value", F.lit(0).cast("long"))
    pairs = valued.select("lang", "source_a", "source_b", "value").unionByName(plain)
    way = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")),
                            F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    return ranked(pairs.withColumn("way", way).select("lang", "way.source", "way.item", "value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` and ``term``."""
    kept = checkpoint(kept_terms(term_counts(docs), least_docs))
    groups = checkpoint(group_totals(docs, kept))
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    pairs = distances(kept, groups).withColumn("part", F.lit("pair"))
    words = overused(kept, groups, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(words).select("lang", "source", "part", "item", "value", "rank")
