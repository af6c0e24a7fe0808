"""Near-duplicate join by chosen paths (Christiani and Pagh).

A document is its set of five-word shingles, a sample of which stands for it:
``COORDINATES`` smallest hashes, each a shingle that two sets share with the
probability of their Jaccard similarity.  In each run all sets start in one
bucket.  A bucket chooses, by its own hash, each coordinate with probability
1 / (similarity * COORDINATES), and its sets go on to one bucket per chosen
coordinate and value.  Sets of the asked similarity stay together somewhere
with a known probability, others drift apart.  Runs are repeated until the
asked recall.

Buckets at the end of the paths are small; there all pairs are compared by
bit sketches, which leaves loose clusters.  In those every pair is checked
exactly on whole shingle sets, by blocks of bounded size, so classes and
numbers of links are exact within clusters.  Equal texts are one set with a
number of copies from the start.  No step emits a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, exp, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wardline.llm.common import chunks, lean, numbered
from wardline.llm.shingles import mixed, shingles, word_codes
from wardline.session import checkpoint

COORDINATES = 128
CHUNK = 4 << 20
#: Sets and words in a block of a cluster.
BLOCK_SETS, BLOCK_WORDS = 1024, 1 << 20
#: Bits of the filter that tells which texts the check needs.
FILTER_BITS = 1 << 24
_A = (mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32) | np.uint32(1)
_B = mixed(np.arange(1001, COORDINATES + 1001, dtype=np.uint64)).astype(np.uint32)
_I = mixed(np.arange(5001, COORDINATES + 5001, dtype=np.uint64))


def runs_needed(depth: int, recall: float) -> int:
    """Runs until two sets of exactly the asked similarity meet with probability ``recall``.

    They share one child bucket on average per level, so the number they
    share is a critical branching process with Poisson offspring.
    """
    lost = 0.0
    for _ in range(depth):
        lost = exp(lost - 1)
    return ceil(log(1 - recall) / log(lost))


def missed(depth: int, runs: int, similarity: float, most: int) -> float:
    """The share of pairs of exactly the similarity that are not found.

    The number of coordinates that two sets share is binomial; it sets how
    many child buckets they share on average, in all runs, and how many bits
    of their sketches can differ, of which ``most`` may.
    """
    found = 0.0
    for same in range(COORDINATES + 1):
        lost, differ = 0.0, COORDINATES - same
        for _ in range(depth):
            lost = exp(same / (similarity * COORDINATES) * (lost - 1))
        chance = comb(COORDINATES, same) * similarity**same * (1 - similarity)**differ
        found += chance * sum(comb(differ, u) for u in range(min(most, differ) + 1)) / 2**differ * (1 - lost**runs)
    return 1 - found


def plan(depth: int, recall: float, similarity: float, least: int = 0) -> tuple[int, int]:
    """Unequal bits to allow, ``least`` or more, and runs, so that pairs of exactly the similarity are found with ``recall``.

    The sketches may lose a tenth of what is allowed to be lost.
    """
    most = least
    while missed(1, 1 << 30, similarity, most) > (1 - recall) / 10 and most < COORDINATES:
        most += 1
    runs = runs_needed(depth, recall)
    while missed(depth, runs, similarity, most) > 1 - recall:
        runs += 1
    return most, runs


def depth_for(n: int) -> int:
    """Levels: one more for each thousandfold of sets.

    A level leaves similarity / 0.8 of the meetings of less similar sets, so
    this many keep those of unrelated ones apart.  Each level multiplies the
    paths by 1.25 and needs more runs; the recall is that of ``plan`` at any.
    """
    return max(3, ceil(log(max(n, 1), 1000)) + 2)


# --- per document --------------------------------------------------------------------

def signature(sh: np.ndarray) -> np.ndarray:
    """The smallest of COORDINATES hashes of the shingles."""
    x = (sh >> np.uint64(32)).astype(np.uint32)[:, None]
    low = np.full(COORDINATES, np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 4096):
        low = np.minimum(low, (x[i:i + 4096] * _A + _B).min(0))
    return low


def sketch(signatures: np.ndarray) -> np.ndarray:
    """One bit per coordinate, as two 64-bit numbers per set."""
    bits = (mixed(signatures.astype(np.uint64) + _I) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def paths(signatures: np.ndarray, similarity: float, depth: int, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Set number and bucket at the end of each path."""
    n = len(signatures)
    who = np.tile(np.arange(n), runs)
    bucket = np.repeat(mixed(np.arange(1, runs + 1, dtype=np.uint64)), n)
    limit = np.uint64(2**64 / (similarity * COORDINATES))
    for _ in range(depth):
        children = []
        for i in range(0, len(who), 1 << 14):
            at, c = np.nonzero(mixed(bucket[i:i + (1 << 14), None] + _I) < limit)
            value = signatures[who[i + at], c].astype(np.uint64)
            children.append((who[i + at], mixed(bucket[i + at] ^ mixed(value + _I[c]))))
        who, bucket = (np.concatenate(x) for x in zip(*children)) if children else (who[:0], bucket[:0])
    return who, bucket


def described(docs: DataFrame, similarity: float, depth: int, runs: int, k: int, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, f1, f2, words, s1, s2, buckets): 128 bits that tell texts apart by their words, and the paths."""
    chosen = numbered(docs, F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = ["row", "doc_id", "f1", "f2", "words", "s1", "s2", "buckets"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(2), CHUNK):
                rows = batch.slice(part.start, part.stop - part.start)
                codes, counts = word_codes(rows.column(2))
                sh, many = shingles(codes, counts, k)
                last, end = np.cumsum(counts).tolist(), np.cumsum(many).tolist()
                prints = np.zeros((len(counts), 2), np.int64)
                sigs = np.zeros((len(counts), COORDINATES), np.uint32)
                for i in np.flatnonzero(counts).tolist():
                    data = codes[last[i] - counts[i]:last[i]].tobytes()
                    prints[i] = np.frombuffer(xxhash.xxh3_128_digest(data), np.int64)
                    sigs[i] = signature(sh[end[i] - many[i]:end[i]])
                bits = sketch(sigs)
                some = np.flatnonzero(counts)
                who, bucket = paths(sigs[some], similarity, depth, runs)
                order = np.argsort(who, kind="stable")
                sizes = np.zeros(len(counts), np.int64)
                sizes[some] = np.bincount(who, minlength=len(some))
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(bucket[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(prints[:, 0]), pa.array(prints[:, 1]),
                                                  pa.array(counts), pa.array(bits[:, 0]), pa.array(bits[:, 1]), lists], names)
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(lean(describe), f"row long, doc_id {kind}, f1 long, f2 long, words long, s1 long, s2 long, buckets array<long>")


# --- buckets -------------------------------------------------------------------------

def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of two rows or more with equal first ``keys`` columns of a sorted stream; only one run is held over."""
    held: list[pa.RecordBatch] = []

    def closed():
        if sum(h.num_rows for h in held) > 1:
            yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if held and any(held[0].column(i)[0] != batch.column(i)[0] for i in range(keys)):
            yield from closed()
        change = np.zeros(n - 1, bool)
        for i in range(keys):
            v = batch.column(i).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [n]])
        if len(cuts) > 2:
            held.append(batch.slice(0, cuts[1]))
            yield from closed()
            for j in np.flatnonzero(np.diff(cuts)[1:-1] > 1) + 1:
                yield batch.slice(cuts[j], cuts[j + 1] - cuts[j])
        held.append(batch.slice(cuts[-2]))
    yield from closed()


def root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(parent, x), root(parent, y)
        if x != y:
            parent[max(x, y)] = min(x, y)


def loose_clusters(bits: np.ndarray, most: int) -> np.ndarray:
    """For each sketch the first of its cluster; pairs with at most ``most`` unequal bits are linked.

    Sets near the first open one join it at once, so only pairs of different
    clusters are left to compare.
    """
    n = len(bits)
    bits = bits.view(np.uint64)

    def near(i, others):
        return np.bitwise_count(bits[others] ^ bits[i]).sum(1, dtype=np.int64) <= most
    label = np.full(n, -1)
    left = np.arange(n)
    while len(left):
        hit = near(left[0], left)
        label[left[hit]] = left[0]
        left = left[~hit]
    heads = np.unique(label)
    if len(heads) == 1:
        return label
    parent = np.arange(n)
    for i in range(n):  # each pair of different clusters once
        others = np.flatnonzero(label[i + 1:] != label[i]) + i + 1
        hit = others[near(i, others)]
        if len(hit):
            unite(parent, np.full(len(hit), label[i]), label[hit])
    return np.array([root(parent, x) for x in label.tolist()])


def candidate_links(sets: DataFrame, most: int) -> DataFrame:
    """(a, b), a > b: sets of a bucket and the first of their loose cluster there, each once."""
    rows = sets.select(F.explode("buckets").alias("bucket"), "set", "s1", "s2")
    shared = rows.repartition("bucket").sortWithinPartitions("bucket", "set")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 1):
            bits = np.stack([group.column(2).to_numpy(), group.column(3).to_numpy()], axis=1)
            first = loose_clusters(np.ascontiguousarray(bits), most)
            who = group.column(1).to_numpy()
            real = first != np.arange(len(first))
            if real.any():
                yield pa.RecordBatch.from_arrays([pa.array(who[real]), pa.array(who[first[real]])], ["a", "b"])
    found = shared.mapInArrow(lean(link), "a long, b long")
    return found.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's connected component.

    Large and small stars in turn (Kiveris and others); the links are never
    on the driver, and lineage is cut each round.
    """
    links = checkpoint(links.select("a", "b"))
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        small = checkpoint(small)
        if links.count() == small.count() and links.exceptAll(small).isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        links = small


# --- exact check ---------------------------------------------------------------------

def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common, from tables of bounded width."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)
    column = np.cumsum(first) - 1
    often = np.bincount(column)[column] > 1 if len(values) else first
    owner, column = owner[often], column[often]
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1 if len(column) else column
    out = np.zeros((n, n), np.float32)
    width = max(256, (1 << 22) // max(1, n))
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for a, b, low in zip(cuts, cuts[1:], range(0, 1 << 62, width)):
        table = np.zeros((n, width), np.float32)
        table[owner[a:b], column[a:b] - low] = 1
        out += table @ table.T
    return out


def exact_links(sets: list[np.ndarray], side: np.ndarray, copies: np.ndarray, similarity: float, within: bool):
    """Number of links of each set, and the first of its class here; only across sides unless ``within``."""
    common = shared_counts(sets).astype(np.float64)
    sizes = np.array([len(s) for s in sets], np.float64)
    linked = common * (1 + similarity) >= similarity * (sizes[:, None] + sizes[None, :]) - 1e-6
    np.fill_diagonal(linked, False)
    if not within:
        linked &= side[:, None] != side[None, :]
    number = linked @ copies
    label = np.arange(len(sets))
    while True:  # smallest label among linked sets, until nothing changes
        low = np.minimum(label, np.where(linked, label[None, :], len(sets)).min(1, initial=len(sets)))
        low = np.minimum(low, low[low])
        if (low == label).all():
            return number, label
        label = low


def wanted(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The texts of members, and few others that have their bit in a table of bounded size, which goes to all tasks.

    So only these are shuffled to their members, not all texts.
    """
    place = F.pmod(F.xxhash64("set"), F.lit(FILTER_BITS))
    bit = F.pmod(place, F.lit(64)).cast("int")
    word = F.shiftright(place, 6).cast("int")
    marks = members.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("marks"))
    return (texts.withColumn("word", word).join(F.broadcast(marks), "word")
            .filter(F.call_function("shiftrightunsigned", F.col("marks"), bit).bitwiseAND(1) == 1).drop("word", "marks"))


def checked(members: DataFrame, docs: DataFrame, text: str, similarity: float, k: int) -> DataFrame:
    """(set, n, first): exact links of each set within a pair of blocks of its cluster.

    members: (set, cluster, copies, blocks, words).  A cluster of several
    blocks is met as pairs of blocks, each of bounded size.
    """
    texts = numbered(docs, F.col(text).cast("string").alias("text")).withColumnRenamed("row", "set")
    own = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    rows = (wanted(texts, members).join(members, "set").withColumn("side", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
            .select("cluster", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "set", "side", "copies", "text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(6), CHUNK):
                some = batch.slice(part.start, part.stop - part.start)
                sh, many = shingles(*word_codes(some.column(6)), k)
                end = np.cumsum(many)
                sets = [np.unique(sh[b - n:b]).tobytes() for b, n in zip(end.tolist(), many.tolist())]
                yield pa.RecordBatch.from_arrays([*some.columns[:6], pa.array(sets, pa.binary())], names)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 3):
            who, side, copies = (group.column(i).to_numpy() for i in (3, 4, 5))
            sets = [np.frombuffer(s, np.uint64) for s in group.column(6).to_pylist()]
            n, first = exact_links(sets, side, copies.astype(np.float64), similarity, group.column(1)[0] == group.column(2)[0])
            real = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(who[real]), pa.array(n[real].astype(np.int64)), pa.array(who[first[real]])], ["set", "n", "first"])

    names = ["cluster", "i", "j", "set", "side", "copies", "shingles"]
    cutup = rows.mapInArrow(lean(cut), "cluster long, i int, j int, set long, side int, copies long, shingles binary")
    return (cutup.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
            .mapInArrow(lean(check), "set long, n long, first long"))


# --- the join ------------------------------------------------------------------------

def near_duplicates(docs: DataFrame, similarity: float = 0.8, recall: float = 0.9999, k: int = 5, doc_id: str = "doc_id",
                    text: str = "text", slack: float = 0.19, depth: int | None = None, runs: int | None = None) -> DataFrame:
    """(row, doc_id, class_id, n_links, first): one row per document.

    n_links is the number of other documents of at least the similarity (of
    sets of k-word shingles; equal words in order count as 1), classes are
    joined by links, class_id is the smallest doc_id of the class and
    ``first`` tells its first row, that of the smallest doc_id.  Null texts
    and texts without words link to nothing and are classes of their own.
    docs are read twice and must come in the same order, as files do.
    """
    depth = depth or depth_for(docs.count())
    # One bit differs with probability (1 - J) / 2.
    most, needed = plan(depth, recall, similarity, int(COORDINATES * (1 - similarity + slack) / 2))
    runs = runs or needed
    every = checkpoint(described(docs, similarity, depth, runs, k, doc_id, text))
    worded = every.filter("words > 0")
    sets = checkpoint(worded.groupBy("f1", "f2").agg(
        F.min("row").alias("set"), F.count("*").alias("copies"),
        F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("id"), F.col("row").alias("row"))).alias("lead"), F.first("words").alias("words"),
        F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("buckets").alias("buckets")))
    loose = components(candidate_links(sets, most))
    clusters = loose.unionByName(loose.select(F.col("root").alias("node"), "root").distinct())
    sized = sets.select("set", "copies", "words").join(clusters.withColumnRenamed("node", "set"), "set")
    blocks = sized.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("words") / BLOCK_WORDS)).alias("blocks"))
    members = checkpoint(sized.join(blocks, "root").select("set", F.col("root").alias("cluster"), "copies", "blocks"))
    links = checkpoint(checked(members, docs, text, similarity, k))
    exact = components(links.filter("set <> first").select(F.greatest("set", "first").alias("a"), F.least("set", "first").alias("b")).distinct())
    numbers = links.groupBy("set").agg(F.sum("n").alias("n"))
    # Classes are worked out per set; documents only look up their own set.
    rooted = sets.select("set", "lead").join(exact.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    leads = checkpoint(rooted.groupBy("root").agg(F.min("lead").alias("lead")))
    known = (sets.select("f1", "f2", "set", "copies").join(rooted.select("set", "root"), "set").join(leads, "root").join(numbers, "set", "left")
             .select("f1", "f2", "lead", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    lone = F.col("words") == 0
    return every.select("row", "doc_id", "f1", "f2", "words").join(known, ["f1", "f2"], "left").select(
        "row", "doc_id", F.when(lone, F.col("doc_id")).otherwise(F.col("lead.id")).alias("class_id"),
        F.when(lone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), (lone | (F.col("lead.row") == F.col("row"))).alias("first"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The first document of every class, with all its columns."""
    drop = near_duplicates(docs, **options).filter(~F.col("first")).select("row")
    whole = numbered(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return whole.join(drop, "row", "left_anti").select("doc.*")
