"""Removal of repeated and near-repeated lines by an exact set-similarity join.

A line is the set of its words.  Words are ordered by rarity; two lines of
Jaccard similarity t or more share a word among the first
n - ceil(t n) + 1 of their n words, so lines meet by those words only.
Where the shared word is a frequent one, lines meet by two frequent words
among the first n - ceil(t n) + 2 instead, which similar lines share as well;
so few meetings grow with the most frequent words.  Rows are counted by key
first, and a key with more than ``HOT_ROWS`` is cut into blocks that meet as
pairs, so no task holds a whole key.  Length, position and a
bit map (the symmetric difference is at least the number of unequal bits) rule
out most pairs, and the rest are checked on whole sets.

Of equal sets the first line in (doc_id, row, line) order stays if no earlier
line is similar to it; all others go.  Words are told apart by 63 bits of a
hash, equal sets by the words' 64-bit sum, their number and their bit map.  A
line passes on its few nearest candidates under each key, so candidates grow
with the lines, not with the pairs in a group; lines whose nearest fail while
others remain are compared with all lines they share a key with.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from wardline.llm.chosen_path import groups_of
from wardline.llm.common import chunks, large, lean, numbered
from wardline.llm.shingles import cut_words, line_words, mixed
from wardline.session import checkpoint

CHUNK = 4 << 20
#: Rows that meet in one bucket, about; partitions that buckets are dealt to, at most.
BUCKET_ROWS, MOST_PARTITIONS = 100_000, 1 << 16
#: Frequent words have one part in so many of all words: as many parts as words / SHARE, within bounds.
SHARE, LEAST_PARTS, MOST_PARTS = 512, 1024, 1 << 17
#: Candidates of a line that are kept if the nearest is very near, and if it isn't; pairs held before only those are kept.
FIRST, NEAREST, HELD_PAIRS = 2, 4, 1 << 19
#: Rows of a group from which a row's search ends when its nearest are very near, and candidates kept there.
LARGE, NEAREST_LARGE = 1024, 64
#: Words up to which the lines of the last round are broadcast; beyond, lines come to them by a shuffle.
BROADCAST_WORDS = 2_000_000
#: Rows of one key that meet in one place, about; slots in which keys are counted, as bits at least, and words for each slot beyond.
HOT_ROWS, SLOT_BITS, SLOT_WORDS = 1 << 14, 18, 20_000
#: One part in so many of HOT_ROWS may be missing from the count of a slot.
UNCOUNTED = 8
#: Rows that are dealt out at once.
DEALT = 1 << 18
#: Sizes up to which a line's bit map has 64, 128 and 256 bits; longer lines have 512.
MAP_SIZES = np.array([64, 128, 256])
#: Removed lines up to which their list is broadcast; a longer one is joined by a shuffle.
BROADCAST_LINES = 2_000_000
#: Bits of the filter that tells which lines the check needs.
FILTER_BITS = 1 << 24
LAST = 2**63 - 1
#: The bit that numbers of frequent words have.
FREQUENT_WORD = np.uint64(1 << 63)


def frequent_words(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Codes of frequent words, rarest first, at most MOST_PARTS; and the number of all words.

    A chunk passes on the words that could be frequent, so a word's count may
    lack what chunks have too little of it to tell.  Any order is exact.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(0), CHUNK):
                codes, ids = cut_words(batch.column(0)[part])[:2]
                n = np.bincount(ids, minlength=len(codes))
                often = n >= max(1, len(ids) / (2 * MOST_PARTS))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(codes[often].view(np.int64), 0)), pa.array(np.append(n[often], 0)),
                                                  pa.array(np.append(np.zeros(int(often.sum()), np.int64), len(ids)))], ["word", "n", "all"])
    counts = checkpoint(docs.select(F.col(text).cast("string")).mapInArrow(lean(count), "word long, n long, all long")
                        .groupBy("word").agg(F.sum("n").alias("n"), F.sum("all").alias("all")))
    total = counts.agg(F.sum("all")).first()[0] or 0
    parts = min(MOST_PARTS, max(LEAST_PARTS, total // SHARE))
    rows = counts.filter((F.col("n") > 0) & (F.col("n") * parts >= total)).orderBy("n", "word").select("word").toArrow()
    return rows.column("word").to_numpy().view(np.uint64), int(total)


class Order:
    """Numbers of words by which lines are sorted: rare ones by hash, then frequent ones, rarest first."""

    def __init__(self, frequent: np.ndarray):
        self.at = np.argsort(frequent)
        self.codes = frequent[self.at]

    def numbers(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each code, and whether it is a frequent word's."""
        if not len(self.codes):
            return codes >> np.uint64(1), np.zeros(len(codes), bool)
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[place] == codes
        return np.where(known, FREQUENT_WORD | self.at[place].astype(np.uint64), codes >> np.uint64(1)), known


def line_sets(codes: np.ndarray, line: np.ndarray, ids: np.ndarray, order: Order):
    """Each line's different words in order: line, word number, whether frequent."""
    number, frequent = order.numbers(codes)
    rising = np.argsort(number)
    rank = np.empty(len(rising), np.int64)
    rank[rising] = np.arange(len(rising))
    key = line * max(1, len(codes)) + rank[ids]
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    word = rising[key % max(1, len(codes))]
    return key // max(1, len(codes)), number[word], frequent[word]


def prefix_sizes(n: np.ndarray, similarity: float) -> np.ndarray:
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def overlap_needed(total: np.ndarray, similarity: float) -> np.ndarray:
    return np.ceil(similarity / (1 + similarity) * total - 1e-9).astype(np.int64)


def map_words(n: np.ndarray) -> np.ndarray:
    """64-bit words in the bit map of a set of n."""
    return 1 << np.searchsorted(MAP_SIZES, n)


def bit_maps(word: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Eight words per set: its bit map, whose bits are the parity of how many words have them, then zeros.

    A map folds into one of half the size by exclusive or of its halves.
    """
    h = mixed(word + np.uint64(7))
    wide = np.repeat(map_words(n), n).astype(np.uint64)
    place = (h >> np.uint64(6)) & (wide - np.uint64(1))
    bit = np.uint64(1) << (h & np.uint64(63))
    out = np.zeros((len(n), 8), np.uint64)
    out[:, 0] = np.bitwise_xor.reduceat(np.where(place == 0, bit, np.uint64(0)), start)
    for w in (1, 2, 4):  # words w to 2 w - 1 are those of larger sets alone
        some = np.flatnonzero(map_words(n) > w)
        if len(some):
            many = n[some]
            first = np.cumsum(many) - many
            at = np.repeat(start[some] - first, many) + np.arange(many.sum())
            own, bits = place[at], bit[at]
            for v in range(w, 2 * w):
                out[some, v] = np.bitwise_xor.reduceat(np.where(own == np.uint64(v), bits, np.uint64(0)), first)
    return out


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """The maps' first ``words`` words after folding the rest onto them."""
    out = maps[:, :words].copy()
    for low in range(words, maps.shape[1], words):
        out ^= maps[:, low:low + words]
    return out


COLUMNS = ["key", "f", "n", "doc_id", "row", "line", "pos"]
KINDS = [np.uint32, np.uint64, np.int64, np.int64, np.int64, np.int64, np.int64]


def narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Least value and the differences to it, in as few bytes each as will do."""
    low = int(values.min())
    size = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if int(values.max()) - low <= np.iinfo(t).max)
    return low, (values.view(np.uint64) - np.uint64(low & (2**64 - 1))).astype(size).tobytes()


def packs(bucket: np.ndarray, columns: list[np.ndarray], maps: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
    """One row per bucket, with each column's values as bytes: first those of fixed width, then least values and differences.

    The bit maps are rows ``of`` of maps; only the words that a set of its size has are kept.
    """
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else [0]
    columns = [np.ascontiguousarray(c[order].astype(t)) for c, t in zip(columns, KINDS)]
    fixed, rest = columns[:2], columns[2:]
    of = of[order]
    words = map_words(rest[0])
    pool = maps[of][np.arange(8) < words[:, None]]
    last = np.append(0, np.cumsum(words))
    small = [[narrow(c[a:b]) for c in rest] for a, b in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays([
        pa.array(bucket[cuts[:-1]].astype(np.int32)),
        *[pa.array([c[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()) for c in fixed],
        pa.array([pool[last[a]:last[b]].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
        pa.array([[low for low, _ in r] for r in small], pa.list_(pa.int64())),
        *[pa.array([r[i][1] for r in small], pa.binary()) for i in range(len(rest))]],
        ["bucket", *COLUMNS[:2], "maps", "least", *COLUMNS[2:]])


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Bucket and columns of each row that ``packs`` made."""
    parts = [c.to_pylist() for c in batch.columns]
    for i, bucket in enumerate(parts[0]):
        n = len(parts[1][i]) // 4
        wide = []
        for low, data in zip(parts[4][i], (p[i] for p in parts[5:])):
            size = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(data) // n]
            wide.append((np.frombuffer(data, size).astype(np.uint64) + np.uint64(low & (2**64 - 1))).view(np.int64))
        words = map_words(wide[0])
        maps = np.zeros((n, 8), np.uint64)
        maps[np.arange(8) < words[:, None]] = np.frombuffer(parts[3][i], np.uint64)
        yield bucket, [*(np.frombuffer(p[i], t) for p, t in zip(parts[1:3], KINDS)), *wide, maps]


PACKED = "bucket int, key binary, f binary, maps binary, least array<long>, n binary, doc_id binary, row binary, line binary, pos binary"


def prefix_keys(word, frequent, start, n, use, similarity):
    """Set, key, place and first word of the rare words, and of the pairs of frequent words, by which the sets in ``use`` meet others."""
    keep = prefix_sizes(n, similarity)
    of = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(word)) - start[of]
    use = use[of] & (n[of] > 1)
    single = np.flatnonzero(use & (pos < keep[of]) & ~frequent)
    at, keys, places, homes = [of[single]], [word[single]], [pos[single]], [word[single]]
    # Frequent words come last, so two of them stand side by side or further apart at the end of the prefix.
    both = np.flatnonzero(use & (pos <= keep[of]) & frequent)
    gap = 1
    while len(both):
        both = both[both + gap < len(word)]
        other = both + gap
        fits = (of[other] == of[both]) & (pos[other] <= keep[of[both]])
        both, other = both[fits], other[fits]
        at.append(of[both]), keys.append(mixed(word[both]) + word[other]), places.append(np.zeros(len(both), np.int64))
        homes.append(word[both])
        gap += 1
    return np.concatenate(at), np.concatenate(keys), np.concatenate(places), np.concatenate(homes)


def set_codes(word: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A number for each set that follows from its words alone."""
    return mixed(np.add.reduceat(mixed(word), start))


class Spread:
    """The slots of keys with many rows, and how many blocks these are cut into; and the slots of first words with many rows."""

    def __init__(self, bits: int, slots: np.ndarray, rows: np.ndarray, homes: np.ndarray):
        self.homes = np.sort(homes).astype(np.uint64)
        order = np.argsort(slots)
        self.shift, self.slots = np.uint64(64 - bits), slots[order].astype(np.uint64)
        self.blocks = -(-2 * rows[order] // HOT_ROWS)
        #: Rows that cutting adds.
        self.extra = int((rows[order] * (self.blocks - 2)).sum())

    def of(self, key: np.ndarray) -> np.ndarray:
        """Blocks of each key, 1 for most."""
        if not len(self.slots):
            return np.ones(len(key), np.int64)
        slot = key >> self.shift
        place = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
        return np.where(self.slots[place] == slot, self.blocks[place], 1)

    def together(self, home: np.ndarray) -> np.ndarray:
        """Whether all rows of a first word may be in one bucket."""
        return ~np.isin(home >> self.shift, self.homes)

    def dealt(self, key: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and keys under which rows meet, some at a time.

        A row of a cut key meets the rows of each other block, and with them
        those of its own block; equal sets are in one block.
        """
        blocks = self.of(key)
        many = np.maximum(1, blocks - 1)
        ends = np.cumsum(many)
        first = 0
        while first < len(key):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + DEALT, "right")))
            some = many[first:last]
            at = np.repeat(np.arange(first, last), some)
            b = blocks[at]
            other = np.arange(len(at)) - np.repeat(np.cumsum(some) - some, some)
            side = (mixed(code[at] + np.uint64(11)) % b.astype(np.uint64)).astype(np.int64)
            other += other >= side
            pair = (np.minimum(side, other).astype(np.uint64) << np.uint64(32)) + np.maximum(side, other).astype(np.uint64)
            yield at, np.where(b > 1, mixed(key[at] ^ mixed(pair + np.uint64(1))), key[at])
            first = last


def spread_of(docs: DataFrame, order, words: int, similarity: float, text: str) -> Spread:
    """Counts, over all docs, the rows of keys by slots; only slots above HOT_ROWS come to the driver.

    A task passes on the slots in which it has more than its share, by its
    words, of HOT_ROWS / UNCOUNTED rows; what it keeps back over all tasks is
    no more than that, which is why slots count as hot from so much less.
    """
    bits = max(SLOT_BITS, (words // SLOT_WORDS).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((2, 1 << bits), np.int64)
        own = 0
        for batch in batches:
            for part in chunks(batch.column(0), CHUNK):
                _, _, codes, line, ids = line_words(batch.column(0)[part])
                own += len(ids)
                line, word, frequent = line_sets(codes, line, ids, order.value)
                if not len(line):
                    continue
                start = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
                n = np.diff(np.append(start, len(line)))
                first = np.zeros(len(n), bool)
                first[np.unique(set_codes(word, start), return_index=True)[1]] = True
                _, key, _, home = prefix_keys(word, frequent, start, n, first, similarity)
                for of, x in zip(rows, (key, home)):
                    of += np.bincount((mixed(x) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        rows = rows.ravel()  # slots of keys, then those of first words
        some = np.flatnonzero(rows > HOT_ROWS * own / (UNCOUNTED * max(1, words)))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(rows[some])], ["slot", "n"])

    found = (docs.select(F.col(text).cast("string")).mapInArrow(lean(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
             .filter(F.col("n") > HOT_ROWS - HOT_ROWS / UNCOUNTED).toArrow())
    slots, n = found.column("slot").to_numpy(), found.column("n").to_numpy()
    keys = slots < 1 << bits
    return Spread(bits, slots[keys], n[keys], slots[~keys] - (1 << bits))


def meetings(docs: DataFrame, order, buckets: int, similarity: float, doc_id: str, text: str, spread) -> DataFrame:
    """Where lines meet: rows of one key, for equal lines (pos -1) and for similar ones, packed by buckets of keys.

    Keys of one first word share a bucket unless it has many rows, so that two
    lines that share several of them are found once there.  Of equal lines in a
    chunk only the first meets others; the rest are marked for removal (pos -2)
    at once.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(2), CHUNK):
                some = batch.slice(part.start, part.stop - part.start)
                text_of, number, codes, line, ids = line_words(some.column(2))
                line, word, frequent = line_sets(codes, line, ids, order.value)
                if not len(line):
                    continue
                start = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
                n = np.diff(np.append(start, len(line)))
                which = line[start]
                f = set_codes(word, start)
                maps = bit_maps(word, start, n)
                bits = folded(maps, 1)[:, 0]
                doc = pc.fill_null(some.column(1), LAST).to_numpy()[text_of[which]]
                row, nth = some.column(0).to_numpy()[text_of[which]], number[which]
                sort = repeated(f)
                sort = sort[np.lexsort([c[sort] for c in (nth, row, doc, n, bits, f)])]
                again = np.append(False, (f[sort][1:] == f[sort][:-1]) & (bits[sort][1:] == bits[sort][:-1]) & (n[sort][1:] == n[sort][:-1]))[:len(sort)]
                first = np.ones(len(n), bool)
                first[sort[again]] = False

                gone, here = np.flatnonzero(~first), np.flatnonzero(first)
                of, key, place, home = prefix_keys(word, frequent, start, n, first, similarity)
                key, home = mixed(key), mixed(home)
                home = np.where(spread.value.together(home) & (spread.value.of(key) == 1), home, np.uint64(0))
                # Cut keys follow from the set alone.
                near = ((of[i], k, place[i], np.where(home[i] > 0, home[i], k)) for i, k in spread.value.dealt(key, set_codes(word, start)[of]))
                own = mixed(np.concatenate([row[gone].view(np.uint64), f[here] + bits[here]]))
                equal = (np.concatenate([gone, here]), own, np.concatenate([np.full(len(gone), -2), np.full(len(here), -1)]), own)
                some = next(near, (gone[:0], own[:0], gone[:0], own[:0]))
                for at, key, places, home in chain([tuple(map(np.concatenate, zip(equal, some)))], near):
                    yield packs((home >> np.uint64(32)) % np.uint64(buckets), [
                        key & np.uint64(0xFFFFFFFF), f[at], n[at], doc[at], row[at], nth[at], places], maps, at)

    chosen = numbered(docs, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(lean(meet), PACKED)


# --- where lines meet ----------------------------------------------------------------

def nearest(later, earlier, unequal, room, more, rank, first, most):
    """The nearest earlier rows of each later row, and whether it had others.

    ``first`` of them if the nearest has at most half the unequal bits that
    there is ``room`` for, else ``most``.
    """
    order = np.lexsort((rank[earlier], unequal, later))
    later, earlier, unequal, room, more = later[order], earlier[order], unequal[order], room[order], more[order]
    if not len(later):
        return later, earlier, unequal, room, more
    start = np.flatnonzero(np.append(True, later[1:] != later[:-1]))
    size = np.diff(np.append(start, len(later)))
    limit = np.where(2 * unequal[start] <= room[start], min(first, most), most)
    more = np.repeat(np.logical_or.reduceat(more, start) | (size > limit), size)
    keep = np.arange(len(later)) - np.repeat(start, size) < np.repeat(limit, size)
    return later[keep], earlier[keep], unequal[keep], room[keep], more[keep]


class Sets:
    """Sizes, places of the key, bit maps and order of the rows that meet."""

    def __init__(self, n, pos, maps, rank, similarity):
        self.n, self.pos, self.maps, self.rank = n, pos, maps, rank
        self.need = overlap_needed(np.arange(2 * int(n.max(initial=0)) + 2), similarity)
        # The largest set a row can be similar to: as many words as needed must come from its place on.
        self.reach = np.minimum(np.floor(n / similarity + 1e-9).astype(np.int64), np.searchsorted(self.need, n - pos, "right") - 1 - n)
        self.words, self.bits = map_words(n), folded(maps, 1)[:, 0]
        self.half = {w: folded(maps, w) for w in (2, 4) if (self.words > w).any()}

    def unequal(self, a, b):
        """Unequal bits of the smaller set's map and the larger one's, folded onto it."""
        out = np.zeros(len(a), np.int64)
        fewer = np.minimum(self.words[a], self.words[b])
        for w in (2, 4, 8):
            some = np.flatnonzero(fewer == w)
            if len(some):
                full = self.half.get(w, self.maps[:, :w])
                out[some] = np.bitwise_count(full[a[some]] ^ full[b[some]]).sum(1, dtype=np.int64)
        return out

    def near(self, a, b):
        """(later, earlier, unequal bits, room for them) of the pairs (a, b) that can be similar."""
        n, pos = self.n, self.pos
        total = n[a] + n[b]
        need = self.need[total]
        unequal = np.bitwise_count(self.bits[a] ^ self.bits[b]).astype(np.int64)
        # Different sets of one size differ in two words at least.
        good = (unequal <= total - 2 * need) & ((n[a] != n[b]) | (total - 2 * need >= 2))
        a, b, unequal, need = a[good], b[good], unequal[good], need[good]
        good = np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need
        a, b, unequal, need = a[good], b[good], unequal[good], need[good]
        wide = np.flatnonzero(np.minimum(self.words[a], self.words[b]) > 1)
        if len(wide):
            unequal[wide] = self.unequal(a[wide], b[wide])
            good = unequal <= n[a] + n[b] - 2 * need
            a, b, unequal, need = a[good], b[good], unequal[good], need[good]
        swap = self.rank[a] < self.rank[b]
        return np.where(swap, b, a), np.where(swap, a, b), unequal, n[a] + n[b] - 2 * need


class Kept:
    """Pairs found so far, of which only the nearest are held."""

    def __init__(self, rank, first, most):
        self.limits = rank, first, most
        self.found = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)]
        self.held = 0

    def add(self, later, earlier, unequal, room):
        self.found.append((later, earlier, unequal, room, np.zeros(len(later), bool)))
        self.held += len(later)
        if self.held > HELD_PAIRS:
            self.found = [self.all()]
            self.held = len(self.found[0][0]) // 2

    def all(self):
        return nearest(*(np.concatenate(x) for x in zip(*self.found)), *self.limits)


def small_groups(at, group, sets: Sets, kept: Kept) -> None:
    """Rows sorted by group and size: each is compared with the next, the second next and so on, as long as sizes allow."""
    gap = 1
    while len(at):
        at = at[at + gap < len(group)]
        to = at + gap
        at = at[(group[at] == group[to]) & (sets.n[to] <= sets.reach[at])]
        kept.add(*sets.near(at, at + gap))
        gap += 1


def large_group(rows, sets: Sets, kept: Kept, first: int) -> np.ndarray:
    """Each row of a group is compared with earlier ones, the last first, until ``first`` are very near; returns rows that stopped so."""
    rows = rows[np.argsort(sets.rank[rows])]
    sure = np.zeros(len(sets.n), np.int64)

    def compare(a, b):
        fits = (sets.n[a] <= sets.reach[b]) & (sets.n[b] <= sets.reach[a])
        found = sets.near(a[fits], b[fits])
        kept.add(*found)
        np.add.at(sure, found[0][2 * found[2] <= found[3]], 1)
    at, gap = np.arange(len(rows)), 1
    while len(at) > 64:
        at = at[at >= gap]
        compare(rows[at], rows[at - gap])
        at = at[sure[rows[at]] < first]
        gap += 1
    for i in at.tolist():
        others = rows[:max(0, i - gap + 1)]
        compare(np.full(len(others), rows[i]), others)
    return rows[sure[rows] >= first]


def near_pairs(group, n, pos, maps, rank, similarity, first, most, large=LARGE):
    """(later, earlier, unequal bits, room for them, more) of the pairs in each group that can be similar.

    Rows are sorted by group and size.
    """
    sets, kept, many = Sets(n, pos, maps, rank, similarity), Kept(rank, first, most), Kept(rank, first, min(most, NEAREST_LARGE))
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(group)))
    small_groups(np.flatnonzero(np.repeat(size <= large, size)), group, sets, kept)
    stopped = [large_group(np.arange(s, s + k), sets, many, first) for s, k in zip(start[size > large].tolist(), size[size > large].tolist())]
    later, earlier, unequal, room, more = (np.concatenate(x) for x in zip(kept.all(), many.all()))
    return later, earlier, unequal, room, more | np.isin(later, np.concatenate([*stopped, np.zeros(0, np.int64)]))


def dense(values: np.ndarray) -> np.ndarray:
    """The number, from 0, of each value among the different ones in order."""
    order = np.argsort(values)
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(np.append(False, values[order][1:] != values[order][:-1])[:len(values)])
    return out


def lines_of(*columns: np.ndarray) -> np.ndarray:
    """A number from 0 for each different line, in the order of its columns; single sorts are faster than one of many columns."""
    out = dense(columns[0])
    for c in columns[1:]:
        c = dense(c)
        out = dense(out * (int(c.max(initial=0)) + 1) + c)
    return out


def merged(later, earlier, unequal, room, more, line, rank, most):
    """(later, earlier, unequal, more) of the pairs of all groups, each pair of lines once and the ``most`` nearest of a line."""
    any_more = np.zeros(len(line), bool)
    any_more[line[later[more]]] = True
    _, once = np.unique(line[later] * max(1, len(line)) + line[earlier], return_index=True)
    later, earlier, unequal, room = later[once], earlier[once], unequal[once], room[once]
    place = np.empty(len(line), np.int64)
    place[line] = np.arange(len(line))
    found, earlier, unequal, _, more = nearest(line[later], earlier, unequal, room, any_more[line[later]], rank, most, most)
    return place[found], earlier, unequal, more


def repeated(values: np.ndarray) -> np.ndarray:
    """Places of the values that occur more than once."""
    order = np.argsort(values)
    change = values[order][1:] != values[order][:-1]
    return order[~(np.append(True, change) & np.append(change, True))[:len(order)]]


def shared(key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The rows that have another of their kind, equal or similar lines, under their key; marked ones (pos -2) are left out."""
    at = np.flatnonzero(pos != -2)
    return at[repeated((key[at].astype(np.uint64) << np.uint64(1)) | (pos[at] == -1))]


def met(rows: DataFrame, buckets: int, similarity: float, first: int, most: int) -> DataFrame:
    """(row, line, to_row, to_line, unequal, more): lines to remove (to_row null) and lines with a nearby earlier one."""
    names = ["row", "line", "to_row", "to_line", "unequal", "more"]

    def batch_of(row, line, to_row, to_line, unequal, more):
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(line.astype(np.int32)), pa.array(to_row), pa.array(to_line, pa.int32()),
                                           pa.array(unequal.astype(np.int32)), pa.array(more)], names)

    def removals(row, line):
        return batch_of(row, line, pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int32()), np.zeros(len(row)), np.zeros(len(row), bool))

    def detect(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, f, n, doc, row, line, pos, maps = columns
        yield removals(row[pos == -2], line[pos == -2])
        at = shared(key, pos)
        group = (key[at].astype(np.uint64) << np.uint64(1)) | (pos[at] == -1)
        bits = folded(maps[at], 1)[:, 0]
        # Of equal sets under a key all but the first go; only those with equal codes are sorted.
        twin = repeated(mixed(group) ^ mixed(f[at] + bits))
        own = at[twin]
        own = twin[np.lexsort((line[own], row[own], doc[own], n[own], bits[twin], f[own], group[twin]))]
        same = [group[own], f[at[own]], bits[own], n[at[own]]]
        again = np.zeros(len(at), bool)
        again[own[1:][np.logical_and.reduce([c[1:] == c[:-1] for c in same])]] = True
        late = at[again & (pos[at] == -1)]
        yield removals(row[late], line[late])
        near = ~again & (pos[at] >= 0)
        at, group = at[near], group[near]
        size = n[at].astype(np.int64)
        order = np.argsort(dense(group) * (int(size.max(initial=0)) + 1) + size)
        at, group = at[order], group[order]
        # Rows that are alone under their key meet none.
        if len(at):
            alone = np.append(True, group[1:] != group[:-1]) & np.append(group[1:] != group[:-1], True)
            at, group = at[~alone], group[~alone]
        if not len(at):
            return
        rank = lines_of(doc[at], row[at], line[at])
        found = near_pairs(group, n[at], pos[at], maps[at], rank, similarity, first, most)
        x, y, unequal, more = merged(*found, rank, rank, most)
        x, y = at[x], at[y]
        yield batch_of(row[x], line[x], row[y], line[y].astype(np.int32), unequal, more)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, columns in unpacked(batch):
                if held and bucket != now:
                    yield from detect([np.concatenate(c) for c in zip(*held)])
                    held = []
                now = bucket
                held.append(columns)
        if held:
            yield from detect([np.concatenate(c) for c in zip(*held)])

    return rows.repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(lean(find), "row long, line int, to_row long, to_line int, unequal int, more boolean")


# --- check ---------------------------------------------------------------------------

def place_bits(row: np.ndarray, line: np.ndarray) -> np.ndarray:
    return (mixed(mixed(row.view(np.uint64)) + line.astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def bit_map(needed: DataFrame) -> np.ndarray:
    """A bit for each needed line, in a table of fixed size."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(FILTER_BITS // 64, np.uint64)
        for batch in batches:
            b = place_bits(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            np.bitwise_or.at(table, b >> 6, np.uint64(1) << (b & 63).astype(np.uint64))
        w = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(table[w].view(np.int64))], ["w", "m"])
    words = needed.select("row", "line").mapInArrow(lean(mark), "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[words.column("w").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
    return table


def line_tables(docs: DataFrame, needed: DataFrame, order, doc_id: str, text: str) -> DataFrame:
    """(row, line, doc_id, words) of the needed lines, and few others that have their bit."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(needed))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(1), CHUNK):
                lines = pc.split_pattern(large(batch.column(1)[part]), "\n")
                sizes = np.diff(lines.offsets.to_numpy())
                row = np.repeat(batch.column(0)[part].to_numpy(), sizes)
                doc = np.repeat(pc.fill_null(batch.column(2)[part], LAST).to_numpy(), sizes)
                number = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                b = place_bits(row, number)
                wanted = np.flatnonzero((shared.value[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1))
                # Each line is now a text of its own.
                _, _, codes, line, ids = line_words(lines.flatten().take(pa.array(wanted)))
                line, word, _ = line_sets(codes, line, ids, order.value)
                if not len(line):
                    continue
                start = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
                data, ends = word.tobytes(), (np.append(start[1:], len(line)) * 8).tolist()
                which = wanted[line[start]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row[which]), pa.array(number[which].astype(np.int32)), pa.array(doc[which]),
                    pa.array([data[a:b] for a, b in zip((start * 8).tolist(), ends)], pa.binary())], ["row", "line", "doc_id", "words"])
    chosen = numbered(docs, F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    return chosen.mapInArrow(lean(cut), "row long, line int, doc_id long, words binary")


def checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(row, line, similar): whether one of the line's candidates in ``pairs`` is similar."""
    to = sets.select(F.col("row").alias("to_row"), F.col("line").alias("to_line"), F.col("words").alias("to_words"))
    both = pairs.join(to, ["to_row", "to_line"]).join(sets, ["row", "line"]).select("row", "line", "words", "to_words")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(good, pa.bool_())], ["row", "line", "similar"])
    return both.mapInArrow(lean(check), "row long, line int, similar boolean").groupBy("row", "line").agg(F.max("similar").alias("similar"))


def sets_of(pairs: DataFrame, docs: DataFrame, order, doc_id: str, text: str) -> DataFrame:
    """(row, line, doc_id, words) of all lines in the pairs."""
    needed = pairs.select("row", "line").unionByName(pairs.select(F.col("to_row").alias("row"), F.col("to_line").alias("line"))).distinct()
    return checkpoint(line_tables(docs, needed, order, doc_id, text).join(needed, ["row", "line"]))


def bits_of(numbers: np.ndarray) -> np.ndarray:
    return (mixed(numbers + np.uint64(3)) % np.uint64(FILTER_BITS)).astype(np.int64)


def has_bit(table: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (table[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) > 0


def marked_keys(sets: DataFrame, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Bit maps of fixed size of the words and the keys by which the sets meet others.

    A set that shares a key shares its words, which are the first of a set.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, FILTER_BITS // 64), np.uint64)
        for batch in batches:
            word = [np.frombuffer(w, np.uint64) for w in batch.column(2).to_pylist()]
            n = np.array([len(w) for w in word], np.int64)
            word = np.concatenate([*word, np.zeros(0, np.uint64)])
            _, keys, _, _ = prefix_keys(word, word >= FREQUENT_WORD, np.cumsum(n) - n, n, np.ones(len(n), bool), similarity)
            of = np.repeat(np.arange(len(n)), n)
            word = word[np.arange(len(word)) - (np.cumsum(n) - n)[of] <= prefix_sizes(n, similarity)[of]]
            for i, b in enumerate((bits_of(word), bits_of(keys))):
                np.bitwise_or.at(table[i], b >> 6, np.uint64(1) << (b & 63).astype(np.uint64))
        table = table.ravel()
        w = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(table[w].view(np.int64))], ["w", "m"])
    found = sets.select("row", "line", "words").mapInArrow(lean(mark), "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    table = np.zeros(2 * (FILTER_BITS // 64), np.uint64)
    table[found.column("w").to_numpy()] = found.column("m").to_numpy().view(np.uint64)
    return table[:FILTER_BITS // 64], table[FILTER_BITS // 64:]


class Asked:
    """The lines of the last round, with an index of their keys."""

    def __init__(self, table: pa.Table, similarity: float):
        self.row, self.line, self.doc = (table.column(c).to_numpy() for c in ("row", "line", "doc_id"))
        self.words = [np.frombuffer(w, np.uint64) for w in table.column("words").to_pylist()]
        self.n = np.array([len(w) for w in self.words], np.int64)
        word = np.concatenate([*self.words, np.zeros(0, np.uint64)])
        of, keys, _, _ = prefix_keys(word, word >= FREQUENT_WORD, np.cumsum(self.n) - self.n, self.n, np.ones(len(self.n), bool), similarity)
        order = np.argsort(keys, kind="stable")
        self.of, self.keys, self.similarity = of[order], keys[order], similarity

    def matched(self, of, key, word, start, n, doc, row, line) -> np.ndarray:
        """Which of the lines have a similar earlier one among the sets given with their keys."""
        low, high = (np.searchsorted(self.keys, key, side) for side in ("left", "right"))
        many = high - low
        y = np.repeat(of, many)
        x = self.of[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        pair = np.unique(x * len(n) + y)
        x, y = pair // max(1, len(n)), pair % max(1, len(n))
        earlier = (doc[y] < self.doc[x]) | ((doc[y] == self.doc[x]) & ((row[y] < self.row[x]) | ((row[y] == self.row[x]) & (line[y] < self.line[x]))))
        fits = earlier & (np.minimum(n[y], self.n[x]) >= self.similarity * np.maximum(n[y], self.n[x]) - 1e-9)
        x, y = x[fits], y[fits]
        found = []
        for i in np.unique(x).tolist():
            others = y[x == i]
            many = n[others]
            values = word[np.repeat(start[others] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            common = np.bincount(np.repeat(np.arange(len(others)), many)[np.isin(values, self.words[i])], minlength=len(others))
            if (common >= self.similarity * (many + self.n[i] - common) - 1e-9).any():
                found.append(i)
        return np.array(found, np.int64)


def compared_with_all(still: DataFrame, sets: DataFrame, docs: DataFrame, order, similarity: float, doc_id: str, text: str,
                      spread, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(row, line) of the lines in ``still``, and maybe others, that have any similar earlier line.

    Few lines go to all tasks and are compared where other lines are read.
    For many, all lines that share a key with one come to it with their words;
    of equal ones in a chunk only the first, and by pairs of blocks where a key has many.
    """
    open_sets = sets.join(still, ["row", "line"])
    few = open_sets.agg(F.sum(F.length("words")) / 8).first()[0] <= broadcast_words
    asked_lines = Asked(open_sets.select("row", "line", "doc_id", "words").toArrow(), similarity) if few else None
    shared = docs.sparkSession.sparkContext.broadcast((*marked_keys(open_sets, similarity), bit_map(still), asked_lines))

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, keys, lines, questions = shared.value
        for batch in batches:
            for part in chunks(batch.column(2), CHUNK):
                some = batch.slice(part.start, part.stop - part.start)
                text_of, number, codes, line, ids = line_words(some.column(2))
                hit = np.zeros(len(text_of), bool)
                hit[line[has_bit(words, bits_of(order.value.numbers(codes)[0]))[ids]]] = True
                use = hit[line]
                line, word, frequent = line_sets(codes, line[use], ids[use], order.value)
                if not len(line):
                    continue
                start = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
                n = np.diff(np.append(start, len(line)))
                which = line[start]
                row, nth = some.column(0).to_numpy()[text_of[which]], number[which]
                asked = has_bit(lines, place_bits(row, nth))
                doc = pc.fill_null(some.column(1), LAST).to_numpy()[text_of[which]]
                code = set_codes(word, start)
                sort = np.lexsort((nth, row, doc, code))
                first = np.ones(len(n), bool)
                first[sort[np.append(False, code[sort][1:] == code[sort][:-1])]] = False
                of, key, _, _ = prefix_keys(word, frequent, start, n, first, similarity)
                real = has_bit(keys, bits_of(key))
                of, key = of[real], key[real]
                if questions is not None:
                    x = questions.matched(of, key, word, start, n, doc, row, nth)
                    yield pa.RecordBatch.from_arrays([pa.array(questions.row[x]), pa.array(questions.line[x], pa.int32())], ["row", "line"])
                    continue
                data, ends = word.tobytes(), (start + n) * 8
                for i, key in spread.value.dealt(mixed(key), code[of]):
                    at = of[i]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(key.view(np.int64)), pa.array(doc[at]), pa.array(row[at]), pa.array(nth[at].astype(np.int32)), pa.array(asked[at]),
                        pa.array([data[a:b] for a, b in zip((start * 8)[at].tolist(), ends[at].tolist())], pa.binary())],
                        ["key", "doc_id", "row", "line", "asked", "words"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, 1):
            doc, row, line, asked = (group.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            if not asked.any():
                continue
            data = group.column(5).to_pylist()
            n = np.array([len(w) // 8 for w in data])
            owner, values = np.repeat(np.arange(len(n)), n), np.frombuffer(b"".join(data), np.uint64)
            rank = np.empty(len(n), np.int64)
            rank[np.lexsort((line, row, doc))] = np.arange(len(n))
            same = []
            for x in np.flatnonzero(asked).tolist():
                common = np.bincount(owner[np.isin(values, np.frombuffer(data[x], np.uint64))], minlength=len(n))
                same.append(bool(((common >= similarity * (n + n[x] - common) - 1e-9) & (rank < rank[x])).any()))
            gone = np.flatnonzero(asked)[np.array(same)]
            yield pa.RecordBatch.from_arrays([pa.array(row[gone]), pa.array(line[gone])], ["row", "line"])

    chosen = numbered(docs, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if few:
        return chosen.mapInArrow(lean(bring), "row long, line int").distinct()
    brought = chosen.mapInArrow(lean(bring), "key long, doc_id long, row long, line int, asked boolean, words binary")
    return (brought.repartition("key").sortWithinPartitions("key").mapInArrow(lean(compare), "row long, line int").distinct())


def repeated_lines(docs: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text",
                   first: int = FIRST, most: int = NEAREST) -> DataFrame:
    """(row, line) of every line to remove; lines without words stay."""
    frequent, words = frequent_words(docs, text)
    order = docs.sparkSession.sparkContext.broadcast(Order(frequent))
    cut = spread_of(docs, order, words, similarity, text)
    spread = docs.sparkSession.sparkContext.broadcast(cut)
    # A line meets others by a fifth of its words, or a little more.
    buckets = 1 + (int(words * (1 - similarity)) + cut.extra) // BUCKET_ROWS
    found = checkpoint(met(meetings(docs, order, buckets, similarity, doc_id, text, spread), buckets, similarity, first, most))
    gone = found.filter("to_row is null").select("row", "line")
    # A line meets a neighbour under several keys.
    pairs = (found.filter("to_row is not null").groupBy("row", "line", "to_row", "to_line")
             .agg(F.first("unequal").alias("unequal"), F.max("more").alias("more")))
    own = W.partitionBy("row", "line")
    pairs = checkpoint(pairs.withColumns({"nth": F.row_number().over(own.orderBy("unequal", "to_row", "to_line")),
                                          "more": F.max("more").over(own) | (F.count("*").over(own) > most)}).filter(F.col("nth") <= most))
    sets = sets_of(pairs, docs, order, doc_id, text)
    near = checkpoint(checked(pairs.filter(F.col("nth") <= first), sets, similarity).filter("similar").select("row", "line"))
    left = pairs.filter(F.col("nth") > first).join(near, ["row", "line"], "left_anti")
    near = checkpoint(near.unionByName(checked(left, sets, similarity).filter("similar").select("row", "line")))
    still = checkpoint(pairs.filter("more").select("row", "line").distinct().join(near, ["row", "line"], "left_anti"))
    if not still.isEmpty():  # more candidates than were kept, and none of those is similar
        near = near.unionByName(compared_with_all(still, sets, docs, order, similarity, doc_id, text, spread)).distinct()
    return gone.unionByName(near)


def without_repeats(docs: DataFrame, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text",
                    broadcast_lines: int = BROADCAST_LINES, **options) -> DataFrame:
    """docs with the text's later lines taken out, and n_lines, n_removed in ``__lines``.

    A line goes if its set of words (letters and digits, A-Z lowered) has
    Jaccard similarity of at least ``similarity`` with an earlier line of any
    document, in the order of doc_id (null last), row and line.  Lines without
    words, null and empty texts stay as they are.  docs are read several
    times and must come in the same order, as files do.
    """
    gone = checkpoint(repeated_lines(docs, similarity, doc_id, text, **options).groupBy("row").agg(F.collect_set("line").alias("gone")))
    few = (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= broadcast_lines
    whole = numbered(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    both = whole.join(F.broadcast(gone) if few else gone, "row", "left")
    lines = F.split(F.col(f"doc.`{text}`").cast("string"), "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    new = F.when(F.col("gone").isNull(), F.col(f"doc.`{text}`")).otherwise(left)
    count = F.struct(F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
                     F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")).alias("__lines")
    return both.select(*[new.alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns], count)
