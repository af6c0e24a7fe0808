"""Packing of documents into fixed-length training sequences.

Documents become token ids and a closing id, and are cut only if longer than
a sequence.  The pieces' length histogram (at most ``capacity`` rows) is all
the driver sees.  A sequence filled with certain lengths is a configuration;
which configurations to use how often is a linear program over the histogram.
It is solved by multiplicative weights: each length has a price, a knapsack
dynamic program finds the configurations of the highest price, sequences are
dealt to them, and the prices of lengths fall by the share of them that is
covered.  The rounds give a fractional solution and, as prices are a dual one,
a number below which no packing can go.  The solution is rounded down, one more
of its full configurations is used where all pieces are there, and the rest is
packed in whole numbers by the same pricing and then by best fit, or by rounding
up if that needs fewer: never more sequences than the program's value and one per
configuration.  Pieces take the places planned for their length by their rank in it.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from wardline.llm.common import chunks, large, lean, numbered
from wardline.session import checkpoint

CAPACITY = 2048
#: Bytes of text that are encoded together; a longer text is alone.
CHUNK = 4 << 20
#: Words of text whose ids are put together at once.
UNITS = 1 << 17
_PLAIN = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"


class WordEncoder:
    """Ids of texts by a tokenizer that never joins letters across white space.

    Texts are cut at spaces and line ends and every different word of a chunk
    is encoded once.  Of words of plain letters with ASCII marks behind,
    letters and marks are units of their own, and the letters skip the
    tokenizer's normalizer, which would change nothing but their case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        # Tasks run side by side as it is; threads of each would only take memory and time.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.lean = Tokenizer(self.whole.model)  # one vocabulary for both
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def _cores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of small letters, and how many each has."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 1000):
            found = self.lean.encode_batch_fast([" ".join(words[i:i + 1000])], add_special_tokens=False)[0].ids
            ids.append(np.array(found, np.uint32))
            counts.append(np.diff(np.flatnonzero(self.ends[ids[-1]]), prepend=-1))
        return np.concatenate(ids), np.concatenate(counts)

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 1000):  # encodings take much more room than their ids
            found = [e.ids for e in self.whole.encode_batch_fast(words[i:i + 1000], add_special_tokens=False)]
            ids.append(np.array([i for ids in found for i in ids], np.uint32))
            counts.append(np.array([len(ids) for ids in found], np.int64))
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        cut = pc.split_pattern(pc.replace_substring(large(texts), "\n", " "), " ")
        words, sizes = cut.flatten().dictionary_encode(), np.diff(cut.offsets.to_numpy())
        del cut  # what is done with goes at once, as workers share a machine's memory
        parts = pc.extract_regex(words.dictionary, _PLAIN)
        plain = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        cores = pc.utf8_lower(pc.struct_field(parts, "core").filter(pa.array(plain))).dictionary_encode()
        marks = pc.struct_field(parts, "marks").filter(pa.array(plain)).dictionary_encode()
        odd = words.dictionary.filter(pa.array(~plain))
        del parts
        tables = [self._cores(cores.dictionary.to_pylist()), self._others(marks.dictionary.to_pylist()), self._others(odd.to_pylist())]
        pool, lengths = (np.concatenate(x) for x in zip(*tables))
        lengths = np.append(lengths, 0).astype(np.int32)  # the last unit is empty
        begins = (np.cumsum(lengths) - lengths).astype(np.int32)

        n_cores, n_marks = len(cores.dictionary), len(marks.dictionary)
        units = np.full((len(plain), 2), len(lengths) - 1, np.int32)
        units[plain, 0] = cores.indices.to_numpy()
        units[plain, 1] = n_cores + marks.indices.to_numpy()
        units[~plain, 0] = n_cores + n_marks + np.arange(len(odd))
        at = words.indices.to_numpy()
        del words, cores, marks, odd, tables
        many = lengths[units].sum(1, dtype=np.int64)  # ids of each different word
        ends = np.cumsum(many[at])
        ids = np.empty(ends[-1] if len(ends) else 0, np.uint32)
        done = 0
        for i in range(0, len(at), UNITS):
            some = units[at[i:i + UNITS]].ravel()
            many = lengths[some]
            to = np.cumsum(many)
            ids[done:done + to[-1]] = pool[np.repeat(begins[some] - (to - many), many) + np.arange(to[-1])]
            done += to[-1]
        last = np.append(0, ends)[np.cumsum(sizes)]
        return ids, np.diff(last, prepend=0)


_encoders: dict[str, WordEncoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id",
           text: str = "text", end_id: int = 0) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32) of every piece; null text counts as empty."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = WordEncoder(tokenizer)
        for batch in batches:
            for part in chunks(batch.column(2), CHUNK):
                rows = batch.slice(part.start, part.stop - part.start)
                ids, counts = _encoders[tokenizer].encode(rows.column(2))
                ids = np.insert(ids.astype("<u4"), np.cumsum(counts), end_id)
                counts = counts + 1
                many = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(counts[doc] - start, capacity)
                at = (np.cumsum(counts) - counts)[doc] + start
                data = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(doc)), rows.column(1).take(pa.array(doc)), pa.array(piece.astype(np.int32)),
                     pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names)
                del rows, ids, data
            del batch  # before the next one is read

    chosen = numbered(docs, F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
    return chosen.mapInArrow(lean(cut), f"row long, doc_id {chosen.schema['doc_id'].dataType.simpleString()}, piece int, "
                                  "start long, length long, ids_crc32 long")


class Knapsack:
    """Configurations of the highest total price; price[l] is that of length l, 0 where there is none."""

    def __init__(self, price: np.ndarray):
        capacity = len(price) - 1
        self.price, self.capacity = price, capacity
        self.best, self.pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
        for c in range(1, capacity + 1):
            value = price[1:c + 1] + self.best[c - 1::-1]
            i = int(value.argmax())
            if value[i] > self.best[c - 1]:
                self.best[c], self.pick[c] = value[i], i + 1
            else:
                self.best[c] = self.best[c - 1]

    def having(self, length: int) -> float:
        """The highest price of a configuration that has ``length``."""
        return float(self.price[length] + self.best[self.capacity - length])

    def configuration(self, length: int = 0, wanted: np.ndarray | None = None, slack: float = 0.0) -> dict[int, int]:
        """Lengths and how often each; with ``length`` among them, if one is given.

        Of choices that together lose at most ``slack`` of the price, those of the most ``wanted`` lengths are taken.
        """
        found: dict[int, int] = defaultdict(int)
        c = self.capacity - length
        if length:
            found[length] = 1
        while c:
            one = int(self.pick[c])
            if wanted is not None and self.best[c] > 0:
                loss = self.best[c] - (self.price[1:c + 1] + self.best[c - 1::-1])
                i = int(np.where(loss <= slack + 1e-12, wanted[1:c + 1], 0.0).argmax())
                if wanted[i + 1] > 0 and loss[i] <= slack + 1e-12:
                    one, slack = i + 1, slack - max(0.0, float(loss[i]))
            if one:
                found[one] += 1
                c -= one
            else:
                c -= 1
        return found


def best_configuration(price: np.ndarray) -> dict[int, int]:
    """Lengths and how often each, of the highest total price within the capacity (unbounded knapsack)."""
    return Knapsack(price).configuration()


#: How often each configuration, ((length, times), ...), is used.
Uses = dict[tuple[tuple[int, int], ...], float]


@dataclass
class Fraction:
    """A fractional cover of all pieces and the dual bound.

    ``uses`` maps a configuration, ((length, times), ...), to how often it is
    used.  No packing has fewer sequences than ``bound``; ``size`` is the sum of uses.
    """

    uses: Uses
    bound: float

    @property
    def size(self) -> float:
        return sum(self.uses.values())


def cover(left: np.ndarray, knapsack: Knapsack, least: float) -> tuple[Uses, np.ndarray]:
    """Fractional uses that cover what is left, by configurations of a price of ``least`` or more.

    Longest first, every length takes a configuration that has it, filled with
    the lengths of which most is open, for as much as is open of all of them.
    Lengths whose configurations are cheaper stay open.  Returns the uses and
    what they cover of each length.
    """
    left = left.astype(float)
    tiny = 1e-6 * left
    lengths = np.arange(len(left))
    uses: Uses = defaultdict(float)
    covered = np.zeros(len(left))
    for length in np.flatnonzero(left)[::-1].tolist():
        while left[length] > tiny[length] and knapsack.having(length) >= least:
            found = knapsack.configuration(length, left * lengths, knapsack.having(length) - least)
            # Lengths that fill a configuration though none is open are covered once too often.
            times = min(left[other] / n for other, n in found.items() if left[other] > tiny[other])
            uses[tuple(sorted(found.items(), reverse=True))] += times
            for other, n in found.items():
                covered[other] += times * n
                left[other] = max(0.0, left[other] - times * n)
                if left[other] <= tiny[other]:
                    left[other] = 0.0
    return uses, covered


def solve(counts: np.ndarray, capacity: int, gap: float = 0.005, rounds: int = 20, rate: float = 0.5, slack: float = 0.01) -> Fraction:
    """The linear program over the histogram by multiplicative weights.

    Least sum of uses such that every length l is covered counts[l] times.  A
    round prices the lengths and lets the knapsack find the dearest
    configuration; prices divided by its price are a dual solution, whose value
    is a bound.  Sequences are dealt to configurations within ``slack`` of the
    dearest, as many as the bound, and each price falls by a factor in the share of its
    length that they cover.  The answer is the average of the rounds, or what one
    round gives if that is smaller, and what it leaves open covered at the same
    prices.  Rounds end when the answer is within ``gap`` of the bound.  First
    prices are a length's share of a sequence, or whether it is above half of
    one, whichever gives the higher bound.
    """
    here, lengths = counts > 0, np.arange(capacity + 1)
    if not here.any():
        return Fraction({}, 0.0)

    def complete(uses: Uses, covered: np.ndarray, knapsack: Knapsack) -> Uses:
        rest = np.where(covered < counts * (1 - 1e-9), counts - covered, 0.0)
        more = cover(rest, knapsack, 0.0)[0]
        return {one: uses.get(one, 0.0) + more.get(one, 0.0) for one in {**uses, **more}}

    share_of = np.where(here, lengths / capacity, 0.0)
    halves = np.where(here, (2 * lengths > capacity) + 0.5 * (2 * lengths == capacity), 0.0)
    starts = [Knapsack(share_of), Knapsack(halves + 1e-6 * share_of)]
    knapsack = max(starts, key=lambda k: float(counts @ k.price) / k.best[capacity])
    best, bound, total = Fraction({}, np.inf), 0.0, 0.0
    average: Uses = defaultdict(float)
    covered = np.zeros(capacity + 1)
    for _ in range(rounds):
        price, top = knapsack.price, float(knapsack.best[capacity])
        bound = max(bound, float(counts @ price) / top)
        found, gain = cover(counts, knapsack, (1 - slack) * top)
        scale = bound / sum(found.values())
        share = np.where(here, scale * gain / np.maximum(counts, 1), 0.0)
        step = min(1.0, 1.0 / share.max())  # no length is covered more than once a round
        for one, times in found.items():
            average[one] += step * scale * times
        covered += step * scale * gain
        total += step
        answers = [complete(found, gain, knapsack)]
        if total > step:
            answers.append(complete({one: times / total for one, times in average.items()}, covered / total, knapsack))
        for uses in answers:
            if not best.uses or sum(uses.values()) < best.size:
                best = Fraction(uses, bound)
        if best.size <= (1 + gap) * bound:
            break
        price = np.where(here, price * np.exp(-rate * step * (share - share[here].min())), 0.0)
        knapsack = Knapsack(np.where(here, np.maximum(price / price.max(), 1e-12), 0.0))
    return Fraction(best.uses, bound)


@dataclass
class Bins:
    """``copies`` sequences of the same content, [(length, times), ...] in order."""

    copies: int
    content: list[tuple[int, int]] = field(default_factory=list)

    def plus(self, copies: int, length: int, times: int) -> "Bins":
        return Bins(copies, [*self.content, (length, times)])


def best_fit(left: np.ndarray, capacity: int) -> list[Bins]:
    """Best fit by falling length, many equal sequences at a time."""
    open_bins: dict[int, list[Bins]] = defaultdict(list)
    done: list[Bins] = []

    def put(bins: Bins, room: int) -> None:
        (open_bins[room] if room else done).append(bins)

    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            room = min((r for r, b in open_bins.items() if r >= length and b), default=0)
            group = open_bins[room].pop() if room else Bins(todo)
            if not room:
                room = capacity
            times = min(room // length, todo)
            used = min(group.copies, todo // times)
            put(group.plus(used, length, times), room - times * length)
            if room < capacity and used < group.copies:
                open_bins[room].append(Bins(group.copies - used, group.content))
            todo -= used * times
    return done + [b for bs in open_bins.values() for b in bs]


def rounded(left: np.ndarray, fraction: Fraction, capacity: int) -> tuple[list[Bins], Uses]:
    """Configurations used a whole number of times, as far as pieces are left; ``left`` falls by them.

    First the whole part of each use, then, most first, one more of each full
    configuration whose pieces are all there.  Also returns how often each
    may be used until it is one above the whole part.
    """
    out = []
    open_uses = {one: int(times + 1e-9) + 1 for one, times in sorted(fraction.uses.items(), key=lambda u: (-u[1], u[0]))}
    for whole in (True, False):
        for one, times in open_uses.items():
            if not whole and sum(a * n for a, n in one) < capacity:
                continue
            copies = min([times - 1 if whole else min(times, 1), *(int(left[a]) // n for a, n in one)])
            if copies > 0:
                out.append(Bins(copies, list(one)))
                open_uses[one] -= copies
                for a, n in one:
                    left[a] -= copies * n
    return out, open_uses


def rounded_up(left: np.ndarray, open_uses: Uses, capacity: int) -> list[Bins]:
    """The remaining pieces in the uses still open, filled with what is there.

    All uses together are one above the whole part at most, so this adds
    no more sequences to the linear program than it has configurations.
    """
    out = []
    for one, times in open_uses.items():
        while times:
            content = [(a, min(n, int(left[a]))) for a, n in one if left[a]]
            if not content:
                break
            copies = min([times, *(int(left[a]) // n for a, n in content)])
            out.append(Bins(copies, content))
            times -= copies
            for a, n in content:
                left[a] -= copies * n
    return out + best_fit(left, capacity)


def by_prices(left: np.ndarray, price: np.ndarray, capacity: int, rounds: int = 400, share: float = 0.5, rate: float = 2.0) -> list[Bins]:
    """The remaining pieces by priced configurations in whole numbers, then by best fit.

    ``share`` is the part of what the remaining histogram allows that a
    configuration is used for, ``rate`` the strength of the price changes.
    """
    out, counts = [], np.maximum(left, 1)
    price = np.where(left > 0, price, 0.0)
    for _ in range(rounds):
        if left.sum() * 4 <= capacity or not (left > 1).any():
            break
        found = {length: min(times, int(left[length])) for length, times in best_configuration(price).items()}
        room = capacity - sum(a * b for a, b in found.items())
        while room:  # pieces that have run out leave room for the longest that fit
            more = left[:room + 1].copy()
            for length, times in found.items():
                if length <= room:
                    more[length] -= times
            fits = np.flatnonzero(more > 0)
            if not len(fits):
                break
            length = int(fits[-1])
            times = min(room // length, int(more[length]))
            found[length] = found.get(length, 0) + times
            room -= times * length
        found = {length: times for length, times in found.items() if times}
        copies = max(1, int(share * min(left[length] // times for length, times in found.items())))
        out.append(Bins(copies, sorted(found.items(), reverse=True)))
        for length, times in found.items():
            left[length] -= copies * times
            price[length] *= np.exp(-rate * copies * times / counts[length]) if left[length] else 0.0
    return out + best_fit(left, capacity)


def plan(counts: np.ndarray, capacity: int) -> list[Bins]:
    """Sequences for counts[l] pieces of each length l, all placed.

    The linear program rounded down, then the rest by prices, or the program rounded up if that needs fewer.
    """
    left = counts.astype(np.int64).copy()
    out = []
    if left[capacity]:
        out.append(Bins(int(left[capacity]), [(capacity, 1)]))
        left[capacity] = 0
    whole, open_uses = rounded(left, solve(left, capacity), capacity)
    # At the start prices are the share of a sequence: no full sequence is better than another.
    rest = [by_prices(left.copy(), np.arange(capacity + 1) / capacity, capacity), rounded_up(left.copy(), open_uses, capacity)]
    return out + whole + min(rest, key=lambda bins: sum(b.copies for b in bins))


@dataclass
class Places:
    """By length: first rank, first sequence, times per sequence and offset of each group of sequences."""

    of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def from_bins(cls, bins: list[Bins]) -> "Places":
        rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        rank: dict[int, int] = defaultdict(int)
        sequence = 0
        for b in bins:
            offset = 0
            for length, times in b.content:
                rows[length].append((rank[length], sequence, times, offset))
                rank[length] += b.copies * times
                offset += length * times
            sequence += b.copies
        return cls({length: tuple(np.array(c, np.int64) for c in zip(*r)) for length, r in rows.items()})

    def find(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, sequence, times, offset = self.of[length]
        at = np.searchsorted(first, rank, "right") - 1
        nth = rank - first[at]
        return sequence[at] + nth // times[at], offset[at] + nth % times[at] * length


def ranked(cut: DataFrame) -> DataFrame:
    """A rank from 0 among the pieces of a length.

    Ranks are counted per partition and length and led by the counts of the
    partitions before, so no length has to be in one task.
    """
    rows = cut.withColumn("part", F.spark_partition_id())
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    lead = rows.groupBy("length", "part").agg(F.count("*").alias("n")).select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lead"))
    own = W.partitionBy("length", "part").orderBy("row", "piece")
    return (rows.withColumn("nth", F.row_number().over(own)).join(lead, ["length", "part"])
            .withColumn("rank", F.col("lead") + F.col("nth") - 1).drop("part", "nth", "lead"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_id: str = "doc_id",
         text: str = "text", end_id: int = 0) -> DataFrame:
    """Where every piece of every document goes.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A
    null or empty text is one piece with the closing id alone; repeated rows
    are packed once each.  Sequences are numbered from 0.
    """
    cut = checkpoint(pieces(docs, tokenizer, capacity, doc_id, text, end_id))
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # one row per length at most
        counts[r["length"]] = r["count"]
    places = cut.sparkSession.sparkContext.broadcast(Places.from_bins(plan(counts, capacity)))
    rows = ranked(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                sequence[group], offset[group] = places.value.find(int(length[group[0]]), rank[group])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kind = cut.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(place), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
                                  "sequence_id long, offset long")
