"""Document likelihood under a subword unigram model, over all segmentations.

The vocabulary is an existing one.  A word, led by a blank, is a lattice of
its pieces; the model's probability of the word is the sum over all ways to
cut it into pieces of the product of their probabilities, found by a forward
recursion in log space.  A document is its words and an end mark, so the
pieces' probabilities and the end's sum to one.  The vocabulary file's scores
order its pieces and give the first weights; passes of expectation
maximization over the counts of all training words turn them into
probabilities (forward and backward recursion, expected piece counts).

Beside the model stands a plain word unigram with one added to each count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import log, log1p, exp

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from wardline.llm.common import chunks, large, numbered
from wardline.session import checkpoint

BLANK = b" "
#: Longest word, in bytes, that is handled together with others.
LONG = 64
#: Bytes of words in one lattice, and of texts that are split and counted together.
LATTICE_BYTES, CHUNK = 1 << 20, 24 << 20
#: A word with at least one part in so many of all tokens is frequent, so there are at most so many.
FREQUENT = 1 << 19


def words_of(text: str | None) -> list[bytes]:
    """Words between blanks, tabs and line ends, A-Z lowered, as bytes."""
    return (text or "").encode("utf-8", "replace").lower().split()


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The same for many texts: the different words, and each token's text and word by number."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(large(texts)))
    words = cut.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    ids = words.indices.to_numpy()
    empty = pc.index(words.dictionary, "").as_py()
    if empty >= 0:  # beside blanks at the ends
        real = ids != empty
        doc, ids = doc[real], ids[real]
    return words.dictionary.cast(pa.large_binary()).cast(pa.binary()), doc, ids


# --- the vocabulary ------------------------------------------------------------------

def read_vocabulary(path: str) -> dict[bytes, float]:
    """Usable pieces and their first weights.

    A leading word mark becomes a blank.  Left out are pieces with a mark or
    blank elsewhere and with A-Z, which no word has.  All bytes are pieces.
    The scores of the file are ranks, so the weight falls with the rank.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    out: dict[bytes, float] = {}
    lowest = min((s for i in range(len(model)) if (s := model.get_score(i)) > -1e8), default=0.0)
    for i in range(len(model)):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        text, score = model.id_to_piece(i), model.get_score(i)
        if model.is_byte(i):
            piece, score = bytes([int(text[3:5], 16)]), lowest
        else:
            piece = text.replace("▁", " ").encode()
        if piece and BLANK not in piece[1:] and piece == piece.lower() and not piece[1:].isspace():
            out[piece] = max(out.get(piece, 0.0), 1 / (10 - max(score, lowest)))
    for b in range(256):
        if not 65 <= b <= 90:
            out.setdefault(bytes([b]), 1 / (10 - lowest))
    return dict(sorted(out.items()))


@dataclass
class Trie:
    """States of a walk along pieces: sorted (state, byte) keys, next states, piece that ends there or -1."""

    first: np.ndarray
    keys: np.ndarray
    following: np.ndarray
    piece: np.ndarray

    @classmethod
    def of(cls, pieces: list[bytes]) -> "Trie":
        step: dict[int, int] = {}
        ends = [-1]
        for i, p in enumerate(pieces):
            state = 0
            for b in p:
                state = step.setdefault(state << 8 | b, len(ends))
                if state == len(ends):
                    ends.append(-1)
            ends[state] = i
        keys = np.array(sorted(step), np.int64)
        following = np.array([step[k] for k in keys.tolist()], np.int64)
        first = np.full(256, -1)
        first[keys[keys < 256]] = following[keys < 256]
        return cls(first, keys, following, np.array(ends))

    def arcs(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of every piece found in the bytes."""
        at = np.arange(len(data))
        state = self.first[data]
        found, length = [], 1
        while len(at):
            piece = self.piece[state]
            hit = piece >= 0
            found.append((at[hit], np.full(int(hit.sum()), length), piece[hit]))
            go = at + length < len(data)
            at, state = at[go], state[go]
            key = state << 8 | data[at + length]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            go = self.keys[place] == key
            at, state = at[go], self.following[place[go]]
            length += 1
        return tuple(np.concatenate(x) for x in zip(*found))


# --- recursions ----------------------------------------------------------------------

class Lattice:
    """The pieces of many words of up to LONG bytes.

    Arcs are grouped by the place in the word where they end and by length:
    in a group no two end, or start, in one node, and groups in order only
    depend on earlier ones.
    """

    def __init__(self, trie: Trie, words: list[bytes]):
        data = np.frombuffer(BLANK + BLANK.join(words), np.uint8).astype(np.int64)
        start, length, self.piece = trie.arcs(data)
        blank = data == 32
        word = np.cumsum(blank) - 1
        begins = np.flatnonzero(blank)
        node = np.arange(len(data)) + word
        order = np.argsort(((start - begins[word[start]] + length) * 64 + length).astype(np.uint16), kind="stable")
        self.start, self.piece, length = node[start[order]], self.piece[order], length[order]
        self.word = word[start[order]]
        self.end = self.start + length
        group = (start[order] - begins[self.word] + length) * 64 + length
        self.cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
        self.first = node[begins]
        self.last = np.append(node[begins[1:]] - 1, len(data) + len(begins) - 1)
        self.nodes = len(data) + len(begins)

    def forward(self, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alpha = np.full(self.nodes, -np.inf)
        alpha[self.first] = 0
        cost = logp[self.piece]
        for a, b in zip(self.cuts, self.cuts[1:]):
            end = self.end[a:b]
            alpha[end] = np.logaddexp(alpha[end], alpha[self.start[a:b]] + cost[a:b])
        return alpha, alpha[self.last]

    def expected(self, logp: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each seen so many times."""
        alpha, total = self.forward(logp)
        beta = np.full(self.nodes, -np.inf)
        beta[self.last] = 0
        cost = logp[self.piece]
        for a, b in reversed(list(zip(self.cuts, self.cuts[1:]))):
            start = self.start[a:b]
            beta[start] = np.logaddexp(beta[start], beta[self.end[a:b]] + cost[a:b])
        share = np.exp(alpha[self.start] + cost + beta[self.end] - total[self.word]) * times[self.word]
        return np.bincount(self.piece, share, len(logp))


def log_add(a: float, b: float) -> float:
    a, b = max(a, b), min(a, b)
    return a if b == float("-inf") else a + log1p(exp(b - a))


def long_word(trie: Trie, word: bytes, logp: np.ndarray, times: float | None = None):
    """The same recursions for one word of any length; expected counts if ``times`` is given."""
    data = np.frombuffer(BLANK + word, np.uint8).astype(np.int64)
    start, length, piece = trie.arcs(data)
    order = np.argsort(start + length, kind="stable")
    arcs = list(zip(start[order].tolist(), (start + length)[order].tolist(), logp[piece[order]].tolist()))
    alpha = [float("-inf")] * (len(data) + 1)
    alpha[0] = 0.0
    for s, e, c in arcs:
        alpha[e] = log_add(alpha[e], alpha[s] + c)
    if times is None:
        return alpha[-1]
    beta = [float("-inf")] * (len(data) + 1)
    beta[-1] = 0.0
    for i in np.argsort(-start[order], kind="stable").tolist():
        s, e, c = arcs[i]
        beta[s] = log_add(beta[s], beta[e] + c)
    a, b = np.array(alpha), np.array(beta)
    share = np.exp(a[start] + logp[piece] + b[start + length] - alpha[-1]) * times
    return np.bincount(piece, share, len(logp))


def portions(words: list[bytes]) -> Iterator[slice]:
    first = size = 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= LATTICE_BYTES:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(words):
        yield slice(first, len(words))


def log_probabilities(trie: Trie, words: list[bytes], logp: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability."""
    out = np.zeros(len(words))
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    some = [words[i] for i in short]
    values = [Lattice(trie, some[part]).forward(logp)[1] for part in portions(some)]
    out[short] = np.concatenate(values) if values else []
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[i] = long_word(trie, w, logp)
    return out


# --- training ------------------------------------------------------------------------

def word_counts(docs: DataFrame, learn: Column, text: str = "text") -> DataFrame:
    """(word, n): every word of the texts, and how often the texts to learn from have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.column(0), CHUNK):
                words, doc, ids = tokens(batch.column(0)[part])
                counted = batch.column(1)[part].to_numpy(zero_copy_only=False).astype(bool)
                n = np.bincount(ids[counted[doc]], minlength=len(words)) if len(words) else np.zeros(0, np.int64)
                seen = np.bincount(ids, minlength=len(words)) > 0 if len(words) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([words.filter(pa.array(seen)), pa.array(n[seen].astype(np.int64))], ["word", "n"])
    return (docs.select(F.col(text).cast("string").alias("text"), learn.alias("learn")).mapInArrow(count, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def expected_counts(words: DataFrame, shared, logp: np.ndarray) -> np.ndarray:
    """Expected pieces over all counted words; the driver gets one number per piece."""
    probabilities = words.sparkSession.sparkContext.broadcast(logp)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, p = shared.value, probabilities.value
        total = np.zeros(len(p))
        for batch in batches:
            names, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            short = [i for i, w in enumerate(names) if len(w) <= LONG]
            some, times = [names[i] for i in short], n[short]
            for part in portions(some):
                total += Lattice(trie, some[part]).expected(p, times[part])
            for w, k in zip(names, n.tolist()):
                if len(w) > LONG:
                    total += long_word(trie, w, p, k)
        piece = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(total[piece])], ["piece", "n"])

    out = np.zeros(len(logp))
    for r in words.mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r["piece"]] = r["n"]
    return out


def with_log_probability(words: DataFrame, trie: Trie, logp: np.ndarray) -> DataFrame:
    """(word, n, p): the natural log of each word's probability."""
    shared = words.sparkSession.sparkContext.broadcast((trie, logp))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = log_probabilities(shared.value[0], batch.column(0).to_pylist(), shared.value[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], ["word", "n", "p"])
    return words.mapInArrow(add, "word binary, n long, p double")


@dataclass
class Model:
    """Piece probabilities (natural log) and the end's; the training counts and their sums.

    ``words`` has the words of all texts to be scored, with count zero if they
    were not learned.
    """

    trie: Trie
    logp: np.ndarray
    log_end: float
    words: DataFrame
    tokens: int
    distinct: int
    ends: int

    def knowing(self, docs: DataFrame, text: str = "text") -> "Model":
        """The same model, able to score further texts."""
        more = word_counts(docs, F.lit(False), text)
        return replace(self, words=checkpoint(self.words.unionByName(more).groupBy("word").agg(F.sum("n").alias("n"))))


def train(docs: DataFrame, learn: Column, vocabulary: dict[bytes, float], passes: int = 3, smooth: float = 0.1,
          text: str = "text") -> Model:
    """Learn from the texts marked by ``learn``; the model can score all of docs.

    A null text is empty and has an end only.
    """
    words = checkpoint(word_counts(docs, learn, text))
    ends = docs.filter(learn).count()
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    weight = np.array(list(vocabulary.values()))
    trie = Trie.of(list(vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast(trie)
    logp, log_end = np.log(0.99 * weight / weight.sum()), log(0.01)  # before anything is learned
    if facts["n"]:
        for _ in range(passes):
            n = expected_counts(words.filter("n > 0"), shared, logp) + smooth
            logp = np.log(n / (n.sum() + ends))
            log_end = log(ends / (n.sum() + ends))
    return Model(trie, logp, log_end, words, facts["n"] + ends, facts["v"] + (ends > 0), ends)


# --- scoring -------------------------------------------------------------------------

def score(docs: DataFrame, model: Model, *keep: Column, text: str = "text") -> DataFrame:
    """The kept columns and n_tokens, n_known, train_tokens, base_score, score (log10).

    Frequent words, of which there are at most FREQUENT, go to all tasks with
    their counts and probabilities; what a document has of other words is
    joined with the table of words.  A document's own row takes part in that
    join under a key no word has.  docs are texts the model was given.
    """
    floor = max(model.tokens, 1) / FREQUENT
    frequent = (F.col("n") >= floor) & (F.length("word") <= LONG)
    common = with_log_probability(model.words.filter(frequent), model.trie, model.logp).toArrow()
    frozen = docs.sparkSession.sparkContext.broadcast((common.column("word").combine_chunks(), common.column("n").to_numpy(), common.column("p").to_numpy()))
    log_end, ends = model.log_end, model.ends
    chosen = numbered(docs, F.struct(*keep).alias("kept"), F.col(text).cast("string").alias("text"))
    kept = chosen.schema["kept"].dataType.simpleString()
    schema = f"row long, word binary, times long, kept {kept}, n_tokens long, n_known long, base double, score double"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, logs = frozen.value
        base = np.append(np.log10(counts + 1.0), 0.0)  # the last stands for a rare word
        logs, known = np.append(logs, 0.0), np.append(counts > 0, False)
        for batch in batches:
            for cut in chunks(batch.column(2), CHUNK // 2):
                part = batch.slice(cut.start, cut.stop - cut.start)
                words, doc, ids = tokens(part.column(2))
                place = pc.fill_null(pc.index_in(words, names), len(names)).to_numpy(zero_copy_only=False)
                at = place[ids] if len(ids) else ids

                def total(values):
                    return np.bincount(doc, values[at], part.num_rows) if len(ids) else np.zeros(part.num_rows)
                row = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([BLANK + int(i).to_bytes(8, "big") for i in row], pa.binary()),
                    pa.array(np.zeros(len(row), np.int64)), part.column(1), pa.array(np.bincount(doc, minlength=len(row)) + 1),
                    pa.array(total(known).astype(np.int64) + (ends > 0)), pa.array(total(base) + np.log10(ends + 1.0)),
                    pa.array((total(logs) + log_end) / log(10))], heads)
                rare = at == len(names)
                pair, times = np.unique(doc[rare] * len(words) + ids[rare], return_counts=True)
                where, what = pair // max(1, len(words)), pair % max(1, len(words))
                nothing = [pa.nulls(len(pair), t) for t in (part.column(1).type, pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(row[where]), words.take(pa.array(what)), pa.array(times.astype(np.int64)), *nothing], heads)

    heads = ["row", "word", "times", "kept", "n_tokens", "n_known", "base", "score"]
    rare = with_log_probability(model.words.filter(~frequent), model.trie, model.logp)
    seen = chosen.mapInArrow(rows, schema).join(rare, "word", "left")
    hit = F.col("n").isNotNull()

    def plus(own: str, value: Column, none) -> Column:
        return (F.sum(own) + F.sum(F.when(hit, value).otherwise(none))).alias(own)
    all_of = seen.groupBy("row").agg(
        F.first("kept", ignorenulls=True).alias("kept"), F.sum("n_tokens").alias("n_tokens"),
        plus("n_known", F.when(F.col("n") > 0, F.col("times")).otherwise(0), 0),
        plus("base", F.col("times") * F.log10(F.col("n") + 1.0), 0.0),
        plus("score", F.col("times") * F.col("p") / log(10), 0.0))
    under = float(np.log10(model.tokens + model.distinct + 1.0))
    return all_of.select("kept.*", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                         (F.col("base") - F.col("n_tokens") * F.lit(under)).alias("base_score"), "score")
