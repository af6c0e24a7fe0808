"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of up to three bytes with the
counts of the bytes that followed.  A context is a node of the trees if it
makes up at least one part in ``min_share`` of the training bytes of any one
language, so a model has at most ``min_share`` nodes of each length and
language however much it is trained on, and a language with few bytes keeps as
many as others.  The probability of a byte follows PPM with escape method C and
exclusion: in a context seen C times with u different followers, a follower
seen c times has c / (C + u), and u / (C + u) goes to the other bytes in
proportion to the next shorter context; below the empty context all bytes are
alike.  After training the statistics are frozen, and a text's code length in
a language is the exact sum of -log2 of its bytes' probabilities in the trees
with these nodes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from wardline.session import checkpoint

ORDER = 3
#: Bytes of text handled at once, and distinct (language, bytes) a task keeps before it passes them on.
CHUNK, HELD = 1 << 20, 1 << 21
PAD = b"\0" * ORDER
LETTER = regex.compile(r"\p{L}")


def clean(text: str) -> bytes:
    return text.lower().replace("\0", " ").encode("utf-8", "replace")


def chunked(texts: Iterable[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, keys): parts of texts of bounded size one after another.

    Each part is led by the ORDER bytes before it, zeros at a text's start.
    A long text has several parts with the same key.
    """
    held: list[bytes] = []
    keys: list[int] = []
    size = 0

    def packed():
        lengths = np.array([len(h) for h in held])
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum(lengths) - lengths, np.array(keys)

    for key, data in texts:
        for at in range(0, len(data), CHUNK):
            part = (data[at - ORDER:at] if at else PAD) + data[at:at + CHUNK]
            held.append(part)
            keys.append(key)
            size += len(part)
            if size >= CHUNK:
                yield packed()
                held, keys, size = [], [], 0
    if held:
        yield packed()


def grams(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each byte with the three before it, as one number, but for the bytes that lead a part."""
    b = data.astype(np.uint32)
    own = np.ones(len(data), bool)
    for lead in range(ORDER):
        own[starts + lead] = False
    return ((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:])[own[3:]]


def context_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, code, n): how often each byte followed each three bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict] = {}

        def rows():
            for name, (codes, n) in sums.items():
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([name] * len(codes), pa.string()), "code": codes.astype(np.int64), "n": n})

        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(name, []).append(clean(value))
            for name, texts in by.items():
                for data, starts, _ in chunked((0, t) for t in texts):
                    codes, n = np.unique(grams(data, starts), return_counts=True)
                    if name in sums:
                        old, m = sums[name]
                        codes, back = np.unique(np.concatenate([old, codes]), return_inverse=True)
                        n = np.bincount(back, np.concatenate([m, n])).astype(np.int64)
                    sums[name] = codes, n
            if sum(len(c) for c, _ in sums.values()) > HELD:
                yield from rows()
                sums = {}
        yield from rows()

    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).dropna()
    return known.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Frozen trees: symbol of a byte, node of three symbols, bits[node * symbols + symbol, language]."""

    langs: list[str]
    symbol: np.ndarray
    width: int
    node: np.ndarray
    bits: np.ndarray

    def code_lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each part in each language."""
        s = self.symbol[data]
        at = self.node[(s[:-3] * self.width + s[1:-2]) * self.width + s[2:-1]].astype(np.int64) * self.width + s[3:]
        cost = np.zeros((len(s), len(self.langs)), np.float32)
        cost[3:] = self.bits[at]
        for lead in range(ORDER):  # the bytes that lead a part are not coded
            cost[starts + lead] = 0
        return np.add.reduceat(cost, starts, axis=0, dtype=np.float64)


def train(counts: DataFrame, min_share: int = 4096) -> Model | None:
    """The frozen model; None if there is nothing to learn from.

    The driver gets the counts of at most ``min_share`` contexts of each
    length and language, which is what a model may have.
    """
    counts = checkpoint(counts)
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return None
    of_lang = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # one row per language
    levels = []
    for k in range(ORDER + 1):
        ctx = F.shiftright("code", 8).bitwiseAND((1 << 8 * k) - 1)
        seen = counts.groupBy("lang", ctx.alias("ctx"), F.col("code").bitwiseAND(255).alias("sym")).agg(F.sum("n").alias("n"))
        kept = (seen.groupBy("lang", "ctx").agg(F.sum("n").alias("all")).join(F.broadcast(of_lang), "lang")
                .filter(F.col("all") * min_share >= F.col("total")).select("ctx").distinct())
        levels.append(seen.join(F.broadcast(kept), "ctx").toPandas() if k else seen.toPandas())
    return frozen(levels)


def frozen(levels: list[pd.DataFrame]) -> Model:
    langs = sorted(levels[0]["lang"].unique())
    by_byte = np.bincount(levels[0]["sym"], levels[0]["n"], 256)
    own = np.flatnonzero(by_byte)
    symbol = np.zeros(256, np.int64)  # 0: bytes that were never seen
    symbol[own] = np.arange(1, len(own) + 1)
    symbol[0] = pad = len(own) + 1  # never coded, but a context
    width, rare = pad + 1, max(1, 255 - len(own))

    nodes = [()]
    place = {(): 0}
    for k in range(ORDER + 1):
        for c in sorted(levels[k]["ctx"].unique()) if k else []:
            place[k, int(c)] = len(nodes)
            nodes.append((k, int(c)))
    index = np.zeros((), np.int32)
    for k in range(1, ORDER + 1):
        index = np.ascontiguousarray(np.broadcast_to(index, (width,) * k))
        for (kk, c), at in [(x, y) for x, y in place.items() if x and x[0] == k]:
            index[tuple(symbol[(c >> 8 * (k - 1 - i)) & 255] for i in range(k))] = at

    n = np.zeros((len(nodes), len(langs), width))
    lang_of = {x: i for i, x in enumerate(langs)}
    for k in range(ORDER + 1):
        d = levels[k]
        at = np.array([place[(k, int(c)) if k else ()] for c in d["ctx"]], np.int64)
        np.add.at(n, (at, d["lang"].map(lang_of).to_numpy(), symbol[d["sym"].to_numpy()]), d["n"].to_numpy())

    flat = np.full((len(langs), width), 1 / pad)
    flat[:, pad] = 0
    p = np.zeros_like(n)
    for i, name in enumerate(nodes):  # shorter contexts come first
        if not name:
            below = flat
        else:
            k, c = name
            below = p[place[(k - 1, c & ((1 << 8 * (k - 1)) - 1)) if k > 1 else ()]]
        seen = n[i] > 0
        seen[:, pad] = True
        sums, kinds = n[i].sum(1, keepdims=True), (n[i] > 0).sum(1, keepdims=True)
        kinds = np.where(seen.all(1, keepdims=True), 0, kinds)
        rest = np.where(seen, 0, below)
        left = rest.sum(1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            p[i] = np.where(sums > 0, n[i] / (sums + kinds) + kinds / (sums + kinds) * rest / np.where(left > 0, left, 1), below)
    p[:, :, 0] /= rare
    with np.errstate(divide="ignore"):
        bits = np.where(p > 0, -np.log2(p), 0).astype(np.float32)
    return Model(langs, symbol, width, index.ravel(), np.ascontiguousarray(bits.transpose(0, 2, 1).reshape(-1, len(langs))))


def predict(docs: DataFrame, model: Model | None, *keep: Column, text: str = "text") -> DataFrame:
    """The kept columns with lang_pred, score and bits_per_byte.

    lang_pred has the shortest code (ties: first in name order), or ``und``
    with score 0 for a text that is null or has no letter, and where nothing
    was learned.  score is the language's share of 2^-bits over the languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # Kept columns go by place, so that no name of theirs can clash.
    chosen = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"))
    kept = chosen.schema["kept"].dataType

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            real = [m is not None and t is not None and LETTER.search(t) is not None for t in texts]
            bits = np.zeros((len(texts), len(m.langs) if m else 1))
            sizes = np.zeros(len(texts))
            if any(real):
                for data, starts, keys in chunked((i, clean(t)) for i, t in enumerate(texts) if real[i]):
                    np.add.at(bits, keys, m.code_lengths(data, starts))
                    np.add.at(sizes, keys, np.diff(np.append(starts, len(data))) - ORDER)
            best = bits.argmin(1)
            low = bits.min(1)
            share = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([m.langs[b] if r else "und" for b, r in zip(best.tolist(), real)], pa.string()),
                pa.array(np.where(real, share, 0.0)), pa.array(np.where(real, low / np.maximum(sizes, 1), 0.0))],
                ["kept", "lang_pred", "score", "bits_per_byte"])

    out = chosen.mapInArrow(score, f"kept {kept.simpleString()}, lang_pred string, score double, bits_per_byte double")
    return out.select("kept.*", "lang_pred", "score", "bits_per_byte")
