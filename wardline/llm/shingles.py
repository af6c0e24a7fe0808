"""Words, lines and word shingles of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from wardline.llm.common import large

# What a byte of a word becomes; 0 is not in words. Words are digits, letters (A-Z lowered) and all beyond ASCII.
_BYTES = np.zeros(256, np.uint8)
for _low, _high in ((48, 58), (97, 123), (128, 256)):
    _BYTES[_low:_high] = np.arange(_low, _high)
_BYTES[65:91] = np.arange(97, 123)
# The first 0 to 8 bytes of eight.
_FIRST = np.array([2 ** (8 * n) - 1 for n in range(9)], np.uint64)
_TABLE, _OUTSIDE = _BYTES.tobytes(), np.flatnonzero(_BYTES == 0).astype(np.uint8).tobytes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(words: pa.Array) -> np.ndarray:
    """64-bit hashes of binary values, eight bytes at a time."""
    places = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    if not len(words):
        return np.zeros(0, np.uint64)
    data = np.append(np.frombuffer(words.buffers()[2], np.uint8)[:places[-1]], np.zeros(8, np.uint8))
    blocks = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
    at, size = places[:-1], np.diff(places)
    out = mixed(size.astype(np.uint64))
    left = np.arange(len(words))
    while len(left):
        block = blocks[at] & _FIRST[np.minimum(size, 8)]
        out[left] = mixed(out[left] + mixed(block + np.uint64(0x9E3779B97F4A7C15)))
        go = size > 8
        left, at, size = left[go], at[go] + 8, size[go] - 8
    return out


def cut_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the different words, each word's code number and first byte, the texts' bytes, and where each text begins.

    The last place is the end of the last text.
    """
    texts = large(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    whole = raw.tobytes()
    inside = np.frombuffer(whole.translate(_TABLE), np.uint8) != 0
    # Words begin and end in turn: where bytes of words meet others, and where texts, which lie side by side, meet within a word.
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edge = np.unique(offsets[(offsets > 0) & (offsets < len(raw))])
    edge = np.repeat(edge[inside[edge] & inside[edge - 1]], 2)
    turns = np.insert(turns, np.searchsorted(turns, edge), edge)
    turns = np.concatenate([np.flatnonzero(inside[:1]), turns, len(raw) + np.flatnonzero(inside[-1:])])
    starts, ends = turns[::2], turns[1::2]
    places = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(whole.translate(_TABLE, _OUTSIDE))]).dictionary_encode()
    return hashed(words.dictionary), words.indices.to_numpy(), starts, raw, offsets


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the words of all texts in order, and how many each text has."""
    codes, ids, starts, _, offsets = cut_words(texts)
    return codes[ids], np.diff(np.searchsorted(starts, offsets))


def line_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and number of each line, the codes of the different words, and each word's line and code number."""
    codes, ids, starts, raw, offsets = cut_words(texts)
    ends = np.flatnonzero(raw == 10)
    lines = np.diff(np.searchsorted(ends, offsets)) + 1
    text = np.repeat(np.arange(len(texts)), lines)
    number = np.arange(len(text)) - np.repeat(np.cumsum(lines) - lines, lines)
    # A line end at a text's end begins an empty line of that text, so it comes before the next text's first line.
    begins = np.sort(np.concatenate([offsets[:-1], ends + 1]), kind="stable")
    words = np.diff(np.searchsorted(starts, np.append(begins, len(raw))))
    return text, number, codes, np.repeat(np.arange(len(text)), words), ids


def shingles(codes: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k neighbouring words, and how many it has.

    A text with fewer words, but some, is one shingle of all of them.
    """
    ends = np.cumsum(counts)
    begins = ends - counts
    many = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    last = np.cumsum(many)
    at = np.repeat(begins - (last - many), many) + np.arange(last[-1] if len(last) else 0)
    stop = np.repeat(ends, many)
    out = np.zeros(len(at), np.uint64)
    padded = np.append(codes, np.zeros(k, np.uint64))
    for i in range(k):
        word = np.where(at + i < stop, padded[at + i], np.uint64(0))
        out = mixed(out + word + np.uint64(i + 1))
    return out, many
