import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from wardline.llm import packing as PK
from wardline.llm.common import chunks
from wardline.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
ODD = ["", " ", "Hello, world. it's", "a\tb\rc\x0bd\x1ce f g", "é ́x É ß İstanbul ΟΔΟΣ ΟΔΟΣ. ñ",
       "<|endoftext|> x<|startoftext|>y", "don't I'LL we've", "1234 12a3 a1,2.", "日本語 テスト 😀👍", "a" * 5000, "x," * 50,
       "Ⅷ ǅ ﬁ ﬁx K", "tail.\n\n\nnext,\r\nline ", "퟿\u0085z", "word.,", "Àéî. ÿ, ×÷"]


WHOLE, ENCODER = Tokenizer.from_file(PATH), PK.WordEncoder(PATH)


def exact(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


def ids_of(texts):
    ids, counts = ENCODER.encode(pa.array(texts, pa.string()))
    assert len(ids) == counts.sum()
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_ids_of_odd_texts():
    for text, got in zip(ODD, ids_of(ODD), strict=True):
        assert got == exact(text), text
    assert ids_of([""]) == [[]] and ids_of(["", ""]) == [[], []]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_ids_of_any_text(texts):
    assert ids_of(texts) == [exact(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text("aBzÀß' .,!<|>'s\t1é\u0301", max_size=40))
def test_ids_of_close_cases(text):
    assert ids_of([text]) == [exact(text)]


@pytest.mark.parametrize("size", [1, 10, 1 << 20])
def test_chunks(size):
    texts = pa.array(["one two", None, "", "x" * 30, "y"] * 3)
    parts = list(chunks(texts, size))
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(15))
    got = []
    for p in parts:
        ids, counts = ENCODER.encode(texts[p])
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [exact(t or "") for t in texts.to_pylist()]


def held(bins, capacity):
    got = Counter()
    for b in bins:
        assert b.copies > 0 and sum(a * t for a, t in b.content) <= capacity
        for length, times in b.content:
            got[length] += b.copies * times
    return got


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 2000), max_size=50))
def test_plan_places_every_piece(counts):
    c = np.zeros(51, np.int64)
    for k, v in counts.items():
        c[k] = v
    bins = PK.plan(c, 50)
    assert held(bins, 50) == Counter(counts)
    # never more than first fit would need
    assert sum(b.copies for b in bins) <= 2 * max(1, (c * np.arange(51)).sum() / 50) + 1
    assert held(PK.best_fit(c, 50), 50) == Counter(counts)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 40000).astype(int) + 1)
    c = np.bincount(lengths, minlength=2049)
    n = sum(b.copies for b in PK.plan(c, 2048))
    assert n <= np.ceil(lengths.sum() / 2048) * 1.002 + 1
    c[2048] = 0
    got, _ = check_program(c, 2048)
    assert got.size <= 1.005 * got.bound


def test_configuration_is_optimal():
    price = np.zeros(11)
    price[3], price[4], price[7] = 3.0, 4.2, 6.9
    knapsack = PK.Knapsack(price)
    assert dict(knapsack.configuration()) == {3: 2, 4: 1}
    assert dict(knapsack.configuration(7)) == {7: 1, 3: 1} and knapsack.having(7) == pytest.approx(9.9)
    wanted = np.zeros(11)
    wanted[7] = 1.0
    assert dict(knapsack.configuration(wanted=wanted, slack=0.4)) == {7: 1, 3: 1}
    assert dict(knapsack.configuration(wanted=wanted, slack=0.2)) == {3: 2, 4: 1}


def fewest(pieces, capacity):
    """The fewest sequences, by trying every place of every piece."""
    best = len(pieces)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= pieces[i]}:
            at = rooms.index(r)
            put(i + 1, [*rooms[:at], r - pieces[i], *rooms[at + 1:]])
        put(i + 1, [*rooms, capacity - pieces[i]])

    put(0, [])
    return best


def check_program(counts, capacity):
    """The solution covers all pieces, the bound is below it, and rounding adds no more than the configurations."""
    got = PK.solve(counts, capacity)
    covered = np.zeros(capacity + 1)
    for one, times in got.uses.items():
        assert times >= 0 and sum(a * n for a, n in one) <= capacity
        for a, n in one:
            covered[a] += times * n
    assert (covered >= counts * (1 - 1e-5)).all()
    assert got.bound <= got.size * (1 + 1e-5)
    n = sum(b.copies for b in PK.plan(counts, capacity))
    assert np.ceil(got.bound - 1e-6) <= n <= np.ceil(got.size) + len(got.uses)
    return got, n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 19), min_size=1, max_size=9))
def test_bound_is_below_the_fewest(pieces):
    counts = np.bincount(pieces, minlength=21)
    got, n = check_program(counts, 20)
    least = fewest(sorted(pieces, reverse=True), 20)
    assert np.ceil(got.bound - 1e-6) <= least <= n


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 2000), min_size=1, max_size=50))
def test_program_of_any_histogram(counts):
    c = np.zeros(51, np.int64)
    for k, v in counts.items():
        c[k] = v
    check_program(c, 50)


def test_program_of_long_pieces():
    """Above half a sequence every piece needs its own: the sum of lengths is far below what is needed."""
    c = np.zeros(2049, np.int64)
    c[1025:1900], c[100:140] = 50, 30
    got, n = check_program(c, 2048)
    assert got.bound == pytest.approx(875 * 50, rel=1e-4) and n == 875 * 50


def test_program_of_no_pieces():
    got = PK.solve(np.zeros(21, np.int64), 20)
    assert (got.uses, got.bound, got.size, PK.plan(np.zeros(21, np.int64), 20)) == ({}, 0.0, 0, [])


def check_packing(rows, texts, capacity):
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = Counter()
    for name, text in texts:
        ids = [*exact(text or ""), 0]
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s:s + capacity]
            want[name, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert got == want


@pytest.mark.parametrize("capacity", [16, 2048])
def test_round_trip(spark, capacity):
    texts = [*enumerate(ODD), (None, "no id"), (100, None), (3, ODD[3]), (3, ODD[3]), *((200 + i, "same words here") for i in range(50))]
    df = spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, row string, length int").repartition(4)
    check_packing(PK.pack(df, PATH, capacity).collect(), texts, capacity)


def test_empty_table(spark):
    assert PK.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_whole_table(spark, sf_dir):
    from wardline.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op3_configuration_packing"](spark, sf_dir).collect()
    check_packing(rows, docs, 2048)
    counts = np.bincount([r["length"] for r in rows], minlength=2049)
    whole, counts[2048] = counts[2048], 0
    got, n = check_program(counts, 2048)
    assert len({r["sequence_id"] for r in rows}) == n + whole <= np.ceil(got.bound + whole) * 1.01 + 1


def test_tasks_hand_memory_back_and_encode_in_parts(spark, monkeypatch):
    lean, tasks = PK.lean, []
    monkeypatch.setattr(PK, "lean", lambda run: tasks.append(run.__name__) or lean(run))
    docs = [(i, f"word{i} x{i}y plain Words, {'a-b ' * (i % 5)}") for i in range(50)]
    check_packing([r.asDict() for r in PK.pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect()], docs, 2048)
    assert sorted(tasks) == ["cut", "place"]
    encoder = PK.WordEncoder(PATH)
    texts = pa.array([t for _, t in docs] + [None, "", " ".join(f"n{i}-{i}" for i in range(2500))])
    whole = encoder.encode(texts)
    monkeypatch.setattr(PK, "UNITS", 3)
    assert all((a == b).all() for a, b in zip(whole, encoder.encode(texts)))
    empty = encoder.encode(pa.array(["", None]))
    assert len(empty[0]) == 0 and empty[1].tolist() == [0, 0]


def test_a_task_holds_one_batch_and_part_of_its_text(spark, monkeypatch):
    tasks, sizes, left = {}, [], []
    monkeypatch.setattr(PK, "lean", lambda run: tasks.setdefault(run.__name__, run))
    PK.pieces(spark.createDataFrame([(1, "a")], "doc_id long, text string"), PATH)
    monkeypatch.setitem(PK._encoders, PATH, ENCODER)
    monkeypatch.setattr(ENCODER, "encode", lambda texts: sizes.append(texts.nbytes) or PK.WordEncoder.encode(ENCODER, texts))
    text = "some words of a text " * 5000

    def batches():
        start = pa.total_allocated_bytes()
        for _ in range(3):
            left.append(pa.total_allocated_bytes() - start)
            yield pa.RecordBatch.from_arrays([pa.array(range(90)), pa.array(range(90)), pa.array([text] * 90)], ["row", "doc_id", "text"])

    pieces = sum(len(out) for out in tasks["cut"](batches()))
    assert pieces == 3 * 90 * -(-(len(exact(text)) + 1) // 2048)
    assert max(left) < len(text) * 9  # a tenth of a batch; the one before is gone
    assert max(sizes) < 5 << 20 and sum(sizes) >= 3 * 90 * len(text)
