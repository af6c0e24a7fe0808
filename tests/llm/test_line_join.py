import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardline.llm import line_join as LJ, shingles as SH
from wardline.session import checkpoint

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
small = lambda text: re.sub("[A-Z]+", lambda m: m[0].lower(), text)
SCHEMA = "doc_id long, text string, row string, line int"


def naive(docs, t=0.8):
    """Every line against all earlier ones, in the order of doc_id (null last) and line."""
    seen, out = [], {}
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    for i in order:
        if docs[i][1] is None:
            out[i] = None
            continue
        keep = []
        for line in docs[i][1].split("\n"):
            w = frozenset(WORD.findall(small(line)))
            if not w or not any(len(w & s) >= t * len(w | s) - 1e-9 for s in seen):
                keep.append(line)
            if w:
                seen.append(w)
        out[i] = "\n".join(keep)
    return Counter((docs[i][0], out[i]) for i in order)


def corpus(seed, n=60, vocab=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)] + ["É", "the", "THE", "a"]
    line = lambda: [rng.choice(words[:rng.choice([6, vocab])]) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 9, 12, 25]))]
    pool = [line() for _ in range(25)]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 8)):
            x = list(rng.choice(pool)) if rng.random() < 0.6 else line()
            if x and rng.random() < 0.6:
                x[rng.randrange(len(x))] = rng.choice(words)
            rng.shuffle(x)
            lines.append(rng.choice([" ", ", "]).join(x))
        docs.append((rng.choice([i, i, 1000 - i]), "\n".join(lines), "x", 1))
    return docs + [(5000, None, "x", 1), (5001, "", "x", 1), (5002, "\n\n . \n", "x", 1), (None, docs[3][1], "x", 1), (None, "only here last", "x", 1)]


def ours(spark, docs, **options):
    # One partition, so that rows of equal id keep their order.
    df = checkpoint(spark.createDataFrame(docs, SCHEMA).coalesce(1))
    rows = LJ.without_repeats(df, **options).collect()
    assert all(r["__lines"]["n_lines"] - r["__lines"]["n_removed"] == len(r["text"].split("\n")) for r in rows
               if r["text"] and r["__lines"]["n_removed"] < r["__lines"]["n_lines"])
    return Counter((r["doc_id"], r["text"]) for r in rows)


@pytest.mark.parametrize("seed, parts, chunk, most", [
    (1, 1 << 17, 1 << 20, 3), (2, 1, 1 << 20, 3), (3, 8, 300, 1), (4, 30, 100, 1), (5, 1 << 17, 50, 3)])
def test_against_brute_force(spark, monkeypatch, seed, parts, chunk, most):
    monkeypatch.setattr(LJ, "LEAST_PARTS", parts)
    monkeypatch.setattr(LJ, "MOST_PARTS", max(parts, 2))
    monkeypatch.setattr(LJ, "CHUNK", chunk)
    monkeypatch.setattr(LJ, "BUCKET_ROWS", chunk)
    docs = corpus(seed)
    assert ours(spark, docs, most=most) == naive(docs)


def test_other_limits(spark):
    docs = corpus(7)
    for t in (0.6, 0.95):
        assert ours(spark, docs, similarity=t) == naive(docs, t)


def test_full_filter(spark, monkeypatch):
    monkeypatch.setattr(LJ, "FILTER_BITS", 64)  # says yes to nearly every line
    docs = corpus(8)
    assert ours(spark, docs) == naive(docs)


def test_many_lines_of_one_key(spark, monkeypatch):
    monkeypatch.setattr(LJ, "MOST_PARTS", 1)
    monkeypatch.setattr(LJ, "LEAST_PARTS", 1)
    rng = random.Random(1)
    docs = [(i, " ".join(["rare", *rng.sample([f"v{j}" for j in range(14)], rng.randint(4, 9))]), "x", 1) for i in range(300)]
    assert ours(spark, docs) == naive(docs)


def test_later_rounds(spark, monkeypatch):
    """Lines whose nearest candidates fail are checked against others, and then against all."""
    real, real_met, calls = LJ.checked, LJ.met, []

    def failing(*args):
        calls.append(1)
        out = real(*args)
        return out.filter(F.lit(False))
    monkeypatch.setattr(LJ, "checked", failing)
    docs = corpus(9)
    real_last = LJ.compared_with_all
    monkeypatch.setattr(LJ, "compared_with_all", lambda still, *rest: calls.append(still.count()) or real_last(still, *rest))
    ours(spark, docs, first=1, most=1)
    assert len(calls) == 3 and calls[2] > 0
    # With all lines in the last round, it finds by itself all there is to find.
    for limit in (0, 1 << 40):
        monkeypatch.setattr(LJ, "compared_with_all", lambda *a, limit=limit: real_last(*a, broadcast_words=limit))
        monkeypatch.setattr(LJ, "checked", lambda *a: real(*a).filter(F.lit(False)))
        monkeypatch.setattr(LJ, "met", lambda *a: real_met(*a).withColumn("more", F.lit(True)))
        assert ours(spark, docs) == naive(docs)
    monkeypatch.setattr(LJ, "checked", real)
    monkeypatch.setattr(LJ, "met", real_met)
    monkeypatch.setattr(LJ, "compared_with_all", real_last)
    for first, most in ((1, 1), (1, 2), (3, 3)):
        assert ours(spark, docs, first=first, most=most) == naive(docs)


def test_a_hot_key_is_cut(spark, monkeypatch):
    """Lines of one template are all in one key; no place where they meet holds them all, and the result is exact."""
    monkeypatch.setattr(LJ, "HOT_ROWS", 60, raising=False)
    monkeypatch.setattr(LJ, "DEALT", 50, raising=False)
    monkeypatch.setattr(LJ, "LEAST_PARTS", 20)
    rng = random.Random(6)
    lines = [f"page p{rng.randrange(10**6)} of the long report q{i % 40}" for i in range(300)]
    lines += [f"page {x.split()[1]} of the long report more" for x in lines[::10]] + [x + " of" for x in lines[::15]]
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[i::30]), "x", 1) for i in range(30)]
    real, real_last, sizes = LJ.met, LJ.compared_with_all, []

    def largest(rows, *rest):
        count = Counter()
        for b, columns in (x for batch in rows.toArrow().to_batches() for x in LJ.unpacked(batch)):
            count.update((b, int(k)) for k, p in zip(columns[0], columns[6]) if p >= 0)
        sizes.append(max(count.values()))
        return real(rows, *rest)
    monkeypatch.setattr(LJ, "met", largest)
    assert ours(spark, docs) == naive(docs)
    assert 20 < sizes[0] <= 100
    # The last round, by a shuffle: every line is asked about.
    monkeypatch.setattr(LJ, "checked", lambda pairs, *rest: pairs.select("row", "line", F.lit(False).alias("similar")))
    monkeypatch.setattr(LJ, "met", lambda *a: real(*a).withColumn("more", F.lit(True)))
    monkeypatch.setattr(LJ, "compared_with_all", lambda *a: real_last(*a, broadcast_words=0))
    assert ours(spark, docs) == naive(docs)


def test_shuffled_list(spark):
    docs = corpus(6)
    assert ours(spark, docs, broadcast_lines=-1) == naive(docs)


def test_long_lines(spark):
    """All sizes of bit maps, with neighbours in the next size."""
    rng = random.Random(12)
    docs = []
    for n in (30, 60, 64, 65, 70, 120, 128, 130, 250, 256, 260, 300, 700, 2000):
        base = [f"k{n}x{j}" for j in range(n)]
        for change in (0.0, 0.05, 0.09, 0.1, 0.12, 0.15, 0.2, 0.4):
            copy = [w if rng.random() > change else f"z{rng.random()}" for w in base]
            docs.append((len(docs), " ".join(copy[:rng.randint(int(0.9 * n), n)]), "x", 1))
    rng.shuffle(docs)
    assert ours(spark, docs) == naive(docs)


def test_bit_maps():
    rng = np.random.default_rng(4)
    sets = [rng.choice(2**62, n, replace=False).astype(np.uint64) for n in (1, 5, 64, 65, 128, 129, 256, 257, 900)]
    word = np.concatenate(sets)
    n = np.array([len(s) for s in sets])
    maps = LJ.bit_maps(word, np.cumsum(n) - n, n)
    for i, s in enumerate(sets):
        w = int(LJ.map_words(n[i:i + 1])[0])
        assert not maps[i, w:].any() and np.bitwise_count(maps[i]).sum() % 2 == n[i] % 2
        alone = LJ.bit_maps(s, np.array([0]), n[i:i + 1])
        assert (alone == maps[i]).all()
        while w > 1:  # folding gives the map that fewer bits would have
            w //= 2
            h = LJ.mixed(s + np.uint64(7))
            want = [int(np.bitwise_xor.reduce(np.where((h >> np.uint64(6)) % np.uint64(w) == k, np.uint64(1) << (h & np.uint64(63)), np.uint64(0)))) for k in range(w)]
            assert LJ.folded(maps[i:i + 1], w)[0].tolist() == want


@pytest.mark.parametrize("held", [1, 50, 1 << 20])
def test_near_pairs_against_all_pairs(monkeypatch, held):
    monkeypatch.setattr(LJ, "HELD_PAIRS", held)
    rng = np.random.default_rng(held)
    k = 150
    group, n = np.sort(rng.integers(0, 3, k)), rng.integers(2, 9, k)
    order = np.lexsort((n, group))
    n, pos = n[order], rng.integers(0, 2, k)
    bits, rank = rng.integers(0, 16, k).astype(np.uint64), rng.permutation(k)
    maps = np.zeros((k, 8), np.uint64)
    maps[:, 0] = bits
    for most in (1, 3, 1 << 40):
        want = {}
        for x in range(k):
            fits = []
            for y in range(k):
                need = -(-4 * int(n[x] + n[y]) // 9)
                u = int(bits[x] ^ bits[y]).bit_count()
                if group[x] == group[y] and rank[y] < rank[x] and 5 * min(n[x], n[y]) >= 4 * max(n[x], n[y]) \
                        and u <= n[x] + n[y] - 2 * need and (n[x] != n[y] or 2 * n[x] - 2 * need >= 2) and min(n[x] - pos[x], n[y] - pos[y]) >= need:
                    fits.append((u, rank[y], y, int(n[x] + n[y] - 2 * need)))
            limit = min(1, most) if fits and 2 * min(fits)[0] <= min(fits)[3] else most
            for u, _, y, _ in sorted(fits)[:limit]:
                want[x, int(y)] = (u, len(fits) > limit)
        # Searches in large groups may end early, but not where all that is found is kept.
        large = LJ.near_pairs(group, n, pos, maps, rank, 0.8, 1 << 40, most, large=5)
        assert {int(x) for x in large[0]} == {x for x, _ in want}
        if most > 3:
            assert {(int(x), int(y)) for x, y in zip(*large[:2])} >= set(want)
        early = LJ.near_pairs(group, n, pos, maps, rank, 0.8, 1, most, large=5)
        assert {int(x) for x in early[0]} == {x for x, _ in want}
        got = LJ.near_pairs(group, n, pos, maps, rank, 0.8, 1, most)
        assert {(int(x), int(y)): (int(u), bool(m)) for x, y, u, _, m in zip(*got)} == want and want


def test_empty_table(spark):
    assert ours(spark, []) == Counter() and ours(spark, [(1, None, "x", 1)]) == Counter({(1, None): 1})


def test_packs():
    rng = np.random.default_rng(0)
    k, m = 500, 60
    sizes = rng.choice([1, 64, 65, 200, 300, 70000], m)
    maps = np.where(np.arange(8) < LJ.map_words(sizes)[:, None], rng.integers(0, 2**63, (m, 8)).astype(np.uint64), np.uint64(0))
    of = rng.integers(0, m, k)
    columns = [rng.integers(0, 2**32, k), rng.integers(0, 2**32, k), sizes[of], np.where(rng.random(k) < 0.1, LJ.LAST, rng.integers(-5, 9, k)),
               rng.integers(0, 2**40, k), rng.integers(0, 300, k), rng.integers(-2, 3, k)]
    bucket = rng.integers(0, 7, k)
    got = [(b, *map(int, r[:-1]), tuple(r[-1].tolist())) for b, cols in LJ.unpacked(LJ.packs(bucket, columns, maps, of)) for r in zip(*cols)]
    assert Counter(got) == Counter((int(b), *map(int, r), tuple(maps[o].tolist())) for b, o, *r in zip(bucket, of, *columns))


def test_prefix_and_overlap():
    n = np.arange(1, 200)
    p = LJ.prefix_sizes(n, 0.8)
    assert (p >= 1).all() and (n - p + 1 == np.ceil(0.8 * n - 1e-9)).all()
    for a in range(1, 60):
        for b in range(a, 60):
            need = int(LJ.overlap_needed(np.array([a + b]), 0.8)[0])
            assert all((c >= need) == (5 * c >= 4 * (a + b - c)) for c in range(a + 1))


def test_line_words_of_slices():
    texts = pa.array(["A b\n\nc É", None, "", "x-y\nx"])
    for low in range(5):
        text, number, codes, line, ids = LJ.line_words(texts[low:])
        want = [(i, j, w) for i, t in enumerate(texts[low:].to_pylist()) for j, x in enumerate((t or "").split("\n")) for w in WORD.findall(small(x))]
        assert [(int(text[a]), int(number[a])) for a in line] == [w[:2] for w in want]
        assert len(set(codes[ids].tolist())) == len({w[2] for w in want})


def test_whole_table(spark, sf_dir):
    from wardline.llm.queries import QUERIES

    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = Counter((r["doc_id"], r["text"]) for r in QUERIES["op8_line_similarity"](spark, sf_dir).collect())
    assert got == fast(docs)


def fast(docs):
    """The same as naive, by an index of words."""
    where, sets, out = {}, [], Counter()
    for name, text in docs:
        keep = []
        for line in text.split("\n"):
            w = frozenset(WORD.findall(small(line)))
            common = Counter(j for x in w for j in where.get(x, ()))
            if not any(5 * n >= 4 * (len(w) + len(sets[j]) - n) for j, n in common.items()):
                keep.append(line)
            for x in w:
                where.setdefault(x, []).append(len(sets))
            sets.append(w)
        out[name, "\n".join(keep)] += 1
    return out


def test_short_lines_that_share_hash_bits_stay(spark):
    """Lines of one rare word each, which once were told apart by too few bits."""
    ids = ["id200374", "id2084577", "id210337", "id1808543", "id2100364", "id2477244"]
    docs = [(0, " ".join(f"filler{i}" for i in range(6000)))] + [(i + 1, x) for i, x in enumerate(ids)]
    df = spark.createDataFrame(docs + [(9, "id210337")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in LJ.without_repeats(df).collect()}
    assert [got[i + 1] for i in range(6)] == ids and got[9] == ""


def test_words_are_told_apart_by_all_their_bits():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 2**64, 50_000, dtype=np.uint64) >> np.uint64(1) << np.uint64(1))
    close = np.concatenate([codes, codes + np.uint64(1 << 5)])  # differ in a low bit only
    number, known = LJ.Order(codes[:100]).numbers(close)
    assert len(np.unique(number)) == len(np.unique(close)) and known.sum() == 100
    assert number[known].min() > number[~known].max()


def test_candidates_grow_with_the_lines(spark, tmp_path):
    """Every line is near thousands of others, yet passes on a few under each of its keys."""
    rows = [(i, f"the page of one long report on these many things and others n{i % 3000} m{i // 3000}") for i in range(6000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    frequent, words = LJ.frequent_words(docs, "text")
    order = spark.sparkContext.broadcast(LJ.Order(frequent))
    spread = spark.sparkContext.broadcast(LJ.spread_of(docs, order, words, 0.8, "text"))
    found = LJ.met(LJ.meetings(docs, order, 4, 0.8, "doc_id", "text", spread), 4, 0.8, LJ.FIRST, LJ.NEAREST).filter("to_row is not null")
    per_line = found.groupBy("row", "line").count().agg(F.max("count"), F.count("*")).first()
    assert per_line[0] <= 6 * LJ.NEAREST and per_line[1] > 5000


def test_a_pair_is_passed_on_once_for_a_shared_first_word(spark, tmp_path):
    """Lines that share many pairs of frequent words meet under each, but are few candidates."""
    rng = random.Random(8)
    rows = []
    for i in range(300):
        words = rng.sample([f"w{k}" for k in range(200)], 40)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-1] + ["other"]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    frequent, words = LJ.frequent_words(docs, "text")
    assert len(frequent) == 201
    order = spark.sparkContext.broadcast(LJ.Order(frequent))
    spread = spark.sparkContext.broadcast(LJ.spread_of(docs, order, words, 0.8, "text"))
    found = checkpoint(LJ.met(LJ.meetings(docs, order, 4, 0.8, "doc_id", "text", spread), 4, 0.8, LJ.FIRST, LJ.NEAREST).filter("to_row is not null"))
    assert found.select("row", "line", "to_row", "to_line").distinct().count() == 300
    assert found.count() <= 4 * 300  # once in each bucket at most


def test_merged_pairs():
    line = LJ.lines_of(np.array([7, 7, 8, 8, 9, 9]), np.array([0, 0, 1, 1, 0, 1]))
    assert line[0] == line[1] and line[2] == line[3] and len(set(line.tolist())) == 4
    later, earlier = np.array([2, 3, 4, 5, 4]), np.array([0, 1, 0, 1, 3])
    more = np.array([False, True, False, False, False])
    x, y, unequal, more = LJ.merged(later, earlier, np.array([1, 1, 2, 3, 1]), np.full(5, 4), more, line, np.arange(6), 1)
    assert {(int(line[a]), int(line[b]), int(u), bool(m)) for a, b, u, m in zip(x, y, unequal, more)} == {
        (line[2], line[0], 1, True), (line[4], line[3], 1, True), (line[5], line[0], 3, False)}


def test_only_words_that_lines_meet_by_are_marked(spark):
    word = [np.arange(1, 41, dtype=np.uint64) * np.uint64(1 + i) for i in range(3)]
    sets = spark.createDataFrame([(i, 0, bytearray(w.tobytes())) for i, w in enumerate(word)], "row long, line int, words binary")
    words, keys = LJ.marked_keys(sets, 0.8)
    first = np.concatenate([w[:10] for w in word])  # nine words of 40, and one more for pairs of frequent words
    assert LJ.has_bit(words, LJ.bits_of(first)).all()
    assert LJ.has_bit(keys, LJ.bits_of(np.concatenate([w[:9] for w in word]))).all()
    assert np.bitwise_count(words).sum() <= len(first)


def test_rows_that_share_a_key():
    key, pos = np.array([5, 5, 5, 7, 7, 9, 5], np.uint32), np.array([0, -1, 3, -1, -2, 0, -2])
    assert sorted(LJ.shared(key, pos).tolist()) == [0, 2]
    assert LJ.repeated(np.array([], np.int64)).tolist() == []
    assert sorted(LJ.repeated(np.array([3, 1, 3, 2, 1])).tolist()) == [0, 1, 2, 4]


def test_hot_keys_are_found_from_the_shares_of_tasks(spark, monkeypatch):
    """Tasks pass on little more than the hot slots; a key that is hot only over all of them is one."""
    monkeypatch.setattr(LJ, "HOT_ROWS", 64)
    docs = spark.createDataFrame([(f"hot x{i}a x{i}b x{i}c",) for i in range(160)], "text string").repartition(4)
    order = spark.sparkContext.broadcast(LJ.Order(np.zeros(0, np.uint64)))
    passed, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda *a: passed.append(real(*a)) or passed[-1])
    cut = LJ.spread_of(docs, order, 640, 0.3, "text")
    hot = SH.hashed(pa.array([b"hot"], pa.binary())) >> np.uint64(1)
    assert cut.of(LJ.mixed(hot))[0] > 1
    assert len(cut.slots) == 1
    assert passed[0].count() <= 8 * 2


def test_rows_are_compared_only_as_far_as_their_place_allows(monkeypatch):
    g = np.random.default_rng(3)
    n = np.sort(g.integers(2, 60, 400))
    pos = (g.random(400) * (LJ.prefix_sizes(n, 0.8) + 1)).astype(np.int64)
    words = np.concatenate([g.choice(70, k, replace=False) for k in n]).astype(np.uint64)
    maps, rank = LJ.bit_maps(words, np.cumsum(n) - n, n), g.permutation(400)
    handed, near = [], LJ.Sets.near
    monkeypatch.setattr(LJ.Sets, "near", lambda self, a, b: handed.append((a, b)) or near(self, a, b))
    LJ.near_pairs(np.zeros(400, np.int64), n, pos, maps, rank, 0.8, 2, 4)
    a, b = (np.concatenate(x) for x in zip(*handed))
    i, j = np.triu_indices(400, 1)
    need = LJ.overlap_needed(n[i] + n[j], 0.8)
    room = n[j] <= np.floor(n[i] / 0.8 + 1e-9)
    can = room & (n[i] - pos[i] >= need) & (n[j] - pos[j] >= need)
    # All that can be similar are compared, and none that the smaller one's place rules out.
    assert set(zip(i[can].tolist(), j[can].tolist())) <= set(zip(a.tolist(), b.tolist()))
    assert (n[a] - pos[a] >= LJ.overlap_needed(n[a] + n[b], 0.8)).all() and len(a) < room.sum() / 2


def test_word_hashes_bit_maps_and_places_of_words():
    words = [b"", b"a", b"1234567", b"12345678", b"123456789", b"x" * 16, b"y" * 17, "é日".encode() * 9]

    def by_byte(word):
        out = SH.mixed(np.array([len(word)], np.uint64))
        for i in range(0, max(1, len(word)), 8):
            block = np.array([int.from_bytes(word[i:i + 8], "little")], np.uint64)
            out = SH.mixed(out + SH.mixed(block + np.uint64(0x9E3779B97F4A7C15)))
        return int(out[0])
    assert SH.hashed(pa.array(words, pa.binary())).tolist() == [by_byte(w) for w in words]
    assert SH.hashed(pa.array(words, pa.binary()).slice(3, 4)).tolist() == [by_byte(w) for w in words[3:7]]

    n = np.array([1, 64, 65, 128, 129, 256, 257, 700, 3])
    word, start = np.random.default_rng(5).integers(0, 2**62, n.sum()).astype(np.uint64), np.cumsum(n) - n
    h = SH.mixed(word + np.uint64(7))
    want = np.zeros((len(n), 8), np.uint64)
    for s, (first, k) in enumerate(zip(start, n)):
        for x in h[first:first + k].tolist():
            want[s, (x >> 6) % int(LJ.map_words(n[s:s + 1])[0])] ^= np.uint64(1 << (x & 63))
    assert (LJ.bit_maps(word, start, n) == want).all()

    texts = pa.array(["ab", "Cd e", None, "", "", "f-", "-g", "h", "-", "é1\n2"])
    starts, raw, offsets = SH.cut_words(texts)[2:]
    assert [bytes(raw[a:a + 1]) for a in starts] == [b"a", b"C", b"e", b"f", b"g", b"h", "é".encode()[:1], b"2"]
    assert np.diff(np.searchsorted(starts, offsets)).tolist() == [1, 2, 0, 0, 0, 1, 1, 1, 0, 2]
