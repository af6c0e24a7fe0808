import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql.datasource import CaseInsensitiveDict
from tokenizers import Tokenizer

from wardline.llm import token_blocks as TB
from wardline.llm.queries import QUERIES, tokenizer_path
from wardline.sources.stores import fresh_dir

PATH = tokenizer_path("word_bpe_49k.json")


def round_trip(ids, share=TB.SHARE):
    blocks = TB.encode_blocks(ids, share)
    starts = np.cumsum([0] + [len(b) for b in blocks], dtype=np.int64)[:-1]
    return TB.decode_blocks(memoryview(b"".join(blocks)), starts)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 32), st.sampled_from([0.0, 0.5, 0.9, 1.0]), st.integers(0, 9))
def test_blocks_round_trip(n, bits, share, seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
    ids[rng.random(n) < 0.02] = 2**32 - 1
    assert np.array_equal(round_trip(ids, share), ids)


def test_outliers_are_exceptions():
    ids = np.arange(1024, dtype=np.uint32) % 16 + 5000
    assert len(TB.encode_blocks(ids)[0]) == TB.HEAD.itemsize + 4 * TB.LANES * 4
    ids[[3, 700]] = [4_000_000_000, 70_000]
    block = TB.encode_blocks(ids)[0]
    head = np.frombuffer(block[:TB.HEAD.itemsize], TB.HEAD)[0]
    assert (head["low"], head["width"], head["exceptions"]) == (5000, 4, 2)
    assert len(block) == TB.HEAD.itemsize + 4 * TB.LANES * 4 + 2 * 6
    assert np.array_equal(round_trip(ids), ids)


def test_part_of_a_file():
    rng = np.random.default_rng(2)
    lengths = [np.array([1, 5000, 3]), np.array([2]), np.array([700, 9000, 1, 1])]
    ids = [rng.integers(0, 50_000, n.sum()).astype(np.uint32) for n in lengths]
    sink = io.BytesIO()
    sink.close, close = (lambda: None), sink.close
    out = TB.FileWriter(sink)
    for i, (n, x) in enumerate(zip(lengths, ids)):
        out.add(pa.array([f"{i}{j}" for j in range(len(n))]), n, x)
    out.close()
    file = TB.FileReader(pa.BufferReader(sink.getvalue()))
    close()
    flat = np.concatenate(ids)
    assert len(file.starts) == -(-len(flat) // TB.BLOCK) + 1
    assert file.documents(1).to_pydict() == {"doc_id": ["10"], "n": [2]}
    for first, many in [(0, len(flat)), (1023, 2), (1024, 1024), (5004, 9000), (len(flat) - 1, 1), (7, 0)]:
        got = list(file.runs(first, many, size=2048))
        assert np.array_equal(np.concatenate([np.zeros(0, np.uint32), *got]), flat[first:first + many])
        assert all(len(g) <= 2048 for g in got)
    with pytest.raises(ValueError):
        TB.FileReader(pa.BufferReader(b"x" * 200))


def expected(rows, end_id=2):
    whole, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        start += len(ids)
    return out


def test_odd_documents(spark, tmp_path):
    rows = [(5, "two words", 1), (None, "no id", 2), (5, "two words", 3), (1, None, 4), (-3, "", 5), (9, "é x, " * 4000, 6), (2, "\n\t ", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(3).sortWithinPartitions("start")
    df.write.parquet(str(tmp_path / "in"))
    TB.write(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out"), PATH)
    got = [tuple(r) for r in TB.read(spark, str(tmp_path / "out"), ids=True).collect()]
    assert got == expected(sorted(((a, b) for a, b, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0)))


def test_empty_and_appended(spark, tmp_path):
    path = "file://" + str(tmp_path / "out")
    one = spark.createDataFrame([("b", "more"), ("a", "text")], "doc_id string, text string")
    TB.write(one.limit(0), path, PATH)
    assert TB.read(spark, path).count() == 0
    TB.write(one, path, PATH, end_id=7)
    TB.write(one.filter("doc_id = 'a'"), path, PATH, end_id=7)
    (tmp_path / "out" / "part-000000-left.pfor").write_bytes(b"what a lost task wrote")
    got = [tuple(r) for r in TB.read(spark, path, ids=True).orderBy("start").collect()]
    assert got == expected([("a", "text"), ("b", "more"), ("a", "text")], 7)


def test_splits_read_alike(spark, sf_dir, tmp_path):
    spark.dataSource.register(TB.TokenBlocks)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").coalesce(1)
    old, TB.CHUNK = TB.CHUNK, 1 << 14
    try:
        rows = iter(docs.toArrow().to_batches())
        options = CaseInsensitiveDict({"path": str(tmp_path / "s"), "tokenizer": PATH, "idsPerSplit": "20000"})
        writer = TB.Writer(options, "bigint", False)
        with pytest.MonkeyPatch.context() as m:
            m.setattr(TB, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda s: 0})())}))
            writer.commit([writer.write(rows), None])
    finally:
        TB.CHUNK = old
    many = TB.read(spark, str(tmp_path / "s"))
    assert many.rdd.getNumPartitions() > 3
    whole = QUERIES["op13_patched_blocks"](spark, sf_dir)
    assert sorted(many.collect()) == sorted(whole.collect())


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = [tuple(r) for r in QUERIES["op13_patched_blocks"](spark, sf_dir).orderBy("start").collect()]
    assert got == [r[:4] for r in expected([(d["doc_id"], d["text"]) for d in docs])]


def test_file_is_small(spark, sf_dir):
    path = fresh_dir("/tmp", "token-blocks")
    TB.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, PATH)
    manifest = TB.read_manifest(path)
    fs, root = TB.opened(path)
    size = sum(fs.get_file_info(f"{root}/{f[0]}").size for f in manifest["files"])
    assert size < 2.4 * sum(f[1] for f in manifest["files"])
