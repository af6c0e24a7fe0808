"""Token ids on disk in patched frame-of-reference blocks.

A block holds up to 1,024 ids: its smallest id, the others as differences from
it in the number of bits that a set share of them fits in, and a list of the
exceptions, differences that need more, by place and value.  A file holds the
blocks of its documents one after another (a block may hold parts of several
documents), sections with the ids and lengths of runs of documents, and at its
end an index of where each block and section starts, so a part of a file is
read without the rest::

    magic | blocks and sections | block starts | sections | counts | magic

``token_blocks`` is a Spark data source.  Every task writes a file of its own
under a name no other attempt uses; the commit writes a manifest that lists the
files of the attempts that count, in the order of the partitions, so what lost
tasks left behind is never read.  Places are opened through Arrow's file
systems (a mounted folder, s3, gs or hdfs).

Defined cases: a null or empty text is a document of the end id alone; rows of
one doc_id stay in the order of the table; a null doc_id comes first; an empty
table gives a manifest without files and reads as no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)
from pyspark.sql.types import StructType

from wardline.llm.common import chunks, numbered
from wardline.llm.packing import WordEncoder

BLOCK, LANES = 1024, 32  # a step packs one id of each lane; 32 steps a block
SHARE = 0.9
MAGIC = b"PFORIDS1"
#: Bytes of text encoded together, ids decoded together, and ids of a split.
CHUNK, RUN, SPLIT = 8 << 20, 1 << 20, 1 << 24
HEAD = np.dtype([("low", "<u4"), ("n", "<u2"), ("width", "<u2"), ("exceptions", "<u4")])
SECTION = np.dtype([("at", "<i8"), ("size", "<i8"), ("docs", "<i8"), ("first", "<i8"), ("ids", "<i8")])
TAIL = np.dtype([("at", "<i8"), ("blocks", "<i8"), ("sections", "<i8"), ("ids", "<i8"), ("magic", "S8")])
MASKS = np.array([(1 << w) - 1 for w in range(33)], np.uint32)


# --- blocks -----------------------------------------------------------------------

def widths(differences: np.ndarray, share: float) -> np.ndarray:
    """Bits per block that hold the given share of its differences."""
    rank = max(0, int(np.ceil(share * differences.shape[1])) - 1)
    return np.frexp(np.partition(differences, rank, axis=1)[:, rank].astype(np.float64))[1].astype(np.int64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Blocks of values below 2**width as words of 32 bits, lane by lane."""
    steps = values.reshape(len(values), BLOCK // LANES, LANES)
    out = np.zeros((len(values), width, LANES), np.uint32)
    for j in range(BLOCK // LANES):
        word, shift = divmod(j * width, 32)
        out[:, word] |= steps[:, j] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= steps[:, j] >> np.uint32(32 - shift)
    return out


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.empty((len(words), BLOCK // LANES, LANES), np.uint32)
    for j in range(BLOCK // LANES):
        word, shift = divmod(j * width, 32)
        step = words[:, word] >> np.uint32(shift)
        if shift + width > 32:
            step |= words[:, word + 1] << np.uint32(32 - shift)
        out[:, j] = step & MASKS[width]
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray, share: float = SHARE) -> list[bytes]:
    """The blocks of ids (below 2**32); only the last may be short."""
    if not len(ids):
        return []
    n_blocks = -(-len(ids) // BLOCK)
    whole = np.empty(n_blocks * BLOCK, np.uint32)
    whole[:len(ids)] = ids
    whole[len(ids):] = whole[(n_blocks - 1) * BLOCK:len(ids)].min()
    whole = whole.reshape(n_blocks, BLOCK)
    low = whole.min(axis=1)
    whole -= low[:, None]
    width = widths(whole, share)
    beyond = whole > MASKS[width][:, None]
    block, place = np.nonzero(beyond)
    value = whole[block, place].astype("<u4")
    place = place.astype("<u2")
    many = np.bincount(block, minlength=n_blocks)
    ends = np.cumsum(many)

    head = np.zeros(n_blocks, HEAD)
    head["low"], head["n"], head["width"], head["exceptions"] = low, BLOCK, width, many
    head["n"][-1] = len(ids) - (n_blocks - 1) * BLOCK
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(width[width > 0]).tolist():
        chosen = np.flatnonzero(width == w)
        data = pack(whole[chosen] & MASKS[w], w).astype("<u4", copy=False).tobytes()
        step = w * LANES * 4
        for i, b in enumerate(chosen.tolist()):
            packed[b] = data[i * step:(i + 1) * step]
    heads, places, values = head.tobytes(), place.tobytes(), value.tobytes()
    return [heads[i * HEAD.itemsize:(i + 1) * HEAD.itemsize] + packed[i] + places[2 * (e - k):2 * e] + values[4 * (e - k):4 * e]
            for i, (e, k) in enumerate(zip(ends.tolist(), many.tolist()))]


def decode_blocks(data: memoryview, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that start at the given places of the data."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    begins = starts.tolist()
    head = np.frombuffer(b"".join(data[a:a + HEAD.itemsize] for a in begins), HEAD)
    out = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(head["width"]).tolist():
        if w:
            chosen = np.flatnonzero(head["width"] == w)
            step = w * LANES * 4
            words = b"".join(data[a:a + step] for a in (starts[chosen] + HEAD.itemsize).tolist())
            out[chosen] = unpack(np.frombuffer(words, "<u4").reshape(len(chosen), w, LANES), w)
    for i in np.flatnonzero(head["exceptions"]).tolist():
        k = int(head["exceptions"][i])
        at = begins[i] + HEAD.itemsize + int(head["width"][i]) * LANES * 4
        out[i, np.frombuffer(data[at:at + 2 * k], "<u2")] = np.frombuffer(data[at + 2 * k:at + 6 * k], "<u4")
    out += head["low"][:, None]
    return out.ravel()[(np.arange(BLOCK) < head["n"][:, None]).ravel()] if (head["n"] < BLOCK).any() else out.ravel()


# --- files ------------------------------------------------------------------------

def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


class FileWriter:
    """Writes one file; holds one unfinished block and the index."""

    def __init__(self, out, share: float = SHARE):
        self.out, self.share, self.rest = out, share, np.zeros(0, np.uint32)
        self.starts: list[int] = []
        self.sections: list[tuple[int, int, int, int, int]] = []
        self.place = self.ids = self.docs = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.place += len(data)

    def _blocks(self, ids: np.ndarray) -> None:
        blocks = encode_blocks(ids, self.share)
        ends = self.place + np.cumsum([len(b) for b in blocks], dtype=np.int64)
        self.starts += [int(e) - len(b) for e, b in zip(ends, blocks)]
        self._put(b"".join(blocks))

    def add(self, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents and their ids one after another; each call is a section."""
        section = pa.record_batch([doc_ids, pa.array(counts.astype(np.int64))], ["doc_id", "n"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, section.schema) as stream:
            stream.write_batch(section)
        data = sink.getvalue()
        self.sections.append((self.place, data.size, len(counts), self.ids, len(ids)))
        self._put(data)
        self.ids += len(ids)
        self.docs += len(counts)
        ids = np.concatenate([self.rest, ids])
        full = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:full])
        self.rest = ids[full:].copy()

    def close(self) -> None:
        self._blocks(self.rest)
        at = self.place
        self._put(np.array(self.starts, "<i8").tobytes())
        self._put(np.array(self.sections, SECTION).tobytes())
        self._put(np.array([(at, len(self.starts), len(self.sections), self.ids, MAGIC)], TAIL).tobytes())
        self.out.close()


class FileReader:
    """Reads sections of one file through its index."""

    def __init__(self, source):
        self.source = source
        tail = np.frombuffer(self._bytes(source.size() - TAIL.itemsize, TAIL.itemsize), TAIL)[0]
        if bytes(tail["magic"]) != MAGIC or bytes(self._bytes(0, len(MAGIC))) != MAGIC:
            raise ValueError("not a file of token blocks")
        index = self._bytes(int(tail["at"]), source.size() - TAIL.itemsize - int(tail["at"]))
        n = int(tail["blocks"])
        self.starts = np.append(np.frombuffer(index[:8 * n], "<i8"), tail["at"])
        self.sections = np.frombuffer(index[8 * n:], SECTION)

    def _bytes(self, at: int, size: int) -> memoryview:
        self.source.seek(at)
        return memoryview(self.source.read(size))

    def documents(self, section: int) -> pa.RecordBatch:
        s = self.sections[section]
        with pa.ipc.open_stream(pa.py_buffer(self._bytes(int(s["at"]), int(s["size"])))) as stream:
            return stream.read_next_batch()

    def runs(self, first: int, many: int, size: int = RUN) -> Iterator[np.ndarray]:
        """The ids from ``first`` on, a bounded number at a time."""
        while many > 0:
            block = first // BLOCK
            last = min(-(-(first + many) // BLOCK), block + max(1, size // BLOCK))
            begin, end = int(self.starts[block]), int(self.starts[last])
            ids = decode_blocks(self._bytes(begin, end - begin), self.starts[block:last] - begin)
            ids = ids[first - block * BLOCK:][:many]
            yield ids
            first, many = first + len(ids), many - len(ids)


# --- the data source --------------------------------------------------------------

MANIFEST = "_manifest.json"
_encoders: dict[str, WordEncoder] = {}


@dataclass
class Written(WriterCommitMessage):
    """A finished file; ``splits`` are its runs of sections: first section, first id."""

    partition: int
    file: str | None
    ids: int = 0
    docs: int = 0
    splits: list[tuple[int, int]] | None = None


def read_manifest(path: str) -> dict | None:
    fs, root = opened(path)
    if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, kind: str, overwrite: bool):
        self.path, self.tokenizer, self.kind, self.overwrite = options["path"], options["tokenizer"], kind, overwrite
        self.end_id, self.share = int(options.get("endId", "2")), float(options.get("share", SHARE))
        self.split = int(options.get("idsPerSplit", SPLIT))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Batches of (doc_id, text) in order."""
        partition = TaskContext.get().partitionId()
        if self.tokenizer not in _encoders:
            _encoders[self.tokenizer] = WordEncoder(self.tokenizer)
        fs, root = opened(self.path)
        name, out, splits = f"part-{partition:06d}-{uuid.uuid4().hex}.pfor", None, []
        for batch in iterator:
            for part in chunks(batch.column(1), CHUNK):
                rows = batch.slice(part.start, part.stop - part.start)
                ids, counts = _encoders[self.tokenizer].encode(rows.column(1))
                ids = np.insert(ids.astype(np.uint32), np.cumsum(counts), self.end_id)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = FileWriter(fs.open_output_stream(f"{root}/{name}"), self.share)
                if not splits or out.ids - splits[-1][1] >= self.split:
                    splits.append((len(out.sections), out.ids))
                out.add(rows.column(0), counts + 1, ids)
        if out is None:
            return Written(partition, None)
        out.close()
        return Written(partition, name, out.ids, out.docs, splits)

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest names the files that count; no file is ever renamed."""
        fs, root = opened(self.path)
        old = read_manifest(self.path)
        new = [[m.file, m.ids, m.docs, m.splits] for m in sorted((m for m in messages if m and m.file), key=lambda m: m.partition)]
        kept = old["files"] if old and not self.overwrite else []
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps({"doc_id": self.kind, "files": kept + new}).encode())
        self._drop([f[0] for f in old["files"]] if old and self.overwrite else [])

    def abort(self, messages: list[Written | None]) -> None:
        self._drop([m.file for m in messages if m and m.file])

    def _drop(self, names: list[str]) -> None:
        fs, root = opened(self.path)
        for name in names:
            fs.delete_file(f"{root}/{name}")


class Split(InputPartition):
    def __init__(self, file: str, first: int, last: int | None, base: int):
        super().__init__(file)
        self.file, self.first, self.last, self.base = file, first, last, base


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.with_ids = options["path"], "ids" in schema.names
        self.names = schema.names

    def partitions(self) -> list[Split]:
        found, base = [], 0
        for name, ids, _, splits in (read_manifest(self.path) or {"files": []})["files"]:
            ends = [s[0] for s in splits[1:]] + [None]
            found += [Split(name, first, end, base) for (first, _), end in zip(splits, ends)]
            base += ids
        return found

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Split):  # a table without files
            return
        fs, root = opened(self.path)
        with fs.open_input_file(f"{root}/{partition.file}") as source:
            file = FileReader(source)
            last = len(file.sections) if partition.last is None else partition.last
            for number in range(partition.first, last):
                docs, section = file.documents(number), file.sections[number]
                counts = docs.column(1).to_numpy()
                ends = np.cumsum(counts)
                crc, held, done = [0] * len(counts), [], 0
                for ids in file.runs(int(section["first"]), int(section["ids"])):
                    data = memoryview(ids.astype("<u4", copy=False).tobytes())
                    low, high = np.searchsorted(ends, [done, done + len(ids) - 1], "right")
                    for d in range(low, high + 1):
                        a, b = max(0, int(ends[d] - counts[d]) - done), min(len(ids), int(ends[d]) - done)
                        crc[d] = zlib.crc32(data[4 * a:4 * b], crc[d])
                    done += len(ids)
                    if self.with_ids:
                        held.append(ids)
                columns = [docs.column(0), pa.array(ends - counts + int(section["first"]) + partition.base),
                           docs.column(1), pa.array(crc, pa.int64())]
                if self.with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)),
                                                            pa.array(np.concatenate(held).astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, self.names)


class TokenBlocks(DataSource):
    """``spark.read/write.format("token_blocks")``.

    Writing takes (doc_id, text) in the order of the rows; options: tokenizer
    (a file), endId, share (of a block's ids that fit its width), idsPerSplit.
    Reading gives doc_id, start (ids of all documents before), n_tokens,
    ids_crc32 and, with ids=true, the ids.
    """

    @classmethod
    def name(cls) -> str:
        return "token_blocks"

    def schema(self) -> str:
        kind = (read_manifest(self.options["path"]) or {"doc_id": "bigint"})["doc_id"]
        ids = ", ids array<bigint>" if self.options.get("ids", "false").lower() == "true" else ""
        return f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint{ids}"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema.fields[0].dataType.simpleString(), overwrite)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, share: float = SHARE,
          doc_id: str = "doc_id", text: str = "text") -> None:
    """Add the documents, in ascending order of their ids, to the files at the path."""
    docs.sparkSession.dataSource.register(TokenBlocks)
    rows = numbered(docs, F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    (rows.orderBy("doc_id", "row").select("doc_id", "text").write.format("token_blocks").mode("append")
     .options(tokenizer=tokenizer, endId=str(end_id), share=str(share)).save(path))


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    spark.dataSource.register(TokenBlocks)
    return spark.read.format("token_blocks").option("ids", str(ids).lower()).load(path)
