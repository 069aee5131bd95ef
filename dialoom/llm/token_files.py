"""Token files: a concatenated id array with document borders in Elias-Fano form.

A token folder has two Parquet tables. `segments`: one row per run of documents, with their ids end to end (16 or 32
bit), the documents' end offsets as an Elias-Fano sequence (low bits packed, high bits in unary, positions of every
256th set bit as 32-bit numbers), and the document ids. `parts`: how many ids lie before each part. Borders cost
about 2 + log2(mean length) bits each; no 64-bit offset table is stored. Parquet carries the bytes to any store that
Spark reaches, and its committer makes writing survive lost executors.

Defined cases: null and empty texts have just the end id; rows of one id lie side by side, ordered by their text;
null ids come first; other columns are ignored; an empty table writes empty files. A segment holds about
`segment_tokens` ids or one longer document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.llm.common import arrow_map, parts, whole_partition, written
from dialoom.llm.encoding import encoder
from dialoom.llm.packing import bases, encoded

SAMPLED = 256


class EliasFano:
    """A non-decreasing sequence of numbers; `select(i)` gives the i-th."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.width, self.low, self.high = n, width, low, high
        self.samples = np.frombuffer(samples, "<u4")
        self.samples_raw = samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(width)) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> width) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, width, low, np.packbits(unary, bitorder="little").tobytes(), ones[::SAMPLED].astype("<u4").tobytes())

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        raw = np.frombuffer(self.low + bytes(8), np.uint8)
        at = i * self.width
        word = np.zeros(len(i), np.int64)
        for k in range((self.width + 14) // 8):
            word |= raw[at // 8 + k].astype(np.int64) << (8 * k)
        return (word >> (at % 8)) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """The i-th number, from the nearest sampled set bit on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLED]), i % SAMPLED
        raw = np.frombuffer(self.high, np.uint8)
        byte, skip = at // 8, at % 8
        while True:
            chunk = np.unpackbits(raw[byte:byte + 64], bitorder="little")[skip:]
            ones = np.flatnonzero(chunk)
            if len(ones) > left:
                at = byte * 8 + skip + int(ones[left])
                break
            left -= len(ones)
            byte, skip = byte + 64, 0
        return ((at - i) << self.width) | int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        i = np.arange(self.n)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[:self.n]
        return ((ones - i) << self.width) | self._low(i)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                 segment_tokens: int = 1_000_000) -> None:
    """Write the token folder `path`: documents in ascending id order, the end id after each."""
    rows = written(encoded(docs, tokenizer, end_id, id_col, text_col).select("doc_id", "ids"), "token-ids")
    ordered = (rows.repartitionByRange(parts(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.crc32("ids"))
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32("ids")))
    id_type = docs.schema[id_col].dataType

    @whole_partition
    def step(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        part, seg, base = TaskContext.get().partitionId(), 0, 0
        names, cells, held = [], [], 0

        def segment():
            nonlocal seg, base, held
            ends = np.cumsum([len(c) // enc.dtype.itemsize + 1 for c in cells])
            ef = EliasFano.encode(ends)
            doc_ids = pa.concat_arrays(names)
            row = {"part": [part], "segment": [seg], "local_start": [base], "n_docs": [len(cells)], "n_tokens": [int(ends[-1])],
                   "id_bytes": [enc.dtype.itemsize], "ids": [end.join(cells) + end], "low_width": [ef.width], "low": [ef.low],
                   "high": [ef.high], "samples": [ef.samples_raw],
                   "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)}
            seg, base, held = seg + 1, base + int(ends[-1]), 0
            names.clear(), cells.clear()
            return row

        for batch in batches:
            column, first = batch.column("doc_id"), 0
            for k, cell in enumerate(batch.column("ids")):
                cells.append(cell.as_py())
                held += len(cells[-1]) // enc.dtype.itemsize + 1
                if held >= segment_tokens:
                    names.append(column.slice(first, k + 1 - first))
                    first = k + 1
                    yield segment()
            if first < batch.num_rows:
                names.append(column.slice(first))
        if cells:
            yield segment()

    out = arrow_map(ordered, step, {
        "part": "long", "segment": "long", "local_start": "long", "n_docs": "long", "n_tokens": "long", "id_bytes": "int",
        "ids": "binary", "low_width": "int", "low": "binary", "high": "binary", "samples": "binary",
        "doc_ids": T.ArrayType(id_type).simpleString()})
    out.write.parquet(f"{path}/segments")
    spark = docs.sparkSession
    before = bases(spark.read.parquet(f"{path}/segments").select("part", "n_tokens"), "part", "n_tokens")
    (spark.createDataFrame(sorted(before.items()), "part long, ids_before long").coalesce(1)
     .write.parquet(f"{path}/parts"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a token folder: doc_id, start (ids of all documents before it), n_tokens, ids (binary, 32 bit)."""
    place = F.broadcast(spark.read.parquet(f"{path}/parts"))   # one row per written part
    segments = spark.read.parquet(f"{path}/segments").join(place, "part")
    id_type = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def step(batch):
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k] for c in ("n_docs", "low_width", "low", "high", "samples", "ids", "id_bytes")}
            v = {c: x.as_py() for c, x in row.items()}
            ends = EliasFano(v["n_docs"], v["low_width"], v["low"], v["high"], v["samples"]).all()
            starts = np.concatenate(([0], ends[:-1]))
            ids = np.frombuffer(v["ids"], "<u2" if v["id_bytes"] == 2 else "<u4").astype("<u4").tobytes()
            first = batch.column("ids_before")[k].as_py() + batch.column("local_start")[k].as_py()
            yield {"doc_id": batch.column("doc_ids")[k].values, "start": first + starts, "n_tokens": ends - starts,
                   "ids": [ids[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist())]}

    return arrow_map(segments, step, {"doc_id": id_type, "start": "long", "n_tokens": "long", "ids": "binary"})


def document_at(segment: dict, i: int) -> np.ndarray:
    """Ids of the i-th document of one segment row, by two select calls."""
    ef = EliasFano(segment["n_docs"], segment["low_width"], segment["low"], segment["high"], segment["samples"])
    start = ef.select(i - 1) if i else 0
    return np.frombuffer(segment["ids"], "<u2" if segment["id_bytes"] == 2 else "<u4")[start:ef.select(i)]
