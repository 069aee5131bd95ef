"""Packing by concatenate-and-cut: prefix sums over partition totals, fixed windows, boundary records.

First pass: every document is encoded and written with its partition and its offset inside it. The totals of the
partitions (one number each) give every partition's place in one long id sequence, so a document's global offset is
known without ordering anything. Second pass: documents are cut at multiples of the window length. A document that
crosses a border gives one record on each side of it; only the very last window can have padding.

Defined cases: a null or empty text is just its end id; repeated rows are packed once each; other columns are ignored
(a stage may have any); an empty table gives no rows. The order of documents is that of the partitions read. One
document's ids are held in memory at a time; the driver holds one number per partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import arrow_map, text_bytes, texts, whole_partition, written
from dialoom.llm.encoding import encoder

SOME = 500


def encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ids (narrow, without the end id), n_tokens (with it), part, local_start."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_bytes(docs, text_col, "text"))

    @whole_partition
    def step(batches):
        part, done = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        for batch in batches:
            cells = texts(batch, "text")
            for lo in range(0, len(cells), SOME):
                ids = enc.encode(cells[lo:lo + SOME])
                n = np.fromiter((len(i) // enc.dtype.itemsize + 1 for i in ids), np.int64, len(ids))
                yield {"doc_id": batch.column("doc_id").slice(lo, len(ids)), "ids": ids, "n_tokens": n,
                       "part": np.full(len(ids), part, np.int64), "local_start": done + np.cumsum(n) - n}
                done += int(n.sum())

    return arrow_map(rows, step, {"ids": "binary", "n_tokens": "long", "part": "long", "local_start": "long"}, keep=["doc_id"])


def bases(table: DataFrame, part: str, tokens: str) -> dict[int, int]:
    """Ids before each partition: one pass with map-side sums, one number per partition reaches the driver."""
    total, out = 0, {}
    for p, n in sorted(tuple(r) for r in table.groupBy(part).agg(F.sum(tokens)).collect()):
        out[p], total = total, total + n
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian 32 bit), doc_tokens, sequence_id, offset."""
    table = written(encoded(docs, tokenizer, end_id, id_col, text_col), "packed-ids")
    base = table.sparkSession.sparkContext.broadcast(bases(table, "part", "n_tokens"))

    def step(batch):
        narrow = encoder(tokenizer).dtype
        n = batch.column("n_tokens").to_numpy()
        local, part = batch.column("local_start").to_numpy(), batch.column("part").to_numpy()
        before = np.array([base.value[p] for p in part.tolist()], np.int64)
        first = before + local
        pieces = (first + n - 1) // length - first // length + 1
        doc = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        seq = first[doc] // length + nth
        start = np.maximum(seq * length, first[doc]) - first[doc]
        stop = np.minimum((seq + 1) * length - first[doc], n[doc])
        cells, cut, at = batch.column("ids"), [], -1
        for d, a, b in zip(doc.tolist(), start.tolist(), stop.tolist()):
            if d != at:
                at, ids = d, np.append(np.frombuffer(cells[d].as_py(), narrow), end_id).astype("<u4")
            cut.append(ids[a:b].tobytes())
        yield {"doc_id": batch.column("doc_id").take(pa.array(doc)), "start": start, "length": stop - start, "ids": cut,
               "doc_tokens": n[doc], "sequence_id": seq, "offset": (first[doc] + start) % length}

    out = arrow_map(table, step, {"start": "long", "length": "long", "ids": "binary", "doc_tokens": "long",
                                  "sequence_id": "long", "offset": "long"}, keep=["doc_id"])
    return out.withColumnRenamed("doc_id", id_col)


def windows(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """The filled windows: sequence_id, ids (binary of `length` ids, the last one padded). A group holds one window."""
    joined = (pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
              .withColumn("raw", F.aggregate(F.col("p.ids"), F.lit(b""), lambda a, x: F.concat(a, x))))

    def step(batch):
        pad = int(pad_id).to_bytes(4, "little")
        ids = [r + pad * (length - len(r) // 4) for r in batch.column("raw").to_pylist()]
        yield {"sequence_id": batch.column("sequence_id"), "ids": ids}

    return arrow_map(joined.select("sequence_id", "raw"), step, {"ids": "binary"}, keep=["sequence_id"])
