"""Shared helpers: scans in Arrow batches, written intermediates, byte-level words."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.session import ship

_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
          "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
          "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}

BATCH_BYTES = "8m"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RUNS: dict[str, str] = {}


def arrow_map(df: DataFrame, step: Callable[[pa.RecordBatch], Iterable[Mapping]], out: Mapping[str, str],
              keep: Iterable[str] = ()) -> DataFrame:
    """`mapInArrow` with columns by name: `step` turns a batch into dicts of arrays; `keep` names columns handed on."""
    spark = ship(df.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)   # long texts come in smaller batches
    keep = list(keep)
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep]
                          + [T.StructField(n, T._parse_datatype_string(t)) for n, t in out.items()])
    kinds = dict(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in _flat(step, batches):
            cols = [got[c] if isinstance(got[c], (pa.Array, pa.ChunkedArray)) else pa.array(got[c]) for c in keep]
            cols += [got[n] if isinstance(got[n], pa.Array) else pa.array(got[n], type=_ARROW[t]) for n, t in kinds.items()]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *kinds])

    return df.mapInArrow(run, schema)


def _flat(step, batches):
    if getattr(step, "whole_partition", False):
        yield from step(batches)
        return
    for b in batches:
        if b.num_rows:
            yield from step(b)


def whole_partition(step):
    """Marks a step that takes the iterator of a partition's batches instead of one batch."""
    step.whole_partition = True
    return step


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """Cells of a binary column; null counts as empty."""
    return [b"" if x is None else x for x in batch.column(column).to_pylist()]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that the table doesn't have yet (Spark compares without case)."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def run_folder(spark: SparkSession) -> str:
    """A folder of this session in the shared folder `spark.checkpoint.dir`; Spark removes it when its JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="dialoom-", dir=os.environ.get("TMPDIR", "/tmp"))
        folder = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _RUNS[app] = folder
    return _RUNS[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared run folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text_col: str, alias: str):
    return F.col(f"`{text_col}`").cast("string").cast("binary").alias(alias)


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (bytes) and a 128-bit key of both."""
    return (docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_bytes(docs, text_col, "text"))
            .select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1), "doc_id").alias("k2")))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words (hashing a word is quicker than looking it up)."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly over all bits (a bijection)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
