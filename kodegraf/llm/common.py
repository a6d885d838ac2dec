"""Shared helpers of the training-data operators.

Conventions of every operator here:

* a null text counts as the empty text;
* only the columns an operator names are read, so further columns, whatever
  their names, never clash with it;
* repeated rows are separate rows and each gets its own result row, unless an
  operator says that it returns one row per document or group;
* an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_dir: dict[str, str] = {}

#: Bytes of text that one call of a batch function sees at most (one text may exceed it alone).
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def work_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder named by spark.checkpoint.dir.

    Only where that is unset on a local master, as in tests, a folder of this
    machine is made; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        base = _own_dir.setdefault("dir", tempfile.mkdtemp(prefix="kodegraf-"))
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Paths written inside the functions that clear up after themselves, innermost last.
_written: list[list[str]] = []


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, what)
    df.write.parquet(path)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def clearing(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, whose result is what it saves last: all else that it saved is deleted when that is written."""

    @wraps(f)
    def run(*args, **kwargs):
        _written.append([])
        try:
            return f(*args, **kwargs)
        finally:
            *gone, last = _written.pop() or [None]
            if _written and last:
                _written[-1].append(last)
            jvm = SparkSession.active()._jvm
            conf = SparkSession.active()._jsc.hadoopConfiguration()
            for path in gone:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)

    return run


def batches(it: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about BATCH_BYTES of text."""
    for b in it:
        if not b.num_rows:
            continue
        size = max(1, b.column(column).nbytes)
        step = max(1, b.num_rows * BATCH_BYTES // max(size, BATCH_BYTES))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str | T.StructType, columns: list) -> DataFrame:
    """mapInArrow over the given columns: make() runs once a task, its result once a batch and returns columns."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(it):
        f = make()
        for b in batches(it):
            got = f(b)
            arrays = [x if isinstance(x := got[k.name], (pa.Array, pa.ChunkedArray)) else pa.array(x, type=k.type) for k in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.select(*columns).mapInArrow(run, out)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def crc_fold(doc_id) -> F.Column:
    """crc32 of the decimal doc_id, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


class Spans:
    """Spans that don't overlap, looked up in logarithmic time: [start, end) of any kinds, merged where they touch each other's inside."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for i, j in sorted(spans):
            if self.ends and i < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], j)
            else:
                self.starts.append(i)
                self.ends.append(j)

    def meet(self, i: int, j: int) -> bool:
        """Whether some span shares a position with [i, j)."""
        k = bisect_left(self.starts, j) - 1
        return k >= 0 and self.ends[k] > i

    def hold(self, i: int, j: int) -> bool:
        """Whether [i, j) lies within the merged spans."""
        k = bisect_right(self.starts, i) - 1
        return k >= 0 and j <= self.ends[k]


U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def sampled(df: DataFrame, n: int, columns: list, key: tuple = ("doc_id", "text"), seed: int = 17) -> DataFrame:
    """At most n rows, those of the smallest hash of key: spread over the table and alike at each run.

    A first pass finds the hash to stop at, so that only rows of the sample are
    sorted. Rows of one hash are equal in the key, whichever of them is taken.
    """
    h = F.xxhash64(*key, F.lit(seed))
    top = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h").alias("h")).first().h
    return df.where(h <= F.lit(top) if top is not None else F.lit(False)).orderBy(h).limit(n).select(*columns)
