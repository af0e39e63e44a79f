"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if top is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile
        top = tempfile.mkdtemp(prefix="spark-llm-")
        sc.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_open: list[list[str]] = []


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a table to the shared folder and read it back: work that several later steps use is done once."""
    path = shared_folder(df.sparkSession, name)
    if _open:
        _open[-1].append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Tables that `stored` makes inside are removed at the end."""
    _open.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _open.pop():
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def staged(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that `make` gives, written and read back; whatever was stored on the way is removed once it is written."""
    path = shared_folder(spark, name)
    with intermediates(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Shared:
    """A broadcast object of a class of this package: it travels as bytes, with its class, so that workers need no copy
    of the package."""

    def __init__(self, spark: SparkSession, value):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self._bytes.value)
        return self._value

    def __getstate__(self):
        return {"_bytes": self._bytes, "_value": None}


#: bytes of a batch; the JVM, the pipe and the worker each hold one
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes as well as by rows from now on, unless the session names a limit."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(BATCH_BYTES))


def arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str, ending: bool = False) -> DataFrame:
    """`mapInArrow` with state made once per task: `make()` gives a function from a batch to dicts of columns.

    With `ending` the function is called once more with None after the last batch. Batches are bounded in bytes.
    """
    kind = to_arrow_schema(_parse_datatype_string(schema))
    bounded_batches(df.sparkSession)

    def run(batches):
        step = make()
        for batch in chain(batches, (None,) if ending else ()):
            for columns in step(batch):
                yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in kind], schema=kind)
    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    found = batch.column(batch.schema.get_field_index(name))
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def text_runs(names: pa.Array, texts: pa.Array, limit: int = 1 << 20, rows: int = 256) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts (null: empty) of runs of rows of about `limit` characters; only a few rows are Python strings at a time."""
    for first in range(0, len(texts), rows):
        part = [t or "" for t in texts.slice(first, rows).to_pylist()]
        start, size = 0, 0
        for i, text in enumerate(part):
            size += len(text)
            if size >= limit or i == len(part) - 1:
                yield names.slice(first + start, i + 1 - start), part[start:i + 1]
                start, size = i + 1, 0
