"""Tables in the shared folder, whole-text helpers and column helpers of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
SPACES = "\t\n\x0b\x0c\r"
#: Bytes of text that one step of a Python task holds at once; a longer text is a step of its own.
STEP_BYTES = 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share; beside the warehouse where none is named, as in tests."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return root.rstrip("/")


class Scratch:
    """Tables written once in the shared folder, so that no lineage is run again.

    A lost executor loses nothing here: the files are in the shared store.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.folder}/{self.count:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = self.path(name), df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove tables of ``put`` that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            files = table.inputFiles() if table is not None else []
            if files:
                path = jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
                path.getFileSystem(conf).delete(path, True)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def document_hash(key: str, text: str) -> tuple[Column, Column]:
    """128 bits of a row's id and text; a hash leaves nulls out, so the text has two seeds of its own."""
    return F.xxhash64(key, text), F.xxhash64(F.lit(1), text, key)


def words_of(text: Column) -> Column:
    r"""The words ``[^\x20\x09-\x0D]+`` of a text as an array; none of a null."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(plain, " "), lambda word: word != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other letter as it is."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def steps(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the named text column holds about ``STEP_BYTES`` at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column_bytes = max(1, batch.column(column).nbytes)
        rows = max(1, batch.num_rows * STEP_BYTES // column_bytes)
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def mark_free(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    while name in df.columns:
        name = "_" + name
    return name
