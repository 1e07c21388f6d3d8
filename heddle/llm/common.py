"""What the training-data operators share: tables, the shared folder, Arrow access."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.sources.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_tables: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    A lost executor then costs the tasks that were running, never the stages before the table. Results
    may read it, so it stays until clear() or the end of the folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.heddle_path = path
    _tables.append(path)
    return back


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _tables.remove(path)


def dropped(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    _delete(df.sparkSession, df.heddle_path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this process has written in between; for jobs whose results are stored."""
    for path in list(_tables):
        _delete(spark, path)


def in_arrow(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """mapInArrow, with these modules sent to the executors, which need not have the repository."""
    context = df.sparkSession.sparkContext
    package = Path(__file__).parent.parent
    if package.is_dir() and not getattr(context, "_heddle_sent", False):
        archive = Path(tempfile.mkdtemp(prefix="heddle-")) / "heddle_workers.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for path in package.rglob("*.py"):
                z.write(path, path.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._heddle_sent = True
    return df.mapInArrow(function, schema)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every text operator works on; other columns, whatever their names, stay out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def strings(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no piece holds much more text than ``most_bytes`` (one long row stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (held + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
