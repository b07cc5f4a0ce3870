"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.session import shared_folder, workers_import

#: Characters of text that one inner step of a Python operator holds at a time.
CHUNK_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by whatever path Spark can read."""
    workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *cols: str) -> DataFrame:
    """Just the named columns: extra columns never reach an operator, so their names can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Names like ``names`` that no column has, whatever its case: for an operator's own columns beside a caller's."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """True for the fold that models never learn from: crc32 of the id's decimal text divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def by_chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with at most CHUNK_CHARS bytes of text (or one row), and their texts, null as ''."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > CHUNK_CHARS:
            yield _slice(batch, column, start, i)
            start, held = i, 0
        held += int(n)
    if batch.num_rows > start:
        yield _slice(batch, column, start, batch.num_rows)


def _slice(batch: pa.RecordBatch, column: int, start: int, stop: int) -> tuple[pa.RecordBatch, list[str]]:
    part = batch.slice(start, stop - start)
    return part, [x or "" for x in part.column(column).to_pylist()]


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written to the shared folder and read back, and what removes it; columns of it are read alone, and it is
    smaller than a checkpoint."""
    spark = df.sparkSession
    shared_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(folder)

    def drop() -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return spark.read.schema(df.schema).parquet(folder), drop


def map_texts(df: DataFrame, id_col: str, text_col: str, work: Callable[[list[str]], dict[str, list]], schema: str) -> DataFrame:
    """One output row for each input row, without a shuffle: the id, and the columns ``work`` makes of the texts.

    ``schema`` lists the columns that ``work`` returns; the id keeps its own name and type.
    """
    workers_import(df.sparkSession)
    source = only(df, id_col, text_col)
    kind = source.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in by_chunks(batch, 1):
                made = work(texts)
                ids = part.column(0)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(v) if not isinstance(v, pa.Array) else v for v in made.values()]], names=[id_col, *made])

    return source.mapInArrow(run, f"`{id_col}` {kind}, {schema}")
