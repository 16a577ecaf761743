"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wideprep.session import new_table_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it back: lineage ends here, a lost
    executor costs a reread of files, and readers know the size."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"__{wanted}{'_' * i}" for i in range(len(taken) + 1)) if n.lower() not in taken)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text falls in fold 0; a null id counts as the empty text, hence as held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def arrow_map(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """``df`` through ``mapInArrow``: ``make()`` runs once a task and returns a function from a batch, given as
    column lists, to the output's column lists. Row counts may differ."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                out = work({c: batch.column(i) for i, c in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_pydict(out, schema=arrow_schema)

    return df.select(*columns).mapInArrow(run, schema)


def file_bytes(path: str) -> bytes:
    """A model file named by a parameter, read on the driver; such files are of fixed size."""
    with open(os.path.expanduser(path), "rb") as f:
        return f.read()
