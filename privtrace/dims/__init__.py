"""Dimension tables and fixed values."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_table(spark: SparkSession, rows, ddl: str) -> DataFrame:
    """A small constant table as a local relation, known to the optimizer with its size."""
    schema = T.StructType.fromDDL(ddl)
    names = [f.name for f in schema.fields]
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    arrow = to_arrow_schema(schema)
    arrays = [pa.array([list(x.items()) if isinstance(x, dict) else x for x in c], type=arrow.field(n).type) for n, c in zip(names, cols)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=schema)
