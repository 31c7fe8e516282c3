"""Rules that follow an order inside a key, as one pass over sorted rows.

Spark deals the rows by key and sorts them (on disk where they are many); a
task then reads them in order and hands each row to the key's own state. A key
is never gathered: what is held is the state, whose size the rule bounds.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T


def sorted_runs(df: DataFrame, keys: list[str], order: list[Column | str], schema: T.StructType,
                start: Callable[[], Callable[[tuple], list[tuple]]]) -> DataFrame:
    """Rows (keys, ``schema``) that the states give.

    ``start`` makes the state of a key, a function from a row (the columns other
    than the keys, in the order of ``df``) to the rows it gives.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    full = T.StructType([*(df.schema[k] for k in keys), *schema.fields])
    names, width = [f.name for f in full.fields], len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in full.fields]
        key, each = None, None
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in (*keys, *rest)]
            out: list[tuple] = []
            for row in zip(*cols):
                if each is None or row[:width] != key:
                    key, each = row[:width], start()
                out += [(*key, *r) for r in each(row[width:])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    dealt = df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, full)
