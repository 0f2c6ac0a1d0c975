"""Rules that read a group's rows in order, each depending on what was decided before. Groups are spread by their keys, sorted by Spark, and streamed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.package import ship

Group = dict[str, list | np.ndarray]


def _column(c: pa.ChunkedArray) -> list | np.ndarray:
    number = pa.types.is_floating(c.type) or pa.types.is_integer(c.type) or pa.types.is_boolean(c.type)
    return c.to_numpy() if number and not c.null_count else c.to_pylist()


def map_groups(df: DataFrame, keys: list[str], order: list, schema: str, each: Callable[[Group], dict[str, list | np.ndarray]]) -> DataFrame:
    """each(a group's columns, in order) -> columns of as many rows as it likes. Columns without nulls come as numpy arrays if they are numbers.

    A task holds one group and one batch at a time; keys should name what is bounded by nature, as a page is. Null keys are equal.
    """

    def one_by_one(columns: Group, start: np.ndarray) -> dict:
        parts = [each({name: c[a:b] for name, c in columns.items()}) for a, b in zip(start[:-1], start[1:], strict=True)]
        return {name: [x for p in parts for x in p[name]] for name in parts[0]}

    return map_runs(df, keys, order, schema, one_by_one)


def map_runs(df: DataFrame, keys: list[str], order: list, schema: str, each: Callable[[Group, np.ndarray], dict[str, list | np.ndarray]], more: dict[str, Column] | None = None, read: list[str] | None = None, at_once: int = 1) -> DataFrame:
    """each(the columns of a run of whole groups, where each group starts and the last one ends) -> columns, for rules that take many small groups at once.

    more: columns made once the groups are dealt, for order and each; read: the columns that each gets, all if not given; at_once: so many rows are gathered for a run,
    about. As map_groups otherwise.
    """
    spark = df.sparkSession
    ship(spark)
    out = T._parse_datatype_string(schema)
    fields = [(f.name, _arrow(f.dataType)) for f in out.fields]

    def borders(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[:1] = True
        for k in keys:
            code = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def made(t: pa.Table, start: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
        columns = {name: _column(t.column(name)) for name in t.column_names}
        if len(start):
            got = each(columns, np.append(start, end))
            yield pa.RecordBatch.from_arrays([pa.array(got[name], kind) for name, kind in fields], names=[name for name, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held, n = None, [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += len(batch)
            if n < at_once:
                continue
            t = pa.concat_tables(held if rest is None else [rest, *held])
            held, n = [], 0
            start = borders(t)
            if len(start) > 1:
                last = int(start[-1])
                yield from made(t.slice(0, last), start[:-1], last)
                t = t.slice(last)
            rest = t
        t = pa.concat_tables(held if rest is None else [rest, *held]) if rest is not None or held else []
        if len(t):
            yield from made(t, borders(t), len(t))

    dealt = df.repartition(*keys).withColumns(more or {}).sortWithinPartitions(*keys, *order)
    return (dealt.select(*read) if read else dealt).mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


