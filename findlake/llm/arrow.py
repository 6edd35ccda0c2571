"""One helper: add columns that are computed batch by batch in Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from findlake.llm.warm import only

#: Rows handed to a compute function at once; texts of a slice stay small beside Arrow's batch.
SLICE_ROWS = 256


def append_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., Sequence[Sequence]]],
    keep: Callable[[Sequence[Sequence]], Sequence[bool]] | None = None,
    drop_new: bool = False,
) -> DataFrame:
    """``df`` with ``fields`` appended, or its rows filtered by them.

    ``make`` runs once a task and returns ``compute(*input lists) -> one list for each field``. A column
    of ``df`` with the name of a new field (any case) is replaced. ``keep`` gets the new lists and says
    which rows stay; with ``drop_new`` the columns of ``df`` come out unchanged.
    """
    fields = list(fields)
    new_names = {f.name.lower() for f in fields}
    old = list(df.schema.fields) if drop_new else [f for f in df.schema.fields if f.name.lower() not in new_names]
    schema = T.StructType(old if drop_new else old + fields)
    # inputs travel under names of their own, so that clashing columns of df can't be taken for them
    sent = df.select(*[df[f"`{f.name}`"] for f in old], *[df[f"`{c}`"].alias(f"__in_{i}") for i, c in enumerate(inputs)])
    n_old, n_in, arrow_types = len(old), len(inputs), [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = only(make)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                values = compute(*[part.column(n_old + i).to_pylist() for i in range(n_in)])
                columns = [part.column(i) for i in range(n_old)]
                if not drop_new:
                    columns += [pa.array(v, type=t) for v, t in zip(values, arrow_types, strict=True)]
                out = pa.RecordBatch.from_arrays(columns, names=names)
                if keep is not None:
                    out = out.filter(pa.array(keep(values), type=pa.bool_()))
                if out.num_rows:
                    yield out

    return sent.mapInArrow(run, schema)
