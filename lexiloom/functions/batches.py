"""Arrow batches taken a few rows at a time: a Python worker holds the batch as it came, and objects only for what it works on."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Rows and bytes that are taken at once; a longer row is taken alone.
ROWS, BYTES = 500, 1 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in order, by halves until they are small."""
    if batch.num_rows < 2 or batch.num_rows <= ROWS and batch.nbytes <= BYTES:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half))
        yield from slices(batch.slice(half))


def each(returns: DataType, columns: int = 1) -> Callable:
    """A function of one value of each column as a UDF."""

    def wrap(f: Callable) -> Callable:
        kind = to_arrow_type(returns)

        def values(batch: pa.RecordBatch) -> Iterator[pa.Array]:
            for b in slices(batch):
                yield pa.array([f(*row) for row in zip(*(c.to_pylist() for c in b.columns))], kind)

        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for a in batches:
                yield from values(pa.RecordBatch.from_arrays([a], ["0"]))

        def more(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for a in batches:
                yield from values(pa.RecordBatch.from_arrays(list(a), [str(k) for k in range(len(a))]))

        return F.arrow_udf(one if columns == 1 else more, returns)

    return wrap
