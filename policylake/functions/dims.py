"""Small tables: size-checked broadcast and constant dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 20_000


def freeze(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Compute a small aggregate once and keep it as a local relation of known size.

    Spark broadcasts it from its exact statistics. If the table turns out to have more rows
    than `max_rows` it is returned as it was, without any hint, so joins on it stay
    shuffle joins that adaptive execution can split.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(table, schema=df.schema))


def constant(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Dimension made of fixed rows; its size is the length of the list."""
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    struct = _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    columns = [[r[i] for r in rows] for i in range(len(struct))]
    table = pa.Table.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
    )
    return F.broadcast(spark.createDataFrame(table, schema=struct))
