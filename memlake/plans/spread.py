"""Small tables in few pieces, dealt out before work that takes much time per byte."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A table of more bytes per core than opening a file is worth comes in pieces enough.
SMALL = 4 << 20


def spread_small(df: DataFrame) -> DataFrame:
    """``df`` on all cores, if its files are fewer and hold ``SMALL`` bytes per core at most; any other table as it is.

    A Parquet file of one row group is read by one task, whatever its size.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL * cores:
        return df
    return df.repartition(cores)
