"""The order in which rows lie in their files, as one number a row."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.session import cut

#: Bits of a position; positions are spread over all of them.
BITS = 62


def with_position(df: DataFrame, name: str = "_position") -> DataFrame:
    """``df`` with a long column that grows along its files, taken by name, and along the rows of each.

    Positions are distinct and at least 0. Parts of a file that Spark writes are named in the order of its partitions, so a
    sorted table that is written and read again has its order back. The driver holds the names of the files, as Spark itself
    does. A table that does not come from files is written first and has the order of its partitions. A column of that name is replaced.
    """
    own = F.struct(*df.columns).alias("_own")  # columns of df can't clash
    try:
        read = df.select(own, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        read = cut(df.select(own, F.lpad(F.spark_partition_id().cast("string"), 10, "0").alias("_file"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_row")))
    most = read.groupBy("_file").agg(F.max("_row").alias("most")).collect()
    files = sorted((r["_file"] for r in most), key=lambda f: (len(f), f))
    part_bits, row_bits = max(len(files) - 1, 0).bit_length(), max((r["most"] for r in most), default=0).bit_length()
    numbers = df.sparkSession.createDataFrame([(f, i << (BITS - part_bits)) for i, f in enumerate(files)], "_file string, _first long")
    place = F.col("_first") + F.shiftleft("_row", BITS - part_bits - row_bits)
    return read.join(F.broadcast(numbers), "_file").select(*[F.col("_own")[c].alias(c) for c in df.columns if c != name], place.alias(name))
