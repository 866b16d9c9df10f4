"""Places of rows in their files: chosen rows are read again instead of being shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.session import durable

FILE, ROW = "_file", "_row"
#: Rows of a file that one bitmap covers, and bitmaps (4 KB at most) that are broadcast together.
BLOCK = 32_768
BITMAPS = 8_192


def located(scan: DataFrame) -> DataFrame:
    """``scan`` with the file and the number of each row in it. Right for a table read from
    Parquet files that was only filtered or projected since."""
    place = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW)]
    return scan.select("*", *place)


def is_located(df: DataFrame) -> bool:
    return FILE in df.columns and ROW in df.columns


def stored(df: DataFrame) -> DataFrame:
    """``df`` with places; rows that have none are written to the shared folder once."""
    return df if is_located(df) else located(durable(df))


def at_places(rows: DataFrame, places: DataFrame, bitmaps: int = BITMAPS) -> DataFrame:
    """The located ``rows`` whose place is among ``places`` (``_file, _row``), places dropped.

    ``rows`` are not shuffled: places travel as one bitmap for each block of a file. Bitmaps
    are counted; more than ``bitmaps`` of them are dealt over groups of files, and each group
    reads its own files and gets its own bitmaps, so no broadcast grows with the table.
    """
    block, bits = "_place_block", "_place_bits"
    number = (F.col(ROW) / BLOCK).cast("long")
    marked = places.select(FILE, number.alias(block), (F.col(ROW) % BLOCK).alias("_at")).groupBy(FILE, block)
    # Bits after the last one that is set are left out.
    found = durable(marked.agg(F.expr("substr(bitmap_construct_agg(_at), 1, cast(max(_at) div 8 + 1 AS int))").alias(bits)))
    groups = max(1, -(-found.count() // bitmaps))
    byte = F.substr(bits, ((F.col(ROW) % BLOCK) / 8).cast("int") + 1, F.lit(1))
    bit = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.expr(f"shiftleft(1, cast({ROW} % 8 AS int))")) != 0
    rows = rows.withColumn(block, number)

    def group(i: int) -> DataFrame:
        # Settled by the name of a file, so files of other groups are not opened.
        mine = F.pmod(F.xxhash64(FILE), F.lit(groups)) == i
        return rows.where(mine).join(F.broadcast(found.where(mine)), [FILE, block]).where(bit)

    parts = [group(i) for i in range(groups)]
    return reduce(DataFrame.unionAll, parts).select(*[c for c in rows.columns if c not in (FILE, ROW, block)])
