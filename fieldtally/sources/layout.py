"""Records written in the order of time block and place, so that Parquet can skip what a time span or a box does not need."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesy import global_cell
from ..operators.filters import in_box

# Bits a side of a place's number, and the most ranges of numbers that a box is cut into.
PLACE_BITS, RANGES = 16, 32
# Parquet keeps the extent of columns for each row group; small ones can be skipped more often.
ROW_GROUP = 16 << 20
_BLOCK, _PLACE = "time_block", "place_number"
# Days of a block of time.
BLOCK_DAYS = 30


def _block(ts: Column, days: int) -> Column:
    return F.floor(F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")) / days).cast("int")


def write_clustered(df: DataFrame, path: str, time: str = "upload_date_utc", lon: str = "lon", lat: str = "lat",
                    partitions: int | None = None, row_group: int = ROW_GROUP,
                    block_days: int = BLOCK_DAYS) -> None:
    """Rows in ranges of (block of time, bit-interleaved cell), sorted within each file; adds those two numbers as columns.

    Rows without a date or place stay, with null numbers. A block or place that holds very many rows is split over
    files by the rows' time and coordinates.
    """
    known = F.col(lon).between(-180, 180) & F.col(lat).between(-90, 90)
    keyed = df.withColumns({_BLOCK: _block(F.col(time), block_days), _PLACE: F.when(known, global_cell(F.col(lon), F.col(lat), PLACE_BITS))})
    order = [_BLOCK, _PLACE, time, lon, lat]
    ranged = keyed.repartitionByRange(partitions, *order) if partitions else keyed.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.size", row_group).parquet(path)


def place_ranges(lon_min: float, lon_max: float, lat_min: float, lat_max: float, most: int = RANGES) -> list[tuple[int, int]]:
    """At most `most` ranges of place numbers that hold a box: squares that lie across its border are quartered while there is room."""
    n = 1 << PLACE_BITS

    def index(value: float, low: float, width: float) -> int:
        return min(max(math.floor((value - low) / width * n), 0), n - 1)

    # one cell more on each side, for rounding; the last meridian is the first one
    x0, x1 = max(0, index(lon_min, -180, 360) - 1), min(n - 1, index(lon_max, -180, 360) + 1)
    y0, y1 = max(0, index(lat_min, -90, 180) - 1), min(n - 1, index(lat_max, -90, 180) + 1)
    if lon_max >= 180:
        x0 = 0
    across = [(0, 0, n)]
    done: list[tuple[int, int, int]] = []
    while across and len(done) + len(across) + 3 <= most:
        x, y, size = across.pop(0)
        half = size // 2
        for a, b in ((x, y), (x + half, y), (x, y + half), (x + half, y + half)):
            if a > x1 or b > y1 or a + half <= x0 or b + half <= y0:
                continue
            whole = a >= x0 and b >= y0 and a + half - 1 <= x1 and b + half - 1 <= y1
            (done if whole or half == 1 else across).append((a, b, half))
    spans = sorted((_interleaved(a, b), _interleaved(a, b) + size * size - 1) for a, b, size in done + across)
    merged: list[tuple[int, int]] = []
    for low, high in spans:
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _interleaved(x: int, y: int) -> int:
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(PLACE_BITS))


def read_clustered(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None,
                   during: tuple[dt.datetime, dt.datetime] | None = None, time: str = "upload_date_utc", lon: str = "lon",
                   lat: str = "lat", block_days: int = BLOCK_DAYS) -> DataFrame:
    """Rows of a box `(lon_min, lon_max, lat_min, lat_max)` and of a time span, both ends included.

    Conditions on the two numbers reach the Parquet scan, which skips row groups by them; the exact ones follow.
    """
    rows = spark.read.parquet(path)
    if during is not None:
        first, last = (math.floor((t.date() - dt.date(1970, 1, 1)).days / block_days) for t in during)
        rows = rows.filter(F.col(_BLOCK).between(first, last) & F.col(time).between(*[F.lit(t) for t in during]))
    if box is not None:
        ranges = F.lit(False)
        for low, high in place_ranges(*box):
            ranges |= F.col(_PLACE).between(low, high)
        rows = in_box(rows.filter(ranges), *box, lon=lon, lat=lat)
    return rows.drop(_BLOCK, _PLACE)
