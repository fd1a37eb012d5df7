"""A spatial index: points and shapes by cells of a curve that keeps what is near together.

The map is halved in both directions again and again; a cell of a level is the bits of its column and row in turn, so the cells
within a larger one have numbers next to each other. A point lies in one cell of the finest level, a shape in up to four cells
of the level whose cells are as large as its bounds. A box is a few ranges of cells for each level, which a scan of the sorted
table passes by the files' statistics; what is found in them is tested exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = "level int, cell bigint, id string, version bigint, path string, lon double, lat double, gs string, box array<double>"
#: The finest level, and the level number under which points are kept, apart from shapes.
FINEST, POINTS = 16, 99
#: Ranges of cells for a box on each level at most: beyond, larger cells are taken, which hold more than the box.
RANGES = 12


def _place(value: Column, least: float, span: float, level: Column | int) -> Column:
    cells = F.shiftleft(F.lit(1), level) if isinstance(level, int) else F.call_function("shiftleft", F.lit(1), level)
    return F.least(F.floor((value - least) / span * cells).cast("bigint"), cells.cast("bigint") - 1)


def _spread(x: Column) -> Column:
    """The bits of a number of 16 bits, each followed by an empty one."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return x


def _cell(x: Column, y: Column) -> Column:
    return _spread(x.cast("bigint")).bitwiseOR(F.shiftleft(_spread(y.cast("bigint")), 1))


def rows(leaves: DataFrame) -> DataFrame:
    """The cells of leaves (id, version, path, lon, lat, gs, box): each point, and each shape that is no point."""
    own = leaves.select("id", "version", "path", "lon", "lat", "gs", "box")
    point = _cell(_place(F.col("lon"), -180, 360, FINEST), _place(F.col("lat"), -90, 180, FINEST))
    points = own.where("lon IS NOT NULL").select(F.lit(POINTS).alias("level"), point.alias("cell"), "id", "version", "path", "lon", "lat", F.lit(None).cast("string").alias("gs"), F.lit(None).cast("array<double>").alias("box"))
    size = F.greatest((F.col("box")[2] - F.col("box")[0]) / 360, (F.col("box")[3] - F.col("box")[1]) / 180)
    level = F.when(size > 0, F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(-F.log2(size)).cast("int")))).otherwise(FINEST)
    shapes = own.where("gs IS NOT NULL AND box IS NOT NULL").withColumn("level", level)
    ends = [[_place(F.col("box")[k + 2 * side], least, span, F.col("level")) for side in (0, 1)] for k, least, span in ((0, -180, 360), (1, -90, 180))]
    cells = F.flatten(F.transform(F.sequence(*ends[0]), lambda x: F.transform(F.sequence(*ends[1]), lambda y: _cell(x, y))))
    return points.unionByName(shapes.select("level", F.explode(cells).alias("cell"), "id", "version", "path", "lon", "lat", "gs", "box"))


def by_cell(found: DataFrame) -> DataFrame:
    return found.repartitionByRange("level", "cell", "id").sortWithinPartitions("level", "cell")


def ranges(left: float, top: float, right: float, bottom: float, level: int, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of a level's cells that hold all cells of the box: cells inside are taken whole, those at its edge are halved while
    there is room for more ranges."""
    side = 1 << level
    x0, x1 = (min(int((v + 180) / 360 * side // 1), side - 1) for v in (left, right))
    y0, y1 = (min(int((v + 90) / 180 * side // 1), side - 1) for v in (bottom, top))
    x0, y0 = max(x0, 0), max(y0, 0)
    if x0 > x1 or y0 > y1:
        return []
    done, open_ = [], [(0, 0, 0, 0)]  # depth, column, row, cell
    while open_ and len(done) + len(open_) < most:
        ahead = []
        for depth, x, y, cell in open_:
            width = 1 << (level - depth)
            a, b, c, d = x * width, (x + 1) * width - 1, y * width, (y + 1) * width - 1
            if a > x1 or b < x0 or c > y1 or d < y0:
                continue
            if depth == level or (x0 <= a and b <= x1 and y0 <= c and d <= y1):
                done.append((depth, cell))
            else:
                ahead += [(depth + 1, 2 * x + i, 2 * y + j, cell * 4 + 2 * j + i) for i in (0, 1) for j in (0, 1)]
        open_ = ahead
    rest = [(depth, cell) for depth, x, y, cell in open_ if not ((x << (level - depth)) > x1 or ((x + 1) << (level - depth)) - 1 < x0 or (y << (level - depth)) > y1 or ((y + 1) << (level - depth)) - 1 < y0)]
    spans = sorted((cell << 2 * (level - depth), ((cell + 1) << 2 * (level - depth)) - 1) for depth, cell in done + rest)
    out: list[tuple[int, int]] = []
    for low, high in spans:
        if out and low == out[-1][1] + 1:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def _within(spans: list[tuple[int, int]]) -> Column:
    some = F.lit(False)
    for low, high in spans:
        some = some | F.col("cell").between(low, high)
    return some


def points_in(table: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """The points of the table that lie in the box."""
    spans = ranges(left, top, right, bottom, FINEST)
    return table.where((F.col("level") == POINTS) & _within(spans) & F.col("lon").between(left, right) & F.col("lat").between(bottom, top))


def shapes_near(table: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """The shapes of the table whose bounds meet the box; a shape may come once for each of its cells."""
    some = F.lit(False)
    for level in range(FINEST + 1):
        some = some | ((F.col("level") == level) & _within(ranges(left, top, right, bottom, level, 4)))
    box = F.col("box")
    return table.where((F.col("level") <= FINEST) & some & (box[0] <= right) & (box[2] >= left) & (box[1] <= top) & (box[3] >= bottom))
