"""Nearest points and points in polygons, without pairing every point with every other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvgrid.session import stage

KM_PER_DEGREE = 111
BITS_PER_ROUND = 3
LEAF_POINTS = 32
MAX_BITS = 24


def _cells(right: DataFrame, bits: int, top: dict) -> dict[str, Column]:
    """Row and column of a point in a grid of 2**bits x 2**bits over the right side."""
    def index(c: str, lo: float, span: float) -> Column:
        scaled = F.floor((F.col(c) - F.lit(lo)) / F.lit(span) * F.lit(float(1 << bits)))
        return F.least(scaled, F.lit((1 << bits) - 1))

    return {"cx": index("x", top["x0"], top["span"]), "cy": index("y", top["y0"], top["span"])}


def _depth(points: DataFrame, top: dict) -> int:
    """Grid bits at which no cell holds more than LEAF_POINTS points."""
    candidates = list(range(BITS_PER_ROUND, MAX_BITS + 1, BITS_PER_ROUND))
    finest = points.withColumns(_cells(points, MAX_BITS, top))
    levels = finest.withColumn("bits", F.explode(F.array(*[F.lit(b) for b in candidates])))
    counts = (levels.withColumns({"ux": F.expr(f"shiftright(cx, {MAX_BITS} - bits)"),
                                  "uy": F.expr(f"shiftright(cy, {MAX_BITS} - bits)")})
              .groupBy("bits", "ux", "uy").agg(F.count("*").alias("n"))
              .groupBy("bits").agg(F.max("n").alias("n")))
    fullest = {r["bits"]: r["n"] for r in counts.collect()}  # one row per level, at most 8
    return next((b for b in candidates if fullest[b] <= LEAF_POINTS), MAX_BITS)


def nearest_point(left: DataFrame, right: DataFrame, left_key: str, right_key: str, *, k: int = 1,
                  max_km: float | None = None) -> DataFrame:
    """The ``k`` nearest right points of every left point, by degrees.

    Both sides have latitude and longitude. Adds ``right_key``, ``distance_km`` (degrees
    times 111) and, for k > 1, ``rank``; ties go to the smaller right key.

    Branch and bound over a grid laid on the right points: in each round a left point
    keeps only the cells that can still hold one of its nearest points, given the
    distances guaranteed by the other cells, and descends into their children. Leaf
    cells hold at most 32 points (or one 2**-24 of the extent), so a crowded
    cell is split rather than compared with every left point near it.
    """
    points = (right.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
              .select(F.col("longitude").alias("x"), F.col("latitude").alias("y"),
                      F.col(right_key).alias("_rid")))
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"),
                     F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if box["x0"] is None:
        raise ValueError("the right side has no points")
    span = max(box["x1"] - box["x0"], box["y1"] - box["y0"]) or 1.0
    top = {"x0": box["x0"], "y0": box["y0"], "span": span}
    depth = _depth(points.select("x", "y").distinct(), top)
    # duplicates at one position beyond the k smallest keys can never be reported
    same = Window.partitionBy("x", "y").orderBy("_rid")
    points = points.withColumn("_same", F.row_number().over(same)).where(F.col("_same") <= k).drop("_same")
    points = stage(points, "points")  # read once per round

    targets = (left.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
               .select(F.col("longitude").alias("px"), F.col("latitude").alias("py")).distinct())
    frontier = targets.withColumns({"cx": F.lit(0).cast("bigint"), "cy": F.lit(0).cast("bigint")})
    rounds = list(range(BITS_PER_ROUND, depth + 1, BITS_PER_ROUND))
    for bits in rounds:
        cells = points.withColumns(_cells(points, bits, top)).groupBy("cx", "cy").agg(
            F.min("x").alias("ax"), F.max("x").alias("bx"), F.min("y").alias("ay"),
            F.max("y").alias("by"), F.count("*").alias("n"))
        cells = cells.select(F.shiftright("cx", BITS_PER_ROUND).alias("ux"),
                             F.shiftright("cy", BITS_PER_ROUND).alias("uy"),
                             F.col("cx").alias("nx"), F.col("cy").alias("ny"), "ax", "bx", "ay", "by", "n")
        if bits == BITS_PER_ROUND:
            cells = F.broadcast(cells)  # at most 8 x 8 cells
        frontier = (frontier.join(cells, (F.col("cx") == F.col("ux")) & (F.col("cy") == F.col("uy")))
                    .select("px", "py", F.col("nx").alias("cx"), F.col("ny").alias("cy"),
                            "ax", "bx", "ay", "by", "n"))
        frontier = _prune(frontier, k)
    leaves = points.withColumns(_cells(points, rounds[-1], top))
    pairs = frontier.join(leaves, ["cx", "cy"])
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    pairs = pairs.withColumn("d2", dx * dx + dy * dy)
    order = Window.partitionBy("px", "py").orderBy("d2", "_rid")
    best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("px").alias("longitude"), F.col("py").alias("latitude"),
        F.col("_rid").alias(right_key), (F.sqrt("d2") * KM_PER_DEGREE).alias("distance_km"), "rank")
    out = left.join(best, ["longitude", "latitude"])
    if max_km is not None:
        out = out.where(F.col("distance_km") <= max_km)
    return out if k > 1 else out.drop("rank")


def _prune(frontier: DataFrame, k: int) -> DataFrame:
    """Drop cells farther away than the k points other cells are sure to provide."""
    zero = F.lit(0.0)
    near_x = F.greatest(F.col("ax") - F.col("px"), zero, F.col("px") - F.col("bx"))
    near_y = F.greatest(F.col("ay") - F.col("py"), zero, F.col("py") - F.col("by"))
    far_x = F.greatest(F.abs(F.col("px") - F.col("ax")), F.abs(F.col("px") - F.col("bx")))
    far_y = F.greatest(F.abs(F.col("py") - F.col("ay")), F.abs(F.col("py") - F.col("by")))
    frontier = frontier.withColumns({"lb": near_x * near_x + near_y * near_y,
                                     "ub": far_x * far_x + far_y * far_y})
    target = Window.partitionBy("px", "py")
    by_ub = target.orderBy("ub").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    frontier = frontier.withColumn("sure", F.sum("n").over(by_ub))
    frontier = frontier.withColumn("bound", F.min(F.when(F.col("sure") >= k, F.col("ub"))).over(target))
    kept = frontier.where(F.col("bound").isNull() | (F.col("lb") <= F.col("bound")))
    return kept.select("px", "py", "cx", "cy")


CELL = ["_poly", "_k", "_cx", "_cy"]
EDGE = ["x1", "y1", "x2", "y2"]
CELL_EDGES = 64
SPLIT_BITS = 3
MAX_SPLITS = 12
#: A cell is given up after so many rounds that left it three quarters of the edges it came from.
MAX_STUCK = 1


def _edges(polygons: DataFrame, key: str) -> DataFrame:
    """A row per edge of every ring."""
    v = F.col("vertices")
    after = F.concat(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1))
    pair = F.explode(F.arrays_zip(v.alias("a"), after.alias("b")))
    rows = polygons.where(F.size(v) > 1).select(F.col(key).alias("_poly"), pair.alias("e"))
    return rows.select("_poly", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def _extents(edges: DataFrame, cell_degrees: float | None) -> DataFrame:
    """Bounding box and number of edges per polygon, and the power of two that is the size of its first cells."""
    box = edges.groupBy("_poly").agg(
        F.min(F.least("x1", "x2")).alias("ax"), F.max(F.greatest("x1", "x2")).alias("bx"),
        F.min(F.least("y1", "y2")).alias("ay"), F.max(F.greatest("y1", "y2")).alias("by"), F.count("*").alias("n"))
    span = F.greatest(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    if cell_degrees:
        span = F.least(span, F.lit(cell_degrees))
    return box.where("bx > ax AND by > ay").withColumn("_k", F.ceil(F.log2(span)).cast("int"))


def _related(rows: DataFrame) -> DataFrame:
    """Adds how an edge lies to its cell: ``within`` if it may touch it, ``beyond`` if it passes it on the right.

    ``within`` errs to the safe side. Beyond means: wherever the edge is at the height of the cell, it is right of it.
    """
    size = F.pow(F.lit(2.0), F.col("_k"))
    left, bottom = F.col("_cx") * size, F.col("_cy") * size
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")

    def x_at(y: Column) -> Column:
        return F.col("x1") + (y - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))

    level = lo == hi
    low = F.when(level, F.col("x1")).otherwise(x_at(F.greatest(lo, bottom)))
    high = F.when(level, F.col("x2")).otherwise(x_at(F.least(hi, bottom + size)))
    slack = (F.abs("x1") + F.abs("x2") + size) * 1e-9
    beside = (hi >= bottom) & (lo <= bottom + size)
    return rows.withColumns({
        "within": beside & (F.least(low, high) - slack <= left + size) & (F.greatest(low, high) + slack >= left),
        "beyond": beside & (F.least(low, high) - slack > left + size)})


def _ends(rows: DataFrame) -> DataFrame:
    """Heights at which the number of crossings right of a cell changes parity; those above the cell are infinite.

    A ray to the right from height y crosses an edge beyond the cell if one of its ends lies above y and one doesn't.
    So every end above y counts once, and where two such edges meet they cancel. What is left are the ends of edges
    that touch the cell, and, as infinite, the parity that all rays of the cell have in common.
    """
    size = F.pow(F.lit(2.0), F.col("_k"))
    bottom = F.col("_cy") * size
    height = F.when(F.col("y") >= bottom + size, float("inf")).otherwise(F.col("y"))
    return (rows.where(F.col("y") > bottom).select(*CELL, height.alias("y"))
            .groupBy(*CELL, "y").agg(F.count("*").alias("n")).where("n % 2 = 1").select(*CELL, "y"))


def _dealt(pairs: DataFrame, carried: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges by cell, ends by cell) of pairs of edge and cell, with ends carried over from larger cells."""
    related = _related(pairs)
    ends = related.where("beyond").select(*CELL, F.explode(F.array("y1", "y2")).alias("y"))
    return (related.where("within").select(*CELL, *EDGE),
            _ends(ends if carried is None else ends.unionByName(carried.select(*CELL, "y"))))


def _rows_between(lo: Column, hi: Column, bits: int) -> Column:
    """Rows of the smaller cells that a stretch of heights may meet."""
    size = F.pow(F.lit(2.0), F.col("_k") - bits)
    first, side = F.col("_cy") * (1 << bits), F.lit((1 << bits) - 1)
    return F.sequence(F.greatest(first, F.floor(lo / size) - 1), F.least(first + side, F.greatest(F.floor(hi / size), first)))


def _smaller(edges: DataFrame, ends: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Edges and ends of cells, dealt to the 4 ** bits cells each is split into."""
    column = F.explode(F.sequence(F.col("_cx") * (1 << bits), F.col("_cx") * (1 << bits) + (1 << bits) - 1))

    def split(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
        rows = rows.withColumn("_row", F.explode(_rows_between(lo, hi, bits))).withColumn("_column", column)
        return rows.withColumns({"_cx": F.col("_column"), "_cy": F.col("_row"), "_k": F.col("_k") - bits}).drop("_row", "_column")

    low = F.col("_cy") * F.pow(F.lit(2.0), F.col("_k"))
    return _dealt(split(edges, F.least("y1", "y2"), F.greatest("y1", "y2")),
                  split(ends, low, F.least("y", low + F.pow(F.lit(2.0), F.col("_k")))))


def _full_cells(edges: DataFrame, cell_edges: int, parents: DataFrame | None) -> DataFrame:
    """Cells to split, with their number of edges and of rounds that didn't help."""
    full = edges.groupBy(*CELL).agg(F.count("*").alias("n")).where(F.col("n") > cell_edges)
    if parents is None:
        return stage(full.withColumn("stuck", F.lit(0)), "full-cells")
    up = {"_k": F.col("_k") + SPLIT_BITS, "_cx": F.shiftright("_cx", SPLIT_BITS), "_cy": F.shiftright("_cy", SPLIT_BITS)}
    before = parents.select(F.col("_poly").alias("_p"), F.col("_k").alias("_pk"), F.col("_cx").alias("_px"), F.col("_cy").alias("_py"),
                            F.col("n").alias("was"), F.col("stuck").alias("waited"))
    same = ((F.col("_poly") == F.col("_p")) & (up["_k"] == F.col("_pk")) & (up["_cx"] == F.col("_px")) & (up["_cy"] == F.col("_py")))
    stuck = F.when(F.col("n") * 4 > F.col("was") * 3, F.col("waited") + 1).otherwise(F.lit(0))
    return stage(full.join(before, same).select(*CELL, "n", stuck.alias("stuck")).where(F.col("stuck") <= MAX_STUCK), "full-cells")


def polygon_cells(polygons: DataFrame, polygon_key: str, cell_degrees: float | None = None,
                  cell_edges: int = CELL_EDGES) -> tuple[DataFrame, list[int]]:
    """A quadtree over each polygon's edges: (polygon, cell, edges, ends) rows, and the sizes of cells that occur.

    A polygon starts with the few cells of its own size that its bounding box meets, so small polygons have small
    cells. Cells with more than ``cell_edges`` edges are split, ``4 ** SPLIT_BITS`` ways a round. A cell has the edges that
    touch it and the ``ends`` of :func:`_ends`; cells in a polygon without edges have one infinite end, those outside
    have none and are left out. No step has a polygon, or a large cell, in one row.
    """
    edges = _edges(polygons, polygon_key)
    boxes = _extents(edges, cell_degrees)
    sizes = {r["_k"]: r["n"] for r in boxes.groupBy("_k").agg(F.max("n").alias("n")).collect()}  # a row per power of two
    if any(n > cell_edges for n in sizes.values()):
        edges, boxes = stage(edges, "edges"), stage(boxes, "boxes")
    size = F.pow(F.lit(2.0), F.col("_k"))
    first = (edges.join(boxes.drop("n"), "_poly")
             .withColumn("_cy", F.explode(F.sequence(F.floor(F.col("ay") / size), F.floor(F.col("by") / size))))
             .where((F.greatest("y1", "y2") >= F.col("_cy") * size) & (F.least("y1", "y2") <= (F.col("_cy") + 1) * size))
             .withColumn("_cx", F.explode(F.sequence(F.floor(F.col("ax") / size), F.floor(F.col("bx") / size)))))
    if not any(n > cell_edges for n in sizes.values()):
        found = _related(first).where("within OR beyond").groupBy(*CELL).agg(
            F.collect_list(F.when(F.col("within"), F.struct(*EDGE))).alias("edges"),
            F.flatten(F.collect_list(F.when(F.col("beyond"), F.array("y1", "y2")))).alias("ends"))
        return found, sorted(sizes)
    now, ends = _dealt(first)
    leaves, levels, rounds, parents = [], set(sizes), 0, None
    while any(n > cell_edges for n in sizes.values()):
        now, ends = stage(now, "cell-edges"), stage(ends, "cell-ends")
        full = _full_cells(now, cell_edges, parents)
        parents = full
        sizes = {r["_k"]: r["n"] for r in full.groupBy("_k").agg(F.max("n").alias("n")).collect()}
        if not sizes or rounds == MAX_SPLITS:
            break
        keys = full.select(*CELL)
        leaves.append((now.join(keys, CELL, "left_anti"), ends.join(keys, CELL, "left_anti")))
        now, ends = _smaller(now.join(keys, CELL, "left_semi"), ends.join(keys, CELL, "left_semi"), SPLIT_BITS)
        levels |= {k - SPLIT_BITS for k in sizes}
        rounds += 1
    leaves.append((now, ends))
    parts = [part for edges, ends in leaves for part in (
        edges.select(*CELL, F.struct(*EDGE).alias("e"), F.lit(None).cast("double").alias("y")),
        ends.select(*CELL, F.lit(None).cast("struct<x1: double, y1: double, x2: double, y2: double>").alias("e"), "y"))]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    cells = rows.groupBy(*CELL).agg(F.collect_list("e").alias("edges"), F.collect_list("y").alias("ends"))
    return stage(cells, "polygon-cells"), sorted(levels)


def points_in_polygons(points: DataFrame, polygons: DataFrame, polygon_key: str, cell_degrees: float | None = None,
                       cell_edges: int = CELL_EDGES) -> DataFrame:
    """Points with the polygon they lie strictly inside; points outside all are dropped.

    ``polygons`` have ``vertices``, an array of (x, y) structs of one ring in order, and may
    have a row per ring: parts and holes of one polygon share its key, and a point is within
    if a ray from it crosses the rings' edges an odd number of times. Points on an edge are
    not within; points without a finite position are in none.

    A point meets the one cell it lies in of each polygon near it, and tests that cell's edges, at most
    ``cell_edges`` (more only where so many meet or coincide that splitting doesn't part them); see :func:`polygon_cells`.
    ``cell_degrees`` limits the size of the first cells.
    """
    cells, levels = polygon_cells(polygons, polygon_key, cell_degrees, cell_edges)
    x, y = F.col("longitude"), F.col("latitude")
    finite = (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    places = [F.struct(F.lit(k).alias("_k"), F.floor(x * 2.0 ** -k).alias("_cx"), F.floor(y * 2.0 ** -k).alias("_cy")) for k in levels]
    if not places:
        return points.where(F.lit(False)).withColumn(polygon_key, F.lit(None).cast(polygons.schema[polygon_key].dataType))
    located = points.where(finite).withColumn("_cell", F.explode(F.array(*places)))
    place = {c: F.col(f"_cell.{c}") for c in CELL[1:]}
    pairs = located.withColumns(place).drop("_cell").join(cells, CELL[1:])

    def crosses(e: Column) -> Column:
        at_y = F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < at_y)

    def touches(e: Column) -> Column:
        side = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return ((side == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
                & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])))

    crossings = F.size(F.filter("ends", lambda end: end > y)) + F.size(F.filter("edges", crosses))
    inside = (crossings % 2 == 1) & ~F.exists("edges", touches)
    return pairs.where(inside).select(*points.columns, F.col("_poly").alias(polygon_key))
