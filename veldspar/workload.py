"""Repeatable workloads: ranges of a given selectivity, attributes by cell; all by integer arithmetic, so that SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranges_of_selectivity(rows: DataFrame, attributes: int, domain: int, share: float) -> DataFrame:
    """(qid, l0, r0, ...): for every row (qid) a box whose intervals each cover `share` of [0, domain)."""
    width = max(1, int(domain * share))
    out = rows.select(F.col("qid").cast("long").alias("qid"))
    for j in range(attributes):
        start = (F.col("qid") * 7919 + j * 104729) % F.lit(domain - width + 1)
        out = out.withColumn(f"l{j}", start.cast("long")).withColumn(f"r{j}", (F.col(f"l{j}") + width - 1).cast("long"))
    return out


def ranges_of_any_width(rows: DataFrame, attributes: int, domain: int) -> DataFrame:
    """(qid, l0, r0, ...): for every row (qid) a box with intervals of scattered place and width."""
    out = rows.select(F.col("qid").cast("long").alias("qid"))
    for j in range(attributes):
        a = (F.col("qid") * 7919 + j * 31) % F.lit(domain)
        b = (F.col("qid") * 104729 + j * 17) % F.lit(domain)
        out = out.withColumn(f"l{j}", F.least(a, b).cast("long")).withColumn(f"r{j}", F.greatest(a, b).cast("long"))
    return out


def stratified_attribute(points: DataFrame, cells: int, domain: int) -> DataFrame:
    """points (id) with a0: equal numbers of points in each of `cells` equal parts of [0, domain), scattered inside."""
    width = domain // cells
    cell = F.pmod("id", F.lit(cells))
    return points.select("id", cell.cast("long").alias("cell_id"), (cell * width + (F.col("id") * 7919) % F.lit(width)).cast("long").alias("a0"))


def attribute_of_cells(points: DataFrame, sizes: list[int], domain: int) -> DataFrame:
    """points (id) with cell_id and a0: in order of id, cell c takes sizes[c] points, and the last cell what is left; each cell's values are scattered over its own equal part of [0, domain)."""
    from .operators.ranking import with_rank

    width, starts = domain // len(sizes), [0]
    for n in sizes:
        starts.append(starts[-1] + n)
    begin = F.array(*[F.lit(s).cast("long") for s in starts[:-1]])
    placed = with_rank(points.select("id"), ["id"], "p")
    # Of empty cells that begin at the same place the last one is counted, which is the one with points.
    out = placed.withColumn("cell_id", (F.size(F.filter(begin, lambda b: b <= F.col("p"))) - 1).cast("long")).drop("p")
    return out.withColumn("a0", F.col("cell_id") * width + F.pmod(F.col("id") * 7919, F.lit(width)))


def balanced_attributes(points: DataFrame, shape: tuple[int, int], domain: int) -> DataFrame:
    """points (id) with a0, a1 and cell_id: two scattered attributes, moved so that every cell of the grid gets equally many points, the first cells one more.

    Points are taken in the order of a scattered first attribute, cut into equal columns, and inside each column in the order of the second; their places, not
    their first values, then decide the part of [0, domain) that they fall into.
    """
    from .operators.ranking import with_rank

    rows, columns = shape
    drawn = points.select("id", F.pmod(F.col("id") * 7919, F.lit(domain)).alias("x"), F.pmod(F.col("id") * 104729, F.lit(domain)).alias("y"))
    n = drawn.count()
    placed = with_rank(drawn, ["x", "id"], "p").withColumn("b0", F.floor(F.col("p") * rows / F.lit(max(n, 1))).cast("long"))
    # A column's points are n / rows: its places are ranked by range over the whole table, shifted by where the column begins.
    placed = with_rank(placed, ["b0", "y", "id"], "q")
    first = placed.groupBy("b0").agg(F.min("q").alias("first"), F.count(F.lit(1)).alias("size"))
    placed = placed.join(F.broadcast(first), "b0")  # one row a column of the grid
    placed = placed.withColumn("b1", F.floor((F.col("q") - F.col("first")) * columns / F.col("size")).cast("long"))
    cut = [F.col("b0") * (domain // rows) + F.pmod("x", F.lit(domain // rows)), F.col("b1") * (domain // columns) + F.pmod("y", F.lit(domain // columns))]
    return placed.select("id", (F.col("b0") * columns + F.col("b1")).alias("cell_id"), cut[0].cast("long").alias("a0"), cut[1].cast("long").alias("a1"))
