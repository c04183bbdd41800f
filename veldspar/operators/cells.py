"""An index laid out by cell, and beams of bounded width that walk it cell by cell with their state handed on.

The index is two Parquet tables.  `cells` has one row a cell, in a partition of its own: ids in order, vectors, attributes and the cell's graph, packed.  `cross` has one row for each
pair of cells, in a partition of its own: the first cross edges of every point of one cell into the other.  A round of a search names the cells it is at, so only
their partitions are read.

A query's state is its beam (the `width` nearest points reached, and which of them are expanded), its recycle list (the nearest points in its box that fell out of the beam, `recycle` at most),
and the cross edges of its beam into the cells it has yet to visit.  Each round brings every state to its next cell and walks there: entered at the cross edges of the beam's nearest
points, the nearest unexpanded point of the cell is expanded until the beam has none; what is further than the whole beam is never expanded, so later cells end early.
A cell that many queries visit is dealt into blocks of at most VISITS states, one task each.  States are written after every round, so a lost executor costs one round.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import vectors as V
from ..shipping import ship
from ..storage import materialise, scratch

#: Points at which a cell is entered that no cross edge leads to.
SCATTERED = 16
#: Nearest points of a beam whose cross edges enter the next cell.
HOPS = 64
#: States in one task.
VISITS = 1024
CELL = "cell_id long, n long, ids binary, vec binary, attributes binary, neighbours binary"


class Packed:
    """A cell: ids ascending, vectors, attributes (nulls as NaN), and neighbours as places in the cell, -1 for none."""

    def __init__(self, row):
        self.ids = np.frombuffer(row["ids"], np.int64)
        n = len(self.ids)
        self.vec = np.frombuffer(row["vec"], np.float64).reshape(n, -1)
        self.attributes = np.frombuffer(row["attributes"], np.float64).reshape(n, -1)
        self.neighbours = np.frombuffer(row["neighbours"], np.int32).reshape(n, -1)
        self.cell = int(row["cell_id"])

    def places(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)

    def scattered(self) -> np.ndarray:
        n = len(self.ids)
        return self.ids[np.unique(np.arange(SCATTERED) * (n - 1) // (SCATTERED - 1))]


@dataclass
class CellIndex:
    """The two tables, by their paths."""

    path: str
    attributes: int
    #: The tables as they were opened, so that their files are listed once and not in every round.
    opened: dict[str, DataFrame] = field(default_factory=dict, repr=False, compare=False)

    def _table(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        if name not in self.opened:
            self.opened[name] = spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return self.opened[name]

    def cells(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "cells", CELL)

    def cross(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "cross", "cell_id long, dst_cell long, src binary, dst binary")


def write_index(gridded: DataFrame, edges: DataFrame, cross: DataFrame | None, attributes: int, *, r: int = 2, path: str | None = None, width: int = 64) -> CellIndex:
    """Lay out points (id, vec, a0.., cell_id), edges (cell_id, src, rank, dst) and cross edges (src, dst_cell, rank, dst), the first r of which are kept.

    Without cross edges they are found by beams of the width in the cells' own graphs.
    """
    spark = gridded.sparkSession
    path = path or scratch(spark, "cell-index")
    index = CellIndex(path, attributes)
    write_cells(gridded, edges, attributes, path)
    known = gridded.filter("cell_id IS NOT NULL")
    if cross is None:
        cross = materialise(cross_edges_by_search(index, known, r, width=width), "cross")

    def pack_cross(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["src", "rank"])
        ids, first = np.unique(rows["src"].to_numpy(np.int64), return_index=True)
        out = np.full((len(ids), r), -1, np.int64)
        out[np.searchsorted(ids, rows["src"]), rows["rank"].to_numpy() - 1] = rows["dst"].to_numpy(np.int64)
        return pd.DataFrame({"cell_id": [key[0]], "dst_cell": [key[1]], "src": [ids.tobytes()], "dst": [out.tobytes()]})

    far = cross.filter(F.col("rank") <= r).join(known.select(F.col("id").alias("src"), "cell_id"), "src").filter("cell_id <> dst_cell")
    packed = far.groupBy("cell_id", "dst_cell").applyInPandas(pack_cross, "cell_id long, dst_cell long, src binary, dst binary")
    packed.repartition("cell_id", "dst_cell").write.partitionBy("cell_id", "dst_cell").parquet(f"{path}/cross")
    return index


@dataclass
class State:
    """A query under way."""

    qid: int
    vec: np.ndarray
    low: np.ndarray
    high: np.ndarray
    order: list[int]  # cells yet to visit
    hops_within: list[int]  # for each of them, how many cells after it are of its batch
    at: list[int] = field(default_factory=list)  # cells the state is at
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    dist: np.ndarray = field(default_factory=lambda: np.zeros(0))
    inside: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    expanded: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    spare_ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    spare_dist: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Cross edges of beam points, by point and cell.
    edges: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    #: The points of the cells the state is at that were scored there.
    cell_of: dict[int, int] = field(default_factory=dict)
    #: Of two channels: those that have entered their cell, and the one whose turn it is.
    entered: list[int] = field(default_factory=list)
    turn: int = 0
    cells: int = 0
    hops: int = 0
    scored: int = 0
    seconds: float = 0.0


class Walker:
    """Walks of states in the cells of a task."""

    def __init__(self, cells: dict[int, Packed], cross: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], width: int, recycle: int, any_: bool):
        self.packed, self.cross, self.width, self.recycle, self.any_ = cells, cross, width, recycle, any_

    def add(self, s: State, cell: int, ids: np.ndarray, *, expanded: bool = False) -> None:
        """Score points of a cell that were not yet, and merge them into the beam; what falls out and lies in the box goes to the recycle list."""
        ids = np.array([i for i in ids.tolist() if i not in s.cell_of], np.int64)
        if not len(ids):
            return
        s.cell_of.update(dict.fromkeys(ids.tolist(), cell))
        s.scored += len(ids)
        c = self.packed[cell]
        place = c.places(ids)
        dist = V.exact_distances(c.vec[place], s.vec)
        inside = P.in_box(c.attributes[place], s.low, s.high, any_=self.any_) if len(s.low) else np.ones(len(ids), bool)
        all_ids, all_dist = np.concatenate([s.ids, ids]), np.concatenate([s.dist, dist])
        all_in, all_x = np.concatenate([s.inside, inside]), np.concatenate([s.expanded, np.full(len(ids), expanded)])
        order = np.lexsort((all_ids, all_dist))
        keep, out = order[: self.width], order[self.width :]
        s.ids, s.dist, s.inside, s.expanded = all_ids[keep], all_dist[keep], all_in[keep], all_x[keep]
        out = out[all_in[out]]
        if len(out):
            spare_ids, spare_dist = np.concatenate([s.spare_ids, all_ids[out]]), np.concatenate([s.spare_dist, all_dist[out]])
            order = np.lexsort((spare_ids, spare_dist))[: self.recycle]
            s.spare_ids, s.spare_dist = spare_ids[order], spare_dist[order]

    def edges_of(self, s: State, point: int, cell: int) -> np.ndarray:
        """The cross edges of a point into a cell: handed on with the state, or read where the point's own cell is at hand."""
        if (point, cell) in s.edges:
            return s.edges[point, cell]
        found = self.cross.get((s.cell_of.get(point, -1), cell))
        at = int(np.searchsorted(found[0], point)) if found is not None else 0
        if found is None or at == len(found[0]) or found[0][at] != point:
            return np.zeros(0, np.int64)
        return found[1][at][found[1][at] >= 0]

    def enter(self, s: State, cell: int, *, first: bool = False) -> None:
        """Into a cell over the cross edges of the beam's nearest points, or at scattered points where none leads there."""
        ways = [] if first else [self.edges_of(s, i, cell) for i in s.ids[:HOPS].tolist()]
        ids = np.unique(np.concatenate([np.zeros(0, np.int64), *ways]))
        s.cells += 1
        self.add(s, cell, ids if len(ids) else self.packed[cell].scattered())

    def nearest_open(self, s: State, cell: int) -> int:
        """Place in the beam of its nearest unexpanded point of the cell, or -1."""
        for j in np.flatnonzero(~s.expanded).tolist():
            if s.cell_of.get(int(s.ids[j])) == cell:
                return j
        return -1

    def expand(self, s: State, cell: int, point: int) -> None:
        c = self.packed[cell]
        near = c.neighbours[int(c.places(np.array([point]))[0])]
        s.hops += 1
        self.add(s, cell, c.ids[near[near >= 0]])

    def leave(self, s: State, stay: list[int], left: int) -> None:
        """Hand on the cross edges of the beam's points into the next `left` cells to come, and forget what belongs to cells other than those to stay at."""
        edges = {(i, cell): self.edges_of(s, i, cell) for i in s.ids.tolist() for cell in s.order[:left]}
        s.edges = {k: way for k, way in edges.items() if len(way)}
        s.cell_of = {i: cell for i, cell in s.cell_of.items() if cell in stay}

    def visit(self, s: State) -> None:
        """One channel: all of the next cell."""
        cell, left = s.order.pop(0), s.hops_within.pop(0)
        self.enter(s, cell)
        while (j := self.nearest_open(s, cell)) >= 0:
            s.expanded[j] = True
            self.expand(s, cell, int(s.ids[j]))
        self.leave(s, [], left)

    def alternate(self, s: State) -> None:
        """Two channels take turns until the one whose turn it is has nothing to expand; the next cell takes its place, or the other goes on alone."""
        begun = s.cells > 0
        for cell in s.at:
            if cell not in s.entered:
                self.enter(s, cell, first=not begun)
                s.entered.append(cell)
        while (j := self.nearest_open(s, s.at[s.turn])) >= 0:
            s.expanded[j] = True
            cell, point = s.at[s.turn], int(s.ids[j])
            self.expand(s, cell, point)
            if len(s.at) == 2:  # the nearest cross edge to a point not yet met is taken, and expanded on the other side
                other = s.at[1 - s.turn]
                fresh = [x for x in self.edges_of(s, point, other).tolist() if x not in s.cell_of]
                if fresh:
                    self.add(s, other, np.array(fresh[:1], np.int64), expanded=True)
                    self.expand(s, other, fresh[0])
                s.turn = 1 - s.turn
        spent = s.at[s.turn]
        self.leave(s, [c for c in s.at if c != spent], len(s.order))
        s.entered.remove(spent)
        if s.order:
            s.at[s.turn] = s.order.pop(0)
        else:
            s.at.remove(spent)
            s.turn = 0


def _task(width: int, recycle: int, any_: bool, step: Callable[[Walker, State], None]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = right.to_dict("records")
        cells = {int(r["cell_id"]): Packed(r) for r in rows if r["ids"] is not None}
        cross = {}
        for r in rows:
            if r["src"] is not None:
                src = np.frombuffer(r["src"], np.int64)
                cross[int(r["cell_id"]), int(r["dst_cell"])] = (src, np.frombuffer(r["dst"], np.int64).reshape(len(src), -1))
        walker, out = Walker(cells, cross, width, recycle, any_), []
        for payload in left["payload"]:
            s = pickle.loads(payload)
            began = time.perf_counter()
            step(walker, s)
            s.seconds += time.perf_counter() - began
            out.append((s.qid, _place(s), pickle.dumps(s)))
        return pd.DataFrame(out, columns=["qid", "at", "payload"])

    return run


def _next(s: State) -> list[int]:
    """Cells of a state's next round; none if it is done."""
    return s.at if s.at else s.order[:1]


def _place(s: State) -> str:
    """The same for all states at the same cells, whichever channel is in which, so that a round sends a pair of cells once."""
    return ",".join(map(str, sorted(_next(s))))


def _places(states: DataFrame) -> dict[str, int]:
    """How many states are at each cell, or pair of cells; as many as the grid has at most."""
    return {r["at"]: r["count"] for r in states.groupBy("at").count().collect()}


def _round(index: CellIndex, states: DataFrame, places: dict[str, int], reach: list[int], width: int, recycle: int, any_: bool, step: Callable[[Walker, State], None]) -> DataFrame:
    """Every state (qid, at, payload) at its cells; reach: the cells whose cross edges may be wanted."""
    spark = states.sparkSession
    rows = [(at, int(cell), -(-n // VISITS)) for at, n in places.items() for cell in at.split(",")]
    keys = spark.createDataFrame(rows, "at string, cell_id long, blocks int")
    active = sorted({cell for _, cell, _ in rows})
    nothing = F.lit(None)
    cells = index.cells(spark).filter(F.col("cell_id").isin(active)).select("cell_id", nothing.cast("long").alias("dst_cell"), "ids", "vec", "attributes", "neighbours", nothing.cast("binary").alias("src"), nothing.cast("binary").alias("dst"))
    cross = index.cross(spark).filter(F.col("cell_id").isin(active) & F.col("dst_cell").isin(reach)).select("cell_id", "dst_cell", *[nothing.cast("binary").alias(c) for c in ("ids", "vec", "attributes", "neighbours")], "src", "dst")
    blocks = keys.select("at", "cell_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    data = cells.unionByName(cross).join(F.broadcast(blocks), "cell_id")  # one row a cell and block of states
    dealt = states.join(F.broadcast(keys.select("at", "blocks").distinct()), "at").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"))
    moved = dealt.select("at", "block", "payload").groupBy("at", "block").cogroup(data.groupBy("at", "block"))
    return materialise(moved.applyInPandas(_task(width, recycle, any_, step), "qid long, at string, payload binary"), "beam-states")


STATE = "qid long, at string, payload binary"


def _states(queries: DataFrame, ordered: DataFrame, attributes: int, channels: int) -> DataFrame:
    """The first state of every query that visits a cell; ordered: qid, cell_id, visit_rank, and batch_id if cells come in batches."""
    ship(queries.sparkSession)
    batch = F.col("batch_id") if "batch_id" in ordered.columns else F.lit(0).cast("long")
    visits = ordered.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(batch.alias("batch"), "visit_rank", "cell_id"))).alias("visits"))
    names = [f"{s}{j}" for j in range(attributes) for s in "lr"]
    rows = queries.select("qid", F.col("qvec").cast("array<double>").alias("qvec"), *[F.col(c).cast("double").alias(c) for c in names]).join(visits, "qid")
    rows = rows.withColumn("cells", F.transform("visits", lambda v: v["cell_id"])).withColumn("batches", F.transform("visits", lambda v: v["batch"])).drop("visits")

    def begin(parts):
        for pdf in parts:
            out = []
            for row in pdf.to_dict("records"):
                order, batches = [int(c) for c in row["cells"]], list(row["batches"])
                within = [sum(b == batches[i] for b in batches[i + 1 :]) for i in range(len(order))]
                low, high = (np.array([row[f"{x}{j}"] for j in range(attributes)], np.float64) for x in "lr")
                s = State(int(row["qid"]), np.asarray(row["qvec"], np.float64), low, high, order, within)
                if channels == 2:
                    s.at, s.order = order[:2], order[2:]
                out.append((s.qid, _place(s), pickle.dumps(s)))
            yield pd.DataFrame(out, columns=["qid", "at", "payload"])

    return materialise(rows.mapInPandas(begin, STATE), "beam-states")


def answers(states: DataFrame, k: int) -> DataFrame:
    """qid, rank, id, dist of finished states: the first k in the box of beam and recycle list."""

    def finish(parts):
        for pdf in parts:
            out = []
            for payload in pdf["payload"]:
                s = pickle.loads(payload)
                ids, dist = np.concatenate([s.ids[s.inside], s.spare_ids]), np.concatenate([s.dist[s.inside], s.spare_dist])
                for rank, j in enumerate(np.lexsort((ids, dist))[:k].tolist()):
                    out.append((s.qid, rank + 1, int(ids[j]), float(dist[j])))
            yield pd.DataFrame(out, columns=["qid", "rank", "id", "dist"])

    return states.mapInPandas(finish, "qid long, rank long, id long, dist double")


def counters(states: DataFrame) -> DataFrame:
    """qid, cells, hops, scored, seconds: cells visited, points expanded, distances computed and time taken by the walks of finished states."""

    def count(parts):
        for pdf in parts:
            yield pd.DataFrame([(s.qid, s.cells, s.hops, s.scored, s.seconds) for s in map(pickle.loads, pdf["payload"])], columns=["qid", "cells", "hops", "scored", "seconds"])

    return states.mapInPandas(count, "qid long, cells long, hops long, scored long, seconds double")


def walk(index: CellIndex, queries: DataFrame, ordered: DataFrame, *, width: int, recycle: int, any_: bool = False) -> DataFrame:
    """Finished states (qid, at, payload) of the queries after all their cells, one after another in order of visit_rank.

    With batches (ordered has batch_id) the cells of one batch come before those of the next; the beam is carried on, cross edges are followed within a batch only, and a
    round reads nothing of other batches.
    """
    spark = queries.sparkSession
    states = _states(queries, ordered, index.attributes, 1)
    done, todo = states.filter("at = ''"), states.filter("at <> ''")
    groups = [(None, [r["cell_id"] for r in ordered.select("cell_id").distinct().collect()])]  # of as many cells as the grid has at most
    if "batch_id" in ordered.columns:
        rows = ordered.groupBy("batch_id").agg(F.collect_set("cell_id").alias("cells")).orderBy("batch_id").collect()
        groups = [(r["batch_id"], r["cells"]) for r in rows]
    for _, cells in groups:
        own = F.col("at").isin([str(c) for c in cells])
        waiting, now = todo.filter(~own), todo.filter(own)
        while places := _places(now):
            moved = _round(index, now, places, cells, width, recycle, any_, Walker.visit)
            done, waiting = done.unionByName(moved.filter("at = ''")), waiting.unionByName(moved.filter((F.col("at") != "") & ~own))
            now = moved.filter(own)
        todo = waiting
    return done


def walk_two(index: CellIndex, queries: DataFrame, ordered: DataFrame, *, width: int, recycle: int, any_: bool = False) -> DataFrame:
    """Finished states of beams in two cells at a time: the channels take turns, every expansion also takes the nearest cross edge into the other cell, and a channel that is spent goes on to the next cell."""
    states = _states(queries, ordered, index.attributes, 2)
    cells = [r["cell_id"] for r in ordered.select("cell_id").distinct().collect()]  # of as many cells as the grid has at most
    done, now = states.filter("at = ''"), states.filter("at <> ''")
    while places := _places(now):
        moved = _round(index, now, places, cells, width, recycle, any_, Walker.alternate)
        done, now = done.unionByName(moved.filter("at = ''")), moved.filter("at <> ''")
    return done


def beams(cell: Packed, q: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the cell (-1 for none) and squared distances of the k nearest points that a beam of the width finds for each row of q, all rows side by side.

    In every step each row expands its nearest unexpanded point; rows that have none are done.  A point that fell out of a full beam cannot come back, so only the beam is looked through.
    """
    n, rows = len(cell.ids), len(q)
    width = max(width, k, SCATTERED)
    if n <= width:
        at = np.broadcast_to(np.arange(n), (rows, n))
        dist = ((cell.vec[None, :, :] - q[:, None, :]) ** 2).sum(2)
        order = np.lexsort((at, dist), axis=1)[:, :k]
        return np.take_along_axis(at, order, 1), np.take_along_axis(dist, order, 1)
    start = cell.places(cell.scattered())
    held = np.full((rows, width), -1, np.int64)
    dist = np.full((rows, width), np.inf)
    held[:, : len(start)] = start
    dist[:, : len(start)] = ((cell.vec[start][None] - q[:, None, :]) ** 2).sum(2)
    open_ = held >= 0
    order = np.lexsort((held, dist), axis=1)
    held, dist, open_ = (np.take_along_axis(x, order, 1) for x in (held, dist, open_))
    live = np.arange(rows)
    while len(live):
        live = live[open_[live].any(1)]
        first = open_[live].argmax(1)
        open_[live, first] = False
        near = cell.neighbours[held[live, first]].astype(np.int64)
        fresh = (near >= 0) & ~(near[:, :, None] == held[live][:, None, :]).any(2)
        d = ((cell.vec[near] - q[live][:, None, :]) ** 2).sum(2)
        all_held = np.concatenate([held[live], np.where(fresh, near, -1)], axis=1)
        all_dist = np.concatenate([dist[live], np.where(fresh, d, np.inf)], axis=1)
        all_open = np.concatenate([open_[live], fresh], axis=1)
        order = np.lexsort((all_held, all_dist), axis=1)[:, :width]
        held[live], dist[live], open_[live] = (np.take_along_axis(x, order, 1) for x in (all_held, all_dist, all_open))
    return held[:, :k], dist[:, :k]


#: Rows searched side by side.
TOGETHER = 1024


def cross_edges_by_search(index: CellIndex, points: DataFrame, k: int, *, width: int = 64, tasks: int | None = None) -> DataFrame:
    """(src, dst_cell, rank, dst): for every point near points of each cell, found by a beam in the cell's own graph.

    Points (id, vec, cell_id) are sent once to every cell, and a cell to the tasks that search it, of which there are `tasks` in all (twice the shuffle partitions unless given), however many points there are: what is
    shuffled grows with points times cells.  A task holds one cell and a batch of points, which follow it in sorted order.
    """
    spark = points.sparkSession
    ship(spark)
    known = points.filter("cell_id IS NOT NULL")
    cells = [r["cell_id"] for r in known.select("cell_id").distinct().collect()]  # of as many cells as the grid has at most
    if not cells:
        return spark.createDataFrame([], "src long, dst_cell long, rank long, dst long")
    blocks = max(1, -(-(tasks or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))) // len(cells)))
    packed = index.cells(spark).select("cell_id", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("src"), F.lit(None).cast("binary").alias("q"), "ids", "vec", "neighbours")
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("ids", "vec", "neighbours")]

    def pack(parts):
        for pdf in parts:
            yield pd.DataFrame({"src": pdf["id"], "q": [np.asarray(v, np.float64).tobytes() for v in pdf["vec"]]})

    sources = known.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInPandas(pack, "src long, q binary")
    to = F.explode(F.array(*[F.lit(c).cast("long") for c in cells])).alias("cell_id")
    asked = sources.select(to, F.pmod(F.xxhash64("src"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("side"), "src", "q", *nothing)
    stream = packed.unionByName(asked).repartition("cell_id", "block").sortWithinPartitions("cell_id", "block", "side")

    def find(parts):
        cell = None
        for pdf in parts:
            out = []
            places = np.flatnonzero(pdf["side"].to_numpy() == 0).tolist()
            for a, b in zip([0, *places], [*places, len(pdf)]):
                own = pdf.iloc[a:b]
                if a in places and a < b:
                    row = own.iloc[0]
                    cell = Packed({"cell_id": row["cell_id"], "ids": row["ids"], "vec": row["vec"], "attributes": b"", "neighbours": row["neighbours"]})
                    own = own.iloc[1:]
                for i in range(0, len(own), TOGETHER):
                    part = own.iloc[i : i + TOGETHER]
                    src = part["src"].to_numpy(np.int64)
                    held, dist = beams(cell, np.stack([np.frombuffer(v, np.float64) for v in part["q"]]), k + 1, width)
                    ids = np.where(held >= 0, cell.ids[held], -1)
                    good = (ids >= 0) & (ids != src[:, None])
                    rank = np.cumsum(good, axis=1)
                    row, col = np.nonzero(good & (rank <= k))
                    out.append(pd.DataFrame({"src": src[row], "dst_cell": cell.cell, "rank": rank[row, col], "dst": ids[row, col]}))
            yield pd.concat(out) if out else pd.DataFrame({"src": [], "dst_cell": [], "rank": [], "dst": []})

    return stream.mapInPandas(find, "src long, dst_cell long, rank long, dst long")


def write_cells(gridded: DataFrame, edges: DataFrame, attributes: int, path: str) -> None:
    """The first of an index's tables: packed cells of points (id, vec, a0.., cell_id) and edges (cell_id, src, rank, dst)."""
    ship(gridded.sparkSession)
    names = [f"a{j}" for j in range(attributes)]

    def pack(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("id"), right.sort_values(["src", "rank"])
        ids = left["id"].to_numpy(np.int64)
        src, dst = np.searchsorted(ids, right["src"].to_numpy(np.int64)), np.searchsorted(ids, right["dst"].to_numpy(np.int64))
        degree = np.bincount(src, minlength=len(ids))
        neighbours = np.full((len(ids), int(degree.max(initial=0))), -1, np.int32)
        neighbours[src, np.arange(len(src)) - np.repeat(np.cumsum(degree) - degree, degree)] = dst
        own = left[names].to_numpy(np.float64) if names else np.zeros((len(ids), 0))
        vec = np.stack(left["vec"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"cell_id": [key[0]], "n": [len(ids)], "ids": [ids.tobytes()], "vec": [vec.tobytes()], "attributes": [own.tobytes()], "neighbours": [neighbours.tobytes()]})

    known = gridded.filter("cell_id IS NOT NULL")
    plain = known.select("cell_id", "id", F.col("vec").cast("array<double>").alias("vec"), *[F.col(a).cast("double").alias(a) for a in names])
    cells = plain.groupBy("cell_id").cogroup(edges.select("cell_id", "src", "rank", "dst").groupBy("cell_id")).applyInPandas(pack, CELL)
    cells.write.partitionBy("cell_id").parquet(f"{path}/cells")


def search(index: CellIndex, queries: DataFrame, ordered: DataFrame, k: int, *, width: int = 64, recycle: int = 64, channels: int = 1, any_: bool = False) -> DataFrame:
    """qid, rank, id, dist: the first k of every query that its beam found, by one channel or two."""
    go = walk if channels == 1 else walk_two
    return answers(go(index, queries, ordered, width=width, recycle=recycle, any_=any_), k)
