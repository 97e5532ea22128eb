"""Exact nearest neighbours by a pivot table, and what is built on them.

Some points serve as pivots. One scan measures every point against them: it belongs to the cell of its nearest pivot,
and cells are cut into parts of about ``size`` points along the distance to their pivot (rows at equal distance, such as
copies, by a hash). Of each part the table keeps the range of distances to its own and to a few reference pivots. By the
triangle inequality no point of a part can be nearer to a query than its distance to a pivot lies outside of that
range, nor nearer than the plane between its pivot and the query's. So a query first looks at one part, and then only
at those whose bound is not beyond its k-th neighbour so far. In the first look each task compares one part of the points
with a chunk of the queries that ask for it. In the second, parts that are near to each other make a block, and queries
whose first parts are near a chunk: each task compares one block with one chunk, so that vectors travel once a block or
chunk, not once a part, and a row says by a bit a part which ones its query asks for. Tasks return at most k rows per query:
a matrix product picks the pairs that may count, and only their distances are measured one by one.

Points of few components are kept in the leaves of a tree of cuts instead (``boxes``), whose bounds are tighter there. Of
equal points only the k of smallest id can count, and equal queries have equal neighbours: they are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.boxes import Boxes
from ledgerlens.operators.encode import lookup
from ledgerlens.operators.ordering import hash_order, only_row, running
from ledgerlens.session import cut_lineage

SCHEMA = "query long, neighbour long, distance double"
#: At most so many pivots, picked from a sample of so many points; so many of them are references of every part.
PIVOTS, SAMPLE, REFERENCES = 4096, 8192, 8
#: Quantiles of the distance to the pivot at which a cell is cut, and rows of the part table that a task holds at once.
RINGS, TABLE_ROWS = 16, 1 << 16
#: Bytes that the points, and the queries, of a task of the second look fill as doubles; it compares about so many points at once.
BLOCK_BYTES, TILE = 1 << 26, 2048
#: Components up to which a product in single precision cannot overflow; above so many candidates a query it is made in doubles.
PLAIN, CROWDED = 1e15, 64
#: Allowance for rounding in bounds, relative to the numbers they come from.
SLACK = 1e-7
#: Vectors of at most so many components are searched by boxes; their sample has so many points a leaf.
NARROW, LEAF_SAMPLE = 16, 8
#: Queries that a task takes down the tree.
TASK_QUERIES = 1 << 15


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    return np.sqrt(np.maximum(d, 0.0))


def _spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the point that is farthest from those before; equal points give one."""
    picked, left = [0], np.full(len(sample), np.inf)
    while len(picked) < n:
        left = np.minimum(left, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
        if left.max() <= 0:
            break
        picked.append(int(left.argmax()))
    return sample[picked]


@dataclass
class PivotTable:
    """``points``: _id, _v, _part. ``parts``: one row a part with its pivot, size and ranges of distances."""

    pivots: np.ndarray
    points: DataFrame
    parts: DataFrame
    width: int

    def tables(self) -> Iterator[Parts]:
        """The part table, in pieces that a task can hold; it has about a row per ``size`` points."""
        n = self.parts.count()
        rows = self.parts if n <= TABLE_ROWS else self.parts.orderBy("_part")
        for start in range(0, n, TABLE_ROWS):
            yield Parts(self.pivots, (rows if n <= TABLE_ROWS else rows.offset(start).limit(TABLE_ROWS)).toPandas())


class Parts:
    """Bounds of queries against a piece of the part table."""

    def __init__(self, pivots: np.ndarray, table: pd.DataFrame):
        self.pivots, self.part, self.rows = pivots, table["_part"].to_numpy(), table["_rows"].to_numpy()
        self.cell = table["_cell"].to_numpy()
        self.low, self.high = np.stack(table["_low"].to_numpy()), np.stack(table["_high"].to_numpy())
        self.between = _distances(pivots, pivots)

    def bounds(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible distances of queries to the points of each part."""
        to = _distances(v, self.pivots)
        scale = SLACK * (1 + to.max(axis=1, initial=0.0) + np.abs(self.high).max(initial=0.0))[:, None]
        seen = [*range(self.low.shape[1] - 1)]
        own = to[:, self.cell]
        least = np.maximum(self.low[:, -1] - own, own - self.high[:, -1])
        most = own + self.high[:, -1]
        for r in seen:
            least = np.maximum(least, np.maximum(self.low[:, r] - to[:, r : r + 1], to[:, r : r + 1] - self.high[:, r]))
            most = np.minimum(most, to[:, r : r + 1] + self.high[:, r])
        home = to.argmin(axis=1)
        gap = self.between[home][:, self.cell]
        plane = np.divide(own**2 - to[np.arange(len(v)), home][:, None] ** 2, 2 * gap, out=np.zeros_like(own), where=gap > 0)
        return np.maximum(np.maximum(least, plane) - scale, 0.0), most + scale


def pivot_table(points: DataFrame, size: int, seed: int) -> PivotTable | None:
    """Pivots, cells and parts of points (_id, _v); one scan for the pivots' sample and size, one for the table."""
    n, width = points.agg(F.count(F.lit(1)), F.max(F.size("_v"))).first()
    if not n:
        return None
    kind = points.schema["_v"].dataType.simpleString()
    wanted = max(1, min(PIVOTS, 4 * -(-n // size)))
    few = points.withColumn("_u", hash_order(["_id"], seed)).orderBy("_u", "_id").limit(SAMPLE).select("_v").collect()
    pivots = _spread_out(np.array([r._v for r in few], np.float64).reshape(-1, width), wanted)
    references = min(REFERENCES, len(pivots))

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            if len(rows):
                d = _distances(np.stack(rows["_v"].to_numpy()).astype(np.float64), pivots)
                cell = d.argmin(axis=1)
                far = np.concatenate([d[:, :references], d[np.arange(len(d)), cell][:, None]], axis=1)
                yield rows.assign(_cell=cell.astype(np.int32), _far=list(far))

    located = cut_lineage(points.select("_id", "_v").mapInPandas(measured, f"_id long, _v {kind}, _cell int, _far array<double>"))
    own = F.element_at("_far", -1)
    cuts = F.percentile_approx(own, F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)]), F.lit(1000)).alias("_cuts")
    cells = located.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), cuts)
    rings = F.least(F.ceil(F.col("_n") / size), F.lit(RINGS))
    step = F.filter("_cuts", lambda c, i: (i + 1) * rings % RINGS < rings)  # about as many cuts as the cell needs parts
    cells = cells.select("_cell", F.when(rings > 1, step).otherwise(F.array().cast("array<double>")).alias("_cuts"))
    ring = F.size(F.filter("_cuts", lambda c: c < own))
    placed = located.join(cells, "_cell").withColumn("_ring", ring).drop("_cuts")
    pieces = placed.groupBy("_cell", "_ring").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("_pieces"))
    piece = F.pmod(F.xxhash64("_id", F.lit(seed)), F.col("_pieces")).cast("int")
    name = F.shiftleft(F.col("_cell").cast("long"), 40) + F.shiftleft(F.col("_ring").cast("long"), 32) + piece
    split = placed.join(pieces, ["_cell", "_ring"]).withColumn("_part", name)
    ends = [f(F.col("_far")[i]) for f in (F.min, F.max) for i in range(references + 1)]
    parts = split.groupBy("_part", "_cell").agg(
        F.count(F.lit(1)).alias("_rows"), F.array(*ends[: references + 1]).alias("_low"), F.array(*ends[references + 1 :]).alias("_high")
    )
    return PivotTable(pivots, cut_lineage(split.select("_id", "_v", "_part")), cut_lineage(parts), width)


def _first_look(table: Parts, k: int):
    """The most promising part of a piece of the table, and a distance within which k other points must lie."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for at in range(0, len(rows), 1024):
                some = rows.iloc[at : at + 1024]
                least, most = table.bounds(np.stack(some["_v"].to_numpy()).astype(np.float64))
                best = (least + 1e-3 * most).argmin(axis=1)
                order = np.argsort(most, axis=1)
                enough = np.cumsum(table.rows[order], axis=1) >= (k + some["_self"].to_numpy(dtype=int))[:, None]
                reach = np.take_along_axis(most, np.take_along_axis(order, enough.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]
                promise = least[np.arange(len(some)), best]
                yield some.assign(_part=table.part[best], _promise=promise, _r=np.where(enough.any(axis=1), reach, np.inf))

    return run


def _near_order(x: np.ndarray) -> np.ndarray:
    """Ranks that keep near points together: halved again and again along the line between two far ones."""
    order, todo = [], [np.arange(len(x))]
    while todo:
        some = todo.pop()
        if len(some) < 3:
            order.extend(some)
            continue
        far = x[some[((x[some] - x[some[0]]) ** 2).sum(axis=1).argmax()]]
        other = x[some[((x[some] - far) ** 2).sum(axis=1).argmax()]]
        some = some[np.argsort(x[some] @ (other - far), kind="stable")]
        todo += [some[len(some) // 2 :], some[: len(some) // 2]]
    return np.argsort(order)


class Grid:
    """Blocks of parts that are near to each other, and chunks of queries by the part of their first look."""

    def __init__(self, tables: list[Parts], homes: pd.DataFrame, width: int, tasks: int):
        """``homes``: the number of queries (count) by the part of their first look (_home)."""
        rank = _near_order(tables[0].pivots)
        points, queries = sum(int(t.rows.sum()) for t in tables), int(homes["count"].sum())
        most, share = max(1, BLOCK_BYTES // (8 * max(width, 1))), points / max(queries, 1)
        sides = ((points, share), (queries, 1 / share))
        # blocks and chunks of bounded size, and enough of them for the tasks with the fewest copied rows
        per_block, per_chunk = (-(-n // max(1, -(-n // most), min(tasks, round((tasks * of) ** 0.5)))) for n, of in sides)
        self.order, self.starts, self.names = [], [], []  # of each piece: parts block by block, where blocks start, their numbers
        for t in tables:
            order = np.lexsort((t.part, rank[t.cell]))
            block = (np.cumsum(t.rows[order]) - t.rows[order]) // per_block
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            self.order.append(order), self.starts.append(starts), self.names.append(sum(map(len, self.names)) + np.arange(len(starts)))
        home, n = homes["_home"].to_numpy(np.int64), homes["count"].to_numpy(np.int64)
        order = np.lexsort((home, rank[home >> 40]))
        before = np.empty(len(n), np.int64)
        before[order] = np.cumsum(n[order]) - n[order]
        order = np.argsort(home)
        self.home, self.before, self.count, self.per_chunk = home[order], before[order], n[order], max(per_chunk, 1)
        self.cells = sum(map(len, self.names)) * -(-queries // self.per_chunk)

    def chunk(self, rows: pd.DataFrame) -> np.ndarray:
        """Queries of one part are cut by ``_u``, a number from 0 to 1."""
        at = np.searchsorted(self.home, rows["_home"].to_numpy())
        return ((self.before[at] + rows["_u"].to_numpy() * self.count[at]) // self.per_chunk).astype(np.int32)


def _asked(table: Parts, rows: pd.DataFrame) -> np.ndarray:
    """For every query the parts, but that of the first look, which may hold a point within its distance."""
    least, _ = table.bounds(np.stack(rows["_v"].to_numpy()).astype(np.float64))
    return (least <= rows["_r"].to_numpy()[:, None]) & (table.part[None, :] != rows["_home"].to_numpy()[:, None])


def _reached(table: Parts, grid: Grid, i: int):
    """A row for every block of a piece of the table in which a query asks for parts, with a bit for each part of the block."""
    order, starts, names = grid.order[i], grid.starts[i], grid.names[i]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, 1_000_000 // len(order))
        for rows in frames:
            for at in range(0, len(rows), step):
                some = rows.iloc[at : at + step]
                asked = _asked(table, some)[:, order]
                some = some[["_id", "_v", "_self", "_r"]].assign(_chunk=grid.chunk(some))
                for a, b, name in zip(starts, [*starts[1:], len(order)], names, strict=True):
                    query = np.flatnonzero(asked[:, a:b].any(axis=1))
                    if len(query):
                        yield some.iloc[query].assign(_block=np.int32(name), _asked=[x.tobytes() for x in np.packbits(asked[query, a:b], axis=1)])

    return run


def _wanted(table: Parts, grid: Grid, i: int):
    """The parts that any query of a chunk asks for, with their block and place in it."""
    order, starts, names = grid.order[i], grid.starts[i], grid.names[i]
    sizes = np.diff(starts, append=len(order))
    block, place = np.repeat(names, sizes), np.arange(len(order)) - np.repeat(starts, sizes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step, seen = max(1, 1_000_000 // len(order)), {}
        for rows in frames:
            for at in range(0, len(rows), step):
                some = rows.iloc[at : at + step]
                asked, chunk = _asked(table, some)[:, order], grid.chunk(some)
                for c in np.unique(chunk).tolist():
                    seen[c] = seen.get(c, False) | asked[chunk == c].any(axis=0)
        for c, parts in seen.items():
            j = np.flatnonzero(parts)
            yield pd.DataFrame({"_part": table.part[order[j]], "_chunk": np.int32(c), "_block": block[j].astype(np.int32), "_at": place[j].astype(np.int32)})

    return run


def _chunked(asked: DataFrame, size: int, seed: int) -> DataFrame:
    """Cut the queries of each part into chunks of about ``size`` rows."""
    counts = asked.groupBy("_part").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("_n"))
    return asked.join(counts, "_part").withColumn("_chunk", F.pmod(F.xxhash64("_id", F.lit(seed)), F.col("_n")).cast("int")).drop("_n")


def _candidates(q: np.ndarray, p: np.ndarray, k: int, skip: np.ndarray | None, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may be among a query's k nearest within its limit: one matrix product, with room for its rounding.

    ``skip`` is a mask of pairs that are none. Pairs whose product is not a number are all candidates.
    """
    near, far = (q * q).sum(axis=1), (p * p).sum(axis=1)
    d = near[:, None] - 2 * (q @ p.T) + far
    room = 16 * (q.shape[1] + 8) * np.finfo(np.float64).eps * (near + far.max())
    unsure = np.isnan(d)
    d[unsure] = np.inf
    if skip is not None:
        d[skip] = np.inf
    most = np.minimum(np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(p) else np.inf, limit**2 * (1 + 1e-9)) + 2 * room
    chosen = (d <= np.where(np.isnan(most), np.inf, most)[:, None]) | unsure
    if skip is not None:
        chosen &= ~skip
    return np.nonzero(chosen)


def _compare(k: int):
    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "neighbour": [], "distance": []}).astype({"query": "int64", "neighbour": "int64"})
        if queries.empty or points.empty:
            return empty
        points = points.sort_values("_id")
        q, p = (np.stack(x["_v"].to_numpy()).astype(np.float64, copy=False) for x in (queries, points))
        ids, asked = points["_id"].to_numpy(), queries["_id"].to_numpy()
        own, limit = queries["_self"].to_numpy(dtype=bool), queries["_r"].to_numpy()
        middle = p.mean(axis=0)
        about_q, about_p = q - middle, p - middle
        out = []
        step = max(1, 1_000_000 // len(p))
        for i in range(0, len(asked), step):
            to = slice(i, i + step)
            skip = own[to, None] & (asked[to, None] == ids[None, :]) if own[to].any() else None
            row, col = _candidates(about_q[to], about_p, k, skip, limit[to])
            row += i
            d = np.empty(len(row))
            piece = max(1, 4_000_000 // max(p.shape[1], 1))
            for j in range(0, len(row), piece):
                d[j : j + piece] = np.sqrt(((q[row[j : j + piece]] - p[col[j : j + piece]]) ** 2).sum(axis=1))
            keep = np.isfinite(d) & (d <= limit[row])
            row, col, d = row[keep], col[keep], d[keep]
            order = np.lexsort((col, d, row))  # ties by position, as points are in order of their ids
            row, col, d = row[order], col[order], d[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append(pd.DataFrame({"query": asked[row[first]], "neighbour": ids[col[first]], "distance": d[first]}))
        return pd.concat(out) if out else empty

    return run


def _pairwise(asked: DataFrame, points: DataFrame, k: int) -> DataFrame:
    cell = ["_part", "_chunk"]
    cells = asked.select(*cell).distinct()
    # fresh names: both sides may come from the same table
    p = points.join(cells, "_part").select(*[F.col(c).alias(f"{c}_p") for c in cell], "_id", "_v")
    q = asked.select(*cell, "_id", "_v", "_self", "_r")
    return q.groupBy(*cell).cogroup(p.groupBy(*[f"{c}_p" for c in cell])).applyInPandas(_compare(k), SCHEMA)


class Tile:
    """Some points, about their middle, and the pairs of queries with them that a product can't rule out."""

    def __init__(self, p: np.ndarray):
        p = p.astype(np.float64)
        self.middle = p.mean(axis=0)
        about = p - self.middle
        far = (about * about).sum(axis=1)
        self.far, self.plain = far.max(), bool(np.abs(about).max(initial=0.0) < PLAIN)
        if self.plain:
            self.sides = np.concatenate([about, far[:, None]], axis=1).astype(np.float32).T

    def pairs(self, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """By one product in single precision, with room for its rounding. None: it can't tell, or too many are left."""
        about = q - self.middle
        if not (self.plain and np.abs(about).max(initial=0.0) < PLAIN):
            return None
        near, most = (about * about).sum(axis=1), limit**2 * (1 + 1e-9)
        room = (q.shape[1] + 8) * np.finfo(np.float32).eps * (near + 2 * self.far + np.where(most < np.inf, most, 0.0)) + 1e-36
        sides = np.concatenate([-2 * about, np.ones((len(q), 1))], axis=1).astype(np.float32)
        with np.errstate(over="ignore"):
            chosen = sides @ self.sides <= (most - near + 2 * room).astype(np.float32)[:, None]
        return None if np.count_nonzero(chosen) > CROWDED * len(q) else np.divmod(np.flatnonzero(chosen), chosen.shape[1])


def _merge(best: np.ndarray, names: np.ndarray, row: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
    """Take pairs into the lists of their queries: nearest first, ties by id."""
    some, at = np.unique(row, return_inverse=True)
    k = best.shape[1]
    at, d, ids = np.r_[np.repeat(np.arange(len(some)), k), at], np.r_[best[some].ravel(), d], np.r_[names[some].ravel(), ids]
    order = np.lexsort((ids, d, at))
    taken = order[np.searchsorted(at[order], np.arange(len(some)))[:, None] + np.arange(k)]
    best[some], names[some] = d[taken], ids[taken]


def _compare_blocks(k: int):
    """As ``_compare``, of a chunk of queries with the parts of a block; a query with the parts that its bits name."""

    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "neighbour": [], "distance": []}).astype({"query": "int64", "neighbour": "int64"})
        if queries.empty or points.empty:
            return empty
        at = points["_at"].to_numpy()
        order = np.argsort(at, kind="stable")
        at, ids, p = at[order], points["_id"].to_numpy()[order], np.stack(points["_v"].to_numpy())[order]
        starts = np.flatnonzero(np.diff(at, prepend=-1))  # of parts
        cuts = [*starts[np.flatnonzero(np.diff(starts // TILE, prepend=-1))], len(at)]  # whole parts make a tile
        tiles = [(a, b, Tile(p[a:b])) for a, b in zip(cuts, cuts[1:])]
        asked, own, limit = queries["_id"].to_numpy(), queries["_self"].to_numpy(dtype=bool), queries["_r"].to_numpy()
        out, piece = [], max(1, 4_000_000 // max(p.shape[1], 1))
        for i in range(0, len(asked), 1024):
            to = slice(i, i + 1024)
            q = np.stack(queries["_v"].iloc[to].to_numpy()).astype(np.float64)
            bits = np.unpackbits(np.frombuffer(b"".join(queries["_asked"].iloc[to]), np.uint8).reshape(len(q), -1), axis=1)
            own_i, asked_i, within = own[to], asked[to], limit[to].copy()
            best, names = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)
            for a, b, tile in tiles:
                some = np.flatnonzero(bits[:, at[a] : at[b - 1] + 1].any(axis=1))
                if not len(some):
                    continue
                pairs = tile.pairs(q[some], within[some])
                if pairs is None:
                    skip = (bits[some][:, at[a:b]] == 0) | (own_i[some, None] & (asked_i[some, None] == ids[None, a:b]))
                    pairs = _candidates(q[some] - tile.middle, p[a:b] - tile.middle, k, skip, within[some])
                row, col = some[pairs[0]], a + pairs[1]
                meant = (bits[row, at[col]] > 0) & ~(own_i[row] & (asked_i[row] == ids[col]))
                row, col = row[meant], col[meant]
                d = np.empty(len(row))
                for j in range(0, len(row), piece):
                    d[j : j + piece] = np.sqrt(((q[row[j : j + piece]] - p[col[j : j + piece]].astype(np.float64)) ** 2).sum(axis=1))
                keep = np.isfinite(d) & (d <= within[row])
                if keep.any():
                    _merge(best, names, row[keep], d[keep], ids[col[keep]])
                    within = np.where(best[:, k - 1] < within, best[:, k - 1], within)
            row, col = np.nonzero(best < np.inf)
            out.append(pd.DataFrame({"query": asked_i[row], "neighbour": names[row, col], "distance": best[row, col]}))
        return pd.concat(out)

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass
class Search:
    """Queries with their first part, and what they look at after it.

    ``more``: a row a query and block, ``wanted``: a row a chunk of queries and part; ``cells`` at most to compare.
    """

    table: PivotTable
    first: DataFrame
    found: DataFrame
    more: DataFrame
    settled: DataFrame
    wanted: DataFrame
    cells: int

    def second_look(self, k: int) -> DataFrame:
        cell = ["_chunk", "_block"]
        tasks = max(int(self.more.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * self.cells)
        # fresh names: both sides may come from the same table
        p = self.table.points.join(self.wanted, "_part").select(*[F.col(c).alias(f"{c}_p") for c in cell], "_at", "_id", "_v")
        q, p = self.more.repartition(tasks, *cell), p.repartition(tasks, *[f"{c}_p" for c in cell])
        return q.groupBy(*cell).cogroup(p.groupBy(*[f"{c}_p" for c in cell])).applyInPandas(_compare_blocks(k), SCHEMA)


def search(asks: DataFrame, table: PivotTable, k: int, size: int, seed: int) -> Search:
    """Look at one part per query, then list the parts that may hold a nearer point.

    Queries at distance 0 of k points are settled: nothing can be nearer, however many points are equal.
    """
    tables = list(table.tables())
    kind = asks.schema["_v"].dataType.simpleString()
    looks = [asks.mapInPandas(_first_look(t, k), f"_id long, _v {kind}, _self boolean, _part long, _promise double, _r double") for t in tables]
    first = looks[0]
    if len(looks) > 1:  # the best of all pieces
        every = looks[0]
        for look in looks[1:]:
            every = every.unionByName(look)
        best = every.groupBy("_id").agg(F.min_by("_part", "_promise").alias("_part"), F.min("_r").alias("_r"))
        first = asks.join(best, "_id")
    first = cut_lineage(first.select("_id", "_v", "_self", "_part", "_r"))
    found = cut_lineage(_pairwise(_chunked(first, size, seed + 1), table.points, k))
    kth = found.groupBy(F.col("query").alias("_id")).agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("_kth"))
    near = lookup(first, kth, ["_id"], {"_kth": None}).withColumn("_r", F.least("_r", "_kth")).withColumnRenamed("_part", "_home").drop("_kth")
    near = near.select("_id", "_v", "_self", "_r", "_home")
    open_ = cut_lineage(near.where(F.col("_r") > 0).withColumn("_u", hash_order(["_id"], seed + 2)))
    grid = Grid(tables, open_.groupBy("_home").count().toPandas(), table.width, 3 * asks.sparkSession.sparkContext.defaultParallelism)
    more = wanted = None
    for i, t in enumerate(tables):
        reached = open_.mapInPandas(_reached(t, grid, i), f"_id long, _v {kind}, _self boolean, _r double, _chunk int, _block int, _asked binary")
        parts = open_.mapInPandas(_wanted(t, grid, i), "_part long, _chunk int, _block int, _at int").distinct()
        more, wanted = (reached, parts) if more is None else (more.unionByName(reached), wanted.unionByName(parts))
    return Search(table, first, found, more, near.where(F.col("_r") == 0).select(F.col("_id").alias("query")), wanted, grid.cells)


def nearest(queries: DataFrame, points: DataFrame, unique_id: str, vector: str, k: int, same: bool = False, size: int = 2048, seed: int = 42) -> DataFrame:
    """The k nearest points of every query: query, neighbour, distance, rank; ties by id.

    ``same`` says that queries are themselves points and must not find themselves. Vectors are arrays of doubles
    without nulls, all of one length. Without points there is no row.
    """
    kind = "array<double>"
    shape = lambda df: df.select(F.col(unique_id).cast("long").alias("_id"), F.col(vector).cast(kind).alias("_v"))
    if not same and (points.agg(F.max(F.size(vector))).first()[0] or NARROW + 1) <= NARROW:
        return _nearest_in_boxes(shape(queries), shape(points), k, size, seed)
    if {df.schema[vector].dataType.simpleString() for df in (queries, points)} == {"array<float>"}:
        kind = "array<float>"  # half the bytes to move; distances are of doubles all the same
    asks = shape(queries).withColumn("_self", F.lit(same))
    table = pivot_table(shape(points), size, seed)
    if table is None:
        return queries.sparkSession.createDataFrame([], T.StructType.fromDDL(SCHEMA + ", rank int"))
    s = search(asks, table, k, size, seed)
    more = s.second_look(k)
    if s.settled.isEmpty():  # then points need not be grouped by their vectors
        return _best(s.found.unionByName(more), k)
    unsettled = s.found.join(s.settled, "query", "left_anti")
    return _best(unsettled.unionByName(more).unionByName(_equal_points(asks, table.points, s.settled, k)), k)


def _equal_points(asks: DataFrame, pts: DataFrame, settled: DataFrame, k: int) -> DataFrame:
    """The equal points of smallest id for queries that have k of them: k + 1 rows a vector, whatever its number of points."""
    by_id = Window.partitionBy("_v").orderBy("_id")
    first = pts.select("_v", "_id").withColumn("_i", F.row_number().over(by_id))
    first = first.where(F.col("_i") <= k + 1).select("_v", F.col("_id").alias("neighbour"))
    asked = asks.select(F.col("_id").alias("query"), "_v", "_self").join(settled, "query", "left_semi")
    found = asked.join(first, "_v").where(~(F.col("_self") & (F.col("query") == F.col("neighbour"))))
    return found.select("query", "neighbour", F.lit(0.0).alias("distance"))


# --- few components ---------------------------------------------------------

def box_tree(points: DataFrame, size: int, seed: int) -> tuple[Boxes, DataFrame] | None:
    """Cuts from a sample, then every point's leaf (_id, _v, _part) and the box that the points of a leaf fill."""
    n = points.count()
    if not n:
        return None
    share = min(1.0, max(SAMPLE, LEAF_SAMPLE * n // size) / n)
    picked = points.where(F.pmod(F.xxhash64("_v", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = picked.select("_v").toPandas()["_v"].to_numpy()
    sample = np.stack(rows).astype(np.float64) if len(rows) else np.zeros((1, 1))
    boxes = Boxes(sample, int(share * size))

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            if len(rows):
                yield rows.assign(_part=boxes.leaf(np.stack(rows["_v"].to_numpy())))

    located = cut_lineage(points.select("_id", "_v").mapInPandas(placed, "_id long, _v array<double>, _part long"))
    width = located.agg(F.max(F.size("_v"))).first()[0]
    low, high = (F.array(*[f(F.col("_v")[i]) for i in range(width)]) for f in (F.min, F.max))
    ranges = located.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), low.alias("_low"), high.alias("_high"))
    return boxes.fill(ranges.toPandas()), located


def _nearest_in_boxes(queries: DataFrame, points: DataFrame, k: int, size: int, seed: int) -> DataFrame:
    """As ``nearest``, of queries that are not points themselves. What is not finite is at no distance from anything."""
    finite = F.forall("_v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    asks = queries.where(finite)
    by_id = Window.partitionBy("_v").orderBy("_id")
    few = points.where(finite).withColumn("_i", F.row_number().over(by_id)).where(F.col("_i") <= k).drop("_i")
    tree = box_tree(cut_lineage(few), size, seed)
    if tree is None:
        return queries.sparkSession.createDataFrame([], T.StructType.fromDDL(SCHEMA + ", rank int"))
    boxes, located = tree
    tasks = max(1, -(-asks.count() // TASK_QUERIES))
    each = cut_lineage(asks.select("_v").distinct().repartition(tasks, "_v").select(F.monotonically_increasing_id().alias("_id"), "_v"))

    def first_look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            if len(rows):
                part, reach = boxes.first(np.stack(rows["_v"].to_numpy()), k)
                yield rows.assign(_self=False, _part=part, _r=reach)

    def reached(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, 1_000_000 // len(boxes.rows))
        for rows in frames:
            for at in range(0, len(rows), step):
                some = rows.iloc[at : at + step]
                query, part = boxes.reached(np.stack(some["_v"].to_numpy()), some["_r"].to_numpy())
                other = part != some["_home"].to_numpy()[query]
                yield some.iloc[query[other]][["_id", "_v", "_self", "_r"]].assign(_part=part[other])

    first = cut_lineage(each.mapInPandas(first_look, "_id long, _v array<double>, _self boolean, _part long, _r double"))
    found = cut_lineage(_pairwise(_chunked(first, size, seed + 1), located, k))
    kth = found.groupBy(F.col("query").alias("_id")).agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("_kth"))
    near = lookup(first, kth, ["_id"], {"_kth": None}).withColumn("_r", F.least("_r", "_kth")).withColumnRenamed("_part", "_home")
    near = near.select("_id", "_v", "_self", "_r", "_home").repartition(tasks, "_id")
    more = cut_lineage(near.mapInPandas(reached, "_id long, _v array<double>, _self boolean, _r double, _part long"))
    best = _best(found.unionByName(_pairwise(_chunked(more, size, seed + 1), located, k)), k).drop("rank")
    named = asks.withColumnRenamed("_id", "_query").join(each, "_v").select("_query", F.col("_id").alias("query"))
    return _best(named.join(best, "query").select(F.col("_query").alias("query"), "neighbour", "distance"), k)


# --- imputation -------------------------------------------------------------

def knn_impute(df: DataFrame, unique_id: str, target: str, features: Sequence[str], k: int = 5, fit: DataFrame | None = None) -> DataFrame:
    """Fill nulls of a column with the distance-weighted mean of the k nearest rows that have it.

    Donors come from ``fit`` (the training rows) or from the frame itself. The
    features must be filled beforehand. Donors at distance 0 outweigh all others.
    """
    vector = F.array(*[F.col(f).cast("double") for f in features])
    donors = (df if fit is None else fit).where(F.col(target).isNotNull()).select(unique_id, target, vector.alias("_vec"))
    askers = df.where(F.col(target).isNull()).select(unique_id, vector.alias("_vec"))
    found = nearest(askers, donors, unique_id, "_vec", k)
    values = donors.select(F.col(unique_id).cast("long").alias("neighbour"), F.col(target).cast("double").alias("_y"))
    near = found.join(values, "neighbour")
    exact = F.avg(F.when(F.col("distance") == 0, F.col("_y")))
    weight = F.when(F.col("distance") > 0, 1 / F.col("distance"))
    filled = near.groupBy(F.col("query").alias(unique_id)).agg(F.coalesce(exact, F.sum(F.col("_y") * weight) / F.sum(weight)).alias("_filled"))
    out = lookup(df, filled, [unique_id], {"_filled": None})
    return out.withColumn(target, F.coalesce(F.col(target).cast("double"), F.col("_filled"))).drop("_filled")


# --- synthetic minority rows ------------------------------------------------

def _interpolate(base: DataFrame, rows: DataFrame, found: DataFrame, unique_id: str, vector: str, k: int, seed: int) -> DataFrame:
    """``base`` has an id and how many new rows it seeds (``_n``)."""
    found = cut_lineage(found.select("query", "rank", "neighbour"))  # read twice
    wanted = base.where(F.col("_n") > 0).select(F.col(unique_id).cast("long").alias("query"), F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("copy"))
    near = found.groupBy("query").agg(F.count(F.lit(1)).alias("_near"))
    picked = wanted.join(near, "query").withColumn("rank", (F.pmod(F.xxhash64("query", "copy", F.lit(seed)), F.col("_near")) + 1).cast("int"))
    pairs = picked.join(found, ["query", "rank"])
    vec = rows.select(F.col(unique_id).cast("long").alias("_i"), F.col(vector).alias("_v"))
    pairs = pairs.join(vec.withColumnsRenamed({"_i": "query", "_v": "_a"}), "query").join(vec.withColumnsRenamed({"_i": "neighbour", "_v": "_b"}), "neighbour")
    u = hash_order(["query", "copy"], seed + 1)
    a, b = (F.col(c).cast("array<double>") for c in ("_a", "_b"))
    mixed = F.zip_with(a, b, lambda a, b: a + (b - a) * F.col("_u"))
    return pairs.withColumn("_u", u).select(F.col("query").alias("seed_id"), "neighbour", "copy", mixed.alias(vector))


def smote(df: DataFrame, unique_id: str, label: str, vector: str, ratio: float, minority=1, k: int = 5, seed: int = 42) -> DataFrame:
    """New minority vectors between a row and one of its k nearest minority rows, up to ``ratio`` x the rest."""
    rare = df.where(F.col(label) == minority).select(unique_id, vector)
    sizes = only_row(df.agg(F.count_if(F.col(label) == minority).alias("a"), F.count_if(F.col(label) != minority).alias("b")))
    n_rare, total = sizes.value("a"), max(0, int(round(ratio * sizes.value("b"))) - sizes.value("a"))
    placed = running(rare.withColumn("_u", hash_order([unique_id], seed)), [], ["_u", unique_id], {"_at": ("count", F.lit(1))})
    each, rest = (divmod(total, n_rare)) if n_rare else (0, 0)
    base = placed.select(unique_id, (F.lit(each) + (F.col("_at") <= rest).cast("int")).alias("_n"))
    return _interpolate(base, rare, nearest(rare, rare, unique_id, vector, k, same=True), unique_id, vector, k, seed)


def adasyn(df: DataFrame, unique_id: str, label: str, vector: str, ratio: float, minority=1, k: int = 5, seed: int = 42) -> DataFrame:
    """Like ``smote`` but rows among more majority neighbours seed more new rows."""
    rare = df.where(F.col(label) == minority).select(unique_id, vector)
    sizes = only_row(df.agg(F.count_if(F.col(label) == minority).alias("a"), F.count_if(F.col(label) != minority).alias("b")))
    total = max(0, int(round(ratio * sizes.value("b"))) - sizes.value("a"))
    around = nearest(rare, df.select(unique_id, vector), unique_id, vector, k, same=True)
    sides = df.select(F.col(unique_id).cast("long").alias("neighbour"), (F.col(label) != minority).cast("double").alias("_other"))
    hard = cut_lineage(around.join(sides, "neighbour").groupBy(F.col("query").alias(unique_id)).agg(F.avg("_other").alias("_hard")))
    whole = only_row(hard.agg(F.sum("_hard").alias("s"))).value("s") or 1.0
    base = hard.select(unique_id, F.round(F.col("_hard") / whole * total).cast("int").alias("_n"))
    return _interpolate(base, rare, nearest(rare, rare, unique_id, vector, k, same=True), unique_id, vector, k, seed)
