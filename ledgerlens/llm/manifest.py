"""A Merkle manifest of a dataset: a digest per row, per group and of all, with a proof for every row.

A row's coordinate is the rank of its id in its group. It comes from bitmaps, not from sorting rows: every 4,096 ids of
a group have one bitmap, merged from all rows, and a directory holds how many ids lie in the bitmaps before. Directories
are a tree of the same fan-out over the id's higher bits, so that every prefix sum runs over at most 4,096 numbers,
however the ids are spread. A rank is the directory's number plus the bits before the id's own.

Coordinates key the rows into slot arrays of 3^6 leaves. An array is folded six levels at once; its top is a leaf of the
next round, which has 3^6 times fewer. What comes down again, array by array, is the path of siblings above an array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import drop_table, small, tidy, write_table
from ledgerlens.operators.ordering import positions

#: Low bits of an id that a bitmap covers; children of a node; levels folded in one array.
BITS, FAN, LEVELS = 12, 3, 6
SLOTS = FAN**LEVELS
#: Copies of one row that are dealt out together.
COPIES = 1 << 14

Path = list[tuple[bytes, bytes]]


# leaves


def encoded(column: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: Iterable[Column]) -> Column:
    """The sha256, in binary, of the encoded columns."""
    return F.unhex(F.sha2(F.concat(*[encoded(c) for c in columns]).cast("binary"), 256))


# coordinates


def bits_before(bitmap: Column, place: Column) -> Column:
    """Number of bits set before ``place`` in a bitmap whose bytes start at their lowest bit."""
    byte = F.floor(place / 8).cast("int")
    whole = F.bitmap_count(F.substring(bitmap, F.lit(1), byte))
    own = F.conv(F.hex(F.substring(bitmap, byte + 1, F.lit(1))), 16, 10).cast("int")
    return whole + F.bit_count(own.bitwiseAND(F.expr("shiftleft(1, __place % 8)") - 1))


def _directory(cells: DataFrame, group: list[str], low: int, high: int) -> DataFrame:
    """group, ``__cell``, ``__total`` -> also ``__before``: what the group's cells of smaller number hold."""
    one = high - low < 1 << BITS  # signed ids: -1 stays -1 when shifted, so a single higher cell is not always reached
    up = F.lit(0).cast("long") if one else F.shiftright("__cell", BITS)
    within = Window.partitionBy(*group, "__up").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    near = cells.withColumn("__up", up).withColumn("__before", F.coalesce(F.sum("__total").over(within), F.lit(0)))
    if one:
        return near.drop("__up")
    above = write_table(near.groupBy(*group, F.col("__up").alias("__cell")).agg(F.sum("__total").alias("__total")), "directory")
    up = _directory(above, group, low >> BITS, high >> BITS).select(*group, F.col("__cell").alias("__up"), F.col("__before").alias("__above"))
    return near.join(up, [*group, "__up"]).withColumn("__before", F.col("__before") + F.col("__above")).drop("__up", "__above")


def ranked(rows: DataFrame, group: list[str], value: str, count: str, out: str) -> tuple[DataFrame, bool]:
    """Add how many rows of the group have a smaller ``value`` (a long); a row stands for ``count`` equal ones.

    Also tells whether different rows share a value somewhere; they get the same rank. Groups and values are not null.
    """
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None:
        return rows.withColumn(out, F.lit(0).cast("long")), False
    cut = rows.withColumn("__cell", F.shiftright(value, BITS)).withColumn("__place", F.col(value).bitwiseAND((1 << BITS) - 1).cast("int"))
    by_cell = cut.select(*group, "__cell", "__place", count).repartition(*[F.col(g) for g in group], F.col("__cell"))
    places = by_cell.groupBy(*group, "__cell", "__place").agg(F.sum(count).alias("__n"), F.count(F.lit(1)).alias("__kinds"))
    extra = F.collect_list(F.when(F.col("__n") > 1, F.struct(F.col("__place").alias("place"), (F.col("__n") - 1).alias("more"))))
    cells = write_table(
        places.groupBy(*group, "__cell").agg(
            F.substring(F.bitmap_construct_agg(F.col("__place").cast("long")), 1, (1 << BITS) // 8).alias("__bits"),
            F.sum("__n").alias("__total"), extra.alias("__extra"), F.max("__kinds").alias("__kinds"),
        ),
        "bitmaps",
    )
    directory = write_table(_directory(cells.select(*group, "__cell", "__total"), group, low >> BITS, high >> BITS).drop("__total"), "directory")
    looked_up = cut.join(cells.drop("__total", "__kinds").join(directory, [*group, "__cell"]), [*group, "__cell"])
    more = F.aggregate(F.filter("__extra", lambda e: e["place"] < F.col("__place")), F.lit(0).cast("long"), lambda s, e: s + e["more"])
    rank = F.col("__before") + bits_before(F.col("__bits"), F.col("__place")) + more
    shared = (cells.agg(F.max("__kinds")).first()[0] or 0) > 1
    return looked_up.select(*[F.col(f"`{c}`") for c in rows.columns], rank.cast("long").alias(out)), shared


def _digits(leaf: str, start: int) -> Column:
    """Fifteen hexadecimal digits of a digest as a long."""
    return F.conv(F.substring(F.hex(leaf), start, 15), 16, 10).cast("long")


def coordinates(leaves: DataFrame) -> DataFrame:
    """group, id, leaf, claimed -> also ``pos`` within the group, from 0 without gaps, and the group's ``size``.

    Null ids come first, in the order of their leaves' first 15 digits. Rows of one id go by digits 16 to 30 of their
    leaves, equal rows follow each other. Equal rows are counted before they meet.
    """
    counted = write_table(leaves.groupBy("group", "id", "leaf", "claimed").agg(F.count(F.lit(1)).alias("n")), "leaves")
    rows = counted.withColumn("hole", F.col("id").isNull()).withColumn("value", F.coalesce(F.col("id").cast("long"), _digits("leaf", 1)))
    placed, shared = ranked(rows, ["group", "hole"], "value", "n", "rank")
    if shared:
        key = ["group", "hole", "value"]
        again = write_table(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").drop("kinds"), "shared-ids")
        ties, _ = ranked(rows.join(again, key, "left_semi").withColumn("digits", _digits("leaf", 16)), key, "digits", "n", "tie")
        placed = placed.join(ties.select(*key, "leaf", "tie"), [*key, "leaf"], "left")
        placed = placed.withColumn("rank", F.col("rank") + F.coalesce("tie", F.lit(0))).drop("tie")
    is_hole = F.col("id").isNull()
    sizes = counted.groupBy("group").agg(F.sum("n").alias("size"), F.coalesce(F.sum(F.when(is_hole, F.col("n"))), F.lit(0)).alias("holes"))
    known = placed.join(sizes, "group").withColumn("first", F.col("rank") + F.when(F.col("hole"), F.lit(0)).otherwise(F.col("holes")))
    most = counted.agg(F.max("n")).first()[0] or 0
    if most > 1:
        known = known.withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")))
        known = known.repartition("leaf", "part") if most > COPIES else known
        known = known.withColumn("copy", F.explode(F.expr(f"sequence(part * {COPIES}, least(n, (part + 1) * {COPIES}) - 1)")))
    else:
        known = known.withColumn("copy", F.lit(0).cast("long"))
    return known.select("group", "id", "leaf", "claimed", (F.col("first") + F.col("copy")).alias("pos"), "size")


# folding


def digest(parts: list[bytes] | bytes) -> bytes:
    return hashlib.sha256(parts if isinstance(parts, bytes) else b"".join(parts)).hexdigest().encode()


def tower(nodes: list[bytes], levels: int | None) -> list[list[bytes]]:
    """All levels over nodes (in hexadecimal): ``levels`` of them, or up to a single node."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([digest(last[i : i + FAN]) for i in range(0, len(last), FAN)])
    return out


def siblings(floors: list[list[bytes]], slot: int) -> Path:
    """What stands left and right of a slot's node in its run, level by level."""
    found = []
    for nodes in floors[:-1]:
        start = slot - slot % FAN
        found.append((b"".join(nodes[start:slot]), b"".join(nodes[slot + 1 : start + FAN])))
        slot //= FAN
    return found


def pack(path: Path) -> bytes:
    """Per level the numbers of nodes left and right, then their digests."""
    return b"".join(bytes([len(a) // 64, len(b) // 64]) + bytes.fromhex((a + b).decode()) for a, b in path)


def unpack(data: bytes) -> Path:
    found, at = [], 0
    while at < len(data):
        left, right = data[at], data[at + 1]
        nodes = data[at + 2 : at + 2 + 32 * (left + right)].hex().encode()
        found.append((nodes[: 64 * left], nodes[64 * left :]))
        at += 2 + 32 * (left + right)
    return found


def fold(leaf: bytes, path: Path) -> bytes:
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def arrays(nodes: DataFrame, *more: str) -> DataFrame:
    """Rows with group, pos, size, leaf -> a row per slot array: at most 3^6 slots, each with its leaf and ``more``."""
    slot = F.struct((F.col("pos") % SLOTS).cast("int").alias("slot"), "leaf", *more)
    block = F.floor(F.col("pos") / SLOTS).cast("long").alias("block")
    return nodes.groupBy("group", block).agg(F.max("size").alias("size"), F.collect_list(slot).alias("slots"))


def _nodes(slots: list[dict], block: int, size: int) -> tuple[list[bytes], list[dict]]:
    """Leaves of an array in hexadecimal, each put into its slot, and the slots in that order."""
    placed: list = [None] * min(SLOTS, size - block * SLOTS)
    for s in slots:
        placed[s["slot"]] = s
    return [s["leaf"].hex().encode() for s in placed], placed


def _tower(nodes: list[bytes], size: int) -> list[list[bytes]]:
    return tower(nodes, LEVELS if size > SLOTS else None)


def tops(blocks: DataFrame) -> DataFrame:
    """The top digest of every array: a node of the next round, or the subroot if the group has one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for b, n, slots in zip(*(batch.column(c).to_pylist() for c in ("block", "size", "slots"))):
                found.append(bytes.fromhex(_tower(_nodes(slots, b, n)[0], n)[-1][0].decode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("group"), batch.column("block"), batch.column("size"), pa.array(found, pa.binary())], ["group", "pos", "size", "leaf"]
            )

    above = blocks.mapInArrow(tidy(run), "group string, pos bigint, size bigint, leaf binary")
    return above.withColumn("size", F.ceil(F.col("size") / SLOTS).cast("long"))


def paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """group, pos and packed path of every node of the arrays; ``above`` has the path above each array (group, block, path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [])
            for g, b, n, slots, path in zip(*(batch.column(c).to_pylist() for c in ("group", "block", "size", "slots", "path"))):
                nodes, _ = _nodes(slots, b, n)
                floors = _tower(nodes, n)
                for i in range(len(nodes)):
                    for column, value in zip(out, (g, b * SLOTS + i, pack(siblings(floors, i)) + path)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["group", "pos", "path"])

    return blocks.join(small(above), ["group", "block"]).select("group", "block", "size", "slots", "path").mapInArrow(tidy(run), "group string, pos bigint, path binary")


@dataclass
class Tree:
    """``rounds``: tables of slot arrays, lowest first; ``roots``: group and digest."""

    rounds: list[DataFrame]
    roots: DataFrame

    def above(self, root_paths: DataFrame) -> DataFrame:
        """Paths above the lowest arrays (group, block, path), from those above the roots (group, path)."""
        down = None
        for blocks in reversed(self.rounds):
            started = blocks.where(F.col("size") <= SLOTS).select("group", F.col("block"))
            first = started.join(root_paths, "group")
            path = first if down is None else first.unionByName(down)
            if blocks is self.rounds[0]:
                return write_table(path, "paths")
            down = write_table(paths(blocks, path), "paths").withColumnRenamed("pos", "block")
        raise AssertionError("a tree has at least one round")


def tree(nodes: DataFrame, *more: str) -> Tree:
    """Fold leaves (group, pos, size, leaf) to one digest a group."""
    rounds, roots = [], None
    while True:
        blocks = write_table(arrays(nodes, *more), "arrays")
        more = ()
        rounds.append(blocks)
        top = write_table(tops(blocks), "tops")
        done = top.where(F.col("size") <= 1).select("group", "leaf")
        # a group with one array is done; its arrays have size <= 3^6 and their tops size 1
        roots = done if roots is None else roots.unionByName(done)
        if (blocks.agg(F.max("size")).first()[0] or 0) <= SLOTS:
            return Tree(rounds, roots)
        nodes = top.where(F.col("size") > 1)


def proofs(df: DataFrame, id: str, group: str, leaf: Column, claimed: Column) -> DataFrame:
    """Manifest and proof of every row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``leaf`` and ``claimed`` are binary digests: that which the manifest is built from, and the one that is checked
    against it by folding it with the proof's siblings. Groups follow each other by their UTF-8 bytes, null first.
    A row that repeats is as many leaves. An empty table gives an empty result.
    """
    rows = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{group}`").alias("name"), leaf.alias("leaf"), claimed.alias("claimed"))
    leaves = rows.select(encoded(F.col("name")).alias("group"), "id", "leaf", "claimed")
    own = tree(coordinates(leaves), "id", "claimed")
    names = own.roots.withColumn("name", F.when(F.col("group") != "-", F.substring_index("group", ":", 1)))
    names = names.withColumn("name", F.when(F.col("group") != "-", F.expr("substring(group, length(name) + 2)")))
    ordered = write_table(names.select("group", "leaf", F.coalesce("name", F.lit("")).alias("name"), F.col("name").isNotNull().cast("int").alias("named")), "roots")
    seats = positions(ordered, ["name", "named"], name="pos") if not ordered.isEmpty() else ordered.withColumn("pos", F.lit(0).cast("long"))
    total = ordered.count()
    seats = write_table(seats.select("group", "leaf", (F.col("pos") - 1).cast("long").alias("pos")), "seats")
    upper = tree(seats.select(F.lit("").alias("group"), "pos", F.lit(total).cast("long").alias("size"), "leaf"))
    no_path = upper.roots.select("group", F.lit(b"").alias("path"))
    over = write_table(paths(upper.rounds[0], upper.above(no_path)), "paths")
    root = (upper.roots.first() or [None, None])[1]
    known = seats.join(over.select("pos", "path"), "pos").select("group", "path", F.col("leaf").alias("subroot"))
    above = own.above(known.select("group", "path"))
    lowest = own.rounds[0].join(small(above), ["group", "block"]).join(known.select("group", "subroot"), "group").select("block", "size", "slots", "path", "subroot")
    hexadecimal = None if root is None else bytes(root).hex()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, n, slots, packed, subroot in zip(*(batch.column(c).to_pylist() for c in ("block", "size", "slots", "path", "subroot"))):
                nodes, placed = _nodes(slots, b, n)
                floors, upper_path = _tower(nodes, n), unpack(packed)
                upper_proof = b"".join(a + c for a, c in upper_path)
                proof, folded = [], []
                for i, s in enumerate(placed):
                    path = siblings(floors, i)
                    proof.append(digest(b"".join([a + c for a, c in path]) + upper_proof).decode())
                    folded.append(fold(fold(s["claimed"].hex().encode(), path), upper_path).decode())
                columns = [[s["id"] for s in placed], [x.decode() for x in nodes], [subroot.hex()] * len(nodes), [hexadecimal] * len(nodes), proof, folded]
                arrays_ = [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:]), pa.array([f == hexadecimal for f in folded], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays_, [id, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return lowest.mapInArrow(tidy(run), f"`{id}` bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
