"""Exact ordered computations that stay balanced whatever the keys look like.

A plain window puts a whole group, or the whole table when there is no
``partitionBy``, into one task. The functions here cut the order column into
slices at fixed edges. Each (key, slice) cell is computed on its own, and one
small frame with at most ``slices`` rows per key carries totals from slice to
slice. A key that holds a third of all rows is therefore spread over about a
third of the slices.

The edges come from approximate quantiles; they are literals in the plan, so a
re-run task always sees the same slices. A value that many rows share is cut on
along the next order column. Edges only balance the work: every result is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import cut_lineage

SLICE = "_slice"


def slice_count(df: DataFrame) -> int:
    """As many slices as shuffle partitions, so that it grows with the cluster."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def order_number(df: DataFrame, name: str) -> Column:
    """A double that never decreases when the column increases."""
    dtype = df.schema[name].dataType
    col = F.col(name)
    if isinstance(dtype, T.NumericType):
        return col.cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    if isinstance(dtype, T.StringType):
        return _string_number(df, name)
    raise TypeError(f"cannot order by {name}: {dtype.simpleString()}")


def _string_number(df: DataFrame, name: str) -> Column:
    """First six bytes after the prefix all values share, read as a number."""
    low, high = df.agg(F.min(name), F.max(name)).first()
    shared = 0
    if low is not None:
        for a, b in zip(low, high):
            if a != b:
                break
            shared += 1
    tail = F.expr(f"substring(cast(substring(`{name}`, {shared + 1}) as binary), 1, 6)")
    return F.conv(F.rpad(F.hex(tail), 12, "0"), 16, 10).cast("double")


def slice_edges(df: DataFrame, numbers: Mapping[str, Column], slices: int) -> dict[str, list[float]]:
    """Inner edges per number, from one pass over the data."""
    names = list(numbers)
    probe = df.select(*[numbers[n].alias(n) for n in names])
    steps = [i / slices for i in range(1, slices)]
    found = probe.approxQuantile(names, steps, max(1e-4, 0.25 / slices))
    return {n: sorted(set(edges)) for n, edges in zip(names, found)}


def assign_slices(df: DataFrame, columns: Mapping[str, str], edges: Mapping[str, list[float]]) -> DataFrame:
    """Add one integer slice column per numeric column (``{input: output}``)."""
    names = list(columns)
    splits = []
    for n in names:
        inner = [e for e in edges[n] if e not in (float("inf"), float("-inf"))] or [0.0]
        splits.append([float("-inf"), *inner, float("inf")])
    bucketizer = Bucketizer(
        inputCols=names,
        outputCols=[columns[n] for n in names],
        splitsArray=splits,
        handleInvalid="keep",
    )
    out = bucketizer.transform(df)
    return out.withColumns({columns[n]: F.col(columns[n]).cast("int") for n in names})


def with_slice(df: DataFrame, order: str | Sequence[str], slices: int | None = None) -> DataFrame:
    """Add the ``_slice`` column, which never decreases in the lexicographic order of the columns.

    Edges are quantiles of the first column. A value that holds two edges or more gets a slice of its own, which is cut
    again at quantiles of the next column, and so on, into as many pieces as it has edges: so neither a value that most
    rows share nor a few of them make a large slice, unless rows are equal in all order columns.
    """
    order = [order] if isinstance(order, str) else list(order)
    slices = slices or slice_count(df)
    number = order_number(df, order[0])
    edges = _repeated_edges(df, number, slices)
    out = assign_slices(df.withColumn("_order", number), {"_order": SLICE}, {"_order": sorted(set(edges))}).drop("_order")
    shared = {e: edges.count(e) for e in set(edges) if edges.count(e) > 1}
    if not shared:
        return out
    # piece 2i: rows equal to the shared edge that opens slice i; 2i + 1: what else slice i holds
    at_edge = number.isin(*shared)
    out = out.withColumn(SLICE, F.when(at_edge, 2 * F.col(SLICE)).otherwise(2 * F.col(SLICE) + 1).cast("long"))
    places = {r[0]: r[1] for r in out.where(at_edge).select(number.alias("v"), SLICE).distinct().collect()}  # a row an edge
    pieces = {places[v]: n for v, n in shared.items() if v in places}
    for name in order[1:]:
        out, pieces = _cut_again(out, name, pieces, slices)
        if not pieces:
            break
    return out


def _repeated_edges(df: DataFrame, number: Column, slices: int) -> list[float]:
    """Inner edges as found: a value that many rows share stands for several of them."""
    steps = [i / slices for i in range(1, slices)]
    return sorted(df.select(number.alias("_n")).approxQuantile("_n", steps, max(1e-4, 0.25 / slices)))


def _cut_again(df: DataFrame, name: str, pieces: Mapping[int, int], slices: int) -> tuple[DataFrame, dict[int, int]]:
    """Cut the slices in ``pieces`` (slice: wanted number) by another column; returns those that hold one value again.

    All slices are renumbered by one factor, so that their order stays. The edges of all slices together are no more
    than those of the whole table.
    """
    number = F.coalesce(order_number(df, name), F.lit(float("-inf")))
    rows = df.where(F.col(SLICE).isin(*pieces)).select(SLICE, number.alias("_n"))
    steps = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    found = rows.groupBy(SLICE).agg(F.percentile_approx("_n", steps, 100 * slices).alias("edges")).collect()
    width = 2 * slices + 2
    cut, again = F.lit(0), {}
    for row in found:
        wanted = pieces[row[0]]
        edges = [row.edges[i * len(row.edges) // wanted] for i in range(1, wanted)] if wanted > 1 else []
        inner = sorted(set(edges))
        if not inner:
            continue
        below = F.size(F.filter(F.array(*[F.lit(e) for e in inner]), lambda e: e <= number))
        shared = [e for e in inner if edges.count(e) > 1]
        equal = number.isin(*shared) if shared else F.lit(False)
        cut = F.when(F.col(SLICE) == row[0], F.when(equal, 2 * below).otherwise(2 * below + 1)).otherwise(cut)
        for e in shared:
            again[row[0] * width + 2 * (inner.index(e) + 1)] = edges.count(e)
    return df.withColumn(SLICE, (F.col(SLICE) * width + cut).cast("long")), again


_INPUT = {
    "count": lambda c: F.when(c.isNotNull(), 1).otherwise(0),
    "sum": lambda c: c,
    "max": lambda c: c,
    "min": lambda c: c,
    "total": lambda c: c,
    "previous": lambda c: c,
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: Mapping[str, tuple[str, Column]],
    descending: bool = False,
    slices: int | None = None,
    sliced: bool = False,
) -> DataFrame:
    """Add running measures per key, up to and including the current row.

    ``measures`` maps a new column to ``(kind, input)``. Kinds: ``count`` of
    non-null inputs, ``sum``, ``max``, ``min``, ``total`` (the sum over all rows
    of the key) and ``previous`` (the input of the row before). ``order``
    must be unique within a key and its first column must not be null. Pass
    ``sliced=True`` when ``df`` already has a ``_slice`` column that agrees with
    the order.

    One shuffle of the rows by (key, slice). What a slice inherits from
    earlier ones travels as one header row per cell that sorts before the
    cell's rows, so there is no join and null keys form a group of their own.
    """
    keys = list(keys)
    base = df if sliced else with_slice(df, order, slices)
    names = list(measures)
    inputs = {n: f"_in_{i}" for i, n in enumerate(names)}
    rows = base.select(
        "*",
        *[_INPUT[kind](col).alias(inputs[n]) for n, (kind, col) in measures.items()],
        F.lit(1).alias("_row"),
    )

    def arrange(names_: Iterable[str]) -> list[Column]:
        return [F.col(n).desc() if descending else F.col(n).asc() for n in names_]

    newest = packed_order(df, order) if any(kind == "previous" for kind, _ in measures.values()) else None
    cell_aggs = []
    for n, (kind, _) in measures.items():
        c = inputs[n]
        if kind in ("count", "sum", "total"):
            cell_aggs.append(F.sum(c).alias(c))
        elif kind == "max":
            cell_aggs.append(F.max(c).alias(c))
        elif kind == "min":
            cell_aggs.append(F.min(c).alias(c))
        else:
            pick = F.min_by if descending else F.max_by
            cell_aggs.append(pick(F.struct(F.col(c)), newest).alias(c))
    cells = rows.groupBy(*keys, SLICE).agg(*cell_aggs)

    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = by_key.orderBy(*arrange([SLICE])).rowsBetween(Window.unboundedPreceding, -1)
    heads = []
    for n, (kind, _) in measures.items():
        c = inputs[n]
        if kind in ("count", "sum"):
            value = F.sum(c).over(earlier)
        elif kind == "total":
            value = F.sum(c).over(by_key)
        elif kind == "max":
            value = F.max(c).over(earlier)
        elif kind == "min":
            value = F.min(c).over(earlier)
        else:
            value = F.last(c).over(earlier).getField(c)
        heads.append(value.alias(c))
    header = cells.select(*keys, SLICE, *heads, F.lit(0).alias("_row"))
    known = set(header.columns)
    header = header.select(
        "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in known]
    )

    cell = Window.partitionBy(*keys, SLICE).orderBy(F.col("_row"), *arrange(order))
    upto = cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outputs = []
    for n, (kind, _) in measures.items():
        c = inputs[n]
        if kind in ("count", "sum"):
            outputs.append(F.sum(c).over(upto).alias(n))
        elif kind == "max":
            outputs.append(F.max(c).over(upto).alias(n))
        elif kind == "min":
            outputs.append(F.min(c).over(upto).alias(n))
        elif kind == "total":
            outputs.append(F.first(c).over(upto).alias(n))
        else:
            outputs.append(F.lag(c).over(cell).alias(n))
    kept = [c for c in df.columns if c != SLICE or sliced]
    joined = rows.unionByName(header)
    if slices and slices > slice_count(df):
        joined = joined.repartition(slices, *keys, SLICE)
    return joined.select(*kept, "_row", *outputs).where("_row = 1").drop("_row")


def positions(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), descending: bool = False, name: str = "position"
) -> DataFrame:
    """1-based position of every row within its key, exact and unbounded in size."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, descending)


def dense_index(df: DataFrame, column: str, name: str = "index", start: int = 0) -> DataFrame:
    """Distinct non-null values of a column with their rank in sorted order."""
    values = cut_lineage(df.select(column).where(F.col(column).isNotNull()).distinct())  # read for the edges, the cells and the rows
    out = positions(values, [column], name=name)
    return out.withColumn(name, (F.col(name) + (start - 1)).cast("long"))


def hash_order(columns: Sequence[str], seed: int) -> Column:
    """A repeatable pseudo-random number in [0, 1) for a row's key columns."""
    digest = F.xxhash64(*[F.col(c) for c in columns], F.lit(seed))
    return F.shiftrightunsigned(digest, 11).cast("double") / F.lit(float(1 << 53))


def hash_positions(
    df: DataFrame, ids: Sequence[str], seed: int, keys: Sequence[str] = (), name: str = "position", total: str | None = None
) -> DataFrame:
    """Position of every row in a repeatable random order.

    The order is uniform, so the slices are plain ranges of it and need no
    pass over the data.
    """
    n = slice_count(df)
    rows = df.withColumn("_u", hash_order(ids, seed)).withColumn(SLICE, F.floor(F.col("_u") * n).cast("int"))
    measures = {name: ("count", F.lit(1))}
    if total:
        measures[total] = ("total", F.lit(1))
    return running(rows, keys, ["_u", *ids], measures, sliced=True).drop("_u", SLICE)


#: Rows that a task orders or collects; more rows make more tasks, so that a task's memory doesn't grow with the input.
TASK_ROWS = 1 << 20


def task_count(df: DataFrame, rows: int) -> int:
    """As many tasks as shuffle partitions, or more for many rows."""
    return max(slice_count(df), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """One exchange by key, into more tasks than usual where there are many rows."""
    tasks = task_count(df, rows)
    return df.repartition(tasks, *keys) if tasks > slice_count(df) else df.repartition(*keys)


#: Rows that one task orders without help; a key with more, if it is a notable share of all rows, is cut into slices.
HEAVY_ROWS = 1 << 20


def heavy_keys(df: DataFrame, keys: Sequence[str], heavy: int = HEAVY_ROWS) -> DataFrame | None:
    """The keys that hold more than ``heavy`` rows and a sixteenth of an average partition, or None."""
    return _weighed(df, keys, heavy)[0]


def _weighed(df: DataFrame, keys: Sequence[str], heavy: int) -> tuple[DataFrame | None, int]:
    """The heavy keys, or None, and the number of all rows.

    One counting pass with map-side aggregation. There are at most sixteen such keys a shuffle partition.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = only_row(counts.agg(F.max("_n").alias("most"), F.sum("_n").alias("n")))
    total = rows.value("n") or 0
    share = total / (16 * task_count(df, total))
    if (rows.value("most") or 0) <= max(heavy, share):
        return None, total
    return cut_lineage(counts.where(F.col("_n") > max(heavy, share)).drop("_n")), total


def _among(keys: Sequence[str], few: DataFrame) -> tuple[DataFrame, Column]:
    """Rename the key columns of ``few``; null keys meet null keys."""
    named = few.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)])
    meet = F.lit(True)
    for i, k in enumerate(keys):
        meet = meet & F.col(k).eqNullSafe(F.col(f"_h{i}"))
    return named, meet


def in_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], measures: Mapping[str, tuple[str, Column]], heavy: int = HEAVY_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add running measures per key as ``running`` does, by a secondary sort.

    One exchange by key and one sort by key and order serve all measures, and an aggregation by the same keys after it
    needs no other exchange. Only keys too large for a task (:func:`heavy_keys`) are cut into slices instead; they are
    found in ``counted``, if given: rows with the same keys that are fewer or computed already.
    """
    keys, names = list(keys), list(measures)
    few, total = _weighed(df if counted is None else counted, keys, heavy)
    light = df
    if few is not None:
        named, meet = _among(keys, few)
        light = df.join(named, meet, "left_anti")
    window = Window.partitionBy(*keys).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    fold = {
        "count": lambda c: F.count(c).over(upto), "sum": lambda c: F.sum(c).over(upto), "max": lambda c: F.max(c).over(upto),
        "min": lambda c: F.min(c).over(upto), "total": lambda c: F.sum(c).over(whole), "previous": lambda c: F.lag(c).over(window),
    }
    arranged = dealt(light, keys, total).sortWithinPartitions(*keys, *order)
    out = arranged.select("*", *[fold[measures[n][0]](measures[n][1]).alias(n) for n in names])
    if few is None:
        return out
    rest = cut_lineage(df.join(named, meet, "left_semi"))  # read for the edges, the cells and the rows
    return out.unionByName(running(rest, keys, order, measures, slices=task_count(df, total)))


def _whole_number(df: DataFrame, name: str) -> Column | None:
    """A long that orders like an integer, date or timestamp column."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return F.col(name).cast("long")
    if isinstance(dtype, T.DateType):
        return F.unix_date(name).cast("long")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return None


def packed_order(df: DataFrame, order: Sequence[str]) -> Column:
    """One number that orders like the columns, so that newest and oldest rows are found by hash aggregation.

    Each column takes as many bits as its range in ``df`` needs, read by one pass; nulls come first. Up to 62 bits make
    a long, up to 125 a decimal; columns that are no whole numbers or times, or need more, make a struct.
    """
    numbers = [_whole_number(df, c) for c in order]
    whole = F.struct(*[F.col(o) for o in order])
    if any(n is None for n in numbers):
        return whole
    ends = only_row(df.agg(*[f(n).alias(f"{f.__name__}{i}") for i, n in enumerate(numbers) for f in (F.min, F.max)]))
    low = [ends.value(f"min{i}") or 0 for i in range(len(numbers))]
    bits = [((ends.value(f"max{i}") or 0) - x + 1).bit_length() for i, x in enumerate(low)]
    places = [F.coalesce(n - F.lit(x) + 1, F.lit(0)) for n, x in zip(numbers, low)] if sum(bits) <= 62 else None
    if places is not None:
        packed = F.lit(0).cast("long")
        for place, width in zip(places, bits):
            packed = F.shiftleft(packed, width) + place
        return packed
    if sum(bits) > 125:
        return whole
    packed = F.lit(0).cast("decimal(38,0)")
    for n, x, width in zip(numbers, low, bits):
        place = F.coalesce(n.cast("decimal(20,0)") - F.lit(str(x - 1)).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
        packed = (packed * F.lit(str(1 << width)).cast("decimal(20,0)") + place).cast("decimal(38,0)")
    return packed


def rank_table(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct (by, value) with their average rank ``_rank`` and the group's count ``_of``; no nulls."""
    by = list(by)
    counts = df.select(*by, value).dropna().groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties"))
    ranked = running(
        counts, by, [value], {"_upto": ("sum", F.col("_ties")), "_of": ("total", F.col("_ties"))}
    )
    mean_rank = F.col("_upto") - F.col("_ties") + (F.col("_ties") + 1) / 2
    return ranked.select(*by, value, mean_rank.alias("_rank"), "_of")


def rank_ladder(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Distinct (by, column, value) of numeric columns with their average rank and the group's count, in long form.

    All columns go through one pass for the edges, one count and one running sum; no nulls.
    """
    by = list(by)
    numbers = {f"_n{i}": F.col(c).cast("double") + F.lit(0.0) for i, c in enumerate(columns)}  # -0.0 is 0.0, also for the slices
    rows = df.dropna(subset=by).select(*by, *[v.alias(k) for k, v in numbers.items()]) if by else df.select(*[v.alias(k) for k, v in numbers.items()])
    edges = slice_edges(rows, {k: F.col(k) for k in numbers}, slice_count(df))
    cut = assign_slices(rows, {k: f"_s{k}" for k in numbers}, edges)
    pieces = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(k).alias("_value"), F.col(f"_s{k}").alias(SLICE)) for c, k in zip(columns, numbers)])
    counts = cut.select(*by, F.inline(pieces)).where("_value is not null and not isnan(_value)").groupBy(*by, "_column", SLICE, "_value").agg(F.count(F.lit(1)).alias("_ties"))
    ranked = running(counts, [*by, "_column"], ["_value"], {"_upto": ("sum", F.col("_ties")), "_of": ("total", F.col("_ties"))}, sliced=True)
    mean_rank = F.col("_upto") - F.col("_ties") + (F.col("_ties") + 1) / 2
    return ranked.select(*by, "_column", "_value", mean_rank.alias("_rank"), "_of")


def average_ranks(df: DataFrame, names: Mapping[str, str], by: Sequence[str] = (), pct: bool = True) -> DataFrame:
    """Add the rank of each column within ``by``, ties sharing their mean rank.

    ``pct`` divides by the number of non-null values. Null values and rows with
    a null group get a null rank. Ranks are computed on distinct values, for
    all numeric columns at once, and joined back, so a value or group of any
    size costs one counter.
    """
    by = list(by)
    rank = F.col("_rank") / F.col("_of") if pct else F.col("_rank")
    exact = (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType)
    together = [c for c in names if isinstance(df.schema[c].dataType, exact)]
    out, together = df, together if len(together) > 1 else []
    if together:
        # numbered rows, stored so that the numbers stay; a row's values are looked up as narrow rows and meet again by number
        out = cut_lineage(df.withColumn("_at", F.monotonically_increasing_id()))
        pieces = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in together])
        asked = out.select("_at", *by, F.inline(pieces)).where("_value is not null")
        placed = asked.join(rank_ladder(out, together, by), [*by, "_column", "_value"]).select("_at", "_column", rank.alias("_place"))
        found = placed.repartition("_at").groupBy("_at").agg(*[F.max(F.when(F.col("_column") == c, F.col("_place"))).alias(names[c]) for c in together])
        out = out.join(found, "_at", "left")
    for value, name in names.items():
        if value not in together:
            out = out.join(rank_table(out, value, by).select(*by, value, rank.alias(name)), [*by, value], "left")
    return out.select(*df.columns, *names.values())


def average_rank(df: DataFrame, value: str, by: Sequence[str] = (), pct: str | None = None, rank: str | None = None) -> DataFrame:
    """One column's average rank, as a percentile (``pct``) or a position (``rank``)."""
    return average_ranks(df, {value: pct or rank}, by, pct=pct is not None)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact linear-interpolated quantiles in long form: by, column, p, quantile.

    First counts per (group, column, slice) show which slices hold the wanted
    positions; only the values of those slices are then counted one by one.
    """
    by, columns, probs = list(by), list(columns), [float(p) for p in probs]
    numbers = {f"_n{i}": F.col(c).cast("double") for i, c in enumerate(columns)}
    rows = df.select(*by, *[v.alias(k) for k, v in numbers.items()])
    edges = slice_edges(rows, {k: F.col(k) for k in numbers}, slice_count(df))
    cut = assign_slices(rows, {k: f"_s{k}" for k in numbers}, edges)
    pieces = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(k).alias("v"), F.col(f"_s{k}").alias(SLICE))
            for c, k in zip(columns, numbers)
        ]
    )
    long = cut.select(*by, F.inline(pieces)).where("v is not null and not isnan(v)")
    group = [*by, "column"]
    cells = long.groupBy(*group, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    asked = F.explode(F.array(*[F.lit(p) for p in probs])).alias("p")
    targets = (
        cells.select(
            *group,
            SLICE,
            "_n",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
            F.sum("_n").over(whole).alias("_total"),
        )
        .select("*", asked)
        .withColumn("_at", F.col("p") * (F.col("_total") - 1))
        .withColumn("_lo", F.floor("_at"))
        .withColumn("_hi", F.ceil("_at"))
        .where(
            "(_lo >= _before and _lo < _before + _n) or (_hi >= _before and _hi < _before + _n)"
        )
    )
    wanted = targets.select(*group, SLICE).distinct()
    counts = long.join(wanted, [*group, SLICE], "left_semi").groupBy(*group, SLICE, "v").agg(
        F.count(F.lit(1)).alias("_ties")
    )
    inside = Window.partitionBy(*group, SLICE).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ladder = counts.withColumn("_upto", F.sum("_ties").over(inside))
    first = F.col("_before") + F.col("_upto") - F.col("_ties")
    last = F.col("_before") + F.col("_upto")
    picked = targets.join(ladder, [*group, SLICE]).select(
        *group,
        "p",
        (F.col("_at") - F.col("_lo")).alias("_part"),
        F.when((F.col("_lo") >= first) & (F.col("_lo") < last), F.col("v")).alias("_low"),
        F.when((F.col("_hi") >= first) & (F.col("_hi") < last), F.col("v")).alias("_high"),
    )
    return (
        picked.groupBy(*group, "p")
        .agg(F.max("_low").alias("_low"), F.max("_high").alias("_high"), F.max("_part").alias("_part"))
        .select(*group, "p", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("quantile"))
    )


def quantile_table(
    df: DataFrame, wanted: Mapping[str, tuple[str, float]], by: Sequence[str] = ()
) -> DataFrame:
    """Quantiles as named columns: ``{name: (column, p)}``, one row per group."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    probs = sorted({p for _, p in wanted.values()})
    long = exact_quantiles(df, columns, probs, by)
    picks = [
        F.max(F.when((F.col("column") == c) & (F.col("p") == p), F.col("quantile"))).alias(n)
        for n, (c, p) in wanted.items()
    ]
    return long.groupBy(*by).agg(*picks)


class OneRow:
    """The values of a one-row statistics frame as literals."""

    def __init__(self, stats: DataFrame):
        self._types = {f.name: f.dataType for f in stats.schema.fields}
        self._row = stats.first()

    def __contains__(self, name: str) -> bool:
        return name in self._types

    def value(self, name: str):
        return None if self._row is None else self._row[name]

    def getField(self, name: str) -> Column:
        return F.lit(self.value(name)).cast(self._types[name])


def only_row(stats: DataFrame) -> OneRow:
    """Read a one-row statistics frame once; its values become constants of the plan."""
    return OneRow(stats)


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    measures: Mapping[str, tuple[Column, int, int]],
    width: int = 1024,
) -> DataFrame:
    """Aggregates over trailing ranges of an integer position per key.

    ``measures`` maps a name to ``(aggregate, first, last)``: ``(F.avg("x"), -5, -1)``
    averages the five positions before the current one. Positions without a
    row count as gaps. The position axis is cut into blocks of ``width``; rows
    near the end of a block are also sent to the next one, so every block has
    its history and blocks never need each other.
    """
    reach = max(-first for _, first, _ in measures.values())
    width = max(width, reach)
    block = F.floor(F.col(position) / width)
    spread = F.when(
        F.pmod(F.col(position), F.lit(width)) >= width - reach, F.array(block, block + 1)
    ).otherwise(F.array(block))
    rows = df.select("*", F.explode(spread).alias("_block"))
    window = Window.partitionBy(*keys, "_block").orderBy(F.col(position).cast("long"))
    out = rows.select(
        "*", *[agg.over(window.rangeBetween(first, last)).alias(n) for n, (agg, first, last) in measures.items()]
    )
    return out.where(F.col("_block") == block).drop("_block")


def row_positions(
    df: DataFrame, score: str, unique_id: str, descending: bool = True, name: str = "position", total: str | None = None
) -> DataFrame:
    """Position of every row by score, ties by id, however many rows share a score.

    Rows ahead come from the distinct scores, the place among equals from
    id-sliced cells of that score.
    """
    counts = df.groupBy(score).agg(F.count(F.lit(1)).alias("_ties"))
    ladder = running(
        counts, [], [score], {"_upto": ("sum", F.col("_ties")), "_of": ("total", F.col("_ties"))}, descending
    )
    ahead = ladder.select(score, (F.col("_upto") - F.col("_ties")).alias("_ahead"), "_of")
    placed = running(df, [score], [unique_id], {"_place": ("count", F.lit(1))})
    out = placed.join(ahead, score)
    extra = [F.col("_of").alias(total)] if total else []
    return out.select(*df.columns, (F.col("_ahead") + F.col("_place")).alias(name), *extra)
