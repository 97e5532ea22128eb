"""Benchmark decontamination by SimHash windows, with DataFrame functions only.

Documents are looked at through windows of the size of each benchmark item, in words. Fingerprints of windows and items
meet in a multi-index: the 64 bits are cut into one block more than the radius, so that two fingerprints within the
radius agree in at least one block. Pairs within the radius are confirmed by the similarity of their weighted shingles.

Windows are only placed where they can be confirmed at all: at least the wanted share of an item's shingles must occur
in the window. They start at a common shingle, or where one puts the item's start. That leaves out nothing, whatever the
order of the passage: a window that starts with a shingle the item lacks can be moved on without losing a common one, up
to the document's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, keep, small

SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which the fingerprints of a leak may differ. At a similarity of 0.8 they differ in 9.7 bits on average, with
#: a deviation of 2.9.
RADIUS = 19


def words(text: Column) -> Column:
    """Lower-case words; null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def shingles(w: Column, k: Column | int) -> Column:
    """Hashes of all windows of k words, in order and with repetition; none if there are fewer words."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(
        F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, k)))
    ).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash: each shingle votes on each bit as often as it occurs."""
    votes = F.aggregate(
        hashes,
        F.array_repeat(F.lit(0), 64),
        lambda acc, h: F.transform(acc, lambda c, b: c + F.getbit(h, b).cast("int") * 2 - 1),
    )
    bits = F.transform(votes, lambda c, b: F.when(c > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger weights of two lists of hashes; a hash weighs as often as it occurs."""
    def times(hashes: Column, x: Column) -> Column:
        return F.size(F.filter(hashes, lambda y: y == x))

    common = F.aggregate(
        F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x))
    )
    return common / (F.size(a) + F.size(b) - common)


def blocks(fingerprint: Column, radius: int) -> Column:
    """(number, bits) of the radius + 1 blocks of a fingerprint, whose sizes are at most one apart."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[
        F.struct(F.lit(i).alias("number"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"))
        for i, (a, b) in enumerate(zip(edges, edges[1:]))
    ])


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    similarity: float = SIMILARITY, radius: int = RADIUS,
) -> DataFrame:
    """One row for each document and item whose passage it holds: key, item, ``similarity``, ``start_word``, ``n_words``.

    The similarity is that of the best window (the first of equal ones) to the item, by weighted five-word shingles of
    lower-case words; an item of fewer words is one shingle. Documents and items without words have no row, nor have
    documents with a null key, as nothing could be done about them; equal items each have a row. Rows of an equal key
    count as one document. The item side is broadcast only if it is checked to be small.
    """
    listed = items.select(F.col(f"`{item}`").alias("item"), words(F.col(f"`{item_text}`")).alias("w")).where(F.size("w") > 0)
    listed = listed.select("item", F.size("w").alias("n"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), "w")
    listed = keep(listed.select("item", "n", "k", shingles(F.col("w"), F.col("k")).alias("hashes")))
    sizes = sorted(r[0] for r in listed.select("k").distinct().collect())  # 1 to SHINGLE
    offsets = keep(listed.select("item", "n", F.size("hashes").alias("m"), F.posexplode("hashes").alias("offset", "h")))

    rows = docs.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").alias("key"), F.xxhash64(f"`{key}`", f"`{text}`").alias("row"), F.col(f"`{text}`").alias("text")
    )
    spread = rows.select("row", words(F.col("text")).alias("w"))
    found = F.array(*[shingles(F.col("w"), k) for k in sizes or [SHINGLE]])
    places = spread.select("row", F.explode(found).alias("hashes")).select("row", F.posexplode("hashes").alias("at", "h"))
    hits = places.join(small(offsets), "h")
    pairs = hits.groupBy("row", "item", "n", "m").agg(
        F.array_sort(F.collect_set("at")).alias("at"), F.collect_set(F.greatest(F.col("at") - F.col("offset"), F.lit(0))).alias("starts")
    )
    # the common weight of a window is at most the number of its places whose shingle the item has
    need = F.ceil(similarity * F.col("m") - 1e-9).cast("int")
    enough = pairs.where(F.size("at") >= need).withColumn("need", need)
    ahead = F.filter("at", lambda x, i: F.get("at", i + F.col("need") - 1) < x + F.col("m"))
    placed = F.concat(
        F.transform("starts", lambda x: F.struct(F.col("n").alias("n"), x.alias("start"), F.lit(False).alias("full"))),
        F.transform(ahead, lambda x: F.struct(F.col("n").alias("n"), x.alias("start"), F.lit(True).alias("full"))),
    )
    per_row = keep(enough.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list(placed))).alias("windows")))
    few = (per_row.agg(F.sum(F.size("windows"))).first()[0] or 0) <= 200_000

    cut = rows.join(F.broadcast(per_row) if few else per_row, "row").select("key", "windows", words(F.col("text")).alias("w"))
    # full: moved back to end with the document at the latest
    start = lambda x: F.when(x["full"], F.greatest(F.lit(0), F.least(x["start"], F.size("w") - x["n"]))).otherwise(x["start"])
    moved = F.array_distinct(F.transform("windows", lambda x: F.struct(x["n"].alias("n"), start(x).alias("start"))))
    cut = cut.select("key", "w", F.explode(moved).alias("x")).select(
        "key", F.col("x.n").alias("n"), F.col("x.start").alias("start"), F.slice("w", F.col("x.start") + 1, F.col("x.n")).alias("w")
    )
    cut = cut.select("key", "n", "start", shingles(F.col("w"), F.least(F.col("n"), F.lit(SHINGLE))).alias("window"))
    cut = keep(cut.where(F.size("window") > 0).withColumn("print", simhash(F.col("window"))))

    ours = cut.select("key", "n", "start", "print", "window", F.explode(blocks(F.col("print"), radius)).alias("block"))
    printed = listed.withColumn("item_print", simhash(F.col("hashes")))
    theirs = keep(printed.select("item", "n", "hashes", "item_print", F.explode(blocks(F.col("item_print"), radius)).alias("block")))
    near = ours.join(small(theirs), ["n", "block"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    scored = near.select("key", "item", "start", "n", weighted_similarity(F.col("window"), F.col("hashes")).alias("similarity"))
    best = scored.where(F.col("similarity") >= similarity).groupBy("key", "item").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("start"), "n")).alias("best")
    )
    return best.select(
        F.col("key").alias(key), F.col("item").alias(item), F.col("best.similarity").alias("similarity"),
        (-F.col("best.start")).cast("long").alias("start_word"), F.col("best.n").cast("long").alias("n_words"),
    )
