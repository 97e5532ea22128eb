"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

The usual L tables of K hashes need L x K minhashes. Here two collections of ``bands`` small hashes of ``rows``
minhashes each are combined: every pair of a hash from the first and one from the second is the key of a table, so
2 x bands x rows minhashes serve bands x bands tables. Documents that share a key fall into a cluster; inside a cluster
all pairs are confirmed on their sets, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import keep, lowered, mix, slices, small, text_arrays, tidy
from ledgerlens.llm.components import components

#: Words of a shingle.
SHINGLE = 5
#: Hashes in each of the two collections, and minhashes of one hash. A pair of similarity s meets in some table with
#: probability (1 - (1 - s**rows)**bands)**2: 0.9998 at 0.85 with 16 and 5, 0.9996 at 0.8 with 16 and 4.
BANDS, ROWS = 16, 5
#: Members of a block, and shingles of a block, on average at most: a task holds two blocks.
BLOCK_MEMBERS, BLOCK_SHINGLES = 400, 400_000
#: Numbers of a matrix of shared shingles that a task holds at once.
MATRIX = 1 << 22

_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)


def word_hashes(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of joined texts, and the number of words before each text and of all.

    The hash is a polynomial of the word's bytes, taken as a difference of running sums.
    """
    raw = np.frombuffer(data, np.uint8)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    starts[first] = solid[first]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | starts[1:]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    powers = np.cumprod(np.full(len(raw) + 1, _POWER, np.uint64), dtype=np.uint64)
    inverse = np.cumprod(np.full(len(raw) + 1, np.uint64(pow(int(_POWER), -1, 1 << 64)), np.uint64), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * powers[: len(raw)], dtype=np.uint64)])
    hashes = mix((sums[e + 1] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
    return hashes, np.searchsorted(s, offsets)


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def shingle_hashes(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of the windows of n words of one text; of the whole text if it has fewer; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * _POWER + words[k : len(words) - n + 1 + k]
    return mix(h)


def shingle_set(text: str | bytes | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted different shingle hashes of a whole text."""
    data = lowered(text)
    return np.unique(shingle_hashes(word_hashes(data, np.array([0, len(data)]))[0], n))


def digest(data: bytes) -> bytes:
    """128-bit digest of a lower-cased text's words: equal for texts with the same words in the same order."""
    return blake2b(b" ".join(data.split()), digest_size=16).digest()


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64))
    return (seeds[:count] | np.uint64(1)).astype(np.uint32), seeds[count:].astype(np.uint32)


def signatures(df: DataFrame, key: str, text: str, bands: int, rows: int) -> DataFrame:
    """Per row: key, its fingerprint, digest of its words, number of shingles, and the two collections of hashes."""
    inner = df.select(F.col(f"`{key}`").alias("key"), F.xxhash64(f"`{key}`", f"`{text}`").alias("row"), F.col(f"`{text}`").alias("text"))
    factors, shifts = _functions(2 * bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_arrays(batch.column(2))
            for start, end in slices(texts):
                low = [lowered(t) for t in texts.slice(start, end - start).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))])
                words, at = word_hashes(b"".join(low), offsets)
                each = [shingle_hashes(words[a:b]) for a, b in zip(at, at[1:])]
                sizes = np.array([len(np.unique(x)) for x in each], np.int64)
                collections = np.zeros((2 * bands, len(low)), np.uint64)
                full = np.flatnonzero(sizes)
                if len(full):
                    flat = np.concatenate([each[i] for i in full])
                    flat = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
                    begins = np.concatenate([[0], np.cumsum([len(each[i]) for i in full])])[:-1]
                    for b in range(2 * bands):
                        h = np.full(len(full), b, np.uint64)
                        for r in range(b * rows, (b + 1) * rows):
                            h = h * _POWER + np.minimum.reduceat(flat * factors[r] + shifts[r], begins)
                        collections[b, full] = mix(h)
                halves = [_lists(collections[:bands]), _lists(collections[bands:])]
                columns = [c.slice(start, end - start) for c in batch.columns[:2]]
                columns += [pa.array([digest(t) for t in low], pa.binary()), pa.array(sizes), *halves]
                yield pa.RecordBatch.from_arrays(columns, ["key", "row", "digest", "n_shingles", "u", "v"])

    kind = df.schema[key].dataType.simpleString()
    return inner.mapInArrow(tidy(run), f"key {kind}, row bigint, digest binary, n_shingles bigint, u array<bigint>, v array<bigint>")


def _lists(table: np.ndarray) -> pa.Array:
    n, rows = table.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * n), pa.array(table.T.reshape(-1).view(np.int64)))


def _meeting(keys: DataFrame) -> DataFrame:
    """Edges from the smallest node of a table key to the others that have the key. Keys go through one exchange."""
    dealt = keys.repartition("k")
    shared = dealt.groupBy("k").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("k", "lead")
    return dealt.join(shared, "k").where(F.col("node") != F.col("lead"))


def _common(classes: DataFrame, bands: int) -> DataFrame:
    """``node`` and, of each collection, the hashes that another class has at the same place; no row without both."""
    # the last bit of a hash says which collection it is from
    sides = [F.transform(c, lambda h, i: F.shiftleft(F.xxhash64(i, h), 1).bitwiseOR(F.lit(bit))) for c, bit in (("u", 0), ("v", 1))]  # noqa: B023
    hashes = classes.select("node", F.explode(F.concat(*sides)).alias("h")).repartition("h")
    shared = hashes.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("h")
    own = hashes.join(shared, "h", "left_semi").groupBy("node").agg(F.collect_list("h").alias("h"))
    of = lambda bit: F.filter("h", lambda h: h.bitwiseAND(F.lit(1)) == bit)
    return own.select("node", of(0).alias("u"), of(1).alias("v")).where((F.size("u") > 0) & (F.size("v") > 0))


def clusters(classes: DataFrame, bands: int) -> DataFrame:
    """``digest`` and ``cluster`` of the classes that share a table key with another one, directly or over others.

    A class goes by a 64-bit hash of its digest, which is half as long; should two hashes be equal, their clusters become
    one, and more pairs are confirmed. A table key can only be shared if both of its hashes are, so only these are
    combined.
    """
    named = F.xxhash64("digest").alias("node")
    left = keep(_common(classes.select(named, "u", "v"), bands))
    pairs = F.flatten(F.transform("u", lambda x: F.transform("v", lambda y: F.xxhash64(x, y))))
    edges = _meeting(left.select("node", F.explode(pairs).alias("k"))).select(F.col("lead").alias("a"), F.col("node").alias("b"))
    found = components(edges)
    return classes.select("digest", named).join(found, "node").select("digest", F.col("component").alias("cluster"))


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a cell, by products of 0/1 matrices over the shared shingles."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    renumbered = np.full(len(counts), -1)
    renumbered[shared] = np.arange(len(shared))
    column = renumbered[which]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n))
    width = max(1, MATRIX // n)
    for start in range(0, len(shared), width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((n, min(width, len(shared) - start)), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        out += part @ part.T
    return out


def _links(members: list[tuple[bytes, int, str]], split: bool, percent: int) -> list[tuple[bytes, bytes]]:
    """Links of one cell: enough of them to connect whatever its links connect. ``split``: only across its two blocks."""
    texts = {d: (block, t) for d, block, t in members}
    names = sorted(texts)
    if len(names) < 2:
        return []
    sets = [shingle_set(texts[d][1]) for d in names]
    sizes = np.array([len(s) for s in sets], float)
    both = _intersections(sets)
    near = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    if split:
        blocks = np.array([texts[d][0] for d in names])
        near &= blocks[:, None] != blocks[None, :]
    root = list(range(len(names)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in np.argwhere(np.triu(near, 1)).tolist():
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            out.append((names[i], names[j]))
    return out


def confirmed(df: DataFrame, key: str, text: str, members: DataFrame, percent: int) -> DataFrame:
    """Edges ``a``, ``b`` between digests that connect exactly what links of at least ``percent`` connect.

    ``members``: digest, row, cluster, n_shingles. A cluster that is larger than a block is dealt into blocks by hash,
    and each pair of blocks is a cell of its own.
    """
    sizes = members.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    placed = keep(members.join(sizes, "cluster").select(
        "row", "digest", "cluster", "blocks", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int").alias("block")
    ))
    rows = df.select(F.xxhash64(f"`{key}`", f"`{text}`").alias("row"), F.col(f"`{text}`").alias("text"))
    texts = rows.join(small(placed), "row").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = texts.select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "digest", "block", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, members = None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64).to_pydict()
                for c, lo, hi, d, b, t in zip(*(part[x] for x in ("cluster", "low", "high", "digest", "block", "text"))):
                    if (c, lo, hi) != cell:
                        yield from _found(cell, members, percent)
                        cell, members = (c, lo, hi), []
                    # rows come by digest: of equal ones one is enough; rows of one fingerprint may differ
                    if not (members and members[-1][0] == d) and digest(lowered(t)) == d:
                        members.append((d, b, t))
        yield from _found(cell, members, percent)

    return cells.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "digest").mapInArrow(tidy(run), "a binary, b binary")


def _found(cell, members, percent: int) -> Iterator[pa.RecordBatch]:
    if cell is not None and (links := _links(members, cell[1] != cell[2], percent)):
        a, b = zip(*links)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``df``: ``key``, ``row`` (fingerprint of key and text), ``n_shingles``, ``component_id``, ``kept``.

    Rows are linked whose sets of five-word shingles have 100 x intersection >= ``percent`` x union; ``component_id`` is
    the smallest key that a row reaches over links, itself included, and ``kept`` says that it is the row's own key.
    A text with fewer than five words is one shingle. Without words (null, empty, blank) the set is empty, nothing is
    linked, and the component is the row's own key. Texts with equal words are one class from the start, so that copies
    are never paired. A null key never is a component's name unless the component has no other, and is not kept.
    Other columns don't matter.
    """
    signed = keep(signatures(df, key, text, bands, rows))
    full = signed.where("n_shingles > 0")
    classes = keep(full.groupBy("digest").agg(
        F.min("key").alias("least"), F.min("row").alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("u").alias("u"), F.first("v").alias("v")
    ))
    found = clusters(classes, bands)
    members = classes.select("digest", "row", "n_shingles").join(found, "digest")
    linked = components(confirmed(df, key, text, members, percent)).select(F.col("node").alias("digest"), "component")
    named = classes.select("digest", "least").join(linked, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = named.join(names, "component").select("digest", "component_id")
    out = signed.select("key", "row", "digest", "n_shingles").join(per_class, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key"))
    return out.select(
        F.col("key").alias(key), "row", "n_shingles", component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept")
    )
