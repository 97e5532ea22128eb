"""Passages that documents share, exactly or nearly, by collinear chaining.

Exact runs: every window of 50 words has an anchor, the smallest of its five-word windows; where an anchor is shared, the
windows are joined by anchor, offset and digest to the first document that has the whole window.

Near ones: seeds are five-word windows, thinned to the smallest hash of every few neighbours. Each seed is joined to its
first occurrence, by document, and so are pairs of seeds some 23 to 38 words apart, so that documents which quote a
part of a passage don't hide one that has it whole. Every occurrence of a seed that a document has in common with one
other is chained in order, with a cost for gaps, by a Fenwick tree of prefix maxima. A chain has two seeds that don't overlap, as
single ones are mostly chance. Texts around a chain are then aligned word by word, and stretches that agree well enough and
are long enough are the passages.

Only one of equal texts takes part. Most seeds occur in one document: a first pass sends bare hashes, many in a row, to
count them, and a Bloom filter of the shared ones, of bounded size, keeps the others from the second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import keep, lowered, mix, other_columns, slices, small, text_arrays, tidy, write_table
from ledgerlens.llm.near_dedup import _POWER, SHINGLE, shingle_hashes, word_hashes

#: Neighbouring windows of which the smallest is a seed; a power of two.
SEED_SPAN = 4
#: Shortest passage in words, and lowest share of its words that agree.
PASSAGE, SIMILARITY = 50, 0.8
#: Words after which an anchor on the diagonal of the one before is kept at the latest; the gain of a seed outweighs them.
STEP = 32
#: Gain of a seed, and loss for each word of a gap on either side, when seeds are chained.
GAIN, LOSS = 16.0, 0.1
#: Distances, in words, at which every other seed, by a bit of its hash, makes a pair with the smallest one there.
PAIRS = ((23, 30), (31, 38))
ODD = np.uint64(1 << 12)
#: Words on either side of a chain that are aligned too.
MARGIN = 64
#: Most bits of the filter of shared hashes (64 MB), and bits for each hash while there are fewer.
FILTER_BITS, FILTER_RATE = 1 << 29, 16
#: Requested stretches of one text that are cut out together.
TOGETHER = 256


def seed_places(hashes: np.ndarray, owner: np.ndarray, size: np.ndarray, least: int) -> np.ndarray:
    """Places of the seeds among the shingles of joined texts; texts of fewer than ``least`` words have none."""
    n = len(hashes)
    if n < SEED_SPAN:
        return np.zeros(0, np.int64)
    low, width = hashes, 1
    while width < SEED_SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    last = np.arange(len(low)) + SEED_SPAN + SHINGLE - 2
    inside = (owner[: len(low)] == owner[last]) & (size[owner[: len(low)]] >= least)
    low = np.where(inside, low, np.uint64(0))
    high = np.concatenate([np.zeros(SEED_SPAN - 1, np.uint64), low, np.zeros(SEED_SPAN - 1, np.uint64)])
    width = 1
    while width < SEED_SPAN:
        high = np.maximum(high[:-width], high[width:])
        width *= 2
    return np.flatnonzero((high[:n] == hashes) & (hashes != 0))


def run_windows(hashes: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, anchor and digest of every window of ``least`` words inside one of the joined texts.

    The anchor is the place of the window's smallest shingle, the first of equal ones. Starts and anchors ascend.
    """
    width, n = least - SHINGLE + 1, len(owner) - least + 1
    if n <= 0 or width <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def lower(places: np.ndarray, by: int) -> np.ndarray:
        one, other = places[: len(places) - by], places[by:]
        return np.where(hashes[other] < hashes[one], other, one)

    anchor, span = np.arange(len(hashes)), 1
    while 2 * span <= width:
        anchor, span = lower(anchor, span), 2 * span
    if span < width:
        anchor = lower(anchor, width - span)
    digest = np.zeros(n, np.uint64)
    for k in [*range(0, least - SHINGLE, SHINGLE), least - SHINGLE]:
        digest = digest * _POWER + hashes[k : k + n]
    starts = np.flatnonzero(owner[:n] == owner[least - 1 :])
    return starts, anchor[starts], (mix(digest[starts]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _thinned_seeds(column: pa.Array, least: int) -> Iterator[tuple]:
    """For slices of texts: first row, shingle hashes, owner of each word, bounds of texts, seed places, and run windows."""
    texts = text_arrays(column)
    for start, end in slices(texts):
        low = [lowered(t) for t in texts.slice(start, end - start).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))])
        words, bounds = word_hashes(b"".join(low), offsets)
        if len(words) < SHINGLE:
            continue
        hashes, size = shingle_hashes(words), np.diff(bounds)
        owner = np.repeat(np.arange(len(size)), size)
        windows = run_windows(hashes, owner, least)
        new = np.flatnonzero(np.diff(windows[1], prepend=-1))
        at = np.union1d(seed_places(hashes, owner, size, least), windows[1][new])
        yield start, hashes, owner, bounds, at, windows, new


def shortened(h: np.ndarray, buckets: int) -> np.ndarray:
    """What the filter knows of a hash: its bucket, and 32 bits of the rest."""
    rest, bucket = np.divmod(h, np.uint64(buckets))
    return bucket + np.uint64(buckets) * (rest & np.uint64(0xFFFFFFFF))


def _shared_hashes(rows: DataFrame, least: int, buckets: int) -> DataFrame:
    """``h``, shortened, of the seeds that more than one document has, and of few others.

    A row of the exchange has the hashes of a bucket in a slice of texts, without what the bucket says; one that several
    texts of the slice have is sent twice at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes, owner, _, at, _, _ in _thinned_seeds(batch.column(0), least):
                h, own = hashes[at], owner[at]
                order = np.lexsort((own, h))
                h, own = h[order], own[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
                h = h[new]
                third = np.zeros(len(h), bool)
                third[2:] = h[2:] == h[:-2]
                h = h[~third]
                rest, bucket = np.divmod(h, np.uint64(buckets))
                order = np.argsort(bucket, kind="stable")
                h, bucket = rest[order].astype(np.uint32).view(np.int32), bucket[order].astype(np.int32)
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(h)).astype(np.int32)), pa.array(h))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), lists], ["bucket", "hs"])

    packed = rows.select("text").mapInArrow(tidy(run), "bucket int, hs array<int>")
    counted = packed.repartition("bucket").select("bucket", F.explode("hs").alias("h")).groupBy("bucket", "h").agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1").select((F.col("bucket") + buckets * F.col("h").cast("long").bitwiseAND(0xFFFFFFFF)).alias("h"))


def _filter(shared: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter of hashes, two for each; set by Spark in pieces of 4 KB, so that the driver only gets these."""
    bits = min(1 << max(15, (shared.count() * FILTER_RATE).bit_length()), FILTER_BITS)
    place = shared.select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 27))).alias("p")).select(F.col("p").bitwiseAND(bits - 1).alias("p"))
    pieces = place.groupBy(F.shiftright("p", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("bits"))
    out = np.zeros(bits // 64, np.uint64)
    for row in pieces.toLocalIterator():
        out[row.piece * 512 : (row.piece + 1) * 512] = np.frombuffer(row.bits, np.uint64)
    return out


def maybe_shared(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for p in (h, h >> np.uint64(27)):
        p = p & np.uint64(64 * len(words) - 1)
        found &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def far_pairs(h: np.ndarray, at: np.ndarray, end: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every other seed and the smallest one ``least`` to ``most`` words after it, before ``end``: number of the seed, of the
    other, and a hash of both with their distance."""
    first = np.searchsorted(at, at + least)
    last = np.searchsorted(at, np.minimum(at + most + 1, end))
    some = np.flatnonzero((first < last) & ((h & ODD) > 0))
    if not len(some):
        return some, some, np.zeros(0, np.uint64)
    order = np.lexsort((at, h))
    rank = np.empty(len(h) + 1, np.int64)  # one more, as a range may end with the last seed
    rank[order], rank[-1] = np.arange(len(h)), len(h)
    other = order[np.minimum.reduceat(rank, np.stack([first[some], last[some]], axis=1).ravel())[::2]]
    return some, other, mix(h[some] * _POWER + mix(h[other] + (at[other] - at[some]).astype(np.uint64)))


def _seeds(rows: DataFrame, least: int, words: np.ndarray, buckets: int) -> DataFrame:
    """``h``, ``key``, ``class``, ``at`` of the seeds and pairs of seeds that may be shared, the digests of the windows that a
    seed anchors, and how many words before it the first of them starts (negative: of a pair, where its other seed is)."""
    kind = rows.schema["key"].dataType.simpleString()
    known = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, hashes, owner, bounds, at, (first, anchor, digest), new in _thinned_seeds(batch.column(2), least):
                held = np.searchsorted(at, anchor[new])
                back, begin, count = (np.zeros(len(at), np.int64) for _ in range(3))
                back[held], begin[held], count[held] = anchor[new] - first[new], new, np.diff(new, append=len(anchor))
                may = maybe_shared(shortened(hashes[at], buckets), known.value)
                pairs = [far_pairs(hashes[at], at, bounds[1:][owner[at]], *distances) for distances in PAIRS]
                one, other, pair = (np.concatenate(x) for x in zip(*pairs))
                both = may[one] & may[other]
                one, pair, seed = one[both], pair[both], np.flatnonzero(may)
                place = np.concatenate([seed, one])
                h = np.concatenate([hashes[at][seed], pair])
                size = np.concatenate([count[seed], np.zeros(len(one), np.int64)])
                ends = np.concatenate([[0], np.cumsum(size)])
                inside = np.arange(ends[-1]) - np.repeat(ends[:-1], size) + np.repeat(begin[place], size)
                rows_ = pa.array(owner[at[place]] + start)
                own = at[place] - bounds[:-1][owner[at[place]]]
                before = np.concatenate([back[seed], at[one] - at[other[both]]])
                columns = [pa.array(h.view(np.int64)), batch.column(0).take(rows_), batch.column(1).take(rows_), pa.array(own.astype(np.int32))]
                columns += [pa.array(before.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(digest[inside]))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "key", "class", "at", "back", "digests"])

    return rows.select("key", "class", "text").mapInArrow(tidy(run), f"h bigint, key {kind}, class bigint, at int, back int, digests array<int>")


def _links(seeds: DataFrame) -> DataFrame:
    """What each occurrence of a seed, and each window it anchors, has in common with the first document that has it.

    ``class``, ``first_class`` and either ``anchor`` (place in the own text and, in the low half, in the other) or
    ``run`` (first and last word after an equal stretch of windows). Seeds are exchanged once, by hash, and read in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, holders = None, (0, 0), {}  # the seed a batch ends in, its first occurrence, who holds its windows
        for batch in batches:
            if not batch.num_rows:
                continue
            h, own, at, back = (batch.column(c).to_numpy().astype(np.int64) for c in ("h", "class", "at", "back"))
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.diff(np.append(starts, len(h)))
            seed = np.repeat(np.arange(len(starts)), size)
            first, first_at = own[starts], at[starts]
            goes_on = now is not None and now == h[0]
            if goes_on:
                first[0], first_at[0] = before
            other, there = first[seed], first_at[seed]
            met = own != other
            pair = met & (back < 0)  # its other seed too
            links = [(own[met], other[met], at[met] << 32 | there[met]), (own[pair], other[pair], at[pair] - back[pair] << 32 | there[pair] - back[pair])]

            offsets, values = batch.column("digests").offsets.to_numpy(), batch.column("digests").values.to_numpy()
            count = np.diff(offsets)
            rows = np.flatnonzero((count > 0) & ((size[seed] > 1) | (seed == 0) | (seed == len(starts) - 1)))
            row = np.repeat(rows, count[rows])
            n = np.arange(len(row)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
            window = (h[row] * 31 + back[row] - n).view(np.uint64)
            window = mix(window * _POWER + values[offsets[row] + n].view(np.uint32))
            known, place, which = np.unique(window, return_index=True, return_inverse=True)
            holder = own[row[place]]
            if goes_on:
                for i in np.flatnonzero(seed[row[place]] == 0).tolist():
                    holder[i] = holders.get(int(known[i]), holder[i])
            if len(starts) > 1 or not goes_on:
                holders = {}
            for i in np.flatnonzero(seed[row[place]] == len(starts) - 1).tolist():
                holders.setdefault(int(known[i]), int(holder[i]))
            now, before = h[-1], (int(first[-1]), int(first_at[-1]))
            holder = holder[which]
            later = holder != own[row]
            row, holder, start = row[later], holder[later], (at[row] - back[row] + n)[later]
            low = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (holder[1:] != holder[:-1]) | (start[1:] != start[:-1] + 1))[: len(row)])
            high = np.append(low[1:], len(row))[: len(low)] - 1
            links.append((own[row[low]], holder[low], start[low] << 32 | start[high]))
            kind = np.repeat([True, True, False], [len(x[0]) for x in links])
            mine, theirs, value = (np.concatenate(x) for x in zip(*links))
            columns = [pa.array(mine), pa.array(theirs), pa.array(value, mask=~kind), pa.array(value, mask=kind)]
            yield pa.RecordBatch.from_arrays(columns, ["class", "first_class", "anchor", "run"])

    ordered = seeds.repartition("h").sortWithinPartitions("h", "key", "class", "at").select("h", "class", "at", "back", "digests")
    return ordered.mapInArrow(tidy(run), "class bigint, first_class bigint, anchor bigint, run bigint")


def _exact(links: DataFrame, least: int) -> DataFrame:
    """``class``, ``first_class``, ``first``, ``last``: words of a class that lie in runs the other class has before it."""
    starts = links.where("run is not null").groupBy("class", "first_class").agg(F.sort_array(F.collect_set("run")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for own, other, runs in zip(*(c.to_pylist() for c in batch.columns)):
                first = last = None
                for x in runs:
                    low, high = x >> 32, x & 0xFFFFFFFF
                    if first is not None and low <= last + 1:
                        last = max(last, high)
                        continue
                    if first is not None:
                        out.append((own, other, first, last + least))
                    first, last = low, high
                out.append((own, other, first, last + least))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["class", "first_class", "first", "last"])

    return starts.mapInArrow(tidy(run), "class bigint, first_class bigint, first int, last int")


def thinned(here: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors without those that say nothing new, sorted.

    Where one place of the other text recurs within fewer words than a seed has (runs of a short period), one anchor in
    PASSAGE words stays. Of unbroken anchors on one diagonal the first, the last and one in STEP words stay.
    """
    for by, gap, step, ends in ((there, SHINGLE, PASSAGE, False), (None, STEP, STEP, True)):
        group = here - there if by is None else by
        order = np.lexsort((here, group))
        here, there, group = here[order], there[order], group[order]
        new = np.ones(len(here), bool)
        new[1:] = (group[1:] != group[:-1]) | (np.diff(here) >= gap)
        part = (here - here[np.maximum.accumulate(np.where(new, np.arange(len(here)), 0))]) // step
        stays = new.copy()
        stays[1:] |= part[1:] != part[:-1]
        if ends:
            stays |= np.append(new[1:], True)
        here, there = here[stays], there[stays]
    order = np.lexsort((there, here))
    return here[order], there[order]


def chain(here: np.ndarray, there: np.ndarray) -> list[list[int]]:
    """Chains of anchors that ascend in both texts, best first; each anchor is in one chain at most.

    The score of an anchor is its gain and the best score before it less the loss for the gap on both sides. The best
    is a prefix maximum over places in the other text, kept in a Fenwick tree, as anchors come in order of the own one.
    """
    order = np.lexsort((there, here)).tolist()
    b, a = here.tolist(), there.tolist()
    rank = {x: i + 1 for i, x in enumerate(sorted(set(a)))}
    n = len(rank)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (n + 1)
    score, before = [0.0] * len(a), [-1] * len(a)
    i = 0
    while i < len(order):
        same = i
        while same < len(order) and b[order[same]] == b[order[i]]:
            same += 1
        for k in order[i:same]:
            best, r = (-1e18, -1), rank[a[k]] - 1
            while r > 0:
                best = max(best, tree[r])
                r &= r - 1
            reached = best[0] - LOSS * (a[k] + b[k])
            score[k], before[k] = (GAIN + reached, best[1]) if reached > 0 else (GAIN, -1)
        for k in order[i:same]:  # anchors of one place don't follow each other
            entry, r = (score[k] + LOSS * (a[k] + b[k]), k), rank[a[k]]
            while r <= n:
                if entry > tree[r]:
                    tree[r] = entry
                r += r & -r
        i = same
    used, out = [False] * len(a), []
    for k in sorted(range(len(a)), key=lambda k: (-score[k], k)):
        links = []
        while k >= 0 and not used[k]:
            used[k] = True
            links.append(k)
            k = before[k]
        if links:
            out.append(links[::-1])
    return out


def _apart(places: np.ndarray) -> bool:
    """Whether two seeds at these places do not overlap."""
    return int(places.max() - places.min()) >= SHINGLE


def _chains(pairs: DataFrame) -> DataFrame:
    """Chains of each pair of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for own, other, anchors in zip(*(batch.column(i).to_pylist() for i in range(3))):
                packed = np.array(anchors, np.int64)
                if not _apart(packed >> 32):
                    continue
                here, there = thinned(packed >> 32, packed & 0xFFFFFFFF)
                out += [(own, other, here[links].tolist(), there[links].tolist()) for links in chain(here, there) if _apart(here[links])]
            if out:
                own, other, b, a = zip(*out)
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(other), pa.array(b, ints), pa.array(a, ints)], ["class", "first_class", "b", "a"])

    return pairs.mapInArrow(tidy(run), "class bigint, first_class bigint, b array<int>, a array<int>")


def _cuts(wanted: DataFrame) -> DataFrame:
    """Cut requested stretches of words out of texts: chain, side, raw text from the first to the last word (not of
    side 2), where it starts and ends in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = (batch.column(0)[i].as_py() or "").encode()
                starts, ends = word_edges(raw)
                out = []
                for x in batch.column(1)[i].as_py():
                    first, last = max(0, x["first"]), min(len(starts), x["last"]) - 1
                    if first <= last:
                        base, stop = int(starts[first]), int(ends[last])
                        out.append((x["chain"], x["side"], first, base, stop, raw[base:stop].decode() if x["side"] < 2 else ""))
                if out:
                    names = ["chain", "side", "first", "base", "stop", "cut"]
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return wanted.mapInArrow(tidy(run), "chain bigint, side int, first int, base bigint, stop bigint, cut string")


def word_edges(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of a text start and end."""
    codes = np.frombuffer(raw, np.uint8)
    solid = np.concatenate([[False], ~((codes == 32) | ((codes >= 9) & (codes <= 13))), [False]])
    change = np.flatnonzero(solid[1:] != solid[:-1])
    return change[::2], change[1::2]


def align(b: np.ndarray, a: np.ndarray, at_b: np.ndarray, at_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of an alignment along a chain: place in ``b`` (-1: a word of ``a`` only) and whether the words agree.

    Between two anchors on one diagonal words are paired; where the diagonal changes, it changes once, at the place that
    leaves most pairs equal. Beyond the ends the outer diagonals go on to the end of either text.
    """
    places: list[np.ndarray] = []
    equal: list[np.ndarray] = []

    def pair(first: int, last: int, shift: int) -> None:
        if last > first:
            at = np.arange(first, last)
            places.append(at)
            equal.append(b[first:last] == a[first + shift : last + shift])

    def lone(count_b: range, count_a: int) -> None:
        places.append(np.concatenate([np.arange(count_b.start, count_b.stop), np.full(count_a, -1)]))
        equal.append(np.zeros(len(count_b) + count_a, bool))

    shift = int(at_a[0] - at_b[0])
    pair(max(0, -shift), int(at_b[0]), shift)
    for k in range(len(at_b) - 1):
        b0, b1, a1 = int(at_b[k]), int(at_b[k + 1]), int(at_a[k + 1])
        new = a1 - b1
        if new == shift:
            pair(b0, b1, shift)
            continue
        # up to x words on the old diagonal, the rest on the new one
        room = min(b1 - b0, a1 - (b0 + shift))
        x_old = np.concatenate([[0], np.cumsum(b[b0 : b0 + room] == a[b0 + shift : b0 + shift + room])])
        tail = np.concatenate([[0], np.cumsum((b[b1 - room : b1] == a[a1 - room : a1])[::-1])])[::-1]
        x = int(np.argmax(x_old + tail))
        pair(b0, b0 + x, shift)
        rest = room - x
        lone(range(b0 + x, b1 - rest), (a1 - rest) - (b0 + shift + x))
        pair(b1 - rest, b1, new)
        shift = new
    last = int(at_b[-1])
    pair(last, min(len(b), len(a) - shift), shift)
    return np.concatenate(places), np.concatenate(equal)


def passages(places: np.ndarray, equal: np.ndarray, least: int = PASSAGE, similarity: float = SIMILARITY) -> list[tuple[int, int, float]]:
    """Stretches of an alignment, as (first place, last place, share of equal columns), that are long and alike enough.

    A column gains what makes ``similarity`` break even, so that a stretch is alike enough if its sum is not negative. Of
    those with ``least`` own words that of the highest sum comes first, then what lies on either side of it; no other
    such stretch lies beside the ones found.
    """
    gain = np.where(equal, 1 - similarity, -similarity)
    own = np.concatenate([[0], np.cumsum(places >= 0)])
    sums = np.concatenate([[0.0], np.cumsum(gain)])
    out, todo = [], [(0, len(gain))]
    while todo:
        low, high = todo.pop()
        if own[high] - own[low] < least:
            continue
        # for each end the last start that is far enough before it, and the lowest sum up to there
        ends = np.arange(int(np.searchsorted(own, own[low] + least)), high + 1)
        starts = np.searchsorted(own, own[ends] - least, side="right") - 1
        rise = sums[ends] - np.minimum.accumulate(sums[low : high + 1])[starts - low]
        best = int(np.argmax(rise))
        if rise[best] < -1e-9:
            continue
        end = int(ends[best])
        start = low + int(np.argmin(sums[low : starts[best] + 1]))
        found = places[start:end]
        found = found[found >= 0]
        out.append((int(found[0]), int(found[-1]), float(equal[start:end].mean())))
        todo += [(low, start), (end, high)]
    return out


def _aligned(rows: DataFrame, least: int, similarity: float) -> DataFrame:
    def hashes(text: str) -> np.ndarray:
        low = lowered(text)
        return word_hashes(low, np.array([0, len(low)]))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for own, other, at_b, at_a, first_b, base, text_b, first_a, text_a in zip(*(c.to_pylist() for c in batch.columns)):
                b, a = hashes(text_b), hashes(text_a)
                columns = align(b, a, np.array(at_b) - first_b, np.array(at_a) - first_a)
                found = passages(*columns, least, similarity)
                if found:
                    starts, ends = word_edges(text_b.encode())
                    out += [(own, other, base + int(starts[x]), base + int(ends[y]), y - x + 1, s) for x, y, s in found]
            if out:
                names = ["class", "first_class", "start_byte", "end_byte", "n_words", "similarity"]
                kinds = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(tidy(run), "class bigint, first_class bigint, start_byte bigint, end_byte bigint, n_words bigint, similarity double")


def shared_passages(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = PASSAGE, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each passage of a document that an earlier one (by ``key``) has too.

    Columns: ``key``, ``row`` (fingerprint of key and text), ``first_<key>`` (a document that has it before),
    ``start_byte`` and ``end_byte`` (in the text's UTF-8, from the first to the last word), ``n_words``, ``similarity``.
    Passages have at least ``least`` words, of which ``similarity`` agree, A-Z lower-cased. All
    words in a run of ``least`` that an earlier document has are in some row; overlapping runs of one earlier document are
    joined. Near passages are found where they share a seed, or a pair of seeds, with the document that has it first. A document found to share
    passages with several earlier ones has rows for each, which may overlap. Of documents with equal texts all but the
    first have one row that covers the whole text, if it is long enough; only the first is compared with others. Null
    and shorter texts, and rows with a null key, have no row; rows equal in key and text count as one document.
    """
    rows = df.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{key}`").alias("key"), F.xxhash64(f"`{key}`", f"`{text}`").alias("row"), F.xxhash64(f"`{text}`").alias("class"), F.col(f"`{text}`").alias("text")
    )
    classes = keep(rows.groupBy("class").agg(F.min(F.struct("key", "row")).alias("first"), F.count(F.lit(1)).alias("n")).select("class", "first.*", "n"))
    again = keep(classes.where("n > 1").drop("n"))
    unique = rows.join(small(again.select("class", F.col("row").alias("first_row"))), "class", "left").where(F.col("first_row").isNull() | (F.col("first_row") == F.col("row")))
    buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = _filter(keep(_shared_hashes(unique, least, buckets)))
    links = write_table(_links(_seeds(unique, least, words, buckets)), "links")
    runs = keep(_exact(links, least).withColumn("chain", F.xxhash64("class", "first_class", "first", "last")))
    pairs = links.where("anchor is not null").groupBy("class", "first_class").agg(F.collect_set("anchor").alias("anchors"))
    chains = keep(_chains(pairs).withColumn("chain", F.xxhash64("class", "first_class", "b", "a")))

    def request(side: int, name: str, at: str):
        first, last = F.col(at)[0] - MARGIN, F.element_at(at, -1) + SHINGLE + MARGIN
        return chains.select(F.col(name).alias("class"), "chain", F.lit(side).alias("side"), first.alias("first"), last.alias("last"))

    requests = request(0, "class", "b").union(request(1, "first_class", "a"))
    requests = requests.union(runs.select("class", "chain", F.lit(2).alias("side"), "first", "last"))
    # requests for one text are dealt into parts only where there are many; such texts are few, at most a TOGETHER-th
    often = keep(requests.groupBy("class").count().where(F.col("count") > TOGETHER))
    part = F.pmod(F.xxhash64("chain"), F.ceil(F.col("count") / TOGETHER))
    dealt = requests.join(small(often), "class", "left").withColumn("part", F.coalesce(part, F.lit(0)))
    wanted = dealt.groupBy("class", "part").agg(F.collect_list(F.struct("chain", "side", "first", "last")).alias("wanted"))
    wanted = keep(wanted.join(classes.select("class", "row"), "class").select("row", "wanted"))
    # rows of one fingerprint have one text
    cuts = keep(_cuts(unique.select("row", "text").join(wanted, "row").select("text", "wanted")).dropDuplicates(["chain", "side"]))
    left = cuts.where("side = 0").select("chain", F.col("first").alias("first_b"), "base", F.col("cut").alias("text_b"))
    right = cuts.where("side = 1").select("chain", F.col("first").alias("first_a"), F.col("cut").alias("text_a"))
    both = chains.join(left, "chain").join(right, "chain").select("class", "first_class", "b", "a", "first_b", "base", "text_b", "first_a", "text_a")
    alike = _aligned(both, least, similarity)
    places = cuts.where("side = 2").select("chain", F.col("base").alias("start_byte"), F.col("stop").alias("end_byte"))
    size = (F.col("last") - F.col("first")).cast("long").alias("n_words")
    equal = runs.join(places, "chain").select("class", "first_class", "start_byte", "end_byte", size, F.lit(1.0).alias("similarity"))
    found = alike.union(equal)
    owner = classes.select("class", "key", "row")
    earlier = classes.select(F.col("class").alias("first_class"), F.col("key").alias("first_key"))
    partial = found.join(owner, "class").join(earlier, "first_class").select(
        "key", "row", "first_key", "start_byte", "end_byte", "n_words", "similarity"
    )
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    copies = rows.join(small(again.select("class", F.col("key").alias("first_key"))), "class").where("key > first_key")  # words of copies only are counted
    copies = copies.select("key", "row", "first_key", F.octet_length("text").cast("long").alias("end_byte"), size.alias("n_words")).where(F.col("n_words") >= least).select(
        "key", "row", "first_key", F.lit(0).cast("long").alias("start_byte"), "end_byte", "n_words", F.lit(1.0).alias("similarity")
    )
    return partial.union(copies).distinct().withColumnsRenamed({"key": key, "first_key": f"first_{key}"})


def remove_passages(df: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the passages of ``found`` (its rows as of :func:`shared_passages`) taken out of the texts.

    Stretches may overlap. Where one is taken out, the white space after it goes too. Texts without a passage, nulls
    included, stay as they are; columns keep their order.
    """
    spans = keep(found.groupBy("row").agg(F.collect_set(F.struct("start_byte", "end_byte")).alias("__spans")).withColumnRenamed("row", "__row"))
    rest = other_columns(df, [text])
    marked = df.withColumn("__row", F.xxhash64(f"`{key}`", f"`{text}`")).join(spans, "__row", "left")
    inner = marked.select(*rest, F.col(f"`{text}`").alias("__text"), "__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 2)
            spans = batch.column(batch.num_columns - 1)
            out = [t.as_py() if not s.is_valid else without(t.as_py(), s.as_py()) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.string())], [*batch.schema.names[:-2], text])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-2])
    return inner.mapInArrow(tidy(run), f"{fields}, `{text}` string").select(*[f"`{c}`" for c in df.columns])


def without(text: str, spans: list[dict]) -> str:
    """A text without stretches of bytes, which start and end at words."""
    raw, out, at = text.encode(), [], 0
    for x in sorted(spans, key=lambda x: x["start_byte"]):
        if x["start_byte"] > at:
            out.append(raw[at : x["start_byte"]])
        if x["end_byte"] > at:
            at = x["end_byte"]
            while at < len(raw) and raw[at] in b" \t\n\r\x0b\x0c":
                at += 1
    return b"".join([*out, raw[at:]]).decode()
