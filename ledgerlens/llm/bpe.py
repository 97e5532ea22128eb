"""Byte-level BPE: encoding and decoding.

Boundaries of the pieces that merges never cross come from a finite automaton over classes of characters. Each
character is a transition function between the automaton's states; functions compose associatively, so all states of
a slice of text come from a block-wise prefix scan over function numbers, without a regular expression and without a
loop over characters. Merges of a piece follow the ranks and are cached.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import SLICE_BYTES, other_columns, slices, text_arrays, tidy, utf8

# The characters with Unicode's White_Space property.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What may follow an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

#: Classes of a character. JOIN: a space before a non-space; LONE: other white space before a non-space; SPACE: white
#: space before white space or the end; TWO, THREE: an apostrophe before a contraction of so many characters.
LETTER, NUMBER, OTHER, SPACE, JOIN, LONE, TWO, THREE = range(8)
#: States after a character: nothing open, in a run of a kind, after a joining space, one or two letters of a
#: contraction still to come.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, JOINED, ONE_LEFT, TWO_LEFT = range(8)
BLOCK = 256
CACHED_PIECES = 100_000
#: Longest piece merged together with others; longer ones take a heap.
SHORT = 64
#: Rows decoded at once.
DECODED_ROWS = 256
NO_RANK = (1 << 63) - 1


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this character."""
    if kind == LETTER:
        if state == TWO_LEFT:
            return ONE_LEFT, False
        if state == ONE_LEFT:
            return CLOSED, False
        return IN_LETTERS, state not in (IN_LETTERS, JOINED)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, JOINED)
    if kind in (OTHER, TWO, THREE):
        if state in (IN_OTHER, JOINED):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, TWO: ONE_LEFT, THREE: TWO_LEFT}[kind], True
    if kind == SPACE:
        return IN_SPACE, state != IN_SPACE
    return (JOINED if kind == JOIN else CLOSED), True


class Automaton:
    """The functions generated by the classes (and, plus 8, by a text's first character), numbered, with their products."""

    def __init__(self) -> None:
        steps = [tuple(_step(s, k)[0] for s in range(8)) for k in range(8)]
        generators = steps + [(f[CLOSED],) * 8 for f in steps]
        found = {tuple(range(8)): 0}
        todo = list(found)
        while todo:
            f = todo.pop()
            for g in generators:
                h = tuple(g[s] for s in f)
                if h not in found:
                    found[h] = len(found)
                    todo.append(h)
        self.functions = np.array(list(found), np.uint8)
        self.of_class = np.array([found[g] for g in generators], np.uint8)
        self.product = np.array([[found[tuple(g[s] for s in f)] for g in found] for f in found], np.uint8)
        starts = np.array([[_step(s, k)[1] for s in range(8)] for k in range(8)])
        self.starts = np.vstack([starts, np.ones((8, 8), bool)])

    def piece_starts(self, symbols: np.ndarray) -> np.ndarray:
        """For symbols (class, plus 8 at a text's first character): where pieces start."""
        n = len(symbols)
        if not n:
            return np.zeros(0, bool)
        blocks = -(-n // BLOCK)
        padded = np.zeros(blocks * BLOCK, np.uint8)
        padded[:n] = symbols
        elements = self.of_class[padded.reshape(blocks, BLOCK).T]
        for i in range(1, BLOCK):
            elements[i] = self.product[elements[i - 1], elements[i]]
        before = np.concatenate([[0], elements[-1][:-1]]).astype(np.uint8)
        shift = 1
        while shift < blocks:
            before[shift:] = self.product[before[:-shift].copy(), before[shift:]]
            shift *= 2
        entry = self.functions[before, CLOSED]
        states = self.functions[elements, entry[None, :]].T.reshape(-1)[:n]
        previous = np.concatenate([[CLOSED], states[:-1]])
        return self.starts[symbols, previous]


@lru_cache(1)
def automaton() -> Automaton:
    return Automaton()


@lru_cache(1)
def character_kinds() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    category = unicodedata.category
    kinds = {"L": LETTER, "N": NUMBER}
    for point in range(0x110000):
        kind = kinds.get(category(chr(point))[0])
        if kind is not None:
            table[point] = kind
    table[WHITE_SPACE] = SPACE
    return table


def symbols_of(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``first`` has the positions where a text begins."""
    n = len(points)
    kinds = character_kinds()[points]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins[n] = True
    blank = kinds == SPACE
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = ~blank[1:]
    solid_next &= ~begins[1:]
    symbols = kinds.copy()
    symbols[blank & solid_next] = LONE
    symbols[(points == 32) & solid_next] = JOIN
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        ahead = np.concatenate([points, [0, 0]])
        inside_1 = ~begins[quotes + 1]
        inside_2 = inside_1 & ~begins[np.minimum(quotes + 2, n)]
        for ending in CONTRACTIONS:
            if len(ending) == 1:
                symbols[quotes[inside_1 & (ahead[quotes + 1] == ord(ending))]] = TWO
            else:
                symbols[quotes[inside_2 & (ahead[quotes + 1] == ord(ending[0])) & (ahead[quotes + 2] == ord(ending[1]))]] = THREE
    symbols[first[first < n]] += 8
    return symbols


class Pairs:
    """Rank of the token that two neighbouring tokens form: an open-addressing table in arrays, probed for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        left = np.array(keys, np.uint64)
        ranked = np.array(values, np.int64)
        self.bits = max(4, int(4 * len(left)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(NO_RANK), np.uint64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int64)
        at = self._slot(left)
        while len(left):
            free = self.keys[at] == np.uint64(NO_RANK)
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.values[at[first]] = left[first], ranked[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, ranked, at = left[rest], ranked[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = self._slot(keys)
        found = self.values[at]
        open_ = np.flatnonzero((self.keys[at] != keys) & (found != NO_RANK))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found[open_] = self.values[at[open_]]
            open_ = open_[(self.keys[at[open_]] != keys[open_]) & (found[open_] != NO_RANK)]
        return found


class Merges(dict):
    """From a piece to its token ids, by rank; found ones are kept until :meth:`trim`."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.pairs = ranks, Pairs(ranks)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def learn(self, pieces: list[bytes]) -> None:
        """Keep the ids of all the pieces."""
        new = [p for p in set(pieces) if p not in self]
        rest = []
        for p in new:
            if (whole := self.ranks.get(p)) is not None:
                self[p] = (whole,)
            elif len(p) > SHORT:
                self[p] = merge_long(p, self.ranks)
            else:
                rest.append(p)
        if rest:
            self.update(zip(rest, merge_many(rest, self)))

    def trim(self) -> None:
        if len(self) > CACHED_PIECES:
            self.clear()


def merge_many(pieces: list[bytes], merges: Merges) -> list[tuple[int, ...]]:
    """In every round each piece joins its neighbours of the lowest rank, the leftmost first, until no pair has a rank."""
    n = len(pieces)
    owner = np.repeat(np.arange(n), np.fromiter(map(len, pieces), np.int64, n))
    ids = merges.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
    ranks = np.full(len(ids), NO_RANK, np.int64)
    same = np.flatnonzero(owner[1:] == owner[:-1])
    ranks[same] = merges.pairs.rank(ids[same], ids[same + 1])
    done_ids, done_owner = [], []
    while len(ids):
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        sizes = np.diff(np.append(starts, len(ids)))
        low = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
        over = low == NO_RANK
        if over.any():
            done_ids.append(ids[over])
            done_owner.append(owner[over])
            ids, owner, ranks, low = ids[~over], owner[~over], ranks[~over], low[~over]
            if not len(ids):
                break
        at = np.flatnonzero(ranks == low)
        at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
        ids[at] = ranks[at]
        stay = np.ones(len(ids), bool)
        stay[at + 1] = False
        at = at - np.arange(len(at))  # one token before each of them goes
        ids, owner, ranks = ids[stay], owner[stay], ranks[stay]
        for left in (at, at[at > 0] - 1):
            ranks[left] = NO_RANK
            left = left[left < len(ids) - 1]
            left = left[owner[left] == owner[left + 1]]
            ranks[left] = merges.pairs.rank(ids[left], ids[left + 1])
    all_owner = np.concatenate(done_owner)
    order = np.argsort(all_owner, kind="stable")
    flat = np.concatenate(done_ids)[order].tolist()
    ends = np.cumsum(np.bincount(all_owner, minlength=n)).tolist()
    return [tuple(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends)]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same for one long piece, by a heap of neighbours: n log n in its length."""
    n = len(piece)
    ends = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    waiting = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, i, end = heapq.heappop(waiting)
        if not alive[i] or ends[i] >= n:
            continue
        j = ends[i]
        if ends[j] != end:
            continue
        ends[i], alive[j] = end, False
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : ends[end]])) is not None:
                heapq.heappush(waiting, (r, i, ends[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heapq.heappush(waiting, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return tuple(out)


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a file of lines ``base64 rank``."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}


@lru_cache(2)
def encoder(content: bytes) -> tuple[Merges, np.ndarray]:
    """Merges and token lengths of a vocabulary file; a worker process keeps those of the last files."""
    ranks = read_ranks(content)
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return Merges(ranks), lengths


def encode_slice(data: bytes, offsets: np.ndarray, merges: Merges, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids, their byte ends in ``data`` and the number of tokens of each text."""
    raw = np.frombuffer(data, np.uint8)
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    first = np.unique(np.searchsorted(at, offsets[:-1]))
    found = at[np.append(np.flatnonzero(automaton().piece_starts(symbols_of(points, first))), len(points))].tolist()
    pieces = [data[a:b] for a, b in zip(found, found[1:])]
    merges.learn(pieces)
    ids = np.fromiter(chain.from_iterable(map(merges.__getitem__, pieces)), np.int32)
    ends = np.cumsum(lengths[ids], dtype=np.int64)
    return ids, ends, np.diff(np.searchsorted(ends, offsets, side="right"))


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def decoded_slice(ids: np.ndarray, stops: np.ndarray, counts: np.ndarray, merges: Merges) -> pa.Array:
    """The bytes that the ids of each text stand for."""
    joined = b"".join(map(merges.tokens.__getitem__, ids.tolist()))
    offsets = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(joined)])


def encode(
    df: DataFrame, path: str, text: str = "text", ids: str = "ids", ends: str | None = None, decoded: str | None = None, drop: bool = False
) -> DataFrame:
    """Add the token ids of every whole text, each piece encoded by itself, without special tokens.

    ``path`` is a file of base64 tokens and ranks that has all 256 bytes. A null or empty text has an empty list. With
    ``ends`` the byte offset (in the text's UTF-8) at which each token ends is added too, with ``decoded`` the bytes that
    the ids decode to, as :func:`decode` has them but in the same pass. Columns of these names are replaced, others stay;
    with ``drop`` the text does not stay. The file is read on the driver and sent to the
    executors: a vocabulary, whose size does not depend on the data.
    """
    with open(path, "rb") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())
    added = [c for c in (ids, ends, decoded) if c]
    inner = df.select(*other_columns(df, [*added, text]), F.col(f"`{text}`"))
    names = inner.columns[:-1] if drop else inner.columns
    place = len(inner.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, lengths = encoder(vocabulary.value)
        for batch in batches:
            texts = text_arrays(batch.column(place))
            for start, end in slices(texts, SLICE_BYTES):
                data, offsets = utf8(texts, start, end)
                found, stops, counts = encode_slice(data, offsets, merges, lengths)
                columns = [batch.column(i).slice(start, end - start) for i in range(len(names))] + [_lists(counts, found)]
                if ends:
                    columns.append(_lists(counts, stops - np.repeat(offsets[:-1], counts)))
                if decoded:
                    columns.append(decoded_slice(found, stops, counts, merges))
                yield pa.RecordBatch.from_arrays(columns, [*names, *added])
                merges.trim()

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[: len(names)]]
    kinds = [f"`{c}` {'binary' if c == decoded else 'array<int>'}" for c in added]
    return inner.mapInArrow(tidy(run), ", ".join(kept + kinds))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that token ids stand for (binary: ids may end inside a character). Null ids give null; an id that
    is not in the vocabulary fails the task."""
    with open(path, "rb") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())
    inner = df.select(*other_columns(df, [out]))
    place = inner.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in read_ranks(vocabulary.value).items()}
        for batch in batches:
            for start in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(start, DECODED_ROWS)
                decoded = [None if x is None else b"".join(map(tokens.__getitem__, x)) for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], [*part.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields)
    return inner.mapInArrow(tidy(run), f"{fields}, `{out}` binary")
