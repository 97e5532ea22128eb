"""Language identification by interpolated Kneser-Ney character models, one a language.

Characters are lower-cased letters and marks; whatever lies between them is one space. The n-grams of all languages
stand in one sorted hash array an order, with the log probability and the weight of the shorter history under each
language beside them, so that one binary search serves all languages. A text gets the language of the lowest
cross-entropy per character; texts that fit no language as well as its own held-back texts do are rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import mix, other_columns, slices, text_arrays, tidy, utf8

if TYPE_CHECKING:
    import pandas as pd

ORDER = 4
#: Expected number of documents a language is learned from at most; a tenth of them calibrates the rejection.
SAMPLE_DOCUMENTS = 1500
#: Cross-entropy counts as evidence for so many characters at most: characters of a text are not independent.
EVIDENCE = 40
#: Shorter texts are never rejected for their fit.
REJECT_FROM = 100
UNKNOWN = "und"
#: Bytes of text scored at once; a longer document is scored alone.
SLICE = 1 << 18
STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _folded() -> np.ndarray:
    """Every code point's lower-case letter (its first character), or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if unicodedata.category(c)[0] in "LM":
            table[point] = ord(c.lower()[0])
    return table


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(p))[0] == "L" for p in range(0x110000)])


def characters(data: bytes, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of joined texts, each after order - 1 spaces and before one; their first places; who has a letter.

    The places are where each text's padding starts, and the end of all.
    """
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    bounds = np.searchsorted(at, offsets)
    folded = _folded()[points]
    lettered = np.concatenate([[0], np.cumsum(_letters()[points])])
    has = lettered[bounds[1:]] > lettered[bounds[:-1]]
    blank = folded == 32
    stay = ~blank
    stay[1:] |= ~blank[:-1]  # the first of each run of spaces
    first = bounds[:-1][bounds[:-1] < len(points)]
    stay[first] = ~blank[first]
    kept = np.concatenate([[0], np.cumsum(stay)])[bounds]
    pads = np.arange(len(kept)) * order
    out = np.full(kept[-1] + pads[-1], 32, np.uint64)
    owner = np.repeat(np.arange(len(kept) - 1), np.diff(kept))
    out[np.arange(kept[-1]) + owner * order + order - 1] = folded[stay]
    return out, kept + pads, has


def gram_hashes(chars: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place from n - 1 on."""
    h = np.full(len(chars) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * STEP + chars[k : len(chars) - n + 1 + k]
    return mix(h)


def _places(bounds: np.ndarray, order: int) -> np.ndarray:
    """The predicted places: all characters of a text and the space after it."""
    size = np.diff(bounds) - order + 1
    start = np.repeat(bounds[:-1] + order - 1, size)
    return start + np.arange(len(start)) - np.repeat(np.cumsum(size) - size, size)


def count_grams(df: DataFrame, text: str, lang: str, order: int) -> DataFrame:
    """Counts of the n-grams of each language with hashes of their history and of their last n - 1 characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in pc.unique(batch.column(0)).to_pylist():
                texts = text_arrays(batch.column(1).filter(pc.equal(batch.column(0), name)))
                for start, end in slices(texts, SLICE):
                    chars, bounds, _ = characters(*utf8(texts, start, end), order)
                    at = _places(bounds, order)
                    for n in range(1, order + 1):
                        h = gram_hashes(chars, n)[at - n + 1]
                        keys, first, counts = np.unique(h, return_index=True, return_counts=True)
                        end_at = at[first]
                        history = gram_hashes(chars, n - 1)[end_at - n + 1] if n > 1 else np.zeros(len(keys), np.uint64)
                        tail = gram_hashes(chars, n - 1)[end_at - n + 2] if n > 1 else np.zeros(len(keys), np.uint64)
                        arrays = [pa.array([name] * len(keys)), pa.array(np.full(len(keys), n, np.int32))]
                        arrays += [pa.array(x.view(np.int64)) for x in (keys, history, tail)] + [pa.array(counts)]
                        yield pa.RecordBatch.from_arrays(arrays, ["lang", "n", "gram", "history", "tail", "count"])

    rows = df.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).mapInArrow(
        run, "lang string, n int, gram bigint, history bigint, tail bigint, count bigint"
    )
    return rows.groupBy("lang", "n", "gram", "history", "tail").agg(F.sum("count").alias("count"))


@dataclass
class Model:
    order: int
    languages: list[str]
    keys: list[np.ndarray]  # of order n at n - 1, sorted
    logs: list[np.ndarray]  # log probability of an n-gram's last character under each language
    weights: list[np.ndarray]  # log weight of the shorter history after these n characters
    floor: float
    limits: np.ndarray  # highest cross-entropy that is not rejected, a language

    def _find(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[n - 1]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return at, keys[at] == hashes

    def score(self, chars: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probabilities of the characters at some places, a column a language; an unseen n-gram backs off."""
        return self._score(chars, at, self.order)

    def _score(self, chars: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        hashes = _hash_at(chars, at, n)
        where, hit = self._find(n, hashes)
        out = self.logs[n - 1][where]
        missed = np.flatnonzero(~hit)
        if len(missed):
            if n == 1:
                out[missed] = self.floor
            else:
                where, known = self._find(n - 1, _hash_at(chars, at[missed] - 1, n - 1))
                out[missed] = np.where(known[:, None], self.weights[n - 2][where], 0) + self._score(chars, at[missed], n - 1)
        return out


def _hash_at(chars: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = h * STEP + chars[at - n + 1 + k]
    return mix(h)


def _model(counts: pd.DataFrame, order: int) -> Model:
    """Interpolated Kneser-Ney: raw counts at the highest order, numbers of different predecessors below it."""
    languages = sorted(counts.lang.unique())
    keys, logs, weights = [], [], []
    alphabet = max(2, counts[counts.n == 1].gram.nunique())
    floor = np.log(1.0 / (2 * alphabet))
    for n in range(1, order + 1):
        own = counts[counts.n == n]
        grams = own.drop_duplicates("gram").assign(k=lambda x: x.gram.to_numpy().view(np.uint64)).sort_values("k")
        k = grams.k.to_numpy()
        table = np.full((len(k), len(languages)), floor, np.float32)
        weight = np.zeros((len(k), len(languages)), np.float32)
        for j, lang in enumerate(languages):
            mine = own[own.lang == lang]
            if n < order:
                longer = counts[(counts.n == n + 1) & (counts.lang == lang)]
                known = longer.groupby("tail").size()
                mine = mine.assign(count=mine.gram.map(known).fillna(0))
                mine = mine[mine["count"] > 0]
            ones, twos = (mine["count"] == 1).sum(), (mine["count"] == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            after = mine.groupby("history")["count"].agg(["sum", "size"])
            share = (discount * after["size"] / after["sum"]).to_dict()
            total = after["sum"].to_dict()
            histories = grams["history"].to_numpy()
            seen = grams.gram.map(dict(zip(mine.gram, mine["count"]))).fillna(0).to_numpy()
            totals = np.array([total.get(h, 0) for h in histories], float)
            shares = np.array([share.get(h, 1.0) for h in histories])
            if n == 1:
                lower = np.full(len(k), 1.0 / alphabet)
            else:
                tails = np.searchsorted(keys[-1], grams["tail"].to_numpy().view(np.uint64))
                lower = np.exp(logs[-1][np.minimum(tails, len(keys[-1]) - 1), j].astype(float))
                spots = np.searchsorted(keys[-1], after.index.to_numpy().view(np.uint64))
                weights[-1][np.minimum(spots, len(keys[-1]) - 1), j] = np.log([share[h] for h in after.index])
            with np.errstate(divide="ignore", invalid="ignore"):
                direct = np.where(totals > 0, np.maximum(seen - discount * (seen > 0), 0) / totals, 0)
            table[:, j] = np.log(np.maximum(direct + shares * lower, np.exp(floor) * 1e-3))
        keys.append(k)
        logs.append(table)
        weights.append(weight)
    return Model(order, languages, keys, logs, weights, float(floor), np.full(len(languages), np.inf))


def _unit(*columns: str) -> Column:
    """A seeded number in [0, 1) from a row's columns."""
    return F.pmod(F.xxhash64(F.lit(11), *columns), F.lit(1 << 30)) / float(1 << 30)


def fit(df: DataFrame, key: list[str], text: str = "text", lang: str = "lang", order: int = ORDER, documents: int = SAMPLE_DOCUMENTS) -> Model | None:
    """A model from labelled texts; null texts and languages are left out. None if nothing is left.

    Each language is learned from a seeded sample of about ``documents`` whole texts (all, if it has fewer), chosen by
    hashes of ``key`` and the text: so the model's size does not depend on the table's. Counts are added up on the
    executors; the driver gets one row a language and different n-gram of the sample. Nine tenths of the sample give
    the counts, the rest the limit of rejection: four times as far from the median cross-entropy as the 99th percentile.
    """
    rows = df.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # one row a language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, documents / v))])
    drawn = rows.withColumn("__unit", _unit(*key, text)).where(F.col("__unit") < share[F.col(f"`{lang}`")])
    held_back = F.pmod(F.xxhash64(F.lit(5), *key, text), F.lit(10)) == 0
    counts = count_grams(drawn.where(~held_back), text, lang, order).toPandas()
    if not len(counts):
        counts = count_grams(drawn, text, lang, order).toPandas()
    model = _model(counts, order)
    scored = predict(drawn.where(held_back).select(text, lang), model, text)
    marks = scored.where((F.col("lang_pred") == F.col(f"`{lang}`")) & (F.col("n_letters") >= REJECT_FROM)).groupBy(lang)
    for name, half, most in marks.agg(F.percentile_approx("cross_entropy", 0.5), F.percentile_approx("cross_entropy", 0.99)).collect():
        model.limits[model.languages.index(name)] = half + 4 * max(most - half, 0.15)
    return model


ADDED = ["lang_pred", "score", "cross_entropy", "n_letters", "rejected"]


def predict(df: DataFrame, model: Model | None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Add language, score, cross-entropy (nats a character), scored characters and rejection of every whole text.

    A null text, or one without any letter, is ``und`` with score 0 and rejected; so is every text without a model.
    The score is the language's share of the likelihoods, as far as ``EVIDENCE`` characters go. Ties go to the first
    language by name. Columns of these names are replaced, others stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rest = other_columns(df, [*ADDED, text])
    inner, place = df.select(*rest, F.col(f"`{text}`")), len(rest)
    passed = place + keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = text_arrays(batch.column(place))
            names = [*batch.schema.names[:passed], *ADDED]
            for start, end in slices(texts, SLICE):
                before = [c.slice(start, end - start) for c in batch.columns[:passed]]
                yield pa.RecordBatch.from_arrays(before + judge(model, *utf8(texts, start, end)), names)

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:passed]]
    return inner.mapInArrow(tidy(run), ", ".join([*kept, "lang_pred string, score double, cross_entropy double, n_letters bigint, rejected boolean"]))


def judge(model: Model | None, data: bytes, offsets: np.ndarray) -> list[pa.Array]:
    n = len(offsets) - 1
    pred, score, entropy = np.full(n, UNKNOWN, object), np.zeros(n), np.full(n, np.nan)
    size, rejected = np.zeros(n, np.int64), np.ones(n, bool)
    if model is not None:
        chars, bounds, has = characters(data, offsets, model.order)
        at = _places(bounds, model.order)
        size = np.diff(bounds) - model.order + 1
        sums = np.add.reduceat(model.score(chars, at), np.cumsum(size) - size, axis=0, dtype=np.float64)
        means = -sums / size[:, None]
        best = means.argmin(axis=1)
        lowest = means[np.arange(n), best]
        odds = np.exp((lowest[:, None] - means) * np.minimum(size, EVIDENCE)[:, None]).sum(axis=1)
        pred = np.where(has, np.array(model.languages, object)[best], UNKNOWN)
        score = np.where(has, 1 / odds, 0.0)
        entropy = np.where(has, lowest, np.nan)
        rejected = ~has | ((size >= REJECT_FROM) & (lowest > model.limits[best]))
    return [pa.array(pred, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(size), pa.array(rejected)]
