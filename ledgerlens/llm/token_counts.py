"""Token counts of whole texts, also of huge ones, by overlapping chunks that resynchronise."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import other_columns, slices, text_arrays, tidy

#: Characters of a chunk, and by how many a chunk runs into the next one at first.
CHUNK, OVERLAP = 20_000, 200
#: A space and the character that stands for it in the vocabulary.
SPACES = " ▁"


class Counter:
    """Counts tokens of a sentencepiece model, without begin and end tokens."""

    def __init__(self, model: bytes, chunk: int = CHUNK, overlap: int = OVERLAP):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        #: A merge never crosses from a non-space to a space, as no piece of the vocabulary has a space inside.
        self.spaces_open_pieces = not any("▁" in p.lstrip("▁") for p in pieces)

    def many(self, texts: list[str]) -> list[int]:
        counts = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk + self.overlap]
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1)):
            counts[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > self.chunk + self.overlap:
                counts[i] = self.huge(t)
        return counts

    def _starts(self, text: str, start: int) -> np.ndarray:
        """Offsets, in the whole text, at which tokens of a chunk start."""
        begins = np.array([p.begin for p in self.model.encode(text, return_type="proto").pieces], np.int64)  # in bytes
        characters = np.flatnonzero((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        return np.searchsorted(characters, begins, side="right") - 1 + start

    def _common(self, text: str, left: np.ndarray, right: np.ndarray, low: int, high: int) -> int:
        """A boundary inside the overlap [low, high) at which both token sequences may be cut, or -1.

        It must be a token start of both chunks and proven stable: a space after a non-space, which no merge of either
        chunk, nor of the whole text, can cross. What follows it is then encoded alike by the whole text.
        """
        both = np.intersect1d(left[(left > low) & (left < high)], right[(right > low) & (right < high)])
        for at in both.tolist():
            if text[at] in SPACES and text[at - 1] not in SPACES:
                return at
        return -1

    def huge(self, text: str) -> int:
        """Count chunk by chunk; a chunk is spliced to the next at a common boundary.

        Without one, the overlap doubles until it has swallowed the next chunk's text up to a boundary or the end.
        """
        if not self.spaces_open_pieces:
            return len(self.model.encode(text))
        total, cut, start = 0, 0, 0
        while True:
            overlap = self.overlap
            while True:
                end = min(start + self.chunk + overlap, len(text))
                left = self._starts(text[start:end], start)
                if end == len(text):
                    return total + int((left >= cut).sum() if start else len(left))
                low = end - overlap
                right = self._starts(text[low : min(end + overlap, len(text))], low)
                at = self._common(text, left, right, low, end)
                if at >= 0:
                    break
                overlap *= 2
            total += int(((left >= cut) & (left < at)).sum() if start else (left < at).sum())
            # the next chunk begins before the boundary, so that the boundary is inside it and not at its edge
            start, cut = low, at


@lru_cache(2)
def counter(model: bytes, chunk: int, overlap: int) -> Counter:
    return Counter(model, chunk, overlap)


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Add the number of tokens of every whole text under the sentencepiece model at ``path``.

    Null and empty texts have 0. A text longer than a chunk and an overlap is encoded in overlapping chunks, so that
    no call grows with the text unless it has no space to cut at. A column of that name is replaced. The model is read
    on the driver and sent to the executors; its size does not depend on the data.
    """
    with open(path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())
    inner = df.select(*other_columns(df, [out]), F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model.value, chunk, overlap)
        for batch in batches:
            texts = text_arrays(batch.column(batch.num_columns - 1))
            found: list[int] = []
            for start, end in slices(texts):
                found += count.many(texts.slice(start, end - start).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], [*batch.schema.names[:-1], out])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema.fields[:-1])
    return inner.mapInArrow(tidy(run), f"{kept}, `{out}` bigint" if kept else f"`{out}` bigint")
