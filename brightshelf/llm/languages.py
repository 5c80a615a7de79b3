"""Language identification by hyperdimensional profiles.

Every letter has a random vector of -1 and 1. A trigram is the product of its letters' vectors, each
rotated by its place; a text is the sum of its trigrams' vectors, and so is a language's prototype.
Texts are compared with prototypes by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brightshelf.llm.frames import TEXT, bounded, scan_text

WIDTH = 1024
UNKNOWN = "und"
SCALE = 1_000_000


class Trigrams:
    """Trigram vectors of a task, drawn per letter from a fixed seed."""

    def __init__(self, width: int = WIDTH, seed: int = 7):
        self.width, self.seed = width, seed
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            self.letters[point] = np.random.default_rng([self.seed, point]).integers(0, 2, self.width).astype(np.float32) * 2 - 1
        return self.letters[point]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones((len(grams), self.width), np.float32)
        for place in range(3):
            points, which = np.unique((grams >> np.int64(21 * (2 - place))) & 0x1FFFFF, return_inverse=True)
            out *= np.stack([np.roll(self.letter(int(p)), 2 - place) for p in points])[which.reshape(-1)]
        return out

    def bundles(self, texts: list[bytes | None]) -> np.ndarray:
        """One row per text; zero where it has no letter."""
        out = np.zeros((len(texts), self.width), np.float32)
        found = [trigram_counts(t) for t in texts]
        sizes = [len(g) for g, _ in found]
        if not sum(sizes):
            return out
        grams, column = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
        column = column.reshape(-1)
        weights = np.concatenate([c for _, c in found]).astype(np.float32)
        row = np.repeat(np.arange(len(texts)), sizes)
        # Trigrams come in blocks, so the dense count table stays small.
        order = np.argsort(column, kind="stable")
        column, weights, row = column[order], weights[order], row[order]
        for a in range(0, len(grams), 4096):
            lo, hi = np.searchsorted(column, [a, a + 4096])
            counts = np.zeros((len(texts), min(4096, len(grams) - a)), np.float32)
            counts[row[lo:hi], column[lo:hi] - a] = weights[lo:hi]
            out += counts @ self.vectors(grams[a : a + 4096])
        return out


def trigram_counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams of a text (three code points in one number) and their counts.

    Letters are lower-cased; a run of other characters counts as one space.
    """
    empty = np.zeros(0, np.int64)
    if not text:
        return empty, empty
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    kinds, which = np.unique(points, return_inverse=True)
    letter = np.array([chr(p).isalpha() if not 0xD800 <= p < 0xE000 else False for p in kinds])[which.reshape(-1)]
    if not letter.any():
        return empty, empty
    points = np.r_[32, np.where(letter, points, 32), 32]
    points = points[np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]]
    grams = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    return np.unique(grams, return_counts=True)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def learn_prototypes(df: DataFrame, text: str = "text", lang: str = "lang", width: int = WIDTH) -> dict[str, np.ndarray]:
    """Prototype per language: the sum of its texts' bundles of length one, in fixed-point numbers.

    Rows with null text or language, or without a letter, teach nothing. The driver gets one vector
    per language.
    """
    source = df.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).cast("string").cast("binary").alias(TEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams, sums = Trigrams(width), {}
        for batch in batches:
            for part in bounded(batch):
                rows = np.rint(_unit(trigrams.bundles(part.column(TEXT).to_pylist())) * SCALE).astype(np.int64)
                names = np.array(part.column("lang").to_pylist(), object)
                for name in set(names):
                    sums[name] = sums.get(name, 0) + rows[names == name].sum(axis=0)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * width), pa.array(np.arange(width)), pa.array(total)], names=["lang", "at", "v"])

    parts = source.mapInArrow(run, "lang string, at bigint, v bigint")
    rows = parts.groupBy("lang", "at").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("v")).collect()
    learned = {r["lang"]: np.array(r["v"], np.float64) for r in rows}
    return {name: v / np.linalg.norm(v) for name, v in sorted(learned.items()) if np.any(v)}


def identify(df: DataFrame, keep: list[str], prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """`keep`, lang_pred and score (cosine, not under 0) of every row.

    Null texts, texts without a letter, and all texts where nothing was learned are `und` with
    score 0. Ties go to the first name.
    """
    names = list(prototypes)
    table = np.stack(list(prototypes.values())) if names else np.zeros((0, WIDTH))
    trigrams: list[Trigrams] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not trigrams:
            trigrams.append(Trigrams(table.shape[1]))
        rows = trigrams[0].bundles(batch.column(TEXT).to_pylist())
        if not names:
            return {"lang_pred": [UNKNOWN] * len(rows), "score": [0.0] * len(rows)}
        cosine = _unit(rows) @ table.T
        best = cosine.argmax(axis=1)
        known = rows.any(axis=1)
        return {
            "lang_pred": [names[b] if k else UNKNOWN for b, k in zip(best, known)],
            "score": np.where(known, np.clip(cosine[np.arange(len(rows)), best], 0, 1), 0.0),
        }

    return scan_text(df, keep, text, run, "lang_pred string, score double")
