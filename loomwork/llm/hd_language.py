"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is bound as the
product of its letters' vectors, rotated by place; a document bundles (sums) the
vectors of its trigrams, a language those of its training documents. A document
gets the language whose prototype has the largest cosine with its bundle.

Training sums per language and partition are vectors of fixed length, so what
reaches the driver depends on the number of languages only.

Defined results: ``und`` with score 0 for a null text, a text without a letter,
or when nothing was learnt; ties go to the first language by code point; rows
with a null id are predicted, and learnt from only if the caller's training
rows hold them; an empty table gives no rows; input columns stay, and those
named lang_pred or score are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.tokens import slices

_LETTER: np.ndarray | None = None
#: Characters handled at once; longer texts are bundled window by window.
_WINDOW = 1 << 20


def _letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def trigrams(body: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams of a whole text, with white space for all else, and their counts."""
    if not body:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_letter, parts, tail = _letters(), [], np.full(1, 32, np.int64)
    for at in range(0, len(body), _WINDOW):
        data = np.frombuffer(body[at : at + _WINDOW].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        data = np.where(is_letter[data], data, 32)
        data = np.concatenate([tail, data] + ([np.full(1, 32)] if at + _WINDOW >= len(body) else []))
        keep = np.ones(len(data), bool)
        keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
        data = data[keep]
        if len(data) > 2:
            codes = data[:-2] << 42 | data[1:-1] << 21 | data[2:]
            parts.append(np.unique(codes, return_counts=True))
        tail = data[-2:]
    return merged(parts)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their counts over all parts."""
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)


class Vectors:
    """Bound trigram vectors, made when first met; at most ``kept`` stay."""

    def __init__(self, size: int, seed: int, kept: int = 12_000):
        self.size, self.seed, self.kept = size, seed, kept
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.table = np.zeros((kept, size), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.size)
            self.letters[code] = (2 * bits - 1).astype(np.float32)
        return self.letters[code]

    def bound(self, code: int) -> np.ndarray:
        a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors by count."""
        total = np.zeros(self.size)
        for at in range(0, len(codes), 4096):
            part, place = codes[at : at + 4096].tolist(), self.place
            new = [c for c in part if c not in place]
            if len(place) + len(new) > self.kept:
                place.clear()
                new = part
            for c in new:
                self.table[len(place)] = self.bound(c)
                place[c] = len(place)
            rows = np.fromiter(map(place.__getitem__, part), np.int64, len(part))
            total += counts[at : at + 4096].astype(np.float32) @ self.table[rows]
        return total


_VECTORS: dict[tuple[int, int], Vectors] = {}


def vectors(size: int, seed: int) -> Vectors:
    """This worker's vectors; kept between tasks."""
    if (size, seed) not in _VECTORS:
        _VECTORS[size, seed] = Vectors(size, seed)
    return _VECTORS[size, seed]


def learn(rows: DataFrame, *, size: int = 1024, seed: int = 5) -> tuple[list[str], np.ndarray]:
    """Languages by code point, and one unit prototype each, from columns text and lang (nulls are skipped)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, sums, held = vectors(size, seed), {}, Counter()
        for batch in (x for b in batches for x in slices(b)):
            for body, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = trigrams(body)
                if len(found[0]):
                    sums.setdefault(lang, []).append(found)
                    held[lang] += len(found[0])
                    if held[lang] > 1_000_000:
                        sums[lang] = [merged(sums[lang])]
                        held[lang] = len(sums[lang][0][0])
                        if held[lang] > 500_000:
                            yield from out({lang: sums.pop(lang)}, own, pa)
                            held[lang] = 0
        yield from out(sums, own, pa)

    def out(sums, own, pa):
        for lang, held in sums.items():
            codes, counts = merged(held)
            total = np.zeros(size, np.int64)
            for at in range(0, len(codes), 4096):  # whole numbers, so the sum doesn't depend on its order
                part = np.stack([own.bound(c) for c in codes[at : at + 4096].tolist()])
                total += counts[at : at + 4096] @ part.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["lang", "i", "v"])

    parts = rows.select("text", "lang").filter("text is not null and lang is not null").mapInArrow(run, "lang string, i int, v long")
    sums = parts.groupBy("lang", "i").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x")).select("lang", "x.v")
    found = sorted(((r.lang, np.asarray(r.v, float)) for r in sums.collect()), key=lambda x: x[0].encode("utf-8", "surrogatepass"))
    found = [(lang, v / np.linalg.norm(v)) for lang, v in found if v.any()]
    return [x[0] for x in found], np.stack([x[1] for x in found]) if found else np.zeros((0, size))


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray, *, seed: int = 5) -> DataFrame:
    """The input rows with lang_pred and score, the cosine where it is above 0."""
    size = prototypes.shape[1]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = vectors(size, seed)
        for batch in (x for b in batches for x in slices(b)):
            names, scores = [], []
            for body in batch.column("text").to_pylist():
                codes, counts = trigrams(body)
                total = own.bundle(codes, counts) if len(codes) and languages else np.zeros(size)
                norm = np.linalg.norm(total)
                cosines = prototypes @ total / norm if norm else np.zeros(0)
                best = int(cosines.argmax()) if len(cosines) else -1
                names.append(languages[best] if best >= 0 else "und")
                scores.append(float(np.clip(cosines[best], 0, 1)) if best >= 0 else 0.0)
            yield batch.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(scores, pa.float64()))

    plain = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields]).add("lang_pred", "string").add("score", "double"))
