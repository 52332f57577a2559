"""Quantizers, clusterings and linear transforms, fitted in numpy on a bounded sample and applied in Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(rows: DataFrame, most: int = 65_536, seed: int = 1) -> np.ndarray:
    """At most about ``most`` vectors, chosen by a hash of the id and in order of it."""
    n = rows.count()
    if n > most:
        rows = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    return np.asarray([r.v for r in rows.select("id", "v").orderBy("id").collect()], float)


def assign(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, ties to the lower."""
    half = (centroids**2).sum(1) / 2
    parts = [(half - x[i : i + 4096] @ centroids.T).argmin(1) for i in range(0, len(x), 4096)]
    return np.concatenate(parts) if parts else np.zeros(0, int)


def kmeans(
    x: np.ndarray, k: int, *, rounds: int = 25, tries: int = 1, most_per_centroid: int = 256, tolerance: float = 1e-6, spherical: bool = False, seed: int = 1234
) -> np.ndarray:
    """k-means++ and Lloyd rounds; an empty cluster takes part of the largest; fewer rows than k are repeated."""
    rng = np.random.default_rng(seed)
    if len(x) < k:
        return np.resize(x, (k, x.shape[1])).astype(float)
    if len(x) > k * most_per_centroid:
        x = x[rng.choice(len(x), k * most_per_centroid, replace=False)]
    best, best_cost = None, np.inf
    for _ in range(tries):
        centroids = _spread(x, k, rng)
        last = np.inf
        for _ in range(rounds):
            cell = assign(x, centroids)
            sums, n = np.zeros_like(centroids), np.bincount(cell, minlength=k)
            np.add.at(sums, cell, x)
            centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
            for empty in np.flatnonzero(n == 0):
                big = int(n.argmax())
                centroids[empty] = centroids[big] * (1 + 1e-3 * rng.standard_normal(x.shape[1]))
                n[empty], n[big] = n[big] // 2, n[big] - n[big] // 2
            if spherical:
                centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
            cost = ((x - centroids[assign(x, centroids)]) ** 2).sum()
            if last - cost <= tolerance * max(cost, 1e-12):
                break
            last = cost
        if cost < best_cost:
            best, best_cost = centroids, cost
    return best


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    chosen = [int(rng.integers(len(x)))]
    far = ((x - x[chosen[0]]) ** 2).sum(1)
    for _ in range(k - 1):
        total = far.sum()
        pick = int(rng.choice(len(x), p=far / total)) if total > 0 else int(rng.integers(len(x)))
        chosen.append(pick)
        far = np.minimum(far, ((x - x[pick]) ** 2).sum(1))
    return x[chosen].astype(float).copy()


def minibatch_kmeans(x: np.ndarray, k: int, *, batch: int = 1024, rounds: int = 100, seed: int = 1234) -> np.ndarray:
    """Centroids that move by their share of each small batch."""
    rng = np.random.default_rng(seed)
    centroids, seen = _spread(x[rng.choice(len(x), min(len(x), 16 * k), replace=False)], min(k, len(x)), rng), np.zeros(min(k, len(x)))
    for _ in range(rounds):
        part = x[rng.choice(len(x), min(batch, len(x)), replace=False)]
        cell = assign(part, centroids)
        n = np.bincount(cell, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, part)
        seen += n
        step = np.divide(n, seen, out=np.zeros_like(seen), where=seen > 0)[:, None]
        centroids = centroids * (1 - step) + step * np.divide(sums, np.maximum(n, 1)[:, None])
    return centroids


@dataclass
class ProductQuantizer:
    """A codebook for each of m slices of the components."""

    m: int = 8
    bits: int = 8
    books: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, seed: int = 1234) -> ProductQuantizer:
        if x.shape[1] % self.m:
            raise ValueError(f"{x.shape[1]} components can't be cut into {self.m} slices")
        self.books = [kmeans(s, 1 << self.bits, seed=seed + i) for i, s in enumerate(np.split(x, self.m, axis=1))]
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([assign(s, b) for s, b in zip(np.split(x, self.m, axis=1), self.books, strict=True)], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.hstack([b[codes[:, i]] for i, b in enumerate(self.books)])

    def table(self, q: np.ndarray) -> np.ndarray:
        return np.stack([((b - s) ** 2).sum(1) for s, b in zip(np.split(q, self.m), self.books, strict=True)])

    def distances(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.table(q)[np.arange(self.m), codes].sum(1)


@dataclass
class ScalarQuantizer:
    """Components by themselves: ``fp16``, ``sq8u`` (one range for all), ``sq8`` or ``sq4`` (a range for each)."""

    kind: str = "sq8"
    low: np.ndarray | None = None
    step: np.ndarray | None = None

    @property
    def levels(self) -> int:
        return 15 if self.kind == "sq4" else 255

    def fit(self, x: np.ndarray) -> ScalarQuantizer:
        low, high = (x.min(), x.max()) if self.kind == "sq8u" else (x.min(0), x.max(0))
        self.low, self.step = np.broadcast_to(low, x.shape[1]), np.broadcast_to((high - low) / self.levels, x.shape[1])
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "fp16":
            return x.astype(np.float16)
        scaled = np.divide(x - self.low, self.step, out=np.zeros_like(x), where=self.step > 0)
        return np.clip(np.rint(scaled), 0, self.levels).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return codes.astype(float) if self.kind == "fp16" else self.low + codes * self.step


def scalar_ranges(rows: DataFrame) -> DataFrame:
    """(dim, low, high) of every component over all rows, as one aggregation."""
    flat = rows.select(F.posexplode("v").alias("dim", "x"))
    return flat.groupBy("dim").agg(F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"))


@dataclass
class AdditiveQuantizer:
    """Sums of one codeword from each of several full-length codebooks.

    ``residual``: each book is fitted to what the ones before leave, and codes
    are found by a beam. Otherwise books are improved together by least squares,
    and codes by changing one place at a time.
    """

    m: int = 4
    bits: int = 6
    beam: int = 5
    residual: bool = True
    rounds: int = 4
    books: np.ndarray | None = None

    def fit(self, x: np.ndarray, seed: int = 1234) -> AdditiveQuantizer:
        rest, books = x.copy(), []
        for i in range(self.m):
            books.append(kmeans(rest, 1 << self.bits, seed=seed + i))
            rest = rest - books[-1][assign(rest, books[-1])]
        self.books = np.stack(books)
        for _ in range(0 if self.residual else self.rounds):
            codes = self.encode(x)
            hot = np.zeros((len(x), self.m << self.bits))
            hot[np.arange(len(x))[:, None], codes + (np.arange(self.m) << self.bits)] = 1
            gram = hot.T @ hot + 1e-3 * np.eye(hot.shape[1])
            self.books = np.linalg.solve(gram, hot.T @ x + 1e-3 * self.books.reshape(-1, x.shape[1])).reshape(self.books.shape)
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of all rows, some hundred rows at a time, so memory is bounded by beam and codewords."""
        return np.concatenate([self._encode(x[i : i + 512]) for i in range(0, len(x), 512)]) if len(x) else np.zeros((0, self.m), int)

    def _encode(self, x: np.ndarray) -> np.ndarray:
        codes, rest = np.zeros((len(x), 1, 0), int), x[:, None, :]
        for book in self.books:  # a beam of the best partial sums
            cost = (rest**2).sum(-1)[:, :, None] - 2 * rest @ book.T + (book**2).sum(1)
            flat = cost.reshape(len(x), -1)
            keep = np.argsort(flat, axis=1, kind="stable")[:, : self.beam]
            parent, code = keep // len(book), keep % len(book)
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), code[:, :, None]], 2)
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[code]
        codes = codes[:, 0]
        for _ in range(0 if self.residual else self.rounds):
            for i, book in enumerate(self.books):
                other = self.decode(codes) - book[codes[:, i]]
                codes[:, i] = assign(x - other, book)
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(b[codes[:, i]] for i, b in enumerate(self.books))

    def distances(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances by tables of inner products, and the norms of the sums."""
        products = self.books @ q
        return (q**2).sum() - 2 * products[np.arange(self.m), codes].sum(1) + (self.decode(codes) ** 2).sum(1)


@dataclass
class Linear:
    """x -> (x - mean) A, and back by the transpose or pseudo-inverse."""

    matrix: np.ndarray
    mean: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.matrix

    def reverse(self, y: np.ndarray) -> np.ndarray:
        return y @ np.linalg.pinv(self.matrix) + self.mean


def pca(x: np.ndarray, size: int, power: float = 0.0) -> Linear:
    """Principal components; a power of -0.5 whitens."""
    mean = x.mean(0)
    values, vectors = np.linalg.eigh(np.cov((x - mean).T, bias=True))
    order = np.argsort(values)[::-1][:size]
    scale = np.maximum(values[order], 1e-12) ** power if power else 1.0
    return Linear(vectors[:, order] * scale, mean)


def distributed_pca(rows: DataFrame, size: int, power: float = 0.0) -> Linear:
    """Principal components of all rows: partitions add up their moments, whose size depends on the components only."""
    import pyarrow as pa

    def run(batches):
        n, total, square = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                n, total, square = n + len(x), total + x.sum(0), square + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()]), pa.array([square.tobytes()])], ["n", "s", "q"])

    parts = rows.select("v").mapInArrow(run, "n long, s binary, q binary").coalesce(16).collect()
    n = sum(p.n for p in parts)
    mean = sum(np.frombuffer(p.s) for p in parts) / n
    cov = sum(np.frombuffer(p.q) for p in parts).reshape(len(mean), -1) / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:size]
    scale = np.maximum(values[order], 1e-12) ** power if power else 1.0
    return Linear(vectors[:, order] * scale, mean)


def random_rotation(size: int, out: int | None = None, seed: int = 1234) -> Linear:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return Linear((q * np.sign(np.diag(r)))[:, : out or size], np.zeros(size))


def opq(x: np.ndarray, m: int, *, bits: int = 8, rounds: int = 8, seed: int = 1234) -> tuple[Linear, ProductQuantizer]:
    """A rotation and a product quantizer, improved in turn: codes for the rotation, then the rotation for the codes."""
    rotation = random_rotation(x.shape[1], seed=seed).matrix
    for _ in range(rounds):
        turned = x @ rotation
        pq = ProductQuantizer(m, bits).fit(turned, seed)
        u, _, v = np.linalg.svd(x.T @ pq.decode(pq.encode(turned)))
        rotation = u @ v
    return Linear(rotation, np.zeros(x.shape[1])), ProductQuantizer(m, bits).fit(x @ rotation, seed)


def transformed(rows: DataFrame, apply) -> DataFrame:
    """(id, v) with a function of matrices applied to all vectors, batch by batch."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 1))
            y = apply(x) if n else x
            ends = pa.array(np.arange(0, y.size + 1, max(1, y.shape[1]), dtype=np.int32) if n else np.zeros(1, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(y.ravel().astype(float)))], ["id", "v"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>")
