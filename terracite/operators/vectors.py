"""An index of vectors for nearest-neighbour search: inverted lists of product-quantised residuals, ranked again exactly."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracite.session import cut

#: Rows, and bytes, of the sample that lists and codebooks are fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20
#: Codes of a list, and queries of a list, that one task compares.
LIST_ROWS, LIST_QUERIES = 200_000, 1_000
#: Dimensions that one byte of a code stands for.
WIDTH = 4


def _clusters(points: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centres of k groups of points (fewer where there are fewer points), by Lloyd's rounds from points spread over the sample."""
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points @ centres.T - (centres * centres).sum(1) / 2).argmax(1)


@dataclass(frozen=True)
class Codebook:
    """Centres of the lists, and for every WIDTH dimensions of what is left of a vector 256 values."""

    lists: np.ndarray
    values: np.ndarray  # parts, 256, WIDTH

    @property
    def dims(self) -> int:
        return self.lists.shape[1]

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of unit vectors."""
        of = _nearest(vectors, self.lists)
        left = self._parts(vectors - self.lists[of])
        return of, np.stack([_nearest(left[:, p], self.values[p]) for p in range(left.shape[1])], axis=1).astype(np.uint8)

    def scores(self, queries: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """About the cosines of unit queries with the vectors of one list, from their codes."""
        table = np.einsum("qpw,pvw->pqv", self._parts(queries), self.values)
        out = np.repeat((queries @ self.lists[of])[:, None], len(codes), axis=1)
        for p in range(codes.shape[1]):
            out += table[p][:, codes[:, p]]
        return out

    @staticmethod
    def _parts(vectors: np.ndarray) -> np.ndarray:
        padded = np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % WIDTH)))
        return padded.reshape(len(padded), -1, WIDTH)


def fit(sample: np.ndarray, lists: int, seed: int = 7) -> Codebook:
    """The codebook of a sample of unit vectors."""
    centres = _clusters(sample, lists, seed)
    left = Codebook._parts(sample - centres[_nearest(sample, centres)])
    return Codebook(centres, np.stack([_filled(_clusters(left[:, p], 256, seed + p)) for p in range(left.shape[1])]))


def _filled(values: np.ndarray) -> np.ndarray:
    return values[np.arange(256) % len(values)]


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _unit(df: DataFrame, name: str) -> DataFrame:
    """name and unit vector u; vectors that are null, hold nulls or have no length are left out."""
    plain = df.select(F.col(name), F.transform("embedding", lambda x: x.cast("double")).alias("v")).withColumn("n", _norm(F.col("v"))).where("n > 0 and n < double('infinity')")
    return plain.select(name, F.transform("v", lambda x: x / F.col("n")).alias("u"))


class Index:
    """Every vector of a table (id, embedding) in the list of its nearest centre, as a code of a byte for every four dimensions.

    Lists and codebooks are fitted on the SAMPLE_ROWS rows, or SAMPLE_BYTES, of least hash; every row is then coded. Rows of another number
    of dimensions than the first of the sample, null ones and those without a length are not in the index. ``codes`` (id, list, code) may be
    written and read again.
    """

    def __init__(self, vectors: DataFrame, lists: int | None = None, seed: int = 7) -> None:
        self.vectors = _unit(vectors.select("id", "embedding"), "id")
        first = self.vectors.select(F.size("u").alias("d")).first()
        dims = first["d"] if first else 1
        self.vectors = self.vectors.where(F.size("u") == dims)
        rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))
        taken = self.vectors.orderBy(F.xxhash64("id"), "id").limit(rows).select("u").toPandas()["u"]
        sample = np.stack(taken.tolist()) if len(taken) else np.zeros((1, dims))
        self.book = fit(sample, lists or max(1, min(1024, int(len(sample) ** 0.5) // 3)), seed)
        book = self.book

        def code(frames):
            for f in frames:
                if len(f):
                    of, codes = book.encode(np.stack(f["u"].tolist()))
                    yield pd.DataFrame({"id": f["id"], "list": of, "code": [c.tobytes() for c in codes]})

        kind = self.vectors.schema["id"].dataType.simpleString()
        self.codes = cut(self.vectors.mapInPandas(code, f"id {kind}, list int, code binary"))

    def candidates(self, queries: DataFrame, keep: int, probe: float = 0.75) -> DataFrame:
        """For each query (query_id, embedding) the ``keep`` ids that, by their codes, are most like it in its nearest lists, a share of ``probe`` of all.

        A list's codes and its queries are dealt out to tasks of bounded size, and each task keeps its own best. Returns query_id, id, about.
        """
        book, most = self.book, max(1, round(probe * len(self.book.lists)))

        def probes(frames):
            for f in frames:
                if len(f):
                    order = np.argsort(-(np.stack(f["u"].tolist()) @ book.lists.T), axis=1)[:, :most]
                    yield pd.DataFrame({"query_id": np.repeat(f["query_id"].to_numpy(), most), "u": [u for u in f["u"] for _ in range(most)], "list": order.ravel()})

        asked = _unit(queries.select("query_id", "embedding"), "query_id").where(F.size("u") == book.dims)
        kind, name = asked.schema["query_id"].dataType.simpleString(), self.codes.schema["id"].dataType.simpleString()
        asked = cut(asked.mapInPandas(probes, f"query_id {kind}, u array<double>, list int"))
        rows = self.codes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).cast("int").alias("parts"))
        blocks = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_QUERIES).cast("int").alias("blocks"))
        cells = F.broadcast(rows.join(blocks, "list"))  # a row for each list, 1,024 at most unless asked for
        spread = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        held = self.codes.join(cells, "list").withColumn("part", spread("id", "parts")).withColumn("block", every("blocks")).select("list", "part", "block", "id", "code")
        sought = asked.join(cells, "list").withColumn("block", spread("query_id", "blocks")).withColumn("part", every("parts")).select("list", "part", "block", "query_id", "u")

        def best(codes: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            if not len(codes) or not len(some):
                return pd.DataFrame({"query_id": [], "id": [], "about": []})
            raw = np.frombuffer(b"".join(codes["code"]), dtype=np.uint8).reshape(len(codes), -1)
            ids, out = codes["id"].to_numpy(), []
            questions, units = some["query_id"].to_numpy(), np.stack(some["u"].tolist())
            for low in range(0, len(units), 32):
                about = book.scores(units[low : low + 32], int(codes["list"].iloc[0]), raw)
                top = np.argpartition(-about, min(keep, len(ids)) - 1, axis=1)[:, :keep]
                out.append(pd.DataFrame({"query_id": np.repeat(questions[low : low + 32], top.shape[1]), "id": ids[top.ravel()], "about": np.take_along_axis(about, top, 1).ravel()}))
            return pd.concat(out)

        keys = ["list", "part", "block"]
        near = held.groupBy(*keys).cogroup(sought.groupBy(*keys)).applyInPandas(best, f"query_id {kind}, id {name}, about double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("about"), "id"))
        return near.withColumn("r", place).where(F.col("r") <= keep).drop("r")

    def search(self, queries: DataFrame, k: int = 10, refine: int = 15, probe: float = 0.75) -> DataFrame:
        """The k nearest of each query by cosine among its ``k * refine`` candidates, whose own vectors are compared. Returns query_id, rank, id, similarity."""
        pairs = self.candidates(queries, k * refine, probe).join(self.vectors, "id").join(_unit(queries.select("query_id", "embedding"), "query_id").withColumnRenamed("u", "q"), "query_id")
        dot = F.aggregate(F.zip_with("u", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        scored = pairs.select("query_id", "id", F.round(dot, 6).alias("similarity"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
        return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")
