"""Language identification: the family first, then pairwise linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracite.llm import features
from terracite.session import pick

WIDTH = 4096
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, family string"
#: Families of languages by ISO 639-1 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indo_aryan": "bn gu hi mr ne pa si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "celtic": "br cy ga gd",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


def vectors(texts: list[str | None]) -> np.ndarray:
    """Unit vectors of the texts' hashed letter trigrams, damped by the square root."""
    raw, owner = features.joined(texts, lower=True)
    raw = features.LETTERS[raw]
    keep = np.concatenate(([True], (raw[1:] != 32) | (raw[:-1] != 32) | (owner[1:] != owner[:-1])))
    return features.unit(np.sqrt(features.trigrams(raw[keep], owner[keep], len(texts), WIDTH)))


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 30, seed: int = 0) -> np.ndarray:
    """Weights, the last a bias, of a linear support vector machine, by dual coordinate descent. y: -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    size, alpha, w, order = (x * x).sum(1), np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] + (1 - y[i] * (x[i] @ w)) / size[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class Model:
    """Family machines, each against the rest, and for every family one machine for each pair of its languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family_of(v) for v in self.langs})
        lang, family = np.array(langs), np.array([family_of(v) for v in langs])
        self.rest = np.array([svm(x, np.where(family == f, 1.0, -1.0)) for f in self.families]) if len(self.families) > 1 else None
        self.members = {f: [v for v in self.langs if family_of(v) == f] for f in self.families}
        self.pairs = {}
        for f, names in self.members.items():
            for a, b in combinations(names, 2):
                of = (lang == a) | (lang == b)
                self.pairs[f, a, b] = svm(x[of], np.where(lang[of] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray, list[str]]:
        """Language, score and family of each vector. Ties in votes go to the larger sum of margins, then by name."""
        x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
        sure = lambda m: 1 / (1 + np.exp(-3 * np.clip(m, -10, 10)))
        if self.rest is None:
            best, score = np.zeros(len(x), dtype=int), np.ones(len(x))
        else:
            margins = x @ self.rest.T
            best = margins.argmax(1)
            score = sure(margins.max(1))
        lang = np.array([self.members[self.families[b]][0] for b in best], dtype=object)
        for k, f in enumerate(self.families):
            rows, names = np.flatnonzero(best == k), self.members[f]
            if len(names) < 2 or not len(rows):
                continue
            votes, margin, certain = (np.zeros((len(rows), len(names))) for _ in range(3))
            for (a, b), w in (((a, b), w) for (g, a, b), w in self.pairs.items() if g == f):
                m = x[rows] @ w
                for name, s in ((a, m), (b, -m)):
                    j = names.index(name)
                    votes[:, j] += s > 0
                    margin[:, j] += s
                    certain[:, j] += sure(s)
            won = (votes + 1e-6 * np.tanh(margin)).argmax(1)
            lang[rows] = np.array(names, dtype=object)[won]
            score[rows] *= certain[np.arange(len(rows)), won] / (len(names) - 1)
        return list(lang), np.clip(score, 0.0, 1.0), [self.families[b] for b in best]


def fit(docs: DataFrame, most_langs: int = 200, per_lang: int = 400, most_rows: int = 8000, folds: int = 3, out: int = 1) -> Model | None:
    """A model from a bounded sample: of the ``most_langs`` most frequent languages, about ``per_lang`` documents each
    and ``most_rows`` in all, chosen by a hash of doc_id and text among those whose crc32 is not of the held-out fold. Of rows that
    repeat doc_id and language each distinct text counts once; a hash chooses if those are over twice ``most_rows``.

    The executors count whole texts; only the sample's vectors come to the driver.
    """
    usable = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    if not counts:
        return None
    each = min(per_lang, most_rows // len(counts))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))])
    chance = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    sample = usable.where(F.col("lang").isin(*counts) & (chance < F.try_element_at(share, F.col("lang"))))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = list(frame["text"])
            for a, b in features.blocks(texts):
                x = vectors(texts[a:b]).astype(np.float16)
                yield frame[["doc_id", "text_hash", "lang"]].iloc[a:b].assign(x=[v.tobytes() for v in x])

    texts = sample.select("doc_id", F.xxhash64("text").alias("text_hash"), "lang", "text")
    rows = (
        features.sampled(texts, 2 * most_rows, "doc_id", "text_hash", "lang")
        .mapInPandas(count, "doc_id long, text_hash long, lang string, x binary")
        .groupBy("doc_id", "text_hash", "lang")
        .agg(F.min("x").alias("x"))
        .collect()
    )
    rows = sorted((r["lang"], bytes(r["x"])) for r in rows)
    if not rows:
        return None
    x = np.stack([np.frombuffer(v, dtype=np.float16) for _, v in rows]).astype(np.float32)
    return Model(x, [lang for lang, _ in rows])


def identify(docs: DataFrame, folds: int = 3, out: int = 1, **limits: int) -> DataFrame:
    """The language of every whole text, learned from the texts and non-null languages outside the held-out fold.

    A text's hashed letter trigrams choose the language family by one machine for each family, then every pair of the
    family's languages votes. Languages, sources and ids are never inputs of a prediction. The model is fitted on a
    bounded sample (see ``fit``) and sent to every task; each task predicts its own rows, without a shuffle.

    Null text, or text without a letter: ``und``, score 0. If nothing can be learned from, every text is ``und``.
    A null doc_id is in no fold: it is not learned from and held_out is false. Repeated rows get the same answer. Empty
    table: no rows. Other columns are ignored.

    Returns doc_id, held_out, lang_pred, score, family.
    """
    docs = pick(docs, "doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = fit(docs, folds=folds, out=out, **limits)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for frame in frames:
            texts = list(frame["text"])
            for a, b in features.blocks(texts):
                some = texts[a:b]
                lettered = np.array([bool(t) and any(c.isalpha() for c in t) for t in some]) & (known is not None)
                lang, score, family = ["und"] * len(some), np.zeros(len(some)), ["und"] * len(some)
                if lettered.any():
                    rows = np.flatnonzero(lettered)
                    got = known.predict(vectors([some[i] for i in rows]))
                    for i, name, s, f in zip(rows, *got, strict=True):
                        lang[i], score[i], family[i] = name, s, f
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[a:b], "held_out": frame["held_out"].iloc[a:b], "lang_pred": lang, "score": score, "family": family}).astype({"doc_id": "Int64"})

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == out, F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInPandas(run, PREDICTED)
