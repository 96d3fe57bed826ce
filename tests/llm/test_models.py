"""The operators that learn or align, against plain loops over the same vectors, and their values in odd cases."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracite.llm import audio, features, languages, quality

SF = "/root/testdata/sf0.001"
LONG = "word of a very long text " * 60_000


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(-1, None, "en"), (-2, "", None), (-3, "12 34 .!", "en"), (-4, LONG, None), (None, "no id here", "en")]
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    again = rows.where("doc_id % 50 = 0")
    return rows.unionByName(again).unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string")).cache()


def test_languages_by_pairs(docs):
    """Every family and every pairwise vote, one text and one machine at a time."""
    model = languages.fit(docs)
    want = {}
    rows = docs.collect()
    for r in rows:
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            want[r["text"]] = ("und", "und")
            continue
        x = np.append(languages.vectors([r["text"]])[0], 1.0)
        family = max(zip(model.rest @ x, model.families, strict=True))[1] if model.rest is not None else model.families[0]
        votes, margins = Counter(), Counter()
        for (f, a, b), w in model.pairs.items():
            if f == family:
                votes[a if x @ w > 0 else b] += 1
                margins[a] += x @ w
                margins[b] -= x @ w
        names = model.members[family]
        want[r["text"]] = (max(names, key=lambda v: (votes[v], margins[v])), family)
    texts = {r["doc_id"]: r["text"] for r in rows}
    answers = languages.identify(docs).collect()
    assert len(answers) == len(rows)
    for r in answers:
        assert (r["lang_pred"], r["family"]) == want[texts[r["doc_id"]]]
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["score"] == 0)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert {r["doc_id"] for r in answers if r["lang_pred"] == "und"} >= {-1, -2, -3}


def test_votes_by_double_loop(spark, docs):
    """Cosines, neighbours and votes, one text and one labelled vector at a time."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    plain = docs.select("doc_id", "text")
    model = quality.fit(plain, labels)
    rows = {r["doc_id"]: r["text"] for r in plain.collect()}
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == docs.count()
    unlike = 0
    for r in got:
        point = model.weigh(quality.counts([rows[r["doc_id"]]])) @ model.basis
        point = features.unit(point)[0]
        near = sorted(((float(point @ p), float(v)) for p, v in zip(model.points, model.labels, strict=True)), reverse=True)
        top = [(max(s, 0.0) ** 2, v) for s, v in near[: model.nearest]]
        total = sum(s for s, _ in top)
        score = sum(s * v for s, v in top) / total if total else model.prior
        tied = near[model.nearest - 1][0] - near[model.nearest][0] < 1e-5
        unlike += abs(score - r["score"]) > 1e-4 and not tied
        assert r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert not unlike
    twice = Counter((r["doc_id"], round(r["score"], 5)) for r in got)
    assert len(twice) == len({r["doc_id"] for r in got})  # repeated rows have one score


def test_a_doc_id_of_many_texts_is_learned_from_in_any_order(spark):
    """More rows of one doc_id than the sample holds: the layout of the table does not choose among them."""
    rows = [(1, f"text {'abcdefgh'[i % 8] * (i % 5 + 1)} number {i}", "en" if i % 3 else "de") for i in range(300)] * 2
    table, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    for fit, most in ((lambda df: quality.fit(df, labels, most_rows=20, out=9).points, 40), (lambda df: languages.fit(df, most_rows=20, out=9).pairs, None)):
        one, other = fit(table.repartition(7, F.xxhash64("text"))), fit(table.orderBy(F.desc("text")).coalesce(2))
        if most:
            assert one.shape[0] == most and np.array_equal(one, other)
        else:
            assert one.keys() == other.keys() and all(np.array_equal(w, other[k]) for k, w in one.items())


def test_counts_over_two_bytes_are_learned_as_they_are(spark):
    text = "aaaa" * 50_000
    model = quality.fit(spark.createDataFrame([(1, text), (2, "other words")], "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), out=9)
    mine = features.unit(model.weigh(quality.counts([text])) @ model.basis)
    assert np.isclose(mine @ model.points.T, 1, atol=1e-5).any()


def test_without_labels_every_score_is_the_same(spark, docs):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert {(r["score"], r["predicted"]) for r in quality.score_quality(docs, none).collect()} == {(0.5, 1)}
    assert quality.keep_good(docs, none, ("doc_id", "text")).count() == docs.count()


def prints(row, shift=0):
    samples = np.frombuffer(row["audio"], dtype="<i2").astype(np.float64)[shift:]
    return audio.packed(audio.chroma(samples)) if len(samples) else np.zeros(0, dtype=np.uint32)


def test_alignment_by_all_offsets(spark):
    """Hits at every offset and the bits that differ there, for every query and recording."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 80")
    sound = audio.render(table, "vec_id", "embedding")
    asked = audio.excerpts(sound)
    whole = {r["id"]: prints(r) for r in sound.collect()}
    queries = {r["id"]: [prints(r, s) for s in audio.SHIFTS] for r in asked.collect()}
    first = {}
    for i in sorted(whole):
        first.setdefault(whole[i].tobytes(), i)

    def heard(p):
        """Places of each key: the signs of two frames that stand KEY apart and differ."""
        signs = (p & np.uint32(audio.SIGNS)).tolist()
        return [(k, signs[k], signs[k + audio.KEY[1]]) for k in range(len(signs) - audio.KEY[1]) if signs[k] != signs[k + audio.KEY[1]]]

    got = {r["id"]: r for r in audio.align(sound, asked).collect()}
    assert set(got) == set(whole)
    for i, p in whole.items():
        assert got[i]["frames"] == len(p) and got[i]["class_id"] == first[p.tobytes()]
        if i not in queries:
            assert got[i]["links"] is None and got[i]["best_class"] is None
            continue
        found = []
        for c in first.values():
            at, best = {}, None
            for k, *key in heard(whole[c]):
                at.setdefault(tuple(key), []).append(k)
            for q in queries[i]:
                hits = Counter(k - j for j, *key in heard(q) for k in at.get(tuple(key), ()))
                for offset, n in hits.items():
                    if best is None or (n, -abs(offset), offset) > best[0]:
                        best = ((n, -abs(offset), offset), [q])
                    elif (n, -abs(offset), offset) == best[0]:
                        best[1].append(q)
            if best is None:
                continue
            offset = best[0][2]
            errors = set()
            for q in best[1]:
                a, b = whole[c][max(0, offset) :], q[max(0, -offset) :]
                n = min(len(a), len(b))
                errors.add(sum((int(x) ^ int(y)).bit_count() for x, y in zip(a[:n], b[:n], strict=True)) / (32 * n) if n >= 24 else 1.0)
            found.append((errors, c, offset))
        sure = [x for x in found if max(x[0]) <= 0.25]
        may = [x for x in found if min(x[0]) <= 0.25]
        assert len(sure) <= got[i]["links"] <= len(may)
        errors, c, offset = min(found, key=lambda x: min(x[0]))
        assert (got[i]["best_class"], got[i]["best_offset"]) == (c, offset) and any(abs(got[i]["best_error"] - e) < 1e-6 for e in errors)
