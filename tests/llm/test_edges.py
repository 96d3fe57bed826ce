"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from terracite.llm import audio, languages, licenses, mixing, packing, private, quality, repetition, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, code string, part int, score double, row long, copies int, DOC_KEY string"
LONG = "aaaa" * 50_000 + " " + "7" * 60_000 + " " + "x.y@" + "b." * 30_000 + " " + "word " * 20_000
TEXTS = [None, "", "   \n\t ", "one", "Hello there, this is a text. " * 12, "Hello there, this is a text. " * 12, LONG, "call +1 (555) 555-0100 or a@b.co", "ünï ßtraße été", "7 7 7"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 2}", None, 1, 2, "c", 3, 0.5, 4, 5, "k") for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "no id here", "en", "s0", 3, *rows[0][5:]), (None, None, None, None, None, *rows[0][5:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def runs(labels):
    return {
        "licences": lambda d: licenses.scan(licenses.with_paths(d)),
        "shards": sharding.shard_by_bytes,
        "simhash": simhash.simhash_components,
        "repetition": repetition.apply_rules,
        "languages": languages.identify,
        "private": lambda d: private.digest(private.find_private(d)),
        "packing": packing.pack,
        "quality": lambda d: quality.score_quality(d, labels),
        "mixing": mixing.mix_sources,
    }


@pytest.mark.parametrize("name", list(runs(None)))
def test_a_row_for_each_row(docs, labels, name):
    got = runs(labels)[name](docs)
    if name == "packing":
        assert {r["doc_id"] for r in got.collect()} == {None, *range(10)}
    else:
        assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", list(runs(None)))
def test_empty_table(docs, labels, name):
    empty = docs.where("doc_id = -1")
    got = runs(labels.limit(0))[name](empty)
    assert got.count() == 0 and got.columns == runs(labels)[name](docs.limit(1)).columns


def test_stages(spark, docs, labels, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("in"))
    labels.write.parquet(f"{place}/labels.parquet")
    for table in (docs, docs.where("doc_id = -1")):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, place)
            if name != "packing":
                assert out.columns == list(corpus_pipeline.COLUMNS)
                now = spark.createDataFrame(out.collect(), out.schema)
            else:
                assert out.count() >= now.count()
        for _, stage in corpus_pipeline.STAGES[1:]:  # each also on the raw rows
            stage(spark, table, place).count()


def test_audio(spark):
    rows = [(0, [0.1 * (i % 7) for i in range(64)]), (1, None), (2, []), (None, [0.5] * 64), (20, [float("nan")] * 64), (40, [0.3, -0.2] * 32), (40, [0.3, -0.2] * 32)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("name", F.lit("x"))
    sound = audio.render(table, "vec_id", "embedding")
    got = audio.align(sound, audio.excerpts(sound)).collect()
    assert len(got) == len(rows) and all((r["class_id"] is None) == (r["frames"] == 0) for r in got if r["id"] is not None)
    assert audio.align(sound.limit(0), sound.limit(0)).count() == 0
