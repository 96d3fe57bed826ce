"""Cases in which a query once did less than its whole job."""

import random

from pyspark.sql import functions as F

from terracite.llm import licenses, mixing, private


def test_a_notice_in_a_third_of_all_files(spark):
    rows = [(i, "some words here\nSPDX-License-Identifier: MIT\nthe end of it" if i % 3 == 0 else "of the plain words", f"s/{i}/a.txt") for i in range(60)]
    rows += [(100, "Released under the MIT License.", "t/LICENSE"), (101, "nothing", "t/x/b.txt")] + [(200 + i, "Released under the MIT License.", f"u/{i}/c.txt") for i in range(30)]
    got = {r["doc_id"]: (r["licence"], r["basis"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert all(got[i] == (("MIT", "notice") if i % 3 == 0 else (None, "none")) for i in range(60))
    assert got[101] == ("MIT", "inherited") and all(got[200 + i] == ("MIT", "notice") for i in range(30))


def test_mixing_goes_on_past_a_long_document(spark):
    rows = [(i, f"{i} " + "w " * 19, "a") for i in range(300)] + [(1000, "w " * 6_000, "a")] + [(2000 + i, f"{i} " + "w " * 19, "b") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = {i: len(text.split()) for i, text, _ in rows}
    for seed in (1, 2):
        got = mixing.mixed_documents(docs, ("doc_id", "text", "source"), weights=(3, 1), seed=seed).collect()
        words = {s: sum(size[r["doc_id"]] for r in got if r["source"] == s) for s in "ab"}
        assert 18_000 - 20 < words["a"] <= 18_000 and 6_000 - 20 < words["b"] <= 6_000


def test_small_tables_wrapped_notices_and_headers(spark):
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, path string")
    for files, held in ((10, 1), (200, 20), (200, 5)):
        rows = [(i, "Released under the MIT License." if i < held else "plain words of a file", f"d{i}/a.txt") for i in range(files)]
        assert sum(r["licence"] == "MIT" for r in licenses.scan(table(rows)).collect()) == held
    texts = {
        "Apache-2.0": "# Copyright 2020 Jane Foo. Licensed under the\n# Apache License, Version 2.0 (the \"License\"); you may not use\n# this file except in compliance with the License.\n\ncode here",
        "Proprietary": "Copyright 2019 The Foo Authors. All rights reserved. More words follow here",
        "MIT": "some prose of a file. Copyright (c) 2021 Jane Foo. Released under the MIT License. And then the text goes on for long",
        "GPL-3.0": "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation",
        None: "the public went home. It is the rights of all men that matter; a domain of words",
    }
    rows = [(i, t, f"e{i}/a.txt") for i, t in enumerate(texts.values())]
    got = {r["doc_id"]: r["licence"] for r in licenses.scan(table(rows + [(100 + i, "other words", f"f{i}/b.txt") for i in range(50)])).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts)


def test_secrets_are_masked_whole(spark):
    rng = random.Random(4)
    secrets = {f"{n}": "".join(rng.choice("abcdef0123456789") for _ in range(n)) for n in (9, 300, 3_000, 300_000)}
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n" + "MIIEow+/Ab9\n" * 400 + "-----END RSA PRIVATE KEY-----"
    texts = [f'some words token = "{v}" and more' for v in secrets.values()]
    texts += ["the password: hunter-two-long goes", '{"apiKey": "abcd1234efgh5678"}', f"here\n{key}\nend", "secret=+49301234567890abc x", "API_KEY='a!b@c#d$e%f'"]
    held = [*secrets.values(), "hunter-two-long", "abcd1234efgh5678", "MIIEow", "+49301234567890abc", "a!b@c#d$e%f"]
    clean = ["the secret: everything was fine", "a token of thanks", "password: remember it well", "no private-key here"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts + clean)]
    got = {r["doc_id"]: r["text"] for r in private.redacted(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    for i, value in enumerate(held):
        assert "[SECRET]" in got[i] and not any(value[k : k + 6] in got[i] for k in range(0, max(1, len(value) - 6), 7)), (i, got[i][:80])
    assert got[0] == 'some words token = "[SECRET]" and more' and got[6] == "here\n[SECRET]\nend"
    assert [got[len(texts) + i] for i in range(len(clean))] == clean


def test_contexts_find_the_label_of_secrets_by_themselves(spark):
    """On the driver's tables: what labels would find is found without them, from words that look random, and little else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = docs.select(private._key(F.col("text")).alias("key"), "text")
    known = texts.select("key", F.concat(private.base_spans(F.col("text")), private.shaped_seeds(F.col("text"))).alias("seeds")).where("size(seeds) > 0").dropDuplicates(["key"])
    found = {(bytes(r["key"]), r["start"], r["end"]) for r in private.discovered(texts, known).where("kind = 4").collect()}
    labelled = texts.select("key", F.explode(private.labelled_secrets(F.col("text"))).alias("s")).select("key", "s.start", "s.end").collect()
    want = {(bytes(r["key"]), r["start"], r["end"]) for r in labelled}
    sure = {(bytes(r["key"]), r["start"], r["end"]) for r in known.select("key", F.explode("seeds").alias("s")).where("s.kind = 4").select("key", "s.start", "s.end").collect()}
    assert len(found & want) >= 0.9 * len(want) > 0 and len(found & want) >= 0.9 * len(found) and found - sure
