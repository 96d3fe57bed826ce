"""Cases that the driver's tables do not show."""

import datetime as dt
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from terracite.functions import text as tx
from terracite.functions.components import connected
from terracite.operators import aggregates, chunks, editorial, graph, grounding, joins, ranking, reports, resolve, search
from terracite.plans.documents import PLAIN_UTTERANCES


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("  Électricité  de France ", "electricite de france"), ("ﬁnance & Co.", "finance co"), ("A B", "a b"), ("", ""), ("--", "")],
)
def test_normalize(spark, raw, want):
    assert one(spark, tx.normalize_name(F.col("c0"), unicode=True), raw) == want


def test_mr_is_not_mrs(spark):
    anchors = spark.createDataFrame([(1, "Mrs. Brown", None)], "source_id long, person string, org string")
    rows = spark.createDataFrame([(1, "a", "Mr. Brown met mrs brown.")], "source_id long, id string, content string")
    got = chunks.normalize_chunks(rows, anchors).first()
    assert got["normalized"] == "Mr. Brown met Mrs. Brown." and got["n_changed"] == 1


def test_structures(spark):
    texts = {"Q: a\nA: b\nQ: c\nA: d": "qa_structured", "Anna: hi\nBen: ho\nAnna: so": "speaker_transcript", "One.\n\nTwo.": "article_style", "One.": "freeform", "": "freeform"}
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    assert {r["t"]: r["s"] for r in df.select("t", tx.structure(F.col("t")).alias("s")).collect()} == texts


def test_anchor_methods(spark):
    person = lambda *v: one(spark, tx.person_anchor_method(F.col("c0"), F.col("c1"), F.col("c2")), *v)
    assert person("mr raji", "mr raji", "raji") == "exact"
    assert person("raji", "raji", "ahmed raji") == "anchor_inferred"
    assert person("zed", "zed", "ahmed raji") is None


@pytest.mark.parametrize(
    ("row", "day", "valid"),
    [
        (("2020-01-01", "exact", "2020-12-31", "exact", "ended"), "2020-01-01", True),
        (("2020-01-01", "exact", "2020-12-31", "exact", "ended"), "2020-12-31", True),
        (("2020-01-01", "exact", "2020-12-31", "exact", "ended"), "2021-01-01", False),
        (("2020-01-01", "unknown", None, "exact", "active"), "1990-01-01", True),
        (("2020-01-01", "exact", "2020-12-31", "unknown", "active"), "2030-01-01", True),
        (("2020-01-01", "exact", "2020-12-31", "unknown", "ended"), "2030-01-01", False),
        (("2020-01-01", "exact", None, "exact", "active"), None, False),
    ],
)
def test_as_of(spark, row, day, valid):
    date = lambda s: None if s is None else dt.date.fromisoformat(s)
    a, p, b, q, state = row
    positions = spark.createDataFrame(
        [(1, "x", date(a), p, date(b), q, state)], "id int, person_id string, valid_from_date date, valid_from_precision string, valid_to_date date, valid_to_precision string, state string"
    )
    asked = spark.createDataFrame([(1, "x", date(day))], "request_id int, person_id string, as_of date")
    assert joins.positions_as_of(positions, asked).count() == int(valid)


def test_freshness(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2023-08-31",), ("2023-03-01",), (None,)], "t string")
    got = [r["f"] for r in df.select(tx.freshness(F.to_date("t"), F.lit("2024-02-29").cast("date")).alias("f")).collect()]
    assert got == ["fresh", "stale", "stale", "unknown"]


def test_chains_and_cycles(spark):
    links = {"a": "b", "b": "a", "t": "a", "s": "s", "r": None, "x0": "r", **{f"x{i}": f"x{i - 1}" for i in range(1, 20)}, "lost": "nobody"}
    e = spark.createDataFrame(list(links.items()), "id string, canonical_entity_id string")
    got = {r["id"]: (r["root_id"], r["depth"], r["cyclic"]) for r in graph.canonical_roots(e).collect()}
    assert got["x19"] == ("r", 20, False) and got["r"] == ("r", 0, False) and got["lost"] == ("lost", 0, False)
    assert all(got[k] == (k, 0, True) for k in "abts")
    cycles = {r["start_id"]: r["path"] for r in graph.canonical_cycles(e).collect()}
    assert cycles == {"a": "a>b>a", "b": "b>a>b", "s": "s>s"}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 2), (2, 1), (3, 3), (9, 7), (7, 8)] + [(500, k) for k in range(501, 900)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, 2: 1, 8: 7, 9: 7, **{k: 500 for k in range(501, 900)}}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gram_join_against_all_pairs(spark):
    names = ["anna smith", "ana smith", "anne smyth", "bob", "bobby", "robert", "", "anna smith jr", "smith anna"]
    l = spark.createDataFrame([(i, n, "b") for i, n in enumerate(names)], "left_id int, name string, k string")
    got = {(r["left_id"], r["right_id"]): round(r["score"], 9) for r in joins.gram_join(l, l.withColumnRenamed("left_id", "right_id"), 0.5, ["k"]).collect()}

    def grams(s):
        s = f"  {s}  "
        return {s[i : i + 3] for i in range(len(s) - 2)} if s.strip() else set()

    want = {}
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            x, y = grams(a), grams(b)
            if x and y and 2 * len(x & y) / (len(x) + len(y)) >= 0.5 - 1e-9:
                want[i, j] = round(2 * len(x & y) / (len(x) + len(y)), 9)
    assert got == want


def test_match_or_create(spark):
    entities = spark.createDataFrame(
        [("e1", "Global Energy Group", "COMPANY", None, "global energy group", None, None), ("e2", "Acme Holdings", "COMPANY", 1, "acme holdings", None, None), ("e3", "National Petroleum Investment Trust", "COMPANY", None, "national petroleum investment trust", None, None)],
        "id string, name string, type string, project_id long, normalized_name string, canonical_entity_id string, description string",
    )
    aliases = spark.createDataFrame([("e2", "Acme", 1, "acme", 1.0)], "entity_id string, alias string, scope long, alias_normalized string, confidence double")
    names = spark.createDataFrame(
        [(1, 1, "COMPANY", "ACME"), (2, 1, "COMPANY", "Acme Holding"), (3, 1, "COMPANY", "Zebra"), (4, 1, "COMPANY", "zebra!"), (5, 2, "COMPANY", "Global Energy Grp"), (6, 1, "PERSON", "Acme Holdings"), (7, 2, "COMPANY", "National Petroleum Investments Trust")],
        "mention_id int, project_id long, type string, name string",
    )
    got = {r["mention_id"]: r for r in resolve.match_or_create(names, entities, aliases).collect()}
    assert (got[1]["entity_id"], got[1]["method"]) == ("e2", "project_alias")
    assert got[2]["result"] == "created" and got[2]["needs_review"] and 0.8 <= got[2]["score"] < 0.9
    assert (got[7]["entity_id"], got[7]["method"]) == ("e3", "fuzzy")
    assert got[3]["entity_id"] == got[4]["entity_id"] and got[3]["result"] == "created" and not got[3]["needs_review"]
    assert got[5]["result"] == "created"
    assert got[6]["result"] == "created"
    only = {r["mention_id"]: r["entity_id"] for r in resolve.match_or_create(names, entities, aliases, "match_only").collect()}
    assert only == {1: "e2", 2: None, 3: None, 4: None, 5: None, 6: None, 7: None}


def test_gate(spark):
    grounded = spark.createDataFrame([(1, "a", "c1", "exact"), (1, "b", "c1", "alias"), (1, "c", "c1", "fuzzy"), (1, "c", "c2", "anchor_context"), (1, "d", "c1", "fuzzy"), (1, "d", "c2", "exact")], "source_id long, entity_id string, chunk_id string, match_method string")
    edges = spark.createDataFrame([(1, "a", "b", "supplier"), (1, "a", "c", "supplier"), (1, "a", "z", "supplier"), (1, "a", "d", "critic"), (1, "a", "d", "advisor")], "source_id long, source_entity_id string, target_entity_id string, relation_type string")
    anchors = spark.createDataFrame([(1, "z")], "source_id long, entity_id string")
    mentions, out = resolve.persistence_gate(grounded, edges, anchors, edges.where("relation_type = 'critic'"))
    assert mentions.where("reason is null").count() == 3
    why = {(r["target_entity_id"], r["relation_type"]): r["reason"] for r in out.collect()}
    assert why == {("b", "supplier"): None, ("c", "supplier"): "end not persisted", ("z", "supplier"): None, ("d", "critic"): "rejected by editor", ("d", "advisor"): None}


def test_validation(spark):
    rows = spark.createDataFrame(
        [("A", "B", "supplier", 0.9, None), ("A", "B", "supplier", 0.9, " said "), ("A", "a!", "supplier", 0.9, "x"), ("A", "B", "knows", 0.9, "x"), ("A", "B", "supplier", 0.05, "x"), ("A", "B", "supplier", 0.7, "  ")],
        "source_name string, target_name string, relation_type string, confidence double, evidence_text string",
    )
    got = [(r["reason"], r["confidence"], r["evidence_text"]) for r in resolve.validate_edges(rows).collect()]
    assert got == [(None, 0.5, None), (None, 0.9, "said"), ("self", 0.9, "x"), ("unknown type", 0.9, "x"), ("low confidence", 0.05, "x"), (None, 0.5, "")]


def test_grounding_takes_the_best_method(spark):
    entities = spark.createDataFrame([(1, "e", "Acme Holdings", "positive"), (1, "p", "Maria Lopez", None)], "source_id long, entity_id string, name string, sentiment string")
    aliases = spark.createDataFrame([("e", "Acme")], "entity_id string, alias string")
    text = [(1, "c1", "We met Acme Holdings."), (1, "c2", "So acme said."), (1, "c3", "The Acme Holdingz board."), (1, "c4", "Nothing here, acmes."), (1, "c5", "Then Lopez spoke.")]
    rows = spark.createDataFrame(text, "source_id long, id string, content string")
    anchors = spark.createDataFrame([(1, "p", "Maria Lopez", "person")], "source_id long, entity_id string, name string, kind string")
    got = {(r["entity_id"], r["chunk_id"]): r["match_method"] for r in grounding.ground(entities, aliases, rows, anchors).collect()}
    assert got == {("e", "c1"): "exact", ("e", "c2"): "alias", ("e", "c3"): "alias", ("p", "c5"): "anchor_context"}


def test_long_turn_is_packed_and_bounded(spark):
    said = " ".join(f"Sentence number {i} goes on for a while about the port." for i in range(120))
    rows = spark.createDataFrame([(1, 0, "A", said, 0.0, 120000.0), (1, 1, "B", "Yes.", 120000.0, 121000.0), (1, 2, "A", "Short.", 121000.0, 122000.0)], "source_id long, turn long, speaker string, text string, start double, end double")
    got = chunks.chunk_transcripts(rows).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == list(range(len(got)))
    assert all(chunks.tokens(r["content"]) <= 600 for r in got) and len(got) > 4
    first = [r for r in got if r["speaker"] == "A"][:3]
    assert first[0]["start"] == 0 and all(a["end"] <= b["end"] for a, b in zip(first, first[1:], strict=False))
    assert first[1]["content"].split(": ", 1)[1].split(" ")[0] != "Sentence" or "number" in first[1]["content"]


def test_structured_chunks(spark):
    qa = "\n".join(f"Q: What about item {i}?\nA: " + "It was fine and went well for everyone. " * 8 for i in range(6))
    docs = spark.createDataFrame([(1, qa), (2, "Anna: hello there\nBen: good day\nAnna: " + "word " * 900), (3, "  "), (4, None), (5, "One.\n\nTwo.")], "source_id long, text string")
    got = chunks.chunk_structured(docs).collect()
    by = {k: [r for r in got if r["source_id"] == k] for k in range(1, 6)}
    assert len(by[1]) == 6 and all(r["content"].startswith("Q:") for r in by[1])
    assert {r["speaker"] for r in by[2]} == {"Anna", "Ben"} and not by[3] and not by[4]
    assert [r["content"] for r in by[5]] == ["One.\n\nTwo."]


def test_utterances(spark):
    docs = spark.createDataFrame([(1, "Q: Why?\nA: So.\nMore.\nQ: And?"), (2, "Anna: hi\nBen: ho\nAnna: so\nstill"), (3, "One\n\nTwo")], "source_id long, text string")
    got = [(r["source_id"], r["speaker"], r["text"]) for r in chunks.utterances_from_text(docs).orderBy("source_id", "turn").collect()]
    assert got == [(1, "Q", "Why?"), (1, "A", "So. More."), (1, "Q", "And?"), (2, "Anna", "hi"), (2, "Ben", "ho"), (2, "Anna", "so still"), (3, "Speaker", "One"), (3, "Speaker", "Two")]


def test_merge_of_chain_and_of_linked_entities(spark):
    e = spark.createDataFrame([(k, k.upper(), None, None, k) for k in "abcd"], "id string, name string, project_id long, canonical_entity_id string, normalized_name string")
    aliases = spark.createDataFrame([], "entity_id string, alias string, scope long, alias_normalized string, confidence double")
    mentions = spark.createDataFrame([("a", 1, "x"), ("c", 1, "x")], "entity_id string, source_id long, chunk_id string")
    edges = spark.createDataFrame([("1", "a", "b", "ally", 1, 0.9, "pending"), ("2", "a", "d", "ally", 1, 0.9, "pending"), ("3", "c", "d", "ally", 1, 0.2, "rejected")], "id string, source_entity_id string, target_entity_id string, relation_type string, source_id long, confidence double, review_status string")
    mapping = spark.createDataFrame([("a", "b"), ("b", "c")], "from_id string, to_id string")
    out = editorial.merge_entities(e, aliases, mentions, edges, mapping)
    assert {r["id"]: r["canonical_entity_id"] for r in out["entities"].collect()} == {"a": "c", "b": "c", "c": None, "d": None}
    assert out["mentions"].count() == 1 and {r["alias"] for r in out["aliases"].collect()} == {"A", "B"}
    assert [(r["id"], r["review_status"]) for r in out["edges"].collect()] == [("3", "rejected")]
    loose = editorial.merge_entities(e, aliases, mentions, edges, mapping, keep_editorial=False, drop_self=False)
    assert {r["id"] for r in loose["edges"].collect()} == {"1", "2"}


def test_ann_recall(spark, sf_dir):
    from terracite.sources.model import Model

    m = Model(spark, sf_dir)
    asked = m.vectors.where("id < 40").select(F.col("id").alias("query_id"), "embedding")
    exact = {(r["query_id"], r["id"]) for r in search.hybrid_search(m.vectors, asked, threshold=-1.0, k=5).collect()}
    near = {(r["query_id"], r["id"]) for r in search.ann_search(m.vectors, asked, 5, tables=16, bits=4).collect()}
    assert len(exact & near) >= 0.8 * len(exact)


def test_names_go_to_global_candidates_only_if_the_project_has_none_alike(spark):
    kinds = "id string, type string, project_id long, normalized_name string, canonical_entity_id string"
    entities = spark.createDataFrame([("P", "COMPANY", 1, "acme holding", None), ("G", "COMPANY", None, "acme trading ltd", None)], kinds)
    aliases = spark.createDataFrame([], "entity_id string, scope long, alias_normalized string")
    names = spark.createDataFrame([(1, 1, "COMPANY", "Acme trading ltdd"), (2, 2, "COMPANY", "Acme trading ltdd")], "mention_id long, project_id long, type string, name string")
    got = {r["mention_id"]: (r["result"], r["entity_id"]) for r in resolve.match_or_create(names, entities, aliases, merge=0.85).collect()}
    assert got[1][0] == "created" and got[2] == ("matched", "G")


def test_word_pairs_find_what_the_pattern_finds(spark):
    """Names and texts with letters whose case folds unusually, names inside longer words, names without a letter."""
    names = ["Ana Ruiz", "\u00c5SA \u00d6berg", "\u0130stanbul", "Stra\u00dfe", "C++", "++", "Port of Tema", "\u039f\u0394\u039f\u03a3", "Tema", "", None]
    texts = ["ana ruiz, anaruiz", "\u00e5sa \u00f6berg++", "istanbul C++ port of tema1", "STRASSE stra\u1e9ee", "c++.", "+ +", "\u03bf\u03b4\u03bf\u03c2 Tema's", "port OF tema", "", None]
    n = spark.createDataFrame([(s, i, x) for s in (1, 2) for i, x in enumerate(names)], "source_id long, entity_id long, name string")
    c = spark.createDataFrame([(1, str(i), x) for i, x in enumerate(texts)] + [(1, "0", texts[0])], "source_id long, chunk_id string, content string")
    plain = n.join(c, "source_id").where(tx.has_word(F.col("content"), F.col("name"))).select("source_id", "entity_id", "chunk_id").collect()
    ours = grounding.contained(n, "name", c.distinct()).select("source_id", "entity_id", "chunk_id").collect()
    assert len(ours) > 5 and sorted(set(map(tuple, plain))) == sorted(map(tuple, ours))


def test_texts_come_in_whole(spark, tmp_path):
    from terracite.sources import payloads

    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in payloads.read_sources(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == "one\ntwo\n" and not got.get("b.txt")


def test_a_repeated_write_replaces_its_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "derived")
    rows = lambda *r: spark.createDataFrame(r, "bucket int, id int")
    editorial.write_derived(rows((0, 1), (1, 2)), path, "bucket")
    for _ in range(2):
        editorial.write_derived(rows((1, 3), (2, 4)), path, "bucket")
    assert sorted(map(tuple, spark.read.parquet(path).select("bucket", "id").collect())) == [(0, 1), (1, 3), (2, 4)]


def test_places_are_gapless_over_ranges(spark):
    from terracite.operators import ranking

    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 13).alias("n"))
    got = ranking.numbered(df, [F.desc("n"), F.col("id")], "place").collect()
    want = sorted(((-r["n"], r["id"]) for r in got))
    assert [r["place"] for r in sorted(got, key=lambda r: (-r["n"], r["id"]))] == list(range(1, 1001)) and len(want) == 1000


def test_batches_of_renames_reach_the_state_in_which_no_request_would_change(spark):
    """Swaps, chains, several claims to one name, claims to names given up, over projects and globally, against repeated passes in Python."""
    rng = random.Random(6)
    for trial in range(4):
        names = [f"n{k}" for k in range(12)]
        rows = [(f"e{i:02d}", rng.choice(names).upper(), rng.choice("AB"), rng.choice([None, 1, 2]), None if rng.random() < 0.8 else "e00") for i in range(40)]
        asked = [(i, rng.choice([*names, "fresh", " ", rng.choice(names).upper(), "--"])) for i, *_ in rng.sample(rows, 22)] + [("zz", "n1")]
        entities = {r[0]: r for r in rows}
        claims = {i: n.strip() for i, n in asked if i in entities and n.strip() not in ("", "--") and n.strip() != entities[i][1]}
        outcome = {i: None for i in claims}  # the entity that each merges into

        def holders(name, kind, scope, but):
            """Who has a name after the batch, as the outcomes stand, the one that keeps it before those that get it."""
            keep = [i for i, r in entities.items() if i not in claims and r[4] is None and (r[1].lower(), r[2], r[3]) == (name, kind, scope)]
            get = [i for i, to in outcome.items() if to is None and entities[i][4] is None and (claims[i].lower(), *entities[i][2:4]) == (name, kind, scope)]
            return [i for i in [*sorted(keep), *sorted(get)] if i != but]

        for _ in range(100):
            before = dict(outcome)
            for i in sorted(claims):
                name, (kind, scope) = claims[i].lower(), entities[i][2:4]
                own, world = holders(name, kind, scope, i), holders(name, kind, None, i) if scope is not None else []
                keeps = [h for h in own if h not in claims]
                ahead = keeps[:1] or world[:1] or [h for h in own if h < i or entities[i][4] is not None][:1]
                outcome[i] = ahead[0] if ahead else None
            if outcome == before:
                break
        else:
            raise AssertionError("no fixed point")
        e = spark.createDataFrame([(*r, r[1].lower()) for r in rows], "id string, name string, type string, project_id long, canonical_entity_id string, normalized_name string")
        got = {r["id"]: (r["outcome"], r["target_id"]) for r in editorial.rename_entities(e, spark.createDataFrame(asked, "id string, new_name string")).collect()}
        assert got["zz"] == ("missing", None) and set(got) == {i for i, _ in asked}
        assert {i: got[i] for i in claims} == {i: ("rename" if to is None else "merge", to) for i, to in outcome.items()}
        assert all(got[i][0] in ("invalid", "same") for i, _ in asked if i in entities and i not in claims)


def test_a_swap_keeps_both_old_names_as_aliases(spark):
    e = spark.createDataFrame([("a", "Acme", "COMPANY", 1, None, "acme"), ("b", "Bolt", "COMPANY", 1, None, "bolt"), ("c", "Cog", "COMPANY", 1, None, "cog")], "id string, name string, type string, project_id long, canonical_entity_id string, normalized_name string")
    aliases = spark.createDataFrame([], "entity_id string, alias string, scope long, alias_normalized string, confidence double")
    mentions = spark.createDataFrame([("c", 1, "x", None)], "entity_id string, source_id long, chunk_id string, sentiment string")
    edges = spark.createDataFrame([("1", "c", "a", "ally", 1, 0.9, "pending")], "id string, source_entity_id string, target_entity_id string, relation_type string, source_id long, confidence double, review_status string")
    asked = spark.createDataFrame([("a", "Bolt"), ("b", "Acme"), ("c", "bolt!")], "id string, new_name string")
    out = editorial.apply_renames(e, aliases, mentions, edges, asked)
    assert {r["id"]: (r["name"], r["canonical_entity_id"]) for r in out["entities"].collect()} == {"a": ("Bolt", None), "b": ("Acme", None), "c": ("Cog", "a")}
    assert {(r["entity_id"], r["alias"]) for r in out["aliases"].collect()} == {("a", "Acme"), ("b", "Bolt"), ("a", "Cog")}
    assert out["mentions"].first()["entity_id"] == "a" and out["edges"].count() == 0


def test_a_check_that_fails_leaves_the_others_alone(spark, sf_dir):
    from terracite.operators import audit
    from terracite.sources.model import Model

    m = Model(spark, sf_dir)
    runs = {
        "plans": lambda m: m.sources.select("no_such_column"),
        "runs": lambda m: m.sources.select(F.raise_error(F.lit("broken while running")).alias("x")),
        "finds": lambda m: m.sources.select("id"),
        "nothing": lambda m: m.sources.where("id < 0").select("id"),
    }
    got = {r["name"]: r for r in audit.audit_report(m, "1998-01-01", 3, runs).collect()}
    assert [got[k]["n_rows"] for k in runs] == [-1, -1, m.sources.count(), 0]
    assert "no_such_column" in got["plans"]["error"] and got["runs"]["error"] and got["finds"]["error"] is None
    ids = sorted(str(r["id"]) for r in m.sources.select("id").collect())
    assert got["finds"]["sample"] == ids[:3] and got["nothing"]["sample"] == []


def test_as_of_join_by_cells_is_the_plain_one(spark, monkeypatch):
    """Also for bounds that are open, unknown, the wrong way round, or outside the days that cells are made of."""
    rng = random.Random(12)
    day = lambda: None if rng.random() < 0.15 else dt.date(rng.choice([1890, 1999, 2000, 2001, 2001, 2001, 2079, 2095]), rng.randint(1, 12), rng.randint(1, 28))
    person = lambda: rng.choice(["a", "a", "a", "b", None])
    rows = [(i, person(), day(), rng.choice(["exact", "unknown"]), day(), rng.choice(["exact", "unknown"]), rng.choice(["active", "ended"])) for i in range(300)]
    positions = spark.createDataFrame(rows, "id int, person_id string, valid_from_date date, valid_from_precision string, valid_to_date date, valid_to_precision string, state string")
    asked = spark.createDataFrame([(i, person(), day()) for i in range(120)], "request_id int, person_id string, as_of date")
    pairs = lambda: sorted(map(tuple, joins.positions_as_of(positions, asked).select("id", "request_id").collect()))
    plain = pairs()
    monkeypatch.setattr(joins, "MOST_DATED", 0)
    assert pairs() == plain and len(plain) > 500
    monkeypatch.setattr(joins, "MOST_DATED", 5000)  # one person above, one below
    assert pairs() == plain


def test_cells_make_up_exactly_the_days(spark):
    rng = random.Random(1)
    rows = [(0, 0), (0, (1 << joins.DAYS) - 1), (5, 4), (7, 7)] + [tuple(sorted((rng.randrange(1 << 10), rng.randrange(1 << 10)))) for _ in range(60)]
    got = spark.createDataFrame(rows, "lo int, hi int").select("lo", "hi", joins.day_cells(F.col("lo"), F.col("hi")).alias("cells")).collect()
    for r in got:
        days = sorted(d for c in r["cells"] for d in range(c["cell"] << c["level"], (c["cell"] + 1) << c["level"]))
        assert days == list(range(r["lo"], r["hi"] + 1)) and len(r["cells"]) <= 2 * joins.DAYS


def test_co_occurrence_in_blocks_is_the_plain_one(spark, monkeypatch):
    rng = random.Random(3)
    links = [(rng.choice([1, 1, 1, 2, 3]), f"e{rng.randrange(30)}", rng.choice(["author", "subject"])) for _ in range(200)]
    l = spark.createDataFrame(links, "source_id long, entity_id string, link_type string")
    sources = spark.createDataFrame([(k, 1) for k in (1, 2, 3)], "id long, project_id long")
    entities = spark.createDataFrame([(f"e{k}", f"E{k}", "COMPANY") for k in range(30)], "id string, name string, type string")
    rows = lambda: sorted(map(str, joins.co_occurrence(l, sources, entities, 1).collect()))
    plain = rows()
    monkeypatch.setattr(joins, "MOST_LINKED", 4)
    assert rows() == plain and len(plain) > 300


def test_cascade_meets_each_spelling_once(spark):
    """Many mentions and many entities of one spelling: no join makes their product."""
    many = 300
    entities = spark.range(many).selectExpr("concat('e', lpad(id, 4, '0')) id", "'bolt' name", "'PRODUCT' type", "if(id % 2 = 0, null, id % 5) project_id", "'bolt' normalized_name", "cast(null as string) canonical_entity_id", "cast(null as string) description")
    aliases = spark.range(many).selectExpr("concat('e', lpad(id, 4, '0')) entity_id", "'hot bolt' alias", "if(id % 3 = 0, null, id % 5) scope", "'hot bolt' alias_normalized", "1.0 confidence")
    names = spark.range(2 * many).selectExpr("id mention_id", "if(id % 7 = 0, null, id % 7) project_id", "'PRODUCT' type", "if(id % 2 = 0, 'bolt', 'hot bolt') normalized_name")
    found = joins.match_cascade(names, entities, aliases)
    got = {r["mention_id"]: (r["entity_id"], r["tier"]) for r in found.collect()}

    def want(k):
        project, alias = (k % 7 or None), k % 2
        scope = lambda j: (None if j % 3 == 0 else j % 5) if alias else (None if j % 2 == 0 else j % 5)
        for at, tier in ((project, "project"), (None, "global")):
            hits = [f"e{j:04}" for j in range(many) if scope(j) == at and (at is not None or tier == "global")]
            if hits:
                return min(hits), tier + ("_alias" if alias else "")

    assert got == {k: want(k) for k in range(2 * many)}
    assert _most_rows(found) < 10 * many


def test_fuzzy_match_compares_each_spelling_once(spark):
    """Many mentions of one spelling against many entities of another; aliases in two scopes lose no link."""
    many = 300
    entities = spark.range(many).selectExpr("concat('e', lpad(id, 4, '0')) id", "'National Petroleum Investment Trust' name", "'COMPANY' type", "1L project_id", "'national petroleum investment trust' normalized_name", "cast(null as string) canonical_entity_id", "cast(null as string) description")
    aliases = spark.createDataFrame([("e0007", s, "global energy holdings group", 1.0) for s in (2, 3, None)], "entity_id string, scope long, alias_normalized string, confidence double")
    names = spark.range(2 * many).selectExpr("id mention_id", "if(id % 2 = 0, 1, 2 + id % 3) project_id", "'COMPANY' type", "if(id % 2 = 0, 'National Petroleum Investments Trust', 'Global Energy Holding Group') name")
    found = resolve.match_or_create(names, entities, aliases, merge=0.85)
    got = {r["mention_id"]: (r["entity_id"], r["method"]) for r in found.collect()}
    assert got == {k: (("e0007" if k % 2 else "e0000"), "fuzzy") for k in range(2 * many)}
    assert _most_rows(found) < 20 * many


def test_keyterms_share_the_lists_of_projects(spark):
    """As a plain reading of each source, with anchors that repeat a list's terms; no row of a list is shuffled for a source."""
    many, words = 400, 30
    entities = spark.createDataFrame([("a", "Term 03"), ("b", "term 05"), ("c", " Other Name "), ("d", "  "), ("e", "Term 05")], "id string, name string")
    known = dict((r["id"], r["name"].strip(" ")) for r in entities.collect())
    pick = lambda i: (["a", "b", "c", "d", "x", None][i % 6], ["e", None, "b", "c"][i % 4], [1, 2, None, 9][i % 4 if i % 5 else 0])
    sources = spark.createDataFrame([(i, pick(i)[2], pick(i)[0], pick(i)[1]) for i in range(many)], "id long, project_id long, interviewee_entity_id string, interviewee_org_entity_id string")
    said = [(1, f"term {k:02}") for k in range(40)] + [(2, f"term {k:02}") for k in range(3)] + [(None, f"world {k:02}") for k in range(40)] + [(None, "term 01"), (2, "Term 02")]
    aliases = spark.createDataFrame(said, "scope long, alias_normalized string")
    found = chunks.keyterms(sources, aliases, entities, words)
    got = {}
    for r in found.collect():
        got.setdefault(r["source_id"], []).append((r["place"], r["term"], r["upto"]))

    def upto(terms):
        total, out = 0, []
        for t in terms:
            total += len(t.split())
            out.append(total)
        return out

    def listed(scope):
        terms = sorted({t for s, t in said if s == scope})[:words]
        return [t for t, n in zip(terms, upto(terms)) if n <= words]

    for i in range(many):
        first, second, project = pick(i)
        own = listed(project) if project else []
        rows = [(k, known[e]) for k, e in enumerate((first, second)) if e in known] + [(k + 2, t) for k, t in enumerate(own)]
        if not own or upto(own)[-1] < words:
            rows += [(k + words + 2, t) for k, t in enumerate(listed(None))]
        best = {}
        for row in sorted(rows):
            if row[1]:
                best.setdefault(row[1].lower(), row)
        rows = sorted(best.values())
        want = [(p, t, n) for (p, t), n in zip(rows, upto(t for _, t in rows)) if n <= words]
        assert sorted(got.get(i, [])) == want
    assert _most_rows(found, "shuffleRecordsWritten") <= 2 * many


def _most_rows(df, of="numOutputRows"):
    """The most rows that any step of a query gave."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    most, todo = 0, [plan]
    while todo:
        node = todo.pop()
        metric = node.metrics().get(of)
        if metric.isDefined():
            most = max(most, metric.get().value())
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_shortlist_is_the_plain_one_and_shuffles_no_list(spark):
    """Also where a project has few names of its own, or none, and a source no project."""
    rng = random.Random(8)
    entities = [(f"e{k:02}", f"E{k}", "COMPANY", rng.choice([None, 1, 2]), "e00" if k % 6 == 1 else None) for k in range(40)]
    sources = [(k, rng.choice([1, 2, 3, 4, None]), f"e{rng.randrange(40):02}", rng.choice([None, f"e{rng.randrange(40):02}"])) for k in range(60)]
    project = {s[0]: s[1] for s in sources}
    mentions = [(rng.choice([s for s in project if project[s] in wide]), f"e{rng.randrange(most):02}") for wide, most, n in (((1, 2), 40, 300), ((3,), 3, 40)) for _ in range(n)]
    e = spark.createDataFrame(entities, "id string, name string, type string, project_id long, canonical_entity_id string")
    s = spark.createDataFrame(sources, "id long, project_id long, interviewee_entity_id string, interviewee_org_entity_id string")
    m = spark.createDataFrame(mentions, "source_id long, entity_id string")
    named = {x[0]: x for x in entities if x[4] is None}
    out = ranking.candidate_shortlist(s, m, e, 6, 5)
    got = {(r["source_id"], r["place"], r["entity_id"], r["name"], r["tier"]) for r in out.collect()}
    counts = {}
    for at, who in mentions:
        if who in named:
            counts[project[at], who] = counts.get((project[at], who), 0) + 1
    best = lambda c: sorted(c, key=lambda x: (-x[1], x[0]))[:6]
    own = {p: best([(w, n) for (q, w), n in counts.items() if q == p]) for p in (1, 2, 3, 4)}
    world = best([(w, sum(n for (_, v), n in counts.items() if v == w)) for w in {w for _, w in counts} if named[w][3] is None])
    want = set()
    for k, p, *anchors in sources:
        rows = [(1, 0, a) for a in anchors if a] + ([] if p is None else [(2, -n, w) for w, n in own[p]] + [(3, -n, w) for w, n in (world if len(own[p]) < 5 else [])])
        first = {}
        for row in sorted(rows):
            first.setdefault(row[2], row)
        for place, (tier, _, w) in enumerate(sorted(r for r in first.values() if r[2] in named)[:6], 1):
            want.add((k, place, w, named[w][1], tier))
    assert got == want and {x[4] for x in want} == {1, 2, 3}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")


def test_pairs_of_a_source_are_grouped_where_they_lie(spark):
    links = spark.createDataFrame([(k % 5, f"e{k % 7}", "author") for k in range(60)], "source_id long, entity_id string, link_type string")
    sources = spark.createDataFrame([(k, 1) for k in range(5)], "id long, project_id long")
    entities = spark.createDataFrame([(f"e{k}", f"E{k}", "COMPANY") for k in range(7)], "id string, name string, type string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = aggregates.co_occurrence_by_source(joins.co_occurrence(links, sources, entities))
        assert out.count() == len({(k % 5, k % 7) for k in range(60)})
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(entity_id" not in plan and "hashpartitioning(source_id" in plan


def test_context_edges_shuffle_each_pair_of_a_source_once(spark):
    rng = random.Random(6)
    links = [(rng.randrange(6), f"e{rng.randrange(8)}", rng.choice(["author", "subject"])) for _ in range(60)]
    l = spark.createDataFrame(links, "source_id long, entity_id string, link_type string")
    sources = spark.createDataFrame([(k, 1) for k in range(6)], "id long, project_id long")
    entities = spark.createDataFrame([(f"e{k}", f"E{k}", "COMPANY") for k in range(7)], "id string, name string, type string")  # e7 has no name
    out = aggregates.context_edges(joins.co_occurrence(l, sources, entities))
    want = {}
    for s in range(6):
        here = {e for at, e, _ in links if at == s}
        for x in here:
            for y in here - {x, "e7"}:
                n, types = want.setdefault((min(x, y), max(x, y)), (set(), set()))
                n.add(s)
                types |= {t for at, e, t in links if (at, e) == (s, y)}
    assert {(r["a"], r["b"]): (r["n_sources"], r["link_types"]) for r in out.collect()} == {k: (len(n), ",".join(sorted(t))) for k, (n, t) in want.items()}
    assert "count(distinct" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


@pytest.mark.parametrize("most", [2_000, 2])
def test_context_edges_merge_the_titles_of_their_sources(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "MOST_LINKED", most)
    links = [(s, e, "author" if s % 2 else "subject") for s, some in enumerate(["abx", "abc", "bc", "ab", "ab"]) for e in some] + [(0, "x", "speaker"), (0, "y", "author"), (None, "a", "author"), (None, "b", "author")]
    l = spark.createDataFrame(links, "source_id long, entity_id string, link_type string")
    sources = spark.createDataFrame([(0, 1, "Panel"), (1, 1, "Call"), (2, 1, None), (3, 1, "Panel")], "id long, project_id long, title string")  # source 4 is unknown
    entities = spark.createDataFrame([(e, e.upper(), "COMPANY") for e in "abc"], "id string, name string, type string")
    out = aggregates.context_edges(joins.titled_pairs(l, sources, entities))
    want = {("a", "b", 4, "author,subject", "Call; Panel"), ("a", "c", 1, "author", "Call"), ("b", "c", 2, "author,subject", "Call")}
    want |= {(e, other, 1, "subject", "Panel") for e in "ab" for other in "xy"}  # x and y are no entities: they have no types to show, nor each other
    assert {(r["a"], r["b"], r["n_sources"], r["link_types"], r["source_titles"]) for r in out.collect()} == want


@pytest.mark.parametrize("most", [2_000, 3])
def test_neighbours_count_each_pair_once_for_both_ends(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "MOST_LINKED", most)
    rng = random.Random(8)
    links = [(rng.choice([1, 1, 2, 3, None]), f"e{rng.randrange(9)}", rng.choice(["author", "subject"])) for _ in range(70)]
    ties = [(f"e{rng.randrange(9)}", f"e{rng.randrange(9)}", rng.choice(["approved", "rejected"])) for _ in range(60)] + [("e1", None, "approved")]
    entities = [(f"e{k}", "e0" if k % 3 == 2 else None) for k in range(8)]  # e8 is unknown, e2 and e5 are not canonical
    l = spark.createDataFrame(links, "source_id long, entity_id string, link_type string")
    e = spark.createDataFrame(entities, "id string, canonical_entity_id string")
    pairs = joins.shared_sources(l, e.withColumn("mark", F.lit(True))).select("a.id", F.col("b.id").alias("b"), "source_id")
    known = {x for x, _ in entities}
    here = {s: {x for at, x, _ in links if at == s} & known for s in (1, 2, 3)}
    assert sorted(map(tuple, pairs.collect())) == sorted((x, y, s) for s, some in here.items() for x in some for y in some if x < y)
    want = {}
    for x, y in [p for a, b, status in ties if status != "rejected" and b and a != b for p in ((a, b), (b, a))]:
        want.setdefault((x, y), [0, 0])[0] += 1
    for x, y in [(x, y) for some in here.values() for x in some for y in some if x != y]:
        want.setdefault((x, y), [0, 0])[1] += 1
    live = {x for x, to in entities if to is None}
    out = graph.ego_neighbours(spark.createDataFrame(ties, "source_entity_id string, target_entity_id string, review_status string"), l, e)
    assert {tuple(r)[:2]: list(r)[2:] for r in out.select("entity_id", "neighbour_id", "n_edges", "n_shared").collect()} == {k: v for k, v in want.items() if k[0] in live}
    some = graph.ego_neighbours(spark.createDataFrame(ties, "source_entity_id string, target_entity_id string, review_status string"), l, e, spark.createDataFrame([("e1",), ("e2",)], "entity_id string"))
    assert {(r["entity_id"], r["neighbour_id"]) for r in some.collect()} == {k for k in want if k[0] == "e1"}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]


def test_utterances_are_made_where_the_text_lies(spark):
    rng = random.Random(5)
    parts = ["Q:", "A :", "Q", ": x", "Answer:", "Ana:", "Ana Bo :", "Ana\tBo:", "Ñandú:", "foo bar", "\n", "\n", "\n\n", " ", "\t", "\r", " ", " ", "\n \n", "B:"]
    texts = [(k, "".join(rng.choice(parts) + rng.choice(["", "\n", " "]) for _ in range(rng.randrange(25))), rng.choice([None, "qa_structured", "speaker_transcript"])) for k in range(300)] + [(301, None, None)]
    docs = spark.createDataFrame(texts, "source_id long, text string, hint string")
    lines = docs.select("source_id", F.coalesce("hint", tx.structure(F.col("text"))).alias("kind"), F.posexplode(F.split("text", "\n")).alias("line", "raw")).withColumn("raw", tx.trimmed(F.col("raw")))
    asks = F.col("raw").rlike(r"^(?i:Q|P|Pregunta|Question|A|R|Respuesta|Answer)\s*:")
    speaks = F.col("raw").rlike(r"^[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñA-ZÁÉÍÓÚÜÑ]+(\s[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñA-ZÁÉÍÓÚÜÑ]+)*\s*:")
    want = {}
    for r in lines.select("*", asks.alias("asks"), speaks.alias("speaks")).orderBy("source_id", "line").collect():
        units = want.setdefault(r["source_id"], [[]])
        if {"qa_structured": r["asks"], "speaker_transcript": r["speaks"]}.get(r["kind"], r["raw"] == ""):
            units.append([])
        units[-1] += [r["raw"]] if r["raw"] else []
    out = chunks.utterances_from_text(docs, "hint")
    got = {}
    for r in out.orderBy("source_id", "turn").collect():
        got.setdefault(r["source_id"], []).append(r["text"])
    plain = {k for k, _, hint in texts if hint is None}
    assert {k: v for k, v in got.items() if k in plain and all(":" not in x for x in v)} == {k: v for k, v in ((k, [" ".join(u) for u in v if u]) for k, v in want.items()) if k in plain and v and all(":" not in x for x in v)}
    bare = lambda x: x.split(":", 1)[-1].strip() if ":" in x[:61] else x
    assert {k: len(v) for k, v in got.items() if k not in plain} == {k: n for k, n in ((k, sum(bool(bare(" ".join(u))) for u in v)) for k, v in want.items()) if k not in plain and n}
    assert "Window" not in out.groupBy("source_id").count()._jdf.queryExecution().optimizedPlan().toString()


def _plain_utterances(text, kind):
    """The reference's parser, line by line: (speaker, text)."""
    asks, answers = (re.compile(rf"({words})[^\S\n]*:", re.IGNORECASE | re.ASCII) for words in ("Q|P|Pregunta|Question", "A|R|Respuesta|Answer"))
    speaks = re.compile(r"[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñA-ZÁÉÍÓÚÜÑ]+(\s[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñA-ZÁÉÍÓÚÜÑ]+)*\s*:", re.ASCII)
    lines = [x.strip() for x in text.split("\n")]
    if kind is None:
        asked, spoken = sum(bool(asks.match(x)) for x in lines), sum(bool(speaks.match(x)) for x in lines)
        kind = "qa_structured" if asked >= 2 else "speaker_transcript" if spoken >= 3 and spoken >= 0.1 * sum(map(bool, lines)) else "freeform"
    out, speaker, said, marked = [], None, [], False

    def flush():
        if speaker and any(said):
            out.append((speaker, " ".join(x for x in said if x)))
        said.clear()

    for line in lines if kind in ("qa_structured", "speaker_transcript") else []:
        begins = speaks.match(line) if kind == "speaker_transcript" else asks.match(line) or answers.match(line)
        if begins:
            flush()
            marked = True
            speaker = line.split(":")[0].strip() if kind == "speaker_transcript" else "Q" if asks.match(line) else "A"
            said.append(line[begins.end() :].strip())
        elif line:
            speaker = speaker or ("Speaker" if kind == "speaker_transcript" else "A")
            said.append(line)
        elif kind == "qa_structured" and speaker == "Q" and any(said):
            flush()
            speaker = "A"
    flush()
    if out and (marked or kind == "speaker_transcript"):
        return out
    return [("Speaker", " ".join(p.split())) for p in re.split(r"\n{2,}", "\n".join(lines)) if p.strip()]


def test_utterances_are_those_of_the_reference(spark):
    """An answer without a label behind a blank line, codes of speakers whatever the label, words before any label, and paragraphs where labels give nothing."""
    one = "Preamble: so\nPregunta: Why?\nreally\n\nBecause.\n\nMore: words\nQuestion:\n\nAnd?\nrespuesta : Yes\n\nand no"
    docs = spark.createDataFrame([(1, one, None), (2, "One\n\nTwo: x", "qa_structured"), (3, "Q:\nQ:", None), (4, " \n", None)], "source_id long, text string, hint string")
    got = [(r["source_id"], r["turn"], r["speaker"], r["text"], r["start"], r["end"]) for r in chunks.utterances_from_text(docs, "hint", whole=True).orderBy("source_id", "turn").collect()]
    want = [("A", "Preamble: so"), ("Q", "Why? really"), ("A", "Because. More: words"), ("Q", "And?"), ("A", "Yes and no")]
    assert got == [(1, i, *x, float(i), float(i + 1)) for i, x in enumerate(want)] + [(2, 0, "Speaker", "One", 0.0, 1.0), (2, 1, "Speaker", "Two: x", 1.0, 2.0), (3, 0, "Speaker", "Q: Q:", 0.0, 1.0)]
    rng = random.Random(9)
    parts = ["Q:", "A :", "Q", ": x", "Answer:", "pregunta:", "Ana:", "Ana Bo :", "Ñandú:", "foo bar", "so", "\n", "\n", "\n\n", " ", "\t", "\n \n", "B:", "\nQ: why", "\nAna: hi"]
    texts = [(k, "".join(rng.choice(parts) + rng.choice(["", "\n", " "]) for _ in range(rng.randrange(25))), rng.choice([None, None, "qa_structured", "speaker_transcript", "freeform"])) for k in range(500)]
    found = {}
    for r in chunks.utterances_from_text(spark.createDataFrame(texts, "source_id long, text string, hint string"), "hint", whole=True).orderBy("source_id", "turn").collect():
        found.setdefault(r["source_id"], []).append((r["speaker"], r["text"]))
    assert found == {k: x for k, text, kind in texts if (x := _plain_utterances(text, kind))}
    plain = chunks.utterances_from_text(spark.createDataFrame(texts, "source_id long, text string, hint string").drop("hint"))
    both = {(r["source_id"], r["turn"]): (r["speaker"], r["text"]) for r in plain.collect()}
    said = {(k, i): x for k, text, _ in texts for i, x in enumerate(_plain_utterances(text, None))}
    assert both == said and {"Q", "A", "Ana", "Ana Bo", "Speaker"} <= {x for x, _ in said.values()}
    values = ", ".join(f"({k}, '{text}')" for k, text, _ in texts)
    sql = f"WITH text_sources(source_id, text) AS (VALUES {values}), {PLAIN_UTTERANCES}\nSELECT source_id, turn, speaker, text FROM plain_utterances"
    assert {(k, i): (who, text) for k, i, who, text in duckdb.sql(sql).fetchall()} == said


@pytest.mark.parametrize("repeats", [0, 70])
def test_ledger_is_the_plain_one_and_reads_few_texts(spark, repeats):
    """Edges that repeat mentions of their source are left out, more of them than are looked at first."""
    rng = random.Random(repeats)
    sources = [(k, k % 2, "COMPLETED" if k % 7 else "FAILED") for k in range(90)]
    mentions = [(f"e{rng.randrange(12)}", rng.randrange(90), f"c{rng.randrange(40)}" if rng.random() < 0.8 else None, rng.choice(["positive", "negative"])) for _ in range(250)]
    mentions += [("e1", k, f"x{k}", "neutral") for k in range(repeats)]
    chunks_ = [(f"c{k}", f"Text {k % 9}") for k in range(38)] + [(f"x{k}", f"said {k}!") for k in range(repeats)]
    edges = [(f"g{k}", "a", "b", "ally", k % 90, round(rng.random(), 3), rng.choice(["Text 3", "tax 1", None]), "pending") for k in range(120)]
    edges += [(f"h{k}", "a", "b", "ally", k, 2.0, f"Said {k}", "approved") for k in range(repeats)]
    entities = [(f"e{k}", f"Name {k}") for k in range(11)]  # e11 has no name
    roots = [(f"e{k}", f"e{k - k % 2}" if k < 10 else f"e{k}") for k in range(12)]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    out = reports.evidence_ledger(
        frame(mentions, "entity_id string, source_id long, chunk_id string, sentiment string"),
        frame(edges, "id string, source_entity_id string, target_entity_id string, relation_type string, source_id long, confidence double, evidence_text string, review_status string"),
        frame(sources, "id long, project_id long, status string"), frame(entities, "id string, name string"), frame(chunks_, "id string, content string"), frame(roots, "id string, root_id string"), 18, 30,
    )
    project, text, name, root = {k: p for k, p, status in sources if status == "COMPLETED"}, dict(chunks_), dict(entities), dict(roots)
    fame, groups = {}, {}
    for e, at, c, mood in mentions:
        if at in project:
            key = (project[at], root[e])
            fame[key] = fame.get(key, 0) + 1
            groups.setdefault((*key, at), []).append((c is None, c or "", text.get(c) or "", mood, text.get(c)))
    rows = [(p, 0, -fame[p, r], r, at, min(g)[4] or name[r], f"Entity mention with {min(g)[3]} sentiment") for (p, r, at), g in groups.items() if r in name]
    rows += [(project[at], 1, -conf, i, at, why or "a ally b", kind) for i, _, _, kind, at, conf, why, _ in edges if at in project]
    seen, want = set(), []
    for row in sorted(rows):
        key = (row[0], row[4], row[5].lower().replace("!", "").strip())
        if key not in seen:
            seen.add(key)
            want.append(row)
    for p in (0, 1):
        kept = [r for r in want if r[:2] == (p, 0)][:18]
        kept = (kept + [r for r in want if r[:2] == (p, 1)])[:30]
        got = {r["evidence_id"]: (r["source_id"], r["excerpt"], r["note"]) for r in out.where(F.col("project_id") == p).collect()}
        assert got == {f"EV-{k}": (r[4], r[5], r[6]) for k, r in enumerate(kept, 1)}


def test_ids_of_edges_are_made_after_the_joins(spark, sf_dir):
    from terracite.plans.catalogue import QUERIES

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("edges_named", "project_graph_edges"):
            plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
            assert plan.index("concat_ws(|") < plan.index("Join"), name  # the root comes first
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_retyped_edges_settle_by_key_in_one_pass(spark):
    columns = "id string, source_entity_id string, target_entity_id string, relation_type string, source_id long, confidence double, evidence_text string, review_status string, origin string"
    edges = [(i, s, "b", kind, at, 0.5, f"why {i}", "pending", "llm") for i, s, kind, at in [("1", "a", "ally", 1), ("2", "a", "supplier", 1), ("3", "c", "ally", 2), ("4", "d", "ally", None), ("5", "e", "ally", 3), ("6", "e", "ally", 3)]]
    requests = [("1", "supplier"), ("3", "advisor"), ("3", "advisor"), ("3", "supplier"), ("3", "ally"), ("4", "advisor"), ("2", None), ("9", "advisor")]
    out = editorial.retype_edges(spark.createDataFrame(edges, columns), spark.createDataFrame(requests, "id string, new_type string"))
    got = sorted((r["source_entity_id"], r["relation_type"], r["id"], r["review_status"], r["confidence"], r["evidence_text"]) for r in out.collect())
    assert got == [
        ("a", "ally", "1", "rejected", 0.5, "why 1"), ("a", "supplier", "a|b|supplier|1", "approved", 1.0, "why 1"), ("c", "advisor", "c|b|advisor|2", "approved", 1.0, "why 3"), ("c", "ally", "3", "rejected", 0.5, "why 3"),
        ("c", "supplier", "c|b|supplier|2", "approved", 1.0, "why 3"), ("d", "advisor", "d|b|advisor", "approved", 1.0, "why 4"), ("d", "ally", "4", "rejected", 0.5, "why 4"), ("e", "ally", "5", "pending", 0.5, "why 5"), ("e", "ally", "6", "pending", 0.5, "why 6"),
    ]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_best_intel_sorts_rows_once(spark, sf_dir):
    from terracite.sources.model import Model

    m, held = Model(spark, sf_dir), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = search.best_intel(m.mentions, m.source_entities, m.edges, m.sources, m.chunks)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    sorts = re.findall(r"Sort \[source_id#\d+L ASC NULLS FIRST(.)", plan)
    assert "SortMergeJoin [source_id#" in plan and sorts == [",", ","]  # each side once, for its window; the join adds none


def test_best_intel_on_odd_rows(spark):
    """The rows of best_role of entity_intel: sources that are missing, null or repeat, roles that are unknown, evidence that is null."""
    mentions = spark.createDataFrame([("P1", 1, "1-1", "neutral"), ("P1", 1, None, None), ("P2", 9, "1-1", None), ("P3", None, "x", None), ("P4", 2, "gone", "positive")], "entity_id string, source_id long, chunk_id string, sentiment string")
    links = spark.createDataFrame([(1, "P1", "author", "extraction", None), (1, "P2", "witness", "upload_anchor", "e"), (2, "P4", "witness", "x", None), (2, None, "author", "x", "q")], "source_id long, entity_id string, link_type string, origin string, evidence string")
    edges = spark.createDataFrame([("P1", "P2", 1, "tax 1", "approved"), ("P4", "P4", 2, None, "pending"), ("P5", "P6", 1, None, "rejected")], "source_entity_id string, target_entity_id string, source_id long, evidence_text string, review_status string")
    chunks = spark.createDataFrame([("1-1", "b"), ("x", None)], "id string, content string")
    sources = spark.createDataFrame([(1, "one", "2020-01-01", "2020-01-02"), (2, None, None, "2020-01-02"), (2, None, None, "2020-01-02"), (None, "none", None, None)], "id long, title string, conducted_at string, created_at string")
    args = (mentions, links, edges, sources, chunks)
    want, got = ranking.best_role(search.entity_intel(*args)), search.best_intel(*args)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 4
    apart = search.entity_intel(*args, few=True)
    assert sorted(map(str, apart.collect())) == sorted(map(str, search.entity_intel(*args).collect()))
