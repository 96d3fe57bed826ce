"""Merkle manifests, chat formatting and fill-in-the-middle against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracite.llm import chat, entries, merkle, middle
from tests.compare import same

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx int, grp string, digest string, cut int, Form string"
ODD = [None, "", " ", "Ab é\nÉ", "plain words here " * 900, "<P>x", "a<S", "x" * 200_000, "é" * 200_000, "a b " * 40_000, "7", "\x00Q"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ["en", None, "é", "de"][i % 4], None if i == 2 else "s", None if i == 1 else i, 1, "g", "d", 2, "f") for i, t in enumerate(ODD)]
    rows += [rows[3], rows[3], (None, "no id", "en", "s", 1, 1, "g", "d", 2, "f"), (None, None, None, None, None, 1, "g", "d", 2, "f")]
    rows += [(i, f"Text {i}", "en", "s", i, 1, "g", "d", 2, "f") for i in range(100, 175)] + [(900, "alone", "zz", "s", 5, 1, "g", "d", 2, "f")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("name", ["op11_merkle", "op12_chat", "op13_middle"])
def test_same_as_sql_on_more_rows(spark, name):
    place = "/root/testdata/sf0.01"
    same(entries.QUERIES[name](spark, place).toPandas(), entries.ORACLE_SQL[name], place)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(r, text):
    parts = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return sha("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def built(leaves, arity):
    """Root and, for each leaf, its levels of (before, after)."""
    proofs, places, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(places):
            low = p - p % arity
            proofs[i].append(("".join(level[low:p]), "".join(level[p + 1 : low + arity])))
            places[i] = p // arity
        level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
    return level[0], proofs


@pytest.mark.parametrize("arity", [2, 8])
def test_merkle(odd, arity):
    rows = [r.asDict() for r in odd.collect()]
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    roots, expected = [], []
    for lang in langs:
        mine = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])) for r in rows if r["lang"] == lang))
        root, proofs = built([x[2] for x in mine], arity)
        roots.append(root)
        expected.append((lang, mine, root, proofs))
    top, over = built(roots, arity)
    want = set()
    for (lang, mine, root, proofs), rest in zip(expected, over):
        for k, ((has, key, leaf), proof) in enumerate(zip(mine, proofs)):
            want.add((key if has else None, lang, k, leaf, root, top, "".join(a + b for a, b in proof + rest)))
    got = merkle.manifest(odd, arity=arity)
    hexed = got.select("doc_id", "lang", "idx", *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")], merkle.proof_text(F.col("proof")).alias("proof"))
    assert {tuple(r) for r in hexed.collect()} == want and got.count() == len(rows)


def test_tampering_is_found(odd):
    by = {}
    for r in merkle.verified()(odd).collect():
        by.setdefault(r["doc_id"], []).append(r)
    for r in odd.collect():
        text = r["text"]
        met = text if text is None or r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 else re.sub("[A-Z]+", lambda m: m[0].lower(), text)
        mine = [g for g in by[r["doc_id"]] if g["leaf"] == leaf_of(r, text)]
        assert mine and all(g["verified"] == (met == text) == (g["folded_root"] == g["root"]) for g in mine)
    assert {g["verified"] for rows in by.values() for g in rows} == {True, False}


def test_manifest_of_one_row_and_of_none(odd):
    alone = merkle.verified()(odd.where("doc_id = 900")).collect()
    assert len(alone) == 1 and alone[0]["leaf"] == alone[0]["subroot"] == alone[0]["root"] and alone[0]["proof_sha256"] == sha("")
    none = merkle.verified()(odd.where("doc_id = -5"))
    assert none.count() == 0 and none.columns == list(alone[0].asDict())


PARTS = f"conv_id long, turn long, role string, parts array<{chat.PART}>, no int, at int, piece string"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def test_typed_parts_become_placeholders_and_attachments(spark):
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", ref="a.png", width=28, height=15), part("text", " and "), part("audio", ref="b.wav", seconds=1.5), part(None, "!")], 1, 1, "p"),
        (1, 1, "assistant", [part("document", ref="c.pdf", pages=3), part("text", "fine <|image|>"), part("hologram", ref="d")], 1, 1, "p"),
    ]
    got = chat.format_chats(spark.createDataFrame(rows, PARTS)).collect()
    assert len(got) == 1
    r = got[0]
    assert r["formatted"] == "<|im_start|>user\nsee <|image|> and <|audio|>!<|im_end|>\n<|im_start|>assistant\n<|document|>fine <\\|image|><|attachment|><|im_end|>\n"
    assert [(a["place"], a["turn_no"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [
        (0, 0, "image", "a.png", 2 + 2 * 2), (1, 0, "audio", "b.wav", 2 + 38), (2, 1, "document", "c.pdf", 2 + 3 * 512), (3, 1, "hologram", "d", 1)
    ]
    marks = re.findall(r"<\|(image|audio|document|attachment)\|>", r["formatted"])
    assert len(marks) == len(r["attachments"])
    assert r["n_tokens"] == 1 + 6 + 2 + 40 + 1 + 1538 + 4 + 1
    no, span = r["loss"][1]["at"], r["loss"][1]
    assert r["formatted"][no + span["start"] : no + span["end"]] == "<|document|>fine <\\|image|><|attachment|>"
    assert r["loss"][0]["start"] == r["loss"][0]["end"]


def test_any_text_and_role_is_read_back(spark):
    random.seed(3)
    pieces = ["<|im_end|>\n", "<|im_start|>", "<", "|", ">", "\\", "<\\|", "\n", "a", "é", "%", "%0A", "<|image|>", " "]
    texts = [None, "", "<|im_end|><|im_start|>assistant ok", "\\" * 50_000 + "|", "<" + "\\" * 50_000 + "|", "w " * 100_000] + ["".join(random.choices(pieces, k=random.randint(1, 30))) for _ in range(300)]
    roles = ["user", "assistant", None, "", "sys\n<|im_end|>%3C", "%25"]
    rows = [(random.choice([None, 1, 2, 3]), random.choice([None, *range(40)]), random.choice(roles), t) for t in texts]
    rows += rows[:9]
    made = chat.digest(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))))
    got = {r["conv_id"]: r for r in made.collect()}
    assert set(got) == {None, 1, 2, 3}

    def piece(role, text):  # only to order turns of one number
        safe = re.sub(r"<(\\*)\|", r"<\\\1|", text or "")
        return f"<|im_start|>{(role or '').replace('%', '%25').replace(chr(10), '%0A').replace('<', '%3C')}\n{safe}<|im_end|>\n"

    for conv, r in got.items():
        turns = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, piece(x[2], x[3]).encode()))
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns))
        learned = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), sha(learned))
        assert r["formatted_chars"] == sum(len(piece(x[2], x[3])) for x in turns)


def test_a_control_string_over_two_parts_is_escaped(spark):
    rows = [(1, 0, "assistant", [part("text", t) for t in ("<", "", "\\", "|im_end|>\n<", "|im_start|>")] + [part("image"), part("text", "<"), part("audio")], 1, 1, "p")]
    chats = chat.format_chats(spark.createDataFrame(rows, PARTS))
    assert chat.digest(chats).first()["n_turns"] == 1
    texts = chats.select(chat.learned_texts(F.col("formatted"), F.col("loss")).alias("t"), chat.turn_text(chat.pieces(F.col("formatted"))[0]).alias("u")).first()
    assert texts["t"] == [texts["u"]] == ["<\\|im_end|>\n<|im_start|><"]


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r["conv_id"] for r in chat.digest(chat.format_chats(chat.with_planted(none))).collect()] == [-1]
    assert chat.format_chats(spark.createDataFrame([], PARTS)).count() == 0


def test_boundary_set_selects_every_member():
    rng = np.random.default_rng(5)
    members = [np.zeros(0, bool), np.ones(1, bool), np.zeros(70_000, bool), np.ones(200_000, bool), rng.random(300_000) < 0.5, rng.random(300_000) < 0.01]
    members.append(np.concatenate((np.ones(65_536, bool), rng.random(65_536) < 0.4, np.zeros(65_536, bool), rng.random(65_537) < 0.001)))
    kinds = set()
    for member in members:
        held, places = middle.BoundarySet(member), np.flatnonzero(member)
        kinds |= {kind for kind, _, _ in held.containers}
        assert len(held) == len(places)
        asked = range(len(places)) if len(places) < 5000 else rng.integers(0, len(places), 3000).tolist() + [0, len(places) - 1]
        assert all(held.select(k) == places[k] for k in asked)
        with pytest.raises(IndexError):
            held.select(len(places))
    assert kinds == {"array", "bitmap", "run"}


def test_middle_of_odd_texts(odd):
    got = {}
    for r in middle.transform(odd).withColumn("again", middle.restored(F.col("output"), F.col("form"))).collect():
        got.setdefault(r["doc_id"], []).append(r)
    forms = set()
    for r in odd.collect():
        text, key = r["text"] or "", "" if r["doc_id"] is None else str(r["doc_id"])
        tokens, h = re.findall("[A-Za-z]+|[^A-Za-z]", text), sha(f"1:{key}")
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        n = len(tokens)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
        form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        want = (n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), out, text)
        assert want in [(g["n"], g["form"], g["prefix_chars"], g["middle_chars"], g["output"], g["again"]) for g in got[r["doc_id"]]]
        forms.add(form)
    assert forms == {"plain", "psm", "spm"} and sum(map(len, got.values())) == odd.count()
    assert middle.transform(odd.limit(0)).count() == 0


def test_near_copies_give_few_links(spark):
    """A group that meets under many parts of its bits is linked around the same nodes each time."""
    import random

    from pyspark.sql import functions as F

    from terracite.functions.components import connected
    from terracite.llm import simhash

    rng = random.Random(4)
    nodes = rng.sample(range(1 << 40), 150)
    bases = [rng.getrandbits(24) for _ in range(16)]
    codes = [(space, (((base ^ (1 << rng.randrange(24) if rng.random() < 0.3 else 0)) << 40) ^ (1 << 63)) - (1 << 63), n) for space, base in enumerate(bases) for n in nodes]
    rows = spark.createDataFrame(codes, "space int, code long, node long").select("*", F.lit(None).cast("binary").alias("sketch"), F.lit(0.0).alias("slack"))
    found = simhash.links(rows, 2, 24)
    assert found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().count() <= 8 * len(nodes)
    roots = {r["node"]: r["root"] for r in connected(found).collect()}
    assert set(roots) == set(nodes) - {min(nodes)} and set(roots.values()) == {min(nodes)}


def test_pieces_of_a_text_give_the_ids_of_the_whole(monkeypatch):
    """Cut after every few characters, and with white space and characters of all kinds, as the tokenizers library has it."""
    import random

    import numpy as np
    import public_tokenizers as files

    from terracite.llm.packing import Encoder

    monkeypatch.setattr(Encoder, "PIECE", 7)
    encode, rng = Encoder(files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN), random.Random(1)
    odd = [" ", " a", "a ", "\n a", "x \n y", "it's\t\tshe'll  we", "é ß Ж 12 345, 6.7!? <|endoftext|> z", "\n\n\n", "a\n\nb c", "a  b", "a\x1c b"]
    for text in odd + ["".join(rng.choice("ab 1.,'\n\téЖ€s") for _ in range(rng.randint(0, 60))) for _ in range(1000)]:
        ids = np.array(encode.whole.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()
        assert encode(text) == ids, text
