"""Operators against plain Python on small tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from terracite.llm import entries, mixing, packing, private, repetition, simhash
from tests.compare import same


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, name):
    same(entries.QUERIES[name](spark, sf_dir).toPandas(), entries.ORACLE_SQL[name], sf_dir)


def test_shards(spark, sf_dir, texts):
    got = entries.op2_shards(spark, sf_dir).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len(t.encode()) + 1 for t in texts.values())
    assert max(abs(s - sum(sizes.values()) / 16) for s in sizes.values()) <= largest
    order = [r["shard"] for r in sorted(got, key=lambda r: r["doc_id"])]
    assert order == sorted(order)


def fingerprint(text, k):
    words = text.encode().lower().split()
    runs = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    votes = [0] * 64
    for run in runs:
        h = xxhash.xxh64_intdigest(run, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(runs))


def joined(items, linked):
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_simhash(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in entries.op3_simhash(spark, sf_dir).collect()}
    ids = sorted(texts)
    codes = [fingerprint(texts[i], 3) for i in ids]
    assert [int(got[i]["fingerprint"], 16) for i in ids] == codes
    roots = joined(codes, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [got[i]["component_id"] for i in ids] == [ids[r] for r in roots]


@pytest.mark.parametrize("spread", [3, 9, 64])
def test_gray_index_joins_what_all_pairs_join(spread):
    rng = random.Random(spread)
    base = rng.getrandbits(64)
    codes = sorted({base ^ sum(1 << rng.randrange(spread) for _ in range(rng.randrange(6))) if spread < 64 else rng.getrandbits(64) & 0xFFFF for _ in range(700)})
    found = simhash.link_group(np.array(codes, dtype=np.uint64), 2)
    assert len(found) < len(codes)
    pairs = {(min(a, b), max(a, b)) for a, b in found}
    mine = joined(list(range(len(codes))), lambda i, j: (min(i, j), max(i, j)) in pairs)
    assert mine == joined(codes, lambda a, b: (a ^ b).bit_count() <= 2)


@pytest.mark.parametrize("bits", [64, 32])
@pytest.mark.parametrize("made", ["low bits", "equal top", "two free bits"])
def test_large_groups_are_divided(spark, monkeypatch, bits, made):
    monkeypatch.setattr(simhash, "GROUP", 20)
    rng = random.Random(1)
    code = {
        "low bits": lambda: (rng.getrandbits(10) << 50) | rng.getrandbits(4),
        "equal top": lambda: 0xABCDEF12 << 32 | rng.getrandbits(32),
        "two free bits": lambda: rng.getrandbits(12) << 34 | rng.getrandbits(2) << 62 | rng.getrandbits(8),
    }[made]
    codes = sorted({code() for _ in range(400)})
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    rows = spark.createDataFrame([(0, c, c, None, 0.0) for c in signed], "space int, code long, node long, sketch binary, slack double")
    at = {c: i for i, c in enumerate(signed)}
    pairs = {tuple(sorted((at[r["a"]], at[r["b"]]))) for r in simhash.links(rows, 2, bits).collect()}
    mine = joined(list(range(len(codes))), lambda i, j: (min(i, j), max(i, j)) in pairs)
    assert mine == joined(codes, lambda a, b: ((a ^ b) >> (64 - bits)).bit_count() <= 2)


def runs_of(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def edited(rng, words, word, least):
    """The words with single words changed, or a passage put in, one after the other, while the similarity is at least that."""
    now, base = list(words), runs_of(" ".join(words))
    for _ in range(400):
        then = list(now)
        if rng.random() < 0.3:
            then.append(word())
        else:
            then[rng.randrange(len(then))] = word()
        if jaccard(runs_of(" ".join(then)), base) < least:
            return now
        now = then
    return now


def test_near_copies_at_the_threshold(spark):
    """Of pairs that are just similar enough, nearly all are found, and no group holds a document that none of it links to."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    plain = [[word() for _ in range(n)] for n in [9, 12, 14, 20, 27, 35] * 10 + [rng.randrange(60, 400) for _ in range(240)]]
    copies = [edited(rng, t, word, 0.8) for t in plain]
    apart = [edited(rng, t, word, 0.74) for t in plain[::3]]
    odd = ["", "  ", "one", "two", "ONE", "a b", "same passage here " * 9, ("same passage here " * 3).strip()]
    texts = [" ".join(t) for t in plain + copies + apart] + odd
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r["doc_id"]: r["group"] for r in simhash.near_duplicates(df).collect()}
    sets = [runs_of(t) for t in texts]
    n = len(plain)
    alike = [i for i in range(n) if jaccard(sets[i], sets[n + i]) >= 0.8]
    assert len(alike) == n and sum(group[i] == group[n + i] for i in alike) >= 0.95 * n
    assert all(group[i] == group[n + i] for i in range(n) if len(sets[i]) <= 24)
    want = joined(sets, lambda a, b: jaccard(a, b) >= 0.8)
    mine = joined(list(range(len(texts))), lambda i, j: group[i] == group[j])
    by_root = defaultdict(set)
    for i, r in enumerate(want):
        by_root[r].add(i)
    assert all(want[i] == want[m] for i, m in enumerate(mine))  # nothing is joined that is not linked
    assert sum(a == b for a, b in zip(want, mine, strict=True)) > 0.98 * len(texts)
    base = 2 * n + len(apart)
    assert group[base] == group[base + 1] and group[base + 2] == group[base + 4] != group[base + 3] and group[base + 6] == group[base + 7]


def test_large_groups_of_near_copies(spark, monkeypatch):
    """With small blocks, the classes inside a group of candidates are those of all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(6)
    for spread in (0.9, 0.8, 0.5):
        base = [rng.getrandbits(60) for _ in range(60)]
        sets = [frozenset(x if rng.random() < spread else rng.getrandbits(60) for x in base) for _ in range(20)]
        sets += [frozenset(x if rng.random() < 0.95 else rng.getrandbits(60) for x in rng.choice(sets)) for _ in range(130)]
        rows = [(1, i, len(s), np.sort(np.array(list(s), dtype=np.uint64)).tobytes()) for i, s in enumerate(sets)]
        got = {r["node"]: r["root"] for r in simhash.decided(spark.createDataFrame(rows, "group long, node long, bytes int, set binary"), 0.8).collect()}
        assert [got.get(i, i) for i in range(len(sets))] == joined(sets, lambda a, b: jaccard(a, b) >= 0.8)


def test_one_of_each_group_stays(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(120)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts + [t.upper() for t in texts[:20]])), "doc_id long, text string")
    from pyspark.sql import functions as F

    rows = df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").alias("n_chars"))
    kept = simhash.keep_one(rows.unionByName(rows), tuple(rows.columns))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(40))


def repeats(words, least):
    """Maximal repeats by trying every pair of places."""
    n, spans, longest, found = len(words), set(), 0, set()
    for i in range(n):
        for j in range(i):
            if words[i] == words[j] and (j == 0 or words[i - 1] != words[j - 1]):
                k = 0
                while i + k < n and words[i + k] == words[j + k]:
                    k += 1
                if k >= least:
                    spans |= set(range(i, i + k)) | set(range(j, j + k))
                    longest = max(longest, k)
                    found.add(tuple(words[i : i + k]))
    return len(spans), longest, len(found)


def test_repetition(spark, sf_dir):
    rng = random.Random(3)
    some = [" ".join(rng.choice("ab cd ef gh".split()) for _ in range(n)) for n in (0, 3, 40, 120)] + ["x y z " * 60, "a b c d e f g h i j " + "q r s t u v w " * 3, "same " * 150]
    some += [" ".join(f"w{k}" for k in range(400)) + " copied passage of eight words stands here twice" * 2, " ".join(f"w{k}" for k in range(90)) + " again" + " ".join(f" w{k}" for k in range(80)), " ".join(f"v{k}" for k in range(150)) + " mid " + " ".join(f"v{k}" for k in range(150))]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    for r in repetition.apply_rules(df).collect():
        words = some[r["doc_id"]].split()
        covered, longest, n_repeats = repeats(words, 5)
        assert (round(r["repeat_fraction"] * max(1, len(words))), r["longest_repeat"], r["n_repeats"]) == (covered, longest, n_repeats)
        assert r["kept"] == (not r["base_failed"] and covered <= 0.3 * len(words) and longest <= 100)
    duck = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r for r in entries.op4_repetition(spark, sf_dir).collect()}
    for i, text in duck:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        three = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        twice = Counter(three)
        inside = {k + d for k, w in enumerate(three) if twice[w] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (len(words) < 50 or 100 * len(inside) > 50 * len(words))


def test_a_text_of_one_word_a_million_times_is_no_burden(spark):
    rows = spark.createDataFrame([(1, "word " * 1_000_000)], "doc_id long, text string")
    began = time.time()
    r = repetition.apply_rules(rows).first()
    assert time.time() - began < 60 and (r["n_words"], r["longest_repeat"], r["repeat_fraction"], r["kept"]) == (1_000_000, 999_999, 1.0, False)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    count = lambda s: sum(c.isdigit() for c in s)
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= count(m[0]) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= count(m[0]) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)


ODD = [
    "a@b.c.@d.e x..y@q.z-.w a@b..c@d.e @x.y a@b-.c", "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 1.2.3 00001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 12345678901234567890 4111111111111111 1",
    "+1 (743) 555-3824, +12 +123456789012345678 +1--2 ++49 30 1234567", "\U0001f600  mail: é.x@y.zz @.b +49 30 901820 ", "1" * 300, "a." * 400 + "@b.c", "x@" + "y." * 300,
]


def test_base_spans(spark, docs):
    rng = random.Random(2)
    made = ["".join(rng.choice("a1@.-+ (5)%_9") for _ in range(60)) for _ in range(400)]
    some = ODD + made
    df = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "doc_id long, text string")
    for r in private.digest(private.find_private(df, accept=2.0)).collect():
        want = base(some[r["doc_id"]])
        assert r["spans"] == want, some[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_context_finds_what_patterns_miss(spark):
    rows = [(i, f"write to mailbox: user{i}@corp{i}.example.org today please") for i in range(30)]
    rows += [(100, "write to mailbox: admin@intranet today please"), (101, "the admin@local went home"), (102, "we met 5550199 men"), (103, "nothing")]
    got = {r["doc_id"]: r["spans"] for r in private.digest(private.find_private(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[100] == "email:18:32" and not got[101] and not got[102] and not got[103]
    masked = private.redacted(spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")).collect()
    text = {r["doc_id"]: r["text"] for r in masked}
    assert text[100] == "write to mailbox: [EMAIL] today please" and text[3] == "write to mailbox: [EMAIL] today please" and len(text) == len(rows)


def test_context_finds_identifiers_of_other_forms(spark):
    """Handles, names, document numbers and secrets in places where known identifiers stand; the same words elsewhere stay."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, planted, clean = [], {}, set()
    for i in range(400):
        a, b = prose(20), prose(15)
        kind = i % 8
        if kind < 3:
            rows.append((i, f"{a} contact: user{i}@corp{i}.example.org {b}"))
        elif kind == 3:
            rows.append((i, f"{a} token = \"{rng.getrandbits(100):x}7\" {b}"))
        elif kind == 4 and i % 16 == 4:
            value = rng.choice([f"jane_doe{i}", f"Zoe{word()}", f"@handle{i}", f"ID-{i}77"])
            rows.append((i, f"{a} contact: {value} {b}"))
            planted[i] = f"other:{len(a) + 10}:{len(a) + 10 + len(value)}"
        elif kind == 5:
            rows.append((i, f"{a} bearer {rng.getrandbits(100):x}8 {b}" if i % 16 == 5 else f"{a} token = \"{rng.getrandbits(90):x}4\" then bearer {rng.getrandbits(90):x}4 {b}"))
        else:
            rows.append((i, f"{a} Zoe{word()} and part {i} of ID-{i}77 {b}"))
            clean.add(i)
    got = {r["doc_id"]: r for r in private.digest(private.find_private(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert sum(got[i]["others"] == planted[i] for i in planted) >= 0.9 * len(planted)
    assert not any(got[i]["others"] or got[i]["spans"] for i in clean)
    assert all(got[i]["others"].startswith("secret:") for i in range(400) if i % 8 == 3)
    found = sum(len(r["others"].split(",")) for r in got.values() if r["others"])
    right = sum(1 for i in planted if got[i]["others"] == planted[i]) + sum(len(got[i]["others"].split(",")) for i in range(400) if i % 8 in (3, 5) and got[i]["others"])
    assert right >= 0.95 * found


def test_packing(spark, sf_dir, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = {10**6 + k: t for k, t in enumerate(["", "a  b", "x<|endoftext|> y", "日本語 text z", "tab\t t", "it's we'll", " lead", "trail ", " q"])}
    df = spark.createDataFrame(list({**texts, **odd}.items()), "doc_id long, text string")
    rows = packing.pack(df).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in {**texts, **odd}.items():
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        place = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == place and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[place : place + r["length"]].tobytes())
            place += r["length"]
        assert place == len(ids)
    for pieces in by_sequence.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 2048
    assert sum(r["length"] for r in rows) > 0.95 * 2048 * len(by_sequence)


def test_mixing_with_unequal_weights(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(5, 60), f"s{i % 4}", rng.choice([0.5, 1.0, 2.0])) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, liking double")
    got = mixing.mix_sources(df, weight_col="liking").collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)
    liked = defaultdict(list)
    for r in got:
        if r["source"] == "s0":
            liked[rows[r["doc_id"]][3]].append(r["copies"])
    means = [np.mean(liked[k]) for k in (0.5, 1.0, 2.0)]
    assert means[0] < means[1] < means[2]
    again = mixing.mix_sources(df.repartition(7), weight_col="liking").collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_inclusion_follows_the_odds(spark):
    """40 sources of the same sizes are as many draws: the mean copies of documents of one size are near what is expected."""
    rng = random.Random(9)
    sizes = [rng.choice([20, 40, 80, 400]) for _ in range(500)]
    rows = [(1000 * s + i, f"{s} {i} " + "w " * (n - 2), f"s{s:03}") for s in range(40) for i, n in enumerate(sizes)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(3, 1)).collect()
    total, own = sum(sizes), [10_000 // (n + 100) ** 0.5 for n in sizes]
    for odd, target in ((0, 1.5 * total), (1, 0.5 * total)):
        rate = target / sum(n * w for n, w in zip(sizes, own, strict=True))
        assert max(own) * rate <= 3
        by_size = defaultdict(list)
        for r in got:
            if int(r["source"][1:]) % 2 == odd:
                assert abs(r["target"] - target) < 1e-6
                by_size[r["size"]].append(r["copies"])
        for n, copies in by_size.items():
            want = rate * own[sizes.index(n)]
            assert abs(np.mean(copies) - want) < 0.05 + 0.05 * want, (odd, n, np.mean(copies), want)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    langs = [r for r in entries.op5_languages(spark, sf).collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in langs)
    held = [r for r in langs if r["held_out"]]
    assert np.mean([docs[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.98
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in entries.op9_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([r["predicted"] == marks[r["doc_id"]] for r in held]) > 0.95


def test_excerpts_are_found(spark, sf_dir):
    got = [r for r in entries.op8_audio(spark, sf_dir).collect() if r["links"] is not None]
    assert len(got) == 25 and all(r["best_class"] == r["id"] and r["best_offset"] in (26, 27) and r["best_error"] < 0.2 for r in got)
