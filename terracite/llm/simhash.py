"""SimHash near-duplicates through a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracite.functions.components import connected
from terracite.llm.audio import small_batches
from terracite.session import cut, pick, small

#: Codes of one leaf of the index, and children of one upper node.
FAN = 32
#: Codes that one group of the index may hold before it is divided by more of its bits, or searched in blocks.
GROUP = 65_536
#: Distinct runs up to which a text is compared by its smallest runs, as a SimHash of few runs is coarse.
FEW = 30
#: Members of near copies, and bytes of their runs, that are compared in one block.
BLOCK, BLOCK_BYTES = 128, 16 << 20
#: Rows that go to Python at a time.
ROWS = 2000
#: Bytes between the parts of a sketch that are searched, and bits of one part.
STRIDE, WIDTH = 4, 24
#: Bytes of a sketch that go to each group of each part; enough to part what differs, as the sets decide in the end.
CARRIED = 32
#: Bytes of a text whose words are made at a time.
PIECE = 1 << 22
#: Odd multipliers that derive more hash words from one: fixed values without meaning.
MORE_WORDS = (np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


# Fingerprints


def word_blocks(text: str) -> Iterator[list[bytes]]:
    """The words of a text with A-Z in lower case, a few MB of text at a time."""
    raw, start = text.encode("utf-8", "surrogatepass"), 0
    while start < len(raw):
        end = start + PIECE
        while end < len(raw) and raw[end] not in b" \t\n\x0b\f\r":
            end += 1
        yield raw[start:end].lower().split()
        start = end


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every run of ``words`` words; of the whole sequence if the text has fewer words."""
    held: list[bytes] = []
    whole = True
    for block in word_blocks(text or ""):
        held += block
        if len(held) >= words:
            whole = False
            runs = zip(*(held[i:] for i in range(words)), strict=False)
            yield np.array([xxhash.xxh64_intdigest(b" ".join(x), 42) for x in runs], dtype=np.uint64)
            held = held[len(held) - words + 1 :]
    if whole and held:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), 42)], dtype=np.uint64)


def majority(hashes: Iterator[np.ndarray], wide: bool) -> np.ndarray:
    """Bits set in over half of the hashes, as uint64 words: the hash itself, or eight words derived from it."""
    total, votes = 0, np.zeros(512 if wide else 64, dtype=np.int64)
    for every in hashes:
        for at in range(0, len(every), 4096):
            h = every[at : at + 4096, None]
            if wide:
                h = h * MORE_WORDS
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(29)
            bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
            for part in range(0, len(bits), 255):  # 255 ones fit a byte
                votes += bits[part : part + 255].sum(0, dtype=np.uint8)
            total += len(h)
    return np.packbits(2 * votes > total, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and 64-bit SimHash (as a signed long) of each whole text; zero for a null text or one without words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            codes = np.array([majority(shingle_hashes(t, words), False)[0] for t in frame["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "code": codes})

    return pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(run, "doc_id long, code long")


# Index of one group


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order, in which neighbours differ in few bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def factor(values: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents of runs of FAN nodes: the bits on which all children agree (mask) and what they are (value)."""
    starts = np.arange(0, len(values), FAN)
    first = np.repeat(values[starts], np.diff(np.append(starts, len(values))))
    differ = np.bitwise_or.reduceat(values ^ first, starts)
    shared = np.bitwise_and.reduceat(masks, starts) & ~differ
    return values[starts] & shared, shared


def link_group(codes: np.ndarray, radius: int, sketches: np.ndarray | None = None, slack: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Stars, as places in ``codes``, that join all codes of a group within ``radius`` bits of each other.

    The codes stand in Gray order; each leaf holds FAN of them and its shared masked pattern, each upper node the
    pattern shared by FAN children. Pairs of nodes are searched from the top: a pair whose shared bits already differ
    in over ``radius`` places is left with all that is under it, and the differences found so far are handed down, so
    a child counts only the bits that its parent did not share. With sketches, those of a pair must also differ in at
    most as many bits as both have slack. Each code that does not stand for its class is returned with the one that does.
    """
    n, full = len(codes), np.uint64(0xFFFFFFFFFFFFFFFF)
    order = np.argsort(gray_rank(codes), kind="stable")
    codes = codes[order]
    if sketches is not None:
        sketches, slack = sketches[order], slack[order]
    levels = [(codes, np.full(n, full))]
    while len(levels) == 1 or len(levels[-1][0]) > FAN:
        levels.append(factor(*levels[-1]))
    values, masks = levels[-1]
    left, right = np.triu_indices(len(values))
    met = np.zeros(len(left), dtype=np.uint64)  # bits already counted
    apart = np.zeros(len(left), dtype=np.int64)
    for depth in range(len(levels) - 1, 0, -1):
        values, masks = levels[depth]
        both = masks[left] & masks[right]
        apart = apart + np.bitwise_count((values[left] ^ values[right]) & both & ~met)
        near = apart <= radius
        left, right, met, apart = left[near], right[near], both[near], apart[near]
        if depth > 1:
            size, grid = len(levels[depth - 1][0]), np.arange(FAN)
            a = (left[:, None, None] * FAN + grid[:, None]).repeat(FAN, 2)
            b = (right[:, None, None] * FAN + grid).repeat(FAN, 1)
            ok = (a < size) & (b < size) & (a <= b)
            met, apart = (np.broadcast_to(x[:, None, None], a.shape)[ok] for x in (met, apart))
            left, right = a[ok], b[ok]
    part = np.arange(n)
    for a, b in zip((left * FAN).tolist(), (right * FAN).tolist(), strict=True):
        i, j = part[a : a + FAN], part[b : b + FAN]
        if i[0] == j[0] and (i == i[0]).all() and (j == j[0]).all():
            continue
        x, y = np.nonzero(np.bitwise_count(codes[a : a + FAN, None] ^ codes[None, b : b + FAN]) <= radius)
        x, y = x + a, y + b
        new = part[x] != part[y]
        x, y = x[new], y[new]
        if sketches is not None and len(x):
            close = np.bitwise_count(sketches[x] ^ sketches[y]).sum(1) <= slack[x] + slack[y] + 1e-9
            x, y = x[close], y[close]
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            if part[p] != part[q]:
                part[part == part[q]] = part[p]
    own = np.flatnonzero(part != np.arange(n))
    return list(zip(order[own].tolist(), order[part[own]].tolist(), strict=True))


def by_smallest(nodes: np.ndarray, stars: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The members of each star (places in ``nodes``) as nodes with the smallest of their star.

    What stands for a class is so the same wherever the same nodes meet: a group of near copies that meets under many of its bits gives nearly the
    same links each time, not new ones.
    """
    least: dict[int, int] = {}
    for i, j in stars:
        least[j] = min(least.get(j, nodes[j]), nodes[i])
    every = [(nodes[i], least[j]) for i, j in stars] + [(nodes[j], head) for j, head in least.items()]
    return [(a, b) for a, b in every if a != b]


# Distributed search


def sub_masks(mask: int, bits: int, blocks: int) -> list[int]:
    """The mask with each of ``blocks`` runs of its free bits added; the runs cover all of the top ``bits`` that are free."""
    free = [i for i in range(63, 63 - bits, -1) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[k * len(free) // blocks : (k + 1) * len(free) // blocks]) for k in range(blocks)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Frames of whole groups, and where in each frame the groups start and end; rows come sorted by the key columns."""
    held: list[pd.DataFrame] = []

    def done() -> tuple[pd.DataFrame, list[int]]:
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        key = rows[keys].to_numpy()
        return rows, np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1), [True]))).tolist()

    for frame in frames:
        if not len(frame):
            continue
        key = frame[keys].to_numpy()
        last = np.flatnonzero((key != key[-1]).any(1))
        start = int(last[-1]) + 1 if len(last) else 0
        if held and (start or (held[-1][keys].to_numpy()[-1] != key[0]).any()):
            held += [frame.iloc[:start]] if start else []
            yield done()
            held = []
        elif start:
            held = [frame.iloc[:start]]
            yield done()
            held = []
        held.append(frame.iloc[start:])
    if held:
        yield done()


def settled(
    members: DataFrame, search: Callable[[DataFrame], DataFrame], most: int, most_bytes: float = float("inf"), slim: DataFrame | None = None
) -> DataFrame:
    """Links (a, b) that join what belongs together inside each group; every pair is compared unless one class holds both.

    members: group, node, bytes, and what ``search`` needs; (group, node) is unique. slim: the first three where they are
    cheaper to have. search: for rows that have block, a number, besides, it gives group, a and b: each node a of a block
    that belongs to the class that b stands for.

    A group of at most ``most`` members and ``most_bytes`` is one block. The members of a larger one are dealt into
    blocks by a hash; then those that stand for the classes of the blocks are dealt again, as long as that lessens them
    by half; then what is not in the group's largest class meets all members, in pairs of blocks spread over tasks. So
    no task gets a large group, and a group of many near copies costs little more than one pass.
    """
    at = lambda *parts: F.xxhash64("group", *parts)
    parts_of = lambda n, size: F.greatest(F.lit(1), F.ceil(F.greatest(n / most, size / most_bytes))).cast("int")
    sized = lambda df: df.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").cast("double").alias("b"))
    place = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")

    def dealt(df: DataFrame, sizes: DataFrame, salt: int) -> DataFrame:
        several = sizes.select("group", parts_of(F.col("n"), F.col("b")).alias("parts")).where("parts > 1")
        parts = F.coalesce("parts", F.lit(1))
        return df.join(small(several), "group", "left").withColumn("block", F.when(parts == 1, F.col("group")).otherwise(at(place(salt, parts), F.lit(salt)))).drop("parts")

    sizes = cut(sized(members if slim is None else slim))
    stars = cut(search(dealt(members, sizes, 1)))
    large = cut(sizes.where(parts_of(F.col("n"), F.col("b")) > 1).select("group"))
    if large.isEmpty():
        return stars.select("a", "b")
    within = cut(members.join(small(large), "group", "left_semi"))
    found, salt, before = stars.select("a", "b"), 1, within.count()
    following = lambda of, by: of.join(by.select("group", F.col("a").alias("head"), "b"), ["group", "head"], "left").select("group", "node", F.coalesce("b", "head").alias("head"))
    classes = cut(following(within.select("group", "node", F.col("node").alias("head")), stars))
    while True:
        heads = cut(classes.select("group", F.col("head").alias("node")).distinct())
        now, salt = heads.count(), salt + 1
        if salt > 2 and 2 * now > before:
            break
        standing = within.join(small(heads), ["group", "node"], "left_semi")
        stars = cut(search(dealt(standing, sized(standing), salt)))
        found, classes, before = found.unionByName(stars.select("a", "b")), cut(following(classes, stars)), now
    named = within.join(classes, ["group", "node"])
    counts = named.groupBy("group", "head").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").cast("double").alias("b"))
    main = counts.groupBy("group").agg(F.max(F.struct("n", "head", "b")).alias("main"), F.sum("n").alias("n"), F.sum("b").alias("b"))
    rest = parts_of(F.col("n") - F.col("main.n"), F.col("b") - F.col("main.b"))
    plan = cut(main.where(F.col("n") > F.col("main.n")).select("group", F.col("main.head").alias("top"), rest.alias("outer"), parts_of(F.col("main.n"), F.col("main.b")).alias("inner")))
    if plan.isEmpty():
        return found
    # Outsiders meet each other in pairs of their blocks, and each block of the largest class besides.
    split = named.join(small(plan), "group").withColumn("at", place(99, F.when(F.col("head") == F.col("top"), F.col("inner")).otherwise(F.col("outer"))))
    every = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    mine, to_main = F.col("at"), lambda outer, inner: F.struct(outer.alias("low"), (-1 - inner).alias("high"))
    meets = F.when(F.col("head") == F.col("top"), every("outer", lambda k: to_main(k, mine))).otherwise(
        F.concat(every("outer", lambda k: F.struct(F.least(k, mine).alias("low"), F.greatest(k, mine).alias("high"))), every("inner", lambda k: to_main(mine, k)))
    )
    pairs = split.withColumn("meets", F.explode(meets)).withColumn("block", at("meets.low", "meets.high")).drop("head", "top", "outer", "inner", "at", "meets")
    return found.unionByName(cut(search(pairs)).select("a", "b"))


def search_codes(rows: DataFrame, radius: int, bits: int) -> DataFrame:
    """group, a, b: the stars of ``link_group`` in each block, around the smallest node of each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, ends in whole_groups(frames, ["block"]):
            code, node = part["code"].to_numpy().view(np.uint64) & np.uint64(((1 << bits) - 1) << (64 - bits)), part["node"].to_numpy()
            group, raw, slack, out = part["group"].to_numpy(), part["sketch"].to_numpy(), part["slack"].to_numpy(), []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if b - a < 2:
                    continue
                bare = raw[a] is None
                wide = None if bare else np.frombuffer(b"".join(raw[a:b]), dtype=np.uint64).reshape(b - a, -1)
                out += [(group[a], *star) for star in by_smallest(node[a:b], link_group(code[a:b], radius, wide, None if bare else slack[a:b]))]
            yield pd.DataFrame(out, columns=["group", "a", "b"], dtype="int64")

    # Two blocks whose hashes are equal are searched as one, which finds no less.
    dealt = rows.select("block", "group", "code", "node", "sketch", "slack").repartition("block").sortWithinPartitions("block")
    return dealt.mapInPandas(run, "group long, a long, b long")


def links(codes: DataFrame, radius: int = 2, bits: int = 64) -> DataFrame:
    """Links between nodes whose codes differ in at most ``radius`` of their top ``bits`` bits.

    codes: space int (only codes of one space are compared), code long, node long, sketch (whole eights of bytes, or null for none)
    and slack: the sketches of two nodes may differ in as many bits as both have slack.

    Two such codes agree on one of radius + 1 runs of bits at least, so each code goes to the group of each run; a
    group is searched by ``link_group``. A group of over GROUP codes is divided once more by the same rule over its
    remaining bits, if that leaves no part of over GROUP. If it does, as where many codes are alike, the group is left whole and
    ``settled`` searches it in blocks. So no task gets a large group, all pairs are met, and a code is in
    (radius + 1) ** 2 groups at most.

    Returns a, b: enough links to join all that belong together, never all pairs of a group.
    """
    blocks, at = radius + 1, ["space", "mask", "value"]
    first = sub_masks(0, bits, blocks)
    inside = lambda mask: F.col("code").bitwiseAND(F.col(mask))
    group = lambda *names: F.xxhash64("space", *names)
    search = lambda rows: search_codes(rows, radius, bits)
    plain = lambda rows, *names: rows.select(group(*names).alias("block"), F.lit(0).cast("long").alias("group"), "code", "node", "sketch", "slack")
    level = codes.withColumn("mask", F.explode(F.array(*[F.lit(_signed(m)) for m in first]))).withColumn("value", inside("mask"))
    large = cut(level.groupBy(*at).count().where(F.col("count") > GROUP).select(*at))
    if large.isEmpty():
        return search(plain(level, "mask", "value")).select("a", "b")
    whole, held = level.join(small(large), at, "left_anti"), level.join(small(large), at, "left_semi")
    free = bits - (bits + blocks - 1) // blocks
    if free < blocks:
        hot = large
    else:
        finer = F.create_map(*[v for m in first for v in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in sub_masks(m, bits, blocks)]))])
        divide = lambda rows: rows.withColumn("sub", F.explode(F.element_at(finer, F.col("mask")))).withColumn("part", inside("sub"))
        hot = cut(divide(held).groupBy(*at, "sub", "part").count().where(F.col("count") > GROUP).select(*at).distinct())
        whole = plain(whole, "mask", "value").unionByName(plain(divide(held.join(small(hot), at, "left_anti")), "sub", "part"))
    if free < blocks:
        whole = plain(whole, "mask", "value")
    alike = held.join(small(hot), at, "left_semi").select(group("mask", "value").alias("group"), "code", "node", "sketch", "slack", F.lit(0).alias("bytes"))
    return search(whole).select("a", "b").unionByName(settled(alike, search, GROUP // 2))


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """SimHash of every whole text, and the component of fingerprints linked at ``radius`` or fewer differing bits.

    Equal fingerprints are searched once. The smallest doc_id of all documents that a document reaches names its
    component. Null text counts as empty; texts without words have fingerprint zero and are linked like others. Null
    doc_ids never name a component unless it holds no other. Repeated rows pass through. Empty table: no rows. Other
    columns are ignored.

    Returns doc_id, fingerprint (16 hex digits), component_id.
    """
    marked = cut(fingerprints(docs, words))
    codes = cut(marked.groupBy("code").agg(F.min("doc_id").alias("first")))
    bare = [F.lit(None).cast("binary").alias("sketch"), F.lit(0.0).alias("slack")]
    roots = connected(links(codes.select(F.lit(0).alias("space"), "code", F.col("code").alias("node"), *bare), radius))
    named = cut(codes.join(roots.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(least, "root").select("code", "component_id")
    hexed = F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint")
    return marked.join(of, "code").select("doc_id", hexed, "component_id")


# Near copies of the pipeline


def distinct_runs(text: str | None, words: int) -> np.ndarray:
    """Hashes of the distinct runs of words of a whole text, in order."""
    found = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(found)) if found else np.array([], dtype=np.uint64)


def prefix(size: int, similarity: float) -> int:
    """Smallest runs of a set of which one at least is among those of any set that is as similar as that."""
    return size - int(np.ceil(similarity * size - 1e-9)) + 1


def sketches(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """key, doc_id, row (hash of the text), node (hash of the set of runs) and size of each whole text; its 512-bit
    SimHash over distinct runs, unless it has too few; and if it has FEW or fewer, a bitmap of them and the smallest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                runs = distinct_runs(text, words)
                n = len(runs)
                wide = majority(iter([runs]), True).tobytes() if n >= similarity * FEW else None
                bitmap = firsts = None
                if n <= FEW:
                    marks = np.zeros(512, dtype=np.uint8)
                    marks[(runs % np.uint64(509)).astype(np.int64)] = 1
                    bitmap, firsts = np.packbits(marks).tobytes(), runs[: prefix(n, similarity)].view(np.int64).tolist()
                rows.append((xxhash.xxh64_intdigest(runs.tobytes(), 7), n, wide, bitmap, firsts))
            out = pd.DataFrame(rows, columns=["node", "size", "sketch", "bitmap", "firsts"])
            out["node"] = out["node"].astype("uint64").to_numpy().view(np.int64)
            yield pd.concat([frame[["key", "row"]].reset_index(drop=True), frame["doc_id"].astype("Int64").reset_index(drop=True), out], axis=1)

    kinds = "key string, row long, doc_id long, node long, size int, sketch binary, bitmap binary, firsts array<long>"
    return keyed(pick(docs, "doc_id", "text")).mapInPandas(run, kinds)


def _row() -> Column:
    return F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))


def _key() -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), _row())


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text, with row, a hash of the text (0 for null), and key, which names doc_id and row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _row().alias("row"), _key().alias("key"))


def compare_sets(rows: DataFrame, similarity: float) -> DataFrame:
    """group, a, b: stars that join the members of each block whose sets (bytes of the sorted runs) have at least that
    Jaccard similarity, decided on the sets themselves."""

    def joined(raw: list[bytes]) -> Iterator[tuple[int, int]]:
        sets = [np.frombuffer(r, dtype=np.uint64) for r in raw]
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        owner, (_, run, often) = np.repeat(np.arange(len(sets)), sizes), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = often[run] > 1
        owner, run = owner[shared], np.unique(run[shared], return_inverse=True)[1]
        both = np.zeros((len(sets), len(sets)), dtype=np.float64)
        order = np.argsort(run, kind="stable")
        owner, run = owner[order], run[order]
        distinct = int(run[-1]) + 1 if len(run) else 0
        wide = min(8192, distinct)
        for low in range(0, distinct, 8192):  # incidence of some of the runs at a time
            a, b = np.searchsorted(run, (low, low + wide))
            hit = np.zeros((len(sets), wide), dtype=np.float32)
            hit[owner[a:b], run[a:b] - low] = 1
            both += hit @ hit.T
        alike = both >= similarity * (sizes[:, None] + sizes[None] - both) - 1e-9
        part = np.arange(len(sets))
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(alike, 1))), strict=True):
            if part[i] != part[j]:
                part[part == part[j]] = part[i]
        own = np.flatnonzero(part != np.arange(len(sets)))
        return zip(own.tolist(), part[own].tolist(), strict=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, ends in whole_groups(frames, ["block", "group"]):
            node, group, raw, out = part["node"].to_numpy(), part["group"].to_numpy(), part["set"].tolist(), []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                out += [(group[a], node[a + i], node[a + j]) for i, j in joined(raw[a:b])] if b - a > 1 else []
            yield pd.DataFrame(out, columns=["group", "a", "b"], dtype="int64")

    dealt = rows.select("block", "group", "node", "set").repartition("block").sortWithinPartitions("block", "group")
    return dealt.mapInPandas(run, "group long, a long, b long")


def decided(members: DataFrame, similarity: float, slim: DataFrame | None = None) -> DataFrame:
    """node, root: exact classes inside each group of candidates (Jaccard of the sets at ``similarity`` or more, and chains).

    members: group, node, bytes, set; a node is in one group. slim: the same without sets."""
    found = settled(members, lambda rows: compare_sets(rows, similarity), BLOCK, BLOCK_BYTES, slim)
    # Where every group was one block, each node already has the one that stands for its class.
    stars = found.groupBy("a").count().where("count > 1").isEmpty() and found.join(found.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()
    return found.select(F.col("a").alias("node"), F.col("b").alias("root")) if stars else connected(found)


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Groups of near copies: texts whose sets of word runs have a Jaccard similarity of ``similarity`` or more.

    Candidates: a 512-bit SimHash over the distinct runs estimates the angle between two sets. Parts of it, WIDTH bits
    each, are searched by the Gray-order index at two differing bits, and a pair found must differ in few of the last 256
    bits: two and a half standard deviations more than expected at ``similarity``, which unrelated texts, at 128, are
    nine deviations away from. Each part goes to three groups, so a wider filter would be most of what is shuffled, and
    could only spare comparisons of sets. A SimHash of few runs is coarse, so texts of FEW runs or fewer are led together
    by equal ones among their smallest runs, which loses no pair, and held to bitmaps of their runs. Then ``decided`` compares the sets themselves, so every link is exact; a pair at
    the threshold is found in about 98 of 100 cases, one at 0.85 nearly always. Copies of copies fall into one group.

    Null and empty texts are alike and form one group. Returns key, doc_id, row (hash of the text), group (node of the
    group's root): documents with equal group are near copies.
    """
    cosine = 2 * similarity / (1 + similarity)
    share = float(np.arccos(cosine)) / np.pi
    most = 8 * CARRIED * share + 2.5 * float(np.sqrt(8 * CARRIED * share * (1 - share)))
    marked = cut(sketches(docs, words, similarity))
    nodes = cut(marked.groupBy("node").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("size", "sketch", "bitmap", "firsts")]))
    part = lambda k: F.shiftleft(F.conv(F.hex(F.substring("sketch", 1 + STRIDE * k, 4)), 16, 10).cast("long"), 32)
    spaces = F.array(*[F.struct(F.lit(k).alias("space"), part(k).alias("code")) for k in range(60 // STRIDE + 1)])
    long = nodes.where("sketch is not null").select("node", F.substring("sketch", 65 - CARRIED, CARRIED).alias("sketch"), F.lit(most / 2).alias("slack"), F.explode(spaces).alias("at"))
    short = nodes.where("bitmap is not null").select(
        F.lit(0).alias("space"), F.explode("firsts").alias("code"), "node", F.col("bitmap").alias("sketch"), (F.col("size") * ((1 - similarity) / (1 + similarity))).alias("slack")
    )
    candidates = links(long.select("at.space", "at.code", "node", "sketch", "slack"), 2, WIDTH).unionByName(links(short, 0))
    roots = connected(candidates)
    members = cut(roots.select("node", F.col("root").alias("group")).unionByName(roots.select(F.col("root").alias("node"), F.col("root").alias("group")).distinct()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"group": frame["group"], "node": frame["node"], "bytes": frame["bytes"], "set": [distinct_runs(t, words).tobytes() for t in frame["text"]]})

    again = marked.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("again"))
    asked = cut(members.join(nodes.select("node", "key", (F.col("size") * 8).alias("bytes")), "node").join(again, "key", "left"))
    held = keyed(pick(docs, "doc_id", "text")).join(small(asked), "key").select("key", "again", "group", "node", "bytes", "text")
    once = held.where("again is null").unionByName(held.where("again").dropDuplicates(["key"]))
    classes = decided(once.drop("key", "again").mapInPandas(run, "group long, node long, bytes int, set binary"), similarity, asked)
    return marked.join(classes, "node", "left").select("key", "doc_id", "row", F.coalesce("root", "node").alias("group"))


def keep_one(docs: DataFrame, columns: tuple[str, ...], **rules: float) -> DataFrame:
    """The columns of one document of each group of near copies: the one of smallest doc_id (then smallest text hash).

    Rows that repeat both are kept once; a null doc_id comes last. Groups may be very large, so the smallest is found
    by an aggregate, not by sorting groups. Only keys are shuffled for that; texts stay where they are as long as the
    keys of what goes, or of what is repeated, are few enough to be sent to all.
    """
    docs = pick(docs, *columns)
    with small_batches(docs.sparkSession, ROWS):
        groups = cut(near_duplicates(docs, **rules))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("row"), F.col("key"))).alias("first")
    kept = groups.groupBy("group").agg(first).select(F.col("first.key").alias("key"))
    gone = cut(groups.select("key").distinct().join(kept, "key", "left_anti"))
    again = cut(groups.groupBy("key").count().where("count > 1").select("key"))
    mine = docs.withColumn("__key", _key())
    left = mine.join(small(gone).withColumnRenamed("key", "__key"), "__key", "left_anti")
    repeated = small(again).withColumnRenamed("key", "__key")
    return left.join(repeated, "__key", "left_anti").unionByName(left.join(repeated, "__key", "left_semi").dropDuplicates(["__key"])).drop("__key")
