"""Quality rules from a suffix array: how much of a text repeats itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from terracite.session import pick

SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
SPACES = np.frombuffer(b" \t\n\x0b\f\r", dtype=np.uint8)
RULES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " kept boolean, repeat_fraction double, longest_repeat long, n_repeats long"
)
#: Words that are sorted together; a longer text is sorted by itself.
BLOCK_WORDS = 400_000


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the keys, from 0."""
    order = np.argsort(keys, kind="stable")
    steps = np.concatenate(([0], (np.diff(keys[order]) != 0).cumsum()))
    ranks = np.empty(len(keys), dtype=np.int64)
    ranks[order] = steps
    return ranks


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Suffixes of ``ids`` in order, by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(ids)
    rank = _ranked(ids)
    order = np.argsort(rank, kind="stable")
    starts = np.searchsorted(rank[order], np.arange(rank.max() + 1 if n else 0))
    rank = starts[rank]  # the rank is now the first place of its group
    width = 1
    while n:
        places = rank[order]
        same = np.concatenate((places[1:] == places[:-1], [False]))
        tied = np.flatnonzero(same | np.concatenate(([False], same[:-1])))
        if not len(tied):
            break
        suffixes = order[tied]
        follow = suffixes + width
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[suffixes]))
        suffixes, second = suffixes[by], second[by]
        order[tied] = suffixes
        first = rank[suffixes]
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        rank[suffixes] = np.maximum.accumulate(np.where(new, tied, 0))
        width *= 2
    return order


def common_prefixes(ids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix in order with the one before it (0 for the first).

    All pairs advance together by one word a step; where some agree on very many words, a walk in text order takes over.
    """
    n = len(ids)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    a, b, live = order[1:].copy(), order[:-1].copy(), np.arange(1, n)
    same = ids[a] == ids[b]
    a, b, live = a[same], b[same], live[same]
    width = 0
    while len(live):  # grows by one word a step while few pairs are left, so long repeats cost their own length only
        width += 1
        out[live] = width
        a, b = a + 1, b + 1
        inside = (a < n) & (b < n)
        a, b, live = a[inside], b[inside], live[inside]
        same = ids[a] == ids[b]
        a, b, live = a[same], b[same], live[same]
        if width >= 64 and len(live):
            return _long_prefixes(ids, order, out)
    return out


def _long_prefixes(ids: np.ndarray, order: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The same by Kasai's walk in text order, for texts with long repeats."""
    n = len(ids)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    seq, at, sa, h = ids.tolist(), rank.tolist(), order.tolist(), 0
    for i in range(n):
        if at[i] == 0:
            h = 0
            continue
        j = sa[at[i] - 1]
        while i + h < n and j + h < n and seq[i + h] == seq[j + h]:
            h += 1
        out[at[i]] = h
        h = max(h - 1, 0)
    return out


#: Stands for words before the places of a repeat that are not all the same.
MIXED = -2


def maximal_repeats(ids: np.ndarray, order: np.ndarray, prefixes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Common-prefix intervals, of ``least`` words or more, that cannot be made longer to the right by all their places nor
    to the left, as the words before differ: the first place of each in the suffix array, and its length.

    A stack holds the intervals that are open. Each carries the word before all of its places, or MIXED, and hands it on
    to the interval around it when it closes, so every suffix and interval is looked at once.
    """
    before = np.where(order > 0, ids[np.maximum(order - 1, 0)], -1).tolist()
    values = np.append(prefixes, 0).tolist()
    open_: list[list[int]] = []  # first place, length, word before
    firsts, lengths = [], []
    for i in np.flatnonzero((np.append(prefixes, 0) >= least) | (np.append(0, prefixes) >= least)).tolist():
        first, value, word = i - 1, values[i], before[i - 1]
        if open_ and value <= open_[-1][1]:  # the suffix before belongs to the interval that is open
            top = open_[-1]
            top[2] = top[2] if top[2] == word else MIXED
            while open_ and open_[-1][1] > value:
                first, length, word = open_.pop()
                if word == MIXED:
                    firsts.append(first)
                    lengths.append(length)
                if open_ and open_[-1][1] >= value:
                    top = open_[-1]
                    top[2] = top[2] if top[2] == word else MIXED
        if value >= least and (not open_ or open_[-1][1] < value):
            open_.append([first, value, word])
    return np.array(firsts, dtype=np.int64), np.array(lengths, dtype=np.int64)


def repeats(ids: np.ndarray, texts: np.ndarray, n_texts: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text of a block: words inside repeated spans, words of the longest repeat, number of maximal repeats.

    ids: word numbers of all the texts, each text's own (no number stands in two texts), so no repeat crosses texts. The union of
    all repeats is what the longest repeat at each place covers: the longer of the prefixes that a suffix shares with its neighbours.
    """
    longest, count = (np.zeros(n_texts, dtype=np.int64) for _ in range(2))
    if not len(ids):
        return longest.copy(), longest, count
    order = suffix_array(ids)
    prefixes = common_prefixes(ids, order)
    firsts, lengths = maximal_repeats(ids, order, prefixes, least)
    of = texts[order[firsts]]
    np.maximum.at(longest, of, lengths)
    np.add.at(count, of, 1)
    shared = np.maximum(prefixes, np.append(prefixes[1:], 0))
    ends = np.zeros(len(ids), dtype=np.int64)
    ends[order] = np.where(shared >= least, order + shared, 0)
    inside = np.maximum.accumulate(ends) > np.arange(len(ids))
    return np.bincount(texts[inside], minlength=n_texts), longest, count


def apply_rules(
    docs: DataFrame,
    least_repeat: int = 5,
    most_fraction: float = 0.3,
    most_longest: int = 100,
    min_words: int = 50,
) -> DataFrame:
    """Base counts of every whole text, and a verdict from its maximal repeated passages.

    A suffix array over a text's words and the common prefixes of its neighbours give the maximal repeated word
    sequences of ``least_repeat`` words or more; the union of all their places is the repeated part of the text. A text
    is kept unless the base rules fail it, or over ``most_fraction`` of its words lie in repeats, or a repeat is longer
    than ``most_longest`` words. Texts are sorted in blocks, each in one task; nothing is shuffled.

    Null or empty text: all counts 0, base_failed true, not kept. A text of one endlessly repeated word fails. Rows are
    judged each by itself; repeated rows and null doc_ids pass through. Empty table: no rows. Other columns are ignored.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, repeat_fraction,
    longest_repeat, n_repeats.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, parts, held = [], [], 0
            names = frame["doc_id"].astype("Int64")
            for text in frame["text"]:
                row, ids = _base(text)
                rows.append(row)
                parts.append(ids)
                held += len(ids)
                if held >= BLOCK_WORDS:
                    yield judged(names[: len(rows)], rows, parts)
                    names, rows, parts, held = names[len(rows) :], [], [], 0
            if rows:
                yield judged(names, rows, parts)

    def judged(names: pd.Series, rows: list[tuple], parts: list[np.ndarray]) -> pd.DataFrame:
        sizes = np.array([len(x) for x in parts], dtype=np.int64)
        starts = np.concatenate(([0], sizes.cumsum()[:-1])).astype(np.int64)
        ids = np.concatenate(parts) + np.repeat(starts, sizes)
        covered, longest, count = repeats(ids, np.repeat(np.arange(len(parts)), sizes), len(parts), least_repeat)
        out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
        n = out["n_words"].to_numpy()
        out["base_failed"] = (n < min_words) | (100 * out["n_repeat_words"].to_numpy() > 50 * n)
        fraction = covered / np.maximum(n, 1)
        out["kept"] = ~out["base_failed"] & (fraction <= most_fraction) & (longest <= most_longest)
        out["repeat_fraction"], out["longest_repeat"], out["n_repeats"] = fraction, longest, count
        out.insert(0, "doc_id", names.to_numpy(dtype=object, na_value=None))
        return out.astype({"doc_id": "Int64"})

    return pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(run, RULES)


def _base(text: str | None) -> tuple[tuple[int, int, int, int, int], np.ndarray]:
    """Base counts of one text, and its words as numbers from 0 in the order of their first place."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    bytes_of = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    points = len(raw) - int(bytes_of[0x80:0xC0].sum())
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in raw.split()), dtype=np.int64)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if len(ids) >= 3:
        base = np.int64(len(seen))
        window = _ranked(_ranked(ids[:-2] * base + ids[1:-1]) * base + ids[2:])
        twice = np.concatenate((np.bincount(window)[window] > 1, [False, False]))
        twice[1:] |= twice[:-1].copy()
        twice[2:] |= np.concatenate((np.bincount(window)[window] > 1, [False, False]))[:-2]
        repeated = int(twice.sum())
    return (len(ids), points - int(bytes_of[SPACES].sum()), int(bytes_of[SYMBOLS].sum()), len(lines) - len(set(lines)), repeated), ids
