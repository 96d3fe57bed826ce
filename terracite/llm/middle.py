"""Fill-in-the-middle documents, cut where a boundary set of tokens selects."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracite.session import pick

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents so many stay plain, and of 100 others so many begin with the suffix.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: Places that one container stands for, and places up to which it is a plain array.
SPAN, SPARSE = 1 << 16, 4096


class BoundarySet:
    """An ordered set of places, as containers of 65,536 consecutive places.

    A container is an array of its places, a bitmap, or runs, whichever is smallest; ``cumulative`` says how many places
    stand in all containers before. ``select(k)`` finds the container by that and looks only into this one.
    """

    def __init__(self, member: np.ndarray) -> None:
        """member: for each place from 0, whether it belongs to the set."""
        self.containers: list[tuple[str, np.ndarray, np.ndarray]] = []
        counts = [0]
        for low in range(0, len(member), SPAN):
            bits = member[low : low + SPAN]
            places = np.flatnonzero(bits)
            starts = np.flatnonzero(np.diff(places, prepend=-2) != 1)  # places after which a run begins, by rank
            self.containers.append(self._smallest(bits, places, starts))
            counts.append(counts[-1] + len(places))
        self.cumulative = np.array(counts, dtype=np.int64)

    @staticmethod
    def _smallest(bits: np.ndarray, places: np.ndarray, starts: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
        """Kind, content, and running cardinalities of its runs or words (of an array: none are needed)."""
        if 4 * len(starts) < min(2 * len(places), SPAN // 8):
            return "run", places[starts].astype(np.uint16), starts.astype(np.int64)
        if len(places) <= SPARSE:
            return "array", places.astype(np.uint16), starts[:0]
        words = np.packbits(bits, bitorder="little")
        words = np.concatenate((words, np.zeros(-len(words) % 8, dtype=np.uint8))).view("<u8")
        return "bitmap", words, np.concatenate(([0], np.bitwise_count(words).cumsum())).astype(np.int64)

    def __len__(self) -> int:
        return int(self.cumulative[-1])

    def select(self, k: int) -> int:
        """The place of rank ``k``, from 0."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.cumulative, k, side="right")) - 1
        kind, content, upto = self.containers[at]
        rank = k - int(self.cumulative[at])
        if kind == "array":
            local = int(content[rank])
        elif kind == "run":
            run = int(np.searchsorted(upto, rank, side="right")) - 1
            local = int(content[run]) + rank - int(upto[run])
        else:
            word = int(np.searchsorted(upto, rank, side="right")) - 1
            left = int(content[word])
            for _ in range(rank - int(upto[word])):
                left &= left - 1
            local = 64 * word + (left & -left).bit_length() - 1
        return at * SPAN + local


def token_ends(text: str) -> np.ndarray:
    """For each code point of a text, whether a token (a run of A-Z and a-z, or any one other code point) ends behind it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = ((points | 32) - 97) < 26  # unsigned, so what is below "a" is far above
    ends = np.ones(len(points), dtype=bool)
    ends[:-1] = ~(letters[:-1] & letters[1:])
    return ends


def _cuts(texts: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    """n, and the places of two cuts that leave ``first % (n + 1)`` and ``second % (n + 1)`` tokens before them, the smaller first."""
    out = []
    for text, a, b in zip(texts, first, second):
        ends = BoundarySet(token_ends(text or ""))
        n = len(ends)
        cuts = [ends.select(k - 1) + 1 if k else 0 for k in sorted((int(a) % (n + 1), int(b) % (n + 1)))]
        out.append((n, *cuts))
    return pd.DataFrame(out, columns=["n", "low", "high"], dtype="int64")


def number(text: Column, k: int) -> Column:
    """The ``k``-th group of eight hex digits of the SHA-256 of a text, from 0, as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 8 * k + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = 1, plain_from: int = PLAIN_FROM, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Every whole text as plain text or with its middle behind prefix and suffix.

    A text is cut between tokens, at two places that the hash of ``seed`` and doc_id chooses. Its token ends are a
    ``BoundarySet``, which selects both places. Form psm is ``<P>prefix<S>suffix<M>middle``, spm ``<S>suffix<P>prefix<M>middle``;
    texts that hold one of the marks, empty ones and a share of the others stay plain. A text of any length is one row's
    work, with four bytes for a code point and its set; nothing is shuffled.

    Null text counts as empty. Null doc_id is hashed as no digits. Repeated rows are transformed alike. Empty table: no
    rows. Other columns are ignored.

    Returns doc_id, n, form, prefix_chars and middle_chars (null where plain) and output.
    """
    cuts = F.pandas_udf(_cuts, "n long, low long, high long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = [number(name, k) for k in range(4)]
    d = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("cut", cuts("text", h[0], h[1]))
    marked = F.col("text").rlike(f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    form = F.when((F.col("text") == "") | marked | (h[2] % 100 >= plain_from), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    low, high = F.col("cut.low").cast("int"), F.col("cut.high").cast("int")
    parts = {"prefix": F.substring("text", F.lit(1), low), "middle": F.substring("text", low + 1, high - low), "suffix": F.substring("text", high + 1, F.length("text"))}
    d = d.withColumn("form", form)
    moved = F.col("form") != "plain"
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), parts["prefix"], F.lit(SUFFIX), parts["suffix"], F.lit(MIDDLE), parts["middle"]))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), parts["suffix"], F.lit(PREFIX), parts["prefix"], F.lit(MIDDLE), parts["middle"]))
        .otherwise(F.col("text"))
    )
    return d.select(
        "doc_id", F.col("cut.n").alias("n"), "form", F.when(moved, F.col("cut.low")).alias("prefix_chars"), F.when(moved, F.col("cut.high") - F.col("cut.low")).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``transform`` was made from. No part holds a mark, so the first of each is the right one."""
    body = F.substring(output, F.lit(4), F.length(output))
    first, middle = F.split(body, SUFFIX, 2), lambda x: F.split(x, MIDDLE, 2)
    psm = F.concat(first[0], middle(first[1])[1], middle(first[1])[0])
    first_s = F.split(body, PREFIX, 2)
    spm = F.concat(middle(first_s[1])[0], middle(first_s[1])[1], first_s[0])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """The outputs' hashes, and those of the texts that are rebuilt from them."""
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


MIDDLE_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
numbers AS (SELECT doc_id, text, t, len(t) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM docs),
forms AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
        CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
    FROM numbers),
parts AS (SELECT *, array_to_string(t[1:low], '') AS p, array_to_string(t[low + 1:high], '') AS m, array_to_string(t[high + 1:], '') AS s FROM forms)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE text END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""
