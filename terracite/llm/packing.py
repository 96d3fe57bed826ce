"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from terracite.session import pick

#: Id that ends every document, and one special string that the tokenizer maps to an id of its own.
END_ID, SPECIAL = 1, "<|endoftext|>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of whole texts as little-endian uint16 bytes, the same ids as the tokenizers library gives.

    Texts go to the rank file of the same vocabulary, which is several times faster, in pieces of about ``PIECE`` characters,
    cut before a single space behind another character, where the tokenizer's own pattern always cuts; texts with the special
    string, with characters beyond common European ones, or with white space before a space go whole to the tokenizers library.
    """

    PIECE = 1 << 20

    RARE = re.compile("[^\t-\r\x20-\x7e¡-ɏЀ-ҁ]")
    WHOLE = (SPECIAL, *[c + " " for c in "\t\n\x0b\f\r "])

    def __init__(self, tokenizer_file: str, rank_file: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer_file)
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.WHOLE) or self.RARE.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()
        out, start = [], 0
        while start < len(text):
            end = text.find(" ", start + self.PIECE)
            end = len(text) if end < 0 else end
            ids = self.ranks.encode_ordinary(text[start:end])
            out.append(struct.pack(f"<{len(ids)}H", *ids))
            start = end
        return b"".join(out)


def assign(lengths: np.ndarray, room: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these token counts.

    Whole sequences are cut off documents longer than ``room``. What is left is taken by descending cost,
    ``linear * n + quadratic * n * n``, to the sequence of lowest cost that has room for it. There are as few sequences
    as the tokens allow; a piece that fits nowhere is cut to fill the emptiest sequence and its rest goes on.
    """
    pieces, tails, sequence = [], [], 0
    for i, n in enumerate(lengths.tolist()):
        full = n // room
        for k in range(full):
            pieces.append((i, k * room, room, sequence, 0))
            sequence += 1
        if n % room:
            tails.append((n % room, i, full * room))
    tails.sort(key=lambda x: (-x[0], x[1]))
    count = -(-sum(x[0] for x in tails) // room)
    cost, left = np.zeros(count), np.full(count, room)
    for n, i, start in tails:
        while n:
            fits = left >= n
            at = int(np.argmin(np.where(fits, cost, np.inf)) if fits.any() else np.argmax(left))
            take = min(n, int(left[at]))
            pieces.append((i, start, take, sequence + at, room - int(left[at])))
            cost[at] += linear * take + quadratic * take * take
            left[at] -= take
            n, start = n - take, start + take
    return pieces


def pack(
    docs: DataFrame,
    room: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    block_tokens: int = 2_000_000,
    tokenizer: str = "byte_bpe_50k",
) -> DataFrame:
    """Packs whole documents, each followed by id 1, into sequences of at most ``room`` tokens.

    Each task tokenizes its own rows and packs them by ``assign`` in blocks of about ``block_tokens``, so no token is
    shuffled, a lost task is simply run again, and memory is bounded by the block and the longest document. A block
    leaves less than one sequence of padding. ``linear`` and ``quadratic`` are the cost of a token and of a pair of
    tokens in attention.

    Null or empty text: id 1 alone. Null doc_id stays null; repeated rows are packed each by itself. An empty table
    gives no rows. Other columns are ignored. sequence_id is unique in the result; numbers need not be gapless.

    Returns one row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers as files

        encode = Encoder(files.path(f"{tokenizer}.json"), files.path(f"{tokenizer}.tiktoken"), files.PATTERN)
        end = np.array([END_ID], dtype="<u2").tobytes()
        number = TaskContext.get().partitionId() << 33
        names: list = []
        tokens: list[bytes] = []
        held = 0

        def packed() -> pd.DataFrame:
            nonlocal number, names, tokens, held
            lengths = np.array([len(x) // 2 for x in tokens], dtype=np.int64)
            wide = [np.frombuffer(x, dtype="<u2").astype("<u4") for x in tokens]
            pieces = assign(lengths, room, linear, quadratic)
            rows = [
                (names[i], start, n, zlib.crc32(wide[i][start : start + n]), len(wide[i]), number + sequence, offset)
                for i, start, n, sequence, offset in pieces
            ]
            number += 1 + max(x[3] for x in pieces)
            names, tokens, held = [], [], 0
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            return out.astype({"doc_id": "Int64"})

        for frame in frames:
            for name, text in zip(frame["doc_id"].astype("Int64"), frame["text"], strict=True):
                names.append(name)
                tokens.append((encode(text) if text else b"") + end)
                held += len(tokens[-1]) // 2
                if held >= block_tokens:
                    yield packed()
        if names:
            yield packed()

    return pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(run, PIECES)
