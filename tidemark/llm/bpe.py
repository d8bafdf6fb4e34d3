"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file becomes a tokenizers model: bytes are written as the usual printable characters, and every split of a
token into two known tokens is a merge with the rank of the token, which is what a rank file means. Texts are cut by
the pattern; each distinct piece of a batch goes through the library once, and its ids are kept as bytes, so that a
document is the concatenation of its pieces' ids.

Null text counts as empty: no tokens. Repeated rows give repeated results; extra columns are not returned.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import map_texts

#: Pieces kept by a Python worker, and their most characters; beyond it the store starts anew (speed only).
KEPT_PIECES, KEPT_CHARACTERS = 300_000, 64


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Codec:
    """Encodes and decodes with one rank file and split pattern."""

    def __init__(self, rank_file: str, pattern: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        chars = byte_characters()
        written = {token: "".join(chars[b] for b in token) for token in ranks}
        merges = [(written[token[:i]], written[token[i:]]) for token in sorted(ranks, key=ranks.get) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        self.library = Tokenizer(models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(pattern)
        self.table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        back = {c: b for b, c in enumerate(chars)}
        for token, rank in ranks.items():
            self.table[rank] = bytes(back[c] for c in written[token])
        self.kept: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers for each text."""
        pieces = [self.pattern.findall(text) if text else [] for text in texts]
        kept = self.kept
        if len(kept) > KEPT_PIECES:
            kept.clear()
        new = list({p for ps in pieces for p in ps if p not in kept})
        for piece, got in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True):
            kept[piece] = np.array(got.ids, dtype="<u4").tobytes()
        out = [b"".join(map(kept.__getitem__, ps)) for ps in pieces]
        for piece in new:
            if len(piece) > KEPT_CHARACTERS:
                del kept[piece]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of a run of ids; a character that the run cuts stays cut."""
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])

    def offsets(self, ids: bytes, text: str) -> tuple[list[int], list[int]]:
        """First character and end (exclusive) of each token; a token that starts inside a character starts at it,
        and one that ends inside a character ends after it."""
        sizes = np.array([len(self.table[i]) for i in np.frombuffer(ids, dtype="<u4").tolist()], dtype=np.int64)
        starts = np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0 != 0x80
        upto = np.concatenate([[0], np.cumsum(starts)])
        ends = np.cumsum(sizes)
        return np.maximum(upto[np.minimum(ends - sizes + 1, len(starts))] - 1, 0).tolist() if len(ends) else [], upto[ends].tolist() if len(ends) else []


@lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> Codec:
    """One codec per Python worker."""
    return Codec(rank_file, pattern)


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids array<int>, char_start, char_end array<int>) per row."""

    def kernel():
        own = codec(rank_file, pattern)

        def run(texts):
            ids = own.encode(texts)
            spans = [own.offsets(i, t or "") for i, t in zip(ids, texts, strict=True)]
            return [[len(i) // 4 for i in ids], [np.frombuffer(i, dtype="<u4").astype(np.int32) for i in ids], [s for s, _ in spans], [e for _, e in spans]]

        return run

    return map_texts(df, id_col, text_col, "n_tokens long, ids array<int>, char_start array<int>, char_end array<int>", kernel)


def decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary, text string) of token ids; null ids count as none. text replaces what isn't whole UTF-8,
    such as a character that was cut at an end of the ids, by U+FFFD; decoded holds the bytes themselves."""

    def kernel():
        own = codec(rank_file, pattern)

        def run(ids):
            decoded = [own.decode(np.array(i or [], dtype="<u4").tobytes()) for i in ids]
            return [decoded, [d.decode("utf-8", "replace") for d in decoded]]

        return run

    return map_texts(df, id_col, ids_col, "decoded binary, text string", kernel)


def round_trip(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: digests of the ids and of the bytes they decode to."""

    def kernel():
        own = codec(rank_file, pattern)

        def run(texts):
            ids = own.encode(texts)
            return [[len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids], [hashlib.sha256(own.decode(i)).hexdigest() for i in ids]]

        return run

    return map_texts(df, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", kernel)
