"""Byte-level BPE from a rank file: encoding with offsets, and decoding (operator 10).

The tokenizers library does the merges.  Its model is built from the ranks:
every byte string becomes a string of printable characters, one per byte, and
every split of a token into two tokens becomes a merge at the token's rank, so
the library joins the same pair at each step as the rank rule does.  A match of
the split pattern that is a token itself is taken whole.

Decoding looks up the bytes of each id and joins them; characters whose bytes
are spread over several tokens come together again only after that, so bytes
are never turned into text token by token.

Defined cases: null counts as the empty text and gives no ids; repeated rows
and null ids are handled row by row; unknown ids in decoding raise.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick
from .encode import BYTE_CHAR, ByteLevelIds
from .words import chunks


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def mapped(raw: bytes) -> str:
    """One printable character per byte."""
    return "".join([BYTE_CHAR[b] for b in raw])


def build(path: str, pattern: str):
    """A tokenizers Tokenizer that encodes by the ranks of ``path``."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    merges = []
    for token in sorted(ranks, key=ranks.get):
        merges += [(mapped(token[:i]), mapped(token[i:])) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    tok = Tokenizer(models.BPE(vocab={mapped(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str) -> ByteLevelIds:
    tok = build(path, pattern)
    return ByteLevelIds(lambda text: array("I", tok.encode(text, add_special_tokens=False).ids).tobytes(), tok.model)


@lru_cache(maxsize=4)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All token bytes end to end by id, and the bounds of each id."""
    ranks = read_ranks(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    bounds = np.zeros(len(by_id) + 1, np.int64)
    np.cumsum([len(t) for t in by_id], out=bounds[1:])
    return np.frombuffer(b"".join(by_id), np.uint8), bounds


def token_offsets(ids: np.ndarray, path: str) -> np.ndarray:
    """The byte offsets of the tokens in their text: n + 1 places."""
    bounds = byte_table(path)[1]
    out = np.zeros(len(ids) + 1, np.int64)
    np.cumsum((bounds[1:] - bounds[:-1])[ids], out=out[1:])
    return out


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and, if asked, byte offsets of the tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoder(path, pattern)
        for batch in batches:
            for part in chunks(batch, "text"):
                ids = [encode(t or "") for t in part.column("text").to_pylist()]
                cols = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if offsets:
                    cols.append(pa.array([token_offsets(np.frombuffer(x, "<u4"), path) for x in ids], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids", "offsets"][: len(cols)])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary" + ", offsets array<long>" * offsets)


def decode_bytes(ids: np.ndarray, path: str) -> bytes:
    """The bytes of a token sequence."""
    table, bounds = byte_table(path)
    if not len(ids):
        return b""
    if ids.max() >= len(bounds) - 1:
        raise ValueError(f"id {ids.max()} is not in the vocabulary")
    size = (bounds[1:] - bounds[:-1])[ids]
    if not size.all():
        raise ValueError("an id has no bytes in the vocabulary")
    ends = np.cumsum(size)
    return table[np.arange(ends[-1]) + np.repeat(bounds[:-1][ids] - (ends - size), size)].tobytes()


def token_texts(ids: np.ndarray, path: str) -> list[str]:
    """The text each token completes: a character split over tokens belongs to the last of them.

    Bytes that are no character become U+FFFD, as in a decoder of the whole sequence."""
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")(errors="replace")
    table, bounds = byte_table(path)
    return [decoder.decode(table[bounds[i]: bounds[i + 1]].tobytes(), final=k == len(ids) - 1) for k, i in enumerate(ids.tolist())]


def decode_ids(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The frame with ``decoded`` (binary: the exact bytes) after its columns; null ids decode to no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, ids_col):
                raw = [decode_bytes(np.frombuffer(x or b"", "<u4"), path) for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*part.schema.names, "decoded"])

    schema = encoded.schema.simpleString()[len("struct<"):-1]
    return encoded.mapInArrow(run, f"{schema},decoded:binary")
