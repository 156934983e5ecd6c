"""Packing token pieces into sequences by the sum-of-squares rule.

A piece goes where the sum of the squared numbers of open sequences per residual gap becomes smallest. In
random order that rule leaves about 5 % of all room unused, for it opens new sequences freely; here pieces
come in decreasing order, and a new sequence is opened only where no open one has room (README has figures).

Tokenising and packing are tasks on partitions: pieces are dealt by hash into groups of bounded size, each
packed alone. Full pieces are sequences of their own and take no part.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from isovane.plans.lineage import cut

ROOM = 1024
END = 2
#: The ranks of byte_bpe_50k.json: the same ids (tests compare them), three times as fast as by tokenizers.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Texts that tiktoken refuses, which are runs of more than some 700,000 blanks, go through tokenizers and this file.
WHOLE_VOCABULARY = "byte_bpe_50k.json"
SPECIAL = {"<|endoftext|>": 50256}
#: Pieces in a group that is packed together.
GROUP = 10_000


@cache
def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a rank file; one for each Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@cache
def whole_encoding(path: str) -> Tokenizer:
    """The same BPE by tokenizers; one for each Python worker."""
    return Tokenizer.from_file(path)


def token_ids(text: str | None, path: str, end: int = END, whole_path: str | None = None) -> np.ndarray:
    """Ids of a whole text (null: empty), then ``end``."""
    try:
        ids = encoding(path).encode(text or "", allowed_special="all")
    except ValueError:  # its pattern gives up on very long runs of blanks
        ids = whole_encoding(whole_path or public_tokenizers.path(WHOLE_VOCABULARY)).encode(text, add_special_tokens=False).ids
    return np.array([*ids, end], "<u4")


def cuts(n: int, room: int = ROOM) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, the first may be shorter."""
    first = n % room or room
    return [(0, first), *[(at, room) for at in range(first, n, room)]]


def pieces(docs: DataFrame, path: str | None = None, room: int = ROOM, end: int = END, text: str = "text", whole_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece of every whole document.

    ``path`` is the rank file of the vocabulary, ``whole_path`` the same vocabulary for tokenizers.
    """
    path, whole_path = path or public_tokenizers.path(VOCABULARY), whole_path or public_tokenizers.path(WHOLE_VOCABULARY)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(body.as_py(), path, end, whole_path)
                rows += [(doc_id, i, at, n, zlib.crc32(ids[at : at + n].tobytes())) for i, (at, n) in enumerate(cuts(len(ids), room))]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_body")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(lengths: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) for each length (1 to ``room``), given in decreasing order.

    With N(g) open sequences of gap g, a piece of length s that turns a gap g into g - s changes the sum of squares by
    2 N(g - s) - 2 N(g) + 2 (no first term for g = s: full sequences aren't open). Equal changes: the smaller gap.
    """
    count = np.zeros(room + 1, np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(room + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = 0
    for i, s in enumerate(lengths.tolist()):
        before = count[s:]
        change = 2 * (count[: room + 1 - s] - before) + 2
        change[0] = 1 - 2 * before[0]
        change[before == 0] = np.iinfo(np.int64).max
        left = int(change.argmin())
        if before[left]:
            at = open_by_gap[left + s].pop()
            count[left + s] -= 1
        else:
            at, left = opened, room - s
            opened += 1
        sequence[i], offset[i] = at, room - s - left
        if left:
            open_by_gap[left].append(at)
            count[left] += 1
    return sequence, offset


def pack(parts: DataFrame, room: int = ROOM, group: int = GROUP) -> DataFrame:
    """``parts`` (doc_id, piece, length and others) with ``sequence_id`` and ``offset``.

    No sequence holds more than ``room`` ids and offsets have no gaps. A sequence is numbered by its first piece.
    Lengths must be 1 to ``room``. Repeated rows are pieces of their own. No row gives no row.
    """
    numbered = cut(parts.withColumn("_row", F.monotonically_increasing_id()))
    whole = numbered.where(F.col("length") == room).withColumn("sequence_id", F.col("_row")).withColumn("offset", F.lit(0).cast("long"))
    loose = numbered.where(F.col("length") < room)
    groups = max(1, -(-loose.count() // group))
    key = F.pmod(F.xxhash64("doc_id", "piece", "_row"), F.lit(groups)).alias("_group")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "_row"], ascending=[False, True])
        sequence, offset = place(frame["length"].to_numpy(), room)
        _, first = np.unique(sequence, return_index=True)
        return pd.DataFrame({"_row": frame["_row"].to_numpy(), "sequence_id": frame["_row"].to_numpy()[first][sequence], "offset": offset})

    placed = loose.select("_row", "length", key).groupBy("_group").applyInPandas(run, "_row long, sequence_id long, offset long")
    return whole.unionByName(loose.join(placed, "_row")).drop("_row")


def pack_documents(docs: DataFrame, path: str | None = None, room: int = ROOM, end: int = END, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    A null or empty text is the end mark alone. A text of more than ``room`` ids is cut, no other. Rows with
    a null or repeated doc_id are packed like others. Extra columns are ignored.
    """
    return pack(pieces(docs, path, room, end), room, group)


def unpack(packed: DataFrame) -> DataFrame:
    """(sequence_id, used, n_pieces) of every sequence."""
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.count("*").alias("n_pieces"))
