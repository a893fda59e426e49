"""Packing documents into token sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveloom.llm.common import map_batches
from curveloom.llm.tokens import TOKENIZERS, VOCABULARY, encoder

#: Documents that are packed together; a group's last sequences are the only ones left slack.
GROUP_DOCS = 4096


def pieces(
    docs: DataFrame, capacity: int = 2048, end_id: int = 1, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): whole texts as identifiers, closed by
    ``end_id`` and cut after every ``capacity`` identifiers. Null counts as empty: one identifier."""
    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        encode = encoder(folder, vocabulary).encode
        end = np.array([end_id], "<u4").tobytes()
        doc, start, length, crc, total = [], [], [], [], []
        for row, text in enumerate(batch["text"].to_pylist()):
            ids = encode(text or "") + end
            n = len(ids) // 4
            for at in range(0, n, capacity):
                doc.append(row)
                start.append(at)
                length.append(min(capacity, n - at))
                crc.append(zlib.crc32(ids[4 * at:4 * (at + capacity)]))
                total.append(n)
        return {
            "doc_id": batch["doc_id"].take(pa.array(doc, pa.int64())), "start": pa.array(start, pa.int64()),
            "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": pa.array(total, pa.int64()),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, ["doc_id", "text"], run,
                       f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


class Remaining:
    """How many pieces of each length are left, with the lengths in order."""

    def __init__(self, lengths: np.ndarray) -> None:
        found, counts = np.unique(lengths, return_counts=True)
        self.lengths = found.tolist()
        self.count = dict(zip(self.lengths, counts.tolist()))

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            self.lengths.pop(bisect_right(self.lengths, length) - 1)


def least_slack(remaining: Remaining, room: int) -> list[tuple[int, int]]:
    """(length, count) of the multiset of remaining lengths whose sum comes closest to ``room``.

    Bit s of a number says that sum s can be reached. A length that occurs c times is added in parts
    of 1, 2, 4, ... and the rest, so that every count up to c can be had; each step keeps the bits
    before it, and from the best sum the steps are traced back to counts. The search ends once
    ``room`` itself is reached.
    """
    mask = (1 << (room + 1)) - 1
    reached = 1
    steps: list[tuple[int, int, int]] = []
    for length in reversed(remaining.lengths[:bisect_right(remaining.lengths, room)]):
        left = min(remaining.count[length], room // length)
        part = 1
        while left:
            n = min(part, left)
            steps.append((length, n, reached))
            reached |= (reached << (length * n)) & mask
            left -= n
            part *= 2
        if reached >> room & 1:
            break
    best = reached.bit_length() - 1
    counts: dict[int, int] = {}
    for length, n, before in reversed(steps):
        if not before >> best & 1:
            counts[length] = counts.get(length, 0) + n
            best -= length * n
    return list(counts.items())


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece: every bin starts with the longest piece left and takes the
    remaining lengths that leave least slack."""
    order = np.argsort(lengths, kind="stable")
    sorted_lengths = lengths[order]
    found, first, counts = np.unique(sorted_lengths, return_index=True, return_counts=True)
    ends = dict(zip(found.tolist(), (first + counts).tolist()))
    remaining = Remaining(lengths)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while remaining.lengths:
        longest = remaining.lengths[-1]
        remaining.take(longest, 1)
        chosen = [(longest, 1)]
        if longest < capacity:
            more = least_slack(remaining, capacity - longest)
            for length, n in more:
                remaining.take(length, n)
            chosen += more
        offset = 0
        for length, n in chosen:
            for _ in range(n):
                ends[length] -= 1
                piece = order[ends[length]]
                bins[piece], offsets[piece] = number, offset
                offset += length
        number += 1
    return bins, offsets


def pack(
    docs: DataFrame, capacity: int = 2048, end_id: int = 1, group_docs: int = GROUP_DOCS,
    folder: str = TOKENIZERS, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` identifiers.

    Returns one row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A
    document becomes full pieces and one remainder. Groups of about ``group_docs`` documents, dealt
    by hash, are packed by minimum bin slack, so a task holds a bounded number of lengths and no
    text. Null and empty texts are one identifier long; repeated rows are packed as often as they
    occur. Reruns give the same sequences.
    """
    if capacity < 1:
        raise ValueError("a sequence needs room for one identifier")
    groups = max(1, -(-docs.count() // group_docs))
    cut = pieces(docs, capacity, end_id, folder, vocabulary).withColumn(
        "group_no", F.pmod(F.xxhash64("doc_id", "doc_tokens"), F.lit(groups))
    )

    def pack_group(group: pa.Table) -> pa.Table:
        group = group.sort_by([(name, "ascending") for name in ("doc_id", "start", "doc_tokens", "ids_crc32")])
        bins, offsets = pack_lengths(group["length"].to_numpy(), capacity)
        numbers = (group["group_no"].to_numpy() << 32) + bins
        return group.drop_columns(["group_no"]).append_column(
            "sequence_id", pa.array(numbers, pa.int64())
        ).append_column("offset", pa.array(offsets, pa.int64()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut.groupBy("group_no").applyInArrow(
        pack_group,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
