"""Hierarchical multi-length packing of tokenised documents."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.common import documents, map_arrow, slices
from veritrace.llm.registry import query
from veritrace.llm.tokens import encoder

#: Piece: (document number, tokens before it in the document, length).
Piece = tuple[int, int, int]

SCHEMA = (
    "{id} {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)
#: Sequence and group numbers of a task start at its number times this.
TASK_NUMBERS = 1 << 40


class TierPacker:
    """Tails of documents by length, packed tier by tier into windows without gaps.

    A tail belongs to the smallest tier that holds it. Tiers are packed from long to short: the longest tail opens a
    window of its tier, the gap takes whole tails of shorter tiers, longest first, and the rest of the gap is cut from
    the shortest tail that is longer. What cannot fill a window stays for the next call.
    """

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.by_length: list[list[Piece]] = [[] for _ in range(self.tiers[0] + 1)]
        self.present = 0  # bit L is set while a tail of length L is there
        self.count = 0

    def add(self, piece: Piece) -> None:
        self.by_length[piece[2]].append(piece)
        self.present |= 1 << piece[2]
        self.count += 1

    def _take(self, length: int) -> Piece:
        piece = self.by_length[length].pop()
        if not self.by_length[length]:
            self.present &= ~(1 << length)
        self.count -= 1
        return piece

    def _longest(self, most: int) -> int:
        return (self.present & ((1 << (most + 1)) - 1)).bit_length() - 1

    def _window(self, size: int) -> list[Piece] | None:
        """A full window, or None with everything put back when all tails together are too short."""
        pieces, gap = [], size
        while gap:
            length = self._longest(gap)
            if length > 0:
                pieces.append(self._take(length))
                gap -= length
                continue
            longer = self.present >> (gap + 1)
            if not longer:
                for piece in pieces:
                    self.add(piece)
                return None
            doc, start, length = self._take(gap + 1 + (longer & -longer).bit_length() - 1)
            pieces.append((doc, start, gap))
            self.add((doc, start + gap, length - gap))
            gap = 0
        return pieces

    def pack(self) -> Iterator[tuple[int, list[Piece]]]:
        for tier, below in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            while self._longest(tier) > below:
                window = self._window(tier)
                if window is None:
                    break
                yield tier, window

    def flush(self) -> Iterator[tuple[int, list[Piece]]]:
        """The rest in windows of powers of two, which need no padding."""
        yield from self.pack()
        size = self.tiers[0]
        while self.count:
            window = self._window(size)
            if window is None:
                size //= 2
            else:
                yield size, window


def balanced(windows: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """A group for each window: longest first into the group with the fewest tokens, so that steps weigh the same."""
    total = sum(size for size, _ in windows)
    heap = [(0, g) for g in range(max(1, round(total / step_tokens)))]
    groups = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: -windows[i][0]):
        tokens, group = heapq.heappop(heap)
        groups[i] = group
        heapq.heappush(heap, (tokens + windows[i][0], group))
    return groups


def pack(
    docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
    tiers: tuple[int, ...] = (1024, 512, 256, 128), pool: int = 4096, step_tokens: int = 65_536,
) -> DataFrame:
    """Pieces of documents in sequences of tier length; one row per piece, ids as little-endian 32-bit integers.

    Full windows of the longest tier are sequences of their own. Tails are routed to tiers and packed in pools of
    ``pool`` tails, which bounds the memory of a task; there is no shuffle. The last tails of a task go into sequences
    whose lengths are powers of two, so no sequence needs padding. ``step_group`` puts sequences into training steps of
    about ``step_tokens`` tokens.

    A null text is an empty one and gives the end id alone; null ids and repeated rows are packed like any other row;
    an empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    window = max(tiers)
    id_type = dict(docs.dtypes)[id_col]
    schema = SCHEMA.format(id="_id", id_type=id_type)

    def run(batches):
        enc, packer = encoder(tokenizer), TierPacker(tiers)
        first = TaskContext.get().partitionId() * TASK_NUMBERS
        docs_held: dict[int, tuple[object, np.ndarray, int, int]] = {}  # id, ids from a start on, the start, all tokens
        number, next_sequence, next_group = 0, first, first

        def emit(windows):
            nonlocal next_sequence, next_group
            groups = balanced(windows, step_tokens)
            columns: list[list] = [[] for _ in range(9)]
            for (size, pieces), group in zip(windows, groups, strict=True):
                offset = 0
                for doc, start, length in pieces:
                    key, ids, held_from, tokens = docs_held[doc]
                    at = start - held_from
                    row = (key, start, length, ids[at:at + length].tobytes(), tokens, next_sequence, offset, size,
                           next_group + group)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += length
                next_sequence += 1
            next_group += max(groups, default=-1) + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        types = names = None
        for batch in slices(batches):
            if types is None:
                types = [batch.schema.field(0).type, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
                names = ["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            ready = []
            whole = set()
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(enc.ids(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
                tail = len(ids) % window
                ready += [(window, [(number, s, window)]) for s in range(0, len(ids) - tail, window)]
                docs_held[number] = (key, ids, 0, len(ids))
                whole.add(number)
                if tail:
                    packer.add((number, len(ids) - tail, tail))
                number += 1
            if packer.count >= pool:
                ready += packer.pack()
            if ready:
                yield emit(ready)
            left = {piece[0] for pieces in packer.by_length for piece in pieces}
            docs_held = {
                d: (k, ids[s - at:].copy(), s, n) if d in whole and (s := n - n % window) > at else (k, ids, at, n)
                for d, (k, ids, at, n) in docs_held.items() if d in left
            }
        ready = list(packer.flush())
        if ready:
            yield emit(ready)

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return map_arrow(texts, run, schema).withColumnRenamed("_id", id_col)


@query("op9_pack_documents")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
