"""Alignment of two tokenizers: groups where both end together, links where tokens overlap, and how usual each link is."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.common import documents, map_arrow, slices
from veritrace.llm.registry import query
from veritrace.llm.tokens import NOT_SAFE, Encoder, byte_alphabet
from veritrace.session import materialize

#: Bytes of text that share one list of id pairs, and bytes whose tokens are aligned in one go.
CHUNK_BYTES, SLICE_BYTES = 12 << 20, 1 << 20
NO_GROUPS = ""


class Tokenizers:
    """Ids of both tokenizers and the bytes behind each id. Special strings in a text are ordinary text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = Encoder(a_path)
        self.a.library.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        vocab = self.a.library.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        size = self.b.get_piece_size()
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
            else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(size)]
        self.a_size, self.b_size = (np.array([len(x) for x in of], dtype=np.int64) for of in (self.a_bytes, self.b_bytes))
        #: An id as text, with what follows it inside its part of a group, then with what ends that part.
        self.a_text = np.array([f"{i}," for i in range(len(self.a_bytes))] + [f"{i}|" for i in range(len(self.a_bytes))], dtype=object)
        self.b_text = np.array([f"{i}," for i in range(size)] + [f"{i};" for i in range(size)], dtype=object)

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both, or None where the tokens do not spell a blank and the text."""
        spaced = " " + text
        if self.a.fast is not None and not NOT_SAFE.search(text):
            a = self.a.fast.encode_to_numpy(spaced, allowed_special=set(), disallowed_special=()).tolist()
        else:
            a = self.a.library.encode(spaced, add_special_tokens=False).ids
        b = self.b.encode(text)
        want = spaced.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def coalesce(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and links of two rows of tokens over the same bytes, given the bytes of each token.

    All tokens are sorted by where they start; a group ends where the next start reaches the furthest end so far.
    Gives the group of each A token and of each B token, and the places in A and in B of each overlapping pair: both rows
    cover all bytes, so each stretch between two neighbouring starts lies in just one token of either, and is one link.
    """
    ends = np.concatenate([np.cumsum(a_sizes), np.cumsum(b_sizes)])
    starts = ends - np.concatenate([a_sizes, b_sizes])
    from_b = np.arange(len(starts)) >= len(a_sizes)
    order = np.lexsort((from_b, starts))
    starts, ends, from_b = starts[order], ends[order], from_b[order]
    furthest = np.maximum.accumulate(ends)
    group = np.cumsum(np.concatenate([[False], starts[1:] >= furthest[:-1]]))
    a_at, b_at = np.cumsum(~from_b) - 1, np.cumsum(from_b) - 1
    link = np.concatenate([starts[1:] != starts[:-1], [True]])  # the last token that begins here
    return group[~from_b], group[from_b], a_at[link], b_at[link]


class Chunk:
    """Aligned documents that share a list of id pairs."""

    def __init__(self, tools: Tokenizers):
        self.tools = tools
        self.rows: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: list, texts: list[str | None]) -> None:
        tools = self.tools
        found = [tools.ids(t) if t else None for t in texts]
        n_a, n_b = (np.array([len(f[k]) if f else 0 for f in found], dtype=np.int64) for k in (0, 1))
        self.held += sum(len(t) for t in texts if t)
        if not n_a.any():
            self.rows += [(i, 0, 0, 0, 0, NO_GROUPS) for i in ids]
            return
        a, b = (np.concatenate([f[k] for f in found if f]) for k in (0, 1))
        group_a, group_b, link_a, link_b = coalesce(tools.a_size[a], tools.b_size[b])
        last_a, last_b = (np.concatenate([g[1:] != g[:-1], [True]]) for g in (group_a, group_b))
        # In the text a group's A ids come before its B ids: each token moves by the other kind's tokens before it.
        parts = np.empty(len(a) + len(b), dtype=object)
        a_in, b_in = np.bincount(group_a), np.bincount(group_b)
        parts[np.arange(len(a)) + (np.cumsum(b_in) - b_in)[group_a]] = tools.a_text[a + last_a * len(tools.a_bytes)]
        parts[np.arange(len(b)) + np.cumsum(a_in)[group_b]] = tools.b_text[b + last_b * len(tools.b_bytes)]
        a_ends, ends = np.cumsum(n_a), np.cumsum(n_a + n_b)
        groups_to = np.concatenate([[0], np.cumsum(last_a)])[a_ends]
        links_to = np.searchsorted(link_a, a_ends, "left")
        self.pairs.append(a[link_a] * len(tools.b_bytes) + b[link_b])
        n_groups, n_links = np.diff(groups_to, prepend=0), np.diff(links_to, prepend=0)
        for k, i in enumerate(ids):
            digest = NO_GROUPS
            if n_a[k]:
                spelled = "".join(parts[ends[k] - n_a[k] - n_b[k]:ends[k]])[:-1]
                digest = hashlib.sha256(spelled.encode()).hexdigest()
            self.rows.append((i, int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), digest))

    def batches(self, chunk: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """A row per document with its links as places in the chunk's list of pairs, then a row per pair."""
        width = len(self.tools.b_bytes)
        links = np.concatenate(self.pairs) if self.pairs else np.zeros(0, np.int64)
        keys, number, counts = np.unique(links, return_inverse=True, return_counts=True)
        n_links = np.array([r[4] for r in self.rows], dtype=np.int64)
        of = np.repeat(np.arange(len(self.rows)), n_links) * max(len(keys), 1) + number
        seen, times = np.unique(of, return_counts=True)
        edges = np.searchsorted(seen, np.arange(len(self.rows) + 1) * max(len(keys), 1))
        squeezed = [pack_links(seen[x:y] - k * len(keys), times[x:y]) for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False))]
        for at in range(0, len(self.rows), 1024):
            rows = self.rows[at:at + 1024]
            ids, *rest = zip(*rows, strict=True)
            yield batch_of(len(rows), id_type, kind=0, chunk=chunk, id=pa.array(ids, id_type), links=pa.array(squeezed[at:at + 1024], pa.binary()), **{
                name: pa.array(column, pa.string() if name == "groups_sha256" else pa.int64())
                for name, column in zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"), rest, strict=True)})
        for at in range(0, len(keys), 50_000):
            some = keys[at:at + 50_000]
            yield batch_of(len(some), id_type, kind=1, chunk=chunk, place=pa.array(np.arange(at, at + len(some)), pa.int32()),
                           a=pa.array(some // width, pa.int32()), b=pa.array(some % width, pa.int32()), n=pa.array(counts[at:at + 50_000]))


def pack_links(places: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending places as differences, and how often each stands there, byte plane by byte plane."""
    both = np.concatenate([np.diff(places, prepend=0), times]).astype("<u4")
    return zstandard.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_links(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(both[:len(both) // 2]), both[len(both) // 2:]


def fields(id_type: pa.DataType) -> list[tuple[str, pa.DataType]]:
    whole = [(name, pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links")]
    return [("kind", pa.int32()), ("chunk", pa.int64()), ("id", id_type), *whole, ("groups_sha256", pa.string()),
            ("links", pa.binary()), ("place", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]


def batch_of(rows: int, id_type: pa.DataType, *, kind: int, chunk: int, **columns: pa.Array) -> pa.RecordBatch:
    columns |= {"kind": pa.array(np.full(rows, kind), pa.int32()), "chunk": pa.array(np.full(rows, chunk), pa.int64())}
    return pa.RecordBatch.from_arrays(
        [columns[name] if name in columns else pa.nulls(rows, of) for name, of in fields(id_type)],
        names=[name for name, _ in fields(id_type)])


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level ``tokenizers`` file that is given a blank and the text, B a ``sentencepiece`` model that adds the
    blank. Texts are aligned once, in chunks; a chunk's distinct id pairs are counted over the corpus, and the counts
    go back to the chunk, whose documents hold their links as places in its list. So what is shuffled grows with the
    distinct pairs of chunks and the distinct pairs of documents, not with all links.

    A row whose text is null, empty, or not spelled by its tokens has zeros and an empty digest. Rows with null or
    repeated ids and repeated rows are rows of their own. An empty table gives no rows; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def cut(batches):
        tools, chunk = tokenizers(a_path, b_path), None
        base, made = TaskContext.get().partitionId() << 32, 0
        id_arrow = None
        for batch in slices(batches):
            id_arrow = batch.schema.field(0).type
            ids, some, size = [], [], 0
            chunk = chunk or Chunk(tools)
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                some.append(text)
                size += len(text or "")
                if size >= SLICE_BYTES:
                    chunk.add(ids, some)
                    ids, some, size = [], [], 0
            if ids:
                chunk.add(ids, some)
            if chunk.held >= CHUNK_BYTES:
                yield from chunk.batches(base + made, id_arrow)
                chunk, made = None, made + 1
        if chunk is not None:
            yield from chunk.batches(base + made, id_arrow)

    aligned = materialize(map_arrow(texts, cut, (
        f"kind int, chunk long, id {id_type.simpleString()}, n_a long, n_b long, n_groups long, n_links long, "
        "groups_sha256 string, links binary, place int, a int, b int, n long")), "aligned")
    pairs = aligned.where("kind = 1").select("chunk", "place", "a", "b", "n")
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))  # at most one row for each id of B's vocabulary
    ranked = counts.join(F.broadcast(highest), "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    replies = pairs.join(ranked, ["a", "b"]).select(F.col("chunk").alias("to_chunk"), "place", "count", "best")
    rows = aligned.where("kind = 0").select("chunk", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy()
        sums = []
        for data in left.column("links").to_pylist():
            at, times = unpack_links(data)
            sums.append((int(times @ best[at]), int(times @ count[at])))
        n_best, count_sum = zip(*sums, strict=True) if sums else ((), ())
        out = left.select(["id", "n_a", "n_b", "n_groups", "n_links"])
        out = out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        return out.append_column("groups_sha256", left.column("groups_sha256"))

    return rows.groupBy("chunk").cogroup(replies.groupBy("to_chunk")).applyInArrow(total, (
        f"id {id_type.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string")).withColumnRenamed("id", id_col)


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
