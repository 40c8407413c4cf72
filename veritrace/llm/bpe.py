"""BPE encoding and decoding with an index of pair occurrences over the words of a partition."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm.common import documents, map_arrow, slices
from veritrace.llm.registry import query
from veritrace.llm.tokens import NOT_SAFE, byte_alphabet

#: Text whose distinct words are merged together, in characters.
CHUNK_CHARS = 4_000_000
#: Words whose ids a task keeps from chunk to chunk; the cache starts anew beyond it.
CACHE_WORDS = 300_000


class WordBPE:
    """A word-level BPE vocabulary: normaliser, splitter, merges by rank, tokens by id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)  # splits texts whose characters Unicode versions class differently
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        if [s["type"] for s in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or model.get("unk_token"):
            raise ValueError(f"{path} is not a word-level BPE file")
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.token = [names.get(i, "") for i in range(max(names) + 1)]
        shown = {b: c for c, b in byte_alphabet().items()}
        self.inner = [vocab[shown[b]] for b in range(256)]
        self.last = [vocab[shown[b] + self.suffix] for b in range(256)]
        self.merges: dict[int, tuple[int, int, int, int]] = {}  # pair key: rank, left, right, merged
        self.by_rank: list[int] = []
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left, right = vocab[a], vocab[b]
            self.merges[left << 20 | right] = (rank, left, right, vocab[a + b])
            self.by_rank.append(left << 20 | right)

    def words(self, text: str) -> list[str]:
        if NOT_SAFE.search(text):
            normal = self.library.normalizer.normalize_str(text)
            return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def pieces(self, text: str) -> list[tuple[int | None, list[str]]]:
        """Words of the text between special strings, each run followed by the id of the special string or None."""
        if self.special_pattern is None or "<" not in text:
            return [(None, self.words(text))]
        parts = self.special_pattern.split(text)
        return [(self.special.get(s), self.words(t)) for t, s in zip(parts[::2], [*parts[1::2], None], strict=True)]

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each distinct word, as little-endian 32-bit integers.

        All words lie in one array of symbols. The index maps each pair that can merge to the positions where it
        begins; ranks that occur are taken in ascending order, all positions of a rank are merged from left to right,
        and the pairs that appear beside a merge go into the lists of their own ranks.
        """
        symbols: list[int] = []
        following: list[int] = []
        before: list[int] = []
        lengths = []
        inner, last, merges = self.inner, self.last, self.merges
        for word in words:
            data = word.encode()
            at = len(symbols)
            symbols += [inner[b] for b in data]
            end = len(symbols)
            symbols[-1] = last[data[-1]]
            following += range(at + 1, end + 1)
            following[-1] = -1
            before += range(at - 1, end - 1)
            before[at] = -1
            lengths.append(end - at)
        places: dict[int, list[int]] = {}
        ranks: list[int] = []
        for at, after in enumerate(following):
            if after >= 0 and (key := symbols[at] << 20 | symbols[after]) in merges:
                if key in places:
                    places[key].append(at)
                else:
                    places[key] = [at]
                    ranks.append(merges[key][0])
        heapq.heapify(ranks)
        while ranks:
            key = self.by_rank[heapq.heappop(ranks)]
            _, left, right, merged = merges[key]
            for at in sorted(places.pop(key)):
                gone = following[at]
                if symbols[at] != left or gone < 0 or symbols[gone] != right:
                    continue
                symbols[at], symbols[gone] = merged, -1
                after, ahead = following[gone], before[at]
                following[at] = after
                if after >= 0:
                    before[after] = at
                    self._note(merged << 20 | symbols[after], at, places, ranks)
                if ahead >= 0:
                    self._note(symbols[ahead] << 20 | merged, ahead, places, ranks)
        flat = np.asarray(symbols, dtype=np.int64)
        alive = flat >= 0
        counts = np.add.reduceat(alive, np.concatenate(([0], np.cumsum(lengths)[:-1]))) if words else []
        data = flat[alive].astype("<u4").tobytes()
        ends = np.cumsum(counts) * 4
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if words else []

    def _note(self, key: int, at: int, places: dict[int, list[int]], ranks: list[int]) -> None:
        found = self.merges.get(key)
        if found is None:
            return
        if key in places:
            places[key].append(at)
        else:
            places[key] = [at]
            heapq.heappush(ranks, found[0])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBPE:
    return WordBPE(path)


def _chunks(batches) -> Iterator[tuple[list, list[str]]]:
    keys, texts, size = [], [], 0
    for batch in slices(batches, 64):
        keys += batch.column(0).to_pylist()
        texts += [t or "" for t in batch.column(1).to_pylist()]
        size += sum(map(len, texts[-batch.num_rows:]))
        if size >= CHUNK_CHARS:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def encode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``ids``, the token ids of the whole text as little-endian 32-bit integers.

    No token is added at the ends, special strings inside a text become their ids, nothing is cut or padded. A null
    text is an empty one and has no ids. Null ids and repeated rows keep their own row, an empty table gives none, and
    other columns of ``docs`` are ignored. A task holds the words of one chunk of text and a bounded cache of words.
    """
    def run(batches):
        bpe = vocabulary(tokenizer)
        cache: dict[str, bytes] = {}
        for keys, texts in _chunks(batches):
            split = [bpe.pieces(t) for t in texts]
            wanted = {w for pieces in split for _, words in pieces for w in words}
            if len(cache) + len(wanted) > CACHE_WORDS:
                cache = {}
            new = list(wanted.difference(cache))
            cache.update(zip(new, bpe.merge(new), strict=True))
            out = [
                b"".join([part for special, words in pieces for part in (
                    *map(cache.__getitem__, words), *([] if special is None else [special.to_bytes(4, "little")]))])
                for pieces in split
            ]
            yield pa.RecordBatch.from_arrays([pa.array(keys, id_type), pa.array(out, pa.binary())], names=["_id", "ids"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(source.dtypes)["_id"]
    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    return map_arrow(source, run, f"_id {kind}, ids binary").withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, tokenizer: str, *, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, ``ids`` and ``decoded``, the tokens of all ids (special ones too) joined by a blank.

    Null ids give a null text, no ids an empty one.
    """
    def run(batches):
        token = vocabulary(tokenizer).token
        for batch in slices(batches, 64):
            decoded = [
                None if ids is None else " ".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], names=["_id", "ids", "decoded"])

    source = encoded.select(F.col(id_col).alias("_id"), "ids")
    schema = f"_id {dict(source.dtypes)['_id']}, ids binary, decoded string"
    return map_arrow(source, run, schema).withColumnRenamed("_id", id_col)


@query("op6_bpe_round_trip")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return decode(encode(documents(spark, sf_dir), path), path).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
