"""Collocations: phrases that occur often and bind tightly, by mergeable Misra-Gries summaries and an exact second pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrace.llm.common import documents, map_arrow, salted_join, slices, spread_keys
from veritrace.llm.registry import query
from veritrace.session import materialize

#: Bytes of text that are counted together before anything is sent.
FLUSH_BYTES = 5 << 20
#: Counters of a summary that one task merges; the number of hash partitions follows from the mass of the corpus.
COUNTERS = 1 << 20
#: Bits of the filter that the second pass reads, at most: 32 MB whatever the data.
FILTER_BITS = 28
#: Bytes that end a piece, and the two marks that stand for the end of a piece and of a text (no byte of UTF-8).
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
PIECE, TEXT = b"\xff", b"\xfe"
FOLD = bytes.maketrans(bytes(range(65, 91)) + PIECE_ENDS, bytes(range(97, 123)) + PIECE * len(PIECE_ENDS))

PART_SCHEMA = "part int, kind int, mass long, keys binary, counts binary"
PHRASES_SCHEMA = "part int, kind int, keys binary, langs array<string>, phrases array<string>, lengths array<int>, counts array<long>"
PHRASES_TYPES = {
    "part": pa.int32(), "kind": pa.int32(), "keys": pa.binary(), "langs": pa.list_(pa.string()), "phrases": pa.list_(pa.string()),
    "lengths": pa.list_(pa.int32()), "counts": pa.list_(pa.int64())}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Flush:
    """The words of some texts as numbers, with marks between pieces and texts."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        joined = TEXT.join(texts).translate(FOLD)
        tokens = joined.replace(PIECE, b" \xff ").replace(TEXT, b" \xfe ").split()
        index: dict[bytes, int] = {PIECE: 0, TEXT: 1}
        put = index.setdefault
        self.ids = np.fromiter((put(t, len(index)) for t in tokens), np.int64, len(tokens))
        self.words = list(index)
        self.langs = sorted(set(langs))
        number = {name: i for i, name in enumerate(self.langs)}
        text_lang = np.array([number[name] for name in langs], dtype=np.int64)
        self.lang = text_lang[np.cumsum(self.ids == 1)] if len(self.ids) else np.zeros(0, np.int64)
        self.is_word = self.ids > 1

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: where a phrase of it begins (a mask), and its 64-bit hash, which holds the language, too."""
        import xxhash

        word = np.array([xxhash.xxh64_intdigest(w, 7) for w in self.words], dtype=np.uint64)[self.ids]
        seeds = np.array([xxhash.xxh64_intdigest(name.encode(), 11) for name in self.langs] or [0], dtype=np.uint64)
        starts, hashes = self.is_word, _mix(word ^ seeds[self.lang])
        for length in range(1, longest + 1):
            if length > 1:
                starts, hashes = starts[:-1] & self.is_word[length - 1:], _mix(
                    hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[length - 1:])
            yield length, starts, hashes
            if len(starts) < 2:
                return


def flushes(batches) -> Iterator[Flush]:
    """Texts put together up to a number of bytes. A longer text is cut where a piece ends, so no phrase is lost."""
    langs: list[str] = []
    texts: list[bytes] = []
    held = 0
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            while text:
                end = len(text)
                if end > FLUSH_BYTES:
                    folded = text.translate(FOLD)
                    end = folded.find(PIECE, FLUSH_BYTES) + 1 or end
                langs.append(lang)
                texts.append(text[:end])
                held += end
                text = text[end:]
                if held >= FLUSH_BYTES:
                    yield Flush(langs, texts)
                    langs, texts, held = [], [], 0
    if texts:
        yield Flush(langs, texts)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending numbers as differences, compressed byte plane by byte plane."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class Summary:
    """A Misra-Gries summary with ``capacity`` counters; summaries are merged by adding counters and cutting back.

    What is cut from each of ``capacity + 1`` counters comes off the mass, so in all at most
    ``mass / (capacity + 1)`` is cut from any counter: with ``capacity >= mass // threshold`` that is less than
    the threshold, and a key that occurs so often is still there at the end.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.cut = 0
        self._keys: list[np.ndarray] = []
        self._counts: list[np.ndarray] = []
        self._held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._keys.append(keys)
        self._counts.append(counts)
        self._held += len(keys)
        if self._held >= max(self.capacity, 1 << 19):
            self.merge()

    def merge(self) -> None:
        if not self._held:
            return
        keys = np.concatenate([self.keys, *self._keys])
        counts = np.concatenate([self.counts, *self._counts])
        self._keys, self._counts, self._held = [], [], 0
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        if len(keys) > self.capacity:
            cut = np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1]
            counts = counts - cut
            keys, counts = keys[counts > 0], counts[counts > 0]
            self.cut += int(cut)
        self.keys, self.counts = keys, counts

    def survivors(self, threshold: int) -> np.ndarray:
        """Keys that may have reached the threshold: no true count is higher than the counter plus what was cut."""
        self.merge()
        return self.keys[self.counts + self.cut >= threshold]


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, n: all words of each language."""
    end = np.zeros(256, dtype=bool)
    end[list(b" \t" + PIECE_ENDS + TEXT)] = True

    def count(batches):
        totals: dict[str, int] = {}
        for batch in slices(batches):
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for lang, text in rows:
                gap = end[np.frombuffer(text, np.uint8)]
                n = int(np.count_nonzero(gap[:-1] & ~gap[1:])) + int(len(gap) > 0 and not gap[0])
                totals[lang] = totals.get(lang, 0) + n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["lang", "n"])

    return map_arrow(texts, count, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def survivors(spark: SparkSession, texts: DataFrame, mass: int, min_count: int, longest: int) -> tuple[DataFrame, int]:
    """First pass: per range of hashes the hashes that may have ``min_count`` occurrences, and how many bits number a range."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(8, min(width, 1024), -(-mass // (min_count * COUNTERS)))
    bits = (parts - 1).bit_length()

    def summarise(batches):
        for flush in flushes(batches):
            found = [hashes[starts] for _, starts, hashes in flush.grams(longest)]
            keys = np.sort(np.concatenate(found)) if found else np.zeros(0, np.uint64)
            if not len(keys):
                continue
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            counts = np.diff(first, append=len(keys))
            keys = keys[first]
            edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            rows = []
            for part, (a, b) in enumerate(zip(edges, [*edges[1:], len(keys)], strict=True)):
                if a < b:
                    rows += [(part, 0, int(counts[a:b].sum()), None, None),
                             (part, 1, 0, pack_keys(keys[a:b]), pack_counts(counts[a:b]))]
            yield from _part_rows(rows)

    def merge(batches):
        summary = mass_seen = None
        at = -1

        def done():
            keys = summary.survivors(min_count) if summary is not None else np.zeros(0, np.uint64)
            return _part_rows([(at, 2, len(keys), pack_keys(keys), None)])

        for batch in slices(batches, 16):
            for row in batch.to_pylist():
                if row["part"] != at:
                    if at >= 0:
                        yield from done()
                    at, summary, mass_seen = row["part"], None, 0
                if row["kind"] == 0:  # all masses of a partition come before its keys
                    mass_seen += row["mass"]
                    continue
                if summary is None:
                    summary = Summary(mass_seen // min_count + 1)
                summary.add(unpack_keys(row["keys"]), unpack_counts(row["counts"]))
        if at >= 0:
            yield from done()

    dealt = map_arrow(texts, summarise, PART_SCHEMA).repartitionById(1 << bits, F.col("part"))
    return materialize(map_arrow(dealt.sortWithinPartitions("part", "kind"), merge, PART_SCHEMA), "phrase-hashes"), bits


def survivor_filter(found: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """A bit array over hash prefixes in which every surviving hash has its bit set; never more than FILTER_BITS bits
    unless the hash ranges alone are more."""
    n = found.agg(F.sum("mass")).first()[0] or 0
    size = max(bits + 3, 16, min(FILTER_BITS, (16 * n).bit_length()))

    def mark(batches):
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            places = (unpack_keys(row["keys"]) >> np.uint64(64 - size)).astype(np.int64) & ((1 << size - bits) - 1)
            hit = np.zeros(1 << size - bits, dtype=bool)
            hit[places] = True
            yield from _part_rows([(row["part"], 3, 0, np.packbits(hit).tobytes(), None)])

    filled = np.zeros(1 << size - 3, dtype=np.uint8)
    step = 1 << size - bits - 3
    for row in map_arrow(found, mark, PART_SCHEMA).collect():  # as many bytes as the filter has, a fixed bound
        filled[row.part * step:(row.part + 1) * step] = np.frombuffer(row["keys"], np.uint8)
    return filled, size


def _part_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
            names=["part", "kind", "mass", "keys", "counts"])


def frequent_phrases(
    docs: DataFrame, *, min_count: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang",
) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with at least ``min_count`` occurrences in their language, counted exactly.

    Gives (lang, phrase, length, f) and the words of each language (lang, n), both written. The first pass sums
    64-bit hashes in Misra-Gries summaries, one per range of hashes; the second counts the phrases themselves whose
    hash, and those of the phrases inside them, survived. Map tasks drop what a filter of bounded size does not hold, and
    the task of a range counts only what survived there: were the filter too small for a corpus, more would be shuffled,
    and nothing lost or held beyond the summaries' size.

    A null text counts as empty, a null language as ``und``. Repeated rows count as often as they stand there. An empty
    table gives two empty tables. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    words = materialize(word_counts(texts), "language-words")
    total = words.agg(F.sum("n")).first()[0] or 0
    found, bits = survivors(spark, texts, longest * total, min_count, longest)
    filled, size = survivor_filter(found, bits)
    shared = spark.sparkContext.broadcast(filled)

    def count(batches):
        hit = shared.value
        for flush in flushes(batches):
            yield from _packed(flush, hit, size, longest, bits)

    counted = map_arrow(texts, count, PHRASES_SCHEMA)
    known = found.select(
        "part", F.lit(0).alias("kind"), "keys", *[F.lit(None).cast(kind).alias(name) for name, kind in (
            ("langs", "array<string>"), ("phrases", "array<string>"), ("lengths", "array<int>"), ("counts", "array<long>"))])
    dealt = known.unionByName(counted).repartitionById(1 << bits, F.col("part")).sortWithinPartitions("part", "kind")

    def total_up(batches):
        at, keys, totals = -1, None, {}
        for batch in slices(batches, 4):
            for row in batch.to_pylist():
                if row["part"] != at:
                    yield from _frequent(totals, min_count)
                    at, keys, totals = row["part"], np.zeros(0, np.uint64), {}
                if row["kind"] == 0:  # what survived comes before what was seen
                    keys = unpack_keys(row["keys"])
                    continue
                seen = unpack_keys(row["keys"])
                place = np.searchsorted(keys, seen)
                for i in np.flatnonzero(keys[np.minimum(place, len(keys) - 1)] == seen).tolist() if len(keys) else ():
                    phrase = row["langs"][i], row["phrases"][i], row["lengths"][i]
                    totals[phrase] = totals.get(phrase, 0) + row["counts"][i]
        yield from _frequent(totals, min_count)

    return materialize(map_arrow(dealt, total_up, "lang string, phrase string, length int, f long"), "phrases"), words


def _frequent(totals: dict[tuple[str, str, int], int], min_count: int) -> Iterator[pa.RecordBatch]:
    kept = [(*phrase, f) for phrase, f in totals.items() if f >= min_count]
    for a in range(0, len(kept), 20_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*kept[a:a + 20_000], strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)],
            names=["lang", "phrase", "length", "f"])


def _counts(flush: Flush, hit: np.ndarray, size: int, longest: int) -> Iterator[tuple]:
    """The phrases of a flush that the filter lets through, by length, each once: hashes, languages, bytes, occurrences."""
    width = len(flush.words)
    names: list[bytes] = []
    dense = flush.lang
    kept = np.zeros(0, dtype=bool)
    langs = np.zeros(0, np.int64)
    for length, starts, hashes in flush.grams(longest):
        place = (hashes >> np.uint64(64 - size)).astype(np.int64)
        inside = starts & (hit[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
        if length > 1:
            inside &= kept[:-1] & kept[1:]
        kept = inside
        at = np.flatnonzero(kept)
        if not len(at):
            return
        keys, first, number, counts = np.unique(
            dense[at] * width + flush.ids[at + length - 1], return_index=True, return_inverse=True, return_counts=True)
        before, last = np.divmod(keys, width)
        if length == 1:
            names, langs = [flush.words[i] for i in last], before
        else:
            names, langs = [names[a] + b" " + flush.words[b] for a, b in zip(before.tolist(), last.tolist(), strict=True)], langs[before]
        dense = np.zeros(len(kept), np.int64)
        dense[at] = number
        yield length, hashes[at[first]], langs, names, counts


def _packed(flush: Flush, hit: np.ndarray, size: int, longest: int, bits: int) -> Iterator[pa.RecordBatch]:
    """One row for each range of hashes, which holds the phrases of a flush in it in the order of their hashes."""
    found = list(_counts(flush, hit, size, longest))
    if not found:
        return
    keys, langs, counts = (np.concatenate([f[k] for f in found]) for k in (1, 2, 4))
    names = [name for f in found for name in f[3]]
    lengths = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
    order = np.argsort(keys, kind="stable")
    keys, langs, counts, lengths = keys[order], langs[order], counts[order], lengths[order]
    names = [names[i] for i in order.tolist()]
    edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    rows, held = [], 0
    for part, (a, b) in enumerate(zip(edges, [*edges[1:], len(keys)], strict=True)):
        if a < b:
            rows.append((part, 1, pack_keys(keys[a:b]), [flush.langs[i] for i in langs[a:b].tolist()],
                         [name.decode() for name in names[a:b]], lengths[a:b], counts[a:b]))
            held += b - a
        if held > 50_000:
            yield _phrase_rows(rows)
            rows, held = [], 0
    if rows:
        yield _phrase_rows(rows)


def _phrase_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PHRASES_TYPES.values(), strict=True)], names=list(PHRASES_TYPES))


def collocations(
    docs: DataFrame, *, min_count: int = 100, longest: int = 5, top: int = 2000, share: int = 100,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """The ``top`` phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of ``a`` occurrences cut into two parts with ``l`` and ``r`` occurrences scores
    ``floor(1000 * a * n / (l * r))``; its lowest cut counts, the shortest first part among equals. A phrase
    inside a longer one that has at least ``share`` percent of its occurrences is left out. Arithmetic is decimal with 38
    digits, exact up to 10**17 words of a language.

    Nulls, repeated rows and empty tables: see ``frequent_phrases``. Ties of the score go to more occurrences, then to the
    smaller phrase in byte order.
    """
    freq, words = frequent_phrases(docs, min_count=min_count, longest=longest, text_col=text_col, lang_col=lang_col)
    word = F.split("phrase", " ")
    several = freq.where(F.col("length") > 1).withColumn("word", word)

    def span(start: int, length: int):
        return F.array_join(F.slice("word", start + 1, length), " ")

    inside = [
        F.when((F.col("length") > length) & (F.col("length") >= start + length), span(start, length))
        for length in range(2, longest) for start in range(longest - length + 1)]
    inner = several.select("lang", "f", F.explode(F.array_compact(F.array(*inside, F.lit(None).cast("string")))).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))

    cuts = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), (
            span(0, k) if side == "l" else F.array_join(F.slice("word", k + 1, longest), " ")).alias("part"))
        for k in range(1, longest) for side in "lr"])
    parts = several.select("lang", "phrase", F.explode(cuts).alias("_cut"), "length").where(F.col("_cut.k") < F.col("length")).select(
        "lang", "phrase", F.col("_cut.k").alias("k"), F.col("_cut.side").alias("side"),
        F.struct("lang", F.col("_cut.part").alias("phrase")).alias("_key"))
    asked = parts.groupBy("_key").agg(F.count(F.lit(1)).alias("_asked"))
    total = 2 * (longest - 1) * several.count()
    known = freq.select(F.struct("lang", "phrase").alias("_key"), F.col("f").alias("part_f"))
    looked_up = salted_join(parts, known, "_key", "phrase", spread_keys(asked, "_key", "_asked", total))

    whole = "decimal(38,0)"
    by_cut = looked_up.groupBy("lang", "phrase").agg(*[
        F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("part_f"))).alias(f"_{side}{k}")
        for k in range(1, longest) for side in "lr"])
    scored = several.select("lang", "phrase", F.col("f").alias("a")).join(by_cut, ["lang", "phrase"]).join(words, "lang")
    options = [
        F.when(F.col(f"_l{k}").isNotNull(), F.struct(
            F.expr(f"(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div "
                   f"(cast(_l{k} as decimal(18,0)) * cast(_r{k} as decimal(18,0)))").cast("long").alias("score"),
            F.lit(k).alias("k"), F.col(f"_l{k}").cast("long").alias("l"), F.col(f"_r{k}").cast("long").alias("r")))
        for k in range(1, longest)]
    best = options[0] if len(options) == 1 else F.least(*options)
    kept = scored.withColumn("_best", best).join(covered, ["lang", "phrase"], "left").where(
        F.col("_longer").isNull() | (F.col("_longer").cast(whole) * 100 < F.col("a").cast(whole) * share))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return kept.select("lang", "phrase", "a", "_best.l", "_best.r", "n", "_best.score").withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
            "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with texts as (select coalesce(lang, 'und') as lang, row_number() over () as doc,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from texts),
lists as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, cast(sum(len(w)) as hugeint) as n from lists group by lang),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from lists where len(w) > 0),
grams as (select lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) as m from starts),
freq as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, m, cast(count(*) as hugeint) as f
    from grams group by 1, 2, 3 having count(*) >= 100),
cand as (select lang, phrase, m, f, string_split(phrase, ' ') as w from freq where m > 1),
cuts as (select lang, phrase, m, f, w, unnest(range(1, m)) as k from cand),
scored as (select c.lang, c.phrase, c.f as a, l.f as l, r.f as r, t.n, c.k, (1000 * c.f * t.n) // (l.f * r.f) as score
    from cuts c join totals t on t.lang = c.lang
    join freq l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:c.k], ' ')
    join freq r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
lengths as (select lang, w, f, m, unnest(range(2, m)) as sub from cand where m > 2),
inner_phrases as (select lang, w, f, sub, unnest(range(1, m - sub + 2)) as s from lengths),
covered as (select lang, array_to_string(w[s:s + sub - 1], ' ') as phrase, max(f) as longer from inner_phrases group by 1, 2),
kept as (select b.* from best b left join covered c on c.lang = b.lang and c.phrase = b.phrase
    where c.longer is null or 100 * c.longer < 100 * b.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n,
    cast(score as bigint) as score
from ranked where rank <= 2000
"""


@query("op11_collocations", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))
