"""Quality rules and toxicity, archives, chats and the pipeline."""

import gzip
import math
import re
from collections import Counter, defaultdict

import pytest
from check_oracles import compare, connect
from odd_docs import make_docs, odd_rows  # noqa: F401
from pyspark.sql import functions as F

from veritrace.llm import chat, quality, toxicity, warc
from veritrace.llm.catalog import ORACLES, QUERIES
from veritrace.session import new_folder

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_its_sql(spark, name):
    assert compare(spark, connect(SF_DIR), SF_DIR, name, QUERIES, ORACLES) == ""


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    repeated = {p + k for v in windows.values() if len(v) > 1 for p in v for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def test_quality_counts(spark, make_docs, odd_rows):
    rows = odd_rows + [(30, "a b c d e f g h " * 5), (31, "x\ny\nx\n \nx"), (32, "# one | two\u00a0three\n# one | two\u00a0three")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    found = quality.quality_verdicts(make_docs(rows), labels).collect()
    got = Counter((str(r._row._id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found)
    assert got == Counter((str(i), *plain_counts(t)) for i, t in rows)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in found)
    assert all(r.kept != r.base_failed for r in found)  # so few labels prove no cutoff
    assert quality.quality_verdicts(make_docs([]), labels).count() == 0
    assert quality.keep_good(make_docs(rows), labels).columns == ["doc_id", "text", "lang", "_id", "score"]


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (1, 10), (3, 40), (20, 3000), (9, 9)]
    rows = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.1).alias("p")).collect()
    for r in rows:
        exact = sum(math.comb(r.n, i) * 0.1**i * 0.9 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(exact, rel=1e-9) if r.k <= r.n * 0.1 else r.p == 1


def test_cutoffs_stop_at_the_first_unsafe_one(spark):
    rows = [("a", 0.0 if i % 100 else 0.28, 0.0, 0.0, 0.0) for i in range(5000)]
    holdout = spark.createDataFrame(rows, "s string, symbol_share double, upper_share double, repeat_share double, dup_line_share double")
    cut = quality.select_cutoffs(holdout, "s", 0.02, 0.05).first()
    assert cut.cut_symbol_share == 0.3 and cut.cut_upper_share == min(quality.CUTOFFS)


def test_toxicity_learns_words_and_beginnings(spark, make_docs):
    rows = [(i, f"plain words of text number {i} and more " + ("vileness" + "abcdefgh"[i % 8] if i % 4 == 0 else "calm")) for i in range(800)]
    rows += [(2000, None), (2001, ""), (None, "plain words")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)] + [(0, 0)], "doc_id long, toxic int")
    found = {r._row._id: r.score for r in toxicity.scored(make_docs(rows), labels).collect()}
    assert len(found) == len(rows) and all(0 <= s <= 1 for s in found.values())
    assert all((found[i] >= 0.5) == (i % 4 == 0) for i in range(800))
    assert found[2000] == found[2001] < 0.5
    assert toxicity.drop_toxic(make_docs(rows), labels).columns == ["doc_id", "text", "lang", "_id", "score"]
    assert {r.score for r in toxicity.scored(make_docs(rows), labels.limit(0)).collect()} == {0.0}
    assert toxicity.scored(make_docs([]), labels).count() == 0


def test_archives_are_read_alike_in_splits_of_any_size(spark):
    same = "<p>" + "shared payload " * 20
    pages = [(1, "http://a/é b\n", same), (2, None, same), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
             (None, "u", same), (1, "again", same), (7, "u", "x\r\n\r\nWARC/1.1\r\n" * 40), (8, "u", "long text " * 60_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    files = warc.write_warc(frame, new_folder(spark, "warc"))
    want = Counter((p, "revisit" if p == 2 else "response", len((h or "").encode()), 1 if p == 2 else None) for p, _, h in pages)
    for split in (97, 1000, 1 << 20):
        found = warc.read_warc(files, split_bytes=split).collect()
        assert Counter((r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in found) == want
        assert Counter(bytes(r.payload).decode() for r in found if r.payload is not None) == Counter(h or "" for p, _, h in pages if p != 2)
    assert warc.read_warc(warc.write_warc(frame.limit(0), new_folder(spark, "warc"))).count() == 0


def test_archives_of_other_writers(spark, tmp_path):
    def packed(kind, block, *head):
        lines = [b"WARC/1.0", b"WARC-Type: " + kind, b"Content-Length: %d" % len(block), *head]
        return gzip.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<html>body</html>" * 1
    broken = bytearray(packed(b"response", b"z" * 4000 + bytes(range(256)), b"content-type: application/http"))
    broken[len(broken) // 2] ^= 0xFF
    parts = [
        packed(b"warcinfo", b"software: x\r\n"), packed(b"request", b"GET / HTTP/1.1\r\n\r\n", b"Content-Type: application/http;msgtype=request"),
        packed(b"response", http, b"content-type: application/http", b"warc-target-uri: http://a/\xe9"), packed(b"metadata", b"a: b"), bytes(broken),
        packed(b"resource", b"\x1f\x8b\x08 not a member", b"X-Page-Id: seven"), packed(b"revisit", b"HTTP/1.1 200 OK\r\n\r\n", b"WARC-Payload-Digest: sha1:ABC", b"WARC-Refers-To: <urn:1>"),
        packed(b"response", http, b"Content-Type: application/http")[:-20]]
    path = tmp_path / "other.warc.gz"
    path.write_bytes(b"".join(parts))
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    files = spark.createDataFrame([(f"file:{path}", path.stat().st_size)], "path string, bytes long")
    for split in (50, 1 << 20):
        found = sorted(warc.read_warc(files, split_bytes=split).collect(), key=lambda r: r.position)
        assert [(r.position, r.record_type) for r in found] == list(zip(starts, (
            "warcinfo", "request", "response", "metadata", "damaged", "resource", "revisit", "damaged")))
        assert [None if r.payload is None else bytes(r.payload) for r in found] == [
            b"software: x\r\n", b"GET / HTTP/1.1\r\n\r\n", b"<html>body</html>", b"a: b", None, b"\x1f\x8b\x08 not a member", None, None]
        assert found[2].url.startswith("http://a/") and found[5].page_id is None
        assert (found[6].payload_digest, found[6].payload_bytes, found[6].refers_to, found[6].refers_to_id) == ("sha1:ABC", None, None, "<urn:1>")


def test_chats_in_parts_read_the_same(spark, monkeypatch):
    rows = [(1, 0, "user", "hi \\ <s> [/INST] </s>"), (1, 1, "assistant", "so \\</s> [\\INST]"), (1, 1, "assistant", "so \\</s> [\\INST]"),
            (2, None, None, None), (None, 3, "assistant", "é\n"), (None, 2, "tool", "[INST]"), (3, 0, "<s>", "x" * 3000)]
    rows += [(4, i, "assistant" if i % 2 else "user", f"</s>{i}" * 50) for i in range(200)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(map(str, chat.read_chats(chat.format_chats(turns)).collect()))
    monkeypatch.setattr(chat, "PART_BYTES", 2000)
    assert sorted(map(str, chat.read_chats(chat.format_chats(turns)).collect())) == whole
    found = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert found[1].loss_chars == 2 * len("so \\</s> [\\INST]") and found[4].n_turns == 200 and found[2].loss_chars == 0
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_pipeline_stages_pass_rows_on(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_dedup", "packing"]
    ids = {r[0] for r in docs.select("doc_id").collect()}
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF_DIR)
        assert kept.columns == docs.columns
    kept_ids = [r[0] for r in kept.select("doc_id").collect()]
    assert 0 < len(kept_ids) == len(set(kept_ids)) and set(kept_ids) < ids
    assert {r[0] for r in corpus_pipeline.run(spark, SF_DIR).select("doc_id").distinct().collect()} == set(kept_ids)
