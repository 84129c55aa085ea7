import base64
import hashlib
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import ODD_TEXTS
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestrand.llm import ann, packing, sentencepiece_ops, warc
from lodestrand.llm.bpe import UnitEncoder
from lodestrand.llm.common import Scratch

# packing ---------------------------------------------------------------------------------------------------------------

BPE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_unit_encoder_equals_the_library(documents):
    texts = [t for t in ODD_TEXTS if t] + [r.text for r in documents.collect()] + ["a  b", " a b ", "a\n b", "it's <|endoftext|> x", "x   y", "tab\t sp", "1 2  3\r\n 4", "don't  we'll", "\x1c x\x85 y"]
    reference = Tokenizer.from_file(BPE)
    mine = UnitEncoder(Path(RANKS).read_bytes(), Path(BPE).read_text(encoding="utf-8"))
    for text, want in zip(texts, reference.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == want.ids, text[:50]


def check_packing(rows, docs, capacity):
    reference = Tokenizer.from_file(BPE)
    want = defaultdict(list)
    for doc_id, text in docs:
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        n, first = len(ids), len(ids) % capacity or capacity
        edges = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[(doc_id, k)].append((a, b - a, zlib.crc32(ids[a:b].tobytes())))
    got, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        got[(r.doc_id, r.piece)].append((r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in rows)


def test_packing_odd_rows(odd, none):
    for capacity in (7, 1024):
        check_packing(packing.pack(odd, capacity=capacity).collect(), [(r.doc_id, r.text) for r in odd.collect()], capacity)
    assert packing.pack(none).count() == 0


def test_packing_is_tight(documents):
    n, tokens = check_packing(packing.pack(documents).collect(), [(r.doc_id, r.text) for r in documents.collect()], 1024)
    assert n <= -(-tokens // 1024) * 1.02 + 1


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_best_fit_decreasing(seed):
    import bisect
    import random

    r = random.Random(seed)
    capacity = r.choice([10, 64, 1024])
    sizes = [r.randint(1, capacity) for _ in range(r.choice([0, 5, 400, 3000]))]
    counts = {s: sizes.count(s) for s in set(sizes)}
    runs = packing.best_fit_runs(counts, capacity)
    used = {int(first + k // fits) for size, rank, first, _, fits in runs for k in range(_count(runs, counts, size, rank))}
    gaps, opened = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, s)
        if i == len(gaps):
            opened += 1
            bisect.insort(gaps, capacity - s)
        else:
            bisect.insort(gaps, gaps.pop(i) - s)
    assert len(used) == opened


def _count(runs, counts, size, rank):
    later = [r[1] for r in runs if r[0] == size and r[1] > rank]
    return int((min(later) if later else counts[size]) - rank)


# WARC ------------------------------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string, address string")


PAGES = [(1, "http://a/\r\nX: y", "<p>é</p>", "c", "c"), (2, None, None, "c", None), (3, "u", "", None, None), (4, "u", "<p>é</p>", None, None), (4, "u", "<p>é</p>", None, None), (None, "u", "<p>é</p>", None, None), (7, "u", "z" * 200_000, None, None), (0, "u", "own", None, None)]


def test_warc_round_trip(spark):
    got = sorted(warc.round_trip(pages(spark, PAGES)).collect(), key=repr)
    assert len(got) == len(PAGES)
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, "response", None), (4, "revisit", 1), (4, "revisit", 1), (None, "revisit", 1), (2, "response", None), (3, "revisit", 2), (7, "response", None), (0, "response", None)]
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.record_type, r.refers_to)) for r in got)
    sizes = {r.page_id: (r.payload_bytes, r.payload_digest) for r in got}
    assert sizes[1] == (9, digest("<p>é</p>")) and sizes[2] == (0, digest("")) and sizes[7] == (200_000, digest("z" * 200_000))
    small = warc.round_trip(pages(spark, PAGES), least_bytes=100).collect()
    assert {r.record_type for r in small} == {"response"}
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_warc_records_can_be_parsed(spark):
    scratch = Scratch(spark, "warc-test")
    warc.write_archive(pages(spark, PAGES), scratch.root)
    for r in warc.read_records(spark, scratch.root).collect():
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and block.endswith(b"\r\n\r\n")
        assert int(fields["Content-Length"]) == len(block) - 4 and len([x for x in fields if x == "X"]) == 0
        http, _, body = block[:-4].partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK") and (body == bytes(r.payload) if fields["WARC-Type"] == "response" else body == b"" and fields["WARC-Refers-To"])


def test_a_damaged_payload_stops_the_read(spark):
    scratch = Scratch(spark, "warc-test")
    warc.write_archive(pages(spark, PAGES), scratch.root)
    bad = spark.read.parquet(f"{scratch.root}/payloads").withColumn("payload", F.encode(F.lit("changed"), "UTF-8"))
    bad.write.parquet(f"{scratch.root}/other")
    scratch.drop("payloads")
    spark.read.parquet(f"{scratch.root}/other").write.parquet(f"{scratch.root}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_index(spark, scratch.root).collect()


# nearest neighbours ----------------------------------------------------------------------------------------------------


def test_ann_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(rows, F.col("vec_id") % 20 == 0).toPandas()
    table = rows.toPandas()
    x, ids = np.array(table.embedding.tolist(), float), table.vec_id.to_numpy()
    hit = total = 0
    for q, mine in got.groupby("query_id"):
        scores = x @ x[ids == q][0]
        assert list(mine["rank"]) == list(range(1, 21)) and q not in set(mine.vec_id)
        assert np.allclose(mine.score, scores[np.searchsorted(ids, mine.vec_id)] if (np.diff(ids) > 0).all() else [scores[ids == v][0] for v in mine.vec_id])
        order = np.lexsort((ids, -scores))
        best = [ids[i] for i in order if ids[i] != q][:20]
        hit, total = hit + len(set(best) & set(mine.vec_id)), total + 20
    assert hit / total >= 0.9 and total == 20 * (ids % 20 == 0).sum()


def test_ann_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "a"), (20, [0.0, 2.0], "a"), (1, [2.0, 0.0], "a"), (3, [2.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (40, None, "a"), (60, [0.0, 0.0], "a"), (80, [1.0, None], "a"), (100, [nan, 1.0], "a"), (120, [inf, 1.0], "a"), (None, [1.0, 1.0], "a"), (140, [], "a"), (160, [1.0, 2.0, 3.0], "a")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 3, 2.0), (0, 4, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0), (20, 4, 3, 0.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df, F.lit(False)).count() == 0


def test_a_crowded_bucket_is_split(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((300, 8)), np.tile(rng.standard_normal(8), (300, 1)) + 1e-3 * rng.standard_normal((300, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, block=50, group=7).toPandas()
    hit = sum(len(set(np.argsort(-np.where(np.arange(600) == q, -np.inf, x @ x[q]), kind="stable")[:20]) & set(g.vec_id)) for q, g in got.groupby("query_id"))
    assert hit / (20 * 30) >= 0.9


# SentencePiece ---------------------------------------------------------------------------------------------------------


def test_sentencepiece_equals_the_library(spark, odd, none, documents):
    rng = np.random.default_rng(5)
    letters = list("aeiounrstld ▁\nés漢🎉Ω9.-\t")
    random_texts = ["".join(rng.choice(letters, int(n))) for n in rng.integers(1, 200, 300)]
    unbroken = ["x" * 300, "0123456789" * 200, "the" * 3000, "".join(rng.choice(list("etaoin"), 30_000)), "é漢" * 700]
    extra = ["  a  b\n c ", "ﬁ Ａ　x ▁y", "日本語 🎉", "a▁b", "<0x0A> <s>", *unbroken, *random_texts]
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(extra)], "doc_id bigint, text string")
    docs = odd.select("doc_id", "text").where("doc_id is not null and doc_id <> 3").unionByName(extra).unionByName(documents.select((F.col("doc_id") + 10**7).alias("doc_id"), "text"))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in sentencepiece_ops.encode_checked(docs).collect()}
    assert {d: list(r.ids) for d, r in got.items()} == {d: sp.encode(t or "") for d, t in texts.items()}
    assert all(r.n_pieces == len(r.ids) and r.round_trip == ("▁" not in (texts[d] or "")) for d, r in got.items())
    back = sentencepiece_ops.decode(sentencepiece_ops.encode(docs)).collect()
    assert all(r.text == (texts[r.doc_id] or "").replace("▁", " ") for r in back)
    assert sentencepiece_ops.encode(none).count() == 0 and sentencepiece_ops.encode_checked(none).count() == 0


def test_sentencepiece_odd_rows(odd):
    rows = odd.collect()
    got = sentencepiece_ops.encode_checked(odd).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    key = lambda d, n: (d is None, d or 0, n)
    assert sorted(key(r.doc_id, r.n_pieces) for r in got) == sorted(key(r.doc_id, len(sp.encode(r.text or ""))) for r in rows)


def test_units_that_a_task_forgets_are_encoded_anew(spark, documents, monkeypatch):
    docs = documents.where("doc_id % 4 = 1").select("doc_id", "text")
    whole = {r.doc_id: list(r.ids) for r in sentencepiece_ops.encode(docs).collect()}
    for name, value in (("CHUNK", 500), ("KNOWN_UNITS", 20), ("WINDOW", 3), ("FOLDED", 64)):
        monkeypatch.setattr(sentencepiece_ops, name, value)
    assert {r.doc_id: list(r.ids) for r in sentencepiece_ops.encode(docs).collect()} == whole


@pytest.mark.parametrize("bits", [5, 22])  # of 5 bits all are in use: substrings of one slot that differ
def test_a_substring_of_a_chunk_is_exploded_once(bits, monkeypatch):
    monkeypatch.setattr(sentencepiece_ops, "HASH_BITS", bits)
    model = sentencepiece_ops.Model.load()
    whole = ("\u2581the" + "\u2581then" + "\u2581banana\u00e9") * 40
    ends = np.cumsum([4, 5, 8] * 40)
    room = np.repeat(ends, [4, 5, 8] * 40) - np.arange(len(whole))
    found, marks = sentencepiece_ops.Sieve(model).spans(np.frombuffer(whole.encode("utf-32-le"), "<u4").astype(np.uint64), room)
    texts = [whole[i : i + k] for i, k in zip((found >> 6).tolist(), (found & 63).tolist())]
    for k, (here, same) in enumerate(marks, 2):
        pieces = {p for p, _, _ in model.pieces if len(p) == k}
        assert {i for i in range(len(whole)) if k <= room[i] and whole[i : i + k] in pieces} <= set(here.tolist())
        assert all(whole[i : i + k] == whole[j : j + k] and j << 6 | k in found for i, j in zip(here.tolist(), same.tolist()))
    if bits == 22:
        assert len(texts) == len(set(texts)) < sum(m.shape[1] for m in marks) / 30
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = {p: i for p, i, _ in model.pieces}
    edges = np.array([(int(f) << 20) + table[t] for f, t in zip(found, texts) if t in table])
    units = ["\u2581the", "\u2581then", "\u2581banana\u00e9"] * 40
    ids = [np.frombuffer(x, "<i4").tolist() for x in sentencepiece_ops.Merger(model).fold(units, edges, marks)]
    assert ids == [sp.encode(u[1:]) for u in units]


def test_decoding_of_odd_ids(spark):
    df = spark.createDataFrame([([9] * 3,), ([10**6, -1, None],), ([],), (None,)], "ids array<int>")
    got = [r.text for r in sentencepiece_ops.decode(df).collect()]
    assert got[1:] == ["⁇  ⁇  ⁇ ", "", None] and len(got) == 4


def test_viterbi_of_a_unigram_model(spark):
    pieces = [("▁", 1, -3.5), ("▁a", 2, -2.0), ("a", 3, -2.5), ("b", 4, -2.6), ("ab", 5, -3.1), ("▁ab", 6, -4.4), ("ba", 7, -4.0), ("aba", 8, -7.2)]
    model = sentencepiece_ops.Model(tuple(pieces), (), 0, False)
    table = {p: (i, s) for p, i, s in pieces}

    def best(unit):
        if not unit:
            return 0.0, []
        options = []
        for k in range(1, len(unit) + 1):
            p = table.get(unit[:k]) or ((0, -7.2 - sentencepiece_ops.UNKNOWN_PENALTY) if k == 1 else None)
            if p:
                score, rest = best(unit[k:])
                options.append((p[1] + score, [p[0], *rest]))
        return max(options)

    units = ["▁ab", "▁abab", "▁baba", "▁xab", "▁aba", "▁bbx", "▁" + "ab" * 40]
    df = spark.createDataFrame([(u,) for u in units], "unit string")
    got = {r.unit: list(r.ids) for r in sentencepiece_ops.encode_units(df, model).collect()}
    for u in units[:-1]:
        assert got[u] == best(u)[1], u
    assert got[units[-1]] == [6] + [5] * 39
    docs = spark.createDataFrame([(1, "ab abab"), (2, None), (1, "b  a"), (None, "ab")], "doc_id int, text string")
    back = sorted((str(r.doc_id), list(r.ids)) for r in sentencepiece_ops.encode(docs, model=model).collect())
    assert back == sorted([("1", got["▁ab"] + got["▁abab"]), ("2", []), ("1", best("▁b")[1] + best("▁▁a")[1]), ("None", got["▁ab"])])


# pipeline --------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, sf)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert after.columns == columns
        if name == "exact dedup":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
            low = {}
            for r in before.collect():
                low[norm(r.text)] = min(low.get(norm(r.text), r.doc_id), r.doc_id)
            assert sorted(r.doc_id for r in after.collect()) == sorted(low.values())
        if name == "secret scans":
            assert after.count() == before.count() and not [r for r in after.collect() if re.search("[0-9a-f]{16}|AKIA[A-Z0-9]{14}", r.text)]
        before = after
    assert after.select("doc_id").distinct().count() == spark.read.parquet(str(tmp_path / "3")).count()


def test_pipeline_odd_rows(spark, odd, none, sf):
    docs = odd.select("doc_id", "text", F.lit("xx").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"), "kept")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, docs, sf).count() > 0 or k == 0  # nothing here need be good enough for the classifier
        if k < 4:
            assert stage(spark, docs, sf).columns == docs.columns and stage(spark, none, sf).count() == 0


def test_row_numbers_do_not_depend_on_how_files_are_dealt(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(23)
    docs.write.parquet(str(tmp_path / "many"))
    docs = spark.read.parquet(str(tmp_path / "many"))
    rows = corpus_pipeline._rows(docs)
    before = {r.doc_id: r[corpus_pipeline.ROW] for r in rows.collect()}
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "64")
        assert {r.doc_id: r[corpus_pipeline.ROW] for r in rows.select("*").collect()} == before
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
