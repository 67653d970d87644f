"""The lattice model, archives and the pipeline."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from pixelmill.llm import lattice, warc
from pixelmill.llm.queries import QUERIES
from pixelmill.llm.shared import shared_dir
from tests.llm.conftest import odd_rows

PIECES = P.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", ["op1_secrets", "op2_lm_scoring", "op3_pii", "op4_language_id", "op5_byte_bpe", "op6_minhash_near_dedup", "op7_license_rules", "op8_quality_rules", "op10_decontamination"])
def test_results_do_not_depend_on_the_layout(name, spark, sf, odd, tmp_path):
    """One partition and seven give the same rows: digits, sums and choices don't depend on neighbours."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = odd.select(F.col("doc_id") + 10**6, "text", "lang", "source", "n_chars").toDF(*docs.columns).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = []
    for n in (1, 7):
        docs.unionByName(more).repartition(n, F.md5(F.col("doc_id").cast("string"))).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/{n}/benchmark.parquet")
        found = QUERIES[name](spark, f"{tmp_path}/{n}")
        rows.append(sorted((tuple(float(f"{v:.9g}") if isinstance(v, float) and name == "op2_lm_scoring" else v for v in r) for r in found.collect()), key=repr))
    assert rows[0] == rows[1]


@pytest.fixture(scope="module")
def model():
    return lattice.Lattice(*lattice._existing(PIECES))


def brute(model, w):
    start, inner = (dict(zip(ps, log, strict=True)) for ps, log in ((model.start, model.log[: len(model.start)]), (model.inner, model.log[len(model.start) :])))

    def rest(i):
        return 1.0 if i == len(w) else sum(math.exp(inner[w[i:j]]) * rest(j) for j in range(i + 1, len(w) + 1) if w[i:j] in inner)

    return math.log10(math.exp(start[b""]) * rest(0) + sum(math.exp(start[w[:j]]) * rest(j) for j in range(1, len(w) + 1) if w[:j] in start))


def test_forward_equals_all_segmentations(model):
    words = ["the", "thention", "été", "x", "zzz", "ing", "a1b2", '"hello"', "日本"]
    got = model.log10([w.encode() for w in words])
    assert got == pytest.approx([brute(model, w.encode()) for w in words])


def test_expectations_cover_every_byte(model):
    n = model.expectations([b"the", b"thention", b"q"], np.array([1.0, 2.0, 5.0]))
    assert sum(x * len(p) for x, p in zip(n, model.start + model.inner, strict=True)) == pytest.approx(3 + 16 + 5)


def test_scores(spark, odd, none):
    docs = spark.createDataFrame([(k, " ".join(random.Random(k).choices(["the", "of", "and", "ing", f"w{k % 7}", "Zz"], k=k % 40))) for k in range(120)], "doc_id long, text string").unionByName(odd.select("doc_id", "text").where("doc_id is null or doc_id > 2").withColumn("doc_id", F.col("doc_id") + 1000))
    rows = [(r.doc_id, lattice.words(r.text)) for r in docs.collect()]
    count, ends = collections.Counter(), 0
    for i, w in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            count.update(w)
            ends += 1
    total, distinct = sum(count.values()) + ends, len(count) + 1
    unit = lambda c: math.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    want = sorted((len(w) + 1, sum(count[x] > 0 for x in w) + 1, round(sum(unit(count[x]) for x in w) + unit(ends), 6)) for _, w in rows)
    got = lattice.score(docs, PIECES).collect()
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == total and r.score < 0 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)
    assert lattice.score(none, PIECES).count() == 0


def test_score_is_the_marginal_of_all_segmentations(spark, model):
    r = random.Random(8)
    vocabulary = ["the", "of", "thention", "été", "x1", "zzq", "Ing", "日本", '"hi"', "rest", "ou"]
    docs = [(k, " \t".join(r.choices(vocabulary, k=k % 9))) for k in range(60)] + [(60, "new unseen"), (None, "the"), (61, None)]
    learned = [lattice.words(t) for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 10]
    total = sum(map(len, learned)) + len(learned)
    end = len(learned) / total
    want = {(i, t): sum(brute(model, w) + math.log10(1 - end) for w in lattice.words(t)) + math.log10(end) for i, t in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in lattice.score(df, PIECES).collect()}
    assert all(got[i].score == pytest.approx(w, rel=1e-9) for (i, _), w in want.items())
    # the arc of seen words: shares of all words sum to one, so it is brute force over the same counts
    count = collections.Counter(w for own in learned for w in own)
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    d = min(0.9, max(0.1, once / max(once + 2 * twice, 1)))
    own = lambda w: math.log10(max(count[w] - d, 0) / total + d * len(count) / total * 10 ** brute(model, w))
    assert all(got[i].corpus_score == pytest.approx(sum(map(own, lattice.words(t))) + math.log10(end), rel=1e-9) for i, t in docs)


def test_rare_words_by_shuffle_score_alike(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    whole = {r.doc_id: r for r in lattice.score(docs, PIECES).collect()}
    for r in lattice.score(docs.repartition(7), PIECES, head_words=50).collect():
        assert (r.n_tokens, r.n_known, r.held_out, r.train_tokens) == (whole[r.doc_id].n_tokens, whole[r.doc_id].n_known, whole[r.doc_id].held_out, whole[r.doc_id].train_tokens)
        for c in ("base_score", "score", "corpus_score"):
            assert r[c] == pytest.approx(whole[r.doc_id][c], rel=1e-9)


def test_estimated_pieces_fit_the_corpus_better(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    total = lambda rounds: sum(r.score for r in lattice.score(docs, PIECES, rounds=rounds).collect())
    assert total(0) < total(2) < 0


def test_archives(spark, tmp_path):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, None, None), (4, "u\r\n4", ""), (5, "u5", "é" * 3000), (6, "u6", "WARC/1.1\r\n\r\n"), (7, "u7", "same"), (None, "u", "same"), (2, "u2", "same"), (8, "u8", "x" * 300_000)]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    firsts = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        firsts.setdefault(h or "", i)
    want = []
    for i, _, h in rows:
        first = firsts[h or ""] if i is not None else None
        revisit = i is not None and first != i
        raw = (h or "").encode()
        want.append((str(i) if i is not None else None, "revisit" if revisit else "response", "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode(), len(raw), str(first) if revisit else None, None if revisit else raw))
    records = got.collect()
    found = [(r.page_id, r.warc_type, r.payload_digest, r.payload_length, r.refers_page, None if r.payload is None else bytes(r.payload)) for r in records]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    named = {r.record_id: r for r in records if r.warc_type == "response"}
    assert all(named[r.refers_to].page_id == r.refers_page and named[r.refers_to].payload_digest == r.payload_digest for r in records if r.refers_to is not None)


def test_pages_that_repeat_an_id_with_other_html(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (2, "u", "other"), (3, "u", "other")]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.warc_type, r.refers_page) for r in got) == [("1", "response", None), ("2", "response", None), ("2", "revisit", "1"), ("3", "revisit", "2")]


def test_foreign_archives(tmp_path):
    """Other record types, header names in other cases, and no private headers."""
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    raw = b"".join(f"WARC/1.0\r\nwarc-type: {kind}\r\ncontent-type:{mime}\r\nWARC-PAYLOAD-DIGEST: {sha1}\r\nCONTENT-LENGTH:  {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
                   for kind, mime, block in (("warcinfo", "application/warc-fields", b"hello"), ("response", "application/http; msgtype=response", body), ("resource", "text/plain", b"hello"), ("conversion", "text/plain", b"hello")))
    (tmp_path / "a.warc").write_bytes(raw)

    def read(**options):
        reader = warc.WarcReader({"path": str(tmp_path / "a.warc"), **options})
        return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]

    assert [(r["warc_type"], r["payload"], r["payload_length"]) for r in read(verify="true")] == [(k, b"hello", 5) for k in ("warcinfo", "response", "resource", "conversion")]
    (tmp_path / "a.warc").write_bytes(raw.replace(b"hello", b"hellO"))
    with pytest.raises(ValueError, match="differs"):
        read(verify="true")
    assert [r["payload"] for r in read()] == [b"hellO"] * 4


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_pushed_filters_and_skipped_payloads(spark, compression):
    rows = [(k, "u", "z" * 50_000 if k % 2 else "same") for k in range(20)]
    warc.register(spark)
    path = f"{shared_dir(spark)}/warc-test-{compression}"
    warc.deduplicated(spark.createDataFrame(rows, "page_id long, url string, html string")).select(*[F.col(c).cast("string") for c in ("page_id", "url", "html", "refers_to")]).write.format("warc").option("compression", compression).mode("append").save(path)
    df = spark.read.format("warc").load(path)
    assert df.where("warc_type = 'response'").count() == 2 and df.where("page_id in ('3', '4')").count() == 2
    assert df.where("warc_type = 'revisit' and payload is not null").count() == 0
    bare = spark.read.format("warc").option("payload", "false").load(path)
    assert bare.where("payload is null").count() == 20
    reader = warc.WarcReader({"path": path})
    assert list(reader.pushFilters([warc.EqualTo(("warc_type",), "response"), warc.EqualTo(("payload_length",), 3)])) == [warc.EqualTo(("payload_length",), 3)]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2


def test_damaged_archives_are_errors(tmp_path):
    good = warc.record({"WARC-Type": "response"}, b"x\r\n\r\nabc")
    for k, bad in enumerate((good[:-12], b"junk\r\n\r\n" + good, good[:10])):
        (tmp_path / f"{k}.warc").write_bytes(bad)
        reader = warc.WarcReader({"path": str(tmp_path / f"{k}.warc")})
        with pytest.raises(ValueError):
            [b for p in reader.partitions() for b in reader.read(p)]
    assert pafs is not None


def test_empty_pages(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as c
    from pixelmill.llm import decontaminate, neardup, pii, quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    out = docs
    names = [n for n, _ in c.STAGES]
    assert names == ["quality_rules", "minhash_near_dedup", "benchmark_decontamination", "pii", "byte_bpe"]
    for name, stage in c.STAGES:
        before = {r.doc_id: r for r in out.collect()}
        out = stage(spark, out, sf)
        after = {r.doc_id: r for r in out.collect()}
        if name != "byte_bpe":
            assert sorted(out.columns) == sorted(docs.columns)
        if name == "quality_rules":
            assert set(after) == good
        if name == "minhash_near_dedup":
            assert set(after) == {r.doc_id for r in neardup.near_duplicates(spark.createDataFrame(list(before.values()), docs.schema)).where("kept").collect()}
        if name == "benchmark_decontamination":
            dirty = {r.doc_id for r in decontaminate.contained(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - dirty
        if name == "pii":
            assert set(after) == set(before) and all(not pii.patterns(r.text) and r.n_chars == len(r.text) for r in after.values())
        if name == "byte_bpe":
            assert all(hashlib.sha256(before[i].text.encode()).hexdigest() == r.decoded_sha256 and r.n_tokens == len(r.ids) for i, r in after.items())
    assert c.run(spark, sf).count() == len(after)


def test_pipeline_on_odd_rows(odd, none, sf):
    import corpus_pipeline as c

    for docs in (odd, none):
        out, spark = docs, docs.sparkSession
        for _, stage in c.STAGES:
            out = stage(spark, out, sf)
        assert out.count() <= len(odd_rows())
