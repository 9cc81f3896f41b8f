"""The operators over small tables: brute force, nulls, empties, ties, repeated rows, other columns."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folioframe.llm import ann, bpe_count, chat, components, decontam, queries, sharding, simhash, toxicity, unigram, warc, wavelet
from folioframe.llm.common import written

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [(1, "Anna Maria went"), (1, "Anna Maria went"), (2, None), (None, "lost id"), (None, None), (3, ""), (4, "word " * 30_000), (5, "<|endoftext|> \t x"), (6, "Anna Maria went")]


@pytest.fixture(scope="module")
def odd(spark):
    """With columns whose names the operators use themselves."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit(1).alias("fp"), F.lit("x").alias("row"), F.lit(2.0).alias("score"), F.lit(3).alias("_ROW"), F.lit(4).alias("_c"), F.lit(5).alias("_d"), F.lit(6).alias("_H"), F.lit(7).alias("_fp"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got.select(*columns)) == sorted(map(repr, want.select(*columns).fetchall()))


def test_token_counts(odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    got = bpe_count.count_tokens(odd, BPE, limit=3).collect()
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 3) for d, t in ODD]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe_count.count_tokens(none, BPE).count() == 0


def test_wavelet_shards(spark, odd, none):
    manifest = wavelet.write_shards(odd, BPE, shard_ids=1000)
    got = wavelet.read_shards(manifest).collect()
    own, start, want = wavelet.encoder(BPE), 0, []
    starts = {}
    assert len(got) == len(ODD)
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
        starts.setdefault(r.doc_id, []).append(r.start)
    for d, t in ODD:
        ids = own.encode(t) + b"\0\0\0\0"
        want.append((d, len(ids) // 4, zlib.crc32(ids)))
    assert sorted(map(repr, [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got])) == sorted(map(repr, want))
    order = [d for d, _ in sorted(((d, s) for d, ss in starts.items() for s in ss), key=lambda x: x[1])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert wavelet.read_shards(wavelet.write_shards(none, BPE)).count() == 0


def test_sharding(spark, odd, none):
    docs = odd.unionByName(spark.range(100, 400).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), *[F.lit(None).alias(c) for c in odd.columns[2:]]))
    got = sharding.external_shuffle(docs, shards=4, bucket_bytes=100).collect()
    assert len(got) == len(ODD) + 300
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 4) for r in got) and any(r.grown_shard == 4 for r in got)
    where = {}
    for r in got:
        assert where.setdefault(r.doc_id, r.shard) == r.shard
        assert r["size"] == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
    again = sharding.external_shuffle(docs.repartition(3), shards=4, bucket_bytes=10**9).collect()
    assert {r.doc_id: r.shard for r in again} == where
    assert sharding.external_shuffle(none).count() == 0


@pytest.mark.parametrize("hub", [4, components.HUB])
def test_components(spark, monkeypatch, hub):
    """Against union-find, with few hubs and with nearly all nodes of this small table as hubs."""
    monkeypatch.setattr(components, "HUB", hub)
    rng = np.random.default_rng(5)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(40)] + [(7, 7), (300, None)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])
def test_simhash_links(spark, bucket):
    """Components of dense and sparse fingerprints against all pairs; with small buckets the hot keys are dealt in blocks."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 62, 40, dtype=np.int64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.int64(1) << rng.integers(0, 62, 40)) ^ (np.int64(1) << rng.integers(0, 62, 40)) for _ in range(4)], np.arange(60)]))
    nodes = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fps)], "node long, fp long")
    got = {r.node: r.component for r in components.components(simhash.link_fingerprints(nodes, bucket)).collect()}
    u, root = fps.view(np.uint64), list(range(len(fps)))
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 3):
            a, b = sorted((root[i], root[int(j)]))
            root = [a if r == b else r for r in root]
    assert all(got.get(i, i) == root[i] for i in range(len(fps)))


def test_simhash_documents(odd, none):
    got = simhash.simhash_components(odd).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert {c for _, c in by[1] | by[6]} == {1}
    assert by[2] == by[3] == {("0" * 16, 2)} and ("0" * 16, 2) in by[None]
    assert simhash.simhash_components(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(repr((r.doc_id, (r.text or "")[:9])) for r in kept.collect()) == sorted(map(repr, [(1, "Anna Mari"), (2, ""), (None, "lost id"), (4, "word word"), (5, "<|endofte")]))


def brute_contamination(docs, items, window):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for i, item in items:
            v = words(item)
            n = min(window, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[s : s + n]:
                        hit |= set(range(at, at + n))
                        found |= {str(i)} - {"None"}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination(spark):
    import random

    rng = random.Random(9)
    say = lambda n: " ".join(rng.choices(["a", "B", "İx", "Σας", "ΣΑΣ", "é", "É", "x1", "b"], k=n))
    items = [(10, say(20)), (9, say(3)), (2, "a"), (None, say(15)), (4, None), (5, " ,. "), (10, say(9))]
    docs = [(i, say(40)) for i in range(40)] + [(100, items[0][1]), (100, items[0][1].upper()), (101, "x " * 50 + items[0][1]), (None, items[3][1]), (7, None), (8, ""), (9, "zz, " * 5000)]
    for window, shingle in ((13, 5), (6, 3), (2, 5)):
        got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window, shingle).drop("text_hash")
        assert rows(got) == sorted(map(repr, brute_contamination(docs, items, window)))


def test_contamination_edges(spark, odd, none, monkeypatch):
    items = spark.createDataFrame([(1, "anna maria")], "item_id long, text string")
    empty = none.select(F.col("doc_id").alias("item_id"), "text")
    assert decontam.contamination(none, items).count() == 0
    assert decontam.contamination(odd, empty).filter("contaminated").count() == 0
    want = rows(decontam.contamination(odd, items))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert rows(decontam.contamination(odd, items)) == want
    kept = decontam.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 3


def test_chat_trees(spark):
    data = [("t", 1, None, "user", "q <b> & \\n", 0.0), ("t", 2, 1, "assistant", "</turn>", 1.0), ("t", 3, 1, "assistant", "&lt;", 5.0), ("t", 4, 3, "user", None, None), ("t", 5, 99, None, "orphan", -1.0), ("u", 6, 7, "x", "cycle", 0.0), ("u", 7, 6, "x", "cycle", 0.0)]
    messages = written(spark.createDataFrame(data, "tree string, msg long, parent long, role string, text string, score double"), "messages")
    read = chat.read_back(chat.conversations(messages)).orderBy("branch").collect()
    assert [(r.branch, [(t.role, t.text) for t in r.turns], r.loss) for r in read] == [
        (1, [("user", "q <b> & \\n"), ("assistant", "&lt;"), ("user", "")], "&lt;"), (2, [("user", "q <b> & \\n"), ("assistant", "</turn>")], "</turn>"), (3, [("", "orphan")], ""),
    ]
    assert chat.conversations(messages, best=1).count() == 1


def test_chat_depth_and_edges(spark):
    deep = written(spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text")), "deep")
    (row,) = chat.digest(chat.read_back(chat.conversations(written(chat.linear_messages(deep), "linear")))).collect()
    assert row.n_turns == 300 and row.loss_sha256 == hashlib.sha256("".join(map(str, range(300))).encode()).hexdigest()
    odd = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "x"), (1, 1, "user", "x"), (1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    got = chat.digest(chat.read_back(chat.conversations(written(chat.linear_messages(odd), "linear"))))
    assert sorted((repr(r.conv_id), r.n_turns, r.loss_chars) for r in got.collect()) == [("1", 2, 0), ("None", 2, 0)]
    assert chat.conversations(written(chat.linear_messages(odd.limit(0)), "linear")).count() == 0


def test_warc(spark):
    big = "<p>" + "x" * 2000
    odd_url = "http://a\nb\r\n {x"
    data = [(1, "http://a b", big), (2, None, big), (3, "u", big), (3, "u", big), (None, "n", big), (4, "v", "small"), (5, odd_url, "small"), (6, "e", None), (7, "e", "")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    manifest = warc.write_archives(pages, archive_bytes=500)
    got = warc.read_archives(manifest, payloads=True).collect()
    assert sorted(repr((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in got) == sorted(
        map(repr, [(1, 2003, "revisit", 3), (2, 2003, "revisit", 3), (3, 2003, "response", None), (3, 2003, "response", None), (None, 2003, "revisit", 3), (4, 5, "response", None), (5, 5, "response", None), (6, 0, "response", None), (7, 0, "response", None)])
    )
    assert {r.payload_digest for r in got if r.payload_bytes == 2003} == {hashlib.sha1(big.encode()).hexdigest()}
    assert all(r.payload is None or len(r.payload) == r.payload_bytes for r in got)
    assert {r.page_id: r.url for r in got} == {d[0]: d[1] for d in data}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def brute_neighbours(x, ids, every, k):
    out = {}
    for q, v in zip(ids, x):
        if q % every == 0:
            score = x @ v / (np.linalg.norm(x, axis=1) * np.linalg.norm(v))
            out[q] = [i for _, i in sorted((-round(float(s), 12), i) for s, i in zip(score, ids) if i != q)[:k]]
    return out


@pytest.mark.parametrize("recall", [1.0, 0.96])
def test_neighbours(spark, recall, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 40)
    monkeypatch.setattr(ann, "CHUNK", 16)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 16)).astype(np.float32).astype(float)
    x[100:140] = x[50]  # a hot vector, with ties
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [None] * 16), (None, [1.0] * 16), (1200, [float("inf")] * 16)]
    got = ann.search(spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("leaf", F.lit(1)), every=50, k=5, recall=recall).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_neighbours(x, list(range(600)), 50, 5)
    hits = sum(len(set(found[q]) & set(w)) for q, w in want.items())
    assert set(found) == set(want) and hits >= 0.9 * 5 * len(want)
    assert found[50] == want[50] and found[100] == want[100]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = ann.search(spark.createDataFrame(data[:3], "vec_id long, embedding array<float>"), every=1, k=5)
    assert few.count() == 6


def test_neighbours_are_complete(spark, monkeypatch):
    """Outliers whose leaves hold few entries, vectors of other lengths, another order of rows: k answers each, the same ones."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8)) * 3
    x = np.concatenate([np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 8)) * 0.01, rng.normal(size=(200, 8)) * 20])
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000, [1.0, 2.0]), (10_050, [3.0])]
    schema = "vec_id long, embedding array<double>"
    monkeypatch.setattr(ann, "LEAF", 60)
    monkeypatch.setattr(ann, "SAMPLE", 1500)
    got = rows(ann.search(spark.createDataFrame(data, schema), every=10))
    assert len(got) == 420 * 5
    assert rows(ann.search(spark.createDataFrame(data[::-1], schema).repartition(5), every=10)) == got
    want = brute_neighbours(x, list(range(len(x))), 10, 5)
    found = {}
    for q, _, v, _ in (eval(r) for r in got):
        found.setdefault(q, set()).add(v)
    assert sum(len(found[q] & set(w)) for q, w in want.items()) >= 0.9 * 5 * len(want)


def test_toxicity(spark, odd, none):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.score(odd, model, keep=("doc_id", "score")).collect()
    assert len(got) == len(ODD) and all(0 <= r[2] <= 1 for r in got)
    assert toxicity.classify(none, labels).count() == 0
    assert toxicity.classify(odd, labels.limit(0)).filter("score <> 0").count() == 0
    flag = {r.doc_id: r.held_out for r in toxicity.classify(odd, labels.limit(0)).collect()}
    assert all(flag[d] == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0) for d, _ in ODD)
    assert toxicity.drop_toxic(odd, model).columns == odd.columns


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.classify(docs.join(labels, "doc_id").select("doc_id", "text"), labels).join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r.predicted == r.toxic == 1 for r in scored)
    assert hit / max(1, sum(r.predicted for r in scored)) > 0.8 and hit / sum(r.toxic for r in scored) > 0.6


def test_unigram(odd, none):
    own = unigram.model(PIECES)
    got = unigram.encode_documents(odd, PIECES, keep=("doc_id", "score")).collect()
    assert len(got) == len(ODD) and sorted(r.decoded for r in got) == sorted(t or "" for _, t in ODD)
    assert [own.decode(own.encode(t)) == t for t in ("a  b ", "\n\t", "漢😀")] == [True] * 3
    digests = unigram.encoded_digests(odd, PIECES).collect()
    assert all(r.round_trip for r in digests) and unigram.encoded_digests(none, PIECES).count() == 0
