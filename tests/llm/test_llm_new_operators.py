"""Structure repair, packing and alignment over small tables: brute force, libraries, nulls, empties, ties, repeated rows, other columns."""

import gzip
import hashlib
import io
import itertools
import json
import re
import zipfile
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioframe.llm import align, ann, decontam, packing, queries, repair_turns, simhash, warc

SF = "/root/testdata/sf0.001"
BYTES, PIECES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


# structure repair


def cheapest(rows):
    """(cost, audit, repaired rows) by trying all edit sequences of rows (role, text, fault) with few insertions."""
    best = (3 * len(rows), "D" * len(rows), [])

    def go(i, said, cost, audit, inserted):
        nonlocal best
        initials = "".join(r[0][0] for r in said)
        if cost > best[0] or not re.fullmatch("s?(ua)*u?", initials):  # no target begins so
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best = min(best, (cost, audit, said))
        if inserted < 2:
            for role in ("user", "assistant"):
                go(i, [*said, (role, "")], cost + 2, audit + "I", inserted + 1)
        if i == len(rows):
            return
        role, text, fault = rows[i]
        go(i + 1, said, cost + 3, audit + "D", 0)
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            if role:
                go(i + 1, [*said, (role, text)], cost + more, audit + "K", 0)
            for other in ("user", "assistant"):
                go(i + 1, [*said, (other, text)], cost + 2 + more, audit + "R", 0)

    go(0, [], 0, "", 0)
    return best


FAULTS = ("clean", "blank", "duplicate", "truncated")


def test_cheapest_edits():
    trie, rng = repair_turns.Trie(), np.random.default_rng(3)
    all_short = ["".join(x) for n in range(3) for x in itertools.product("0123456789abcdef", repeat=n)]
    some = ["".join(rng.choice(list("0123456789abcdef"), n)) for n in (3, 4, 4, 5) for _ in range(8)]
    for signature in sorted([*all_short, *some]):
        rows = [(("system", "user", "assistant", "tool")[int(d, 16) // 4], f"t{i}", FAULTS[int(d, 16) % 4]) for i, d in enumerate(signature)]
        cost, audit, said = cheapest(rows)
        *counts, illegal, got_cost, edits = trie.answer(signature)
        assert (got_cost, repair_turns.audit_of(edits)) == (cost, audit), signature
        assert counts == [sum(r[2] == f for r in rows) for f in ("blank", "duplicate", "truncated")]
        assert illegal == sum(a[0][0] + b[0][0] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))


def test_prefixes_are_shared():
    trie = repair_turns.Trie()
    signatures = sorted("".join(x) for x in itertools.product("48", repeat=8))
    answers = [trie.answer(s) for s in signatures]
    assert trie.computed == 2**9 - 2  # one layer for each node of the trie
    assert answers == [repair_turns.Trie().answer(s) for s in signatures]


def test_long_conversation():
    edits = repair_turns.Trie().answer("48" * 50_000 + "4")[5]
    assert edits == "K" * 100_001 + "a"
    assert repair_turns.cut_edits("uKKDaKa", [2, 1, 1]) == ["uKK", "D", "aKa"]


def brute_repair(rows):
    """contract rows from Python rows (conv_id, turn, role, text) by other means than the operator."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = found[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, kept in found.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in kept:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "clean")
            seen.add((role, text))
        turns = [t for t, *_ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(kept))
        cost, audit, said = cheapest([(r[1], r[2], f) for r, f in zip(kept, faults)])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return out


def test_structure_repair(spark):
    rng, rows = np.random.default_rng(5), []
    roles, texts = ["user", "assistant", "system", "tool", None, "", "USER", "superb"], ["Yes.", "No", "", " \t", None, "Ja! \n", "é ", "Yes.", "a.b", "?"]
    for conv in [*range(60), None]:
        for _ in range(int(rng.integers(1, 6))):
            turn = None if rng.random() < 0.1 else int(rng.integers(0, 6))
            rows.append((conv, turn, roles[int(rng.integers(0, len(roles)) * (rng.random() < 0.5))] if rng.random() < 0.6 else ["user", "assistant"][len(rows) % 2], texts[int(rng.integers(len(texts)))]))
    rows.append(rows[-1])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit(1).alias("place"), F.lit("x").alias("digit"), F.lit(2).alias("COPY"))
    got = repair_turns.repair_damaged(df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_repair(rows)))
    assert repair_turns.repair_damaged(df.limit(0)).count() == 0


def test_repaired_rows(spark):
    """Undamaged rows through repair(): the rows themselves, over several parts of one conversation."""
    n = 400
    rows = [(7, t, "user" if t % 2 else "assistant", "word " * 2000 + "end." if t == 9 else f"t{t}.") for t in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        solved, repaired = repair_turns.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), spark.createDataFrame([(7,), (8,)], "conv_id long"))
        got = repaired.orderBy("part", "at").collect()
        assert {r.conv_id: (r.cost, len(r.parts) > 1) for r in solved.collect()} == {7: (4, True), 8: (0, False)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r.role, r.text, r.edit) for r in got] == [("user", "", "I"), *[(role, text, "K") for _, _, role, text in rows], ("assistant", "", "I")]


# alignment

TEXTS = [
    (1, "The cat sat on the mat.\nThe end"), (1, "The cat sat on the mat.\nThe end"), (2, None), (None, "lost id"), (None, None), (3, ""), (4, "word " * 5000), (5, "<|endoftext|> \t x </s> <0x41>"),
    (6, "a ▁ b"), (7, "naïve 北京 😀 x"), (8, " begins"), (9, "ends \n"), (10, "a\n\nb"), (11, " x́ ​"), (12, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40), (13, "\x00 nul"), (14, "1234567890 12,5 don't"),
]


def brute_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(align.byte_symbols())}
    linked, out, counts = [], [], Counter()
    for doc, text in rows:
        ids_a = ids_b = []
        groups, links = [], Counter()
        if text:
            ids_a, ids_b, own = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
            by_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
            by_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
            if b"".join(by_a) != own or b"".join(by_b) != own:
                ids_a = ids_b = []
            i = j = 0
            while i < len(ids_a):
                group, x, y = ([ids_a[i]], [ids_b[j]]), len(by_a[i]), len(by_b[j])
                while x != y:
                    if x < y:
                        i += 1
                        x += len(by_a[i])
                        group[0].append(ids_a[i])
                    else:
                        j += 1
                        y += len(by_b[j])
                        group[1].append(ids_b[j])
                i, j = i + 1, j + 1
                groups.append(group)
                links.update(itertools.product(*group))
        counts.update(links.keys())
        linked.append((doc, ids_a, ids_b, groups, links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    for doc, ids_a, ids_b, groups, links in linked:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc, len(ids_a), len(ids_b), len(groups), links.total(), sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if ids_a else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def same(df, want):
    assert sorted(map(repr, map(tuple, df.select(*COLUMNS).collect()))) == sorted(map(repr, want))


def test_alignment_edges(spark, monkeypatch):
    monkeypatch.setattr(align, "SHARD_KEYS", 40)
    monkeypatch.setattr(align, "BUFFER_KEYS", 30)
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").select("*", F.lit(1).alias("n_a"), F.lit("x").alias("LINKS"), F.lit(3).alias("key"))
    same(align.alignment(df, BYTES, PIECES), brute_alignment(TEXTS))
    assert align.alignment(df.limit(0), BYTES, PIECES).count() == 0
    assert align.alignment(df.filter("text IS NULL"), BYTES, PIECES).count() == 2


def test_alignment_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(queries.QUERIES["op13_alignment"](spark, SF), brute_alignment(rows))


def test_alignment_memory(monkeypatch):
    """Segments that are forgotten are learned again; large groups go by distinct ids."""
    texts = [t for _, t in TEXTS] + [f"word{i} w{i % 7}" for i in range(50)]
    usual = align.Aligner(BYTES, PIECES)
    small = align.Aligner(BYTES, PIECES, kept=3)
    want = usual.align(texts)
    monkeypatch.setattr(align, "LARGE_GROUP", 0)
    for got in ([small.align([t])[0] for t in texts], align.Aligner(BYTES, PIECES).align(texts)):
        for a, b in zip(got, want, strict=True):
            assert a[:5] == b[:5] and (a[5] == b[5]).all() and (a[6] == b[6]).all()
    assert len(small.table.index) <= 3


# packing


@cache
def word_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def library_ids(text):
    return word_library().encode(text or "", add_special_tokens=False).ids + [2]


def check_pieces(got, docs, window):
    """Every id of every row once, sequences gapless, only powers of two shorter than the window."""
    sequences, want = defaultdict(list), Counter()
    for doc, text in docs:
        want[doc, tuple(library_ids(text))] += 1
    for r in got:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0 and len(r.ids) == 4 * r.length
            at += r.length
        assert at <= window and at & (at - 1) == 0 or at == window
    # pieces of rows that share an id are put together by trying: here by the ids they must give
    left = defaultdict(list)
    for r in got:
        left[r.doc_id].append((r.start, r.length, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.doc_tokens))
    for (doc, ids), times in want.items():
        for _ in range(times):
            at = 0
            while at < len(ids):
                piece = next(p for p in left[doc] if p[0] == at and p[3] == len(ids) and ids[at : at + p[1]] == p[2])
                left[doc].remove(piece)
                at += piece[1]
    assert not any(left.values())


def test_packing_edges(spark):
    more = [(100 + i, f"topic{i % 3} river bank {i} " * (i % 9 + 1)) for i in range(60)] + [(200, "same text here") for _ in range(50)]
    docs = [*TEXTS, (30, "<|ENDOFTEXT|> Upper Ünï <|endoftext|>x"), (31, "Σίσυφος ΣΑΣ ΣΑΣ"), *more]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("ids"), F.lit("x").alias("START"), F.lit(3).alias("shard"))
    for window, rows in ((64, 16), (100, 1000)):
        got = packing.packed(df, WORDS, 2, window, rows).collect()
        check_pieces(got, docs, window)
    assert packing.packed(df.limit(0), WORDS, 2).count() == 0
    assert [r.length for r in packing.packed(df.filter("text IS NULL").limit(1), WORDS, 2).collect()] == [1]


def test_packing_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_packing"](spark, SF).collect()
    ids = {d: np.array(library_ids(t), "<u4") for d, t in docs}
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    lengths = Counter()
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        lengths[r.sequence_id] += r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in lengths.values())
    # full but for what the shards have left
    assert sum(n < 4096 for n in lengths.values()) <= 12


def test_neighbours_are_the_best():
    """Scores of the index against BM25 by its definition, over the same query tokens."""
    rng = np.random.default_rng(2)
    bags = [rng.integers(0, 40, rng.integers(1, 30)).astype("<u4") for _ in range(80)]
    frequency = np.bincount(np.concatenate([np.unique(b) for b in bags]), minlength=41)
    known = packing.Statistics(len(bags), sum(map(len, bags)), frequency)
    index = packing.Index([b.tobytes() for b in bags], known)
    index.used[5:9] = True
    mean = sum(map(len, bags)) / len(bags)

    def weight(token, bag):
        n = (bag == token).sum()
        idf = np.log(1 + (len(bags) - frequency[token] + 0.5) / (frequency[token] + 0.5))
        return idf * n * (packing.K1 + 1) / (n + packing.K1 * (1 - packing.B + packing.B * len(bag) / mean))

    for seed in (5, 6):
        asked = sorted(np.unique(bags[seed]).tolist(), key=lambda t: -weight(t, bags[seed]))[: packing.QUERY_TOKENS]
        scores = {i: sum(weight(t, b) for t in asked) for i, b in enumerate(bags) if not 5 <= i < 9}
        want = sorted((i for i in scores if scores[i] > 0), key=lambda i: -scores[i])
        got = index.neighbours(seed, 20)
        assert np.allclose([scores[i] for i in got], [scores[i] for i in want[:20]], rtol=1e-4) and len(set(got)) == 20


def test_neighbours_share_sequences():
    """Passages of one topic stand together although they come in turns."""
    passages = [np.array([10 + i % 4] * 5 + [100 + i], "<u4").tobytes() for i in range(40)]
    frequency = np.bincount(np.concatenate([np.unique(np.frombuffer(p, "<u4")) for p in passages]))
    for sequence in packing.pack(passages, packing.Statistics(40, 240, frequency), window=30)[:4]:
        assert len({i % 4 for i, *_ in sequence}) == 1


def test_shard_plan():
    assert packing.shard_plan([(1, 3), (2, 3), (3, 25), (4, 5), (9, 6)], 10) == [(1, 0, 1), (2, 0, 1), (3, 1, 3), (4, 4, 1), (9, 5, 1)]


# mended operators


def test_one_id_with_unlike_texts(spark):
    """Rows that share a doc_id are rows of their own: nothing that is linked with nothing is dropped."""
    a, b, c = "the quick brown fox jumps over the lazy dog", "completely different words stand in this other row", "and a third one about rivers and their banks"
    rows = [(1, a), (1, b), (2, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(df).collect())) == sorted(rows)
    assert {r.component_id for r in simhash.simhash_components(df).collect() if r.doc_id == 2} == {2}
    more = df.unionByName(spark.createDataFrame([(5, a), (None, b), (None, "nothing like the others at all here")], df.schema))
    assert sorted(map(repr, map(tuple, simhash.keep_one(more).collect()))) == sorted(map(repr, [*rows, (None, "nothing like the others at all here")]))
    named = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(more).collect()}
    assert sorted(repr((d, c)) for d, _, c in named) == sorted(map(repr, [(1, 1), (1, 1), (2, 2), (5, 1), (None, 1), (None, None)]))


@pytest.mark.parametrize("rows", [0, 400_000])
def test_long_contaminated_document(spark, monkeypatch, rows):
    """Every word of a long document is hit, on the broadcast path and the shuffled one; blocks lose no window at their borders."""
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
    rng = np.random.default_rng(1)
    item = [f"w{i}" for i in rng.permutation(4000)]
    docs = spark.createDataFrame([(1, " ".join(item * 4)), (2, " ".join(item[50:63])), (3, " ".join(item[50:62])), (4, " ".join(["x"] * 300 + item[:40]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in decontam.contamination(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {1: (16_000, 16_000, True), 2: (13, 13, True), 3: (12, 0, False), 4: (340, 40, True)}


def clustered(spark, n, dims=16, clusters=2000):
    """n vectors around clusters, by hashes of their ids; as a table and as a matrix."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(clusters, dims))
    x = (centres[rng.integers(0, clusters, n)] + 0.25 * rng.normal(size=(n, dims))).astype(np.float32)
    schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32()))])
    return spark.createDataFrame(pa.table([pa.array(range(n)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dims).cast(pa.list_(pa.float32()))], schema=schema)), x


def test_search_prunes_at_size(spark):
    """200,000 clustered vectors with the shipped constants: recall of at least 0.9, and under a fifth of the rows scored."""
    df, x = clustered(spark, 200_000)
    report: dict = {}
    got = defaultdict(list)
    for r in ann.search(df, every=2000, k=5, report=report).collect():
        got[r.query_id].append(r.vec_id)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(x), 2000):
        close = unit @ unit[q]
        close[q] = -2
        hits += len(set(np.argpartition(-close, 5)[:5].tolist()) & set(got[q]))
    recall = hits / (5 * len(got))
    print(f"recall {recall:.3f}, share of rows scored {report['share']:.3f}, {report['visits']} of {report['leaves']} leaves")
    assert len(got) == 100 and recall >= 0.9 and report["share"] < 0.2


def foreign(front=b""):
    """An archive as others write it: two data files, one of them not packed, indexes of two forms, offsets as text, packed members beside them."""
    http = lambda body: b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body

    def record(kind, block, **more):
        fields = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://a/", "Content-Length": str(len(block)), **more}
        return b"WARC/1.0\r\n" + "".join(f"{k}:{v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    packed = [gzip.compress(record(*r)) for r in (("warcinfo", b"software: x"), ("response", http(b"one")), ("revisit", b""))]
    plain = [record("response", http(b"two")), record("resource", b"\x00raw")]
    lines = "".join(f"com,a)/ 20240101000000 {json.dumps({'filename': 'data-00.warc.gz', 'offset': str(sum(map(len, packed[:i]))), 'length': str(len(packed[i]))})}\n" for i in range(3))
    columns = " CDX N b a m s k r M S V g\n" + "".join(f"com,a)/ 2024 http://a/ text/html 200 X - - {len(plain[i])} {sum(map(len, plain[:i]))} archive/more.warc\n" for i in (1, 0, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/data-00.warc.gz", b"".join(packed))
        z.writestr("archive/more.warc", b"".join(plain))
        z.writestr("indexes/index.cdxj", lines)
        z.writestr("indexes/more.cdx.gz", gzip.compress(columns.encode()))
        z.writestr(zipfile.ZipInfo("pages/p.jsonl"), "x" * 100, zipfile.ZIP_DEFLATED)
    return front + out.getvalue()


@pytest.mark.parametrize("front", [b"", b"MZ stub of an executable" * 50])
def test_archives_of_others(spark, tmp_path, front):
    raw = foreign(front)
    got = [warc.page_of(*r) for r in warc.records_in(io.BytesIO(raw), len(raw))]
    assert [(r[4], r[2], r[6]) for r in got] == [("warcinfo", 11, b"software: x"), ("response", 3, b"one"), ("revisit", None, None), ("response", 3, b"two"), ("resource", 4, b"\x00raw")]
    assert got[1][3] == hashlib.sha1(b"one").hexdigest() and got[1][0] is None and got[1][1] == "http://a/"
    (tmp_path / "a.wacz").write_bytes(raw)
    rows = warc.read_archives(spark.createDataFrame([(str(tmp_path / "a.wacz"),)], "file string"), payloads=True).collect()
    assert sorted(bytes(r.payload) for r in rows if r.payload is not None) == [b"\x00raw", b"one", b"software: x", b"two"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("indexes/index.cdxj", 'k 1 {"filename": "gone.warc.gz", "offset": 0, "length": 1}')
    with pytest.raises(ValueError, match="names gone.warc.gz"):
        list(warc.records_in(io.BytesIO(out.getvalue()), len(out.getvalue())))
    old = io.BytesIO(raw.replace(b"pages/p.jsonl", "pages/pä.json".encode("cp437")))
    assert "pages/pä.json" in warc.ZipIndex(old, len(raw)).members
