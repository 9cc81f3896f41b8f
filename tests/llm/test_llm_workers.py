import public_tokenizers
import pyarrow as pa

from folioframe.llm import common, wavelet


def test_held_keeps_one_state():
    made = []

    def make(name):
        made.append(name)
        return name

    assert [common.held(k, lambda k=k: make(k)) for k in ("a", "a", "b", "a")] == ["a", "a", "b", "a"]
    assert made == ["a", "b", "a"]  # what another key kept has gone


def test_slices_keep_all_rows_in_order():
    texts = ["", None, "x" * 10, "é" * 3, "y" * 50, None, "z", "w" * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts, pa.string())], ["id", "text"])
    parts = list(common.slices(batch, 1, 12))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3], [4], [5, 6, 7]]
    assert pa.Table.from_batches(parts).column("text").to_pylist() == texts
    assert list(common.slices(batch.slice(0, 0), 1, 12)) == []
    assert len(list(common.slices(batch, 1, 1000))) == 1


def test_giving_back_passes_batches_on():
    batches = [pa.RecordBatch.from_arrays([pa.array([i])], ["a"]) for i in range(3)]
    assert list(common.giving_back(iter)(iter(batches))) == batches
    assert list(common.giving_back(iter)(iter([]))) == []


def test_gathered_keeps_all_rows_in_order():
    texts = [["a" * 5, None], [], ["é"], ["b" * 30], ["c"], []]
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.string())], ["text"]) for t in texts]
    got = [b.column(0).to_pylist() for b in common.gathered(iter(batches), 0, 7)]
    assert got == [["a" * 5, None, "é"], ["b" * 30], ["c"]]
    assert list(common.gathered(iter([]), 0, 7)) == []


def test_shards_close_at_their_size(spark):
    """Shards are cut at the document that fills them, wherever batches end."""
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('word ', cast(id % 7 AS int)) AS text").coalesce(1)
    manifest = wavelet.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), shard_ids=40).collect()
    assert sum(r.n_docs for r in manifest) == 300
    last = {r.part: max(q.seq for q in manifest if q.part == r.part) for r in manifest}
    assert all(40 <= r.n_ids < 54 for r in manifest if r.seq < last[r.part])
    assert sorted(r.base for r in manifest) == sorted(sum(q.n_ids for q in manifest if (q.part, q.seq) < (r.part, r.seq)) for r in manifest)
