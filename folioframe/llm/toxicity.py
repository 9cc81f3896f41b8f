"""Toxicity by compression distance: two zstandard dictionaries, and how much better one of them packs each window.

The ordinary dictionary is trained on windows of ordinary texts, the toxic one on the phrases of toxic texts that
ordinary ones lack; the latter is used in front of the former, so a window's gain, its packed length without minus
with the toxic dictionary, comes from toxic phrases alone. Counts of windows beyond graded thresholds
make a document's score by a logistic curve, calibrated on labelled documents that trained no dictionary.
"""

from __future__ import annotations

import math
import pickle
import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, held

#: Bounds of the training sample: labelled rows of each class, which are taken whole.
TOXIC_ROWS, ORDINARY_ROWS = 1500, 4500
#: Words of a window; bytes of the toxic and of the ordinary dictionary; compression level.
WINDOW, TOXIC_BYTES, ORDINARY_BYTES, LEVEL = 8, 3000, 24_576, 12
#: Gains that are counted, and lengths of the character runs that tell toxic words.
THRESHOLDS, RUNS = range(1, 10), (5, 6, 7, 8, 9)
#: Follows every window that is measured: a long run packs to a few bytes, so that the window is never
#: stored as it is because packing it alone would save too little.
FILL = b"\n" * 64
#: A run tells if its share of toxic texts is so much larger than that of ordinary ones, and at least that large.
RATIO, SHARE = 20, 0.03


def windows(text: str | None) -> list[bytes]:
    width = WINDOW
    words = text.lower().split() if text else []
    return [(" " + " ".join(words[i : i + width])).encode() for i in range(0, len(words), width)]


@dataclass
class Model:
    """Dictionary contents and the weights of the score; without labels of both classes every score is 0."""

    toxic: bytes
    ordinary: bytes
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        out = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            kind = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=256, dict_size=TOXIC_BYTES + ORDINARY_BYTES, min_match=3, write_content_size=False)
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=kind)
            out.append(zstandard.ZstdCompressor(dict_data=own, compression_params=kind))
        return out[0], out[1]

    def features(self, text: str | None, packers) -> list[float]:
        plain, toxic = packers[0].compress, packers[1].compress
        gains = np.array([len(plain(w + FILL)) - len(toxic(w + FILL)) for w in windows(text)] or [0])
        n, counts = len(gains), [int((gains >= t).sum()) for t in THRESHOLDS]
        top = [*np.sort(gains)[::-1][:3].tolist(), 0, 0][:3]
        return [1.0, math.log(n), *(math.log1p(c) for c in counts), *(c / n for c in counts), float(np.maximum(gains, 0).mean()), *(min(t, 15) for t in top)]

    def scores(self, texts: list[str | None], packers) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        x = np.array([self.features(t, packers) for t in texts]).reshape(len(texts), len(self.weights))
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.spread @ self.weights, -500, 500)))


def _runs(word: str) -> set[str]:
    word = " " + word
    return {word[i : i + n] for n in RUNS for i in range(len(word) - n + 1)}


def telling_runs(toxic: list[str], ordinary: list[str]) -> set[str]:
    """Character runs of words that are far more frequent in toxic than in ordinary texts."""
    least = max(3, SHARE * len(toxic))
    # counts by hash first: an upper bound that tells which runs are worth an exact count, without holding all of them
    upper, mask = np.zeros(1 << 20, np.int32), (1 << 20) - 1
    for text in toxic:
        upper[list({hash(r) & mask for w in set(text.lower().split()) for r in _runs(w)})] += 1
    counts: Counter = Counter()
    for text in toxic:
        counts.update({r for w in set(text.lower().split()) for r in _runs(w) if upper[hash(r) & mask] >= least})
    able = {r for r, c in counts.items() if c >= least}
    other: Counter = Counter()
    for text in ordinary:
        other.update({r for w in set(text.lower().split()) for r in _runs(w) if r in able})
    return {r for r in able if counts[r] / len(toxic) > RATIO * (other[r] + 0.5) / len(ordinary)}


def phrases(text: str, runs: set[str]) -> list[bytes]:
    """The parts of the words of a text that telling runs cover."""
    found = []
    for word in text.lower().split():
        padded = " " + word
        hit = [False] * len(padded)
        for n in RUNS:
            for i in range(len(padded) - n + 1):
                if padded[i : i + n] in runs:
                    hit[i : i + n] = [True] * n
        found += ["".join(c if h else "\0" for c, h in zip(padded, hit))]
    return [p.encode() for part in found for p in part.split("\0") if p]


def _dictionary(samples: list[bytes], size: int, k: int, rng: random.Random) -> bytes:
    """Content of a trained dictionary; of too few samples the plain text of some of them."""
    samples = samples[:]
    rng.shuffle(samples)
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit(toxic: list[str], ordinary: list[str], prior: float | None = None, seed: int = 11) -> Model:
    """Two thirds of each class train the dictionaries, the rest the curve; prior: the true odds toxic : ordinary."""
    rng = random.Random(seed)
    toxic, ordinary = sorted(toxic), sorted(ordinary)
    rng.shuffle(toxic)
    rng.shuffle(ordinary)
    n, m = -(-2 * len(toxic) // 3), -(-2 * len(ordinary) // 3)
    if not toxic[n:] or not ordinary[m:]:
        return Model(b"", b"")
    runs = telling_runs(toxic[:n], ordinary[:m])
    told = [p for t in toxic[:n] for p in phrases(t, runs)]
    mixed = [b"".join(rng.choices(told, k=6)) for _ in range(4000)] if told else []
    plain = [w for t in ordinary[:m] for w in windows(t)]
    model = Model(_dictionary(mixed, TOXIC_BYTES, 24, rng), _dictionary(plain, ORDINARY_BYTES, 64, rng))
    packers = model.compressors()
    x = np.array([model.features(t, packers) for t in toxic[n:] + ordinary[m:]])
    y = np.array([1.0] * len(toxic[n:]) + [0.0] * len(ordinary[m:]))
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-9
    model.mean[0], model.spread[0] = 0, 1
    z, w = (x - model.mean) / model.spread, np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps of the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.3 * np.eye(len(w)), z.T @ (y - p) - 0.3 * w)
    if prior:
        w[0] += math.log(prior / (y.sum() / (len(y) - y.sum())))
    model.weights = w
    return model


def held_out(doc_id):
    """Whether the unsigned CRC-32 of the id as text is divisible by 5; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model:
    """Fits on the whole texts of at most toxic_rows + ordinary_rows labelled documents that are not held out, chosen by a hash of
    the id; rows with null ids or labels do not count, an id with several labels has the largest, one with several texts the least."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("_toxic"))
    sizes = dict(map(tuple, known.groupBy("_toxic").count().collect()))
    chosen = None
    for kind, rows in ((True, toxic_rows), (False, ordinary_rows)):
        some = known.filter(F.col("_toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    ids = [tuple(r) for r in chosen.collect()]
    if not ids:
        return Model(b"", b"")
    # ids of the bounded sample only
    few = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, _toxic boolean"))
    found = docs.select("doc_id", F.col("text").alias("t")).join(few, "doc_id").filter("t IS NOT NULL").groupBy("doc_id").agg(F.min("t").alias("t"), F.max("_toxic").alias("x")).select("t", "x").collect()
    odds = sizes.get(True, 0) / sizes[False] if sizes.get(False) else None
    return fit([t for t, x in found if x], [t for t, x in found if not x], odds)


def _ready(packed: bytes) -> tuple:
    """A pickled model and its compressors, made once in a worker."""

    def make():
        own = pickle.loads(packed)
        return own, own.compressors() if own.weights is not None else None

    return held(("toxicity", packed), make)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and score of every row of docs; texts are scored whole, null and empty ones as one window without gain.
    One pass without shuffle; the model (some 30 KB) goes with the code."""
    packed = pickle.dumps(model)

    def run(batches):
        own, packers = _ready(packed)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(own.scores(batch.column(0).to_pylist(), packers), pa.float64())], [*names, "score"])

    names = [f"_c{i}" for i in range(len(keep))]
    types = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep))
    out = docs.select("text", *(F.col(c).alias(n) for n, c in zip(names, keep))).mapInArrow(giving_back(run), f"{types}, score double")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "score")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5) of every row; repeated rows all stay, an empty table gives none."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of docs(text, ...) with a score below 0.5, all columns as they are. One pass without shuffle."""
    packed = pickle.dumps(model)

    def run(batches):
        own, packers = _ready(packed)
        for batch in batches:
            yield batch.filter(pa.array(own.scores(batch.column("text").to_pylist(), packers) < 0.5))

    return docs.mapInArrow(giving_back(run), docs.schema)
