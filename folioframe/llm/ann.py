"""Nearest neighbours by cosine over a hierarchical k-means tree, searched best bin first.

The upper levels are fitted on a bounded sample of directions; where the table is larger, the lower levels are fitted
cell by cell in tasks, each on a bounded sample of its own, so that leaves stay small as the table grows. Every vector is
put into a leaf. A query keeps a priority queue of subtrees by the closeness of their centres and opens the closest one until it
has visited as many leaves as calibration found necessary, and until these hold enough candidates. Only found
vectors are scored: in blocks first, and those that can be among the best exactly, in double precision.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bounds of the fit: vectors in the sample, rows per leaf, branches per node, sample rows used as queries.
SAMPLE, LEAF, BRANCH, PROBES = 40_000, 300, 16, 300
#: Small tables have smaller leaves, so that there is something to choose from: about so many, of so many rows at least.
LEAVES, LEAST_LEAF = 100, 16
#: Sample of one cell for the levels below it, at most; with fewer rows per cell than LEAF there are none.
CELL_SAMPLE = 12_000
#: Recall that calibration asks for on the sample; the contract asks for 0.9.
RECALL = 0.96
#: Rows of one leaf that one task scores at once; larger leaves are dealt in chunks. Queries scored with them at once.
CHUNK, BLOCK = 4096, 512


@dataclass
class Tree:
    """Nodes by number: children (empty for a leaf) and the unit centres of the children; leaves are numbered."""

    children: list[list[int]] = field(default_factory=list)
    centres: list[np.ndarray | None] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the closest child at each node."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.centres[node] is None:
                out[rows] = self.leaf[node]
                continue
            near = np.argmax(x[rows] @ self.centres[node].T, axis=1)
            todo += [(child, rows[near == i]) for i, child in enumerate(self.children[node]) if (near == i).any()]
        return out

    def visit(self, query: np.ndarray):
        """Leaves in the order of a best-bin-first search."""
        queue, tie = [(0.0, 0, 0)], 0
        while queue:
            _, _, node = heapq.heappop(queue)
            if self.centres[node] is None:
                yield self.leaf[node]
                continue
            for child, close in zip(self.children[node], self.centres[node] @ query):
                tie += 1
                heapq.heappush(queue, (-float(close), tie, child))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-30), centres)
    return centres, np.argmax(x @ centres.T, axis=1)


def fit(sample: np.ndarray, leaf: int = LEAF, branch: int = BRANCH, seed: int = 5) -> Tree:
    tree, rng = Tree(), np.random.default_rng(seed)

    def grow(rows: np.ndarray) -> int:
        node = len(tree.children)
        tree.children.append([])
        tree.centres.append(None)
        tree.leaf.append(-1)
        if len(rows) > leaf:
            centres, own = _kmeans(sample[rows], min(branch, max(2, len(rows) // leaf)), rng)
            groups = [(i, rows[own == i]) for i in range(len(centres)) if (own == i).any()]
            if len(groups) > 1:
                tree.centres[node] = centres[[i for i, _ in groups]]
                tree.children[node] = [grow(g) for _, g in groups]
                return node
        tree.leaf[node], tree.leaves = tree.leaves, tree.leaves + 1
        return node

    grow(np.arange(len(sample)))
    return tree


def graft(tree: Tree, below: dict[int, Tree]) -> Tree:
    """The tree with some leaves replaced by trees of their own; leaves are numbered anew."""
    out = Tree()

    def copy(source: Tree, node: int) -> int:
        if source is tree and source.centres[node] is None and source.leaf[node] in below:
            return copy(below[source.leaf[node]], 0)
        at = len(out.children)
        out.children.append([])
        out.centres.append(source.centres[node])
        out.leaf.append(-1)
        if source.centres[node] is None:
            out.leaf[at], out.leaves = out.leaves, out.leaves + 1
        else:
            out.children[at] = [copy(source, child) for child in source.children[node]]
        return at

    copy(tree, 0)
    return out


def calibrate(tree: Tree, sample: np.ndarray, k: int, recall: float = RECALL, probes: int = PROBES, seed: int = 7) -> int:
    """Leaves to visit: widened until the mean share of the k true neighbours (in the sample) that lie in visited leaves is `recall`."""
    if len(sample) <= 1 or tree.leaves <= 1:
        return 1
    rng, own = np.random.default_rng(seed), tree.assign(sample)
    chosen = rng.choice(len(sample), min(probes, len(sample)), replace=False)
    k = min(k, len(sample) - 1)
    need = []  # for every true neighbour the number of visits that reach its leaf
    for q in chosen:
        close = sample @ sample[q]
        close[q] = -np.inf
        rank = np.empty(tree.leaves, np.int64)
        for i, leaf in enumerate(tree.visit(sample[q])):
            rank[leaf] = i + 1
        need.append(rank[own[np.argpartition(-close, k - 1)[:k]]])
    return int(np.quantile(np.concatenate(need), recall, method="higher"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array of double): rows with an id and a vector that is not null or zero and has only finite components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _deepen(tree: Tree, entries: DataFrame, n: int, seed: int) -> Tree:
    """Fits the levels below the leaves of a tree that the whole sample made, on about CELL_SAMPLE rows of each leaf at most."""
    top = entries.sparkSession.sparkContext.broadcast(tree)  # about SAMPLE / LEAF centres
    # leaves of LEAF rows of the table are wanted; of a cell, as many rows are read as that takes
    wanted = min(CELL_SAMPLE, n / tree.leaves)

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(top.value.assign(_unit(_matrix(batch.column(0))))), batch.column(0)], ["cell", "v"])

    placed = entries.select("v").mapInArrow(place, "cell long, v array<double>")
    # a cell's share by a hash of the vector: only what is taken is shuffled, and no cell is sorted
    counts = dict(map(tuple, placed.groupBy("cell").count().collect()))  # a row for each cell
    shares = F.array(*[F.lit(min(1.0, wanted / counts.get(cell, 1))) for cell in range(tree.leaves)])
    some = placed.filter(F.pmod(F.xxhash64("v", F.lit(seed + 1)), F.lit(1 << 30)) < F.get(shares, F.col("cell").cast("int")) * float(1 << 30))

    def grow(key, rows):
        x = _unit(np.array(rows["v"].tolist(), dtype=np.float64))
        return pd.DataFrame({"cell": [key[0]], "tree": [pickle.dumps(fit(x, seed=seed))]})

    fitted = some.groupBy("cell").applyInPandas(grow, "cell long, tree binary").collect()  # SAMPLE * CELL_SAMPLE / LEAF^2 centres at most
    return graft(tree, {r.cell: pickle.loads(r.tree) for r in fitted})


def search(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = RECALL, seed: int = 5, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose vec_id is divisible by `every`.

    vectors(vec_id, embedding): null ids and unusable vectors take no part, nor do vectors of another length than the most
    frequent one (of equally frequent ones the longest); ids are unique and repeated rows of one id with one vector count
    once; an empty table gives no rows. Equal vectors are one entry with the k + 1 smallest ids, which is all that any
    query can need, so a hot vector makes no pairs; a leaf of many rows is scored in chunks. Every query gets k answers
    if there are as many candidates. The order of the input does not matter. A report, if given, gets the number of leaves and
    the share of all entries that a query is scored against, on average; that is a job of its own.
    """
    spark = vectors.sparkSession
    fine = usable(vectors)
    lengths = fine.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fine = fine.filter(F.size("v") == lengths[0].d)
    # per task k + 1 ids of a vector at most go to the shuffle
    order = Window.partitionBy("v").orderBy("vec_id")
    rows = fine.distinct().withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = written(rows, "ann-entries")
    n = entries.count()
    taken = entries.select("v").orderBy(F.xxhash64("v", F.lit(seed)), "v").limit(SAMPLE)
    sample = _unit(np.array([r[0] for r in taken.collect()], dtype=np.float64))  # SAMPLE vectors at most
    tree = fit(sample, leaf=min(LEAF, max(LEAST_LEAF, n // LEAVES)), seed=seed)
    if n > 2 * SAMPLE:
        tree = _deepen(tree, entries, n, seed)
    visits = calibrate(tree, sample, k, recall)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            x = _unit(_matrix(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.assign(x)), batch.column(0), batch.column(1)], ["leaf", "v", "ids"])

    indexed = written(entries.mapInArrow(place, "leaf long, v array<double>, ids array<long>").withColumn("chunk", F.pmod(F.xxhash64("v"), F.lit(1 << 20))), "ann-index")
    sizes = written(indexed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("chunks"), F.sum(F.size("ids")).alias("held"), F.count(F.lit(1)).alias("rows")), "ann-leaves")
    held = np.zeros(tree.leaves, np.int64)
    for r in sizes.collect():  # a row for each leaf of the tree
        held[r.leaf] = r.held
    counts = spark.sparkContext.broadcast(held)

    # queries: every usable row of the divisible ids; those of one vector share a search
    asked = written(fine.filter(F.col("vec_id") % every == 0).distinct(), "ann-asked")
    searches = written(asked.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "ann-searches")

    def route(batches):
        for batch in batches:
            x, qs = _unit(_matrix(batch.column(1))), batch.column(0).to_pylist()
            q, leaf, at = [], [], []
            for i in range(len(qs)):
                found = 0
                for visited, to in enumerate(shared.value.visit(x[i])):
                    if visited >= visits and found > k:  # the query's own row is one of them
                        break
                    found += counts.value[to]
                    q.append(qs[i])
                    leaf.append(to)
                    at.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(q, pa.int64()), batch.column(1).take(pa.array(at, pa.int64()))], ["leaf", "q", "v"])

    routed = searches.select("q", "v").mapInArrow(route, "leaf long, q long, v array<double>")
    if report is not None:
        scored = routed.join(sizes.select("leaf", "rows"), "leaf").groupBy("q").agg(F.sum("rows").alias("n")).agg(F.avg("n")).first()[0] or 0
        report |= {"leaves": tree.leaves, "visits": visits, "share": scored / n}
    chunks = sizes.select("leaf", "chunks")
    bins = routed.join(chunks, "leaf").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "q", "v", F.lit(None).cast("array<long>").alias("ids"))
    dealt = indexed.join(chunks, "leaf").select("leaf", F.pmod("chunk", "chunks").alias("chunk"), F.lit(None).cast("long").alias("q"), "v", "ids")
    both = dealt.unionByName(bins).repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk", F.col("q").asc_nulls_first())

    def score(batches):
        bin_, entries_ = None, []
        for batch in batches:
            leaf, chunk = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            asks = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(chunk) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                if (leaf[a], chunk[a]) != bin_:
                    bin_, entries_ = (leaf[a], chunk[a]), []
                part = batch.slice(a, b - a)
                if not asks[a]:  # entries come first, so they are complete once a query comes
                    entries_.append((_matrix(part.column(3)), part.column(4).to_pylist()))
                elif entries_:
                    if len(entries_) > 1:
                        entries_ = [(np.concatenate([x for x, _ in entries_]), [i for _, ids in entries_ for i in ids])]
                    yield _best(*entries_[0], _matrix(part.column(3)), part.column(2).to_pylist(), k)

    scored = both.select("leaf", "chunk", "q", "v", "ids").mapInArrow(score, "q long, vec_id long, score double")
    per_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    per_vector = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = scored.withColumn("_r", F.row_number().over(per_vector)).filter(F.col("_r") <= k + 1).drop("_r")
    found = asked.join(searches, "v").select(F.col("vec_id").alias("query_id"), "q").join(top, "q").filter("query_id <> vec_id")
    return found.withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(entries: np.ndarray, ids: list[list[int]], asked: np.ndarray, qs: list[int], k: int) -> pa.RecordBatch:
    """For each query its k + 1 best ids among the entries (it may be one of them)."""
    norms, own = (np.sqrt(np.einsum("ij,ij->i", x, x)) for x in (entries, asked))
    unit = entries / norms[:, None]
    m, out_q, out_id, out_score = len(entries), [], [], []
    for at in range(0, len(qs), BLOCK):
        block = (asked[at : at + BLOCK] / own[at : at + BLOCK, None]) @ unit.T
        least = np.partition(block, m - k - 1, axis=1)[:, m - k - 1] if m > k + 1 else np.full(len(block), -np.inf)
        for i, (rough, cut) in enumerate(zip(block, least), at):
            # products in blocks round as they like: what may be among the best is summed again in one fixed order
            near = np.flatnonzero(rough >= cut - 1e-9)
            close = np.einsum("ij,j->i", entries[near], asked[i]) / (norms[near] * own[i])
            best = sorted((-s, v) for s, j in zip(close.tolist(), near) for v in ids[j])[: k + 1]
            out_q += [qs[i]] * len(best)
            out_id += [v for _, v in best]
            out_score += [-s for s, _ in best]
    return pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_id, pa.int64()), pa.array(out_score, pa.float64())], ["q", "vec_id", "score"])
