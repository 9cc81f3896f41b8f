"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every window (consecutive words of an item) is the ordered list of its word shingles. Containment of a
window means that all its shingles occur, so one shingle is a sufficient prefix; the rarest over all
documents is taken. Document shingles that occur in any window are found in one pass over the texts;
those that are a window's prefix give candidates, which the length and position of the window bound, and
whose shingles are compared one by one with those around them in the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_names, written

WINDOW, SHINGLE = 13, 5
#: Rows and bytes of text of a benchmark table up to which it is broadcast; beyond either, a shuffled join.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 32 << 20
#: Matches of a document that candidates take along for verification: a block of so many, and what a window reaches beyond it.
BLOCK = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands before the shingles of a document, so that a document without matches keeps a row.
MARK = 0x5EED0F0C5EED0F0C


def words(text):
    """Maximal runs of ASCII letters and digits and of anything beyond ASCII; none for null."""
    return F.coalesce(F.array_remove(F.split(text, NO_WORD), ""), F.array().cast("array<string>"))


def ascii_lower(text):
    return F.translate(text, UPPER, LOWER)


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, w): the distinct windows (arrays of words) of every item; a shorter item is one window."""
    items = benchmark.select("item_id", words(ascii_lower(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    starts = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda s: F.slice("w", s, n))
    return items.select("item_id", F.explode(starts).alias("w")).distinct()


def _small(df: DataFrame, text: str | None = None) -> bool:
    """Whether df, a written table, is within the bounds of a broadcast; text is its column of unbounded length, if it has one."""
    rows, held = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(text) if text else F.lit(0))).first()
    return rows <= BROADCAST_ROWS and (held or 0) <= BROADCAST_BYTES


def _sized(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _matches(docs: DataFrame, shingles: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """One row a document (p = -1) and one for each of its shingles that is in shingles(sh, k, sid)."""
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w")).withColumn("row", F.monotonically_increasing_id())

    def hashes(k):
        # a lambda binds the lower-cased words once; positions past the end are cut off before
        def of(ws):
            starts = F.slice(ws, 1, F.greatest(F.size(ws) - (k - 1), F.lit(0)))
            return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(ws, i + d) for d in range(1, k)]))

        return of

    folded = F.array(F.transform("w", F.lower))
    all_hashes = F.transform(folded, lambda ws: F.concat(F.array(F.lit(MARK)), *[hashes(k)(ws) for k in sizes]))
    n = F.size("w")
    # outer: else a filter on the array's size would compute the hashes twice
    cut = base.select("row", "doc_id", "text_hash", "w", n.alias("n"), F.get(all_hashes, F.lit(0)).alias("hs")).select("row", "doc_id", "text_hash", "w", "n", F.posexplode_outer("hs").alias("at", "h"))
    first, offset = F.lit(1), {}
    for k in sizes:
        offset[k] = first
        first = first + F.greatest(F.col("n") - (k - 1), F.lit(0))
    place = F.lit(-1)
    for k in sizes:
        place = F.when(F.col("k") == k, F.col("at") - offset[k]).otherwise(place)
    known = shingles.select("sh", "k", "sid", F.xxhash64(*[F.lower(F.get(F.split("sh", " "), F.lit(d))) for d in range(max(sizes, default=1))]).alias("h"))
    mark = docs.sparkSession.range(1).select(F.lit("").alias("sh"), F.lit(0).alias("k"), F.lit(-1).cast("long").alias("sid"), F.lit(MARK).alias("h"))
    if not small:  # the rows are dealt by hash: take the shingle along, not the document
        text = F.lit("")
        for k in sizes:
            text = F.when((F.col("at") >= offset[k]) & (F.col("at") < offset[k] + F.greatest(F.col("n") - (k - 1), F.lit(0))), F.array_join(F.slice("w", F.col("at") - offset[k] + 1, k), " ")).otherwise(text)
        cut = cut.withColumn("text", text).drop("w")
        exact = ascii_lower(F.col("text")) == F.col("sh")
    else:
        exact = ascii_lower(F.array_join(F.slice("w", F.greatest(F.col("p") + 1, F.lit(1)), F.col("k")), " ")) == F.col("sh")
    joined = cut.join(_sized(known.unionByName(mark), small), "h").withColumn("p", place)
    return joined.filter(((F.col("sid") < 0) & (F.col("at") == 0)) | ((F.col("sid") >= 0) & (F.col("p") >= 0) & exact)).select("row", "doc_id", "text_hash", "n", "p", "k", "sid")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs: doc_id, text_hash, n_words, n_hit (words in any occurrence of any window), n_items,
    items_sha256, contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    Null and empty texts have no words; items without words have no window; an item with a null id marks
    words but is not listed; repeated documents and items (equal ids) count once each as rows and as ids; an
    empty table on either side gives no hits; other columns are not read. Texts are taken whole.
    """
    owned = written(windows_of(benchmark, window).withColumn("item_id", F.col("item_id").cast("string")), "decontam-owned")
    win = written(owned.select("w").distinct().withColumn("wid", F.monotonically_increasing_id()), "decontam-windows")
    # a row for each window and item, never a list: a passage that all items share stays spread
    owners = written(owned.filter("item_id IS NOT NULL").join(win, "w").select("wid", F.col("item_id").alias("item")).distinct(), "decontam-owners")
    k = F.least(F.size("w"), F.lit(shingle))
    parts = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda o: F.struct(o.alias("o"), F.array_join(F.slice("w", o + 1, k), " ").alias("sh")))
    cut = win.select("wid", F.size("w").alias("len"), k.alias("k"), F.explode(parts).alias("e")).select("wid", "len", "k", "e.o", "e.sh")
    shingles = written(cut.select("sh", "k").distinct().withColumn("sid", F.monotonically_increasing_id()), "decontam-shingles")
    # at most `shingle` sizes, of which there is one unless items are very short
    sizes = sorted(r[0] for r in shingles.select("k").distinct().collect())
    found = written(_matches(docs, shingles, sizes, _small(shingles, "sh")), "decontam-matches")

    counts = found.filter("sid >= 0").groupBy("sid").agg(F.count(F.lit(1)).alias("c"))
    # windows with a shingle that occurs nowhere cannot occur
    ranked = cut.join(shingles, ["sh", "k"]).join(counts, "sid", "left").groupBy("wid", "len", "k").agg(
        F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "sid", "o")).alias("rarest"), F.transform(F.sort_array(F.collect_list(F.struct("o", "sid"))), lambda x: x["sid"]).alias("want")
    )
    prefixes = written(ranked.filter("rarest.c > 0").select("wid", "len", "want", F.col("rarest.sid").alias("sid"), F.col("rarest.o").alias("o")), "decontam-prefixes")

    listed = F.sort_array(F.collect_list(F.when(F.col("sid") >= 0, F.struct("k", "p", "sid"))))
    per_doc = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("n").alias("n"), listed.alias("m"))
    per_doc = per_doc.select("row", "doc_id", "text_hash", "n", F.transform("m", lambda x: x["p"]).alias("ps"), F.transform("m", lambda x: x["sid"]).alias("sids"))
    # a candidate takes its block of matches along, not all of its document
    reach = max(window - shingle, 0)
    begins = lambda b: F.greatest(b * BLOCK - reach, F.lit(0))
    around = lambda c, b: F.slice(c, begins(b) + 1, BLOCK + 2 * reach)
    block = lambda b: F.struct((b * BLOCK - begins(b)).alias("skip"), around(F.col("ps"), b).alias("ps"), around(F.col("sids"), b).alias("sids"))
    blocks = per_doc.filter(F.size("sids") > 0).select("row", "n", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("sids") - 1) / BLOCK).cast("int")), block)).alias("b")).select("row", "n", "b.*")
    candidates = blocks.select("row", "n", "ps", "sids", "skip", F.posexplode(F.slice("sids", F.col("skip") + 1, F.lit(BLOCK))).alias("i", "sid"))
    candidates = candidates.withColumn("j", F.col("skip") + F.col("i")).join(_sized(prefixes, _small(prefixes)), "sid")
    length, begin = F.size("want"), F.col("j") - F.col("o")
    start = F.get("ps", F.col("j")) - F.col("o")
    bounded = candidates.filter((start >= 0) & (start + F.col("len") <= F.col("n")) & (begin >= 0) & (begin + length <= F.size("sids")))
    verified = bounded.filter(
        (F.get("ps", begin) == start) & (F.get("ps", begin + length - 1) == start + length - 1) & (F.slice("sids", begin + 1, length) == F.col("want"))
    ).select("row", "wid", start.alias("s"), "len")

    def cover(spans):
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))
        step = lambda acc, x: F.struct(
            F.greatest(acc["end"], x["s"] + x["len"]).alias("end"), (acc["hit"] + F.greatest(F.lit(0), x["s"] + x["len"] - F.greatest(acc["end"], x["s"]))).alias("hit")
        )
        return F.aggregate(F.sort_array(spans), zero, step)["hit"]

    hits = verified.groupBy("row").agg(cover(F.collect_set(F.struct("s", "len"))).alias("n_hit"), F.collect_set("wid").alias("wids"))
    items = hits.select("row", F.explode("wids").alias("wid")).join(_sized(owners, _small(owners, "item")), "wid")
    items = items.select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    full = per_doc.select("row", "doc_id", "text_hash", "n").join(hits.select("row", "n_hit"), "row", "left").join(items, "row", "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return full.select(
        "doc_id", "text_hash", F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Rows of docs(doc_id, text, ...) that are not contaminated, all columns. A row is known by its id (null too) and a hash of its text."""
    one, two = own_names(docs, "_d", "_h")
    bad = contamination(docs, benchmark, window, shingle).filter("contaminated").select(F.col("doc_id").alias(one), F.col("text_hash").alias(two)).distinct()
    return docs.join(written(bad, "decontam-dropped"), docs["doc_id"].eqNullSafe(F.col(one)) & (F.xxhash64(docs["text"]) == F.col(two)), "left_anti")
