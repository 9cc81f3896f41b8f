"""Models over parts of images: cells meet their images in tasks that hold one image and one batch at a time.

Images are listed, not joined: a task gets the paths of its images and the boxes of their cells, reads one image after another, has the boxes cut
out, and fills batches for the model across images. Cutting pixels and the model are functions that the caller gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import deskew
from ..sources import files, page_xml, sinks, storage

#: Bytes of images for which there is a task.
TASK_BYTES = 256 << 20


def batches_over(rows: Iterator[tuple], read: Callable[[str], bytes], cut: Callable[[bytes, list[tuple[int, int, int, int]]], list[bytes]], predict: Callable[[list[bytes]], list], size: int) -> Iterator[tuple]:
    """(image, cell, answer, fault) for rows (image, path, boxes of cell, x, y, w, h): one image is held at a time, and never more than `size` parts wait for the model.

    An image that cannot be read or cut is a fault of all its cells; a null path is `no image`.
    """
    waiting: list[tuple[str, str, bytes]] = []

    def ask() -> Iterator[tuple]:
        answers = predict([part for *_, part in waiting])
        if len(answers) != len(waiting):
            raise ValueError(f"{len(answers)} answers to {len(waiting)} parts")
        yield from ((image, cell, answer, None) for (image, cell, _), answer in zip(waiting, answers))
        waiting.clear()

    for image, path, boxes in rows:
        if path is None:
            yield from ((image, cell, None, "no image") for cell, *_ in boxes)
            continue
        try:
            content = read(path)
        except (OSError, ValueError) as e:
            yield from ((image, cell, None, str(e)) for cell, *_ in boxes)
            continue
        for at in range(0, len(boxes), size):  # an image with many cells is cut in turns
            some = boxes[at : at + size]
            try:
                parts = cut(content, [tuple(b[1:]) for b in some])
            except (OSError, ValueError) as e:
                yield from ((image, cell, None, str(e)) for cell, *_ in some)
                continue
            for (cell, *_), part in zip(some, parts, strict=True):
                waiting.append((image, cell, part))
                if len(waiting) == size:
                    yield from ask()
        del content
    if waiting:
        yield from ask()


def over_images(cells: DataFrame, images: DataFrame, cut: Callable, predict: Callable, kind: str, size: int = 50, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(image, cell, answer, fault) for cells(image, cell, x, y, w, h) and images(image, path, length), of which nothing is read here: what the model says of each cell, of type `kind`.

    Cells without an image, with a null box, or in an image that does not open have a fault and a null answer; of several images of one name the first by path counts. An image's boxes travel
    as one array beside its path, and images are dealt by name to one task for each task_bytes of them all. The model gets `size` parts at a time, from several images where
    they are small.
    """
    whole = F.expr("x IS NOT NULL AND y IS NOT NULL AND w > 0 AND h > 0")
    boxes = F.sort_array(F.collect_list(F.struct(F.col("cell").cast("string").alias("cell"), *[F.col(c).cast("int").alias(c) for c in "xywh"])))
    one = images.groupBy("image").agg(F.min_by("path", "path").alias("path"), F.min_by("length", "path").alias("length"))
    held = one.agg(F.sum("length")).first()[0] or 0
    asked = cells.filter(whole).groupBy("image").agg(boxes.alias("boxes")).join(one.select("image", "path"), "image", "left")
    tasks = min(max(1, -(-held // task_bytes)), 10_000)

    def read(path: str) -> bytes:
        with storage.open_for_read(path) as source:
            return source.read()

    def run(incoming):
        def rows():
            for batch in incoming:
                for image, path, listed in zip(*(c.to_pylist() for c in batch.columns)):
                    yield image, path, [(b["cell"], b["x"], b["y"], b["w"], b["h"]) for b in listed]

        out, answers = [], batches_over(rows(), read, cut, predict, size)
        for row in answers:
            out.append(row)
            if len(out) == 1000:
                yield _batch(out, kind_type)
                out = []
        if out:
            yield _batch(out, kind_type)

    kind_type = _arrow_type(cells.sparkSession, kind)
    answered = asked.select("image", "path", "boxes").repartition(tasks, "image").mapInArrow(run, f"image string, cell string, answer {kind}, fault string")
    bare = cells.filter(~F.coalesce(whole, F.lit(False))).select("image", F.col("cell").cast("string").alias("cell"), F.lit(None).cast(kind).alias("answer"), F.lit("no box").alias("fault"))
    return answered.unionByName(bare)


def _arrow_type(spark: SparkSession, kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(spark.sql(f"SELECT CAST(NULL AS {kind}) AS x").schema["x"].dataType)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), kind, pa.string()))], ["image", "cell", "answer", "fault"])


def cell_boxes(docs: DataFrame, margin: int = 0) -> DataFrame:
    """(image, cell, file_name, points, x, y, w, h): the cells of tables of two cells or more with the page's stem as image and the box around each, grown by a margin within the page. cell is unique in its image."""
    sizes = docs.select("file_name", F.col("Page._imageWidth").alias("_w"), F.col("Page._imageHeight").alias("_h"))
    found = page_xml.cells(docs).join(sizes, "file_name")
    box = g.let(F.col("rect"), lambda r: deskew.with_margin(r, margin, F.col("_w"), F.col("_h"))) if margin else F.col("rect")
    name = F.concat_ws("-", F.col("table_ord").cast("string"), F.col("cell_ord").cast("string"))
    return found.select(F.regexp_replace("file_name", r"\.[^.]*$", "").alias("image"), name.alias("cell"), "file_name", "points", box.alias("b")).select("image", "cell", "file_name", "points", "b.*")


def classify_documents(spark: SparkSession, path: str, images: str, out: str, cut: Callable, predict: Callable, margin: int = 0, size: int = 50) -> DataFrame:
    """Documents under `path` with the class of each cell, as a model sees it in the images below `images`, written below `out`; returns (file_name, cells, fault).

    predict gives a map of shares for each part: the largest one's name is the class, the first by name of equals. A document of which a cell has no class is not written, and its
    first fault is reported; the others appear together when all are written.
    """
    docs = page_xml.scan(spark, path)
    listed = files.listing(spark, images).filter(~F.endswith("name", F.lit(".xml"))).select(F.col("stem").alias("image"), "path", "length")
    cells = cell_boxes(docs, margin)

    def named(parts: list[bytes]) -> list[str]:
        return [min(shares.items(), key=lambda x: (-x[1], x[0]))[0] for shares in predict(parts)]

    said = cells.select("image", "cell", "file_name", "points").join(over_images(cells, listed, cut, named, "string", size), ["image", "cell"])
    stored = f"{out.rstrip('/')}-classes"
    said.write.mode("overwrite").parquet(stored)
    said = spark.read.schema(said.schema).parquet(stored)
    report = docs.select("file_name").distinct().join(said.groupBy("file_name").agg(F.count(F.lit(1)).alias("cells"), F.min("fault").alias("fault")), "file_name", "left").select("file_name", F.coalesce("cells", F.lit(0)).alias("cells"), "fault")
    good = report.filter("fault IS NULL AND cells > 0").select("file_name")
    content = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content").join(good, "file_name", "left_semi")
    labels = said.join(good, "file_name", "left_semi").select("file_name", "points", F.col("answer").alias("label"))
    written = page_xml.classified_xml(content, labels)
    sinks.write_files(written.select(F.col("file_name").alias("name"), F.col("xml").alias("content")), out, overwrite=True)
    return report
