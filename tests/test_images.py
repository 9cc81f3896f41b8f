"""Models over parts of images, with stand-ins for what cuts pixels and for the model."""

import gc
import weakref

import pytest
from pyspark.sql import functions as F

from folioframe.flows import images
from folioframe.operators import extract, predict, regions
from folioframe.sources import files, page_xml

NAME = "autods_turku_muuttaneet_1890-1899_mko1_{}.xml"



def test_one_image_and_one_batch_are_held():
    alive, parts, batches = weakref.WeakSet(), [], []
    most = 0

    class Image:
        def __init__(self, path):
            self.path = path

    def read(path):
        nonlocal most
        if path == "broken":
            raise OSError("no such image")
        image = Image(path)
        alive.add(image)
        gc.collect()
        most = max(most, len(alive))
        return image

    def cut(image, boxes):
        if image.path == "bad":
            raise ValueError("not an image")
        parts.append(len(boxes))
        return [f"{image.path}:{b}".encode() for b in boxes]

    def model(batch):
        batches.append(len(batch))
        return [len(p) for p in batch]

    rows = [(f"i{i}", None if i == 5 else "broken" if i == 6 else "bad" if i == 7 else f"p{i}", [(f"c{j}", j, 0, 1, 1) for j in range(n)]) for i, n in enumerate([1, 2, 130, 1, 1, 2, 2, 2, 3, 0])]
    got = list(images.batches_over(iter(rows), read, cut, model, 50))
    assert most == 1 and max(batches) == 50 == max(parts) and batches[:-1] == [50, 50] and sum(batches) == 138
    faults = {(i, c): f for i, c, _, f in got if f}
    assert faults == {("i5", "c0"): "no image", ("i5", "c1"): "no image", ("i6", "c0"): "no such image", ("i6", "c1"): "no such image", ("i7", "c0"): "not an image", ("i7", "c1"): "not an image"}
    answers = {(i, c): a for i, c, a, f in got if not f}
    assert len(answers) == 138 and answers["i2", "c100"] == len("p2:(100, 0, 1, 1)")
    with pytest.raises(ValueError, match="0 answers to 1 parts"):
        list(images.batches_over(iter(rows[:1]), read, cut, lambda b: [], 50))


def stand_ins():
    """What cuts an image, which is text here and a part its characters from x on, and the model."""

    def cut(content, boxes):
        if content.startswith(b"not"):
            raise ValueError("not an image")
        return [content[x : x + w] for x, _, w, _ in boxes]

    def shares(parts):
        return [{"line": 0.5, "empty": 0.5} if p.isupper() else {"misc": 0.9, "line": 0.1} for p in parts]

    return cut, shares


def test_documents_get_classes(spark, tmp_path):
    cell = lambda c, x: f'<TableCell id="c{c}" row="0" col="{c}"><Coords points="{x},0 {x + 2},4"/></TableCell>'
    page = f'<PcGts xmlns="{page_xml.NAMESPACE}"><Page imageFilename="a" imageWidth="9" imageHeight="9"><TableRegion id="t"><Coords points="0,0 9,9"/>{cell(0, 0)}{cell(1, 3)}</TableRegion></Page></PcGts>'
    for folder in ("xml", "img/x", "img/y"):
        (tmp_path / folder).mkdir(parents=True)
    for i in range(5):
        (tmp_path / "xml" / NAME.format(i)).write_text(page if i < 4 else page.replace(cell(1, 3), ""))
    for folder, i, content in (("x", 0, "ABcdEF"), ("y", 0, "zzzzzz"), ("x", 1, "abcDEF"), ("x", 2, "not an image")):
        (tmp_path / "img" / folder / NAME.format(i).replace("xml", "jpg")).write_text(content)
    report = images.classify_documents(spark, str(tmp_path / "xml"), str(tmp_path / "img"), str(tmp_path / "out"), *stand_ins())
    assert {int(r.file_name[-5]): (r.cells, r.fault) for r in report.collect()} == {0: (2, None), 1: (2, None), 2: (2, "not an image"), 3: (2, "no image"), 4: (0, None)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_file() and not p.name.startswith(".")) == [NAME.format(0), NAME.format(1)]
    kinds = {(int(r.file_name[-5]), r.col): r.cell_type for r in page_xml.cells(page_xml.scan(spark, str(tmp_path / "out"))).collect()}
    assert kinds == {(0, 0): "empty", (0, 1): "misc", (1, 0): "misc", (1, 1): "empty"}


def test_boxes_without_a_place(spark):
    cells = spark.createDataFrame([("i", "a", 0, 0, 1, 1), ("i", "b", None, 0, 1, 1), ("i", "c", 0, 0, 0, 1)], "image string, cell string, x int, y int, w int, h int")
    none = spark.createDataFrame([], "image string, path string, length long")
    got = images.over_images(cells, none, *stand_ins(), "string").collect()
    assert {r.cell: r.fault for r in got} == {"a": "no image", "b": "no box", "c": "no box"}
    assert images.over_images(cells.limit(0), none, *stand_ins(), "int").count() == 0


def test_small_items(spark):
    rows = spark.createDataFrame([("t", 0, ["a", "turku"]), ("t", 1, ["b", "oulu"]), ("u", 0, ["c", "d"]), ("v", 0, ["e"])], "tab string, row int, texts array<string>")
    found = {r.tab: r.col for r in predict.parish_columns(rows, ["tab"], lambda texts: next((i for i, x in enumerate(texts[0]) if x == "turku"), 7 if texts[0] == ["e"] else -1)).collect()}
    assert found == {"t": 1, "u": None, "v": None}
    shapes = spark.createDataFrame([("d", 0, [1] * 4), ("d", 1, [1] * 3), ("d", 2, [1] * 5), ("e", 0, [1] * 4)], "doc string, ord int, points array<int>")
    assert sorted((r.doc, r.ord) for r in regions.until_small(shapes, "doc").collect()) == [("d", 0), ("e", 0)]
    named = spark.createDataFrame([("/x/line/1",), ("/x/line/2",), ("/x/misc/3",)], "path string")
    assert {r.label: r.n for r in files.label_counts(files.labelled_by_folder(files.with_names(named))).collect()} == {"line": 2, "misc": 1}
    records = spark.createDataFrame([("a/b/p.xml", "t", 1, "{}"), ("q.xml", "t", 0, "{}")], "source_xml string, table_id string, row_idx int, extracted_data string")
    table = rows.filter("tab = 't'").select(F.lit("mands-p.xml").alias("file_name"), F.col("tab").alias("table_id"), "row", "texts")
    assert [(r.source_xml, r.row_idx, r.texts[0], r.extracted_data) for r in extract.result_view(records, table).orderBy("row_idx").collect()] == [("a/b/p.xml", 0, "a", None), ("a/b/p.xml", 1, "b", "{}")]
