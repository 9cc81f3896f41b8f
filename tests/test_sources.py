import io
import json
import zipfile

from folioframe.sources import archives, files, page_xml, records
from folioframe.streaming import ingest

PAGE = """<?xml version="1.0" encoding="UTF-8"?>
<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"><Metadata><Creator>me</Creator><Created>2024</Created></Metadata>
<Page imageFilename="a.jpg" imageWidth="100" imageHeight="80"><TableRegion id="t1"><Coords points="0,0 9,9"/>
<TableCell id="c1" row="0" col="0" custom="structure {type:line;}"><Coords points="1,2 3,2 3,8 1,8"/><CornerPts>0 1 2 3</CornerPts>
<TextLine id="l1"><TextEquiv><Unicode> Anna </Unicode></TextEquiv></TextLine><TextLine id="l2"><TextEquiv><Unicode>Maria</Unicode></TextEquiv></TextLine></TableCell>
<TableCell id="c2" row="0" col="1"><Coords points="4,2 9,8"/></TableCell></TableRegion>
<TableRegion id="t2"><Coords points="0,0 9,9"/><TableCell id="d1" row="0" col="0"><Coords points="1,1 2,2"/></TableCell></TableRegion></Page></PcGts>"""
NAME = "autods_turku_muuttaneet_1890-1899_mko1_3.xml"


def test_page_xml(spark, tmp_path):
    (tmp_path / NAME).write_text(PAGE)
    docs = page_xml.scan(spark, str(tmp_path))
    assert docs.first().meta.parish == "turku"
    cells = page_xml.cells(docs).orderBy("col")
    first, second = cells.collect()
    assert (first.text, first.cell_type, first.rect.w) == ("Anna \nMaria", "line", 2)
    assert (second.text, second.cell_type, second.table_id) == ("", "empty", "t1")
    parsed = [json.loads(r.json) for r in page_xml.table_json(docs).collect()]
    assert [len(p["table"]["cells"]) for p in parsed] == [1, 0] and parsed[0]["table"]["cells"][0]["row_span"] == 1
    assert page_xml.by_status(docs).count() == 1



RECT = "x int, y int, w int, h int"


def test_xml_upsert(spark, tmp_path):
    (tmp_path / NAME).write_text(PAGE)
    files_ = spark.createDataFrame([(NAME, PAGE), ("other.xml", "<left/>")], "file_name string, content string")
    rows = [(NAME, "t1", (0, 0, 9, 9), 0, 0, "c2", "same-as", "New", (4, 2, 5, 6)), (NAME, "t1", (0, 0, 9, 9), 0, 1, None, None, None, None)]
    cells = spark.createDataFrame(rows, f"file_name string, table_id string, table_rect struct<{RECT}>, row int, col int, cell_id string, cell_type string, text string, rect struct<{RECT}>")
    got = {r.file_name: r.xml for r in page_xml.updated_xml(cells, files_).collect()}
    assert got["other.xml"] == "<left/>"
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / NAME).write_text(got[NAME])
    docs = page_xml.scan(spark, str(tmp_path / "out"))
    again = page_xml.cells(docs, least_cells=1).orderBy("table_id", "col").collect()
    # the cell that is not there goes, the table of one cell stays
    assert [(r.table_id, r.cell_id, r.text, r.cell_type) for r in again] == [("t1", "c_0_0", "New", "same-as"), ("t1", "c_0_1", "", "line"), ("t2", "d1", "", "empty")]
    assert got[NAME].count("CornerPts") == 4 and "Anna" not in got[NAME] and "<ns0" not in got[NAME]

    labels = spark.createDataFrame([(NAME, "1,2 3,2 3,8 1,8", "misc"), (NAME, "4,2 9,8", "line")], "file_name string, points string, label string")
    (xml,) = [r.xml for r in page_xml.classified_xml(files_, labels).collect()]
    assert 'custom="structure {type:line;} structure {type:misc;}"' in xml and xml.count("type:line;") == 2
    gone = {r.file_name: r.xml for r in page_xml.without_elements(files_, spark.createDataFrame([(NAME, "t1")], "file_name string, id string")).collect()}
    assert 'id="t1"' not in gone[NAME] and 'id="t2"' in gone[NAME] and gone["other.xml"] == "<left/>"


def test_xml_readers(spark, tmp_path):
    region = {"id": "r1", "points": "0,0 5,0 5,5 0,5", "type": "header", "lines": [{"id": "l1", "points": "0,0 5,5", "baseline": "0,4 5,4", "text": " Turku "}, {"id": "l2", "points": "0,0 1,1"}]}
    (tmp_path / NAME).write_text(PAGE)
    (tmp_path / "b.xml").write_text(page_xml.new_page("b.jpg", 10, 20, "me", "2024", [region]))
    docs = page_xml.scan(spark, str(tmp_path))
    flat = page_xml.flat_texts(docs).orderBy("ord").collect()
    assert [(r.coords, r.baseline, r.text) for r in flat] == [("1,2 3,2 3,8 1,8", None, "Anna"), ("4,2 9,8", None, ""), ("1,1 2,2", None, "")]
    assert [(r.key, r.text) for r in page_xml.line_texts(docs).orderBy("key").collect()] == [("r1_l1", "Turku"), ("r1_l2", "")]
    assert [(r.region_id, r.type, len(r.points)) for r in page_xml.text_regions(docs).collect()] == [("r1", "header", 4)]
    assert {r.file_name: r.creator for r in page_xml.metadata(docs).collect()} == {NAME: "me", "b.xml": "me"}
    assert [r.file_name for r in page_xml.annotated_files(docs).collect()] == [NAME] == [r.file_name for r in page_xml.files_with_text(docs).collect()]
    boxes = {(r.kind, r.table_ord, r.number): (r.x1, r.y1, r.x2, r.y2) for r in page_xml.evaluation_boxes(docs).collect()}
    assert boxes == {("table", 0, 0): (0, 0, 9, 9), ("table", 1, 0): (0, 0, 9, 9), ("row", 0, 0): (1, 2, 9, 8), ("column", 0, 0): (1, 2, 3, 8), ("column", 0, 1): (4, 2, 9, 8)}
    rects = page_xml.table_rects(docs).collect()
    assert [(r.table_id, r.x, r.y, r.w, r.h, r.page_width) for r in rects] == [("t1", 1, 2, 8, 6, 100)]
    assert [r.texts for r in page_xml.strict_rows(docs).collect()] == [["Anna \nMaria", "---"]]
    assert [(r.n_rows, r.n_cols) for r in page_xml.page_sizes(docs).orderBy("table_id").collect()] == [(1, 2), (1, 1)]
    assert page_xml.grids(docs).count() == 2 and page_xml.reading_order(docs).filter("regions IS NOT NULL").count() == 0
    assert json.loads(records.viewer_cells(page_xml.flat_texts(docs)).first().json)[0] == {"coords": "1,2 3,2 3,8 1,8", "baseline": None, "text": "Anna"}
    page_xml.write_line_texts(page_xml.line_texts(docs), str(tmp_path / "texts"))
    assert {(r.key, r.value) for r in spark.read.text(str(tmp_path / "texts")).collect()} == {("r1_l1", "Turku"), ("r1_l2", "")}


def test_dittos_in_scan(spark, tmp_path):
    cell = lambda r, c, text, kind="line": f'<TableCell id="c{r}{c}" row="{r}" col="{c}" custom="structure {{type:{kind};}}"><Coords points="{c},{r} {c + 1},{r + 1}"/><TextLine><TextEquiv><Unicode>{text}</Unicode></TextEquiv></TextLine></TableCell>'
    grid_ = cell(2, 0, " &quot; ") + cell(0, 0, "Anna") + cell(1, 0, "x", "same-as") + cell(1, 1, "S") + cell(3, 1, "5.")
    (tmp_path / NAME).write_text(f'<PcGts xmlns="{page_xml.NAMESPACE}"><Page imageFilename="a" imageWidth="9" imageHeight="9"><TableRegion id="t"><Coords points="0,0 9,9"/>{grid_}</TableRegion></Page></PcGts>')
    got = page_xml.grids(page_xml.scan(spark, str(tmp_path))).orderBy("row", "col").collect()
    # a cell that is missing is empty and is what a ditto below it takes
    assert [r.text for r in got] == ["Anna", "", "Anna", "", "Anna", "", "", ""]


def test_listings(spark, tmp_path):
    for name in ("p1/b1/pageTextClassified/x.xml", "p1/b1/images/x.jpg", "p2/b2/pageTextClassified/y.xml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1")
    found = files.listing(spark, str(tmp_path))
    assert found.count() == 3 and sorted((r.parish, r.book) for r in files.books(found).collect()) == [("p1", "b1"), ("p2", "b2")]
    status = {r.stem: r.status for r in files.pairs(found.filter("name LIKE '%.jpg'"), found.filter("name LIKE '%.xml'")).collect()}
    assert status == {"x": "pair", "y": "no image"}
    assert files.free_name("a.json", ["a.json", "a_1.json"]) == "a_2.json" and files.free_name("a", []) == "a"
    assert sorted(r.label for r in files.labelled_by_folder(found).collect()) == ["images", "pageTextClassified", "pageTextClassified"]
    (tmp_path / "pairs.json").write_text('[{"annotation": " a ", "prediction": "b"}, {"annotation": "a?", "prediction": "b"}]')
    assert [tuple(r) for r in records.prediction_pairs(spark, str(tmp_path / "pairs.json")).collect()] == [("b", "a")]
    (tmp_path / "crops.json").write_text('{"1": {"file_name": "f", "text": "t"}}')
    assert [tuple(r) for r in records.crop_index(spark, str(tmp_path / "crops.json")).collect()] == [(1, "f", "t")]
    build = lambda: spark.range(2)
    assert [records.stored_or(spark, str(tmp_path / "state"), b).count() for b in (build, lambda: spark.range(9))] == [2, 2]
    members = spark.createDataFrame([("a", "x/1", b"one"), ("a", "x/2", b"two"), ("b", "y", None)], "archive string, name string, content binary")
    (tmp_path / "zips").mkdir()
    assert sorted(r.members for r in archives.write_zips(members, str(tmp_path / "zips")).collect()) == [1, 2]
    back = archives.zip_members(spark, str(tmp_path / "zips"))
    assert sorted((r.name, bytes(r.content)) for r in back.collect()) == [("x/1", b"one"), ("x/2", b"two"), ("y", b"")]


def test_zip_and_workbook(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("turku/x.xml", "1")
        z.writestr("lahti/y.jpg", "2")
    got = archives.zip_members(spark, str(tmp_path / "a.zip"), holds="turku")
    assert [(r.name, bytes(r.content)) for r in got.collect()] == [("turku/x.xml", b"1")]
    assert archives.top_folders(archives.zip_members(spark, str(tmp_path / "a.zip"))).count() == 2
    raw, ns = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Turku</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(raw.getvalue())
    assert [r.cells for r in archives.workbook(spark, str(tmp_path / "b.xlsx")).collect()] == [["Turku", None, "7"]]


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("{'xml_path': 'a', 'table_id': 't', 'item_name': 'x', 'columns': [1]}\n{\"xml_path\": \"a\", \"table_id\": \"t\", \"item_name\": \"x\", \"columns\": [2, 3]}\nbroken\n")
    assert [r.columns for r in records.column_annotations(spark, str(tmp_path / "a.jsonl")).collect()] == [[2, 3]]
    row = spark.createDataFrame([("b", "u", "l", "ok", "in", "p", None, "t", ["x", "y"])], ", ".join(f"`{c}` string" for c in records.MASTER) + ", `original columns` array<string>")
    assert records.master_lines(row).first().value == "b\tu\tl\tok\tin\tp\tNone\tt\tx\ty"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / name).write_text(name)
        ingest.append_new_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda f: f.selectExpr("string(content) AS v")).awaitTermination()
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
