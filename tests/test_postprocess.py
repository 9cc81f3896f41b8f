"""Documents in, documents and a report out."""

from pyspark.sql import functions as F

from folioframe.flows import postprocess
from folioframe.operators import catalogue
from folioframe.sources import page_xml

BOOK = "turku_muuttaneet_1890-1899_mko1"
HEADERS = ["nro", "nimi", "mistä"]


def table(name, rows, x=0, y=0, step=10, types=None):
    cells = []
    for r, row in enumerate(rows):
        for c, text in enumerate(row):
            if text is not None:
                kind = (types or {}).get((r, c), "line")
                points = f"{x + c * step},{y + r * step} {x + (c + 1) * step},{y + (r + 1) * step}"
                cells.append(f'<TableCell id="{name}{r}{c}" row="{r}" col="{c}" custom="structure {{type:{kind};}}"><Coords points="{points}"/><CornerPts>0 1 2 3</CornerPts><TextLine><TextEquiv><Unicode>{text}</Unicode></TextEquiv></TextLine></TableCell>')
    return f'<TableRegion id="{name}"><Coords points="0,0 9,9"/>{"".join(cells)}</TableRegion>'


def page(*tables):
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<PcGts xmlns="{page_xml.NAMESPACE}"><Page imageFilename="a.jpg" imageWidth="1000" imageHeight="700">{"".join(tables)}</Page></PcGts>'


FULL = [["1", "Anna Maria Virtanen", "Turku"], ["2", "Juho Heikki Salo", "&quot;"]]
FILES = {
    1: page(table("a", [r[:2] for r in FULL]), table("b", [r[2:] for r in FULL], x=30)),  # halves of one table
    2: page(table("a", [[*r, ""] for r in FULL]), table("small", [["x", "y"]], x=1, y=1, step=4)),  # an empty column, and a table within the other
    3: page(table("a", [["", "", "", "", ""], ["", "", "", "", ""]])),  # empty, of another width
    4: page(table("a", [r[:2] for r in FULL])),  # too narrow: stays, and is reported
    5: page(table("one", [["x"]])),  # no table of two cells
    21: page(table("h", [["Anna", "1"], ["x", "2"]], types={(1, 0): "same-as"}), table("in", [["a", "b"]], x=1, y=1, step=4)),  # handwritten
    6: "<PcGts><Page",
    7: page(table("a", FULL, types={(0, 0): "odd"})),
    8: page(table("a", FULL), table("a", FULL)),
    31: page(table("a", FULL)),  # a layout that nobody describes
}


def test_from_documents_to_documents(spark, tmp_path):
    folder = tmp_path / "in/turku/muuttaneet_1890-1899_mko1/pageTextClassified"
    folder.mkdir(parents=True)
    names = {n: f"autods_{BOOK}_{n}.xml" for n in FILES}
    for n, content in FILES.items():
        (folder / names[n]).write_text(content)
    (folder / "autods_oulu_muuttaneet_1890-1899_mko1_1.xml").write_text(FILES[1])
    (folder / "notes.xml").write_text(FILES[1])
    cells = lambda **at: [at.get(f"c{i}") for i in range(1, 20)]
    books = catalogue.books(spark.createDataFrame([(2, cells(c1="turku", c4="40", c5="muuttaneet", c8="1890-1899", c9="mko1", c17="muuttaneet", c19="print 1:1-20, handrawn in:21-30, print 9:31-40"))], "row_no int, cells array<string>"))
    types = catalogue.print_types(spark.createDataFrame([(2, ["print 1", "one table", "in", None, None, "3", *HEADERS])], "row_no int, cells array<string>"))
    report = postprocess.postprocess(spark, str(tmp_path / "in/*/*/pageTextClassified/*.xml"), books, types, str(tmp_path / "out"), str(tmp_path / "work")).collect()
    by_opening = {(r.book_id, r.opening): r for r in report if r.book_id == BOOK and r.opening != 21}
    said = {o: (r.fault, r.table_id, r.n_rows, r.n_cols, r.expected, r.problematic) for (_, o), r in by_opening.items()}
    assert said == {
        1: (None, "a", 2, 3, 3, False), 2: (None, "a", 2, 3, 3, False), 3: (None, "a", 1, 3, 3, True), 4: (None, "a", 2, 2, 3, True), 5: (None, None, None, None, None, None),
        6: ("not parsed or no page", *[None] * 5), 7: ("cell of unknown type", *[None] * 5), 8: ("table without an id of its own", *[None] * 5), 31: ("no annotation of the layout", *[None] * 5),
    }
    assert {r.file_name: r.fault for r in report if r.book_id != BOOK} == {"autods_oulu_muuttaneet_1890-1899_mko1_1.xml": "unknown book", "notes.xml": "no book and opening in the name"}
    assert [(r.layout, r.printed, r.table_id, r.n_cols, r.expected) for r in report if r.opening == 21] == [("handrawn in", False, "h", 2, None)]

    out = tmp_path / "out/turku/muuttaneet_1890-1899_mko1/pagePostprocessed"
    assert len(list(out.iterdir())) == len(FILES) + 2 and not list((tmp_path / "out").glob("_*"))
    for n in (6, 7, 8, 31):
        assert (out / names[n]).read_text() == FILES[n]
    docs = page_xml.scan(spark, str(out / f"autods_{BOOK}_[1-5].xml")).unionByName(page_xml.scan(spark, str(out / names[21])))
    texts = {}
    for r in page_xml.cells(docs, least_cells=1).orderBy("file_name", "row", "col").collect():
        texts.setdefault((r.file_name, r.table_id), {}).setdefault(r.row, []).append(r.text)
    got = {(int(f.split("_")[-1][:-4]), t): list(rows.values()) for (f, t), rows in texts.items()}
    # the ditto below Turku is resolved before the halves meet
    whole = [["1", "Anna Maria Virtanen", "Turku"], ["2", "Juho Heikki Salo", "Turku"]]
    assert got == {(1, "a"): whole, (2, "a"): whole, (3, "a"): [["", "", ""]], (4, "a"): [r[:2] for r in whole], (5, "one"): [["x"]], (21, "h"): [["Anna", "1"], ["Anna", "2"]]}
    merged = page_xml.table_rects(docs).filter(F.col("file_name") == names[1]).first()
    assert (merged.x, merged.w) == (0, 40) and (out / names[1]).read_text().startswith("<?xml")


def test_a_model_corrects_what_is_left(spark, tmp_path):
    """Only printed tables of a wrong width reach the model; cells whose text stays in its place keep what else they have."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / f"autods_{BOOK}_1.xml").write_text(page(table("a", [r[:2] for r in FULL])))
    (tmp_path / "in" / f"autods_{BOOK}_2.xml").write_text(page(table("a", FULL)))
    books = spark.createDataFrame([(BOOK, "print 1")], "book_id string, spec string")
    types = spark.createDataFrame([("print 1", 0, "opening", "in", HEADERS)], "print_type string, ord int, page string, direction string, headers array<string>")
    cells, tables, pages = postprocess.repaired(page_xml.scan(spark, str(tmp_path / "in")), books, types, postprocess.keeper(spark, str(tmp_path / "work")), lambda texts, headers: [("insert", 0)])
    got = {(r.file_name[-5], r.row, r.col): (r.text, r.cell_id) for r in cells.collect()}
    assert {k: v for k, v in got.items() if k[0] == "1"} == {("1", 0, 0): ("", None), ("1", 0, 1): ("1", None), ("1", 0, 2): ("Anna Maria Virtanen", None), ("1", 1, 0): ("", None), ("1", 1, 1): ("2", None), ("1", 1, 2): ("Juho Heikki Salo", None)}
    assert got["2", 0, 1] == ("Anna Maria Virtanen", "a01") and len(got) == 12
    assert {(r.file_name[-5], r.n_cols, r.problematic) for r in tables.collect()} == {("1", 3, True), ("2", 3, False)} and pages.filter("fault IS NOT NULL").count() == 0
