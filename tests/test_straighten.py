"""Straightening of openings: solved perspectives against numpy, corrections of the second model, and documents moved with the page."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from folioframe.functions import geometry as g
from folioframe.operators import straighten

XML = """<?xml version="1.0" encoding="UTF-8"?>
<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15">
<Page imageFilename="a.jpg" imageWidth="1000" imageHeight="700"><TableRegion id="t1"><Coords points="110,60 480,80 470,640 100,620"/>
<TableCell id="c1" row="0" col="0"><Coords points="520,90  900,100"/><TextLine><Coords points='0,0 999,699'/><TextEquiv><Unicode>says points="1,2" &lt; x</Unicode></TextEquiv></TextLine></TableCell></TableRegion></Page></PcGts>"""
KEYS = {"tl": (100, 50), "tm": (500, 70), "tr": (930, 60), "bl": (90, 640), "bm": (490, 650), "br": (940, 630)}


def solve(source, target):
    """The eight unknowns by elimination, as numpy does it."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return [*np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0]


def points(array):
    return F.array(*[F.struct(F.lit(int(x)).alias("x"), F.lit(int(y)).alias("y")) for x, y in array])


def test_perspective_is_the_solution(spark):
    rng = np.random.default_rng(4)
    square = np.array([(0, 0), (600, 0), (600, 900), (0, 900)])
    cases = [(square + rng.integers(-150, 150, (4, 2)), square + rng.integers(-150, 150, (4, 2))) for _ in range(20)] + [(square + 7, square)]
    got = spark.range(1).select(*[g.perspective(points(a), points(b)).alias(f"c{i}") for i, (a, b) in enumerate(cases)]).first()
    for found, (a, b) in zip(got, cases):
        assert np.allclose(found, solve(a, b), atol=1e-6)
    line = spark.range(1).select(g.perspective(points([(0, 0), (1, 1), (2, 2), (3, 3)]), points(square)).alias("c"), g.perspective(F.array(F.lit(None).cast("struct<x:int,y:int>")), points(square)).alias("d")).first()
    assert line.c is None and line.d is None


def brute_point(x, y, keys):
    """A point through the half in which it lies deepest."""

    def depth(outline):
        inside, near = False, math.inf
        for (ax, ay), (bx, by) in zip(outline, outline[1:] + outline[:1]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                inside = not inside
            d2 = (bx - ax) ** 2 + (by - ay) ** 2
            t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / d2))
            near = min(near, math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
        return near if inside else -near

    high = keys["bm"][1] - keys["tm"][1]
    halves = []
    for names, wide, offset in ((("tl", "tm", "bm", "bl"), keys["tm"][0] - keys["tl"][0], 0), (("tm", "tr", "br", "bm"), keys["tr"][0] - keys["tm"][0], keys["tm"][0] - keys["tl"][0])):
        outline = [keys[n] for n in names]
        halves.append((depth(outline), solve(outline, [(0, 0), (wide, 0), (wide, high), (0, high)]), offset))
    _, m, offset = max(halves, key=lambda h: h[0])
    z = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / z + offset, (m[3] * x + m[4] * y + m[5]) / z


def pages_of(spark, rows):
    kind = ", ".join(f"{n}: STRUCT<x: INT, y: INT>" for n in straighten.POINTS)
    return spark.createDataFrame(rows, f"file_name string, width int, height int, points STRUCT<{kind}>")


def test_documents_move_with_the_page(spark):
    files = spark.createDataFrame([("a.xml", XML), ("b.xml", XML), ("c.xml", "<left/>")], "file_name string, content string")
    pages = pages_of(spark, [("a.xml", 1000, 700, tuple(KEYS[n] for n in straighten.POINTS)), ("b.xml", 1000, 700, None)])
    got = {r.file_name: r.xml for r in straighten.straightened_xml(files, pages, scale=0.5).collect()}
    assert got["b.xml"] == XML and got["c.xml"] == "<left/>"
    want = XML.replace("a.jpg", "mands-a.jpg").replace('imageWidth="1000"', f'imageWidth="{830 // 2}"').replace('imageHeight="700"', f'imageHeight="{580 // 2}"')

    def moved(m):
        out = []
        for word in m.group(2).split():
            x, y = brute_point(*map(int, word.split(",")), KEYS)
            out.append(f"{int(min(max(x, 0), 1000) * 0.5)},{int(min(max(y, 0), 700) * 0.5)}")
        return m.group(1) + " ".join(out)

    want = re.sub(r"""(<Coords points=["'])([^"']*)""", moved, want)
    assert got["a.xml"] == want and 'says points="1,2"' in got["a.xml"]
    try:
        straighten.straightened_xml(files, pages_of(spark, [("a.xml", 999, 700, tuple(KEYS[n] for n in straighten.POINTS))])).collect()
    except Exception as e:
        assert "no page of the image's size in a.xml" in str(e)
    else:
        raise AssertionError("another size must stop the query")


def test_two_stages(spark):
    shares = [(x / 1000, y / 700) for x, y in (KEYS[n] for n in straighten.POINTS)]
    found = spark.createDataFrame([("a", 1000, 700, shares), ("b", 1000, 700, shares[:5]), ("c", 1000, 700, shares)], "page string, width int, height int, shares array<struct<x:double,y:double>>")
    pages = straighten.first_points(found)
    assert {r.page: r.points is None for r in pages.collect()} == {"a": False, "b": True, "c": False}
    asked = {(r.page, r.name): r for r in straighten.zooms(pages, "page").collect()}
    assert len(asked) == 12
    # 150 around the point, cut at the page's edges; mirrored for right and lower points
    first = pages.filter("page = 'a'").first().points
    z = asked["a", "br"]
    assert (z.x, z.w, z.y, z.h) == (first.br.x - 150, 1000 - first.br.x + 150, first.br.y - 150, 700 - first.br.y + 150)
    assert (z.px, z.py) == (z.w - 150, z.h - 150)
    p = lambda n, dx, dy: (asked["a", n].px + dx, asked["a", n].py + dy)
    rows = [
        ("a", "tl", 0, "midpoint", 1.0, 1.0), ("a", "tl", 1, "corner", *map(float, p("tl", 4, 3))), ("a", "tl", 2, "corner", 0.0, 0.0),  # the first corner counts
        ("a", "br", 0, "corner", *map(float, p("br", 6, -2))),  # mirrored both ways
        ("a", "tm", 0, "midpoint", *map(float, p("tm", 140, 0))),  # turns the middle too far
        ("a", "bm", 0, "corner", 0.0, 0.0),
    ]
    out = {r.page: r for r in straighten.second_points(pages, spark.createDataFrame(rows, "page string, name string, ord int, class string, x double, y double"), "page").collect()}
    a = out["a"].points
    assert (a.tl.x, a.tl.y) == (first.tl.x + 4, first.tl.y + 3) and (a.br.x, a.br.y) == (first.br.x - 6, first.br.y + 2)
    assert a.tm == first.tm and a.bm == first.bm and out["a"].refused == ["tm"]
    assert out["b"].points is None and out["c"].points == first and out["c"].refused == []
    # what was moved there comes back
    t = pages_of(spark, [("a", 1000, 700, a)]).select(straighten.transforms(F.col("points"), back=True).alias("t")).select("t.*").first()
    assert (t.width, t.height, t.offset) == (a.tr.x - a.tl.x, a.bm.y - a.tm.y, a.tm.x - a.tl.x)
    round_trip = np.array(t.left).reshape(3, 3) @ np.array(t.left_back).reshape(3, 3)
    assert np.allclose(round_trip / round_trip[2, 2], np.eye(3), atol=1e-9)
