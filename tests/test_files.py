"""Archives read by range, and files and archives that appear when a job is done, and only then."""

import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from folioframe.sources import archives, files, page_xml, sinks, zip_ranges

TABLE = '<TableRegion id="{}"><Coords points="0,0 9,9"/><TableCell id="c" row="0" col="0"><Coords points="1,1 2,2"/><CornerPts>0</CornerPts></TableCell></TableRegion>'


def page(*tables):
    return f'<PcGts xmlns="{page_xml.NAMESPACE}"><Page imageFilename="a" imageWidth="9" imageHeight="9">{"".join(map(TABLE.format, tables))}</Page></PcGts>'


class Watched(io.BytesIO):
    """Remembers how much was asked for, at once and altogether."""

    most = total = 0

    def read(self, n=-1):
        self.most, self.total = max(self.most, n), self.total + n
        return super().read(n)


def listed(raw):
    return list(zip_ranges.entries(io.BytesIO(raw), len(raw)))


def test_reads_ranges_only():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for i in range(300):
            z.writestr(zipfile.ZipInfo(f"m{i}"), bytes([i % 256]) * 50_000)
        z.writestr("folder/", b"")
    source = Watched(raw.getvalue())
    found = list(zip_ranges.entries(source, len(raw.getvalue()), piece=4096))
    assert len(found) == 300 and zip_ranges.read_member(source, found[77]) == bytes([77]) * 50_000
    # of 15 MB: the end, the directory in pieces, and one member
    assert source.most <= 70_000 and source.total < 300_000


@pytest.mark.parametrize("front", [b"", b"#!/bin/sh\nexit\n" * 9])
def test_large_archives(front):
    """More members than 16 bits count, sizes that stand in the extra field, comments that look like an end, and data in front."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"n{i}"), b"" if i % 1000 else b"text" * i)
        with z.open(zipfile.ZipInfo("large"), "w", force_zip64=True) as f:
            f.write(b"x" * 1000)
    data = front + raw.getvalue()
    found = listed(data)
    assert len(found) == 66_001 and zip_ranges.read_member(io.BytesIO(data), found[-1]) == b"x" * 1000
    assert zip_ranges.read_member(io.BytesIO(data), found[65_000]) == b"text" * 65_000
    small = io.BytesIO()
    with zipfile.ZipFile(small, "w") as z:
        z.writestr("ä€.txt", "1")
        z.comment = b"PK\x05\x06 is not here" + b"PK\x05\x06" + bytes(18)
    assert [e.name for e in listed(front + small.getvalue())] == ["ä€.txt"]


def test_old_names_and_faults():
    def archive(name, flags, method, data, crc=None):
        local = zip_ranges.LOCAL_FIELDS.pack(zip_ranges.LOCAL, 20, flags, method, 0, 0, zlib.crc32(data) if crc is None else crc, len(data), len(data), len(name), 0) + name + data
        entry = zip_ranges.ENTRY_FIELDS.pack(zip_ranges.DIRECTORY, 20, 20, flags, method, 0, 0, zlib.crc32(data) if crc is None else crc, len(data), len(data), len(name), 0, 0, 0, 0, 0, 0) + name
        return local + entry + zip_ranges.END_FIELDS.pack(zip_ranges.END, 0, 0, 1, 1, len(entry), len(local), 0)

    assert listed(archive("Häme".encode("cp437"), 0, 0, b"x"))[0].name == "Häme"
    for raw, word in ((archive(b"a", 1, 0, b"x"), "encrypted"), (archive(b"a", 0, 12, b"x"), "method 12"), (archive(b"a", 0, 0, b"x", 5), "damaged")):
        with pytest.raises(ValueError, match=word):
            zip_ranges.read_member(io.BytesIO(raw), listed(raw)[0])
    for raw in (b"", b"no archive at all", b"PK\x05\x06"):
        with pytest.raises((ValueError, struct.error)):
            listed(raw)


def test_one_archive_feeds_many_tasks(spark, tmp_path):
    for name in ("x_turku", "y_lahti"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for i in range(40):
                z.writestr(f"{name}/images/{i}.{'xml' if i % 2 else 'jpg'}", f"{name} {i}" * 500)
    path = str(tmp_path / "*.zip")
    got = archives.zip_members(spark, path, suffix=".xml", archives=["turku", "oulu"], task_bytes=1000)
    assert got.rdd.getNumPartitions() > 4 and got.select(F.spark_partition_id()).distinct().count() > 2
    assert sorted((r.name, bytes(r.content).decode()) for r in got.collect()) == sorted((f"x_turku/images/{i}.xml", f"x_turku {i}" * 500) for i in range(1, 40, 2))
    # in place: the members of both archives by their top folders, changed
    out = archives.rezipped(spark, path, str(tmp_path / "out"), lambda m: m.filter("name LIKE '%.xml'").withColumn("content", F.concat(F.col("content"), F.lit(b"!"))), archives=["lahti"])
    assert [(r.archive, r.members) for r in out.collect()] == [("y_lahti", 20)]
    with zipfile.ZipFile(tmp_path / "out" / "y_lahti.zip") as z:
        assert z.testzip() is None and z.read("y_lahti/images/3.xml") == b"y_lahti 3" * 500 + b"!"
    split = archives.split_by_folder(spark, str(tmp_path / "*.zip"), str(tmp_path / "split"), holds="1.")
    assert sorted((r.archive, r.members) for r in split.collect()) == [("x_turku", 4), ("y_lahti", 4)]


def below(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file())


def test_files_appear_when_all_are_written(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.createDataFrame([("a/x.txt", 2, "two"), ("a/x.txt", 1, "one "), ("b.txt", 1, None), ("c.txt", 1, "é")], "name string, ord int, content string").repartition(3)
    sinks.write_files(rows, str(out), ["ord"])
    assert below(out) == ["a/x.txt", "b.txt", "c.txt"] and (out / "a/x.txt").read_text() == "one two" and (out / "b.txt").read_bytes() == b"" and (out / "c.txt").read_text() == "é"
    # a job that fails in one of its tasks, others being done, leaves what was there
    broken = rows.withColumn("content", F.when(F.col("name") == "c.txt", F.raise_error(F.lit("killed"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="killed"):
        sinks.write_files(broken, str(out), ["ord"], overwrite=True)
    assert below(out) == ["a/x.txt", "b.txt", "c.txt"] and (out / "a/x.txt").read_text() == "one two" and not list(out.glob("_*"))
    sinks.write_files(rows.filter("name = 'c.txt'"), str(out))
    assert len(below(out)) == 3
    sinks.write_files(rows.filter("name = 'c.txt'"), str(out), overwrite=True)
    assert below(out) == ["c.txt"]
    for name in ("../up", "/abs", None, "_hidden"):
        with pytest.raises(Exception, match="not a name"):
            sinks.write_files(spark.createDataFrame([(name, "x")], "name string, content string"), str(out))
    scattered = spark.createDataFrame([("d", "x"), ("d", "y")], "name string, content string").repartition(2)
    scattered.sparkSession.dataSource.register(sinks.NamedFiles)
    with pytest.raises(Exception, match="several tasks wrote one file"):
        scattered.write.format("named_files").option("path", str(out)).mode("append").save()
    assert below(out) == ["c.txt"] and not list(out.glob("_*"))


def test_books(spark, tmp_path):
    root = tmp_path / "in"
    for name, content in (("p1/b1/pageTextClassified/z.xml", page("t1", "t2")), ("p1/b1/pageTextClassified/a.xml", page("t3")), ("p1/b1/1.jpg", "jpg" * 700_000), ("p2/b2/pageTextClassified/y.xml", page())):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    found = files.listing(spark, str(root))
    books = files.books(found)
    tables = page_xml.table_json(page_xml.scan(spark, str(root / "*/*/pageTextClassified/*.xml"))).join(books, "path")
    parts = F.split("path", "/")
    images = found.filter("name LIKE '%.jpg'").select(F.get(parts, F.size(parts) - 3).alias("parish"), F.get(parts, F.size(parts) - 2).alias("book"), "path", "name")
    sinks.write_books(spark, tables, images, books.select("parish", "book").distinct(), str(tmp_path / "out"))
    assert below(tmp_path / "out") == ["p1/b1/images/1.jpg", "p1/b1/tables/tables.jsonl", "p2/b2/tables/tables.jsonl"]
    lines = (tmp_path / "out/p1/b1/tables/tables.jsonl").read_text().splitlines()
    assert [(json.loads(x)["source_xml_file"], json.loads(x)["table"]["id"]) for x in lines] == [("a.xml", "t3"), ("z.xml", "t1"), ("z.xml", "t2")]
    assert (tmp_path / "out/p2/b2/tables/tables.jsonl").read_text() == "" and (tmp_path / "out/p1/b1/images/1.jpg").stat().st_size == 2_100_000


def test_evaluation_trees(spark, tmp_path):
    key = "turku_muuttaneet_1890-1899_mko1"
    made = {
        f"ann/printed/x/y/mands-{key}_3.xml": "A3", f"ann/handdrawn/x/y/mands-{key}_4.xml": "A4", f"ann/printed/x/y/mands-{key}_5.xml": "A5", f"ann/other/x/y/mands-{key}_6.xml": "A6", "ann/printed/x/y/odd.xml": "O",
        **{f"all/autods_turku_fold_1/images/turku/b/pageTextClassified/autods_{key}_{n}.xml": f"B{n}" for n in (3, 4, 6)}, f"all/autods_turku_fold_2/images/turku/b/pageTextClassified/autods_{key}_4.xml": "C4", f"all/autods_turku_fold_1/images/turku/b/other/autods_{key}_5.xml": "C5",
    }
    for name, content in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    pairs = files.evaluation_pairs(files.listing(spark, str(tmp_path / "ann")), files.listing(spark, str(tmp_path / "all")))
    assert sorted((r.name.split("_")[-1], r.status) for r in pairs.collect()) == [("3.xml", "pair"), ("4.xml", "several"), ("5.xml", "missing"), ("6.xml", "no kind"), ("odd.xml", "no name")]
    sinks.write_files(files.evaluation_files(pairs), str(tmp_path / "out"))
    tree = f"autods_turku_fold_1/images/turku/b/pageTextClassified/autods_{key}_3.xml"
    assert below(tmp_path / "out") == [f"printed/actual/{tree}", f"printed/annotated/{tree}"] and (tmp_path / "out" / "printed/annotated" / tree).read_text() == "A3"
