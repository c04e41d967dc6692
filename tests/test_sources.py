import csv
import io
import json
import random
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.operators import profile
from gridloom.plans.table import Table
from gridloom.plans.template import Template
from gridloom.sources import writers
from gridloom.sources.delimited import delimiter_of, extension, load_paths, read_delimited
from gridloom.sources.records import left_open


def put(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_ragged_rows_and_missing_marks(spark, tmp_path):
    t = read_delimited(spark, put(tmp_path / "a.csv", ' A b ,N\n1\n2,N/A\n3,"x,y",z\n'))
    assert t.columns == ["a_b", "n", "column_3"]
    assert [tuple(r) for r in t.ordered().collect()] == [(1, None, None), (2, None, None), (3, "x,y", "z")]


def test_encoding_delimiter_and_types(spark, tmp_path):
    text = "名称;值;时间;真\n甲;1,5;2024-01-01;是\n乙;2;2024/01/02 03:04;否\n"
    t = read_delimited(spark, put(tmp_path / "b.txt", text.encode("gbk")))
    assert t.columns == ["名称", "值", "时间", "真"] and dict(t.rows().dtypes) == {"名称": "string", "值": "string", "时间": "timestamp_ntz", "真": "boolean"}
    assert t.ordered().collect()[1] == ("乙", "2", datetime(2024, 1, 2, 3, 4), False)
    t = read_delimited(spark, put(tmp_path / "c.tsv", "a\tb\tc\n1\t0\t1.5\n2\t1\t-\n"))
    assert dict(t.rows().dtypes) == {"a": "bigint", "b": "bigint", "c": "double"}


def test_cells_over_several_lines(spark, tmp_path):
    t = read_delimited(spark, put(tmp_path / "m.csv", '"a, ""x""",b\n1,"two\nlines"\n2,"q ""z"", \n\n w",3,"e\n",f\n3,plain\n'))
    assert t.columns == ["a,_\"x\"", "b", "column_3", "column_4", "column_5"]
    assert [tuple(r) for r in t.ordered().collect()] == [(1, "two\nlines", None, None, None), (2, 'q "z", \n\n w', 3, "e", "f"), (3, "plain", None, None, None)]
    gbk = put(tmp_path / "g.csv", '名,值\n甲,"一\n二"\n'.encode("gbk"))
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    t = read_delimited(spark, gbk)
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before
    assert [tuple(r) for r in t.ordered().collect()] == [("甲", "一\n二")]


@pytest.mark.parametrize("encoding", ["utf-8", "gbk"])
def test_lines_of_one_record_in_several_splits(spark, tmp_path, encoding):
    draw = random.Random(3)
    rows = [[str(i), "".join(draw.choice('甲b ",\n') for _ in range(draw.choice((3, 9, 300 if i % 20 == 0 else 5)))), f"z{i}"] for i in range(80)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([["i", "v", "w"], *rows])
    path = put(tmp_path / "r.csv", out.getvalue().encode(encoding))
    size = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in size]
    try:
        spark.conf.set(size[0], "150")
        spark.conf.set(size[1], "0")
        assert spark.read.text(path).rdd.getNumPartitions() >= 10
        t = read_delimited(spark, path, keep_text=True)
        assert [(r.i, r.v or "", r.w) for r in t.ordered().collect()] == [(i, v.strip(), w) for i, v, w in rows]
    finally:
        for k, v in zip(size, before, strict=True):
            spark.conf.set(k, v)


def test_which_lines_leave_a_cell_open(spark):
    cases = {'a,"b': True, '"': True, ' "a""': True, '"a","b"': False, 'x "y, z': False, '5" a,"b': True, '"a"b",c': False, '""': False, '"""': True, "": False, '"a" x,"': True, '"' + "ab" * 200_000: True, '"",' * 100_000: False}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, line string").select("i", left_open(F.col("line"), ",").alias("o"))
    assert [r.o for r in df.orderBy("i").collect()] == list(cases.values())
    tab = spark.createDataFrame([('a\t"b',), ('\t\t"b"\t,"',)], "line string").select(left_open(F.col("line"), "\t").alias("o"))
    assert [r.o for r in tab.collect()] == [True, False]


@pytest.mark.parametrize("kind", ["csv", "tsv", "txt"])
@pytest.mark.parametrize("breaks", [False, True])
def test_what_is_written_is_read_back(spark, tmp_path, kind, breaks):
    rows = [(i, (None, 'a "b", c', "x\ty", "two\nlines" if breaks else "a;b", "'", '"')[i % 6], i / 4, f"n{i % 3}") for i in range(200)]
    t = Table.of(spark.createDataFrame(rows, "id long, s string, v double, t string").repartition(5), "id")
    path = str(tmp_path / f"out.{kind}")
    getattr(writers, f"write_{kind}")(t, path)
    assert len(list((tmp_path / f"out.{kind}").glob("part-*"))) > 1
    back = read_delimited(spark, path)
    assert back.columns == t.columns and [tuple(r) for r in back.ordered().collect()] == rows


def test_sniffing():
    assert delimiter_of(["a;b;c", "1,2;3;4"], "csv") == ";" and delimiter_of(["abc"], "csv") == "|" and delimiter_of(["a,b"], "tsv") == "\t"
    assert extension("/x/Y.CSV") == "csv"
    with pytest.raises(ValueError):
        extension("/x/y.json")


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = lambda rows: f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/><sheet name="None" sheetId="3" r:id="r3"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/><Relationship Id="r3" Target="worksheets/sheet3.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", sheet('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>When</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>3</v></c><c r="C2" s="1"><v>45292.5</v></c></row><row r="3"><c r="A3" t="b"><v>1</v></c><c r="B3" t="e"><v>#N/A</v></c></row>'))
        z.writestr("xl/worksheets/sheet2.xml", sheet('<row><c><v>1.5</v></c></row><row><c><v>2</v></c></row>'))
        z.writestr("xl/worksheets/sheet3.xml", sheet(""))
    return str(path)


def test_workbooks(spark, tmp_path):
    found = load_paths(spark, [workbook(tmp_path / "book.xlsx"), put(tmp_path / "d.csv", "x,y\n1,2\n")])
    (tmp_path / "book.xlsx").unlink()  # it is parsed once, when it is loaded
    assert set(found) == {"book[One]", "book[Two]", "d"}
    one = found["book[One]"]
    assert one.columns == ["name", "column_2", "when"]
    assert found["book[Two]"].columns == ["1_5"]
    assert [tuple(r) for r in one.ordered().collect()] == [("ab", "3", datetime(2024, 1, 1, 12)), ("true", "ERROR", None)]
    with pytest.raises(ValueError, match="e.pdf.*none.csv"):  # all that cannot be read are named
        load_paths(spark, [str(tmp_path / "e.pdf"), str(tmp_path / "d.csv"), str(tmp_path / "none.csv")])


def test_parts_beyond_five_digits_keep_their_order(spark, tmp_path):
    (tmp_path / "p.csv").mkdir()
    for n, text in ((99_999, "a\n1\n"), (100_000, "2\n"), (100_001, "3\n")):
        put(tmp_path / "p.csv" / f"part-{n:05d}-x.csv", text)
    assert [r.a for r in read_delimited(spark, str(tmp_path / "p.csv")).ordered().collect()] == [1, 2, 3]


def lines(path):
    return "".join(p.read_text(encoding="utf-8") for p in sorted(path.glob("part-*"))).splitlines()


def test_writers(spark, tmp_path):
    t = Table.of(spark.createDataFrame([(3, 'q "x", y', None), (1, "", 1.5), (2, "plain", 2.0)], "id long, s string, v double"), "id")
    writers.write_csv(t, str(tmp_path / "csv"))
    assert lines(tmp_path / "csv") == ["﻿id,s,v", "1,,1.5", "2,plain,2.0", '3,"q ""x"", y",']
    writers.write_tsv(t, str(tmp_path / "tsv"))
    assert lines(tmp_path / "tsv")[0] == "﻿id\ts\tv"
    writers.write_quality_report(t, "demo", str(tmp_path / "report"), profile.Rules(primary_key="id"))
    report = json.loads(writers.read_text(spark, str(tmp_path / "report")))
    assert report["dataset"] == "demo" and len(report["columns"]) == 3 and report["overview"]["duplicate_row_count"] == 0
    template = Template("demo", (("KeepTopRows", {"count": 1}), ("DropEmptyRows", {})))
    writers.save_template(spark, template, str(tmp_path / "template"))
    assert writers.load_template(spark, str(tmp_path / "template")) == template


def test_streams(spark, tmp_path):
    from gridloom.streaming.tables import deduplicated, sessions, windowed_aggregate

    rows = [(1, "a", datetime(2024, 1, 1, 0, 0, s), float(s)) for s in (0, 10, 50)] + [(2, "a", datetime(2024, 1, 1, 0, 3), 9.0), (3, "b", datetime(2024, 1, 1, 1), 1.0)]
    spark.createDataFrame(rows, "id long, k string, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(make, name):
        q = make(spark.readStream.schema("id long, k string, ts timestamp, v double").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.sql(f"SELECT * FROM {name}").collect()

    got = run(lambda s: windowed_aggregate(s, "ts", ["k"], "v", "1 minute", "1 minute"), "w")
    assert sorted((r.k, r.rows, r.sum) for r in got) == [("a", 1, 9.0), ("a", 3, 60.0)]
    assert sorted(r.rows for r in run(lambda s: sessions(s, "ts", ["k"], "45 seconds", "1 minute"), "s")) == [1, 3]
    assert sorted(r.id for r in run(lambda s: deduplicated(s, "ts", ["id"]), "d")) == [1, 2, 3]
