import sqlite3
import tempfile
import zipfile

from framewise.sources import excel, files, jdbc, schema, sqlite

M = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_xlsx(path, rows):
    """A minimal workbook written with the standard library only."""
    shared, body = [], []
    for i, row in enumerate(rows):
        cells = []
        for j, v in enumerate(row):
            ref = chr(65 + j) + str(i + 1)
            if v is None:
                continue
            if isinstance(v, str):
                shared.append(v)
                cells.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            else:
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
        body.append(f'<row r="{i + 1}">' + "".join(cells) + "</row>")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{M}" xmlns:r="{R}"><sheets>'
                                      f'<sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="ws"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{M}"><sheetData>{"".join(body)}'
                                               f'</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml",
                   f'<sst xmlns="{M}">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")


def test_excel_folder_one_task_per_workbook(spark):
    d = tempfile.mkdtemp()
    write_xlsx(f"{d}/a.xlsx", [["name", "x"], ["a", 1], ["b", 2.5]])
    write_xlsx(f"{d}/b.xlsx", [["name", "x"], ["c", 3], ["d", None]])
    df = excel.read_excel(spark, f"{d}/*.xlsx")
    assert df.rdd.getNumPartitions() == 2
    assert dict(df.dtypes)["x"] == "double"
    rows = sorted((r["name"], r["x"]) for r in df.collect())
    assert rows == [("a", 1.0), ("b", 2.5), ("c", 3.0), ("d", None)]


def test_sqlite_ranges_and_tables(spark):
    d = tempfile.mkdtemp()
    path = f"{d}/sample.db"
    con = sqlite3.connect(path)
    con.execute('CREATE TABLE "my table" (id INTEGER, v REAL, s TEXT)')
    con.execute("CREATE VIEW vv AS SELECT 1")
    con.executemany('INSERT INTO "my table" VALUES (?, ?, ?)', [(i, i / 4, f"r{i}") for i in range(101)])
    con.commit()
    con.close()
    df = sqlite.read_sqlite(spark, path, "my table", partitions=4)
    assert df.rdd.getNumPartitions() == 4
    assert df.count() == 101 and df.agg({"v": "sum"}).first()[0] == sum(i / 4 for i in range(101))
    assert [r[0] for r in sqlite.list_tables(spark, path).collect()] == ["my table"]


def test_csv_json_roundtrip(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    d = tempfile.mkdtemp()
    files.write_csv(ev, f"{d}/csv")
    back = files.read_csv(spark, f"{d}/csv")
    assert back.count() == ev.count() and set(back.columns) == set(ev.columns)
    with open(f"{d}/arr.json", "w") as f:
        f.write('[{"a": 1, "b": {"c": "x"}}, {"a": 2, "b": {"c": null}}]')
    j = files.read_json(spark, f"{d}/arr.json")
    assert j.count() == 2 and "b" in j.columns


def test_jdbc_derby_in_memory(spark, sf):
    url = "jdbc:derby:memory:fwtest;create=true"
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    jdbc.write_jdbc(ev, url, "EVENTS", "replace")
    jdbc.write_jdbc(ev.limit(5), url, "EVENTS", "append")
    n = jdbc.read_jdbc(spark, "jdbc:derby:memory:fwtest", sql="SELECT count(*) AS n FROM EVENTS").first()[0]
    assert n == ev.count() + 5


def test_datetime_threshold(spark):
    rows = [("2024-01-0%d 10:00:00" % (i % 9 + 1) if i % 5 else "n/a", "2024-01-01" if i % 5 >= 3 else "x")
            for i in range(20)]
    df = spark.createDataFrame(rows, "a string, b string")
    out = schema.convert_datetimes(df)
    assert dict(out.dtypes) == {"a": "timestamp_ntz", "b": "string"}
    kinds = {r["column"]: r["kind"] for r in schema.column_types(df).collect()}
    assert kinds == {"a": "datetime", "b": "categorical"}
    empty = spark.createDataFrame([], "s string")
    assert schema.column_types(empty).first()["kind"] == "categorical"
