from mosaiq.sources import tables
from tests import test_formats as made


def _files(spark, *bodies):
    return spark.createDataFrame([(str(i), bytearray(b)) for i, b in enumerate(bodies)], "path string, content binary")


def test_containers_and_trees(spark):
    z = made.zipped({"a.xml": "<r x='1'><b>t</b><b/></r>", "n/b": "12"})
    got = tables.zip_members(_files(spark, z, b"bad")).collect()
    assert {(r["path"], r["name"], r["size"]) for r in got if not r["error"]} == {("0", "a.xml", 25), ("0", "n/b", 2)}
    assert [r["error"] for r in got if r["path"] == "1"] == ["Not a ZIP file"]
    nodes = tables.xml_nodes(_files(spark, b"<r x='1'><b>t</b><b/></r>")).collect()
    assert [(r["id"], r["parent"], r["ord"], r["depth"], r["tag"], r["text"]) for r in nodes] == [(0, None, 0, 0, "r", ""), (1, 0, 0, 1, "b", "t"), (2, 0, 1, 1, "b", "")]
    assert nodes[0]["attrs"] == {"x": "1"}
    assert {r["name"] for r in tables.ole2_streams(_files(spark, made.ole2({"One": b"x" * 5000}))).collect()} == {"One"}


def test_contents(spark):
    assert [r["fields"] for r in tables.csv_rows(_files(spark, b'a,"b, c"\n1\n')).collect()] == [["a", "b, c"], ["1"]]
    cells = tables.sheet_cells(_files(spark, made.xlsx_file())).collect()
    assert [(r["row"], r["col"], r["display"]) for r in cells if r["display"]] == [(0, 0, "rich"), (0, 1, "$2.50"), (2, 0, "TRUE"), (2, 1, "in")]
    assert [tuple(r)[2:6] for r in tables.sheet_merges(_files(spark, made.xlsx_file())).collect()] == [(4, 0, 5, 1)]
    mp4 = tables.mp4_samples(_files(spark, made.mp4_file())).collect()
    assert [(r["sample"], r["size"], r["is_sync"]) for r in mp4[:3]] == [(1, 5, True), (2, 6, True), (3, 7, False)] and len(mp4) == 20
    kinds = {r["number"]: r["kind"] for r in tables.pdf_objects(_files(spark, made.make_pdf(b"q Q"))).collect()}
    assert kinds == {0: "free", 1: "dict", 2: "dict", 3: "dict", 4: "stream"}
    docx = made.zipped({"word/document.xml": "<w:d xmlns:w='w'><w:body><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>hi</w:t></w:r></w:p></w:body></w:d>"})
    assert [tuple(r)[1:5] for r in tables.text_runs(_files(spark, docx)).collect()] == [(0, 0, "hi", 11.0)]
