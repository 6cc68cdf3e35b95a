"""Workbooks read on executors, one partition a file."""

import zipfile

from loomwork.sources import workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(path, rows, shared=False):
    """A workbook of inline or shared texts, numbers in column C."""
    texts, body = [], ""
    for r, cells in enumerate(rows, 1):
        body += f'<row r="{r}">'
        for column, value in zip("AB", cells, strict=False):
            if value is None:
                continue
            if shared:
                texts.append(value)
                body += f'<c r="{column}{r}" t="s"><v>{len(texts) - 1}</v></c>'
            else:
                body += f'<c r="{column}{r}" t="inlineStr"><is><t>{value}</t></is></c>'
        body += f'<c r="C{r}"><v>{r}</v></c></row>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {NS}><sheetData/></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><r><t>{t[:2]}</t></r><r><t>{t[2:]}</t></r></si>" for t in texts) + "</sst>")


def test_many_workbooks(spark, tmp_path):
    (tmp_path / "more").mkdir()
    book(tmp_path / "a.xlsx", [("Outcome", "Phrase"), ("Name things", "names"), (None, "no outcome"), ("  ", "blank"), ("Weigh them", None)])
    book(tmp_path / "more" / "b.xlsx", [("Outcome", "Phrase"), *[(f"Outcome {i}", f"o{i}") for i in range(50)]], shared=True)
    book(tmp_path / "more" / "c.xlsx", [])
    (tmp_path / "more" / "note.txt").write_text("no workbook")
    workbooks.register(spark)
    for place in (str(tmp_path), f"file://{tmp_path}"):
        rows = spark.read.format("outcome_sheets").option("paths", place).load()
        assert rows.rdd.getNumPartitions() == 3
        found = [(r.path.rpartition("/")[2], r.row, r.outcome, r.shortphrase) for r in rows.collect()]
        assert found[:2] == [("a.xlsx", 2, "Name things", "names"), ("a.xlsx", 5, "Weigh them", None)]
        assert found[2:] == [("b.xlsx", i + 2, f"Outcome {i}", f"o{i}") for i in range(30)], "the window of 31 rows"
    two = spark.read.format("outcome_sheets").option("paths", f"{tmp_path}/a.xlsx,{tmp_path}/more/b.xlsx").option("rows", 3).load()
    assert two.count() == 3
