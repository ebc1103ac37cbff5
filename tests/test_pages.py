"""Readers of office files, boxes and OCR tables on rows written by hand; the data source as a batch and as a stream."""

import time

import pandas as pd
import pyarrow as pa
import pytest

from lodestone.sources import pages, readers
from lodestone.sources.readers import docx_text, pptx_text, xlsx_text, zipped

W = 'xmlns:w="http://w" xmlns:r="http://r"'
DOCX = f"<w:document {W}><w:body><w:p><w:r><w:t>Title</w:t><w:tab/><w:t>two</w:t><w:drawing><w:docPr id='1' descr=' A plan '/></w:drawing></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>"
XLSX = {
    "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="One" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>code</t></si><si><t>v</t></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row/><row><c r="A3"><v>7</v></c><c r="B3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
    "xl/worksheets/sheet2.xml": "<worksheet><sheetData/></worksheet>",
}


def test_office_files():
    assert docx_text(zipped({"word/document.xml": DOCX})) == ["[Hình: A plan]\n\nTitle two\n\n- item\n\n| x; y |  |"]
    assert xlsx_text(zipped(XLSX)) == ["## Sheet: One\n| code |  | v |\n| 7 | in |"]
    slides = {f"ppt/slides/slide{n}.xml": f"<p:sld xmlns:p='http://p'><a:p xmlns:a='http://a'><a:t>{t}</a:t></a:p></p:sld>" for n, t in ((10, "ten"), (2, "two"), (3, ""))}
    assert pptx_text(zipped(slides)) == ["## Slide 2\ntwo", "## Slide 10\nten"]
    docs = [(1, ["a & <b>", "", "  x\ty\r"]), (2, [])]
    assert docx_text(pages.as_docx(docs)) == ["a & <b>\n\nx\ty"]
    assert xlsx_text(pages.as_xlsx(docs)) == ["## Sheet: 1\n| 1 | a & <b> |\n| 2 |\n| 3 | x\ty |"]


def test_readers_by_extension(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_pages(spark, "/nowhere", ".exe")
    with pytest.raises(ValueError):
        readers.reader(".a b")
    (tmp_path / "a.docx").write_bytes(zipped({"word/document.xml": DOCX}))
    assert [r.seq for r in readers.read_pages(spark, f"file://{tmp_path}", ".DOCX").collect()] == [1]


def test_stream_of_files_reads_each_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    spark.dataSource.register(pages.PagesSource)

    def run():
        rows = spark.readStream.format("lodestone_pages").option("extension", ".docx").load(f"file://{folder}")
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.path.rsplit("/", 1)[1] for r in spark.read.schema(readers.PAGES).parquet(f"{tmp_path}/out").collect())

    (folder / "b.docx").write_bytes(zipped({"word/document.xml": DOCX}))
    (folder / "c.txt").write_bytes(b"other")
    assert run() == ["b.docx"]
    assert run() == ["b.docx"]
    time.sleep(0.05)
    (folder / "a.docx").write_bytes(zipped({"word/document.xml": DOCX}))
    assert run() == ["a.docx", "b.docx"]


def test_a_slanting_line_is_cut_by_its_box(spark):
    words = [(1, 1, 0, 0, 10, 10, "one"), (1, 2, 20, 3, 10, 10, "goes"), (1, 3, 40, 6, 10, 10, "down"), (1, 4, 60, 12, 10, 10, "far"), (1, 5, 80, 30, 10, 10, "new"), (1, 6, 70, 30, 5, 10, "left"), (2, 1, 0, 0, 10, 0, "flat"), (2, 2, 20, 0, 10, 0, "flat")]
    found = readers.boxed(spark.createDataFrame(pd.DataFrame(words, columns=["page", "n", "x", "y", "w", "h", "text"])))
    assert sorted((r.page, r.line, r.text) for r in found.collect()) == [(1, 0, "one goes down"), (1, 1, "far"), (1, 2, "left new"), (2, 0, "flat"), (2, 1, "flat")]


def test_lines_go_on_from_batch_to_batch(spark):
    words = [(1, 1, 0, 0, 10, 10, "one"), (1, 2, 20, 3, 10, 10, "goes"), (1, 3, 40, 6, 10, 10, "down"), (1, 4, 60, 12, 10, 10, "far"), (2, 1, 0, 12, 10, 10, "next"), (2, 2, 5, 12, 10, 10, "page")]
    names = ["page", "n", "x", "y", "w", "h", "text"]
    rows = pa.RecordBatch.from_pandas(pd.DataFrame(words, columns=names))
    for size in (1, 2, 6):
        found = [r for b in readers.lined(rows.slice(i, size) for i in range(0, len(words), size)) for r in b.to_pylist()]
        assert [(r["page"], r["line"], r["text"]) for r in found] == [(1, 0, "one goes down"), (1, 1, "far"), (2, 0, "next page")]
    plan = readers.boxed(spark.createDataFrame(pd.DataFrame(words, columns=names)))._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan  # a page each was a call of its own
