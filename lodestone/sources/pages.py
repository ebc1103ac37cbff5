"""Pages of office and text files as a data source, in batches and as a stream, and files written from a stored table.

`spark.read.format("lodestone_pages").option("extension", ".docx").load(path)` reads files in groups of some size; as a stream its
offset is the time and path of the last file that was taken, so files that arrive later are read once each. Paths are those that
pyarrow opens; readers.read_pages reads others through Spark.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lodestone.registry import query
from lodestone.sources.readers import PAGES, docx_text, pptx_text, text_pieces_of, xlsx_text, zipped
from lodestone.sources.sinks import folder
from lodestone.views import table

GROUP = 20  # documents of one file
TOGETHER = 8 << 20  # bytes of files that one task reads
LEAST = 64  # tasks, where there are as many files
PIECE = 4096  # bytes of a text piece in the query
PARSERS: dict[str, Callable[[bytes], list[str]]] = {".docx": docx_text, ".xlsx": xlsx_text, ".pptx": pptx_text}


def store_of(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


@dataclass
class Group(InputPartition):
    paths: list[str]


class Files:
    """What both readers share: the files under a path with the extension, and their pages."""

    def __init__(self, options: dict):
        self.extension, self.path = options.get("extension", ".docx").lower(), options["path"]
        if self.extension not in PARSERS:
            raise ValueError(f"no reader for {self.extension}")

    def listed(self) -> list[tuple[int, str, int]]:
        """Time, path and size of each file, in that order."""
        from pyarrow import fs

        store, at = store_of(self.path)
        found = store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        return sorted((f.mtime_ns or 0, f.path, f.size or 0) for f in found if f.is_file and f.path.lower().endswith(self.extension))

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                pages = PARSERS[self.extension](f.read())
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(pages), pa.string()), pa.array(range(1, len(pages) + 1), pa.int32()), pa.array(pages, pa.string())], names=["path", "seq", "text"])


def groups(files: list[tuple[int, str, int]]) -> list[Group]:
    """Files in partitions of TOGETHER bytes at most, but of no more than a LEAST-th of all; a larger file is one of its own."""
    most = min(TOGETHER, sum(size for *_, size in files) // LEAST)
    out, held = [], 0
    for _, path, size in files:
        if not out or held + size > most:
            out.append(Group([]))
            held = 0
        out[-1].paths.append(path)
        held += size
    return out


class BatchReader(Files, DataSourceReader):
    def partitions(self) -> list[Group]:
        return groups(self.listed())


class StreamReader(Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        time, path, _ = (self.listed() or [(-1, "", 0)])[-1]
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        low, high = ((x["time"], x["path"]) for x in (start, end))
        return groups([f for f in self.listed() if low < f[:2] <= high])


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestone_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def pages(spark: SparkSession, path: str, extension: str) -> DataFrame:
    spark.dataSource.register(PagesSource)
    return spark.read.format("lodestone_pages").option("extension", extension).load(path)


#: What XML can't hold.
UNFIT = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]"


def xml(text: str) -> str:
    return escape(text, {"\r": "&#13;"})


def as_docx(docs: list[tuple[int, list[str]]]) -> bytes:
    """A paragraph for every line."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{xml(line)}</w:t></w:r></w:p>' for _, lines in docs for line in lines)
    return zipped({"word/document.xml": f'<w:document xmlns:w="http://w"><w:body>{body}</w:body></w:document>'})


def as_xlsx(docs: list[tuple[int, list[str]]]) -> bytes:
    """A sheet for every document: the lines' numbers and the lines."""
    parts = {
        "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets>' + "".join(f'<sheet name="{i}" r:id="r{n}"/>' for n, (i, _) in enumerate(docs)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{n}" Target="worksheets/sheet{n}.xml"/>' for n in range(len(docs))) + "</Relationships>",
    }
    for n, (_, lines) in enumerate(docs):
        rows = "".join(f'<row><c r="A{k}"><v>{k}</v></c><c r="B{k}" t="inlineStr"><is><t xml:space="preserve">{xml(line)}</t></is></c></row>' for k, line in enumerate(lines, 1))
        parts[f"xl/worksheets/sheet{n}.xml"] = f"<worksheet><sheetData>{rows}</sheetData></worksheet>"
    return zipped(parts)


def as_pptx(docs: list[tuple[int, list[str]]]) -> bytes:
    """A slide for every document."""
    slide = lambda lines: "".join(f"<a:p><a:r><a:t>{xml(line)}</a:t></a:r></a:p>" for line in lines)
    return zipped({f"ppt/slides/slide{n}.xml": f'<p:sld xmlns:p="http://p" xmlns:a="http://a">{slide(lines)}</p:sld>' for n, (_, lines) in enumerate(docs, 1)})


def as_text(docs: list[tuple[int, list[str]]]) -> bytes:
    return "".join(f"{line}\n" for _, lines in docs for line in lines).encode()


WRITERS = {".docx": as_docx, ".xlsx": as_xlsx, ".pptx": as_pptx, ".txt": as_text}


def write_files(docs: DataFrame, path: str, extension: str) -> str:
    """Writes documents (doc_id, text) as files of GROUP documents each, named by the group; tasks write them under another name first."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), UNFIT, ""), "\n")
    grouped = docs.groupBy(F.expr(f"doc_id div {GROUP}").alias("g")).agg(F.array_sort(F.collect_list(F.struct("doc_id", lines.alias("lines")))).alias("docs"))
    make = WRITERS[extension]

    def run(batches):
        for batch in batches:
            store, at = store_of(path)
            store.create_dir(at, recursive=True)
            for g, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(own := f"{at}/.{uuid.uuid4().hex}") as out:
                    out.write(make([(d["doc_id"], d["lines"]) for d in found]))
                store.move(own, f"{at}/{g:09d}{extension}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["g"])

    grouped.mapInArrow(run, "g long").write.format("noop").mode("overwrite").save()
    return path


def written(spark: SparkSession, sf: str, extension: str) -> str:
    """The stored documents as files of a format, in the shared folder."""
    return write_files(table(spark, sf, "documents").select("doc_id", "text"), folder(spark, "files"), extension)


def numbered(df: DataFrame) -> DataFrame:
    return df.select(F.regexp_extract("path", "(\\d+)\\.\\w+$", 1).cast("long").alias("file"), "seq", "text")


_BLANK = "[\\s\\p{Z}\\x85]+"
_LINES = f", l AS (SELECT doc_id, doc_id // {GROUP} AS file, generate_subscripts(s, 1) AS n, unnest(s) AS raw FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{fffe}}\\x{{ffff}}]', '', 'g'), chr(10)) AS s FROM documents)), t AS (SELECT *, regexp_replace(raw, '^{_BLANK}|{_BLANK}$', '', 'g') AS line FROM l)"


@query(_LINES + " SELECT file, 1 AS seq, coalesce(string_agg(line, chr(10) || chr(10) ORDER BY doc_id, n) FILTER (line <> ''), '') AS text FROM t GROUP BY 1")
def docx_scan(spark, sf):
    """The stored documents, written as word files and read again."""
    return numbered(pages(spark, written(spark, sf, ".docx"), ".docx"))


@query(_LINES + " SELECT file, row_number() OVER (PARTITION BY file ORDER BY doc_id) AS seq, text FROM (SELECT file, doc_id, '## Sheet: ' || doc_id || chr(10) || string_agg(CASE WHEN line = '' THEN '| ' || n || ' |' ELSE '| ' || n || ' | ' || line || ' |' END, chr(10) ORDER BY n) AS text FROM t GROUP BY file, doc_id)")
def xlsx_scan(spark, sf):
    """The same as work books, a sheet for every document."""
    return numbered(pages(spark, written(spark, sf, ".xlsx"), ".xlsx"))


@query(_LINES + """, g AS (SELECT file, doc_id, string_agg(line, chr(10) ORDER BY n) FILTER (line <> '') AS text FROM t GROUP BY file, doc_id), s AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY doc_id) AS slide FROM g)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY slide) AS seq, '## Slide ' || slide || chr(10) || text AS text FROM s WHERE text IS NOT NULL""")
def pptx_scan(spark, sf):
    """The same as slides, one for every document; those without a word are left out."""
    return numbered(pages(spark, written(spark, sf, ".pptx"), ".pptx"))


@query(_LINES + f""", e AS (SELECT file, doc_id, n, raw, (sum(strlen(raw) + 1) OVER (PARTITION BY file ORDER BY doc_id, n) - 1) // {PIECE} AS piece FROM l)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY piece) AS seq, string_agg(raw, chr(10) ORDER BY doc_id, n) || chr(10) AS text FROM e GROUP BY file, piece""")
def text_pieces(spark, sf):
    """The same as text files, in pieces of some bytes."""
    return numbered(text_pieces_of(spark, written(spark, sf, ".txt"), PIECE))


@query(f", e AS (SELECT unnest(['.TXT', '.md', '.docx', '.Xlsx', '.exe']) AS e) SELECT doc_id // {GROUP} AS file, e AS ext, lower(e) IN ('.txt', '.md', '.docx', '.xlsx') AS known FROM documents, e GROUP BY ALL")
def reader_registry(spark, sf):
    """Whether there is a reader for each of the forms in which the files of a stored table are asked for."""
    from lodestone.sources.readers import READERS

    files = table(spark, sf, "documents").select(F.expr(f"doc_id div {GROUP}").alias("file")).distinct()
    asked = files.select("file", F.explode(F.array(*[F.lit(x) for x in (".TXT", ".md", ".docx", ".Xlsx", ".exe")])).alias("ext"))
    return asked.select("file", "ext", F.lower("ext").isin(*READERS).alias("known"))
