"""Binary and database formats: DOCX packages, multipart bodies, SQLite tables.

DOCX bytes are written row by row on the executors (a stored zip of four parts, the same bytes for the same
text). A multipart body is split by its boundary. SQLite files are read by a data source of ranges of row ids.
"""

from __future__ import annotations

import io
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def docx_bytes(blocks: list[tuple[str, str]]) -> bytes:
    """A package of (kind, text) blocks; headings have the style Heading2. Characters that XML forbids are left out."""
    body = []
    for kind, text in blocks:
        style = '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>' if kind == "heading" else ""
        lines = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(_CONTROL.sub("", line))}</w:t>' for line in (text or "").split("\n"))
        body.append(f"<w:p>{style}<w:r>{lines}</w:r></w:p>")
    document = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{_WORD}"><w:body>{"".join(body)}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, part in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", document)):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), part.encode())
    return out.getvalue()


def docx(paragraphs: DataFrame, key: str, order: str = "ord", kind: str = "kind", text: str = "source_text") -> DataFrame:
    """(key, docx): one package for each document, its paragraphs in order."""
    rows = paragraphs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(kind).alias("k"), F.col(text).alias("t")))).alias("p"))
    schema = rows.select(key).schema.add("docx", "binary")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            made = [docx_bytes([(p["k"], p["t"]) for p in ps]) for ps in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def multipart(body: bytes, boundary: str) -> list[dict]:
    """Parts of a multipart body: name, filename, type and bytes; a part without headers is left out."""
    parts = []
    mark = b"--" + boundary.encode()
    for chunk in (b"\r\n" + body).split(b"\r\n" + mark)[1:]:
        if chunk.startswith(b"--"):
            break
        head, found, data = chunk.lstrip(b" \t").removeprefix(b"\r\n").partition(b"\r\n\r\n")
        if not found:
            continue
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))}
        told = dict(re.findall(r'(\w+)="([^"]*)"', headers.get("content-disposition", "")))
        parts.append({"name": told.get("name", ""), "filename": told.get("filename", ""), "type": headers.get("content-type", ""), "data": data})
    return parts


def uploads(bodies: DataFrame, keys: list[str], body: str = "body", boundary: str = "boundary", suffix: str = ".pdf", most_bytes: int = 120 << 20) -> DataFrame:
    """bodies to (keys, filename, status, size, data): files of the uploads; those too large or of another suffix have no data."""
    schema = bodies.select(*keys).schema.add("filename", "string").add("status", "string").add("size", "long").add("data", "binary")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, rows = [], []
            for i, (raw, mark) in enumerate(zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist(), strict=True)):
                for p in multipart(raw or b"", mark or ""):
                    if p["filename"]:
                        state = "too-large" if len(p["data"]) > most_bytes else "ok" if p["filename"].lower().endswith(suffix) else "wrong-type"
                        at.append(i)
                        rows.append((p["filename"], state, len(p["data"]), p["data"] if state == "ok" else None))
            idx = pa.array(at, pa.int64())
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(idx) for k in range(len(keys))], *cols], names=schema.names)

    return bodies.select(*keys, body, boundary).mapInArrow(run, schema)


class _Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _SqliteReader(DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.parts = int(options.get("partitions", "4"))
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", self.table):
            raise ValueError(f"no table name: {self.table}")

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as c:
            lo, hi = c.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        if lo is None:
            return [_Range(0, 0)]
        step = (hi - lo) // self.parts + 1
        return [_Range(a, min(a + step, hi + 1)) for a in range(lo, hi + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        with self._open() as c:
            yield from c.execute(f"SELECT {names} FROM {self.table} WHERE rowid >= ? AND rowid < ?", (partition.first, partition.last))


class Sqlite(DataSource):
    """spark.read.format("leafmill_sqlite").schema(...).option("table", ...).load(path); path is on a folder that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "leafmill_sqlite"

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(schema, self.options)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(Sqlite)
    return spark.read.format("leafmill_sqlite").schema(schema).option("table", table).option("partitions", str(partitions)).load(path)


def papers_in_order(papers: DataFrame) -> DataFrame:
    """Favourites first, then the latest changed, then the latest made."""
    return papers.orderBy(F.col("favorite").desc(), F.col("updated_at").desc(), F.col("created_at").desc())
