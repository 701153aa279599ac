"""File sources: text, tables, office documents and archives, read as binary files and parsed in tasks."""

from __future__ import annotations

import hashlib
import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from functools import partial
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "path string, segment_index int, segment_type string, content string, error string"
#: The kinds of file that are parsed.
KINDS = (".txt", ".md", ".csv", ".docx")
ALLOWED_MEMBERS = (".txt", ".md", ".csv", ".docx", ".pdf", ".html", ".json")
_OFFICE = "http://schemas.openxmlformats.org"
_W = f"{{{_OFFICE}/wordprocessingml/2006/main}}"
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
#: Fixed value: a page of fewer characters is taken for a picture.
SCAN_UNDER = 50
#: The texts of the pages of a file.
Pages = Callable[[bytes], list[str]]


def decode(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _paragraphs(text: str) -> list[tuple[str, str]]:
    return [("text", p.strip()) for p in text.split("\n\n") if p.strip()]


def _table_text(text: str) -> list[tuple[str, str]]:
    rows = pd.read_csv(io.StringIO(text), dtype=str, keep_default_na=False)
    return [("table", " | ".join(f"{h}: {v}" for h, v in zip(rows.columns, r, strict=True))) for r in rows.itertuples(index=False)]


def _office_text(data: bytes) -> list[tuple[str, str]]:
    """Paragraphs, then tables, of a word-processing document."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out = [("text", said(p)) for p in body.findall(f"{_W}p") if said(p)]
    for table in body.iter(f"{_W}tbl"):
        rows = [[said(c) for c in r.findall(f"{_W}tc")] for r in table.findall(f"{_W}tr")]
        if kept := [" | ".join(r) for r in rows if any(r)]:
            out.append(("table", "\n".join(kept)))
    return out


def _parse(pages: Pages | None, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        rows = []
        for path, data in zip(part["path"], part["content"], strict=True):
            low, data = path.lower(), bytes(data)
            try:
                if low.endswith(".docx"):
                    found = _office_text(data)
                elif low.endswith(".csv"):
                    found = _table_text(decode(data))
                elif low.endswith((".txt", ".md")):
                    found = _paragraphs(decode(data))
                elif low.endswith(".pdf") and pages is not None:
                    found = [("page" if len(t.strip()) >= SCAN_UNDER else "scan", t) for t in pages(data)]
                else:
                    raise ValueError("unsupported file type")
                rows += [(path, i, k, c, None) for i, (k, c) in enumerate(found)]
            except Exception as e:  # a broken file is a row, not a failed job
                rows.append((path, 0, "error", None, f"{type(e).__name__}: {e}"[:200]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENT.split(", ")])


def parse_files(files: DataFrame, pages: Pages | None = None) -> DataFrame:
    """Segments of files (path, content): paragraphs, table rows, office text. A file that can't be parsed is an error row.

    ``pages`` gives the texts of a .pdf file's pages; a page with too little text to be more than a picture is a "scan",
    which a recognition service should read. Without it such files are error rows.
    """
    return files.select("path", "content").mapInPandas(partial(_parse, pages), SEGMENT)


def _core_properties(path: str, data: bytes) -> dict[str, str]:
    if not path.lower().endswith(".docx"):
        return {}
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("docProps/core.xml"))
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return {}
    return {e.tag.rsplit("}", 1)[-1]: e.text.strip() for e in root.iter() if e.text and e.text.strip()}


def file_properties(files: DataFrame) -> DataFrame:
    """(path, filename, extension, size, sha256, title, creator, created, modified) of files (path, content); what a word
    processor's file says of itself, nulls for others and for broken ones."""
    names = ["title", "creator", "created", "modified"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [_core_properties(p, bytes(d)) for p, d in zip(part["path"], part["content"], strict=True)]
            head = {"path": part["path"], "size": [len(d) for d in part["content"]], "sha256": [hashlib.sha256(bytes(d)).hexdigest() for d in part["content"]]}
            yield pd.DataFrame(head | {n: [f.get(n) for f in found] for n in names}, dtype=object)

    raw = files.select("path", "content").mapInPandas(run, "path string, size long, sha256 string, title string, creator string, created string, modified string")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return raw.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, "([.][^.]*)$", 1)).alias("extension"), "size", "sha256", *names)


def office_file(lines: list[str]) -> bytes:
    """A word-processing file with a paragraph for each line."""
    said = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(_NOT_XML.sub("", x))}</w:t></w:r></w:p>' for x in lines)
    kinds = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'
    link = f'<Relationship Id="r1" Type="{_OFFICE}/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/>'
    head, out = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_OFFICE}/package/2006/content-types">{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_OFFICE}/package/2006/relationships">{link}</Relationships>')
        z.writestr("word/document.xml", f'{head}<w:document xmlns:w="{_W[1:-1]}"><w:body>{said}</w:body></w:document>')
    return out.getvalue()


def office_files(texts: DataFrame, text: str, into: str = "content") -> DataFrame:
    """texts with a word-processing file of each text, a paragraph a line; a null text is an empty file."""

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda t: office_file(t.split("\n") if isinstance(t, str) else []))

    return texts.withColumn(into, run(F.col(text)))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below path as (path, content, sha256, length)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return raw.select("path", "content", F.sha2("content", 256).alias("sha256"), "length")


def _members(data: bytes) -> Iterator[tuple[str, bytes]]:
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.infolist():
                if not m.is_dir():
                    yield m.filename, z.read(m)
    else:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            for m in t:
                if m.isfile():
                    yield m.name, t.extractfile(m).read()


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        for path, data in zip(part["path"], part["content"], strict=True):
            rows = []
            for name, content in _members(bytes(data)):
                base = name.rsplit("/", 1)[-1]
                unsafe = name.startswith("/") or ".." in name.split("/")
                if not unsafe and not base.startswith((".", "__")) and base.lower().endswith(ALLOWED_MEMBERS):
                    rows.append((path, name, content))
            yield pd.DataFrame(rows, columns=["archive", "path", "content"])


def unpack(archives: DataFrame) -> DataFrame:
    """Members of zip and tar archives (path, content): hidden, unsafe and unknown ones are left out."""
    return archives.select("path", "content").mapInPandas(_unpack, "archive string, path string, content binary")


#: The nodes of parsed plans that only read.
READING = set(
    "Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias UnresolvedSubqueryColumnAliases "
    "UnresolvedRelation UnresolvedInlineTable OneRowRelation UnresolvedWith UnresolvedHaving WithWindowDefinition Window Generate Pivot Unpivot Sample".split()
)
_CALLS_OUT = re.compile(r"\b(reflect|try_reflect|java_method)\b", re.I)


def _only_reads(spark: SparkSession, node, views: set[str]) -> None:
    """Raise unless every node of a parsed plan only reads, and reads nothing but the views named, or what the query names by WITH."""
    kind = node.getClass().getSimpleName().rstrip("$")
    if kind not in READING:
        raise ValueError(f"only queries are allowed, not {kind}")
    if kind == "UnresolvedRelation":
        parts = node.multipartIdentifier()
        if parts.size() != 1 or parts.apply(0).lower() not in views:
            raise ValueError("only temporary views of this session can be read")
        return
    inner = node.innerChildren()
    if kind == "UnresolvedWith":  # each part sees those before it, and itself if it recurs; the query sees all
        seen = set(views)
        for i in range(inner.size()):
            part = inner.apply(i)
            seen |= {part.alias().lower()}
            _only_reads(spark, part, seen)
        views = seen
    else:
        for i in range(inner.size()):
            _only_reads(spark, inner.apply(i), views)
    for more in (node.children(), node.subqueries()):
        for i in range(more.size()):
            _only_reads(spark, more.apply(i), views)


def read_only_sql(spark: SparkSession, sql: str, limit: int = 100) -> DataFrame:
    """The rows of one query over the session's temporary views.

    Every node of the parsed plan, subqueries included, must be one that only reads. A relation must be a temporary view by
    its plain name, or a part that WITH names where it is in sight: files by path and tables of catalogs are rejected.
    Functions that call foreign code are rejected too.
    """
    views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    _only_reads(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), views)
    if _CALLS_OUT.search(sql):
        raise ValueError("functions that call foreign code aren't allowed")
    return spark.sql(sql).limit(limit)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(response_id, metric, score) of annotation files: JSON objects, each response's metrics by name."""
    raw = spark.read.schema("response_id string, scores map<string,double>").option("multiLine", True).json(path)
    return raw.select("response_id", F.explode("scores").alias("metric", "score"))


def read_backup(spark: SparkSession, path: str) -> DataFrame:
    """(namespace, key, value) of backup files: a JSON object of namespaces, each an object of keys and values."""
    raw = spark.read.text(path, wholetext=True)
    spaces = F.from_json("value", "map<string,map<string,string>>")
    return raw.select(F.explode(spaces).alias("namespace", "held")).select("namespace", F.explode("held").alias("key", "value"))


def restore(current: DataFrame, backup: DataFrame) -> DataFrame:
    """current (namespace, key, value) with the backup's entries put in or over its own."""
    rows = current.select("namespace", "key", "value", F.lit(0).alias("at")).unionByName(backup.select("namespace", "key", "value", F.lit(1).alias("at")))
    return rows.groupBy("namespace", "key").agg(F.max_by("value", "at").alias("value"))
