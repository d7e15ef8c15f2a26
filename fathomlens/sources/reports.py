"""Readers of incident reports."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READERS = {"txt": "text", "md": "text", "log": "text", "": "text", "docx": "docx", "pdf": "pdf"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(content: Column) -> Column:
    """Text of bytes: UTF-8 with a mark, UTF-16 with a mark, else UTF-8 with replacement characters."""
    head = F.hex(F.substring(content, 1, 3))
    utf8 = F.decode(F.substring(content, 4, 2147483647), "UTF-8")
    return F.when(head == "EFBBBF", utf8).when(head.startswith("FEFF") | head.startswith("FFFE"), F.decode(content, "UTF-16")).otherwise(F.decode(content, "UTF-8"))


def dispatch(files: DataFrame, path: str) -> DataFrame:
    """`files` with reader and error: by extension, whatever its case; what can't be read keeps its row, with the reason."""
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    reader = F.coalesce(*[F.when(extension == e, r) for e, r in READERS.items()])
    return files.withColumn("reader", reader).withColumn("error", F.when(reader.isNull(), F.concat(F.lit("unreadable: ."), extension)))


def docx_text(content: bytes) -> str:
    """Paragraphs, then table rows with their distinct cells, one a line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))[0]
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    lines = [text(p) for p in body.findall(f"{_W}p")]
    for row in body.iter(f"{_W}tr"):
        lines.append(" | ".join(dict.fromkeys(filter(None, (text(c) for c in row.findall(f"{_W}tc"))))))
    return "\n".join(x for x in lines if x.strip())


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of the report files under a path; unreadable files keep their row, with the reason.

    PDF text needs a library that is no part of this one; such files are reported as unreadable."""
    files = dispatch(spark.read.format("binaryFile").load(path).select("path", "content"), "path")

    @F.pandas_udf("text string, error string")
    def docx(content: pd.Series) -> pd.DataFrame:
        rows = []
        for data in content:
            try:
                rows.append((docx_text(data), None))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError):
                rows.append((None, "unreadable: broken docx"))
        return pd.DataFrame(rows, columns=["text", "error"])

    plain = files.where("reader = 'text'").select("path", decode(F.col("content")).alias("text"), "error")
    word = files.where("reader = 'docx'").select("path", docx("content").alias("r")).select("path", "r.text", "r.error")
    rest = files.where("reader is null or reader = 'pdf'").select("path", F.lit(None).cast("string").alias("text"), F.coalesce("error", F.lit("unreadable: .pdf needs a PDF library")).alias("error"))
    return plain.union(word).union(rest)
