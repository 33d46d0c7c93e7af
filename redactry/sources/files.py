"""Files as documents: text and DOCX here, PDF and images through plug-ins; redacted files out again."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactry.sources.shipping import ship

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SUFFIXES = (".txt", ".docx", ".pdf")
MEDIA = {".txt": "text/plain", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".pdf": "application/pdf"}
#: Folders of a DOCX whose files are not text: images, other documents.
EMBEDDED = ("word/media/", "word/embeddings/")
PAGES = 20
EXTRACTED = "path string, text string, file_type string, total_pages int, processing_mode string, error string"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, suffix, content) of the files right in a folder, whatever their case; the bytes stay on the executors."""
    ship(spark)
    df = spark.read.format("binaryFile").load(path)
    return df.select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), "content")


def paragraphs(body: ET.Element) -> Iterator[ET.Element]:
    return body.iter(f"{W}p")


def paragraph_text(p: ET.Element) -> str:
    return "".join(t.text or "" if t.tag == f"{W}t" else "\t" if t.tag == f"{W}tab" else "\n" for t in p.iter() if t.tag in (f"{W}t", f"{W}tab", f"{W}br"))


def docx_text(content: bytes) -> str:
    """Paragraphs of the body, then each table's rows with cells joined by " | "; headers and footers are not read."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
    if body is None:
        raise ValueError("no body")
    lines = [paragraph_text(p) for p in body.findall(f"{W}p")]
    for table in body.findall(f"{W}tbl"):
        for row in table.findall(f"{W}tr"):
            lines.append(" | ".join("\n".join(paragraph_text(p) for p in cell.findall(f"{W}p")) for cell in row.findall(f"{W}tc")))
    return "\n".join(lines)


def extract_text(files: DataFrame, pdf: Callable[[bytes], tuple[list[str], str]] | None = None) -> DataFrame:
    """(path, text, file_type, total_pages, processing_mode, error), one row per file; a bad file has an error and no text.

    Text files are decoded in the JVM, invalid bytes replaced. ``pdf`` gives the
    pages' texts and the mode; without it PDF files are an error, as are other types
    and documents above the page limit.
    """
    txt = files.where("suffix = '.txt'").select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit("txt").alias("file_type"), F.lit(1).alias("total_pages"), F.lit("direct_text_extraction").alias("processing_mode"), F.lit(None).cast("string").alias("error"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_frame in frames:
            rows = []
            for path, suffix, content in zip(pdf_frame["path"], pdf_frame["suffix"], pdf_frame["content"]):
                try:
                    if suffix == ".docx":
                        rows.append((path, docx_text(content), "docx", 1, "direct_text_extraction", None))
                    elif suffix == ".pdf" and pdf is not None:
                        pages, mode = pdf(content)
                        if mode != "direct_text_extraction" and len(pages) > PAGES:
                            raise ValueError(f"more than {PAGES} pages to recognise")
                        if not any(p.strip() for p in pages):
                            raise ValueError("no text")
                        rows.append((path, "\n".join(pages), "pdf", len(pages), mode, None))
                    else:
                        rows.append((path, None, suffix.lstrip("."), None, None, f"unsupported file type {suffix or 'none'}" if suffix != ".pdf" else "no PDF reader is plugged in"))
                except Exception as e:  # noqa: BLE001 - a broken file is a row, not a failed job
                    rows.append((path, None, suffix.lstrip("."), None, None, f"unreadable: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EXTRACTED.split(", ")]).astype({"total_pages": "Int32"})

    return txt.unionByName(files.where("suffix <> '.txt'").mapInPandas(run, EXTRACTED))


def delete_in_paragraph(p: ET.Element, spans: list[tuple[int, int]]) -> bool:
    """Take spans of the paragraph's text out of its runs, the last first; whether exactly as much is gone as should be."""
    before, gone = len(paragraph_text(p)), 0
    for start, end in sorted(spans, reverse=True):
        at = 0
        for t in [x for x in p.iter() if x.tag in (f"{W}t", f"{W}tab", f"{W}br")]:
            size = len(t.text or "") if t.tag == f"{W}t" else 1
            a, b = max(start - at, 0), min(end - at, size)
            if t.tag == f"{W}t" and a < b:
                t.text = t.text[:a] + t.text[b:]
                t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
            elif a < b:
                for parent in p.iter():
                    if t in list(parent):
                        parent.remove(t)
            at += size
        gone += end - start
    return before - len(paragraph_text(p)) == gone


def redact_docx(content: bytes, find: Callable[[str], list[tuple[int, int]]], image: Callable[[bytes], bytes] | None = None) -> bytes:
    """The document without the spans ``find`` gives for each paragraph of body, tables, headers and footers.

    ``image`` gives an image without what it shows, or raises; without it a document
    with images is refused, as nothing has read them. Raises if a span could not be
    removed as a whole, so nothing is given out half redacted.
    """
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for item in z.infolist():
            data = z.read(item.filename)
            if item.filename.startswith(EMBEDDED) and not item.is_dir():
                if image is None:
                    raise ValueError("an embedded file is unread")
                data = image(data)
            if item.filename.startswith("word/") and item.filename.endswith(".xml") and item.filename.split("/")[1].startswith(("document", "header", "footer")):
                root = ET.fromstring(data)
                for p in paragraphs(root):
                    text = paragraph_text(p)
                    if text.strip() and not delete_in_paragraph(p, find(text)):
                        raise ValueError("a span could not be located")
                data = ET.tostring(root, encoding="utf-8", xml_declaration=True)
            new.writestr(item, data)
    return out.getvalue()


def redact_files(files: DataFrame, load_finder: Callable[[], Callable[[str], list[tuple[int, int, str]]]]) -> DataFrame:
    """(path, name, media_type, status, content): text files with tags, DOCX files with the spans taken out; failures have no content.

    ``load_finder`` gives, once per task, a function from a text to spans that don't overlap.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = load_finder()
        for frame in frames:
            rows = []
            for path, suffix, content in zip(frame["path"], frame["suffix"], frame["content"]):
                name = "redacted_" + path.rsplit("/", 1)[-1]
                try:
                    if suffix == ".txt":
                        text, at, parts = content.decode("utf-8", "replace"), 0, []
                        for a, b, kind in sorted(find(text)):
                            parts += (text[at:a], f"<{kind}>")
                            at = b
                        data = ("".join(parts) + text[at:]).encode()
                    elif suffix == ".docx":
                        data = redact_docx(content, lambda t: [(a, b) for a, b, _ in find(t)])
                    else:
                        raise ValueError("unsupported")
                    rows.append((path, name, MEDIA[suffix], "redacted", data))
                except Exception:  # noqa: BLE001
                    rows.append((path, name, MEDIA.get(suffix), "redaction_failed", None))
            yield pd.DataFrame(rows, columns=["path", "name", "media_type", "status", "content"])

    return files.mapInPandas(run, "path string, name string, media_type string, status string, content binary")
