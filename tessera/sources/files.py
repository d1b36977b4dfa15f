"""File trees as tables: scan, decoding, extraction from binary formats, ignore patterns."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tessera.schema import FILE


def scan(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """(path, content, length) of every regular file below root, names with leading dots and underscores too.

    The names are listed on the driver; the bytes are read by the tasks, so root has to be visible to all of them.
    """
    names = sorted(os.path.relpath(os.path.join(d, f), root).replace(os.sep, "/") for d, _, fs in os.walk(root) for f in fs if os.path.isfile(os.path.join(d, f)))
    listed = spark.createDataFrame([(n,) for n in names], "path string")
    spread = listed.repartition(partitions or max(1, min(len(names), spark.sparkContext.defaultParallelism)))

    def contents(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                with open(os.path.join(root, path), "rb") as f:
                    data = f.read()
                yield pd.DataFrame({"path": [path], "content": [data], "length": [len(data)]})

    return spread.mapInPandas(contents, FILE)


def scan_store(spark: SparkSession, root: str) -> DataFrame:
    """As scan(), for a store that Spark reads itself; its listing leaves out names that begin with a dot or underscore."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return read.select(F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "").alias("path"), "content", "length")


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(regular expression, negated) for each pattern of an ignore file, in order. # ends a line anywhere."""
    found = []
    for line in text.splitlines():
        pattern = line.partition("#")[0].strip()
        if pattern:
            found.append((_glob(pattern.removeprefix("!")), pattern.startswith("!")))
    return found


def _glob(pattern: str) -> str:
    """Regular expression of a gitignore pattern for whole relative paths."""
    only_dirs, pattern = pattern.endswith("/"), pattern.rstrip("/")
    anchored, parts = "/" in pattern, pattern.strip("/").split("/")
    out = "^" if anchored else "^(?:.*/)?"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
            continue
        at = 0
        while at < len(part):
            ch = part[at]
            close = part.find("]", at + 2) if ch == "[" else -1
            if ch == "*":
                out += "[^/]*"
            elif ch == "?":
                out += "[^/]"
            elif close > 0:
                body = part[at + 1 : close]
                out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
                at = close
            else:
                out += re.escape(ch)
            at += 1
        out += "" if last else "/"
    return out + ("/.*$" if only_dirs else "(?:/.*)?$")


def ignored(path: Column | str, rules: list[tuple[str, bool]]) -> Column:
    """The last rule that matches decides."""
    column, out = F.col(path) if isinstance(path, str) else path, F.lit(False)
    for pattern, negated in rules:
        out = F.when(column.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


@pandas_udf(T.StringType())
def lenient(content: pd.Series) -> pd.Series:
    """UTF-8 text without its undecodable bytes."""
    return content.map(lambda b: bytes(b).decode("utf-8", "ignore"), na_action="ignore")


def strict_text(content: Column | str) -> Column:
    """UTF-8 text with universal newlines, or null."""
    valid = F.try_validate_utf8((F.col(content) if isinstance(content, str) else content).cast("string"))
    return F.regexp_replace(valid, "\r\n?", "\n")


class _Text(HTMLParser):
    SILENT, BREAKS = {"script", "style", "head", "template", "noscript"}, {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol"}

    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs) -> None:
        self.silent += tag in self.SILENT
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag) -> None:
        self.silent -= tag in self.SILENT and self.silent > 0
        if tag in self.BREAKS:
            self.parts.append("\n")

    def handle_data(self, data) -> None:
        if not self.silent:
            self.parts.append(data)


def html_text(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.parts).split("\n"))
    return "\n".join(line for line in lines if line)


def _xml_texts(data: bytes, member: str, paragraph: str, run: str) -> list[str]:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read(member))
    return ["".join(t.text or "" for t in p.iter(run)) for p in root.iter(paragraph)]


_W, _A = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _docx(data: bytes) -> str:
    return "\n".join(_xml_texts(data, "word/document.xml", f"{_W}p", f"{_W}t"))


def _pptx(data: bytes) -> str:
    slides = sorted((n for n in zipfile.ZipFile(io.BytesIO(data)).namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    return "\n".join(t for s in slides for t in _xml_texts(data, s, f"{_A}p", f"{_A}t"))


def _epub(data: bytes) -> str:
    book = zipfile.ZipFile(io.BytesIO(data))
    return "\n".join(html_text(book.read(n).decode("utf-8", "ignore")) for n in sorted(book.namelist()) if n.endswith((".xhtml", ".html", ".htm")))


def _rtf(data: bytes) -> str:
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "ignore"), data.decode("latin-1"))
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n", text)
    return re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", text).strip()


def _csv(data: bytes) -> str:
    return pd.read_csv(io.BytesIO(data), encoding="latin-1").to_string(index=False)


def _excel(data: bytes) -> str:
    return pd.read_excel(io.BytesIO(data)).to_string(index=False)  # needs a reader for the format


def _pdf(data: bytes) -> str:
    import fitz  # optional

    return "\n".join(page.get_text() for page in fitz.open(stream=io.BytesIO(data), filetype="pdf"))


def _image(data: bytes) -> str:
    import pytesseract  # optional
    from PIL import Image

    return pytesseract.image_to_string(Image.open(io.BytesIO(data)), lang="rus+eng")


#: Extractor of each suffix; a caller may add or replace some. Those of pdf, images and Excel need optional packages.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {
    ".pdf": _pdf, ".docx": _docx, ".pptx": _pptx, ".html": lambda b: html_text(b.decode("utf-8", "ignore")), ".epub": _epub, ".rtf": _rtf,
    ".csv": _csv, ".xls": _excel, ".xlsx": _excel, **dict.fromkeys((".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp", ".bmp"), _image),
}


def extracted(extractors: dict[str, Callable[[bytes], str]] | None = None):
    """Column function (suffix, content) -> struct(text, error) for bytes that are not UTF-8 text."""
    table = extractors or EXTRACTORS

    # pickled, as its batches are of 100 rows, and Arrow's of 10,000 whole files
    def extract(suffix: str | None, data: bytes | None) -> tuple[str | None, str | None]:
        if data is None or suffix not in table:
            return None, None if data is None else f"no extractor for {suffix or 'no suffix'}"
        try:
            return table[suffix](bytes(data)), None
        except Exception as e:  # noqa: BLE001  one file's failure is a row, not the job's
            return None, f"{type(e).__name__}: {e}"[:300]

    return F.udf(extract, "struct<text:string,error:string>", useArrow=False)
