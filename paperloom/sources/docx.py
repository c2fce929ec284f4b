"""Word packages as DataFrames: parts, relationships, media, paragraphs and HTML."""

from __future__ import annotations

import io
import re
import tempfile
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from html import escape
from itertools import groupby
from typing import IO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.functions.omml import omml_to_latex
from paperloom.functions.text import basename, stem, strip, suffix
from paperloom.session import spread

DOCX_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
DOCUMENT, RELS = "word/document.xml", "word/_rels/document.xml.rels"


def read_packages(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(file_id, path, length, content) of the .docx files below ``path``; with ``max_bytes``, of those with fewer bytes.

    file_id is a hash of the path, so it is the same whenever the files are read. Whole files are rows here;
    ``packages.read_part_files`` reads single parts of files of any size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    files = files if max_bytes is None else files.where(F.col("length") < max_bytes)
    return files.select(F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 32).alias("file_id"), "path", "length", "content")


def accepted(name: Column, mime: Column | None = None) -> Column:
    """Names that end in .docx, or (with ``mime``) files of Word's media type."""
    return F.endswith(name, F.lit(".docx")) | ((mime == DOCX_MIME) if mime is not None else F.lit(False))


def stored_id(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def locate(files: DataFrame, file_id: str) -> DataFrame:
    """The first path, in order, among the stored files of an id."""
    name = basename(F.col("path"))
    return files.where(F.startswith(name, F.lit(f"{file_id}_")) & F.endswith(name, F.lit(".docx"))).agg(F.min("path").alias("path"))


def read_parts(packages: DataFrame, prefixes: tuple[str, ...] = ("word/",)) -> DataFrame:
    """(file_id, part_name, bytes, error): the packages' entries below ``prefixes``; a package that can't be read is a row with an error."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file_id, content in zip(pdf.file_id, pdf.content, strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(file_id, n, z.read(n), None) for n in z.namelist() if n.startswith(prefixes) and not n.endswith("/")]
                except (zipfile.BadZipFile, ValueError, OSError, TypeError, RuntimeError) as e:
                    rows = [(file_id, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pd.DataFrame(rows, columns=["file_id", "part_name", "bytes", "error"])

    return packages.select("file_id", "content").mapInPandas(explode, "file_id string, part_name string, bytes binary, error string")


def relationships(parts: DataFrame) -> DataFrame:
    """(file_id, rel_id, rel_type, rel_type_raw, target); rel_type is the last segment of the type."""
    xml = parts.where(F.col("part_name") == RELS).select("file_id", F.decode("bytes", "UTF-8").alias("xml"))
    one = xml.select("file_id", F.explode(F.regexp_extract_all("xml", F.lit(r"<Relationship\s[^>]*>"), 0)).alias("r"))
    value = lambda name: F.regexp_extract("r", rf"""\s{name}\s*=\s*["']([^"']*)["']""", 1)
    return one.select("file_id", value("Id").alias("rel_id"), F.element_at(F.split(value("Type"), "/"), -1).alias("rel_type"), value("Type").alias("rel_type_raw"), F.replace(F.replace(value("Target"), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")).alias("target"))


def media(parts: DataFrame) -> DataFrame:
    """(file_id, original_filename, filename, kind, bytes): images as they are, named after their file; OLE objects as .png to be made."""
    name = basename(F.col("part_name"))
    image = F.startswith("part_name", F.lit("word/media/"))
    ole = F.startswith("part_name", F.lit("word/embeddings/")) & (suffix(F.col("part_name")) == ".bin")
    return parts.where(image | ole).select("file_id", name.alias("original_filename"), F.concat("file_id", F.lit("_"), F.when(image, name).otherwise(F.concat(stem(name), F.lit(".png")))).alias("filename"), F.when(image, "media").otherwise("ole").alias("kind"), "bytes")


def encodings(parts: DataFrame) -> DataFrame:
    """(file_id, has_omml, has_vml_shapes)."""
    xml = F.decode("bytes", "UTF-8")
    return parts.where(F.col("part_name") == DOCUMENT).select("file_id", F.contains(xml, F.lit("oMath")).alias("has_omml"), F.regexp_like(xml, F.lit(r"<v:shape[\s>]")).alias("has_vml_shapes"))


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def attribute(e: ET.Element, *names: str) -> str | None:
    """The first of the attributes (by local name) that is set."""
    for name in names:
        for k, v in e.attrib.items():
            if local(k) == name and v:
                return v
    return None


def find(e: ET.Element, name: str) -> ET.Element | None:
    return next((x for x in e.iter() if local(x.tag) == name), None)


def _image(kind: str, rel_ids: list[str | None]) -> list[dict]:
    ids = [x for x in rel_ids if x]
    return [{"type": "image", "text": None, "kind": kind, "rel_ids": ids}] if ids else []


def items(e: ET.Element) -> list[dict]:
    """Typed items of an element, in order; images name the relationships to try."""
    tag = local(e.tag)
    if tag in ("oMath", "oMathPara"):
        return [{"type": "latex" if tag == "oMath" else "latex_block", "text": omml_to_latex(ET.tostring(e, encoding="unicode")), "kind": None, "rel_ids": []}]
    if tag in ("t", "tab", "br"):
        text = {"tab": "\t", "br": "\n"}.get(tag, e.text or "")
        return [{"type": "text", "text": text, "kind": None, "rel_ids": []}] if text else []
    if tag == "drawing":
        blip = find(e, "blip")
        return _image("drawing", [attribute(blip, "embed")] if blip is not None else [])
    if tag == "pict":
        data = find(e, "imagedata")
        return _image("vml", [attribute(data, "id")] if data is not None else [])
    if tag == "shape":
        data = find(e, "imagedata")
        return _image("vml", [attribute(e, "relid"), attribute(data, "id", "relid") if data is not None else None])
    if tag == "object":
        ole, data = find(e, "OLEObject"), find(e, "imagedata")
        return _image("ole", [attribute(ole, "id") if ole is not None else None, attribute(data, "id", "relid") if data is not None else None])
    return [x for child in e for x in items(child)]


def style(p: ET.Element) -> dict:
    props = next((x for x in p if local(x.tag) == "pPr"), None)
    of = lambda name: next((attribute(x, "val") for x in (props if props is not None else []) if local(x.tag) == name), None)
    style_id = of("pStyle")
    found = re.fullmatch(r"(?:Heading|标题)(.*)", style_id or "", re.DOTALL)
    level = found[1].strip() if found else ""
    return {"style_id": style_id, "is_heading": found is not None, "heading_level": int(level) if re.fullmatch(r"\d{1,9}", level) else 0, "alignment": of("jc") or "left", "indent": 0}


def _paragraphs(xml: bytes, tables: bool) -> list[ET.Element]:
    root = ET.fromstring(xml)
    body = find(root, "body")
    if body is None or tables:
        return [x for x in root.iter() if local(x.tag) == "p"]
    return [x for x in body if local(x.tag) == "p"]


class _Checked:
    """A target that keeps nothing: whether there is a body."""

    body = False

    def start(self, tag: str, attributes: dict) -> None:
        self.body = self.body or local(tag) == "body"

    def close(self) -> bool:
        return self.body


def _streamed_paragraphs(xml: bytes) -> Iterator[ET.Element]:
    return _read_paragraphs(lambda: io.BytesIO(xml))


def _read_paragraphs(opened: Callable[[], IO[bytes]]) -> Iterator[ET.Element]:
    """``_paragraphs`` without tables, one by one; what was passed is let go. A document is checked to its end first."""
    check = ET.XMLParser(target=_Checked())
    with opened() as f:
        while data := f.read(1 << 16):
            check.feed(data)
    if not check.close():
        with opened() as f:
            yield from _paragraphs(f.read(), False)
        return
    body, depth = None, 0
    with opened() as f:
        for event, e in ET.iterparse(f, ("start", "end")):
            if event == "start":
                if body is not None:
                    depth += 1
                elif local(e.tag) == "body":
                    body = e
            elif e is body:
                return
            elif body is not None:
                depth -= 1
                if not depth:
                    if local(e.tag) == "p":
                        yield e
                    body.clear()


#: Paragraphs that are handed on together.
BATCH_PARAGRAPHS = 1000


RAW = f"file_id string, pos int, style {schemas.STYLE}, items array<struct<type: string, text: string, kind: string, rel_ids: array<string>>>, error string"


def _raw_rows(file_id: str | None, found: Callable[[], Iterable[ET.Element]]) -> Iterator[pd.DataFrame]:
    """The rows of ``raw_paragraphs`` for a document's paragraphs, by BATCH_PARAGRAPHS."""
    names = ["file_id", "pos", "style", "items", "error"]
    rows = []
    try:
        for pos, p in enumerate(found()):
            if held := [x for c in p for x in items(c)]:
                rows.append((file_id, pos, style(p), held, None))
            if len(rows) >= BATCH_PARAGRAPHS:
                yield pd.DataFrame(rows, columns=names)
                rows = []
    except ET.ParseError as e:
        rows = [(file_id, -1, None, None, f"ParseError: {e}")]
    if rows:
        yield pd.DataFrame(rows, columns=names)


def raw_paragraphs(parts: DataFrame, include_tables: bool = False) -> DataFrame:
    """(file_id, pos, style, items, error): the body's paragraphs with content; images aren't looked up yet."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file_id, data in zip(pdf.file_id, pdf.bytes, strict=True):
                yield from _raw_rows(file_id, lambda data=data: _paragraphs(data, True) if include_tables else _streamed_paragraphs(data))

    return parts.where(F.col("part_name") == DOCUMENT).select("file_id", "bytes").mapInPandas(read, RAW)


#: What reading a damaged package may raise.
DAMAGED = (zipfile.BadZipFile, zlib.error, ValueError, OSError, TypeError, RuntimeError, EOFError)


def _piece_files(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, IO[bytes]]]:
    """The packages whose pieces follow one another, each as a file in the task's own temporary folder."""
    rows = (row for pdf in batches for row in zip(pdf.file_id, pdf.bytes, strict=True))
    for file_id, own in groupby(rows, key=lambda row: row[0]):
        with tempfile.TemporaryFile() as f:
            for _, data in own:
                f.write(data)
            yield file_id, f


def raw_piece_paragraphs(pieces: DataFrame) -> DataFrame:
    """``raw_paragraphs`` of dealt pieces (file_id, bytes); a package that can't be read is a row with an error too."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file_id, f in _piece_files(batches):
            try:
                with zipfile.ZipFile(f) as z:
                    if DOCUMENT in z.namelist():
                        yield from _raw_rows(file_id, lambda z=z: _read_paragraphs(lambda: z.open(DOCUMENT)))
            except DAMAGED as e:
                yield pd.DataFrame([(file_id, -1, None, None, f"{type(e).__name__}: {e}")], columns=["file_id", "pos", "style", "items", "error"])

    return pieces.mapInPandas(read, RAW)


def _piece_names(pieces: DataFrame) -> DataFrame:
    """``read_parts`` of dealt pieces as far as names need them: only relationships have their bytes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for file_id, f in _piece_files(batches):
            try:
                with zipfile.ZipFile(f) as z:
                    rows = [(file_id, n, z.read(n) if n == RELS else None) for n in z.namelist() if n.startswith("word/") and not n.endswith("/")]
            except DAMAGED:
                continue
            if rows:
                yield pd.DataFrame(rows, columns=["file_id", "part_name", "bytes"])

    return pieces.mapInPandas(read, "file_id string, part_name string, bytes binary")


def piece_paragraphs(pieces: DataFrame) -> DataFrame:
    """``paragraphs`` of packages that come in pieces (file_id, n, bytes), in order of n.

    No row and no task holds a whole package or document: they pass through the task's temporary folder, which needs
    room for one package. ``pieces`` are read twice: give them written.
    """
    dealt = spread(pieces, "file_id").sortWithinPartitions("file_id", "n").select("file_id", "bytes")
    return _with_images(raw_piece_paragraphs(dealt), _piece_names(dealt))


def paragraphs(parts: DataFrame, include_tables: bool = False) -> DataFrame:
    """Paragraphs of the packages' bodies, in the PARAGRAPHS schema; tables are left out unless asked for.

    An image whose relationships lead nowhere is dropped; an OLE object takes its converted preview if there is one.
    """
    return _with_images(raw_paragraphs(parts, include_tables), parts)


def _with_images(raw: DataFrame, parts: DataFrame) -> DataFrame:
    """Raw paragraphs with their images looked up among the parts' names and relationships."""
    raw = raw.where("error is null")
    # A package's relationships and media are small next to the package: they come as maps.
    rels = relationships(parts).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("rel_id", "target"))).alias("_rels"))
    names = media(parts).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("original_filename", "filename"))).alias("_media"))
    joined = raw.join(rels, "file_id", "left").join(names, "file_id", "left")

    def stored(x: Column) -> Column:
        found = F.transform(x["rel_ids"], lambda r: F.struct(r.alias("rel_id"), basename(F.element_at("_rels", r)).alias("original")))
        usable = F.filter(found, lambda f: f["original"].isNotNull() & (~F.endswith(f["original"], F.lit(".bin")) | F.element_at("_media", f["original"]).isNotNull()))
        first = F.get(usable, F.lit(0))
        image = F.struct(x["kind"].alias("type"), first["rel_id"].alias("rel_id"), F.coalesce(F.element_at("_media", first["original"]), first["original"]).alias("filename"), first["original"].alias("original_filename"))
        return F.struct(x["type"].alias("type"), x["text"].alias("text"), F.when((x["type"] == "image") & first["original"].isNotNull(), image).alias("image"))

    content = F.filter(F.transform("items", stored), lambda i: (i["type"] != "image") | i["image"].isNotNull())
    return with_text(joined.select("file_id", "pos", "style", content.alias("content_items"))).where(F.size("content_items") > 0)


def with_text(rows: DataFrame) -> DataFrame:
    """Text and formula counters of paragraphs from their items; images add nothing to the text."""
    kind = lambda name: F.filter("content_items", lambda x: x["type"] == name)
    text = F.array_join(F.transform("content_items", lambda x: F.when(x["type"] == "latex", F.concat(F.lit("$"), x["text"], F.lit("$"))).when(x["type"] == "latex_block", F.concat(F.lit("$$"), x["text"], F.lit("$$"))).when(x["type"] == "text", x["text"]).otherwise("")), "")
    latex = F.transform(F.filter("content_items", lambda x: x["type"].isin("latex", "latex_block")), lambda x: x["text"])
    return rows.select("file_id", "pos", "style", strip(text).alias("text"), "content_items", (F.size(latex) > 0).alias("has_formula"), F.size(kind("latex")).alias("inline_formula_count"), F.size(kind("latex_block")).alias("block_formula_count"), latex.alias("latex_formulas"))


def plain_paragraphs(parts: DataFrame) -> DataFrame:
    """(file_id, pos, text): every paragraph at any depth, as its text runs joined; blank ones are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file_id, data in zip(pdf.file_id, pdf.bytes, strict=True):
                try:
                    texts = ["".join(t.text or "" for t in p.iter() if local(t.tag) == "t") for p in _paragraphs(data, True)]
                except ET.ParseError:
                    continue
                rows = [(file_id, pos, t) for pos, t in enumerate(texts) if t.strip()]
                if rows:
                    yield pd.DataFrame(rows, columns=["file_id", "pos", "text"])

    return parts.where(F.col("part_name") == DOCUMENT).select("file_id", "bytes").mapInPandas(read, "file_id string, pos int, text string")


def _inline_html(e: ET.Element, pictures: dict[str, str]) -> str:
    out, marks = [], {"b": "font-weight:bold", "i": "font-style:italic", "u": "text-decoration:underline"}
    for child in e:
        tag = local(child.tag)
        if tag == "r":
            props = next((x for x in child if local(x.tag) == "rPr"), None)
            css = ";".join(marks[local(x.tag)] for x in (props if props is not None else []) if local(x.tag) in marks and attribute(x, "val") not in ("0", "false", "none"))
            text = "".join(escape(x["text"], False).replace("\n", "<br/>") if x["type"] == "text" else "" for x in items(child))
            out.append(f'<span style="{css}">{text}</span>' if css and text else text)
            out += [f'<img src="{pictures.get(i, i)}" class="docx-image" />' for x in items(child) if x["type"] == "image" for i in x["rel_ids"][:1]]
        elif tag in ("oMath", "oMathPara"):
            x = items(child)[0]
            latex = escape(x["text"], True)
            out.append(f'<span class="math-inline" data-latex="{latex}">${latex}$</span>' if tag == "oMath" else f'<div class="math-block" data-latex="{latex}">$${latex}$$</div>')
        elif tag != "pPr":
            out.append(_inline_html(child, pictures))
    return "".join(out)


def _block_html(e: ET.Element, pictures: dict[str, str]) -> str:
    if local(e.tag) == "tbl":
        rows = ["".join(f"<td>{''.join(_block_html(p, pictures) for p in cell if local(p.tag) in ('p', 'tbl'))}</td>" for cell in row if local(cell.tag) == "tc") for row in e if local(row.tag) == "tr"]
        return '<table class="docx-table">' + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"
    looks, inner = style(e), _inline_html(e, pictures)
    if not inner.strip():
        return ""
    css = f' style="text-align:{looks["alignment"]}"' if looks["alignment"] != "left" else ""
    # Of headings only those named Heading count here; one without a number has level 1.
    tag = f"h{min(6, looks['heading_level'] or 1)}" if (looks["style_id"] or "").startswith("Heading") else "p"
    return f"<{tag}{css}>{inner}</{tag}>"


def html_documents(parts: DataFrame) -> DataFrame:
    """(file_id, html): body paragraphs and tables as one HTML text, images inlined; an unreadable document has a null html."""
    from paperloom.functions.text import data_uri

    rels = relationships(parts).select("file_id", "rel_id", basename(F.col("target")).alias("original_filename"))
    uris = media(parts).where("kind = 'media'").join(rels, ["file_id", "original_filename"]).groupBy("file_id").agg(F.collect_list(F.struct("rel_id", data_uri(F.col("original_filename"), F.col("bytes")).alias("uri"))).alias("pictures"))

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for data, pictures in zip(pdf.bytes, pdf.pictures, strict=True):
                held = {} if pictures is None else {p["rel_id"]: p["uri"] for p in pictures}
                try:
                    body = find(ET.fromstring(data), "body")
                    out.append("\n".join(x for e in (body if body is not None else []) if local(e.tag) in ("p", "tbl") and (x := _block_html(e, held))))
                except ET.ParseError:
                    out.append(None)
            yield pd.DataFrame({"file_id": pdf.file_id, "html": pd.Series(out, dtype=object, index=pdf.index)})

    return parts.where(F.col("part_name") == DOCUMENT).select("file_id", "bytes").join(uris, "file_id", "left").mapInPandas(render, "file_id string, html string")


def read_papers(spark: SparkSession, path: str, include_tables: bool = False) -> DataFrame:
    """The paragraphs of all packages below ``path``."""
    return paragraphs(read_parts(read_packages(spark, path)), include_tables)
