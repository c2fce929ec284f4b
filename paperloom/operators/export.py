"""Selected questions as a plan of document lines, and as .docx packages."""

from __future__ import annotations

import io
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import IO
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.options import option_pairs
from paperloom.session import spread

#: Bytes of a package that are one row where packages come in pieces: readers hold thousands of rows at once.
PIECE_BYTES = 4 << 10
#: Pieces that are handed on together.
BATCH_PIECES = 256


def section_headers(questions: DataFrame) -> DataFrame:
    """``questions`` with header: the type name where it differs from the last non-empty one before, else null."""
    named = F.nullif(F.col("type_name"), F.lit(""))
    before = F.last(named, ignorenulls=True).over(Window.partitionBy("file_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return questions.withColumn("header", F.when(named.isNotNull() & ~named.eqNullSafe(before), named))


def rich_text_runs(text: Column) -> Column:
    """array<struct<part, text, italic>>: what stands between dollar signs is italic, with a space on either side; part counts from 1, empty plain parts too."""
    parts = F.transform(F.split(text, r"\$"), lambda x, i: F.struct((i + 1).cast("long").alias("part"), F.when(i % 2 == 1, F.concat(F.lit(" "), x, F.lit(" "))).otherwise(x).alias("text"), (i % 2 == 1).alias("italic")))
    return F.filter(parts, lambda r: r["italic"] | (r["text"] != ""))


def option_line(pair: Column) -> Column:
    return F.array_join(F.transform(pair, lambda o: F.concat(o["label"], F.lit(". "), o["content"])), "\t\t")


def export_lines(questions: DataFrame, include_answer: bool = False, include_analysis: bool = False) -> DataFrame:
    """(file_id, ord, seq, kind, text): the lines of the document, in order of (ord, seq)."""
    line = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    some = lambda name, flag: F.lit(flag) & (F.coalesce(F.col(name), F.lit("")) != "")
    optional = lambda ok, x: F.when(ok, F.array(x)).otherwise(F.array().cast("array<struct<kind: string, text: string>>"))
    lines = F.concat(
        optional(F.col("header").isNotNull(), line("header", F.col("header"))),
        F.array(line("stem", F.concat(F.col("number").cast("string"), F.lit(". "), F.coalesce("content", F.lit(""))))),
        F.transform(F.array_distinct(F.coalesce("images", F.array().cast("array<string>"))), lambda x: line("image", x)),
        F.transform(option_pairs(F.col("options")), lambda p: line("options", option_line(p))),
        optional(some("answer", include_answer), line("answer", F.concat(F.lit("【答案】"), F.col("answer")))),
        optional(some("analysis", include_analysis), line("analysis", F.concat(F.lit("【解析】"), F.col("analysis")))),
        F.array(line("blank", F.lit(""))),
    )
    return section_headers(questions).select("file_id", "ord", F.posexplode(lines).alias("seq", "l")).select("file_id", "ord", "seq", "l.kind", "l.text")


NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:v="urn:schemas-microsoft-com:vml" xmlns:o="urn:schemas-microsoft-com:office:office" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"'
DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml"
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _run(text: str, size: float = 12, bold: bool = False, italic: bool = False, color: str = "", font: str = "") -> str:
    style = (f'<w:rFonts w:ascii="{font}" w:hAnsi="{font}" w:eastAsia="{font}"/>' if font else "") + "<w:b/>" * bold + "<w:i/>" * italic + (f'<w:color w:val="{color}"/>' if color else "") + f'<w:sz w:val="{round(size * 2)}"/>'
    body = "".join("<w:tab/>" if part == "\t" else f'<w:t xml:space="preserve">{escape(part)}</w:t>' for part in text.replace("\t", "\0\t\0").split("\0") if part)
    return f"<w:r><w:rPr>{style}</w:rPr>{body}</w:r>"


def _formatted(text: str, size: float = 12) -> str:
    return "".join(_run(f" {x} " if i % 2 else x, size, italic=bool(i % 2)) for i, x in enumerate(text.split("$")) if x or i % 2)


def _paragraph(runs: str, indent: float = 0, centred: bool = False) -> str:
    style = '<w:jc w:val="center"/>' * centred + (f'<w:ind w:left="{round(indent * 1440)}"/>' if indent else "")
    return f"<w:p><w:pPr>{style}</w:pPr>{runs}</w:p>"


def _picture(rel_id: str, number: int) -> str:
    size = '<wp:extent cx="2743200" cy="2057400"/>'
    blip = f'<pic:pic><pic:nvPicPr><pic:cNvPr id="{number}" name="image{number}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="{rel_id}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="2743200" cy="2057400"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic>'
    return f'<w:r><w:drawing><wp:inline>{size}<wp:docPr id="{number}" name="image{number}"/><a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture">{blip}</a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'


def _watermark(text: str) -> str:
    shape = f'<v:shape id="watermark" type="#_x0000_t136" style="position:absolute;width:400pt;height:100pt;rotation:315;mso-position-horizontal:center;mso-position-vertical:center" fillcolor="silver" stroked="f"><v:fill opacity=".5"/><v:textpath style="font-family:宋体;font-size:1pt" string={quoteattr(text)}/></v:shape>'
    return f"<w:hdr {NS}><w:p><w:r><w:pict>{shape}</w:pict></w:r></w:p></w:hdr>"


def _paragraph_of(kind: str, text: str, images: dict[str, bytes], used: list[str]) -> str:
    """The markup of a line; images that are shown are noted in ``used``."""
    if kind == "header":
        return _paragraph(_run(text, 14, bold=True, font="黑体"))
    if kind == "stem":
        number, _, rest = text.partition(". ")
        return _paragraph(_run(f"{number}. ", bold=True) + _formatted(rest))
    if kind == "image":
        if text not in images:
            return ""
        used.append(text)
        return _paragraph(_picture(f"rIdImage{len(used)}", len(used)))
    if kind == "options":
        cells = [x.partition(". ") for x in text.split("\t\t")]
        return _paragraph(_run("\t\t").join(_run(f"{a}. ", bold=True) + _formatted(c) for a, _, c in cells), 0.5)
    if kind == "answer":
        return _paragraph(_run(text, 10.5, color="008000"), 0.3)
    if kind == "analysis":
        return _paragraph(_run(text[:4], 10.5, bold=True, color="0000FF") + _formatted(text[4:]), 0.3)
    return _paragraph("")


def docx_bytes(lines: Iterable[tuple[str, str]], title: str = "", watermark: str = "", images: dict[str, bytes] | None = None) -> bytes:
    """A package of the lines (kind, text); images that aren't given are left out.

    Lines are taken one by one and written as they come: beside the package itself no more than a line is held.
    """
    out = io.BytesIO()
    write_docx(out, lines, title, watermark, {} if images is None else images)
    return out.getvalue()


def write_docx(out: IO[bytes], lines: Iterable[tuple[str, str]], title: str, watermark: str, images: dict[str, bytes], large: bool = False) -> None:
    """Write a package of the lines; an image is looked up when its line comes. ``large``: the document may pass 2 GiB."""
    used = []
    header = '<w:headerReference w:type="default" r:id="rIdHeader"/>' if watermark else ""
    styles = f'<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Times New Roman" w:hAnsi="Times New Roman" w:eastAsia="宋体"/><w:sz w:val="24"/></w:rPr></w:rPrDefault></w:docDefaults></w:styles>'
    kinds = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Default Extension="{x}" ContentType="image/{x}"/>' for x in ("png", "jpeg", "jpg", "gif", "wmf", "emf"))
    first = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    before = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{kinds}<Override PartName="/word/document.xml" ContentType="{DOCX_TYPE}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{DOCX_TYPE}.styles+xml"/><Override PartName="/word/header1.xml" ContentType="{DOCX_TYPE}.header+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{RELATION}/officeDocument" Target="word/document.xml"/></Relationships>',
    }
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in before.items():
            z.writestr(zipfile.ZipInfo(name), first + text)
        with z.open(zipfile.ZipInfo("word/document.xml"), "w", force_zip64=large) as f:
            f.write(f"{first}<w:document {NS}><w:body>".encode())
            if title:
                f.write((_paragraph(_run(title, 18, bold=True), centred=True) + _paragraph("")).encode())
            for kind, text in lines:
                f.write(_paragraph_of(kind, text, images, used).encode())
            f.write(f"<w:sectPr>{header}</w:sectPr></w:body></w:document>".encode())
        relations = [("rIdStyles", "styles", "styles.xml")] + [("rIdHeader", "header", "header1.xml")] * bool(watermark) + [(f"rIdImage{i + 1}", "image", f"media/{name}") for i, name in enumerate(used)]
        related = "".join(f'<Relationship Id="{i}" Type="{RELATION}/{kind}" Target={quoteattr(target)}/>' for i, kind, target in relations)
        after = {
            "word/styles.xml": styles,
            "word/_rels/document.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{related}</Relationships>',
        } | ({"word/header1.xml": _watermark(watermark)} if watermark else {})
        for name, text in after.items():
            z.writestr(zipfile.ZipInfo(name), first + text)
        for name in dict.fromkeys(used):
            z.writestr(zipfile.ZipInfo(f"word/media/{name}"), images[name])


def _package_rows(questions: DataFrame, include_answer: bool, include_analysis: bool, media: DataFrame | None) -> DataFrame:
    """(file_id, kind, text, bytes): the lines of each paper in order, its images before them; a paper is in one task, its rows together."""
    lines = export_lines(questions, include_answer, include_analysis)
    rows = lines.select("file_id", "ord", "seq", "kind", "text", F.lit(None).cast("binary").alias("bytes"))
    if media is not None:
        wanted = lines.where("kind = 'image'").select("file_id", F.col("text").alias("filename")).distinct()
        rows = rows.unionByName(media.join(wanted, ["file_id", "filename"], "left_semi").select("file_id", F.lit(-1).alias("ord"), F.lit(0).alias("seq"), F.lit("bytes").alias("kind"), F.col("filename").alias("text"), "bytes"))
    return spread(rows, "file_id").sortWithinPartitions("file_id", F.col("ord").asc_nulls_last(), "seq").select("file_id", "kind", "text", "bytes")


def _package_files(batches: Iterator[pa.RecordBatch], title: str, watermark: str, large: bool) -> Iterator[tuple[str | None, IO[bytes]]]:
    """A file in the task's own temporary folder for each paper among the rows, which are never held together."""
    rows = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("file_id", "kind", "text", "bytes")), strict=True))
    for file_id, own in groupby(rows, key=lambda row: row[0]):
        images: dict[str, bytes] = {}

        def lines(own=own, images=images) -> Iterator[tuple[str, str]]:
            for _, kind, text, data in own:
                if kind == "bytes":
                    images[text] = data
                else:
                    yield kind, text

        with tempfile.TemporaryFile() as f:
            write_docx(f, lines(), title, watermark, images, large)
            f.seek(0)
            yield file_id, f


def export_papers(questions: DataFrame, title: str = "", watermark: str = "", include_answer: bool = False, include_analysis: bool = False, media: DataFrame | None = None) -> DataFrame:
    """(file_id, bytes): a .docx for each file, of its questions in order; ``media`` (file_id, filename, bytes) has the images."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file_id, f in _package_files(batches, title, watermark, False):
            yield pa.RecordBatch.from_arrays([pa.array([file_id], pa.string()), pa.array([f.read()], pa.binary())], ["file_id", "bytes"])

    return _package_rows(questions, include_answer, include_analysis, media).mapInArrow(write, "file_id string, bytes binary")


def export_pieces(questions: DataFrame, title: str = "", watermark: str = "", include_answer: bool = False, include_analysis: bool = False, media: DataFrame | None = None) -> DataFrame:
    """(file_id, n, bytes): the packages of ``export_papers`` in pieces of PIECE_BYTES, numbered from 0, for papers of any length.

    No row and no task holds a whole paper; a task needs disk for one package. ``docx.piece_paragraphs`` reads them.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file_id, f in _package_files(batches, title, watermark, True):
            n = 0
            while data := f.read(BATCH_PIECES * PIECE_BYTES):
                own = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
                yield pa.RecordBatch.from_arrays([pa.array([file_id] * len(own), pa.string()), pa.array(range(n, n + len(own)), pa.int64()), pa.array(own, pa.binary())], ["file_id", "n", "bytes"])
                n += len(own)

    return _package_rows(questions, include_answer, include_analysis, media).mapInArrow(write, "file_id string, n long, bytes binary")


def question_json(questions: DataFrame) -> DataFrame:
    """(file_id, total_questions, questions): the answer that a client gets for each file."""
    row = F.struct("ord", F.to_json(F.struct(*[c for c in questions.columns if c not in ("file_id", "ord")])).alias("json"))
    return questions.groupBy("file_id").agg(F.count("*").alias("total_questions"), F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["json"]), ","), F.lit("]")).alias("questions"))
