"""HTML of paragraphs, options and formulas, and blocks and formulas out of HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.patterns import DOT
from paperloom.functions.text import collapse_spaces, escape_html, image_url, strip, strip_tags

BLOCK = r"(?is)<(p|h[1-6]|div)[^>]*>(.*?)</\1>"
SCRIPTS = {kind: rf"""(?s)<script[^>]*type=["']math/tex{rest}["'][^>]*>(.*?)</script>""" for kind, rest in (("inline", ""), ("display", r";\s*mode=display"), ("any", """[^"']*"""))}


def inline_formula(latex: Column) -> Column:
    x = escape_html(strip(F.coalesce(latex, F.lit(""))))
    return F.concat(F.lit('<span class="math-inline" data-latex="'), x, F.lit('">$'), x, F.lit("$</span>"))


def block_formula(latex: Column, compat: bool = False) -> Column:
    """``compat``: three dollar signs before the formula, as older output had."""
    x = escape_html(strip(F.coalesce(latex, F.lit(""))))
    return F.concat(F.lit('<div class="math-block" data-latex="'), x, F.lit('">$$$' if compat else '">$$'), x, F.lit("$$</div>"))


def image(name: Column, css_class: Column | str, file_id: Column | None = None) -> Column:
    css = css_class if isinstance(css_class, Column) else F.lit(css_class)
    return F.concat(F.lit('<img src="'), image_url(name, file_id), F.lit('" class="'), css, F.lit('" />'))


def paragraph(items: Column, file_id: Column | None = None, compat: bool = False) -> Column:
    """The items of a paragraph as HTML: adjacent parts are set apart by one space, images alone in it are blocks."""
    alone = F.forall(items, lambda x: x["type"] == "image")
    css = F.when(alone, "formula-image-block").otherwise("formula-image")

    def part(x: Column) -> Column:
        return F.when(x["type"] == "text", escape_html(x["text"])).when(x["type"] == "latex", inline_formula(x["text"])).when(x["type"] == "latex_block", block_formula(x["text"], compat)).when(x["type"] == "image", image(x["image"]["filename"], css, file_id)).otherwise("")

    def joined(html: Column, x: Column) -> Column:
        piece = part(x)
        touching = (html == "") | F.endswith(html, F.lit(" "))
        # Text may bring its own space; between a tag's end and an escaped text none is needed either.
        own = (x["type"] == "text") & (F.startswith(piece, F.lit(" ")) | (F.endswith(html, F.lit(">")) & F.startswith(piece, F.lit("<"))))
        return F.concat(html, F.when(touching | own, "").otherwise(" "), piece)

    shown = F.filter(items, lambda x: (x["type"] != "image") | x["image"]["filename"].isNotNull())
    return collapse_spaces(F.aggregate(shown, F.lit(""), joined))


def option(label: Column, content: Column, paragraph_html: Column, images: Column, n_options: Column, file_id: Column | None = None, compat: bool = False) -> Column:
    """An option's label, its own text and images; the markup of its paragraph where that holds this option alone.

    ``compat``: any paragraph that starts with the label gives all that follows it.
    """
    start = F.concat(F.lit("(?Ud)^"), label, F.lit(rf"\s*{DOT}\s*"))
    whole = F.regexp_like(paragraph_html, start) & (F.lit(compat) | (n_options == 1))
    body = F.when(whole, F.regexp_replace(paragraph_html, start, F.lit(""))).otherwise(escape_html(content))
    pictures = F.array_join(F.transform(images, lambda x: F.concat(F.lit(" "), image(x, "option-image", file_id), F.lit(" "))), "")
    return F.concat(F.lit('<span class="option-label">'), label, F.lit(".</span> "), body, pictures)


def wrapped(text: Column, kind: str) -> Column:
    """An answer or analysis as a block."""
    return F.concat(F.lit(f'<div class="{kind}">'), text, F.lit("</div>"))


def script_formulas(html: Column, kind: str = "any") -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(SCRIPTS[kind]), 1), strip)


def blocks(html: Column) -> Column:
    """array<struct<tag, content_html, text>> of paragraphs, headings and divisions; blank ones are left out."""
    zipped = F.arrays_zip(F.regexp_extract_all(html, F.lit(BLOCK), 1).alias("t"), F.regexp_extract_all(html, F.lit(BLOCK), 2).alias("c"))
    rows = F.transform(zipped, lambda z: F.struct(F.lower(z["t"]).alias("tag"), z["c"].alias("content_html"), strip(strip_tags(z["c"])).alias("text")))
    return F.filter(rows, lambda r: (r["text"] != "") | F.contains(r["content_html"], F.lit("<img")) | F.contains(r["content_html"], F.lit("math/tex")))
