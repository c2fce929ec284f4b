"""Word packages: formulas by rule, paragraphs, images, HTML and the questions made of them, from files on disk."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.functions import html, text
from paperloom.functions.omml import omml_to_latex
from paperloom.operators import formulas, lookup, stats
from paperloom.operators.options import continued_options, option_images, option_pairs
from paperloom.operators.segment import split_questions
from paperloom.sources import docx, html_pages, media

M = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
NS = f'xmlns:w="urn:w" xmlns:r="urn:r" xmlns:a="urn:a" xmlns:v="urn:v" xmlns:o="urn:o" {M}'


def run(x):
    return f"<m:r><m:t>{x}</m:t></m:r>"


def el(name, *children, **properties):
    props = "".join(f'<m:{k} m:val="{v}"/>' if v is not None else f"<m:{k}/>" for k, v in properties.items())
    return f"<m:{name}>{f'<m:{name}Pr>{props}</m:{name}Pr>' if props else ''}{''.join(children)}</m:{name}>"


def e(x):
    return el("e", run(x))


RULES = [
    ("OM-1", run("a") + run("b"), "ab"),
    ("OM-2", el("f", el("num", run("a")), el("den", run("b"))), r"\frac{a}{b}"),
    ("OM-3", el("rad", el("deg"), e("x")), r"\sqrt{x}"),
    ("OM-3", el("rad", el("deg", run("2")), e("x")), r"\sqrt{x}"),
    ("OM-3", el("rad", el("deg", run("3")), e("x")), r"\sqrt[3]{x}"),
    ("OM-4", el("sSup", e("x"), el("sup", run("2"))), "x^{2}"),
    ("OM-5", el("sSub", e("x"), el("sub", run("i"))), "x_{i}"),
    ("OM-6", el("sSubSup", e("x"), el("sub", run("i")), el("sup", run("2"))), "x_{i}^{2}"),
    ("OM-7", el("limLow", e("m"), el("lim", run("n"))), "m_{n}"),
    ("OM-7", el("limUpp", e("m"), el("lim", run("n"))), "m^{n}"),
    ("OM-8", el("func", el("fName", run("sin")), e("x")), r"\sin(x)"),
    ("OM-8", el("func", el("fName", run("foo")), e("x")), "foo(x)"),
    ("OM-9", el("nary", el("sub", run("i=1")), el("sup", run("n")), e("i"), chr="∑"), r"\sum_{i=1}^{n} i"),
    ("OM-9", el("nary", el("sub"), el("sup"), e("f"), chr="∮"), r"\oint f"),
    ("OM-10", el("eqArr", e("a"), e("b")), "\\begin{aligned}a \\\\\nb\\end{aligned}"),
    ("OM-11", el("d", e("x")), "(x)"),
    ("OM-11", el("d", e("x"), begChr="[", endChr="]"), "[x]"),
    ("OM-11", el("d", e("x"), begChr="{", endChr="", grow="1"), r"\left\{x\right."),
    ("OM-11", el("d", e("a"), e("b"), sepChr=","), "(a,b)"),
    ("OM-12", el("acc", e("x"), chr="→"), r"\vec{x}"),
    ("OM-12", el("acc", e("x")), r"\hat{x}"),
    ("OM-13", el("bar", e("x"), pos="bot"), r"\underline{x}"),
    ("OM-13", el("bar", e("x"), pos="top"), r"\overline{x}"),
    ("OM-14", el("box", e("x")), r"\boxed{x}"),
    ("OM-15", el("m", el("mr", e("a"), e("b")), el("mr", e("c"), e("d"))), "\\begin{matrix}a & b \\\\\nc & d\\end{matrix}"),
    ("OM-15", el("d", el("e", el("m", el("mr", e("a"), e("b")))), begChr="["), r"\begin{bmatrix}a & b\end{bmatrix}"),
    ("OM-16", run("α≤β"), r"\alpha\leq \beta"),
    ("OM-16", run("αx"), r"\alpha x"),
    ("OM-16", run("5%_#"), r"5\%\_\#"),
    ("nested", el("f", el("num", el("rad", el("deg"), el("e", el("sSup", e("x"), el("sup", run("2")))))), el("den", run("2"))), r"\frac{\sqrt{x^{2}}}{2}"),
]


@pytest.mark.parametrize(("rule", "xml", "want"), RULES, ids=[f"{r}-{i}" for i, (r, _, _) in enumerate(RULES)])
def test_formula_rules(rule, xml, want):
    assert omml_to_latex(f"<m:oMath {M}>{xml}</m:oMath>") == want


def test_formulas_that_are_none():
    assert [omml_to_latex(x) for x in (None, " ", "<a", f"<m:oMath {M}/>")] == ["", "", "[formula error: not well-formed]", ""]


def p(*children, style=None, jc=None):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:jc w:val="{jc}"/>' if jc else "")
    return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{''.join(children)}</w:p>"


def r(x, props=""):
    return f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}{x}</w:r>"


def t(x):
    return f"<w:t>{x}</w:t>"


FORMULA = f"<m:oMath>{el('f', el('num', run('a')), el('den', run('b')))}</m:oMath>"
DRAWING = '<w:drawing><a:blip r:embed="rId1"/></w:drawing>'
PICT = '<w:pict><v:shape><v:imagedata r:id="rId2"/></v:shape></w:pict>'
SHAPE = '<v:shape o:relid="rId2"/>'
OBJECT = '<w:object><v:shape><v:imagedata r:id="rId2"/></v:shape><o:OLEObject r:id="rId3"/></w:object>'
BODY = [
    p(r(t("第一章")), style="Heading1", jc="center"),
    p(),
    p(r(t("一、选择题：")), style="标题2"),
    p(r(t("1. 求 ")), FORMULA, r(t(" &lt; 1") + "<w:tab/>" + t("值") + "<w:br/>"), r(DRAWING)),
    p(r(t("A. ")), r(PICT), r(t("B. 乙 $x$"))),
    f"<w:tbl><w:tr><w:tc>{p(r(t('cell')))}</w:tc><w:tc>{p(r(t('two')))}</w:tc></w:tr></w:tbl>",
    p(r(t("【答案】A"))),
    p(f"<m:oMathPara>{FORMULA}</m:oMathPara>"),
    p(r(OBJECT), r(SHAPE), r('<w:drawing><a:blip r:embed="rId9"/></w:drawing>')),
    p(r(t("bold"), '<w:b/><w:u w:val="none"/>'), r(t("both"), "<w:b/><w:i/>")),
]
RELS = [("rId1", "image", "media/image1.png"), ("rId2", "image", "media/image2.wmf"), ("rId3", "oleObject", "embeddings/oleObject1.bin")]
OLE = b"head" + b"\xd7\xcd\xc6\x9a" + b"picture"


def package(body):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{''.join(body)}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="http://x/{k}" Target="{g}"/>' for i, k, g in RELS) + "</Relationships>")
        z.writestr("word/media/image1.png", b"\x89PNG")
        z.writestr("word/media/image2.wmf", b"\xd7\xcd\xc6\x9arest")
        z.writestr("word/embeddings/oleObject1.bin", OLE)
    return held.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("papers")
    (path / "sub").mkdir()
    (path / "a.docx").write_bytes(package(BODY))
    (path / "sub/broken.docx").write_bytes(b"no archive")
    (path / "sub/odd.docx").write_bytes(package(["<w:p>"]))
    (path / "notes.txt").write_text("1. no paper")
    return str(path)


@pytest.fixture(scope="module")
def parts(spark, folder):
    return docx.read_parts(docx.read_packages(spark, folder)).cache()


@pytest.fixture(scope="module")
def paragraphs(parts):
    return docx.paragraphs(parts).orderBy("pos").collect()


def test_packages_of_a_folder(spark, folder, parts):
    files = docx.read_packages(spark, folder)
    assert sorted(x["path"].rsplit("/", 1)[1] for x in files.collect()) == ["a.docx", "broken.docx", "odd.docx"]
    assert docx.read_packages(spark, folder, max_bytes=100).count() == 1
    assert [x["error"].split(":")[0] for x in parts.where("error is not null").collect()] == ["BadZipFile"]
    assert docx.raw_paragraphs(parts).where("error is not null").count() == 1
    names = spark.createDataFrame([("x.docx", None), ("x.DOCX", None), ("x", docx.DOCX_MIME)], "name string, mime string")
    assert [x[0] for x in names.select(docx.accepted(F.col("name"), F.coalesce("mime", F.lit("")))).collect()] == [True, False, True]
    assert names.select(docx.stored_id(F.lit("u1_a_b.docx"))).first()[0] == "u1"
    stored = spark.createDataFrame([("/u/k_b.docx",), ("/u/k_a.docx",), ("/u/kk_a.docx",)], "path string")
    assert docx.locate(stored, "k").first()["path"] == "/u/k_a.docx"


def test_relationships_media_and_encodings(parts):
    assert sorted((x["rel_id"], x["rel_type"], x["target"]) for x in docx.relationships(parts).dropDuplicates(["rel_id"]).collect()) == RELS
    one = docx.media(parts).dropDuplicates(["original_filename"]).collect()
    assert {x["original_filename"]: (x["kind"], x["filename"].split("_", 1)[1]) for x in one} == {"image1.png": ("media", "image1.png"), "image2.wmf": ("media", "image2.wmf"), "oleObject1.bin": ("ole", "oleObject1.png")}
    assert {(x["has_omml"], x["has_vml_shapes"]) for x in docx.encodings(parts).collect()} == {(True, True), (False, False)}
    seen = media.previews(docx.media(parts)).first()
    assert (seen["suffix"], bytes(seen["data"]), seen["status"]) == (".wmf", OLE[4:], "preview")


def test_paragraphs(paragraphs):
    assert [x["pos"] for x in paragraphs] == [0, 2, 3, 4, 5, 6, 7, 8]  # empty ones and tables are left out
    s = paragraphs[0]["style"]
    assert (s["style_id"], s["is_heading"], s["heading_level"], s["alignment"]) == ("Heading1", True, 1, "center")
    assert (paragraphs[1]["style"]["heading_level"], paragraphs[1]["style"]["alignment"]) == (2, "left")
    x = paragraphs[2]
    assert x["text"] == "1. 求 $\\frac{a}{b}$ < 1\t值" and (x["inline_formula_count"], x["block_formula_count"], x["latex_formulas"]) == (1, 0, [r"\frac{a}{b}"])
    assert [i["type"] for i in x["content_items"]] == ["text", "latex", "text", "text", "text", "text", "image"]
    assert x["content_items"][-1]["image"]["original_filename"] == "image1.png"
    assert paragraphs[5]["text"] == "$$\\frac{a}{b}$$" and paragraphs[5]["block_formula_count"] == 1
    images = [(i["image"]["type"], i["image"]["original_filename"]) for i in paragraphs[6]["content_items"]]
    assert images == [("ole", "oleObject1.bin"), ("vml", "image2.wmf")]  # a missing relationship gives no image


def test_paragraphs_in_tables_and_plain_ones(parts):
    assert [x["text"] for x in docx.paragraphs(parts, include_tables=True).orderBy("pos").collect()][4:6] == ["cell", "two"]
    assert [x["text"] for x in docx.plain_paragraphs(parts).orderBy("pos").collect()][:3] == ["第一章", "一、选择题：", "1. 求 ab < 1值"]


def test_whole_document_html(parts):
    lines = docx.html_documents(parts).where("html is not null").first()["html"].split("\n")
    assert lines[0] == '<h1 style="text-align:center">第一章</h1>' and lines[1] == "<p>一、选择题：</p>"
    assert '<span class="math-inline" data-latex="\\frac{a}{b}">$\\frac{a}{b}$</span>' in lines[2] and 'src="data:image/png;base64,iVBORw==' in lines[2] and "&lt; 1\t值<br/>" in lines[2]
    assert lines[4] == '<table class="docx-table"><tr><td><p>cell</p></td><td><p>two</p></td></tr></table>'
    assert lines[6].startswith('<p><div class="math-block"')
    assert lines[-1] == '<p><span style="font-weight:bold">bold</span><span style="font-weight:bold;font-style:italic">both</span></p>'


def test_questions_of_a_package(parts, paragraphs):
    q = split_questions(docx.paragraphs(parts)).collect()
    assert len(q) == 1
    q, name = q[0], paragraphs[2]["content_items"][-1]["image"]["filename"]
    assert (q["number"], q["type"], q["answer"], q["latex_formulas"]) == (1, "single_choice", "A", [r"\frac{a}{b}", r"\frac{a}{b}"])
    assert q["images"][0] == name and f'<img src="/api/v1/images/{q["file_id"]}/{name}" class="formula-image" />' in q["content_html"]
    assert [(o["label"], o["is_latex"], len(o["images"])) for o in q["options"]] == [("A", True, 1), ("B", True, 0)]
    assert 'class="option-image"' in q["options"][0]["content_html"] and q["options"][1]["content_html"].startswith('<span class="option-label">B.</span> ')
    assert '<div class="math-block"' in q["content_html"] and 'class="formula-image-block"' in q["content_html"]


def test_option_images_and_pairs(spark):
    image = lambda n: ("image", None, (None, None, n, n))
    items = [image("before"), ("text", "A. x", None), image("a1"), image("a2"), ("text", "then B. y C. z", None), image("b1")]
    df = spark.createDataFrame([(items,)], "items array<struct<type: string, text: string, image: struct<type: string, rel_id: string, filename: string, original_filename: string>>>")
    assert df.select(option_images(F.col("items"))).first()[0] == {"A": ["a1", "a2"], "B": ["b1"]}
    five = spark.sql("select array(1, 2, 3, 4, 5) as o")
    assert five.select(option_pairs(F.col("o"))).first()[0] == [[1, 2], [3, 4], [5]]


def test_options_that_go_on(spark):
    rows = [("f", 1, "stem"), ("f", 2, "A. one B. two"), ("f", 3, " more of two "), ("f", 4, None), ("f", 5, "and more"), ("f", 6, "C. three"), ("f", 7, "D."), ("g", 1, "A."), ("g", 2, "late")]
    got = continued_options(spark.createDataFrame(rows, "file_id string, pos int, text string")).collect()
    want = {("f", 2): [("A", "one"), ("B", "two more of two and more")], ("f", 6): [("C", "three")], ("f", 7): [], ("g", 1): [("A", "late")]}
    assert {(r["file_id"], r["pos"]): [tuple(o) for o in r["options"]] for r in got} == want


def test_names_paths_and_headers(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(text.collapse_spaces(F.lit("a   b\t c"))) == "a b\t c"
    assert value(text.without_image_sizes(F.lit('<img src="a" style="width:3px"><img height="4" src="b">'))) == '<img src="a"><img src="b">'
    assert value(text.image_url(F.lit("media/x.png"))) == "/api/v1/images/x.png" and value(text.cache_name(F.lit("a b/ü.wmf"))) == "a_b__.wmf.png.v2"
    assert value(text.disposition_name(F.lit("attachment; filename*=UTF-8''%E8%AF%95%E5%8D%B7.docx"))) == "试卷.docx"
    assert value(text.disposition_name(F.lit('attachment; filename="a.docx"'))) == "a.docx"
    assert [value(c) for c in (text.prefixed(F.lit("x"), F.lit("f")), text.prefixed(F.lit("f_x"), F.lit("f")), text.unprefixed(F.lit("f_x"), F.lit("f")))] == ["f_x", "f_x", "x"]
    assert value(lookup.export_name(F.lit("media/x.png"))) == ["media/x.png", "media/media/x.png", "x.png"]
    assert value(html.wrapped(F.lit("A"), "answer")) == '<div class="answer">A</div>'
    pages = spark.createDataFrame([("f", "m/a.png m/a.png.bak"), ("g", "m/a.png")], "file_id string, html string")
    held = spark.createDataFrame([("f", "m/a.png", "/u/1"), ("f", "m/a.png.bak", "/u/2")], "file_id string, path string, url string")
    assert sorted((r["file_id"], r["html"]) for r in lookup.rewrite_paths(pages, held).collect()) == [("f", "/u/1 /u/2"), ("g", "m/a.png")]


def test_an_empty_selection_is_an_error(spark):
    q = spark.createDataFrame([("f", "q_0")], "file_id string, id string")
    with pytest.raises(ValueError, match="no question"):
        lookup.selected(q, q.limit(0))
    assert lookup.selected(q, q).count() == 1


def test_cache_index_is_updated_and_purged(spark, tmp_path):
    schema = "hash string, path string, latex_preview string, created_at timestamp, size long, exists boolean"
    old = spark.createDataFrame([("h", "/old", "x", None, 1, True)], schema)
    new = spark.sql("select 'h' as hash, '/new' as path, repeat('y', 80) as latex, timestamp '2024-01-01' as created_at, 2L as size union all select 'i', '/i', 'z', timestamp '2024-01-02', 3L")
    formulas.updated_cache(old, new).write.parquet(f"{tmp_path}/cache")
    held = {r["hash"]: r for r in spark.read.parquet(f"{tmp_path}/cache").collect()}
    assert held["h"]["path"] == "/new" and len(held["h"]["latex_preview"]) == 50 and set(held) == {"h", "i"}
    formulas.purge_cache(spark, f"{tmp_path}/cache")
    left = spark.read.parquet(f"{tmp_path}/cache")
    assert left.count() == 0 and set(left.columns) == set(old.columns)


def test_equation_headers_and_tools(spark):
    rows = spark.createDataFrame([(bytearray(b"\0\0\0\0\x05" + bytes(30) + b"Times New Roman\0Symbol\0x\0"),), (bytearray(b"short"),), (None,)], "data binary")
    assert [(x[0]["version"], x[0]["fonts"]) for x in rows.select(media.equation_header("data")).collect()] == [(5, ["Times New Roman", "Symbol"]), (None, []), (None, [])]
    assert media.capabilities(spark).where("rank = 0").count() == len(media.TOOLS)


def test_blocks_of_parsed_pages(spark):
    page = '<div><p>one <b>two</b></p><ul><li>item</li></ul></div><h2></h2><p><img src="/m/a.png"></p>'
    rows = html_pages.html_blocks(spark.createDataFrame([("f", page), ("g", None)], "file_id string, html string")).orderBy("pos").collect()
    assert [x["tag"] for x in rows] == ["div", "p", "li", "p"] and rows[1]["text"] == "one two" and rows[3]["images"]


def test_blocks_of_nested_pages_are_handed_on_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(html_pages, "BATCH_CHARS", 1000)
    pages = pa.RecordBatch.from_pydict({"file_id": [f"f{i}" for i in range(20)], "html": ["<div>" * 30 + "x" * 50 + "</div>" * 30] * 20})
    made = list(html_pages.block_batches(iter([pages])))
    # Each page's 30 blocks, each with those inside it; all pages of a batch were handed on at once before.
    assert len(made) > 20 and max(b.nbytes for b in made) < 4000
    rows = [r for b in made for r in b.to_pylist()]
    assert [(r["file_id"], r["pos"]) for r in rows] == [(f"f{i}", k) for i in range(20) for k in range(30)]


def test_streamed_paragraphs_are_those_of_the_tree():
    import tracemalloc
    import xml.etree.ElementTree as ET

    def shown(ps):
        # What stands behind a paragraph isn't read yet, and isn't used.
        return [(setattr(p, "tail", None), ET.tostring(p))[1] for p in ps]

    texts = [b"<d><body><p>a<q/></p>t<tbl><p>in</p></tbl><p/><s><body><p>x</p></body></s><p><r><t>b</t></r></p></body><p>out</p></d>", b"<body><p>1</p></body>", b"<d><p>n<p>m</p></p></d>", b"<d><body/></d>", b"<d><h><p>h</p></h><body><p>1</p></body></d>"]
    for xml in texts:
        assert shown(docx._streamed_paragraphs(xml)) == shown(docx._paragraphs(xml, False)), xml
    # A document that breaks at its end has no paragraphs at all.
    for bad in (b"<d><body><p>1</p></body>", b"", b"x"):
        with pytest.raises(ET.ParseError):
            next(docx._streamed_paragraphs(bad))
    xml = b"<d><body>" + b"<p><r><t>x</t></r></p>" * 50_000 + b"</body></d>"
    tracemalloc.start()
    assert sum(1 for _ in docx._streamed_paragraphs(xml)) == 50_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The whole tree takes ten times the text and more.
    assert peak < 4 * len(xml)
