"""Formula markup by rule, one structure after the other, and the LaTeX that each must give."""

from __future__ import annotations

NAMESPACE = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


def run(text: str) -> str:
    return f"<m:r><m:t>{text}</m:t></m:r>"


def element(name: str, *children: str, **properties: str) -> str:
    held = "".join(f'<m:{k} m:val="{v}"/>' for k, v in properties.items())
    return f"<m:{name}>{f'<m:{name}Pr>{held}</m:{name}Pr>' if held else ''}{''.join(children)}</m:{name}>"


def base(text: str) -> str:
    return element("e", run(text))


#: (markup, LaTeX); @ stands for a number of the row.
STRUCTURES = (
    (run("a") + run("@"), "a@"),
    (element("f", element("num", run("α")), element("den", run("@"))), r"\frac{\alpha}{@}"),
    (element("rad", element("deg", run("3")), base("@")), r"\sqrt[3]{@}"),
    (element("sSup", base("x"), element("sup", run("@"))), "x^{@}"),
    (element("sSub", base("x"), element("sub", run("@"))), "x_{@}"),
    (element("sSubSup", base("x"), element("sub", run("i")), element("sup", run("@"))), "x_{i}^{@}"),
    (element("limLow", base("m"), element("lim", run("@"))), "m_{@}"),
    (element("func", element("fName", run("sin")), base("@")), r"\sin(@)"),
    (element("nary", element("sub", run("i=1")), element("sup", run("@")), base("i"), chr="∑"), r"\sum_{i=1}^{@} i"),
    (element("eqArr", base("a"), base("@")), "\\begin{aligned}a \\\\\n@\\end{aligned}"),
    (element("d", base("x"), base("@"), begChr="[", endChr="]", sepChr=","), "[x,@]"),
    (element("acc", base("@"), chr="→"), r"\vec{@}"),
    (element("bar", base("@"), pos="bot"), r"\underline{@}"),
    (element("box", base("@")), r"\boxed{@}"),
    (element("m", element("mr", base("a"), base("b")), element("mr", base("c"), base("@"))), "\\begin{matrix}a & b \\\\\nc & @\\end{matrix}"),
    (run("α≤β") + run("@%"), r"\alpha\leq \beta@\%"),
)

LATEX = f"replace(case p_partkey % {len(STRUCTURES)} " + " ".join(f"when {i} then '{latex}'" for i, (_, latex) in enumerate(STRUCTURES)) + " end, '@', p_size::varchar)"
