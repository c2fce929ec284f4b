"""Office mathematics (OMML) to LaTeX: one recursive rule per element, over tables of symbols."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Function names with a LaTeX command of the same name.
FUNCTIONS = (
    "sin", "cos", "tan", "cot", "sec", "csc", "log", "ln", "exp", "lg", "lb", "lim", "limsup", "liminf", "max", "min",
    "sup", "inf", "dim", "ker", "deg", "gcd", "lcm", "det", "tr", "hom", "arg", "arcsin", "arccos", "arctan",
    "arccot", "arcsec", "arccsc", "sinh", "cosh", "tanh", "coth", "sech", "csch", "arsinh", "arcosh", "artanh",
)
# Large operators.
OPERATORS = {
    "∑": "sum", "∏": "prod", "∐": "coprod", "∫": "int", "∬": "iint", "∭": "iiint", "∮": "oint",
    "∯": "oiint", "∰": "oiiint", "⋃": "bigcup", "⋂": "bigcap", "⋁": "bigvee", "⋀": "bigwedge", "⊕": "bigoplus",
    "⊗": "bigotimes", "⨁": "bigoplus", "⨂": "bigotimes", "⨄": "biguplus", "⨅": "bigsqcap", "⨆": "bigsqcup",
}
# Delimiters that aren't written as they are; one that is missing is a dot.
DELIMITERS = {"{": r"\{", "}": r"\}", "‖": r"\|", "⌈": r"\lceil ", "⌉": r"\rceil ", "⌊": r"\lfloor ", "⌋": r"\rfloor ", "⟨": r"\langle ", "⟩": r"\rangle ", "": "."}
# Accents, as characters and as combining marks.
ACCENTS = {"^": "hat", "~": "tilde", "-": "bar", ".": "dot", "..": "ddot", "→": "vec", "`": "grave", "'": "acute", "ˇ": "check", "°": "mathring", "̂": "hat", "̃": "tilde", "̄": "bar", "̇": "dot", "̈": "ddot", "⃗": "vec"}
# Matrix environments by opening bracket.
MATRICES = {"(": "pmatrix", "[": "bmatrix", "{": "Bmatrix", "|": "vmatrix", "‖": "Vmatrix"}
# Characters and their commands.
SYMBOLS = {
    "Α": "Alpha", "Β": "Beta", "Γ": "Gamma", "Δ": "Delta", "Ε": "Epsilon", "Ζ": "Zeta", "Η": "Eta", "Θ": "Theta",
    "Ι": "Iota", "Κ": "Kappa", "Λ": "Lambda", "Μ": "Mu", "Ν": "Nu", "Ξ": "Xi", "Ο": "Omicron", "Π": "Pi",
    "Ρ": "Rho", "Σ": "Sigma", "Τ": "Tau", "Υ": "Upsilon", "Φ": "Phi", "Χ": "Chi", "Ψ": "Psi", "Ω": "Omega",
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta",
    "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi", "ο": "omicron", "π": "pi",
    "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
    "±": "pm", "∓": "mp", "×": "times", "÷": "div", "∗": "ast", "⋆": "star", "∘": "circ", "•": "bullet",
    "∩": "cap", "∪": "cup", "⊔": "sqcup", "⊓": "sqcap", "∧": "wedge", "∨": "vee", "⊕": "oplus", "⊗": "otimes",
    "⊖": "ominus", "⊙": "odot", "†": "dagger", "‡": "ddagger", "∞": "infty", "∂": "partial", "∇": "nabla", "√": "surd",
    "∠": "angle", "⊥": "perp",
    "≤": "leq", "≥": "geq", "≡": "equiv", "≈": "approx", "≠": "neq", "∼": "sim", "≃": "simeq", "≅": "cong",
    "≪": "ll", "≫": "gg", "∝": "propto", "⊂": "subset", "⊃": "supset", "⊆": "subseteq", "⊇": "supseteq", "∈": "in",
    "∋": "ni", "∉": "notin",
    "←": "leftarrow", "→": "rightarrow", "↑": "uparrow", "↓": "downarrow", "↔": "leftrightarrow", "⇒": "Rightarrow", "⇐": "Leftarrow", "⇔": "Leftrightarrow",
    "↦": "mapsto",
    "…": "dots", "⋯": "cdots", "⋮": "vdots", "⋱": "ddots", "ℵ": "aleph", "ℑ": "Im", "ℜ": "Re", "℘": "wp",
    "∀": "forall", "∃": "exists", "∅": "emptyset",
}
# Characters that LaTeX takes for itself.
ESCAPES = {"\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "#": r"\#", "^": r"\^{}", "_": r"\_", "~": r"\textasciitilde{}", "%": r"\%"}
_COMMANDS = {char: rf"\{name}" for char, name in SYMBOLS.items()}


def escaped(text: str) -> str:
    """Characters are escaped or become commands one by one; a command is set apart from a letter after it."""
    out = []
    for i, c in enumerate(text):
        command = _COMMANDS.get(c)
        out.append((command + " " * text[i + 1 : i + 2].isalpha()) if command else ESCAPES.get(c, c))
    return "".join(out)


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _child(e: ET.Element, name: str) -> ET.Element | None:
    return next((c for c in e if _name(c) == name), None)


def _value(e: ET.Element, name: str) -> str | None:
    """The val attribute of a property, in the element's property child or right below it; null without the property."""
    for holder in [c for c in e if _name(c) == _name(e) + "Pr"] + [e]:
        if (found := _child(holder, name)) is not None:
            return next((v for k, v in found.attrib.items() if k.rpartition("}")[2] == "val"), "")
    return None


def _inside(e: ET.Element | None) -> str:
    return "" if e is None else "".join(_latex(c) for c in e)


def _part(e: ET.Element, name: str) -> str:
    return _inside(_child(e, name))


def _scripts(e: ET.Element) -> str:
    low, high = _part(e, "sub"), _part(e, "sup")
    return (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "")


def _radical(e: ET.Element) -> str:
    degree = _part(e, "deg").strip()
    return rf"\sqrt{f'[{degree}]' if degree and degree != '2' else ''}{{{_part(e, 'e')}}}"


def _function(e: ET.Element) -> str:
    name = _part(e, "fName")
    plain = name.strip().lower()
    return (f"\\{plain}" if plain in FUNCTIONS else name) + f"({_part(e, 'e')})"


def _nary(e: ET.Element) -> str:
    char = _value(e, "chr")
    sign = "\\" + OPERATORS[char] if char in OPERATORS else (char or ("\\sum" if char is None else "\\int"))
    return f"{sign}{_scripts(e)} {_part(e, 'e')}"


def _delimited(e: ET.Element) -> str:
    first, last, between = _value(e, "begChr"), _value(e, "endChr"), _value(e, "sepChr")
    first, last = "(" if first is None else first, ")" if last is None else last
    parts = [c for c in e if _name(c) == "e"]
    if len(parts) == 1 and len(parts[0]) == 1 and _name(parts[0][0]) == "m" and first in MATRICES:
        return _matrix(parts[0][0], MATRICES[first])
    grows = _value(e, "grow") is not None
    side = lambda word, c: (f"\\{word}" if grows else "") + DELIMITERS.get(c, c if c or grows else "")
    return side("left", first) + (between or "|").join(_inside(p) for p in parts) + side("right", last)


def _accent(e: ET.Element) -> str:
    return f"\\{ACCENTS.get(_value(e, 'chr') or '^', 'hat')}{{{_part(e, 'e')}}}"


def _bar(e: ET.Element) -> str:
    return rf"\{'underline' if _value(e, 'pos') == 'bot' else 'overline'}{{{_part(e, 'e')}}}"


def _matrix(e: ET.Element, environment: str = "") -> str:
    environment = environment or MATRICES.get(_value(e, "begChr") or "", "matrix")
    rows = [r for r in e if _name(r) in ("mr", "m")] or [e]
    return rf"\begin{{{environment}}}" + " \\\\\n".join(" & ".join(_inside(c) for c in r if _name(c) == "e") for r in rows) + rf"\end{{{environment}}}"


def _equations(e: ET.Element) -> str:
    rows = [_inside(r) if _name(r) == "e" else " & ".join(_inside(c) for c in r if _name(c) == "e") for r in e if _name(r) in ("e", "eqArrRow")]
    return r"\begin{aligned}" + " \\\\\n".join(rows) + r"\end{aligned}"


RULES: dict[str, Callable[[ET.Element], str]] = {
    "f": lambda e: rf"\frac{{{_part(e, 'num')}}}{{{_part(e, 'den')}}}",
    "rad": _radical,
    "sSup": lambda e: f"{_part(e, 'e')}^{{{_part(e, 'sup')}}}",
    "sSub": lambda e: f"{_part(e, 'e')}_{{{_part(e, 'sub')}}}",
    "sSubSup": lambda e: f"{_part(e, 'e')}_{{{_part(e, 'sub')}}}^{{{_part(e, 'sup')}}}",
    "sPre": lambda e: f"{{}}_{{{_part(e, 'sub')}}}^{{{_part(e, 'sup')}}}{_part(e, 'e')}",
    "limLow": lambda e: f"{_part(e, 'e')}_{{{_part(e, 'lim')}}}",
    "limUpp": lambda e: f"{_part(e, 'e')}^{{{_part(e, 'lim')}}}",
    "func": _function,
    "nary": _nary,
    "d": _delimited,
    "acc": _accent,
    "bar": _bar,
    "box": lambda e: rf"\boxed{{{_part(e, 'e')}}}",
    "borderBox": lambda e: rf"\boxed{{{_part(e, 'e')}}}",
    "m": _matrix,
    "matrix": _matrix,
    "eqArr": _equations,
    "t": lambda e: escaped(e.text or ""),
}


def _latex(e: ET.Element) -> str:
    name = _name(e)
    if name.endswith("Pr"):
        return ""
    return RULES[name](e) if name in RULES else _inside(e)


def omml_to_latex(xml: str | None) -> str:
    """LaTeX of an OMML element; its plain text where no rule gives any; an error text where it isn't XML."""
    if not xml or not xml.strip():
        return ""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return "[formula error: not well-formed]"
    return _latex(root).strip() or "".join(root.itertext()).strip()


@pandas_udf(StringType())
def to_latex(xml: pd.Series) -> pd.Series:
    return xml.map(omml_to_latex)


def with_latex(formulas: DataFrame, xml: str = "xml") -> DataFrame:
    """``formulas`` with latex; each distinct formula is converted once."""
    distinct = formulas.select(F.col(xml).alias("_xml")).where("_xml is not null").distinct().withColumn("latex", to_latex(F.col("_xml")))
    same: Column = F.col(xml) == F.col("_xml")
    return formulas.join(distinct, same, "left").drop("_xml").withColumn("latex", F.coalesce("latex", F.lit("")))
