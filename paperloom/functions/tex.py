"""Formulas in LaTeX text: extraction, cleaning, hashing, rendering guidance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import collapse_blanks, strip

INLINE = r"(?<!\$)\$((?:[^$]|\\\$)+?)\$(?!\$)"
BLOCK = r"(?s)\$\$(.*?)\$\$"
GRAPHICS = r"\\includegraphics(?:\[[^\]]*\])?\{([^}]+)\}"
# Environments in the order in which they are looked for.
ENVIRONMENTS = ("equation", "align", "gather", "multline", "eqnarray", "split", "alignat")
# Strategy, priorities, fallbacks and notes by status.
GUIDANCE = {
    "compiled": ("image_first", ("rendered_image", "latex"), ("rendered_image -> latex (if image fails)",), ("优先显示预编译的高质量图片", "如图片加载失败，可使用 MathJax/KaTeX 渲染 LaTeX 源码", "图片已优化字体和布局，无需额外处理")),
    "fallback_image": ("image_only", ("rendered_image",), ("rendered_image (no fallback)",), ("仅图片可用（MathType/OLE 对象）", "无法转换为 LaTeX 源码", "确保图片路径正确")),
    "source_only": ("latex_first", ("latex",), ("latex -> placeholder (if rendering fails)",), ("仅有 LaTeX 源码，需要前端渲染", "推荐使用 MathJax 或 KaTeX", "注意处理特殊符号和字体")),
    "unknown": ("unknown", (), (), ("状态未知，请检查数据",)),
}


def clean_latex(c: Column) -> Column:
    """Without blank lines and without blanks at the ends of lines."""
    lines = F.transform(F.split(c, "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _formulas(kind: str, whole: Column, inner: Column, env: str | None = None, keep_blank: bool = False) -> Column:
    zipped = F.arrays_zip(whole.alias("w"), inner.alias("i"))
    kept = zipped if keep_blank else F.filter(zipped, lambda z: strip(z["i"]) != "")
    return F.transform(kept, lambda z: F.struct(F.lit(kind).alias("type"), clean_latex(strip(z["i"])).alias("latex"), F.substring(z["w"], 1, 60).alias("context"), F.lit(env).cast("string").alias("env_name"), F.lit(None).cast("string").alias("image_ref")))


def extract_all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def inline_formulas(c: Column) -> Column:
    return _formulas("inline", extract_all(c, INLINE, 0), extract_all(c, INLINE, 1))


def block_formulas(c: Column) -> Column:
    return _formulas("block", extract_all(c, BLOCK, 0), extract_all(c, BLOCK, 1))


def environment_formulas(c: Column) -> Column:
    found = []
    for env in ENVIRONMENTS:
        pattern = rf"(?s)\\begin\{{{env}\}}(.*?)\\end\{{{env}\}}"
        found.append(_formulas("environment", extract_all(c, pattern, 0), extract_all(c, pattern, 1), env, True))
    return F.concat(*found)


def graphics_references(c: Column) -> Column:
    zipped = F.arrays_zip(extract_all(c, GRAPHICS, 0).alias("w"), extract_all(c, GRAPHICS, 1).alias("i"))
    return F.transform(zipped, lambda z: F.struct(F.lit("image_ref").alias("type"), F.lit("").alias("latex"), z["w"].alias("context"), F.lit(None).cast("string").alias("env_name"), z["i"].alias("image_ref")))


def formulas(c: Column) -> Column:
    """Inline, block, environment and graphics formulas, in this order."""
    return F.concat(inline_formulas(c), block_formulas(c), environment_formulas(c), graphics_references(c))


def formula_hash(latex: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the text with its blanks collapsed."""
    return F.substring(F.sha2(strip(collapse_blanks(latex)).cast("binary"), 256), 1, 16)


def guidance(status: Column) -> Column:
    """STRUCT<strategy, priority, fallback_chain, notes> for a formula's status."""

    def row(key: str) -> Column:
        strategy, *lists = GUIDANCE[key]
        return F.struct(F.lit(strategy).alias("strategy"), *[F.array(*[F.lit(x) for x in values]).cast("array<string>").alias(name) for name, values in zip(("priority", "fallback_chain", "notes"), lists, strict=True)])

    return F.when(status.isin("compiled", "cached"), row("compiled")).when(status == "fallback_image", row("fallback_image")).when(status == "source_only", row("source_only")).otherwise(row("unknown"))
