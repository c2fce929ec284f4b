"""Summary statistics of papers, formulas, compilations and markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def paper_stats(paragraphs: DataFrame) -> DataFrame:
    """Per file: paragraphs, paragraphs with formulas, formulas, and the formula encodings it has (if known)."""
    flags = [F.bool_or(c).alias(c) for c in ("has_omml", "has_vml_shapes") if c in paragraphs.columns]
    n = F.coalesce(F.size("latex_formulas"), F.lit(0))
    return paragraphs.groupBy("file_id").agg(F.count("*").alias("total_paragraphs"), F.count_if(n > 0).alias("total_formula_paragraphs"), F.sum(n).cast("long").alias("total_formulas"), *flags)


def observed_paragraphs(paragraphs: DataFrame, name: str = "paragraphs") -> tuple[DataFrame, Observation]:
    """``paragraphs`` unchanged, and the totals of ``paper_stats`` over all files, counted while they are read.

    ``.get`` of the observation has them once the first action on the returned rows ends, without a job of its own: write
    the rows and use what was written. Of no rows all totals are 0.
    """
    told = Observation(name)
    n = F.coalesce(F.size("latex_formulas"), F.lit(0))
    flags = [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("has_omml", "has_vml_shapes") if c in paragraphs.columns]
    totals = [F.count(F.lit(1)).alias("total_paragraphs"), F.count_if(n > 0).alias("total_formula_paragraphs"), F.coalesce(F.sum(n.cast("long")), F.lit(0)).alias("total_formulas"), *flags]
    return paragraphs.observe(told, *totals), told


def observed_questions(questions: DataFrame, name: str = "questions") -> tuple[DataFrame, Observation]:
    """``questions`` unchanged, and their number and how many have options, an answer, an analysis, points and formulas; see ``observed_paragraphs``."""
    told = Observation(name)
    present = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    totals = {
        "total_questions": F.count(F.lit(1)), "with_options": F.count_if(F.size("options") > 0), "with_answer": F.count_if(present("answer")),
        "with_analysis": F.count_if(present("analysis")), "with_score": F.count_if(F.col("score").isNotNull()), "formula_count": F.coalesce(F.sum(F.greatest(F.size("latex_formulas"), F.lit(0)).cast("long")), F.lit(0)),
    }
    return questions.observe(told, *[c.alias(k) for k, c in totals.items()]), told


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def as_percent(value: Column) -> Column:
    return F.format_string("%.2f%%", value)


def compile_stats(attempts: DataFrame, *by: str) -> DataFrame:
    """Counts, rates, times and the last five errors of compilation attempts (ok, cached, seconds, error, seq).

    An attempt from the cache (cached) is a hit and no compilation; rates and means are 0 where there is none.
    """
    ran = ~F.col("cached")
    out = attempts.groupBy(*by).agg(
        F.count_if(ran).alias("total_attempts"), F.count_if(ran & F.col("ok")).alias("successful"), F.count_if(ran & ~F.col("ok")).alias("failed"),
        F.count_if(F.col("cached")).alias("cache_hits"), F.count_if(ran).alias("cache_misses"), F.coalesce(F.sum(F.when(ran & F.col("ok"), F.col("seconds"))), F.lit(0.0)).alias("seconds"),
    )
    shown = out.select(
        *by, "total_attempts", "successful", "failed", "cache_hits", "cache_misses",
        as_percent(percent(F.col("successful"), F.col("total_attempts"))).alias("success_rate"),
        as_percent(percent(F.col("cache_hits"), F.col("cache_hits") + F.col("cache_misses"))).alias("cache_hit_rate"),
        F.format_string("%.2fs", "seconds").alias("total_compile_time"),
        F.format_string("%.2fs", F.coalesce(F.try_divide("seconds", "successful"), F.lit(0.0))).alias("avg_compile_time"),
    )
    # Five rows a group are kept, however many errors it has.
    newest = Window.partitionBy(*by).orderBy(F.desc("seq"))
    errors = attempts.where(ran & ~F.col("ok")).withColumn("_n", F.row_number().over(newest)).where("_n <= 5")
    errors = errors.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "error"))), lambda s: s["error"]).alias("recent_errors"))
    joined = shown.join(errors, list(by), "left") if by else shown.crossJoin(errors)
    return joined.withColumn("recent_errors", F.coalesce("recent_errors", F.array().cast("array<string>")))


def status_counts(formulas: DataFrame, *by: str) -> DataFrame:
    return formulas.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col("status").isin("compiled", "cached")).alias("compiled"), F.count_if(F.col("status") == "fallback_image").alias("fallback"),
        F.count_if(F.col("status") == "source_only").alias("source_only"), F.count_if(F.coalesce("cached", F.lit(False))).alias("from_cache"),
    )


# The texts of reports in the two functions below.
def render_strategy(counts: DataFrame) -> DataFrame:
    """``status_counts`` with strategy, reason, performance and recommendation."""
    total = F.col("total")
    pick = lambda *values: F.when(total == 0, values[0]).when(F.try_divide("compiled", total) >= 0.8, values[1]).when(F.try_divide("source_only", total) >= 0.5, values[2]).otherwise(values[3])
    ratio = lambda name, text: F.concat(F.col(name).cast("string"), F.lit("/"), total.cast("string"), F.lit(text))
    return counts.withColumns({
        "strategy": pick("none", "image_preferred", "latex_required", "hybrid"),
        "reason": pick(F.lit("无公式"), ratio("compiled", " 公式已预编译为图片"), ratio("source_only", " 公式需要前端渲染"), F.lit("混合模式：部分图片，部分 LaTeX")),
        "performance": pick("none", "excellent", "moderate", "good"),
        "recommendation": pick("文档中没有公式", "优先加载图片，降级到 LaTeX 渲染", "必须集成 MathJax/KaTeX，考虑服务端编译优化", "根据每个公式的 guidance 字段选择渲染方式"),
    })


def recommendations(counts: DataFrame, success_rate: Column | None = None, attempts: Column | None = None) -> DataFrame:
    """``status_counts`` with the list of hints that its counts (and a compilation's success rate) call for."""
    line = lambda name, before, after: F.when(F.col(name) > 0, F.concat(F.lit(before), F.col(name).cast("string"), F.lit(after)))
    hints = [
        line("compiled", "✅ ", " 个公式已预编译，直接显示图片即可"), line("from_cache", "⚡ ", " 个公式来自缓存，加载速度更快"), line("source_only", "⚠️ ", " 个公式需要前端 LaTeX 渲染"),
        F.when(F.col("source_only") > 0, "   建议：集成 MathJax 3.x 或 KaTeX"), line("fallback", "🖼️ ", " 个公式仅图片可用（MathType）"),
    ]
    if success_rate is not None:
        hints.append(F.when((success_rate < 80) & (attempts > 0), F.concat(F.lit("⚠️ 编译成功率较低 ("), F.format_string("%.1f%%", success_rate), F.lit(")，建议检查 LaTeX 环境"))))
    return counts.withColumn("recommendations", F.array_compact(F.array(*hints)))


def quality_rates(questions: DataFrame, *by: str) -> DataFrame:
    """Shares of questions with options, answer and analysis."""
    share = lambda ok: F.round(F.avg(ok.cast("int")), 6)
    present = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return questions.groupBy(*by).agg(F.count("*").alias("total_questions"), share(F.size("options") > 0).alias("option_rate"), share(present("answer")).alias("answer_rate"), share(present("analysis")).alias("analysis_rate"), share(F.col("score").isNotNull()).alias("score_rate"))


def tag_histogram(pages: DataFrame, n: int = 20) -> DataFrame:
    """(tag, count) of the ``n`` most frequent tags in ``html``; ties by tag name."""
    tags = pages.select(F.explode(F.transform(F.regexp_extract_all("html", F.lit(r"<([A-Za-z][A-Za-z0-9:]*)"), 1), F.lower)).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "tag").limit(n)


def rank_conversions(candidates: DataFrame, gap: float = 0.03) -> DataFrame:
    """The best successful conversion of each image (file_id, name, method, size, fill_ratio).

    Fill ratios within ``gap`` of the highest count as equal, then the larger size wins, then the method's name. (A
    pairwise rule with a gap has no consistent order; comparing with the highest does.)
    """
    best = Window.partitionBy("file_id", "name")
    near = candidates.where("success").withColumn("_top", F.max(F.coalesce("fill_ratio", F.lit(0.0))).over(best)).where(F.coalesce("fill_ratio", F.lit(0.0)) >= F.col("_top") - gap)
    return near.withColumn("_rank", F.row_number().over(best.orderBy(F.desc("size"), "method"))).where("_rank = 1").drop("_top", "_rank")


def needs_normalising(fill_ratio: Column, height_ratio: Column) -> Column:
    return (fill_ratio < 0.72) & (height_ratio >= 0.45)


def resolution(dpi: Column) -> Column:
    """A resolution held between 150 and 600."""
    return F.greatest(F.lit(150), F.least(F.lit(600), dpi))
