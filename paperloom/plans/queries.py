"""Registered queries over papers, questions, formulas, pages and job events, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import html, tex, text
from paperloom.operators import export, formulas, lookup, stats
from paperloom.operators.classify import classify, question_number
from paperloom.operators.options import is_latex, legacy_options, option_pairs, remainder, split_options
from paperloom.operators.segment import clean_content, deal, deal_by_fold, look_ahead, split_questions, with_type
from paperloom.plans import fixtures as X
from paperloom.plans import markup, objects, rasters
from paperloom.plans import oracle as O
from paperloom.session import shared_folder, written
from paperloom.sources.raster import with_ratios
from paperloom.streaming import ingest, jobs, machine

REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def register(f):
        REGISTERED[f.__name__] = f, sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}


def options_text(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o: F.concat(o["label"], F.lit("="), o["content"])), "|")


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = written(classify(X.rows(spark, sf_dir, X.PAPER_LINES)), "classified_lines")
    return with_type(deal(lines), lines)


def paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_questions(X.rows(spark, sf_dir, X.PAPER_LINES))


@query(O.QUESTIONS + "select file_id, id, number, type, type_name, content, n_options, option_text, answer, analysis, score from questions")
def paper_questions(spark, sf_dir):
    q = paper(spark, sf_dir)
    return q.select("file_id", "id", F.col("number").cast("long").alias("number"), "type", "type_name", "content", F.size("options").cast("long").alias("n_options"), options_text(F.col("options")).alias("option_text"), "answer", "analysis", "score")


@query(O.DEALT + "select file_id, pos, kind, ord from dealt")
def line_kinds(spark, sf_dir):
    return dealt(spark, sf_dir).select("file_id", "pos", "kind", F.col("ord").cast("long").alias("ord"))


@query(O.DEALT + "select file_id, pos, kind, ord from dealt")
def line_kinds_by_fold(spark, sf_dir):
    # Written, so that the choice of decisive lines doesn't repeat the rules.
    lines = written(classify(X.rows(spark, sf_dir, X.PAPER_LINES)), "lines")
    return deal_by_fold(lines).select("file_id", "pos", "kind", F.col("ord").cast("long").alias("ord"))


@query(O.DEALT + "select file_id, pos, type_name, type from dealt")
def sticky_type(spark, sf_dir):
    return dealt(spark, sf_dir).select("file_id", "pos", "type_name", "type")


@query(O.DEALT + "select file_id, ord, max(case when kind = 'start' then number end)::bigint as number, count(*) as n_lines from dealt where ord is not null group by 1, 2")
def question_ordinals(spark, sf_dir):
    d = dealt(spark, sf_dir).where("ord is not null")
    return d.groupBy("file_id", F.col("ord").cast("long").alias("ord")).agg(F.max(F.when(F.col("kind") == "start", F.col("number"))).cast("long").alias("number"), F.count("*").alias("n_lines"))


@query(O.DEALT + "select file_id, pos, score from dealt where kind = 'score'")
def score_lines(spark, sf_dir):
    return dealt(spark, sf_dir).where("kind = 'score'").select("file_id", "pos", "score")


@query(O.FLAGGED + "select file_id, pos, answer_text as answer from flagged where flag = 'answer'")
def inline_answers(spark, sf_dir):
    return classify(X.rows(spark, sf_dir, X.PAPER_LINES)).where("flag = 'answer'").select("file_id", "pos", F.col("answer_text").alias("answer"))


@query(O.FLAGGED + "select file_id, pos, analysis_text as analysis from flagged where flag = 'analysis'")
def inline_analysis(spark, sf_dir):
    return classify(X.rows(spark, sf_dir, X.PAPER_LINES)).where("flag = 'analysis'").select("file_id", "pos", F.col("analysis_text").alias("analysis"))


@query(f"with s as (select file_id, pos, {O.pieces('text')} as p, text from ({X.PAPER_LINES})) select file_id, pos, case when len(p) > 1 then {O.strip('p[1]')} else text end as remainder, (len(p) - 1)::bigint as n_options, {O.joined('p')} as option_text from s")
def option_split(spark, sf_dir):
    lines = X.rows(spark, sf_dir, X.PAPER_LINES)
    o = split_options(F.col("text"))
    return lines.select("file_id", "pos", remainder(F.col("text")).alias("remainder"), F.size(o).cast("long").alias("n_options"), options_text(o).alias("option_text"))


@query(f"with s as (select file_id, pos, unnest({O.pieces('text')}[2:]) as o from ({X.PAPER_LINES})), t as (select file_id, pos, o[1] as label, {O.strip(O.unlabelled('o'))} as content from s) select *, contains(content, '$') or contains(content, chr(92)) as is_latex from t")
def option_flags(spark, sf_dir):
    o = X.rows(spark, sf_dir, X.PAPER_LINES).select("file_id", "pos", F.inline(split_options(F.col("text"))))
    return o.withColumn("is_latex", is_latex(F.col("content")))


@query(O.QUESTIONS + r"select file_id, id, unnest(range(1, n_options + 1, 2)) // 2 as line, array_to_string(string_split(option_text, '|')[unnest(range(1, n_options + 1, 2)):unnest(range(1, n_options + 1, 2)) + 1], chr(9) || chr(9)) as text from questions where n_options > 0")
def option_lines(spark, sf_dir):
    q = paper(spark, sf_dir).select("file_id", "id", F.posexplode(option_pairs(F.col("options"))).alias("line", "pair"))
    return q.select("file_id", "id", F.col("line").cast("long").alias("line"), F.array_join(F.transform("pair", lambda o: F.concat(o["label"], F.lit("="), o["content"])), "\t\t").alias("text"))


@query(f"with s as (select file_id, pos, {O.pieces('text')} as p from ({X.PAPER_LINES})) select file_id, pos, case when len(p) > 2 then {O.joined('p')} else '' end as option_text from s")
def legacy_option_split(spark, sf_dir):
    return X.rows(spark, sf_dir, X.PAPER_LINES).select("file_id", "pos", options_text(legacy_options(F.col("text"))).alias("option_text"))


@query(rf"select file_id, pos, coalesce(nullif(regexp_extract(text, '^\s*(\d+)\s*[.、．:：,，]\s*', 1), ''), nullif(regexp_extract(text, '^\s*[(（]\s*(\d+)\s*[)）]\s*', 1), ''))::bigint as number from ({X.PAPER_LINES})")
def legacy_numbers(spark, sf_dir):
    return X.rows(spark, sf_dir, X.PAPER_LINES).select("file_id", "pos", question_number(F.col("text"), legacy=True).cast("long").alias("number"))


@query(O.ANSWERS)
def answer_merge(spark, sf_dir):
    q = split_questions(X.rows(spark, sf_dir, X.ANSWERED_LINES))
    return q.select("file_id", "id", F.col("number").cast("long").alias("number"), "answer", "analysis")


@query(O.LOOK_AHEAD)
def answer_lookahead(spark, sf_dir):
    lines = classify(X.rows(spark, sf_dir, X.ANSWERED_LINES))
    entries = look_ahead(lines).where("pos > 1000000 and number is not null")
    return entries.select("file_id", "pos", F.col("entry_answer").alias("answer"), F.col("entry_analysis").alias("analysis"))


@query(f"select file_id, pos, {O.cleaned('text')} as content from ({X.PAPER_LINES})")
def clean_contents(spark, sf_dir):
    return X.rows(spark, sf_dir, X.PAPER_LINES).select("file_id", "pos", clean_content(F.col("text")).alias("content"))


@query(O.QUESTIONS + "select file_id, id, case when type_name <> '' and type_name is distinct from lag(nullif(type_name, '') ignore nulls) over (partition by file_id order by ord) then type_name end as header from questions")
def section_headers(spark, sf_dir):
    return export.section_headers(paper(spark, sf_dir)).select("file_id", "id", "header")


@query(O.QUESTIONS + O.EXPORT)
def export_lines(spark, sf_dir):
    return export.export_lines(paper(spark, sf_dir), True, True).select("file_id", F.col("ord").cast("long").alias("ord"), F.col("seq").cast("long").alias("seq"), "kind", "text")


@query(f"with s as (select file_id, pos, string_split(text, '$') as p from ({X.PAPER_LINES})), e as (select file_id, pos, unnest(p) as t, generate_subscripts(p, 1) as i from s) select file_id, pos, i as part, case when i % 2 = 0 then ' ' || t || ' ' else t end as text, i % 2 = 0 as italic from e where i % 2 = 0 or t <> ''")
def rich_text(spark, sf_dir):
    return X.rows(spark, sf_dir, X.PAPER_LINES).select("file_id", "pos", F.inline(export.rich_text_runs(F.col("text"))))


@query(O.QUESTIONS + "select file_id, id from questions where ord % 3 = 0")
def selected_questions(spark, sf_dir):
    q = paper(spark, sf_dir)
    return lookup.selected(q, q.where("ord % 3 = 0").select("file_id", "id")).select("file_id", "id")


@query(O.QUESTIONS + "select file_id, id from questions where ord % 3 <> 0")
def unselected_questions(spark, sf_dir):
    q = paper(spark, sf_dir)
    return lookup.not_selected(q, q.where("ord % 3 = 0").select("file_id", "id")).select("file_id", "id")


@query(O.QUESTIONS + "select file_id, count(*) as total_questions, round(avg((n_options > 0)::int), 6) as option_rate, round(avg((coalesce(answer, '') <> '')::int), 6) as answer_rate, round(avg((coalesce(analysis, '') <> '')::int), 6) as analysis_rate, round(avg((score is not null)::int), 6) as score_rate from questions group by 1")
def quality_rates(spark, sf_dir):
    return stats.quality_rates(paper(spark, sf_dir), "file_id")


@query(f"select r.file_id, r.rel_id, n, target, regexp_extract(target, '[^/]*$') as original_filename, coalesce(m.f, regexp_extract(target, '[^/]*$')) as filename from ({X.REFERENCES}) r join ({X.RELATIONSHIPS}) t on r.file_id = t.file_id and r.rel_id = t.rel_id left join (select concat('o', l_orderkey) as file_id, concat('image', l_partkey, '.png') as original_filename, max(concat('o', l_orderkey, '_image', l_partkey, '.png')) as f from lineitem where l_partkey % 2 = 0 group by 1, 2) m on m.file_id = r.file_id and m.original_filename = regexp_extract(target, '[^/]*$')")
def rel_lookup(spark, sf_dir):
    found = lookup.resolve_relationships(X.rows(spark, sf_dir, X.REFERENCES), X.rows(spark, sf_dir, X.RELATIONSHIPS))
    media = X.rows(spark, sf_dir, "select concat('o', l_orderkey) as file_id, concat('image', l_partkey, '.png') as original_filename, concat('o', l_orderkey, '_image', l_partkey, '.png') as filename from lineitem where l_partkey % 2 = 0")
    return lookup.resolve_media(found, media).select("file_id", "rel_id", "n", "target", "original_filename", "filename")


REQUESTS = "select p_brand as file_id, case p_partkey % 3 when 0 then concat('image', p_partkey, '.png') when 1 then concat(p_brand, '_image', p_partkey, '.png') else concat('deep', p_partkey, '.png') end as name from part"
STORED = "select p_brand as file_id, name, path from (select p_brand, concat(p_brand, '_image', p_partkey, '.png') as name, concat('/data/', p_brand, '_image', p_partkey, '.png') as path from part where p_partkey % 2 = 0 union all select p_brand, concat('image', p_partkey, '.png'), concat('/data/image', p_partkey, '.png') from part where p_partkey % 5 = 0 union all select p_brand, concat('sub/deep', p_partkey, '.png'), concat('/data/sub/deep', p_partkey, '.png') from part where p_partkey % 4 = 1) x"


@query(f"""
    with r as ({REQUESTS}), s as ({STORED}),
    k as (
        select file_id, name, 0 as rank, false as deep, name as key from r union all
        select file_id, name, 1, false, case when starts_with(name, file_id || '_') then name else file_id || '_' || name end from r union all
        select file_id, name, 2, false, case when starts_with(name, file_id || '_') then substr(name, length(file_id) + 2) else name end from r union all
        select file_id, name, 3, true, name from r union all
        select file_id, name, 4, true, case when starts_with(name, file_id || '_') then substr(name, length(file_id) + 2) else name end from r),
    h as (select file_id, false as deep, name as key, path from s union all select file_id, true, regexp_extract(path, '[^/]*$'), path from s),
    b as (select k.file_id, k.name, rank, path, row_number() over (partition by k.file_id, k.name order by rank, path) as n from k join h on k.file_id = h.file_id and k.deep = h.deep and k.key = h.key)
    select r.file_id, r.name, b.path, b.rank::bigint as rank from r left join b on r.file_id = b.file_id and r.name = b.name and b.n = 1""")
def image_resolve(spark, sf_dir):
    found = lookup.resolve_names(X.rows(spark, sf_dir, REQUESTS), X.rows(spark, sf_dir, STORED))
    return found.select("file_id", "name", "path", F.col("rank").cast("long").alias("rank"))


IMAGE_REFS = "select p_brand as file_id, concat('image', p_size) as image_ref, p_partkey as n from part"


@query(f"with f as ({IMAGE_REFS}), m as ({X.MEDIA}), b as (select f.n, m.filename, row_number() over (partition by f.n order by m.filename <> f.image_ref, m.filename) as k from f join m on f.file_id = m.file_id and contains(m.filename, f.image_ref)) select f.file_id, f.image_ref, f.n, b.filename as image_filename from f left join b on f.n = b.n and b.k = 1")
def contains_match(spark, sf_dir):
    return lookup.match_images(X.rows(spark, sf_dir, IMAGE_REFS), X.rows(spark, sf_dir, X.MEDIA)).select("file_id", "image_ref", "n", "image_filename")


PREVIEWS = "select p_brand as file_id, concat('image', p_partkey, '.png') as original_filename, concat(p_brand, '_preview', p_partkey, '.png') as filename, -p_partkey as p_partkey from part where p_partkey % 3 = 0"


@query(f"with m as ({X.MEDIA}), p as ({PREVIEWS}) select file_id, original_filename, coalesce(p.filename, m.filename) as filename, coalesce(p.p_partkey, m.p_partkey)::bigint as p_partkey from m full join p using (file_id, original_filename)")
def media_merge(spark, sf_dir):
    merged = lookup.merged_media(X.rows(spark, sf_dir, X.MEDIA), X.rows(spark, sf_dir, PREVIEWS))
    return merged.withColumn("p_partkey", F.col("p_partkey").cast("long"))


#: Paths of media, some of which begin or contain others, and pages that name them; a URL may hold another path.
PATHS = """
    select file_id, path, max(url) as url from (
        select p_brand as file_id, concat('media/image', p_size) as path, concat('/api/', p_brand, '/image', p_size) as url from part
        union all
        select p_brand, concat('media/image', p_size, '.png'), concat('/api/media/image', p_size + 1, '.png') from part where p_partkey % 2 = 0
    ) x group by file_id, path"""
PATH_PAGES = "select p_brand as file_id, p_partkey, concat('<p><img src=', chr(34), 'media/image', p_size, '.png', chr(34), '><img src=', chr(34), 'media/image', p_size + 1, chr(34), '> ', p_name, ' ', chr(34), 'media/image', chr(34), '</p>') as html from part"


@query(rf"""with m as ({PATHS}), g as (select *, string_split(html, chr(34)) as p from ({PATH_PAGES})),
    t as (select file_id, p_partkey, unnest(p) as token, generate_subscripts(p, 1) as i from g),
    b as (select t.file_id, t.p_partkey, t.i, any_value(t.token) as token, arg_max(m.path, length(m.path)) as path, arg_max(m.url, length(m.path)) as url from t left join m on m.file_id = t.file_id and starts_with(t.token, m.path) group by 1, 2, 3)
    select file_id, p_partkey, string_agg(case when path is null then token else url || substr(token, length(path) + 1) end, chr(34) order by i) as html from b group by 1, 2""")
def path_rewriting(spark, sf_dir):
    return lookup.rewrite_paths(X.rows(spark, sf_dir, PATH_PAGES), X.rows(spark, sf_dir, PATHS)).select("file_id", "p_partkey", "html")


@query(f"with f as ({IMAGE_REFS}), m as ({X.MEDIA}), b as (select f.n, m.file_id, m.filename, row_number() over (partition by f.n order by m.filename <> f.image_ref, m.filename) as k from f join m on f.file_id = m.file_id and contains(m.filename, f.image_ref)) select file_id, filename from m where regexp_matches(lower(filename), '\\.(png|jpg|jpeg|svg|gif)$') and not exists (select 1 from b where b.k = 1 and b.file_id = m.file_id and b.filename = m.filename)")
def unreferenced_media(spark, sf_dir):
    media = X.rows(spark, sf_dir, X.MEDIA)
    return lookup.unreferenced(media, lookup.match_images(X.rows(spark, sf_dir, IMAGE_REFS), media)).select("file_id", "filename")


@query(f"with f as ({X.FORMULA_TEXTS}) select file_id, substr(sha256({O.strip(O.one_blank('latex_text'))}), 1, 16) as hash from f")
def formula_hash(spark, sf_dir):
    return X.rows(spark, sf_dir, X.FORMULA_TEXTS).select("file_id", tex.formula_hash(F.col("latex_text")).alias("hash"))


@query(f"with f as (select file_id, n, substr(sha256({O.strip(O.one_blank('latex_text'))}), 1, 16) as hash from ({X.FORMULA_TEXTS})), c as (select hash, min(concat('/cache/', n, '.png')) as path from f where n % 5 <> 0 and n % 2 = 0 group by 1) select f.file_id, f.hash, c.path as cache_path, c.path is not null as cached, case when c.path is null then 'source_only' else 'cached' end as status from f left join c on f.hash = c.hash")
def formula_cache(spark, sf_dir):
    f = X.rows(spark, sf_dir, X.FORMULA_TEXTS).select("file_id", "n", tex.formula_hash(F.col("latex_text")).alias("hash"))
    cache = f.where("n % 2 = 0").select("hash", F.concat(F.lit("/cache/"), F.col("n"), F.lit(".png")).alias("path"), (F.col("n") % 5 != 0).alias("exists"))
    return lookup.cached_formulas(f, cache).select("file_id", "hash", "cache_path", "cached", "status")


def found_formulas(spark, sf_dir, kind) -> DataFrame:
    rows = X.rows(spark, sf_dir, X.FORMULA_TEXTS).select("file_id", F.posexplode(kind(F.col("latex_text"))).alias("i", "f"))
    return rows.select("file_id", (F.col("i") + 1).cast("long").alias("part"), "f.latex", "f.context")


@query(O.formulas(X.FORMULA_TEXTS, r"\$([^$]+?)\$", "replace(latex_text, '$$', chr(1))"))
def inline_formulas(spark, sf_dir):
    return found_formulas(spark, sf_dir, tex.inline_formulas)


@query(O.formulas(X.FORMULA_TEXTS, r"(?s)\$\$(.*?)\$\$", "latex_text"))
def block_formulas(spark, sf_dir):
    return found_formulas(spark, sf_dir, tex.block_formulas)


@query(O.formulas(X.FORMULA_TEXTS, r"(?s)\\begin\{(?:equation|align)\}(.*?)\\end\{(?:equation|align)\}", "latex_text"))
def environments(spark, sf_dir):
    return found_formulas(spark, sf_dir, tex.environment_formulas)


@query(rf"with f as (select file_id, unnest(regexp_extract_all(latex_text, '\\includegraphics(?:\[[^\]]*\])?\{{([^}}]+)\}}', 1)) as image_ref from ({X.FORMULA_TEXTS})) select file_id, image_ref from f")
def graphics_refs(spark, sf_dir):
    return X.rows(spark, sf_dir, X.FORMULA_TEXTS).select("file_id", F.explode(tex.graphics_references(F.col("latex_text"))).alias("f")).select("file_id", "f.image_ref")


@query(f"select doc_id, {O.clean_lines('text')} as latex from documents")
def latex_clean(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tex.clean_latex(F.col("text")).alias("latex"))


STATUSES = "select p_brand as file_id, p_partkey, case p_partkey % 7 when 0 then 'compiled' when 1 then 'cached' when 2 then 'fallback_image' when 3 then 'compiled' when 4 then 'compiled' when 5 then case when p_size > 20 then 'source_only' else 'compiled' end else 'other' end as status from part"


@query(f"select p_partkey, case when status in ('compiled', 'cached') then 'image_first' when status = 'fallback_image' then 'image_only' when status = 'source_only' then 'latex_first' else 'unknown' end as strategy, case when status in ('compiled', 'cached') then 'rendered_image,latex' when status = 'fallback_image' then 'rendered_image' when status = 'source_only' then 'latex' else '' end as priority from ({STATUSES})")
def render_guidance(spark, sf_dir):
    g = X.rows(spark, sf_dir, STATUSES).withColumn("g", tex.guidance(F.col("status")))
    return g.select("p_partkey", "g.strategy", F.array_join("g.priority", ",").alias("priority"))


@query(f"with c as (select file_id, count(*) as total, count(*) filter (where status in ('compiled', 'cached')) as compiled, count(*) filter (where status = 'source_only') as source_only from ({STATUSES}) group by 1) select file_id, total, compiled, source_only, case when compiled / total >= 0.8 then 'image_preferred' when source_only / total >= 0.5 then 'latex_required' else 'hybrid' end as strategy from c")
def render_strategy(spark, sf_dir):
    counts = stats.status_counts(X.rows(spark, sf_dir, STATUSES).withColumn("cached", F.col("status") == "cached"), "file_id")
    return stats.render_strategy(counts).select("file_id", "total", "compiled", "source_only", "strategy")


@query(f"with c as (select file_id, count(*) filter (where status in ('compiled', 'cached')) as c, count(*) filter (where status = 'cached') as k, count(*) filter (where status = 'source_only') as s, count(*) filter (where status = 'fallback_image') as f from ({STATUSES}) group by 1) select file_id, ((c > 0)::int + (k > 0)::int + 2 * (s > 0)::int + (f > 0)::int)::bigint as n from c")
def render_hints(spark, sf_dir):
    counts = stats.status_counts(X.rows(spark, sf_dir, STATUSES).withColumn("cached", F.col("status") == "cached"), "file_id")
    return stats.recommendations(counts).select("file_id", F.size("recommendations").cast("long").alias("n"))


ATTEMPTS = "select p_brand as file_id, p_partkey as seq, p_partkey % 3 = 0 as cached, p_partkey % 4 <> 1 as ok, p_size / 8.0 as seconds, concat('error ', p_partkey) as error from part"


@query(f"""
    with a as ({ATTEMPTS}),
    c as (select file_id, count(*) filter (where not cached) as total_attempts, count(*) filter (where not cached and ok) as successful, count(*) filter (where not cached and not ok) as failed, count(*) filter (where cached) as cache_hits, coalesce(sum(seconds) filter (where not cached and ok), 0) as s from a group by 1),
    e as (select file_id, string_agg(error, '|' order by seq) as recent from (select *, row_number() over (partition by file_id order by seq desc) as n from a where not cached and not ok) where n <= 5 group by 1)
    select c.file_id, total_attempts, successful, failed, cache_hits, printf('%.2f%%', case when total_attempts = 0 then 0 else successful * 100.0 / total_attempts end) as success_rate,
        printf('%.2f%%', case when cache_hits + total_attempts = 0 then 0 else cache_hits * 100.0 / (cache_hits + total_attempts) end) as cache_hit_rate, coalesce(recent, '') as recent_errors
    from c left join e on c.file_id = e.file_id""")
def compile_stats(spark, sf_dir):
    s = stats.compile_stats(X.rows(spark, sf_dir, ATTEMPTS), "file_id")
    return s.select("file_id", "total_attempts", "successful", "failed", "cache_hits", "success_rate", "cache_hit_rate", F.array_join("recent_errors", "|").alias("recent_errors"))


@query(f"with l as (select file_id, len(regexp_extract_all(text, '\\$([^$]+)\\$')) as n from ({X.PAPER_LINES})) select file_id, count(*) as total_paragraphs, count(*) filter (where n > 0) as total_formula_paragraphs, sum(n)::bigint as total_formulas from l group by 1")
def paper_stats(spark, sf_dir):
    lines = X.rows(spark, sf_dir, X.PAPER_LINES).withColumn("latex_formulas", F.transform(tex.inline_formulas(F.col("text")), lambda f: f["latex"]))
    return stats.paper_stats(lines)


@query(O.QUESTIONS + """, l as (select len(regexp_extract_all(text, '\\$([^$]+)\\$')) as n from source),
    r as (select count(*) as total_paragraphs, count(*) filter (where n > 0) as total_formula_paragraphs, coalesce(sum(n), 0)::bigint as total_formulas from l),
    s as (select count(*) as total_questions, count(*) filter (where n_options > 0) as with_options, count(*) filter (where answer <> '') as with_answer, count(*) filter (where analysis <> '') as with_analysis, count(score) as with_score from questions)
    select * from r, s""")
def reading_totals(spark, sf_dir):
    """Totals of lines and questions that are counted in passing, while papers are read and split."""
    lines = X.rows(spark, sf_dir, X.PAPER_LINES).withColumn("latex_formulas", F.transform(tex.inline_formulas(F.col("text")), lambda f: f["latex"]))
    seen, read = stats.observed_paragraphs(lines)
    made, split = stats.observed_questions(split_questions(written(seen, "read_lines").drop("latex_formulas")))
    written(made, "split_questions")
    totals = {**read.get, **split.get}
    names = ["total_paragraphs", "total_formula_paragraphs", "total_formulas", "total_questions", "with_options", "with_answer", "with_analysis", "with_score"]
    return spark.range(1).select(*[F.lit(totals[k]).cast("long").alias(k) for k in names])


@query("with t as (select lower(unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9:]*)', 1))) as tag from pages) select tag, count(*) as count from t group by 1 order by count desc, tag limit 20")
def tag_histogram(spark, sf_dir):
    return stats.tag_histogram(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query(r"select page_id, regexp_replace(html, '<[^>]+>', '', 'g') as text from pages")
def stripped_pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query(f"select doc_id, {O.escaped('text')} as html, replace({O.escaped('text')}, '\"', '&quot;') as quoted from documents")
def html_escape(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.escape_html(F.col("text")).alias("html"), text.escape_html(F.col("text"), quotes=True).alias("quoted"))


@query(O.BLOCKS)
def page_blocks(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.explode(html.blocks(F.col("html"))).alias("b")).select("page_id", "b.tag", "b.text").where("tag = 'p'")


@query(O.ALL_BLOCKS)
def page_blocks_all(spark, sf_dir):
    """Paragraphs, headings and divisions in their order; page_blocks are its paragraphs, as far as its one-tag SQL goes."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.posexplode(html.blocks(F.col("html"))).alias("part", "b")).select("page_id", F.col("part").cast("long").alias("part"), "b.tag", "b.content_html", "b.text")


MATH_PAGES = "select p_partkey, concat('<p>', p_name, '<script type=\"math/tex\">x_', p_size, ' </script></p><script type=\"math/tex; mode=display\"> y^', p_size, '</script><script>var a</script>') as html from part"


@query(rf"""select p_partkey, trim(regexp_extract(html, '(?s)<script[^>]*type=["'']math/tex["''][^>]*>(.*?)</script>', 1)) as inline_tex, trim(regexp_extract(html, '(?s)<script[^>]*type=["'']math/tex;\s*mode=display["''][^>]*>(.*?)</script>', 1)) as display_tex, len(regexp_extract_all(html, '(?s)<script[^>]*type=["'']math/tex[^"'']*["''][^>]*>'))::bigint as n from ({MATH_PAGES})""")
def script_formulas(spark, sf_dir):
    found = lambda kind: html.script_formulas(F.col("html"), kind)
    return X.rows(spark, sf_dir, MATH_PAGES).select("p_partkey", F.array_join(found("inline"), "|").alias("inline_tex"), F.array_join(found("display"), "|").alias("display_tex"), F.size(found("any")).cast("long").alias("n"))


@query("select page_id, regexp_matches(html, 'math-inline|math-block|data-latex|[$]') as typeset from pages")
def typeset_pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.should_typeset(F.col("html")).alias("typeset"))


@query(f"""with f as (select p_partkey, {O.escaped("concat('x<', p_size, ' & ', p_name)")} as x from part) select p_partkey, '<span class="math-inline" data-latex="' || x || '">$' || x || '$</span>' as inline_html, '<div class="math-block" data-latex="' || x || '">$$' || x || '$$</div>' as block_html from f""")
def formula_html(spark, sf_dir):
    f = X.rows(spark, sf_dir, "select p_partkey, concat('x<', p_size, ' & ', p_name) as x from part")
    return f.select("p_partkey", html.inline_formula(F.col("x")).alias("inline_html"), html.block_formula(F.col("x")).alias("block_html"))


@query(f"select file_id, original_filename, case when regexp_matches(original_filename, '\\.png$') then 'image/png' when regexp_matches(original_filename, '\\.jpeg$') then 'image/jpeg' else 'image/png' end as mime, regexp_matches(lower(original_filename), '\\.(wmf|emf)$') as is_metafile, regexp_matches(lower(original_filename), '\\.(png|jpg|jpeg|svg|gif)$') as is_image, lower(regexp_extract(original_filename, '\\.[^.]*$')) as suffix, regexp_replace(original_filename, '\\.[^.]*$', '') as stem, '/api/v1/images/' || file_id || '/' || filename as url from ({X.MEDIA})")
def media_names(spark, sf_dir):
    name = F.col("original_filename")
    return X.rows(spark, sf_dir, X.MEDIA).select("file_id", "original_filename", text.media_type(name).alias("mime"), text.is_metafile(name).alias("is_metafile"), text.is_web_image(name).alias("is_image"), text.suffix(name).alias("suffix"), text.stem(name).alias("stem"), text.image_url(F.col("filename"), F.col("file_id")).alias("url"))


@query("select p_partkey, 'data:image/png;base64,' || to_base64(encode(p_name)) as uri from part")
def data_uri(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select("p_partkey", text.data_uri(F.lit("a.png"), F.col("p_name").cast("binary")).alias("uri"))


@query(f"select file_id, ts, seq, status, progress::bigint as progress from (select *, row_number() over (partition by file_id order by ts desc, seq desc) as n from ({X.JOB_EVENTS})) where n = 1")
def job_latest(spark, sf_dir):
    return jobs.latest(X.rows(spark, sf_dir, X.JOB_EVENTS)).select("file_id", "ts", "seq", "status", F.col("progress").cast("long").alias("progress"))


@query(f"select file_id, ts, seq from (select *, row_number() over (partition by file_id order by ts desc, seq desc) as n from ({X.JOB_EVENTS})) where n = 1 and status = 'completed'")
def job_completed(spark, sf_dir):
    return jobs.completed(X.rows(spark, sf_dir, X.JOB_EVENTS)).select("file_id", "ts", "seq")


@query("with l as (select o.o_custkey, list(concat('image', l_partkey % 5, '.png') order by l_orderkey, l_linenumber, l_partkey % 5) as x from lineitem l join orders o on l.l_orderkey = o.o_orderkey group by 1) select o_custkey, array_to_string(list_filter(x, lambda e, i: list_position(x, e) = i), ',') as images from l")
def image_distinct(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = F.concat(F.lit("image"), (F.col("l_partkey") % 5).cast("string"), F.lit(".png"))
    found = lookup.distinct_names(lines.select("o_custkey", name.alias("name"), "l_orderkey", "l_linenumber"), "o_custkey", "name", "l_orderkey", "l_linenumber", "name")
    return found.select("o_custkey", F.array_join("names", ",").alias("images"))


@query(O.OLDER_QUESTIONS)
def older_questions(spark, sf_dir):
    """Papers of the older form: their headers, all six forms of numbers, and points that take no line away."""
    q = split_questions(X.rows(spark, sf_dir, X.OLDER_LINES), legacy=True)
    return q.select("file_id", "id", F.col("number").cast("long").alias("number"), "type", "content", F.size("options").cast("long").alias("n_options"), "answer", "score")


CONVERSIONS = "select p_brand as file_id, p_size as name, concat('m', p_partkey) as method, p_partkey % 6 <> 0 as success, p_partkey as size, (p_partkey % 50) / 50.0 as fill_ratio from part"


@query(f"with c as (select *, max(fill_ratio) over (partition by file_id, name) as top from ({CONVERSIONS}) where success), r as (select *, row_number() over (partition by file_id, name order by size desc, method) as n from c where fill_ratio >= top - 0.03) select file_id, name, method from r where n = 1")
def conversion_rank(spark, sf_dir):
    return stats.rank_conversions(X.rows(spark, sf_dir, CONVERSIONS).withColumn("name", F.col("name"))).select("file_id", "name", "method")


@query(O.FORMULA_REPORT)
def formula_report(spark, sf_dir):
    docs = X.rows(spark, sf_dir, X.FORMULA_TEXTS)
    media = docs.select("file_id", F.concat(F.lit("image"), F.col("n") % 50, F.lit(".png")).alias("filename"))
    cache = formulas.extracted(docs.where("n % 4 = 0")).where("hash is not null").select("hash", F.lit("/cache/a.png").alias("path"), F.lit(True).alias("exists"))
    return formulas.formula_report(docs, media, cache).select("file_id", "type", "latex", "image_filename", "hash", "status", "cached", "guidance.strategy")


@query(r"select p_partkey, '\frac{\alpha}{' || p_size || '}' as latex from part")
def omml_latex(spark, sf_dir):
    from paperloom.functions.omml import with_latex

    ns = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
    xml = F.concat(F.lit(f"<m:oMath {ns}><m:f><m:num><m:r><m:t>α</m:t></m:r></m:num><m:den><m:r><m:t>"), F.col("p_size").cast("string"), F.lit("</m:t></m:r></m:den></m:f></m:oMath>"))
    return with_latex(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", xml.alias("xml"))).select("p_partkey", "latex")


@query(f"select p_partkey, {markup.LATEX} as latex from part")
def omml_structures(spark, sf_dir):
    """Sixteen structures of formula markup in turn, from plain runs to matrices."""
    from paperloom.functions.omml import with_latex

    xml = F.element_at(F.array(*[F.lit(f"<m:oMath {markup.NAMESPACE}>{xml}</m:oMath>") for xml, _ in markup.STRUCTURES]), (F.col("p_partkey") % len(markup.STRUCTURES) + 1).cast("int"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return with_latex(parts.select("p_partkey", F.replace(xml, F.lit("@"), F.col("p_size").cast("string")).alias("xml"))).select("p_partkey", "latex")


@query()
def exported_packages(spark, sf_dir):
    made = export.export_papers(paper(spark, sf_dir), title="试卷", watermark="A & B", include_answer=True, include_analysis=True)
    return made.select("file_id", F.octet_length("bytes").alias("size"))


@query()
def docx_round_trip(spark, sf_dir):
    """Papers written as packages, read again and split.

    A section is written as its bare type word, which no header rule takes: on reading it goes to the question before,
    and the next question, if its line names points, is taken for that question's score. All others come back.
    """
    from paperloom.sources.docx import piece_paragraphs

    made = written(export.export_pieces(paper(spark, sf_dir), include_answer=True), "packages")
    again = split_questions(piece_paragraphs(made))
    return again.select("file_id", "id", "number", "content", F.size("options").alias("n_options"), "answer")


@query()
def parsed_blocks(spark, sf_dir):
    from paperloom.sources.html_pages import html_blocks

    return html_blocks(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("file_id"), "html"))


@query("select p_partkey, case when p_size % 2 = 0 then '.wmf' else '.emf' end as suffix, 4 + strlen(p_name) as size from part")
def metafiles(spark, sf_dir):
    from paperloom.sources.media import metafile

    data = F.concat(F.lit("OLE").cast("binary"), F.when(F.col("p_size") % 2 == 0, F.unhex(F.lit("D7CDC69A"))).otherwise(F.lit(" EMF").cast("binary")), F.col("p_name").cast("binary"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", metafile(data).alias("m")).select("p_partkey", "m.suffix", F.octet_length("m.data").cast("long").alias("size"))


@query(f"select p_partkey, 'Equation Native' as stream, 5::bigint as version, {objects.LATEX} as latex, null::varchar as error from part")
def equation_objects(spark, sf_dir):
    """Equations inside compound files, from their small or long, scattered streams to LaTeX."""
    from paperloom.functions.equations import equation
    from paperloom.sources.ole import EQUATION, ole_streams

    found = ole_streams(objects.equation_objects(spark.read.parquet(f"{sf_dir}/part.parquet")), (EQUATION,))
    return found.select("p_partkey", "stream", equation(F.col("data")).alias("e")).select("p_partkey", "stream", F.col("e.version").cast("long").alias("version"), "e.latex", "e.error")


@query("""with s as (
        select p_partkey, chr(1) || 'Ole' as stream, p_partkey % 100 as size, repeat(chr(1), (p_partkey % 100)::integer) as data from part union all
        select p_partkey, 'Contents', p_partkey % 3 * 3000, repeat(chr(0), (p_partkey % 3 * 3000)::integer) from part)
    select p_partkey, stream, size::bigint as size, sha256(data) as sha256 from s""")
def compound_streams(spark, sf_dir):
    from paperloom.sources.ole import EQUATION, ole_streams

    found = ole_streams(objects.equation_objects(spark.read.parquet(f"{sf_dir}/part.parquet"))).where(F.col("stream") != EQUATION)
    return found.select("p_partkey", "stream", "size", F.sha2("data", 256).alias("sha256"))


@query(O.JOB_STATES)
def job_states(spark, sf_dir):
    found = machine.final_states(X.rows(spark, sf_dir, X.JOB_STEPS))
    return found.select("file_id", "status", F.col("progress").cast("long").alias("progress"), F.col("attempts").cast("long").alias("attempts"), F.col("illegal").cast("long").alias("illegal"))


@query(O.INGESTED + "select file_id, id, number, type, content, n_options, answer, score from questions")
def ingested_questions(spark, sf_dir):
    """Papers uploaded in batches: all, some shortened (that batch twice), an older upload late, more after a compaction."""
    table = f"{shared_folder(spark)}/paperloom/{uuid.uuid4().hex}/ingested"
    lines = written(X.rows(spark, sf_dir, X.PAPER_LINES), "uploaded_lines")

    def batch(number: int, day: int, like: str, most: int) -> None:
        part = lines.where(F.col("file_id").like(like) & (F.col("pos") <= most))
        found = part.select("file_id").distinct().select("file_id", F.lit(f"2024-01-0{day}").cast("timestamp").alias("modified"), F.concat("file_id", F.lit(".docx")).alias("path"))
        ingest.store_batch(table, "lines", number, found, lambda newest: (split_questions(part.join(newest, "file_id", "left_semi")), None))

    batch(0, 2, "%", 1_000_000_000)
    batch(1, 3, "%1", 200)
    batch(1, 4, "%3", 50)
    batch(2, 1, "%", 30)
    ingest.compact(spark, table)
    batch(3, 5, "%2", 100)
    q = ingest.current_questions(spark, table)
    return q.select("file_id", "id", F.col("number").cast("long").alias("number"), "type", "content", F.size("options").cast("long").alias("n_options"), "answer", "score")


_RATIOS = f"""with b as ({rasters.BOXES}), r as (select *, case when not damaged then wide * 1.0::double / width end as fill, case when not damaged then high * 1.0::double / height end as tall from b)"""


@query(_RATIOS + """ select p_partkey, damaged, case when not damaged then width end::bigint as width, case when not damaged then height end::bigint as height, case when not damaged then "left" end::bigint as left_edge,
    case when not damaged then top end::bigint as top_edge, fill as fill_ratio, tall as height_ratio, fill < 0.72 and tall >= 0.45 as normalise from r""")
def image_ratios(spark, sf_dir):
    """The drawn part of images by rule, in all colour types, depths, filters and row orders."""
    found = with_ratios(rasters.images(spark.read.parquet(f"{sf_dir}/part.parquet")))
    return found.select("p_partkey", F.col("error").isNotNull().alias("damaged"), *[F.col(a).cast("long").alias(b) for a, b in (("width", "width"), ("height", "height"), ("left", "left_edge"), ("top", "top_edge"))], "fill_ratio", "height_ratio", "normalise")


@query(_RATIOS + """, c as (select *, max(fill) over (partition by file_id, name) as best from r where not damaged),
    n as (select *, row_number() over (partition by file_id, name order by p_partkey desc, concat('m', p_partkey)) as k from c where fill >= best - 0.03) select file_id, name::bigint as name, concat('m', p_partkey) as method, fill as fill_ratio from n where k = 1""")
def ranked_images(spark, sf_dir):
    """The best image of each name, by the ratios read from the images themselves."""
    found = with_ratios(rasters.images(spark.read.parquet(f"{sf_dir}/part.parquet")))
    candidates = found.select("file_id", "name", F.concat(F.lit("m"), "p_partkey").alias("method"), F.col("error").isNull().alias("success"), F.col("p_partkey").alias("size"), "fill_ratio")
    return stats.rank_conversions(candidates).select("file_id", F.col("name").cast("long").alias("name"), "method", "fill_ratio")
