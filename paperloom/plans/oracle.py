"""DuckDB SQL fragments for the registered queries."""

from __future__ import annotations

from paperloom.functions import patterns as P
from paperloom.plans import fixtures as X

B = r"[\s\x{3000}]"
DOT = P.DOT


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{B}+|{B}+$', '', 'g')"


def one_blank(x: str) -> str:
    return rf"regexp_replace({x}, '{B}+', ' ', 'g')"


def escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def cleaned(x: str) -> str:
    """Cut at each keyword in turn, then blanks as one; a list of the keywords is folded over the text."""
    words = ", ".join(f"'{w}'" for w in P.CUT_WORDS)
    cut = f"list_reduce([{words}], lambda c, w: case when contains(c, w) then {strip('string_split(c, w)[1]')} else c end, {x})"
    return strip(one_blank(cut))


def pieces(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([A-H])\s*{DOT}\s*', chr(1) || '\0', 'g'), chr(1))"


def unlabelled(x: str) -> str:
    return rf"regexp_replace({x}, '^[A-H]{B}*{DOT}{B}*', '')"


def joined(p: str) -> str:
    return f"array_to_string(list_transform({p}[2:], lambda o: o[1] || '=' || {strip(unlabelled('o'))}), '|')"


def clean_lines(x: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), lambda l: l <> ''), chr(10))"


def lead(starts: tuple[str, ...], x: str) -> str:
    return "coalesce(" + ", ".join(rf"case when regexp_matches({x}, '{s}\s*(?s:.)') then {strip(rf"regexp_extract({x}, '{s}\s*((?s:.)[^【]*)', 1)")} end" for s in starts) + ")"


TYPES = "case header_word " + " ".join(f"when '{w}' then '{t}'" for w, t in P.HEADER_TYPES.items()) + " end"


def flagged(source: str, legacy: bool = False) -> str:
    number = rf"try_cast(nullif(regexp_extract(line, '^{B}*(\d+){B}*{DOT}{B}*', 1), '') as bigint)"
    header = rf"nullif(regexp_extract(line, '^[一二三四五六七八九十]+{DOT}{B}*({'|'.join(P.HEADER_TYPES)})', 1), '')"
    if legacy:
        number = "try_cast(coalesce(" + ", ".join(f"nullif(regexp_extract(line, '{p}', 1), '')" for p in P.LEGACY_NUMBERS) + ") as bigint)"
        header = "coalesce(" + ", ".join(f"nullif(regexp_extract(line, '{p}', 1), '')" for p in P.LEGACY_HEADERS) + ")"
    score = "coalesce(" + ", ".join(rf"nullif(regexp_extract(line, '{p}', 1), '')" for p in P.SCORES) + ")"
    return f"""with source as ({source}),
    lined as (select file_id, pos, {strip("coalesce(text, '')")} as line from source),
    marked as (
        select *, {header} as header_word,
            {not legacy} and regexp_matches(line, '^({"|".join(P.MARKERS)})') or {not legacy} and regexp_matches(line, '^[^\\n]*({"|".join(P.MARKERS_ANYWHERE)})[^\\n]*$') as marker,
            {lead(P.ANSWER_LEADS, "line")} as answer_text, {lead(P.ANALYSIS_LEADS, "line")} as analysis_text
        from lined),
    flagged0 as (
        select *, case when line = '' then 'blank' when header_word is not null then 'header' when marker then 'marker' when answer_text is not null then 'answer' when analysis_text is not null then 'analysis' else 'text' end as flag
        from marked),
    flagged as (select * replace (case when flag = 'header' then header_word end as header_word), case when flag = 'text' then {number} end as number, case when flag = 'text' then {score}::double end as score from flagged0)
    """


FLAGGED = flagged(X.PAPER_LINES)
DEAL = f"""
    , typed as (select *, coalesce(last_value(header_word ignore nulls) over w, '') as type_name, coalesce(last_value({TYPES} ignore nulls) over w, 'unknown') as type, sum((flag = 'header')::int) over w as section from flagged window w as (partition by file_id order by pos rows unbounded preceding)),
    firsts as (select *, min(case when number is not null then pos end) over (partition by file_id, section) as first_pos from typed),
    started as (select *, number is not null and (pos = first_pos or score is null) as is_start, first_pos is not null and pos >= first_pos as is_open from firsts),
    dealt0 as (select *, sum(is_start::int) over (partition by file_id order by pos rows unbounded preceding) - 1 as q from started),
    dealt as (
        select *, case when flag <> 'text' then flag when is_start then 'start' when score is not null and is_open then 'score' when is_open then 'continuation' else 'orphan' end as kind,
            case when is_open and flag not in ('blank', 'header') then q end::bigint as ord
        from dealt0)
    """
DEALT = FLAGGED + DEAL
SPLIT = rf""", bodies as (select *, case when kind = 'start' then {strip(rf"regexp_replace(line, '^{B}*\d+{B}*{DOT}{B}*', '')")} when kind = 'continuation' then line end as body from dealt where ord is not null),
    split as (select *, {pieces("body")} as p from bodies),
    parts as (
        select *, case when kind = 'start' and len(p) > 1 then {strip("p[1]")} when kind = 'start' or (kind = 'continuation' and len(p) = 1) then body end as piece, case when len(p) > 1 then {joined("p")} end as opts, case when len(p) > 1 then len(p) - 1 else 0 end as n from split),
    grouped as (
        select file_id, ord, max(case when kind = 'start' then number end)::bigint as number, max(case when kind = 'start' then type end) as t, max(case when kind = 'start' then type_name end) as tn,
            string_agg(piece, ' ' order by pos) as c, sum(n)::bigint as n_options, coalesce(string_agg(opts, '|' order by pos), '') as option_text,
            arg_max(answer_text, pos) filter (where kind = 'answer') as answer, arg_max(analysis_text, pos) filter (where kind = 'analysis') as analysis, arg_max(score, pos) filter (where kind = 'score') as score
        from parts group by 1, 2),
    questions as (
        select file_id, ord, 'q_' || ord as id, number, case when t = 'unknown' and n_options > 0 then 'single_choice' else t end as type, case when t = 'unknown' and n_options > 0 then '选择题' else tn end as type_name,
            {cleaned("c")} as content, n_options, option_text, answer, analysis, score
        from grouped)
    """
QUESTIONS = DEALT + SPLIT
_NUMBERED = rf"regexp_replace(line, '^{B}*\d+{B}*{DOT}{B}*', '')"
_OLDER_NUMBERED = "case " + " ".join(f"when regexp_matches(line, '{p}') then regexp_replace(line, '{p}', '')" for p in P.LEGACY_NUMBERS) + " end"
OLDER_QUESTIONS = (
    flagged(X.OLDER_LINES, legacy=True)
    + DEAL.replace("(pos = first_pos or score is null)", "true").replace("score is not null and is_open then 'score'", "false then 'score'")
    + SPLIT.replace(_NUMBERED, _OLDER_NUMBERED)
    + """, points as (
        select file_id, case when not is_start then q when pos > first_pos then q - 1 end as ord, arg_max(score, pos) as points
        from dealt where score is not null and is_open group by 1, 2)
    select file_id, id, number, type, content, n_options, answer, points as score from questions left join points using (file_id, ord)"""
)
EXPORT = """
    , headed as (select *, case when type_name <> '' and type_name is distinct from lag(nullif(type_name, '') ignore nulls) over (partition by file_id order by ord) then type_name end as header from questions),
    opts as (select file_id, ord, list_transform(string_split(option_text, '|'), lambda o: o[1] || '. ' || o[3:]) as o from headed where n_options > 0),
    lines as (
        select file_id, ord, 0 as a, 0 as b, 'header' as kind, header as text from headed where header is not null union all
        select file_id, ord, 1, 0, 'stem', number || '. ' || content from headed union all
        select file_id, ord, 2, i, 'options', array_to_string(o[i:i + 1], chr(9) || chr(9)) from (select *, unnest(range(1, len(o) + 1, 2)) as i from opts) union all
        select file_id, ord, 3, 0, 'answer', '【答案】' || answer from headed where coalesce(answer, '') <> '' union all
        select file_id, ord, 4, 0, 'analysis', '【解析】' || analysis from headed where coalesce(analysis, '') <> '' union all
        select file_id, ord, 5, 0, 'blank', '' from headed)
    select file_id, ord, row_number() over (partition by file_id, ord order by a, b) - 1 as seq, kind, text from lines"""

INGESTED = QUESTIONS.replace(X.PAPER_LINES, X.INGESTED_LINES)

_ANSWERED = f"""with l as ({X.ANSWERED_LINES}),
    entry as (select file_id, pos, regexp_extract(text, '^(\\d+)', 1)::bigint as number, regexp_extract(text, '^\\d+\\. ([A-H])', 1) as answer from l where pos > 1000000 and regexp_matches(text, '^\\d+\\. ')),
    entries as (
        select e.file_id, e.pos, e.number, e.answer, coalesce(string_agg(case when starts_with(t.text, '【') then trim(replace(t.text, '【详解】', '')) else t.text end, ' ' order by t.pos) filter (where not starts_with(t.text, '故选')), '') as analysis
        from entry e left join l t on t.file_id = e.file_id and t.pos > e.pos and t.pos < e.pos + 10 group by all)
    """
LOOK_AHEAD = _ANSWERED + "select file_id, pos, answer, analysis from entries"
ANSWERS = (
    _ANSWERED
    + """, q as (select file_id, pos, regexp_extract(text, '^(\\d+)', 1)::bigint as number, row_number() over (partition by file_id order by pos) - 1 as ord from l where pos < 1000000 and regexp_matches(text, '^\\d+\\. '))
    select q.file_id, 'q_' || q.ord as id, q.number, coalesce(case when a.text is not null then 'D' end, nullif(e.answer, ''), '') as answer, e.analysis
    from q left join l a on a.file_id = q.file_id and a.pos = q.pos + 2 left join entries e on e.file_id = q.file_id and e.number = q.number"""
)


def formulas(source: str, pattern: str, text: str) -> str:
    inner = strip("w[2]")
    return rf"""with f as (select file_id, {text} as t from ({source})),
    g as (select file_id, regexp_extract_all(t, '{pattern}', 0) as whole, regexp_extract_all(t, '{pattern}', 1) as inside from f),
    h as (select file_id, list_filter(list_zip(whole, inside), lambda w: {inner} <> '') as z from g),
    e as (select file_id, unnest(z) as w, generate_subscripts(z, 1) as part from h)
    select file_id, part, {clean_lines(inner)} as latex, substr(w[1], 1, 60) as context from e"""


BLOCKS = rf"""with b as (select page_id, unnest(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1)) as c from pages)
    select page_id, 'p' as tag, {strip("regexp_replace(c, '<[^>]+>', '', 'g')")} as text from b where {strip("regexp_replace(c, '<[^>]+>', '', 'g')")} <> ''"""

_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "div")
_ANY_BLOCK = "|".join(rf"<{t}[^>]*>.*?</{t}>" for t in _TAGS)
ALL_BLOCKS = rf"""with b as (select page_id, regexp_extract_all(html, '(?is){_ANY_BLOCK}') as w from pages), e as (select page_id, unnest(w) as w, generate_subscripts(w, 1) as i from b),
    s as (select page_id, i, lower(regexp_extract(w, '(?i)^<({"|".join(_TAGS)})', 1)) as tag, regexp_extract(w, '(?s)^<[^>]*>(.*)</[^>]*>$', 1) as content_html from e),
    t as (select *, {strip("regexp_replace(content_html, '<[^>]+>', '', 'g')")} as text from s)
    select page_id, row_number() over (partition by page_id order by i) - 1 as part, tag, content_html, text from t where text <> '' or contains(content_html, '<img') or contains(content_html, 'math/tex')"""

_REPORTED = {
    "inline": (r"\$([^$]+?)\$", "replace(latex_text, '$$', chr(1))"),
    "block": (r"(?s)\$\$(.*?)\$\$", "latex_text"),
    "environment": (r"(?s)\\begin\{(?:equation|align)\}(.*?)\\end\{(?:equation|align)\}", "latex_text"),
}
FORMULA_REPORT = f"""with d as ({X.FORMULA_TEXTS}),
    a as (
        {" union all ".join(f"select file_id, '{kind}' as type, latex, null as image_ref from ({formulas('select * from d', *how)})" for kind, how in _REPORTED.items())} union all
        select file_id, 'image_ref', '', unnest(regexp_extract_all(latex_text, '\\\\includegraphics(?:\\[[^\\]]*\\])?\\{{([^}}]+)\\}}', 1)) from d),
    h as (select a.*, d.n, case when latex <> '' then substr(sha256({strip(one_blank("latex"))}), 1, 16) end as hash, 'image' || d.n % 50 || '.png' as medium from a join d using (file_id)),
    c as (select distinct hash from h where n % 4 = 0 and hash is not null),
    r as (
        select file_id, type, latex, case when contains(medium, image_ref) then medium end as image_filename, hash, case when hash is not null then case when c.hash is null then 'source_only' else 'cached' end end as status, c.hash is not null as cached
        from h left join c using (hash)
        union all
        select file_id, 'image_only', '', 'image' || n % 50 || '.png', null, 'fallback_image', false from d where not exists (select 1 from h where h.file_id = d.file_id and contains(h.medium, h.image_ref)))
    select *, case status when 'cached' then 'image_first' when 'source_only' then 'latex_first' when 'fallback_image' then 'image_only' end as strategy from r"""

JOB_STATES = f"""with recursive e as (select *, row_number() over (partition by file_id order by ts, seq) as n from ({X.JOB_STEPS})),
    s as (
        select distinct file_id, 0::bigint as n, null::varchar as status, 0::bigint as progress, 0::bigint as attempts, 0::bigint as illegal, null::timestamp as deadline from e
        union all
        select file_id, n, case when legal then next else now end, case when legal then (case when next = 'parsing' then p when next = 'completed' then 100 else 0 end) when now = 'error' then 0 else progress end,
            attempts + (legal and upload)::bigint, illegal + (not legal)::bigint,
            case when legal and upload then ts + interval 300 second when now <> 'parsing' or (legal and next <> 'parsing') then null else deadline end
        from (
            select *, case when upload then now is distinct from 'parsing' when next = 'parsing' then now is not distinct from 'parsing' and p >= (case when now = 'parsing' then progress else 0 end) else now is not distinct from 'parsing' end as legal
            from (
                select s.file_id, e.n, e.ts, e.status as next, e.progress as p, e.status = 'parsing' and e.progress = 0 as upload, s.progress, s.attempts, s.illegal, s.deadline,
                    case when s.status = 'parsing' and s.deadline <= e.ts then 'error' else s.status end as now
                from s join e on s.file_id = e.file_id and e.n = s.n + 1)))
    select file_id, status, case when status is null then null else progress end as progress, attempts, illegal from (select *, row_number() over (partition by file_id order by n desc) as back from s) where back = 1"""
