"""Rows derived from the star-schema tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Parts of a brand, numbered: the questions of a paper.
PARTS = "select *, row_number() over (partition by p_brand order by p_partkey) as rn from part"

#: Lines of papers: headers, numbered lines, options, points, answers and analyses, by the part's key.
PAPER_LINES = f"""
    select file_id, cast(rn * 10 + k as bigint) as pos, text from (
        select p_brand as file_id, rn, 0 as k, case (rn - 1) % 20 when 0 then '一、选择题：' when 5 then '二、填空题' when 10 then '三、解答题' else '四、证明题' end as text from ({PARTS}) a where (rn - 1) % 5 = 0
        union all
        select p_brand, rn, 1, concat(rn, '. ', p_name, case when p_partkey % 7 = 0 then concat('（', p_size, '分）') else '' end) from ({PARTS}) b
        union all
        select p_brand, rn, 2, concat('A. ', p_type, ' B．$x_{{', p_size, '}}$  C、', p_brand) from ({PARTS}) c where p_partkey % 3 = 0
        union all
        select p_brand, rn, 3, concat('（', p_size % 10 + 1, '分）') from ({PARTS}) d where p_partkey % 4 = 0
        union all
        select p_brand, rn, 4, concat('【答案】 ', case p_partkey % 3 when 0 then 'A' when 1 then 'B' else 'C' end, '【解析】略') from ({PARTS}) e where p_partkey % 2 = 0
        union all
        select p_brand, rn, 5, concat('解析：', p_type) from ({PARTS}) f where p_partkey % 5 = 0
    ) x"""

#: Papers with an answer section: questions with options, then an entry and its analysis for each.
ANSWERED_LINES = f"""
    select file_id, pos, text from (
        select p_brand as file_id, cast(rn * 10 as bigint) as pos, concat(rn, '. ', p_name) as text from ({PARTS}) a
        union all
        select p_brand, cast(rn * 10 + 1 as bigint), concat('A. ', p_type, ' B．$x_{{', p_size, '}}$') from ({PARTS}) b where p_partkey % 3 = 0
        union all
        select p_brand, cast(rn * 10 + 2 as bigint), '【答案】D' from ({PARTS}) c where p_partkey % 5 = 0
        union all
        select p_brand, cast(1000000 as bigint), '参考答案' from ({PARTS}) d where rn = 1
        union all
        select p_brand, cast(1000000 + rn * 10 as bigint), concat(rn, '. ', case p_partkey % 3 when 0 then 'A' when 1 then 'B' else 'C' end) from ({PARTS}) e
        union all
        select p_brand, cast(1000000 + rn * 10 + 1 as bigint), concat('【详解】', p_type) from ({PARTS}) f where p_partkey % 2 = 0
        union all
        select p_brand, cast(1000000 + rn * 10 + 2 as bigint), concat('因为 ', p_size) from ({PARTS}) g where p_partkey % 4 <> 1
        union all
        select p_brand, cast(1000000 + rn * 10 + 3 as bigint), '故选 A' from ({PARTS}) h where p_partkey % 3 = 0
    ) x"""

#: Papers of the older form: three forms of headers and a line that looks like one, six forms of numbers, points at the
#: start of a question or on lines of their own, and a line that newer papers would take for a marker.
OLDER_LINES = f"""
    select file_id, cast(rn * 10 + k as bigint) as pos, text from (
        select p_brand as file_id, rn, 0 as k, case (rn - 1) % 25 when 0 then 'Part A：选择题' when 5 then '填空题（每题5分）' when 10 then '三、解答题' when 15 then 'Part  B 多选题（共）' else 'Part E: 选择题' end as text from ({PARTS}) a where (rn - 1) % 5 = 0
        union all
        select p_brand, rn, 1, concat(case rn % 6 when 0 then concat(rn, '，') when 1 then concat('（', rn, '） ') when 2 then concat(rn, ' ) ') when 3 then concat('第 ', rn, '题') when 4 then concat('Question', rn, ' ') else concat('Q', rn, ' ') end, p_name, case when p_partkey % 7 = 0 then concat('（', p_size, '分）') else '' end) from ({PARTS}) b
        union all
        select p_brand, rn, 2, concat('A. ', p_type, ' B．$x_{{', p_size, '}}$  C、', p_brand) from ({PARTS}) c where p_partkey % 3 = 0
        union all
        select p_brand, rn, 3, concat('（', p_size % 10 + 1, '分）') from ({PARTS}) d where p_partkey % 4 = 0
        union all
        select p_brand, rn, 4, '参考答案' from ({PARTS}) e where p_partkey % 9 = 0
        union all
        select p_brand, rn, 5, concat('【答案】 ', case p_partkey % 3 when 0 then 'A' when 1 then 'B' else 'C' end, '【解析】略') from ({PARTS}) f where p_partkey % 2 = 0
    ) x"""

#: The lines of papers once some of them were uploaded again, shortened.
INGESTED_LINES = f"select * from ({PAPER_LINES}) z where not ((file_id like '%1' and pos > 200) or (file_id like '%2' and pos > 100))"

#: LaTeX texts: inline and block formulas, an environment and a graphics reference, blanks that vary.
FORMULA_TEXTS = r"""
    select concat('f', p_partkey) as file_id, p_partkey as n,
        concat('Let $x_{', p_size, '}', case when p_partkey % 2 = 0 then '  + ' else ' + ' end, 'y$ be, $$', chr(10), '\frac{1}{', p_size, '}  ', chr(10), chr(10), ' + z$$ and ',
            case p_partkey % 3 when 0 then concat('\begin{align}a &= ', p_size, chr(10), '  b\end{align}') when 1 then concat('\begin{equation} e_', p_size, ' \end{equation}') else '' end,
            case when p_partkey % 4 = 0 then concat(' \includegraphics[width=3cm]{image', p_size, '}') else '' end) as latex_text
    from part"""

#: Media of papers: a name for each part, of four kinds in turn.
MEDIA = """
    select p_brand as file_id, concat('image', p_partkey, case p_partkey % 4 when 0 then '.png' when 1 then '.jpeg' when 2 then '.WMF' else '.emf' end) as original_filename,
        concat(p_brand, '_image', p_partkey, case p_partkey % 4 when 0 then '.png' when 1 then '.jpeg' when 2 then '.WMF' else '.emf' end) as filename, p_partkey
    from part where p_partkey % 5 <> 0"""

#: Relationships and references to them, by order line.
RELATIONSHIPS = "select concat('o', l_orderkey) as file_id, concat('rId', l_linenumber) as rel_id, concat('media/image', l_partkey, '.png') as target from lineitem where l_linenumber <> 3"
REFERENCES = "select concat('o', l_orderkey) as file_id, concat('rId', l_linenumber) as rel_id, l_suppkey as n from lineitem"

#: Job events: the state of a user's job from what the user did.
JOB_EVENTS = """
    select concat('u', user_id) as file_id, ts, event_id as seq, case event_type when 'error' then 'error' when 'purchase' then 'completed' else 'parsing' end as status,
        case event_type when 'error' then 0 when 'purchase' then 100 else 20 end as progress
    from events"""

#: Steps of jobs: uploads, progress, ends and failures, many of them out of turn.
JOB_STEPS = """
    select concat('u', user_id) as file_id, ts, event_id as seq, case event_type when 'error' then 'error' when 'purchase' then 'completed' else 'parsing' end as status,
        case when event_type = 'error' then 0 when event_type = 'purchase' then 100 when event_id % 3 = 0 then 0 else event_id % 100 end as progress
    from events"""


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of ``sql`` over the tables it names."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem", "events", "documents", "pages", "orders", "conversations") if f"from {t}" in sql}
    escaped = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        escaped = escaped.replace(f"from {t}", f"from {{{t}}}")
    # Spark takes a backslash in a literal as an escape, DuckDB as itself.
    return spark.sql(escaped.replace("\\", "\\\\"), **tables)
