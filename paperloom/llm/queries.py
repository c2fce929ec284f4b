"""The operators as queries over whole tables, named opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import chat, decontaminate, license_scan, line_dedup, mixing, quality, ranked, runs, sharding, simhash, topk, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The digest is taken where texts are read, so that rows are numbered without moving texts.
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    out = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text", crc), map_path=spark.conf.get(sharding.MAP_SETTING, None))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


#: The query's rules, and the host names whose pages it lists.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
LISTED_HOSTS = "(^|[.])(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)[.]"


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in URL_RULES))))
    listed = pages.where(urls.host_of(F.col("url")).rlike(LISTED_HOSTS)).select("url")
    return urls.judge_urls(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict")


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Every tenth document by the hash of its id repeats a stretch of words from some place on; linear in its words."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held = docs.withColumns({"_h": h, "_n": F.when(h % 10 == 0, F.size(words))})
    g = F.floor(F.col("_h") / 10)
    # A text without words has no place to repeat from; a remainder by zero is an error.
    held = held.withColumns({"_a": (g % F.nullif(F.col("_n"), F.lit(0))).cast("int"), "_k": (3 + g % 8).cast("int")})
    p = (1 + F.floor((F.col("_n") - F.col("_a")) / F.col("_k"))).cast("int")
    left = F.col("_n") - F.col("_a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, F.col("_a") + 1, p), F.ceil(left / p).cast("int"))), F.lit(1), left)
    text = F.when(F.col("_n") > 0, F.array_join(F.concat(F.slice(words, F.lit(1), F.col("_a")), tail), " ")).otherwise(F.col("text"))
    return held.withColumn("text", text).drop("_h", "_n", "_a", "_k")


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digest = F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256")
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", digest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_line_dedup, op3_decontaminate, op4_licenses, op5_toxicity, op6_sharding, op7_mixing, op8_chat, op9_simhash, op10_topk, op11_urls, op12_ranked, op13_runs)}


#: Words of a DuckDB string column, as a list.
WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": rf"""
            with lines as (
                select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
                from documents),
            keyed as (
                select *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {BLANKS}) as key from lines),
            repeated as (
                select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
            marked as (
                select k.*, r.key is not null and k.doc_id <> r.keeper as gone from keyed k left join repeated r on k.key = r.key)
            select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
                sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
            from marked group by doc_id""",
        "op3_decontaminate": f"""
            with items as (select distinct item_id, {WORDS.format("text")} as w from benchmark),
            windows as (
                select item_id, least(10, len(w)) as n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) as win
                from items where len(w) > 0),
            docs as (select doc_id, {WORDS.format("text")} as w from documents),
            widths as (select distinct n from windows),
            spots as (
                select doc_id, n, unnest(range(1, len(w) - n + 2)) as first_at, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as win
                from docs, widths where len(w) >= n),
            hits as (select s.doc_id, s.first_at, s.n, x.item_id from spots s join windows x on s.n = x.n and s.win = x.win),
            hit_words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(first_at, first_at + n)) as p from hits) group by doc_id),
            hit_items as (
                select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
                from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
            select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
                sha256(coalesce(i.names, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
            from docs d left join hit_words h on d.doc_id = h.doc_id left join hit_items i on d.doc_id = i.doc_id""",
        "op10_topk": """
            with v as (
                select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
                from embeddings
                where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
            scored as (
                select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
                from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
            ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from scored)
            select query_id, rank, vec_id, score from ranked where rank <= 20""",
        "op11_urls": rf"""
            with rules(host, path, verdict) as (values {", ".join(str(x) for x in URL_RULES)}),
            parsed as (
                select page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
                    list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '{urls.TRACKING}'))) as params
                from pages),
            named as (
                select *, case when contains(url, '://') then rtrim(
                    regexp_replace(host, '{urls.HOST_EXTRAS}', '', 'g') || rtrim(regexp_replace(path, '{urls.PATH_EXTRAS}', ''), '/') || '?' || array_to_string(params, '&'), '?') end as canonical
                from parsed),
            listed as (select distinct canonical from named where regexp_matches(host, '{LISTED_HOSTS}')),
            places as (select distinct host, path from named),
            best as (
                select p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.verdict, length(r.host || r.path)) as verdict
                from places p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
                group by p.host, p.path)
            select n.page_id, n.host, n.path, b.rule, coalesce(b.verdict, case when l.canonical is not null then 'block' else 'allow' end) as verdict
            from named n left join best b on n.host = b.host and n.path = b.path left join listed l on n.canonical = l.canonical""",
        "op12_ranked": f"""
            with docs as (select row_number() over () as r, doc_id, {WORDS.format("text")} as w from documents),
            totals as (select count(*) filter (where len(w) > 0) as n_docs, sum(len(w))::bigint as n_words from docs),
            tf as (select r, t, count(*) as tf from (select r, unnest(w) as t from docs) group by r, t),
            terms as (select distinct item_id, t from (select item_id, unnest({WORDS.format("text")}) as t from benchmark)),
            weights as (
                select t, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as weight
                from tf, totals where t in (select t from terms) group by t),
            parts as (
                select f.r, f.t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * n_docs) // n_words))) as part
                from tf f join weights using (t) join docs d on f.r = d.r, totals),
            scored as (
                select q.item_id, p.r, sum(part)::bigint as score from terms q join parts p on q.t = p.t group by q.item_id, p.r),
            ranked as (
                select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank
                from scored join docs using (r) where score > 0 and doc_id is not null)
            select item_id, rank, doc_id, score from ranked where rank <= 10""",
    }
