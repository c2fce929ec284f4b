"""URL filters, ranked search and periodic runs: SQL, brute force, and the edge cases that their docstrings define."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import queries, ranked, runs, urls
from tests.conftest import duckdb_rows, rows_of

SF = "/root/testdata/sf0.001"


def flat(df, tmp_path, name):
    """A table of one file, as DuckDB and the queries read it."""
    df.write.parquet(f"{tmp_path}/many_{name}")
    duckdb.sql(f"copy (select * from '{tmp_path}/many_{name}/*.parquet') to '{tmp_path}/{name}.parquet'")


URLS = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://com"), (5, "http://com/"), (6, "HTTP://A.COM/x"), (7, "x://www.Example.com/en/1?u=://z"), (8, "x://m.example.com/en/"),
    (9, "x://example.com/en"), (10, "x://example.net/es/q#://"), (11, "x://net/fr/"), (12, "x://a.net/de/"), (13, "x://notnet/es/"), (14, "x://spam-farm.org/a/?utm_x=1&b=2&a=1"),
    (15, "y://www.Spam-Farm.org:80/a?a=1&b=2#f"), (15, "y://www.Spam-Farm.org:80/a?a=1&b=2#f"), (16, "z://me@spam-farm.org./a//index.html?b=2&ref=q&a=1"), (17, "z://other.org/" + "/" * 50_000 + "x"),
    (None, "x://cheap-pills.org/\n?\n"), (18, "x://spam-farm.com/a"), (19, "x://É.Com/É?"), (20, "://com/"), (21, "a://b://c/d"),
]


def test_urls_edge_rows_same_as_sql(spark, tmp_path):
    flat(spark.createDataFrame(URLS, "page_id long, url string"), tmp_path, "pages")
    df = queries.op11_urls(spark, str(tmp_path))
    got = rows_of(df, df.columns)
    assert got == duckdb_rows(queries.oracle_sql()["op11_urls"], str(tmp_path), df.columns)
    verdict = {r[0]: (r[3], r[4]) for r in got}
    assert verdict[4] == (None, "allow") and verdict[5] == ("com/", "allow") and verdict[7] == ("www.example.com/en/", "allow") and verdict[8] == ("example.com/en/", "block")
    assert verdict[13] == (None, "allow") and verdict[11] == ("net/fr/", "block")
    assert {verdict[x] for x in (14, 15, 16)} == {(None, "block")} and verdict[18] == ("com/", "allow")


def test_urls_by_brute_force(spark):
    r = random.Random(3)
    hosts = [".".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(40)]
    rules = list({(r.choice(hosts), "/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 9))) if r.random() < 0.9 else ""): r.choice(["allow", "block"]) for _ in range(60)}.items())
    pages = [(i, f"s://{r.choice(hosts)}/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 12)))) for i in range(3000)]
    hot = [(i, "s://a.b/x") for i in range(3000, 5000)]
    listed = [(u.replace("s://", "t://www."),) for _, u in pages[::50]]
    frame = spark.createDataFrame(pages + hot, "page_id long, url string").withColumns({"verdict": F.lit(1), "_url": F.lit("mine"), "key": F.lit("k")})
    found = urls.judge_urls(frame, spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string"), spark.createDataFrame(listed, "url string"))
    assert found.columns == ["page_id", "url", "_url", "key", "host", "path", "rule", "is_listed", "verdict"]
    names = {u.split("://www.")[1].rstrip("/") for (u,) in listed}
    got = {x["page_id"]: x for x in found.collect()}
    assert len(got) == 5000 and got[7]["_url"] == "mine"
    for i, u in pages + hot:
        host, path = u[4:].split("/", 1)
        path = "/" + path
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        is_listed = u[4:].rstrip("/") in names
        assert (got[i]["rule"], got[i]["is_listed"], got[i]["verdict"]) == (best and best[2], is_listed, best[3] if best else "block" if is_listed else "allow"), u


def test_urls_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "a://b/c", "x")], "page_id long, url string, host string")
    rules, listed = spark.createDataFrame([], "host string, path string, verdict string"), spark.createDataFrame([], "url string")
    assert [tuple(r) for r in urls.judge_urls(pages, rules, listed).collect()] == [(1, "a://b/c", "b", "/c", None, False, "allow")]
    assert urls.judge_urls(pages.limit(0), rules, pages.select("url")).collect() == []


def test_bloom_never_drops_a_key(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    for limit in (1 << 20, 64):  # 64 bytes: two blocks, nearly full
        bloom = urls.BlockedBloom(keys, 5000, limit)
        tested = bloom.tested(spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), "id"), {"held": F.col("key")})
        n = tested.where("held").agg(F.count(F.when(F.col("id") < 5000, 1)), F.count(F.when(F.col("id") >= 5000, 1))).first()
        assert n[0] == 5000 and (n[1] < 150 or limit == 64)


def test_ranked_edge_rows_same_as_sql(spark, tmp_path):
    docs = [(1, "a b c a"), (2, None), (3, ""), (4, "..."), (5, "A b"), (5, "a b"), (6, "Ünï 東京 a"), (None, "a a a b"), (7, "x " * 60_000 + "rare"), (8, "b " * 30)] + [(100 + i, "a b common") for i in range(25)]
    items = [(1, "a b"), (2, None), (3, ""), (4, "zzz"), (5, "東京 x rare"), (6, "A B c common"), (6, "again rare"), (7, "common a b")]
    flat(spark.createDataFrame(docs, "doc_id long, text string"), tmp_path, "documents")
    flat(spark.createDataFrame(items, "item_id long, text string"), tmp_path, "benchmark")
    df = queries.op12_ranked(spark, str(tmp_path))
    assert rows_of(df, df.columns) == duckdb_rows(queries.oracle_sql()["op12_ranked"], str(tmp_path), df.columns)


def test_ranked_blocks_and_string_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", f"w{i % 7} w{i % 5} w{i % 3}", i) for i in range(200)], "doc_id string, text string, rank int")
    items = spark.createDataFrame([(f"i{i}", f"w{i % 7} w{i % 4} w{i}") for i in range(30)], "item_id string, text string")
    whole, cut = (sorted(map(tuple, ranked.rank_documents(docs, items, block_bytes=n).collect())) for n in (1 << 20, 60))
    assert whole == cut and whole and {r[0] for r in whole} == {f"i{i}" for i in range(30)}
    assert ranked.rank_documents(docs.limit(0), items).collect() == [] and ranked.rank_documents(docs, items.limit(0)).collect() == []


def test_sharing_dag_sums_to_the_items():
    r = random.Random(5)
    base = [r.sample(range(40), 12) for _ in range(4)]
    items = [sorted(set(r.choice(base) + r.sample(range(60), 5))) for _ in range(80)]
    sets = ranked.SharedSets(items, 60)
    terms = [Counter({i: 1}) for i in range(60)]
    for a, b in sets.parts:
        terms.append(terms[a] + terms[b])
    for item, nodes in zip(items, sets.items, strict=True):
        assert sum((terms[x] for x in nodes), Counter()) == Counter(item)
    assert sets.additions < sum(len(x) - 1 for x in items) / 2
    assert all(max(sets.parts[a - 60 : b - 60].reshape(-1)) < a for a, b in sets.levels)


def runs_by_force(w, least, exponent):
    n, out = len(w), set()
    for q in range(1, n // exponent + 1):
        i = q
        while i < n:
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, size = i - q, j - i + q
            if size >= max(least, exponent * q) and not any(q % p == 0 and all(w[x] == w[x - p] for x in range(s + p, j)) for p in range(1, q)):
                out.add((s, size, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (3, 2), (5, 3)])
def test_runs_by_brute_force(least, exponent):
    r = random.Random(least)
    for _ in range(600):
        w, k, n = [], r.choice([1, 2, 2, 3, 6]), r.randint(0, 70)
        while len(w) < n:
            w += [r.randrange(k) for _ in range(r.randint(1, 6))] * r.choice([1, 1, r.randint(1, 8)])
        force = runs_by_force(w, least, exponent)
        assert runs.find_runs(np.array(w, np.int64), least, exponent) == force
        assert {(s, q): s + n - 1 for s, n, q in force} == runs.runs_of(w, least, exponent)


def expected_runs(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = runs_by_force(w, 6, 4)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(found), *first, sha("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op13_by_brute_force(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * j) % 9}" for j in range(i % 60))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "x\x0by\x0cz"), (None, "a b " * 9), (1004, "one two\u00a0two " * 200), (1005, "ha " * 500), (1006, "Zwei  drei\r\n" * 3 + "東京 " * 7)]
    rows += [(1004, "one two\u00a0two " * 200), *((i, "q w e r t y " * 20) for i in range(2000, 2040))]
    flat(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path, "documents")
    df = queries.op13_runs(spark, str(tmp_path))
    got = rows_of(df, df.columns)
    assert got == sorted((expected_runs(*x) for x in rows), key=repr)
    assert sum(x[1] > 0 for x in got) > 60


def test_op13_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    few = {r["doc_id"]: expected_runs(*r) for r in docs.collect() if len(r["text"]) < 4000}
    df = queries.op13_runs(spark, SF)
    got = {r["doc_id"]: tuple(r) for r in df.collect()}
    assert len(got) == docs.count() and all(got[k] == v for k, v in few.items()) and len(few) > 100


def test_runs_columns_and_long_texts(spark):
    docs = spark.createDataFrame([("a", "x y " * 100_000, 1), ("b", " ".join(map(str, range(300_000))), 2), ("c", None, 3)], "doc_id string, text string, start int")
    got = {r["doc_id"]: r for r in runs.periodic_runs(docs).collect()}
    assert got["a"]["collapsed_text"] == "x y" and (got["a"]["start"], got["a"]["length"], got["a"]["period"], got["a"]["exponent_milli"]) == (0, 200_000, 2, 100_000_000)
    assert got["b"]["n_runs"] == 0 and got["b"]["collapsed_text"].endswith("299999") and (got["c"]["n_words"], got["c"]["collapsed_text"]) == (0, "")
    assert runs.periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, 6, 1)
