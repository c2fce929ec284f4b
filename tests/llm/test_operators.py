"""The training-data operators: brute force, planted cases, and the edge cases that their docstrings define."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import chat, decontaminate, license_scan, line_dedup, mixing, quality, queries, sharding, simhash, topk, toxicity
from tests.conftest import duckdb_rows, rows_of

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "The same footer line stands here"
EDGE = [
    (1, None, "en", "a", 0), (2, "", None, None, None), (3, " \n\t\n", "en", "a", 1), (4, f"{LINE}\nown words of four", "en", "b", 1),
    (5, f" {LINE.upper()}\r\nother words of five", "en", "b", 1), (6, f"x\n{LINE}\t\n{LINE}", "de", "b", 1), (7, "one two three four five " * 300, "en", "c", 1),
    (7, "one two three four five " * 300, "en", "c", 1), (8, "Ünïcode wörds çome 東京 here and there", None, "c", 1), (9, "MIT License, CC BY 4.0; mit license", "en", None, 1),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def clashing(df, *names):
    return df.withColumns({n: F.lit("x") for n in names})


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    assert rows_of(df, df.columns) == duckdb_rows(queries.oracle_sql()[name], SF, df.columns)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op3_decontaminate"])
def test_edge_rows_same_as_sql(spark, edge, tmp_path, name):
    edge.dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(1, "four five one two"), (2, None), (3, ""), (3, ""), (4, "wörds çOME")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    import duckdb

    for t in ("documents", "benchmark"):
        duckdb.sql(f"copy (select * from '{tmp_path}/{t}.parquet/*.parquet') to '{tmp_path}/flat_{t}.parquet'")
    (tmp_path / "flat").mkdir()
    for t in ("documents", "benchmark"):
        (tmp_path / f"flat_{t}.parquet").rename(tmp_path / f"flat/{t}.parquet")
    df = queries.queries()[name](spark, f"{tmp_path}/flat")
    assert rows_of(df, df.columns) == duckdb_rows(queries.oracle_sql()[name], f"{tmp_path}/flat", df.columns)


def test_quality_is_modified_kneser_ney(spark):
    texts = ["abracadabra banana", "bandana abra", None, ""] * 2
    frame = spark.createDataFrame([(x,) for x in texts], "text string")
    table, shards, rest = quality.train(frame, frame)
    full = Counter()
    for x in texts:
        if x:
            s = quality.symbols(x.encode(), table).tolist()
            full.update(tuple(s[i : i + 4]) for i in range(len(s) - 3))
    counts = {4: full}
    for k in (3, 2, 1):  # continuation counts
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discounts(c):
        n = [0] + [sum(v == i for v in c.values()) for i in range(1, 5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        return [0.0] + [min(i, max(quality.LEAST_CUT * i, i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i)) for i in (1, 2, 3)]

    cuts = {k: discounts(c) for k, c in counts.items()}

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / quality.KINDS
        after = [(g, v) for g, v in counts[k].items() if g[:-1] == gram[:-1]]
        total = sum(v for _, v in after)
        if not total:
            return p(gram[1:])
        cut = sum(cuts[k][min(v, 3)] for _, v in after)
        own = counts[k].get(gram, 0)
        return (own - cuts[k][min(own, 3)]) / total + cut / total * p(gram[1:])

    scorer = quality.Scorer(table, shards, rest)
    for x in (b"abra", b"zebra banana", b"", b"bbbb q"):
        s = quality.symbols(x, table).tolist()
        assert scorer.log_probability(x)[1] == pytest.approx(sum(math.log(p(tuple(s[i : i + 4]))) for i in range(len(s) - 3)), rel=1e-4)


def test_word_pairs_by_brute_force(spark):
    good = ["the cat sat on the mat", "The dog sat on a cat", None, "", "a dog 12 a dog 34", "the cat " * 40] * 2
    other = ["the dog sat on the zebra ##", "", "unseen wordings only " + "x" * 200, "the cat", "a\0b"]
    frame = lambda x: spark.createDataFrame([(i, t) for i, t in enumerate(x)], "doc_id long, text string")
    model = quality.train_words(frame(good))
    known, scorer = model[0], quality.Scorer(*model[1])
    assert set(known) == {w for t in good if t for w in quality.split(t.encode())}
    number = {w: i for i, w in enumerate(known, 1)}

    def ids(text):
        return [0, *(number.get(w) or quality.KNOWN + zlib.crc32(w) % quality.RARE for w in quality.split(text)), 0]

    pairs = Counter(p for t in good for p in itertools.pairwise(ids((t or "").encode())))
    before = Counter(b for _, b in pairs)

    def cuts(c):
        n = [0] + [sum(v == i for v in c.values()) for i in range(1, 5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        return [0.0] + [min(i, max(quality.LEAST_CUT * i, i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i)) for i in (1, 2, 3)]

    d2, d1 = cuts(pairs), cuts(before)

    def p(a, b):
        n = sum(before.values())
        one = (before[b] - d1[min(before[b], 3)]) / n + sum(d1[min(v, 3)] for v in before.values()) / n / quality.NUMBERS
        after = [v for (x, _), v in pairs.items() if x == a]
        if not after:
            return one
        own = pairs[a, b]
        return (own - d2[min(own, 3)]) / sum(after) + sum(d2[min(v, 3)] for v in after) / sum(after) * one

    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 97)  # tasks that only pass documents on
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    got = {r["doc_id"]: r for r in quality.perplexities(frame(good + other).repartition(3), model).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", was)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(good) + len(other)
    for i, t in enumerate(good + other):
        w = quality.split((t or "").encode())
        spelt = sum(scorer.log_probability(x)[1] + math.log(quality.RARE) for x in w if x not in number)
        assert got[i]["log_prob"] == pytest.approx(sum(math.log(p(*x)) for x in itertools.pairwise(ids((t or "").encode()))) + spelt, rel=1e-4, abs=1e-4)
        assert got[i]["n_symbols"] == len(b" ".join(w)) + 1


def test_long_words_are_trained_whole(spark, monkeypatch):
    monkeypatch.setattr(quality, "HELD", 1000)  # several batches of words a task
    runs = ["這是一段沒有空格的中文文本" * 9, "這是一段沒有空格的中文文本" * 9 + "結尾不同", "x" * 60 + "token/with/a/tail?of=it&more", "ประโยคภาษาไทยยาวไม่มีช่องว่าง" * 5]
    texts = [f"short words {r} end" for r in runs] * 2 + [None, "", "z" * (quality.LONGEST - 1), "z" * quality.LONGEST]
    words = {w for t in texts if t for w in quality.split(t.encode())}
    frame = lambda x: spark.createDataFrame([(t,) for t in x], "text string")
    counted = {bytes(r["text"]): r["n"] for r in quality.word_counts(frame(texts).repartition(3)).collect()}
    assert counted == Counter(w for t in texts if t for w in quality.split(t.encode()))
    known, (table, shards, rest), *_ = quality.train_words(frame(texts))
    assert set(known) == {w for w in words if len(w) < quality.LONGEST}
    whole = quality.train(frame(sorted(w.decode() for w in words)), frame(sorted(w.decode() for w in words)))
    got, want = quality.Scorer(table, shards, rest), quality.Scorer(*whole)
    assert table == whole[0] and np.allclose(got.logp, want.logp)


def test_packed_pairs():
    rng = np.random.default_rng(3)
    pair = np.unique(rng.integers(0, 1 << 32, 5000, dtype=np.uint64))
    n = rng.integers(1, 1 << 40, len(pair))
    parts = [quality.unpack_counts(b) for _, _, b in quality.by_shard(pair, 7, *quality.halves(n))]
    back = dict(zip(np.concatenate([p for p, _ in parts]).tolist(), np.concatenate([c for _, c in parts]).tolist(), strict=True))
    assert len(parts) == 7 and back == dict(zip(pair.tolist(), n.tolist(), strict=True))


def test_probabilities_are_proper():
    rng = np.random.default_rng(5)
    for case in range(60):
        n = [0, *rng.integers(0, (3, 50, 900)[case % 3], 4).tolist()]
        d = quality.discounts_from([0, 546, 80, 58, 57] if case == 0 else n)
        assert all(quality.LEAST_CUT * i <= d[i] <= i for i in (1, 2, 3))
        lower = rng.dirichlet(np.ones(12))
        for counts in (rng.integers(0, 5, (9, 12)), rng.integers(3, 9, (9, 12)) * (rng.random((9, 12)) < 0.3), np.zeros((9, 12), np.int64)):
            p = quality.interpolated(counts, d, lower)
            assert np.isfinite(np.log(p)).all() and np.allclose(p.sum(axis=1), 1)


def test_word_pair_probabilities_sum_to_one(monkeypatch):
    monkeypatch.setattr(quality, "NUMBERS", 50)
    rng = np.random.default_rng(6)
    for high in (2, 4, 40):  # from all singletons to none
        c = rng.integers(0, high, (50, 50)) * (rng.random((50, 50)) < 0.3) + (0 if high < 40 else 3 * (rng.random((50, 50)) < 0.1).astype(int))
        c[7] = 0
        sums = [(i, int(c[i].sum()), int((c[i] > 0).sum()), *(int((c[i] == k).sum()) for k in range(1, 5)), int((c[:, i] > 0).sum())) for i in range(50)]
        formula = quality.Pairs(sums)
        logp = formula.log_probability(np.arange(2500), c.reshape(-1)).reshape(50, 50)
        assert np.isfinite(logp).all() and np.allclose(np.exp(logp).sum(axis=1), 1)


def test_quality_of_documents_never_seen(spark):
    big = "/root/testdata/sf0.1"
    marked = spark.read.parquet(f"{big}/labels.parquet")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    out = quality.classify_quality(spark.read.parquet(f"{big}/documents.parquet"), marked.where(even)).cache()
    assert out.where("isnan(perplexity) or perplexity < 1 or log_prob > 0").count() == 0
    unseen = out.join(marked.where(~even), "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int"))).collect()
    out.unpersist()
    assert dict(unseen)[1] >= 0.95 and dict(unseen)[0] <= 0.2


def test_quality_edges(spark, edge, docs, labels):
    out = quality.classify_quality(clashing(edge, "perplexity", "keep"), spark.createDataFrame([(4, 1), (4, 0), (None, 1)], "doc_id long, quality int"))
    assert out.count() == len(EDGE) and [r["trusted"] for r in out.where("doc_id = 4").collect()] == [True]
    none = quality.classify_quality(edge, labels.limit(0))
    assert none.where("keep").count() == len(EDGE)
    assert quality.classify_quality(edge.limit(0), labels).count() == 0
    merged = quality.classify_quality(edge, spark.createDataFrame([(4, 1), (9, 1)], "doc_id long, quality int"), broadcast_ids=0)
    sent = quality.classify_quality(edge, spark.createDataFrame([(4, 1), (9, 1)], "doc_id long, quality int"))
    assert rows_of(merged, ["doc_id", "log_prob", "keep"]) == rows_of(sent, ["doc_id", "log_prob", "keep"])
    good = quality.classify_quality(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int"))).collect()
    assert dict(good)[1] > 0.95 and dict(good)[0] < 0.5


def test_line_dedup_edges(spark, edge):
    out = line_dedup.dedup_lines(clashing(edge, "n_lines", "_dropped2")).collect()
    at = {r["doc_id"]: r for r in out}
    assert len(out) == len(EDGE) and (at[1]["n_lines"], at[1]["kept_text"]) == (1, "")
    assert at[4]["kept_text"] == "own words of four" and at[5]["kept_text"] == "other words of five" and at[6]["n_dropped"] == 0
    assert line_dedup.dedup_lines(edge.limit(0)).count() == 0
    few = line_dedup.dedup_lines(edge, batches=7, fanout=2)
    assert rows_of(few, ["doc_id", "n_dropped"]) == sorted(((r["doc_id"], r["n_dropped"]) for r in out), key=repr)


def test_runs_are_joined_where_they_lie(spark, docs):
    """A batch's join shuffles its own lines only; the runs, compacted or not, give what plain counting gives."""
    lines = line_dedup.lines_of(docs.withColumn("text", F.concat("text", F.lit("\nthis line stands in the documents of number "), F.col("doc_id") % 17)), 20)
    want = lines.groupBy("h1", "h2").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where("n >= 3")
    for fanout, levels in ((2, [0, 0, 1]), (3, [1, 1]), (5, [4])):
        store = line_dedup.LineRuns(spark, fanout=fanout, min_docs=3)
        for part in range(4):
            batch = lines.where(F.pmod("doc_id", F.lit(4)) == part)
            plan = store.news(batch)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 2 and plan.count("SortMergeJoin") == plan.count("Bucketed: true") == len(store.runs())
            store.add(batch)
        assert [len(level) for level in store.levels] == levels
        found = rows_of(store.repeated(), ["h1", "h2", "keeper"])
        assert len(found) >= 17 and found == rows_of(want, ["h1", "h2", "keeper"])
        names = store.runs()
        store.forget()
        assert not any(spark.catalog.tableExists(name) for name in names)


def test_hot_lines_give_the_same(spark):
    lines = spark.range(300).select(F.lit(1).cast("long").alias("h1"), (F.col("id") % 7).alias("h2"), "id")
    repeated = lines.groupBy("h1", "h2").agg(F.max("id").alias("keeper"), F.count("*").alias("n_docs"))
    found = {n: rows_of(line_dedup.with_keeper(lines, repeated, n), ["h1", "h2", "id", "keeper"]) for n in (1, 7, 1000)}
    assert found[1] == found[7] == found[1000] and len(found[1]) == 300


def test_decontamination_in_blocks_and_spans(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = decontaminate.find_benchmark(docs, bench)
    assert rows_of(whole, ["doc_id", "n_hit", "items"]) == rows_of(decontaminate.find_benchmark(docs, bench, block_bytes=2000), ["doc_id", "n_hit", "items"])
    cut = decontaminate.decontaminate(docs, bench, remove="spans")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert rows_of(whole, ["doc_id", "n_hit", "items"]) == rows_of(decontaminate.find_benchmark(docs, bench, block_bytes=500), ["doc_id", "n_hit", "items"])  # more blocks than are chained
    unnamed = spark.createDataFrame([(None, "plain words")], "item_id long, text string")
    row = decontaminate.find_benchmark(spark.createDataFrame([(1, "Some plain, words!")], "doc_id long, text string"), unnamed).first()
    assert (row["n_words"], row["n_hit"], row["items"]) == (3, 2, [])
    assert decontaminate.find_benchmark(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(clashing(docs.limit(0), "items"), bench).count() == 0


def test_license_places_by_brute_force(spark, edge, docs):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    both = docs.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    want = []
    for r in both.collect():
        w = word.findall((r["text"] or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
        at = sorted((i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.encode().split())
        want.append((r["doc_id"], len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, sorted({x for _, x in at})))
    got = license_scan.scan_licenses(clashing(both, "score"), ["doc_id"])
    assert rows_of(got, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]) == sorted(want, key=repr)
    fuzzy = spark.createDataFrame([(1, "Code relesed undr the MIT  licence!")], "doc_id long, text string")
    row = license_scan.scan_licenses(fuzzy).first()
    assert row["labels"] == ["mit"] and row["n_base"] == 0 and row["spans"][0]["edits"] == 3 and 0 < row["score"] < 1


def test_near_miss_licenses_and_repeated_notices(spark):
    scanner = license_scan.Scanner()
    for other in ("bsd", "gpl", "isc", "epl", "w3c", "zlib", "permit", "mitre"):
        assert scanner.spans(f"released under the {other} license") == []
    gnu = "under the terms of the gnu {} general public license".format
    assert [x[0] for x in scanner.spans(gnu("affero"))] == ["agpl"] and [x[0] for x in scanner.spans(gnu("lesser"))] == ["lgpl"] and scanner.spans(gnu("library")) == []
    assert scanner.spans("permission to use copy and or distribute this software for any purpose") == []
    for label, notice in license_scan.NOTICES:
        typo = notice[:1] + notice[2:]
        for a, b in ((notice, notice), (typo, notice), (notice, typo), (typo, typo)):
            n = len(a) + 1
            got = sorted({x[1:4] for x in scanner.spans(f"{a} {b}") if x[0] == label and x[4] == len(notice)})
            assert [(x, y) for x, y, _ in got] == [(0, len(a)), (n, n + len(b))] and [e for *_, e in got] == [int(a is typo), int(b is typo)]
    many = " ".join(["any person obtaining", "released under the mit license"] * 200)
    assert len([x for x in scanner.spans(many) if x[0] == "mit" and x[3] == 0]) == 200
    rows = spark.createDataFrame([(1, "Released under the BSD license"), (2, "Released under the MIT License. Released under the MIT license!")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(rows).collect()}
    assert (got[1]["labels"], got[1]["score"]) == ([], 0.0) and [(x["first"], x["end"]) for x in got[2]["spans"]] == [(0, 30), (31, 61)]


def test_toxicity(spark, edge):
    big = "/root/testdata/sf0.1"
    marked = spark.read.parquet(f"{big}/labels.parquet")
    documents = spark.read.parquet(f"{big}/documents.parquet")
    found = toxicity.score_toxicity(documents, marked).join(marked, "doc_id").join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    hit = Counter((r["lang"], r["toxic"], r["predicted"]) for r in found)
    for lang in ("de", "en", "es", "fr"):  # recall and precision of documents whose labels were never seen
        assert hit[lang, 1, 1] >= 0.85 * (hit[lang, 1, 0] + hit[lang, 1, 1]) and hit[lang, 0, 1] <= 0.05 * hit[lang, 0, 0]
    caught, missed, false = (sum(n for (_, t, p), n in hit.items() if (t, p) == x) for x in ((1, 1), (1, 0), (0, 1)))
    assert caught >= 0.9 * (caught + missed) and caught >= 0.9 * (caught + false)
    none = toxicity.score_toxicity(edge, marked.limit(0))
    assert none.count() == len(EDGE) and none.where("score = 0 and predicted = 0").count() == len(EDGE)
    assert toxicity.score_toxicity(edge.limit(0), marked).count() == 0
    kept = toxicity.drop_toxic(clashing(edge, "features", "score"), marked.limit(0))
    assert kept.count() == len(EDGE) and kept.columns == [*edge.columns, "features", "score"]


def test_toxicity_of_repeated_long_and_null_rows(spark):
    rows = [(i, f"you {'dreck' if i % 3 == 0 else 'pretty'}sack word{i % 11} and more {i}") for i in range(400)]
    marked = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    extra = [(None, rows[3][1]), (None, None), (7, rows[7][1]), (900, "plain words " * 500_000 + "drecksack"), (901, "!!!??? D.r.e.c.k")]
    frame = spark.createDataFrame(rows + extra, "doc_id long, text string").coalesce(1)
    scored = toxicity.score_toxicity(frame, marked).collect()
    assert len(scored) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    assert all(r["predicted"] == (r["doc_id"] % 3 == 0) for r in scored if r["doc_id"] is not None and r["doc_id"] < 400)
    assert len({r["score"] for r in scored if r["doc_id"] == 7}) == 1


def test_lexicons_by_brute_force(spark):
    texts = [(2 + i % 3, float(i % 4 == 0), f"{'Grob' if i % 4 == 0 else 'fein'}heit{i % 5} the same, wörter{i % 7} ß") for i in range(120)]
    got = toxicity.learn_lexicons(spark.createDataFrame(texts, "fold int, label double, text string").repartition(3), (2, 3, 4))
    for out in (0, 2, 3, 4):
        used = [(label, toxicity.entries(t.encode())) for f, label, t in texts if f != out]
        n = Counter(label for label, _ in used)
        bad, other = (Counter(e for label, found in used if label == x for e in found) for x in (1.0, 0.0))
        assert got[out] == toxicity.lexicon_weights([(e, bad[e], other[e]) for e in bad], n[1.0], n[0.0])
        assert got[out] and all(e.startswith(b" gro") for e in got[out])


def test_sharding(spark, edge, docs):
    both = docs.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    out = sharding.shard_documents(both)
    rows = out.collect()
    places = defaultdict(list)
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 1 and 0 <= r["shard"] < 16
        places[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    again = sharding.shard_documents(both.repartition(5))
    assert rows_of(out, ["doc_id", "shard", "slot"]) == rows_of(again, ["doc_id", "shard", "slot"])
    assert sharding.shard_documents(edge.limit(0)).count() == 0


def test_slot_maps(spark, tmp_path):
    sizes = {s: 1 + s % 13 * 10 for s in range(256)}
    first = sharding.SlotMap.initial(8, 256)
    even, grown = first.rebalanced(sizes), first.grown(sizes)
    load = Counter()
    for s, b in sizes.items():
        load[even.shard_of[s]] += b
    assert max(load.values()) - min(load.values()) <= 20
    assert {grown.shard_of[s] for s in grown.moved(first)} == {8}
    first.save(spark, f"{tmp_path}/map")
    even.save(spark, f"{tmp_path}/map")
    assert sharding.SlotMap.load(spark, f"{tmp_path}/map") == even and sharding.SlotMap.load(spark, f"{tmp_path}/map", 0) == first


def test_stored_map_is_edited(spark, docs, tmp_path):
    path = f"{tmp_path}/map"
    few = docs.select("doc_id", "text").where("doc_id % 3 > 0")
    grown = docs.select("doc_id", "text").unionByName(spark.range(200).select((F.col("id") + 90_000).alias("doc_id"), F.repeat(F.lit("new words "), (F.col("id") % 40).cast("int")).alias("text")))
    first = {r["doc_id"]: r for r in sharding.shard_documents(few, 4, 64, path).collect()}
    second = sharding.shard_documents(grown, 4, 64, path).collect()
    old, new = (sharding.SlotMap.load(spark, path, v) for v in (1, 2))
    sizes = Counter()
    for r in second:
        sizes[r["vslot"]] += r["size"]
    assert new == old.rebalanced(sizes) and new != sharding.SlotMap(2, sharding.SlotMap.initial(4, 64).rebalanced(sizes).shard_of, 4)
    moved = set(new.moved(old))
    assert {r["map_version"] for r in first.values()} == {1} and {r["map_version"] for r in second} == {2}
    assert all((r["shard"] != first[r["doc_id"]]["shard"]) == (r["vslot"] in moved) for r in second if r["doc_id"] in first)
    assert {r["shard"] for r in sharding.shard_documents(grown, 5, 64, path).collect()} == set(range(5))
    with pytest.raises(ValueError, match="5 shards"):
        sharding.shard_documents(grown, 4, 64, path)


def test_mixing(spark, edge, docs):
    both = docs.select("doc_id", "text", "source").unionByName(edge.select("doc_id", "text", "source"))
    out = mixing.mix(clashing(both, "target"))
    rows = out.collect()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    total, largest, taken, target = Counter(), Counter(), Counter(), {}
    for r in rows:
        n = len(word.findall(r["text"] or ""))
        assert r["size"] == n and r["taken"] in (0, n, 2 * n)
        total[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, full = {}, set()
    while True:
        rest, open_ = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full), [s for s in order if s not in full]
        want = {s: 2.0 * total[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in order}
        if not (over := {s for s in open_ if want[s] > 2 * total[s]}):
            break
        full |= over
    for s in order:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 2 * largest[s]
    assert rows_of(out, ["doc_id", "taken"]) == rows_of(mixing.mix(both.repartition(5)), ["doc_id", "taken"])
    assert mixing.mix(edge.limit(0)).count() == 0
    assert mixing.mixed_rows(both).columns == both.columns


def test_chat_links(spark):
    talk = [
        (1, 1, "user", "Hello  there"), (1, 2, "assistant", "> hello there\nHi"), (1, 3, "user", ">> hello there\n> Hi\nThanks"),
        (1, 4, None, "> never said\nEh"), (1, 5, "user", None), (1, 5, "user", None), (2, 1, "user", "> hello there\nx"), (None, 1, "user", "Hello there"),
    ]
    frame = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(clashing(frame, "body", "thread"))
    rows = {(r["conv_id"], r["turn"]): r for r in out.collect()}
    assert out.count() == len(talk) and rows[1, 2]["reply_to"] == 1 and rows[1, 3]["reply_to"] == 2 and rows[1, 3]["thread"] == 1
    assert rows[1, 3]["n_linked"] == 2 and rows[1, 3]["formatted"] == "<|user|>\nThanks"
    assert rows[1, 4]["reply_to"] is None and rows[1, 4]["n_quotes"] == 1 and rows[2, 1]["thread"] == 1
    assert chat.format_chat(frame.limit(0)).count() == 0


def test_chat_links_parts_and_quotes_of_quotes(spark):
    talk = [
        (1, 1, "first one\nfirst two\n\nsecond part"), (1, 2, "> first two\nto a line"), (1, 3, "> first one\n> first two\nto a paragraph"),
        (1, 4, "> first one\n> first two\nyes\n> second part\nno"), (1, 5, "top\n> second part\nbottom"), (1, 6, "> top\n>> second part\n> bottom\nto all of it"),
        (1, 7, "> yes\n>> second part\n\n> no\nto two answers"), (1, 8, "> first one\n> first two\n\n> second part\nblank line without a mark"),
        (1, 9, "> first\npart of a line"), (1, 10, "common\nlast words"), (1, 11, "> common"), (1, 12, "common"), (1, 13, "> common\nwhole first"),
        (2, 1, "> first two"), (2, 2, "one"), (2, 3, "two"), (2, 4, "> one\nA\n> two\nB"), (2, 4, "> two"), (2, 5, "> \n>>\n\n>"),
    ]
    frame = spark.createDataFrame([(c, t, "user", x) for c, t, x in talk], "conv_id long, turn long, role string, text string")
    got = chat.format_chat(frame).collect()
    assert len(got) == len(talk)
    reply = {(r["conv_id"], r["turn"]): (r["reply_to"], r["n_linked"]) for r in got}
    assert [reply[1, t] for t in range(1, 10)] == [(None, 0), (1, 1), (1, 1), (1, 1), (1, 1), (5, 2), (4, 2), (1, 1), (None, 0)]
    assert [reply[1, t] for t in (11, 13)] == [(10, 1), (12, 1)]
    assert [reply[2, t] for t in (1, 4, 5)] == [(None, 0), (3, 2), (None, 0)]
    row = {r["turn"]: r for r in got if r["conv_id"] == 1}
    assert row[6]["thread"] == 1 and (row[4]["body"], row[6]["n_quotes"], row[8]["n_quotes"]) == ("yes\nno", 3, 1)


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("shard", [simhash.SHARD, 8])
def test_simhash_by_brute_force(spark, edge, docs, shard):
    both = docs.select("doc_id", "text").unionByName(edge.select((F.col("doc_id") + 50_000).alias("doc_id"), "text")).unionByName(docs.where("doc_id % 9 = 0").select((F.col("doc_id") + 10_000).alias("doc_id"), F.concat(F.col("text"), F.lit(" tail")).alias("text")))
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in both.collect()]
    up = {d: d for d, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, f), (b, g) in itertools.combinations(rows, 2):
        if (f ^ g).bit_count() <= 2:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    want = sorted(((d, f"{f:016x}", root(d)) for d, f in rows), key=repr)
    assert rows_of(simhash.near_groups(both, shard=shard), ["doc_id", "fingerprint", "component_id"]) == want


def test_one_row_of_each_group_of_near_copies(spark):
    same = "words that are said again and again in this text"
    rows = [(1, same, "x"), (1, same, "x"), (1, "altogether different sentences stand in here today", "y"), (2, same, "z"), (3, "altogether different sentences stand in here today", "z"), (4, None, "n"), (5, "", "n"), (None, same, "k"), (None, same, "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, keep string")
    kept = Counter(tuple(r) for r in simhash.drop_near_copies(frame.repartition(4)).collect())
    prints = {(d, t): brute_fingerprint(t) for d, t, _ in rows}
    assert (prints[1, same] ^ prints[3, rows[4][1]]).bit_count() > 2
    # Both groups have 1 as their smallest id; of each, one row of that id stays.
    assert kept == Counter([(1, same, "x"), (1, rows[2][1], "y"), (4, None, "n"), (None, same, "k"), (None, same, "k")])
    for d in (simhash.drop_near_copies(frame.limit(0)), simhash.drop_near_copies(frame.where("doc_id is null").limit(0))):
        assert d.columns == frame.columns and d.count() == 0


CLASHES = ["_doc", "_hash", "_dropped", "epochs", "cut", "end_bucket", "_key", "_bucket", "_hits", "fp", "first", "n", "text_hash", "component_id", "row", "shard_key", "_carried_0", "_source", "word", "features"]


def test_clashing_names_are_carried(spark, edge, labels):
    """No column of an input is lost or confused with an operator's own, whatever its name."""
    bench = spark.createDataFrame([(i, f"one two three four five {'one two three four five ' * (i % 3)}tail{i}") for i in range(30)], "item_id long, text string")
    frame = edge.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in CLASHES})
    results = {
        "lines": line_dedup.dedup_lines(frame), "bench": decontaminate.find_benchmark(frame, bench, block_bytes=300), "spans": decontaminate.decontaminate(frame, bench, "spans"),
        "mix": mixing.mix(frame, weight=F.length("_doc") + F.length("cut")), "rows": mixing.mixed_rows(frame), "shard": sharding.shard_documents(frame), "near": simhash.drop_near_copies(frame),
        "clean": decontaminate.decontaminate(frame, bench), "toxic": toxicity.drop_toxic(frame, labels.limit(0)),
    }
    for name, out in results.items():
        assert out.columns[: len(frame.columns)] == frame.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in CLASHES), name


def test_simhash_edges(spark, edge):
    assert simhash.near_groups(edge.limit(0)).count() == 0
    kept = simhash.drop_near_copies(clashing(edge, "fp", "component_id"))
    assert kept.columns == [*edge.columns, "fp", "component_id"] and kept.where("doc_id in (1, 2, 3)").count() == 1


def test_close_pairs_connect_as_all_pairs_do():
    rng = np.random.default_rng(1)
    points = np.unique(np.concatenate([rng.integers(0, 2**63, 300).astype(np.uint64), np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))]))
    rows, columns = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    want = simhash.group_labels(len(points), np.stack((rows, columns), 1))
    assert np.array_equal(simhash.group_labels(len(points), simhash.close_pairs(points, 2)), want)
    # Dealt over homes, the pairs found with each home's points connect the same.
    home = rng.integers(0, 5, len(points))
    links = np.concatenate([simhash.close_pairs(points, 2, np.flatnonzero(home == h), leaf) for h, leaf in zip(range(5), (64, 64, 8, 8, 1))])
    assert np.array_equal(simhash.group_labels(len(points), links), want)


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 5), 1.0]) for i in range(60)] + [(60, [nan, 1.0]), (61, None), (62, [inf, 0.0]), (63, [None, 1.0]), (None, [1.0, 1.0]), (80, [-3.5, 0.3])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(clashing(v, "score", "rank"), v.where("vec_id % 20 = 0"), block=2)
    ok = {i: [math.floor(64 * y) for y in x] for i, x in rows if i is not None and x and all(y is not None and math.isfinite(np.float32(y)) for y in x)}
    want = []
    ok[80] = [math.floor(64 * float(np.float32(y))) for y in (-3.5, 0.3)]
    for q in (i for i in ok if i % 20 == 0):
        scored = sorted((-(sum(a * b for a, b in zip(ok[q], ok[c], strict=True))), c) for c in ok if c != q)[:20]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(scored, 1)]
    assert rows_of(got, ["query_id", "rank", "vec_id", "score"]) == sorted(want, key=repr)
    assert topk.top_k(v.limit(0), v).count() == 0 and topk.top_k(v, v.limit(0)).count() == 0


def test_top_k_with_an_odd_length_among_many_rows(spark):
    rows = [(i, [float(i * 37 % 101), float(i % 7)] if i not in (1500, 2100) else [] if i == 1500 else [1.0, 2.0, 3.0]) for i in range(3000)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = topk.top_k(v, v.where("vec_id in (7, 2500)"))
    ok = {i: [int(64 * y) for y in x] for i, x in rows if len(x) == 2}
    want = []
    for q in (7, 2500):
        scored = sorted((-sum(a * b for a, b in zip(ok[q], ok[c], strict=True)), c) for c in ok if c != q)[:20]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(scored, 1)]
    assert rows_of(got, ["query_id", "rank", "vec_id", "score"]) == sorted(want, key=repr)


def test_pipeline_by_brute_force(spark, docs, labels):
    import corpus_pipeline

    toxic = {r["doc_id"] for r in toxicity.score_toxicity(docs, labels).where("predicted = 1").collect()}
    left = docs.where(~F.col("doc_id").isin(list(toxic)))
    groups = {r["component_id"] for r in simhash.near_groups(left).collect()}
    left = left.where(F.col("doc_id").isin(list(groups)))
    left = decontaminate.find_benchmark(left, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit = 0").select(*docs.columns)
    want = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(left).collect() if r["copies"]})
    out = corpus_pipeline.run(spark, SF)
    assert Counter(r["doc_id"] for r in out.collect()) == want and {"shard", "slot"} <= set(out.columns)
