"""String ids, lines and rows with very many copies, hostile texts, and thresholds of each language's own."""

import random
import time

import pytest
from pyspark.sql import functions as F

from paperloom.llm import decontaminate, license_scan, line_dedup, mixing, sharding, simhash

LINE = "a line that many documents hold"


@pytest.mark.parametrize("kind", ["string", "int", "long"])
def test_line_dedup_takes_ids_of_any_type(spark, kind):
    rows = [(1, f"{LINE}\nown"), (2, f"x\n{LINE}"), (3, LINE.upper()), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    before = {t.name for t in spark.catalog.listTables()}
    got = {int(r["doc_id"]): (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: (2, 1, "own"), 2: (2, 1, "x"), 3: (1, 0, LINE.upper()), 4: (1, 0, ""), 5: (1, 0, "")}
    assert {t.name for t in spark.catalog.listTables()} == before


def test_line_dedup_leaves_no_tables_after_a_failure(spark, monkeypatch):
    before = {t.name for t in spark.catalog.listTables()}

    def fail(self):
        raise RuntimeError

    monkeypatch.setattr(line_dedup.LineRuns, "repeated", fail)
    with pytest.raises(RuntimeError):
        line_dedup.dedup_lines(spark.createDataFrame([(1, LINE)], "doc_id long, text string"))
    assert {t.name for t in spark.catalog.listTables()} == before


def test_a_line_of_very_many_copies_in_three_documents(spark):
    n = 100_000
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit(LINE + "\n"), n), F.col("id")).alias("text"))
    got = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.length("kept_text")).collect()}
    assert got == {0: (n + 1, n, 1), 1: (n + 1, n, 1), 2: (n + 1, 0, n * (len(LINE) + 1) + 1)}


def test_hot_lines_are_judged_by_copies(spark):
    # One line a thousand times in three documents, others once in many: only the first is joined by broadcast.
    lines = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.lit(1).alias("h1"), F.lit(1).alias("h2")).unionByName(spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 100 + 10).alias("h1"), F.lit(2).alias("h2")))
    repeated = spark.createDataFrame([(1, 1, 2, 3), *((i, 2, 200 + i - 10, 3) for i in range(10, 110))], "h1 long, h2 long, keeper long, n_docs long")
    found = line_dedup.with_keeper(lines, repeated, hottest=10)
    assert found.count() == 3300
    assert found.where("h1 = 1 and keeper = 2").count() == 3000


HOSTILE = [
    "permission is free of charge ",
    "permission to use this software for any purpose is granted free of charge ",
    "released under the bsd license ",
    "permission is hereby granted free of charge to any person obtaining a copy ",
]


@pytest.mark.parametrize("text", HOSTILE)
def test_license_scan_of_a_hostile_megabyte(text):
    scanner, long = license_scan.Scanner(), text * (1_000_000 // len(text))
    began = time.process_time()
    found = scanner.spans(long)
    assert time.process_time() - began < 30  # 3 to 10 s where this was written; 20 minutes before
    assert len(found) == (1_000_000 // len(text) if text == HOSTILE[3] else 0)


def edit_distances(notice, text):
    """For each end in the text, the least edit distance of the notice and a stretch that ends there."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(notice, 1):
        above, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (c != d)))
    return row


def test_bit_parallel_ends_by_brute_force():
    r, scanner = random.Random(4), license_scan.Scanner()
    for _ in range(120):
        i = r.randrange(len(license_scan.NOTICES))
        notice = license_scan.NOTICES[i][1]
        k, changed = license_scan.allowed(notice), list(notice)
        for _ in range(r.randint(0, k + 2)):
            j = r.randrange(len(changed))
            changed[j] = r.choice(["", r.choice("abcdef "), changed[j] + r.choice("xyz ")])
        text = f"words before {''.join(changed)} and after {''.join(changed)}" * r.choice([1, 2])
        row = edit_distances(notice, text)
        assert scanner.ends(i, text, 0, len(text)) == [j for j in range(1, len(text) + 1) if row[j] <= k]


def test_spans_have_the_edits_of_brute_force():
    r, scanner = random.Random(6), license_scan.Scanner()
    for _ in range(150):
        i = r.randrange(len(license_scan.NOTICES))
        label, notice = license_scan.NOTICES[i]
        changed = list(notice)
        # Edits outside the key words, which have bounds of their own.
        free = [j for j, c in enumerate(notice) if not any(s <= j < s + len(w) + 1 for w in notice.split() if w in license_scan.KEYS for s in [notice.index(w)]) and c != " "]
        for j in r.sample(free, min(len(free), r.randint(0, 2))):
            changed[j] = "q"
        found = [s for s in scanner.spans(f"one two {''.join(changed)} three") if s[4] == len(notice) and s[0] == label]
        best = min(edit_distances(notice, f"one two {''.join(changed)} three")[1:])
        assert found and min(s[3] for s in found) == best


def test_shards_of_repeated_rows_are_equal(spark):
    docs = spark.range(10_000).select((F.col("id") % 5).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 5).alias("text"))
    out = sharding.shard_documents(docs).select("shard", "slot", "size").collect()
    loads, places = {}, {}
    for shard, slot, size in out:
        loads[shard] = loads.get(shard, 0) + size
        places.setdefault(shard, []).append(slot)
    assert len(out) == 10_000 and len(loads) == 16 and max(loads.values()) <= 1.02 * min(loads.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_one_row_among_many_is_dealt_out(spark):
    docs = spark.range(6000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), "id")).alias("text"))
    out = sharding.shard_documents(docs, shards=4)
    most = out.groupBy("vslot").count().agg(F.max("count")).first()[0]
    assert out.count() == 6000 and most < 200
    sizes = [r[1] for r in out.groupBy("shard").agg(F.sum("size")).collect()]
    assert max(sizes) < 1.02 * min(sizes)


def test_a_failed_job_leaves_the_stored_map(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    path = str(tmp_path / "map")
    sharding.shard_documents(docs, map_path=path)
    assert sharding.SlotMap.load(spark, path).version == 1
    failing = docs.withColumn("n_chars", F.when(F.col("doc_id") == 7, F.raise_error(F.lit("no"))).otherwise(F.lit(1)))
    with pytest.raises(Exception, match="no"):
        sharding.shard_documents(failing, map_path=path)
    assert sharding.SlotMap.load(spark, path).version == 1


def test_other_operators_take_string_ids(spark):
    rows = [(f"d{i}", f"some words of document number {i} that are its own", "a", "x") for i in range(30)] + [("copy", "some words of document number 3 that are its own", "a", "x"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, lang string")
    assert sharding.shard_documents(docs).count() == mixing.mix_counts(docs).count() == license_scan.scan_licenses(docs, ["doc_id"]).count() == 32
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    assert groups["copy"] == groups["d3"] == "copy"
    assert decontaminate.find_benchmark(docs, spark.createDataFrame([("i", "document number 7")], "item_id string, text string")).where("n_hit > 0").count() == 1


def test_benchmark_blocks_are_read_once(spark):
    """Many blocks: every item is in one of them, blocks come from their own folders, and hits equal those of one block."""
    from paperloom.llm import decontaminate

    items = spark.range(60).selectExpr("case when id = 7 then null else id end as item_id", "case when id = 9 then null else concat_ws(' ', transform(sequence(1, 12), x -> concat('w', id, '_', x))) end as text")
    items = items.unionByName(items.limit(5))
    blocks = list(decontaminate._blocks(items, 1500))
    assert len(blocks) > 4 and [last for _, last in blocks] == [False] * (len(blocks) - 1) + [True]
    dealt = [x for block, _ in blocks for x in block]
    assert len(dealt) == len(set(dealt)) == 60
    docs = spark.range(60).selectExpr("id as doc_id", "concat('a ', concat_ws(' ', transform(sequence(1, 12), x -> concat('w', id, '_', x))), ' b') as text")
    found = [sorted(tuple(r[c] if c != "items" else tuple(r[c]) for c in ("doc_id", "n_hit", "items")) for r in decontaminate.find_benchmark(docs, items, block_bytes=size).collect()) for size in (1500, 1 << 23)]
    assert found[0] == found[1]
    assert sum(n > 0 for _, n, _ in found[0]) == 59


def test_transcripts_of_threads(spark):
    """Replies stand below what they answer; parts of long threads, joined, are the thread."""
    from paperloom.llm import chat

    rows = [("c", 0, "user", "How are you?"), ("c", 1, "bot", "Other thread"), ("c", 2, None, "> How are you?\nFine"), ("c", 3, "user", "> Fine\nGood"), ("c", None, "user", "no turn"), (None, 0, "user", "no conversation"), ("d", 0, "user", None)]
    made = chat.format_chat(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    got = {(r["conv_id"], r["thread"]): (r["first_turn"], r["last_turn"], r["n_messages"], r["transcript"]) for r in chat.transcripts(made).collect()}
    assert got == {("c", 0): (0, 3, 3, "<|user|>\nHow are you?\n<|user|>\nFine\n<|user|>\nGood"), ("c", 1): (1, 1, 1, "<|bot|>\nOther thread"), ("d", 0): (0, 0, 1, "<|user|>\n")}
    long = spark.range(5000).selectExpr("'c' as conv_id", "0L as thread", "id as turn", "repeat(cast(id as string), 20) as formatted").unionByName(spark.createDataFrame([("c", 0, 7, "7x"), ("c", 0, 7, "7x")], "conv_id string, thread long, turn long, formatted string"))
    parts = sorted(chat.transcripts(long, 10_000).collect(), key=lambda r: r["part"])
    assert len(parts) > 20 and sum(r["n_messages"] for r in parts) == 5002
    assert all(len(r["transcript"]) < 10_000 + 100 + r["n_messages"] for r in parts)
    lines = "\n".join(r["transcript"] for r in parts).split("\n")
    assert [x for x in lines if x not in ("7x", "7" * 20)] == [str(i) * 20 for i in range(5000) if i != 7]
    assert sorted(lines[7:10]) == sorted(["7x", "7x", "7" * 20])
    assert chat.transcripts(made.limit(0)).collect() == []


def test_periodic_tails_of_texts_without_words(spark):
    from paperloom.llm.queries import with_periodic_tails

    # Every tenth document by hash gets a tail; blank ones among them have no place to start it from.
    texts = ["", " \t\n", None, "a", "a b c d e f g h"]
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.explode(F.array(*map(F.lit, texts))).alias("text"))
    got = with_periodic_tails(docs).collect()
    assert len(got) == 200 * len(texts)
    assert {r["text"] for r in got} >= {"", " \t\n", None, "a", "a b c d e f g h"}
    assert any(r["text"] not in texts for r in got)
