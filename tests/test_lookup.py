"""Joins by containment and path rewriting against brute force."""

import random

from pyspark.sql import functions as F

from paperloom.operators import lookup

REF = "file_id string, image_ref string, n long"


def brute_match(ref, names):
    hit = sorted(x for x in names if x is not None and ref and ref in x)
    return None if not hit else ref if ref in hit else hit[0]


def test_containment_by_brute_force(spark):
    rng = random.Random(1)
    word = lambda most: "".join(rng.choice("ab图") for _ in range(rng.randint(0, most)))
    media = [(f, word(13)) for f in "fgh" for _ in range(60)] + [("f", None), ("f", "aab"), ("f", "aab"), (None, "aab")]
    refs = [(f, word(7), i) for i, f in enumerate("fghi" * 60)] + [("f", None, 900), ("f", "", 901), (None, "a", 902)]
    named = spark.createDataFrame(media, "file_id string, filename string").withColumn("image_filename", F.lit("clash"))
    got = {r["n"]: r["image_filename"] for r in lookup.match_images(spark.createDataFrame(refs, REF), named).collect()}
    want = {n: brute_match(ref, [x for f, x in media if f == file_id and f is not None]) for file_id, ref, n in refs}
    assert got == want
    assert len(set(want.values()) - {None}) > 20


def test_containment_has_no_product_of_a_file(spark):
    """A thousand names and a thousand references in one file: few pairs are verified."""
    media = spark.range(1000).select(F.lit("f").alias("file_id"), F.format_string("f_image%04d.png", "id").alias("filename"))
    refs = spark.range(1000).select(F.lit("f").alias("file_id"), F.format_string("image%04d", "id").alias("image_ref"), F.col("id").alias("n"))
    found = lookup.match_images(refs, media)
    assert found.where("image_filename = concat('f_', image_ref, '.png')").count() == 1000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x and "contains" in x.lower()]
    assert joins and all("gram" in x for x in joins), plan


def test_no_media_and_no_references(spark):
    refs, media = spark.createDataFrame([("f", "a", 1)], REF), spark.createDataFrame([], "file_id string, filename string")
    assert [r["image_filename"] for r in lookup.match_images(refs, media).collect()] == [None]
    assert lookup.match_images(refs.limit(0), media).collect() == []


def brute_rewrite(text, urls):
    out, at = "", 0
    while at < len(text):
        path = max((p for p in urls if p and text.startswith(p, at)), key=len, default=None)
        out += text[at] if path is None else urls[path]
        at += 1 if path is None else len(path)
    return out


def rewritten(spark, pages, media):
    made = spark.createDataFrame(pages, "file_id string, n long, html string"), spark.createDataFrame(media, "file_id string, path string, url string")
    return {r["n"]: r["html"] for r in lookup.rewrite_paths(*made).collect()}


def test_rewriting_by_brute_force(spark):
    rng = random.Random(2)
    word = lambda least, most: "".join(rng.choice("ab/é") for _ in range(rng.randint(least, most)))
    urls = {f: {word(1, 4): word(0, 5) for _ in range(8)} for f in "fgh"}
    pages = [(f, i, word(0, 40)) for i, f in enumerate("fgh" * 50)]
    media = [(f, p, u) for f in urls for p, u in urls[f].items()]
    assert rewritten(spark, pages, media) == {n: brute_rewrite(text, urls[f]) for f, n, text in pages}


def test_rewriting_edges(spark):
    media = [("f", "m/a", "/x/m/a.png"), ("f", "m/a.png", "m/a"), ("f", "m/b", "2"), ("f", "m/b", "1"), ("f", "", "no"), ("f", "m/c", None), ("f", None, "no"), (None, "m", "no")]
    pages = [("f", 1, "m/a.png m/a m/am/a"), ("f", 2, "m/b m/c"), ("f", 3, None), ("f", 4, ""), ("g", 5, "m/a"), (None, 6, "m/a"), ("f", 7, "m/a " * 200_000)]
    got = rewritten(spark, pages, media)
    assert got[7] == "/x/m/a.png " * 200_000
    assert {k: v for k, v in got.items() if k < 7} == {1: "m/a /x/m/a.png /x/m/a.png/x/m/a.png", 2: "1 m/c", 3: None, 4: "", 5: "m/a", 6: "m/a"}


def test_merged_media_prefers_previews(spark):
    t = "file_id string, original_filename string, filename string"
    media = spark.createDataFrame([("f", "a", "1"), ("f", "b", "2"), ("g", "a", "3")], t)
    previews = spark.createDataFrame([("f", "a", "4"), ("h", "c", "5")], t)
    assert sorted(tuple(r) for r in lookup.merged_media(media, previews).collect()) == [("f", "a", "4"), ("f", "b", "2"), ("g", "a", "3"), ("h", "c", "5")]


def test_distinct_names(spark):
    t = spark.createDataFrame([("k", "b", 2), ("k", "a", 3), ("k", "b", 1), ("k", None, 0), ("l", "x", 1)], "k string, n string, o int")
    assert {r["k"]: r["names"] for r in lookup.distinct_names(t, "k", "n", "o").collect()} == {"k": ["b", "a"], "l": ["x"]}
    assert lookup.distinct_names(t.limit(0), "k", "n", "o").collect() == []


def test_names_are_resolved_without_a_broadcast(spark):
    asked = spark.range(40).select(F.lit("f").alias("file_id"), F.concat(F.lit("n"), "id").alias("name"))
    held = spark.range(0, 40, 2).select(F.lit("f").alias("file_id"), F.concat(F.lit("f_n"), "id").alias("name"), F.concat(F.lit("/d/f_n"), "id").alias("path"))
    found = lookup.resolve_names(asked, held)
    rows = found.orderBy("name").collect()
    assert sum(r["path"] is not None and r["rank"] == 1 for r in rows) == 20 and len(rows) == 40
    # The plan that ran: candidates grow with the requests, so none are sent to the driver.
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
