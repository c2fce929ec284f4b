import re
from collections import Counter

from pyspark.sql import functions as F

from paperloom.functions.omml import with_latex
from paperloom.operators.segment import split_questions
from paperloom.plans import queries as core
from paperloom.streaming import jobs


def questions(spark, *lines):
    rows = [("f", i, x) for i, x in enumerate(lines)]
    return split_questions(spark.createDataFrame(rows, "file_id string, pos long, text string")).orderBy("ord").collect()


def test_header_gives_the_type_of_what_follows(spark):
    q = questions(spark, "一、选择题：本题共8小题", "1. 题干", "A. 甲 B. 乙", "【答案】AB【解析】因为")
    assert [(x["number"], x["type_name"], x["answer"], len(x["options"])) for x in q] == [(1, "选择题", "AB", 2)]


def test_points_belong_to_the_open_question(spark):
    q = questions(spark, "1. 题干", "（5分）", "　2、另一题")
    assert [(x["number"], x["score"]) for x in q] == [(1, 5.0), (2, None)]


def test_a_first_line_with_points_starts_a_question(spark):
    assert [x["number"] for x in questions(spark, "3. 题干（5分）")] == [3]


def test_no_lines(spark):
    assert questions(spark) == []


def test_fraction(spark):
    ns = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
    xml = f"<m:oMath {ns}><m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>b</m:t></m:r></m:den></m:f></m:oMath>"
    assert with_latex(spark.createDataFrame([(xml,)], "xml string")).first()["latex"] == r"\frac{a}{b}"


def test_latest_event_in_batch_and_stream(spark, tmp_path):
    rows = spark.sql("select 'a' as file_id, timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts, case when id = 3 then 'completed' else 'parsing' end as status from range(4)")
    assert [r["status"] for r in jobs.latest(rows).collect()] == ["completed"]
    rows.write.parquet(f"{tmp_path}/in")
    stream = jobs.stream_latest(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest_events").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["status"] for r in spark.table("latest_events").collect()] == ["completed"]


def brute_blocks(page):
    low, at, out = page.translate({c: c + 32 for c in range(65, 91)}), 0, []
    while m := re.compile("<(p|h[1-6]|div)[^>]*>").search(low, at):
        end = low.find(f"</{m[1]}>", m.end())
        at = m.start() + 1 if end < 0 else end + len(m[1]) + 3
        content = page[m.end() : end]
        text = re.sub("<[^>]+>", "", content).strip(" \t\n\x0b\f\r\u3000")
        if end >= 0 and (text or "<img" in content or "math/tex" in content):
            out.append((m[1], content, text))
    return out


def test_all_blocks_of_pages(spark, tmp_path):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    odd = ["<H1 class='a'>Top</h1><div>x <b>y</b>\n z</DIV><p> </p><p><img src=a></p><h6>six</h6><h7>no</h7><p>open <div>in</div>", "", None, "<h2>two</h2><p>three</p>" * 3]
    pages += [(-1 - i, x) for i, x in enumerate(odd)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = core.queries()["page_blocks_all"](spark, str(tmp_path)).collect()
    want = [(i, n, *b) for i, x in pages for n, b in enumerate(brute_blocks(x or ""))]
    assert sorted(tuple(r) for r in got) == sorted(want)
    kinds = Counter(r["tag"] for r in got if r["page_id"] >= 0)
    assert kinds["h1"] and kinds["div"] and kinds["p"]
