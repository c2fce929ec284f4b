"""Papers into questions: the ordered lines of each paper are dealt to questions, then grouped.

Without an answer section a paper needs window functions only: after a header, a question is open from the first
numbered line on, so scores count from there, and each numbered line that is no score starts a question. In papers
with an answer section the numbered lines are walked in order, since a number there may belong to an earlier question.
Both are segmented scans over chunks of a paper, so a paper may be longer than a task can hold.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import html
from paperloom.functions import patterns as P
from paperloom.functions.text import collapse_blanks, strip
from paperloom.operators.classify import after_number, classify, header_type
from paperloom.operators.options import is_latex, option_images, remainder, split_options
from paperloom.session import written

#: Lines after an answer-section entry that may hold its analysis.
LOOK_AHEAD = 10
#: Papers are cut into chunks of 2 ** CHUNK_BITS positions, which one task holds.
CHUNK_BITS = 11


def with_chunk(lines: DataFrame) -> DataFrame:
    """``lines`` with _chunk: papers are cut where pos passes a multiple of 2 ** CHUNK_BITS."""
    return lines.withColumn("_chunk", F.shiftright(F.col("pos").cast("long"), CHUNK_BITS))


def chunk_order():
    """The lines of a chunk up to the current one."""
    return Window.partitionBy("file_id", "_chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def chunks_before():
    """The chunks of a paper before the current one, a row each."""
    return Window.partitionBy("file_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def deal_by_windows(lines: DataFrame, score_consumes: bool = True) -> DataFrame:
    """Classified lines of papers without an answer section, with kind and ord (the question, from 0).

    A segmented scan: each chunk is summed up (questions it starts, whether it leaves one open), the chunks' rows are
    scanned by paper, and lines are dealt inside their chunks. So only a row a chunk, never a paper, is in one task.
    scored: the question that is open before the line, for which the points of older papers count. Rows without file_id or pos are left out.
    """
    out = with_chunk(lines).withColumn("_part", F.sum((F.col("flag") == "header").cast("int")).over(chunk_order()))
    numbered = F.col("number").isNotNull()
    scored = F.col("score").isNotNull() & F.lit(score_consumes)
    out = out.withColumn("_first", F.min(F.when(numbered, F.col("pos"))).over(Window.partitionBy("file_id", "_chunk", "_part")))
    # A section's first numbered line starts a question even with points, unless one is open from the chunk before.
    opener = numbered & scored & (F.col("pos") == F.col("_first"))
    sections = F.max("_part")
    sums = out.groupBy("file_id", "_chunk").agg(
        F.count(F.when((numbered & ~scored) | opener, 1)).alias("_starts"),
        F.max((opener & (F.col("_part") == 0)).cast("int")).alias("_opener"),
        F.when(F.max(F.when(numbered, F.col("_part"))) == sections, True).when(sections > 0, False).alias("_leaves"),
    )
    heads = sums.withColumn("_entered", F.coalesce(F.last("_leaves", ignorenulls=True).over(chunks_before()), F.lit(False)))
    started = F.col("_starts") - F.when(F.col("_entered"), F.col("_opener")).otherwise(0)
    heads = heads.withColumn("_base", F.coalesce(F.sum(started).over(chunks_before()), F.lit(0))).select("file_id", "_chunk", "_entered", "_base")
    out = out.join(heads, ["file_id", "_chunk"])
    within = F.col("_entered") & (F.col("_part") == 0)
    out = out.withColumn("_start", (numbered & ~scored) | (opener & ~within))
    out = out.withColumn("_ord", F.col("_base") + F.sum(F.col("_start").cast("int")).over(chunk_order()) - 1)
    open_ = within | F.coalesce(F.col("pos") >= F.col("_first"), F.lit(False))
    kind = (
        F.when(F.col("flag") != "text", F.col("flag"))
        .when(F.col("_start"), "start")
        .when(scored & open_, "score")
        .when(open_, "continuation")
        .otherwise("orphan")
    )
    owned = open_ & ~F.col("flag").isin("blank", "header")
    before = F.when(F.col("_start") & (within | (F.col("pos") > F.col("_first"))), F.col("_ord") - 1).when(~F.col("_start") & owned, F.col("_ord"))
    return out.withColumns({"kind": kind, "ord": F.when(owned, F.col("_ord")).cast("int"), "scored": before.cast("int")}).drop("_chunk", "_part", "_first", "_entered", "_base", "_start", "_ord")


# What a deciding line does: a state is 2 * (the answer section has begun) + (a question is open).
HEADER, MARK, POINTS, KNOWN = 1, 2, 4, 8


def _step(state: int, code: int) -> tuple[int, str]:
    """The state after a deciding line, and the line's kind."""
    if code & HEADER:
        return state & 2, "header"
    if code & MARK:
        return state | 2, "marker"
    if code & POINTS and state & 1:
        return state, "score"
    if state & 2 and code & KNOWN:
        return 2, "merge"
    return 1, "start"


def _sum_up(table: pa.Table) -> pa.Table:
    """A chunk as one row: for each state before it, the state after it and the questions it starts."""
    codes = table.sort_by("pos")["code"].to_pylist()
    ends, starts = [], []
    for state in range(4):
        n = 0
        for code in codes:
            state, kind = _step(state, code)
            n += kind == "start"
        ends.append(state)
        starts.append(n)
    columns = [pa.array([ends], pa.list_(pa.int32())), pa.array([starts], pa.list_(pa.int32()))]
    return pa.Table.from_arrays([table["file_id"].slice(0, 1), table["_chunk"].slice(0, 1), *columns], names=["file_id", "_chunk", "ends", "starts"])


def _scan(table: pa.Table) -> pa.Table:
    """The chunks of a paper with the state before each and the questions started before it."""
    table = table.sort_by("_chunk")
    states, bases, state, base = [], [], 0, 0
    for ends, starts in zip(table["ends"].to_pylist(), table["starts"].to_pylist(), strict=True):
        states.append(state)
        bases.append(base)
        if ends is not None:
            state, base = ends[state], base + starts[state]
    return pa.Table.from_arrays([table["file_id"], table["_chunk"], pa.array(states, pa.int32()), pa.array(bases, pa.int32())], names=["file_id", "_chunk", "_state", "_base"])


def _walk(table: pa.Table) -> pa.Table:
    """The deciding lines of a chunk with kind, owner (not of entries) and the question left open (-1: none)."""
    table = table.sort_by("pos")
    state, n = table["_state"][0].as_py(), table["_base"][0].as_py()
    kinds, owners, opened = [], [], []
    for code in table["code"].to_pylist():
        state, kind = _step(state, code)
        n += kind == "start"
        # An open question is always the last one started.
        current = n - 1 if state & 1 else -1
        kinds.append(kind)
        owners.append(current if current >= 0 else None)
        opened.append(current)
    columns = [pa.array(kinds, pa.string()), pa.array(owners, pa.int32()), pa.array(opened, pa.int32())]
    return pa.Table.from_arrays([table["file_id"], table["pos"], table["number"], table["code"], *columns], names=["file_id", "pos", "number", "code", "_kind", "_owner", "_open"])


def deal_by_fold(lines: DataFrame, score_consumes: bool = True) -> DataFrame:
    """Classified lines of any papers, with kind and ord; kind is merge for an entry of the answer section.

    Only headers, markers and numbered lines decide anything. They are a segmented scan too: a chunk of a paper is summed
    up as a change of state, the chunks' rows are scanned by paper, and the deciding lines walked inside their chunks.
    Whether a number is known at a line depends on the first line that started it: that is the first numbered line, but
    for lines with points, which start nothing while a question is open. So the walk is repeated with what it found until
    nothing changes. Each round settles at least one more line of a paper, and what doesn't change is the only solution,
    as a line depends on earlier ones alone; one round or two are usual. ``lines`` are read several times: give them
    written. Rows without file_id or pos are left out.
    """
    types = {f.name: f.dataType.simpleString() for f in lines.schema}
    key = f"file_id {types['file_id']}"
    lines = with_chunk(lines)
    scored = F.coalesce(F.col("score").isNotNull() & F.lit(score_consumes), F.lit(False))
    decisive = F.col("flag").isin("header", "marker") | ((F.col("flag") == "text") & F.col("number").isNotNull())
    code = F.when(F.col("flag") == "header", HEADER).when(F.col("flag") == "marker", MARK).when(scored, POINTS).otherwise(0)
    number = F.when(F.col("flag") == "text", F.col("number"))
    few = lines.where(decisive).select("file_id", "_chunk", "pos", number.alias("number"), code.alias("code"))
    chunks = lines.select("file_id", "_chunk").distinct()
    firsts = few.where(F.col("number").isNotNull() & (F.col("code") == 0)).groupBy("file_id", "number").agg(F.min("pos").alias("_first"))
    while True:
        known = F.coalesce(F.col("_first") < F.col("pos"), F.lit(False))
        marked = few.join(firsts, ["file_id", "number"], "left").withColumn("code", F.when(known, F.col("code").bitwiseOR(KNOWN)).otherwise(F.col("code"))).drop("_first")
        sums = marked.select("file_id", "_chunk", "pos", "code").groupBy("file_id", "_chunk").applyInArrow(_sum_up, f"{key}, _chunk long, ends array<int>, starts array<int>")
        heads = written(chunks.join(sums, ["file_id", "_chunk"], "left").groupBy("file_id").applyInArrow(_scan, f"{key}, _chunk long, _state int, _base int"), "chunk_heads")
        walk = marked.join(heads, ["file_id", "_chunk"]).groupBy("file_id", "_chunk")
        walked = written(walk.applyInArrow(_walk, f"{key}, pos {types['pos']}, number {types['number']}, code int, _kind string, _owner int, _open int"), "walked_lines")
        found = walked.where(F.col("_kind").isin("start", "merge")).groupBy("file_id", "number").agg(F.min("pos").alias("_found"))
        taken = F.col("code").bitwiseAND(KNOWN) != 0
        changed = walked.where("number is not null").join(found, ["file_id", "number"]).where((F.col("_found") < F.col("pos")) != taken)
        if changed.isEmpty():
            break
        firsts = written(found.withColumnRenamed("_found", "_first"), "first_lines")
    owners = walked.where("_kind = 'start'").groupBy("file_id", "number").agg(F.min("_owner").alias("_started"))
    entries = walked.where("_kind = 'merge'").join(owners, ["file_id", "number"]).withColumn("_owner", F.col("_started")).drop("_started")
    walked = walked.where("_kind <> 'merge'").unionByName(entries).drop("number", "code")
    out = lines.join(walked, ["file_id", "pos"], "left").join(heads, ["file_id", "_chunk"])
    entered = F.when(F.col("_state").bitwiseAND(1) == 1, F.col("_base") - 1)
    current = F.coalesce(F.last("_open", ignorenulls=True).over(chunk_order()), entered)
    out = out.withColumn("_current", F.when(current >= 0, current))
    open_ = F.col("_current").isNotNull()
    kind = F.when(F.col("flag") != "text", F.col("flag")).when(scored & open_, "score").when(open_, "continuation").otherwise("orphan")
    owner = F.when(F.col("_kind").isNotNull(), F.col("_owner")).when(~F.col("flag").isin("blank", "header"), F.col("_current"))
    return out.withColumns({"kind": F.coalesce("_kind", kind), "ord": owner.cast("int")}).drop("_chunk", "_kind", "_owner", "_open", "_current", "_state", "_base")


def deal(lines: DataFrame, score_consumes: bool = True, legacy: bool = False) -> DataFrame:
    """Classified lines with kind and ord: by windows where a paper has no answer section, else by the fold.

    Both ways and the choice between them read the lines: give them written. Entries of the answer section come with
    entry_answer and entry_analysis. ``legacy``: older papers have no answer section.
    """
    answered = lines.where(F.col("flag") == "marker").select("file_id").distinct()
    none = {"entry_answer": F.lit(None).cast("string"), "entry_analysis": F.lit(None).cast("string")}
    if legacy or answered.isEmpty():
        return deal_by_windows(lines, score_consumes).withColumns(none)
    plain = deal_by_windows(lines.join(answered, "file_id", "left_anti"), score_consumes).withColumns(none)
    folded = deal_by_fold(lines.join(answered, "file_id", "left_semi"), score_consumes)
    return plain.unionByName(look_ahead(folded.withColumn("scored", F.when(F.col("kind") == "continuation", F.col("ord")))))


def look_ahead(lines: DataFrame) -> DataFrame:
    """``lines`` (with line) with entry_answer and entry_analysis, as an entry of the answer section would give them.

    The analysis is the following lines up to a numbered one: of lines that start with 【 only what follows an analysis
    tag, of the others those that don't start with 故选.
    """
    lines = with_chunk(lines)
    sizes = lines.groupBy("file_id", "_chunk").agg(F.count("*").alias("_n"))
    heads = sizes.select("file_id", "_chunk", F.coalesce(F.sum("_n").over(chunks_before()), F.lit(0)).alias("_base"))
    lines = lines.join(heads, ["file_id", "_chunk"])
    row = F.col("_base") + F.count("*").over(chunk_order()) - 1
    # Blocks of equally many lines; the first lines of a block are also lent to the block before.
    lines = lines.withColumn("_row", row).withColumn("_block", F.shiftright("_row", CHUNK_BITS)).drop("_chunk", "_base")
    lent = F.shiftright(F.col("_row") - LOOK_AHEAD, CHUNK_BITS)
    lines = lines.withColumn("_in", F.explode(F.sequence(F.greatest(lent, F.lit(0)), "_block")))
    rest = F.collect_list("line").over(Window.partitionBy("file_id", "_in").orderBy("_row").rowsBetween(1, LOOK_AHEAD))
    numbered = lambda x: F.regexp_like(x, F.lit(rf"{P.FLAGS}^\d+\s*{P.DOT}"))
    tag = rf"{P.FLAGS}(?:{'|'.join(P.ANALYSIS_TAGS)})"

    def part(x: Column) -> Column:
        return F.when(F.startswith(x, F.lit("【")), F.when(F.regexp_like(x, F.lit(tag)), strip(F.regexp_replace(x, rf"(?Uds)^.*?(?:{'|'.join(P.ANALYSIS_TAGS)})", "")))).when((x != "") & ~F.startswith(x, F.lit(P.SKIPPED_START)), x)

    stop = F.coalesce(F.nullif(F.array_position(F.transform(F.col("_rest"), numbered), F.lit(True)), F.lit(0)) - 1, F.size("_rest").cast("long"))
    parts = F.filter(F.transform(F.slice("_rest", F.lit(1), stop.cast("int")), part), lambda x: x.isNotNull())
    entry = after_number(F.col("line"))
    answer = F.regexp_extract(entry, rf"{P.FLAGS}^([A-H])\s*(?:[\[【]|$)", 1)
    own = lines.withColumn("_rest", rest).where("_in = _block")
    return own.withColumns({"entry_answer": answer, "entry_analysis": F.array_join(parts, " ")}).drop("_rest", "_row", "_block", "_in")


def clean_content(content: Column) -> Column:
    """Cut at each answer or analysis keyword in turn, blanks collapsed."""
    words = F.array(*[F.lit(word) for word in P.CUT_WORDS])
    cut = F.aggregate(words, content, lambda c, word: F.when(F.contains(c, word), strip(F.get(F.split(c, word), F.lit(0)))).otherwise(c))
    return strip(collapse_blanks(cut))


def with_type(lines: DataFrame, read: DataFrame | None = None) -> DataFrame:
    """Classified lines with the type and type word of the last header at or before each.

    ``read``: the same lines where they are cheap to read, from which the chunks are summed up.
    """
    told = F.when(F.col("header_word").isNotNull(), F.col("pos"))
    sums = with_chunk(lines if read is None else read).groupBy("file_id", "_chunk").agg(F.max_by("header_word", told).alias("_word"))
    heads = sums.select("file_id", "_chunk", F.last("_word", ignorenulls=True).over(chunks_before()).alias("_word"))
    lines = with_chunk(lines).join(heads, ["file_id", "_chunk"])
    word = F.coalesce(F.last("header_word", ignorenulls=True).over(chunk_order()), F.col("_word"))
    return lines.withColumn("type_name", F.coalesce(word, F.lit(""))).withColumn("type", F.coalesce(header_type(F.nullif("type_name", F.lit(""))), F.lit("unknown"))).drop("_chunk", "_word")


def split_questions(lines: DataFrame, score_consumes: bool = True, compat: bool = False, legacy: bool = False) -> DataFrame:
    """Lines of papers (file_id, pos, text, and optionally content_items) into one row for each question.

    Columns: file_id, id, ord, number, type, type_name, content, content_html, options, answer, analysis, score,
    difficulty, images, latex_formulas. ``score_consumes=False``: a line with points is dealt as any other, its points
    count for the question open before it (in papers with an answer section those of a question's first line don't count).
    ``compat``: markup as older output had it. ``legacy``: papers of the older form, with their headers and numbers and
    without an answer section, and ``score_consumes=False``.
    Options are told by the same rule in both forms.
    """
    score_consumes = score_consumes and not legacy
    if "content_items" not in lines.columns:
        item = "array<struct<type: string, text: string, image: struct<type: string, rel_id: string, filename: string, original_filename: string>>>"
        image = F.lit(None).cast("struct<type: string, rel_id: string, filename: string, original_filename: string>")
        lines = lines.withColumn("content_items", F.array(F.struct(F.lit("text").alias("type"), F.col("text"), image.alias("image"))).cast(item))
    lines = lines.where((F.col("file_id").isNotNull()) & F.col("pos").isNotNull())
    flagged = classify(lines, legacy)
    # Headers count for the sticky type only where they are headers.
    flagged = flagged.withColumn("header_word", F.when(F.col("flag") == "header", F.col("header_word")))
    # What a line alone tells is worked out before the lines move: a numbered line is never a continuation.
    body = F.when(F.col("flag") == "text", F.when(F.col("number").isNotNull(), after_number(F.col("line"), legacy)).otherwise(F.col("line")))
    flagged = flagged.withColumn("_body", body).withColumn("_options", F.when(F.col("_body").isNotNull(), split_options(F.col("_body"))))
    flagged = written(flagged, "classified_lines")
    dealt = with_type(deal(flagged, score_consumes, legacy), flagged)
    points = dealt.where("score is not null and scored is not null").groupBy("file_id", F.col("scored").alias("ord")).agg(F.max_by("score", "pos").alias("_points")) if not score_consumes else None
    dealt = dealt.where("ord is not null")
    stands = F.col("kind").isin("start", "continuation")
    rows = dealt.withColumns({c: F.when(stands, F.col(c)) for c in ("_body", "_options")})
    has_options = F.coalesce(F.size("_options") > 0, F.lit(False))
    items, file_id = F.col("content_items"), F.col("file_id")
    stem = (F.col("kind") == "start") | ((F.col("kind") == "continuation") & ~has_options)
    markup = html.paragraph(items, file_id, compat)
    pictures = option_images(items)
    made = F.transform(
        "_options",
        lambda o: F.struct(
            o["label"].alias("label"), o["content"].alias("content"),
            html.option(o["label"], o["content"], F.col("_html"), F.coalesce(F.element_at("_pictures", o["label"]), F.array().cast("array<string>")), F.size("_options"), file_id, compat).alias("content_html"),
            is_latex(o["content"], F.coalesce(F.element_at("_pictures", o["label"]), F.array().cast("array<string>"))).alias("is_latex"),
            F.coalesce(F.element_at("_pictures", o["label"]), F.array().cast("array<string>")).alias("images"),
        ),
    )
    rows = rows.withColumns({
        "_html": markup,
        "_pictures": pictures,
        "_content": F.when((F.col("kind") == "start") & has_options, remainder(F.col("_body"))).when(stem, F.col("_body")),
        "_stem": stem,
        "_own_images": F.transform(F.filter(items, lambda x: (x["type"] == "image") & x["image"]["filename"].isNotNull()), lambda x: x["image"]["filename"]),
        "_latex": F.transform(F.filter(items, lambda x: x["type"].isin("latex", "latex_block")), lambda x: x["text"]),
    }).withColumn("_made", made)

    def ordered(value: Column, where: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(where, F.struct(F.col("pos").alias("p"), value.alias("v"))))), lambda s: s["v"])

    kind = F.col("kind")
    last = lambda value, name: F.max_by(value, F.when(kind == name, F.col("pos")))
    first_entry = lambda name: F.min_by(name, F.when((kind == "merge") & (F.col(name) != ""), F.col("pos")))
    grouped = rows.groupBy("file_id", "ord").agg(
        F.max(F.when(kind == "start", F.col("number"))).alias("number"),
        F.max(F.when(kind == "start", F.col("type"))).alias("_type"),
        F.max(F.when(kind == "start", F.col("type_name"))).alias("_type_name"),
        F.array_join(ordered(F.col("_content"), F.col("_stem")), " ").alias("_content"),
        F.array_join(F.filter(ordered(F.col("_html"), F.col("_stem")), lambda x: x != ""), " ").alias("content_html"),
        F.flatten(ordered(F.col("_made"), F.coalesce(F.size("_made") > 0, F.lit(False)))).alias("options"),
        F.flatten(ordered(F.col("_own_images"), F.col("_stem"))).alias("_stem_images"),
        F.flatten(ordered(F.col("_latex"), F.col("_stem"))).alias("latex_formulas"),
        last(F.col("answer_text"), "answer").alias("_answer"),
        last(F.col("analysis_text"), "analysis").alias("_analysis"),
        last(F.col("score"), "score").alias("score"),
        first_entry("entry_answer").alias("_entry_answer"),
        first_entry("entry_analysis").alias("_entry_analysis"),
        F.max((kind == "merge").cast("int")).alias("_merged"),
    )
    if points is not None:
        grouped = grouped.join(points, ["file_id", "ord"], "left").withColumn("score", F.col("_points"))
    guessed = (F.col("_type") == "unknown") & (F.size("options") > 0)
    late = F.array_distinct(F.flatten(F.transform("options", lambda o: o["images"])))
    either = lambda own, entry: F.coalesce(F.nullif(F.col(own), F.lit("")), F.col(entry), F.col(own), F.when(F.col("_merged") == 1, ""))
    return grouped.select(
        "file_id", F.concat(F.lit("q_"), F.col("ord").cast("string")).alias("id"), "ord", "number",
        F.when(guessed, "single_choice").otherwise(F.col("_type")).alias("type"),
        F.when(guessed, "选择题").otherwise(F.col("_type_name")).alias("type_name"),
        clean_content(F.col("_content")).alias("content"), "content_html", "options",
        either("_answer", "_entry_answer").alias("answer"), either("_analysis", "_entry_analysis").alias("analysis"),
        "score", F.lit(None).cast("string").alias("difficulty"),
        F.concat("_stem_images", F.filter(late, lambda x: ~F.array_contains("_stem_images", x))).alias("images"), "latex_formulas",
    )
