"""Views derived from sentences and their renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T


def granularity_groups(sentences: DataFrame, size: int | None) -> DataFrame:
    """The units shown together with each: by size within a block, or the whole block (None). Adds grp and group_units."""
    grp = F.floor(F.col("idx") / size) if size else F.lit(0).cast("bigint")
    rows = sentences.withColumn("grp", grp)
    w = Window.partitionBy("doc_id", "block_id", "grp").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("group_units", F.collect_list("unit_id").over(w))


def current(sentences: DataFrame, renderings: DataFrame) -> DataFrame:
    """Sentences with the renderings of their present text: renderings(doc_id, unit_id, src_hash, zh). Adds zh; one of another text does not count."""
    return sentences.join(renderings.withColumnRenamed("src_hash", "hash"), ["doc_id", "unit_id", "hash"], "left")


def progress(sentences: DataFrame, by: list[str]) -> DataFrame:
    """Counts of sentences(by..., zh, failed): total, done, failed, complete (there are sentences and all are done)."""
    done = F.count("zh")
    return sentences.groupBy(*by).agg(F.count("*").alias("total"), done.alias("done"), F.count_if(F.col("zh").isNull() & F.coalesce("failed", F.lit(False))).alias("failed"), (done == F.count("*")).alias("complete"))


def find(sentences: DataFrame, query: str) -> DataFrame:
    """Hits of a query in document order: doc_id, unit_id, lang, hit. sentences(doc_id, ord, idx, unit_id, text, zh)."""
    q = T.search_form(T.strip(F.lit(query)))
    sides = F.array(F.struct(F.lit(0).alias("l"), F.lit("en").alias("lang"), F.col("text").alias("t")), F.struct(F.lit(1).alias("l"), F.lit("zh").alias("lang"), F.col("zh").alias("t")))
    rows = sentences.select("doc_id", "ord", "idx", "unit_id", F.explode(sides).alias("s")).where(F.contains(T.search_form(F.col("s.t")), q) & (q != ""))
    hit = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "idx", "s.l"))
    return rows.select("doc_id", "unit_id", "s.lang", hit.alias("hit"))


def section_titles(blocks: DataFrame) -> DataFrame:
    """Blocks with the nearest heading with text at or before them: adds section (empty where there is none)."""
    title = F.when((F.col("kind") == "heading") & (T.strip(F.col("text")) != ""), F.col("text"))
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("section", F.coalesce(F.last(title, ignorenulls=True).over(w), F.lit("")))


def mode_view(sentences: DataFrame, mode: str) -> DataFrame:
    """What a reader sees of sentences(doc_id, ord, block_id, idx, text, zh): mode en, zh, interleave or side. doc_id, ord, lang, shown, pending (of the units without rendering)."""
    zh = F.struct(F.lit("zh").alias("lang"), F.coalesce("zh", "text").alias("t"), F.col("zh").isNull().alias("p"))
    en = F.struct(F.lit("en").alias("lang"), F.col("text").alias("t"), F.lit(False).alias("p"))
    sides = {"en": [en], "zh": [zh]}.get(mode, [en, zh])
    rows = sentences.select("doc_id", "ord", "block_id", "idx", F.explode(F.array(*sides)).alias("s"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.col("s.t").alias("t")))), lambda x: x["t"]), F.lit(" ") if mode == "en" else " ")
    return rows.groupBy("doc_id", "ord", "block_id", "s.lang").agg(joined.alias("shown"), F.count_if(F.col("s.p")).alias("pending"))


def joined_selection(units: DataFrame, sep: str) -> DataFrame:
    """The texts of selected units(sel_id, pos, block_id, text), one paragraph for each run of one block: sel_id, paragraph, text."""
    w = Window.partitionBy("sel_id").orderBy("pos")
    new = F.when(F.col("block_id") == F.lag("block_id").over(w), 0).otherwise(1)
    rows = units.withColumn("new", new).withColumn("paragraph", F.sum("new").over(w))
    return rows.groupBy("sel_id", "paragraph").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), sep).alias("text"))


def notes_in_order(annotations: DataFrame, sentences: DataFrame) -> DataFrame:
    """Annotations(doc_id, annotation_id, unit_ids) in reading order by their first unit: doc_id, annotation_id, at, nth. Those without a unit in the document go."""
    place = sentences.select("doc_id", "unit_id", (F.col("ord") * 1000 + F.col("idx")).alias("at"))
    rows = annotations.select("doc_id", "annotation_id", F.explode("unit_ids").alias("unit_id")).join(place, ["doc_id", "unit_id"])
    rows = rows.groupBy("doc_id", "annotation_id").agg(F.min("at").alias("at"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "annotation_id")))


def resolved_bookmarks(bookmarks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Bookmarks(doc_id, mark_id, block_id, text) with the block they point at: doc_id, mark_id, resolved, ord.

    First choice is the block of their id if its letters start as theirs do; then the first block that starts with, or holds, their first 40 letters.
    Marks of under 8 letters keep the block of their id. Marks meet the blocks of their own document only.
    """
    own = blocks.select("doc_id", F.col("ord"), F.col("block_id").alias("b"), T.letters(F.col("text")).alias("letters"))
    marks = bookmarks.select("doc_id", "mark_id", "block_id", F.substring(T.letters(F.col("text")), 1, 40).alias("key"))
    near = marks.join(own, "doc_id", "left")
    same = F.col("b") == F.col("block_id")
    short = F.length("key") < 8
    rank = (
        F.when(same & F.startswith(F.col("letters"), F.substring("key", 1, 20)), 0).when(same & short, 1)
        .when(~short & F.startswith(F.col("letters"), F.col("key")), 2).when(~short & F.contains(F.col("letters"), F.col("key")), 3)
    )
    best = near.withColumn("rank", rank).where("rank is not null").groupBy("doc_id", "mark_id").agg(F.min(F.struct("rank", "ord", "b")).alias("r"))
    return marks.join(best, ["doc_id", "mark_id"], "left").select("doc_id", "mark_id", F.col("r.b").alias("resolved"), F.col("r.ord").alias("ord"))


def bookmarks_in_order(resolved: DataFrame) -> DataFrame:
    """Resolved bookmarks(doc_id, mark_id, resolved, ord) in the order of the document, those that point nowhere last, as they were set: adds nth."""
    return resolved.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("ord").asc_nulls_last(), "mark_id")))


def toggled(bookmarks: DataFrame, resolved: DataFrame, block: DataFrame, t: int) -> DataFrame:
    """Bookmarks(doc_id, mark_id, block_id, text, page, t) after one is set at, or taken from, a block(doc_id, block_id, text, page): marks that resolve to it go, else a new one comes."""
    here = resolved.join(block.selectExpr("doc_id", "block_id as resolved"), ["doc_id", "resolved"], "left_semi").select("doc_id", "mark_id")
    new = block.join(here.select("doc_id").distinct(), "doc_id", "left_anti")
    last = bookmarks.groupBy("doc_id").agg(F.max("mark_id").alias("m"))
    new = new.join(last, "doc_id", "left").select("doc_id", (F.coalesce("m", F.lit(-1)) + 1).alias("mark_id"), "block_id", F.substring("text", 1, 120).alias("text"), "page", F.lit(t).cast("bigint").alias("t"))
    return bookmarks.join(here, ["doc_id", "mark_id"], "left_anti").select(*new.columns).unionByName(new)


def sections(blocks: DataFrame, sentences: DataFrame) -> DataFrame:
    """Task export: doc_id, section_no, heading, paragraphs (block, kind, units), for sections with text. sentences(doc_id, ord, idx, unit_id, text, zh).

    Blocks and sentences go by document in one shuffle, which everything after it keeps: a text is shuffled once, and that of a block only if it is a heading.
    """
    w = Window.partitionBy("doc_id").orderBy("ord", "unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = (F.col("kind") == "heading") & (F.col("level") == 1)
    block = F.struct("ord", F.col("block_id").alias("block"), "kind")
    unit = F.struct("idx", F.col("unit_id").alias("id"), F.col("text").alias("en"), "zh")
    none = lambda like: F.lit(None).cast(like.schema[0].dataType)
    some = blocks.select("doc_id", "ord", block.alias("block"), F.coalesce(top, F.lit(False)).alias("top"), F.when(top, F.col("text")).alias("title"), none(sentences.select(unit)).alias("unit"))
    units = sentences.select("doc_id", "ord", none(blocks.select(block)).alias("block"), F.lit(False).alias("top"), F.lit(None).alias("title"), unit.alias("unit"))
    rows = some.unionByName(units).withColumns({"section_no": F.sum(F.when(F.col("top"), 1).otherwise(0)).over(w), "heading": F.coalesce(F.last("title", ignorenulls=True).over(w), F.lit("(front matter)"))})
    here = F.when(F.col("unit").isNull(), F.struct("section_no", "heading", "block"))
    met = rows.where("doc_id is not null and ord is not null").groupBy("doc_id", "ord").agg(F.collect_list(here).alias("here"), F.sort_array(F.collect_list("unit")).alias("u")).where("size(u) > 0")
    plain = F.transform("u", lambda x: F.struct(x["id"].alias("id"), x["en"].alias("en"), x["zh"].alias("zh")))
    paragraph = F.struct("b.block.ord", "b.block.block", "b.block.kind", F.col("u").alias("units"))
    whole = met.select("doc_id", plain.alias("u"), F.explode("here").alias("b")).groupBy("doc_id", F.col("b.section_no").alias("section_no"), F.col("b.heading").alias("heading")).agg(F.sort_array(F.collect_list(paragraph)).alias("paragraphs"))
    return whole.withColumn("doc_id", F.col("doc_id").cast(blocks.schema["doc_id"].dataType))


def tints(highlights: DataFrame) -> DataFrame:
    """The colour of each unit under highlights(doc_id, highlight_ord, color, unit_ids): the last highlight's."""
    return highlights.select("doc_id", "highlight_ord", "color", F.explode("unit_ids").alias("unit_id")).groupBy("doc_id", "unit_id").agg(F.max_by("color", "highlight_ord").alias("color"))


def comment(note: Column, renderings: Column) -> Column:
    """A highlight's comment: the note, then the rendering if every unit has one."""
    n = T.strip(note)
    full = F.forall(renderings, lambda z: z.isNotNull() & (z != ""))
    both = F.array(F.when(n != "", n), F.when(full, F.concat(F.lit("【译】"), F.array_join(renderings, ""))))
    return F.array_join(F.filter(both, lambda x: x.isNotNull()), "\n")


def task_phase(glossary: Column, delivered: Column, todo: Column, report: Column) -> Column:
    """How far a task folder is, from its files."""
    return F.when(report, "done").when((delivered >= todo) & (todo > 0), "checking").when(delivered > 0, "translating").when(glossary, "glossary").otherwise("waiting")


def stalled(phase: Column, watching: Column, last_ms: Column, now_ms: Column) -> Column:
    """Whether an unfinished, watched task has had no new file for over five minutes."""
    return (phase != "done") & watching & (now_ms - last_ms > 300_000)


def age(ms: Column) -> Column:
    """Milliseconds as a short age."""
    s = F.greatest(F.lit(0), F.floor(ms / 1000 + 0.5))
    m = F.floor(s / 60 + 0.5)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit(" 秒前"))).when(m < 60, F.concat(m.cast("string"), F.lit(" 分钟前"))).otherwise(F.concat(F.floor(m / 60 + 0.5).cast("string"), F.lit(" 小时前")))


def selected_units(selections: DataFrame, spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """Units of which a selection covers at least one character that is not white space: doc_id, sel_id, unit_id.

    selections(doc_id, sel_id, from_ord, from_at, to_ord, to_at) run from a place in a block to one in the same or a later block; spans(doc_id, ord,
    unit_id, start, end); blocks(doc_id, ord, text). A selection is dealt to its blocks, so the joins are on equal keys.
    """
    forward = selections.where("from_ord <= to_ord")
    parts = forward.select("doc_id", "sel_id", F.explode(F.sequence("from_ord", "to_ord")).alias("ord"), "from_ord", "from_at", "to_ord", "to_at")
    rows = parts.join(spans, ["doc_id", "ord"]).join(blocks.select("doc_id", "ord", "text"), ["doc_id", "ord"])
    left = F.when(F.col("ord") == F.col("from_ord"), F.greatest("start", "from_at")).otherwise(F.col("start"))
    right = F.when(F.col("ord") == F.col("to_ord"), F.least("end", "to_at")).otherwise(F.col("end"))
    rows = rows.withColumns({"__l": left.cast("int"), "__r": right.cast("int")}).where("__l < __r")
    covered = F.col("text").substr(F.col("__l") + 1, F.col("__r") - F.col("__l"))
    return rows.where(T.strip(covered) != "").select("doc_id", "sel_id", "unit_id").distinct()


def paragraph_action(busy: Column, failed: Column, total: Column, done: Column) -> Column:
    """What can be done with a paragraph."""
    return F.when(busy, "busy").when(failed > 0, "retry").when(done >= total, "retranslate").otherwise("translate")


def changed(shown: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of now whose value differs from what was shown, or was not shown."""
    old = shown.select(F.col(key), F.col(value).alias("__old"), F.lit(True).alias("__was"))
    return now.join(old, key, "left").where(F.col("__was").isNull() | ~F.col(value).eqNullSafe(F.col("__old"))).select(*now.columns)


def blind_scores(marks: DataFrame) -> DataFrame:
    """Ratings(engine, score) → engine, rated, mean, share_5, share_le3."""
    return marks.groupBy("engine").agg(
        F.count("*").alias("rated"), F.avg("score").alias("mean"), F.avg(F.when(F.col("score") == 5, 1.0).otherwise(0.0)).alias("share_5"), F.avg(F.when(F.col("score") <= 3, 1.0).otherwise(0.0)).alias("share_le3")
    )


def blind_sample(units: DataFrame, n: int, seed: int = 20261005) -> DataFrame:
    """n units drawn by a hash, in document order: units(unit_id, ord)."""
    return units.orderBy(F.xxhash64("unit_id", F.lit(seed)), "unit_id").limit(n).orderBy("ord")


def bench_rows(runs: DataFrame) -> DataFrame:
    """Runs(engine, seconds, requests, unit_id, zh, problems) by unit → one row an engine."""
    return runs.groupBy("engine").agg(
        F.count("*").alias("sentences"), F.max("seconds").alias("seconds"), F.floor(F.count("zh") / F.max("seconds") * 60 + 0.5).alias("sentences_per_min"),
        F.max("requests").alias("requests"), F.count_if(F.col("zh").isNull()).alias("failed"), F.sum("problems").alias("problems"),
    )


def runs_of_style(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pieces of ranges(doc_id, block_id, start, end) under segments(doc_id, block_id, seg_start, length, style): doc_id, block_id, a, b, style."""
    near = ranges.join(segments, ["doc_id", "block_id"]).withColumns({"a": F.greatest("start", "seg_start"), "b": F.least("end", F.col("seg_start") + F.col("length"))})
    return near.where("a < b").select("doc_id", "block_id", "a", "b", "style")
