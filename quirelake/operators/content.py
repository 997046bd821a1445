"""Content lists → blocks, heading levels and outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators.blocks import mark_front_matter, mark_references, merge_split_paragraphs

# The types of items that give no block, and the numbers that headings start with.
SKIPPED = ("header", "footer", "page_number", "aside_text", "discarded")
NUMBERED = r"^\s*([IVXLC]+\.|[A-Z]\.|\d+\)|\d+(\.\d+)*\.?)\s"


def rect_of(bbox: Column, page: Column, width: Column, height: Column) -> Column:
    """A box in thousandths from the top left as a rectangle in points from the bottom left; null without box or page."""
    at = [F.get(bbox, F.lit(i)) / 1000 for i in range(4)]
    rect = F.struct(page.alias("page"), (at[0] * width).alias("x1"), (height - at[3] * height).alias("y1"), (at[2] * width).alias("x2"), (height - at[1] * height).alias("y2"))
    return F.when(bbox.isNotNull() & width.isNotNull(), rect)


def _entry(kind: str, text: Column, role: str | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), T.strip(F.coalesce(text, F.lit(""))).alias("text"), F.lit(role).cast("string").alias("role"))


def _each(kind: str, texts: str, role: str | None = None, change=lambda c: c) -> Column:
    return F.coalesce(F.transform(texts, lambda c: _entry(kind, change(c), role)), F.array().cast("array<struct<kind:string,text:string,role:string>>"))


def content_blocks(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Content items → blocks: one item gives any number, by its type. pages(doc_id, page, width, height).

    Block ids count what was added (m0, m1, ...) before anything is merged. Columns beyond the block schema: latex, table_html.
    """
    none = F.array().cast("array<struct<kind:string,text:string,role:string>>")
    text, kind = F.col("text"), F.col("type")
    made = (
        F.when(kind.isin(*SKIPPED), none)
        .when(kind == "equation", F.array(_entry("math", F.lit(""))))
        .when(kind == "image", F.concat(F.array(_entry("image", F.lit(""))), _each("caption", "image_caption", "caption"), _each("paragraph", "image_footnote", "footnote")))
        .when(kind == "table", F.concat(_each("caption", "table_caption", "caption", lambda c: F.regexp_replace(c, rf"{T.WS}*\n{T.WS}*", " ")), F.array(_entry("table", F.lit(""))), _each("paragraph", "table_footnote", "footnote")))
        .when(kind == "list", _each("listitem", "list_items", None, lambda c: F.regexp_replace(c, rf"^{T.WS}*[-•·]{T.WS}+", "")))
        .when(kind == "page_footnote", F.array(_entry("paragraph", text, "footnote")))
        .when(T.strip(F.coalesce(text, F.lit(""))) == "", none)
        .when(F.coalesce("text_level", F.lit(0)) != 0, F.array(_entry("heading", text)))
        .otherwise(F.array(_entry("paragraph", text)))
    )
    rows = items.select("*", F.posexplode(made).alias("pos", "b"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "pos")).cast("bigint") - 1
    rows = rows.join(pages.select("doc_id", F.col("page").alias("page_idx"), "width", "height"), ["doc_id", "page_idx"], "left")
    rect = rect_of(F.col("bbox"), F.col("page_idx"), F.col("width"), F.col("height"))
    out = rows.withColumn("n", number).select(
        "doc_id", F.col("n").alias("ord"), F.concat(F.lit("m"), F.col("n").cast("string")).alias("block_id"), F.col("b.kind").alias("kind"), F.lit(None).cast("int").alias("level"), F.col("b.role").alias("role"),
        F.col("b.text").alias("text"), F.col("b.text").contains("$").alias("inline_math"), F.filter(F.array(rect), lambda r: r.isNotNull()).alias("rects"),
        F.when(F.col("b.kind") == "math", T.clean_latex(F.coalesce(text, F.lit("")))).alias("latex"), F.when(F.col("b.kind") == "table", F.col("table_body")).alias("table_html"),
    )
    return with_levels(out)


def heading_level(text: Column, before: Column) -> Column:
    """The depth that a heading's number gives it; before: the letter of the last lettered heading. "C." after "B." is a letter, else Roman."""
    t = T.strip(text)
    letter = F.regexp_extract(t, rf"^([A-Z])\.{T.WS}", 1)
    dotted = F.regexp_extract(t, rf"^(\d+(?:\.\d+)*)\.?{T.WS}", 1)
    return (
        F.when((letter != "") & (before != "") & (F.ascii(letter) == F.ascii(before) + 1), 2)
        .when(t.rlike(rf"^[IVXLC]+\.{T.WS}"), 1)
        .when(letter != "", 2)
        .when(t.rlike(rf"^\d+\){T.WS}"), 3)
        .when(dotted != "", F.least(F.lit(4), F.size(F.split(dotted, r"\."))))
        .otherwise(1)
    )


def level_list(heads: Column, all_numbered: bool) -> Column:
    """A fold over the headings of a document, array<struct<ord, text, level>> in order → array<struct<ord, level>>.

    all_numbered: each heading takes part; else unnumbered ones keep their own level.
    """
    start = F.struct(F.lit("").alias("letter"), F.array().cast("array<struct<ord:bigint,level:int>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        counts = F.lit(True) if all_numbered else h["text"].rlike(NUMBERED)
        lv = F.when(counts, heading_level(h["text"], acc["letter"])).otherwise(F.coalesce(h["level"], F.lit(1))).cast("int")
        letter = F.when(~counts, acc["letter"]).when(lv == 2, F.regexp_extract(h["text"], r"^\s*([A-Z])\.", 1)).when(lv == 1, "").otherwise(acc["letter"])
        return F.struct(letter.alias("letter"), F.concat(acc["out"], F.array(F.struct(h["ord"].alias("ord"), lv.alias("level")))).alias("out"))

    return F.aggregate(heads, start, step, lambda acc: acc["out"])


def _leveled(blocks: DataFrame, all_numbered: bool) -> DataFrame:
    heads = blocks.where("kind = 'heading' and trim(text) <> ''").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text", "level"))).alias("h"))
    return heads.select("doc_id", F.explode(level_list(F.col("h"), all_numbered)).alias("l")).select("doc_id", "l.ord", F.col("l.level").alias("__level"))


def with_levels(blocks: DataFrame) -> DataFrame:
    """Headings with the level that their numbering gives."""
    return blocks.join(_leveled(blocks, True), ["doc_id", "ord"], "left").withColumn("level", F.coalesce("__level", "level")).select(*blocks.columns)


def finished(blocks: DataFrame) -> DataFrame:
    """Tagged and merged as the last steps for content lists: only sentences left open are joined."""
    base = blocks.select("doc_id", "ord", "block_id", "kind", "level", "role", "text", "inline_math", "rects")
    return merge_split_paragraphs(mark_front_matter(mark_references(base)), only_mid_sentence=True)


def outline(blocks: DataFrame) -> DataFrame:
    """Headings as an outline: doc_id, ord, block_id, text, depth (0 is the top), has_children."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    rows = blocks.join(_leveled(blocks, False), ["doc_id", "ord"])
    return rows.select(
        "doc_id", "ord", "block_id", "text", (F.col("__level") - F.min("__level").over(Window.partitionBy("doc_id"))).alias("depth"),
        F.coalesce(F.lead("__level").over(w) > F.col("__level"), F.lit(False)).alias("has_children"),
    )


def rendered_outline(headings: DataFrame, sentences: DataFrame) -> DataFrame:
    """An outline with its headings' renderings: sentences(doc_id, block_id, idx, zh) of each are joined in order. Adds zh, empty where there is none."""
    have = sentences.where("zh <> ''").groupBy("doc_id", "block_id").agg(F.sort_array(F.collect_list(F.struct("idx", "zh"))).alias("s"))
    zh = F.coalesce(F.array_join(F.transform("s", lambda x: x["zh"]), ""), F.lit(""))
    return headings.join(have, ["doc_id", "block_id"], "left").withColumn("zh", zh).drop("s")


def titles(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Title and id of documents(doc_id, source, attachment, pdf_hash, version, title): title is that of the outline's first entry, or of the base parse.

    The first parse prefers its outline's title to its first heading; content lists prefer their first heading to the title of the base parse.
    """
    first = blocks.where("kind = 'heading'").groupBy("doc_id").agg(F.min_by("text", "ord").alias("__h"))
    sdt = F.col("source") == "sdt"
    parser = F.when(sdt, F.concat(F.lit("sdt"), "version")).otherwise("mineru")
    return documents.join(first, "doc_id", "left").select(
        "doc_id", F.when(sdt, F.coalesce("title", "__h")).otherwise(F.coalesce("__h", "title")).alias("title"),
        F.concat_ws("|", "attachment", F.coalesce("pdf_hash", F.lit("")), parser).alias("document_id"),
    )


def visible(headings: DataFrame) -> DataFrame:
    """Which headings of an outline (doc_id, ord, depth, folded) show: not those below a folded one."""
    rows = headings.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "depth", "folded"))).alias("h"))
    top = F.lit(1 << 30)
    start = F.struct(top.alias("below"), F.array().cast("array<struct<ord:bigint,hidden:boolean>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        below = F.when(h["depth"] <= acc["below"], top).otherwise(acc["below"])
        hidden = below != top
        return F.struct(F.when(~hidden & h["folded"], h["depth"]).otherwise(below).alias("below"), F.concat(acc["out"], F.array(F.struct(h["ord"].alias("ord"), hidden.alias("hidden")))).alias("out"))

    return rows.select("doc_id", F.explode(F.aggregate("h", start, step, lambda a: a["out"])).alias("r")).select("doc_id", "r.ord", "r.hidden")
