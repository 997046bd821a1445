"""Blocks: tagging, merging and cutting into sentences. Every window runs over PARTITION BY doc_id ORDER BY ord, so one shuffle serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T

# Headings that start and end a list of references, and lines that publishers add to a paper.
REFERENCES = r"(?i)^(?:[ivx\d]+\.?\s*)?(references|bibliography|literature cited|参考文献)\s*\z"
APPENDIX = r"(?i)^(?:[a-z\d]+\.?\s*)?(appendix|appendices|附录)"
FRONT_MATTER = (
    r"(?i)^\s*Manuscript received(?![A-Za-z0-9_])",
    r"(?i)^\s*(Received|Accepted|Available online|Published)\s*:?\s*\d",
    r"(?i)^[^.]{0,200}(?<![A-Za-z0-9_])is (also |now )?with (the )?[^.]*(e-?mail|\.edu|University|Institute|Laboratory)",
    r"(?i)^\s*\*?\s*Corresponding author(?![A-Za-z0-9_])",
    r"(?i)^\s*E-?mail addresses?\s*:",
    r"(?i)^\s*Color versions of one or more (of the )?figures(?![A-Za-z0-9_])",
    r"(?i)^\s*Digital Object Identifier(?![A-Za-z0-9_])",
    r"(?i)^\s*(https?:\/\/)?doi\.org\/\S+\s*\z",
    r"(?i)©|(?<![A-Za-z0-9_])Personal use is permitted(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])All rights reserved(?![A-Za-z0-9_])",
)
TABLE_CAPTION = r"(?i)^\s*TABLE\s+([IVXLC]+|\d+)(?![A-Za-z0-9_])"


def by_doc():
    """The window of a document in reading order."""
    return Window.partitionBy("doc_id").orderBy("ord")


def so_far():
    return by_doc().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def mark_references(blocks: DataFrame) -> DataFrame:
    """role `reference` for paragraphs and list items after a references heading, until an appendix heading."""
    title = T.strip(F.col("text"))
    event = F.when(F.col("kind") == "heading", F.when(title.rlike(REFERENCES), True).when(title.rlike(APPENDIX), False))
    inside = F.coalesce(F.last(event, ignorenulls=True).over(so_far()), F.lit(False))
    return blocks.withColumn("role", F.when(inside & F.col("kind").isin("paragraph", "listitem"), "reference").otherwise(F.col("role")))


def mark_front_matter(blocks: DataFrame) -> DataFrame:
    """role `footnote` for short paragraphs and list items without a role that are publisher's lines."""
    fits = F.lit(False)
    for p in FRONT_MATTER:
        fits = fits | F.col("text").rlike(p)
    return blocks.withColumn("role", F.when(F.col("role").isNull() & F.col("kind").isin("paragraph", "listitem") & (F.length("text") <= 600) & fits, "footnote").otherwise(F.col("role")))


def translatable(kind: Column, role: Column, text: Column) -> Column:
    """Whether a block is cut into sentences: it has a word, and is body text."""
    return text.rlike("[A-Za-z]{2,}") & ~F.coalesce(role.isin("reference", "footnote"), F.lit(False)) & kind.isin("paragraph", "listitem", "caption", "heading")


def merge_drop_caps(blocks: DataFrame) -> DataFrame:
    """A heading of one capital before a paragraph that starts with a capital becomes the paragraph's first letter."""
    w = by_doc()
    one = (F.col("kind") == "heading") & T.strip(F.col("text")).rlike(r"^[A-Z]\z")
    body = (F.col("kind") == "paragraph") & F.col("text").rlike("^[A-Z]")
    marked = blocks.withColumns({
        "__cap": one & F.coalesce(F.lead(body).over(w), F.lit(False)),
        "__letter": F.when(body & F.coalesce(F.lag(one).over(w), F.lit(False)), F.lag(T.strip(F.col("text"))).over(w)),
        "__rects": F.lag("rects").over(w),
    })
    joined = marked.where(~F.col("__cap")).withColumns({
        "text": F.concat(F.coalesce("__letter", F.lit("")), "text"),
        "rects": F.when(F.col("__letter").isNotNull(), F.concat("__rects", "rects")).otherwise(F.col("rects")),
    })
    return joined.drop("__cap", "__letter", "__rects")


def merge_split_paragraphs(blocks: DataFrame, only_mid_sentence: bool = False) -> DataFrame:
    """Paragraphs broken by a column or page: one that ends open takes in the next body paragraph, past floats and footnotes.

    A run of such paragraphs is an island of a cumulative sum over the blocks that do not interrupt; one aggregation joins each.
    """
    interrupts = F.col("kind").isin("image", "table", "caption") | F.coalesce(F.col("role") == "footnote", F.lit(False))
    body = (F.col("kind") == "paragraph") & F.col("role").isNull()
    opened = body & ~F.col("text").rlike(rf"""[.?!:;]["')\]]?{T.WS}*\z""")
    starts = body & F.col("text").rlike(rf"^{T.WS}*[a-z]") if only_mid_sentence else body
    w = Window.partitionBy("doc_id", "__aside").orderBy("ord")
    marked = blocks.withColumn("__aside", interrupts)
    follows = ~interrupts & starts & F.coalesce(F.lag(opened).over(w), F.lit(False))
    island = F.sum(F.when(follows, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    piece = F.struct("ord", "text", "rects")
    rows = marked.withColumn("__island", island).groupBy("doc_id", "__aside", "__island").agg(
        F.min("ord").alias("ord"), *[F.min_by(c, "ord").alias(c) for c in ("block_id", "kind", "level", "role", "inline_math")], F.sort_array(F.collect_list(piece)).alias("__p")
    )
    glued = F.aggregate(
        F.slice("__p", 2, 1 << 30), F.element_at("__p", 1)["text"],
        lambda a, p: F.concat(a, F.when(a.rlike(rf"({T.WS}|-)\z"), "").otherwise(" "), p["text"]),
    )
    return rows.withColumns({"text": glued, "rects": F.flatten(F.transform("__p", lambda p: p["rects"]))}).select(*blocks.columns)


def with_sentences(blocks: DataFrame) -> DataFrame:
    """The blocks that have sentences to translate."""
    return blocks.where(translatable(F.col("kind"), F.col("role"), F.col("text")))


def to_sentences(blocks: DataFrame) -> DataFrame:
    """Blocks → sentences, one row each, with their ids and hashes. A heading is one sentence as it stands."""
    body = with_sentences(blocks)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end")))
    ranges = F.when(F.col("kind") == "heading", whole).otherwise(T.sentences("text"))
    rows = body.select("doc_id", "ord", "block_id", "text", F.posexplode(ranges).alias("idx", "r"))
    cut = F.substring(F.col("text"), F.col("r.start") + 1, F.col("r.end") - F.col("r.start"))
    rows = rows.select("doc_id", "ord", "block_id", "idx", F.concat_ws(":", "block_id", "idx").alias("unit_id"), F.col("r.start").alias("start"), F.col("r.end").alias("end"), cut.alias("text"))
    return rows.withColumn("hash", T.text_hash(F.col("text")))


def recover_tables(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add a table block under each `TABLE n` caption that has none: the empty region of its column down to the next node.

    nodes(doc_id, rect): boxes of the top-level nodes. Only captions meet them, by document and page.
    """
    w = by_doc()
    nxt = F.lead(F.struct("kind", F.get("rects", F.lit(0)).alias("r"))).over(w)
    caps = blocks.withColumn("__next", nxt).where((F.col("kind") == "caption") & F.col("text").rlike(TABLE_CAPTION) & (F.size("rects") > 0))
    caps = caps.withColumn("c", F.element_at("rects", -1))
    has = F.col("__next.kind").isin("table", "image") & (F.col("__next.r.page") == F.col("c.page")) & (F.col("__next.r.y2") > F.col("c.y1") - 30)
    caps = caps.where(~F.coalesce(has, F.lit(False))).select("doc_id", "block_id", "ord", "c")
    near = caps.join(nodes.select("doc_id", F.col("rect").alias("r")), "doc_id").where("r.page = c.page")
    page = near.groupBy("doc_id", "block_id", "ord", "c").agg(F.min("r.x1").alias("left"), F.max("r.x2").alias("right"), F.min("r.y1").alias("low"), F.collect_list("r").alias("rs"))
    wide = F.col("c.x2") - F.col("c.x1") > (F.col("right") - F.col("left")) * 0.6
    side = ((F.col("c.x1") + F.col("c.x2")) / 2) < (F.col("left") + F.col("right")) / 2
    column = F.filter("rs", lambda r: (wide | ((((r["x1"] + r["x2"]) / 2) < (F.col("left") + F.col("right")) / 2) == side)) & (r["x2"] - r["x1"] > 20))
    page = page.withColumns({
        "x1": F.least(F.col("c.x1"), F.coalesce(F.array_min(F.transform(column, lambda r: r["x1"])), F.col("c.x1"))),
        "x2": F.greatest(F.col("c.x2"), F.coalesce(F.array_max(F.transform(column, lambda r: r["x2"])), F.col("c.x2"))),
    })
    below = F.filter("rs", lambda r: (r["y2"] < F.col("c.y1") - 1) & (r["x2"] > F.col("x1")) & (r["x1"] < F.col("x2")))
    page = page.withColumn("bottom", F.coalesce(F.array_max(F.transform(below, lambda r: r["y2"])), F.col("low"))).where("c.y1 - bottom >= 15")
    rect = F.struct(F.col("c.page").alias("page"), (F.col("x1") - 8).alias("x1"), (F.col("bottom") + 1).alias("y1"), (F.col("x2") + 8).alias("x2"), (F.col("c.y1") - 3).alias("y2"))
    new = page.select(
        "doc_id", F.col("ord").alias("__o"), F.lit(1).alias("__n"), F.concat("block_id", F.lit(".t")).alias("block_id"), F.lit("table").alias("kind"), F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("string").alias("role"), F.lit("").alias("text"), F.lit(False).alias("inline_math"), F.array(rect).alias("rects"),
    )
    rows = blocks.withColumns({"__o": F.col("ord"), "__n": F.lit(0)}).drop("ord").unionByName(new)
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("__o", "__n")).cast("bigint") - 1).select(*blocks.columns)
