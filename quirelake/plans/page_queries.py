"""Queries on pages, boxes, content lists and small files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.operators import content as C, geometry as G
from quirelake.plans.base import table
from quirelake.schemas import RECT
from quirelake.sources import readers as R

RECT_SQL = "STRUCT(page INTEGER, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)"


def _box(page, e, at: int = 0):
    """A box from four components of an embedding."""
    x, y = F.abs(e[at]) * 400, F.abs(e[at + 1]) * 400
    return F.struct(page.cast("int").alias("page"), x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 20 + F.abs(e[at + 2]) * 200).cast("double").alias("x2"), (y + 20 + F.abs(e[at + 3]) * 200).cast("double").alias("y2"))


def _boxes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    return e.select((F.col("vec_id") % 50).alias("doc_id"), F.floor(F.col("vec_id") / 50).alias("ord"), "label", _box(F.col("vec_id") % 3, F.col("e")).alias("a"), _box(F.col("vec_id") % 3, F.col("e"), 4).alias("b"))


_X = "CAST({e}[{i}] AS DOUBLE)"


def _sql_box(i: int) -> str:
    e = [f"abs(CAST(embedding[{i + k}] AS DOUBLE))" for k in range(1, 5)]
    return f"{{'page': (vec_id % 3)::INTEGER, 'x1': {e[0]} * 400, 'y1': {e[1]} * 400, 'x2': {e[0]} * 400 + 20 + {e[2]} * 200, 'y2': {e[1]} * 400 + 20 + {e[3]} * 200}}"


_BOXES = f"boxes AS (SELECT vec_id % 50 AS doc_id, vec_id // 50 AS ord, label, {_sql_box(0)} AS a, {_sql_box(4)} AS b FROM embeddings)"


def overlap_match(spark, sf_dir):
    """Each vector gives a block box and an item box; a third of both are tables."""
    rows = _boxes(spark, sf_dir)
    kind = F.when(F.col("label") % 3 == 0, "table").when(F.col("label") % 3 == 1, "math").otherwise("paragraph")
    blocks = rows.select("doc_id", "ord", F.concat(F.lit("b"), F.col("ord").cast("string")).alias("block_id"), kind.alias("kind"), F.lit("short").alias("text"), F.array("a").alias("rects"))
    items = rows.select("doc_id", "ord", F.when(F.col("ord") % 2 == 0, "table").otherwise("equation").alias("kind"), F.col("b").alias("rect"))
    out = G.match_boxes(blocks, items)
    return out.select("doc_id", "block_id", F.coalesce("item_ord", F.lit(-1)).alias("item_ord"), F.coalesce("covered_by", F.lit("")).alias("covered_by"))


_MATCH = f"""
WITH {_BOXES}, bl AS (SELECT doc_id, ord, a, CASE WHEN label % 3 = 0 THEN 'table' WHEN label % 3 = 1 THEN 'math' ELSE 'paragraph' END AS kind FROM boxes), it AS (SELECT doc_id, ord, b, CASE WHEN ord % 2 = 0 THEN 'table' ELSE 'equation' END AS kind FROM boxes),
p AS (SELECT bl.doc_id, bl.ord AS bo, bl.kind, it.ord AS io, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) AS m
  FROM bl JOIN it ON bl.doc_id = it.doc_id AND a.page = b.page AND it.kind = CASE WHEN bl.kind = 'table' THEN 'table' ELSE 'equation' END),
t AS (SELECT doc_id, bo, kind, io, i / m AS score FROM p WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, bo ORDER BY i / m DESC, io) = 1),
o AS (SELECT doc_id, io, min(bo) AS owner FROM t WHERE kind <> 'paragraph' AND score >= 0.5 GROUP BY doc_id, io)
SELECT t.doc_id, 'b' || bo AS block_id, CASE WHEN bo = owner THEN io ELSE -1 END AS item_ord, CASE WHEN bo = owner THEN '' ELSE 'b' || owner END AS covered_by FROM t JOIN o USING (doc_id, io) WHERE (kind <> 'paragraph' AND score >= 0.5) OR (kind = 'paragraph' AND score >= 0.8)
"""


def crop_rects(spark, sf_dir):
    rows = _boxes(spark, sf_dir).select("doc_id", "ord", G.crop_rect(F.array("a", "b")).alias("r"))
    return rows.select("doc_id", "ord", "r.page", *[G.rounded(F.col(f"r.{k}")).alias(k) for k in ("x1", "y1", "x2", "y2")])


def page_markers(spark, sf_dir):
    """Blocks on pages that go up and down, every fourth without a box."""
    rows = _boxes(spark, sf_dir).select("doc_id", "ord", F.when(F.col("ord") % 4 == 3, F.array().cast(f"array<{RECT}>")).otherwise(F.array(F.col("a").withField("page", (F.col("ord") % 5).cast("int")))).alias("rects"))
    return G.page_markers(rows)


def sort_keys(spark, sf_dir):
    rows = _boxes(spark, sf_dir)
    return rows.select("doc_id", "ord", G.sort_index(F.col("a.page"), F.floor(F.col("a.x1") * 1000), F.floor(F.col("a.y1")) - 100).alias("key"), G.rounded(F.col("a.x1") - 200).alias("x"))


def units_under(spark, sf_dir):
    """Sentence boxes under annotations of their document and page."""
    rows = _boxes(spark, sf_dir)
    boxes = rows.select("doc_id", F.col("ord").cast("string").alias("unit_id"), F.array("a").alias("lines"))
    notes = rows.select((F.col("doc_id") * 1000000 + F.col("ord")).alias("annotation_id"), "doc_id", F.col("b.page").alias("page"), F.array("b").alias("rects"), F.when(F.col("ord") % 2 == 0, F.array("a")).alias("next_rects"))
    return G.units_under(boxes, notes)


_UNDER = f"""
WITH {_BOXES}, n AS (SELECT doc_id * 1000000 + ord AS annotation_id, doc_id, b.page AS page, b AS q FROM boxes UNION ALL SELECT doc_id * 1000000 + ord, doc_id, b.page + 1, a FROM boxes WHERE ord % 2 = 0)
SELECT DISTINCT annotation_id, n.doc_id, unit_id FROM (SELECT annotation_id, n.doc_id, boxes.ord::VARCHAR AS unit_id, sum(greatest(0, least(a.x2, q.x2) - greatest(a.x1, q.x1)) * greatest(0, least(a.y2, q.y2) - greatest(a.y1, q.y1))) / any_value((a.x2 - a.x1) * (a.y2 - a.y1)) AS s FROM n JOIN boxes ON n.doc_id = boxes.doc_id AND n.page = a.page GROUP BY ALL) AS n WHERE s >= 0.3
"""


def line_boxes(spark, sf_dir):
    """The boxes of a document's page in order, merged to lines."""
    rows = _boxes(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "a"))).alias("c"))
    return rows.select("doc_id", F.posexplode(G.merge_lines(F.transform("c", lambda c: c["a"]))).alias("nth", "l")).select("doc_id", "nth", "l.*")


NUMBERS = ("I. ", "A. ", "B. ", "C. ", "1) ", "2.1 ", "3. ", "V. ", "", "2.1.1.1.1 ")


def _heads(spark, sf_dir):
    """Turns as headings under numbers of all kinds; the unnumbered ones have levels of their own."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "text")
    number = F.array(*map(F.lit, NUMBERS))[F.pmod(F.col("doc_id") * 7 + F.col("ord") * F.col("ord") * 3 + F.col("ord"), F.lit(len(NUMBERS))).cast("int")]
    return t.select("doc_id", "ord", F.concat(F.lit("b"), "ord").alias("block_id"), F.lit("heading").alias("kind"), (1 + F.col("ord") % 3).cast("int").alias("level"), F.lit(None).cast("string").alias("role"), F.concat(number, "text").alias("text"), F.lit(False).alias("inline_math"), F.array().cast(f"array<{RECT}>").alias("rects"))


def heading_levels(spark, sf_dir):
    return C.with_levels(_heads(spark, sf_dir)).select("doc_id", "ord", "level")


def outline(spark, sf_dir):
    return C.outline(_heads(spark, sf_dir)).select("doc_id", "ord", "depth", "has_children")


def rendered_outline(spark, sf_dir):
    """Turns as headings of two sentences each, of which every third has no rendering."""
    heads = _heads(spark, sf_dir)
    parts = heads.select("doc_id", "block_id", "ord", F.explode(F.array(F.lit(0), F.lit(1))).alias("idx"))
    zh = F.when((F.col("ord") + F.col("idx")) % 3 > 0, F.concat(F.lit("z"), "ord", F.lit("."), "idx"))
    return C.rendered_outline(C.outline(heads), parts.select("doc_id", "block_id", "idx", zh.alias("zh"))).select("doc_id", "ord", "depth", "zh")


def _levels_sql(all_numbered: bool) -> str:
    """Level and last letter, heading by heading; t is the heading, own its own level, c what stands before the text."""
    counts = "true" if all_numbered else "c <> '' OR regexp_matches(t, '^\\s*([IVXLC]+\\.|[A-Z]\\.|\\d+\\)|\\d+(\\.\\d+)*\\.?)\\s')"
    level = "CASE WHEN NOT counts THEN own WHEN a <> '' AND letter <> '' AND ord(a) = ord(letter) + 1 THEN 2 WHEN regexp_matches(t, '^[IVXLC]+\\.\\s') THEN 1 WHEN a <> '' THEN 2 WHEN regexp_matches(t, '^\\d+\\)\\s') THEN 3 WHEN d <> '' THEN least(4, len(string_split(d, '.'))) ELSE 1 END"
    after = "CASE WHEN NOT counts THEN letter WHEN lv = 2 THEN a WHEN lv = 1 THEN '' ELSE letter END"
    numbers = ", ".join(f"'{n}'" for n in NUMBERS)
    return f"""RECURSIVE h0 AS (SELECT conv_id AS doc_id, turn AS o, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, 1 + turn % 3 AS own, ([{numbers}])[1 + (conv_id * 7 + turn * turn * 3 + turn) % {len(NUMBERS)}] AS c, trim(c || text) AS t FROM conversations),
h AS (SELECT *, {counts} AS counts, regexp_extract(t, '^([A-Z])\\.\\s', 1) AS a, regexp_extract(t, '^(\\d+(?:\\.\\d+)*)\\.?\\s', 1) AS d FROM h0 WHERE t <> ''),
z AS (SELECT doc_id, 0::BIGINT AS i, -1::BIGINT AS o, 0::BIGINT AS lv, '' AS letter FROM (SELECT DISTINCT doc_id FROM h)
  UNION ALL SELECT doc_id, i, o, lv, {after} FROM (SELECT h.*, z.letter, ({level})::BIGINT AS lv FROM z JOIN h ON h.doc_id = z.doc_id AND h.i = z.i + 1)), levels AS (SELECT doc_id, o AS ord, lv FROM z WHERE i > 0)"""


def fold_visibility(spark, sf_dir):
    """Turns as headings of an outline, some of them folded."""
    t = table(spark, sf_dir, "conversations")
    return C.visible(t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), ((F.col("conv_id") + F.col("turn") * F.col("turn")) % 4).cast("int").alias("depth"), ((F.col("conv_id") + F.col("turn")) % 3 == 0).alias("folded")))


_FOLDS = """
WITH h AS (SELECT conv_id AS doc_id, turn AS ord, (conv_id + turn * turn) % 4 AS depth, (conv_id + turn) % 3 = 0 AS folded FROM conversations)
SELECT doc_id, ord, EXISTS (SELECT 1 FROM h f WHERE f.doc_id = h.doc_id AND f.ord < h.ord AND f.folded AND NOT EXISTS (SELECT 1 FROM h m WHERE m.doc_id = h.doc_id AND m.ord > f.ord AND m.ord <= h.ord AND m.depth <= f.depth)) AS hidden FROM h
"""


def html_blocks(spark, sf_dir):
    """All web pages as content lists, then as tagged and merged blocks."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    sizes = pages.select("doc_id", F.lit(0).alias("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    out = C.finished(C.content_blocks(R.html_content(pages), sizes))
    return out.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("kind") == "heading").alias("headings"), F.count_if(F.col("kind") == "listitem").alias("items"), F.sum(F.length("text")).alias("chars"))


QUERIES = {
    "overlap_match": overlap_match, "crop_rects": crop_rects, "page_markers": page_markers, "sort_keys": sort_keys, "units_under": units_under, "line_boxes": line_boxes, "heading_levels": heading_levels, "outline": outline, "rendered_outline": rendered_outline,
    "fold_visibility": fold_visibility, "html_blocks": html_blocks,
}


def _r(x: str) -> str:
    return f"floor(({x}) * 1000 + 0.5) / 1000"


ORACLES = {
    "overlap_match": _MATCH, "units_under": _UNDER,
    "crop_rects": f"WITH {_BOXES} SELECT doc_id, ord, a.page AS page, {_r('least(a.x1, b.x1) - 3')} AS x1, {_r('least(a.y1, b.y1) - 3')} AS y1, {_r('greatest(a.x2, b.x2) + 3')} AS x2, {_r('greatest(a.y2, b.y2) + 3')} AS y2 FROM boxes",
    "page_markers": f"WITH {_BOXES}, p AS (SELECT doc_id, ord, CASE WHEN ord % 4 = 3 THEN NULL ELSE (ord % 5)::INTEGER END AS page FROM boxes), q AS (SELECT *, coalesce(max(page) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS b FROM p) SELECT doc_id, ord, page FROM q WHERE page > b",
    "sort_keys": f"WITH {_BOXES} SELECT doc_id, ord, lpad(a.page::VARCHAR, 5, '0') || '|' || lpad(least(999999, floor(a.x1 * 1000)::BIGINT)::VARCHAR, 6, '0') || '|' || lpad(greatest(0, floor(a.y1)::BIGINT - 100)::VARCHAR, 5, '0') AS key, {_r('a.x1 - 200')} AS x FROM boxes",
    "heading_levels": f"WITH {_levels_sql(True)} SELECT doc_id, ord, lv::INTEGER AS level FROM levels",
    "rendered_outline": f"WITH {_levels_sql(False)} SELECT doc_id, ord, (lv - min(lv) OVER (PARTITION BY doc_id))::INTEGER AS depth, CASE ord % 3 WHEN 0 THEN '' ELSE 'z' || ord || '.0' END || CASE ord % 3 WHEN 2 THEN '' ELSE 'z' || ord || '.1' END AS zh FROM levels",
    "outline": f"WITH {_levels_sql(False)} SELECT doc_id, ord, (lv - min(lv) OVER (PARTITION BY doc_id))::INTEGER AS depth, coalesce(lead(lv) OVER (PARTITION BY doc_id ORDER BY ord) > lv, false) AS has_children FROM levels",
    "fold_visibility": _FOLDS,
}
