"""Queries on task folders, queues, annotations and reading positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.operators import content as C
from quirelake.operators import tasks as K
from quirelake.operators import views as V
from quirelake.plans.base import BLOCKS, line_blocks, table


def queue_round(spark, sf_dir):
    """What one round takes of each document's lines, every eleventh of which holds nothing to do."""
    rows = line_blocks(spark, sf_dir).select("doc_id", F.col("ord").alias("seq"), F.when(F.col("ord") % 11 == 3, 0).otherwise(F.length("text")).alias("chars"))
    return K.taken(rows, ["doc_id"], 900)


def queue_priority(spark, sf_dir):
    """Lines in view go before the others."""
    rows = line_blocks(spark, sf_dir).select("doc_id", "block_id", F.col("ord").alias("seq"))
    return K.prioritized(rows, rows.where("seq between 4 and 6")).select("doc_id", "block_id", "seq")


FILE_NAMES = ("units.json", "parts/1.json", "glossary.md", "report.md", "fix.json", "zz.json")


def last_activity(spark, sf_dir):
    """Events as files of their users' folders."""
    name = F.array(*map(F.lit, FILE_NAMES))[(F.col("event_id") * 5 % 7 % len(FILE_NAMES)).cast("int")]
    return K.last_activity(table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("folder"), name.alias("name"), F.col("event_id").alias("modified")))


def job_summary(spark, sf_dir):
    """Conversations as papers: those of an odd number of turns are not finished."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("done"), F.count_if(F.length("text") < 40).alias("failed"), F.count("*").alias("n"))
    return K.summary(t.select(F.when(F.col("n") % 2 == 0, "done").otherwise("open").alias("state"), "done", "failed"))


def active_source(spark, sf_dir):
    """Documents of every third id have a second parse."""
    rows = line_blocks(spark, sf_dir).select("doc_id", F.lit("sdt").alias("source"), "ord")
    both = rows.unionByName(rows.where("doc_id % 3 = 0 and ord % 2 = 0").withColumn("source", F.lit("mineru")))
    return K.active_source(both).groupBy("doc_id", "source").agg(F.count("*").alias("n"))


def annotation_changes(spark, sf_dir):
    """Events as highlights, of which some get another colour, some another comment, and some go."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("annotation_id"), F.col("event_type").alias("color"), F.concat(F.lit("c"), "user_id").alias("comment"))
    new = e.where("annotation_id % 4 = 1").select("annotation_id", F.when(F.col("annotation_id") % 8 == 1, "red").alias("color"), F.when(F.col("annotation_id") % 3 == 0, "new").alias("comment"))
    return K.deleted(K.updated(e, new), e.where("annotation_id % 9 = 2").select("annotation_id"))


def annotations(spark, sf_dir):
    """Events as annotations: some are of another kind, some have no position that can be read, some go on to the next page."""
    k = F.col("event_id")
    good = F.concat(F.lit('{"pageIndex": '), k % 9, F.lit(', "rects": [[1, 2.5, '), k, F.lit(", 4], [0, 0, 1, 1]]"), F.when(k % 3 == 0, ', "nextPageRects": [[5, 6, 7, 8]]').otherwise(""), F.lit("}"))
    position = F.when(k % 7 == 0, "{").when(k % 7 == 1, '{"pageIndex": "2", "rects": []}').when(k % 7 == 2, '{"pageIndex": 2, "rects": {}}').when(k % 7 == 3, '{"rects": []}').when(k % 7 == 4, F.lit(None)).otherwise(good)
    kind = F.when(k % 4 == 0, "ink").when(k % 4 == 1, "underline").otherwise("highlight")
    label = F.when(k % 5 == 0, F.concat(F.lit("p"), k)).when(k % 5 == 1, "")
    raw = table(spark, sf_dir, "events").select(k.alias("annotation_id"), kind.alias("type"), F.col("event_type").alias("color"), F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("c"), "user_id")).alias("comment"), F.col("props").alias("text"), label.alias("page_label"), position.alias("position"))
    found = K.annotations(raw)
    return found.select("annotation_id", "kind", "color", "comment", "text", "page_label", "page", F.size("rects").alias("n"), F.col("rects")[0][1].alias("y1"), F.col("rects")[0][2].alias("x2"), F.coalesce(F.get(F.get("next_rects", F.lit(0)), F.lit(2)), F.lit(-1.0)).alias("next_x2"))


def first_highlight(spark, sf_dir):
    """Events as highlights of two users' sentences each; the lists are in falling order of ids."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("annotation_id"), (-F.col("event_id")).alias("nth"), F.array("user_id", F.col("user_id") + 1).alias("unit_ids"), F.col("event_type").alias("comment"))
    return K.first_highlight(e)


def still_busy(spark, sf_dir):
    """Documents' lines as units that paragraphs of five lines wait for; two of three are answered."""
    units = line_blocks(spark, sf_dir).select(F.concat_ws(":", "doc_id", F.floor(F.col("ord") / 5)).alias("block_id"), F.concat_ws(":", "doc_id", "ord").alias("unit_id"), "ord")
    return K.still_busy(units, units.where("ord % 3 > 0"))


def last_problems(spark, sf_dir):
    """Short lines of documents as problems of their source."""
    rows = line_blocks(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").where("kind = 'heading'")
    return K.last_problems(rows.select("source", F.struct("doc_id", "ord").alias("ord"), F.col("text").alias("problem")), ["source"])


def document_titles(spark, sf_dir):
    """Documents of even ids as first parses; every third has a title of its own."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(k % 2 == 0, "sdt").otherwise("mineru").alias("source"), F.concat(F.lit("A"), k).alias("attachment"), F.when(k % 5 > 0, F.md5(F.col("doc_id").cast("string"))).alias("pdf_hash"),
        (k % 4).cast("string").alias("version"), F.when(k % 3 == 0, F.concat(F.lit("Title "), k)).alias("title"),
    )
    return C.titles(line_blocks(spark, sf_dir), docs)


def api_engines(spark, sf_dir):
    """Customers as providers of two models; some have no key, some no address."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("id"), F.col("c_name").alias("name"), F.when(k % 3 > 0, F.concat(F.lit("http://"), k)).alias("base"), F.when(k % 4 > 0, F.col("c_name")).otherwise("").alias("key"),
        F.array(F.lit("m"), F.col("c_mktsegment")).alias("models"),
    )
    return K.api_engines(rows)


def selected_units(spark, sf_dir):
    """Each document has a selection from its second line to its fifth; units are the first ten characters of a line and the rest."""
    blocks = line_blocks(spark, sf_dir).select("doc_id", "ord", "text")
    size = F.length("text")
    cut = F.array(F.struct(F.lit(0).alias("n"), F.lit(0).alias("start"), F.least(size, F.lit(10)).alias("end")), F.struct(F.lit(1).alias("n"), F.lit(10).alias("start"), size.alias("end")))
    spans = blocks.select("doc_id", "ord", F.explode(cut).alias("s")).select("doc_id", "ord", F.concat_ws(":", "ord", "s.n").alias("unit_id"), "s.start", "s.end").where("start < end")
    place = {"sel_id": F.lit(0), "from_ord": F.lit(1).cast("bigint"), "from_at": F.lit(4), "to_ord": F.lit(4).cast("bigint"), "to_at": F.lit(11)}
    return V.selected_units(table(spark, sf_dir, "documents").select("doc_id").withColumns(place), spans, blocks).select("doc_id", "unit_id")


def english_view(spark, sf_dir):
    """Lines, with every word of over eight letters taken as a sentence of its own."""
    blocks = line_blocks(spark, sf_dir).select("doc_id", "block_id", "text")
    first = F.regexp_instr("text", F.lit("[a-z]{9,}"))
    word = F.regexp_extract("text", "[a-z]{9,}", 0)
    units = blocks.where(first > 0).select("doc_id", "block_id", F.concat("block_id", F.lit(":0")).alias("unit_id"), (first - 1).alias("start"), (first - 1 + F.length(word)).alias("end"))
    return K.english_view(blocks, units).groupBy("doc_id").agg(F.count("*").alias("runs"), F.count("unit_id").alias("units"), F.sum(F.length("run")).alias("chars"))


def blind_sheet(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("unit_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"), F.col("text").alias("en"))
    runs = t.select("unit_id", "en", F.explode(F.array(F.lit("x"), F.lit("y"), F.lit("z"))).alias("engine")).withColumn("zh", F.upper("en"))
    from quirelake.operators.views import blind_sample

    return K.blind_sheet(runs, blind_sample(t.select("unit_id", "ord"), 20))


QUERIES = {
    "queue_round": queue_round, "queue_priority": queue_priority, "last_activity": last_activity, "job_summary": job_summary, "active_source": active_source,
    "annotations": annotations, "first_highlight": first_highlight, "still_busy": still_busy, "last_problems": last_problems, "document_titles": document_titles, "api_engines": api_engines, "selected_units": selected_units,
    "annotation_changes": annotation_changes, "english_view": english_view, "blind_sheet": blind_sheet,
}

ORACLES = {
    "queue_round": f"WITH {BLOCKS}, q AS (SELECT doc_id, ord AS seq, (CASE WHEN ord % 11 = 3 THEN 0 ELSE length(text) END)::INTEGER AS chars FROM blocks), s AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM q WHERE chars > 0) SELECT doc_id, seq, chars FROM s WHERE b < 900",
    "queue_priority": f"WITH {BLOCKS} SELECT doc_id, block_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN ord BETWEEN 4 AND 6 THEN 0 ELSE 1 END, ord) - 1 AS seq FROM blocks",
    "last_activity": f"WITH f AS (SELECT 'u' || user_id AS folder, ([{', '.join(repr(n) for n in FILE_NAMES)}])[1 + event_id * 5 % 7 % {len(FILE_NAMES)}] AS name, event_id FROM events) SELECT folder, max(event_id) AS last_write, bool_or(name = 'report.md') AS report, bool_or(name = 'glossary.md') AS glossary FROM f WHERE name NOT IN ('units.json', 'TASK.md', 'FIX.md', 'job.json', 'fix.json') GROUP BY folder",
    "job_summary": "WITH t AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'assistant') AS d, count(*) FILTER (length(text) < 40) AS f FROM conversations GROUP BY conv_id) SELECT count(*) AS papers, count(*) FILTER (n % 2 = 0) AS finished, coalesce(sum(d), 0)::BIGINT AS sentences, coalesce(sum(f), 0)::BIGINT AS failed FROM t",
    "active_source": f"WITH {BLOCKS}, b AS (SELECT doc_id, 'sdt' AS source FROM blocks UNION ALL SELECT doc_id, 'mineru' FROM blocks WHERE doc_id % 3 = 0 AND ord % 2 = 0) SELECT doc_id, source, count(*) AS n FROM b WHERE source = CASE WHEN doc_id IN (SELECT doc_id FROM b WHERE source = 'mineru') THEN 'mineru' ELSE 'sdt' END GROUP BY doc_id, source",
    "annotation_changes": "SELECT event_id AS annotation_id, CASE WHEN event_id % 8 = 1 THEN 'red' ELSE event_type END AS color, CASE WHEN event_id % 4 = 1 AND event_id % 3 = 0 THEN 'new' ELSE 'c' || user_id END AS comment FROM events WHERE event_id % 9 <> 2",
    "annotations": "SELECT event_id AS annotation_id, CASE WHEN event_id % 4 = 1 THEN 'underline' ELSE 'highlight' END AS kind, event_type AS color, CASE WHEN event_id % 2 = 1 THEN 'c' || user_id END AS comment, props AS text, CASE WHEN event_id % 5 = 0 THEN 'p' || event_id ELSE (event_id % 9 + 1)::VARCHAR END AS page_label, (event_id % 9)::INTEGER AS page, 2::INTEGER AS n, 2.5::DOUBLE AS y1, event_id::DOUBLE AS x2, CASE WHEN event_id % 3 = 0 THEN 7 ELSE -1 END::DOUBLE AS next_x2 FROM events WHERE event_id % 4 > 0 AND event_id % 7 > 4",
    "first_highlight": "WITH u AS (SELECT event_id, event_type, user_id AS unit_id FROM events UNION ALL SELECT event_id, event_type, user_id + 1 FROM events) SELECT unit_id, max(event_id) AS annotation_id, arg_max(event_type, event_id) AS comment FROM u GROUP BY unit_id",
    "still_busy": f"WITH {BLOCKS} SELECT doc_id || ':' || ord // 5 AS block_id, count(*) AS \"left\" FROM blocks WHERE ord % 3 = 0 GROUP BY 1",
    "last_problems": f"WITH {BLOCKS}, p AS (SELECT d.source, blocks.text, doc_id, ord FROM blocks JOIN documents d USING (doc_id) WHERE kind = 'heading' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC, ord DESC) <= 3) SELECT source, string_agg(text, chr(10) ORDER BY doc_id, ord) AS problems FROM p GROUP BY source",
    "document_titles": f"WITH {BLOCKS}, h AS (SELECT doc_id, arg_min(text, ord) AS h FROM blocks WHERE kind = 'heading' GROUP BY doc_id), d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Title ' || doc_id END AS t FROM documents) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(t, h) ELSE coalesce(h, t) END AS title, 'A' || doc_id || '|' || CASE WHEN doc_id % 5 > 0 THEN md5(doc_id::VARCHAR) ELSE '' END || '|' || CASE WHEN doc_id % 2 = 0 THEN 'sdt' || doc_id % 4 ELSE 'mineru' END AS document_id FROM d LEFT JOIN h USING (doc_id)",
    "api_engines": "SELECT 'api:' || c_custkey || ':' || m AS id, c_name || ' · ' || m AS label, c_custkey % 3 > 0 AND c_custkey % 4 > 0 AS ready, CASE WHEN c_custkey % 4 = 0 THEN 'no API key' WHEN c_custkey % 3 = 0 THEN '' ELSE 'http://' || c_custkey END AS note FROM (SELECT *, unnest(['m', c_mktsegment]) AS m FROM customer)",
    "selected_units": f"WITH {BLOCKS}, u AS (SELECT doc_id, ord, 0 AS n, text[1 + CASE WHEN ord = 1 THEN 4 ELSE 0 END : 10] AS t FROM blocks UNION ALL SELECT doc_id, ord, 1, CASE WHEN ord = 4 THEN text[11:11] ELSE text[11:] END FROM blocks) SELECT doc_id, ord || ':' || n AS unit_id FROM u WHERE ord BETWEEN 1 AND 4 AND trim(t) <> ''",
    "english_view": f"WITH {BLOCKS}, w AS (SELECT doc_id, text, regexp_extract(text, '[a-z]{{9,}}') AS word FROM blocks), p AS (SELECT *, CASE WHEN word <> '' THEN strpos(text, word) - 1 END AS s FROM w) SELECT doc_id, sum(CASE WHEN word = '' THEN 1 ELSE 1 + CASE WHEN s > 0 THEN 1 ELSE 0 END + CASE WHEN s + length(word) < length(text) THEN 1 ELSE 0 END END)::BIGINT AS runs, count(*) FILTER (word <> '') AS units, sum(length(text))::BIGINT AS chars FROM p GROUP BY doc_id",
}
