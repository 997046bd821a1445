"""Queries on files that are written from the tables and read by the readers, and on settings, jobs and marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import protocol as P
from quirelake.operators import tasks as K
from quirelake.operators import views as V
from quirelake.plans.base import BLOCKS, LINES, line_blocks, lines, table
from quirelake.plans.derived_queries import _trees
from quirelake.sources import readers as R
from quirelake.sources import writers as W
from quirelake.sources.files import write_files
from quirelake.sources.tables import fresh_folder
from quirelake.streaming import watch

_NAME = r"name=([^/]+)\.txt$"


def _files(rows: DataFrame, name: str) -> str:
    """rows(name, value) as text files of one line; their folder."""
    root = fresh_folder(rows.sparkSession, name)
    write_files(rows.select(F.concat(F.lit("name="), F.col("name").cast("string"), F.lit(".txt")).alias("name"), F.concat("value", F.lit("\n")).alias("value")), root)
    return root


def cache_files(spark, sf_dir):
    """Each user's events as a cache file, of which some are of another version."""
    events = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("e"))
    unit = F.struct("event_type", F.struct(F.concat(F.lit("z"), F.col("e").cast("string")).alias("zh"), F.lit("x").alias("engine"), F.lit("p4").alias("prompt"), F.lit("").alias("glossary"), F.col("e").alias("t")))
    rows = events.groupBy("user_id").agg(F.map_from_entries(F.collect_list(unit)).alias("units"))
    value = F.to_json(F.struct(F.when(F.col("user_id") % 7 == 0, 2).otherwise(1).alias("version"), F.lit(1).alias("libraryID"), F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("attachmentKey"), "units"))
    return R.caches(spark, _files(rows.select(F.col("user_id").alias("name"), value.alias("value")), "caches")).select("attachment", "hash", "zh", "engine", "t")


def structured_files(spark, sf_dir):
    """Documents as files of structured text; some are packed, and some are cut off."""
    k = F.col("doc_id") % 5
    json = F.to_json("doc")
    rows = _trees(spark, sf_dir).select(F.col("doc_id").alias("name"), F.when(k == 4, F.concat(F.lit("PACK"), json)).when(k == 3, F.substring(json, 1, 40)).otherwise(json).alias("value"))
    found = R.structured_text(spark, _files(rows, "trees"))
    return found.select(F.regexp_extract("path", _NAME, 1).cast("bigint").alias("doc_id"), F.size(F.try_variant_get("doc", "$.content", "array<variant>")).alias("nodes"))


def _answers(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    rows = turns.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("t"), F.col("turn").cast("string")), "text"))).alias("m"))
    return rows.select(F.col("conv_id").alias("name"), F.when(F.col("conv_id") % 7 == 3, '{"half').otherwise(F.to_json("m")).alias("value"))


def delivered_files(spark, sf_dir):
    """Conversations as result files, read back; some are half written."""
    found = R.delivered(spark, _files(_answers(spark, sf_dir), "results"))
    return found.select(F.regexp_extract("file", _NAME, 1).cast("bigint").alias("conv_id"), "unit_id", "zh")


def file_listing(spark, sf_dir):
    """Documents as files: their sizes and hashes."""
    path = _files(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.coalesce("text", F.lit("")).alias("value")), "texts")
    found = R.listed(spark, path).join(R.file_hashes(spark, path), "path")
    return found.select(F.regexp_extract("path", _NAME, 1).cast("bigint").alias("doc_id"), "size", "sha")


def bench_files(spark, sf_dir):
    """Each user's events as a run of an engine; some have no results."""
    entry = F.struct(F.col("event_id").cast("string"), F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("en"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("zh")))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.map_from_entries(F.collect_list(entry)).alias("translations"))
    value = F.to_json(F.struct(F.concat(F.lit("api:"), F.col("user_id").cast("string")).alias("spec"), (F.col("user_id") + 0.5).alias("seconds"), F.size("translations").alias("requests"), F.when(F.col("user_id") % 6 > 0, F.col("translations")).alias("translations")))
    return R.bench_runs(spark, _files(rows.select(F.col("user_id").alias("name"), value.alias("value")), "runs"))


def tool_models(spark, sf_dir):
    """Customers' lists of models in both forms, with hidden ones."""
    k, seg = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    maps = F.concat(F.lit('{"models":{"a":{"info":{"id":"m'), k, F.lit('","name":"'), seg, F.lit('","description":"d","reasoning_efforts":[{"value":"low"},{"id":"high"}]}},"b":{"info":{"id":"h","hidden":true}},"c":{"info":{"id":"plain"}}}}'))
    lists = F.concat(F.lit('{"models":[{"slug":"s'), k, F.lit('","display_name":"'), seg, F.lit('","visibility":"list","supported_reasoning_levels":[{"effort":"x"}]},{"slug":"t","visibility":"hide"}]}'))
    rows = table(spark, sf_dir, "customer").select(k.alias("tool"), F.when(F.col("c_custkey") % 2 == 0, maps).otherwise(lists).alias("value"))
    return R.tool_models(rows).select("tool", "model", "label", F.coalesce(F.array_join("efforts", ","), F.lit("")).alias("efforts"))


def rich_runs(spark, sf_dir):
    """Lines behind a formula, as runs."""
    rows = lines(spark, sf_dir).select("doc_id", "ord", T.rich_runs(F.concat(F.lit("a $x_"), F.col("ord").cast("string"), F.lit("$"), F.translate("text", "$", ""))).alias("r"))
    return rows.select("doc_id", "ord", F.posexplode("r").alias("nth", "run")).select("doc_id", "ord", "nth", "run.math", "run.text")


def json_lines(spark, sf_dir):
    """Events as JSON lines, read back."""
    path = fresh_folder(spark, "lines")
    W.json_documents(table(spark, sf_dir, "events").select(F.struct("event_id", "user_id", "value", "props").alias("v")), "v", path)
    return spark.read.schema("event_id bigint, user_id bigint, value double, props string").json(path)


def report_csv(spark, sf_dir):
    """Counts by event type as a report, read back."""
    path = fresh_folder(spark, "report")
    W.table_csv(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.concat(F.lit('a "b", '), F.first("event_type")).alias("note")), path)
    return spark.read.schema("event_type string, n bigint, note string").csv(path, header=True, escape="\\")


def toggled_bookmarks(spark, sf_dir):
    """Marks on some lines; documents of even ids take that of their third line away, the others set one at their fourth."""
    blocks = line_blocks(spark, sf_dir)
    marks = blocks.where("ord % 5 = 2").select("doc_id", F.col("ord").alias("mark_id"), "block_id", F.substring("text", 1, 120).alias("text"), F.lit(0).alias("page"), F.lit(1).cast("bigint").alias("t"))
    at = blocks.where("ord = 2 + doc_id % 2").select("doc_id", "block_id", "text", F.lit(1).alias("page"))
    return V.toggled(marks, marks.select("doc_id", "mark_id", F.col("block_id").alias("resolved")), at, 9)


def bookmarks_in_order(spark, sf_dir):
    """Lines as marks in falling order, every third of which points nowhere."""
    marks = line_blocks(spark, sf_dir).select("doc_id", (-F.col("ord")).alias("mark_id"), F.when(F.col("ord") % 3 > 0, F.col("block_id")).alias("resolved"), F.when(F.col("ord") % 3 > 0, F.col("ord")).alias("ord"))
    return V.bookmarks_in_order(marks).select("doc_id", "mark_id", "nth")


def paragraph_actions(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(k.alias("id"), V.paragraph_action(k % 5 == 0, k % 3, F.lit(4), k % 7).alias("action"))


def shown_blocks(spark, sf_dir):
    """Lines of which every fourth is a formula; what stands in every third place is covered by one."""
    blocks = line_blocks(spark, sf_dir).withColumn("kind", F.when(F.col("ord") % 4 == 3, "math").otherwise(F.col("kind")))
    return K.shown_blocks(blocks, blocks.select("doc_id", "block_id", F.when(F.col("ord") % 3 == 0, "m").alias("covered_by"))).select("doc_id", "block_id", "kind")


def span_index(spark, sf_dir):
    """Three lines a unit, as its spans, the last one first."""
    spans = line_blocks(spark, sf_dir).select("doc_id", F.concat(F.lit("u"), F.floor(F.col("ord") / 3).cast("string")).alias("unit_id"), (-F.col("ord")).alias("nth"), F.col("ord").alias("start"), (F.col("ord") + F.length("text")).alias("end"))
    return K.span_index(spans).select("doc_id", "unit_id", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


def job_states(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select(F.when(F.col("value") > 50, "done").when(F.col("value") > 20, "open").otherwise("failed").alias("state"))
    return K.by_state(jobs)


def retried_units(spark, sf_dir):
    """Events as failed units of their user's block; users of a multiple of four are asked for again."""
    failed = table(spark, sf_dir, "events").select(F.col("event_id").alias("unit_id"), F.col("user_id").alias("block_id"))
    return watch.retried(failed, failed.where("block_id % 4 = 0"))


def fix_items(spark, sf_dir):
    """Events as units, of which some came back well, some with a problem, some not."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    expected = e.select(k.alias("unit_id"), F.col("event_type").alias("en"))
    checked = e.where("event_id % 4 < 3").select(k.alias("unit_id"), F.when(k % 4 > 0, F.concat(F.lit("z"), k.cast("string"))).alias("zh"), F.when(k % 4 == 2, "lost").alias("problem"))
    return W.fix_items(expected, checked)


def both_sources(spark, sf_dir):
    """Lines as the blocks of two parses, the second of every other line."""
    blocks = line_blocks(spark, sf_dir).select("doc_id", "ord", "block_id")
    return K.both_sources(blocks, blocks.where("ord % 2 = 0").withColumn("block_id", F.when(F.col("ord") % 4 == 0, F.concat(F.lit("m"), F.col("ord").cast("string"))).otherwise(F.col("block_id"))))


def expected_units(spark, sf_dir):
    """Lines as sentences, of which a job waits for every third."""
    units = line_blocks(spark, sf_dir).select("doc_id", "ord", "inline_math", "text", F.concat("block_id", F.lit(":0")).alias("unit_id"))
    return K.expected_units(units, units.where("ord % 3 = 1"))


def settings_put(spark, sf_dir):
    """Customers' settings after changes of some: glossaries set and cleared, positions and bookmarks replaced."""
    people, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    mine = people.where("c_custkey % 5 > 0").select(F.col("c_name").alias("attachment"), F.lit("old").alias("glossary"), F.concat(F.lit("b"), k.cast("string")).alias("position"), F.array(k, k + 1).alias("bookmarks"))
    new = people.where("c_custkey % 2 = 0").select(F.col("c_name").alias("attachment"), F.when(k % 3 == 0, " ").when(k % 3 == 1, F.col("c_mktsegment")).alias("glossary"), F.when(k % 4 == 0, F.array(k * 2)).alias("bookmarks"))
    return K.settings_put(mine, new).select("attachment", "glossary", "position", F.array_join("bookmarks", ",").alias("bookmarks"))


def loaded_providers(spark, sf_dir):
    """Customers' providers: a list, settings of older versions, broken ones, and none."""
    k, n = F.col("c_custkey"), F.col("c_custkey").cast("string")
    listed = F.concat(F.lit('[{"id":"x","name":"N","base":"http://h/'), n, F.lit('/","key":"k","models":["a","","a"],"concurrency":'), n, F.lit(',"effort":"low"},{"models":["'), "c_mktsegment", F.lit('"],"effort":"odd"}]'))
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("owner"), F.when(k % 4 == 0, listed).when(k % 4 == 1, "[{").when(k % 4 == 2, "").alias("providers"), F.when(k % 3 > 0, "key").otherwise("").alias("key"), F.when(k % 2 == 0, "http://o//").alias("base"),
        F.when(k % 5 > 0, F.col("c_mktsegment")).otherwise("").alias("model"), F.when(k % 7 > 0, (k % 90).cast("int")).alias("concurrency"),
    )
    return R.loaded_providers(rows).withColumn("models", F.array_join("models", ","))


def combined_prompts(spark, sf_dir):
    """Prompts in one message, for the paragraphs of a document of which every other unit is asked for."""
    part = F.struct("ord", "kind", F.array(F.struct(F.concat("block_id", F.lit(":0")).alias("id"), F.col("text").alias("en"))).alias("units"), F.col("text").alias("full_text"), F.lit(1).alias("total_units"))
    blocks = line_blocks(spark, sf_dir)
    batches = blocks.select(F.col("doc_id").alias("batch"), part.alias("p")).groupBy("batch").agg(F.sort_array(F.collect_list("p")).alias("p"))
    ids = blocks.where("ord % 2 = 1").select(F.col("doc_id").alias("batch"), F.concat("block_id", F.lit(":0")).alias("unit_id"))
    prompt = P.combined_prompt(F.col("p"), F.size("p"), F.lit("T"))
    return P.sub_batch(batches, ids).select("batch", F.size("p").alias("n"), F.length(prompt).alias("length"), F.md5(F.element_at(F.split(prompt, "answer directly[.]\n\n"), 2)).alias("asked"))


QUERIES = {
    "cache_files": cache_files, "structured_files": structured_files, "delivered_files": delivered_files, "file_listing": file_listing, "bench_files": bench_files, "tool_models": tool_models, "rich_runs": rich_runs, "json_lines": json_lines,
    "report_csv": report_csv, "toggled_bookmarks": toggled_bookmarks, "bookmarks_in_order": bookmarks_in_order, "paragraph_actions": paragraph_actions, "shown_blocks": shown_blocks, "span_index": span_index, "job_states": job_states,
    "retried_units": retried_units, "fix_items": fix_items, "both_sources": both_sources, "expected_units": expected_units, "settings_put": settings_put, "loaded_providers": loaded_providers, "combined_prompts": combined_prompts,
}

_ASKED = "'Translate these units. Return {\"translations\":[...]} with ' || count(*) || ' items.' || chr(10) || '{\"paper\":\"T\",\"paragraphs\":[' || string_agg('{\"type\":\"' || kind || '\",\"units\":[{\"id\":\"' || block_id || ':0\",\"en\":' || to_json(text)::VARCHAR || '}]}', ',' ORDER BY ord) || ']}'"
ORACLES = {
    "cache_files": "SELECT 'A' || user_id AS attachment, event_type AS hash, 'z' || max(event_id) AS zh, 'x' AS engine, max(event_id) AS t FROM events WHERE user_id % 7 > 0 GROUP BY user_id, event_type",
    "structured_files": f"WITH {LINES} SELECT doc_id, count(*)::INTEGER AS nodes FROM lines WHERE doc_id % 5 < 3 GROUP BY doc_id",
    "delivered_files": "SELECT conv_id, 't' || turn AS unit_id, text AS zh FROM conversations WHERE conv_id % 7 <> 3",
    "file_listing": "SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, sha256(coalesce(text, '') || chr(10)) AS sha FROM documents",
    "bench_files": "SELECT 'api:' || user_id AS spec, user_id + 0.5::DOUBLE AS seconds, (count(*) OVER (PARTITION BY user_id))::INTEGER AS requests, event_id::VARCHAR AS unit_id, 'e' || event_id AS en, CASE WHEN event_id % 5 > 0 THEN event_type END AS zh FROM events WHERE user_id % 6 > 0",
    "tool_models": "SELECT c_custkey::VARCHAR AS tool, 'm' || c_custkey AS model, c_mktsegment || ' · d' AS label, 'low,high' AS efforts FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey::VARCHAR, 'plain', 'plain', '' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey::VARCHAR, 's' || c_custkey, c_mktsegment, 'x' FROM customer WHERE c_custkey % 2 = 1",
    "rich_runs": f"WITH {LINES}, t AS (SELECT doc_id, ord, replace(text, '$', '') AS t FROM lines) SELECT doc_id, ord, 0::INTEGER AS nth, false AS math, 'a ' AS text FROM t UNION ALL SELECT doc_id, ord, 1, true, 'x_' || ord FROM t UNION ALL SELECT doc_id, ord, 2, false, t FROM t WHERE t <> ''",
    "json_lines": "SELECT event_id, user_id, value, props FROM events",
    "report_csv": "SELECT event_type, count(*) AS n, 'a \"b\", ' || event_type AS note FROM events GROUP BY event_type",
    "toggled_bookmarks": f"WITH {BLOCKS}, m AS (SELECT doc_id, ord AS mark_id, block_id, substr(text, 1, 120) AS text FROM blocks WHERE ord % 5 = 2) SELECT doc_id, mark_id, block_id, text, 0::INTEGER AS page, 1::BIGINT AS t FROM m WHERE doc_id % 2 = 1 OR mark_id <> 2 UNION ALL SELECT doc_id, coalesce((SELECT max(mark_id) FROM m WHERE m.doc_id = blocks.doc_id), -1) + 1, block_id, substr(text, 1, 120), 1, 9 FROM blocks WHERE doc_id % 2 = 1 AND ord = 3",
    "bookmarks_in_order": f"WITH {BLOCKS} SELECT doc_id, -ord AS mark_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord % 3 = 0, CASE WHEN ord % 3 = 0 THEN -ord ELSE ord END)::INTEGER AS nth FROM blocks",
    "paragraph_actions": "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'busy' WHEN event_id % 3 > 0 THEN 'retry' WHEN event_id % 7 >= 4 THEN 'retranslate' ELSE 'translate' END AS action FROM events",
    "shown_blocks": f"WITH {BLOCKS} SELECT doc_id, block_id, CASE WHEN ord % 4 = 3 THEN 'math' ELSE kind END AS kind FROM blocks WHERE ord % 4 = 3 OR ord % 3 > 0",
    "span_index": f"WITH {BLOCKS} SELECT doc_id, 'u' || ord // 3 AS unit_id, string_agg(ord || '-' || (ord + length(text)), ',' ORDER BY ord DESC) AS spans FROM blocks GROUP BY doc_id, ord // 3",
    "job_states": "SELECT CASE WHEN value > 50 THEN 'done' WHEN value > 20 THEN 'open' ELSE 'failed' END AS state, count(*) AS count FROM events GROUP BY 1",
    "retried_units": "SELECT event_id AS unit_id, user_id AS block_id FROM events WHERE user_id % 4 > 0",
    "fix_items": "SELECT event_id AS unit_id, event_type AS en, CASE WHEN event_id % 4 = 2 THEN 'z' || event_id END AS previous, CASE WHEN event_id % 4 = 2 THEN 'lost' ELSE '' END AS problem FROM events WHERE event_id % 4 <> 1",
    "both_sources": f"WITH {BLOCKS} SELECT doc_id, ord, block_id, 'sdt' AS source FROM blocks UNION ALL SELECT doc_id, ord, CASE WHEN ord % 4 = 0 THEN 'm' || ord ELSE 'm' || block_id END, 'mineru' FROM blocks WHERE ord % 2 = 0",
    "expected_units": f"WITH {BLOCKS} SELECT doc_id, block_id || ':0' AS unit_id, text AS en, contains(text, '$') AS math FROM blocks WHERE ord % 3 = 1",
    "settings_put": "WITH c AS (SELECT *, c_custkey AS k, c_custkey % 5 > 0 AS had, c_custkey % 2 = 0 AS put FROM customer) SELECT c_name AS attachment, CASE WHEN put AND k % 3 = 0 THEN NULL WHEN put AND k % 3 = 1 THEN c_mktsegment WHEN had THEN 'old' END AS glossary, CASE WHEN had THEN 'b' || k END AS position, CASE WHEN put AND k % 4 = 0 THEN (k * 2)::VARCHAR WHEN had THEN k || ',' || (k + 1) END AS bookmarks FROM c WHERE had OR put",
    "loaded_providers": "WITH c AS (SELECT *, c_custkey AS k FROM customer) SELECT c_name AS owner, 'x' AS id, 'N' AS name, 'http://h/' || k AS base, 'k' AS key, 'a' AS models, CASE WHEN k = 0 THEN 8 ELSE least(64, k) END::INTEGER AS concurrency, 'low' AS effort FROM c WHERE k % 4 = 0 UNION ALL SELECT c_name, 'p2', 'API', '', '', c_mktsegment, 8, '' FROM c WHERE k % 4 = 0 "
    "UNION ALL SELECT c_name, 'p1', 'OpenAI 兼容 API', CASE WHEN k % 2 = 0 THEN 'http://o' ELSE 'https://api.openai.com/v1' END, 'key', CASE WHEN k % 5 > 0 THEN c_mktsegment ELSE '' END, CASE WHEN k % 7 = 0 OR k % 90 = 0 THEN 4 ELSE least(64, k % 90) END, '' FROM c WHERE k % 4 > 0 AND k % 3 > 0",
    "combined_prompts": f"WITH {BLOCKS}, q AS (SELECT doc_id, count(*)::INTEGER AS n, {_ASKED} AS asked FROM blocks WHERE ord % 2 = 1 GROUP BY doc_id) SELECT doc_id AS batch, n, (length(asked) + 1286)::INTEGER AS length, md5(asked) AS asked FROM q",
}
