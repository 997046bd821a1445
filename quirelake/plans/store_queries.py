"""Queries on batches, stores and views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirelake.operators import protocol as P, store as S, views as V
from quirelake.plans.base import BLOCKS, LINES, line_blocks, lines, table
from quirelake.plans.text_queries import WS


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def batch_packing(spark, sf_dir):
    """Turns as paragraphs of one unit each; budgets scaled to them."""
    rows = _turns(spark, sf_dir).select("conv_id", F.col("turn").alias("ord"), F.length("text").alias("chars"), F.lit(1).alias("units"))
    return P.pack(rows, ["conv_id"], 400, 3)


_PACK = """
WITH RECURSIVE n AS (SELECT conv_id, turn AS ord, length(text) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
p AS (SELECT conv_id, i, ord, c AS sum_c, 1 AS u, 0 AS batch FROM n WHERE i = 1
  UNION ALL SELECT n.conv_id, n.i, n.ord, CASE WHEN p.sum_c + n.c > 400 OR p.u + 1 > 3 THEN n.c ELSE p.sum_c + n.c END, CASE WHEN p.sum_c + n.c > 400 OR p.u + 1 > 3 THEN 1 ELSE p.u + 1 END, CASE WHEN p.sum_c + n.c > 400 OR p.u + 1 > 3 THEN p.batch + 1 ELSE p.batch END
  FROM p JOIN n ON n.conv_id = p.conv_id AND n.i = p.i + 1)
SELECT conv_id, ord, batch FROM p
"""


def wanted_batches(spark, sf_dir):
    """Whole batches of a document's lines, one unit each."""
    rows = lines(spark, sf_dir).select("doc_id", "ord", F.lit(0).alias("idx"), F.concat(F.lit("b"), "ord", F.lit(":0")).alias("unit_id"), "text")
    blocks = line_blocks(spark, sf_dir).select("doc_id", "ord", "block_id", "kind", F.col("text").alias("full_text"), F.lit(1).alias("total_units"), F.col("inline_math").alias("math"))
    out = P.wanted_batches(rows, blocks, 2600, 5)
    return out.select("doc_id", "batch", "chars", F.size("ids").alias("n_ids"), F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"))


_WANTED = f"""
WITH RECURSIVE {LINES}, n AS (SELECT doc_id, ord, length(text) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM lines),
p AS (SELECT doc_id, i, ord, c, c AS sum_c, 1 AS u, 0 AS batch FROM n WHERE i = 1
  UNION ALL SELECT n.doc_id, n.i, n.ord, n.c, CASE WHEN p.sum_c + n.c > 2600 OR p.u + 1 > 5 THEN n.c ELSE p.sum_c + n.c END, CASE WHEN p.sum_c + n.c > 2600 OR p.u + 1 > 5 THEN 1 ELSE p.u + 1 END, CASE WHEN p.sum_c + n.c > 2600 OR p.u + 1 > 5 THEN p.batch + 1 ELSE p.batch END
  FROM p JOIN n ON n.doc_id = p.doc_id AND n.i = p.i + 1)
SELECT doc_id, batch, sum(c)::BIGINT AS chars, count(*)::INTEGER AS n_ids, 'b' || min(ord) || ':0' AS first_id, 'b' || max(ord) || ':0' AS last_id FROM p GROUP BY doc_id, batch
"""


def budgeted_limit(spark, sf_dir):
    """The first documents of each source until 100,000 characters are reached."""
    rows = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ord"), F.length("text").alias("n"))
    return P.budgeted(rows, ["source"], F.col("n"), 100_000).select("source", F.col("ord").alias("doc_id"), "n")


def glossary_source(spark, sf_dir):
    """The opening lines of each document up to the first that would pass 500 characters."""
    rows = lines(spark, sf_dir)
    return P.budgeted(rows, ["doc_id"], F.length("text"), 500, whole=False).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def granularity(spark, sf_dir):
    rows = line_blocks(spark, sf_dir).select("doc_id", F.lit("b").alias("block_id"), F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).alias("n"), "ord")
    rows = rows.select("doc_id", "block_id", (F.col("n") - 1).alias("idx"), F.concat(F.lit("b:"), (F.col("n") - 1).cast("string")).alias("unit_id"))
    return V.granularity_groups(rows, 3).select("doc_id", "unit_id", "grp", F.array_join("group_units", ",").alias("units"))


def _pairs(spark, sf_dir):
    """User turns as sentences, the answers to them as renderings; some are of an older text."""
    t = _turns(spark, sf_dir)
    users = t.where("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.lit(0).alias("idx"), F.concat(F.lit("b"), "turn", F.lit(":0")).alias("unit_id"), "text", F.md5("text").alias("hash"))
    answers = t.where("role = 'assistant'").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("b"), (F.col("turn") - 1).cast("string"), F.lit(":0")).alias("unit_id"), F.col("text").alias("zh"), (F.col("turn") - 1).alias("t"))
    links = users.select("doc_id", "unit_id", "ord", F.when(F.col("ord") % 4 == 0, F.col("hash")).otherwise(F.md5(F.concat("hash", F.lit("old")))).alias("src_hash"))
    return users, answers.join(links.select("doc_id", "unit_id", "src_hash"), ["doc_id", "unit_id"]).select("doc_id", "unit_id", "src_hash", "zh")


def translation_join(spark, sf_dir):
    users, answers = _pairs(spark, sf_dir)
    rows = V.current(users, answers).withColumn("failed", F.col("ord") % 6 == 2)
    return V.progress(rows, ["doc_id"])


_PAIRS = "u AS (SELECT conv_id AS doc_id, turn AS ord, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id AS doc_id, turn - 1 AS ord, text AS zh FROM conversations WHERE role = 'assistant'), r AS (SELECT u.*, CASE WHEN u.ord % 4 = 0 THEN a.zh END AS zh FROM u LEFT JOIN a USING (doc_id, ord))"


def find_hits(spark, sf_dir):
    users, answers = _pairs(spark, sf_dir)
    return V.find(V.current(users, answers), "  the ")


def mode_view(spark, sf_dir):
    users, answers = _pairs(spark, sf_dir)
    rows = V.current(users, answers).withColumn("block_id", F.concat(F.lit("b"), "ord"))
    return V.mode_view(rows, "side").select("doc_id", "ord", "lang", "shown", "pending")


def run_batches(spark, sf_dir):
    """User turns through an engine that is known by its name."""
    P.register_engine("mock", P.mock_engine, concurrency=4)
    rows = _turns(spark, sf_dir).where("role = 'user'").select(
        F.col("conv_id").alias("batch"), F.concat(F.lit("b"), "turn", F.lit(":0")).alias("unit_id"), F.lit("paragraph").alias("kind"), F.col("text").alias("en"), F.col("text").alias("full_text"), F.lit(1).alias("total_units"), F.lit(False).alias("math")
    )
    return P.run_batches(rows, P.ENGINES["mock"], parallel=P.concurrency("mock"))


def _logs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("event_id").alias("t"), "value")
    keys = ["user_id", "event_type"]

    def side(r: int):
        return e.where(F.col("event_id") % 2 == r).groupBy(*keys).agg(F.max_by(F.struct("t", "value"), "t").alias("r")).select(*keys, (F.col("r.t") - F.col("r.t") % 4).alias("t"), "r.value")

    return side(0), side(1), keys


def newest_wins(spark, sf_dir):
    return S.newest_wins(*_logs(spark, sf_dir))


def existing_wins(spark, sf_dir):
    return S.existing_wins(*_logs(spark, sf_dir))


def changed_rows(spark, sf_dir):
    a, b, _ = _logs(spark, sf_dir)
    key = F.concat_ws("|", "user_id", "event_type").alias("k")
    return V.changed(a.select(key, F.floor("value").alias("v")), b.select(key, F.floor("value").alias("v")), "k", "v")


_SIDES = ", ".join(f"{n} AS (SELECT user_id, event_type, max(event_id) - max(event_id) % 4 AS t, arg_max(value, event_id) AS value FROM events WHERE event_id % 2 = {r} GROUP BY ALL)" for n, r in (("a", 0), ("b", 1)))

def later_file_wins(spark, sf_dir):
    """Events as entries of ten files that deliver renderings of users' sentences; some are blank, some are left as they were, some are of unexpected units."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    zh = F.when(k % 9 == 0, "  ").when(k % 9 == 1, F.concat(F.lit("See the windy event of user "), "user_id")).otherwise(F.concat(F.lit(" 译"), k, F.lit(" ")))
    files = e.select(F.concat(F.lit("parts/"), k % 10, F.lit(".json")).alias("file"), k.alias("pos"), F.col("user_id").cast("string").alias("unit_id"), zh.alias("zh"))
    expected = e.where("user_id % 4 <> 0").select(F.col("user_id").cast("string").alias("unit_id"), F.concat(F.lit("See the windy event of user "), "user_id").alias("en"), (F.col("user_id") % 2 == 0).alias("math")).distinct()
    return S.later_file_wins(files, expected)


_FILES = """
WITH f AS (SELECT user_id, arg_max(CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'See the windy event of user ' || user_id ELSE '译' || event_id END, {'f': 'parts/' || event_id % 10 || '.json', 'p': event_id}) AS zh FROM events WHERE user_id % 4 <> 0 GROUP BY user_id)
SELECT user_id::VARCHAR AS unit_id, zh, CASE WHEN zh = '' THEN 'empty translation' WHEN starts_with(zh, 'See') THEN 'not translated' END AS problem FROM f
"""


def _cache(spark, sf_dir, condition: str):
    """The last of some events by user and type, as rows of a store; and the groups, all types of a user."""
    e = table(spark, sf_dir, "events").withColumn("hash", F.concat_ws("|", "user_id", "event_type"))
    row = F.max_by(F.struct(F.concat(F.lit("v"), "event_id").alias("zh"), F.concat(F.lit("e"), F.col("event_id") % 3).alias("engine"), F.lit("p4").alias("prompt"), F.lit("").alias("glossary"), F.col("event_id").alias("t")), "event_id")
    return e.where(condition).groupBy("hash").agg(row.alias("r")).select("hash", "r.*"), e.select(F.col("user_id").alias("grp"), "hash").distinct()


def store_put(spark, sf_dir):
    """New rows overwrite those of their whole group."""
    store, groups = _cache(spark, sf_dir, "event_id % 2 = 0")
    return S.put(store, _cache(spark, sf_dir, "event_id % 41 = 1")[0], groups)


def store_removed(spark, sf_dir):
    store, groups = _cache(spark, sf_dir, "event_id % 2 = 0")
    return S.removed(store, table(spark, sf_dir, "events").where("event_id % 53 = 3").select(F.concat_ws("|", "user_id", "event_type").alias("hash")), groups).select("hash", "zh")


def store_cleared(spark, sf_dir):
    """Events of a type on screen; other types of their users go with them."""
    store, groups = _cache(spark, sf_dir, "event_id % 2 = 0")
    shown = table(spark, sf_dir, "events").where("event_id % 5 = 0 and user_id % 4 = 1").select(F.concat_ws("|", "user_id", "event_type").alias("hash"))
    return S.cleared(store, shown, groups).select("hash", "zh")


def store_rendered(spark, sf_dir):
    """Events as sentences: some have rows of their own, some get that of another type of their user, some none."""
    store, groups = _cache(spark, sf_dir, "event_id % 7 = 0")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("unit_id"), F.concat_ws("|", "user_id", "event_type").alias("hash"))
    return S.rendered(rows, store, groups).select("unit_id", "zh")


def store_edited(spark, sf_dir):
    store, _ = _cache(spark, sf_dir, "event_id % 2 = 0")
    edits = _cache(spark, sf_dir, "event_id % 10 = 5")[0].select("hash", F.when(F.col("t") % 3 == 0, F.lit(" \n ")).otherwise(F.concat(F.lit("  "), "zh", F.lit(" "))).alias("zh"), "t")
    return S.edited(store, edits).select("hash", "zh", "engine", "t")


def _cached(name: str, condition: str) -> str:
    return f"{name} AS (SELECT user_id, user_id || '|' || event_type AS hash, 'v' || max(event_id) AS zh, 'e' || max(event_id) % 3 AS engine, 'p4' AS prompt, '' AS glossary, max(event_id) AS t FROM events WHERE {condition} GROUP BY user_id, event_type)"


def progress_by_doc(spark, sf_dir):
    """Labels as the state of documents, by source."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select("source", F.when(F.col("quality") == 1, "x").alias("zh"), (F.col("quality") == 0).alias("failed"))
    return V.progress(rows, ["source"])


def section_as_of(spark, sf_dir):
    return V.section_titles(line_blocks(spark, sf_dir)).select("doc_id", "ord", "section")


def sections(spark, sf_dir):
    """Task export of documents whose level-1 headings start sections."""
    blocks = line_blocks(spark, sf_dir)
    units = blocks.select("doc_id", "ord", F.lit(0).alias("idx"), F.concat("block_id", F.lit(":0")).alias("unit_id"), "text", F.lit(None).cast("string").alias("zh"))
    return V.sections(blocks, units).select("doc_id", "section_no", "heading", F.size("paragraphs").alias("n"), F.expr("aggregate(paragraphs, 0, (a, p) -> a + length(p.units[0].en))").alias("chars"))


def blind_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return V.blind_scores(rows.select(F.col("source").alias("engine"), (1 + 3 * F.col("quality") + F.col("toxic")).alias("score"))).withColumns({c: F.round(c, 6) for c in ("mean", "share_5", "share_le3")})


def blind_sample(spark, sf_dir):
    return V.blind_sample(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("unit_id"), F.col("doc_id").alias("ord")), 30)


def bench_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.lit(60.0).alias("seconds"), F.lit(8).alias("requests"), F.col("event_id").alias("unit_id"), F.when(F.col("event_id") % 5 > 0, "x").alias("zh"), F.when(F.col("event_id") % 7 == 0, 1).otherwise(0).alias("problems"))
    return V.bench_rows(e)


def tints(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 7).alias("doc_id"), F.col("event_id").alias("highlight_ord"), F.col("event_type").alias("color"), F.array(F.col("user_id"), F.col("user_id") + 1).alias("unit_ids"))
    return V.tints(e).select("doc_id", "unit_id", "color")


def joined_selection(spark, sf_dir):
    """Turns selected in order, with two turns to a block."""
    t = _turns(spark, sf_dir).select(F.col("conv_id").alias("sel_id"), F.col("turn").alias("pos"), F.floor(F.col("turn") / 2).alias("block_id"), "text")
    return V.joined_selection(t, " ")


def notes_order(spark, sf_dir):
    units = lines(spark, sf_dir).select("doc_id", "ord", F.lit(0).alias("idx"), F.concat(F.lit("b"), "ord", F.lit(":0")).alias("unit_id"))
    notes = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("annotation_id"))
    notes = notes.select("doc_id", "annotation_id", F.array(F.concat(F.lit("b"), (7 - 2 * F.col("annotation_id")).cast("string"), F.lit(":0")), F.lit("b90000:0")).alias("unit_ids"))
    return V.notes_in_order(notes, units)


def bookmarks(spark, sf_dir):
    """Marks made in another parse: their ids are off by one, their text is that of the block."""
    blocks = line_blocks(spark, sf_dir)
    marks = blocks.where("ord % 5 = 2").select("doc_id", F.col("ord").alias("mark_id"), F.concat(F.lit("b"), (F.col("ord") - 1).cast("string")).alias("block_id"), F.substring("text", 1, 120).alias("text"))
    return V.resolved_bookmarks(marks, blocks).na.fill({"resolved": "", "ord": -1})


_L = "regexp_replace(regexp_replace(lower(text), '\\$[^$]*\\$', '', 'g'), '[^a-z0-9]', '', 'g')"
_MARKS = f"""
WITH {BLOCKS}, o AS (SELECT doc_id, ord, block_id AS b, {_L} AS l FROM blocks), m AS (SELECT doc_id, ord AS mark_id, 'b' || (ord - 1) AS block_id, substring(regexp_replace(regexp_replace(lower(substring(text, 1, 120)), '\\$[^$]*\\$', '', 'g'), '[^a-z0-9]', '', 'g'), 1, 40) AS key FROM blocks WHERE ord % 5 = 2),
n AS (SELECT m.doc_id, mark_id, ord, b, CASE WHEN b = block_id AND starts_with(l, substring(key, 1, 20)) THEN 0 WHEN b = block_id AND length(key) < 8 THEN 1 WHEN length(key) >= 8 AND starts_with(l, key) THEN 2 WHEN length(key) >= 8 AND contains(l, key) THEN 3 END AS rank FROM m JOIN o USING (doc_id)),
t AS (SELECT doc_id, mark_id, b, ord FROM n WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, mark_id ORDER BY rank, ord) = 1)
SELECT m.doc_id, m.mark_id, coalesce(t.b, '') AS resolved, coalesce(t.ord, -1) AS ord FROM m LEFT JOIN t USING (doc_id, mark_id)
"""

def task_status(spark, sf_dir):
    """Events as task folders with some files, the last of which is up to some hours old."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(k.alias("id"), (k % 3 > 0).alias("glossary"), (k % 13).alias("delivered"), F.when(k % 6 == 0, 0).otherwise(10).alias("todo"), (k % 5 == 0).alias("report"), (k * 977 % 9_000_000).alias("age_ms"))
    phase = V.task_phase(F.col("glossary"), F.col("delivered"), F.col("todo"), F.col("report"))
    return rows.select("id", phase.alias("phase"), V.stalled(phase, F.lit(True), F.lit(0), F.col("age_ms")).alias("stalled"), V.age(F.col("age_ms")).alias("age"))


_STATUS = """
WITH r AS (SELECT event_id AS id, event_id % 13 AS d, CASE WHEN event_id % 6 = 0 THEN 0 ELSE 10 END AS todo, event_id * 977 % 9000000 AS ms FROM events),
p AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'done' WHEN d >= todo AND todo > 0 THEN 'checking' WHEN d > 0 THEN 'translating' WHEN id % 3 > 0 THEN 'glossary' ELSE 'waiting' END AS phase, floor(ms / 1000 + 0.5)::BIGINT AS s FROM r), q AS (SELECT *, floor(s / 60 + 0.5)::BIGINT AS m FROM p)
SELECT id, phase, phase <> 'done' AND ms > 300000 AS stalled, CASE WHEN s < 60 THEN s || ' 秒前' WHEN m < 60 THEN m || ' 分钟前' ELSE floor(m / 60 + 0.5)::BIGINT || ' 小时前' END AS age FROM q
"""


def comments(spark, sf_dir):
    """A user's turns as notes on the turns that follow; every third note is blank, and every fifth rendering is missing."""
    t = _turns(spark, sf_dir)
    rows = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.when(F.col("turn") % 5 < 4, F.col("text")).alias("z")))).alias("z"), F.min_by("text", "turn").alias("note"))
    note = F.when(F.col("conv_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "note", F.lit("\n")))
    return rows.select("conv_id", V.comment(note, F.transform("z", lambda x: x["z"])).alias("comment"))


def work_queue(spark, sf_dir):
    """Events as units: in flight, failed and cached ones need no work, but for those that are forced."""
    from quirelake.streaming.watch import pending

    u = table(spark, sf_dir, "events").select(F.col("event_id").alias("unit_id"), F.col("user_id").alias("hash"))
    by = lambda c: u.where(c)
    return pending(u, by("hash % 3 = 0"), by("unit_id % 11 = 0"), by("unit_id % 13 = 0"), by("unit_id % 17 = 0"))


QUERIES = {
    "batch_packing": batch_packing, "wanted_batches": wanted_batches, "budgeted_limit": budgeted_limit, "glossary_source": glossary_source, "granularity_groups": granularity, "translation_join": translation_join, "find_hits": find_hits, "mode_view": mode_view,
    "run_batches": run_batches, "newest_wins": newest_wins, "existing_wins": existing_wins, "changed_rows": changed_rows, "later_file_wins": later_file_wins, "store_put": store_put, "store_removed": store_removed, "store_cleared": store_cleared, "store_rendered": store_rendered, "store_edited": store_edited,
    "progress_by_doc": progress_by_doc, "section_as_of": section_as_of, "sections": sections, "blind_scores": blind_scores, "blind_sample": blind_sample, "bench_rows": bench_rows, "tints": tints, "joined_selection": joined_selection, "notes_order": notes_order,
    "bookmarks": bookmarks, "task_status": task_status, "comments": comments, "work_queue": work_queue,
}

_BUDGET = "SELECT *, sum(n) OVER (PARTITION BY k ORDER BY o ROWS UNBOUNDED PRECEDING) AS t FROM s"
_SF = f"lower(regexp_replace(t, '{WS}+', ' ', 'g'))"
ORACLES = {
    "batch_packing": _PACK, "wanted_batches": _WANTED, "bookmarks": _MARKS,
    "budgeted_limit": f"WITH s AS (SELECT source AS k, doc_id AS o, length(text) AS n FROM documents), t AS ({_BUDGET}) SELECT k AS source, o AS doc_id, n::INTEGER AS n FROM t WHERE t - n < 100000",
    "glossary_source": f"WITH {LINES}, s AS (SELECT doc_id AS k, ord AS o, length(text) AS n FROM lines), t AS ({_BUDGET}) SELECT k AS doc_id, count(*) AS n, sum(n)::BIGINT AS chars FROM t WHERE t <= 500 GROUP BY k",
    "granularity_groups": f"WITH {LINES}, n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS i FROM lines) SELECT doc_id, 'b:' || i AS unit_id, i // 3 AS grp, string_agg('b:' || i, ',') OVER (PARTITION BY doc_id, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS units FROM n",
    "translation_join": f"WITH {_PAIRS} SELECT doc_id, count(*) AS total, count(zh) AS done, count(*) FILTER (zh IS NULL AND ord % 6 = 2) AS failed, count(zh) = count(*) AS complete FROM r GROUP BY doc_id",
    "find_hits": f"WITH {_PAIRS}, s AS (SELECT doc_id, ord, 0 AS l, 'en' AS lang, text AS t FROM r UNION ALL SELECT doc_id, ord, 1, 'zh', zh FROM r) SELECT doc_id, 'b' || ord || ':0' AS unit_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY ord, l)::INTEGER AS hit FROM s WHERE contains({_SF}, 'the')",
    "mode_view": f"WITH {_PAIRS} SELECT doc_id, ord, 'en' AS lang, text AS shown, 0::BIGINT AS pending FROM r UNION ALL SELECT doc_id, ord, 'zh', coalesce(zh, text), CASE WHEN zh IS NULL THEN 1 ELSE 0 END FROM r",
    "run_batches": f"SELECT conv_id AS batch, 'b' || turn || ':0' AS unit_id, regexp_replace('【模拟译文】' || text, '^{WS}+|{WS}+$', '', 'g') AS zh, 1 AS attempt FROM conversations WHERE role = 'user'",
    "newest_wins": f"WITH {_SIDES}, u AS (SELECT *, 1 AS own FROM a UNION ALL SELECT *, 0 FROM b) SELECT user_id, event_type, t, value FROM u QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY t DESC, own DESC) = 1",
    "existing_wins": f"WITH {_SIDES} SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND a.event_type = b.event_type)",
    "changed_rows": f"WITH {_SIDES} SELECT b.user_id || '|' || b.event_type AS k, floor(b.value)::BIGINT AS v FROM b LEFT JOIN a USING (user_id, event_type) WHERE a.user_id IS NULL OR floor(a.value) IS DISTINCT FROM floor(b.value)",
    "later_file_wins": _FILES,
    "store_put": f"WITH {_cached('o', 'event_id % 2 = 0')}, {_cached('n', 'event_id % 41 = 1')}, l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC) = 1), g AS (SELECT DISTINCT user_id, user_id || '|' || event_type AS hash FROM events) SELECT g.hash, zh, engine, prompt, glossary, t FROM g JOIN l USING (user_id) UNION ALL SELECT hash, zh, engine, prompt, glossary, t FROM o WHERE user_id NOT IN (SELECT user_id FROM n)",
    "store_removed": f"WITH {_cached('o', 'event_id % 2 = 0')} SELECT hash, zh FROM o WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 53 = 3)",
    "store_cleared": f"WITH {_cached('o', 'event_id % 2 = 0')} SELECT hash, zh FROM o WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 5 = 0 AND user_id % 4 = 1)",
    "store_rendered": f"WITH {_cached('o', 'event_id % 7 = 0')}, m AS (SELECT user_id, arg_min(zh, hash) AS z FROM o GROUP BY user_id) SELECT e.event_id AS unit_id, coalesce(o.zh, m.z) AS zh FROM events e LEFT JOIN o ON o.hash = e.user_id || '|' || e.event_type LEFT JOIN m ON m.user_id = e.user_id",
    "store_edited": f"WITH {_cached('o', 'event_id % 2 = 0')}, {_cached('n', 'event_id % 10 = 5')}, w AS (SELECT * FROM n WHERE t % 3 <> 0) SELECT hash, zh, 'manual' AS engine, t FROM w UNION ALL SELECT hash, zh, engine, t FROM o WHERE hash NOT IN (SELECT hash FROM w)",
    "progress_by_doc": "SELECT source, count(*) AS total, count(*) FILTER (quality = 1) AS done, count(*) FILTER (quality = 0) AS failed, count(*) FILTER (quality = 1) = count(*) AS complete FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "section_as_of": f"WITH {BLOCKS} SELECT doc_id, ord, coalesce(last_value(CASE WHEN kind = 'heading' AND trim(text) <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING), '') AS section FROM blocks",
    "sections": f"WITH {BLOCKS}, s AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER w AS section_no, coalesce(last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER w, '(front matter)') AS heading FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)) SELECT doc_id, section_no::BIGINT AS section_no, heading, count(*)::INTEGER AS n, sum(length(text))::INTEGER AS chars FROM s GROUP BY doc_id, section_no, heading",
    "blind_scores": "WITH s AS (SELECT source AS engine, 1 + 3 * quality + toxic AS s FROM labels JOIN documents USING (doc_id)) SELECT engine, count(*) AS rated, round(avg(s), 6) AS mean, round(avg(CASE WHEN s = 5 THEN 1.0 ELSE 0.0 END), 6) AS share_5, round(avg(CASE WHEN s <= 3 THEN 1.0 ELSE 0.0 END), 6) AS share_le3 FROM s GROUP BY engine",
    "bench_rows": "SELECT event_type AS engine, count(*) AS sentences, 60.0::DOUBLE AS seconds, floor(count(*) FILTER (event_id % 5 > 0) / 60.0 * 60 + 0.5)::BIGINT AS sentences_per_min, 8 AS requests, count(*) FILTER (event_id % 5 = 0) AS failed, count(*) FILTER (event_id % 7 = 0) AS problems FROM events GROUP BY event_type",
    "tints": "WITH u AS (SELECT event_id, event_type, user_id AS unit_id FROM events UNION ALL SELECT event_id, event_type, user_id + 1 FROM events) SELECT event_id % 7 AS doc_id, unit_id, arg_max(event_type, event_id) AS color FROM u GROUP BY 1, 2",
    "joined_selection": "SELECT conv_id AS sel_id, dense_rank() OVER (PARTITION BY conv_id ORDER BY b) AS paragraph, text FROM (SELECT conv_id, turn // 2 AS b, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1, 2)",
    "notes_order": f"WITH {LINES}, n AS (SELECT doc_id, i AS annotation_id, 7 - 2 * i AS o FROM documents, range(0, 4) AS r(i)), p AS (SELECT n.doc_id, annotation_id, o * 1000 AS pl FROM n JOIN lines ON lines.doc_id = n.doc_id AND lines.ord = o) SELECT doc_id, annotation_id::INTEGER AS annotation_id, pl::BIGINT AS \"at\", row_number() OVER (PARTITION BY doc_id ORDER BY pl, annotation_id)::INTEGER AS nth FROM p",
    "task_status": _STATUS,
    "comments": f"WITH c AS (SELECT conv_id, count(*) FILTER (turn % 5 = 4) AS gaps, string_agg(text, '' ORDER BY turn) AS z, count(*) FILTER (text = '') AS blank, regexp_replace(arg_min(text, turn), '^{WS}+|{WS}+$', '', 'g') AS n FROM conversations GROUP BY conv_id) SELECT conv_id, concat_ws(chr(10), CASE WHEN conv_id % 3 > 0 AND n <> '' THEN n END, CASE WHEN gaps = 0 AND blank = 0 THEN '【译】' || z END) AS comment FROM c",
    "work_queue": "SELECT event_id AS unit_id, user_id AS hash FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND (NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = events.user_id AND c.user_id % 3 = 0) OR event_id % 17 = 0)",
}
