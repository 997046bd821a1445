"""Queries on text, blocks and sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import align, blocks as B
from quirelake.plans.base import BLOCKS, LINES, as_blocks, frame, line_blocks, lines, table, values

WS = T.WS
FRONT = [p.replace("(?![A-Za-z0-9_])", r"\b").replace("(?<![A-Za-z0-9_])", r"\b") for p in B.FRONT_MATTER]

# a paper's blocks: (doc_id, ord, kind, text)
PAPER = [
    (-1, 0, "heading", "T"), (-1, 1, "paragraph", "Shoals move each spring, and charts follow late."), (-1, 2, "paragraph", "Manuscript received May 3, 2020; revised June 1."), (-1, 3, "heading", "I. INTRODUCTION"),
    (-1, 4, "paragraph", "Dredging of the outer channel is"), (-1, 5, "caption", "TABLE I. Results"), (-1, 6, "paragraph", "planned by the port, e.g. in Fig. 2."), (-1, 7, "heading", "VI. References"), (-1, 8, "paragraph", "[1] K. Lund, Shoals, 2019."),
    (-1, 9, "listitem", "[2] O. Brandt, Tides, 2020."), (-1, 10, "heading", "Appendix A"), (-1, 11, "paragraph", "Proof of the lemma, see"), (-1, 12, "image", ""), (-1, 13, "paragraph", "below."), (-1, 14, "paragraph", "© 2020 All rights reserved."),
    (-2, 0, "heading", "References"), (-2, 1, "paragraph", "[1] Only one."), (-2, 2, "heading", "W"), (-2, 3, "paragraph", "HARVES line the"), (-2, 4, "paragraph", "river-"), (-2, 5, "paragraph", "front to the lock."), (-2, 6, "paragraph", "doi.org/10.1/x"),
]
PAPER_COLS = "doc_id bigint, ord bigint, kind varchar, text varchar"


def _paper(spark, sf_dir):
    fixture = frame(spark, PAPER, "doc_id bigint, ord bigint, kind string, text string")
    return as_blocks(fixture, F.col("kind")).unionByName(line_blocks(spark, sf_dir))


_ALL = f"{BLOCKS}, f AS {values(PAPER, PAPER_COLS)}, b AS (SELECT doc_id, ord, kind, text FROM f UNION ALL SELECT doc_id, ord, kind, text FROM blocks)"


def text_hash(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "ord", T.text_hash(F.col("text")).alias("hash"))


def _fold(seed: int, step: int) -> str:
    return f"list_reduce(u, lambda h, c: (xor(h, c) * {step}::UBIGINT) & 4294967295::UBIGINT, {seed}::UBIGINT)"


_MIX = "((xor({a}, {a} >> {n}) * {m}::UBIGINT) & 4294967295::UBIGINT)"
_HASH = f"""
WITH {LINES}, n AS (SELECT doc_id, ord, list_transform(string_split(trim(regexp_replace(text, '{WS}+', ' ', 'g')), ''), lambda c: unicode(c)::UBIGINT) AS u FROM lines),
s AS (SELECT doc_id, ord, {_fold(3735928559, 2654435761)} AS a, {_fold(1103547991, 1597334677)} AS b FROM n),
x AS (SELECT doc_id, ord, b, xor({_MIX.format(a="a", n=16, m=2246822507)}, {_MIX.format(a="b", n=13, m=3266489909)}) AS a FROM s),
y AS (SELECT doc_id, ord, a, xor({_MIX.format(a="b", n=16, m=2246822507)}, {_MIX.format(a="a", n=13, m=3266489909)}) AS b FROM x)
SELECT doc_id, ord, lower(to_base(((b & 2097151::UBIGINT) << 32 | a)::BIGINT, 36, 11)) AS hash FROM y
"""


def text_forms(spark, sf_dir):
    t = F.col("text")
    return lines(spark, sf_dir).select("doc_id", "ord", T.loose_key(t).alias("loose_key"), T.letters(t).alias("letters"), T.search_form(t).alias("search_form"), T.snippet(t, 20).alias("snippet"))


def sibling_groups(spark, sf_dir):
    """Lines and benchmark items, dealt to ten documents by their ids."""
    from quirelake.operators.store import grouped

    rows = lines(spark, sf_dir).select((F.col("doc_id") % 10).alias("doc_id"), "text", F.md5("text").alias("hash"))
    return grouped(rows.unionByName(table(spark, sf_dir, "benchmark").select((F.col("item_id") % 10).alias("doc_id"), "text", F.md5("text").alias("hash")))).select("doc_id", "loose_key", "hash")


_KEY = "CASE WHEN NOT contains(text, '$') THEN regexp_replace(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), '^(table|figure|fig)\\d+', '') END"


def reference_tagging(spark, sf_dir):
    return B.mark_references(_paper(spark, sf_dir)).select("doc_id", "ord", "role")


def front_matter(spark, sf_dir):
    return B.mark_front_matter(_paper(spark, sf_dir)).select("doc_id", "ord", "role")


def translatable(spark, sf_dir):
    rows = B.mark_references(_paper(spark, sf_dir))
    return rows.groupBy("doc_id").agg(F.count_if(B.translatable(F.col("kind"), F.col("role"), F.col("text"))).alias("n_translatable"), F.count("*").alias("n_blocks"))


_EVENT = "CASE WHEN kind = 'heading' THEN CASE WHEN regexp_matches(trim(text), '(?i)^(?:[ivx\\d]+\\.?\\s*)?(references|bibliography|literature cited|参考文献)\\s*$') THEN true WHEN regexp_matches(trim(text), '(?i)^(?:[a-z\\d]+\\.?\\s*)?(appendix|appendices|附录)') THEN false END END"
_TAGGED = f"{_ALL}, e AS (SELECT *, {_EVENT} AS ev FROM b), r AS (SELECT doc_id, ord, kind, text, CASE WHEN kind IN ('paragraph', 'listitem') AND coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING), false) THEN 'reference' END AS role FROM e)"


def split_merge(spark, sf_dir, only=False):
    out = B.merge_split_paragraphs(_paper(spark, sf_dir), only)
    return out.select("doc_id", "ord", "kind", "text")


def split_merge_mid(spark, sf_dir):
    return split_merge(spark, sf_dir, True)


def _split(start: str) -> str:
    return f"""
WITH {_ALL}, a AS (SELECT *, kind IN ('image', 'table', 'caption') AS aside, kind = 'paragraph' AS body FROM b),
o AS (SELECT *, coalesce(lag(body AND NOT regexp_matches(text, '[.?!:;]["'')\\]]?{WS}*$')) OVER (PARTITION BY doc_id, aside ORDER BY ord), false) AND body AND NOT aside AND {start} AS goes_on FROM a),
i AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, aside ORDER BY ord ROWS UNBOUNDED PRECEDING) AS island FROM o),
j AS (SELECT *, CASE WHEN goes_on THEN CASE WHEN regexp_matches(lag(text) OVER (PARTITION BY doc_id, aside ORDER BY ord), '({WS}|-)$') THEN '' ELSE ' ' END ELSE '' END || text AS piece FROM i)
SELECT doc_id, min(ord) AS ord, min_by(kind, ord) AS kind, string_agg(piece, '' ORDER BY ord) AS text FROM j GROUP BY doc_id, aside, island
"""


def drop_caps(spark, sf_dir):
    return B.merge_drop_caps(_paper(spark, sf_dir)).select("doc_id", "ord", "kind", "text")


_CAPS = f"""
WITH {_ALL}, m AS (SELECT *, kind = 'heading' AND regexp_matches(trim(text), '^[A-Z]$') AS one, kind = 'paragraph' AND regexp_matches(text, '^[A-Z]') AS body FROM b),
n AS (SELECT *, one AND coalesce(lead(body) OVER w, false) AS gone, CASE WHEN body AND coalesce(lag(one) OVER w, false) THEN lag(trim(text)) OVER w ELSE '' END AS letter FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT doc_id, ord, kind, letter || text AS text FROM n WHERE NOT gone
"""


def sentence_units(spark, sf_dir):
    return B.to_sentences(_paper(spark, sf_dir)).select("doc_id", "unit_id", "start", "end", "text", "hash")


def document_progress(spark, sf_dir):
    """Lines → sentences → hashes → a store that holds every second of them → counts by document."""
    from quirelake.operators.views import progress

    units = B.to_sentences(B.mark_front_matter(line_blocks(spark, sf_dir)))
    rows = units.withColumns({"zh": F.when(F.conv(F.substring("hash", -1, 1), 36, 10).cast("int") % 2 == 0, "x"), "failed": F.conv(F.substring("hash", -2, 1), 36, 10).cast("int") == 0})
    return progress(rows, ["doc_id"])


def unique_gram_join(spark, sf_dir):
    left = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), align.kept_text(F.col("text")).alias("text"))
    right = lines(spark, sf_dir).select(F.concat_ws(":", "doc_id", "ord").alias("id"), align.kept_text(F.col("text")).alias("text"))
    return align.gram_anchors(left, right)


def _grams(name: str, source: str) -> str:
    return f"{name} AS (SELECT id, gram, min(pos) AS pos FROM (SELECT id, unnest(list_transform(range(1, length(t) - {12 - 2}), lambda i: substring(t, i, 12))) AS gram, unnest(range(0, length(t) - {12 - 1})) AS pos FROM {source} WHERE length(t) >= 12) GROUP BY id, gram HAVING count(*) = 1)"


_KEPT = "regexp_replace(lower(regexp_replace(text, '\\$[^$]+\\$', '', 'g')), '[^a-z0-9]', '', 'g')"
_GRAMS = f"""
WITH {LINES}, bt AS (SELECT item_id AS id, {_KEPT} AS t FROM benchmark), lt AS (SELECT doc_id || ':' || ord AS id, {_KEPT} AS t FROM lines), {_grams("a", "bt")}, {_grams("b", "lt")}
SELECT a.id AS left_id, b.id AS right_id, count(*) AS anchors, min(a.pos) AS first_left, min(b.pos) AS first_right FROM a JOIN b USING (gram) GROUP BY 1, 2
"""


def alignment(spark, sf_dir):
    """Each document's sentences against a second parse of it, which lost every seventh block and its line-end hyphens."""
    blocks = line_blocks(spark, sf_dir)
    second = blocks.where("ord % 7 <> 6").withColumns({"text": F.regexp_replace("text", "-", ""), "block_id": F.concat(F.lit("m"), "ord")})
    return align.align_blocks(B.with_sentences(blocks), B.with_sentences(second)).where("nth >= 0").select("doc_id", "unit_id", "nth", "other_unit", "start", "end")


# (id, source, rendering, formulas marked by dollars)
UNITS = [  # two or three rows a rule: citations, a rendering without Chinese, name lists, formulas, what only looks like a mark, empty renderings
    (1, "Silt returns to the basin within a year [4], [9-11].", "泥沙一年内回到港池。", False), (2, "Silt returns to the basin within a year [4], [9-11].", "泥沙一年内回到港池[4]、[9-11]。", False), (3, "Pilots board at the second buoy, as in ［2］ and [5, 6].", "引航员在第二浮标登船［2］。", False),
    (4, "Every ferry waits for the lock to fill again.", "Every ferry waits for the lock", False), (5, "Ferries wait.", "Ferries wait.", False), (6, "Every ferry waits 等 for the lock to fill again.", "每艘渡轮", False),
    (7, "Ingrid Halle, Tomas Berg, Lena Voss and Piet Maas", "Ingrid Halle", False), (8, "K. Oduya, R. Stein, and F. van Dam", "K. Oduya", False), (9, "Depth $d_1$ exceeds $[h]$ here", "水深 $d_1$", True), (10, "Depth $d_1$ exceeds $[h]$ here", "水深 $ d_1 $ 大于 $[h]$", True),
    (11, "Fees of 9 $/t, or 70 $ a call", "费用", False), (12, "The gate stays in state [05] till noon", "闸门不变", False), (13, "any text", " \n", False),
]


def validate_units(spark, sf_dir):
    rows = frame(spark, UNITS, "id int, en string, zh string, math boolean")
    turns = table(spark, sf_dir, "conversations").selectExpr("cast(-1 - (conv_id * 100 + turn) as int) as id", "text as en", "concat('译', text) as zh", "true as math")
    en, zh = F.col("en"), F.col("zh")
    return rows.unionByName(turns).select("id", T.unit_problem(en, zh, F.col("math")).alias("problem"), F.array_join(T.citation_numbers(en), ",").alias("citations"), T.is_name_list(en).alias("names"))


_CITES = "flatten(list_transform(regexp_extract_all(translate({c}, '［］', '[]'), '\\[\\d+(?:\\s*[-–]\\s*\\d+)?(?:\\s*,\\s*\\d+(?:\\s*[-–]\\s*\\d+)?)*\\]'), lambda m: list_filter(regexp_extract_all(m, '\\d+'), lambda n: NOT starts_with(n, '0'))))"
_VALID = f"""
WITH u AS (SELECT * FROM {values(UNITS, "id integer, en varchar, zh varchar, math boolean")} UNION ALL SELECT (-1 - (conv_id * 100 + turn))::INTEGER, text, '译' || text, true FROM conversations),
c AS (SELECT *, {_CITES.format(c="en")} AS ce, {_CITES.format(c="zh")} AS cz,
  list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(en, '\\$[^$]*\\$', ' ', 'g'), '[\\\\*†‡§¶#]|\\d+|\\biD\\b', ' ', 'g'), ',|;|\\band\\b'), lambda p: regexp_replace(p, '^{WS}+|{WS}+$', '', 'g')), lambda p: p <> '') AS parts,
  len(list_filter(string_split_regex(en, '{WS}+'), lambda w: regexp_matches(w, '^[A-Za-z][a-z]+[,.;:]?$'))) AS words,
  regexp_extract_all(en, '\\$((?:\\\\\\$|[^$])+?)\\$') AS fe, list_transform(regexp_extract_all(zh, '\\$((?:\\\\\\$|[^$])+?)\\$'), lambda m: regexp_replace(m, '{WS}+', '', 'g')) AS fz FROM u),
d AS (SELECT *, len(parts) >= 2 AND len(list_filter(parts, lambda p: NOT regexp_matches(p, '^([A-Z][\\p{{L}}''’.\\-]*\\.?{WS}*){{1,5}}$'))) = 0 AS names, list_filter(ce, lambda x: NOT list_contains(cz, x)) AS lost, list_filter(fe, lambda m: NOT list_contains(fz, regexp_replace(m, '{WS}+', '', 'g'))) AS gone FROM c),
e AS (SELECT *, list_filter(lost, lambda x, i: list_position(lost, x) = i) AS lone FROM d)
SELECT id, CASE WHEN regexp_replace(zh, '{WS}+', '', 'g') = '' THEN 'empty translation' WHEN NOT regexp_matches(zh, '[㐀-鿿]') AND words >= 4 AND length(en) > 25 AND NOT names THEN 'not translated'
  WHEN len(lone) > 0 THEN 'lost citation [' || array_to_string(lone, ',') || ']' WHEN math AND len(gone) > 0 THEN 'lost inline math ' || array_to_string(gone, ' ') END AS problem, array_to_string(ce, ',') AS citations, names FROM e
"""

QUERIES = {
    "text_hash": text_hash, "text_forms": text_forms, "sibling_groups": sibling_groups, "reference_tagging": reference_tagging, "front_matter": front_matter, "translatable": translatable, "split_merge": split_merge,
    "split_merge_mid": split_merge_mid, "drop_caps": drop_caps, "sentence_units": sentence_units, "document_progress": document_progress, "unique_gram_join": unique_gram_join, "alignment": alignment, "validate_units": validate_units,
}

ORACLES = {
    "text_hash": _HASH,
    "text_forms": f"""WITH {LINES}, k AS (SELECT *, {_KEY} AS k, trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS c FROM lines)
SELECT doc_id, ord, CASE WHEN length(k) >= 6 THEN k END AS loose_key, regexp_replace(regexp_replace(lower(text), '\\$[^$]*\\$', '', 'g'), '[^a-z0-9]', '', 'g') AS letters, regexp_replace(lower(text), '{WS}+', ' ', 'g') AS search_form, CASE WHEN length(c) > 20 THEN substring(c, 1, 20) || '…' ELSE c END AS snippet FROM k""",
    "sibling_groups": f"WITH {LINES}, t AS (SELECT doc_id % 10 AS doc_id, text FROM lines UNION ALL SELECT item_id % 10, text FROM benchmark), k AS (SELECT DISTINCT doc_id, {_KEY} AS loose_key, md5(text) AS hash FROM t) SELECT doc_id, loose_key, hash FROM k WHERE length(loose_key) >= 6 QUALIFY count(*) OVER (PARTITION BY doc_id, loose_key) > 1",
    "reference_tagging": f"WITH {_TAGGED} SELECT doc_id, ord, role FROM r",
    "front_matter": f"WITH {_ALL} SELECT doc_id, ord, CASE WHEN kind IN ('paragraph', 'listitem') AND length(text) <= 600 AND (" + " OR ".join(f"regexp_matches(text, '{p}')" for p in FRONT).replace(r"\z", "$") + ") THEN 'footnote' END AS role FROM b",
    "translatable": f"WITH {_TAGGED} SELECT doc_id, count(*) FILTER (regexp_matches(text, '[A-Za-z]{{2,}}') AND role IS NULL AND kind IN ('paragraph', 'listitem', 'caption', 'heading')) AS n_translatable, count(*) AS n_blocks FROM r GROUP BY doc_id",
    "split_merge": _split("true"), "split_merge_mid": _split(f"regexp_matches(text, '^{WS}*[a-z]')"), "drop_caps": _CAPS, "unique_gram_join": _GRAMS, "validate_units": _VALID,
}
