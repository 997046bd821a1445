"""Cases that were worked out by hand: small inputs of formats that no table has, and what must come of them."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from quirelake.operators import blocks as B
from quirelake.operators import content as C
from quirelake.operators import geometry as G
from quirelake.operators import protocol as P
from quirelake.operators import store as S
from quirelake.operators import tasks as K
from quirelake.plans.base import frame, values
from quirelake.schemas import RECT, STYLE
from quirelake.sources import readers as R
from test_oracles import rows


TEXT_MAPS = [(1, "[[0,2,10,20,40,30,5,[1,6],7]]"), (2, "[[1,0,0,0,9,9,3,3,3]]"), (3, "[[2,1,5,6,7,20,4,4]]"), (4, "[[0,0,1,2,3,4]]"), (5, "nonsense"), (6, None), (7, "[[0,0,1,2],[0,1,0,0,1,1]]")]

DECODED = [(1, 0, 2, 10.0, 20.0, 15.0, 30.0), (1, 1, 2, 16.0, 20.0, 22.0, 30.0), (1, 2, 2, 22.0, 20.0, 29.0, 30.0), (2, 0, 0, 0.0, 0.0, 3.0, 9.0), (2, 1, 0, 3.0, 0.0, 6.0, 9.0), (3, 0, 1, 5.0, 6.0, 7.0, 10.0), (3, 1, 1, 5.0, 10.0, 7.0, 14.0), (4, 0, 0, 1.0, 2.0, 3.0, 4.0), (7, 0, 1, 0.0, 0.0, 1.0, 1.0)]


def text_maps(spark, sf_dir):
    rows = frame(spark, TEXT_MAPS, "id int, m string").select("id", F.posexplode(G.decode_text_map("m")).alias("nth", "c"))
    return rows.select("id", "nth", "c.*")


def sentence_lines(spark, sf_dir):
    """Two sentences over two text nodes: the second starts in one and ends in the other."""
    nodes = frame(spark, [(1, "0.0", "ab cd", "[[0,0,0,0,40,10,10,10,[10,10],10]]"), (1, "0.1", " ef", "[[0,0,0,20,20,30,10,10]]")], "doc_id bigint, node_key string, text string, text_map string")
    segments = frame(spark, [(1, "b", "0.0", 0, 0, 5), (1, "b", "0.1", 5, 0, 3)], "doc_id bigint, block_id string, node_key string, start int, node_start int, length int")
    units = frame(spark, [(1, "b", "b:0", 0, 2), (1, "b", "b:1", 3, 8)], "doc_id bigint, block_id string, unit_id string, start int, end int")
    return G.sentence_boxes(units, segments, nodes).select("unit_id", F.posexplode("lines").alias("nth", "l")).select("unit_id", "nth", "l.*")

ITEMS = [
    {"type": "header", "text": "skip"}, {"type": "text", "text": "I. Intro", "text_level": 1, "page_idx": 0, "bbox": [100.0, 100.0, 500.0, 200.0]}, {"type": "text", "text": " We saw "}, {"type": "text", "text": "  "},
    {"type": "equation", "text": "$$ x = 1 $$"}, {"type": "image", "image_caption": ["Fig. 1. A"], "image_footnote": ["note"]}, {"type": "table", "table_caption": ["TABLE I\n Data"], "table_body": "<table></table>", "table_footnote": ["f"]},
    {"type": "list", "list_items": ["- one $y$", "• two"]}, {"type": "page_footnote", "text": "foot"},
]

ITEM_BLOCKS = [
    ("m0", "heading", "I. Intro", None, 1, None), ("m1", "paragraph", "We saw", None, None, None), ("m2", "math", "", None, None, "x = 1"), ("m3", "image", "", None, None, None), ("m4", "caption", "Fig. 1. A", "caption", None, None), ("m5", "paragraph", "note", "footnote", None, None),
    ("m6", "caption", "TABLE I Data", "caption", None, None), ("m7", "table", "", None, None, None), ("m8", "paragraph", "f", "footnote", None, None), ("m9", "listitem", "one $y$", None, None, None), ("m10", "listitem", "two", None, None, None), ("m11", "paragraph", "foot", "footnote", None, None),
]


def content_blocks(spark, sf_dir):
    keys = ("type", "page_idx", "bbox", "text", "text_level", "table_body", "table_caption", "table_footnote", "image_caption", "image_footnote", "list_items")
    rows = [(1, i, *(x.get(k, 0 if k == "page_idx" else None) for k in keys)) for i, x in enumerate(ITEMS)]
    items = frame(spark, rows, "doc_id bigint, ord bigint, type string, page_idx int, bbox array<double>, text string, text_level int, table_body string, table_caption array<string>, table_footnote array<string>, image_caption array<string>, image_footnote array<string>, list_items array<string>")
    pages = frame(spark, [(1, 0, 600.0, 800.0)], "doc_id bigint, page int, width double, height double")
    return C.content_blocks(items, pages).select("block_id", "kind", "text", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("latex", F.lit("")).alias("latex"), F.coalesce(F.get("rects", F.lit(0))["y2"], F.lit(-1.0)).alias("top"))


def _t(text, **kw):
    return {"text": text, **kw}

SDT = {
    "schemaVersion": "1", "metadata": {"processor": {"type": "t", "version": 2}, "source": {"hash": "h"}},
    "catalog": {"outline": [{"title": "A", "ref": [0], "children": [{"title": "B", "ref": [5]}]}], "pages": [{"label": "i"}, {"viewRect": [10, 20, 110, 220]}]},
    "content": [
        {"type": "heading", "content": [_t("Intro")], "anchor": {"pageRects": [[0, 1, 2, 3, 4]]}}, {"type": "paragraph", "content": [_t("First half"), _t(" more")], "nextPart": [2], "anchor": {"pageRects": [[0, 1, 1, 2, 2]]}},
        {"type": "paragraph", "content": [_t("second half.")], "previousPart": [1], "anchor": {"pageRects": [[1, 1, 1, 2, 2]]}}, {"type": "list", "content": [{"type": "listitem", "content": [_t("one")]}, {"type": "listitem", "content": [{"type": "paragraph", "content": [_t("two")]}]}]},
        {"type": "section", "flowClass": "excluded", "content": [{"type": "paragraph", "content": [_t("gone")]}]}, {"type": "heading", "content": [_t("Sub")]}, {"type": "image", "content": [{"type": "caption", "content": [_t("inside")]}]},
        {"type": "paragraph", "reference": True, "content": [_t("[1] X.", style={"italic": True})]}, {"type": "caption", "content": [_t("Fig. 1")]}, {"type": "math"},
    ],
}

SDT_BLOCKS = [
    ("0", "heading", "Intro", "", 1, "0", 1), ("1", "paragraph", "First half more second half.", "", -1, "1,2", 2), ("3.0", "listitem", "one", "", -1, "3.0", 0), ("3.1.0", "paragraph", "two", "", -1, "3.1.0", 0), ("5", "heading", "Sub", "", 2, "5", 0), ("6", "image", "", "", -1, "6", 0),
    ("7", "paragraph", "[1] X.", "reference", -1, "7", 0), ("8", "caption", "Fig. 1", "caption", -1, "8", 0), ("9", "math", "", "", -1, "9", 0),
]


def sdt_blocks(spark, sf_dir):
    docs = frame(spark, [(1, json.dumps(SDT))], "doc_id bigint, j string").select("doc_id", F.parse_json("j").alias("doc"))
    out = R.sdt_blocks(docs)
    return out.select("block_id", "kind", "text", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("level", F.lit(-1)).alias("level"), F.array_join("parts", ",").alias("parts"), F.size("rects").alias("n_rects"))


def sdt_pages(spark, sf_dir):
    docs = frame(spark, [(1, json.dumps(SDT))], "doc_id bigint, j string").select("doc_id", F.parse_json("j").alias("doc"))
    return R.sdt_pages(docs).select("page", "width", "height", F.coalesce("label", F.lit("")).alias("label"))


def recovered_tables(spark, sf_dir):
    """A caption over an empty region of its column, one over a table, and one without room."""
    def rect(p, a, b, c, d):
        return {"page": p, "x1": float(a), "y1": float(b), "x2": float(c), "y2": float(d)}

    blocks = [(1, 0, "a", "caption", None, "caption", "TABLE I. Data", False, [rect(0, 50, 700, 250, 710)]), (1, 1, "b", "paragraph", None, None, "text", False, [rect(0, 50, 400, 280, 500)]), (1, 2, "c", "caption", None, "caption", "Table 2 more", False, [rect(0, 320, 700, 520, 710)]), (1, 3, "d", "table", None, None, "", False, [rect(0, 320, 600, 520, 695)]), (1, 4, "e", "caption", None, "caption", "TABLE III", False, [rect(0, 50, 510, 250, 520)])]
    rows = frame(spark, blocks, f"doc_id bigint, ord bigint, block_id string, kind string, level int, role string, text string, inline_math boolean, rects array<{RECT}>")
    nodes = rows.select("doc_id", F.explode("rects").alias("rect"))
    return B.recover_tables(rows, nodes).select("ord", "block_id", "kind", F.concat_ws(",", *[F.col("rects")[0][k].cast("int") for k in ("x1", "y1", "x2", "y2")]).alias("rect"))

TABLES = [(1, "<table><tr><th> A </th><th>B</th></tr><tr><td>1<sub>x</sub></td><td><span>2 &amp; 3</span></td></tr></table><table><tr><td>no</td></tr></table>"), (2, "<p>none</p>"), (3, None), (4, "<table><tr><td rowspan=2>x<br>y</td></tr><tr></tr></table>")]

TSVS = [(1, "A\tB\n1x\t2 & 3"), (2, ""), (3, ""), (4, "xy\n")]


def table_tsv(spark, sf_dir):
    return frame(spark, TABLES, "id int, html string").select("id", R.tsv(R.html_table("html")).alias("tsv"))


def small_files(spark, sf_dir):
    """TOML values, key files, glossaries, model lists and providers, one row for what each gives."""
    toml = frame(spark, [(1, i, v) for i, v in enumerate(['model = "top"', "[models]", ' default = "g-1" # x', 'default = "late"', "n = 3", "[other]", 'default = "o"'])], "doc_id bigint, ord bigint, value string")
    a = R.toml_values(toml).select(F.concat_ws("|", F.lit("toml"), "section", "key", "val").alias("line"))
    keys = frame(spark, [("ABC\tfirst",), ("# no",), ("  ",), ("DEF",)], "value string")
    b = R.keys_file(keys).select(F.concat_ws("|", F.lit("key"), "key", F.coalesce("label", F.lit("-"))).alias("line"))
    g = R.glossary_rows(frame(spark, [(0, "Wind Farm = 风电场"), (1, "none"), (2, "a=b=c")], "line bigint, value string"))
    c = g.select(F.concat_ws("|", F.lit("term"), "en", "en_key", "zh").alias("line"))
    m = R.model_ids(frame(spark, [("u", '{"data":[{"id":"m2"},{"name":"m1"},"m3",{"id":"m2"}]}'), ("v", '{"models":["x"]}'), ("w", "bad")], "base string, value string"))
    d = m.select(F.concat_ws("|", F.lit("model"), "base", "model").alias("line"))
    p = R.providers(frame(spark, [("p1", None, "http://h/v1//", "k", ["a", "", "b", "a"], 0, "low"), ("p2", "N", None, None, None, 99, "odd")], "id string, name string, base string, key string, models array<string>, concurrency int, effort string"))
    e = p.select(F.concat_ws("|", F.lit("provider"), "id", "name", "base", F.array_join("models", ","), F.col("concurrency").cast("string"), "effort").alias("line"))
    r = R.resolved_engines(frame(spark, [("api:p1:a:b",), ("api:p9:x",), ("grok",)], "engine_id string"), p)
    f = r.select(F.concat_ws("|", F.lit("engine"), "provider", "model", "config").alias("line"))
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e).unionByName(f)

SMALL = [
    "toml||model|top", "toml|models|default|g-1", "toml|other|default|o", "key|ABC|first", "key|DEF|-", "term|Wind Farm|wind farm|风电场", "term|a|a|b=c", "model|u|m2", "model|u|m1", "model|u|m3", "model|v|x",
    "provider|p1|API|http://h/v1|a,b|8|low", "provider|p2|N|||64|", "engine|p1|a:b|api:p1:a:b|http://h/v1|a:b|low|8ce4b16b",
]


def delivered_entries(spark, sf_dir):
    files = frame(spark, [("1", '{"translations":[{"id":"a","zh":"甲"},{"id":"b"},{"id":3,"zh":"x"}]}'), ("2", '{"c":"丙","d":5}'), ("3", '{"half')], "file string, value string")
    return R.entries(files.select("file", F.try_parse_json("value").alias("v")).where("v is not null")).select("file", "unit_id", "zh")


def style_runs(spark, sf_dir):
    from quirelake.operators.views import runs_of_style

    none = {"bold": False, "italic": False, "sub": False, "sup": False, "monospace": False}
    segments = frame(spark, [(1, "b", 0, 5, none), (1, "b", 5, 4, {**none, "italic": True})], f"doc_id bigint, block_id string, seg_start int, length int, style {STYLE}")
    return runs_of_style(segments, frame(spark, [(1, "b", 3, 7), (1, "b", 7, 20)], "doc_id bigint, block_id string, start int, end int")).select("a", "b", F.col("style.italic").alias("italic"))

ANSWERS = [
    (1, '```json\n{"translations":[{"id":"b:0","zh":"好"},{"id":"b:1","zh":"甲"},{"id":"b:1","zh":"乙"},{"id":"x","zh":"?"}]}\n```'), (2, 'Here you are: {"translations":[{"id":"c:0","zh":" 完成 "}]} done'), (3, "no answer"), (4, '{"translations":[{"id":"d:0","zh":5},{"id":"d:1","zh":"See it"}]}'),
]

ASKED = [(1, "b:0", "Good.", False), (1, "b:1", "Twice.", False), (1, "b:2", "Missing.", False), (2, "c:0", "Done.", False), (3, "e:0", "Nothing.", False), (4, "d:0", "Number.", False), (4, "d:1", "This one is left as it was written [3].", False)]

ANSWERED = [
    (1, "b:0", "好", None), (1, "b:1", None, "duplicate id"), (1, "b:2", None, None), (1, "x", None, "unexpected id"), (2, "c:0", "完成", None), (3, "e:0", None, None), (4, "d:0", None, "empty translation"), (4, "d:1", None, "not translated"),
]


def answered(spark, sf_dir):
    return P.answered(frame(spark, ANSWERS, "batch bigint, response string"), frame(spark, ASKED, "batch bigint, unit_id string, en string, math boolean"))

GLOSSARIES = [
    (1, "Wind farm = 风场\nnote", "wind farm = 风电场\nramp event = 爬坡事件", '{"terms":[{"en":"a","zh":"甲"},{"en":" ","zh":"乙"},{"en":"b","zh":3},{"en":" c ","zh":" 丙 "}]}'), (2, "", "x = y\r\nz", '```json\n{"terms":[]}\n```'), (3, "A=1", "a = 2", 'Sure: {"terms":[{"en":"q","zh":"问"}]} ok'), (4, "", "", "none"),
]

GLOSSARY_RESULT = [(1, "Wind farm = 风场\nramp event = 爬坡事件", "a = 甲\nc = 丙", "49d9c2aa"), (2, "x = y", "", ""), (3, "A=1", "q = 问", ""), (4, "", "", "")]


def glossaries(spark, sf_dir):
    rows = frame(spark, GLOSSARIES, "id int, own string, paper string, answer string")
    return rows.select("id", S.merged_glossary(F.col("own"), F.col("paper")).alias("merged"), S.parsed_glossary(F.col("answer")).alias("parsed"))


def prompts(spark, sf_dir):
    part = [{"ord": 0, "block_id": "b", "kind": "paragraph", "units": [{"id": "b:1", "en": "Two."}], "full_text": "One. Two.", "total_units": 2, "math": False}, {"ord": 1, "block_id": "c", "kind": "heading", "units": [{"id": "c:0", "en": "End"}], "full_text": "End", "total_units": 1, "math": False}]
    rows = frame(spark, [(1, part, 2)], "id int, p array<struct<ord:bigint,block_id:string,kind:string,units:array<struct<id:string,en:string>>,full_text:string,total_units:int,math:boolean>>, n int")
    return rows.select("id", P.user_prompt(F.col("p"), F.col("n"), F.lit("T")).alias("prompt"))

PROMPT = 'Translate these units. Return {"translations":[...]} with 2 items.\n{"paper":"T","paragraphs":[{"type":"paragraph","context":"One. Two.","units":[{"id":"b:1","en":"Two."}]},{"type":"heading","units":[{"id":"c:0","en":"End"}]}]}'


def _rect(p, a, b, c, d):
    return {"page": p, "x1": float(a), "y1": float(b), "x2": float(c), "y2": float(d)}


def unit_places(spark, sf_dir):
    """A unit of the base text, one of the second parse with two pieces, and one whose pieces have no lines."""
    units = frame(spark, [(1, "b:0", 0, 5), (1, "m1:0", 0, 9), (1, "m2:0", 0, 4)], "doc_id bigint, unit_id string, start int, end int")
    spans = frame(spark, [(1, "m1:0", 0, "b:0", "b", 2, 5), (1, "m1:0", 1, "c:0", "c", 0, 4), (1, "m1:0", -1, "b:0", "b", 0, 0), (1, "m2:0", 0, "c:1", "c", 5, 9)], "doc_id bigint, unit_id string, nth int, other_unit string, other_block string, start int, end int")
    boxes = frame(spark, [(1, "b", 0, [_rect(0, 1, 1, 2, 2)]), (1, "b", 2, []), (1, "c", 0, [_rect(1, 3, 3, 4, 4)])], f"doc_id bigint, block_id string, start int, lines array<{RECT}>")
    blocks = frame(spark, [(1, "b", [_rect(0, 0, 0, 9, 9)]), (1, "c", [_rect(1, 5, 5, 6, 6), _rect(2, 0, 0, 1, 1)])], f"doc_id bigint, block_id string, rects array<{RECT}>")
    out = K.located(K.pieces(units, spans), boxes, blocks)
    return out.select("unit_id", F.size("place").alias("n"), F.col("place")[0]["page"].alias("page"), F.col("place")[0]["x1"].alias("x1"))


def positions(spark, sf_dir):
    rows = frame(spark, [(1, "b@0"), (2, "gone@3"), (3, "gone@9"), (4, "b"), (5, "a@b@2")], "doc_id bigint, position string")
    blocks = frame(spark, [(1, "b"), (2, "x"), (4, "b"), (5, "a@b")], "doc_id bigint, block_id string")
    markers = frame(spark, [(1, 0), (2, 3), (3, 1)], "doc_id bigint, page int")
    return K.restored_position(rows, blocks, markers).select("doc_id", F.coalesce("block_id", F.lit("")).alias("block_id"), F.coalesce("page", F.lit(-1)).alias("page"))


def new_annotations(spark, sf_dir):
    """A highlight over two pages."""
    requests = frame(spark, [(1, "#ffd400", "n")], "request_id int, color string, comment string")
    boxes = frame(spark, [(1, 0, " One. ", [_rect(0, 10.00049, 700, 50, 710)], 800.0, 120), (1, 1, "Two.", [_rect(0, 10, 690, 50, 699.5), _rect(1, 10, 780, 50, 790)], 800.0, 126)], f"request_id int, nth int, text string, lines array<{RECT}>, page_height double, offset int")
    return K.new_annotations(requests, boxes).select("request_id", "page", "color", "comment", "text", F.array_join(F.transform(F.flatten("rects"), lambda v: v.cast("decimal(10,3)").cast("string")), ",").alias("rects"), "sort_index")


def names_and_specs(spark, sf_dir):
    rows = frame(spark, [(1, "AB", "it's", "api:gpt:low"), (7, "Q", "", "grok")], "lib int, k string, dir string, spec string")
    return rows.select(K.cache_file(F.col("lib"), F.col("k")).alias("file"), K.quoted(F.col("dir")).alias("quoted"), K.engine_spec(F.col("spec")).alias("s")).select("file", "quoted", "s.*")


def opened_settings(spark, sf_dir):
    kind = "attachment string, glossary string, position string"
    return K.opened_settings(frame(spark, [("a", None, None), ("b", "g", "p"), ("c", "", None)], kind), frame(spark, [("a", "x", "y"), ("b", "x", "y"), ("c", "x", "")], kind)).na.fill("-")


WANT = {
    "text_maps": f"SELECT * FROM {values(DECODED, 'id integer, nth integer, page integer, x1 double, y1 double, x2 double, y2 double')}",
    "sentence_lines": f"SELECT * FROM {values([('b:0', 0, 0, 0.0, 0.0, 20.0, 10.0), ('b:1', 0, 0, 30.0, 0.0, 50.0, 10.0), ('b:1', 1, 0, 0.0, 20.0, 20.0, 30.0)], 'unit_id varchar, nth integer, page integer, x1 double, y1 double, x2 double, y2 double')}",
    "content_blocks": f"SELECT * FROM {values([(i, k, t, r or '', v or -1, x or '', 720.0 if i == 'm0' else -1.0) for i, k, t, r, v, x in ITEM_BLOCKS], 'block_id varchar, kind varchar, text varchar, role varchar, level integer, latex varchar, top double')}",
    "sdt_blocks": f"SELECT * FROM {values(SDT_BLOCKS, 'block_id varchar, kind varchar, text varchar, role varchar, level integer, parts varchar, n_rects integer')}",
    "sdt_pages": f"SELECT * FROM {values([(0, 612.0, 792.0, 'i'), (1, 100.0, 200.0, '')], 'page integer, width double, height double, label varchar')}",
    "recovered_tables": f"SELECT * FROM {values([(0, 'a', 'caption', '50,700,250,710'), (1, 'a.t', 'table', '42,521,288,697'), (2, 'b', 'paragraph', '50,400,280,500'), (3, 'c', 'caption', '320,700,520,710'), (4, 'd', 'table', '320,600,520,695'), (5, 'e', 'caption', '50,510,250,520')], 'ord bigint, block_id varchar, kind varchar, rect varchar')}",
    "table_tsv": f"SELECT * FROM (VALUES (1, 'A' || chr(9) || 'B' || chr(10) || '1x' || chr(9) || '2 & 3'), (2, ''), (3, ''), (4, 'xy' || chr(10))) AS v(id, tsv)",
    "small_files": f"SELECT * FROM {values([(x,) for x in SMALL], 'line varchar')}",
    "delivered_entries": f"SELECT * FROM {values([('1', 'a', '甲'), ('2', 'c', '丙')], 'file varchar, unit_id varchar, zh varchar')}",
    "style_runs": f"SELECT * FROM {values([(3, 5, False), (5, 7, True), (7, 9, True)], 'a integer, b integer, italic boolean')}",
    "answered": f"SELECT * FROM {values(ANSWERED, 'batch bigint, unit_id varchar, zh varchar, problem varchar')}",
    "glossaries": f"SELECT id, merged, parsed FROM {values(GLOSSARY_RESULT, 'id integer, merged varchar, parsed varchar, tag varchar')}",
    "prompts": f"SELECT * FROM {values([(1, PROMPT)], 'id integer, prompt varchar')}",
    "unit_places": f"SELECT * FROM {values([('b:0', 1, 0, 1.0), ('m1:0', 1, 1, 3.0), ('m2:0', 1, 1, 5.0)], 'unit_id varchar, n integer, page integer, x1 double')}",
    "positions": f"SELECT * FROM {values([(1, 'b', -1), (2, '', 3), (3, '', -1), (4, 'b', -1), (5, 'a@b', -1)], 'doc_id bigint, block_id varchar, page integer')}",
    "new_annotations": f"SELECT * FROM {values([(1, 0, '#ffd400', 'n', 'One. Two.', '10.000,700.000,50.000,710.000,10.000,690.000,50.000,699.500', '00000|000120|00090'), (1, 1, '#ffd400', 'n', 'Two.', '10.000,780.000,50.000,790.000', '00001|000126|00010')], 'request_id integer, page integer, color varchar, comment varchar, text varchar, rects varchar, sort_index varchar')}",
    "names_and_specs": f"SELECT * FROM {values([('1-AB.json', chr(39) + 'it' + chr(39) * 2 + 's' + chr(39), 'api', 'gpt', 'low'), ('7-Q.json', chr(39) * 2, 'grok', '', '')], 'file varchar, quoted varchar, kind varchar, model varchar, effort varchar')}",
    "opened_settings": f"SELECT * FROM {values([('a', 'x', 'y'), ('b', 'g', 'p'), ('c', '', '-')], 'attachment varchar, glossary varchar, position varchar')}",
}


@pytest.mark.parametrize("name", sorted(WANT))
def test_case(spark, name):
    got, want = globals()[name](spark, None).toPandas(), duckdb.connect().execute(WANT[name]).df()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))
