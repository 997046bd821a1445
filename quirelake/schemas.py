"""Table schemas of the document engine. Order is always a column (ord), never the order of rows."""

from pyspark.sql import types as t

STYLE = "struct<bold:boolean,italic:boolean,sub:boolean,sup:boolean,monospace:boolean>"
RECT = "struct<page:int,x1:double,y1:double,x2:double,y2:double>"
BLOCKS = f"doc_id bigint, ord bigint, block_id string, kind string, level int, role string, text string, inline_math boolean, rects array<{RECT}>"
SENTENCES = "doc_id bigint, ord bigint, block_id string, idx int, unit_id string, start int, end int, text string, hash string"
CONTENT_ITEMS = (
    "doc_id bigint, ord bigint, type string, page_idx int, bbox array<double>, text string, text_level int, table_body string, table_caption array<string>, "
    "table_footnote array<string>, image_caption array<string>, image_footnote array<string>, list_items array<string>"
)
CACHED = "hash string, zh string, engine string, prompt string, glossary string, t bigint"
CACHE_FILE = "version int, libraryID int, attachmentKey string, position string, glossary string, bookmarks array<struct<blockId:string,text:string,page:int,t:bigint>>, units map<string,struct<zh:string,engine:string,prompt:string,glossary:string,t:bigint>>"
PARSE_FILE = "status string, pdfSha256 string"
ITEM_FILE = "type string, page_idx int, bbox array<double>, text string, text_format string, text_level int, table_body string, table_caption array<string>, table_footnote array<string>, image_caption array<string>, image_footnote array<string>, list_items array<string>"
SDT_NODES = f"doc_id bigint, ord bigint, path array<int>, type string, is_text boolean, n_children int, text_children int, flow_class string, reference boolean, previous_part string, next_part string, text string, style {STYLE}, rects array<{RECT}>, text_map string"

# The same as types, for functions that are defined before there is a session.
RECT_TYPE = t.StructType([t.StructField("page", t.IntegerType()), *(t.StructField(k, t.DoubleType()) for k in ("x1", "y1", "x2", "y2"))])
RECTS_TYPE = t.ArrayType(RECT_TYPE)
RANGES_TYPE = t.ArrayType(t.StructType([t.StructField("start", t.IntegerType()), t.StructField("end", t.IntegerType())]))
CELLS_TYPE = t.ArrayType(t.ArrayType(t.StringType()))
ITEMS_TYPE = t.ArrayType(t.StructType([
    t.StructField("type", t.StringType()), t.StructField("text", t.StringType()), t.StructField("text_level", t.IntegerType()), t.StructField("list_items", t.ArrayType(t.StringType())),
]))
RUNS_TYPE = t.ArrayType(t.StructType([t.StructField("page", t.IntegerType()), t.StructField("n", t.IntegerType())]))
