"""Sources. All read through Spark, so paths may be in any store; schemas are given, never inferred."""

from __future__ import annotations

import json
from html.parser import HTMLParser
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType

from quirelake import schemas as S
from quirelake.functions import text as T
from quirelake.sources import files as many

# ---- structured text -------------------------------------------------------

KINDS = {"paragraph": "paragraph", "heading": "heading", "caption": "caption", "math": "math", "listitem": "listitem", "preformatted": "pre", "note": "paragraph"}


def structured_text(spark: SparkSession, path: str) -> DataFrame:
    """Structured-text files as (path, doc): JSON files only (first byte a brace); others are left out."""
    files = many.texts(spark, path)
    return files.where(F.ltrim(F.col("value")).startswith("{")).select("path", F.try_parse_json("value").alias("doc")).where("doc is not null")


def sdt_nodes(docs: DataFrame) -> DataFrame:
    """Trees (doc_id, doc VARIANT) → one row a node: doc_id, path, key, parent, type, is_text, flow, reference, previous_part, next_part, text, style, rects, text_map, n_children, and
    outline, the document's (JSON) in the row of its first node.

    The walk goes down level by level: each step explodes the children of all documents at once, until none is left; its depth is that of the deepest tree. What is known of a node is read from its
    tree once, and written with what lies below it; the rows that come back hold no trees.
    """
    from quirelake.sources.tables import scratch

    def get(path: str, kind: str) -> Column:
        return F.try_variant_get("n", path, kind)

    style = F.struct(*[F.coalesce(get(f"$.style.{k}", "boolean"), F.lit(False)).alias(k) for k in ("bold", "italic", "sub", "sup", "monospace")])
    rects = F.transform(F.coalesce(get("$.anchor.pageRects", "array<array<double>>"), F.array().cast("array<array<double>>")), lambda r: F.struct(r[0].cast("int").alias("page"), *[r[i].alias(k) for i, k in ((1, "x1"), (2, "y1"), (3, "x2"), (4, "y2"))]))
    known = [
        "doc_id", "path", F.array_join(F.col("path").cast("array<string>"), ".").alias("key"), F.array_join(F.slice("path", 1, F.size("path") - 1).cast("array<string>"), ".").alias("parent"),
        get("$.type", "string").alias("type"), (get("$.text", "string").isNotNull() & get("$.type", "string").isNull()).alias("is_text"), get("$.flowClass", "string").alias("flow"),
        F.coalesce(get("$.reference", "boolean"), F.lit(False)).alias("reference"), get("$.previousPart", "array<int>").alias("previous_part"), F.array_join(get("$.nextPart", "array<string>"), ".").alias("next_part"),
        get("$.text", "string").alias("text"), style.alias("style"), rects.alias("rects"), get("$.anchor.textMap", "string").alias("text_map"), F.coalesce(F.size(get("$.content", "array<variant>")), F.lit(0)).alias("n_children"),
    ]
    below = docs.select("doc_id", F.try_variant_get("doc", "$.content", "variant").alias("content"), F.array().cast("array<int>").alias("path"), F.to_json(F.try_variant_get("doc", "$.catalog.outline", "variant")).alias("outline"))
    out = None
    while True:
        kids = below.select("doc_id", F.posexplode(F.try_variant_get("content", "$", "array<variant>")).alias("i", "n"), "path", "outline")
        level = scratch(kids.select("doc_id", "n", F.concat("path", F.array("i")).alias("path"), F.when(F.col("i") == 0, F.col("outline")).alias("outline")).select(*known, "outline", get("$.content", "variant").alias("content")), "level")
        if out is not None and level.isEmpty():
            return out
        out = level.drop("content") if out is None else out.unionByName(level.drop("content"))
        below = level.where("content is not null").select("doc_id", "content", "path", F.lit(None).cast("string").alias("outline"))


def flattened(nodes: DataFrame) -> DataFrame:
    """Nodes that become blocks, in reading order: doc_id, ord, key, path, kind, reference.

    Excluded subtrees, and parts that continue another block, go; images and tables are leaves, and so are text kinds with only text below.
    Whether an ancestor stops the walk is an anti-join on the keys of ancestors.
    """
    from quirelake.sources.tables import scratch

    text_kids = nodes.where("is_text").groupBy("doc_id", F.col("parent").alias("key")).agg(F.count("*").alias("t"))
    n = nodes.where("not is_text").join(text_kids, ["doc_id", "key"], "left")
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    kind = F.when(F.col("type").isin("image", "table"), F.col("type")).when((F.col("n_children") == 0) | (F.coalesce("t", F.lit(0)) == F.col("n_children")), F.try_element_at(kinds, "type"))
    n = scratch(n.select("doc_id", "key", "path", kind.alias("kind"), ((F.coalesce("flow", F.lit("")) == "excluded") | F.col("previous_part").isNotNull()).alias("gone"), "reference"), "walk")
    stops = n.where("gone or kind is not null").select("doc_id", F.col("key").alias("ancestor"))
    above = n.select("doc_id", "key", F.explode_outer(F.expr("transform(sequence(1, size(path) - 1), i -> array_join(cast(slice(path, 1, i) as array<string>), '.'))")).alias("ancestor")).where("ancestor is not null and size(split(key, '[.]')) > 1")
    hidden = above.join(stops, ["doc_id", "ancestor"]).select("doc_id", "key").distinct()
    rows = n.where("not gone and kind is not null").join(hidden, ["doc_id", "key"], "left_anti")
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1).cast("bigint").alias("ord"), "key", "path", "kind", "reference")


def part_chains(heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each head (doc_id, key) with the parts that continue it: doc_id, head, hop, key. A chain ends at a missing node and where it would come back to one it holds.

    Pointers are doubled: a round knows where 2**k steps lead, adds them to all places found so far, and keeps the first visit of each part; it ends when a round finds no new part. A chain of n parts
    takes log2(n) + 1 rounds, a cycle of n parts as many, and what is written in all rounds is some twice the result. All its joins are shuffled: small as the files of pointers are, none goes through the driver.
    """
    from quirelake.sources.tables import scratch

    link = nodes.where("not is_text").select("doc_id", "key", F.when(F.col("next_part") != "", F.col("next_part")).alias("to"))
    jump = scratch(link.where("to is not null").join(link.select("doc_id", F.col("key").alias("to")).hint("merge"), ["doc_id", "to"], "left_semi").select("doc_id", "key", "to"), "jump")
    found = scratch(heads.select("doc_id", F.col("key").alias("head"), F.lit(0).cast("bigint").alias("hop"), "key"), "parts")
    n = found.count()
    for k in count():
        further = found.join(jump.hint("merge"), ["doc_id", "key"]).select("doc_id", "head", (F.col("hop") + (1 << k)).alias("hop"), F.col("to").alias("key"))
        found = scratch(found.unionByName(further).groupBy("doc_id", "head", "key").agg(F.min("hop").alias("hop")), "parts")
        before, n = n, found.count()
        if n == before:
            return found.select("doc_id", "head", F.col("hop").cast("int").alias("hop"), "key")
        jump = scratch(jump.join(jump.select("doc_id", F.col("key").alias("to"), F.col("to").alias("end")).hint("merge"), ["doc_id", "to"]).select("doc_id", "key", F.col("end").alias("to")), "jump")


def sdt_blocks(docs: DataFrame) -> DataFrame:
    """Structured text (doc_id, doc VARIANT) → blocks, with segments (node_key, start, length) into their text nodes, before tagging and merging."""
    from quirelake.sources.tables import scratch

    nodes = sdt_nodes(docs)
    flat = scratch(flattened(nodes), "flat")
    parts = part_chains(flat, nodes)
    texts = nodes.where("is_text and text <> ''").select("doc_id", F.col("parent").alias("key"), F.element_at("path", -1).alias("i"), F.col("key").alias("node_key"), "text", "style")
    own = nodes.where("not is_text").select("doc_id", "key", "rects")
    # a part meets its texts and its own row (where i is null) in one join
    held = parts.join(texts.unionByName(own, allowMissingColumns=True), ["doc_id", "key"]).groupBy("doc_id", F.col("head").alias("key")).agg(*[
        F.sort_array(F.collect_list(F.when(kept, F.struct(*columns)))).alias(name)
        for name, kept, columns in (("p", F.col("i").isNotNull(), ("hop", "i", "node_key", "text", "style")), ("r", F.col("i").isNull(), ("hop", "rects")), ("k", F.col("i").isNull(), ("hop", "key")))
    ])
    start = F.struct(F.lit("").alias("text"), F.array().cast(f"array<struct<node_key:string,start:int,length:int,style:{S.STYLE}>>").alias("segments"))

    def glue(a: Column, p: Column) -> Column:
        gap = (a["text"] != "") & ~a["text"].rlike(rf"{T.WS}\z") & ~p["text"].rlike(f"^{T.WS}") & (p["hop"] > 0) & (p["i"] == 0)
        before = F.concat(a["text"], F.when(gap, " ").otherwise(""))
        seg = F.struct(p["node_key"].alias("node_key"), F.length(before).alias("start"), F.length(p["text"]).alias("length"), p["style"].alias("style"))
        return F.struct(F.concat(before, p["text"]).alias("text"), F.concat(a["segments"], F.array(seg)).alias("segments"))

    body = held.select("doc_id", "key", "r", "k", F.when(F.size("p") > 0, F.aggregate("p", start, glue)).alias("b"))
    levels = nodes.where("outline is not null").select("doc_id", F.explode(_levels("outline")).alias("key", "level"))
    rows = flat.join(body, ["doc_id", "key"], "left").join(levels, ["doc_id", "key"], "left")
    role = F.when(F.col("kind") == "caption", "caption").when(F.col("reference"), "reference")
    return rows.select(
        "doc_id", "ord", F.col("key").alias("block_id"), "kind", F.when(F.col("kind") == "heading", F.coalesce("level", F.lit(2))).cast("int").alias("level"), role.alias("role"), F.coalesce("b.text", F.lit("")).alias("text"),
        F.lit(False).alias("inline_math"), F.flatten(F.transform("r", lambda r: r["rects"])).alias("rects"), F.transform("k", lambda k: k["key"]).alias("parts"), F.col("b.segments").alias("segments"),
    )


def levels_of(outline: str | None) -> dict[str, int]:
    """The depth of each address in an outline (JSON); of repeated addresses the last counts."""
    out: dict[str, int] = {}
    todo = [(x, 1) for x in reversed(json.loads(outline) if outline else [])]
    while todo:
        item, depth = todo.pop()
        if item.get("ref"):
            out[".".join(map(str, item["ref"]))] = depth
        todo += [(x, depth + 1) for x in reversed(item.get("children") or [])]
    return out


@F.pandas_udf(MapType(StringType(), IntegerType()))
def _levels(outlines: pd.Series) -> pd.Series:
    return outlines.map(levels_of)


def outline_levels(doc: Column) -> Column:
    """The depth of each address in a document's outline (one small value a document): a map; of repeated addresses the last counts."""
    return _levels(F.to_json(F.try_variant_get(doc, "$.catalog.outline", "variant")))


def sdt_pages(docs: DataFrame) -> DataFrame:
    """Pages of structured text: doc_id, page, width, height, label; a page without a view is 612 by 792."""
    rows = docs.select("doc_id", F.posexplode(F.try_variant_get("doc", "$.catalog.pages", "array<variant>")).alias("page", "p"))
    view = F.coalesce(F.try_variant_get("p", "$.viewRect", "array<double>"), F.array(*map(F.lit, (0.0, 0.0, 612.0, 792.0))))
    return rows.select("doc_id", "page", (view[2] - view[0]).alias("width"), (view[3] - view[1]).alias("height"), F.try_variant_get("p", "$.label", "string").alias("label"))


# ---- parse stores and caches ----------------------------------------------


def content_lists(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """Content items below root/<key>/raw/content_list.json whose root/<key>/parse.json says that the parse is complete.

    strict needs the status to be there. Returns key, sha, and the item's columns with ord. Folders without both files give nothing; compare sha with file_hashes().
    """
    at = F.col("_metadata.file_path")
    state = spark.read.schema(S.PARSE_FILE).json(f"{root}/*/parse.json", multiLine=True).select(F.regexp_extract(at, "([^/]+)/parse[.]json$", 1).alias("key"), "status", F.col("pdfSha256").alias("sha"))
    state = state.where("status = 'complete'" if strict else "coalesce(status, 'complete') = 'complete'").drop("status")
    text = spark.read.text(f"{root}/*/raw/content_list.json", wholetext=True).select(F.regexp_extract(at, "([^/]+)/raw/content_list[.]json$", 1).alias("key"), F.from_json("value", f"array<struct<{_struct(S.ITEM_FILE)}>>").alias("items"))
    return text.join(state, "key").select("key", "sha", F.posexplode("items").alias("ord", "i")).select("key", "sha", F.col("ord").cast("bigint").alias("ord"), "i.*")


def _struct(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (part.strip().split(" ", 1) for part in ddl.split(", ")))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of files: path, sha."""
    return many.contents(many.files_below(spark, path, False)).select("path", F.sha2("content", 256).alias("sha"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: path, modified, size. Contents are not read."""
    return many.files_below(spark, path)


def caches(spark: SparkSession, path: str) -> DataFrame:
    """Renderings in cache files of version 1: path, attachment, hash, META. Files of other versions, or that do not parse, give nothing."""
    rows = many.json_rows(spark, path, _struct(S.CACHE_FILE)).where("version = 1 and units is not null")
    return rows.select("path", F.col("attachmentKey").alias("attachment"), F.explode("units").alias("hash", "u")).select("path", "attachment", "hash", "u.*")


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """Entries of result files, {id: text} or {"translations": [{id, zh}]}: file, pos, unit_id, zh. Half-written files give nothing until they are whole."""
    files = many.texts(spark, path).select(F.col("path").alias("file"), F.try_parse_json("value").alias("v"))
    return entries(files)


def entries(files: DataFrame) -> DataFrame:
    """(file, v VARIANT) → file, pos, unit_id, zh: entries whose id and text are strings."""
    listed_ = F.try_variant_get("v", "$.translations", "array<variant>")

    def text(v: Column, path: str) -> Column:
        part = F.try_variant_get(v, path, "variant")
        return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(v, path, "string"))

    lists = files.where(listed_.isNotNull()).select("file", F.posexplode(listed_).alias("pos", "e")).select("file", "pos", text(F.col("e"), "$.id").alias("unit_id"), text(F.col("e"), "$.zh").alias("zh"))
    maps = files.where(listed_.isNull()).select("file", F.posexplode(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))).alias("pos", "e"))
    maps = maps.select("file", "pos", F.col("e.key").alias("unit_id"), text(F.col("e.value"), "$").alias("zh"))
    return lists.unionByName(maps).where("unit_id is not null and zh is not null")


# ---- small text files ------------------------------------------------------


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """Lines `English = rendering`: line, en, en_key, zh."""
    return glossary_rows(spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value"))


def glossary_rows(lines: DataFrame) -> DataFrame:
    v = T.strip(F.col("value"))
    en = T.strip(F.substring_index(v, "=", 1))
    return lines.where(v.contains("=")).select("line", en.alias("en"), F.lower(en).alias("en_key"), T.strip(F.expr("substring(value, instr(value, '=') + 1)")).alias("zh"))


def keys_file(lines: DataFrame) -> DataFrame:
    """Lines (value) `key[TAB label]` → key, label; blank lines and comments go."""
    v = T.strip(F.col("value"))
    return lines.where((v != "") & ~v.startswith("#")).select(T.strip(F.split("value", "\t")[0]).alias("key"), F.nullif(T.strip(F.coalesce(F.get(F.split("value", "\t"), F.lit(1)), F.lit(""))), F.lit("")).alias("label"))


def toml_values(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, ord, value) of simple TOML → doc_id, section, key, val: `key = "text"` under its `[section]`; the first of a key."""
    v = T.strip(F.col("value"))
    head = F.when(v.rlike(r"^\[[^\]]+\]\z"), T.strip(F.regexp_extract(v, r"^\[([^\]]+)\]", 1)))
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("section", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit(""))).where(head.isNull() & v.rlike(r'^[A-Za-z0-9_.-]+\s*=\s*"[^"]*"'))
    found = rows.select("doc_id", "ord", "section", F.regexp_extract(v, r"^([A-Za-z0-9_.-]+)", 1).alias("key"), F.regexp_extract(v, r'=\s*"([^"]*)"', 1).alias("val"))
    return found.groupBy("doc_id", "section", "key").agg(F.min_by("val", "ord").alias("val"))


def model_ids(answers: DataFrame) -> DataFrame:
    """Model lists (base, value JSON) → base, model: the id, else the name, else the entry itself; distinct."""
    v = F.try_parse_json("value")
    items = F.coalesce(F.try_variant_get(v, "$.data", "array<variant>"), F.try_variant_get(v, "$.models", "array<variant>"))
    rows = answers.select("base", F.explode(items).alias("m"))
    name = F.coalesce(F.try_variant_get("m", "$.id", "string"), F.try_variant_get("m", "$.name", "string"), F.try_variant_get("m", "$", "string"))
    return rows.select("base", name.alias("model")).where("model <> ''").distinct()


def providers(rows: DataFrame) -> DataFrame:
    """API providers(id, name, base, key, models, concurrency, effort) in normal form."""
    efforts = ("minimal", "low", "medium", "high", "xhigh", "max")
    return rows.select(
        "id", F.coalesce("name", F.lit("API")).alias("name"), F.regexp_replace(T.strip(F.coalesce("base", F.lit(""))), "/+$", "").alias("base"), F.coalesce("key", F.lit("")).alias("key"),
        F.array_distinct(F.filter(F.coalesce("models", F.array().cast("array<string>")), lambda m: m != "")).alias("models"),
        F.least(F.lit(64), F.greatest(F.lit(1), F.when(F.coalesce("concurrency", F.lit(0)) == 0, 8).otherwise(F.col("concurrency")))).alias("concurrency"), F.when(F.col("effort").isin(*efforts), F.col("effort")).otherwise("").alias("effort"),
    )


# What a single provider of older settings was, and the name that it gets.
OLD_BASE, OLD_CONCURRENCY, OLD_NAME = "https://api.openai.com/v1", 4, "OpenAI 兼容 API"


def loaded_providers(settings: DataFrame) -> DataFrame:
    """Providers of settings(owner, providers JSON, key, base, model, concurrency), in normal form: the list where it is one, else, with a key, the one provider that older settings knew.

    Returns owner and the columns of providers(). A provider without an id gets p and its place in the list.
    """
    entry = "struct<id: string, name: string, base: string, key: string, models: array<string>, concurrency: double, effort: string>"
    rows = settings.withColumn("__l", F.try_variant_get(F.try_parse_json("providers"), "$", "array<variant>"))
    listed_ = rows.where("__l is not null").select("owner", F.posexplode("__l").alias("at", "v")).select("owner", "at", F.try_variant_get("v", "$", entry).alias("p")).select("owner", "at", "p.*")
    listed_ = listed_.withColumns({"id": F.coalesce(F.nullif(F.col("id"), F.lit("")), F.concat(F.lit("p"), (F.col("at") + 1).cast("string"))), "concurrency": F.col("concurrency").cast("int")})
    some = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    old = rows.where("__l is null and key <> ''").select(
        "owner", F.lit(0).alias("at"), F.lit("p1").alias("id"), F.lit(OLD_NAME).alias("name"), some("base", OLD_BASE).alias("base"), "key", F.filter(F.array(some("model", "")), lambda m: m != "").alias("models"),
        F.when(F.coalesce("concurrency", F.lit(0)) == 0, OLD_CONCURRENCY).otherwise(F.col("concurrency")).cast("int").alias("concurrency"), F.lit("").alias("effort"),
    )
    both = listed_.unionByName(old)
    tagged = both.withColumn("id", F.struct("owner", "id"))
    return providers(tagged).select("id.owner", F.col("id.id").alias("id"), "name", "base", "key", "models", "concurrency", "effort")


def resolved_engines(ids: DataFrame, known: DataFrame) -> DataFrame:
    """Engine ids `api:<provider>:<model>` → engine_id, provider, model, config (what a cached row depends on); unknown ones go. Models may hold colons."""
    parts = ids.select("engine_id", F.regexp_extract("engine_id", r"^api:([^:]+):(.+)$", 1).alias("id"), F.regexp_extract("engine_id", r"^api:([^:]+):(.+)$", 2).alias("model")).where("model <> ''")
    config = F.concat_ws("|", "engine_id", "base", "model", F.when(F.col("effort") == "", "default").otherwise(F.col("effort")), F.substring(F.md5("key"), 1, 8))
    return parts.join(known, "id").select("engine_id", F.col("id").alias("provider"), "model", config.alias("config"))


# ---- tables in HTML --------------------------------------------------------

# The elements that stay in a table.
TABLE_TAGS = frozenset("table thead tbody tfoot tr td th caption colgroup col br sub sup b i em strong".split())


class _Table(HTMLParser):
    """The rows of the first table of a page; text of elements that do not stay counts as the cell's."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.depth, self.cell, self.done = 0, False, False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
        if self.depth and not self.done:
            if tag == "tr":
                self.rows.append([])
                self.cell = False
            elif tag in ("td", "th"):
                if not self.rows:
                    self.rows.append([])
                self.rows[-1].append("")
                self.cell = True

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.cell = False
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.done or not self.depth

    def handle_data(self, data):
        if self.depth and self.cell and not self.done:
            self.rows[-1][-1] += data


def table_cells(html: str | None) -> list[list[str]]:
    """The trimmed cells of the first table in a page; [] without one."""
    p = _Table()
    p.feed(html or "")
    p.close()
    return [[c.strip() for c in r] for r in p.rows]


@F.pandas_udf(S.CELLS_TYPE)
def html_table(pages: pd.Series) -> pd.Series:
    """table_cells() over a column."""
    return pages.map(table_cells)


def tsv(cells: Column) -> Column:
    """Cells as tab-separated lines."""
    return F.array_join(F.transform(cells, lambda r: F.array_join(r, "\t")), "\n")


class _Items(HTMLParser):
    """Headings, paragraphs and list items of a page, in order, as content items; navigation, ads and footers are skipped."""

    KINDS = {"h1": ("text", 1), "h2": ("text", 2), "h3": ("text", 3), "p": ("text", 0), "li": ("list", 0)}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.open: str | None = None
        self.text, self.aside, self.mute = "", [], 0

    def close_item(self):
        if self.open and self.text.strip():
            kind, level = self.KINDS[self.open]
            kind = self.aside[-1] if self.aside else kind
            self.items.append({"type": kind, "text": self.text.strip() if kind != "list" else None, "text_level": level or None, "list_items": [self.text.strip()] if kind == "list" else None})
        self.open, self.text = None, ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.mute += 1
        elif tag in ("nav", "header", "footer", "aside"):
            self.close_item()
            self.aside.append({"nav": "header", "aside": "aside_text"}.get(tag, tag))
        elif tag in self.KINDS:
            self.close_item()
            self.open = tag

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.mute = max(0, self.mute - 1)
        elif tag in ("nav", "header", "footer", "aside"):
            self.close_item()
            self.aside = self.aside[:-1]
        elif tag in self.KINDS:
            self.close_item()

    def handle_data(self, data):
        if self.open and not self.mute:
            self.text += data


@F.pandas_udf(S.ITEMS_TYPE)
def page_items(pages: pd.Series) -> pd.Series:
    """Content items of web pages."""

    def one(html: str | None) -> list[dict]:
        p = _Items()
        p.feed(html or "")
        p.close()
        p.close_item()
        return p.items

    return pages.map(one)


def html_content(pages: DataFrame) -> DataFrame:
    """Web pages (doc_id, html) as content items."""
    rows = pages.select("doc_id", F.posexplode(page_items("html")).alias("ord", "i"))
    empty = {c: F.lit(None).cast("array<string>") for c in ("table_caption", "table_footnote", "image_caption", "image_footnote")}
    return rows.select("doc_id", F.col("ord").cast("bigint").alias("ord"), "i.*").withColumns({"page_idx": F.lit(0), "bbox": F.lit(None).cast("array<double>"), "table_body": F.lit(None).cast("string")} | empty)


# ---- models and runs -------------------------------------------------------


def tool_models(caches_: DataFrame) -> DataFrame:
    """Model caches of tools (tool, value JSON) → tool, model, label, efforts. Of a map of entries the hidden ones go; of a list those that are not for listing."""
    v = F.try_parse_json("value")
    entry = "struct<info: struct<id: string, name: string, description: string, hidden: boolean, reasoning_efforts: array<struct<value: string, id: string>>>>"
    maps = caches_.select("tool", F.explode(F.map_values(F.try_variant_get(v, "$.models", f"map<string, {entry}>"))).alias("e"))
    maps = maps.where("e.info.id <> '' and not coalesce(e.info.hidden, false)").select(
        "tool", F.col("e.info.id").alias("model"), F.concat_ws(" · ", F.coalesce("e.info.name", "e.info.id"), "e.info.description").alias("label"), F.transform("e.info.reasoning_efforts", lambda x: F.coalesce(x["value"], x["id"])).alias("efforts")
    )
    item = "struct<slug: string, display_name: string, description: string, visibility: string, supported_reasoning_levels: array<struct<effort: string>>>"
    lists = caches_.select("tool", F.explode(F.try_variant_get(v, "$.models", f"array<{item}>")).alias("e")).where("e.slug <> '' and e.visibility = 'list'")
    lists = lists.select("tool", F.col("e.slug").alias("model"), F.concat_ws(" · ", F.coalesce("e.display_name", "e.slug"), "e.description").alias("label"), F.transform("e.supported_reasoning_levels", lambda x: x["effort"]).alias("efforts"))
    return maps.unionByName(lists)


def bench_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs kept as JSON files (blind files and files without translations give nothing): spec, seconds, requests, unit_id, en, zh."""
    kind = "spec: string, seconds: double, requests: int, translations: map<string, struct<en: string, zh: string>>"
    rows = many.json_rows(spark, path, kind).where(~F.element_at(F.split("path", "/"), -1).startswith("blind") & F.col("translations").isNotNull())
    return rows.select("spec", "seconds", "requests", F.explode("translations").alias("unit_id", "t")).select("spec", "seconds", "requests", "unit_id", "t.*")


def blind_key(spark: SparkSession, path: str) -> DataFrame:
    """A file {unit: {letter: engine}} (or of scores): unit_id, letter, value."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("unit_id", "m"))
    return rows.select("unit_id", F.explode("m").alias("letter", "value"))
