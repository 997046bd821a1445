"""Task folders, queues, annotations and reading positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators.geometry import rounded, sort_index

#: Files of a task folder that this side writes.
OWN_FILES = ("units.json", "TASK.md", "FIX.md", "job.json", "fix.json")


def taken(queue: DataFrame, by: list[str], budget: int = 2600) -> DataFrame:
    """Paragraphs that one round takes from a queue(by..., seq, chars): while the characters before them are under the budget; empty ones go by."""
    w = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = queue.where("chars > 0").withColumn("__b", F.coalesce(F.sum("chars").over(w), F.lit(0)))
    return rows.where(F.col("__b") < budget).drop("__b")


def prioritized(queue: DataFrame, front: DataFrame) -> DataFrame:
    """queue(doc_id, block_id, seq) with the blocks of front(doc_id, block_id) first; seq is dealt anew."""
    rows = queue.join(front.select("doc_id", "block_id", F.lit(0).alias("__p")).distinct(), ["doc_id", "block_id"], "left")
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("__p", F.lit(1)), "seq")
    return rows.withColumn("seq", (F.row_number().over(order) - 1).cast("bigint")).drop("__p")


def last_activity(files: DataFrame) -> DataFrame:
    """The latest change in each folder(folder, name, modified), leaving out files that this side writes."""
    return files.where(~F.col("name").isin(*OWN_FILES)).groupBy("folder").agg(F.max("modified").alias("last_write"), F.max(F.col("name") == "report.md").alias("report"), F.max(F.col("name") == "glossary.md").alias("glossary"))


def summary(jobs: DataFrame) -> DataFrame:
    """A queue's jobs(state, done, failed) in one row: papers, finished, sentences, failed."""
    return jobs.agg(F.count("*").alias("papers"), F.count_if(F.col("state") == "done").alias("finished"), F.coalesce(F.sum("done"), F.lit(0)).alias("sentences"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"))


def by_state(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").count()


def active_source(blocks: DataFrame, preferred: str = "mineru", base: str = "sdt") -> DataFrame:
    """Blocks(doc_id, source, ...) of the preferred source where a document has it, else of the base source."""
    has = blocks.where(F.col("source") == preferred).select("doc_id").distinct().withColumn("__has", F.lit(True))
    rows = blocks.join(has, "doc_id", "left")
    return rows.where(F.col("source") == F.when(F.col("__has"), preferred).otherwise(base)).drop("__has")


def pieces(units: DataFrame, spans: DataFrame) -> DataFrame:
    """Where units(doc_id, unit_id, start, end) stand in the base text: themselves, or by the alignment for those of the second parse (ids that start with m). doc_id, unit_id, nth, block_id, start, end."""
    second = F.col("unit_id").startswith("m")
    own = units.where(~second).select("doc_id", "unit_id", F.lit(0).alias("nth"), T.block_of(F.col("unit_id")).alias("block_id"), "start", "end")
    found = units.where(second).select("doc_id", "unit_id").join(spans.where("nth >= 0"), ["doc_id", "unit_id"])
    return own.unionByName(found.select("doc_id", "unit_id", "nth", F.col("other_block").alias("block_id"), "start", "end"))


def located(pieces_: DataFrame, boxes: DataFrame, blocks: DataFrame) -> DataFrame:
    """The place of each unit: the lines of its first piece that has any, else its block's first box. boxes(doc_id, block_id, start, lines); blocks(doc_id, block_id, rects)."""
    rows = pieces_.join(boxes.where("size(lines) > 0"), ["doc_id", "block_id", "start"], "left").join(blocks.select("doc_id", "block_id", "rects"), ["doc_id", "block_id"], "left")
    return rows.groupBy("doc_id", "unit_id").agg(F.coalesce(F.min_by("lines", F.when(F.col("lines").isNotNull(), F.col("nth"))), F.slice(F.min_by("rects", "nth"), 1, 1)).alias("place"))


def saved_position(block_id: Column, page: Column) -> Column:
    """A reading position as it is kept: the block, and its page where it has one."""
    return F.concat_ws("@", block_id, page.cast("string"))


def restored_position(positions: DataFrame, blocks: DataFrame, markers: DataFrame) -> DataFrame:
    """Positions(doc_id, position) → doc_id, block_id, page: the block if the document has it, else the start of its page, else neither. markers(doc_id, page)."""
    has = F.contains(F.col("position"), F.lit("@"))
    rows = positions.select("doc_id", F.when(has, F.regexp_extract("position", r"(?s)^(.*)@[^@]*\z", 1)).otherwise(F.col("position")).alias("b"), F.when(has, F.regexp_extract("position", r"@([^@]*)\z", 1)).alias("p"))
    rows = rows.join(blocks.select("doc_id", F.col("block_id").alias("b"), F.lit(True).alias("__own")), ["doc_id", "b"], "left")
    rows = rows.join(markers.select("doc_id", F.col("page").cast("string").alias("p"), F.col("page").alias("__page")), ["doc_id", "p"], "left")
    return rows.select("doc_id", F.when(F.col("__own"), F.col("b")).alias("block_id"), F.when(F.col("__own").isNull(), F.col("__page")).alias("page"))


def annotations(raw: DataFrame) -> DataFrame:
    """Highlights and underlines of raw(annotation_id, type, color, comment, text, page_label, position): annotation_id, kind, color, comment (null where empty), text, page_label, page, rects, next_rects.

    A position is JSON with a number pageIndex and an array rects; rows with another one are skipped. next_rects are boxes on the following page, for highlights that go on there; a page
    without a label has its number, from 1.
    """
    rows = raw.where(F.col("type").isin("highlight", "underline")).withColumn("__v", F.try_parse_json("position"))
    part = {k: F.try_variant_get("__v", f"$.{k}", "variant") for k in ("pageIndex", "rects")}
    number = F.schema_of_variant(part["pageIndex"]).rlike("^(BIGINT|DOUBLE|DECIMAL)")
    rows = rows.where(number & F.schema_of_variant(part["rects"]).startswith("ARRAY"))
    page, boxes = F.try_variant_get("__v", "$.pageIndex", "int"), "array<array<double>>"
    label = F.coalesce(F.nullif(F.col("page_label"), F.lit("")), (page + 1).cast("string"))
    return rows.select(
        "annotation_id", F.col("type").alias("kind"), "color", F.nullif(F.col("comment"), F.lit("")).alias("comment"), "text", label.alias("page_label"), page.alias("page"),
        F.try_variant_get("__v", "$.rects", boxes).alias("rects"), F.try_variant_get("__v", "$.nextPageRects", boxes).alias("next_rects"),
    )


def both_sources(base: DataFrame, second: DataFrame) -> DataFrame:
    """Blocks(doc_id, ord, block_id, ...) of both parses of documents in one space of ids: those of the second have ids that start with m. Adds source."""
    marked = second.withColumn("block_id", F.when(F.col("block_id").startswith("m"), F.col("block_id")).otherwise(F.concat(F.lit("m"), "block_id")))
    return base.withColumn("source", F.lit("sdt")).unionByName(marked.withColumn("source", F.lit("mineru")))


def expected_units(sentences: DataFrame, todo: DataFrame) -> DataFrame:
    """Of sentences(doc_id, unit_id, text, inline_math) those that a job waits for, todo(doc_id, unit_id): doc_id, unit_id, en, math."""
    rows = sentences.join(todo.select("doc_id", "unit_id"), ["doc_id", "unit_id"], "left_semi")
    return rows.select("doc_id", "unit_id", F.col("text").alias("en"), F.coalesce("inline_math", F.lit(False)).alias("math"))


def settings_put(settings: DataFrame, changes: DataFrame, key: str = "attachment") -> DataFrame:
    """Settings(key, ...) after changes(key, some of the columns): a value that is not null replaces the old one whole, and texts of white space only clear it; new keys are added."""
    columns = [c for c in settings.columns if c != key]
    given = [c for c in columns if c in changes.columns]
    new = changes.select(key, F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in given])
    both = settings.withColumn("__old", F.lit(True)).join(new, key, "full")

    def value(c: str) -> Column:
        put = F.col(f"__{c}")
        cleared = (T.strip(put) == "") if settings.schema[c].dataType.simpleString() == "string" else F.lit(False)
        return F.when(put.isNull(), F.col(c)).when(cleared, F.lit(None)).otherwise(put)

    return both.select(key, *[(value(c) if c in given else F.col(c)).alias(c) for c in columns])


def first_highlight(highlights: DataFrame) -> DataFrame:
    """The first highlight of each unit: highlights(annotation_id, nth, unit_ids, comment) → unit_id, annotation_id, comment. One shuffle of partial minima."""
    rows = highlights.select(F.explode("unit_ids").alias("unit_id"), "nth", "annotation_id", "comment")
    return rows.groupBy("unit_id").agg(F.min_by(F.struct("annotation_id", "comment"), F.struct("nth", "annotation_id")).alias("h")).select("unit_id", "h.*")


def still_busy(waiting: DataFrame, answered: DataFrame, running: bool = True) -> DataFrame:
    """Paragraphs that wait(block_id, unit_id) for answers: block_id and units left. One with none left is out; when nothing runs, all are."""
    rows = waiting if running else waiting.where("false")
    return rows.join(answered.select("unit_id"), "unit_id", "left_anti").groupBy("block_id").agg(F.count_distinct("unit_id").alias("left"))


def last_problems(problems: DataFrame, by: list[str], n: int = 3) -> DataFrame:
    """The last problems(by..., ord, problem) of each group, in order; partitions cut theirs to n before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.col("ord").desc())
    last = problems.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n)
    return last.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "problem"))), lambda x: x["problem"]), "\n").alias("problems"))


def new_annotations(requests: DataFrame, boxes: DataFrame) -> DataFrame:
    """Highlights from requests(request_id, color, comment) and their pieces' boxes(request_id, nth, text, lines, page_height, offset): one annotation a page.

    Text is that of the pieces on the page, joined by spaces; boxes are rounded; the sort index is of the first piece and the highest box.
    """
    per = boxes.select("request_id", "nth", "text", "page_height", "offset", F.explode("lines").alias("l")).withColumn("page", F.col("l.page"))
    texts = per.groupBy("request_id", "page", "nth").agg(F.first("text").alias("t"), F.first("offset").alias("o"))
    text = texts.groupBy("request_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "t"))), lambda x: T.strip(x["t"])), " ").alias("text"), F.min_by("o", "nth").alias("offset"))
    rect = F.array(*[rounded(F.col(f"l.{k}")) for k in ("x1", "y1", "x2", "y2")])
    place = per.groupBy("request_id", "page").agg(F.sort_array(F.collect_list(F.struct("nth", rect.alias("r")))).alias("rs"), F.greatest(F.lit(0), F.floor(F.first("page_height") - F.max("l.y2"))).alias("top"))
    rows = text.join(place, ["request_id", "page"]).join(requests, "request_id")
    return rows.select("request_id", "page", "color", "comment", "text", F.transform("rs", lambda x: x["r"]).alias("rects"), sort_index(F.col("page"), F.col("offset"), F.col("top")).alias("sort_index"))


def updated(annotations: DataFrame, changes: DataFrame) -> DataFrame:
    """Annotations(annotation_id, color, comment, ...) with changes(annotation_id, color, comment): nulls leave a value."""
    new = changes.select("annotation_id", F.col("color").alias("__c"), F.col("comment").alias("__m"))
    rows = annotations.join(new, "annotation_id", "left").withColumns({"color": F.coalesce("__c", "color"), "comment": F.coalesce("__m", "comment")})
    return rows.select(*annotations.columns)


def deleted(annotations: DataFrame, ids: DataFrame) -> DataFrame:
    return annotations.join(ids.select("annotation_id"), "annotation_id", "left_anti")


def span_index(spans: DataFrame) -> DataFrame:
    """Spans of each unit, in order: doc_id, unit_id, spans."""
    rows = spans.groupBy("doc_id", "unit_id").agg(F.sort_array(F.collect_list(F.struct("nth", "start", "end"))).alias("s"))
    return rows.select("doc_id", "unit_id", F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def english_view(blocks: DataFrame, sentences: DataFrame) -> DataFrame:
    """A block's text in runs: its sentences and what stands between them, or all of it without sentences: doc_id, block_id, start, unit_id (null between), run."""
    w = Window.partitionBy("doc_id", "block_id").orderBy("start")
    s = sentences.select("doc_id", "block_id", "unit_id", "start", "end").withColumns({"before": F.coalesce(F.lag("end").over(w), F.lit(0)), "last": F.lead("start").over(w).isNull()})
    rows = blocks.select("doc_id", "block_id", "text").join(s, ["doc_id", "block_id"], "left")
    size = F.length("text")
    runs = F.when(F.col("unit_id").isNull(), F.array(F.struct(F.lit(0).alias("a"), size.alias("b"), F.lit(None).cast("string").alias("u")))).otherwise(F.array(
        F.struct(F.col("before").alias("a"), F.col("start").alias("b"), F.lit(None).cast("string").alias("u")), F.struct(F.col("start").alias("a"), F.col("end").alias("b"), F.col("unit_id").alias("u")),
        F.struct(F.col("end").alias("a"), F.when(F.col("last"), size).otherwise(F.col("end")).alias("b"), F.lit(None).cast("string").alias("u")),
    ))
    out = rows.select("doc_id", "block_id", "text", F.explode(runs).alias("r")).where("r.a < r.b")
    return out.select("doc_id", "block_id", F.col("r.a").alias("start"), F.col("r.u").alias("unit_id"), F.substring(F.col("text"), F.col("r.a") + 1, F.col("r.b") - F.col("r.a")).alias("run"))


def shown_blocks(blocks: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Blocks without fragments that a rebuilt formula covers: enrichment(doc_id, block_id, covered_by)."""
    covered = enrichment.where("covered_by is not null").select("doc_id", "block_id")
    return blocks.where("kind <> 'math'").join(covered, ["doc_id", "block_id"], "left_anti").unionByName(blocks.where("kind = 'math'"))


def api_engines(providers: DataFrame) -> DataFrame:
    """Engines of providers(id, name, base, key, models), one a model: id, label, ready (with an address and a key), note."""
    rows = providers.select("id", "name", F.coalesce("base", F.lit("")).alias("base"), F.coalesce("key", F.lit("")).alias("key"), F.explode("models").alias("model"))
    ready = (F.col("base") != "") & (F.col("key") != "")
    return rows.select(F.concat(F.lit("api:"), "id", F.lit(":"), "model").alias("id"), F.concat("name", F.lit(" · "), "model").alias("label"), ready.alias("ready"), F.when(F.col("key") != "", F.col("base")).otherwise("no API key").alias("note"))


def cache_file(library: Column, key: Column) -> Column:
    return F.concat(library.cast("string"), F.lit("-"), key, F.lit(".json"))


def quoted(c: Column) -> Column:
    """A PowerShell literal."""
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def engine_spec(c: Column) -> Column:
    """`kind:model:effort` as a struct; parts that are not there are empty."""
    p = F.split(c, ":")
    return F.struct(*[F.coalesce(F.get(p, F.lit(i)), F.lit("")).alias(k) for i, k in enumerate(("kind", "model", "effort"))])


def opened_settings(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """A store's settings(attachment, glossary, position) after another's were read: a value is taken only where there is none."""
    other = theirs.select("attachment", F.col("glossary").alias("__g"), F.nullif(F.col("position"), F.lit("")).alias("__p"))
    return mine.join(other, "attachment", "left").select("attachment", F.coalesce("glossary", "__g").alias("glossary"), F.coalesce("position", "__p").alias("position"))


def blind_sheet(runs: DataFrame, picked: DataFrame, seed: int = 20261005) -> DataFrame:
    """Candidates of picked units(unit_id, ord) in an order that hides their engine: runs(engine, unit_id, en, zh) → unit_id, ord, en, letter, engine, zh."""
    rows = runs.join(picked, "unit_id")
    n = F.row_number().over(Window.partitionBy("unit_id").orderBy(F.xxhash64("engine", "unit_id", F.lit(seed)), "engine"))
    return rows.select("unit_id", "ord", "en", F.char(n + 64).alias("letter"), "engine", F.coalesce("zh", F.lit("（无译文）")).alias("zh"))


def task_text(folder: Column, todo: Column, partial: Column, math: Column, glossary: Column) -> Column:
    """Instructions for a task folder, as Markdown: what is in it, what to deliver, and what to keep as it is."""
    kept = F.concat(F.lit("Keep citation marks, numbers with units, variables and names of models and data sets as they are"), F.when(math, ", and formulas between dollar signs with those signs.").otherwise("."))
    lines = F.array(
        F.lit("# Translate a paper, sentence by sentence"), F.concat(F.lit("Folder: `"), folder, F.lit("`. Change files in it only, and leave units.json alone.")),
        F.concat(F.lit("units.json holds all sentences by section and paragraph. "), F.when(partial, F.concat(F.lit("Sentences with zh are done; "), todo.cast("string"), F.lit(" others are to do."))).otherwise(F.concat(F.lit("All "), todo.cast("string"), F.lit(" are to do.")))),
        F.lit("Write glossary.md first (lines `English = rendering`), then each finished part as a file in parts/ of the form {id: rendering}, then translations.json with every id once, and report.md last."), kept,
        F.when(T.strip(F.coalesce(glossary, F.lit(""))) != "", F.concat(F.lit("Terms that must be used:\n"), T.strip(glossary))),
    )
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n\n")


def task_folders(sections: DataFrame, root: str, started: int = 0, glossary: Column | None = None) -> DataFrame:
    """What a task folder of each document holds: sections(doc_id, section_no, heading, paragraphs) → doc_id, units, task, job, for the data source of sources.folders. Documents without a unit to do get none.

    units are all sections; the job names the units that have no rendering yet.
    """
    section = F.struct("section_no", F.struct("heading", "paragraphs").alias("s"))
    whole = sections.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(section)), lambda x: x["s"]).alias("sections"))
    units = F.flatten(F.flatten(F.transform("sections", lambda s: F.transform(s["paragraphs"], lambda p: p["units"]))))
    rows = whole.withColumn("units", units).withColumn("todo", F.transform(F.filter("units", lambda u: u["zh"].isNull()), lambda u: u["id"])).where("size(todo) > 0")
    folder = F.concat(F.lit(f"{root}/"), F.col("doc_id").cast("string"))
    math = F.exists("units", lambda u: F.contains(u["en"], F.lit("$")))
    text = task_text(folder, F.size("todo"), F.size("todo") < F.size("units"), math, F.lit(None).cast("string") if glossary is None else glossary)
    return rows.select("doc_id", F.to_json(F.struct("sections")).alias("units"), text.alias("task"), F.to_json(F.struct(F.lit(started).cast("bigint").alias("startedAt"), "todo")).alias("job"))


def merged_settings(defaults: dict, saved: dict | None, patch: dict | None = None) -> dict:
    """Settings: defaults, over them what was saved, over that a patch; values of None do not count."""
    return defaults | {k: v for part in (saved, patch) for k, v in (part or {}).items() if v is not None}


def free_id(taken_ids: list[str]) -> str:
    """The first unused `p<n>`, from the number after those in use."""
    n = len(taken_ids) + 1
    while f"p{n}" in taken_ids:
        n += 1
    return f"p{n}"
