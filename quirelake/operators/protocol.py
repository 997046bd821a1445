"""Batches for a text engine, its answers, and the checks on them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T

PROMPT_VERSION = "p4"
UNIT = "struct<id:string,en:string>"


def pack(paragraphs: DataFrame, by: list[str], max_chars: int = 2600, max_units: int = 45) -> DataFrame:
    """Number the batches of paragraphs(by..., ord, chars, units): a fold that starts a new batch where a budget would be passed.

    A paragraph is never split; one beyond the budget is a batch of its own. Only three numbers of each paragraph enter the fold, which keeps
    the places where batches start; those cut the list into batches once. Returns by..., ord, batch.
    """
    rows = paragraphs.where("units > 0").groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("ord", F.col("chars").cast("bigint").alias("c"), F.col("units").cast("bigint").alias("u")))).alias("p"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit(1).alias("i"), zero.alias("c"), zero.alias("u"), F.array(F.lit(1)).alias("starts"))

    def step(a: Column, p: Column) -> Column:
        full = (a["u"] > 0) & ((a["c"] + p["c"] > max_chars) | (a["u"] + p["u"] > max_units))
        return F.struct(
            (a["i"] + 1).alias("i"), (F.when(full, 0).otherwise(a["c"]) + p["c"]).alias("c"), (F.when(full, 0).otherwise(a["u"]) + p["u"]).alias("u"),
            F.when(full, F.concat(a["starts"], F.array(a["i"]))).otherwise(a["starts"]).alias("starts"),
        )

    def batch(s: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("p") + 1)
        return F.transform(F.slice("p", s, end - s), lambda x: F.struct(x["ord"].cast("bigint").alias("ord"), k.cast("bigint").alias("batch")))

    cut = rows.withColumn("starts", F.aggregate("p", start, step, lambda a: a["starts"]))
    return cut.select(*by, F.explode(F.flatten(F.transform("starts", batch))).alias("r")).select(*by, "r.ord", "r.batch")


def wanted_batches(sentences: DataFrame, blocks: DataFrame, max_chars: int = 2600, max_units: int = 45) -> DataFrame:
    """Sentences to ask for → batches: doc_id, batch, paragraphs, ids, chars. blocks gives kind, whole text and number of units."""
    size = sentences.groupBy("doc_id", "ord").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("units"), F.sort_array(F.collect_list(F.struct("idx", F.col("unit_id").alias("id"), F.col("text").alias("en")))).alias("u"))
    numbered = pack(size, ["doc_id"], max_chars, max_units)
    units = F.transform("u", lambda x: F.struct(x["id"].alias("id"), x["en"].alias("en")))
    paragraph = F.struct("ord", "block_id", "kind", units.alias("units"), F.col("full_text"), F.col("total_units"), F.col("math"))
    rows = size.join(numbered, ["doc_id", "ord"]).join(blocks, ["doc_id", "ord"])
    out = rows.groupBy("doc_id", "batch").agg(F.sort_array(F.collect_list(paragraph)).alias("paragraphs"), F.sum("chars").alias("chars"))
    return out.withColumn("ids", F.flatten(F.transform("paragraphs", lambda p: F.transform(p["units"], lambda u: u["id"]))))


def budgeted(rows: DataFrame, by: list[str], size: Column, limit: int, whole: bool = True) -> DataFrame:
    """Rows in order until a budget: whole keeps a row while what came before is under the limit, else all rows before the first to pass it."""
    w = Window.partitionBy(*by).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = rows.withColumns({"__t": F.sum(size).over(w), "__s": size})
    return total.where(F.col("__t") - F.col("__s") < limit if whole else F.col("__t") <= limit).drop("__t", "__s")


# ---- prompts ---------------------------------------------------------------

# The wording that an engine is asked with.
RULES = (
    "You are an expert translator of scientific papers into {lang}.",
    "Write as a native {lang} academic author of the paper's own field would, following the conventions of {lang} journals in that field, so that readers do not notice it is a translation.",
    "Stay faithful: add or drop no information; keep hedging, negation and caveats exactly.",
    "Rules:",
    '1. Input is a list of paragraphs; each has sentence units with ids. A paragraph may also carry "context" (its full original text): use it to understand the units, but never translate or output it.',
    "2. Output EXACTLY one translation per unit id, in the same order. Never merge two ids, never split one id into two items, never skip or invent ids.",
    '3. A long English sentence may become several Chinese sentences, but they all stay in that id\'s "zh" string.',
    "4. Keep citation markers ([12], [3]-[5], (Zhang et al., 2021)), equation/figure/table references, numbers, units, variable names, model names and acronyms unchanged.",
    '5. Headings: translate concisely; keep numbering such as "II." or "3.1".',
    "5b. Inline LaTeX between dollar signs ($x_t$, $[1]$) is copied into the translation unchanged, dollar signs included.",
    '6. Output only JSON: {{"translations":[{{"id":"...","zh":"..."}}]}} with no commentary or code fences.',
)


def system_prompt(glossary: str = "", lang: str = "简体中文") -> str:
    """What an engine is told once."""
    lines = [r.format(lang=lang) for r in RULES]
    if glossary.strip():
        lines.append(f"Glossary (English = {lang}), use consistently:\n{glossary.strip()}")
    return "\n".join(lines)


def user_prompt(paragraphs: Column, n_ids: Column, title: Column) -> Column:
    """What an engine is asked for one batch; a paragraph's whole text goes along only where part of it is asked for."""
    part = F.transform(paragraphs, lambda p: F.struct(
        p["kind"].alias("type"), F.when(F.size(p["units"]) < p["total_units"], p["full_text"]).alias("context"), p["units"].alias("units"),
    ))
    payload = F.to_json(F.struct(F.coalesce(title, F.lit("")).alias("paper"), part.alias("paragraphs")))
    return F.concat(F.lit('Translate these units. Return {"translations":[...]} with '), n_ids.cast("string"), F.lit(" items.\n"), payload)


def combined_prompt(paragraphs: Column, n_ids: Column, title: Column, glossary: str = "", lang: str = "简体中文") -> Column:
    """Both prompts as one message, for engines that take one."""
    return F.concat(F.lit(system_prompt(glossary, lang) + "\n\nDo not use any tools; answer directly.\n\n"), user_prompt(paragraphs, n_ids, title))


def sub_batch(batches: DataFrame, ids: DataFrame) -> DataFrame:
    """Batches(batch, p: paragraphs with units(id, ...)) with the units of ids(batch, unit_id) only; paragraphs and batches that keep none go."""
    wanted = ids.groupBy("batch").agg(F.collect_set("unit_id").alias("__ids"))  # a batch has a bounded number of units
    kept = F.transform("p", lambda p: p.withField("units", F.filter(p["units"], lambda u: F.array_contains("__ids", u["id"]))))
    rows = batches.join(wanted, "batch").withColumn("p", F.filter(kept, lambda p: F.size(p["units"]) > 0))
    return rows.where(F.size("p") > 0).select(*batches.columns)


# ---- answers ---------------------------------------------------------------


def unfenced(c: Column) -> Column:
    """An answer without a code fence around it."""
    return F.regexp_replace(F.regexp_replace(T.strip(c), rf"(?i)^```(?:json)?{T.WS}*", ""), rf"```{T.WS}*\z", "")


def extracted_json(c: Column) -> Column:
    """The JSON value in an answer: all of it, or what stands in the outermost braces, or brackets; null if none parses. A VARIANT."""
    t = unfenced(c)

    def within(opening: str, closing: str) -> Column:
        a = F.instr(t, opening)
        b = F.length(t) - F.instr(F.reverse(t), closing) + 1
        return F.when((a > 0) & (F.instr(t, closing) > 0) & (b > a), F.substring(t, a, b - a + 1))

    return F.coalesce(F.try_parse_json(F.when(t != "", t)), F.try_parse_json(within("{", "}")), F.try_parse_json(within("[", "]")))


def answered(responses: DataFrame, expected: DataFrame) -> DataFrame:
    """Items of answers against what was asked: one row for each expected unit and unexpected item.

    responses(batch, response); expected(batch, unit_id, en, math). Returns batch, unit_id, zh (null unless usable), problem (null for usable and missing units). An id that comes twice is unusable.
    """
    data = extracted_json(F.col("response"))
    items = F.coalesce(F.expr("try_variant_get(d, '$.translations', 'array<variant>')"), F.expr("try_variant_get(d, '$', 'array<variant>')"))
    rows = responses.select("batch", data.alias("d")).select("batch", F.posexplode(items).alias("pos", "v"))
    rows = rows.select("batch", "pos", F.coalesce(F.expr("try_variant_get(v, '$.id', 'string')"), F.lit("")).alias("unit_id"), T.strip(F.coalesce(F.expr("if(schema_of_variant(v:zh) = 'STRING', try_variant_get(v, '$.zh', 'string'), '')"), F.lit(""))).alias("zh"))
    w = Window.partitionBy("batch", "unit_id")
    rows = rows.withColumns({"times": F.count("*").over(w), "nth": F.row_number().over(w.orderBy("pos"))}).where("nth = 1")
    both = expected.join(rows, ["batch", "unit_id"], "full_outer")
    problem = (
        F.when(F.col("en").isNull(), "unexpected id").when(F.col("times") > 1, "duplicate id")
        .when(F.col("times").isNotNull(), T.unit_problem(F.col("en"), F.col("zh"), F.coalesce("math", F.lit(False))))
    )
    return both.select("batch", "unit_id", "zh", "times", problem.alias("problem")).select("batch", "unit_id", F.when(F.col("problem").isNull(), F.col("zh")).alias("zh"), "problem")


Engine = Callable[[str], str]
ENGINES: dict[str, Engine] = {}
LIMITS: dict[str, int] = {}


def register_engine(name: str, engine: Engine, concurrency: int = 8) -> None:
    """Make an engine (prompt → answer) known by name."""
    ENGINES[name], LIMITS[name] = engine, concurrency


def unregister_engine(name: str) -> None:
    ENGINES.pop(name, None)
    LIMITS.pop(name, None)


def concurrency(name: str) -> int:
    """Requests that an engine takes at once, at least 1."""
    return max(1, LIMITS.get(name, 8))


def mock_engine(prompt: str) -> str:
    """A deterministic engine for tests: each unit's text behind a mark."""
    payload = json.loads(prompt[prompt.index("\n{") + 1 :])
    return json.dumps({"translations": [{"id": u["id"], "zh": f"【模拟译文】{u['en']}"} for p in payload["paragraphs"] for u in p["units"]]}, ensure_ascii=False)


def ask(batches: DataFrame, engine: Engine, parallel: int = 8) -> DataFrame:
    """Send each batch's prompt: batches(batch, prompt) → batch, response, error. parallel partitions bound the requests at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for b, p in zip(f["batch"], f["prompt"], strict=True):
                try:
                    out.append((b, engine(p), None))
                except Exception as e:  # an engine may fail in any way; the failure is the row's result
                    out.append((b, None, str(e)))
            yield pd.DataFrame(out, columns=["batch", "response", "error"])

    kind = batches.schema["batch"].dataType.simpleString()
    return batches.select("batch", "prompt").repartition(parallel).mapInPandas(run, f"batch {kind}, response string, error string")


def run_batches(expected: DataFrame, engine: Engine, retries: int = 2, parallel: int = 8, title: str = "") -> DataFrame:
    """Ask for units and ask again for those that came back unusable: expected(batch, unit_id, kind, en, full_text, total_units, math) → batch, unit_id, zh, attempt.

    A round is one pass of the engine over the batches that still lack units; three rounds at most, so the plan has a fixed size.
    """
    from quirelake.sources.tables import scratch

    todo, done = expected, None
    for attempt in range(retries + 1):
        paragraph = F.struct(F.lit(0).alias("ord"), F.col("kind"), F.array(F.struct(F.col("unit_id").alias("id"), "en")).alias("units"), "full_text", "total_units")
        asked = todo.groupBy("batch").agg(F.sort_array(F.collect_list(paragraph)).alias("p"), F.count("*").alias("n"))
        answers = scratch(ask(asked.select("batch", user_prompt(F.col("p"), F.col("n"), F.lit(title)).alias("prompt")), engine, parallel), "answers")
        got = scratch(answered(answers.select("batch", "response"), todo.select("batch", "unit_id", "en", "math")), "answered")
        good = got.where("zh is not null").select("batch", "unit_id", "zh", F.lit(attempt + 1).alias("attempt"))
        done = good if done is None else done.unionByName(good)
        todo = scratch(todo.join(good.select("batch", "unit_id"), ["batch", "unit_id"], "left_anti"), "todo")
        if todo.isEmpty():
            break
    lost = todo.select("batch", "unit_id", F.lit(None).cast("string").alias("zh"), F.lit(None).cast("int").alias("attempt"))
    return done.unionByName(lost)
