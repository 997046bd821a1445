"""The store of renderings: conflict policies, sibling links and glossaries.

Three policies live side by side: newest wins (between stores), existing wins (batch tool), later file wins (task folder).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T

META = ("zh", "engine", "prompt", "glossary", "t")


def newest_wins(mine: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key: of two, the one with the greater t, mine on a tie. One aggregation with map-side combining."""
    cols = mine.columns
    both = mine.withColumn("__own", F.lit(1)).unionByName(theirs.withColumn("__own", F.lit(0)))
    order = F.struct(F.coalesce("t", F.lit(0)).alias("t"), "__own")
    rest = [c for c in cols if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest]).select(*cols)


def existing_wins(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All existing rows and the new ones whose key is not there yet."""
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def later_file_wins(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Delivered entries files(file, pos, unit_id, zh) of expected units (unit_id, en, math): the last entry in order of (file, pos). Returns unit_id, zh, problem."""
    last = files.join(expected.select("unit_id"), "unit_id", "left_semi").groupBy("unit_id").agg(F.max_by("zh", F.struct("file", "pos")).alias("zh"))
    rows = last.withColumn("zh", T.strip(F.col("zh"))).join(expected, "unit_id")
    return rows.select("unit_id", "zh", T.unit_problem(F.col("en"), F.col("zh"), F.coalesce("math", F.lit(False))).alias("problem"))


def grouped(sentences: DataFrame) -> DataFrame:
    """Distinct hashes of groups with at least two: doc_id, loose_key, hash."""
    keyed = sentences.withColumn("loose_key", T.loose_key(F.col("text"))).where("loose_key is not null").select("doc_id", "loose_key", "hash").distinct()
    more = keyed.groupBy("doc_id", "loose_key").count().where("count > 1").drop("count")
    return keyed.join(more, ["doc_id", "loose_key"])


def put(store: DataFrame, new: DataFrame, groups: DataFrame) -> DataFrame:
    """New rows overwrite their hash and all hashes of its group: store(hash, META), new(hash, META), groups(grp, hash)."""
    spread = new.join(groups, "hash").withColumnRenamed("hash", "__from").join(groups.withColumnRenamed("hash", "hash"), "grp").select("hash", *META)
    rows = new.select("hash", *META).unionByName(spread).groupBy("hash").agg(F.max_by(F.struct(*META), "t").alias("r")).select("hash", "r.*")
    return existing_wins(rows, store.select("hash", *META), ["hash"])


def removed(store: DataFrame, hashes: DataFrame, groups: DataFrame) -> DataFrame:
    """The store without hashes and all hashes of their groups."""
    spread = hashes.join(groups, "hash").select("grp").distinct().join(groups, "grp").select("hash")
    return store.join(hashes.select("hash").unionByName(spread).distinct(), "hash", "left_anti")


def cleared(store: DataFrame, active: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """No rows; given the sentences(hash) of the source on screen and the groups of all, the rows that they leave."""
    return store.where("false") if active is None else removed(store, active.select("hash").distinct(), groups)


def edited(store: DataFrame, edits: DataFrame) -> DataFrame:
    """Hand edits(hash, zh, t): trimmed, non-empty ones overwrite, with `manual` as their engine."""
    rows = edits.withColumn("zh", T.strip(F.col("zh"))).where("zh <> ''").select("hash", "zh", F.lit("manual").alias("engine"), F.lit("p4").alias("prompt"), F.lit("").alias("glossary"), "t")
    return existing_wins(rows, store.select("hash", *META), ["hash"])


def rendered(sentences: DataFrame, store: DataFrame, groups: DataFrame) -> DataFrame:
    """Sentences with their rendering: their own row of the store, else that of the least hash of their group that has one. Adds zh."""
    have = store.select("hash", "zh")
    other = groups.join(have, "hash").groupBy("grp").agg(F.min_by("zh", "hash").alias("__z"))
    fallback = groups.join(other, "grp").select("hash", "__z")
    return sentences.join(have, "hash", "left").join(fallback, "hash", "left").withColumn("zh", F.coalesce("zh", "__z")).drop("__z")


def glossary_tag(glossary: Column) -> Column:
    """What a row keeps of the glossary it was made with."""
    g = T.strip(glossary)
    return F.when(g == "", "").otherwise(F.substring(F.md5(g), 1, 8))


def glossary_lines(c: Column) -> Column:
    """The lines of a glossary that hold a term."""
    return F.filter(F.transform(F.split(c, r"\r?\n"), T.strip), lambda x: x.contains("="))


def merged_glossary(user: Column, paper: Column) -> Column:
    """The user's lines, then the paper's whose term the user has not set."""

    def term(x: Column) -> Column:
        return F.lower(T.strip(F.split(x, "=")[0]))

    own = glossary_lines(user)
    taken = F.transform(own, term)
    return F.array_join(F.concat(own, F.filter(glossary_lines(paper), lambda x: ~F.array_contains(taken, term(x)))), "\n")


def parsed_glossary(answer: Column, most: int = 60) -> Column:
    """`English = rendering` lines of an engine's answer: at most 60 terms with both sides; empty for any other answer."""
    from quirelake.operators.protocol import unfenced

    t = unfenced(answer)
    a, b = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    inner = F.when((a > 0) & F.contains(t, F.lit("}")) & (b > a), F.substring(t, a, b - a + 1))
    data = F.coalesce(F.try_parse_json(F.when(t != "", t)), F.try_parse_json(inner))
    terms = F.try_variant_get(data, "$.terms", "array<struct<en:variant,zh:variant>>")

    def side(x: Column) -> Column:
        return T.strip(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(""))

    pairs = F.filter(F.transform(F.coalesce(terms, F.array().cast("array<struct<en:variant,zh:variant>>")), lambda x: F.struct(F.coalesce(side(x["en"]), F.lit("")).alias("e"), F.coalesce(side(x["zh"]), F.lit("")).alias("z"))), lambda p: (p["e"] != "") & (p["z"] != ""))
    return F.array_join(F.transform(F.slice(pairs, 1, most), lambda p: F.concat(p["e"], F.lit(" = "), p["z"])), "\n")
