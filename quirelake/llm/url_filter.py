"""URL filters: rules, then naive Bayes over segmented hosts and path tokens.

Host names run words together. A unigram model of words, counted over the visible text of all pages, splits each
name: every substring is looked up by a join, and a Viterbi pass takes the split of highest
probability; an unknown string of n letters has the probability of 10 / (N * 10**n) of N words. The tokens of hosts and paths (runs of digits count as one token) then enter multinomial naive Bayes, learned
from all urls that a rule decides; it judges the urls that no rule fits. Urls are aggregated by host and
path shape first, so a host with a third of all pages costs no more than another one.

Cases: a null url or one without `://` has empty host and path, fits no rule, and has the prior's verdict; repeated page ids are
rows of their own; with no urls to learn from, or of one kind only, the verdict is that kind's, or allow; odds of 0 allow; of splits of equal
probability the one with the shorter last word wins; hosts, words and paths may have any length; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import ascii_lower, importable, table, written

#: Fixed values: (action, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Substrings up to this length are looked up as they are; longer words are looked up by their first SHORT letters. The result is that of looking up all.
SHORT = 24
#: Names are cut into pieces of this length (and SHORT more) before their substrings are made, so that a name of any length stays many small rows.
PIECE = 512


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; both empty for null or without `://`."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, ascii_lower(host)).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path together), as text, and its action; null where none fits."""
    text = action = F.lit(None).cast("string")
    for a, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last one to fit wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, action = F.when(fits, h + p).otherwise(text), F.when(fits, a).otherwise(action)
    return text, action


def word_counts(pages: DataFrame) -> DataFrame:
    """How often each word (of letters) stands in the visible text of all pages: (word, n)."""
    visible = F.regexp_replace(F.col("html"), r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    words = F.explode(F.split(ascii_lower(visible), r"[^\p{L}]+"))
    return pages.select(words.alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def viterbi(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The split of name into words of the highest probability; unknown pieces of any length are possible at a price by their length."""
    lengths = sorted({len(w) for w in counts})
    letter, start = log(10), log(10 / max(total, 10))
    score = {w: log(n / total) for w, n in counts.items()}
    best: list[tuple[float, int]] = [(0.0, 0)]
    unknown = (float("-inf"), 0)  # the best split that ends here in an unknown piece, and where that piece starts
    for j in range(1, len(name) + 1):
        unknown = max((unknown[0] - letter, unknown[1]), (best[-1][0] + start - letter, j - 1))  # a word is never less likely than an unknown string
        top = unknown
        for k in lengths:
            if k > j:
                break
            p = score.get(name[j - k : j])
            if p is not None:
                top = max(top, (best[j - k][0] + p, j - k))
        best.append(top)
    out, j = [], len(name)
    while j:
        i = best[j][1]
        out.append(name[i:j])
        j = i
    return out[::-1]


def _split(total: int):
    """Rows come sorted by id, the name first and then the words found in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        names, words, size = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

        for _, own in groupby(rows, key=lambda r: r[0]):
            name = next(own)[1]
            names.append(name)
            words.append(viterbi(name, {w: n for _, _, w, n in own}, total))
            size += len(name)
            if size > 1_000_000:
                yield batch()
                names, words, size = [], [], 0
        yield batch()

    return run


def segmented(names: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Names (distinct) with the words that they split into: (name, words). No list of words is broadcast: each name's substrings are joined to the counts."""
    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = names.select(F.unhex(F.sha2("name", 256)).alias("id"), "name")
    cut = keyed.select("id", F.explode(F.expr(f"transform(sequence(1, length(name), {PIECE}), s -> substring(name, s, {PIECE + SHORT - 1}))")).alias("piece"))
    parts = cut.select("id", F.explode(F.array_distinct(F.expr(
        f"flatten(transform(sequence(1, length(piece)), i -> transform(sequence(1, least({SHORT}, length(piece) - i + 1)), k -> substring(piece, i, k))))"
    ))).alias("word"))
    found = parts.join(counts.where(f"length(word) <= {SHORT}"), "word").select("id", "word", "n")
    longer = counts.where(f"length(word) > {SHORT}").selectExpr(f"substring(word, 1, {SHORT}) as start", "word as whole", "n")
    begun = parts.where(f"length(word) = {SHORT}").join(longer, F.col("word") == F.col("start")).join(keyed, "id").where("contains(name, whole)").selectExpr("id", "whole as word", "n")
    nothing = F.lit(None)
    rows = keyed.select("id", "name", nothing.cast("string").alias("word"), nothing.cast("bigint").alias("n")).unionByName(
        found.unionByName(begun).distinct().select("id", nothing.cast("string").alias("name"), "word", "n"))
    rows = rows.repartition(n, "id").sortWithinPartitions("id", F.col("name").asc_nulls_last(), "word")
    return rows.mapInArrow(_split(total), "name string, words array<string>")


def shape(path: Column) -> Column:
    """A path with each run of digits as one 0."""
    return F.regexp_replace(path, r"[0-9]+", "0")


def host_tokens(hosts: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Distinct hosts with their tokens: (host, host_tokens). Names between dots and hyphens are split into words; the place tells host tokens apart."""
    names = hosts.select("host", F.posexplode(F.split("host", r"[.\-_:0-9]+")).alias("at", "name")).where("name <> ''")
    words = segmented(names.select("name").distinct(), counts, total)
    parts = names.join(words, "name").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("parts"))
    tokens = F.expr("transform(flatten(parts.words), w -> concat('h:', w))")
    return hosts.join(parts, "host", "left").select("host", F.coalesce(tokens, F.array().cast("array<string>")).alias("host_tokens"))


def classify(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of pages(page_id, url, html): page_id, host, path, rule, verdict, words (of the host), block_odds (log-odds of naive Bayes)."""
    importable(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.select("*", rule.alias("rule"), action.alias("action"), shape(F.col("path")).alias("shape"))
    # from here on one row per host and path shape
    kinds = written(urls.groupBy("host", "shape").agg(
        F.count_if(F.col("action") == "block").alias("blocked"), F.count_if(F.col("action") == "allow").alias("permitted"), F.count("*").alias("n")
    ), "kinds")
    counts = written(word_counts(pages), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hosts = written(host_tokens(kinds.select("host").distinct(), counts, total), "hosts")
    path_tokens = F.transform(F.filter(F.split(ascii_lower("shape"), r"[^\p{L}0-9]+"), lambda t: t != ""), lambda t: F.concat(F.lit("p:"), t))
    tokens = written(kinds.join(hosts, "host").select("host", "shape", "blocked", "permitted", F.concat("host_tokens", path_tokens).alias("tokens")), "tokens")
    each = tokens.select("host", "shape", "blocked", "permitted", F.explode("tokens").alias("token"))
    seen = written(each.groupBy("token").agg(F.sum("blocked").alias("b"), F.sum("permitted").alias("a")), "seen")
    all_tokens = seen.where("a + b > 0").agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.count("*").alias("v")).first()
    prior = kinds.agg(F.coalesce(F.sum("blocked"), F.lit(0)).alias("b"), F.coalesce(F.sum("permitted"), F.lit(0)).alias("a")).first()
    if prior["a"] and prior["b"]:
        base = log(prior["b"] / prior["a"])
        weight = f"case when a + b > 0 then ln((b + 1) / {all_tokens['b'] + all_tokens['v']}D) - ln((a + 1) / {all_tokens['a'] + all_tokens['v']}D) else 0D end"
    else:
        base, weight = (1.0 if prior["b"] else -1.0), "0D"
    odds = each.join(seen.selectExpr("token", f"{weight} as w"), "token").groupBy("host", "shape").agg(F.sum("w").alias("w"))
    judged = written(tokens.select("host", "shape").join(odds, ["host", "shape"], "left").selectExpr("host", "shape", f"coalesce(w, 0D) + {base}D as block_odds"), "judged")
    out = urls.join(judged, ["host", "shape"]).join(hosts, "host")
    verdict = F.coalesce("action", F.when(F.col("block_odds") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.expr("transform(host_tokens, t -> substring(t, 3))").alias("words"), "block_odds")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """The contract's query over the whole pages table."""
    return classify(table(spark, sf_dir, "pages"))
