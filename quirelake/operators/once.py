"""Requests that are made once: a glossary for each document before its first batch, and the self test of an engine.

Before a document is asked for, its claim is made in a folder that all executors share, by a step that fails where the claim is there. A task that runs again, or twice at a time, finds the claim and does not ask;
it gives the kept answer, or none where the first attempt was lost before it had one. Claims belong to a run (an opening of the documents): the next run asks again for what has no glossary.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators.protocol import ENGINES, Engine, answered, user_prompt
from quirelake.operators.store import parsed_glossary
from quirelake.sources.folders import opened

#: What the self test asks for.
TEST_SENTENCE = "The proposed method improves accuracy by 3.2% on the test set [7]."


def claimed(store: pafs.FileSystem, path: str) -> bool:
    """Make a claim; False where it is there. Local stores create the file exclusively; elsewhere a rename must not overwrite (as in HDFS)."""
    if isinstance(store, pafs.LocalFileSystem):
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    if store.get_file_info(path).type != pafs.FileType.NotFound:
        return False
    own = f"{path}-{uuid.uuid4().hex}"
    with store.open_output_stream(own, compression=None):
        pass
    try:
        store.move(own, path)
    except OSError:
        store.delete_file(own)
        return False
    return True


def ask_once(prompts: DataFrame, engine: Engine, folder: str, parallel: int = 8) -> DataFrame:
    """prompts(doc_id, prompt) → doc_id, response, error, asked (whether this attempt asked). Each document is asked once for a folder, however often tasks run."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(folder)
        for f in frames:
            out = []
            for d, p in zip(f["doc_id"], f["prompt"], strict=True):
                name = hashlib.sha256(str(d).encode()).hexdigest()
                at = f"{root}/{name[:2]}"
                store.create_dir(at)
                if claimed(store, f"{at}/{name}.claim"):
                    try:
                        response, error = engine(p), None
                    except Exception as e:  # an engine may fail in any way; a document without a glossary is no failure of the job
                        response, error = None, str(e)
                    if response is not None:
                        with store.open_output_stream(f"{at}/{name}.half", compression=None) as half:
                            half.write(response.encode())
                        store.move(f"{at}/{name}.half", f"{at}/{name}.answer")
                    out.append((d, response, error, True))
                elif store.get_file_info(f"{at}/{name}.answer").type == pafs.FileType.File:
                    with store.open_input_stream(f"{at}/{name}.answer", compression=None) as kept:
                        out.append((d, kept.read().decode(), None, False))
                else:
                    out.append((d, None, "asked before, without an answer", False))
            yield pd.DataFrame(out, columns=["doc_id", "response", "error", "asked"])

    kind = prompts.schema["doc_id"].dataType.simpleString()
    return prompts.select("doc_id", "prompt").repartition(parallel).mapInPandas(run, f"doc_id {kind}, response string, error string, asked boolean")


def glossary_prompt(title: Column, text: Column, chars: int = 6000) -> Column:
    """Asks for the terms of a document, from its start: the answer is JSON, {"terms": [{"en", "zh"}]}."""
    ask = F.lit('List the key terms of this paper with their renderings, as JSON {"terms": [{"en": "...", "zh": "..."}]} and nothing else.\n\nTitle: ')
    return F.concat(ask, F.coalesce(title, F.lit("")), F.lit("\n\n"), F.substring(F.coalesce(text, F.lit("")), 1, chars))


def glossaries_once(documents: DataFrame, stored: DataFrame, engine: Engine, folder: str, parallel: int = 8) -> DataFrame:
    """One attempt for each of documents(doc_id, prompt) without a glossary in stored(doc_id, glossary): doc_id, glossary (null where there is none to keep), error, asked. An answer without terms is not kept."""
    lacking = documents.join(stored.where("glossary <> ''").select("doc_id"), "doc_id", "left_anti")
    got = ask_once(lacking, engine, folder, parallel)
    return got.select("doc_id", F.nullif(parsed_glossary(F.coalesce("response", F.lit(""))), F.lit("")).alias("glossary"), "error", "asked")


def self_test(spark: SparkSession, names: list[str]) -> DataFrame:
    """Each engine's answer to one fixed sentence, without retries: engine, zh, problem (null where the answer can be used)."""
    engines = {n: ENGINES[n] for n in names if n in ENGINES}
    unit = F.struct(F.lit("t:0").alias("id"), F.lit(TEST_SENTENCE).alias("en"))
    paragraph = F.struct(F.lit(0).alias("ord"), F.lit("paragraph").alias("kind"), F.array(unit).alias("units"), F.lit(TEST_SENTENCE).alias("full_text"), F.lit(1).alias("total_units"))
    rows = spark.createDataFrame([(n,) for n in names], "batch string").select("batch", user_prompt(F.array(paragraph), F.lit(1), F.lit("")).alias("prompt"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for n, p in zip(f["batch"], f["prompt"], strict=True):
                try:
                    out.append((n, engines[n](p), None))
                except KeyError:
                    out.append((n, None, "no such engine"))
                except Exception as e:  # shown to whoever tests the engine
                    out.append((n, None, str(e)))
            yield pd.DataFrame(out, columns=["batch", "response", "error"])

    told = rows.repartition(max(1, len(names))).mapInPandas(run, "batch string, response string, error string")
    units = told.select("batch", F.lit("t:0").alias("unit_id"), F.lit(TEST_SENTENCE).alias("en"), F.lit(False).alias("math"))
    judged = answered(told.select("batch", F.coalesce("response", F.lit("")).alias("response")), units)
    return told.join(judged, "batch").select(F.col("batch").alias("engine"), "zh", F.coalesce("error", "problem").alias("problem"))
