"""Answers of a model provider: each prompt is sent once, whatever is computed from the answers and however often."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import prompt
from ..storage import exists, open_store
from .contracts import output_schema

ANSWERS = "asked string, raw string"


def _journal(path: str) -> str:
    return f"{path.rstrip('/')}/journal"


def _call(path: str, provider: Callable[[str, dict], str], schema: dict, at_once: int):
    """Worker function: each answer is a small file as soon as it comes, so that what a lost task had asked isn't asked again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, folder = open_store(_journal(path))

        def answer(asked: str, text: str) -> str:
            name = f"{folder}/{asked[:2]}/{asked}.json"
            if store.get_file_info(name).type == fs.FileType.File:
                with store.open_input_file(name) as f:
                    return json.loads(f.read())
            raw = provider(text, schema)
            draft = f"{folder}/{asked[:2]}/.{asked}.{uuid.uuid4().hex}"
            store.create_dir(f"{folder}/{asked[:2]}", recursive=True)
            with store.open_output_stream(draft) as f:
                f.write(json.dumps(raw).encode())
            store.move(draft, name)
            return raw

        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                for at in range(0, len(b), 10 * at_once):
                    part = b.iloc[at : at + 10 * at_once]
                    yield pd.DataFrame({"asked": part["asked"], "raw": list(pool.map(answer, part["asked"], part["prompt"]))})

    return run


def answers(spark: SparkSession, path: str) -> DataFrame:
    """``asked, raw``: what has been answered, ``asked`` the sha256 of the prompt."""
    table = f"{path.rstrip('/')}/answers"
    return spark.read.schema(ANSWERS).parquet(table) if exists(spark, table) else spark.createDataFrame([], ANSWERS)


def ask_once(materials: DataFrame, provider: Callable[[str, dict], str], path: str, tasks: int = 8, at_once: int = 4) -> DataFrame:
    """``materials`` with their ``prompt`` and the provider's ``raw`` JSON.

    ``provider(prompt, response_schema)`` is called on executors, in ``tasks`` tasks of ``at_once`` threads each: no more
    calls are open at a time. Only prompts without an answer in the table ``path``/answers are sent; equal prompts, which
    repeated rows have, are one. An answer is journalled before the next is asked for, so tasks that are run again and
    runs that are started again go on where the others ended; just a call that was open when its worker died is repeated.
    All calls are made before this returns; what is computed from the result calls nothing. One job at a time a path, no
    speculative tasks. An error of the provider fails the run and keeps what was answered."""
    spark = materials.sparkSession
    rows = materials.withColumn("prompt", prompt()).withColumn("asked", F.sha2("prompt", 256))
    open_ = rows.select("asked", "prompt").dropDuplicates(["asked"]).join(answers(spark, path).select("asked"), "asked", "left_anti")
    new = open_.repartition(tasks, "asked").mapInPandas(_call(path, provider, output_schema(), at_once), ANSWERS)
    new.write.mode("append").parquet(f"{path.rstrip('/')}/answers")
    store, folder = open_store(_journal(path))
    if store.get_file_info(folder).type.name == "Directory":
        store.delete_dir(folder)
    return rows.join(answers(spark, path), "asked").drop("asked")
