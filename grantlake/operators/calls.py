"""Calls of an outside service for what isn't known yet: batches in tasks, waits between tries, a stored ledger.

A payload is known by the hash of its text; each is called once, whatever rows have it. What the ledger
has isn't called again. The rest goes in waves: a wave's tasks each call batches of at most ``BATCH`` payloads and
write the answers as their output, then the ledger takes them. A task that has ended has its output in
the shared store, so a lost executor repeats the unfinished task alone, and a lost driver at most one wave.

A call that is told to wait (``Busy``) or that fails is tried again after waits that double each time, with
jitter, so that tasks don't come back together. When the tries are used up the answer is null: the row
goes on without it, the ledger doesn't have it, and the next run asks again. An answer list of another
length than the batch is a failure.

Defined cases: null and blank payloads aren't called and have a null answer; rows that repeat an id or payload get
the same answer each; extra columns stay. An empty table makes no call.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.sources.keyed import KeyedStore
from grantlake.sources.shared import discard, shared_folder

BATCH = 100
TRIES = 5
FIRST_WAIT, MOST_WAIT = 1.0, 60.0
WAVE = 10_000  # payloads of a wave
TASK = 500  # payloads of a task
Service = Callable[[list[str]], list[str | None]]
LEDGER = "payload_hash string, answer string"


class Busy(Exception):
    """The service asks to wait: ``seconds``, if it says how long."""

    def __init__(self, seconds: float | None = None) -> None:
        super().__init__(seconds)
        self.seconds = seconds


def payload_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def waits(tries: int = TRIES, first: float = FIRST_WAIT, most: float = MOST_WAIT, draw: Callable[[], float] = random.random) -> Iterator[float]:
    """The wait before each further try: doubled each time, up to ``most``, between half and all of it."""
    for k in range(tries - 1):
        yield min(most, first * 2**k) * (0.5 + draw() / 2)


def called(service: Service, batch: list[str], tries: int = TRIES, first: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> list[str | None]:
    """The answers of a batch; nulls where no try has given them."""
    for wait in [*waits(tries, first), None]:
        least = 0.0
        try:
            answers = service(batch)
            if len(answers) == len(batch):
                return answers
        except Busy as told:
            least = told.seconds or 0.0
        except Exception:  # noqa: BLE001, S110  what fails is tried again, then goes on without an answer
            pass
        if wait is not None:
            sleep(max(wait, least))
    return [None] * len(batch)


def answered(rows: DataFrame, payload: str, service: Service, ledger: KeyedStore, batch: int = BATCH, tries: int = TRIES, first_wait: float = FIRST_WAIT, wave: int = WAVE, task: int = TASK) -> DataFrame:
    """Rows with ``answer``: what the service gave for their payload, now or earlier. ``service`` runs in tasks and takes a list of payloads."""
    spark = rows.sparkSession
    own = rows.withColumn("_hash", F.when(F.trim(payload) != "", payload_hash(F.col(payload))))

    def known() -> DataFrame:
        return ledger.read() if ledger.versions() else spark.createDataFrame([], LEDGER)

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                some = part[at : at + batch]
                yield pd.DataFrame({"payload_hash": some["_hash"], "answer": called(service, some["payload"].tolist(), tries, first_wait)})

    new = own.filter("_hash IS NOT NULL").groupBy("_hash").agg(F.first(payload).alias("payload"))
    todo = shared_folder(spark)
    new.join(known(), F.col("_hash") == F.col("payload_hash"), "left_anti").write.parquet(todo)
    open_ = spark.read.schema("_hash string, payload string").parquet(todo)
    n = open_.count()
    waves = -(-n // wave)
    for k in range(waves):
        of_wave = open_.filter(F.pmod(F.xxhash64("_hash"), F.lit(waves)) == k)
        path = shared_folder(spark)
        tasks = max(1, -(-min(n, wave) // task))
        of_wave.repartition(tasks, F.xxhash64(F.lit("task"), "_hash")).mapInPandas(call, LEDGER).filter("answer IS NOT NULL").write.parquet(path)
        ledger.upsert(spark.read.schema(LEDGER).parquet(path))
        discard(spark, path)
    discard(spark, todo)
    found = known().select(F.col("payload_hash").alias("_known"), "answer")
    return own.join(found, F.col("_hash") == F.col("_known"), "left").drop("_hash", "_known")
