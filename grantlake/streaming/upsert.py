"""An extension beyond batch ingest: a stream of new rows merged into a stored table, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from grantlake.operators.ingest import newest
from grantlake.sources.keyed import BUCKETS, KeyedStore


def merge_into(path: str, key: str = "id", modified: str = "last_modified", ordinal: str = "ordinal", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch goes into the keyed store under ``path``, whose other buckets stay as they are; a repeated batch changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        new = newest(batch, [key], modified, ordinal).select(*batch.columns)
        KeyedStore(batch.sparkSession, path, key).upsert(new, batch=number, buckets=buckets)

    return run
