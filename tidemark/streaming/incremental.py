"""New S1 records as a stream, matched with a gallery that stands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import BlockingConfig
from tidemark.functions.text import normalize_source
from tidemark.operators.blocking import capped, generate_candidates, key_columns, key_table


def key_candidates(stream: DataFrame, gallery: DataFrame, config: BlockingConfig = BlockingConfig(), scripts: str = "latin") -> DataFrame:
    """A stream-static join on blocking keys, without state: raw S1 rows to country, s1, g, leg."""
    keys = [k for k in key_columns() if k[0] != 32]
    g = capped(key_table(gallery, keys), config).select("country", "leg", "key", F.col("entity_id").alias("g"))
    return key_table(normalize_source(stream, scripts), keys).join(g, ["country", "leg", "key"]).select("country", F.col("entity_id").alias("s1"), "g", "leg")


def run_batches(stream: DataFrame, gallery: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, config: BlockingConfig = BlockingConfig(), scripts: str = "latin") -> StreamingQuery:
    """The whole candidate plan on each micro-batch; sink gets its candidates and its number, and is to overwrite by number so that a
    repeated batch has no effect."""
    def each(batch: DataFrame, number: int) -> None:
        sink(generate_candidates(normalize_source(batch, scripts), gallery, config=config), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
