"""Linking a stream of queries against a standing table of targets."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kinlink.operators import decide
from kinlink.plans.link import LinkConfig, link_prepared, normalised, target_cells
from kinlink.plans.store import fresh, scratch, written


def start(queries: DataFrame, targets: DataFrame, path: str, checkpoint: str, config: LinkConfig = LinkConfig(), trigger: dict | None = None, fitted=None):
    """Writes the match lists of every micro-batch of queries (a streaming DataFrame of entities) under path.

    Targets are normalised and keyed once and stay as tables in the shared folder; a batch's own tables go when its
    lists are written. A query's matches depend on no other query, so batches give what one run over all queries gives.
    Each batch writes a folder of its own by batch id and overwrites it when it is run again, so a repeated batch is
    harmless.
    """
    two = written(normalised(targets), "targets")
    index = target_cells(two, config, fresh(two.sparkSession, "index"))

    def batch(rows: DataFrame, number: int) -> None:
        with scratch(rows.sparkSession):
            _, matches = link_prepared(rows, two, index, config, fitted)
            decide.lists(rows, matches).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
