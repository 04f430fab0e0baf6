"""Briefs of tickets that arrive as a stream of JSON exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import scratch
from ..plans.briefs import Briefs
from ..sources.tickets import from_json


def start(payloads: DataFrame, id_col: str, json_col: str, to: str, checkpoint: str, levels: list[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch of complete tickets through the plan, appended to a table of records.

    A ticket is one payload, so no state is held between batches; a batch that is done again writes its own folder anew.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            tickets = from_json(batch, id_col, json_col)
            Briefs(tickets.heads, tickets.comments, levels).records.write.mode("overwrite").parquet(f"{to}/batch={batch_id}")

    query = payloads.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if available_now else query).start()
