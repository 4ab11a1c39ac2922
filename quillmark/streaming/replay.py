"""Ordered, idempotent replay of event batches into a projection's rows.

Events have event_id, checkpoint, position, document_id and payload (null deletes).
A ledger table remembers event ids; it and the rows are published in one step.  A
batch is all or nothing: an id that is twice
in the batch, or a position not after the last one of its source, fails it; events
that the ledger knows are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.sources.shared import settle
from quillmark.sources.tables import Store

EVENT = "event_id string, checkpoint string, position long, document_id string, payload string"
STATE = "document_id string, payload string, position long"


class ReplayError(ValueError):
    pass


def latest(events: DataFrame) -> DataFrame:
    """The last event of each document by position."""
    w = Window.partitionBy("document_id").orderBy(F.desc("position"), F.desc("event_id"))
    return events.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def applied(state: DataFrame, events: DataFrame) -> DataFrame:
    """State after events: their last payloads replace rows, null payloads remove them."""
    new = latest(events).select("document_id", "payload", "position")
    kept = state.join(new.select("document_id"), "document_id", "left_anti")
    return kept.select("document_id", "payload", "position").union(new.filter("payload is not null"))


class Replay:
    def __init__(self, store: Store, name: str) -> None:
        self.store, self.state, self.ledger = store, f"{name}_state", f"{name}_ledger"
        spark = store.spark
        if not store.exists(self.state):
            store.write(self.state, spark.createDataFrame([], STATE))
            store.write(self.ledger, spark.createDataFrame([], "event_id string, position long, checkpoint string, batch_id string"))

    def apply(self, events: DataFrame, batch_id: str) -> dict:
        """Applies a batch; returns the numbers of applied and passed-over events and the checkpoint."""
        events = settle(events.select("event_id", "checkpoint", "position", "document_id", "payload"))
        counts = events.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids")).first()
        if counts["n"] != counts["ids"]:
            raise ReplayError("an event is twice in the batch")
        seen = {n: self.store.generation(n) for n in (self.state, self.ledger)}
        ledger = self.store.read(self.ledger)
        new = settle(events.join(ledger.select("event_id"), "event_id", "left_anti"))
        last = ledger.agg(F.max("position")).first()[0]
        first = new.agg(F.min("position").alias("low"), F.count(F.lit(1)).alias("n")).first()
        if first["n"] and last is not None and first["low"] <= last:
            raise ReplayError(f"position {first['low']} is not after {last}")
        if first["n"]:
            state = self.store.stage(self.state, applied(self.store.read(self.state), new))
            book = ledger.union(new.select("event_id", "position", "checkpoint", F.lit(batch_id)))
            ledger_version = self.store.stage(self.ledger, book)
            old = {n: self.store.meta(n) for n in (self.state, self.ledger)}
            versions = {self.state: (state, old[self.state]["schema"]), self.ledger: (ledger_version, old[self.ledger]["schema"])}
            self.store.activate_all(versions, expected=seen)
        return {"applied": first["n"], "duplicates": counts["n"] - first["n"], "checkpoint": self.checkpoint()}

    def checkpoint(self) -> str | None:
        r = self.store.read(self.ledger).agg(F.max_by("checkpoint", "position")).first()
        return r[0]

    def lag(self, source: DataFrame) -> DataFrame:
        """How far the rows are behind a source of events: applied and last position, and the events that wait."""
        done = self.store.read(self.ledger).agg(F.max("position")).first()[0]
        waits = F.col("position") > F.lit(-1 if done is None else done)
        return source.agg(F.lit(done).cast("long").alias("applied_position"), F.max("position").alias("source_position"), F.coalesce(F.sum(waits.cast("long")), F.lit(0)).alias("waiting"), F.coalesce(~F.max(waits), F.lit(True)).alias("fresh"))

    def rows(self) -> DataFrame:
        return self.store.read(self.state)

    def stream(self, events: DataFrame, checkpoint_location: str):  # noqa: ANN201
        """A streaming query that replays each micro-batch; the ledger makes redelivery harmless."""
        write = events.writeStream.foreachBatch(lambda df, epoch: self.apply(df, f"batch-{epoch}") and None)
        return write.option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start()
