"""Live rows: follow logs, label lines as a load does, flag addresses as they come, append to the store, tell subscribers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weirlog.operators import pools
from weirlog.progress import Progress  # noqa: F401
from weirlog.sources import json_log
from weirlog.sources.files import Files
from weirlog.sources.geo import locate
from weirlog.sources.store import LogStore
from weirlog.sources.tail import TailSource
from weirlog.streaming.hub import Hub


def last_offset(spark: SparkSession, checkpoint: str) -> str:
    """The last offset that a query with one source has planned to read up to, by its checkpoint; '' without one."""
    files = Files(spark)
    numbers = sorted(int(n) for n in files.names(f"{checkpoint}/offsets") if n.isdigit())
    return files.read(f"{checkpoint}/offsets/{numbers[-1]}").split("\n")[2] if numbers else ""


def tail(spark: SparkSession, paths: list[str], checkpoint: str | None = None, from_start: bool = False, start_bytes: dict[str, int] | None = None, max_bytes: int = 64 << 20) -> DataFrame:
    """Normalised events of lines as they are appended to files; seq orders lines as they came. With the query's
    checkpoint a restart keeps to max_bytes from its first batch on."""
    spark.dataSource.register(TailSource)
    options = {"paths": json.dumps(paths), "fromStart": str(from_start).lower(), "startBytes": json.dumps(start_bytes or {}), "maxBytes": max_bytes, "resume": last_offset(spark, checkpoint) if checkpoint else ""}
    lines = spark.readStream.format("tail").options(**options).load()
    return json_log.parsed(lines.withColumnRenamed("arrival", "seq"), ["seq"])


class Flags(StatefulProcessor):
    """Flagged addresses as state by address: written once, when an address attacks; read for rows of their own address only.

    Addresses known before are flagged from their first row on, others from their first attack on. Rows that came before
    that stay in their pool here; the store, which derives pools from all rows, moves them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flag = handle.getValueState("flag", "reason string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self.flag.update((str(initialState["reason"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, first = (self.flag.get()[0], -1) if self.flag.exists() else (None, None)
        parts: Iterator[pd.DataFrame] | list[pd.DataFrame] = rows
        if known is None:
            parts = list(rows)  # an address's rows of one batch, whose bytes are limited
            hits = [x.loc[x["attack"].notna() & (x["is_local"] == 0), ["seq", "attack"]] for x in parts]
            found = pd.concat(hits).sort_values("seq") if hits else None
            if found is not None and len(found):
                first, known = int(found["seq"].iloc[0]), str(found["attack"].iloc[0])
                self.flag.update((known,))
        for x in parts:
            reason = pd.Series("", x.index, dtype=object)
            if known is not None:
                public = x["is_local"] == 0
                reason[public & (x["seq"] == first)] = known
                reason[public & (x["seq"] > first)] = f"ip_flag:{known}"
            pool = reason.where(reason == "", "malicious").mask(reason == "", x["is_static"].map({1: "static", 0: "dynamic"}))
            yield x.assign(malicious_reason=reason, pool=pool)

    def close(self) -> None:
        pass


PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def flagged_live(labelled: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """A stream of labelled rows with pool and malicious_reason as they are on arrival; flagged(ip, reason) are known from the start."""
    labelled.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    schema = T.StructType([*labelled.schema.fields, T.StructField("malicious_reason", T.StringType()), T.StructField("pool", T.StringType())])
    known = flagged.groupBy("ip") if flagged is not None else None
    return labelled.groupBy("ip").transformWithStateInPandas(Flags(), schema, "Append", "None", known)


def follow(
    store: LogStore, paths: list[str], checkpoint: str, callback: Callable[[DataFrame], None] | None = None, hub: Hub | None = None, from_start: bool = False,
    start_bytes: dict[str, int] | None = None, max_bytes: int = 64 << 20, compact_after: int = 0, once: bool = False,
) -> StreamingQuery:
    """Follows files: each batch is appended to the store, once however often Spark repeats it, and rows that aren't static
    go to the callback and the hub, classified once for all. The flagged addresses of the store are known from the start.

    compact_after: deltas after which the store is compacted, 0 for never. once: goes up to the end of the files and stops.
    """
    spark, stream = store.spark, hashlib.sha256(checkpoint.encode()).hexdigest()[:24]
    events = tail(spark, paths, checkpoint, from_start, start_bytes, max_bytes)
    labels, geo = {k: v for k, v in store.labels.items() if k != "geo"}, store.labels.get("geo")
    routed = flagged_live(pools.label(events, **labels), store.flags())

    def batch(rows: DataFrame, number: int) -> None:
        rows = (rows if geo is None else locate(rows.drop("country", "city"), geo)).persist()  # places by batch, as addresses are looked up once each
        try:
            rows.count()  # all of it once, as state counts only then, also where the store has the batch already
            store.ingest(rows, stream, number)
            shown = rows.where(F.col("is_static") == 0)
            if callback is not None:
                callback(shown)
            if hub is not None:
                hub.publish(shown)
        finally:
            rows.unpersist()
        if compact_after and len(store.manifest.latest()[1]["delta"]) >= compact_after:
            store.compact()

    query = routed.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).start()
    if once:
        query.processAllAvailable()
        query.stop()
    return query
