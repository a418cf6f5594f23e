"""Calls across files as a stream: whatever the order in which files arrive, the call table is that of a batch build.

A first stream takes extraction results apart: calls whose ends are in their own file are done, the ends of all others become requests
for a name, and symbols become offers of one. A second one keeps state by qualified name: the best offer so far (the
last definition in the order of files and places, else the first declaration) and every request. A request is answered as soon as there is an
offer, and a better offer that comes late answers all requests of its name anew; the best answer counts when the table is read.

The state is in RocksDB, so a name's requests needn't fit in memory; they are read and written in passing. Files are expected
to arrive once: changed ones go through streaming.increment, which rewrites what they touch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lattica.operators import resolve
from lattica.session import ship_package
from lattica.sources.extraction import decoded
from lattica.streaming.increment import arrivals

#: kind is `offer` (a symbol: is_definition, file, place, id) or the end of a call that asks (file, ordinal).
EVENT = "name string, kind string, file string, ordinal int, is_definition boolean, place int, id long"
ANSWER = "file string, ordinal int, end string, is_definition boolean, of_file string, place int, id long"
CALLS = "file string, ordinal int, caller string, callee string, file_path string, line int, `column` int, is_virtual boolean, is_indirect boolean"
NEAR = f"{CALLS}, caller_id long, callee_id long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Requests that are answered at once, about.
ROWS = 10_000


class Names(StatefulProcessor):
    """One qualified name: its best offer, and who asks for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "is_definition boolean, file string, place int, id long")
        # the ordinals that one batch brings of a file and end, as 32-bit integers: an element each would be pickled one by one
        self.asking = handle.getListState("asking", "file string, end string, ordinals binary")

    @staticmethod
    def _order(offer: tuple) -> tuple:
        """A key that is greatest for the best offer: definitions by the last place, declarations by the first."""
        definition, file, place, _ = offer
        return bool(definition), _Place(file, place, not definition)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.best.get() if self.best.exists() else None
        offer, new = before and tuple(before), []
        for batch in rows:
            offers = batch["kind"] == "offer"
            for r in batch[offers].itertuples(index=False):
                own = (bool(r.is_definition), r.file, int(r.place), int(r.id))
                if offer is None or self._order(own) > self._order(offer):
                    offer = own
            for (file, end), some in batch[~offers].groupby(["file", "kind"], sort=False)["ordinal"]:
                new.append((file, end, some.to_numpy("<i4").tobytes()))
        if offer is not None and (before is None or offer != tuple(before)):
            self.best.update(offer)
            if self.asking.exists():
                yield from self._answers(self.asking.get(), offer)
        if new:
            self.asking.appendList(new)
            if offer is not None:
                yield from self._answers(new, offer)

    @staticmethod
    def _answers(asked, offer: tuple) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        n = 0
        for file, end, packed in asked:
            held.append((file, end, np.frombuffer(packed, "<i4")))
            n += len(held[-1][2])
            if n >= ROWS:
                yield _frame(held, offer)
                held, n = [], 0
        if held:
            yield _frame(held, offer)

    def close(self) -> None:
        pass


class _Place:
    """A place in the order of files: by the components of the path, as bytes; or in the opposite order."""

    def __init__(self, file: str, place: int, backward: bool):
        self.key, self.backward = ([p.encode() for p in file.split("/")], place), backward

    def __eq__(self, other) -> bool:
        return self.key == other.key

    def __gt__(self, other) -> bool:
        return self.key < other.key if self.backward else self.key > other.key

    def __lt__(self, other) -> bool:
        return other > self


def _frame(asked: list[tuple], offer: tuple) -> pd.DataFrame:
    definition, of_file, place, id_ = offer
    counts = [len(ordinals) for _, _, ordinals in asked]
    found = pd.DataFrame({"file": np.repeat(np.array([f for f, _, _ in asked], object), counts), "ordinal": np.concatenate([o for _, _, o in asked]), "end": np.repeat(np.array([e for _, e, _ in asked], object), counts)})
    return found.assign(is_definition=definition, of_file=of_file, place=np.int32(place), id=id_).astype({"ordinal": "int32", "place": "int32"})


def events(symbols: DataFrame, waiting: DataFrame) -> DataFrame:
    """Offers of the symbols (resolve.deduplicated_symbols), and requests for both ends of the calls that wait."""
    null = lambda kind: F.lit(None).cast(kind)
    out = symbols.select(F.col("qualified_name").alias("name"), F.lit("offer").alias("kind"), "file", null("int").alias("ordinal"), "is_definition", "place", "id")
    for end in ("caller", "callee"):
        out = out.unionByName(waiting.select(F.col(end).alias("name"), F.lit(end).alias("kind"), "file", "ordinal", null("boolean").alias("is_definition"), null("int").alias("place"), null("long").alias("id")))
    return out.where("name IS NOT NULL")


def answered(found: DataFrame) -> DataFrame:
    """The answers to a stream (or table) of events, as they come."""
    return found.groupBy("name").transformWithStateInPandas(statefulProcessor=Names(), outputStructType=ANSWER, outputMode="Append", timeMode="None")


def _taken_apart(root: str):
    """For each batch of arrivals: its calls and events as folders that appear whole, once."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        results = decoded(batch.where("json IS NOT NULL").select("file", "part", "json"))
        symbols = resolve.deduplicated_symbols(resolve.raw_symbols(results))
        calls = resolve.calls_in_file(results, resolve.names_in_file(symbols))
        for name, df in (("near", calls.calls), ("waiting", calls.unresolved), ("events", events(symbols, calls.unresolved))):
            part = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/.{name}-{number}-{uuid.uuid4().hex}")
            whole = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/batch-{number}")
            fs = part.getFileSystem(spark._jsc.hadoopConfiguration())
            if fs.exists(whole):  # a batch that is run again
                continue
            df.write.parquet(part.toString())
            fs.mkdirs(whole.getParent())
            fs.rename(part, whole)

    return write


def extracted(spark: SparkSession, folder: str, root: str, files_a_batch: int = 1000) -> StreamingQuery:
    """The first stream, over all that has arrived in the folder."""
    ship_package(spark)
    found = arrivals(spark, folder, files_a_batch).drop("arrived").where("NOT coalesce(deleted, false)")
    return found.writeStream.option("checkpointLocation", f"{root}/checkpoint-files").trigger(availableNow=True).foreachBatch(_taken_apart(root)).start()


def resolved(spark: SparkSession, root: str, batches: int = 100) -> StreamingQuery:
    """The second stream, over all events of the first."""
    ship_package(spark)
    spark.conf.set(PROVIDER, ROCKSDB)
    found = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", batches).parquet(f"{root}/events/*")
    return answered(found).writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint-names").option("path", f"{root}/answers").trigger(availableNow=True).start()


def run(spark: SparkSession, folder: str, root: str, files_a_batch: int = 1000, batches: int = 100) -> None:
    """Both streams over what has arrived; to be called again for what arrives later."""
    extracted(spark, folder, root, files_a_batch).awaitTermination()
    resolved(spark, root, batches).awaitTermination()


def call_table(spark: SparkSession, root: str) -> DataFrame:
    """file, ordinal, caller, callee, .., caller_id, callee_id of all calls that are answered so far."""
    order = F.struct(resolve.file_order(F.col("of_file")).alias("f"), F.col("place").alias("p"))
    offer = F.struct(order.alias("o"), F.col("id").alias("id"))
    definition, declaration = F.max(F.when(F.col("is_definition"), offer)), F.min(F.when(~F.col("is_definition"), offer))
    best = spark.read.schema(ANSWER).parquet(f"{root}/answers").groupBy("file", "ordinal", "end").agg(F.coalesce(definition["id"], declaration["id"]).alias("id"))
    ends = best.groupBy("file", "ordinal").agg(*(F.max(F.when(F.col("end") == e, F.col("id"))).alias(f"{e}_id") for e in ("caller", "callee")))
    near = spark.read.schema(NEAR).parquet(f"{root}/near/*")
    waiting = spark.read.schema(CALLS).parquet(f"{root}/waiting/*")
    across = waiting.join(ends.where("caller_id IS NOT NULL AND callee_id IS NOT NULL"), ["file", "ordinal"])
    return near.unionByName(across)
