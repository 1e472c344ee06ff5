"""Delivery of a plan: ordered iteration, numpy batches, and an endless stream whose only state is a draw offset."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from samplery.plans.sampling import SampleConfig, batches, looped_draws, split, usable_groups, with_payload


def in_order(plan: DataFrame) -> Iterator:
    """Rows by ``draw``, fetched a partition at a time and the next one ahead."""
    return plan.orderBy("draw").toLocalIterator(prefetchPartitions=True)


class Peekable:
    """Rows in order with a look at the next one."""

    def __init__(self, plan: DataFrame) -> None:
        self.plan = plan
        self.reset()

    def reset(self) -> None:
        self._rows, self._next = in_order(self.plan), None

    def peek(self):
        if self._next is None:
            self._next = next(self._rows)
        return self._next

    def __next__(self):
        row, self._next = self.peek(), None
        return row

    def __iter__(self):
        self.reset()
        return self


def numpy_batches(plan: DataFrame, config: SampleConfig, shape: tuple[int, int, int], image: str = "image") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, images) of each batch; ``image`` holds height x width x channels numbers. All images must have the shape."""
    h, w, c = shape
    for row in batches(plan, config.batch, ("id", "label", image)).orderBy("batch").toLocalIterator(prefetchPartitions=True):
        images = np.zeros((row["rows"], h, w, c), config.dtype)
        for k, values in enumerate(row[image]):
            if values is not None:  # a missing image stays zero
                if len(values) != h * w * c:
                    raise ValueError("images of a batch must have one shape")
                images[k] = np.asarray(values).reshape(h, w, c)
        if config.colorspace == "RGB":
            images = images[..., ::-1]
        yield np.array(row["id"], np.int64), np.array(row["label"], np.float32), images.transpose(0, 3, 1, 2) if config.order == "NCHW" else images


def endless(index: DataFrame, config: SampleConfig, offset: int, draws: int) -> DataFrame:
    """Draws ``offset`` to ``offset + draws`` of the endless stream; a slice is computed alone, from the epochs and buckets that it meets, so a failed one is just computed again."""
    return looped_draws(index, config, draws, offset)


def stream_batches(ticks: DataFrame, index: DataFrame, records: DataFrame | None, config: SampleConfig, per_tick: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Structured Streaming form: every micro-batch of ``ticks`` (any stream) delivers the next ``per_tick`` draws to ``sink``.

    The micro-batch number is the offset, and Spark's checkpoint keeps it: after a restart the same batch is delivered again with the same rows.
    """
    def each(_: DataFrame, number: int) -> None:
        plan = endless(index, config, number * per_tick, per_tick)
        sink(with_payload(plan, records) if records is not None else plan, number)

    return ticks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def draw_source(spark: SparkSession) -> str:
    """Registers a streaming source whose rows are draw numbers (``draw``) and whose offset is the next one; gives its name.

    A micro-batch has ``maxDraws`` of them (1,024 unless the option says else), from the offset ``first`` on if it is the
    first one. Spark's checkpoint keeps the offset, so a restarted query goes on with the next draw, also with another
    ``maxDraws``.
    """

    class Draws(SimpleDataSourceStreamReader):
        def __init__(self, options: dict) -> None:
            self.first, self.most = int(options.get("first", 0)), int(options.get("maxdraws", options.get("maxDraws", 1024)))
            if self.first < 0 or self.most < 1:
                raise ValueError("draws count from 0, and a micro-batch has at least one")

        def initialOffset(self) -> dict:
            return {"draw": self.first}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            end = {"draw": start["draw"] + self.most}
            return self.readBetweenOffsets(start, end), end

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            return iter([(k,) for k in range(start["draw"], end["draw"])])

        def commit(self, end: dict) -> None:
            pass

    class DrawSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "samplery_draws"

        def schema(self) -> str:
            return "draw long"

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return Draws(dict(self.options))

    spark.dataSource.register(DrawSource)
    return DrawSource.name()


def stream_draws(spark: SparkSession, index: DataFrame, records: DataFrame | None, config: SampleConfig, per_trigger: int, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "0 seconds", first: int = 0) -> StreamingQuery:
    """The endless stream as a streaming query of its own: each micro-batch gives ``sink`` the rows of the next ``per_trigger`` draws, and its number.

    The only state is the draw number in Spark's checkpoint; a batch that failed is computed again from it alone.
    """
    config = usable_groups(index, config)

    def each(batch: DataFrame, number: int) -> None:
        ends = batch.agg(F.min("draw").alias("lo"), F.max("draw").alias("hi")).first()
        if ends["lo"] is not None:
            plan = looped_draws(index, config, ends["hi"] - ends["lo"] + 1, ends["lo"], True)
            sink(with_payload(plan, records) if records is not None else plan, number)

    draws = spark.readStream.format(draw_source(spark)).option("maxDraws", per_trigger).option("first", first).load()
    return draws.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def size(index: DataFrame, config: SampleConfig) -> int:
    """Rows that a pass over the stream yields."""
    return split(index, config).count()
