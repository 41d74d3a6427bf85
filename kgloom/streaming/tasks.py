"""Requests as a stream: each task handled once, failures apart, and event-time windows with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REQUEST = "taskId string, taskType string, payload string, timestamp timestamp"
RESULT = "task_id string, task_type string, status string, result string"
Handler = Callable[[DataFrame], DataFrame]


def read_requests(spark: SparkSession, folder: str, files_at_once: int = 10) -> DataFrame:
    """Task envelopes (JSON lines) that arrive in ``folder``; ``files_at_once`` bounds a micro batch."""
    raw = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_at_once).json(folder)
    return raw.select(F.col("taskId").alias("task_id"), F.col("taskType").alias("task_type"), "payload", "timestamp")


def once(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each task id once, though it may be sent again within ``late``."""
    return requests.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["task_id"])


def dispatch(requests: DataFrame, handlers: dict[str, Handler], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Runs each task type's handler over the batch's tasks and writes task_id, task_type, status and result under ``out``.

    A handler takes task_id and payload and returns task_id and result. If it fails, its tasks are answered with the error.
    Unknown types are dropped. A batch overwrites its own folder, so a batch that is run again leaves no second answer.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for kind, handler in handlers.items():
                tasks = batch.where(F.col("task_type") == kind)
                path = f"{out}/batch={number}/task_type={kind}"
                try:
                    done = handler(tasks.select("task_id", "payload"))
                    done.select("task_id", F.lit("done").alias("status"), F.col("result").cast("string").alias("result")).write.mode("overwrite").parquet(path)
                except Exception as e:  # noqa: BLE001 - the error is the answer
                    tasks.select("task_id", F.lit("failed").alias("status"), F.lit(f"{type(e).__name__}: {e}"[:500]).alias("result")).write.mode("overwrite").parquet(path)
        finally:
            batch.unpersist()

    writer = requests.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime="10 seconds").start()


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """start, ``by``, n and total of tumbling or sliding windows over ts; events later than ``late`` no longer count."""
    frame = F.window("ts", length, slide) if slide else F.window("ts", length)
    got = events.withWatermark("ts", late).groupBy(frame.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start and n of each user's sessions, which a pause of ``gap`` ends."""
    got = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return got.select("user_id", F.col("w.start").alias("start"), "n")


def running_assignment(items: DataFrame, least: float = 0.6):
    """item, cluster and size as items come in: each user's items join the nearest of the user's cluster centres, or start one.

    ``items`` has user_id, item and vector. A user's centres are the state; items of one user are taken in order, those of
    different users in parallel. The state of a user grows with the clusters, not with the items.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        import json

        import numpy as np
        import pandas as pd

        centres = [(np.array(c), n) for c, n in json.loads(state.get[0])] if state.exists else []
        out = []
        for frame in frames:
            for item, vector in zip(frame["item"], frame["vector"]):
                v = np.asarray(vector, float)
                length = np.linalg.norm(v)
                v = v / length if length > 0 else v
                scores = [float(c @ v / (np.linalg.norm(c) or 1.0)) for c, _ in centres]
                at = int(np.argmax(scores)) if scores and max(scores) >= least else len(centres)
                if at == len(centres):
                    centres.append((v, 1))
                else:
                    c, n = centres[at]
                    centres[at] = ((c * n + v) / (n + 1), n + 1)
                out.append((key[0], item, at, centres[at][1]))
        state.update((json.dumps([(c.tolist(), n) for c, n in centres]),))
        yield pd.DataFrame(out, columns=["user_id", "item", "cluster", "size"])

    return items.groupBy("user_id").applyInPandasWithState(step, "user_id string, item string, cluster int, size int", "centres string", "append", GroupStateTimeout.NoTimeout)
