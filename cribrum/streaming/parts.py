"""Parts that a stream writes: shards of micro-batches, roll-ups by rows, and a manifest that says what counts.

Readers go by the manifest alone.  It is written under a new name and renamed
into place, so a reader or a restart sees the state before a commit or after it;
whatever else lies in the folder is left over from a failed try, and is removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import first_failure

#: Manifests kept: the one in force and those that a slow reader may still hold.
KEPT = 3


@dataclass
class State:
    """What has been committed: the last micro-batch, its counters so far, shards not yet rolled up, roll-ups, the final table.

    Shards and roll-ups are {path, raw, rows}: rows read for them, and rows that
    survived.  Where there is a final table, it holds the rows of all roll-ups, which only remain as a log.
    """

    version: int = 0
    batch: int = -1
    counters: dict[str, int] = field(default_factory=dict)
    shards: list[dict] = field(default_factory=list)
    rollups: list[dict] = field(default_factory=list)
    final: dict | None = None

    def listed(self) -> set[str]:
        return {x["path"] for x in ([self.final] if self.final else [*self.shards, *self.rollups])}


class Parts:
    """The folder ``target``: ``manifest``, and the data in ``data``, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.target}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.target}/{name}"), True)

    def state(self) -> State:
        """The state of the newest manifest; a new one where there is none."""
        names = [n for n in self._names("manifest") if n.endswith(".json")]
        if not names:
            return State()
        stream = self._fs.open(self._path(f"{self.target}/manifest/{names[-1]}"))
        try:
            return State(**json.loads(self._io.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def commit(self, state: State) -> None:
        """Make ``state`` the one in force; it fails if another writer has committed since it was read."""
        state.version += 1
        new = self._path(f"{self.target}/manifest/{state.version:012d}.json")
        draft = self._path(f"{self.target}/manifest/draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        try:
            stream.write(bytearray(json.dumps(asdict(state)).encode()))
        finally:
            stream.close()
        if self._fs.exists(new) or not self._fs.rename(draft, new):
            raise RuntimeError(f"another writer has committed version {state.version} of {self.target}")
        for name in [n for n in self._names("manifest") if n.endswith(".json")][:-KEPT]:
            self._delete(f"manifest/{name}")

    def stale(self) -> list[str]:
        """Folders of data, and drafts of manifests, that the manifest doesn't list."""
        listed = self.state().listed()
        return [f"data/{n}" for n in self._names("data") if n not in listed] + [f"manifest/{n}" for n in self._names("manifest") if n.startswith("draft-")]

    def sweep(self) -> None:
        """Remove what is stale; only the one writer may."""
        for name in self.stale():
            self._delete(name)

    def clear(self, *folders: str) -> None:
        """Start afresh: everything goes, and ``folders`` (such as a stream's checkpoint) with it."""
        self._fs.delete(self._path(self.target), True)
        for folder in folders:
            self._fs.delete(self._path(folder), True)

    def read(self, entries: list[dict], schema: T.StructType | str) -> DataFrame:
        """The rows of some shards or roll-ups."""
        paths = [f"{self.target}/data/{x['path']}" for x in entries]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self, schema: T.StructType | str) -> DataFrame:
        """All committed rows: of the final table if there is one, else of roll-ups and shards."""
        now = self.state()
        return self.read([now.final] if now.final else [*now.rollups, *now.shards], schema)

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.target}/data/{name}")
        return name

    def roll_up(self, state: State) -> None:
        """The open shards become one roll-up; ``state`` is changed, not committed."""
        if not state.shards:
            return
        paths = [f"{self.target}/data/{x['path']}" for x in state.shards]
        name = self._write(self.spark.read.parquet(*paths), "rollup")
        state.rollups.append({"path": name, "shards": len(paths), **{c: sum(x[c] for x in state.shards) for c in ("raw", "rows")}})
        state.shards = []

    def finish(self, files: int, *folders: str) -> State:
        """A clean end: the last shards are rolled up, the roll-ups become one table of ``files`` files, and the rest goes.

        The rows of the table are counted against those of the roll-ups before it counts.
        """
        state = self.state()
        if state.final is None:
            self.roll_up(state)
            if state.rollups:
                name = self._write(self.spark.read.parquet(*[f"{self.target}/data/{x['path']}" for x in state.rollups]).repartition(files), "final")
                rows, have = sum(x["rows"] for x in state.rollups), self.spark.read.parquet(f"{self.target}/data/{name}").count()
                if rows != have:
                    raise RuntimeError(f"{have} rows in the final table, {rows} in its roll-ups")
                state.final = {"path": name, "raw": sum(x["raw"] for x in state.rollups), "rows": rows}
            self.commit(state)
        self.sweep()
        for folder in folders:
            self._fs.delete(self._path(folder), True)
        return state


def run_to_parts(
    stream: DataFrame, steps: list[tuple[str, Column]], target: str, checkpoint: str, every: int, fresh: bool = False, before_commit: Callable[[int], None] | None = None
) -> State:
    """Run a funnel over a stream until no file is left; survivors go to shards, and these to roll-ups of at least ``every`` rows read.

    A micro-batch whose number is committed is not written again, and one that was
    stopped before its commit leaves nothing that counts: after a stop at any point
    the next run goes on exactly.  Rows read and survivors come from the job that
    writes the shard.  The counters cover all micro-batches since the fresh start.
    After a clean end (``Parts.finish``) only a fresh start goes on.
    ``before_commit`` is called between the writing of a shard and its commit.
    """
    parts = Parts(stream.sparkSession, target)
    if fresh:
        parts.clear(checkpoint)
    if parts.state().final:
        raise ValueError(f"{target} is finished; start afresh")
    parts.sweep()

    def write(batch: DataFrame, number: int) -> None:
        state = parts.state()
        if number <= state.batch:
            return
        seen = Observation()
        tagged = batch.withColumn("_why", first_failure(steps))
        counted = [F.count(F.lit(1)).alias("raw"), *[F.count_if(F.col("_why") == name).alias(f"fail_{name}") for name, _ in steps], F.count_if(F.col("_why") == "out").alias("out")]
        name = parts._write(tagged.observe(seen, *counted).where("_why = 'out'").drop("_why"), "shard")
        counts = seen.get
        state.batch = number
        state.counters = {c: state.counters.get(c, 0) + n for c, n in counts.items()}
        state.shards.append({"path": name, "raw": counts["raw"], "rows": counts["out"]})
        if sum(x["raw"] for x in state.shards) >= every:
            parts.roll_up(state)
        if before_commit:
            before_commit(number)
        parts.commit(state)
        parts.sweep()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return parts.state()
