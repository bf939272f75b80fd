"""Live capture: a stream of states into a recording, micro-batch by micro-batch.

Each batch is a flush: its chunks are sealed and described together. Iterations must rise; a late row fails the query
instead of being dropped, so there is no watermark. A journal beside the recording's metadata says which batch is under
way and how far the batches before it came. So the guard holds after a restart too, and a batch that runs again after a
failure finds its rows recorded and passes over them.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kymo.errors import StorageError
from kymo.functions.strict_json import pretty
from kymo.sources.writer import RecordingWriter, replace_synced

JOURNAL = ".capture.json"


class RecordingSink:
    def __init__(self, writer: RecordingWriter, kinds: dict[str, str] | None = None):
        self.writer, self.kinds = writer, kinds
        self.path = writer.root / JOURNAL
        #: batch: the last one begun; done: whether it ended; seen: the last iteration of the batches before it, or with it once done.
        self.journal = json.loads(self.path.read_bytes()) if self.path.exists() else {"batch": -1, "done": True, "seen": None}
        if not self.path.exists():
            ends = [s.last for s in writer.streams if s.last is not None]
            self.journal["seen"] = max(ends, default=None)

    def _write(self, **changes) -> None:
        self.journal |= changes
        replace_synced(self.path, pretty(self.journal))

    def __call__(self, states: DataFrame, batch: int) -> None:
        """For ``foreachBatch``."""
        if batch < self.journal["batch"] or batch == self.journal["batch"] and self.journal["done"]:
            return
        again = batch == self.journal["batch"]
        ends = states.agg(F.min("iteration").alias("a"), F.max("iteration").alias("b"), F.count(F.lit(1)).alias("n"), F.count_distinct("iteration").alias("d")).first()
        seen = self.journal["seen"]
        if ends["n"]:
            if ends["n"] != ends["d"] or seen is not None and ends["a"] <= seen:
                raise StorageError("out_of_order_iteration", f"a batch begins at {ends['a']} after {seen}", previous=seen)
            self._write(batch=batch, done=False)
            self.writer.record(states, self.kinds, late="pass" if again else "raise")
            seen = int(ends["b"])
        self._write(batch=batch, done=True, seen=seen)


def capture(states: DataFrame, writer: RecordingWriter, checkpoint: str, kinds: dict[str, str] | None = None) -> StreamingQuery:
    """Start the capture of a streaming DataFrame with iteration, physical_time and fields."""
    return states.writeStream.foreachBatch(RecordingSink(writer, kinds)).option("checkpointLocation", checkpoint).start()
