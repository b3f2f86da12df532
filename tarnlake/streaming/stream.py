"""Streams of records into collections, and how long a validated index may be trusted."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnlake.operators.collections import Collection, newest_per_key
from tarnlake.operators.filters import METADATA

RECORD_FILES = f"id string, text string, metadata {METADATA}, seq long"


def upsert_stream(source: DataFrame, collection: Collection, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Puts a stream of records (id, text, metadata, seq) into a collection, a generation for each batch.

    Of records with one id in a batch the one with the highest seq counts. A batch that is run again changes nothing:
    texts that are there already aren't embedded, and ids stay. Blank ids and texts are left out.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.trim("id").alias("record_key"), "text", "metadata", "seq").where("record_key <> '' and trim(text) <> ''")
        rows = newest_per_key(rows, F.struct("seq", "text")).drop("seq")
        if not rows.isEmpty():
            collection.upsert_frame(rows)

    writer = source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def record_files(spark: SparkSession, path: str, schema: str = RECORD_FILES, per_batch: int = 100) -> DataFrame:
    """JSON-lines files that appear in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(path)


@dataclass
class _Mark:
    version: int
    at: float
    uses: int = 0


class Freshness:
    """Whether an index validated a moment ago can be used without looking at the files again.

    A mark holds for `seconds` and `uses` uses, and until an event says that something below its root has changed. What
    was validated while an event came doesn't count. The least recently used of more than `most` marks are dropped.
    """

    def __init__(self, seconds: float = 5.0, uses: int = 32, most: int = 128, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.uses, self.most, self.clock = seconds, uses, most, clock
        self._versions: dict[str, int] = {}
        self._marks: OrderedDict[tuple[str, str], _Mark] = OrderedDict()
        self._lock = threading.Lock()

    def begin(self, root: str) -> int:
        """A token to hand to finish()."""
        with self._lock:
            return self._versions.setdefault(root, 0)

    def finish(self, root: str, key: str, token: int) -> bool:
        """False if something has changed since begin(): what was validated is stale."""
        with self._lock:
            if self._versions.setdefault(root, 0) != token:
                return False
            self._marks[root, key] = _Mark(token, self.clock())
            self._marks.move_to_end((root, key))
            while len(self._marks) > self.most:
                self._marks.popitem(last=False)
            return True

    def fresh(self, root: str, key: str) -> bool:
        with self._lock:
            mark = self._marks.get((root, key))
            if mark is None:
                return False
            if mark.version != self._versions.get(root, 0) or self.clock() - mark.at >= self.seconds or mark.uses >= self.uses:
                del self._marks[root, key]
                return False
            mark.uses += 1
            self._marks.move_to_end((root, key))
            return True

    def changed(self, root: str) -> None:
        with self._lock:
            self._versions[root] = self._versions.get(root, 0) + 1
            for k in [k for k in self._marks if k[0] == root]:
                del self._marks[k]
