"""Arrow-batch plumbing of the operators that need per-text Python code."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from redactry.sources.tables import spread


#: Longer strings (unbroken runs of letters, encoded data) are computed each time: they hardly repeat and would fill a memo.
LONGEST_KEY = 64


class Memo(dict):
    """Memo of a pure function, bounded in entries and in the length of their keys; emptied when full."""

    def __init__(self, fn: Callable, limit: int = 200_000, longest: int = LONGEST_KEY):
        super().__init__()
        self.fn, self.limit, self.longest = fn, limit, longest

    def __missing__(self, key):
        if isinstance(key, (str, bytes)) and len(key) > self.longest:
            return self.fn(key)
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``make()`` once per Python task and its result on every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if out is not None:
                    yield out

    return spread(df).mapInArrow(run, schema)
