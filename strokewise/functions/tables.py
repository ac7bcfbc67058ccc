"""Table functions that SQL can call once they are registered."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from strokewise.operators.segments import AIM, DRAG, GRAB


class SplitRuns:
    """Rows (run, part, seq, x, y) of aims and the drags after them, from a recording's events in order.

    Called on a table with PARTITION BY and ORDER BY it sees one recording's
    rows one by one, and holds those of the run it is in; runs that have no
    drag are dropped.  Events need kind, seq, x and y.
    """

    def __init__(self) -> None:
        self.run, self.dragging, self.held, self.moved = 0, False, [], False

    def _flush(self):
        if self.moved:
            yield from ((self.run, *row) for row in self.held)
        self.run += 1
        self.held, self.moved = [], False

    def eval(self, row):
        kind = row["kind"]
        if kind in (AIM, GRAB):
            if self.dragging:
                yield from self._flush()
            self.dragging = kind == GRAB
            if kind == AIM:
                self.held.append(("aim", row["seq"], row["x"], row["y"]))
        elif kind in DRAG and self.dragging:
            self.moved = True
            self.held.append(("drag", row["seq"], row["x"], row["y"]))

    def terminate(self):
        yield from self._flush()


class RunsOf:
    """The same from one array of events, for LATERAL joins."""

    def eval(self, events):
        one = SplitRuns()
        for row in sorted(events or [], key=lambda e: (e["seq"] is not None, e["seq"] or 0)):
            yield from one.eval(row)
        yield from one.terminate()


RUN = "run: int, part: string, seq: bigint, x: double, y: double"


def register(spark: SparkSession) -> None:
    """split_runs(TABLE(events) PARTITION BY recording ORDER BY seq), and runs_of(events)."""
    spark.udtf.register("split_runs", udtf(SplitRuns, returnType=RUN))
    spark.udtf.register("runs_of", udtf(RunsOf, returnType=RUN))
