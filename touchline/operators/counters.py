"""Counters of named batches, taken by the queries that run anyway."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def counting(spark: SparkSession) -> SparkSession:
    """A session for rows that are counted, on the same cluster."""
    return spark.newSession()


class Counters:
    """Rows, failed rows and seconds of each named batch; no second scan counts them.

    ``watched`` rows are counted when an action runs over them. A name's first action counts, as an observation has one result.
    Read the rows in a session of their own (``counting``): Spark 4.1 can't ship a model that was fitted in a session which has observed.
    """

    def __init__(self):
        self._seen: dict[str, Observation] = {}
        self._began: dict[str, float] = {}
        self._took: dict[str, float] = {}
        self._lost: dict[str, str] = {}

    def watched(self, name: str, rows: DataFrame, failed: Column | None = None, match: str | None = None) -> DataFrame:
        """``rows`` whose rows are counted, those that ``failed`` holds for, and roughly (1 percent) the different values of ``match``."""
        self._seen[name] = Observation(f"{name}-{uuid.uuid4().hex}")
        self._began[name] = time.monotonic()
        bad = F.sum(F.coalesce(failed, F.lit(False)).cast("long")) if failed is not None else F.lit(0).cast("long") * F.count(F.lit(1))
        n = F.approx_count_distinct(match, 0.01) if match else F.lit(0).cast("long") * F.count(F.lit(1))
        return rows.observe(self._seen[name], F.count(F.lit(1)).alias("events"), F.coalesce(bad, F.lit(0)).alias("failed"), n.alias("matches"))

    def run(self, name: str, action, rows: DataFrame, failed: Column | None = None, match: str | None = None) -> bool:
        """Run ``action`` over the watched rows; a failing batch is noted with its reason and doesn't end the others."""
        try:
            action(self.watched(name, rows, failed, match))
        except Exception as e:  # noqa: BLE001
            self._seen.pop(name, None)
            self._lost[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            return False
        self._took[name] = time.monotonic() - self._began[name]
        return True

    def of(self, name: str) -> dict:
        """Counters of a finished batch; waits for its action."""
        found = dict(self._seen[name].get)
        return found | {"seconds": self._took.get(name, time.monotonic() - self._began[name]), "success_rate": success_rate(found["events"], found["failed"])}

    def summary(self) -> dict:
        """Totals over the finished batches, with the share of rows that didn't fail, rows a batch and seconds a batch."""
        each = {n: self.of(n) for n in self._seen}
        events, failed, seconds = (sum(x[c] for x in each.values()) for c in ("events", "failed", "seconds"))
        n = len(each) or 1
        return {
            "completions": len(each), "failures": len(self._lost), "failure_reasons": dict(self._lost), "total_events": events, "failed_events": failed,
            "total_seconds": seconds, "events_per_batch": round(events / n, 2), "seconds_per_batch": round(seconds / n, 3), "success_rate": success_rate(events, failed),
        }


def success_rate(events: int, failed: int) -> float:
    """Percent of rows that didn't fail, two decimals; 100 without rows."""
    return round((1 - failed / events) * 100, 2) if events else 100.0
