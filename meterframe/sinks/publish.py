"""All-or-nothing replacement of a Parquet table's partitions (SNK-6, SNK-13).

A batch is written to a run folder below the table (``_runs/<id>``, which
readers skip), checked, and only then published:

1. ``stage``    the partitions' new content goes to ``_runs/<id>/data``; the
                checks are counted by the very job that writes it;
2. ``mark``     ``_runs/<id>/publish.json`` lists what will be replaced; from
                here on the batch will be in the table, before it is not;
3. ``publish``  each old partition goes, the staged one takes its place;
4. the run folder goes.

A process may end anywhere. ``recover`` (called before each write and by jobs at
their start) publishes the runs that have a mark, from wherever they were left,
and drops those that have none; both steps may be repeated. A table has one
writer at a time. Readers that open a partition while it is replaced may have to
read again; a table whose ``recover`` has run holds whole batches only.

Folder names are handled on the driver, one for each partition replaced; rows
never are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from meterframe.sinks.files import Files
from meterframe.sinks.layout import for_write

RUNS = "_runs"
MARK = "publish.json"


class RejectedBatch(ValueError):
    """A batch broke a rule of the table and was not published; ``counts``: rows by rule."""

    def __init__(self, path: str, counts: dict[str, int]):
        super().__init__(f"batch for {path} rejected: " + ", ".join(f"{k}={v}" for k, v in sorted(counts.items())))
        self.path, self.counts = path, counts


class Publisher:
    """Writer of one table, partitioned by ``partitions`` (folder columns, in order)."""

    def __init__(self, spark: SparkSession, path: str, partitions: Sequence[str]):
        self.spark, self.path, self.partitions = spark, path.rstrip("/"), list(partitions)

    @property
    def files(self) -> Files:
        return Files(self.spark, self.path)

    def replace(self, rows: DataFrame, sort: Sequence[str], rules: Mapping[str, Column] | None = None,
                keep_rest: bool = True, also: Sequence[str] = ()) -> list[str]:
        """Replace the partitions that ``rows`` has (``keep_rest=False``: the whole table); returns their folders.

        ``rules`` name conditions that no row may meet; if one does, nothing is
        published and ``RejectedBatch`` tells how many. Folders in ``also`` that
        get no rows are emptied.
        """
        self.recover()
        run = f"{self.path}/{RUNS}/{uuid.uuid4().hex[:12]}"
        try:
            self.stage(rows, run, sort, rules or {})
        except BaseException:
            self.files.delete(run)
            raise
        folders = self.mark(run, keep_rest, also)
        self.publish(run)
        return folders

    def stage(self, rows: DataFrame, run: str, sort: Sequence[str], rules: Mapping[str, Column]) -> None:
        watch = Observation()
        if rules:
            # A lost executor's repeated tasks may count a row twice, never a sound batch as bad.
            rows = rows.observe(watch, *(F.count_if(cond).alias(name) for name, cond in rules.items()))
        columns = [c for c in rows.columns if c not in self.partitions] + self.partitions
        (for_write(rows.select(*columns), self.partitions, list(sort)).write.mode("overwrite")
         .option("partitionOverwriteMode", "static").partitionBy(*self.partitions).parquet(f"{run}/data"))
        # A plan without rows may be reduced to nothing, its counts with it.
        if rules and self._folders(self.files, f"{run}/data"):
            broken = {k: v for k, v in watch.get.items() if v}
            if broken:
                raise RejectedBatch(self.path, broken)

    def _folders(self, files: Files, root: str, depth: int | None = None) -> list[str]:
        depth = len(self.partitions) if depth is None else depth
        if depth == 0:
            return [""]
        column = self.partitions[len(self.partitions) - depth]
        return [f"{n}/{rest}".rstrip("/") for n in files.names(root) if n.startswith(f"{column}=")
                for rest in self._folders(files, f"{root}/{n}", depth - 1)]

    def mark(self, run: str, keep_rest: bool = True, also: Sequence[str] = ()) -> list[str]:
        files = self.files
        new = self._folders(files, f"{run}/data")
        old = set(also) if keep_rest else set(self._folders(files, self.path))
        files.write(f"{run}/{MARK}", json.dumps({"replace": new, "drop": sorted(old - set(new))}))
        return new

    def publish(self, run: str) -> None:
        """Carry out a marked run; what is done already stays done."""
        files = self.files
        plan = json.loads(files.read(f"{run}/{MARK}"))
        files.make(self.path)
        for folder in plan["drop"]:
            files.delete(f"{self.path}/{folder}")
        for folder in plan["replace"]:
            staged = f"{run}/data/{folder}"
            if files.exists(staged):  # else it was moved before the process ended
                files.delete(f"{self.path}/{folder}")
                files.move(staged, f"{self.path}/{folder}")
        files.delete(run)

    def recover(self) -> tuple[int, int]:
        """Finish or discard what an ended process left; (published, discarded) runs."""
        files, done, dropped = self.files, 0, 0
        for name in files.names(f"{self.path}/{RUNS}"):
            run = f"{self.path}/{RUNS}/{name}"
            if files.exists(f"{run}/{MARK}"):
                self.publish(run)
                done += 1
            else:
                files.delete(run)
                dropped += 1
        return done, dropped
