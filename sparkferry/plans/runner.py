"""A whole run: list, order, and sync each table with bounded concurrency, a deadline, retries, and a result for each.

The driver only submits Spark jobs and, to a database, statements; rows go from store to store (a SQLite file, which has one
writer, gets them through the driver, a partition at a time). Tables of one dependency level run at once, so that a table is
loaded after those that it references.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkferry.functions.types import BUILT_IN, TypeMap
from sparkferry.operators import coerce, merge, validate
from sparkferry.plans import graph
from sparkferry.plans.config import Config
from sparkferry.plans.log import logger
from sparkferry.plans.model import Result, Table, exit_code
from sparkferry.plans.schema_diff import Plan, plan
from sparkferry.sources.stores import Store, with_retries

Clock = Callable[[], float]
log = logger("run")
#: Seconds between a table's reports of progress.
PROGRESS = 10.0


class Late(TimeoutError):
    """A table's deadline has passed."""


class Cancelled(RuntimeError):
    """The run was told to stop."""


class Unfit(ValueError):
    """Rows have values that the destination's types can't hold."""


@contextmanager
def jobs_of(spark: SparkSession, name: str, seconds: float, stop: threading.Event):
    """Spark jobs that this thread starts within are one group; it is cancelled when the time is over or `stop` is set. Gives the group's name."""
    context, group, over = spark.sparkContext, f"sparkferry-{name}-{uuid.uuid4().hex[:8]}", threading.Event()

    def watch() -> None:
        ends, tell = time.monotonic() + seconds, time.monotonic() + PROGRESS
        while not over.wait(0.2):
            if stop.is_set() or time.monotonic() > ends:
                context.cancelJobGroup(group)
            elif time.monotonic() > tell:
                tell += PROGRESS
                share = progress(spark, group)
                log.info("progress", extra={"table": name, "percent": None if share is None else round(100 * share, 1)})

    context.setJobGroup(group, f"sync of {name}", interruptOnCancel=True)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield group
    finally:
        over.set()
        watcher.join()
        for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(k, None)


def progress(spark: SparkSession, group: str) -> float | None:
    """The share of the tasks of a group's running stages that are done; None where none runs."""
    tracker = spark.sparkContext.statusTracker()
    stages = [x for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) and info.status == "RUNNING" for x in map(tracker.getStageInfo, info.stageIds) if x]
    total = sum(x.numTasks for x in stages)
    return sum(x.numCompletedTasks for x in stages) / total if total else None


def sync_table(source: Store, destination: Store, spec: Table, config: Config, sleep=time.sleep, clock: Clock = time.monotonic, stop: threading.Event | None = None, types: TypeMap = BUILT_IN) -> tuple[Result, Plan | None]:
    """One table: its schema changes, its rows, and then its indexes and constraints, each only if what is before it went well.

    Returns the result and the plan, whose deferred statements wait for all tables. A retry begins with the rows again.
    """
    out, began, todo = Result(spec.name), clock(), None
    stop = stop or threading.Event()

    def in_time() -> None:
        if stop.is_set():
            raise Cancelled(f"{spec.name}: the run was cancelled")
        if clock() - began > config.table_timeout:
            raise Late(f"{spec.name}: more than {config.table_timeout:g} s")

    def told(e: Exception) -> str:
        try:
            in_time()  # a cancelled job fails in Spark's words; the reason says more
        except (Cancelled, Late) as reason:
            return str(reason)
        return str(e)

    log.info("table begins", extra={"table": spec.name})
    with jobs_of(source.spark, spec.name, config.table_timeout, stop):
        try:
            have = destination.describe(spec.name)
            todo = plan(spec, have, config.destination, config.strategy, config.compat, types)
            out.statements = [s.sql for s in todo.statements]
            in_time()
            if destination.executes:
                destination.execute(todo.before)
        except Exception as e:
            out.schema_error, out.skipped = told(e), "schema"
        if not out.schema_error:
            try:
                with_retries(lambda: _load(source, destination, spec, have, config, out, in_time, types), config.retries, config.retry_interval, sleep)
            except Exception as e:
                out.data_error = told(e)
            else:
                out.constraint_error = _constrained(destination, spec, todo, config, in_time, told)
    out.seconds = clock() - began
    log.log(20 if out.status == "ok" else 30, "table ends", extra={"table": spec.name, "status": out.status, "rows": out.rows, "unfit": out.unfit, "seconds": round(out.seconds, 3), "error": out.schema_error or out.data_error or out.constraint_error})
    return out, todo


def _constrained(destination: Store, spec: Table, todo: Plan, config: Config, in_time, told) -> str | None:
    try:
        in_time()
        if destination.executes:
            destination.execute(todo.later)
            return None
        return "; ".join(violated(destination, spec)) or None if config.validate else None
    except Exception as e:
        return told(e)


def _load(source: Store, destination: Store, spec: Table, have: Table | None, config: Config, out: Result, in_time, types: TypeMap) -> None:
    in_time()
    rows = source.read(spec.name)
    want = {c.name: c.mapped or c.type for c in _mapped(spec, config, types).columns}
    generated = [c.name for c in spec.columns if c.generated is not None] if destination.executes else []
    if rows.isEmpty() and have is not None and config.strategy != "drop_create":
        out.rows = out.batches = 0
        return
    if config.unfit != "null" and coerce.may_lose(rows, want, config.destination):
        lost = coerce.unfit(rows, want, config.destination)
        out.unfit = lost.count()
        if out.unfit and config.unfit == "fail":
            raise Unfit(f"{out.unfit} rows of {spec.name} have values that {config.destination} can't hold")
        if out.unfit:
            destination.save(f"{spec.name}__unfit", lost, [], None, replace=True)
            rows = coerce.fit(rows, want, config.destination)
    rows = coerce.coerce(rows, want, config.destination).drop(*generated)
    replace = config.strategy == "drop_create" or have is None
    key = (have or spec).key or spec.key
    if key and not replace:
        newest = [F.col(f"`{c.strip()}`") for c in config.newest.split(",") if c.strip() in rows.columns]
        rows = merge.latest(rows, key, [*newest, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])])
    if not destination.executes and not replace and config.strategy == "alter":
        key = _reshaped(destination, spec.name, rows, key)
    in_time()
    out.rows = destination.save(spec.name, rows, key, have if not replace or destination.executes else None, replace)
    out.batches = -(-out.rows // config.batch_size)


def _reshaped(destination: Store, name: str, rows: DataFrame, key: list[str]) -> list[str]:
    """A Parquet table gets the columns of the rows: it is written anew, by what it has of them, before it is merged into."""
    old, kept = destination.read(name), {f.name: f.dataType for f in rows.schema.fields}
    if {f.name: f.dataType for f in old.schema.fields} != kept:
        there = set(old.columns)
        destination.write(name, old.select(*[(F.col(f"`{c}`").try_cast(t) if c in there else F.lit(None).cast(t)).alias(c) for c, t in kept.items()]))
    return key


def _mapped(spec: Table, config: Config, types: TypeMap) -> Table:
    from sparkferry.plans.ddl import mapped

    return mapped(spec, config.destination, config.compat, types)


def violated(store: Store, spec: Table) -> list[str]:
    """The constraints that a loaded table breaks, each with how often. Each is a job of its own, over its own columns."""
    df, out = store.read(spec.name), []
    if spec.key and (n := validate.duplicates(df, spec.key).count()):
        out.append(f"primary key: {n} keys repeat")
    for r in validate.nulls(df, [c.name for c in spec.columns if not c.nullable and c.name in df.columns] or df.columns[:0]).collect() if any(not c.nullable for c in spec.columns) else []:
        out.append(f"not null {r['column']}: {r['n']} rows")
    for c in spec.constraints:
        if c.kind == "UNIQUE" and (n := validate.duplicates(df, list(c.columns), nulls_match=False).count()):
            out.append(f"{c.name}: {n} keys repeat")
        elif c.kind == "CHECK" and (n := validate.violations(df, c.definition).count()):
            out.append(f"{c.name}: {n} rows")
        elif c.kind == "FOREIGN KEY" and (c.to_table == spec.name or c.to_table in store.tables()) and (n := validate.orphans(df, list(c.columns), store.read(c.to_table), list(c.to_columns)).count()):
            out.append(f"{c.name}: {n} rows without {c.to_table}")
    return out


def run(source: Store, destination: Store, config: Config, tables: list[str] | None = None, sleep=time.sleep, clock: Clock = time.monotonic, stop: threading.Event | None = None) -> list[Result]:
    """A result for each table, by name. A failure stops no other table, unless skip_failed_tables is off under `alter` or
    `drop_create` dependencies: then tables that come after a failed level are skipped (compat: never). Setting `stop` cancels
    the running tables' jobs; tables that haven't begun are marked as skipped, with an error. Deferred foreign keys are added
    when all tables are loaded; where that fails, the table's result has it as a constraint error.
    """
    stop = stop or threading.Event()
    types = TypeMap.load(config.type_map) if config.type_map else BUILT_IN
    names = source.tables() if tables is None else sorted(tables)
    specs = {n: s for n in names if (s := source.describe(n)) is not None}
    results = {n: Result(n, skipped="no such table") for n in names if n not in specs}
    plans: dict[str, Plan] = {}
    edges = graph.edges_of(specs.values())
    rounds = graph.levels(list(specs), edges) if config.strategy != "none" and len(specs) > 1 else [sorted(specs)]
    failed, done = False, 0
    if destination.executes and config.strategy == "drop_create":  # references go before what they refer to is dropped
        _dropped(destination, [n for level in reversed(rounds) for n in level], config)

    def one(name: str) -> tuple[Result, Plan | None]:
        if stop.is_set():
            return Result(name, skipped="cancelled before it began", data_error="the run was cancelled"), None
        return sync_table(source, destination, specs[name], config, sleep, clock, stop, types)

    for level in rounds:
        if failed and not stop.is_set() and not config.skip_failed_tables and not config.compat:
            results |= {n: Result(n, skipped="a table before it failed") for n in level}
            continue
        with ThreadPoolExecutor(max_workers=config.workers) as pool:
            for r, todo in pool.map(one, level):
                results[r.table], done = r, done + 1
                failed = failed or r.status == "failed"
                if todo is not None and r.status == "ok":
                    plans[r.table] = todo
                log.info("progress", extra={"done": done, "of": len(specs), "percent": round(100 * done / max(1, len(specs)), 1)})
    if destination.executes:
        for name, todo in plans.items():
            try:
                destination.execute(todo.deferred)
            except Exception as e:
                results[name].constraint_error = str(e)
    return [results[n] for n in sorted(results)]


def _dropped(destination: Store, names: list[str], config: Config) -> None:
    """Tables that hold references are dropped before those that they refer to; each table's own plan then drops what is left. A failure shows there."""
    from sparkferry.plans.ddl import drop_table

    there = set(destination.tables())
    for name in names:
        if name in there:
            try:
                destination.execute([drop_table(name, config.destination)])
            except Exception as e:
                log.warning("drop failed", extra={"table": name, "error": str(e)})


def results_frame(spark: SparkSession, results: list[Result]) -> DataFrame:
    rows = [(r.table, r.status, r.schema_error, r.data_error, r.constraint_error, r.other_error, r.skipped, r.rows, r.batches, r.unfit, float(r.seconds)) for r in results]
    return spark.createDataFrame(rows, "`table` string, status string, schema_error string, data_error string, constraint_error string, other_error string, skipped string, rows long, batches long, unfit long, seconds double")


def exit_code_frame(results: DataFrame) -> DataFrame:
    """The exit code of a table of results with `status`."""
    has = lambda s: F.coalesce(F.max(F.col("status") == s), F.lit(False))
    only = F.coalesce(F.min(F.col("status") == "skipped"), F.lit(False))
    return results.agg(F.when(has("failed"), 1).when(has("constraint_failed"), 2).when(only, 3).otherwise(0).alias("exit_code"))


__all__ = ["exit_code", "exit_code_frame", "progress", "results_frame", "run", "sync_table", "violated"]
