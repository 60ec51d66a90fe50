"""One run from the command line: settings from the environment, then from flags, which win. The exit code is the run's."""

from __future__ import annotations

import argparse
import os
import signal
import sys
import threading
import time
from collections.abc import Mapping

from pyspark.sql import SparkSession

from sparkferry.plans import log, metrics, runner, serve
from sparkferry.plans.config import Config, credentials, vault
from sparkferry.sources.stores import Store, open_store


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkferry", description=__doc__)
    p.add_argument("--direction", help="such as mysql-to-postgres")
    p.add_argument("--source", help="JDBC url or SQLite file (SRC_URL)")
    p.add_argument("--destination", help="JDBC url, SQLite file, or parquet:FOLDER (DST_URL)")
    p.add_argument("--strategy", choices=("drop_create", "alter", "none"))
    p.add_argument("--tables", help="by comma; all if left out")
    p.add_argument("--batch-size", type=int)
    p.add_argument("--workers", type=int)
    p.add_argument("--type-map")
    p.add_argument("--unfit", choices=("fail", "quarantine", "null"))
    p.add_argument("--debug", action="store_true")
    p.add_argument("--json-logs", action="store_true")
    p.add_argument("--metrics-port", type=int, help="answers /metrics, /healthz and /readyz while the run lasts")
    return p


def _store(spark: SparkSession, env: Mapping[str, str], label: str, where: str, dialect: str, config: Config, secrets: list) -> Store:
    if where.startswith("parquet:"):
        return open_store(spark, "parquet", where.removeprefix("parquet:"))
    user, password = ("", "") if dialect == "sqlite" else credentials(env, label, secrets)
    return open_store(spark, dialect, where, user, password, config.pool)


def main(arguments: list[str] | None = None, env: Mapping[str, str] | None = None, stop: threading.Event | None = None) -> int:
    env, stop = os.environ if env is None else env, stop or threading.Event()
    given = _arguments().parse_args(arguments)
    settings = dict(env) | ({"SYNC_DIRECTION": given.direction} if given.direction else {})
    config = Config.load(settings, strategy=given.strategy, batch_size=given.batch_size, workers=given.workers, type_map=given.type_map, unfit=given.unfit)
    words = tuple(v for k, v in env.items() if k.endswith(("_PASSWORD", "_TOKEN")) and len(v) > 3)
    told = log.configure(given.debug, given.json_logs, words)
    places = {label: flag or env.get(f"{label}_URL", "") for label, flag in (("SRC", given.source), ("DST", given.destination))}
    if missing := [label for label, where in places.items() if not where]:
        raise SystemExit(f"no address for {', '.join(missing)}")
    secrets = [vault(env["VAULT_ADDR"], env.get("VAULT_TOKEN", ""), {k: env.get(f"{k}_SECRET_PATH", "") for k in places}, ca=env.get("VAULT_CACERT"))] if env.get("VAULT_ADDR") else []
    if threading.current_thread() is threading.main_thread():
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: stop.set())
    spark, began, results = SparkSession.builder.appName("sparkferry").getOrCreate(), time.monotonic(), []
    server = serve.serve(given.metrics_port, lambda: metrics.exposition(results, time.monotonic() - began), lambda: not stop.is_set()) if given.metrics_port is not None else None
    try:
        source, destination = (_store(spark, env, label, places[label], dialect, config, secrets) for label, dialect in (("SRC", config.source), ("DST", config.destination)))
        for store in (source, destination):
            runner.with_retries(store.ping, config.retries, config.retry_interval, lambda s: stop.wait(s))
        results += runner.run(source, destination, config, given.tables.split(",") if given.tables else None, stop=stop)
    except Exception as e:
        told.error("run failed", extra={"error": str(e)})
        return 1
    finally:
        if server:
            server.shutdown()
    for r in results:
        print(r.table, r.status, r.rows, r.schema_error or r.data_error or r.constraint_error or r.skipped or "", sep="\t")
    return runner.exit_code(results)


if __name__ == "__main__":
    sys.exit(main())
