"""Figures of a run, as a DataFrame and in the text form that monitoring systems scrape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkferry.plans.model import Result

#: Upper bounds of the histogram of tables' seconds.
BUCKETS = tuple(0.1 * 2**k for k in range(16))
SLOTS = ("schema_error", "data_error", "constraint_error", "other_error")


def metrics(results: list[Result], seconds: float) -> list[tuple[str, str, float]]:
    """(metric, label, value): tables by status, errors by kind, rows and batches by table, a histogram of seconds, and the run's."""
    out = [("tables_total", s, float(sum(r.status == s for r in results))) for s in ("ok", "failed", "constraint_failed", "skipped")]
    out += [("errors_total", s, float(sum(bool(getattr(r, s)) for r in results))) for s in SLOTS]
    out += [("rows_total", r.table, float(r.rows)) for r in results] + [("batches_total", r.table, float(r.batches)) for r in results]
    out += [("table_seconds_bucket", f"{b:g}", float(sum(r.seconds <= b for r in results))) for b in BUCKETS]
    return [*out, ("table_seconds_sum", "", float(sum(r.seconds for r in results))), ("run_seconds", "", float(seconds))]


def metrics_frame(spark: SparkSession, results: list[Result], seconds: float) -> DataFrame:
    return spark.createDataFrame(metrics(results, seconds), "metric string, label string, value double")


def exposition(results: list[Result], seconds: float) -> str:
    escape = lambda s: s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    return "".join(f'sparkferry_{m}{{label="{escape(label)}"}} {v:g}\n' if label else f"sparkferry_{m} {v:g}\n" for m, label, v in metrics(results, seconds))
