"""Run analytics as one composition over request logs, manifests and
process snapshots of all runs (no per-run loop)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from larkspur.operators import runs


@dataclass
class RunAnalytics:
    summaries: DataFrame      # A1-A3 per run
    consolidated: DataFrame   # J11 (+ A4)
    ranked: DataFrame         # T1
    top3: DataFrame           # T2
    percentiles: DataFrame    # U3


def run_analytics(log: DataFrame, manifests: DataFrame, rss: DataFrame | None,
                  run_key: str = "full_run_id") -> RunAnalytics:
    """log(full_run_id, timestamp, success, latency_ms) -> every analytics table."""
    s = runs.latency_summary(log, [run_key])
    c = runs.consolidate_runs(s, manifests, rss, run_key)
    return RunAnalytics(s, c, runs.sort_by_throughput(c), runs.top_throughput(c, 3),
                        runs.unpivot_percentiles(c, ["run_id"]))


def scorer_char_stats():
    """A built-in plug-in scorer for M6: characters and blank-separated words."""
    import pandas as pd

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf["text"].fillna("")
        return pd.DataFrame({"doc_id": pdf["doc_id"], "n_chars": t.str.len().astype("int64"),
                             "n_words": t.str.split(" ").str.len().astype("int64")})
    return score
