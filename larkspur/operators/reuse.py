"""R2 (batch), J8, J9, A10: answer reuse.

* ``lookup_or_compute`` splits requests into hits (semi join against a
  materialised result table keyed by fingerprint) and misses (anti join),
  computes each distinct missing key once and merges both sides.
* ``reuse_within_ttl`` replays a keyed time-to-live cache over ordered
  arrivals: a repeat within TTL of the key's last *miss* is a hit, a hit
  does not renew the entry, and a gap strictly above TTL is a miss.  It is a
  streaming fold over key-partitioned sorted rows (see ``batching``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.batching import sorted_by_key


def compute_once_per_key(df: DataFrame, key: str,
                         compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``compute`` on one row per distinct key, join the result back."""
    firsts = df.dropDuplicates([key])
    return df.join(compute(firsts).drop(*[c for c in df.columns if c != key]), key, "left")


def lookup_or_compute(requests: DataFrame, store: DataFrame, key: str,
                      compute: Callable[[DataFrame], DataFrame],
                      value_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """J8 -> (results with ``origin`` hit/miss, new store rows to append).

    Hits come from the store (semi/regular join on key); misses are computed
    once per distinct key (J9); the store side is de-duplicated per key.
    """
    st = store.select(key, *value_cols).dropDuplicates([key])
    hits = requests.join(st, key, "inner").withColumn("origin", F.lit("hit"))
    misses = requests.join(st.select(key), key, "left_anti")
    fresh = compute(misses.dropDuplicates([key]).select(key, *[c for c in misses.columns
                                                               if c != key]))
    fresh = fresh.select(key, *value_cols)
    computed = misses.join(fresh, key, "left").withColumn("origin", F.lit("miss"))
    return hits.unionByName(computed), fresh


def reuse_within_ttl(df: DataFrame, keys: list[str], order: list[str], ts_micros: str,
                     ttl_micros: int, id_col: str) -> DataFrame:
    """R2 -> (keys..., id_col, hit)."""
    src = sorted_by_key(df.select(*keys, *[c for c in order if c not in keys],
                                  F.col(ts_micros).alias("_t"),
                                  *([id_col] if id_col not in order else [])),
                        keys, order)
    types = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{id_col} {types[id_col]}",
                                                            "hit boolean"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur_key, last_miss = None, None
        for pdf in batches:
            kv = list(zip(*[pdf[k].tolist() for k in keys])) if keys else [()] * len(pdf)
            ts = pdf["_t"].to_numpy(np.int64)
            hits = np.zeros(len(pdf), dtype=bool)
            for i in range(len(pdf)):
                if kv[i] != cur_key:
                    cur_key, last_miss = kv[i], None
                t = int(ts[i])
                if last_miss is not None and t - last_miss <= ttl_micros:
                    hits[i] = True
                else:
                    last_miss = t
            out = pdf[list(keys) + [id_col]].copy()
            out["hit"] = hits
            yield out

    return src.mapInPandas(fold, schema)


def reuse_ratio(flags: DataFrame, labels: list[str], hit: str = "hit") -> DataFrame:
    """A10: hits, misses and hit share per label set."""
    g = flags.groupBy(*labels).agg(F.count_if(F.col(hit)).alias("hits"),
                                   F.count_if(~F.col(hit)).alias("misses"))
    return g.withColumn("hit_ratio", F.col("hits") / (F.col("hits") + F.col("misses")))
