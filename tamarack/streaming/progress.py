"""Progress records folded to one state a model, in batch and as a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship

STATE = "model string, status string, total long, completed long, percent double, done boolean, ok boolean, error string"


def fold(records: DataFrame) -> DataFrame:
    """model, status, total, completed, percent, done, ok, error of records (model, seq, status, total, completed, error).

    Each field keeps its last value that isn't null. percent is 100 * completed / total of
    the last record with a total above 0, within 0 and 100. Records after the first error
    or success don't count. A stream that just ends is fine from 99.9 percent on.
    """
    final = F.col("error").isNotNull() | F.coalesce(F.contains(F.lower("status"), F.lit("success")), F.lit(False))
    before = W.partitionBy("model").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    open_ = records.withColumn("final_", final).withColumn("over_", F.coalesce(F.max(F.col("final_").cast("int")).over(before), F.lit(0))).where("over_ = 0")
    share = F.when(F.col("total") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * F.coalesce("completed", F.lit(0)) / F.col("total"))))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("seq")))
    out = open_.groupBy("model").agg(
        *(last(F.col(c)).alias(c) for c in ("status", "total", "completed", "error")),
        F.coalesce(last(share), F.lit(0.0)).alias("percent"),
        F.max(F.coalesce(F.contains(F.lower("status"), F.lit("success")), F.lit(False))).alias("success"),
    )
    ok = F.col("error").isNull() & (F.col("success") | (F.col("percent") >= 99.9))
    return out.select("model", "status", "total", "completed", F.when(F.col("success") & F.col("error").isNull(), 100.0).otherwise(F.col("percent")).alias("percent"), (F.col("success") | F.col("error").isNotNull() | ok).alias("done"), ok.alias("ok"), "error")


def _step(key, batches, state: GroupState):
    now = list(state.get) if state.exists else [None, None, None, 0.0, False, None]
    status, total, completed, percent, success, error = now
    for pdf in batches:
        for r in pdf.sort_values("seq").itertuples():
            if success or error is not None:
                break
            status = r.status if isinstance(r.status, str) else status
            if not pd.isna(r.total):
                total = int(r.total)
            if not pd.isna(r.completed):
                completed = int(r.completed)
            if not pd.isna(r.total) and r.total > 0:
                percent = max(0.0, min(100.0, 100.0 * (0 if pd.isna(r.completed) else r.completed) / r.total))
            error = r.error if isinstance(r.error, str) else error
            success = isinstance(r.status, str) and "success" in r.status.lower()
    state.update((status, total, completed, percent, success, error))
    ok = error is None and (success or percent >= 99.9)
    yield pd.DataFrame({"model": [key[0]], "status": [status], "total": pd.array([total], "Int64"), "completed": pd.array([completed], "Int64"), "percent": [100.0 if success and error is None else percent], "done": [success or error is not None or ok], "ok": [ok], "error": [error]})


def fold_stream(records: DataFrame) -> DataFrame:
    """The same as a stateful stream: after each micro-batch, the state of the models it touched."""
    ship(records.sparkSession)
    state = "status string, total long, completed long, percent double, success boolean, error string"
    return records.groupBy("model").applyInPandasWithState(_step, STATE, state, "update", GroupStateTimeout.NoTimeout)
