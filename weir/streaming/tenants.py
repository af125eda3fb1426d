"""The tenant merge as a stateful stream: the state is the slot, the output one outcome for each event.

Within a micro-batch a tenant's events are taken by sequence number; stale ones are told by version, so no watermark is
needed, and the outcomes equal those of the batch fold on the same events if batches come in sequence order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weir.operators.tenants import Slot, apply

OUTPUT = "seq long, tenant_id string, outcome string, version long"
STATE = "version long, policy string, provenance string, limits string, limits_provenance string"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    slot = Slot(*state.get) if state.exists else Slot()
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for r in rows.itertuples(index=False):
        outcome = apply(slot, r.kind, int(r.version), None if pd.isna(r.payload) else r.payload, None if pd.isna(r.provenance) else r.provenance)
        out.append((r.seq, key[0], outcome, slot.version))
    state.update((slot.version, slot.policy, slot.provenance, slot.limits, slot.limits_provenance))
    yield pd.DataFrame(out, columns=["seq", "tenant_id", "outcome", "version"])


def fold_stream(events: DataFrame) -> DataFrame:
    """events: a stream with the columns of operators.tenants.EVENTS."""
    return events.groupBy("tenant_id").applyInPandasWithState(_fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def defend_stream(objects: DataFrame, policies: DataFrame, results_path: str, checkpoint: str, audit_path: str | None = None):
    """A stream of objects through the pipeline into tables of results and audit events; returns the started query."""
    from weir.operators.pipeline import audit_events, defend

    def sink(batch: DataFrame, number: int) -> None:
        results = defend(batch, policies).persist()
        results.write.mode("overwrite").parquet(f"{results_path}/batch={number}")  # a batch that is run again replaces itself
        if audit_path:
            audit_events(results).write.mode("overwrite").parquet(f"{audit_path}/batch={number}")
        results.unpersist()

    return objects.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
