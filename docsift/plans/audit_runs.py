"""An audit over all tenders in steps, each of which is stored with its findings, so that a run that dies goes on where it was.

The tenders are dealt into blocks by a hash of their id; a block is one Spark job over its tenders. Its findings and the
note that it is done are one version of the store. A run that is started again under its id does the blocks that have no
note; findings of a run are complete when the note of the last block is there, whoever wrote it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.sources.snapshots import Conflict, Snapshots


def done_blocks(store: Snapshots, run_id: str) -> dict[int, int]:
    """Blocks that the run has stored, and the findings of each."""
    return {v.info["block"]: v.info["findings"] for v in store.notes("run", run_id)}


def run_audit(store: Snapshots, run_id: str, tenders: DataFrame, findings_of: Callable[[DataFrame], DataFrame], blocks: int = 16, key: str = "tender_id") -> dict:
    """Findings of all tenders in the store's table `findings`, a part for each run and block. Returns the run as public state.

    A run keeps the number of blocks that it began with."""
    begun = store.notes("run", run_id)
    blocks = begun[0].info["blocks"] if begun else blocks
    done = {v.info["block"]: v.info["findings"] for v in begun}
    resumed = len(done)
    for block in range(blocks):
        if block in done:
            continue
        own = tenders.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == block)
        writer = store.begin()
        part = f"{run_id}/{block:06d}"
        rows = findings_of(own)
        writer.replace("findings", rows, part)
        n = writer.staged("findings", part, rows.schema).count()
        try:
            writer.commit(run=run_id, block=block, blocks=blocks, findings=n)
        except Conflict:  # another process of the same run was first; its findings stand
            pass
        done[block] = n
    return {"id": run_id, "status": "completed", "blocks": blocks, "resumed_from": resumed, "findings": sum(done_blocks(store, run_id).values())}


def findings(store: Snapshots, run_id: str, schema: str) -> DataFrame:
    """What the run has found so far."""
    parts = [p for p in store.version().tables.get("findings", {}) if p.startswith(f"{run_id}/")]
    return store.read("findings", schema, parts=parts)
