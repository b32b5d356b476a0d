"""Continuous item feed: deduplicate new items against the table they are appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators.dedup import drop_matched, item_keys, unique_in_batch, with_keys
from newsloom.session import cut_lineage
from newsloom.streaming.tables import AppendTable, KeyTable, each_batch


def feed_items(stream: DataFrame, table: AppendTable, keys: KeyTable, checkpoint: str) -> StreamingQuery:
    """Append the new items of each batch and their keys; items kept before are not read again.

    Deduplication is exact over all batches, not only inside a watermark, so an item that comes late is
    treated like any other and none is set aside. The keys of earlier batches are read in the buckets that
    the batch's own keys fall into.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        # Which items are new is decided without their texts; these move once, when they are written.
        narrow = cut_lineage(with_keys(batch).select("item_id", "created_at", "task_id", "external_id", "url_hash", "content_hash"))
        known = keys.before(epoch, item_keys(narrow, probing=True))
        kept = cut_lineage(unique_in_batch(drop_matched(narrow, known)).select("item_id").distinct())
        table.write(with_keys(batch).join(kept, "item_id", "left_semi"), epoch)
        keys.write(item_keys(table.batch(epoch)), epoch)

    return each_batch(stream, checkpoint, handle)
