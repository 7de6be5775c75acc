"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string")) % 5


def bounded_ids(rows: DataFrame, bound: int, seed: int = 0) -> list[int]:
    """At most ``bound`` distinct doc_ids of ``rows``: those with the least hashes. The hash limit is set
    so that no task sends much more than its share."""
    ids = rows.where("doc_id is not null").select("doc_id")
    total = ids.count()
    if not total:
        return []
    h = F.xxhash64("doc_id", F.lit(seed))
    share = min(1.0, 1.5 * bound / total + 64 / total)
    if share < 1:
        ids = ids.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30)))
    return [r["doc_id"] for r in ids.distinct().orderBy(F.pmod(h, F.lit(1 << 30)), "doc_id").limit(bound).collect()]
