"""Keys and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def claim_key(kind: Column, from_id: Column, to_id: Column, source_id: Column) -> Column:
    """SHA-1 over parts that carry their lengths, so no separator inside a part can confuse two claims."""
    parts = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in (kind, from_id, to_id, source_id)]
    return F.sha1(F.concat_ws("|", *parts).cast("binary"))


def reporter_fingerprint(salt: Column, address: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", salt, address), 256), 1, 32)


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)
