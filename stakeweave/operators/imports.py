"""Importers as runs: records become nodes, then edges, then claims, then housekeeping follows."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession

from stakeweave.operators.claims import claim_rows, upsert_claims
from stakeweave.operators.maintenance import housekeeping
from stakeweave.operators.store import Files
from stakeweave.operators.upsert import upsert, upsert_edges
from stakeweave.sources.registers import control_edges, control_entities, control_persons, control_rows

Tables = Mapping[str, DataFrame]


def fold_in(tables: Tables, now: Column, entities: DataFrame | None = None, persons: DataFrame | None = None, owns: DataFrame | None = None,
            kind: str = "owns") -> dict[str, DataFrame]:
    """The graph ``entity, person, owns, claim`` with what one source says; later steps see earlier ones' rows."""
    out = dict(tables)
    if entities is not None:
        out["entity"] = upsert(out["entity"], entities, ["id"], {c: "nonempty_new" for c in entities.columns if c != "id"})
    if persons is not None:
        out["person"] = upsert(out["person"], persons, ["id"], {c: "nonempty_new" for c in persons.columns if c != "id"})
    if owns is not None:
        out["owns"] = upsert_edges(out["owns"], owns.select(*[c for c in out["owns"].columns if c in owns.columns]), ["from_id", "to_id"])
        out["claim"] = upsert_claims(out["claim"], claim_rows(owns, kind, now))
        out["entity"], out["owns"] = housekeeping(out["entity"], out["owns"])
    return out


def import_control(tables: Tables, records: DataFrame, source_id: str, credibility: int, now: Column, codes: DataFrame | None = None) -> dict[str, DataFrame]:
    """The register of persons with significant control, folded into the graph."""
    rows = control_rows(records, codes)
    entities = control_entities(rows, source_id, credibility)
    persons = control_persons(rows)
    known = lambda new, table: new.select(*[c for c in table.columns if c in new.columns])
    return fold_in(tables, now, known(entities, tables["entity"]), known(persons, tables["person"]), control_edges(rows, source_id, credibility))


class ImportLocked(RuntimeError):
    """Another import holds the lock."""


class ImportLock:
    """One import at a time over the tables below ``root``.

    Every holder leaves a file with the next number, which appears whole and which only one can take; nothing is ever
    replaced, so of two that see a stale lock one takes it over and the other is told.  The number is the holder's fence: a
    ``Store`` that has seen a higher one refuses its commits.
    """

    def __init__(self, spark: SparkSession, root: str, stale_after: timedelta = timedelta(hours=6)):
        self._files = Files(spark, root)
        self.stale_after, self.fence = stale_after, None

    def _last(self) -> tuple[int, bool]:
        """The last number, and whether it has been given back."""
        names = self._files.names("locks")
        if not names:
            return 0, True
        number = max(int(n.split(".")[0]) for n in names)
        return number, f"{number:012d}.free" in names

    def status(self, now: datetime | None = None) -> dict:
        """Whether the lock is held, by whom, since when, with which fence, and whether it is stale."""
        number, free = self._last()
        if free:
            return {"held": False, "fence": number}
        since, holder = self._files.read(f"locks/{number:012d}.held").split(" ", 1)
        age = (now or datetime.now(UTC)) - datetime.fromisoformat(since)
        return {"held": True, "holder": holder, "since": since, "stale": age > self.stale_after, "fence": number}

    def acquire(self, holder: str, now: datetime | None = None) -> int:
        """The fence under which to write."""
        now = now or datetime.now(UTC)
        before = self.status(now)
        if before["held"] and not before["stale"]:
            raise ImportLocked(f"{before['holder']} imports since {before['since']}")
        number = before["fence"] + 1
        if not self._files.put_new(f"locks/{number:012d}.held", f"{now.isoformat()} {holder}"):
            raise ImportLocked("another import was faster")
        self.fence = number
        return number

    def release(self) -> None:
        """Lets go of one's own lock; one that was lost to another stays with it."""
        if self.fence is not None:
            self._files.put_new(f"locks/{self.fence:012d}.free", "")
        self.fence = None

    def __enter__(self) -> ImportLock:
        if self.fence is None:
            self.acquire("import")
        return self

    def __exit__(self, *_) -> None:
        self.release()
