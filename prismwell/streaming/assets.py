"""Assets under replacement, with their versions and jobs, as live state and as a fold over a table.

One function, ``advance``, says what an event does to an asset. The stream keeps an asset's entry, its
versions, its jobs and the events that came too early in keyed state (``transformWithState``); a running
job has a processing-time timer, and is queued again when it fires. The batch reads sorted rows and holds
one asset at a time. Both give the same entries for the same events.

Events of an asset are numbered from 1 without gaps. One that comes early waits for those before it;
where they do not come within ``patience``, it is applied without them. One that comes late, or again,
is reported and changes nothing. Unknown events change nothing either; a null attempt is that of the
asset's open job, or the next one; a missing start makes a running job stale at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import MOST_ATTEMPTS, STALE_SECONDS

#: Seconds that an event waits for the numbers before it.
PATIENCE_SECONDS = 600
OPEN = ("queued", "running")
EVENT = "asset_id long, seq long, event string, attempt int, reason string, final boolean, at long"
ENTRY = "asset_id long, seq long, status string, attempts_used int, restarts int, active_version string, job_attempt int, job_status string, versions string, note string"
_NAMES = [c.split()[0] for c in ENTRY.split(", ")]


def version_name(attempt: int) -> str:
    return f"attempt_{attempt:02d}"


@dataclass
class Asset:
    """An entry of the registry; ``jobs`` are attempt -> (status, started), ``versions`` name -> status."""

    status: str = "active"
    used: int = 0
    restarts: int = 0
    active: str = version_name(0)
    versions: dict[str, str] = field(default_factory=lambda: {version_name(0): "active"})
    jobs: dict[int, tuple[str, int | None]] = field(default_factory=dict)
    seq: int = 0

    def open_job(self) -> int | None:
        return next((a for a in sorted(self.jobs) if self.jobs[a][0] in OPEN), None)

    def row(self, key, note: str = "") -> tuple:
        job = self.open_job() if self.open_job() is not None else max(self.jobs, default=None)
        told = ",".join(f"{v}:{s}" for v, s in sorted(self.versions.items()))
        return key, self.seq, self.status, self.used, self.restarts, self.active, job, self.jobs[job][0] if job is not None else None, told, note


def recover(asset: Asset, now: int, stale: int = STALE_SECONDS) -> list[int]:
    """Queue running jobs again that started ``stale`` seconds ago or have no start; their attempts."""
    found = [a for a, (status, started) in asset.jobs.items() if status == "running" and (started is None or now - started >= stale * 1000)]
    for a in found:
        asset.jobs[a] = ("queued", None)
    return found


def advance(asset: Asset, event: str, attempt: int | None, final: bool, at: int | None, most: int = MOST_ATTEMPTS) -> None:
    """What one event does: deprecate, restart, claim, promote, fail."""
    job = asset.open_job()
    number = attempt if attempt is not None else job if job is not None else asset.used + 1
    if event == "deprecate":
        asset.status = asset.versions[asset.active] = "deprecated_pending_replacement"
        if job is not None:
            return
        if asset.used + 1 > most:
            asset.status, asset.versions[asset.active] = "manual_reprompt_required", "replacement_failed"
        else:
            asset.jobs[asset.used + 1] = ("queued", None)
    elif event == "restart" and job is None:
        if asset.restarts >= most:
            asset.status = "manual_reprompt_required"
        else:
            asset.status, asset.restarts = "deprecated_pending_replacement", asset.restarts + 1
            asset.jobs[max(asset.used, 1)] = ("queued", None)
    elif event == "claim" and job is not None and asset.jobs[job][0] == "queued":
        asset.jobs[job] = ("running", at)
    elif event == "promote":
        if asset.active in asset.versions:
            asset.versions[asset.active] = "deprecated"
        asset.active, asset.status, asset.restarts = version_name(number), "active", 0
        asset.versions[asset.active] = "active"
        asset.used = max(asset.used, number)
        if number in asset.jobs:
            asset.jobs[number] = ("completed", None)
    elif event == "fail":
        asset.versions[version_name(number)] = "replacement_failed"
        asset.used = max(asset.used, number)
        asset.status = "manual_reprompt_required" if final else "deprecated_pending_replacement"
        if number in asset.jobs:
            asset.jobs[number] = ("failed", None)


class _Registry(StatefulProcessor):
    """The keyed state: one entry, versions and jobs as maps, early events as a map by number."""

    def __init__(self, stale: int, patience: int):
        self.stale, self.patience = stale, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "status string, used int, restarts int, active string, seq long, waits_until long")
        self.versions = handle.getMapState("versions", "version string", "status string")
        self.jobs = handle.getMapState("jobs", "attempt int", "status string, started long")
        self.early = handle.getMapState("early", "seq long", "event string, attempt int, final boolean, at long")

    def _load(self) -> tuple[Asset, int]:
        if not self.entry.exists():
            return Asset(), 0
        status, used, restarts, active, seq, until = self.entry.get()
        versions = {k[0]: v[0] for k, v in self.versions.iterator()}
        jobs = {k[0]: (v[0], None if v[1] < 0 else v[1]) for k, v in self.jobs.iterator()}
        return Asset(status, used, restarts, active, versions, jobs, seq), until

    def _store(self, asset: Asset, until: int, before: Asset, was_until: int, now: int) -> None:
        """Write what changed, and set the timers that it asks for."""
        self.entry.update((asset.status, asset.used, asset.restarts, asset.active, asset.seq, until))
        for v, s in asset.versions.items():
            if before.versions.get(v) != s or not before.seq:
                self.versions.updateValue((v,), (s,))
        for a, (s, started) in asset.jobs.items():
            if before.jobs.get(a) != (s, started):
                self.jobs.updateValue((a,), (s, -1 if started is None else started))
                if s == "running":
                    self.handle.registerTimer(max(now + 1, (started or 0) + self.stale * 1000))
        if until and until != was_until:
            self.handle.registerTimer(until)

    def _drain(self, asset: Asset, waiting: dict[int, tuple], skip: bool) -> None:
        """Apply the events whose turn it is; with ``skip`` the gap before the first is given up."""
        while waiting:
            first = min(waiting)
            if first != asset.seq + 1 and not skip:
                return
            skip = False
            event, attempt, final, at = waiting.pop(first)
            if at is not None and at >= 0:
                recover(asset, at, self.stale)
            advance(asset, event, None if attempt is None or attempt < 0 else attempt, final, None if at is None or at < 0 else at)
            asset.seq = first
            if self.early.containsKey((first,)):
                self.early.removeKey((first,))

    def _waiting(self) -> dict[int, tuple]:
        return {k[0]: v for k, v in self.early.iterator()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        asset, was_until = self._load()
        before, _ = self._load()
        waiting, late = self._waiting(), []
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if r.seq <= asset.seq or r.seq in waiting:
                    late.append(int(r.seq))
                    continue
                event = (r.event or "", -1 if pd.isna(r.attempt) else int(r.attempt), bool(r.final) if not pd.isna(r.final) else False, -1 if pd.isna(r.at) else int(r.at))
                waiting[int(r.seq)] = event
                if r.seq == asset.seq + 1:
                    self._drain(asset, waiting, False)
                else:
                    self.early.updateValue((int(r.seq),), event)
        self._drain(asset, waiting, False)
        until = (was_until or now + self.patience * 1000) if waiting else 0
        self._store(asset, until, before, was_until, now)
        out = [asset.row(key[0], f"waiting:{len(waiting)}" if waiting else "")] + [(*asset.row(key[0])[:-1], f"late:{n}") for n in late]
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, fired = timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()
        asset, until = self._load()
        before, _ = self._load()
        note = ",".join(f"stale:{a}" for a in recover(asset, max(now, fired), self.stale))
        was_until = until
        if until and until <= fired:
            waiting = self._waiting()
            self._drain(asset, waiting, True)
            until = fired + self.patience * 1000 if waiting else 0
            note = ",".join(filter(None, [note, "gap"]))
        self._store(asset, until, before, was_until, now)
        if note:
            yield pd.DataFrame([asset.row(key[0], note)], columns=_NAMES)

    def close(self) -> None:
        pass


def live_registry(events: DataFrame, stale: int = STALE_SECONDS, patience: int = PATIENCE_SECONDS) -> DataFrame:
    """A stream of entries (ENTRY) for a stream of events (EVENT); needs the RocksDB state store.

    ``at`` is in milliseconds. A row's ``note`` tells of stale jobs, late events, waits and gaps.
    """
    return events.groupBy("asset_id").transformWithStateInPandas(_Registry(stale, patience), outputStructType=ENTRY, outputMode="Update", timeMode="ProcessingTime")


def folded_registry(events: DataFrame, now: int | None = None, stale: int = STALE_SECONDS) -> DataFrame:
    """The last entry (ENTRY) of each asset after all events of a table, in the order of their numbers.

    Rows stream through, an asset's one after the other: no asset's events are gathered. A number that
    is told again changes nothing. Jobs that are stale ``now`` are queued again at last.
    """
    names = [c.split()[0] for c in EVENT.split(", ")]
    # numbers, not nulls: a batch with a null would turn them into floats
    columns = [F.coalesce(F.col(n).cast("long"), F.lit(-1)).alias(n) if n in ("attempt", "at") else F.coalesce("final", F.lit(False)).alias(n) if n == "final" else F.col(n) for n in names]
    rows = events.where("asset_id is not null and seq is not null").select(*columns).repartition("asset_id").sortWithinPartitions("asset_id", "seq", "event", "attempt")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, asset = None, Asset()

        def done() -> tuple:
            if now is not None:
                recover(asset, now, stale)
            return asset.row(key)

        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.asset_id != key:
                    if key is not None:
                        out.append(done())
                    key, asset = r.asset_id, Asset()
                if r.seq <= asset.seq:
                    continue
                if r.at >= 0:
                    recover(asset, int(r.at), stale)
                advance(asset, r.event or "", None if r.attempt < 0 else int(r.attempt), bool(r.final), None if r.at < 0 else int(r.at))
                asset.seq = int(r.seq)
            yield pd.DataFrame(out, columns=_NAMES)
        if key is not None:
            yield pd.DataFrame([done()], columns=_NAMES)

    return rows.mapInPandas(fold, ENTRY)
