"""What governs recurring captures: settings, one writer, room, quotas, due times, fallbacks and status.

State is rows (entity_id, at, and the fields of its kind), appended and never changed; each decision is a query over the latest row of
an entity. The driver holds settings and locks only.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import re
import shutil
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import versions

#: Bounds of the settings (least, most).
BOUNDS = {"daily_quota": (1, 288), "per_source_quota": (1, 96), "interval": (1800, 86_400), "max_backoff": (1800, 86_400), "min_free_bytes": (4 << 20, None)}
NAME = re.compile(r"[A-Za-z0-9_-]{8,80}")
LOCAL, PRODUCTION = "ISOLATED_LOCAL_PILOT", "PRODUCTION_DURABLE_CAPTURE"
#: Settings that say where, not what: no part of the policy.
PLACES = ("root", "volume", "initialize", "fixture")


def plain_path(path: str) -> Path:
    """An absolute path with no link in it."""
    made = Path(path)
    if not made.is_absolute():
        raise ValueError("ABSOLUTE_PATH_REQUIRED")
    if any(step.is_symlink() for step in (made, *made.parents)):
        raise ValueError("LINK_REFUSED")
    return made


@dataclasses.dataclass(frozen=True)
class CaptureSettings:
    """Settings of a capture; ``checked`` raises the first fault's code."""

    scope: str
    root: str
    volume: str
    volume_id: str
    ledger_id: str
    sources: tuple[str, ...]
    daily_quota: int
    per_source_quota: int
    interval: int
    max_backoff: int
    max_storage_bytes: int
    warning_bytes: int
    min_free_bytes: int
    initialize: bool = False
    approved: bool = False
    fixture: str | None = None

    @classmethod
    def of(cls, values: dict) -> CaptureSettings:
        names = {f.name for f in dataclasses.fields(cls)}
        if set(values) - names or {f.name for f in dataclasses.fields(cls) if f.default is dataclasses.MISSING} - set(values):
            raise ValueError("SETTINGS_INVALID")
        return cls(**{**values, "sources": tuple(values["sources"])})

    def checked(self, allowed: set[str]) -> CaptureSettings:
        root, volume = plain_path(self.root), plain_path(self.volume)
        numbers = [getattr(self, n) for n in (*BOUNDS, "max_storage_bytes", "warning_bytes")]
        outside = any(not (low <= getattr(self, n) and (high is None or getattr(self, n) <= high)) for n, (low, high) in BOUNDS.items())
        faults = [
            ("SCOPE_INVALID", self.scope not in (LOCAL, PRODUCTION) or root == volume or volume not in root.parents),
            ("NAMESPACE_INVALID", not (NAME.fullmatch(self.volume_id) and NAME.fullmatch(self.ledger_id))),
            ("UNAPPROVED_SOURCE", not self.sources or len(set(self.sources)) < len(self.sources) or not set(self.sources) <= allowed),
            ("SETTINGS_INVALID", any(type(n) is not int for n in numbers)),
            ("QUOTA_OR_CADENCE_INVALID", outside or self.interval > self.max_backoff),
            ("CAPACITY_POLICY_INVALID", not 0 < self.warning_bytes < self.max_storage_bytes),
            ("ACTIVATION_NOT_APPROVED", self.scope == PRODUCTION and (not self.approved or self.fixture is not None)),
        ]
        for code, wrong in faults:
            if wrong:
                raise ValueError(code)
        marker = volume / "VOLUME.json"
        if not marker.is_file() or json.loads(marker.read_text()) != {"volume_id": self.volume_id, "scope": self.scope}:
            raise ValueError("VOLUME_NOT_APPROVED")
        return self

    def fingerprint(self) -> str:
        """Hash of the policy: moving a capture changes neither its authority nor its quotas."""
        policy = {k: v for k, v in dataclasses.asdict(self).items() if k not in PLACES}
        return hashlib.sha256(json.dumps(policy, sort_keys=True).encode()).hexdigest()


def same_runner(settings: CaptureSettings, marker: Path) -> None:
    """Binds a root to the policy that first ran there."""
    if not marker.exists() and settings.initialize:
        marker.write_text(settings.fingerprint())
    if not marker.exists() or marker.read_text() != settings.fingerprint():
        raise ValueError("RUNNER_IDENTITY_MISMATCH")


@contextmanager
def single_writer(lock: Path):
    """Holds the only writer's lock; a second writer fails at once. The system frees it when the process ends."""
    import fcntl

    with lock.open("a") as held:
        try:
            fcntl.flock(held, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as error:
            raise ValueError("WRITER_ALREADY_RUNNING") from error
        yield


def capacity(settings: CaptureSettings) -> dict:
    """Bytes used and free below the root, after a write that can be read back; an error where there is no room."""
    root = plain_path(settings.root)
    probe = root / ".probe"
    probe.write_bytes(b"probe")
    if probe.read_bytes() != b"probe":
        raise ValueError("WRITE_PROBE_FAILED")
    probe.unlink()
    used = sum(p.stat().st_size for p in root.rglob("*") if p.is_file())
    free = shutil.disk_usage(root).free
    if used >= settings.max_storage_bytes or free < settings.min_free_bytes:
        raise ValueError("CAPACITY_EXHAUSTED")
    return {"used_bytes": used, "free_bytes": free, "warning": used >= settings.warning_bytes}


def stop_requested(file: Path, pid: int | None = None) -> bool:
    """Whether a stop is asked of this process; the request is then taken."""
    if not file.exists() or json.loads(file.read_text()).get("pid") != (pid or os.getpid()):
        return False
    file.unlink()
    return True


# Decisions over state rows

def _last(states: DataFrame, kind: str) -> DataFrame:
    return versions.latest(states.filter(F.col("kind") == kind), ["entity_id"], ["at", "state_id"])


def reservations(states: DataFrame, day: str) -> DataFrame:
    """(source, used): attempts reserved on a UTC day."""
    return states.filter((F.col("kind") == "ATTEMPT") & (F.to_date("at") == F.lit(day).cast("date"))).groupBy(F.col("source")).agg(F.count("*").alias("used"))


def admitted(states: DataFrame, sources: DataFrame, now: Column, daily: int, per_source: int) -> DataFrame:
    """(source, decision) for each source that asks: RESERVED, or why not.

    A clock behind the latest state is refused for all. Then a fence after a restore, an open circuit, a check that is not due, and the quotas, in this
    order; the day's quota goes to sources by name.
    """
    facts = states.agg(F.max("at").alias("newest"), F.max(F.when(F.col("kind") == "FENCE", F.col("until"))).alias("fence"))
    provider = _last(states, "PROVIDER").select(F.col("entity_id").alias("source"), "circuit_open", F.col("until").alias("due"))
    used = states.filter((F.col("kind") == "ATTEMPT") & (F.to_date("at") == F.to_date(now))).groupBy("source").agg(F.count("*").alias("used"))
    total = used.agg(F.coalesce(F.sum("used"), F.lit(0)).alias("total"))
    asked = sources.select("source").distinct().join(provider, "source", "left").join(used, "source", "left").crossJoin(F.broadcast(facts.crossJoin(total)))  # one row
    why = (
        F.when(F.col("newest") > now, "CLOCK_REGRESSION").when(F.col("fence") > now, "RESTORE_FENCED").when(F.coalesce("circuit_open", F.lit(False)), "SOURCE_PAUSED")
        .when(F.col("due") > now, "BACKOFF_OR_NOT_DUE").when(F.coalesce("used", F.lit(0)) >= per_source, "SOURCE_QUOTA_USED")
    )
    from pyspark.sql import Window

    free = asked.withColumn("why", why)
    turn = F.sum(F.when(F.col("why").isNull(), 1).otherwise(0)).over(Window.orderBy("source"))  # one row a configured source
    decision = F.coalesce("why", F.when(F.col("total") + turn > daily, "DAILY_QUOTA_USED"), F.lit("RESERVED"))
    return free.select("source", decision.alias("decision"))


def acknowledged(states: DataFrame, source: str, now: Column) -> DataFrame:
    """The state row by which an operator closes a source's circuit; quotas and history stay."""
    last = _last(states, "PROVIDER").filter((F.col("entity_id") == source) & F.col("circuit_open"))
    return last.withColumn("circuit_open", F.lit(False)).withColumn("failures", F.lit(0)).withColumn("at", now).withColumn("state_id", F.concat("state_id", F.lit("-ack")))


def capture_status(states: DataFrame, enabled: bool, running: bool, now: Column, daily: int) -> DataFrame:
    """One row: OFF, STOPPED or RUNNING, the day's use of the quota, and whether a fence holds."""
    today = (F.col("kind") == "ATTEMPT") & (F.to_date("at") == F.to_date(now))
    facts = states.agg(F.count_if(today).alias("daily_quota_used"), F.max(F.when((F.col("kind") == "FENCE") & (F.col("until") > now), F.col("until"))).alias("recovery_ready_at"))
    budget = F.when(F.col("recovery_ready_at").isNotNull(), "RESTORE_FENCED").when(F.col("daily_quota_used") >= daily, "EXHAUSTED").otherwise("AVAILABLE")
    return facts.select(F.lit("OFF" if not enabled else "RUNNING" if running else "STOPPED").alias("status"), "daily_quota_used", budget.alias("budget_status"), "recovery_ready_at")


def schema_faults(rows: DataFrame, expected: str) -> list[str]:
    """Columns that a ledger lacks, has besides, or has in another type."""
    from pyspark.sql.types import _parse_datatype_string

    want = {f.name: f.dataType.simpleString() for f in _parse_datatype_string(expected).fields}
    have = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return sorted(n for n in want.keys() | have.keys() if want.get(n) != have.get(n))


def ledger_path(environment: dict[str, str], home: str) -> str | None:
    """Where the ledger is: named itself, below a named root, below the home folder where recording is asked for, else nowhere."""
    if named := environment.get("TIDEMARK_LEDGER", "").strip():
        return named
    if root := environment.get("TIDEMARK_ROOT", "").strip():
        return f"{root}/ledger"
    return f"{home}/.tidemark/ledger" if environment.get("TIDEMARK_RECORD", "").strip() == "1" else None


def evidence_paths(environment: dict[str, str], root: str) -> dict[str, str | None]:
    """The paths of the eight inputs, each named by TIDEMARK_<NAME> and relative to ``root``; None where it is not named."""
    names = ("news", "official", "expectations", "markets", "macro", "source_health", "geography", "mapping")
    given = {n: environment.get(f"TIDEMARK_{n.upper()}", "").strip() for n in names}
    return {n: (v if v.startswith("/") or "://" in v else f"{root}/{v}") if v else None for n, v in given.items()}


def opted_in(environment: dict[str, str], sources: dict[str, bool]) -> list[str]:
    """Sources whose flag is 1; those that need it (True) only with their acknowledgement as well."""
    on = lambda name: environment.get(name, "") == "1"
    return [s for s, needs in sources.items() if on(f"TIDEMARK_{s.upper()}") and (not needs or on(f"TIDEMARK_{s.upper()}_ACKNOWLEDGED"))]


def request_fault(method: str, path: str, known: set[str]) -> int | None:
    """The HTTP status that refuses a request; None where it may be answered."""
    return 405 if method not in ("GET", "HEAD") else None if path in known else 404


class Polled:
    """A source that is fetched when its rows are older than ``ttl`` seconds, once at a time; a failure keeps the last valid rows."""

    def __init__(self, fetch: Callable[[], DataFrame], clock: Callable[[], float], ttl: int):
        self.fetch, self.clock, self.ttl = fetch, clock, ttl
        self.rows: DataFrame | None = None
        self.at, self.status, self.busy = None, "STARTING", False

    def read(self) -> tuple[DataFrame | None, str]:
        """(rows, status): LIVE or EMPTY when fetched, CACHED within the ttl, LAST_VALID_FALLBACK or UNAVAILABLE after a failure."""
        if self.busy or (self.at is not None and self.clock() - self.at < self.ttl):
            return self.rows, "CACHED" if self.status in ("LIVE", "EMPTY") else self.status
        self.busy = True
        try:
            self.at = self.clock()
            rows = self.fetch()
            self.rows, self.status = rows, "EMPTY" if rows.isEmpty() else "LIVE"
        except Exception:
            self.status = "LAST_VALID_FALLBACK" if self.rows is not None else "UNAVAILABLE"
        finally:
            self.busy = False
        return self.rows, self.status


def run_cycles(step: Callable[[str], str], sources: list[str], cycles: int, stop: Callable[[], bool]) -> list[tuple[int, str, str]]:
    """(cycle, source, outcome): one to four cycles over the sources in order, until a stop is asked for."""
    if not 1 <= cycles <= 4:
        raise ValueError("CYCLES_OUT_OF_BOUNDS")
    out = []
    for cycle in range(1, cycles + 1):
        for source in sources:
            if stop():
                return out
            out.append((cycle, source, step(source)))
    return out


def paged(fetch: Callable[[str, int], list[dict]], searches: list[str], most_requests: int = 12, most_events: int = 8, depth: int = 3) -> list[dict]:
    """Events of several searches, depth by depth, each id once, within the budget of requests; a fetch takes (search or id, page)."""
    if len(searches) > most_requests:
        raise ValueError("REQUEST_BUDGET_EXCEEDED")
    batches, found = [fetch(s, 0)[:depth] for s in searches], {}
    for place in range(depth):
        for batch in batches:
            if place < len(batch) and len(found) < most_events and re.fullmatch(r"[0-9]{1,30}", str(batch[place].get("id", ""))):
                found.setdefault(str(batch[place]["id"]), batch[place])
    return list(found.values())


def states_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """State rows (state_id, kind, entity_id, source, at, until, circuit_open, failures)."""
    return spark.createDataFrame(rows, "state_id string, kind string, entity_id string, source string, at timestamp, until timestamp, circuit_open boolean, failures int")
