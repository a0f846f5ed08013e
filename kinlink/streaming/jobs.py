"""Jobs: one FIFO worker per remote party, statuses, callbacks."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from enum import Enum
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession

from kinlink.plans.config import LinkageConfig, RemoteParty
from kinlink.plans.engine import LinkageEngine
from kinlink.sources.sinks import count_document, linkage_document


class Status(Enum):
    QUEUED = "queued"
    RUNNING = "running"
    HOLD = "hold"
    FAULT = "fault"
    DONE = "done"


@dataclass
class Job:
    job_id: str
    remote_id: str
    kind: str
    status: Status = Status.QUEUED
    result: DataFrame | None = None
    error: str | None = None
    future: Future | None = field(default=None, repr=False)


class LinkageService:
    """Submits linkage and counting jobs against a cached server snapshot.

    Jobs of one remote run one after the other, those of different remotes side
    by side, each in its remote's scheduler pool.  The registry's lock isn't held
    while a job runs.  ``role`` is the side this service speaks for; as a server its
    documents carry the database's ids.  Of the jobs that are over the last ``keep``
    stay; an older one is forgotten with its result.
    """

    def __init__(self, spark: SparkSession, config: LinkageConfig, database: Callable[[], DataFrame], mode: str = "int32", role: str = "client", keep: int = 1000):
        self.spark, self.config, self.mode, self.role, self.keep = spark, config, mode, role, keep
        self._load, self._lock, self._loading = database, threading.Lock(), threading.Lock()
        self._snapshot: DataFrame | None = None
        self._uses: dict[int, int] = {}  # snapshots by id: jobs that still read them
        self._jobs: dict[str, Job] = {}
        self._workers: dict[str, ThreadPoolExecutor] = {}
        self._remotes: dict[str, RemoteParty] = {}

    def init_remote(self, remote: RemoteParty) -> None:
        with self._lock:
            if remote.remote_id in self._remotes:
                raise NotImplementedError("a remote can't be initialised again")
            self._remotes[remote.remote_id] = remote
            self._workers[remote.remote_id] = ThreadPoolExecutor(1, thread_name_prefix=remote.remote_id)

    def poll_database(self) -> int:
        """Load a new snapshot; the number of its rows."""
        fresh = self._load().cache()
        n = fresh.count()
        self._replace(fresh)
        return n

    def poll_changes(self) -> int:
        """Load a new snapshot; the number of its rows whose ids the last one lacks."""
        if self._snapshot is None:
            return self.poll_database()
        data = self._begin()
        try:
            fresh = self._load().cache()
            n = fresh.join(data.select("id"), "id", "left_anti").count()
            self._replace(fresh)
        finally:
            self._end(data)
        return n

    def _replace(self, fresh: DataFrame) -> None:
        with self._lock:
            old, self._snapshot = self._snapshot, fresh
            unused = old is not None and not self._uses.get(id(old))
        if unused:
            old.unpersist()

    def database(self) -> DataFrame:
        with self._loading:  # one load, however many jobs ask first
            if self._snapshot is None:
                self.poll_database()
        with self._lock:
            return self._snapshot

    def _begin(self) -> DataFrame:
        self.database()
        with self._lock:
            data = self._snapshot
            self._uses[id(data)] = self._uses.get(id(data), 0) + 1
        return data

    def _end(self, data: DataFrame) -> None:
        with self._lock:
            self._uses[id(data)] -= 1
            unused = not self._uses[id(data)] and data is not self._snapshot
            if not self._uses[id(data)]:
                del self._uses[id(data)]
        if unused:
            data.unpersist()

    def _forget(self) -> None:
        """Drop the oldest jobs that are over, beyond ``keep``."""
        with self._lock:
            over = [j for j in self._jobs.values() if j.status in (Status.DONE, Status.FAULT)]
            gone = over[:max(0, len(over) - self.keep)]
            for j in gone:
                del self._jobs[j.job_id]
        for j in gone:
            if j.result is not None:
                j.result.unpersist()

    def ping(self, remote_id: str, timeout: float = 15.0) -> bool:
        """Whether the remote's linkage service answers."""
        service = self._remotes[remote_id].linkage_service
        if service is None:
            return False
        try:
            with urlopen(f"{service.rstrip('/')}/test", timeout=timeout) as answer:  # noqa: S310
                return answer.status == 200
        except OSError:
            return False

    def test_config(self, other: LinkageConfig) -> bool:
        return self.config.compatible(other)

    def submit_link(self, remote_id: str, records: DataFrame, callback: Callable[[str], object] | None = None) -> str:
        return self._submit(remote_id, "link", records, callback)

    def submit_count(self, remote_id: str, records: DataFrame, callback: Callable[[str], object] | None = None) -> str:
        if not self._remotes[remote_id].matching_allowed:
            raise PermissionError(f"matching isn't allowed for {remote_id}")
        return self._submit(remote_id, "count", records, callback)

    def _submit(self, remote_id: str, kind: str, records: DataFrame, callback) -> str:
        if remote_id not in self._remotes:
            raise KeyError(f"remote {remote_id} isn't initialised")
        job = Job(uuid.uuid4().hex, remote_id, kind)
        with self._lock:
            self._jobs[job.job_id] = job
            job.future = self._workers[remote_id].submit(self._run, job, records, callback)
        return job.job_id

    def _run(self, job: Job, records: DataFrame, callback) -> None:
        self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", job.remote_id)
        job.status, data = Status.RUNNING, None
        try:
            engine, data = LinkageEngine(self.config, self.mode), self._begin()
            out = (engine.link if job.kind == "link" else engine.count)(records, data)
            # Results are small (a row per record): keep them from running again.
            job.result = out.cache()
            job.result.count()
            if callback is not None:
                doc = linkage_document(job.result, self.role, data) if job.kind == "link" else count_document(job.result)
                callback(doc.first()["document"])
            job.status = Status.DONE
        except Exception as e:  # noqa: BLE001
            job.error, job.status = f"{type(e).__name__}: {e}", Status.FAULT
        finally:
            if data is not None:
                self._end(data)
            self._forget()

    def job_status(self, job_id: str) -> str:
        return self._jobs[job_id].status.value

    def jobs(self) -> dict[str, dict[str, str]]:
        """All jobs by remote."""
        out: dict[str, dict[str, str]] = {}
        with self._lock:
            for j in self._jobs.values():
                out.setdefault(j.remote_id, {})[j.job_id] = j.status.value
        return out

    def wait(self, job_id: str, timeout: float | None = None) -> Job:
        job = self._jobs[job_id]
        job.future.result(timeout)
        return job

    def close(self) -> None:
        for w in self._workers.values():
            w.shutdown(wait=True)
