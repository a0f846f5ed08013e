"""A session with the states of a linkage run, for callers that go step by step."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame

from kinlink.plans.config import LinkageConfig
from kinlink.plans.engine import LinkageEngine


class State(Enum):
    CREATED = "created"
    BUILT = "built"
    READY = "ready"
    DONE = "done"


class LinkageSession:
    """build, set_inputs, then run; ``reset`` allows another run.

    ``build`` fixes what is computed and how many rows are expected at most; the
    inputs are held against that.  There is no setup phase to run beforehand.
    """

    def __init__(self, config: LinkageConfig, mode: str = "int32"):
        self.engine, self.state = LinkageEngine(config, mode), State.CREATED
        self._kind, self._sizes = "", (0, 0)
        self._inputs: tuple[DataFrame, DataFrame] | None = None

    def _expect(self, *states: State) -> None:
        if self.state not in states:
            raise RuntimeError(f"not possible in state {self.state.value}")

    def build(self, kind: str, records: int, rows: int) -> None:
        self._expect(State.CREATED)
        if kind not in ("link", "count"):
            raise ValueError(f"unknown kind {kind!r}")
        self._kind, self._sizes, self.state = kind, (records, rows), State.BUILT

    def set_inputs(self, client: DataFrame, server: DataFrame) -> None:
        self._expect(State.BUILT)
        found = client.count(), server.count()
        for what, n, most in zip(("records", "rows"), found, self._sizes):
            if n > most:
                raise RuntimeError(f"built for {most} {what}, got {n}")
        self._inputs, self.state = (client, server), State.READY

    def run(self) -> DataFrame:
        self._expect(State.READY)
        self.state = State.DONE
        return (self.engine.link if self._kind == "link" else self.engine.count)(*self._inputs)

    def reset(self) -> None:
        self._inputs, self._kind, self._sizes, self.state = None, "", (0, 0), State.CREATED
