"""Linkage configuration: fields, exchange groups, thresholds, and their checks."""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field

COMPARATORS = ("dice", "binary")
TYPES = ("bitmask", "integer", "number", "string")
#: Bytes that the JSON encoders of numbers have at most.
MOST_BYTES = {"integer": 4, "number": 8}


def bitbytes(bits: int) -> int:
    return (bits + 7) // 8


@dataclass(frozen=True)
class FieldSpec:
    """One field: how frequent a value is, how often wrong, and how it is compared."""

    name: str
    frequency: float
    error: float
    comparator: str
    ftype: str
    bitsize: int

    def __post_init__(self):
        if self.comparator not in COMPARATORS:
            raise ValueError(f"field {self.name}: unknown comparator {self.comparator!r}")
        if self.ftype not in TYPES:
            raise ValueError(f"field {self.name}: unknown type {self.ftype!r}")
        if self.bitsize <= 0:
            raise ValueError(f"field {self.name}: bit size must be positive")
        if bitbytes(self.bitsize) > MOST_BYTES.get(self.ftype, self.bitsize):
            raise ValueError(f"field {self.name}: {self.ftype} fields have at most {MOST_BYTES[self.ftype]} bytes")
        if not (0 < self.frequency and 0 <= self.error < 1 and self.weight > 0):
            raise ValueError(f"field {self.name}: frequency and error rate give no positive weight")
        if self.ftype == "string" and self.bitsize % 8:
            warnings.warn(f"string field {self.name}: bit size isn't a multiple of 8", stacklevel=2)

    @property
    def weight(self) -> float:
        return math.log2((1 - self.error) / self.frequency)

    @property
    def nbytes(self) -> int:
        return bitbytes(self.bitsize)


@dataclass(frozen=True)
class LinkageConfig:
    """Fields by name (always in alphabetical order), groups of interchangeable fields, thresholds."""

    fields: dict[str, FieldSpec]
    threshold: float
    tentative_threshold: float
    groups: tuple[tuple[str, ...], ...] = ()
    local_id: str = "local"
    options: dict = field(default_factory=dict, compare=False)

    @classmethod
    def of(cls, fields: Iterable[FieldSpec], threshold: float, tentative_threshold: float, groups: Iterable[Iterable[str]] = (), **more) -> LinkageConfig:
        fields = list(fields)
        by_name = {f.name: f for f in sorted(fields, key=lambda f: f.name)}
        if len(by_name) != len(fields):
            raise ValueError("field names must differ")
        if not by_name:
            raise ValueError("at least one field is needed")
        return cls(by_name, threshold, tentative_threshold, tuple(tuple(sorted(g)) for g in groups), **more)

    def __post_init__(self):
        seen: set[str] = set()
        for g in self.groups:
            if not g:
                raise ValueError("an exchange group has no members")
            for name in g:
                if name not in self.fields:
                    raise ValueError(f"exchange group names the unknown field {name!r}")
                if name in seen:
                    raise ValueError(f"field {name!r} is in exchange groups twice")
                seen.add(name)
            for what in ("comparator", "bitsize"):
                if len({getattr(self.fields[n], what) for n in g}) > 1:
                    raise ValueError(f"fields of the exchange group {g} differ in {what}")

    @property
    def names(self) -> list[str]:
        return list(self.fields)

    @property
    def max_weight(self) -> float:
        return max(f.weight for f in self.fields.values())

    @property
    def single_fields(self) -> list[str]:
        grouped = {n for g in self.groups for n in g}
        return [n for n in self.fields if n not in grouped]

    @classmethod
    def from_json(cls, doc: str | dict) -> LinkageConfig:
        """From the document that initialises the local party."""
        doc = json.loads(doc) if isinstance(doc, str) else doc
        try:
            algo = doc["algorithm"]
            fields = [FieldSpec(f["name"], float(f["frequency"]), float(f["errorRate"]), f["comparator"], f["fieldType"], int(f["bitlength"])) for f in algo["fields"]]
            return cls.of(fields, float(algo["threshold_match"]), float(algo["threshold_non_match"]), algo.get("exchangeGroups", []),
                          local_id=doc.get("localId", "local"), options={k: v for k, v in doc.items() if k not in ("algorithm", "localId")})
        except KeyError as e:
            raise ValueError(f"configuration lacks {e}") from e

    def to_json(self) -> dict:
        return {"localId": self.local_id, "algorithm": {
            "threshold_match": self.threshold, "threshold_non_match": self.tentative_threshold, "exchangeGroups": [list(g) for g in self.groups],
            "fields": [{"name": f.name, "frequency": f.frequency, "errorRate": f.error, "comparator": f.comparator, "fieldType": f.ftype, "bitlength": f.bitsize} for f in self.fields.values()]}}

    def compatible(self, other: LinkageConfig) -> bool:
        """Both parties must use the same fields, groups and thresholds."""
        mine, theirs = self.to_json()["algorithm"], other.to_json()["algorithm"]
        for a in (mine, theirs):
            a["exchangeGroups"] = sorted(a["exchangeGroups"])
        return mine == theirs


@dataclass(frozen=True)
class RemoteParty:
    """Connection of a remote party; kept as plain settings."""

    remote_id: str
    url: str
    linkage_service: str | None = None
    matching_allowed: bool = False

    @classmethod
    def from_json(cls, remote_id: str, doc: str | dict) -> RemoteParty:
        doc = json.loads(doc) if isinstance(doc, str) else doc
        if "url" not in doc.get("connectionProfile", {}):
            raise ValueError("remote configuration lacks connectionProfile.url")
        return cls(remote_id, doc["connectionProfile"]["url"], doc.get("linkageService", {}).get("url"), bool(doc.get("matchingAllowed", False)))
