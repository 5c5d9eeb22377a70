"""The rules of reconciliation: authority, switches, locked periods, thresholds."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date

from .errors import RulesError

# Authority of each source, and what a role adds to a user's own edits.
SOURCE_AUTHORITY = {"user_edit": 100, "third_party": 50, "bank_sync": 10, "unknown": 1}
ROLE_BONUS = {"admin": 25, "premium": 10, "standard": 0, "trial": -5}
BONUS_SOURCES = ("user_edit",)
ACTION_RANK = {"create": 0, "update": 1, "delete": 2}

# Spellings of actions and sources.
ACTION_WORDS = {
    "create": "create created insert new add added c post",
    "update": "update updated edit edited modify modified change correct correction patch amend u",
    "delete": "delete deleted remove removed del d void voided cancel cancelled canceled reverse",
}
SOURCE_WORDS = {
    "user_edit": "user_edit user user_correction manual manual_entry manual_input app app_edit mobile web ui human",
    "third_party": "third_party thirdparty 3p expense_tracker tracker partner csv_import csv import integration spreadsheet excel",
    "bank_sync": "bank_sync bank bank_api sync aggregator plaid open_banking feed statement",
}

#: Field groups that are contested apart; amount and currency move together.
GROUPS = ("amount", "date", "category", "merchant", "account_id", "parent_transaction_id")


def spelled(words: Mapping[str, str]) -> dict[str, str]:
    return {w: name for name, text in words.items() for w in text.split()}


@dataclass(frozen=True)
class Period:
    """A closed accounting period, both ends included."""

    start: date
    end: date
    label: str = ""

    def __post_init__(self):
        if self.start > self.end:
            raise RulesError(f"period starts {self.start} after its end {self.end}")


# Names and defaults of thresholds and switches.
@dataclass(frozen=True)
class Thresholds:
    """Bounds of the anomaly rules; amounts in minor units."""

    amount_jump_minor: int = 100_000
    amount_jump_pct: int = 300
    date_shift_days: int = 90
    delete_age_days: int = 365
    edit_churn_count: int = 5
    round_amount_floor_minor: int = 1_000_000
    round_amount_modulus_minor: int = 100_000
    flag_sign_flip: bool = True


@dataclass(frozen=True)
class Rules:
    """Everything that results depend on; ``fingerprint`` names it."""

    source_authority: Mapping[str, int] = field(default_factory=lambda: dict(SOURCE_AUTHORITY))
    role_bonus: Mapping[str, int] = field(default_factory=lambda: dict(ROLE_BONUS))
    bonus_sources: tuple[str, ...] = BONUS_SOURCES
    user_roles: Mapping[str, str] = field(default_factory=dict)
    default_role: str = "standard"
    prefer_earliest_date_on_equal_authority: bool = True
    allow_update_before_create: bool = True
    allow_delete_before_create: bool = True
    resurrect_deleted_on_higher_authority: bool = True
    blank_never_overwrites: bool = True
    enforce_delete_dependencies: bool = True
    #: Periods by user key, or "*" for all users; the first that covers a date counts.
    locked_periods: Mapping[str, tuple[Period, ...]] = field(default_factory=dict)
    default_currency: str = "USD"
    strict_ambiguous_dates: bool = True
    case_insensitive_ids: bool = True
    synthesize_missing_transaction_id: bool = True
    infer_missing_event_ts: bool = True
    min_date: date = date(1970, 1, 1)
    max_date: date = date(2100, 12, 31)
    max_upload_bytes: int = 10 * 1024 * 1024
    detect_anomalies: bool = True
    thresholds: Thresholds = field(default_factory=Thresholds)

    def __post_init__(self):
        if self.default_role not in self.role_bonus:
            raise RulesError(f"default_role {self.default_role!r} has no bonus")
        if self.min_date > self.max_date:
            raise RulesError("min_date is after max_date")
        if self.max_upload_bytes <= 0:
            raise RulesError("max_upload_bytes must be positive")

    def authority(self, source: str, role: str) -> int:
        base = self.source_authority.get(source, self.source_authority.get("unknown", 1))
        return base + (self.role_bonus.get(role, 0) if source in self.bonus_sources else 0)

    def locked(self, user_key: str, day: date | None) -> Period | None:
        if day is None or not self.enforce_delete_dependencies:
            return None
        periods = [*self.locked_periods.get(user_key, ()), *self.locked_periods.get("*", ())]
        return next((p for p in periods if p.start <= day <= p.end), None)

    def with_(self, **changes) -> Rules:
        unknown = changes.keys() - {f.name for f in dataclasses.fields(self)}
        if unknown:
            raise RulesError(f"unknown rules: {sorted(unknown)}")
        return dataclasses.replace(self, **changes)

    def to_dict(self) -> dict:
        out = dataclasses.asdict(self)
        out["locked_periods"] = {k: [{"start": p.start.isoformat(), "end": p.end.isoformat(), "label": p.label} for p in v] for k, v in sorted(self.locked_periods.items())}
        out |= {"min_date": self.min_date.isoformat(), "max_date": self.max_date.isoformat(), "bonus_sources": list(self.bonus_sources)}
        return out

    @classmethod
    def from_dict(cls, said: Mapping) -> Rules:
        said = dict(said)
        if unknown := said.keys() - {f.name for f in dataclasses.fields(cls)}:
            raise RulesError(f"unknown rules: {sorted(unknown)}")
        for k in ("min_date", "max_date"):
            if isinstance(said.get(k), str):
                said[k] = date.fromisoformat(said[k])
        if isinstance(said.get("thresholds"), Mapping):
            said["thresholds"] = Thresholds(**said["thresholds"])
        if "bonus_sources" in said:
            said["bonus_sources"] = tuple(said["bonus_sources"])
        if "locked_periods" in said:
            said["locked_periods"] = {
                k: tuple(p if isinstance(p, Period) else Period(date.fromisoformat(p["start"]), date.fromisoformat(p["end"]), p.get("label", "")) for p in v) for k, v in said["locked_periods"].items()
            }
        return cls(**said)

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


DEFAULT = Rules()
