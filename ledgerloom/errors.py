"""Errors raised on the driver. Faults in rows never raise: they become issues of the row."""

from __future__ import annotations


class LedgerError(Exception):
    """Root of the library's errors; ``code`` is stable and may be relied on."""

    code = "E_LEDGER"
    status = 500

    def __init__(self, message: str, **context):
        super().__init__(message)
        self.message, self.context = message, context

    def to_dict(self) -> dict:
        return {"code": self.code, "message": self.message, "status": self.status, "context": self.context}


class InvalidRow(LedgerError):
    code, status = "E_VALIDATION", 400


class DuplicateEvent(LedgerError):
    code, status = "E_DUPLICATE_EVENT", 409


class InputError(LedgerError):
    code, status = "E_INGEST", 400


class TooLarge(InputError):
    code, status = "E_TOO_LARGE", 413


class StoreError(LedgerError):
    code = "E_STORE"


class ReplayMismatch(LedgerError):
    code = "E_REPLAY_MISMATCH"


class RulesError(LedgerError):
    code, status = "E_CONFIG", 400
