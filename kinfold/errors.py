"""Errors with stable codes."""


class EngineError(Exception):
    code = "unexpected_error"


def _kind(name: str, code: str, about: str) -> type[EngineError]:
    return type(name, (EngineError,), {"code": code, "__doc__": about, "__module__": __name__})


InvalidConfiguration = _kind("InvalidConfiguration", "invalid_configuration", "A definition or value cannot be used.")
ForbiddenOperation = _kind("ForbiddenOperation", "forbidden_operation", "The actor lacks an ability.")
MissingContext = _kind("MissingContext", "missing_context", "No actor, panel or tenant is known.")
RecordUnavailable = _kind("RecordUnavailable", "record_unavailable", "A record is absent, invisible or cannot be resolved.")
StalePreview = _kind("StalePreview", "stale_preview", "A plan expired or no longer describes its records.")
UnsupportedRelation = _kind("UnsupportedRelation", "unsupported_relation", "A relation of a kind that cannot be moved.")
DomainConflict = _kind("DomainConflict", "domain_conflict", "The operation contradicts the state.")
MergeTooLarge = _kind("MergeTooLarge", "merge_too_large", "More children than the cap allows.")
RetryExhausted = _kind("RetryExhausted", "retry_exhausted", "Concurrent commits won each time.")
