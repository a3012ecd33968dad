"""Exceptions raised by the declarative gates."""


class EvidenceError(Exception):
    """Base class of every error this package raises."""


class SourceValidationError(EvidenceError):
    """Source rows or manifests break the ingest contract."""


class BundleFormatError(EvidenceError):
    """A concept bundle cannot be parsed or fails its integrity check."""


class JudgeValidationError(EvidenceError):
    """A judge response is not the one exact JSON document expected."""


class DuplicateJSONKeyError(JudgeValidationError):
    """A JSON object repeats a key."""


class PairingError(EvidenceError):
    """Paired analysis was asked for on an incomplete or ambiguous grid."""


class BenchmarkValidationError(EvidenceError):
    """The gold question set breaks its contract."""


class RetriesExhaustedError(EvidenceError):
    """No valid judge response after the allowed attempts."""
