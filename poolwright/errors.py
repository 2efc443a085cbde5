"""Errors of pools, backends, wire headers and snapshots."""


class PoolError(Exception):
    """Base of all errors of this library."""


class ConfigError(PoolError, ValueError):
    """A declaration or configuration that is not allowed."""


class InsertError(PoolError):
    """A write that was not made."""


class Conflict(InsertError):
    """A live row holds the id and the policy is to reject."""


class SerializationFailed(InsertError):
    """Bytes did not decode to a row of the model."""


class BackendFailed(InsertError):
    """The backend failed and the policy is to fail with it."""


class Reserved(InsertError):
    """A strict write of the id is under way."""


class FetchError(PoolError):
    """A fetch that gave no rows to the pool."""


class IdentityMismatch(FetchError):
    """A fetcher returned a row of another id than was asked for."""


class FetcherFailed(FetchError):
    """The fetcher raised."""


class BackendError(PoolError):
    """A backend operation failed; ``retryable`` errors may pass by themselves."""

    retryable = False


class NetworkError(BackendError):
    retryable = True


class OtherBackendError(BackendError):
    retryable = True


class NotConfigured(BackendError):
    pass


class CodecError(BackendError):
    pass


class AccessDenied(BackendError):
    pass


class WireFormatError(PoolError):
    """A header or body that cannot be read; ``kind`` names the check."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


class SnapshotError(PoolError):
    """A snapshot that was refused before anything changed."""


class TooManyEntries(SnapshotError):
    pass


class DuplicateId(SnapshotError):
    pass


class JsonValueError(PoolError, ValueError):
    """A value outside the portable JSON domain."""
