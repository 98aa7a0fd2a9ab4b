"""Error classes; context values whose names suggest credentials are masked."""

from __future__ import annotations

#: Parts of names whose values are masked.
SECRET_NAMES = ("key", "token", "secret", "password", "passwd", "authorization", "auth", "bearer", "credential", "cookie", "session")
MASK = "***redacted***"


class FolioError(Exception):
    """Base class: a message and named context."""

    def __init__(self, message: str, **context: object):
        self.message = message
        self.context = {k: MASK if any(s in k.lower() for s in SECRET_NAMES) else v for k, v in context.items()}
        shown = ", ".join(f"{k}={v!r}" for k, v in sorted(self.context.items()))
        super().__init__(f"{message} ({shown})" if shown else message)


class ConfigError(FolioError, ValueError):
    """A setting or argument is wrong."""


class LoaderError(FolioError):
    """A source can't be read."""


class ChunkingError(FolioError):
    """A document can't be cut into chunks."""


class EmbeddingError(FolioError):
    """Vectors are missing or malformed."""


class StoreError(FolioError):
    """Tables disagree or are missing."""


class ModelMismatch(StoreError):
    """The index was built with another model."""


class RetrievalError(FolioError):
    """A ranking can't be completed."""


class RerankError(FolioError):
    """A reranker failed."""


class QueryTransformError(FolioError):
    """A query transform failed."""


class GenerationError(FolioError):
    """An answer can't be generated."""


class EvaluationError(FolioError):
    """Gold data or metrics are unusable."""


class ProviderError(FolioError):
    """A hosted service failed."""


class AuthError(ProviderError):
    """A service refused the credentials."""


class RateLimitError(ProviderError):
    """A service asked to slow down."""

    def __init__(self, message: str, *, retry_after: float | None = None, **context: object):
        super().__init__(message, retry_after=retry_after, **context)
        self.retry_after = retry_after


class TransientError(ProviderError):
    """A failure that may pass."""


class QuotaExhausted(ProviderError):
    """A daily allowance is spent."""
