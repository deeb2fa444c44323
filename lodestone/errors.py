"""Errors of the engine; ``error_type`` columns hold these names."""


class EngineError(Exception):
    """Base of all errors here."""


class ConfigError(EngineError):
    pass


class ServiceUnavailableError(EngineError):
    pass


class ConversionError(EngineError):
    pass


class ConversionTimeoutError(ConversionError):
    pass


class CorruptedDocumentError(ConversionError):
    pass


class ChunkingError(EngineError):
    pass


class EmbeddingError(EngineError):
    pass


class StorageError(EngineError):
    pass


class RetrievalError(EngineError):
    pass


class AnswerError(EngineError):
    pass


class SourceError(EngineError):
    pass


class SyncError(EngineError):
    pass


#: By name: whether a failure of this type is tried again.
RETRYABLE = ("ConversionTimeoutError", "ServiceUnavailableError", "RetrievalError", "EmbeddingError", "StorageError")
FINAL = ("ConfigError", "ConversionError", "CorruptedDocumentError")
