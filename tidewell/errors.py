"""Errors, one class for each kind."""


class EngineError(Exception):
    """Base of all errors raised here."""

    status = 500


class ConfigError(EngineError):
    status = 400


class NotFoundError(EngineError):
    status = 404


class UnsupportedLanguageError(EngineError):
    status = 400


class ParseError(EngineError):
    status = 400


class EmbeddingError(EngineError):
    pass


class DimensionError(EngineError):
    status = 400


class StorageError(EngineError):
    pass


class ReadOnlyError(StorageError):
    status = 400


class RetrievalError(EngineError):
    pass


class NotImplementedYet(EngineError):
    status = 501
