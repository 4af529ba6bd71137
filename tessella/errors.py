"""Errors of the engine."""


class EngineError(Exception):
    """Any error of the engine; `retryable` says whether running the transaction again may succeed."""

    retryable = False


class NotImplementedFeature(EngineError):
    """A part of SQL that the strict dialect leaves out."""


class GeneralError(EngineError):
    """A statement that can't be carried out: unknown names, wrong types, violated constraints."""


class SqlError(EngineError):
    """Text that isn't a statement."""


class InternalError(EngineError):
    """A failure inside Spark that isn't the statement's fault."""


class IoError(EngineError):
    """A database folder that can't be opened, locked or written."""


class Busy(EngineError):
    """Another transaction has changed the same rows; the transaction is gone, and may be retried."""

    retryable = True


class BusySnapshot(Busy):
    """The snapshot of a transaction is too old to go on from."""
