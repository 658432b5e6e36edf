"""Exceptions of the engine."""


class RollviewError(Exception):
    """Base of all errors that the engine raises on purpose."""


class SchemaError(RollviewError):
    """A definition is wrong or refers to something unknown."""


class ReducerError(RollviewError):
    """A reducer's code failed."""


class RollbackError(RollviewError):
    """No common ancestor, or one below the finalized head."""


class InvalidOperation(RollviewError):
    """A call that the present state doesn't allow."""


class PendingAck(InvalidOperation):
    """The last batch must be acknowledged first."""


class WrongAckSequence(InvalidOperation):
    """An acknowledgement names another batch than the pending one."""


class Poisoned(InvalidOperation):
    """A commit without changes failed; the engine must be opened again."""
