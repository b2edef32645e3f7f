"""Errors that the engine raises."""


class EngineError(Exception):
    """Anything that makes a statement fail."""


class ParseError(EngineError):
    """The text is not in the dialect."""


class ConstraintError(EngineError):
    """A row breaks NOT NULL, UNIQUE, CHECK, a foreign key or a declared size."""


class Signal(EngineError):
    """SIGNAL SQLSTATE."""

    def __init__(self, state: str, message: str | None):
        super().__init__(message or f"SQLSTATE {state}")
        self.state = state


class ConflictError(EngineError):
    """Another session has changed the catalog since this one read it; run the statement or transaction again."""
