"""Coded errors raised by argument checks on the driver."""


class QueryError(ValueError):
    """A request that cannot be answered; ``code`` is stable, the message is for people."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
        self.message = message
