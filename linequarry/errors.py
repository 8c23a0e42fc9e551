"""The one exception type of the query language; ``code`` is stable, the text is for people."""


class QueryError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code
