"""Named failures."""


class TableError(ValueError):
    """A rejected input or request, with a machine-readable ``code``.

    Codes: NO_TABULAR_DATA, CORRUPTED_FILE, UNSUPPORTED_FILE_TYPE, EMPTY_DATASET,
    TOO_MANY_COLUMNS, PARSE_ERROR, UNKNOWN_COLUMN, UNKNOWN_OPERATION, UNKNOWN_OPERATOR.
    """

    def __init__(self, message: str, code: str):
        super().__init__(message)
        self.code = code
