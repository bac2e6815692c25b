"""Failures by kind; `code` is what a strict expression raises inside a query."""


class RasterError(Exception):
    code = "UNKNOWN"


class NotImplementedYet(RasterError):
    code = "NOT_IMPLEMENTED"


class InvalidArgument(RasterError):
    code = "INVALID_ARGUMENT"


class OutOfRange(RasterError):
    code = "OUT_OF_RANGE"


class NotFound(RasterError):
    code = "NOT_FOUND"
