"""Errors with the stable code string that tools can match on."""

from __future__ import annotations


class RecordError(ValueError):
    """Base of all errors of the engine; `code` names the family."""

    code = "ERR_GENERIC"
    exit_code = 1


class BadMagic(RecordError):
    code, exit_code = "ERR_BAD_MAGIC", 3


class OutOfBounds(RecordError, IndexError):
    code, exit_code = "ERR_OUT_OF_BOUNDS", 3


class DictMismatch(RecordError):
    code, exit_code = "ERR_DICT_MISMATCH", 3


class InvalidPageMagic(RecordError):
    code, exit_code = "ERR_INVALID_PAGE_MAGIC", 3


class IncompatibleFlags(RecordError):
    code, exit_code = "ERR_INCOMPATIBLE_FLAGS", 3


class UnsupportedField(RecordError):
    code, exit_code = "ERR_UNSUPPORTED_FIELD_TYPE", 3


class UnsupportedLayout(RecordError):
    code, exit_code = "ERR_UNSUPPORTED_LAYOUT", 2


class ParseFailure(RecordError):
    code, exit_code = "ERR_PARSE", 2


class DepthLimit(ParseFailure):
    code = "ERR_RECURSION_LIMIT"


class MacroUnresolved(ParseFailure):
    code = "ERR_MACRO_UNRESOLVED"


class ListTypeMismatch(ParseFailure):
    code = "ERR_LIST_TYPE_MISMATCH"


class Overflow(RecordError):
    code, exit_code = "ERR_OVERFLOW", 3


class SchemaConflict(RecordError):
    code, exit_code = "ERR_SCHEMA_CONFLICT", 4
