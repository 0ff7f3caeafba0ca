"""Errors of metadata and decoding, each with a numeric code."""

from __future__ import annotations

from enum import IntEnum


class Code(IntEnum):
    # The format's tools exchange these numbers.
    OK = 0
    ERROR = -1
    INTERNAL = -2
    OUT_OF_MEMORY = -3
    NOT_FOUND = -4
    JSON_PARSE_ERROR = -5
    JSON_ERROR = -6
    JSON_WRONG_TYPE = -7
    JSON_NOT_GTEZ = -8
    JSON_NOT_GTZ = -9
    INVALID_ALIGNMENT = -10
    INVALID_BYTE_ORDER = -11
    INVALID_BIT_ORDER = -12
    INVALID_RANGE = -13
    INVALID_RANGE_SET = -14
    INVALID_UUID = -15
    INVALID_FIELD_LOCATION = -16
    INVALID_FIELD_CLASS = -17
    INVALID_FLAGS = -18
    INVALID_ROLE = -19
    INVALID_BASE = -20
    UNSUPPORTED_LENGTH = -21
    INVALID_ENCODING = -22
    INVALID_ENVIRONMENT = -23
    INVALID_VARIANT = -24
    CYCLES_GTE_FREQUENCY = -25
    NO_SUCH_ALIAS = -26
    MISSING_PROPERTY = -27
    UNSUPPORTED_EXTENSION = -28
    NO_SUCH_ORIGIN = -29
    NO_DEFAULT_CLOCK = -30
    INVALID_UUID_ROLE = -31
    INVALID_MAGIC_ROLE = -32
    NOT_A_STRUCT = -33
    DUPLICATE = -34
    NO_SUCH_ID = -35
    UNSUPPORTED_VERSION = -36
    NO_PREAMBLE = -37
    WRONG_FIELD_TYPE = -38
    MISSING_FIELD_LOCATION = -39
    NOT_ENOUGH_BITS = -40
    MID_BYTE_ORDER_CHANGE = -41
    INVALID_STRING_LENGTH = -42
    MAGIC_MISMATCH = -43
    UUID_MISMATCH = -44
    NO_SELECTOR_FIELD = -45
    INVALID_CONTENT_LENGTH = -46
    INVALID_METADATA_PACKET = -47


def describe(code: int) -> str:
    """What a code stands for, in words."""
    try:
        return Code(code).name.lower().replace("_", " ")
    except ValueError:
        return "unknown error"


class TraceError(Exception):
    """An error with its code; context is put before the message on the way up."""

    def __init__(self, code: Code, message: str = ""):
        super().__init__(code, message)
        self.code, self.message = code, message or describe(code)

    def within(self, context: str) -> TraceError:
        return TraceError(self.code, f"{context}: {self.message}")

    def __str__(self) -> str:
        return f"{self.message} ({self.code.name})"
