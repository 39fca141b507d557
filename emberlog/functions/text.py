"""Texts of log records: escapes, first lines, normal forms, fingerprints."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.severity import ERROR, severity_name, trimmed

# Terminal escapes whole (also unterminated ones), and the SGR sequence that turns text red.
ANSI = r"\x1b(?:\[[^@-~]*(?:[@-~]|\z)|[^\[]|\z)"
ANSI_RED = r"\A\x1b\[(?:[^@-~]*;)?(?:31|91)(?:;[^@-~]*)?m\z"
CSI = r"\x1b\[[0-?]*[ -/]*[@-~]"
PANIC = r"\A[ \t]*(?:panic:|fatal error:)"

#: What varies between messages of one kind, in the order in which it is replaced, and whether
#: it must be whole words. Long decimal runs go before hexadecimal ones, so that those need a letter.
VOLATILE = (
    ("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>", True),
    ("(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)", "<ip>", True),
    ("[0-9]{8,}", "<n>", True),
    ("[0-9a-fA-F]{8,}", "<hex>", True),
    ('"[^"]*"|`[^`]*`', "<str>", False),
    ("[0-9]+", "<n>", True),
)
# Word boundaries are ASCII.
_START, _END = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"

EXCEPTION_KEYS = ("exception.type", "exception.message", "exception.stacktrace")
#: Attribute that sets the grouping of an event outright.
FINGERPRINT_KEY = "emberlog.fingerprint"


def strip_ansi(col: Column) -> Column:
    """Without terminal escapes: whole sequences, bare ESC and byte, unterminated ends."""
    return F.regexp_replace(col, ANSI, "")


def ansi_red(col: Column) -> Column:
    """True if an escape in the text sets the colour red (31) or bright red (91)."""
    return F.exists(F.regexp_extract_all(col, F.lit(f"({ANSI})"), F.lit(1)), lambda s: s.rlike(ANSI_RED))


def strip_csi(col: Column) -> Column:
    """Without complete CSI sequences; a lone ESC stays."""
    return F.regexp_replace(col, CSI, "")


def first_line(col: Column) -> Column:
    return F.substring_index(col, "\n", 1)


def truncated(col: Column, n: int) -> Column:
    """At most ``n`` characters, then a marker with the true length."""
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("… ["), F.length(col).cast("string"), F.lit(" chars]"))).otherwise(col)


def attr(attrs: Column | Mapping[str, Column], key: str) -> Column:
    """An attribute's value, empty if absent; of a map column, or of columns that hold single attributes."""
    if isinstance(attrs, Mapping):
        return attrs[key]
    return F.coalesce(F.try_element_at(attrs, F.lit(key)), F.lit(""))


def normalize_message(col: Column) -> Column:
    for pattern, replacement, words in VOLATILE:
        col = F.regexp_replace(col, f"{_START}{pattern}{_END}" if words else pattern, replacement)
    return col


def is_event(severity: Column, attrs: Column | None = None) -> Column:
    """ERROR or worse, or an exception attribute that is not empty."""
    out = severity >= ERROR
    for key in EXCEPTION_KEYS if attrs is not None else ():
        out = out | (attr(attrs, key) != "")
    return out


def title(body: Column, attrs: Column | None = None) -> Column:
    """The first line, trimmed, after the exception's type; at most 200 characters."""
    line = trimmed(first_line(body))
    if attrs is not None:
        kind = attr(attrs, "exception.type")
        line = F.when(kind == "", line).when(line == "", kind).otherwise(F.concat(kind, F.lit(": "), line))
    return F.substring(line, 1, 200)


def fingerprint(project_id: Column, severity: Column, body: Column, attrs: Column | None = None, key: str = FINGERPRINT_KEY) -> Column:
    """16 hexadecimal digits that group events: by the override attribute, else exception type and message, else severity and first line; project by project."""
    label, line = severity_name(severity), first_line(body)
    if attrs is not None:
        # One of the two texts is brought to normal form, so that the patterns are in the plan once.
        kind = attr(attrs, "exception.type")
        label, line = F.when(kind != "", kind).otherwise(label), F.when(kind != "", attr(attrs, "exception.message")).otherwise(line)
    material = F.concat(label, F.lit("|"), normalize_message(line))
    if attrs is not None:
        own = attr(attrs, key)
        material = F.when(own != "", own).otherwise(material)
    return F.substring(F.sha2(F.concat(project_id.cast("string"), F.lit("|"), material), 256), 1, 16)
