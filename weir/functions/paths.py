"""Field paths: `a.b.c`, `"quoted key"`, list positions, `.` for the record, `meta.*` for arrival facts."""

from __future__ import annotations

import re
from dataclasses import dataclass

META_FIELDS = ("id", "tenant", "ingestion_time", "delivery_count")
_BARE = re.compile(r"[A-Za-z0-9_-]+")


class PathError(ValueError):
    """A path that cannot be read, or may not be written."""


@dataclass(frozen=True)
class Path:
    """segments within the record, or the name of one meta field."""

    segments: tuple[str, ...] = ()
    meta: str | None = None

    def __str__(self) -> str:
        if self.meta:
            return f"meta.{self.meta}"
        if not self.segments:
            return "."
        shown = ".".join(s if _BARE.fullmatch(s) else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"' for s in self.segments)
        return "." + shown if self.segments[0] == "meta" else shown


def is_position(segment: str) -> bool:
    """Whether a segment can name a place in a list: digits without a leading zero."""
    return segment.isascii() and segment.isdigit() and (segment == "0" or segment[0] != "0")


def scan(text: str, start: int = 0) -> tuple[Path, int]:
    """The path that begins at start, and where it ends."""
    at, segments, dotted = start, [], text[start : start + 1] == "."
    if dotted:
        at += 1
        if not _BARE.match(text, at) and text[at : at + 1] != '"':
            return Path(), at
    quoted_first = text[at : at + 1] == '"'
    while True:
        if text[at : at + 1] == '"':
            at += 1
            out = []
            while text[at : at + 1] != '"':
                if text[at : at + 1] == "\\":
                    at += 1
                    if text[at : at + 1] not in ('"', "\\"):
                        raise PathError(f'only \\" and \\\\ are escapes in a quoted segment (at offset {at})')
                if at >= len(text):
                    raise PathError(f"unterminated quote starting at offset {start}")
                out.append(text[at])
                at += 1
            at += 1
            segments.append("".join(out))
        elif found := _BARE.match(text, at):
            segments.append(found[0])
            at = found.end()
        else:
            raise PathError("empty path segment" if at >= len(text) or text[at] in ". \t" else f"`{text[at]}` needs quotes in a path")
        if text[at : at + 1] == "[":
            inside = text[at + 1 : text.find("]", at)].strip("\"'") if "]" in text[at:] else ""
            step = inside if _BARE.fullmatch(inside) else f'"{inside}"'
            raise PathError("a path has dots only" + (f", as in `{text[start:at]}.{step}`" if inside else ""))
        if text[at : at + 1] != ".":
            break
        at += 1
    if not dotted and not quoted_first and segments[0] == "meta":
        if len(segments) != 2 or segments[1] not in META_FIELDS:
            raise PathError(f"`{text[start:at]}` is no meta field; they are " + ", ".join(f"`meta.{m}`" for m in META_FIELDS))
        return Path(meta=segments[1]), at
    return Path(tuple(segments)), at


def parse(text: str) -> Path:
    if not isinstance(text, str) or not text:
        raise PathError("a path is a text that is not empty")
    path, end = scan(text)
    if end != len(text):
        raise PathError(f"`{text[end]}` needs quotes in a path")
    return path


def parse_target(text: str) -> Path:
    """A path that is written or removed."""
    path = parse(text)
    if path.meta:
        raise PathError(f"`{path}` tells of the arrival, which stages only read; a copy of it in the record can be changed")
    return path


def get(record: object, path: Path) -> object:
    """The value at a path of a JSON value; None where nothing is."""
    for s in path.segments:
        if isinstance(record, dict):
            record = record.get(s)
        elif isinstance(record, list) and is_position(s) and int(s) < len(record):
            record = record[int(s)]
        else:
            return None
    return record


def put(record: object, path: Path, value: object) -> object:
    """The record with value at path. What stands in the way (a scalar, or a list without that place) becomes an object."""
    if not path.segments:
        return value
    head, rest = path.segments[0], Path(path.segments[1:])
    if isinstance(record, list) and is_position(head) and int(head) < len(record):
        return [put(x, rest, value) if k == int(head) else x for k, x in enumerate(record)]
    record = dict(record) if isinstance(record, dict) else {}
    record[head] = put(record.get(head), rest, value)
    return record


def remove(record: object, path: Path) -> object:
    """The record without what is at path; a list closes the gap, the whole record becomes null."""
    if not path.segments:
        return None
    head, rest = path.segments[0], Path(path.segments[1:])
    if isinstance(record, list) and is_position(head) and int(head) < len(record):
        return [remove(x, rest) if k == int(head) else x for k, x in enumerate(record) if rest.segments or k != int(head)]
    if isinstance(record, dict) and head in record:
        return {k: remove(v, rest) if k == head else v for k, v in record.items() if rest.segments or k != head}
    return record
