"""Page records as YAML text: written and cut out with built-in expressions, parsed with PyYAML in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..schemas import schema
from .text import strip

RESPONSE = "primary_language string, is_rotation_valid boolean, rotation_correction int, is_table boolean, is_diagram boolean, natural_text string"
# A record's fields.
_TEXT = "natural_text"
FIELDS = ("primary_language", "is_rotation_valid", "rotation_correction", "is_table", "is_diagram")


def _flag(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


def format_yaml(text: Column, lang: Column, is_table: Column, is_diagram: Column, rotation_valid: Column | None = None, rotation: Column | None = None, document_id: Column | None = None) -> Column:
    """A page record with its text as a block of lines indented by two spaces; lines of white space only stay as they are."""
    block = F.regexp_replace(text, r"(?m)^(?=[^\n]*[^\s])", "  ")
    parts = [F.lit("primary_language: "), lang, F.lit("\nis_rotation_valid: "), _flag(F.lit(True) if rotation_valid is None else rotation_valid), F.lit("\nrotation_correction: "), (F.lit(0) if rotation is None else rotation).cast("string"), F.lit("\nis_table: "), _flag(is_table), F.lit("\nis_diagram: "), _flag(is_diagram), F.lit("\nnatural_text: |\n"), block]
    if document_id is not None:
        parts = [F.lit("document_id: "), document_id, F.lit("\n"), *parts]
    return F.concat(*parts)


def natural_text_of(c: Column) -> Column:
    """The text block of a YAML answer up to the next unindented line, two spaces off its lines; without one, the whole answer."""
    block = F.regexp_extract(c, r"(?s)natural_text:\s*\|\n(.*?)(?:\n\S|\z)", 1)
    found = c.rlike(r"(?s)natural_text:\s*\|\n")
    return F.when(found, strip(F.regexp_replace(block, r"(?m)^  ", ""))).otherwise(strip(c))


# Fixed value: how an answer fences its record.
_FENCED = r"(?s)```(?:yaml)?\s*\n(.*?)```"


def yaml_of_completion(c: Column) -> Column:
    """The record in a model's answer: without <think> blocks, a fenced block that names natural_text, else everything
    from primary_language: on, else null."""
    said = strip(F.regexp_replace(strip(c), r"(?s)<think>.*?</think>", ""))
    names_text = lambda x: F.contains(x, F.lit("natural_text:"))
    after = F.get(F.split(said, "primary_language:", 2), F.lit(1))  # null where it isn't named
    tail = strip(F.concat(F.lit("primary_language:"), after))
    record = F.when(F.endswith(tail, F.lit("```")), strip(F.left(tail, F.length(tail) - 3))).otherwise(tail)
    candidates = F.array(strip(F.regexp_extract(said, _FENCED, 1)), F.when(names_text(said), record))
    return F.when(names_text(F.get(candidates, F.lit(0))), F.get(candidates, F.lit(0))).otherwise(F.get(candidates, F.lit(1)))


def valid_page(c: Column) -> Column:
    """Whether a YAML page has a text field at all."""
    return c.isNotNull() & F.contains(c, F.lit("natural_text:"))


#: The C loader is some ten times faster where it was built in.
_Loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def _load(raw: str) -> object:
    """A bare word that names a language stays a string (`no` isn't false)."""
    parsed = yaml.load(raw, _Loader)  # noqa: S506  a safe loader
    if isinstance(parsed, dict) and isinstance(parsed.get("primary_language"), bool):
        named = re.search(r"(?m)^primary_language:[ \t]*(\S+)", raw)
        parsed["primary_language"] = named[1].strip("'\"") if named else None
    return parsed


def _truth(x: object, other: bool) -> bool:
    if x is None:
        return other
    return x.strip().lower() in ("true", "yes", "on", "1") if isinstance(x, str) else bool(x)


def _whole(x: object) -> int:
    try:
        return int(x or 0)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return 0


def _record(parsed: dict) -> tuple:
    lang, text = parsed.get("primary_language"), parsed.get("natural_text")
    return (None if lang is None else str(lang), _truth(parsed.get("is_rotation_valid"), True), _whole(parsed.get("rotation_correction")), _truth(parsed.get("is_table"), False), _truth(parsed.get("is_diagram"), False), None if text is None else str(text))


def parse_answer(raw: str | None) -> tuple:
    """A model's answer: YAML with a text field, else the YAML in its fence, else all of it as text."""
    if raw is None:
        return (None,) * 6
    fence = re.search(r"```(?:ya?ml)?\s*\n(.*?)```", raw, re.DOTALL)
    for part in (raw, fence[1] if fence else None):
        if part is None:
            continue
        try:
            parsed = _load(part)
        except (yaml.YAMLError, ValueError, RecursionError):
            continue
        if isinstance(parsed, dict) and "natural_text" in parsed:
            return _record(parsed)
    return None, True, 0, False, False, raw


def _scan(raw: str) -> dict:
    """What a broken page still says: its lines are read one by one, as a field, as part of the open text block, or as noise."""
    said: dict[str, str] = {}
    block: list[str] | None = None
    lines = iter(raw.split("\n"))
    for line in lines:
        name, colon, value = line.partition(":")
        if block is not None and line[:2] == "  " and len(line) > 2:
            block.append(line)
        elif block is not None:  # the block is over; a second one isn't read
            said.setdefault(_TEXT, _left_aligned(block))
            block = None
        if colon and name in FIELDS and value.strip():
            said.setdefault(name, value.strip())
        elif colon and name == _TEXT and value.strip() == "|" and _TEXT not in said:
            block = []
    if block is not None:
        said.setdefault(_TEXT, _left_aligned(block))
    return said


def _left_aligned(lines: list[str]) -> str:
    least = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    return "\n".join(x[least:] if x.strip() else "" for x in lines).strip()


def parse_page(raw: str | None) -> tuple:
    """A stored page: YAML, or where that is broken the fields line by line and the text block; (fields, error)."""
    if raw is None or not raw.strip():
        return (*(None,) * 6, "empty page")
    try:
        parsed = _load(raw)
    except (yaml.YAMLError, ValueError, RecursionError):
        parsed = _scan(raw)
    if not isinstance(parsed, dict):
        return (*(None,) * 6, "not a record")
    return (*_record(parsed), None)


#: Characters of answers that are parsed before their records are handed on (one answer at least).
AT_ONCE = 1 << 20


def _parsed(batches: Iterator[pa.Array], parse: Callable[[str | None], tuple], kind: T.StructType) -> Iterator[pa.Array]:
    """The records of all texts, some at a time, so that a batch's texts and records never stand side by side as objects."""
    made = to_arrow_type(kind)
    for batch in batches:
        rows: list[tuple] = []
        room = AT_ONCE
        for x in batch:
            raw = x.as_py()
            rows.append(parse(raw))
            room -= len(raw or "")
            if room <= 0:
                yield _records(rows, made)
                rows, room = [], AT_ONCE
        if rows or not len(batch):
            yield _records(rows, made)


def _records(rows: list[tuple], kind: pa.StructType) -> pa.Array:
    columns = zip(*rows, strict=True) if rows else [()] * kind.num_fields
    return pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))


@F.arrow_udf(schema(RESPONSE))
def parse_response(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _parsed(batches, parse_answer, schema(RESPONSE))


@F.arrow_udf(schema(RESPONSE + ", error string"))
def parse_yaml_page(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _parsed(batches, parse_page, schema(RESPONSE + ", error string"))
