"""Loading delivered records in bulk, with the records that can't be loaded set apart.

A block of records is parsed at once by Arrow's CSV reader. Where that fails, the block is
halved, and each half that fails again, until the bad records stand alone; only those are
read character by character for their reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame

#: The fields of a manifest record, the words for a missing text, the audio suffix.
FIELDS = ("sample_id", "src_audio", "tgt_audio", "src_text", "tgt_text", "src_lang", "tgt_lang")
MISSING_WORDS = ("na", "n/a", "null", "none", "nan")
AUDIO_SUFFIX = ".wav"

BLOCK = 512
#: One field: quoted with doubled quotes inside, or without any quote.
_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^"\t]*)'


_STRICT_FORM = re.compile(rf"{_FIELD}(?:\t{_FIELD}){{{len(FIELDS) - 1}}}")


def split_strictly(line: str) -> list[str] | None:
    """The fields of one record, or None where its quoting is broken."""
    out, at, n = [], 0, len(line)
    while True:
        if line.startswith('"', at):
            parts, at = [], at + 1
            while True:
                end = line.find('"', at)
                if end < 0:
                    return None
                parts.append(line[at:end])
                at = end + 1
                if line.startswith('"', at):
                    parts.append('"')
                    at += 1
                else:
                    break
            if at < n and line[at] != "\t":
                return None
            out.append("".join(parts))
        else:
            end = line.find("\t", at)
            end = n if end < 0 else end
            if '"' in line[at:end]:
                return None
            out.append(line[at:end])
            at = end
        if at >= n:
            return out
        at += 1


def value_reason(src_audio: str, src_text: str, tgt_text: str) -> str | None:
    for text in (src_text, tgt_text):
        if "\ufffd" in text or text.strip().lower() in MISSING_WORDS or not any(c.isalpha() for c in text):
            return "value"
    return None if src_audio.lower().endswith(AUDIO_SUFFIX) else "value"


def diagnose(line: str | None) -> tuple[list[str] | None, str | None]:
    """(fields, None) of a loadable record, else (None, the first reason that holds)."""
    line = line or ""
    fields = split_strictly(line[:-1] if line.endswith("\r") else line)
    if fields is None:
        return None, "quoting"
    if len(fields) != len(FIELDS):
        return None, "column_count"
    reason = value_reason(fields[1], fields[3], fields[4])
    return (None, reason) if reason else (fields, None)


_OPTIONS = {
    "parse_options": pacsv.ParseOptions(delimiter="\t", quote_char='"', double_quote=True, newlines_in_values=True, ignore_empty_lines=False),
    "convert_options": pacsv.ConvertOptions(column_types={f: pa.string() for f in FIELDS}, strings_can_be_null=False, quoted_strings_can_be_null=False),
}


def _bulk(lines: pa.Array) -> list[pa.Array] | None:
    """All fields of a block of records by the fast reader, or None where the block fails.

    The reader forgives misplaced quotes, so a block that it has read must also have the
    strict form as a whole.
    """
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(lines)], lines), "\n")[0].as_buffer()
    try:
        parsed = pacsv.read_csv(pa.BufferReader(joined), pacsv.ReadOptions(column_names=list(FIELDS), use_threads=False, block_size=joined.size + 1), **_OPTIONS)
    except pa.ArrowInvalid:
        return None
    if parsed.num_rows != len(lines):
        return None
    quoted = lines.filter(pc.match_substring(lines, '"')).to_pylist()
    if not all(map(_STRICT_FORM.fullmatch, quoted)):
        return None
    return [c.combine_chunks() for c in parsed.columns]


def _usable(columns: list[pa.Array]) -> pa.Array:
    ok = pc.ends_with(pc.utf8_lower(columns[1]), AUDIO_SUFFIX)
    for k in (3, 4):
        ok = pc.and_(ok, pc.match_substring_regex(columns[k], r"\pL"))
        ok = pc.and_(ok, pc.invert(pc.match_substring(columns[k], "\ufffd")))
        ok = pc.and_(ok, pc.invert(pc.is_in(pc.utf8_lower(pc.utf8_trim_whitespace(columns[k])), value_set=pa.array(MISSING_WORDS))))
    return ok


@dataclass
class Loader:
    """Parses blocks; ``block`` is the size to try next, ``strict`` the records read strictly so far."""

    block: int = BLOCK
    largest: int = BLOCK
    strict: int = 0

    def load(self, lines: pa.Array) -> tuple[list[list[str | None]], list[str | None]]:
        """Columns of fields (null where the record is bad) and the reasons, in the order of ``lines``.

        A block is parsed as a whole. One that fails is halved, and so is each failing half,
        until single records are left; only those, and records of a parsed block with an
        unusable value, are read strictly. Blocks grow while they parse and shrink as they
        fail, so that few records are parsed often, whatever the share of bad ones.
        """
        n = len(lines)
        columns: list[list[str | None]] = [[None] * n for _ in FIELDS]
        reasons: list[str | None] = [None] * n

        def strictly(k: int) -> None:
            self.strict += 1
            fields, reasons[k] = diagnose(lines[k].as_py())
            for column, value in zip(columns, fields or [None] * len(columns)):
                column[k] = value

        def clean(at: int, size: int, failed: bool = False) -> bool:
            """Parse a block; halve it if it fails, or is known to. Whether all of it was parsed at once."""
            parsed = None if failed else _bulk(lines.slice(at, size))
            if parsed is not None:
                for column, values in zip(columns, parsed):
                    column[at : at + size] = values.to_pylist()
            elif size == 1:
                strictly(at)
            else:
                # If the first half is clean, the fault is in the second.
                first = clean(at, size // 2)
                clean(at + size // 2, size - size // 2, failed=first)
            return parsed is not None

        begin = 0
        while begin < n:
            size = min(self.block, n - begin)
            whole = clean(begin, size)
            begin += size
            self.block = min(self.largest, self.block * 2) if whole else max(1, self.block // 2)
        unusable = pc.fill_null(pc.invert(_usable([pa.array(c, pa.string()) for c in columns])), False)
        for k in pc.indices_nonzero(unusable).to_pylist():
            strictly(k)
        return columns, reasons


def parse_records(records: DataFrame, key: str, line: str, block: int = BLOCK) -> DataFrame:
    """(key, the seven fields, reason): ``reason`` is null for a record that was loaded.

    A null line is read as an empty one and fails for its column count. Other columns of
    ``records`` are ignored; join them by ``key``.
    """
    kind = records.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loader = Loader(block, block)
        for batch in batches:
            lines = pc.replace_substring_regex(pc.fill_null(batch.column(1), "").cast(pa.string()), r"\r\z", "")
            columns, reasons = loader.load(lines)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns), pa.array(reasons, pa.string())], [key, *FIELDS, "reason"])

    schema = f"`{key}` {kind}, " + ", ".join(f"{f} string" for f in (*FIELDS, "reason"))
    return records.select(key, line).mapInArrow(parse, schema)


def loaded(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason is null").drop("reason")


def rejected(parsed: DataFrame, key: str) -> DataFrame:
    return parsed.filter("reason is not null").select(key, "reason")
