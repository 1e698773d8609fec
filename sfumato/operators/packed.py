"""Several values packed in one field: one row a value with its position.

Quoted spans become indexed placeholders, the brackets around the whole list go, what remains is split at delimiters, and
the placeholders are replaced by array look-up.  Each step is one pass over the field, whatever its length, number of quotes
or depth of brackets.  Fields travel in Arrow batches; equal fields of a batch are split once, and the items of all rows are
gathered by index.

Placeholders are an index between two private-use characters.  Those characters are themselves treated as spans where
a text holds them, so no text can collide with a placeholder.

Defined results: NULL, empty and blank fields and empty brackets give no row; delimiters are commas (also full-width and
ideographic), semicolons, bars, slashes, and runs of white space; white space beside another delimiter belongs to it; an
empty place counts as a place but gives no row; a quote opens a span only at the beginning of a value and closes it
before a delimiter, a closing bracket or the end; a doubled quote inside is one quote mark; a quote without an end is
ordinary text; equal values at different
places are different rows; rows repeated in the input are repeated in the output.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPEN, _CLOSE = chr(0xE000), chr(0xE001)
#: Unicode's white space.
_BLANKS = "\t\n\v\f\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_MARKS = ",;|/" + chr(0xFF0C) + chr(0x3001)
_PAIRS = {"[": "]", "(": ")", "{": "}"}
_CLOSERS = {c: o for o, c in _PAIRS.items()}

_SPAN = re.compile(rf"""(?:(?<=[{re.escape(_MARKS + _BLANKS)}\[({{])|^)["']|[{_OPEN}{_CLOSE}]""")
_BRACKET = re.compile(r"[\[\](){}]")
_DELIMITER = re.compile(rf"[{_BLANKS}]*+[{re.escape(_MARKS)}][{_BLANKS}]*+|[{_BLANKS}]++")
_NUMBER = re.compile(rf"{_OPEN}(\d+){_CLOSE}")
_AFTER = frozenset(["", *_MARKS, *_BLANKS, *_CLOSERS])


def _span_end(text: str, at: int) -> int:
    """Place after the quote that ends the span begun at `at`; -1 if none does."""
    quote, k = text[at], text.find(text[at], at + 1)
    while k >= 0:
        after = text[k + 1 : k + 2]
        if after == quote:
            k += 1
        elif after in _AFTER:
            return k + 1
        k = text.find(quote, k + 1)
    return -1


def _own_run_end(text: str, at: int) -> int:
    """The same where no quote past the run of quotes begun at `at` ends a span."""
    end = at
    while text[end : end + 1] == text[at]:
        end += 1
    return end if (end - at) % 2 == 0 and text[end : end + 1] in _AFTER else -1


def _with_placeholders(text: str) -> tuple[str, list[str]]:
    """(text with placeholders, spans without their quoting)."""
    out, spans, at = [], [], 0
    endless: set[str] = set()  # a quote whose search reached the end closes nothing later but its own run
    found = _SPAN.search(text)
    while found:
        i, ch = found.start(), found[0]
        if ch in (_OPEN, _CLOSE):
            end, value = i + 1, ch
        else:
            end = _own_run_end(text, i) if ch in endless else _span_end(text, i)
            if end < 0:
                endless.add(ch)
                end, value = i + 1, None
            else:
                value = text[i + 1 : end - 1].replace(ch + ch, ch)
        if value is None:
            out.append(text[at:end])
        else:
            out += (text[at:i], f"{_OPEN}{len(spans)}{_CLOSE}")
            spans.append(value)
        at = end
        found = _SPAN.search(text, at)
    out.append(text[at:])
    return "".join(out), spans


def _without_brackets(text: str) -> str:
    """Without the brackets around the whole list, however many."""
    text = text.strip(_BLANKS)
    if text[:1] not in _PAIRS or text[-1:] not in _CLOSERS:
        return text
    partner: dict[int, int] = {}
    unmatched: dict[str, list[int]] = {o: [] for o in _PAIRS}
    for m in _BRACKET.finditer(text):
        if m[0] in _PAIRS:
            unmatched[m[0]].append(m.start())
        elif unmatched[_CLOSERS[m[0]]]:
            partner[unmatched[_CLOSERS[m[0]]].pop()] = m.start()
    lo, hi = 0, len(text)
    while hi - lo > 1 and partner.get(lo) == hi - 1:
        lo, hi = lo + 1, hi - 1
        while lo < hi and text[lo] in _BLANKS:
            lo += 1
        while lo < hi and text[hi - 1] in _BLANKS:
            hi -= 1
    return text[lo:hi]


def split_field(text: str) -> list[tuple[int, str]]:
    """(position, value) of one field."""
    text, spans = _with_placeholders(text)
    out = []
    for k, part in enumerate(_DELIMITER.split(_without_brackets(text)), 1):
        if spans and _OPEN in part:
            part = _NUMBER.sub(lambda m: spans[int(m[1])], part)
        if part := part.strip(_BLANKS):
            out.append((k, part))
    return out


#: Fields up to this length are remembered between batches; the cache's memory is bounded by the two numbers.
_REMEMBERED = 200


@lru_cache(maxsize=20_000)
def _remembered(text: str) -> list[tuple[int, str]]:
    return split_field(text)


def split_packed(df: DataFrame, keys: list[str], field: str, item: str = "item", pos: str = "pos") -> DataFrame:
    """keys, pos (from 1) and item of each value in a field."""
    src = df.select(*keys, F.col(field).cast("string").alias("_f")).where(F.col("_f").isNotNull() & (F.col("_f") != ""))
    schema = T.StructType([*(src.schema[k] for k in keys), T.StructField(pos, T.IntegerType()), T.StructField(item, T.StringType())])
    at = len(keys)

    def run(batches):
        for batch in batches:
            codes = batch.column(at).dictionary_encode()
            got = [_remembered(f) if len(f) <= _REMEMBERED else split_field(f) for f in codes.dictionary.to_pylist()]
            sizes = np.array([len(g) for g in got], np.int64)
            begins = np.cumsum(sizes) - sizes
            places = pa.array([p for g in got for p, _ in g], pa.int32())
            items = pa.array([v for g in got for _, v in g], pa.string())
            field_no = codes.indices.to_numpy(zero_copy_only=False)
            many = sizes[field_no]
            row = np.repeat(np.arange(batch.num_rows), many)
            within = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            take = pa.array(begins[field_no[row]] + within)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(row) for i in range(at)), places.take(take), items.take(take)], names=schema.names)

    return src.mapInArrow(run, schema)
