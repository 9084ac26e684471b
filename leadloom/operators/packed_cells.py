"""Several values packed in one cell, split over Arrow string buffers.

A batch is handled as one byte array. Masks over all its bytes mark quotes and delimiters; running counts of the quote mask
give each byte's quote parity; the delimiters outside quotes give the child offsets; child spans are trimmed by moving their
two ends over whole arrays. The bytes left are the values of an Arrow list array, which the parent ordinals flatten into rows.
Python touches single values only where a quoted value holds an escape.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells that say "nothing", in lower case.
NOTHING = ("-", "--", "–", "—", "n/a", "na", "none", "null", "nil", "nan", "[]", "{}", "()", "?")


@dataclass(frozen=True)
class PackedField:
    """How a field's values may be written.

    labels: values may begin with one of these words and a colon; a comma or spaced slash then delimits only before such a label,
    as both also occur within values. atomic: values never hold blanks (addresses, links) and hold some letter or digit; so blanks delimit too, and a lone mark is
    none.
    """

    name: str
    labels: tuple[str, ...] = ()
    atomic: bool = False


def _shifted(mask: np.ndarray, by: int) -> np.ndarray:
    """mask moved so that position i tells of i + by."""
    out = np.zeros_like(mask)
    if abs(by) >= len(mask):
        return out
    if by >= 0:
        out[: len(mask) - by] = mask[by:]
    else:
        out[-by:] = mask[:by]
    return out


def _at(data: np.ndarray, text: bytes) -> np.ndarray:
    """Where ``text`` begins."""
    found = data == text[0]
    for k in range(1, len(text)):
        found &= _shifted(data == text[k], k)
    return found


def _since_start(mask: np.ndarray, starts: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """For each byte, how many marked bytes its cell has up to and including it."""
    total = np.cumsum(mask)
    before = np.concatenate([[0], total])[starts]
    return total - before[cell]


def split_buffer(values: pa.Array, field: PackedField) -> tuple[np.ndarray, pa.Array]:
    """(parent ordinals, items in order) of all values in the cells of one array; null and blank cells give none."""
    values = values.cast(pa.large_string())
    if len(values) == 0:
        return np.empty(0, np.int64), pa.array([], pa.large_string())
    if values.null_count:
        values = values.fill_null("")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    raw = values.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), pa.array([], pa.large_string())
    starts, lengths = offsets[:-1], np.diff(offsets)
    cell = np.repeat(np.arange(len(lengths)), lengths)

    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    nbsp = _at(data, b"\xc2\xa0")
    blank |= nbsp | _shifted(nbsp, -1)

    # The first and last written byte of each cell.
    where = np.arange(n)
    some = np.flatnonzero(~blank)
    if not len(some):
        return np.empty(0, np.int64), pa.array([], pa.large_string())
    k = np.searchsorted(some, starts)
    first = np.where(k < len(some), some[np.minimum(k, len(some) - 1)], n)
    k = np.searchsorted(some, offsets[1:]) - 1
    last = np.where(k >= 0, some[np.maximum(k, 0)], -1)
    has = (first < offsets[1:]) & (lengths > 0)
    first, last = np.where(has, first, starts), np.where(has, last, starts)
    safe_first, safe_last = np.minimum(first, n - 1), np.minimum(last, n - 1)
    listed = has & (last > first) & (data[safe_first] == 91) & (data[safe_last] == 93)  # [ ... ]

    # Quotes. Within a list a backslash escapes; a single quote counts only in a list whose first value it opens.
    opened = np.minimum(some[np.minimum(np.searchsorted(some, np.minimum(first + 1, n - 1)), len(some) - 1)], n - 1)
    single = listed & (data[opened] == 39)
    back = data == 92
    run = where - np.maximum.accumulate(np.where(back, -1, where))  # length of the run of backslashes that ends here
    escaped = np.concatenate([[False], (run[:-1] % 2) == 1]) & listed[cell]
    double = (data == 34) & ~escaped & ~single[cell]
    curly_open, curly_close = _at(data, "“".encode()), _at(data, "”".encode())
    depth = _since_start(curly_open, starts, cell) - _since_start(curly_close, starts, cell)
    double &= depth <= 0
    quote = double | ((data == 39) & single[cell] & ~escaped)
    parity = _since_start(quote, starts, cell)
    at_end = np.maximum(offsets[1:] - 1, 0)
    at_end = np.minimum(at_end, n - 1)
    odd = (parity[at_end] % 2 == 1) & (lengths > 0)  # an unpaired quote protects nothing
    crooked = (depth[at_end] != 0) & (lengths > 0)
    inside = ((parity % 2 == 1) & ~odd[cell]) | ((depth > 0) & ~crooked[cell])
    free = ~inside

    # Delimiters of each cell: begin and length.
    width = np.zeros(n, np.int64)
    strong = np.zeros(n, bool)
    plain = ~listed[cell]
    for text in (b";", b"|", b"\n", b"\r", b"\t", "；".encode(), "•".encode(), "·".encode(), "▪".encode(), b"<br>", b"<br/>", b"<br />"):
        hit = _at(low if text[:1] == b"<" else data, text) & free & plain
        width[hit] = len(text)
        strong |= hit
    # Numbers of a list within the line: blank or start, digits, bracket or dot, blank; they must count up from 1.
    digit = (data >= 48) & (data <= 57)
    begins = np.concatenate([[True], blank[:-1]]) | (where == starts[cell])
    for size in (1, 2, 3):
        head = begins & free & plain
        for j in range(size):
            head &= _shifted(digit, j)
        for mark in (41, 46):
            hit = head & _shifted(data == mark, size) & _shifted(blank, size + 1)
            spot = np.flatnonzero(hit)
            if not len(spot):
                continue
            number = np.zeros(len(spot), np.int64)
            for j in range(size):
                number = number * 10 + data[np.minimum(spot + j, n - 1)] - 48
            numbered = (data[np.minimum(first + 0, n - 1)] == 49) & has
            spot, number = spot[numbered[cell[spot]]], number[numbered[cell[spot]]]
            width[spot] = size + 1
            strong[spot] = True
            # kept only where it counts up; checked below together for all sizes
    marks = np.flatnonzero(strong & digit)
    if len(marks):
        order = _since_start(strong & digit, starts, cell)[marks]
        number = np.zeros(len(marks), np.int64)
        for j in range(3):
            within = j < width[marks] - 1
            number = np.where(within, number * 10 + data[np.minimum(marks + j, n - 1)] - 48, number)
        wrong = marks[number != order]
        strong[wrong] = False
        width[wrong] = 0
    comma = (data == 44) & free
    slash = (data == 47) & free & plain & np.concatenate([[False], blank[:-1]]) & _shifted(blank, 1)
    weak = np.zeros(n, bool)
    if field.labels:
        label = np.zeros(n, bool)
        for word in field.labels:
            hit = _at(low, word.lower().encode())
            label |= hit & (_shifted(data == 58, len(word)) | (_shifted(blank, len(word)) & _shifted(data == 58, len(word) + 1)))
        nearest = np.where(~blank, where, n)
        nearest = np.minimum.accumulate(nearest[::-1])[::-1]
        after = np.concatenate([nearest[1:], [n]])
        before_label = (after < n) & label[np.minimum(after, n - 1)]
        before_label &= cell[np.minimum(after, n - 1)] == cell
        weak = (comma | slash) & before_label & plain
    elif field.atomic:
        weak = (comma | slash | blank) & free & plain
        strong |= weak
        width[weak] = 1
        weak = np.zeros(n, bool)
    else:
        any_strong = np.zeros(len(lengths), bool)
        any_strong[cell[strong]] = True
        weak = (comma | slash) & plain & ~any_strong[cell]
    weak |= comma & listed[cell]
    width[weak] = 1
    cut = strong | weak
    # The brackets of a list are cut away like delimiters.
    for end in (first[listed], last[listed]):
        cut[end] = True
        width[end] = 1

    # Child spans: from the start of a cell or the end of a delimiter to the next delimiter or the end of the cell.
    spots = np.flatnonzero(cut)
    begin = np.concatenate([starts[lengths > 0], spots + width[spots]])
    owner = np.concatenate([np.flatnonzero(lengths > 0), cell[spots]])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    k = np.searchsorted(spots, begin)
    stop = np.minimum(np.where(k < len(spots), spots[np.minimum(k, len(spots) - 1)] if len(spots) else n, n), offsets[owner + 1])
    begin, stop, owner, quoted = _trim(data, blank, begin, stop, owner)

    # The bytes of all spans, which lie apart and in order, are the values buffer of the children; their lengths its offsets.
    inside_span = np.zeros(n + 1, np.int64)
    np.add.at(inside_span, begin, 1)
    np.add.at(inside_span, stop, -1)
    ends = np.concatenate([[0], np.cumsum(stop - begin)])
    items = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[np.cumsum(inside_span[:-1]) > 0].tobytes()))

    # Only quoted values may hold escapes, and of them only those with a mark of one are looked at one by one.
    marked = quoted > 0
    if marked.any():
        back_in, twice = np.concatenate([[0], np.cumsum(back)]), np.concatenate([[0], np.cumsum(_at(data, b'""'))])
        has = lambda counts: counts[stop] > counts[begin]
        escaped_items = np.flatnonzero(marked & np.where(listed[owner], has(back_in), (quoted == 34) & has(twice)))
        trimmed = pc.utf8_trim_whitespace(items)
        if len(escaped_items):
            plain_items = [_unescape(items[i].as_py(), "'" if single[owner[i]] else '"').strip() if listed[owner[i]] else items[i].as_py().replace('""', '"').strip() for i in escaped_items.tolist()]
            at = np.zeros(len(items), bool)
            at[escaped_items] = True
            trimmed = pc.replace_with_mask(trimmed, pa.array(at), pa.array(plain_items, pa.large_string()))
        items = pc.if_else(pa.array(marked), trimmed, items)

    keep = pc.greater(pc.binary_length(items), 0)
    if field.atomic:
        keep = pc.and_(keep, pc.match_substring_regex(items, r"[\p{L}\p{N}]"))
    alone = np.bincount(owner, minlength=len(values)) == 1
    nothing = pc.and_(pc.is_in(pc.utf8_lower(items), pa.array(NOTHING, pa.large_string())), pa.array(alone[owner] & ~marked))
    keep = pc.and_not(keep, nothing)
    kept = keep.to_numpy(zero_copy_only=False)
    return owner[kept], items.filter(keep)


def _trim(data, blank, begin, stop, owner):
    """Move the ends of all spans inwards over blanks, bullets, numbers and one pair of quotes; drop spans with nothing left."""
    n = len(data)
    some = np.flatnonzero(~blank)
    quoted = np.zeros(len(begin), np.int64)
    curly_open, curly_close = _at(data, "“".encode()), _at(data, "”".encode())
    for step in range(3):
        k = np.searchsorted(some, begin)
        begin = np.where(k < len(some), some[np.minimum(k, len(some) - 1)], n)
        k = np.searchsorted(some, stop) - 1
        stop = np.where(k >= 0, some[np.maximum(k, 0)] + 1, 0)
        ok = begin < stop
        begin, stop, owner, quoted = begin[ok], stop[ok], owner[ok], quoted[ok]
        if not len(begin):
            break
        at = lambda i: data[np.clip(i, 0, n - 1)]  # noqa: E731, B023
        if step == 0:  # bullets: a dash or star and a blank
            bullet = ((at(begin) == 45) | (at(begin) == 42)) & blank[np.clip(begin + 1, 0, n - 1)] & (begin + 1 < stop)
            begin = begin + bullet
            # numbers
            size = np.zeros(len(begin), np.int64)
            for width in (3, 2, 1):
                hit = np.ones(len(begin), bool)
                for j in range(width):
                    c = at(begin + j)
                    hit &= (c >= 48) & (c <= 57)
                mark = at(begin + width)
                hit &= ((mark == 41) | (mark == 46)) & blank[np.clip(begin + width + 1, 0, n - 1)] & (begin + width + 1 < stop)
                size = np.where(hit, width + 1, size)
            begin = begin + size
        elif step == 1:
            a, z = at(begin), at(stop - 1)
            long = stop - begin >= 2
            pair = long & (((a == 34) & (z == 34)) | ((a == 39) & (z == 39)))
            curly = (stop - begin >= 6) & curly_open[np.clip(begin, 0, n - 1)] & curly_close[np.clip(stop - 3, 0, n - 1)]
            quoted = np.where(pair, a, np.where(curly, 1, 0)).astype(np.int64)
            begin = begin + np.where(pair, 1, np.where(curly, 3, 0))
            stop = stop - np.where(pair, 1, np.where(curly, 3, 0))
    return begin, stop, owner, quoted


def _unescape(item: str, quote: str) -> str:
    """A quoted value of a list without its escapes; as written if they are no valid ones."""
    try:
        return json.loads(f'"{item}"', strict=False) if quote == '"' else str(ast.literal_eval(f"'{item}'"))
    except (ValueError, SyntaxError):
        return item.replace("\\" + quote, quote)


def split_cells(df: DataFrame, record_id: str, fields: list[PackedField]) -> DataFrame:
    """One row per value: (record_id, field_name, pos, item).

    ``pos`` counts the non-empty values of a cell from 1 in the order written; ``item`` is the value without blanks around it,
    enclosing quotes and their escapes, list numbers or bullets. Null, blank and "nothing" cells have no rows; repeated values
    count each time; rows with the same id (also null) are split each for itself; other columns are neither read nor needed,
    whatever their names. An unpaired quote is an ordinary character. Cells of any length are split whole. An empty table gives
    an empty result. Narrow: nothing is shuffled, so hot values don't matter.
    """
    read = df.select(F.col(record_id).cast("bigint").alias("record_id"), *[F.col(f.name).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    kinds = tuple(fields)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, field in enumerate(kinds):
                owner, items = split_buffer(batch.column(i + 1), field)
                if not len(items):
                    continue
                # Lists by parent: their offsets give the places of the items within them, their parents the ids.
                counts = np.bincount(owner, minlength=len(ids))
                offsets = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), items)
                parents = pc.list_parent_indices(lists)
                pos = np.arange(len(items)) - offsets[owner] + 1
                name = pa.array([field.name]).take(pa.array(np.zeros(len(items), np.int64)))
                yield pa.RecordBatch.from_arrays([ids.take(parents), name, pa.array(pos, pa.int32()), pc.list_flatten(lists).cast(pa.string())], names=["record_id", "field_name", "pos", "item"])

    return read.mapInArrow(split, "record_id bigint, field_name string, pos int, item string")


SEVERITIES = ("critical", "high", "medium", "low")
LEAD_FIELDS = [PackedField("top_issues", labels=SEVERITIES), PackedField("emails_found", atomic=True), PackedField("social_links_found", atomic=True)]
CRITERIA_FIELDS = [PackedField("allowed_categories")]
