"""Fill-in-the-middle examples by displacement scatter.

A document is cut at two units into prefix, middle and suffix, which change places behind marks. The
texts of a batch stand one after the other as bytes. The cuts are found by a scan, each segment's
displacement is written into a difference array, and its cumulative sum is the shift of every byte;
one scatter then builds all outputs. Restoring finds the marks in the outputs and gathers every byte
back by a difference array of its own, without looking at what the first pass had worked out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_chunks

#: The marks before prefix, suffix and middle, and the forms of an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = range(3)
FORMS = np.array(["plain", "psm", "spm"])
#: Of 100 documents, those that stay whole, and of 100 others those whose suffix comes first.
WHOLE, SUFFIX_FIRST = 10, 20
_MARKS = np.array([list(m.encode()) for m in (PREFIX, SUFFIX, MIDDLE)], np.uint8)
_WIDE = _MARKS.shape[1]
#: The marks in the order of each form's output.
_ORDER = {PSM: (0, 1, 2), SPM: (1, 0, 2)}


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the units of all texts start: a run of ASCII letters, or any other code point alone."""
    low = data | 0x20
    letter = (low >= 97) & (low <= 122)
    start = (data & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(start)


def mark_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, mark, byte) of every mark that stands in a text, in order."""
    at = np.flatnonzero((data[:-2] == _MARKS[0, 0]) & (data[2:] == _MARKS[0, 2])) if len(data) >= _WIDE else np.zeros(0, np.int64)
    which = np.full(256, -1)
    which[_MARKS[:, 1]] = range(3)
    kind = which[data[at + 1]] if len(at) else np.zeros(0, int)
    text = np.searchsorted(offsets, at, "right") - 1
    good = (kind >= 0) & (at + _WIDE <= offsets[text + 1])
    return text[good], kind[good], at[good]


def shifts(starts: np.ndarray, shift: np.ndarray, size: int) -> np.ndarray:
    """For `size` bytes the shift of the segment that each lies in; segments are given in order, empty ones too."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, np.diff(shift, prepend=0))
    return np.cumsum(steps[:-1])


def scattered(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(units, form, prefix code points, middle code points, output bytes, output offsets) of a batch; hashes has a row of four for each text."""
    size = np.diff(offsets)
    starts = unit_starts(data, offsets)
    first = np.searchsorted(starts, offsets)
    n = np.diff(first)
    cuts = np.sort(hashes[:, :2] % (n + 1)[:, None], axis=1)
    at = np.append(starts, len(data))[first[:-1, None] + cuts]  # the bytes where prefix and middle end
    form = np.where(hashes[:, 3] % 100 < SUFFIX_FIRST, SPM, PSM)
    form[(size == 0) | (hashes[:, 2] % 100 >= 100 - WHOLE)] = PLAIN
    form[mark_places(data, offsets)[0]] = PLAIN
    out = np.concatenate(([0], np.cumsum(size + np.where(form != PLAIN, 3 * _WIDE, 0))))
    begin = np.stack([offsets[:-1], at[:, 0], at[:, 1]], 1)
    length = np.diff(np.concatenate([begin, offsets[1:, None]], 1), axis=1)
    goal, marks = begin - offsets[:-1, None] + out[:-1, None], []
    for f, order in ((PSM, (0, 2, 1)), (SPM, (2, 0, 1))):  # segments in the order of the output
        own = np.flatnonzero(form == f)
        place = out[own]
        for segment, mark in zip(order, _ORDER[f], strict=True):
            marks.append((place, mark))
            place = place + _WIDE
            goal[own, segment] = place
            place = place + length[own, segment]
    result = np.empty(int(out[-1]), np.uint8)
    result[np.arange(len(data)) + shifts(begin.ravel(), (goal - begin).ravel(), len(data))] = data
    for place, mark in marks:
        result[place[:, None] + np.arange(_WIDE)] = _MARKS[mark]
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return n, form, chars[at[:, 0]] - chars[offsets[:-1]], chars[at[:, 1]] - chars[at[:, 0]], result, out


def gathered(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts that outputs of these forms were made from. Outputs whose marks don't fit their form raise."""
    text, mark, at = mark_places(data, offsets)
    held = form[text] != PLAIN
    text, mark, at = text[held], mark[held], at[held]
    own = np.flatnonzero(form != PLAIN)
    want = np.where((form[own] == PSM)[:, None], _ORDER[PSM], _ORDER[SPM])
    if not np.array_equal(text, np.repeat(own, 3)) or not np.array_equal(mark, want.ravel()):
        raise ValueError("an output without exactly the marks of its form")
    at = at.reshape(-1, 3)
    begin, end = at + _WIDE, np.concatenate([at[:, 1:], offsets[own + 1, None]], 1)
    size = np.diff(offsets) - np.where(form != PLAIN, 3 * _WIDE, 0)
    out = np.concatenate(([0], np.cumsum(size)))
    source = np.repeat(offsets[:-1, None], 3, 1)  # where each text's prefix, middle and suffix stand in the output
    length = np.stack([size, np.zeros_like(size), np.zeros_like(size)], 1)
    for f, order in ((PSM, (0, 2, 1)), (SPM, (1, 2, 0))):
        k = form[own] == f
        source[own[k]], length[own[k]] = begin[k][:, order], (end - begin)[k][:, order]
    goal = out[:-1, None] + np.cumsum(length, 1) - length
    return data[np.arange(int(out[-1])) + shifts(goal.ravel(), (source - goal).ravel(), int(out[-1]))], out


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def cut_hashes(id_col: str, salt: str = "1:") -> list[Column]:
    """The first four 8-digit groups of the sha256 of the salt and the decimal id, as integers; a null id is as an empty one."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1:") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for every row.

    n counts the units of the text, between which it is cut; the counts are of code points and null in
    plain form. Null and empty texts are empty outputs in plain form, and so is a text that holds a
    mark. Rows are worked on alone: repeated rows give repeated outputs, other columns play no part.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)], 1) if len(b) else None
            for lo, hi, data, offsets in text_chunks(b, 1):
                n, form, before, middle, out, ends = scattered(data, offsets, hashes[lo:hi])
                none = form == PLAIN
                counts = [pa.array(x.astype(np.int64), pa.int64(), mask=none) for x in (before, middle)]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(n.astype(np.int64)), pa.array(FORMS[form].tolist(), pa.string()), *counts, _strings(out, ends)], names=names)

    hashed = docs.select(F.col(id_col), F.col(text_col).alias("_text"), *[h.alias(f"_h{k}") for k, h in enumerate(cut_hashes(id_col, salt))])
    return hashed.mapInArrow(run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore_middle(examples: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored") -> DataFrame:
    """Adds the text that each output was made from, by output and form alone; a null output is an empty text."""
    own = [f for f in examples.schema if f.name != name]
    at, kind = ([f.name for f in own].index(c) for c in (output_col, form_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            form = np.searchsorted(FORMS, np.array(b.column(kind).to_pylist(), FORMS.dtype)) if len(b) else None
            for lo, hi, data, offsets in text_chunks(b, at):
                text = _strings(*gathered(data, offsets, form[lo:hi]))
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, text], names=[*b.schema.names, name])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    return examples.select(*[f"`{f.name}`" for f in own]).mapInArrow(run, f"{types}, `{name}` string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = restore_middle(fill_in_middle(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return examples.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


OP12_SQL = """WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]', 0, 's') AS u, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM texts
), cut AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM units),
parts AS (
  SELECT doc_id, t, n, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts"""
