"""Fill-in-the-middle transformation with repeated-capture matching.

One fullmatch of ``(unit)*`` over a text keeps the end of every repetition of the group, so
``match.ends(1)`` gives the number of units and both cut offsets without a loop over the units.
The draws come from a hash of the seed and the document's id, so that a row's result depends on that
row alone and a repeated task gives the same text.

Cases: null and empty texts stay plain, with no units; so does a text that holds one of the markers,
as it could not be taken apart again; a text that units do not cover as a whole is refused with an
error; a null id draws like an empty id; repeated rows get equal results; one unit or a cut at the
ends gives empty parts, which are parts like others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts

#: A line with its line feed, or what follows the last one.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def cutter(unit: str):
    """text -> end offset of every unit."""
    # a unit, once found, is never given up: matching takes time in proportion to the text
    match = regex.compile(f"((?>{unit}))*+").fullmatch

    def ends(text: str) -> list[int]:
        found = match(text)
        if found is None:
            raise ValueError("the units do not cover a text")
        return found.ends(1)

    return ends


def fill_in_middle(docs: DataFrame, seed: int, rate: int = 100, spm_rate: int = 50, unit: str = LINES) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every whole text.

    ``n``: number of units; ``form``: ``plain`` (output is the text, no part sizes), ``psm`` (prefix,
    suffix, middle) or ``spm`` (suffix, prefix, middle), each part after its marker.  ``rate`` percent of the
    documents are transformed, ``spm_rate`` percent of those to ``spm``.  The prefix ends after the
    smaller and the middle after the larger of two drawn numbers of units; sizes are code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends_of = cutter(unit)
        for batch in pieces(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ends = ends_of(text)
                n = len(ends)
                h = draws(seed, doc_id)
                if not text or h[2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                    rows.append((n, "plain", None, None, text))
                    continue
                low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                a, b = (ends[k - 1] if k else 0 for k in (low, high))
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                if h[3] % 100 < spm_rate:
                    rows.append((n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle))
                else:
                    rows.append((n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle))
            n, form, prefix_chars, middle_chars, output = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix_chars, pa.int64()),
                 pa.array(middle_chars, pa.int64()), pa.array(output, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return texts(docs).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output of a form was made from.  Parts hold no marker, so the first
    place of each marker is where its part begins."""
    second = F.when(form == "psm", SUFFIX).otherwise(PREFIX)
    # code points before the second marker and before the middle's
    p, q = F.instr(output, second) - 1, F.instr(output, F.lit(MIDDLE)) - 1
    first = F.substr(output, F.lit(len(PREFIX) + 1), p - len(PREFIX))
    other = F.substr(output, p + len(SUFFIX) + 1, q - p - len(SUFFIX))
    middle = F.substr(output, q + len(MIDDLE) + 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, other)).otherwise(F.concat(other, middle, first))
