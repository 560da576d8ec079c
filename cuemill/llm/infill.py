"""Fill-in-middle: texts cut at two unit borders into prefix, middle and suffix, and put in the order a model is trained on.

A unit is a run of ASCII letters or any other single code point. The borders, and whether and how a text is turned, come
from the sha256 of `1:` and the document's id, so they are the same in every run, on every machine and in every order of
rows. psm is prefix, suffix, middle; spm is suffix, prefix, middle; a plain text stays as it is.

A text is read whole, once: the ends of its units go to a flat array of four or eight bytes each, two lookups in it give the
borders, and two slices the parts. Null texts are empty; empty texts, and those that contain a marker already, are plain. A
null doc_id counts as an id without digits. Repeated rows are each turned, alike if their ids and texts are; an empty table
gives no rows. Only doc_id and text are read, so other columns may have any name. Memory is a batch of rows and the longest
text's offsets.
"""

from __future__ import annotations

import hashlib
from array import array
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import small_batches

UNITS = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 texts, so many are turned, and of 100 turned ones so many are spm.
TURNED, SPM = 90, 20

_FORM = "form string, n long, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


class Turned(NamedTuple):
    form: str
    n: int
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def ends_of(text: str) -> array:
    """Where each unit ends."""
    return array("I" if len(text) < 1 << 31 else "Q", (m.end() for m in regex.finditer(UNITS, text)))


def seeds(doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def turn(doc_id: int | None, text: str) -> Turned:
    ends = ends_of(text)
    n, (h1, h2, h3, h4) = len(ends), seeds(doc_id)
    if not n or h3 % 100 >= TURNED or any(m in text for m in MARKERS):
        return Turned("plain", n, None, None, text)
    # The border after k units; none of them is the start.
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM:
        return Turned("spm", n, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Turned("psm", n, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def restore(output: str, form: str) -> str:
    """The text that an output and its form come from. Markers can't be part of what is between them."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    marks = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    parts = dict(zip(marks, head.removeprefix(marks[0]).split(marks[1]), strict=True))
    return parts[PREFIX] + middle + parts[SUFFIX]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _turned(texts: bool):
    """A pandas function of ids and texts; with texts, the outputs themselves are returned too."""

    @F.pandas_udf(_FORM + (", output string" if texts else ""))
    def turned(ids: pd.Series, given: pd.Series) -> pd.DataFrame:
        rows = []
        for i, text in zip(ids, given, strict=True):
            t = turn(None if pd.isna(i) else int(i), text or "")
            rows.append((t.form, t.n, t.prefix_chars, t.middle_chars, _sha(t.output), _sha(restore(t.output, t.form)), *([t.output] if texts else [])))
        made = pd.DataFrame(rows, columns=[c.split()[0] for c in _FORM.split(", ")] + (["output"] if texts else []))
        return made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return turned


def transformed(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, form, n (units), prefix_chars, middle_chars (null if plain), output_sha256, restored_sha256, and with texts
    the output: a row for each row of docs (doc_id, text)."""
    # Ids go as text, since a null among numbers would make them inexact.
    made = small_batches(docs).select("doc_id", _turned(texts)(F.col("doc_id").cast("string"), F.col("text")).alias("made"))
    return made.select("doc_id", "made.*")


def restored(output: Column, form: Column) -> Column:
    """The texts that outputs and forms come from; null for null."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None or f is None else restore(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return back(output, form)
