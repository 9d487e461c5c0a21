"""Fill-in-the-middle: texts cut at two unit boundaries and set in another order, and back.

A unit is a run of letters A to Z and a to z, or any one other character. Which boundaries, and which form, follow
from a digest of the row's id, so a row comes out alike wherever and whenever it is worked on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.storage import bounded_batches
from ledgerlark.llm.text_arrays import tidily

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def unit_bounds(points: np.ndarray) -> np.ndarray:
    """Where units begin, and the end of the last: place k is the end of the first k units."""
    letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    between = np.flatnonzero(~(letter[1:] & letter[:-1])) + 1
    return np.concatenate([[0], between, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def draws(seed: str) -> tuple[int, ...]:
    """Four unsigned 32-bit integers of a digest."""
    return tuple(np.frombuffer(hashlib.sha256(seed.encode()).digest()[:16], ">u4").tolist())


def transform(text: str, seed: str, *, plain_from: int = 90, spm_below: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """n units, form, code points of prefix and middle, and the text in that form."""
    points = code_points(text)
    bounds = unit_bounds(points)
    n = len(bounds) - 1
    h = draws(seed)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= plain_from:
        return n, "plain", None, None, text
    a, b = bounds[sorted((h[0] % (n + 1), h[1] % (n + 1)))].tolist()
    prefix, middle, suffix = (points[x:y].tobytes().decode("utf-32-le") for x, y in ((0, a), (a, b), (b, len(points))))
    if h[3] % 100 < spm_below:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that ``transform`` has set in a form. No mark stands in a text that is cut, and none can begin in one part and end in
    another, as each begins with the sign that only begins one: the first of each mark is the one that was put there."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _transformed(batches: Iterator[pa.RecordBatch], salt: str, shares: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in tidily(batches):
        names = batch.schema.names
        # rows one at a time: a batch may hold long texts
        rows = [transform(text.as_py() or "", f"{salt}{'' if key.as_py() is None else key.as_py()}", plain_from=shares[0], spm_below=shares[1]) for key, text in zip(batch.column(0), batch.column(1))]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = zip(*rows) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), kind) for c, kind in zip(columns, kinds))], [names[0], "n", "form", "prefix_chars", "middle_chars", "output"])


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tidily(batches):
        names = batch.schema.names
        at, form = names.index("output"), names.index("form")
        texts = [None if o.as_py() is None or f.as_py() is None else restore(o.as_py(), f.as_py()) for o, f in zip(batch.column(at), batch.column(form))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "restored"])


def fill_in_middle(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, salt: str = "1:", plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row; output is the whole text, cut and set in its form: psm,
    spm (``spm_percent`` of those that are cut), or plain (``plain_percent``, and empty texts and those that hold a mark).

    Lengths are in code points and null for plain. A null text counts as empty. Rows with the same id draw the same
    numbers; a null id counts as an empty string. An empty table gives an empty result; further columns are left out. There is no shuffle.
    """
    bounded_batches(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    fields = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.mapInArrow(partial(_transformed, salt=salt, shares=(100 - plain_percent, spm_percent)), fields).withColumnRenamed("id", id_col)


def restored_texts(rows: DataFrame) -> DataFrame:
    """rows (output, form, further columns) with ``restored``, the text before it was cut, taken from these two alone; null where one is null."""
    bounded_batches(rows.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_restored, f"{fields}, restored string")


def fill_in_middle_digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """fill_in_middle with the digests of output and of the text restored from it instead of the texts."""
    rows = restored_texts(fill_in_middle(documents, id_col, text_col, **settings))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2("restored", 256)}
    return rows.withColumns(digests).drop("output", "restored")
