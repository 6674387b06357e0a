"""Fill-in-the-middle texts by block rotation inside one buffer.

A text is cut at two seeded unit borders into prefix, middle and suffix, where a
unit is a word with the whitespace before it, or the whitespace that ends the
text.  Spark works out the form and the cuts of each row from a hash of its id;
a text that changes is then put into a bytearray, the sentinels are inserted at
the cuts, and neighbouring segments change places by three reversals, so that
no second copy of a long text is made.  ``restore`` turns the segments back and
takes the sentinels out, which gives the text again byte by byte.

Rows are independent: nothing is shuffled, and a lost task is simply run again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from lexmill.llm.common import WORD, others, quoted, text_or_empty

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
FIM_PERCENT = 50  # of the texts that can be changed
SPM_PERCENT = 80  # of the changed texts
NEW = ("n", "form", "prefix_chars", "middle_chars", "output")
_CHUNK = 1 << 16  # bytes that change places at a time


def unit_count(text: Column) -> Column:
    """Number of units of a text: its words, and one more if it ends in whitespace."""
    ends_in_space = text.rlike(r"[\x20\x09-\x0D]\z")
    return F.regexp_count(text, F.lit(WORD)).cast("long") + ends_in_space.cast("long")


def cut_offsets(data: bytes, first: int, second: int) -> tuple[int, int]:
    """The byte offsets after ``first`` and after ``second`` units."""
    codes = np.frombuffer(data, dtype=np.uint8)
    space = (codes == 32) | (codes - np.uint8(9) <= 4)
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    at = lambda k: 0 if k == 0 else int(ends[k - 1]) if k <= len(ends) else len(data)
    return at(first), at(second)


def _reverse(view: np.ndarray, start: int, stop: int) -> None:
    """Turn a segment round in place, a bounded piece from both ends at a time."""
    while stop - start > 1:
        size = min(_CHUNK, (stop - start) // 2)
        left = view[start : start + size].copy()
        view[start : start + size] = view[stop - size : stop][::-1]
        view[stop - size : stop] = left[::-1]
        start, stop = start + size, stop - size


def exchange(buffer: bytearray, start: int, border: int, stop: int) -> None:
    """Let the segments before and after ``border`` change places, by three reversals."""
    view = np.frombuffer(buffer, dtype=np.uint8)
    _reverse(view, start, border)
    _reverse(view, border, stop)
    _reverse(view, start, stop)


def rotate_out(data: bytes, first: int, second: int, form: str) -> bytearray:
    """Prefix, middle and suffix of ``data`` in the order of ``form``, each behind its sentinel."""
    buffer = bytearray(data)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    middle_at = len(PREFIX) + first
    suffix_at = middle_at + len(MIDDLE) + second - first
    exchange(buffer, 0 if form == "spm" else middle_at, suffix_at, len(buffer))
    return buffer


def rotate_back(data: bytes, form: str) -> bytearray | None:
    """The text that ``rotate_out`` began with; None if the sentinels are not there."""
    buffer = bytearray(data)
    if form == "spm":
        start, border = 0, buffer.find(PREFIX)
    else:
        start = buffer.find(SUFFIX)
        border = buffer.find(MIDDLE, max(start, 0))
    if start < 0 or border < 0:
        return None
    exchange(buffer, start, border, len(buffer))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.find(sentinel)
        if at < 0:
            return None
        del buffer[at : at + len(sentinel)]
    return buffer


def _code_points(data: bytes) -> int:
    """How many bytes begin a code point."""
    return int(((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80).sum())


@F.arrow_udf(StructType().add("output", BinaryType()).add("prefix_chars", LongType()).add("middle_chars", LongType()))
def _rotated(text: pa.Array, first: pa.Array, second: pa.Array, form: pa.Array) -> pa.Array:
    """``rotate_out`` for each row; null for a null text."""
    output, prefix, middle = [], [], []
    for data, a, b, kind in zip(text, first.to_pylist(), second.to_pylist(), form.to_pylist()):
        data = data.as_py()
        if data is None:
            output.append(None), prefix.append(None), middle.append(None)
            continue
        start, stop = cut_offsets(data, a, b)
        output.append(bytes(rotate_out(data, start, stop, kind)))
        prefix.append(_code_points(data[:start]))
        middle.append(_code_points(data[start:stop]))
    columns = [pa.array(output, pa.binary()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]
    return pa.StructArray.from_arrays(columns, names=["output", "prefix_chars", "middle_chars"])


@F.arrow_udf(BinaryType())
def _restored(output: pa.Array, form: pa.Array) -> pa.Array:
    """``rotate_back`` for each row; null for a null output."""
    back = (
        None if data is None else rotate_back(data, kind)
        for data, kind in ((x.as_py(), f.as_py()) for x, f in zip(output, form))
    )
    return pa.array([None if data is None else bytes(data) for data in back], pa.binary())


def fill_in_middle(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """The rows with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``form`` is ``plain`` for an empty text, for one that holds a sentinel, so
    that it can always be restored, and for ``100 - fim_percent`` of the others;
    ``output`` is the text then and the two lengths, in code points, are null.
    ``spm_percent`` of the rest are ``spm`` (suffix, prefix, middle), the others
    ``psm`` (prefix, suffix, middle).

    A null text counts as empty and a null id as the empty id.  Rows that share
    an id share the hashes but not the cuts, which follow from their units;
    equal rows give equal results.  A column of the table that has the name of a
    new one is replaced; all others stay.  An empty table gives an empty one.
    """
    body = text_or_empty(F.col(quoted(text)))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    n = unit_count(body)
    first, second = h[0] % (n + 1), h[1] % (n + 1)
    held = [F.contains(body, F.lit(s.decode())) for s in (PREFIX, SUFFIX, MIDDLE)]
    plain = (body == "") | held[0] | held[1] | held[2] | (h[2] % 100 >= fim_percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    # a plain text is null here, so it does not go to Python
    moved = _rotated(F.when(~plain, body.cast("binary")), F.least(first, second), F.greatest(first, second), form)
    rows = docs.select(F.struct("*").alias("row"), body.alias("body"), n.alias("n"), form.alias("form"), moved.alias("moved"))
    kept = [F.col(f"row.{quoted(c)}") for c in docs.columns if c.lower() not in NEW]
    return rows.select(
        *kept, "n", "form", F.col("moved.prefix_chars").alias("prefix_chars"), F.col("moved.middle_chars").alias("middle_chars"),
        F.coalesce(F.col("moved.output").cast("string"), F.col("body")).alias("output"),
    )


def restore(rows: DataFrame, *, output: str = "output", form: str = "form") -> DataFrame:
    """The rows with ``restored``, the text that ``output`` was made from.

    A ``plain`` output is the text; an output of another form without its
    sentinels, a null output and a null form give null.  A column ``restored``
    that is there already is replaced.
    """
    out, kind = F.col(quoted(output)), F.col(quoted(form))
    back = _restored(F.when(kind != "plain", out.cast("binary")), kind).cast("string")
    return rows.select(*others(rows, ["restored"]), F.when(kind == "plain", out).otherwise(back).alias("restored"))
