"""Token-array scalars: end marks, chunks, padding, decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.constants import EOS_ID, LABEL_IGNORE, MIN_TAIL, PAD_ID, SPACE_MARK, SPECIAL_PIECES
from lexmill.functions.text import strip_text

# Unicode noncharacters, so never part of a piece.
_OPEN, _CLOSE = "\uFDD0", "\uFDD1"


def ends_with_eos(ids: Column) -> Column:
    """True where the sequence already ends with the end-of-sequence id."""
    return (F.size(ids) > 0) & (F.element_at(ids, -1) == EOS_ID)


def append_eos(ids: Column) -> Column:
    """Add the end-of-sequence id unless it is there; an empty array gains one."""
    return F.when(ends_with_eos(ids), ids).otherwise(F.concat(ids, F.array(F.lit(EOS_ID))))


def join_pair(first: Column, second: Column) -> Column:
    """Two sequences, each closed by its own end-of-sequence id."""
    return F.concat(append_eos(first), append_eos(second))


def chunk_arrays(ids: Column, size: int | None, min_tail: int = MIN_TAIL) -> Column:
    """Array of fixed-size slices of ``ids``.

    A tail shorter than ``min_tail`` is dropped, the first slice never is, and
    an empty array has no slices.  ``size=None`` keeps each sequence whole.
    """
    empty = F.array().cast("array<array<int>>")
    if size is None:
        return F.when(F.size(ids) > 0, F.array(ids)).otherwise(empty)
    starts = F.filter(
        F.sequence(F.lit(0), F.size(ids) - 1, F.lit(size)),
        lambda at: (at == 0) | (F.size(ids) - at >= min_tail),
    )
    slices = F.transform(starts, lambda at: F.slice(ids, at + 1, size))
    return F.when(F.size(ids) > 0, slices).otherwise(empty)


def pad_right(ids: Column, width: Column, value: int = PAD_ID) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), width - F.size(ids)))


def attention_mask(ids: Column, width: Column) -> Column:
    return F.concat(
        F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), width - F.size(ids))
    )


def mask_padding(ids: Column) -> Column:
    """Labels for training: padding ids become the ignored label."""
    return F.transform(
        ids, lambda x: F.when(x == PAD_ID, F.lit(LABEL_IGNORE)).otherwise(x)
    )


def join_pieces(pieces: Column, special: Sequence[str] = SPECIAL_PIECES) -> Column:
    """Text of a piece array, special tokens kept as they are.

    Pieces between two special tokens are decoded together: the space mark
    becomes a space and leading spaces go.  A special token puts one space in
    front of the text it closes, unless it directly follows another special
    token.  The work is one join and two passes over the joined text, so long
    sequences stay linear.
    """
    marked = F.transform(
        pieces,
        lambda p: F.when(
            p.isin(list(special)), F.concat(F.lit(_OPEN), p, F.lit(_CLOSE))
        ).otherwise(F.replace(p, F.lit(SPACE_MARK), F.lit(" "))),
    )
    run = f"[^{_OPEN}{_CLOSE}]"
    closed = F.regexp_replace(
        F.array_join(marked, ""), rf"(\A|{_CLOSE})(?={run}) *({run}*){_OPEN}", rf"$1 $2{_OPEN}"
    )
    tail = F.regexp_replace(closed, rf"(\A|{_CLOSE}) +({run}*)\z", "$1$2")
    return strip_text(F.translate(tail, _OPEN + _CLOSE, ""))
