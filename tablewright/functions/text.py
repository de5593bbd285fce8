"""Expressions over text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate_utf8(cell: Column, limit: int) -> Column:
    """The longest prefix of whole characters within ``limit`` bytes."""
    # A cut inside a character leaves an incomplete tail, which decodes to one replacement character.
    head = F.substring(F.encode(cell, "UTF-8"), 1, limit)
    tail = F.expr("null")
    for n in range(1, 5):
        # The byte after the cut starts a character unless its leading bits are 10.
        at = limit + 1 - (n - 1)
        starts = _byte(cell, at) < 128 if at > 0 else F.lit(True)
        starts = starts | (_byte(cell, at) >= 192) if at > 0 else starts
        prefix = F.substring(F.encode(cell, "UTF-8"), 1, max(at - 1, 0))
        tail = F.coalesce(tail, F.when(starts, prefix))
    return F.when(F.octet_length(cell) <= limit, cell).otherwise(F.decode(F.coalesce(tail, head), "UTF-8"))


def _byte(cell: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(F.encode(cell, "UTF-8"), at, 1)), 16, 10).cast("int")


def has_replacement(cell: Column) -> Column:
    """Whether decoding replaced bytes."""
    return F.contains(cell, F.lit("�"))


def formatted_cell(cell: Column, delimiter: str, quote: str) -> Column:
    """A cell as written to a file: quoted if it holds the delimiter, a quote or a line break, inner quotes doubled."""
    cell = F.coalesce(cell, F.lit(""))
    special = F.contains(cell, F.lit(delimiter)) | F.contains(cell, F.lit(quote)) | F.contains(cell, F.lit("\n")) | F.contains(cell, F.lit("\r"))
    return F.when(special, F.concat(F.lit(quote), F.replace(cell, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(cell)


def formatted_row(cells: list[Column], delimiter: str, quote: str) -> Column:
    return F.concat_ws(delimiter, *[formatted_cell(c, delimiter, quote) for c in cells])


def compared(cell: Column, query: str, *, whole_cell: bool = False, match_case: bool = False) -> Column:
    """As ``matches``, but null for an absent cell: in a filter that is the same, and a scan can push it down."""
    wanted = F.lit(query)
    if not match_case:
        cell, wanted = F.lower(cell), F.lower(wanted)
    return cell == wanted if whole_cell else F.contains(cell, wanted)


def matches(cell: Column, query: str, *, whole_cell: bool = False, match_case: bool = False) -> Column:
    """Whether a cell contains the query, or with ``whole_cell`` equals it. An absent cell never matches."""
    return F.coalesce(compared(cell, query, whole_cell=whole_cell, match_case=match_case), F.lit(False))
