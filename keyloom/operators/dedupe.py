"""One copy of each message that was delivered at least once (problem 5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def _ranked(df: DataFrame, ident: Sequence[str], arrived: str, tie: Sequence[str]) -> DataFrame:
    order = [F.col(arrived).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in tie]]
    return df.withColumn("kl_rank", F.row_number().over(Window.partitionBy(*ident).orderBy(*order)))


def first_copies(df: DataFrame, ident: Sequence[str], arrived: str, tie: Sequence[str] = ()) -> DataFrame:
    """Keep the copy of each identifier that arrived first.

    Ranks the copies by arrival, then by ``tie``, and keeps rank 1.  Spark limits
    the ranks on the map side too (a window group limit), so of a hot identifier
    each task sends one row.  Columns in ``tie`` should tell copies apart; where
    they don't, the copies are equal in all of them and any one is kept.  Null
    parts of the identifier compare equal; a null arrival ranks last.
    """
    return _ranked(df, ident, arrived, tie).where("kl_rank <= 1").drop("kl_rank")


def repeated(df: DataFrame, ident: Sequence[str], arrived: str, tie: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Identifiers of which :func:`first_copies` removes at least one copy, with the columns ``carry`` of the copy it keeps."""
    rows = _ranked(df.select(*dict.fromkeys([*ident, arrived, *tie, *carry])), ident, arrived, tie)
    kept = Window.partitionBy(*ident).orderBy("kl_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.where("kl_rank <= 2")
    for c in carry:
        rows = rows.withColumn(c, F.first(c).over(kept))
    return rows.where("kl_rank = 2").select(*ident, *carry)


def new_messages(batch: DataFrame, stored: DataFrame, ident: Sequence[str], arrived: str, tie: Sequence[str] = ()) -> DataFrame:
    """First copies of the messages in ``batch`` whose identifiers aren't in ``stored``.

    ``stored`` needs the identifier columns only.  The anti-join is null-safe,
    as the ranking is: an identifier with a null part is found again.
    """
    fresh = first_copies(batch, ident, arrived, tie)
    known = stored.select(*[F.col(c).alias(f"kl_s{i}") for i, c in enumerate(ident)])
    same = [F.col(c).eqNullSafe(F.col(f"kl_s{i}")) for i, c in enumerate(ident)]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return fresh.join(known, cond, "left_anti")
