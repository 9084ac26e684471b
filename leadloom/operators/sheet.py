"""A sheet kept by hand and the rows to add to it: which header it gets, what of it stays, and which new rows are no repeats."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions import contact as C
from leadloom.functions import text as T
from leadloom.functions import url as U
from leadloom.operators.identity import greedy_distinct, numbered


@dataclass(frozen=True)
class Header:
    """names: the header to write. places: by name the column of the sheet it comes from, none for new ones. migrated: whether the
    sheet is written anew. first_row_is_data: the sheet's first line is a row, as it had no header."""

    names: tuple[str, ...]
    places: dict[str, int]
    is_new: bool = False
    migrated: bool = False
    first_row_is_data: bool = False


def plan_header(first: Sequence[str | None] | None, wanted: Sequence[str], empty: bool) -> Header:
    """What becomes of a sheet's header. An empty sheet gets the wanted one. A blank first line is no header: the sheet is written
    anew and its columns are taken in the wanted order. A header that begins as wanted stays. Any other is migrated: the wanted
    names first, then names of its own, each from the first column of that name."""
    if empty:
        return Header(tuple(wanted), {}, is_new=True)
    had = [(h or "") for h in (first or ())]
    if not any(h.strip() for h in had):
        return Header(tuple(wanted), {h: i for i, h in enumerate(wanted) if i < len(had)}, migrated=True, first_row_is_data=True)
    if had[: len(wanted)] == list(wanted):
        return Header(tuple(had), {h: i for i, h in reversed(list(enumerate(had)))})
    extra = [h for h in had if h.strip() and h not in wanted]
    places: dict[str, int] = {}
    for i, h in enumerate(had):
        places.setdefault(h, i)
    names = (*wanted, *dict.fromkeys(extra))
    return Header(names, {h: places[h] for h in names if h in places}, migrated=True)


def tokens(website: str, phone: str, email: str, name: str):
    """The tokens by which a lead is told: website, phone and e-mail, or the name where there is none of them."""
    tagged = lambda tag, c: F.when(c != "", F.concat(F.lit(tag), c))
    mail = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    own = F.array_compact(F.array(tagged("w:", U.sheet_domain_key(F.col(website))), tagged("p:", C.phone_last8(F.col(phone))), F.when(mail.contains("@"), F.concat(F.lit("e:"), mail))))
    return F.when(F.size(own) > 0, own).otherwise(F.array_compact(F.array(tagged("n:", F.lower(F.trim(F.coalesce(name, F.lit(""))))))))


def plan_sheet(sheet: DataFrame, new: DataFrame, wanted: Sequence[str], order: str = "_ord") -> tuple[Header, DataFrame, DataFrame]:
    """(header, existing rows, rows to add). sheet: its lines in ``order``, all columns text, the first line its header. new: rows with
    named columns and ``order``, of which Website, Phone, Email, Business Name and Priority are looked at.

    New rows come hot before warm before cold, then in order; a row that shares a token with the sheet or with a row kept before it
    is left out. Blank lines of a sheet without a header are dropped. An empty sheet keeps nothing.
    """
    columns = [c for c in sheet.columns if c != order]
    blank = F.concat(*[F.trim(F.coalesce(f"`{c}`", F.lit(""))) for c in columns]) == "" if columns else F.lit(True)
    top = sheet.orderBy(order).limit(1).collect()  # the header line
    header = plan_header([top[0][c] for c in columns] if top else None, wanted, sheet.filter(~blank).isEmpty())
    rows = sheet if header.first_row_is_data else sheet.filter(F.col(order) > (top[0][order] if top else 0))
    rows = rows.filter(~blank) if header.first_row_is_data else rows
    rows = rows.limit(0) if header.is_new else rows
    existing = rows.select(*[(F.coalesce(F.col(f"`{columns[header.places[h]]}`"), F.lit("")) if h in header.places else F.lit("")).alias(h) for h in header.names], order)
    names = ("Website", "Phone", "Email", "Business Name")
    column = lambda df, c: F.col(f"`{c}`").cast("string") if c in df.columns else F.lit(None).cast("string")
    keyed = lambda df, *more: df.select(*more, *[column(df, c).alias(f"k{i}") for i, c in enumerate(names)])
    taken = keyed(existing).select(F.explode(tokens("k0", "k1", "k2", "k3")).alias("token"))
    ranked = numbered(new.withColumn("_rank", F.struct(T.priority_rank(column(new, "Priority")), F.col(order))), "_rank", "_place").drop("_rank")
    kept = greedy_distinct(keyed(ranked, "_place").select("_place", tokens("k0", "k1", "k2", "k3").alias("tokens")), "tokens", "_place", taken).select("_place")
    fresh = ranked.join(kept, "_place", "left_semi")
    fresh = fresh.select(*[(F.coalesce(F.col(f"`{h}`").cast("string"), F.lit("")) if h in new.columns else F.lit("")).alias(h) for h in header.names], F.col("_place").alias(order))
    return header, existing, fresh
