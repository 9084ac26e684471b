"""Review blobs in JSON: reviews as maps, their ratings and texts, and the complaints among them."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import short_number, shorten

#: Keys that may hold a review's rating and text (fixed values).
RATING_KEYS = ("rating", "stars", "score", "star_rating")
TEXT_KEYS = ("text", "snippet", "comment", "body", "description", "review_text")
#: Columns that may hold a blob, complaints are below so many stars, at most so many are kept, of so many characters (fixed values).
BLOB_COLUMNS = ("user_reviews_extended", "user_reviews", "reviews", "reviews_data")
STARS, KEPT, CHARACTERS = 3, 5, 400


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing more. The parser stops behind the first value, so the text is put into a list
    and into an object: what follows a value breaks one of them."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()


def _literal(text: pd.Series) -> pd.Series:
    """Python literals of a list or mapping as JSON, null for what is none."""

    def one(t):
        if t is None:
            return None
        try:
            value = ast.literal_eval(t)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        return json.dumps(value, default=str) if isinstance(value, dict | list) else None

    return text.map(one, na_action="ignore")


def reviews(c: Column, literals: bool = True) -> Column:
    """The reviews of a blob as maps of text, keys in lower case: a JSON list's or a single JSON object, or, with ``literals``, the
    same as a Python literal. Entries that are no objects are left out; null, blank and damaged blobs give an empty array.

    JSON is read natively; a Python worker sees only what begins like a list or mapping and is no JSON.
    """
    text = F.trim(c)
    elements = lambda t: F.coalesce(F.from_json(t, "array<string>"), F.when(t.startswith("{"), F.array(t)))
    good = is_json(text)
    found = F.when(good & text.rlike(r"^[\[{]"), elements(text))
    if literals:
        other = F.pandas_udf(_literal, "string")(F.when(~good & text.rlike(r"^[\[{]"), text))
        found = F.coalesce(found, elements(other))
    maps = F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x: F.when(F.trim(x).startswith("{"), F.from_json(x, "map<string,string>"))), lambda m: m.isNotNull())
    return F.transform(maps, lambda m: F.map_from_entries(F.array_distinct(F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))))


def first_key(review: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys that holds something."""
    return F.coalesce(*[F.nullif(review[k], F.lit("")) for k in keys])


def complaints(found: Column, below: float = STARS) -> Column:
    """'(stars★) text' of each review under ``below`` stars with a text, in order; long texts are shortened. Names are left out."""
    rating = lambda r: F.when(~F.isnan(first_key(r, RATING_KEYS).try_cast("double")), first_key(r, RATING_KEYS).try_cast("double"))
    text = lambda r: F.trim(F.regexp_replace(first_key(r, TEXT_KEYS), r"\s+", " "))
    low = F.filter(found, lambda r: (rating(r) < below) & (F.coalesce(text(r), F.lit("")) != ""))
    return F.transform(low, lambda r: F.concat(F.lit("("), short_number(rating(r)), F.lit("★) "), shorten(text(r), CHARACTERS)))


def negative_reviews(all_complaints: Column, kept: int = KEPT) -> Column:
    """The first ``kept`` complaints and how many more there are, joined by bars."""
    more = F.when(F.size(all_complaints) > kept, F.array(F.concat(F.lit("...(+"), (F.size(all_complaints) - kept).cast("string"), F.lit(" more)")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.slice(all_complaints, 1, kept), more), " | ")
