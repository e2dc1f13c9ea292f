"""String columns: descriptions, item texts, tokens and vector texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_or_empty(col: Column | str) -> Column:
    """First element of an array; '' for an empty or missing one."""
    return F.coalesce(F.get(F.col(col) if isinstance(col, str) else col, F.lit(0)), F.lit(""))


def joined_text(title: Column | str, description: Column | str) -> Column:
    """Title and first description with one blank between them, also when a side is empty."""
    title = F.col(title) if isinstance(title, str) else title
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), first_or_empty(description))


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def vec_to_text(vector: Column | str) -> Column:
    """Blank-separated text of a vector. Each number has the digits that tell it from others of its precision."""
    return F.array_join(F.transform(vector, lambda x: x.cast("string")), " ")


def text_to_vec(text: Column | str) -> Column:
    """Vector of a blank-separated text; NULL and '' give NULL."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.trim(text), r"\s+")
    return F.when(F.trim(text) != "", F.transform(parts, lambda x: x.cast("float")))
