"""Structured replies inside free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import standard


def districts(reply: Column | str) -> Column:
    """The names under "districts" in the widest {...} of a reply, standard and distinct, in order; empty if there are none."""
    found = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "districts array<string>")["districts"]
    return F.coalesce(F.array_distinct(F.transform(F.filter(found, lambda x: x.isNotNull()), standard)), F.array().cast("array<string>"))


def estimates(reply: Column | str) -> Column:
    """Items {name, dist_km} of the first [...] of a reply, names standard, in order; empty if there are none."""
    found = F.from_json(F.regexp_extract(reply, r"(?s)(\[.*?\])", 1), "array<struct<name:string,dist_km:string>>")
    made = F.transform(F.filter(found, lambda x: x["name"].isNotNull()), lambda x: F.struct(standard(x["name"]).alias("name"), x["dist_km"].try_cast("double").alias("dist_km")))
    return F.coalesce(made, F.array().cast("array<struct<name:string,dist_km:double>>"))
