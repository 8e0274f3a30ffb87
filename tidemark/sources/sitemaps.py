"""Sitemaps and their indexes, read as XML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "sitemap array<struct<loc:string>>, url array<struct<loc:string>>, bad string"


def read(body: Column) -> Column:
    """struct(locations, valid): addresses that an index or a set names, in order and not empty; a text that isn't XML has none.

    Comments, CDATA, entities and prefixes are what they are in XML; addresses of images and the like aren't those of pages. External entities aren't read.
    """
    told = F.from_xml(body, SCHEMA, {"mode": "PERMISSIVE", "ignoreNamespace": "true", "columnNameOfCorruptRecord": "bad"})
    none = F.array().cast("array<struct<loc:string>>")
    every = F.transform(F.concat(F.coalesce(told["sitemap"], none), F.coalesce(told["url"], none)), lambda x: F.trim(x["loc"]))
    return F.struct(F.filter(every, lambda u: F.coalesce(u, F.lit("")) != "").alias("locations"), (told.isNotNull() & told["bad"].isNull()).alias("valid"))
