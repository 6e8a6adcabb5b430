"""Visible text of HTML, by regular expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseam.functions.text import strip

# The named entities that are undone; numbers of other characters stay.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def visible_text(c: Column) -> Column:
    """Without comments, scripts, styles and tags; entities undone, white space single."""
    t = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?is)<(script|style)\b.*?</(script|style)\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, to in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(to))
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))
