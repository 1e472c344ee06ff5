"""Percent-encoding of URI parts and forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape(text: Column) -> Column:
    """All bytes but letters, digits and ``-._~`` as %XX."""
    form = F.url_encode(text)  # the form encoding differs in three characters
    return F.replace(F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def unescape(text: Column) -> Column:
    """%XX as bytes again; a ``%`` without two hex digits and a ``+`` stand for themselves."""
    plain = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(plain)


def parse_form(query: Column) -> Column:
    """``key=value&...`` as a list of structs ``key``, ``value``, both unescaped; a part without a key or a value is an error."""
    parts = F.filter(F.split(query, "&"), lambda x: x != "")
    ok = F.forall(parts, lambda x: F.regexp_like(x, F.lit("^[^=]+=.+$")))
    pair = lambda x: F.struct(unescape(F.substring_index(x, "=", 1)).alias("key"), unescape(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("value"))
    return F.transform(F.when(F.assert_true(F.coalesce(ok, F.lit(True)), F.lit("a form is key=value&...")).isNull(), parts), pair)


def encode_form(pairs: Column) -> Column:
    """A list of structs ``key``, ``value`` as ``key=value&...``."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(escape(p["key"]), F.lit("="), escape(p["value"]))), "&")
