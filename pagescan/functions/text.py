"""Body decoding, HTML entities and titles."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from pagescan import catalog
from pagescan.functions.match import all_matches

_SPACE = r"[\s\x1c-\x1f]"
_ENTITY = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&"

# The six entities that nearly all pages use are replaced directly.
_COMMON = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


_WINDOWS = [ord(bytes([b]).decode("cp1252", "ignore") or chr(b)) for b in range(128, 160)]


def _code_point(token: Column) -> Column:
    """Character for a numeric reference; invalid numbers give U+FFFD."""
    digits = F.regexp_replace(token, "[&#xX;]", "")
    is_hex = token.rlike("^&#[xX]")
    plain = F.regexp_replace(digits, "^0+", "")
    number = F.when(~is_hex, plain).when(F.length(plain) <= 8, F.conv(plain, 16, 10)).try_cast("bigint")
    # The standard reads these 32 numbers as Windows-1252.
    number = F.when(number.between(128, 159), F.element_at(F.array(*map(F.lit, _WINDOWS)), (number - 127).cast("int"))).otherwise(number)
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    hexed = F.lpad(F.hex(F.when(valid, number).otherwise(F.lit(0xFFFD))), 8, "0")
    return F.decode(F.unhex(hexed), "UTF-32")


def decode_entities(text: Column) -> Column:
    """Text with HTML character references replaced.

    Common ones by plain replacement; only texts that still hold a reference
    go through the full name table, which comes from the standard library.
    """
    simple = text
    for entity, char in _COMMON:
        simple = F.replace(simple, F.lit(entity), F.lit(char))
    simple = F.replace(simple, F.lit("&amp;"), F.lit("&"))
    names = {f"&{name}": chars for name, chars in html5.items()}
    table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    # Names the standard also knows without their semicolon; the longest that begins a token counts.
    bare = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True))

    def named(token: Column) -> Column:
        known = F.regexp_extract(token, rf"^&(?:{bare})", 0)
        return F.coalesce(table[token], F.concat(table[known], F.substr(token, F.length(known) + 1)), token)

    tokens = F.transform(
        all_matches(text, _ENTITY, 0),
        lambda t: F.when(t.rlike("^&#[xX0-9]"), _code_point(t)).when(t.rlike("^&[a-zA-Z]"), named(t)).otherwise(t),
    )
    rare = text.rlike(r"&#(?!39;)|&(?!lt;|gt;|quot;|nbsp;|amp;)[a-zA-Z]")
    return F.when(~F.contains(text, F.lit("&")), text).when(rare, F.array_join(tokens, "")).otherwise(simple)


def hide_inactive(html: Column) -> Column:
    """Page without comments and without the bodies of scripts and styles.

    A quote without a partner is a character of its tag, and a tag that is never closed runs to the end, so that
    nothing inside it is tried again.
    """
    return F.regexp_replace(
        html,
        r"(?is)<!--.*?(?:-->|\z)|(<(script|style)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+(?:>|\z)).*?(?=</\2|\z)",
        "$1",
    )


def title_of(html: Column) -> Column:
    """Text of the first title element: trimmed, one line, entities decoded."""
    ahead = F.lower(F.regexp_extract(html, r"(?is)^(.*?)<title", 1))
    visible = F.when(
        F.contains(ahead, F.lit("<!--")) | F.contains(ahead, F.lit("<script")) | F.contains(ahead, F.lit("<style")),
        hide_inactive(html),
    ).otherwise(html)
    # Up to the last bracket every open tag closes, so the first one found is the one, without a second try.
    closed = F.left(visible, F.length(visible) - F.length(F.substring_index(visible, ">", -1)))
    raw = F.regexp_extract(closed, r"(?is)\A(?>.*?<title(?:\s[^>]*+)?+>)(.*?)</title\s*+>", 1)
    plain = F.when(raw.rlike(r"<[a-zA-Z/!]"), F.lit("")).otherwise(raw)
    return F.regexp_replace(strip(decode_entities(plain)), r"[\r\n]", "")


def longest_title(contents: Column) -> Column:
    """Longest title over candidate decodings, the first one on ties.

    No candidate at all gives the text ``None``.
    """
    titles = F.transform(contents, lambda c: title_of(c))
    best = F.aggregate(
        titles,
        F.lit(None).cast("string"),
        lambda best, t: F.when(best.isNull() | (F.length(t) > F.length(best)), t).otherwise(best),
    )
    return F.coalesce(best, F.lit("None"))


@F.pandas_udf(StringType())
def _decode_declared(body: pd.Series, charset: pd.Series) -> pd.Series:
    def one(data, name):
        if data is None:
            return None
        try:
            codecs.lookup(name)
        except LookupError:
            name = "utf-8"
        return bytes(data).decode(name, "replace")

    return pd.Series([one(data, name) for data, name in zip(body, charset)], dtype=object)


def decode_body(body: Column, charset: Column) -> Column:
    """Body text in its declared charset, invalid bytes replaced.

    No charset, or ISO-8859-1 (which servers send by default), means UTF-8.
    UTF-8 bodies are decoded in the JVM; only other charsets reach Python, and
    for the rest no body is sent there.
    """
    name = F.lower(F.coalesce(charset, F.lit("")))
    utf8 = name.isin("", "iso-8859-1", "utf-8", "utf8", "us-ascii", "ascii")
    other = _decode_declared(F.when(~utf8, body), F.when(~utf8, name))
    return F.when(utf8, F.make_valid_utf8(body.cast("string"))).otherwise(other)


def text_for_links(body: Column) -> Column:
    """Body as UTF-8 text with invalid bytes dropped."""
    text = body.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(
        F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))
    )


def decoded_candidates(encodings: Iterable[str] = tuple(catalog.TITLE_ENCODINGS)):
    """UDF: body -> texts of all encodings that decode it without error."""
    encodings = tuple(encodings)

    @F.pandas_udf(ArrayType(StringType()))
    def candidates(body: pd.Series) -> pd.Series:
        def one(data):
            texts = []
            for encoding in encodings:
                try:
                    texts.append(bytes(data).decode(encoding).encode("utf-8", "replace").decode("utf-8"))
                except UnicodeDecodeError:
                    continue
            return texts

        return pd.Series([None if data is None else one(data) for data in body], dtype=object)

    return candidates
