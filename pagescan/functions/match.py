"""Regular expressions in Spark with the meaning the patterns were written for.

The fixed patterns assume that ``\\w \\d \\s \\b`` follow Unicode, that ``.``
stops only at a line feed and that ignoring case follows Unicode.  Java has
other classes (combining marks count as word characters, superscript digits do
not) and changes some between versions, so the classes are spelled out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_CLASSES = {"\\w": r"\p{L}\p{N}_", "\\d": r"\p{Nd}", "\\s": r"\t-\r\x1c-\x1f\x85\p{Z}"}
_WORD = f"[{_CLASSES[chr(92) + 'w']}]"
_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_NO_BOUNDARY = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """The pattern with its classes spelled out for Java."""
    tokens = re.findall(r"\\.|.", pattern, re.DOTALL)
    out, in_class = [], False
    for place, token in enumerate(tokens):
        following = tokens[place + 1 : place + 3]
        if token in _CLASSES:
            token = _CLASSES[token] if in_class else f"[{_CLASSES[token]}]"
        elif token in (r"\W", r"\D", r"\S"):
            token = f"[^{_CLASSES[token.lower()]}]"
        elif token == r"\B":
            token = _NO_BOUNDARY
        elif token == r"\b" and not in_class:
            # Next to a plain letter or digit one side is known.
            if following and following[0].isalnum() and following[1:] not in (["?"], ["*"], ["{"]):
                token = f"(?<!{_WORD})"
            elif place and tokens[place - 1].isalnum():
                token = f"(?!{_WORD})"
            else:
                token = _BOUNDARY
        elif in_class and token in "[&":
            # Java would read a nested class or an intersection.
            token = "\\" + token
        elif token == "[":
            in_class = True
        elif token == "]" and in_class:
            if tokens[place - 1] == "[" or tokens[place - 2 : place] == ["[", "^"]:
                token = r"\]"
            else:
                in_class = False
        elif token == r"\Z":
            token = r"\z"
        out.append(token)
    return ("(?idu)" if ignore_case else "(?d)") + "".join(out)


def group_count(pattern: str) -> int:
    return re.compile(pattern).groups


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def folded(text: Column) -> Column:
    """Lower-cased text in which every character that equals an ASCII letter
    when case is ignored (dotless and dotted i, long s, Kelvin sign) is that
    letter, so that a substring test never misses what a regex would match."""
    for char, letter in (("ı", "i"), ("İ", "i"), ("ſ", "s"), ("K", "k")):
        text = F.replace(text, F.lit(char), F.lit(letter))
    return F.lower(text)


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    test = F.lit(False)
    for needle in needles:
        test = test | F.contains(text, F.lit(needle))
    return test


def sql_string(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# The functions below return SQL text instead of columns: a scan has some 150
# patterns, and one parsed expression is built much faster than a tree of
# thousands of column objects.  Arguments are SQL expressions.

NO_MATCHES = "cast(array() AS array<string>)"


def all_matches_sql(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {sql_string(pattern)}, {group})"


def contains_any_sql(text: str, needles: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {sql_string(needle)})" for needle in needles) + ")"


def guarded_sql(text: str, needles: Iterable[str], matches: str) -> str:
    """``matches`` if ``text`` holds one of the needles, else no matches.

    Each pattern names substrings that every match must contain, so a page
    without them skips the regex pass.
    """
    needles = tuple(needles)
    if not needles:
        return matches
    return f"CASE WHEN {contains_any_sql(text, needles)} THEN {matches} ELSE {NO_MATCHES} END"


def captured_sql(text: str, pattern: str) -> str:
    """What each match captured: the first non-empty group, or the match if there is no group."""
    regex, groups = java_regex(pattern, ignore_case=True), group_count(pattern)
    if groups <= 1:
        return all_matches_sql(text, regex, groups)
    parts = ", ".join(f"nullif(regexp_extract(m, {sql_string(regex)}, {i}), '')" for i in range(1, groups + 1))
    return f"transform({all_matches_sql(text, regex)}, m -> coalesce({parts}, ''))"


def escaped_any(words: Iterable[str]) -> str:
    """A regex that finds any of the words as plain substrings."""
    return "|".join(r"\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E" for word in words)


def _tree(words: Iterable[str]) -> dict:
    tree: dict = {}
    for word in words:
        node = tree
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}
    return tree


def _tree_regex(node: dict) -> str:
    if "" in node:
        return ""
    branches = [re.escape(char) + _tree_regex(child) for char, child in sorted(node.items())]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def word_tree(words: Iterable[str]) -> str:
    """A regex for these words, with common beginnings shared; of words that begin alike the shortest is found."""
    return _tree_regex(_tree(words))


_LIKE = {"i": "\u0130\u0131", "s": "\u017f", "k": "\u212a"}


def prefix_guard(words: Iterable[str], ignore_case: bool = False) -> str:
    """Look-ahead that holds exactly where one of the words starts; if case is ignored, also where a word starts that equals one of them then.

    A long alternation tries every word at every position; the look-ahead
    shares their beginnings, so a position that starts no word is left after
    one or two characters.  Cases are spelled out, as comparing them costs far more than a class of characters.
    """
    if ignore_case:
        tree = _tree(word.lower() for word in words)
        return f"(?-i:(?=[{''.join(_cases(char) for char in sorted(tree))}])(?={_cased_regex(tree)}))"
    tree = _tree(words)
    first = "".join(re.escape(char) for char in sorted(tree))
    return f"(?=[{first}])(?={_tree_regex(tree)})"


def _cases(char: str) -> str:
    return "".join(map(re.escape, dict.fromkeys(char + char.upper()))) + _LIKE.get(char, "")


def _cased_regex(node: dict) -> str:
    if "" in node:
        return ""
    branches = [f"[{_cases(char)}]{_cased_regex(child)}" for char, child in sorted(node.items())]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exploded(rows: DataFrame, keys: Iterable[str], values: Column, name: str) -> DataFrame:
    """One row per element of a computed array.

    A plain explode lets the optimizer filter out empty arrays ahead of it,
    which computes the array twice and moves that work below any exchange.
    The outer form with a test on its output does not.
    """
    return rows.select(*keys, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())
