"""Sensitive-data findings: rules over texts, narrow per row.

The default rules know what to look for before their expression runs; each is an expression of its own behind such tests.  Rules
from a user's table may be thousands.  They stay data: every rule gets a literal that all its matches hold, its beginning goes into one search
tree, and one pass of that tree over a text says which few rules can match there.  Only these run, so that a text costs about the
same for fifty rules and for five thousand.

A default rule whose matches hold no space or no line feed is searched for only in the pieces of a text that pass its tests; cut where no match
can be, pieces have the matches of the whole.  Matches that go on over such signs are searched for from a piece in which one can begin to the
piece in which it must have ended.
"""

from __future__ import annotations

import json
import re
import string
import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from re import _constants as parts_of
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescan import catalog
from pagescan.functions.match import (
    NO_MATCHES,
    all_matches_sql,
    contains_any_sql,
    exploded,
    folded,
    group_count,
    java_regex,
    prefix_guard,
    sql_string,
    word_tree,
)

FINDING = "struct<ord:int,rule:string,type:string,count:int,samples:array<string>,total:int>"

# A rule table is part of the query plan, so its size is bounded by what a plan can hold: some ten thousand rules.


@dataclass(frozen=True)
class Rule:
    """A named expression.

    ``needles``: substrings of which every match holds at least one; in lower
    case and searched in the folded text if ``fold``.  ``must``: a cheaper
    regex that any text with a match also matches.  ``start``: look-ahead put
    before the expression.  ``linear``: a form of the expression that is as fast on hostile text: where a match fails, it
    passes over the part in which every other start would fail the same way, as a match without ``holds``, which
    all true matches hold.  ``reach``, for matches that hold spaces or line feeds: the signs at which a text may be cut so that a match begins in a piece
    with its needle, a regex, and how many later pieces in which that is found no match that begins there goes beyond.  All of these only save time.
    """

    key: str
    label: str
    pattern: str
    needles: tuple[str, ...] = ()
    fold: bool = False
    must: str = ""
    start: str = ""
    linear: str = ""
    holds: str = ""
    reach: tuple[str, str, int] | tuple[()] = ()

    @property
    def tuned(self) -> bool:
        """Does the rule come with tests of its own?"""
        return bool(self.needles or self.must or self.start or self.linear)

    @property
    def groups(self) -> int:
        return group_count(self.pattern)

    @property
    def cut(self) -> str:
        """Signs at which a text may be cut without a change to the rule's matches: none, line feeds, or spaces too."""
        if self.reach or not (self.must or self.needles and not self.fold):
            return ""
        searched = (self.start + (self.linear or self.pattern).removeprefix("(?i)")).replace(r"\G", "")
        return next((signs for signs in CUTS if not crosses(searched, signs)), "")

    @property
    def regex(self) -> str:
        return self._java(self.linear or self.pattern, self.start)

    @property
    def inner_regex(self) -> str:
        """For a text that is one match."""
        return self._java(self.pattern, "")

    def _java(self, pattern: str, start: str) -> str:
        flags = re.match(r"\(\?i\)", pattern)
        body = pattern[flags.end():] if flags else pattern
        if start:
            body = f"{start}(?:{body})"
        return java_regex(body, ignore_case=bool(flags))


CUTS = (" \n", "\n")
PIECE, PIECES = 200, 256  # characters that a piece has at least, and how many of them the longest texts have at most


def crosses(pattern: str, signs: str) -> bool:
    """Could a match hold one of these signs, or depend on whether one of them or the end of the text is next to it?"""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # about readings that a later version may change
        return _crosses(parser.parse(pattern), signs)


def _crosses(sequence, signs: str) -> bool:
    return any(_part_crosses(kind, value, signs) for kind, value in sequence)


def _part_crosses(kind, value, signs: str) -> bool:
    if kind is parts_of.LITERAL:
        return chr(value) in signs
    if kind is parts_of.IN:
        return any(_in_class(value, sign) for sign in signs)
    if kind is parts_of.ANY:
        return signs != "\n"
    if kind is parts_of.AT:
        return value not in (parts_of.AT_BOUNDARY, parts_of.AT_NON_BOUNDARY)
    if kind is parts_of.BRANCH:
        return any(_crosses(branch, signs) for branch in value[1])
    if kind in (parts_of.MAX_REPEAT, parts_of.MIN_REPEAT, parts_of.POSSESSIVE_REPEAT):
        return _crosses(value[2], signs)
    if kind in (parts_of.SUBPATTERN, parts_of.ASSERT, parts_of.ASSERT_NOT):
        return _crosses(value[-1], signs)
    return True


def _in_class(parts, sign: str) -> bool:
    """Is a sign among those of a class?  Of named classes only white space holds one of the signs asked for."""
    found = False
    for kind, value in parts:
        if kind is parts_of.LITERAL:
            found |= chr(value) == sign
        elif kind is parts_of.RANGE:
            found |= value[0] <= ord(sign) <= value[1]
        elif kind is parts_of.CATEGORY:
            found |= value in (parts_of.CATEGORY_SPACE, parts_of.CATEGORY_NOT_DIGIT, parts_of.CATEGORY_NOT_WORD)
    return found != (parts[0][0] is parts_of.NEGATE)


_NEEDLES = {
    "private_ip": ("127.0.0.1", "10.", "172.", "192.168."),
    "email": ("@",),
    "basic_bearer": ("basic", "bearer"),
    "authorization": ("basic ", "bearer "),
    "aliyun_key": ("LTAI",),
    "tencent_key": ("AKID",),
    "baidu_key": ("AK",),
    "aws_access": ("AKIA", "ASIA"),
    "aws_key_id": ("A3T", "AKIA", "AGPA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA", "ASIA"),
    "google_api": ("AIza",),
    "firebase": ("AAAA",),
    "recaptcha": ("6L",),
    "google_oauth": ("ya29.",),
    "twilio_key": ("SK",),
    "twilio_account": ("AC",),
    "twilio_app": ("AP",),
    "stripe_live": ("sk_live_",),
    "stripe_restricted": ("rk_live_",),
    "github_url_token": ("@github.com",),
    "slack_token": ("xox",),
    "slack_webhook": ("hooks.slack.com",),
    "mailgun": ("key-",),
    "square_access": ("sqOatp-",),
    "square_oauth": ("sq0csp-",),
    "braintree": ("access_token$production$",),
    "facebook_token": ("EAACEdEose0cBA",),
    "facebook_client": ("facebook", "fb"),
    "facebook_secret": ("facebook", "fb"),
    "twitter_secret": ("twitter",),
    "linkedin_secret": ("linkedin",),
    "github_secret": ("github",),
    "aliyun_oss": (".oss.aliyuncs.com",),
    "aws_s3": ("s3.amazonaws.com",),
    "aws_s3_url": ("s3",),
    "cloudinary": ("cloudinary://",),
    "db_url": ("://",),
    "jdbc": ("jdbc:",),
    "jwt": ("ey",),
    "rsa_private": ("BEGIN RSA PRIVATE KEY",),
    "any_private": ("PRIVATE KEY-----",),
    "pgp_private": ("BEGIN PGP PRIVATE KEY BLOCK",),
    "private_block": ("PRIVATE KEY-",),
    "api_key_field": ("key",),
    "password_field": ("pass", "pwd"),
    "secret_field": ("key", "secret", "token", "config", "auth", "access", "admin", "ticket"),
    "access_key_word": ("ccess",),
    "secret_key_word": ("ecret", "ECRET"),
    "windows_path": (":\\\\",),
    "twitter_oauth": ("twitter", "|"),
}
_QUOTED_VALUE = r"""['"][0-9a-zA-Z\-_=]{6,64}['"]"""
_LONG_NUMBER = r"\d{11}"
_MUST = {
    "cn_id_card": _LONG_NUMBER,
    "cn_mobile": _LONG_NUMBER,
    "cn_company_reg": _LONG_NUMBER,
    "cn_credit_code": f"[{string.digits}{string.ascii_uppercase}]{{18}}",  # single signs of a class are looked up at once, ranges one by one
    "ipv4": r"\.[0-9]{1,3}\.[0-9]{1,3}\.",
    "mac": r"[:-][a-fA-F0-9]{2}[:-][a-fA-F0-9]{2}[:-]",
    "api_key_field": r"""[:=]\s*['"]""",
    "password_field": r"""[:=]\s*['"]""",
    "secret_field": r"""[:=]\s*['"]""",
    "named_secret": _QUOTED_VALUE,
}
# Where a match can start.  A pattern that begins with a repeated class can only
# start where a run of that class does, or right after the match before (\G).
_STARTS = {
    "github_url_token": r"(?:\G|(?<![a-zA-Z0-9_-]))",
    "aws_s3": r"(?:\G|(?<![a-zA-Z0-9_-])|(?=s3\.))",
    "private_block": r"(?=-)(?:\G|(?<!-))",
    "private_ip": r"(?=1(?:0\.|27\.|72\.|92\.))",
    "cn_id_card": r"(?=[1-9]\d{5})",
    "cn_mobile": r"(?=1)",
    "cn_credit_code": r"(?=[0-9A-Z]{18})",
    "cn_company_reg": r"(?=\d{13})",
    "ipv4": r"(?=[0-9])",
    "mac": r"(?=[a-fA-F0-9]{2}[:-])",
    "twitter_oauth": r"(?=[t|T][w|W])",
    "jwt": r"(?=ey)",
    "basic_bearer": prefix_guard(("basic", "bearer")),
    "named_secret": prefix_guard(catalog.SECRET_NAMES),
} | {
    key: prefix_guard(words, ignore_case=True)
    for key, words in {
        "authorization": ("basic ", "bearer "),
        "facebook_client": ("facebook", "fb"),
        "facebook_secret": ("facebook", "fb"),
        "twitter_secret": ("twitter",),
        "linkedin_secret": ("linkedin",),
        "github_secret": ("github",),
        "db_url": ("mysql://", "postgresql://", "mongodb://", "redis://", "oracle://", "sqlserver://"),
        "api_key_field": ("api", "access", "secret"),
        "password_field": ("pass", "pwd", "userpass"),
        "secret_field": ("key", "secret", "token", "config", "auth", "access", "admin", "ticket"),
    }.items()
}


LONGEST = 120  # characters that matches with `_SHORT` have at most, and one that they look at
_SHORT, _QUOTES = (" \n", rf"(?s).{{{LONGEST}}}", 1), (" \n", r"""['"]""", 2)
_REACH = {
    "basic_bearer": (" \n", r"\S", 1),
    "db_url": (" \n", "@", 1),
    "private_block": ("\n", "-", 1),
    "api_key_field": _QUOTES,
    "password_field": _QUOTES,
    "secret_field": _QUOTES,
    "authorization": _SHORT,
    "facebook_client": _SHORT,
    "facebook_secret": _SHORT,
    "twitter_oauth": _SHORT,
    "twitter_secret": _SHORT,
    "linkedin_secret": _SHORT,
    "github_secret": _SHORT,
}


def _literal_start(pattern: str) -> str:
    """Look-ahead for the text that all matches begin with, if there is one behind a word boundary."""
    literal = re.match(r"\\b((?:[\w-]|\\[.$])+)(?![?*+{|\w-])", pattern)
    return f"(?={literal[1]})" if literal and "|" not in pattern else ""

_SPACED = r"[\s]*[^-]*"


def _linear(key: str, pattern: str) -> tuple[str, str]:
    """The linear form of a rule and what its true matches hold.

    A repeated class with no bound is read again from every start in it.  All those starts come to the same end and fail
    there alike, so after the first failure the rest of the class is passed over.
    """
    if key == "email":
        # A match ends its local part at an @; without a match no start before that @ has one, and signs that no word touches start none.
        local = r"[a-zA-Z0-9._%+-]"
        return rf"{pattern}|\b{local}++|[.%+-]++".replace("a-zA-Z0-9", string.ascii_letters + string.digits), "@"
    if key == "db_url":
        head, _, tail = pattern.partition("[^@]+@")
        return rf"{head}(?:[^@]+@{tail}|[^@]*+)", "@"
    if key == "jdbc":
        head, _, tail = pattern.partition("[a-z:]+://")
        return rf"{head}(?:[a-z:]+://{tail}|[a-z:]*+)", "//"
    if key == "jwt":
        run = "[A-Za-z0-9-_=]"
        head, _, tail = pattern.partition(run)
        return rf"{head}(?:{run}{tail}|{run}*+)", "."
    if key == "aws_s3_url":
        # Its first form begins with the class: it is tried at the start of a run or right after the match before.
        return rf"(?:\G|(?<![a-zA-Z0-9._-])){pattern}", "s3"
    if key == "private_block":
        # White space is among the signs that are no dash.
        return pattern.replace(_SPACED, "[^-]*+"), "BEGIN"
    return "", ""


def _default_pattern(key: str, pattern: str | None) -> str:
    if key == "named_secret":
        names = "|".join(name.replace(".", r"\.") for name in catalog.SECRET_NAMES)
        return f"({names}){catalog.SECRET_TAIL}"
    if key == "windows_path":
        # Possessive repetition: what follows may be empty, so nothing is ever
        # given back, and Java then repeats the group without recursion.
        return pattern.replace(")*[", ")*+[")
    return pattern


def default_rules() -> list[Rule]:
    return [
        Rule(
            key,
            label,
            _default_pattern(key, pattern),
            _NEEDLES.get(key, ()),
            (pattern or "").startswith("(?i)") or key == "twitter_oauth",
            _MUST.get(key, ""),
            _STARTS.get(key) or _literal_start(pattern or ""),
            *_linear(key, pattern or ""),
            _REACH.get(key, ()),
        )
        for key, label, pattern in catalog.RULES
    ]


def custom_rules(patterns: Mapping[str, str] | DataFrame) -> list[Rule]:
    """Rules from a name -> expression mapping or a (type, pattern) table.

    All rows of a table are rules, also those with one type, in the order of its
    ``ord`` column or else of type and pattern.  A rule whose expression does
    not compile is left out with a warning, the others go on.
    """
    if isinstance(patterns, DataFrame):
        order = ["ord"] if "ord" in patterns.columns else ["type", "pattern"]
        named = [(row["type"], row["pattern"]) for row in patterns.orderBy(*order).select("type", "pattern").collect()]
    else:
        named = list(patterns.items())
    return _compiled([Rule(name, name, re.sub(r"\(\?P<\w+>", "(", pattern)) for name, pattern in named])


def _compiled(rules: list[Rule]) -> list[Rule]:
    """The rules that compile: all are tried at once, and a bad half is tried in halves."""
    if not rules:
        return []
    try:
        for rule in rules:
            re.compile(rule.pattern)
        # As rows, not as columns: thousands of rules are one small plan.
        table = SparkSession.active().createDataFrame([(rule.regex,) for rule in rules], "regex string")
        table.select(F.rlike(F.lit("x"), F.col("regex"))).collect()
        return rules
    except Exception as error:  # a bad expression must not stop the others
        if len(rules) == 1:
            warnings.warn(f"rule {rules[0].label!r} left out: {str(error).splitlines()[0]}", stacklevel=2)
            return []
    half = len(rules) // 2
    return _compiled(rules[:half]) + _compiled(rules[half:])


_UNPRINTABLE = r"[\p{C}\p{Zl}\p{Zp}\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"


def _repr_sql(text: str) -> str:
    """SQL for a text in single quotes, or in double ones if it holds single ones;
    characters that do not print are escaped."""
    escaped = text
    for char, code in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = f"replace({escaped}, {sql_string(char)}, {sql_string(code)})"
    unprintable, single, double = sql_string(_UNPRINTABLE), sql_string("'"), sql_string('"')
    number = "lower(hex(ascii(c)))"
    code = f"""CASE WHEN ascii(c) < 256 THEN concat('\\\\x', lpad({number}, 2, '0'))
        WHEN ascii(c) < 65536 THEN concat('\\\\u', lpad({number}, 4, '0'))
        ELSE concat('\\\\U', lpad({number}, 8, '0')) END"""
    shown = f"""CASE WHEN rlike(e, {unprintable}) THEN array_join(transform(regexp_extract_all(e, '(?s).', 0),
        c -> CASE WHEN rlike(c, {unprintable}) THEN {code} ELSE c END), '') ELSE e END"""
    quoted = f"replace(e, {single}, {sql_string(chr(92) + chr(39))})"
    return f"""transform(transform(array({escaped}), e -> {shown}),
        e -> CASE WHEN contains(e, {single}) AND NOT contains(e, {double})
            THEN concat({double}, e, {double}) ELSE concat({single}, {quoted}, {single}) END)[0]"""


def _samples_sql(text: str, rule: Rule, mode: str) -> str:
    """What a rule reports: the whole match, its one group, or its groups as a tuple."""
    matches = all_matches_sql(text, rule.regex)
    if rule.holds:
        matches = f"filter({matches}, m -> contains(m, {sql_string(rule.holds)}))"
    if mode == "match" or rule.groups == 0:
        return matches
    if rule.groups == 1 and not rule.linear:
        return all_matches_sql(text, rule.regex, 1)
    regex = sql_string(rule.inner_regex if rule.linear else rule.regex)
    if rule.groups == 1:
        return f"transform({matches}, m -> regexp_extract(m, {regex}, 1))"
    groups = ", ".join(f"regexp_extract(m, {regex}, {i})" for i in range(1, rule.groups + 1))
    shown = f"array_join(transform(array({groups}), g -> {_repr_sql('g')}), ', ')"
    return f"transform({matches}, m -> concat('(', {shown}, ')'))"


def pieces_sql(text: str, signs: str) -> str:
    """A text cut at some of these signs; each piece but the last ends with one."""
    size = f"greatest({PIECE}, length({text}) div {PIECES})"
    return f"regexp_extract_all({text}, concat('(?s).{{1,', {size}, {sql_string(f'}}+[^{signs}]*+[{signs}]?')}), 0)"


def passing_sql(pieces: str, test: str) -> str:
    """The pieces, named p in the test, that pass it, as one text."""
    return f"array_join(filter({pieces}, p -> {test}), '')"


def reaching_sql(pieces: str, piece: str, test: str, ends: str, count: int) -> str:
    """The pieces p that pass the test and those after each, to the one in which ``ends`` is found for the so manyth time, as one text."""
    kept = f"concat(s.kept, array({piece}))"
    return f"""aggregate({pieces}, named_struct('kept', {NO_MATCHES}, 'more', 0), (s, p) -> CASE
        WHEN {test} THEN named_struct('kept', {kept}, 'more', {count})
        WHEN s.more > 0 THEN named_struct('kept', {kept}, 'more', s.more - int(rlike({piece}, {sql_string(java_regex(ends))})))
        ELSE s END, s -> array_join(s.kept, ''))"""


def searched_sql(rule: Rule, pieces: Mapping[str, str]) -> str:
    """What a rule searches of a text, for a rule that need not search it all.  ``pieces``: columns that hold the cut texts."""
    if rule.reach:
        signs, ends, count = rule.reach
        piece, tested = ("p.text", "p.low") if rule.fold else ("p", "p")
        return reaching_sql(pieces["low" + signs if rule.fold else signs], piece, contains_any_sql(tested, rule.needles), ends, count)
    test = f"rlike(p, {sql_string(java_regex(rule.must))})" if rule.must else contains_any_sql("p", rule.needles)
    return passing_sql(pieces[rule.cut], test)


def rule_samples_sql(text: str, low: str, rule: Rule, mode: str, musts: Mapping[str, str], searched: Mapping[Rule, str]) -> str:
    """Distinct samples of a rule in a text, sorted.  ``musts`` and ``searched``: columns for the tests and the parts of the text that rules share."""
    part, tests = searched.get(rule, text), []
    if part != text:
        tests.append(f"{part} <> ''")
    elif rule.needles:
        tests.append(contains_any_sql(low if rule.fold else text, rule.needles))
    if rule.must and not rule.cut:
        tests.append(musts[rule.must])
    found = f"array_sort(array_distinct({_samples_sql(part, rule, mode)}))"
    return f"CASE WHEN {' AND '.join(tests)} THEN {found} ELSE {NO_MATCHES} END" if tests else found


SHORTEST, WORD = 4, 12  # characters of a literal that the search tree holds


def needed_literals(pattern: str) -> list[str]:
    """Lower-case texts of which every match holds one; none if the expression says too little.

    Of several such sets the one whose shortest text is longest.
    """
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # about readings that a later version may change
        found = _needed(parser.parse(pattern))
    return sorted(found) if found and min(map(len, found)) >= SHORTEST else []


def _needed(sequence) -> set[str]:
    sets, run = [], ""
    for kind, value in [*sequence, (None, None)]:
        if kind is parts_of.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if run:
            sets.append({run})
            run = ""
        if kind is parts_of.SUBPATTERN:
            sets.append(_needed(value[-1]))
        elif kind in (parts_of.MAX_REPEAT, parts_of.MIN_REPEAT, parts_of.POSSESSIVE_REPEAT) and value[0] > 0:
            sets.append(_needed(value[2]))
        elif kind is parts_of.ATOMIC_GROUP:
            sets.append(_needed(value))
        elif kind is parts_of.BRANCH:
            branches = [_needed(branch) for branch in value[1]]
            sets.append(set().union(*branches) if all(branches) else set())
    return max(filter(None, sets), key=lambda texts: (min(map(len, texts)), -len(texts)), default=set())


def _rule_table(rules: list[tuple[int, Rule]]) -> tuple[list[dict], dict[str, list[int]], list[int]]:
    """The rules as data, the places of the rules behind each word of the search tree, and those of the rules without one.

    A word is the beginning of a literal.  One that begins with another word is found through that.
    """
    literals = [needed_literals(rule.pattern) for _, rule in rules]
    words: dict[str, list[int]] = {}
    for word, place in sorted({(text[:WORD], place) for place, texts in enumerate(literals) for text in texts}):
        shorter = next((word[:size] for size in range(SHORTEST, len(word)) if word[:size] in words), word)
        words.setdefault(shorter, []).append(place)
    table = [
        {"ord": ord_, "key": rule.key, "label": rule.label, "regex": rule.regex, "groups": rule.groups, "literals": texts}
        for (ord_, rule), texts in zip(rules, literals)
    ]
    return table, words, [place for place, texts in enumerate(literals) if not texts]


def table_findings_sql(text: str, low: str, rules: list[tuple[int, Rule]], mode: str) -> str:
    """Findings of the rules that the words found in a text call for; the rules are constants, not expressions."""
    def constant(value, kind: str) -> str:
        return f"from_json({sql_string(json.dumps(value))}, '{kind}')"

    table, words, always = _rule_table(rules)
    of = constant(table, "array<struct<ord:int,key:string,label:string,regex:string,groups:int,literals:array<string>>>")
    called = constant(always, "array<int>")
    if words:
        seen = f"array_distinct(regexp_extract_all({low}, {sql_string(f'(?s)(?=({word_tree(words)}))')}, 1))"
        called = f"concat({called}, flatten(transform({seen}, w -> try_element_at({constant(words, 'map<string,array<int>>')}, w))))"
    called = f"transform(array_sort(array_distinct({called})), i -> get({of}, i))"
    called = f"filter({called}, r -> size(r.literals) = 0 OR exists(r.literals, l -> contains({low}, l)))"
    groups = f"array_join(transform(transform(sequence(1, r.groups), i -> regexp_extract(m, r.regex, i)), g -> {_repr_sql('g')}), ', ')"
    whole = "true" if mode == "match" else "r.groups = 0"
    samples = f"""CASE WHEN {whole} THEN regexp_extract_all({text}, r.regex, 0)
        WHEN r.groups = 1 THEN regexp_extract_all({text}, r.regex, 1)
        ELSE transform(regexp_extract_all({text}, r.regex, 0), m -> concat('(', {groups}, ')')) END"""
    return f"""transform({called}, r -> named_struct('ord', r.ord, 'rule', r.key, 'type', r.label,
        'samples', array_sort(array_distinct({samples}))))"""


def findings_array(text: str, low: str, rules: Iterable[Rule], mode: str, musts: Mapping[str, str], searched: Mapping[Rule, str]) -> Column:
    """Findings of a text in rule order."""
    found, others = [], []
    for ord_, rule in enumerate(rules, 1):
        if not rule.tuned:
            others.append((ord_, rule))
            continue
        samples = rule_samples_sql(text, low, rule, mode, musts, searched)
        found.append(
            f"named_struct('ord', {ord_}, 'rule', {sql_string(rule.key)}, 'type', {sql_string(rule.label)}, "
            f"'samples', {samples})"
        )
    arrays = ([f"array({', '.join(found)})"] if found else []) + ([table_findings_sql(text, low, others, mode)] if others else [])
    every = arrays[0] if len(arrays) == 1 else f"array_sort(concat({', '.join(arrays)}))"
    return F.expr(
        f"""transform(filter({every}, f -> size(f.samples) > 0), f -> named_struct(
            'ord', f.ord, 'rule', f.rule, 'type', f.type, 'count', size(f.samples), 'samples', f.samples,
            'total', size(f.samples)))"""
    )


def with_findings(texts: DataFrame, text: str = "text", rules: Iterable[Rule] | None = None, mode: str = "findall",
                  keep_text: bool = False) -> DataFrame:
    """Rows plus ``sensitive_raw``, the findings of their text.

    The text column is dropped unless asked for, so that it does not travel
    further than the stage that read it.
    """
    rules = default_rules() if rules is None else list(rules)
    keys = [c for c in texts.columns if keep_text or c != text]
    if not rules:
        return texts.select(*keys, F.array().cast(f"array<{FINDING}>").alias("sensitive_raw"))
    # Computed once per text: its pieces, the folded text, the tests that rules share and what of the text they search.
    pieces = {signs: f"_pieces_{i}" for i, signs in enumerate(CUTS)}
    cut, low = texts.withColumns({name: F.expr(pieces_sql(f"`{text}`", signs)) for signs, name in pieces.items()}), folded(F.col(text))
    for signs in sorted({r.reach[0] for r in rules if r.fold and r.reach}):
        both = F.transform(F.col(pieces[signs]), lambda p: F.struct(p.alias("text"), folded(p).alias("low")))
        pieces["low" + signs] = name = f"_low{pieces[signs]}"
        cut, low = cut.withColumn(name, both), F.array_join(F.col(f"{name}.low"), "")
    musts = {must: f"_must_{i}" for i, must in enumerate(sorted({r.must for r in rules if r.must and not r.cut}))}
    parts = {r: searched_sql(r, pieces) for r in rules if r.cut or r.reach}
    names = {part: f"_part_{i}" for i, part in enumerate(dict.fromkeys(parts.values()))}
    tests = {name: F.col(text).rlike(java_regex(must)) for must, name in musts.items()}
    low = cut.withColumns({"low": low, **tests, **{name: F.expr(part) for part, name in names.items()}})
    found = findings_array(f"`{text}`", "low", rules, mode, musts, {rule: names[part] for rule, part in parts.items()})
    empty = F.array().cast(f"array<{FINDING}>")
    return low.select(*keys, F.when(F.length(text) > 0, found).otherwise(empty).alias("sensitive_raw"))


def findings(texts: DataFrame, text: str = "text", rules: Iterable[Rule] | None = None,
             mode: str = "findall") -> DataFrame:
    """One row per text and rule that hits."""
    wide = with_findings(texts, text, rules, mode)
    keys = [c for c in wide.columns if c != "sensitive_raw"]
    return exploded(wide, keys, F.col("sensitive_raw"), "f").select(*keys, "f.*")


def finding_types(texts: DataFrame, text: str = "text", rules: Iterable[Rule] | None = None) -> DataFrame:
    """Number of rules that hit each text."""
    wide = with_findings(texts, text, rules)
    return wide.withColumn("n_types", F.size("sensitive_raw")).drop("sensitive_raw")


def flat(sensitive_raw: Column) -> tuple[Column, Column, Column]:
    """Types, counts and details of findings as three pipe-joined texts."""
    details = F.transform(
        sensitive_raw,
        lambda f: F.concat(
            f["type"],
            F.lit(":"),
            F.when(F.size(f["samples"]) > 0, F.array_join(f["samples"], "; ")).otherwise(catalog.NO_SAMPLE),
        ),
    )
    return (
        F.array_join(F.transform(sensitive_raw, lambda f: f["type"]), "|"),
        F.array_join(F.transform(sensitive_raw, lambda f: f["count"].cast("string")), "|"),
        F.array_join(details, "|"),
    )


def summary(sensitive_raw: Column) -> Column:
    """``typeXcount`` of every finding in one text."""
    return F.array_join(
        F.transform(sensitive_raw, lambda f: F.concat(f["type"], F.lit("X"), f["count"].cast("string"))),
        catalog.SUMMARY_SEPARATOR,
    )
