import random
import re
import time
import warnings

import pytest
from pyspark.sql import functions as F

from pagescan.operators import detect
from registry.inputs import SEEDS, seeded_documents

RULES = {rule.key: rule for rule in detect.default_rules()}
H16, H32 = "0123456789abcdef", "0123456789abcdef" * 2


def plain(rule):
    """The rule as its author wrote it."""
    return rule.pattern.replace(")*+[", ")*[")


def expected_samples(rule, text):
    return sorted({str(m) if isinstance(m, tuple) else m for m in re.findall(plain(rule), text)})


def found(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for row in detect.findings(rows, **options).collect():
        assert row["count"] == row.total == len(row.samples)
        got.setdefault(row.doc_id, {})[row.rule] = row.samples
    return got


def same_as_library(spark, texts):
    got = found(spark, texts)
    for number, text in enumerate(texts):
        want = {key: expected_samples(rule, text) for key, rule in RULES.items()}
        assert got.get(number, {}) == {key: samples for key, samples in want.items() if samples}, text[:200]


def test_there_are_56_rules_in_order():
    assert len(RULES) == 56
    assert list(RULES)[0] == "cn_id_card" and list(RULES)[-1] == "named_secret"


def test_named_secret_is_one_alternation():
    rule = RULES["named_secret"]
    assert rule.groups == 3
    assert rule.pattern.startswith(r"(access_key|Access-Key|") and r"api\.googlemaps" in rule.pattern


CASES = [
    ("cn_id_card", "x 11010519900307123X y", ["11010519900307123X"]),
    ("cn_id_card", "11010519901307123X", []),
    ("cn_mobile", "13800000000 and 13800000000", ["13800000000"]),
    ("cn_mobile", "12800000000", []),
    ("private_ip", "10.0.0.1 127.0.0.1 172.16.3.4 172.32.0.1", ["('10.0.0.1', '')", "('127.0.0.1', '')", "('172.16.3.4', '16')"]),
    ("ipv4", "256.1.1.1 1.2.3.4", ["1.2.3.4"]),
    ("mac", "aa:bb:cc:dd:ee:ff", ["ee:"]),
    ("email", "a@b.json a@b.com", ["a@b.com"]),
    ("email", "a@b.example.js", ["a@b.example"]),
    ("aws_key_id", "AK" + "IA" + "ABCDEFGHIJKLMNOP", ["AKIA"]),
    ("db_url", "MySQL" + "://u:p@h.example.com:3306/d", ["MySQL"]),
    ("secret_key_word", "SecretKey SECRET_KEY", ["('ECRET', 'EY')", "('ecret', 'ey')"]),
    ("access_key_word", "AccessKey accessKeyId", ["", "accessKeyId"]),
    ("password_field", "passwd = 'a b c d'", ["passwd"]),
    ("facebook_client", "fb it's \"" + "1" * 15 + '"', ["('fb', \" it's \")"]),
    ("windows_path", r"C:\\a\\b c C:\x", [r"C:\\a\\b c C"]),
    ("aliyun_oss", "ab.oss.aliyuncs.com w.oss.aliyuncs.com", ["w.oss.aliyuncs.com"]),
]


@pytest.mark.parametrize("key,text,expected", CASES)
def test_cases(spark, key, text, expected):
    assert found(spark, [text]).get(0, {}).get(key, []) == expected


def seeded_text(number):
    import hashlib

    digest, text = hashlib.md5(str(number).encode()).hexdigest(), SEEDS
    for size in (32, 16, 8, 2):
        text = text.replace(f"{{h{size}}}", digest[:size]).replace(f"{{H{size}}}", digest[:size].upper())
    return text.replace("{d8}", f"{number:08d}").replace("{d3}", f"{number % 1000:03d}").replace("{b}", str(number % 256))


def test_every_rule_agrees_with_the_standard_library(spark):
    texts = [seeded_text(n) for n in range(5)]
    assert all(re.search(plain(rule), texts[0]) for rule in RULES.values())
    same_as_library(spark, texts)


def test_near_misses_and_other_scripts_agree_with_the_standard_library(spark):
    base = seeded_text(11)
    texts = [
        base.upper(), base.lower(), base.replace(" ", "é"), base.replace(" ", "中"), base.replace("\n", "\r"),
        base.replace(" ", " "), base.replace(" ", "_"), base.replace("0", "٠"), base.replace("'", '"'), base.replace("s", "ſ").replace("k", "K"),
        base[::-1], base.replace("=", ": "), "", " ", "é1.2.3.4é 1.2.3.4٣",
        base.replace(" ", "\u0e35"), base.replace(" ", "²"), base.replace(" ", "\x1c"), base.replace(" ", "\u0301"), base.replace(" ", "\u200d"),
        base.replace(" ", "\u2028"), base.replace(" ", "\x85"), base.replace(" ", "½"), base.replace(" ", "Ⅷ"), base.replace(" ", "\u203f"),
        "a:b@github.comc:d@github.com:e@github.com -:x@github.com",
        "xs3.amazonaws.com//s3.amazonaws.com/b a.s3.amazonaws.comb.s3.amazonaws.com.s3.amazonaws.com/c s3-x s3://y.s3.amazonaws.com as3-z s3.console.aws.amazon.com/s3/buckets/q",
    ]
    same_as_library(spark, texts)


def test_documents_agree_with_the_standard_library(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    same_as_library(spark, [r.text for r in rows.unionByName(pages).collect()])


def test_seeded_documents_match_the_test_text(spark):
    row = seeded_documents(spark.createDataFrame([(7, "x")], "doc_id long, text string")).first()
    assert row.text == "x" + seeded_text(7)


def test_empty_text_and_null(spark):
    rows = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert detect.findings(rows).count() == 0
    assert [r.n_types for r in detect.finding_types(rows).collect()] == [0, 0]


def test_long_texts(spark):
    """Repeated groups and long runs neither overflow the stack nor lose the tail."""
    text = "C:" + r"\\dir" * 50_000 + " a@b.example.com " + "-" * 20_000 + " 1.2.3.4"
    got = found(spark, [text])[0]
    assert got["email"] == ["a@b.example.com"] and got["ipv4"] == ["1.2.3.4"] and len(got["windows_path"]) == 1


def test_whole_match_mode(spark):
    got = found(spark, ["aa:bb:cc:dd:ee:ff 10.0.0.1"], mode="match")[0]
    assert got["mac"] == ["aa:bb:cc:dd:ee:ff"] and got["private_ip"] == ["10.0.0.1"]


def test_custom_rules_skip_bad_ones(spark):
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        rules = detect.custom_rules({"bad": "(", "named": "(?P<x>b)", "it's": r"(it's)|x(\d+)"})
    assert [r.key for r in rules] == ["named", "it's"]
    assert sum("left out" in str(w.message) for w in caught) == 1
    assert found(spark, ["it's x12 b"], rules=rules) == {0: {"named": ["b"], "it's": ["(\"it's\", '')", "('', '12')"]}}


def test_custom_rules_keep_every_row(spark):
    table = spark.createDataFrame([(2, "t", "b+"), (1, "t", "a+")], "ord int, type string, pattern string")
    assert [(r.label, r.pattern) for r in detect.custom_rules(table)] == [("t", "a+"), ("t", "b+")]


def test_custom_rules_read_as_written(spark):
    """Brackets and ampersands in classes, the end of text, plain boundaries."""
    patterns = [r"[[&&a]+", r"[^]x]+", r"[]x]+", r"b\Z", r"\bé?x\b", r"[\w&]+\s?", r"\\w", r"a|\Bx", r"\S+", r"[\Wx]+", r"[^\S]", r"\D\W"]
    texts = ["[&&a]x]b", "é éx x &é² \\w\n", "xab\n", "ax]b"]
    got = found(spark, texts, rules=detect.custom_rules({p: p for p in patterns}))
    for number, text in enumerate(texts):
        want = {p: sorted(set(re.findall(p, text))) for p in patterns}
        assert got.get(number, {}) == {p: s for p, s in want.items() if s}, text


def test_rule_table(spark):
    table = spark.createDataFrame([("digits", r"\d+")], "type string, pattern string")
    assert found(spark, ["a1b22"], rules=detect.custom_rules(table)) == {0: {"digits": ["1", "22"]}}
    assert found(spark, ["a1b22"], rules=[]) == {}


def test_flat_and_summary(spark):
    rows = detect.with_findings(spark.createDataFrame([("1.2.3.4 5.6.7.8 a@b.com",), ("none",)], "text string"))
    types, counts, details = detect.flat(F.col("sensitive_raw"))
    got = rows.select(types, counts, details, detect.summary(F.col("sensitive_raw"))).collect()
    assert tuple(got[0]) == ("IP地址|邮箱", "2|1", "IP地址:1.2.3.4; 5.6.7.8|邮箱:a@b.com", "IP地址X2，邮箱X1")
    assert tuple(got[1]) == ("", "", "", "")
    empty = F.expr("array(named_struct('ord', 1, 'rule', 'r', 'type', 't', 'count', 0, 'samples', cast(array() as array<string>), 'total', 0))")
    assert spark.range(1).select(detect.flat(empty)[2]).first()[0] == "t:无样本"


def test_detection_runs_once(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = detect.findings(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LTAI[a-zA-Z0-9]{12,20}") == 1 and "Exchange" not in plan


# Beginnings of matches, over and over: every start would read on to the end.
HOSTILE = {
    "email": lambda n: "@ " + "a." * n, "email_at": lambda n: "a." * n + "@x", "email_dots": lambda n: "@" + "." * n + "a@b.com" + "." * n,
    "email_many": lambda n: "a@b.c.de." * n + "@", "email_plus": lambda n: "é" + "+a" * n + "@b.co ",
    "db_url": lambda n: "mysql://a:" * n, "db_url_at": lambda n: "redis://a:" * n + "@h:1/ @h:12/d", "jdbc": lambda n: "jdbc:" * n,
    "jdbc_end": lambda n: "jdbc:" * n + "://h/x", "jwt": lambda n: "ey-" * n, "jwt_dot": lambda n: "ey-" * n + "a.b-c.d",
    "aws_s3_url": lambda n: "s3." * n, "aws_s3_url_end": lambda n: "s3." * n + "s3.amazonaws.com s3-" + "s3-" * n,
    "private_block": lambda n: "-" * n + "BEGIN A PRIVATE KEY-----" + " " * n + "-" * n + "x-BEGIN B PRIVATE KEY--" + "z" * n + "--END C PRIVATE KEY--",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_texts_give_the_same_findings(spark, name):
    same_as_library(spark, [HOSTILE[name](n) for n in (1, 2, 40)] + [f"x {HOSTILE[name](7)} é{HOSTILE[name](3)}\n{HOSTILE[name](5)}"])


def test_random_texts_give_the_same_findings(spark):
    """Texts of pieces of matches, joined at random."""
    pick = random.Random(6)
    pieces = [
        "a", "b1", ".", "-", "_", "+", "%", "@", ":", "/", "//", "=", " ", "\n", "é", "com", "js", "ey", "eyJ", "jdbc:", "mysql://", "redis://u:", "s3.", "s3-", "s3://",
        ".s3.amazonaws.com", "s3.amazonaws.com/", "host:3306/db", "--", "-----BEGIN ", "RSA", " PRIVATE KEY-----", "-----END ", "x" * 5,
    ]
    same_as_library(spark, ["".join(pick.choices(pieces, k=pick.randint(1, 25))) for _ in range(1500)])


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_texts_take_linear_time(spark, name):
    def seconds(n):
        rows = spark.createDataFrame([(HOSTILE[name](n),)], "text string")
        start = time.perf_counter()
        detect.with_findings(rows).collect()
        return time.perf_counter() - start

    seconds(10)
    small = min(seconds(20_000) for _ in range(2))
    assert min(seconds(80_000) for _ in range(2)) < 4 * 1.6 * small + 1


def test_needed_literals():
    needed = detect.needed_literals
    assert needed(r"\bSecret_(?:Key|Name)\d+") == ["secret_"]
    assert needed(r"(?:alpha|betas)x") == ["alpha", "betas"]
    assert needed(r"(?:alpha|\d+)x") == [] and needed(r"a?b*c") == [] and needed("abc") == []
    assert needed(r"x{2}(longest text)+y?") == ["longest text"]
    assert needed(r"(?=ahead)body(?!later)") == ["body"] and needed("größe") == []


def test_many_rules_equal_the_library(spark):
    """A table of rules, with and without literals, groups and flags, next to default rules."""
    pick = random.Random(9)
    names = [f"{pick.choice('abcxyz')}{i:03d}key" for i in range(700)]
    rules = {name: pick.choice([rf"{name}\s*=\s*(\w+)", rf"(?i){name}-(\d)(x?)", rf"\b{name[1:]}\b", rf"(?:{name}|none{name[:4]})\d"]) for name in names}
    rules |= {"digits": r"\d{6}", "two": r"(\w)=(\W)", "İ": r"(?i)istanbul"}
    words = [*names, "=", " ", "-1x", "-2", "1", "İSTANBUL", "é", "123456", "a=!", "noneb001", "x" * 3, "\n"]
    texts = ["".join(pick.choices(words, k=pick.randint(0, 30))) for _ in range(300)]
    want = [{k: expected_samples(detect.Rule(k, k, p), t) for k, p in rules.items()} for t in texts]
    got = found(spark, texts, rules=detect.custom_rules(rules))
    for number, samples in enumerate(want):
        assert got.get(number, {}) == {k: v for k, v in samples.items() if v}
    mixed = found(spark, texts[:50], rules=[*detect.custom_rules(rules), *detect.default_rules()])
    for number, text in enumerate(texts[:50]):
        both = {k: v for k, v in want[number].items() if v} | {r.key: e for r in detect.default_rules() if (e := expected_samples(r, text))}
        assert mixed.get(number, {}) == both


def test_time_is_nearly_flat_in_the_number_of_rules(spark):
    pick = random.Random(1)
    texts = spark.createDataFrame([(" ".join(f"{pick.choice('abcdef')}{pick.randrange(10**6)}" for _ in range(2000)),) for _ in range(200)], "text string").coalesce(1)

    def seconds(count):
        rules = detect.custom_rules({f"r{i}": rf"secret{i:05d}\s*=\s*(\w+)" for i in range(count)})
        frame = detect.with_findings(texts, rules=rules).select(F.sum(F.size("sensitive_raw")))
        frame.collect()
        start = time.perf_counter()
        frame.collect()
        return time.perf_counter() - start

    assert seconds(5000) < 3 * seconds(56) + 2


def test_a_bad_rule_among_many_is_left_out(spark):
    rules = {f"r{i}": f"word{i}" for i in range(300)} | {"bad": "(", "worse": "a**"}
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert len(detect.custom_rules(rules)) == 300
    assert len([w for w in caught if "left out" in str(w.message)]) == 2


@pytest.mark.parametrize("least", [1, 40, 200])
def test_cut_texts_give_the_same_findings(spark, monkeypatch, least):
    """Matches at the edges of pieces, of any length, with spaces, line feeds and other white space between them."""
    monkeypatch.setattr(detect, "PIECE", least)
    pick = random.Random(least)
    words = [w for n in range(3) for w in re.split(r"[ \n]", seeded_text(n)) if w] + ["word", "é", "中文", "'", '"', ":", "=", "@", "-", "key", "basic", "twitter", "fb"]
    texts = ["".join(pick.choice(words) + pick.choice([" ", " ", "\n", "", "\t", " ", "  \n "]) for _ in range(pick.randint(1, 60))) for _ in range(400)]
    same_as_library(spark, texts + [seeded_text(n).replace("\n", mark) for n in range(3) for mark in "\n \t"])


def test_secrets_in_a_long_text_cost_little_more_than_none(spark):
    """Where all rules have something to find, they do not read the whole text."""
    prose = "Nothing to be seen in these words, one after the other.\n" * 700

    def seconds(*ends):
        rows = spark.createDataFrame([(prose + end,) for end in ends], "text string").coalesce(1)
        start = time.perf_counter()
        detect.with_findings(rows).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    ends = [seeded_text(n) for n in range(50)]
    seconds(*ends)
    none = min(seconds(*[""] * 50) for _ in range(2))
    assert min(seconds(*ends) for _ in range(2)) < 3.5 * none


def test_reach_of_rules_is_wide_enough():
    from re import _parser as parser

    for rule in RULES.values():
        if rule.reach == detect._SHORT:
            assert parser.parse(plain(rule)).getwidth()[1] < detect.LONGEST, rule.key
        assert not (rule.reach and rule.cut)


@pytest.mark.parametrize("least", [1, 30, 200])
def test_matches_over_many_pieces_are_found(spark, monkeypatch, least):
    """Beginnings, ends and fillings of matches that hold spaces and line feeds, in any order, in both modes."""
    monkeypatch.setattr(detect, "PIECE", least)
    pick = random.Random(least)
    parts = [
        "basic", "bearer ", "Basic abcdef", "abc12/x", "mysql://u:", "redis://a:p@h.example:1/d", "@h:33/db", "@", "-----BEGIN A PRIVATE KEY-----", "-----END A PRIVATE KEY---",
        "-", "password", "passwd =", "key:", "secret = '", "token=\"abcdefg\"", "access_key", ":", "=", "'", '"', "abcdefg hij", "0123456789abcdef" * 2, "1" * 15,
        "facebook", "FB", "twitter", "tw|tter", "linkedIn", "github", "ſecret", "é", "x" * 40, "'" + "a" * 38 + "'", "'" + "b1" * 8 + "'", "word", "and",
    ]
    gaps = ["", "", " ", " ", "\n", "\t", "  \n  ", " " * 130, "\n" * 50]
    texts = ["".join(pick.choice(parts) + pick.choice(gaps) for _ in range(pick.randint(1, 50))) for _ in range(600)]
    same_as_library(spark, texts)
    got = found(spark, texts, mode="match")
    for number, text in enumerate(texts):
        want = {key: sorted({m[0] for m in re.finditer(plain(rule), text)}) for key, rule in RULES.items()}
        assert got.get(number, {}) == {key: samples for key, samples in want.items() if samples}, text


def test_long_texts_have_few_pieces(spark):
    rows = spark.createDataFrame([("\U0001f600a " * 300_000,), ("a b " * 20,), ("",), (None,)], "text string")
    pieces = rows.select(F.expr(detect.pieces_sql("text", " \n")).alias("p"))
    assert [r.n for r in pieces.select(F.size("p").alias("n")).collect()][:3] == [256, 1, 0]
    assert pieces.select(F.array_join("p", "").alias("t")).collect() == rows.collect()
