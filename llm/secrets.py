"""Secret scans: three fixed kinds, and a battery of randomness tests for the rest.

Fixed kinds, leftmost and non-overlapping per kind: ``assign`` (a credential
name, then ``:`` or ``=`` and a value of 12 characters or more), ``access`` (a key id of
18 or more) and ``hex`` (16 or more).

``random`` spans come from the tests.  A candidate is a whole run of 20 or more of
``[A-Za-z0-9+/_-]``.  Its characters tell the encoding (base 16, 32 or 64, each of which must
mix letters and digits; base 64 also both cases); a run that fits none is no candidate.
Over the encoding's alphabet three tests ask if the characters look drawn at
random: chi-squared uniformity over eight equal parts of the alphabet, the
runs of the upper and lower half, and serial correlation at lag one.
Fisher's method makes one p-value of the three; a small one says "not random".
Which candidates are discovered to be no secrets is controlled by
Benjamini-Hochberg at rate `RATE`, separately in each class of lengths, as short runs have less power.
Candidates that are not rejected and touch no fixed span are ``random`` spans.
The p-values are counted in 1,000 bins for each of five classes, so the cut-offs are five numbers.

Everything is DataFrame functions.  The text is scanned in place and never
shuffled; only matches are, and positions are running sums over a document's matches.

Null texts are empty.  Rows without an id are left out of `scan`; rows that repeat an id count
as one document with the matches of all of them, repeated texts once.  `redact` keeps every row and column.
Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.tables import texts
from pagescan.storage import Workspace

# Fixed values.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": CANDIDATE}
VALUE_LENGTH = 12

RATE = 0.05
CLASSES = [24, 32, 48, 96]  # a class ends before each of these lengths
BINS = 1000
_ALPHABETS = {
    16: "0123456789abcdef",
    32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _base(token: Column) -> Column:
    """The alphabet's size, null if the characters fit no encoding."""
    letter_and_digit = token.rlike("[A-Za-z]") & token.rlike("[0-9]")
    return (
        F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & letter_and_digit, 16)
        .when(token.rlike("^[A-Z2-7]+$") & letter_and_digit, 32)
        .when(token.rlike("[A-Z]") & token.rlike("[a-z]") & token.rlike("[0-9]"), 64)
    )


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic approximation, within 0.0002)."""
    z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def p_value(token: Column) -> Column:
    """Fisher's combination of the three tests; null if there is no encoding."""
    return F.element_at(F.transform(F.array(F.struct(token.alias("token"), _base(token).alias("base"))), _battery), 1)


def _battery(item: Column) -> Column:
    token, base = item["token"], item["base"]
    alphabet = F.when(base == 16, _ALPHABETS[16]).when(base == 32, _ALPHABETS[32]).otherwise(_ALPHABETS[64])
    plain = F.translate(F.when(base == 16, F.lower(token)).otherwise(token), "-_", "+/")
    codes = F.transform(F.split(plain, ""), lambda c: F.instr(alphabet, c) - 1)
    # The inner values are bound once, by mapping over an array of one.
    bound = F.array(F.struct(F.filter(codes, lambda c: c >= 0).alias("codes"), base.alias("base")))
    return F.when(base.isNotNull(), F.element_at(F.transform(bound, _tests), 1))


def _tests(item: Column) -> Column:
    codes, base = item["codes"], item["base"]
    n = F.size(codes).cast("double")
    part = (base / 8).cast("int")
    counts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.size(F.filter(codes, lambda c: F.floor(c / part) == b)))
    chi = F.aggregate(counts, F.lit(0.0), lambda s, o: s + (o - n / 8) * (o - n / 8) / (n / 8))
    spread = 2.0 / (9 * 7)
    uniform = _tail((F.pow(chi / 7, F.lit(1 / 3)) - (1 - spread)) / spread**0.5)

    high = F.aggregate(codes, F.lit(0.0), lambda s, c: s + F.when(c * 2 >= base, 1.0).otherwise(0.0))
    low = n - high
    changes = F.aggregate(
        codes,
        F.struct(F.lit(0.0).alias("runs"), F.lit(-1).alias("side")),
        lambda s, c: F.struct(
            (s["runs"] + F.when(F.when(c * 2 >= base, 1).otherwise(0) != s["side"], 1.0).otherwise(0.0)).alias("runs"),
            F.when(c * 2 >= base, 1).otherwise(0).alias("side"),
        ),
        lambda s: s["runs"],
    )
    expected = 2 * high * low / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    runs = F.when(variance > 0, 2 * _tail(F.abs(changes - expected) / F.sqrt(variance))).otherwise(1e-9)

    mean = F.aggregate(codes, F.lit(0.0), lambda s, c: s + c) / n
    products = F.aggregate(
        codes,
        F.struct(F.lit(0.0).alias("lag"), F.lit(0.0).alias("square"), F.lit(None).cast("double").alias("last")),
        lambda s, c: F.struct(
            (s["lag"] + F.coalesce(s["last"], F.lit(0.0)) * (c - mean)).alias("lag"),
            (s["square"] + (c - mean) * (c - mean)).alias("square"),
            (c - mean).cast("double").alias("last"),
        ),
        lambda s: F.when(s["square"] > 0, s["lag"] / s["square"]).otherwise(1.0),
    )
    serial = 2 * _tail(F.abs(products + 1 / n) * F.sqrt(n))

    half = -(F.ln(uniform) + F.ln(runs) + F.ln(serial))  # half of Fisher's statistic, six degrees of freedom
    return F.least(F.lit(1.0), F.exp(-half) * (1 + half + half * half / 2))


def _class(length: Column) -> Column:
    out = F.lit(len(CLASSES))
    for i in reversed(range(len(CLASSES))):
        out = F.when(length < CLASSES[i], i).otherwise(out)
    return out


def _matches(docs: DataFrame) -> DataFrame:
    """doc_id, copy (hash of the text), kind, found, p, start, end of every match (failing ones too)."""

    def part(kind: str) -> Column:
        gaps = F.transform(F.split("text", PATTERNS[kind], -1), lambda g: F.length(g))
        found = F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        return F.transform(
            F.arrays_zip(gaps.alias("gap"), found.alias("found")),
            lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), m["gap"].alias("gap"), m["found"].alias("found")),
        )

    every = F.concat(*map(part, KINDS))
    each = docs.select("doc_id", F.xxhash64("text").alias("copy"), F.explode_outer(every).alias("m")).where(
        F.col("m.found").isNotNull()
    )
    p = F.when(F.col("kind") == "random", p_value(F.col("found")))
    each = each.select("doc_id", "copy", "m.*").withColumn("p", p).distinct()  # a repeated row once
    before = Window.partitionBy("doc_id", "copy", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("found")).over(before)
    return each.select("doc_id", "copy", "kind", "found", "p", end.cast("bigint").alias("end")).select(
        "doc_id", "copy", "kind", "found", "p", (F.col("end") - F.length("found")).alias("start"), "end"
    )


def _kept(kind: Column, found: Column) -> Column:
    """False for an assignment whose value is short."""
    return (kind != "assign") | (F.length(F.regexp_extract(found, ASSIGN, 2)) >= VALUE_LENGTH)


def cut_offs(tokens: DataFrame) -> list[float]:
    """Per class of lengths the p-value at or below which a candidate is found not random; ``tokens``: p, length."""
    counted = tokens.where("p is not null").groupBy(
        _class(F.col("length")).alias("class"), F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).alias("bin")
    ).agg(F.count("*").alias("n"))
    # At most len(CLASSES) + 1 times BINS rows from here on.
    up_to = Window.partitionBy("class").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    edge = (F.col("bin") + 1) / BINS
    test = counted.select(
        "class", edge.alias("edge"), F.sum("n").over(up_to).alias("below"), F.sum("n").over(Window.partitionBy("class")).alias("all")
    )
    best = test.where(F.col("edge") <= RATE * F.col("below") / F.col("all")).groupBy("class").agg(F.max("edge").alias("edge"))
    found = {row["class"]: row["edge"] for row in best.collect()}
    return [found.get(i, 0.0) for i in range(len(CLASSES) + 1)]


def _random(p: Column, length: Column, cuts: list[float]) -> Column:
    cut = F.element_at(F.array(*[F.lit(c) for c in cuts]), _class(length) + 1)
    return F.coalesce(p > cut, F.lit(False))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans (arrays of start, kind, end) of each document."""
    work = Workspace(docs.sparkSession, "secrets")
    rows = texts(docs, id_column, text_column)
    matches = _matches(rows).where(_kept(F.col("kind"), F.col("found")))
    matches = work.write(matches.where("kind != 'random' or p is not null"), "matches")
    candidates = matches.where("kind = 'random'").select("p", F.length("found").alias("length"))
    cuts = cut_offs(candidates)
    # Fixed spans that overlap a candidate: by the latest end before and the first start behind it.
    place = Window.partitionBy("doc_id", "copy").orderBy("start", F.col("kind") == "random")
    fixed = F.col("kind") != "random"
    behind = F.max(F.when(fixed, F.col("end"))).over(place.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(fixed, F.col("start"))).over(place.rowsBetween(0, Window.unboundedFollowing))
    free = (F.coalesce(behind, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))
    spans = matches.withColumn("free", free).where(
        fixed | (F.col("free") & _random(F.col("p"), F.length("found"), cuts))
    )
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    listed = (
        spans.select("doc_id", F.struct("start", order.alias("order"), "kind", "end").alias("s"))
        .groupBy("doc_id").agg(F.sort_array(F.collect_set("s")).alias("spans"))
    )
    ids = rows.select("doc_id").distinct()
    out = ids.join(listed, "doc_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast(listed.schema["spans"].dataType)))
    return out.select(
        "doc_id",
        *[_count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.filter("spans", lambda s: s["kind"] != "random").alias("base_spans"),
        "spans",
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def listing(spans: Column) -> Column:
    """The spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents with every secret in the text replaced by ``mark``; other texts stay as they are.

    Two passes: the first only fixes the cut-offs, the second replaces in place, without a shuffle.
    """
    found = F.regexp_extract_all(F.coalesce(F.col(text_column), F.lit("")), F.lit(CANDIDATE), F.lit(0))
    tokens = docs.select(F.explode_outer(found).alias("found")).where("found is not null")
    cuts = cut_offs(tokens.select(p_value(F.col("found")).alias("p"), F.length("found").alias("length")))
    text = F.col(text_column)

    def secret(kind: str, found: Column) -> Column:
        return _random(p_value(found), F.length(found), cuts) if kind == "random" else _kept(F.lit(kind), found)

    def replaced(kind: str) -> Column:
        gaps = F.split(text, PATTERNS[kind], -1)
        matches = F.transform(
            F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda found: F.when(secret(kind, found), mark).otherwise(found)
        )
        pieces = F.zip_with(gaps, matches, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
        return F.when(text.rlike(PATTERNS[kind]), F.array_join(pieces, "")).otherwise(text)

    for kind in KINDS:
        docs = docs.withColumn(text_column, replaced(kind))
    return docs
