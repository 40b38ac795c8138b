"""Conversation repair, clustering and harmonic packing against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from llm import bisector, dialogue, harmonic
from llm.queries import byte_tokenizer, op11_conversation_repair, op12_clusters, op13_harmonic_packing

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, signature string, part int, n string"
VECTORS = "vec_id bigint, embedding array<float>, cluster string, distance string, place int"


def talks():
    pick = random.Random(5)
    rows = []
    for conv in range(60):
        roles = ["system"] * pick.randint(0, 1) + ["user", "assistant"] * pick.randint(0, 4)
        for turn, role in enumerate(roles):
            text = pick.choice(["Yes.", "No!", "Why?", "and so on", "Tell me more. ", f"Number {pick.random()}.", "1 2 3", " \t ", ""])
            rows.append((conv, turn, pick.choice([role] * 6 + ["user", "tool", "", None]), pick.choice([text] * 9 + [None])))
    rows += [(70, 5, "user", "Same."), (70, 5, "user", "Same."), (70, None, "user", "Null turn."), (70, None, "assistant", "Null turn.")]
    rows += [(None, 0, "user", "No id."), (None, 3, "assistant", "No id."), (71, -3, "s", "x" * 50000), (72, 9, "user", "é 日 x")]
    rows += [(73, i, ("user", "assistant")[i % 2], f"Turn {i}{'.' if i % 3 else ''}") for i in range(500)]
    return rows


def repaired_plainly(rows):
    """What the contract says of one conversation's damaged (turn, role, text), by exhaustive recursion over strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))

    @cache
    def best(i, done):
        """Cheapest (cost, audit, lines) for the rows from i on, if the last initial so far is ``done``."""
        return min(inserted(i, done, 2))

    def legal(done, initial):
        return initial == "u" if done in ("", "s") or done[-1] == "a" else initial == "a" if done[-1] == "u" else False

    @cache
    def inserted(i, done, left):
        ways = list(taken(i, done))
        if i == len(rows) and (done == "" or done.endswith("a")):
            ways.append((0, "", ()))
        if left:
            for role in ("user", "assistant"):
                if legal(done, role[0]):
                    ways += [(5 + c, "I" + a, (f"{role}:", *ls)) for c, a, ls in inserted(i, role[0], left - 1)]
        return [min(ways)] if ways else []

    @cache
    def taken(i, done):
        if i == len(rows):
            return []
        _, role, text = rows[i]
        ways = [(2 + c, "D" + a, ls) for c, a, ls in [best(i + 1, done)]]
        if faults[i] not in ("blank", "duplicate"):
            extra = 5 * (faults[i] == "truncated")
            if legal(done, role[:1]) or done == "" and role[:1] == "s":
                ways += [(extra + c, "K" + a, (f"{role}:{text}", *ls)) for c, a, ls in [best(i + 1, role[:1])]]
            for new in ("user", "assistant"):
                if legal(done, new[0]):
                    ways += [(1 + extra + c, "R" + a, (f"{new}:{text}", *ls)) for c, a, ls in [best(i + 1, new[0])]]
        return ways

    for i in range(len(rows), -1, -1):  # from the end, to keep the recursion shallow
        for done in ("", "s", "u", "a"):
            best(i, done)
    cost, audit, lines = best(0, "")
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    counts = Counter(faults)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged_plainly(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


@pytest.mark.parametrize("damage", [False, True])
def test_repair(spark, tmp_path, damage):
    rows = talks()
    table = spark.createDataFrame([(*r, "s", 1, "n") for r in rows], CONVERSATIONS).repartition(5)
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    broken = list(damaged_plainly(rows)) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    by = defaultdict(list)
    for conv, *row in broken:
        by[conv].append(tuple(row))
    want = {conv: repaired_plainly(own) for conv, own in by.items()}
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    if damage:
        nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        want = {conv: want.get(conv, nothing) for conv in {r[0] for r in rows}}
        got = op11_conversation_repair(spark, str(tmp_path)).select(*columns).collect()
    else:
        repair = dialogue.Repair(table)
        digests = {r.conv_id: r.repaired_sha256 for r in repair.digests().collect()}
        got = [(*r, digests.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in repair.summary().select(*columns[:-1]).collect()]
    got = {r[0]: tuple(r[1:]) for r in got}
    assert got == want


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "Q?"), (1, 2, "user", "Q?"), (1, 3, "tool", "B."), (1, 4, "user", "cut")]
    turns = dialogue.Repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).turns().orderBy("place").collect()
    assert [(t.role, t.text) for t in turns] == [("user", "Q?"), ("assistant", "B.")]


def test_suffixes_are_shared(monkeypatch):
    """Each distinct suffix of sorted signatures is worked out once."""
    import pyarrow as pa

    made = []
    real = dialogue.before
    monkeypatch.setattr(dialogue, "before", lambda sign, after: made.append(sign) or real(sign, after))
    signatures = ["sua", "ua", "xua", "suaua", "uaua", "oa"]
    backward = sorted(s[::-1] for s in signatures)
    batches = [pa.record_batch({"signature": [b[::-1] for b in part], "backward": part}) for part in (backward[:2], backward[2:])]
    list(dialogue._solved(iter(batches)))
    assert len(made) == len({s[i:] for s in signatures for i in range(len(s))})


def test_repair_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], CONVERSATIONS)
    repair = dialogue.Repair(empty)
    assert repair.summary().count() == 0 == repair.turns().count() == repair.digests().count()


def clustered_plainly(rows, count=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: ((0, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()) if r[0] is not None else (1, ""), r[1]))
    centres = [v for _, v in order[:count]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centres = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if groups[k] else c for k, c in enumerate(centres)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, k, d in found:
        inertia[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for i, k, d in found)


@pytest.mark.parametrize("size", [300, 9, 0])
def test_clusters(spark, tmp_path, size):
    random_ = np.random.default_rng(size)
    # Few distinct values, so that many distances tie.
    rows = [(i, (random_.integers(-2, 3, 64) / 64 * random_.choice([1, 1, 20])).astype(np.float32).tolist()) for i in range(size)]
    if size == 300:
        rows += [rows[0]] * 40 + [(3, rows[4][1]), (None, rows[5][1]), (400, None), (401, [1.0]), (402, [None] + [0.0] * 63), (403, [float("nan")] + [0.0] * 63),
                 (404, [float("inf")] + [0.0] * 63), (405, []), (406, [0.0] * 65), (407, [-0.001] * 64), (408, [1000.5] * 64)]
    table = spark.createDataFrame([(i, v, "c", "d", 7) for i, v in rows], VECTORS).repartition(4)
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op12_clusters(spark, str(tmp_path)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert Counter(map(tuple, got)) == clustered_plainly(rows)


def test_far_components_are_bounded(spark):
    rows = [(1, [1e300] + [0.0] * 63), (2, [-1e300] + [0.0] * 63)]
    got = bisector.cluster(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), count=1, rounds=1).collect()
    assert [r.distance for r in got] == [bisector.FAR**2] * 2


def test_tournament_prefers_smaller_numbers():
    centres = np.array([[0, 4], [4, 0], [0, 4], [9, 9]])
    assert bisector.Tournament(centres).winners(np.array([[0, 4], [2, 2], [4, 0], [9, 8]])).tolist() == [0, 0, 1, 3]


def test_byte_codec():
    codec, library, pick = harmonic.ByteCodec(byte_tokenizer()), Tokenizer.from_file(byte_tokenizer()), random.Random(2)
    signs = list("  \n\t\r'sStrelvmd01²½.,-_ªµßéſ×÷¿\x0b\x1c\x85\xa0") + ["ing", "the", " a", "日", "<|endoftext|>", "ı", "ʼn"]
    texts = ["".join(pick.choices(signs, k=pick.randint(0, 40))) for _ in range(3000)] + ["", "x" * 30000, " " * 30000 + "a", "a. " * 9000]
    for text in texts:
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_harmonic_packing(spark, tmp_path):
    pick = random.Random(4)
    texts = [None, "", " ", "one", "é 日本 <|endoftext|>", "word " * 30000, "x" * 20000] + [" ".join(f"w{pick.randint(0, 99)}" for _ in range(pick.randint(0, 900))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(7, texts[7])] * 3
    table = spark.createDataFrame([(i, t, "l", "s", 1) for i, t in [*rows, (None, "no id")]], "doc_id bigint, text string, length string, start string, offset int")
    table.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = op13_harmonic_packing(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(byte_tokenizer())
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    covered = Counter()
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id]) and 0 < p.length <= 1024
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length])
        covered[p.doc_id, p.start, p.length] += 1
    copies = Counter(i for i, _ in rows)
    for i, own in ids.items():
        mine = sorted((start, length) for (doc, start, length), n in covered.items() if doc == i)
        assert all(covered[i, *m] == copies[i] for m in mine)
        at = 0
        for start, length in mine:
            assert start == at
            at += length
        assert at == len(own)
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    short = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # nothing is padded
        short += at < 1024
    assert short <= 10 * 4


def test_harmonic_classes_hold_fixed_counts():
    assert harmonic.parts(2 * 1024 + 7) == [1024, 1024, 4, 2, 1] and harmonic.parts(0) == []
    with pytest.raises(ValueError):
        harmonic.Classes(1000, 0)
    classes = harmonic.Classes(8, 0)
    out = classes.add(np.array([(i, 0, 2, 0, 2) for i in range(9)]))
    assert out[:, 5].tolist() == [0, 0, 0, 0, 1, 1, 1, 1] and out[:, 6].tolist() == [0, 2, 4, 6] * 2
    assert classes.close()[:, 5:].tolist() == [[2, 0]]


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert harmonic.pack(empty, byte_tokenizer()).count() == 0
