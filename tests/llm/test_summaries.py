"""Token counts, conversation repair and quantile summaries against plain versions."""

import bisect
import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vanika.llm import quantiles, repair, tokencounts
from vanika.llm.queries import queries, tokenizer_path

DATA = "/root/testdata/sf0.001"
PARTS = ["a", "b1", "1a", " ", "  ", "\n", "\n\n", " \t", "'s", "'", "don't", ".", "é", "世界", "。", "<|endoftext|>", " ", "　", "​", "\x1c", "ß", "İ", "\U0001f600", "x" * 5, "Σ", " <|endoftext|> "]
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]


def library_counts(name, texts):
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        return [len(x) for x in SentencePieceProcessor(model_file=tokenizer_path(name)).encode(texts)]
    from tokenizers import Tokenizer

    return [len(x.ids) for x in Tokenizer.from_file(tokenizer_path(name)).encode_batch(texts, add_special_tokens=False)]


# --- 11 token counts


@pytest.mark.parametrize("name", FILES)
def test_counts_are_the_librarys(monkeypatch, name):
    own = random.Random(5)
    texts = ["".join(own.choices(PARTS, k=own.randrange(300))) for _ in range(600)] + ["", " ", "<|endoftext|>", "a" * 40000, "ab1" * 9000, "世界。" * 9000, "x y " * 9000, " a", "a "]
    want = library_counts(name, texts)
    for piece in (1, 50, tokencounts.PIECE):
        monkeypatch.setattr(tokencounts, "PIECE", piece)
        lib = tokencounts.Lengths(tokenizer_path(name))
        assert lib.safe is not None and lib.of(texts).tolist() == want
    column = [lib.column(pa.array(texts[k : k + 50])) for k in range(0, len(texts), 50)]
    assert np.concatenate(column).tolist() == want
    monkeypatch.setattr(lib, "KEEP", 10)
    assert lib.column(pa.array(texts)).tolist() == want


def test_unknown_first_steps_are_not_cut():
    assert tokencounts._safe({"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Metaspace"}}) is None
    assert tokencounts._safe({"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}) is None


def test_token_count_rows(spark):
    path = tokenizer_path(FILES[0])
    rows = [(1, "one two", 5), (1, "one two", 5), (None, "no id", 6), (2, None, 7), (3, "", 8), (4, "é <|endoftext|> x", 9), (5, "word " * 1024, 1), (6, "word" * 1 + " word" * 1023, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((tuple(x) for x in tokencounts.count_tokens(docs, path).collect()), key=repr)
    counts = library_counts(FILES[0], [t or "" for _, t, _ in rows])
    assert got == sorted(((d, len((t or "").encode()), n, n > 1024) for (d, t, _), n in zip(rows, counts, strict=True)), key=repr)
    assert tokencounts.count_tokens(docs.filter("doc_id > 99"), path).collect() == []
    got = {x["doc_id"]: x["n_tokens"] for x in queries()["op11_token_counts"](spark, DATA).collect()}
    texts = {x["doc_id"]: x["text"] or "" for x in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert got == dict(zip(texts, library_counts(FILES[0], list(texts.values())), strict=True))


# --- 12 conversation repair

FOLLOWS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def plain_cheapest(turns):
    """Of all edits, by cost and then by their initials: a queue of partial repairs."""
    queue, done = [(0, "", 0, 0)], set()
    while queue:
        cost, edits, i, q = heapq.heappop(queue)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(turns) and q in (0, 3):
            return cost, edits
        for x in "ua":
            if q in FOLLOWS[x]:
                heapq.heappush(queue, (cost + 2, edits + "I", i, FOLLOWS[x][q]))
        if i < len(turns):
            initial, fault = turns[i]
            heapq.heappush(queue, (cost + 3, edits + "D", i + 1, q))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                if q in FOLLOWS.get(initial, {}):
                    heapq.heappush(queue, (cost + late, edits + "K", i + 1, FOLLOWS[initial][q]))
                for x in "ua":
                    if q in FOLLOWS[x]:
                        heapq.heappush(queue, (cost + 2 + late, edits + "R", i + 1, FOLLOWS[x][q]))
    raise AssertionError


def test_edits_are_the_least_of_all():
    kinds = list(itertools.product(["s", "u", "a", ""], ["", "blank", "truncated"]))
    own = random.Random(3)
    cases = [list(t) for n in range(3) for t in itertools.product(kinds, repeat=n)]
    cases += [[(own.choice(["s", "u", "a", "u", "a", ""]), own.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(own.randrange(14))] for _ in range(1500)]
    for t in cases:
        assert repair.cheapest(t) == plain_cheapest(t), t


def plain_repair(rows):
    """conv_id -> the report's values, from rows (conv_id, turn, role, text)."""
    said = lambda x: " " if x is None else str(x)
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = said(role), said(text)
        k = zlib.crc32(f"{said(c)}:{said(turn)}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        convs[c] += [] if k == 0 else [(turn is not None, turn or 0, "user" if k == 4 else role, text)] * (1 + (k == 3))
    out = {}
    for c, own in convs.items():
        own.sort(key=lambda x: x[:2])
        numbers = {t for known, t, _, _ in own if known}
        seen, turns = set(), []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\v\f\r")
            turns.append((role[:1], "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        cost, audit = plain_cheapest(turns)
        lines, at, q = [], 0, 0
        for e in audit:
            role, text = ("user" if q != 2 else "assistant"), ""
            if e != "I":
                kept, text = own[at][2:]
                role, at = kept if e == "K" else role, at + 1
            if e != "D":
                lines.append(f"{role}:{text}")
                q = FOLLOWS[role[:1]][q]
        faults = [f for _, f in turns]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        out[c] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_of_the_table(spark):
    table = spark.read.parquet(f"{DATA}/conversations.parquet")
    got = {x["conv_id"]: tuple(x[n] for n in NAMES) for x in queries()["op12_conversation_repair"](spark, DATA).collect()}
    assert got == plain_repair([(x["conv_id"], x["turn"], x["role"], x["text"]) for x in table.collect()])


def test_repair_of_odd_rows(spark):
    own = random.Random(8)
    rows = [(c, own.choice([None, *range(5)]) if c % 7 == 0 else t, own.choice(["user", "assistant", "system", "tool", "", None]), own.choice(["Yes.", "no", "", None, " \n", "é! \t", "Why?", "x" * 5000 + "."])) for c in range(120) for t in range(own.randrange(7))]
    # Turns of one number have no order of their own but for equal rows.
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values()) + [(None, 1, "user", "Of none."), (None, 2, "assistant", "Yes.")] + [(500, t, "user", "One of many?") for t in range(3000)]
    drop_all = next(k for k in range(1000, 9000) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    rows.append((drop_all, 1, "user", "gone"))
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "conv_id long, turn long, role string, text string, cost int, audit string")
    found = repair.repair_report(repair.damaged(df)).collect()
    got = {x["conv_id"]: tuple(x[n] for n in NAMES) for x in found}
    assert got == plain_repair(rows) and len(found) == len(got)
    assert got[drop_all] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_report(repair.damaged(empty)).collect() == []


def test_repaired_turns(spark):
    rows = [(1, 1, "system", "Be brief."), (1, 2, "assistant", "Hello."), (1, 3, "assistant", "Hello."), (1, 4, "user", "And")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    report = repair.judged(df)
    x = report.first()
    assert (x["duplicate"], x["truncated"], x["illegal"]) == (1, 1, 2)
    got = [tuple(y)[1:] for y in repair.repaired(df, report).orderBy("place").collect()]
    assert re.fullmatch("s?(ua)+", "".join(y[1][0] for y in got)) and "".join(y[3] for y in got) == x["audit"].replace("D", "")


# --- 13 quantile summaries


def plain_report(rows):
    groups = defaultdict(list)
    for s, g, b, x, w in rows:
        groups[s, g, b] += [x] * w
        groups[s, g, -1] += [x] * w
    return {k: sorted(v) for k, v in groups.items()}


def held(found, groups):
    """What must hold of the report's rows for the groups' sorted values."""
    got = {(x["stream"], x["grp"], x["batch"], x["i"]): x for x in found}
    assert len(got) == len(found) and set(got) == {(*k, i) for k, v in groups.items() if len(v) >= 20 for i in (1, 2, 3)}
    last = {}
    for (*k, i), x in sorted(got.items(), key=lambda y: repr(y[0])):
        v = groups[tuple(k)]
        n, target = len(v), math.ceil(i * len(v) / 4)
        assert (x["n"], x["target"], x["exact_x"]) == (n, target, v[target - 1])
        below, upto = bisect.bisect_left(v, x["answer"]), bisect.bisect_right(v, x["answer"])
        off = max(0, below + 1 - target, target - upto)
        assert (x["n_below"], x["n_upto"], x["rank_error"]) == (below, upto, off) and x["within"] and 1000 * off <= 20 * n
        assert min(10, len(set(v))) <= x["points"] <= min(n, 1000) and v[0] <= x["answer"] <= v[-1]
        assert last.get(tuple(k), x["answer"]) <= x["answer"]
        last[tuple(k)] = x["answer"]


def test_quantiles_of_odd_groups(spark):
    own = random.Random(2)
    rows = []
    for b in range(4):
        rows += [("s", "one value", b, 7, 50), ("s", "small", b, own.randrange(9), 6), ("s", "heavy", b, 10**12, 9000)]
        rows += [("s", "heavy", b, own.randrange(-(10**12), 10**12), 1) for _ in range(40)]  # many values in few rows
        rows += [("s", "wide", b, int(own.gauss(0, 1) * 10 ** own.randrange(1, 15)), 1 + own.randrange(3)) for _ in range(3000)]
        rows += [("s", "dense", b, own.randrange(300) + b * 50, 1) for _ in range(2000)]
        rows += [("t", None, b, k, 1) for k in range(30)]
    rows += [("s", "few", 0, k, 1) for k in range(19)] + [("s", "edge", 2, k % 2, 1) for k in range(20)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "stream string, grp string, batch int, x long, w long, k int, c int")
    held(quantiles.report(df).collect(), plain_report(rows))
    nulls = spark.createDataFrame([("s", "a", 0, None, 1), ("s", "a", 0, 1, None)], df.select("stream", "grp", "batch", "x", "w").schema)
    assert quantiles.report(nulls).collect() == [] and quantiles.report(df.filter("x IS NULL")).collect() == []


def test_quantiles_of_the_streams(spark):
    money = lambda v, b: math.floor(100 * v + 0.5) + 1000 * b
    rows = []
    clicks = {x["click_id"]: x for x in spark.read.parquet(f"{DATA}/clicks.parquet").collect()}
    for c, x in clicks.items():
        b = zlib.crc32(str(c).encode()) % 4
        rows += [] if None in (x["client_id"], x["value"]) else [("value", str(x["client_id"]), b, money(x["value"], b), 1)]
    items = {x["item_id"]: x for x in spark.read.parquet(f"{DATA}/items.parquet").collect()}
    for x in spark.read.parquet(f"{DATA}/sale_lines.parquet").collect():
        item, b = items.get(x["item_id"]), zlib.crc32(str(x["vendor_id"]).encode()) % 4
        rows += [("price", item["brand"], b, money(item["price"], b), 1)] if item and None not in (item["brand"], item["price"]) else []
    held(queries()["op13_quantile_summaries"](spark, DATA).collect(), plain_report(rows))


def test_many_summaries_merge_into_few_points(spark):
    own = random.Random(4)
    rows = [(b, own.randrange(10**6)) for b in range(40) for _ in range(500)]
    base = quantiles.counted(spark.createDataFrame(rows, "b int, x long"), ["b"])
    points = quantiles.Radix(base).points().selectExpr("struct(1 AS all) AS k", "lo", "hi", "c")
    got = quantiles.merge(points, most=200).orderBy("x").collect()
    values = sorted(x for _, x in rows)
    assert len(got) <= 200 and got[-1]["rmin"] == got[-1]["n"] == len(values)
    assert all(x["rmin"] <= bisect.bisect_right(values, x["x"]) <= x["rmax"] for x in got)
    assert all(b["rmin"] - a["rmin"] <= len(values) / 100 + len(values) * 0.02 for a, b in zip(got, got[1:], strict=False))
