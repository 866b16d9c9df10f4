"""Operators 11 to 13 against plain versions: repair, decontamination, prefix trie."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.llm import decontaminate as D
from tarn.llm import repair as R
from tarn.llm import trie as T
from tarn.llm.batches import utf8

TURNS = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def conversations(seed, sizes=(0, 1, 5, 40, 150)):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = []
    for c in [None, -8, -5, -3, 0, 1, 2, 5, 6, 7, 9, 10, *range(30, 45)]:
        for t in range(rng.choice(sizes)):
            text = rng.choice(["hi.", "hello", "", "  ", None, "what?", f"a{t}.", f"b{t}", "c\nd!", "é" * 3])
            rows.append((c, rng.choice([None, t, t, t, t]), rng.choice(roles), text))
    return rows


# Repair.


def cheapest(symbols):
    """(cost, least letters) by a search over all edits in order of cost and letters."""
    done = {}
    queue = [(0, "", 0, R.START)]
    while queue:
        cost, letters, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done[i, state] = cost, letters
        if i < len(symbols):
            heapq.heappush(queue, (cost + 2, letters + "D", i + 1, state))
            x = symbols[i]
            if x > R.GONE:
                extra = 5 * (x & 1)
                if (state, (x - 2) // 2) in R.KEPT:
                    heapq.heappush(queue, (cost + extra, letters + "K", i + 1, R.KEPT[state, (x - 2) // 2]))
                heapq.heappush(queue, (cost + extra + 1, letters + "R", i + 1, R.NEXT[state]))
        if len(letters) < 3 * len(symbols) + 6:
            heapq.heappush(queue, (cost + 5, letters + "I", i, R.NEXT[state]))
    return min(done[len(symbols), s] for s in (R.START, R.ASSISTANT))


def plain_repair(rows):
    space = " "
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        out = held[conv]
        role, text = (space if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(space if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    answer = {}
    for conv, turns in held.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, symbols, seen = [], [], set()
        for _, role, text in turns:
            words = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            initial = {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)
            symbols.append(R.GONE if fault in ("blank", "duplicate") else 2 + 2 * initial + (fault == "truncated"))
        cost, letters = cheapest(symbols)
        legal, rest, lines = "", iter(turns), []
        for letter in letters:
            role, text = ("", "") if letter == "I" else next(rest)[1:]
            if letter in "IR":
                role = "assistant" if legal[-1:] == "u" else "user"
            if letter != "D":
                legal += role[0]
                lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", legal)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False)]
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        answer[conv] = (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, digest)
    return answer


def test_block_tables_give_the_least_cheapest_edits():
    rng, t = random.Random(3), R.tables()
    for _ in range(1500):
        symbols = [rng.randint(1, 9) for _ in range(rng.randint(0, 11))]
        codes = t.codes(symbols)
        costs, after = t.costs(codes, t.accept)
        letters, state = t.trace(codes, after, R.START)
        assert (costs[R.START], letters + t.close(state)[0]) == cheapest(symbols)


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_whole_and_in_pieces(spark, monkeypatch, seed):
    rows = conversations(seed)
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("x") for c in ("audit", "piece", "_row", "key")})
    want = plain_repair(rows)
    assert {r[0]: tuple(r[1:]) for r in R.repair(df).collect()} == want
    monkeypatch.setattr(R, "PIECE", 7)
    assert {r[0]: tuple(r[1:]) for r in R.repair(df, 3).collect()} == want


def test_repair_of_conversations_without_rows(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = R.repair(spark.createDataFrame([(dropped, 0, "user", "hi.")], TURNS)).collect()
    assert [tuple(r) for r in got] == [(dropped, 0, 0, 0, 0, 0, 0, "", EMPTY)]
    assert R.repair(spark.createDataFrame([], TURNS)).count() == 0


# Decontamination.

ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_leaks(docs, items):
    """[(n_words, hit words, item ids)] of each text."""
    windows = defaultdict(set)
    for i, text in items:
        w = ITEM_WORDS.findall(brute.lower_ascii(text))
        size = min(len(w), D.WINDOW)
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add("" if i is None else str(i))
    out = []
    for text in docs:
        w = ITEM_WORDS.findall(brute.lower_ascii(text))
        hit, ids = set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                found = windows.get(tuple(w[p : p + size]))
                if found:
                    hit |= set(range(p, p + size))
                    ids |= found
        out.append((len(w), len(hit), sorted(ids)))
    return out


def leak_cases(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "the", "Ünder", "zz9", "longerword", "x", "yy", "A", "ß"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ". ", "--", "\n", "\x00"]) for _ in range(n))

    items = [(rng.choice([None, 1, 2, 33, 4]), text(rng.choice([0, 1, 3, 9, 10, 12, 25]))) for _ in range(12)]
    docs = [text(rng.randint(0, 60)) + rng.choice(items)[1] + text(rng.randint(0, 60)) for _ in range(25)]
    common = "of the same words again and again in one long line "
    docs += ["", None, " .,", common * 300, "q" * 100_000 + " " + items[0][1]]
    return docs, [*items, (7, None), (8, common), (9, common + common)]


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_match_plain_search(spark, seed):
    docs, items = leak_cases(seed)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    df = df.withColumns({c: F.lit("x") for c in ("hits", "items", "item", "words")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = plain_leaks(docs, items)
    for passes in (D.PASS_BYTES, 200):
        rows = D.decontaminate(df, bench, passes).withColumn("n", D.n_hit(F.col("hits"))).orderBy("doc_id").collect()
        assert [(r["n_words"], r["n"], r["items"]) for r in rows] == want


def test_leaks_without_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    rows = D.decontaminate(docs, none).collect()
    assert sorted((r["n_words"], r["hits"], r["items"]) for r in rows) == [(0, [], []), (2, [], []), (2, [], [])]
    assert D.decontaminate(docs.limit(0), none).count() == 0


def test_short_and_long_strings_shift_apart():
    items = ["a", "b c", "one two three four five six seven eight nine ten", "x" * 500]
    bench = D.Benchmark(["i"] * 4, pa.array(items))
    assert sorted(g.lead for g in bench.groups) == sorted(max(len(i) + 2 - 8, 0) for i in items)
    words = D.Words(*utf8(pa.array(["A-b,c " + items[2] + " eleven " + items[3], "b", "c"])))
    assert len(bench.find(words)[0]) == 4


# Prefix trie.


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, name, len(text.encode())))
    paths = {}
    for c in own:
        own[c].sort()
    for c in own:
        family = c - (c % 5 if c >= 0 else -(-c % 5))
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = [t[2:] for t in own.get(family, [])[:h] + own[c][h:]]
    members, last = defaultdict(list), {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            key = tuple(t[0] for t in path[:d])
            members[key].append(c)
            last[key] = path[d - 1][1] if d else 0
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in members:
        children[key[:-1]] += bool(key)
    for key, m in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(m) - 1) * last[key]
    out = []
    for key, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(key))
        up = min(members[key[:-1]]) if key else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(key), up, len(m), children[key], leaves[key], saved[key], digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_whole_in_shards_and_in_pieces(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = []
    for c, *_ in {(r[0],) for r in conversations(seed, (1,))}:
        for t in range(rng.choice([1, 2, 5, 9, 40])):
            usual = [("user", "hi")] if t < 6 else [("user", "a"), ("assistant", "b"), ("x", "é"), (None, None)]
            rows.append((c, rng.choice([None, t, t, t]) if seed == 2 else t, *rng.choice(usual)))
    rows += [(c, t, "user", "hi") for c in range(100, 140) for t in range(12)]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("x") for c in ("base", "path", "kind", "at")})
    want = plain_trie(rows)

    def got(**options):
        return sorted((tuple(r[c] for c in T.RESULT) for r in T.prefix_trie(df, **options).collect()), key=str)

    assert got() == want
    monkeypatch.setattr(T, "SHARD", 5)
    assert got() == want
    monkeypatch.setattr(T, "WIDTH", 4)
    assert got() == want
    assert got(long=3) == want


def test_trie_of_nothing(spark):
    assert T.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert T.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).count() == 0
