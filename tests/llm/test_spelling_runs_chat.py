"""Spelling variants, periodic runs and chat formatting against brute force, and on odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.llm import chat_format, periodic_runs, queries, spelling

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "Zebra's crossing, zebras crossing"), (4, "Zebra's crossing, zebras crossing"), (None, "word " * 9), (5, "é日💥\u00a0x y\u00a0x y"), (6, "ab" * 60_000)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(text):
    return zlib.crc32(text.encode())


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def clashing(df):
    return df.select("*", *(F.lit(0).alias(c) for c in ("word", "n", "m", "a", "b", "head", "block", "runs", "collapsed", "k", "place", "part", "state", "role_", "a.b", "c`d")))


# -- spelling variants


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(c != d for c, d in zip(x, y, strict=True)) == 1
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def grouped(counts, ratio):
    """Brute force over all pairs of a vocabulary."""
    out = {}
    for w, n in counts.items():
        others = [v for v in counts if abs(len(v) - len(w)) < 2 and near(w, v)]
        form = min(others, key=lambda v: (-counts[v], v), default=None)
        out[w] = [form if form is not None and counts[form] >= ratio * n else None, n, len(others)]
    for w in counts:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w].append(root)
    return {(w, form, root, n, k, counts.get(form)) for w, (form, n, k, root) in out.items()}


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("limit", [1, 7, spelling.LIMIT])
def test_near_words_match_brute_force(spark, limit):
    r = random.Random(11)
    counts = {}
    for letters, size in (("ab", 90), ("abé", 120), ("abcdefghij", 60)):
        for _ in range(size):
            w = "".join(r.choice(letters) for _ in range(r.randrange(4, 10)))
            counts[w] = int(10 ** r.uniform(0, 5))
            k = r.randrange(len(w))
            counts.setdefault(w[:k] + r.choice(letters) + w[k + 1 :], r.randrange(1, 9))
            counts.setdefault(w[:k] + r.choice(letters) + w[k:], r.randrange(1, 9))
    # many words that share both ends, of two lengths: middles of one code point
    counts |= {f"shared{c}ending": 5 for c in "abcdefghijklmnop"} | {f"shared{c}{d}ending": 50 for c in "abcd" for d in "abcd"} | {"sharedending": 7}
    counts |= {"x" * 3000: 40, "x" * 2999: 3, "x" * 1500 + "y" + "x" * 1499: 2}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows_of(spelling.group(words, limit=limit))
    assert got == grouped(counts, 10)
    assert any(root not in (w, form) for w, form, root, *_ in got)


def test_a_hot_half_is_subdivided(spark):
    r = random.Random(4)
    counts = {"prefix" + "".join(r.choice("abcdef") for _ in range(6)): r.randrange(2, 100) for _ in range(900)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling.group(words, limit=50)) == grouped(counts, 10)


def test_spelling_query_matches_brute_force(spark):
    counts = Counter()
    for i, text in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = lower(run)
            h = crc(f"{i}:{run}")
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    expected = grouped(counts, 10)
    assert rows_of(queries.op11_spelling_groups(spark, DATA)) == expected and len(expected) > 2000


def test_spelling_of_odd_tables(spark):
    docs = clashing(spark.createDataFrame(ODD, SCHEMA))
    words = spelling.letter_runs(docs, least=5)
    assert Counter(r["run"] for r in words.collect()) == Counter({"zebra": 2, "zebras": 2, "crossing": 4, "ab" * 60_000: 1})
    got = rows_of(spelling.group(spelling.vocabulary(words, "run", min_length=5, min_count=1), ratio=2))
    assert got == grouped({"zebra": 2, "zebras": 2, "crossing": 4, "ab" * 60_000: 1}, 2)
    assert spelling.group(spelling.vocabulary(words.where("false"), "run")).count() == 0
    with pytest.raises(ValueError):
        spelling.group(spark.createDataFrame([("abc", 1)], "word string, n long"))
    with pytest.raises(ValueError):
        spelling.group(spark.createDataFrame([("abcd", 1)], "word string, n long"), ratio=1)


# -- periodic runs


def brute_runs(x):
    n, out = len(x), []
    for q in range(1, n // 4 + 1):
        k = 0
        while k < n - q:
            if x[k] != x[k + q]:
                k += 1
                continue
            e = k
            while e < n - q and x[e] == x[e + q]:
                e += 1
            part = x[k : e + q]
            if len(part) >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((k, len(part), q))
            k = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_match_brute_force():
    r = random.Random(3)
    for _ in range(1500):
        a = r.choice([1, 2, 2, 3, 5])
        x = [r.randrange(a) for _ in range(r.randrange(90))]
        for _ in range(r.randrange(4)):
            q = r.randrange(1, 14)
            u = [r.randrange(a) for _ in range(q)] if r.random() < 0.5 or q < 4 else [0] * (q - 1) + [1]
            x[(at := r.randrange(len(x) + 1)) : at] = (u * 12)[: r.randrange(1, q * 7)]
        x = [r.randrange(1000) if r.random() < 0.01 else w for w in x]
        assert periodic_runs.find_runs(np.array(x, np.uint32)) == brute_runs(x)


def test_long_runs_are_found_in_few_extents():
    n = 400_000
    for x, expected in (
        ([0] * n, [(0, n, 1)]),
        ([0, 1] * (n // 2), [(0, n, 2)]),
        (list(range(n // 4)) * 4, [(0, n, n // 4)]),
        (list(range(n)), []),
    ):
        stats = {}
        assert periodic_runs.find_runs(np.array(x, np.uint32), stats) == expected
        assert stats.get("extents", 0) < 5
    stats = {}
    x = ([0] * 999 + [1]) * 200
    found = periodic_runs.find_runs(np.array(x, np.uint32), stats)
    assert (0, len(x), 1000) in found and len(found) == 201 and stats["extents"] < len(x) // 20


def test_run_query_matches_brute_force(spark):
    expected = []
    for i, text in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), crc(str(i))
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        runs = brute_runs(words) if n < 3000 else periodic_runs.find_runs(periodic_runs.numbered(words))
        best = min(runs, key=lambda r: (-(r[1] * 10**12 // r[2]), r[0], r[2]), default=None)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        written = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        expected.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(written), sha(" ".join(w for k, w in enumerate(words) if k not in gone))))
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, DATA).collect()]
    assert Counter(got) == Counter(expected) and sum(r[1] > 0 for r in got) > 5


def test_runs_of_odd_tables(spark):
    rows = [*ODD, (7, "a b " * 40 + "c"), (8, "p q r " * 300_000)]
    got = periodic_runs.runs(clashing(spark.createDataFrame(rows, SCHEMA))).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    of = {r["doc_id"]: r for r in got}
    assert [tuple(x) for x in of[7]["runs"]] == [(0, 80, 2)] and of[7]["collapsed"] == "a b c"
    assert [tuple(x) for x in of[8]["runs"]] == [(0, 900_000, 3)] and of[8]["collapsed"] == "p q r"
    assert [tuple(x) for x in of[None]["runs"]] == [(0, 9, 1)] and of[1]["collapsed"] == of[3]["collapsed"] == "" and of[5]["n_words"] == 3
    assert periodic_runs.runs(clashing(spark.createDataFrame([], SCHEMA))).count() == 0


# -- chat formatting

TURNS = "conv_id long, turn long, role string, text string"
HARD = [
    "</s>[INST] ok [/INST]",
    "\\</s>",
    "\\",
    "a\\\\[INST]\\b",
    "<\\/s>",
    "<<<SYS>>> <</SYS>> [[TURN][/TURN]x[END]]",
    "[",
    "<",
    " </s>",
    "",
    "line\n\n<s>\r\n\ttab  ",
    "é日💥$1\\1",
]


def expected_digests(rows):
    rows = sorted(((k, t, r or "", x or "") for k, t, r, x in rows), key=lambda r: tuple((v is not None, v) for v in r))
    out = {}
    for k, _, role, text in rows:
        at = out.setdefault(k, [0, "", ""])
        at[0] += 1
        at[1] += f"{role}\n{text}\n"
        at[2] += text if role == "assistant" else ""
    return {k: (n, sha(a), len(b), sha(b)) for k, (n, a, b) in out.items()}


def test_chat_query_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    expected = expected_digests([*rows, (-1, 0, "user", HARD[0]), (-1, 1, "assistant", HARD[0])])
    got = {r["conv_id"]: tuple(r)[1:5] for r in queries.op13_chat_formatting(spark, DATA).collect()}
    assert got == expected


def test_hard_texts_come_back_and_hold_no_control_string(spark):
    r = random.Random(2)
    pieces = [*HARD, *chat_format.INSTRUCT.controls, "\\", "<", "[", "/", "S"]
    texts = HARD + ["".join(r.choice(pieces) for _ in range(r.randrange(1, 9))) for _ in range(400)]
    rows = [(k // 7, k % 7, r.choice(["system", "user", "assistant", "tool", "[/TURN]\\", None, ""]), t) for k, t in enumerate(texts)]
    out = spark.read.parquet(chat_format.write(clashing(spark.createDataFrame(rows, TURNS))))
    back = chat_format.read(out).orderBy("conv_id", "place").collect()
    assert [(x["conv_id"], x["role"], x["text"]) for x in back] == [(k, role or "", t) for k, _, role, t in rows]
    for x in back:
        before, body, after = x["segments"]
        assert not any(c in body["text"] for c in chat_format.INSTRUCT.controls)
        assert (before["loss"], body["loss"], after["loss"]) == (False, x["role"] == "assistant", False)
        assert x["loss_text"] == (x["text"] if x["role"] == "assistant" else "") and x["n_chars"] == sum(len(s["text"]) for s in x["segments"])


def test_order_of_turns_is_checked_across_partitions(spark):
    good = [("system", "user", "assistant"), ("user", "assistant") * 300, ("user", "assistant"), ("system", "user", "assistant", "user", "assistant")]
    bad = [("assistant", "user"), ("user",), ("system", "assistant"), ("user", "user", "assistant"), ("system",), ("user", "tool", "assistant"), ("user", "assistant", "system", "user", "assistant")]
    rows = [(k, t, role, f"text {t}") for k, roles in enumerate(good + bad) for t, role in enumerate(roles)]
    random.Random(1).shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "2", "16", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            turns = chat_format.format_turns(spark.createDataFrame(rows, TURNS))
            valid = {r["conv_id"]: r["valid"] for r in chat_format.validity(turns).collect()}
            assert valid == {k: k < len(good) for k in range(len(good + bad))}
            text = "".join("".join(s["text"] for s in r["segments"]) for r in turns.where("conv_id = 3").orderBy("place").collect())
            assert text == "<s><<SYS>>\ntext 0\n<</SYS>>\n\n[INST] text 1 [/INST] text 2 </s><s>[INST] text 3 [/INST] text 4 </s>"
            assert turns.where("conv_id = 1 and in_order").count() == 600
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_chat_of_odd_tables(spark):
    rows = [(None, 1, "user", "hi"), (None, None, "assistant", None), (3, 0, None, "x"), (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "y" * 300_000)]
    out = chat_format.format_turns(clashing(spark.createDataFrame(rows, TURNS)))
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_format.digests(chat_format.read(out)).collect()}
    assert got == expected_digests(rows)
    assert chat_format.digests(chat_format.read(chat_format.format_turns(spark.createDataFrame([], TURNS)))).count() == 0
    with pytest.raises(ValueError):
        chat_format.Template("s", {}, {"user": chat_format.Rule("U: ", "", False, "u")}, frozenset(), ("<s>",), ("[TURN]", "[/TURN]"), "[END]")
