"""Runs against their definition, pair by pair."""

import hashlib
import random
import zlib

import pytest

from turnout.llm import periodic_runs as R

from .frames import LONG, documents, prose, texts, words


def brute_runs(ws, repeats, least):
    out = []
    for q in range(1, len(ws) // repeats + 1):
        a = 0
        while a + q < len(ws):
            b = a
            while b + q < len(ws) and ws[b] == ws[b + q]:
                b += 1
            n = b - a + q
            if b > a and n >= max(least, repeats * q) and not any(all(ws[i] == ws[i + p] for i in range(a, a + n - p)) for p in range(1, q)):
                out.append((a, n, q))
            a = b + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefgh"])
def test_all_runs_of_random_words(letters):
    r = random.Random(len(letters))
    for k in range(150):
        ws = [r.choice(letters) for _ in range(r.randrange(60))]
        if k % 2 and ws:
            part = ws[: 1 + r.randrange(9)]
            ws[5:5] = part * r.randrange(2, 9)
        assert R.maximal_runs(ws) == brute_runs(ws, 2, 1), ws
        assert R.maximal_runs(ws, 4, 6) == brute_runs(ws, 4, 6)


def test_arrays_give_what_lists_give(monkeypatch):
    ws = list("abaabaabaabab" * 9 + "aaaaaaaabc" * 5)
    want = R.maximal_runs(ws)
    monkeypatch.setattr(R, "LISTED", 1)
    assert R.maximal_runs(ws) == want == brute_runs(ws, 2, 1)


def test_a_long_run_takes_few_steps():
    assert R.maximal_runs([0] * 60_000, 4, 6) == [(0, 60_000, 1)]
    fib = ["a", "b"]
    while len(fib) < 20_000:
        fib += fib[: len(fib) - len(fib) // 3]
    assert all(n >= 4 * p for _, n, p in R.maximal_runs(fib, 4, 6))


def brute(doc_id, text, plant):
    ws = words(text)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if plant and h % 10 == 0 and ws:
        g = h // 10
        a = g % len(ws)
        p = 1 + (len(ws) - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(len(ws))]
    runs = brute_runs(ws, 4, 6)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(b" ".join(w for i, w in enumerate(ws) if i not in gone)),
    )


ROWS = [
    (1, "x " + "a b c " * 5 + "y"), (2, "a " * 6), (3, "a " * 5), (4, "a b " * 4), (5, "a b " * 4 + "a"), (6, "a b a b a b a c"), (7, None), (8, ""), (9, " \n"),
    (10, "p " + "a a a a a a b " * 6), (11, "\t".join(["é", "ü"] * 9)), (None, "z " * 40), (12, "a b c d " * 4 + " ".join(prose(1, 50)) + " a b c d" * 5),
    (13, "a b c " * 4 + "a b c d " * 4), (13, "a b c " * 4 + "a b c d " * 4),
]


@pytest.mark.parametrize("plant", [None, R.planted])
def test_digests(spark, plant):
    rows = [*ROWS, *((100 + i, " ".join(prose(i, 40 + i))) for i in range(120)), *(r for r in texts() if len(r[1] or "") < 3000)]
    got = R.digests(documents(spark, rows), plant).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute(i, t, plant) for i, t in rows), key=repr)
    assert sum(r["n_runs"] > 0 for r in got) > (15 if plant else 8)


def test_periodic_runs_keep_the_rest_of_the_text(spark):
    rows = [*ROWS, (300, " ".join(prose(3, LONG))), (301, "tic tac " * 30_000)]
    got = R.periodic_runs(documents(spark, rows)).collect()
    for r in got:
        if r["doc_id"] == 301:
            assert [tuple(x) for x in r["runs"]] == [(0, 60_000, 2)] and r["kept_text"] == "tic tac"
        elif r["doc_id"] == 300:
            assert r["n_words"] == LONG and len(r["kept_text"].split()) <= LONG
    whole = {(r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"])) for r in got if r["doc_id"] != 300 and r["doc_id"] != 301}
    assert whole == {(i, len(words(t)), tuple(brute_runs(words(t), 4, 6))) for i, t in ROWS}
    assert R.periodic_runs(documents(spark).limit(0)).count() == R.digests(documents(spark).limit(0)).count() == 0
