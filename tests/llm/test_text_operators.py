"""Operators on documents against plain Python over the same rows."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from turnout.llm import near_duplicates as N
from turnout.llm import words as W
from turnout.llm.byte_bpe import Vocabulary, digests, encode
from turnout.llm.licenses import BASE, NOTICES, Scanner, errors_of, scan, scan_text, seeds
from turnout.llm.packing import cuts, pack, shortest_pack_first
from turnout.llm.substring_dedup import repeated_spans
from turnout.llm.token_counts import token_counts

from .frames import documents, prose, texts, words


def by_row(rows, *columns):
    return Counter(tuple(r[c] for c in columns) for r in rows)


# ------------------------------------------------------------------ substrings
def brute_spans(rows, window):
    first: dict = {}
    for i, t in rows:
        if i is not None:
            ws = words(t)
            for a in range(len(ws) - window + 1):
                k = tuple(ws[a : a + window])
                first[k] = min(first.get(k, i), i)
    out = Counter()
    for i, t in rows:
        ws = words(t)
        gone = [False] * len(ws)
        for a in range(len(ws) - window + 1):
            if i is not None and first[tuple(ws[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        kept = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out[i, len(ws), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window", [50, 20])
def test_repeated_spans(spark, window):
    got = repeated_spans(documents(spark), window).collect()
    assert by_row(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_spans(texts(), window)
    at = {}
    for i, t in texts():
        at.setdefault(i, []).append(words(t))
    for r in got:
        assert sum(s["n_words"] for s in r["spans"]) == r["n_removed"]
        covered = {w for f in r["factors"] for w in range(f["first_word"], f["first_word"] + f["n_words"])}
        assert covered == {w for s in r["spans"] for w in range(s["first_word"], s["first_word"] + s["n_words"])}
        for f in r["factors"]:  # copied from where it says, and as long as it may be without changing the source
            assert f["n_words"] >= window and f["source_id"] < r["doc_id"]
            own = [x for x in at[r["doc_id"]] if len(x) == r["n_words"]]
            taken = lambda x, a: x[a : a + f["n_words"]]  # noqa: B023, E731
            assert any(taken(x, f["first_word"]) == taken(y, f["source_word"]) for x in own for y in at[f["source_id"]])
        for f, g in zip(r["factors"], r["factors"][1:]):
            assert f["first_word"] < g["first_word"]
            assert (f["source_id"], f["source_word"] - f["first_word"]) != (g["source_id"], g["source_word"] - g["first_word"]) or g["first_word"] > f["first_word"] + f["n_words"] - window


def test_a_copied_passage_is_one_factor(spark):
    body = prose(77, 400)
    rows = [(1, " ".join(body)), (2, " ".join(["x", "y", *body[30:330], "z"])), (3, " ".join(body[100:200] + prose(78, 30) + body[:90]))]
    got = {r["doc_id"]: [tuple(f) for f in r["factors"]] for r in repeated_spans(documents(spark, rows)).collect()}
    assert got == {1: [], 2: [(2, 300, 1, 30)], 3: [(0, 100, 1, 100), (130, 90, 1, 0)]}


def test_repeated_spans_of_repetitive_texts(spark):
    rows = [(1, "a b " * 60), (2, "a b " * 90), (3, "b a " * 30 + "c " * 10), (4, "a b " * 24 + "a"), (5, "a b " * 25)]
    got = repeated_spans(documents(spark, rows)).collect()
    assert by_row(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_spans(rows, 50)


# --------------------------------------------------------------- near duplicates
def brute_links(rows, threshold=0.8):
    best: dict = {}
    for i, t in rows:
        ws = words(t)
        s = frozenset(tuple(ws[a : a + 5]) for a in range(len(ws) - 4)) or (frozenset([tuple(ws)]) if ws else frozenset())
        if i is not None and len(s) >= len(best.get(i, ())):
            best[i] = s
    ids = sorted(best)
    group, links, copy = {i: i for i in ids}, Counter(), {}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in ids:
        if best[i]:
            copy.setdefault(best[i], i)
        for j in ids:
            if i < j and best[i] and best[j] and len(best[i] & best[j]) / len(best[i] | best[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return Counter((i, i if i is None else find(i), None if i is None else copy.get(best[i], i), links[i]) for i, _ in rows)


@pytest.mark.parametrize("tile", [512, 2])
def test_near_duplicates(spark, monkeypatch, tile):
    monkeypatch.setattr(N, "TILE_SETS", tile)
    got = N.near_duplicates(documents(spark)).collect()
    assert by_row(got, "doc_id", "class_id", "copy_id", "n_links") == brute_links(texts())


@pytest.mark.parametrize("far", [0, 1, 5])
def test_ties_at_the_threshold_are_linked_in_every_bucket(far):
    def row(rep, s):
        return {"key": 1, "side": 0, "band": 0, "pure": True, "rep": rep, "copies": 1, "bands": [], "shingles": np.array(sorted(s), np.uint64).tobytes()}

    others = [row(10 + i, range(10**6 * (i + 1), 10**6 * (i + 1) + 7)) for i in range(far)]
    for k in range(1, 400):
        tie = N._tile([row(1, range(4 * k)), row(2, range(5 * k)), *others], 0.8)
        assert tie == [(1, 1, 1), (2, 1, 1)], k
        assert N._tile([row(1, range(4 * k - 1)), row(2, range(5 * k)), *others], 0.8) == [], k


def test_band_plan_reaches_the_recall():
    bands = N.plan_bands(0.8, 0.9995, 6)
    assert 1 - (1 - 0.8**6) ** bands >= 0.9995 > 1 - (1 - 0.8**6) ** (bands - 1)


def test_connected(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 200)]
    got = {r["rep"]: r["least"] for r in N.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_word_hashes_do_not_depend_on_their_place():
    import pyarrow as pa

    a, b = pa.array(["x yy zzz", None, "", "yy\tq"]), pa.array(["q zzz", "yy", "x"])
    hashed = [dict(zip([x for t in c.to_pylist() for x in words(t)], W.hashes(*W.spans(c)[:3]).tolist(), strict=True)) for c in (a, b, a.slice(2))]
    assert hashed[0] | hashed[1] | hashed[2] == hashed[0] and len(set(hashed[0].values())) == 4


# ------------------------------------------------------------------- tokenizers
def test_byte_bpe_round_trip(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    v = Vocabulary(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    want = Counter()
    for i, t in texts():
        ids = library.encode_ordinary(t or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want[i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert by_row(digests(documents(spark), path, P.PATTERN).collect(), *columns) == want
    whole = encode(documents(spark), path, P.PATTERN).collect()
    assert by_row(whole, *columns) == want
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole)


def test_many_distinct_long_words_and_a_small_table(spark, monkeypatch):
    """Words too long and too many for the tables, which empty themselves on the way."""
    import random

    from turnout.llm import units as U

    r = random.Random(9)
    rows = [(i, " ".join("".join(r.choices("abcdeéß.", k=r.randrange(1, 4000))) for _ in range(12))) for i in range(20)]
    rows += [(100 + i, f"a  b\t{i} c,d. e! " + "x" * i + "\n\n" + "don't  we'll, " * i) for i in range(20)]
    small = U.Table(room=50, ids=200)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    from turnout.llm.packing import WordIds

    enc = WordIds(P.path("word_bpe_49k.json"))
    enc.table = small
    import pyarrow as pa

    for lo in range(0, len(rows), 7):
        col = pa.array([x for _, x in rows[lo : lo + 7]])
        ids, first = enc.encode(col, 1)
        want = [[*t.encode(x, add_special_tokens=False).ids, 1] for x in col.to_pylist()]
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == want
        assert len(small.keys) <= 50 + len(set(" ".join(col.to_pylist()).split())) * 2
    path = P.path("byte_bpe_multi_50k.tiktoken")
    v = Vocabulary(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    got = {x["doc_id"]: np.frombuffer(x["ids"], "<u4").tolist() for x in encode(documents(spark, rows), path, P.PATTERN).collect()}
    assert got == {i: library.encode_ordinary(x) for i, x in rows}
    counter = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = {x["doc_id"]: x["n_tokens"] for x in token_counts(documents(spark, rows), P.path("byte_bpe_50k.json")).collect()}
    assert n == {i: len(counter.encode(x, add_special_tokens=False).ids) for i, x in rows}


@pytest.mark.parametrize("texts_", [["a b", None, "", "x.\ny!", " lead", "trail ", "two  gaps", "tab\tbed", "nb\u00a0sp", "é\u2003z", "q?!", "9.9.", "a\n\nb", ",", "a,"]])
def test_units_tile_every_text(texts_):
    import pyarrow as pa
    import regex

    from turnout.llm.units import pre_units

    find = regex.compile(P.PATTERN).findall
    data, cut, before = pre_units(pa.array(texts_), lambda t: list(map(len, find(t))))
    raw = bytes(data)
    for i, t in enumerate(texts_):
        own = [raw[a:b].decode() for a, b in zip(cut[before[i] : before[i + 1]], cut[before[i] + 1 : before[i + 1] + 1])]
        assert "".join(own) == (t or "")
        assert [p for u in own for p in find(u)] == find(t or "")


def test_rank_queue_on_long_and_equal_pre_tokens():
    v = Vocabulary(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=v.ranks, special_tokens={})
    pieces = ["a" * n for n in range(1, 40)] + ["ab" * 5000, "".join(prose(5, 5000)), "the" * 999]
    got = v.encode([p.encode() for p in pieces])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode_ordinary(p) for p in pieces]
    assert v.encode([]) == []


def test_token_counts(spark):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = Counter()
    for i, x in texts():
        n = len(t.encode(x or "", add_special_tokens=False))
        want[i, len((x or "").encode()), n, n > 1024] += 1
    assert by_row(token_counts(documents(spark), path).collect(), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


# ---------------------------------------------------------------------- packing
def test_pack(spark):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for i, x in texts()]
    want = Counter()
    for i, x in ids:
        at = 0
        for n in cuts(len(x), 2048, 512):
            want[i, at, n, zlib.crc32(np.array(x[at : at + n], "<u4").tobytes()), len(x)] += 1
            at += n
        assert at == len(x)
    got = pack(documents(spark), path).collect()
    assert by_row(got, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == want
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= 2048
    assert sorted(sequences) == list(range(len(sequences)))


@pytest.mark.parametrize("histogram", [{}, {2048: 3}, {1: 5000}, {1025: 7}, {1500: 9, 548: 4, 3: 1000}, {n: n % 7 + 1 for n in range(1, 2049)}])
def test_shortest_pack_first_holds_every_length(histogram):
    packs = shortest_pack_first(dict(histogram), 2048)
    held = Counter()
    for count, lengths in packs:
        assert count > 0 and sum(lengths) <= 2048
        for n in lengths:
            held[n] += count
    assert held == Counter(histogram)


# --------------------------------------------------------------------- licences
LICENSED = [
    (1, "Released under the MIT License."), (2, "mit\nLICENSE, MIT-license mit licenses"), (3, "Apache Licence 2.0"), (4, "GNU General Publik License"),
    (5, None), (6, ""), (7, "summit license"), (8, "the word " * 9000 + "general public   license"), (9, "Licensed under CC BY-NC 4.0."), (None, "mit license"),
    (10, "permision is hereby granted, free of charge to any persn obtaining a copy"), (1, "Released under the MIT License."),
]


def test_scan(spark):
    got = scan(documents(spark, LICENSED)).collect()
    rows = {r["doc_id"]: r for r in got}
    assert len(got) == len(LICENSED) and sum(r["doc_id"] == 1 for r in got) == 2
    for i, t in LICENSED:
        ws = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        places = [(a, label) for p, label in BASE.items() for a in range(len(ws)) if ws[a : a + len(p.split())] == p.encode().split()]
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(ws), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == (min((a for a, _ in places), default=None), max((a for a, _ in places), default=None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert rows[3]["labels"] == "apache" and rows[4]["labels"] == "gpl" and rows[10]["labels"] == "mit" and rows[9]["labels"] == "cc"
    assert rows[7]["labels"] == "" and rows[5]["score"] == 0


def test_seeds_meet_every_notice_with_errors():
    import random

    r, scanner = random.Random(3), Scanner()
    for notice in NOTICES:
        assert "".join(s for _, s in seeds(notice)) == notice and len(seeds(notice)) == errors_of(notice) + 1
        for _ in range(20):
            text = list(notice)
            for _ in range(errors_of(notice)):
                at = r.randrange(len(text))
                text[at] = r.choice(["", "q", text[at] + "q"])
            if "  " in "".join(text) or text[0] in ("", " ") or text[-1] in ("", " "):
                continue
            found = scan_text(scanner, "xx yy " + "".join(text) + " zz")
            assert NOTICES[notice] in found["labels"].split(","), (notice, "".join(text))


def test_adjacent_notices_with_falling_errors_are_all_found():
    scanner = Scanner({"released under the mit license": "mit"})
    forms = ["released undr the mut license", "released under the mut license", "released under the mit license"]
    for row in (forms, forms[1:], forms[::-1], forms * 3, [forms[1], forms[2], forms[0], forms[1]], forms[2:] * 5):
        text = " ".join(row)
        want, at = [], 0
        for x in row:
            want.append((at, at + len(x.split()) - 1, forms[::-1].index(x)))
            at += len(x.split())
        assert [(s["first_word"], s["last_word"], s["errors"]) for s in scan_text(scanner, text)["spans"]] == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_spans_against_an_edit_distance_search():
    import random

    notices = {"released under the mit license": "mit", "gnu public license": "gpl", "all rights reserved": "own"}
    r, scanner = random.Random(12), Scanner(notices)
    for _ in range(60):
        ws = []
        for _ in range(r.randrange(1, 6)):
            ws += [r.choice(["the", "license", "mit", "under", "xy", "all"]) for _ in range(r.randrange(4))]
            text = list(r.choice(list(notices)))
            for _ in range(r.randrange(4)):
                at = r.randrange(len(text))
                text[at] = r.choice(["", "q", text[at] + "q"])
            ws += "".join(text).split()
        got = scan_text(scanner, " ".join(ws))["spans"]
        for notice in notices:
            k = errors_of(notice)
            own = [(s["first_word"], s["last_word"], s["errors"]) for s in got if s["notice"] == notice]
            every = [
                (a, b, d) for a in range(len(ws)) for b in range(a, min(len(ws), a + 8))
                if abs(len(" ".join(ws[a : b + 1])) - len(notice)) <= k and (d := distance(" ".join(ws[a : b + 1]), notice)) <= k
            ]
            assert set(own) <= set(every)
            assert all(a2 > b1 for (_, b1, _), (a2, _, _) in zip(own, own[1:]))
            for a, b, d in every:  # another match of as few errors stands in its place
                assert any(x <= b and a <= y and e <= d for x, y, e in own), (ws, notice, (a, b, d), own)


def test_a_megabyte_of_near_notices_takes_seconds():
    import time

    n = 33_000
    began = time.perf_counter()
    got = scan_text(Scanner(), "released under the mut license " * n)
    assert time.perf_counter() - began < 30
    spans = [s for s in got["spans"] if s["notice"] == "released under the mit license"]
    assert [(s["first_word"], s["errors"]) for s in spans] == [(5 * i, 1) for i in range(n)]


@pytest.mark.parametrize("operator", [
    repeated_spans, N.near_duplicates, scan, lambda d: digests(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
    lambda d: token_counts(d, P.path("byte_bpe_50k.json")), lambda d: pack(d, P.path("word_bpe_49k.json")),
])
def test_empty_table(spark, operator):
    assert operator(documents(spark).limit(0)).count() == 0
