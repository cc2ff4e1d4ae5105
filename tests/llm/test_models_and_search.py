"""Quality rules, toxicity, neighbours, pages and the pipeline."""

import json
import math
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import rows as normal
from turnout.llm import binary_codes as B
from turnout.llm import html_text as H
from turnout.llm import toxicity as T
from turnout.llm.quality_rules import judge, measures

from .frames import documents, prose, texts

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------------- quality
def brute_measures(text):
    ws = (text or "").encode().split()
    runs: dict = {}
    for a in range(len(ws) - 7):
        runs.setdefault(tuple(ws[a : a + 8]), []).append(a)
    repeated = {a + j for at in runs.values() if len(at) > 1 for a in at for j in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    chars = sum(len(w.decode()) for w in ws)
    return len(ws), chars, sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_measures(spark):
    extra = [(90, "a b c d e f g h " * 5 + "x\n\n"), (91, "one\ntwo\none\n \none"), (92, "#a *b $c %d &e |f <g> h\n")]
    rows = texts() + extra
    got = measures(documents(spark, rows)).collect()
    want = sorted(((i, *brute_measures(t)) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got), key=repr) == want


def test_judge_follows_the_group(spark):
    rows = [(i, " ".join(prose(i, 60))) for i in range(300)] + [(900, " ".join(x + "%%%" for x in prose(1, 60))), (901, "too short"), (902, None)]
    rows += [(903, " ".join("Longwordwithmanyletters" + x for x in prose(3, 60)))]
    got = {r["doc_id"]: r for r in judge(documents(spark, rows)).collect()}
    assert all(got[i]["kept"] for i in range(300)) and not any(got[i]["kept"] for i in (900, 901, 902, 903))
    assert got[901]["base_failed"] and not got[900]["base_failed"]
    assert judge(documents(spark).limit(0)).count() == 0


def test_each_measure_can_reject_a_document_that_passes_the_base_rules(spark):
    ws = prose(5, 100)
    lines = [" ".join(prose(70 + i, 6)) for i in range(12)]
    planted = {
        "mean_word": " ".join(w + "abc" for w in ws),
        "symbol_share": " ".join(w + "%" if i % 2 else w for i, w in enumerate(ws)),
        "dup_line_share": "\n".join(x for i, x in enumerate(lines) for x in [x] * (1 + (i < 5))),
        "repeat_share": " ".join(ws[:88] + ws[20:32]),
        "caps_share": " ".join(w.upper() if i % 8 == 0 else w for i, w in enumerate(ws)),
    }
    rows = [(i, " ".join(prose(i, 60))) for i in range(300)] + [(900 + k, t) for k, t in enumerate(planted.values())]
    got = {r["doc_id"]: r for r in judge(documents(spark, rows)).collect()}
    assert all(got[i]["kept"] for i in range(300))
    for k, m in enumerate(planted):
        r = got[900 + k]
        assert not r["base_failed"] and not r["kept"] and r[m] > r[f"max_{m}"], m


def test_fences_of_a_large_group_are_near_those_of_exact_quantiles(spark):
    from turnout.llm.quality_rules import FENCE, OUTER, STEPS, thresholds

    r = np.random.default_rng(7)
    n = 30_000
    cols = {m: r.gamma(2.0, 0.1 * (i + 1), n) for i, m in enumerate(STEPS)}
    rows = [("en", None if i % 3 else "s", i % 11 == 0, *(float(c[i]) for c in cols.values())) for i in range(n)]
    df = spark.createDataFrame(rows, "lang string, source string, base_failed boolean, " + ", ".join(f"{m} double" for m in STEPS)).repartition(6)
    got = {x["t_source"]: x for x in thresholds(df).collect()}
    for source, pick in ((None, lambda i: i % 3), ("s", lambda i: not i % 3)):
        some = np.array([i for i in range(n) if pick(i) and i % 11])
        for m, least in STEPS.items():
            x = np.sort(cols[m][some])
            rank = lambda q: x[[int((q - 0.01) * len(x)), int((q + 0.01) * len(x))]]  # noqa: B023, E731
            (mid_lo, mid_hi), (out_lo, out_hi) = rank(0.5), rank(OUTER)
            low, high = mid_lo + FENCE * max(out_lo - mid_hi, least), mid_hi + FENCE * max(out_hi - mid_lo, least)
            assert low - 0.005 <= got[source][f"max_{m}"] <= high + 0.005, (source, m)


# --------------------------------------------------------------------- toxicity
def brute_segments(s):
    """Maximal segments by definition: best sum, widest among none shorter, then left and right of it."""
    best = None
    for a in range(len(s)):
        for b in range(a + 1, len(s) + 1):
            x = sum(s[a:b])
            if x > 0 and (best is None or x > best[0]):
                best = (x, a, b)
    if best is None:
        return []
    x, a, b = best
    return brute_segments(s[:a]) + [best] + [(y, i + b, j + b) for y, i, j in brute_segments(s[b:])]


def test_segments_are_all_maximal_ones():
    r = random.Random(1)
    for _ in range(300):
        s = [r.choice([-5, -3, -2, -1.5, 1.25, 2, 4.125, 7]) + r.random() / 100 for _ in range(r.randrange(12))]
        got = [(round(x, 6), a, b) for x, a, b in T.segments(s)]
        assert got == [(round(x, 6), a, b) for x, a, b in brute_segments(s)]


def toxic_frames(spark, n=900):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        ws, bad = prose(1000 + i, 80), i % 6 == 0
        if bad:
            for _ in range(6):
                ws.insert(r.randrange(len(ws)), "vile" + r.choice(["mouth", "thing", "one", "ness"]) if i % 12 else r.choice(["creep", "fool"]))
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(bad)))
    rows += [(None, "vilething"), (n, None), (n + 1, ""), (n + 2, "vileunseen vilemouth " * 3000)]
    labels += [(None, 1, 1), (5, None, None), (n, 0, 0)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_frames(spark)
    got = {r["doc_id"]: r for r in T.score(docs, T.fit(docs, labels)).collect()}
    assert len(got) == 904
    held = [r for i, r in got.items() if i is not None and i < 900 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.values() if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == (r["doc_id"] % 6 == 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert got[None]["held_out"] is False
    assert got[902]["predicted"] == 1 and got[902]["passages"] and got[900]["predicted"] == 0
    assert T.score(docs.limit(0), T.fit(docs, labels.limit(0))).count() == 0


def same(a, b):
    return a.knots == b.knots and a.decay == b.decay and all(np.array_equal(x, y) for p, q in ((a.words, b.words), (a.stems, b.stems)) for x, y in zip(p, q, strict=True))


def test_held_out_labels_are_never_learned(spark):
    docs, labels = toxic_frames(spark, 300)
    turned = labels.withColumn("toxic", T.F.when(T.held_out(), 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    assert same(T.fit(docs, labels), T.fit(docs, turned))
    clash = labels.withColumns({"text": T.F.lit("x"), "lang": T.F.lit("en"), "apart": T.F.lit(1), "n": T.F.lit("n"), "token": T.F.lit("t")})
    assert same(T.fit(docs, labels), T.fit(docs, clash))


def found(model, text):
    (words, steps), = T.Scored(model).steps([text])
    return T.heights(model, words, steps)


def test_every_significant_passage_of_a_text_is_found():
    bad = [f"bad{chr(97 + i)}" for i in range(8)]
    model = T.Model.of({w: 3.0 for w in bad}, 0.0, 1.0)
    far = " ".join(f"{w} " + "x " * 40 for w in bad)
    passage = " ".join(bad)
    _, n, spans = found(model, far + passage)
    assert [(a, b) for _, a, b in spans] == [(n - 8, n)]
    _, n, spans = found(model, passage + " x" * 60 + " " + passage)
    assert [(a, b) for _, a, b in spans] == [(0, 8), (n - 8, n)]


def test_scores_do_not_depend_on_what_is_kept(monkeypatch):
    model = T.Model.of({"bad": 4.0, "worse": 4.0, "mild": 0.5, "harmless": -3.0, "*long": 1.0}, 0.0, 1.0)
    rows = ["bad harmless mild worse bad", "longword " + "l" * 500 + " bad", "", "mild longword"] * 3
    scored = T.Scored(model)
    want = [found(model, t) for t in rows]
    assert [T.heights(model, *x) for x in scored.steps(rows)] == want
    assert max(map(len, scored.kept)) <= T.LETTERS
    monkeypatch.setattr(T, "CACHED", 1)
    assert [T.heights(model, *next(iter(scored.steps([t])))) for t in rows] == want


def test_toxicity_against_brute_force(spark):
    """Counts, smoothed odds, segments and the calibration from their definitions, document by document."""
    docs, labels = toxic_frames(spark, 400)
    rows, marks = docs.select("doc_id", "text").collect(), labels.collect()
    model = T.fit(docs, labels)
    toxic = {}
    for i, _, t in marks:
        if i is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            toxic[i] = max(t, toxic.get(i, 0))
    counts: dict = {}
    for i, text in rows:
        if i in toxic:
            ws = set(T._WORD.findall((text or "").lower()))
            for token in ws | {"*" + w[:n] for w in ws for n in T.PREFIXES if len(w) > n}:
                counts.setdefault(token, [0, 0])[toxic[i]] += 1
    counts = {t: c for t, c in counts.items() if sum(c) >= T.LEAST}
    o, t = (sum(c[k] for token, c in counts.items() if token[0] != "*") for k in (0, 1))
    rest = math.log((t + 1) / (o + 1))
    share: dict = {}

    def smoothed(token):
        if token not in share:
            stem = token.lstrip("*")
            parents = ["*" + stem[:n] for n in T.PREFIXES if len(stem) > n and "*" + stem[:n] in counts]
            prior = smoothed(parents[-1]) if parents else 1 / (1 + math.exp(-rest))
            share[token] = (counts[token][1] + T.PRIOR * prior) / (sum(counts[token]) + T.PRIOR)
        return share[token]

    def own(word):
        for token in [word, *("*" + word[:n] for n in reversed(T.PREFIXES) if len(word) > n)]:
            if token in counts:
                p = smoothed(token)
                return math.log(p / (1 - p)) - rest
        return 0.0

    words = [w for w in counts if w[0] != "*"]
    x = np.array([*(own(w) - T.DRIFT for w in words), -T.DRIFT])
    weight = np.array([*(counts[w][0] for w in words), 1.0])
    assert abs((weight / weight.sum() * np.exp(model.decay * x)).sum() - 1) < 1e-6
    got = {r["doc_id"]: r for r in T.score(docs, model).collect()}
    for i, text in rows:
        if i is None or i > 402 or i % 9:
            continue
        ws = T._WORD.findall((text or "").lower())
        steps = [own(w) - T.DRIFT for w in ws]
        log_n = math.log(len(ws) + 1)
        segs = brute_segments(steps)
        sums = []
        for _, a, b in segs:
            once = {w: s for w, s in zip(ws[a:b], steps[a:b], strict=True) if s > 0}
            sums.append(model.decay * (sum(once.values()) + sum(s for s in steps[a:b] if s <= 0)) - log_n)
        height = -log_n if not sums else max(sums) + math.log(sum(math.exp(max(-30.0, h - max(sums))) for h in sums))
        assert math.isclose(got[i]["score"], model.probability(height), abs_tol=1e-9), i
        wide = [(a, b - a) for s, a, b in segs if model.decay * s - log_n >= T.SIGNIFICANT]
        assert [(p["first_word"], p["n_words"]) for p in got[i]["passages"]] == wide


def test_all_counted_words_have_their_own_score(spark):
    docs, labels = toxic_frames(spark, 300)
    model = T.fit(docs, labels)
    assert len(model.words[0]) > 100 and model.score("vilemouth") > 1 and model.score("vileunseen") > 0 and model.score("zzzz") == 0
    assert T.Scored(model).model.scores([]) == {}


# ------------------------------------------------------------------- neighbours
def vectors(spark, d=24, n=700):
    r = np.random.default_rng(2)
    x = r.standard_normal((n, d)).astype("float32")
    x[::3] = x[0] + 0.05 * x[::3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, []), (1040, [0.0] * d), (1060, [float("nan")] + [1.0] * (d - 1)), (1080, [None] + [1.0] * (d - 1)), (1100, [float("inf")] * d)]
    rows += [(None, [1.0] * d), (1120, x[7].tolist()), (1121, x[7].tolist()), (1121, x[7].tolist()), (1140, [1.0, 2.0]), (1141, [2.0, 1.0])]
    return rows, spark.createDataFrame([(*t, 1, "c", 2) for t in rows], "vec_id long, embedding array<float>, rank int, d string, b int")


def test_search(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 128)
    rows, df = vectors(spark)
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    got: dict = {}
    for r in B.search(df, block=128).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in (i for i in good if i % 20 == 0):
        want = sorted(((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:20]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, len(want) + 1))
        assert mine == sorted(mine, key=lambda t: (-t[2], t[1]))
        for _, i, s in mine:
            assert s == float((good[q] * good[i]).sum())
        hit += len({i for _, i in want} & {i for _, i, _ in mine})
        total += len(want)
    assert hit >= 0.99 * total and set(got) == {i for i in good if i % 20 == 0}
    assert B.search(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    x = np.random.default_rng(3).standard_normal((4000, 96))
    middle, error = B.estimates(x[:5], *B.encode(x))
    off = middle - x[:5] @ x.T
    assert abs(off.mean()) < 0.05 * off.std() + 0.05 and (np.abs(off) <= error).mean() > 0.99


def test_few_rows_are_reranked_and_recall_is_kept():
    x = np.random.default_rng(5).standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    best = B.Nearest(np.arange(40), x[:40], 20)
    for lo in range(0, len(x), B.BLOCK):
        ids = np.arange(lo, min(lo + B.BLOCK, len(x)))
        best.add(ids, x[ids], B.encode(x[ids]))
    hit = 0
    for a, (ids, _) in enumerate(best.found):
        exact = x @ x[a]
        exact[a] = -9
        hit += len(set(np.argsort(-exact)[:20].tolist()) & set(ids.tolist()))
    assert hit >= 0.995 * 800 and best.reranked < 0.1 * best.met


# ------------------------------------------------------------------------ pages
SHELL = (
    "<html><head><title>{t}</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>{n}</a><li><a href=/b>More</a></ul></nav>"
    "<div class='cookieNotice'>We use cookies</div><div>Standing line of the site</div><main><article><h1>{t}</h1>{body}<form><label>Mail</label></form></article>"
    "<section class='comments'><article class=comment><p>Nice {n}</p></article></section></main><footer>&copy; {n}</footer><script>x('<p>no</p>')</script>"
)


def pages():
    rows = []
    for i in range(30):
        body = "".join(f"<p><b>{' '.join(prose(i * 50 + k, 12))}<br>tail &amp; {k}&nbsp;x" for k in range(1 + i % 4)) + ("<ul><li>one<li>two</ul>" if i % 5 == 0 else "")
        want = [f"T{i}"] + [f"{' '.join(prose(i * 50 + k, 12))} tail & {k} x" for k in range(1 + i % 4)] + (["one", "two"] if i % 5 == 0 else [])
        rows.append((i, f"https://Site{i % 2}.example.org/{i}", SHELL.format(t=f"T{i}", n=f"n{i}", body=body), "\n".join(want)))
    return rows


def test_extract(spark):
    odd = [(100, "http://x.example.com", None, ""), (101, None, "<p>a<p>b", "a\nb"), (102, "not a url", "", ""), (103, "http://x.example.com", "<" * 5000, "<" * 5000)]
    rows = pages() + odd + pages()[:1]
    df = spark.createDataFrame([(a, b, c, "w", 1) for a, b, c, _ in rows], "page_id long, url string, html string, wrapper string, n_chars int")
    got = H.extract(df).collect()
    assert sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got if r["url"]) == sorted((a, b, t, len(t)) for a, b, _, t in rows if b)
    assert [r["text"] for r in got if r["url"] is None] == ["a\nb"]
    assert H.extract(df.limit(0)).count() == 0


def test_wrapper_has_constants_slots_and_repeats():
    whole = None
    for _, _, page, _ in pages():
        new = H.fold(H.parse(page)[0])
        whole = new if whole is None else H.align(whole, new)
    flat: dict = {}

    def walk(n, path):
        flat[path + n.label] = n
        for k in n.kids:
            walk(k, path + n.label + "/")

    walk(H.Node.of(json.loads(json.dumps(whole.plain()))), "")
    assert flat["/html/body/div/#"].const == "Standing line of the site" and flat["/html/body/main/article/h1/#"].const is None
    assert flat["/html/body/main/article/p"].many and flat["/html/body/main/article/ul"].pages == 6
    long = H.fold(H.parse("<h2>a</h2><p>b</p>" * 300)[0])
    assert [k.label for k in long.kids] == ["h2", "p"] and all(k.many for k in long.kids)


def wrapped(pages):
    whole = None
    for page in pages:
        new = H.fold(H.parse(page)[0])
        whole = new if whole is None else H.align(whole, new)
    return H.Node.of(json.loads(json.dumps(whole.plain())))


def test_long_texts_with_one_lead_are_no_constant():
    lead = " ".join(prose(3, 200))
    rows = [f"<div>Standing line</div><div><h1>T{i}</h1><p>{lead} end {i}</p><p>{lead}</p></div>" for i in range(6)]
    whole = wrapped(rows)
    assert [H.main_text(r, whole) for r in rows] == [f"T{i}\n{lead} end {i}\n{lead}" for i in range(6)]
    # a page that is read by another's template keeps what differs from its constants
    other = "<div>Standing line of today</div><div><h1>T</h1><p>x</p></div>"
    assert H.main_text(other, wrapped(f"<div>Standing line</div><div><h1>T{i}</h1><p>x{i}</p></div>" for i in range(6))) == "Standing line of today\nT\nx"


@pytest.mark.parametrize("page, want", [
    ("<div class=entry-title><h1>Title</h1></div><div class='entry-content'><p>long body</p><p>of it</p></div><div>foot</div>", "Title\nlong body\nof it"),
    ("<main><p>Lead</p><article><p>first part</p></article><article><p>second</p></article></main>", "Lead\nfirst part\nsecond"),
    ("<div class=content>a b</div><div class=advert>no</div><div class=content>c d e</div>", "a b\nc d e"),
    ("<main><article><h1>T</h1><p>the whole body of it</p></article><section><article><h2><a href=x>Other</a></h2><p>read</p></article>"
     "<article><h2><a href=y>Next</a></h2><p>that</p></article></section><article class=comment>Nice</article><p><a href=z>tags</a></main>", "T\nthe whole body of it"),
    ("<main><article><h2><a href=x>One</a></h2><p>text of one</p></article><article><h2><a href=y>Two</a></h2><p>text of the other</p></article></main>",
     "One\ntext of one\nTwo\ntext of the other"),
])
def test_all_regions_of_the_article_are_kept(page, want):
    assert H.main_text(page, None) == want


def test_a_lone_teaser_is_known_by_the_hosts_repeated_group():
    teaser = "<article><h2><a href=x>Other story {}</a></h2><p>its lead {}</p></article>"
    page = lambda i, n: f"<main><article><h1>T{i}</h1><p>{' '.join(prose(40 + i, 30))}</p></article><section>{''.join(teaser.format(i * 10 + k, i) for k in range(n))}</section></main>"
    rows = [page(i, n) for i, n in enumerate((3, 4, 1, 2, 1))]
    whole = wrapped(rows)
    for i, row in enumerate(rows):
        assert H.main_text(row, whole) == f"T{i}\n{' '.join(prose(40 + i, 30))}", i


def test_pages_nest_as_deep_as_they_like(spark):
    deep = "<html><body><div>Standing line</div>" + "<div class=a>" * 50_000 + "<p>text {i}</p>" + "</div>" * 50_000
    rows = [(i, "http://d.example.org/x", deep.replace("{i}", str(i)) if i < 2 else "<html><body><div>Standing line</div><p>other</p>", 1) for i in range(3)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {0: "text 0", 1: "text 1", 2: "Standing line\nother"}
    assert H.main_text("<blockquote>" * 50_000 + "text", None) == "text" and H.main_text("<p>a</div>" * 50_000, None).count("a") == 50_000


def test_thousands_of_unlike_siblings_take_seconds():
    import time

    r = random.Random(4)
    pages = ["".join(f"<div class='{''.join(r.choices('abcdefgh', k=3))}'>t{k}-{i}</div><p>x{k}-{i}</p>" for i in range(6000)) for k in range(3)]
    began = time.perf_counter()
    whole = wrapped(pages)
    assert [H.main_text(p, whole).count("\n") for p in pages] == [11_999] * 3
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize("unit", [1, 2, 5, 9, 30])
def test_repeated_sequences_of_any_length_fold(unit):
    tags = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "dl", "table", "pre", "section", "article", "main", *(f"x-{chr(97 + i)}" for i in range(15))][:unit]
    page = H.fold(H.parse("".join(f"<{t}>a</{t}>" for _ in range(40) for t in tags))[0])
    assert [k.label for k in page.kids] == tags and all(k.many for k in page.kids)


def test_common_labels_rise_on_both_sides():
    r = random.Random(5)
    for _ in range(500):
        one, two = ([r.choice("abcdefgh"[: 2 + _ % 7]) for _ in range(r.randrange(14))] for _ in range(2))
        got = H._common(one, two)
        assert all(one[i] == two[j] for i, j in got)
        assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:]))
        if one == two:
            assert len(got) == len(one)
        if set(one) & set(two):
            assert got


def test_extraction_of_generated_pages_whose_text_is_known():
    """Pages built from a known article among navigation, notices, adverts, comments and a template."""
    r = random.Random(6)
    for host in range(12):
        n, rows = r.randrange(2, 9), []
        line = " ".join(prose(900 + host, 6))
        for i in range(n):
            blocks = [" ".join(prose(r.randrange(10**6), r.randrange(3, 30))) for _ in range(r.randrange(1, 7))]
            tags = [r.choice(["p", "h2", "blockquote", "pre", "div"]) for _ in blocks]
            body = "".join(f"<{t}>{'<b>' + b + '</b>' if r.random() < 0.2 else b}</{t}>" for t, b in zip(tags, blocks, strict=True))
            holder = r.choice(["<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>", "<div id=main>{}</div>"]).format(body)
            around = ["<nav><a href=/>Home</a></nav>", "<div class='sidebar'><p>aside</p></div>", "<div class='ad-banner'>buy</div>", "<form><p>Name</p></form>",
                      "<section class='comments'><p>first!</p></section>", f"<div>{line}</div>", "<script>var a='<p>no</p>'</script>"]
            r.shuffle(around)
            k = r.randrange(len(around))
            rows.append(("".join(around[:k]) + holder + "".join(around[k:]), "\n".join(blocks)))
        whole = wrapped([p for p, _ in rows])
        for page, want in rows:
            assert H.main_text(page, whole) == want


# ---------------------------------------------------------------------- queries
@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op4_binary_codes", "op9_quality_rules", "op11_secret_scan", "op13_hard_negatives"])
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    res = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(cols, res.fetchall())


def test_pipeline_equals_its_stages_by_brute_force(spark):
    from .test_text_operators import brute_links, brute_spans

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    left = docs
    kept = {r["doc_id"] for r in judge(docs).where("kept").select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in left.collect()}
        left = corpus_pipeline.saved(stage(spark, left, SF))
        assert left.columns == docs.columns, name
        after = {r["doc_id"]: r["text"] for r in left.collect()}
        if name == "quality":
            assert set(after) == kept and len(after) > 0.7 * len(rows)
        elif name == "toxicity":
            assert set(after) < set(before) or set(after) == set(before)
        elif name == "near_copies":
            assert set(after) == {i for i, c, _, _ in brute_links(list(before.items())) if i == c}
        else:
            gone = {i: n for i, _, n, _ in brute_spans(list(before.items()), 50)}
            assert {i: len(before[i].encode().split()) - len(after.get(i, "").encode().split()) for i in before} == gone
            assert all(after[i] == before[i] for i in after if not gone[i])
    packed = corpus_pipeline.STAGES[-1][1](spark, left, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in left.collect()}
    whole = corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, whole)) == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed)


def folder(spark, path, rows, labels):
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts; each row's decision is its own."""
    good = [(i, " ".join(prose(5000 + i, 70))) for i in range(500)]
    toxic = lambda i: " ".join(w if k % 6 else "vile" + w for k, w in enumerate(prose(9000 + i, 70)))
    bad = [(1000 + i, toxic(i)) for i in range(150)]
    odd = [(None, toxic(900)), (None, " ".join(prose(7, 60))), (2000, toxic(901)), (2000, " ".join(prose(8, 60))), (2001, None), (2002, ""), (2003, "too short"), (7, good[7][1])]
    path = folder(spark, tmp_path, good + bad + odd, [(i, 1, 0) for i, _ in good] + [(i, 0, 1) for i, _ in bad])
    left, names = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        left = corpus_pipeline.saved(stage(spark, left, path))
        names.append(name)
        if name != "packing":
            assert left.columns == corpus_pipeline.COLUMNS
        rows = [(r["doc_id"], r["text"]) for r in left.select("doc_id", *(["text"] if name != "packing" else [corpus_pipeline.F.lit("").alias("text")])).collect()]
        if name == "quality":
            assert not {2001, 2002, 2003} & {i for i, _ in rows} and sum(i is None for i, _ in rows) == 2
        if name == "toxicity":
            ids = [i for i, _ in rows]
            assert ids.count(None) == 1 and ids.count(2000) == 1 and sum(i is not None and 1000 <= i < 1150 for i in ids) < 10 and sum(i is not None and i < 500 for i in ids) > 480
    assert {i for i, _ in rows} >= {None, 2000} and names == ["quality", "toxicity", "near_copies", "substrings", "packing"]


def test_pipeline_of_an_empty_table_and_without_toxic_labels(spark, tmp_path):
    path = folder(spark, tmp_path / "a", [], [(1, 1, 1)])
    assert corpus_pipeline.run(spark, path).count() == 0
    rows = [(i, " ".join(prose(6000 + i, 70))) for i in range(40)]
    path = folder(spark, tmp_path / "b", rows, [(i, 1, 0) for i, _ in rows])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.toxicity(spark, docs, path).count() == 40
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()} == set(range(40))
