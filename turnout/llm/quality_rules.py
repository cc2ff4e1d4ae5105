"""Quality rules whose cut-offs follow the data: quantile sketches per language and source.

Fixed rules come first and are never changed by the data. For the adaptive part every
group (lang, source) gets KLL sketches of its measures. They are merged into sketches of
the language and of everything; a group with few documents takes the quantiles of the
next wider one that has enough. A document is rejected where a measure lies beyond an
outer fence: as many spreads from the median as no ordinary document has, the spread
being the distance between outer quantiles, but at least a small step that keeps a
group of identical documents from rejecting its neighbours.

Only built-in functions are used. A text is measured inside its own row, in time
n log n; nothing is exploded. Sketches aggregate partially before their shuffle, so a hot
source costs one small sketch per task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import saved

BLANK = r"[\x20\x09-\x0D]+"
REPEAT = 8  # words of a repeated window
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of words
SKETCH_K = 2048  # rank error about 0.15 %, exact up to that many documents
ENOUGH = 200  # documents a group needs for quantiles of its own

#: measure -> least spread. All grow with badness; each is judged on its upper side only.
STEPS = {"mean_word": 0.2, "symbol_share": 0.02, "dup_line_share": 0.05, "repeat_share": 0.05, "caps_share": 0.005}
#: spreads above the median, and the outer quantile that the spread is measured to
FENCE, OUTER = 4.0, 0.9


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words of a text that stand in a run of REPEAT words which occurs twice or more in it."""

    def windows(hashed: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashed) - (REPEAT - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(hashed, i, F.lit(REPEAT))))

    def twice(ordered: Column) -> Column:
        """Places whose window equals a neighbour in the order of hashes."""
        last = F.size(ordered) - 1
        return F.filter(
            ordered,
            lambda s, i: ((i > 0) & (F.get(ordered, i - 1)["w"] == s["w"])) | ((i < last) & (F.get(ordered, i + 1)["w"] == s["w"])),
        )

    def covered(at: Column) -> Column:
        """Each window covers REPEAT words, less what the next one covers again."""
        own = F.transform(at, lambda p, i: F.least(F.lit(REPEAT), F.coalesce(F.get(at, i + 1) - p, F.lit(REPEAT))))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    def count(win: Column) -> Column:
        numbered = F.array_sort(F.transform(win, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        places = _let(numbered, lambda o: F.array_sort(F.transform(twice(o), lambda s: s["i"])))
        return F.when(F.size(F.array_distinct(win)) < F.size(win), _let(places, covered)).otherwise(0)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= REPEAT, _let(hashed, lambda h: _let(windows(h), count))).otherwise(0)


def measures(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words and n_caps (all long).

    Words are maximal runs of other bytes than 0x20 and 0x09-0x0D; a null text has none.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, BLANK, -1), lambda w: w != "")
    of_words = _let(
        words,
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.aggregate(ws, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
            _repeated(ws).cast("long").alias("n_repeat_words"),
        ),
    )
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return (
        docs.withColumns({"_words": of_words, "_lines": of_lines})
        .withColumns(
            {
                "n_words": F.col("_words.n_words"),
                "word_chars": F.col("_words.word_chars"),
                "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
                "n_dup_lines": (F.col("_lines.n") - F.col("_lines.d")).cast("long"),
                "n_lines": F.col("_lines.n").cast("long"),
                "n_repeat_words": F.col("_words.n_repeat_words"),
                "n_caps": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
            }
        )
        .drop("_words", "_lines")
    )


def _shares(df: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return (
        df.withColumn("mean_word", F.col("word_chars") / words)
        .withColumn("symbol_share", F.col("n_symbols") / chars)
        .withColumn("dup_line_share", F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)))
        .withColumn("repeat_share", F.col("n_repeat_words") / words)
        .withColumn("caps_share", F.col("n_caps") / chars)
    )


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source and the upper fence of each measure, from sketches over all documents that pass the fixed rules.

    The sketches of a group are made once; those of a language and of all documents are
    merged from them. Groups with a null language or source are groups of their own.
    """
    sound = measured.where("not base_failed")
    sketches = sound.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(m, SKETCH_K).alias(m) for m in STEPS))
    by_lang = sketches.groupBy("lang").agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(m, SKETCH_K).alias(m) for m in STEPS))
    overall = by_lang.agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(m, SKETCH_K).alias(m) for m in STEPS))

    def fences(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        cols = []
        for m, least in STEPS.items():
            mid, out = (F.kll_sketch_get_quantile_double(m, F.lit(q)) for q in (0.5, OUTER))
            fence = mid + FENCE * F.greatest(out - mid, F.lit(least))
            cols.append(F.round(fence, 2).alias(f"{name}_{m}"))  # sketches of equal data differ in the last places
        return df.where("n > 0").select(*keys, F.col("n").alias(f"{name}_n"), *cols)

    own = fences(sketches, ["lang", "source"], "own")
    lang = fences(by_lang, ["lang"], "lang").withColumnRenamed("lang", "l")
    whole = fences(overall, [], "all")
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(whole), F.lit(True), "left")  # one row
    pick = [
        F.when(F.col("own_n") >= ENOUGH, F.col(f"own_{m}")).when(F.col("lang_n") >= ENOUGH, F.col(f"lang_{m}")).otherwise(F.col(f"all_{m}")).alias(f"max_{m}")
        for m in STEPS
    ]
    return joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *pick)


def rated(docs: DataFrame) -> DataFrame:
    """`docs` with measures, base_failed (see `judge`) and the shares that the adaptive rules look at."""
    base = measures(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return _shares(base.withColumn("base_failed", failed))


def verdicts(rows: DataFrame) -> DataFrame:
    """`rows` of `rated` with the fences of their group and `kept`."""
    cut = thresholds(rows)
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    fine = F.lit(True)
    for m in STEPS:
        fine = fine & (F.col(m) <= F.coalesce(F.col(f"max_{m}"), F.col(m)))
    return rows.join(cut, same, "left").withColumn("kept", ~F.col("base_failed") & fine).drop("t_lang", "t_source")


def judge(docs: DataFrame) -> DataFrame:
    """All columns of `docs`, the measures, the fences, base_failed and kept.

    base_failed: under MIN_WORDS words, or over MAX_REPEATED per cent of the words in
    windows of REPEAT words that occur twice or more in the text. kept: not base_failed
    and no measure above the fence of the document's (lang, source). A null or empty text
    fails. Repeated rows are judged alike. Columns of `docs` that have a name of ours are
    replaced. An empty table gives an empty result. Documents whose group has no
    threshold (only base_failed ones in it) are not kept anyway.
    """
    return verdicts(saved(rated(docs)))
