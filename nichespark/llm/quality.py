"""Quality rules with adaptive thresholds from mergeable quantile sketches (native)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichespark.runtime import settle

#: What parts words: space and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda over an array of one element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null text: none."""
    bare = F.trim(F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " " * len(BLANKS)))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " +"))


def _covered(marks: Column, width: int) -> Column:
    """Positions that windows of `width` starting at the sorted marks cover."""
    steps = F.zip_with(marks, F.slice(marks, 2, F.greatest(F.size(marks), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(width).cast("long")), F.lit(width).cast("long")))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words stand in windows of `width` words that occur twice or more in the text.

    A window is the hash of its words' hashes (64 bits). Where not all are distinct, hashes are sorted
    together with their places, and neighbours compared.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - (width - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, width)]))

    def pairs_to_marks(sorted_places: Column, win: Column) -> Column:
        # a place is marked if its neighbour on either side has the same window
        same = F.zip_with(
            sorted_places,
            F.slice(sorted_places, 2, F.greatest(F.size(sorted_places), F.lit(1))),
            lambda a, b: F.coalesce(F.get(win, a.cast("int")) == F.get(win, b.cast("int")), F.lit(False)),
        )
        return let(
            same,
            lambda eq: let(
                F.sort_array(F.filter(F.transform(sorted_places, lambda p, i: F.when(F.get(eq, i) | F.coalesce(F.get(eq, i - 1), F.lit(False)), p)), lambda p: p.isNotNull())),
                lambda marks: _covered(marks, width),
            ),
        )

    def counted(win: Column) -> Column:
        places = F.transform(F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i")))), lambda s: s["i"])
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(let(places, lambda p: pairs_to_marks(p, win)))

    return F.when(F.size(words) < width, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(windows(h), counted)))


def measures(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text (null: none) as one struct each."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    packed = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    return {
        "of_words": packed,
        "n_symbols": (F.octet_length(whole) - F.octet_length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


@dataclass(frozen=True)
class Rule:
    """A rate with a fence above its group's upper quantile, and one below its lower quartile if `low`.

    rate is an integer expression, so that all engines agree. The sketch takes `smooth`, which counts
    one more event than there is: a rate that is zero for most of a group still shows there how finely
    texts of their lengths can tell rates apart. A row fails if its rate is more than reach times the
    spread above the `top` percent point. The spread is what lies between the median and that point in
    its group, or what is usual (the median) in the groups of its language, if that is wider, as copies
    may make a group narrow. No constant bounds it.
    """

    rate: str
    smooth: str
    reach: int
    top: int = 75
    low: bool = False


#: Symbols, repeated words and repeated lines in parts per 100,000 words, and hundredths of a character per word. Repeated
#: words stand in few clean texts, but many of them there: their fence lies by a higher quantile.
RULES: dict[str, Rule] = {
    "symbol_rate": Rule("n_symbols * 100000 div n_words", "(n_symbols + 1) * 100000 div n_words", reach=16),
    "repeat_rate": Rule("n_repeat_words * 100000 div n_words", "(n_repeat_words + 1) * 100000 div n_words", reach=16, top=90),
    "dup_line_rate": Rule("n_dup_lines * 100000 div n_words", "(n_dup_lines + 1) * 100000 div n_words", reach=16),
    "word_length": Rule("word_chars * 100 div n_words", "word_chars * 100 div n_words", reach=10, low=True),
}
#: The other quantiles of a sketch that make the fences, in percent.
LOW, MID = 25, 50
#: A sketch of fewer documents is replaced by that of its language, then by that of all.
MIN_DOCS = 100


def sketch_bin(value: Column) -> Column:
    """The bin of a non-negative long: exact below 128, then 64 bins for each doubling (1.6 % wide).

    Equal to the smallest value that falls into the bin.
    """
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rows: DataFrame, rates: list[str], keys: list[str]) -> DataFrame:
    """keys, rule, bin, n: quantile sketches of bounded size that merge by adding n of equal bins."""
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), sketch_bin(F.col(r)).alias("bin")) for r in rates])).alias("b"))
    return long.groupBy(*keys, "b.rule", "b.bin").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rule, q: docs, and the first bins at which a quarter (low), half (mid) and the rule's top percent of the documents are reached."""
    by = Window.partitionBy(*keys, "rule")
    run = sketch.withColumns({"upto": F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "docs": F.sum("n").over(by)})
    top = F.expr("CASE rule " + " ".join(f"WHEN '{k}' THEN {r.top}" for k, r in RULES.items()) + " END")
    at = {"low": F.lit(LOW), "mid": F.lit(MID), "top": top}
    found = run.groupBy(*keys, "rule").agg(F.max("docs").alias("docs"), *[F.min(F.when(F.col("upto") * 100 >= F.col("docs") * q, F.col("bin"))).alias(k) for k, q in at.items()])
    return found.select(*keys, "rule", F.struct("docs", "low", "mid", "top").alias("q"))


def fences(sketch: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """q_lang, q_source, rule, floor (null without one) and ceiling of every group's sketch."""
    sketch = settle(sketch)
    by_lang = sketch.groupBy("q_lang", "rule", "bin").agg(F.sum("n").alias("n"))
    by_all = sketch.groupBy("rule", "bin").agg(F.sum("n").alias("n"))
    a = quantiles(sketch, ["q_lang", "q_source"]).withColumnRenamed("q", "a")
    b = quantiles(by_lang, ["q_lang"]).select(F.col("q_lang").alias("b_lang"), F.col("rule").alias("b_rule"), F.col("q").alias("b"))
    c = quantiles(by_all, []).select(F.col("rule").alias("c_rule"), F.col("q").alias("c"))
    best = a.join(b, F.col("q_lang").eqNullSafe(F.col("b_lang")) & (F.col("rule") == F.col("b_rule"))).join(c, F.col("rule") == F.col("c_rule"))
    wide = a.where(F.col("a.docs") >= min_docs).groupBy(F.col("q_lang").alias("w_lang"), F.col("rule").alias("w_rule"))
    wide = wide.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY a.top - a.mid)").alias("up"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY a.mid - a.low)").alias("down"))
    best = best.join(wide, F.col("q_lang").eqNullSafe(F.col("w_lang")) & (F.col("rule") == F.col("w_rule")), "left")
    best = best.withColumn("q", F.when(F.col("a.docs") >= min_docs, F.col("a")).when(F.col("b.docs") >= min_docs, F.col("b")).otherwise(F.col("c")))
    reach = F.expr("CASE rule " + " ".join(f"WHEN '{k}' THEN {r.reach}" for k, r in RULES.items()) + " END")
    ceiling = F.col("q.top") + reach * F.greatest(F.col("q.top") - F.col("q.mid"), F.col("up").cast("long"))
    floor = F.col("q.low") - reach * F.greatest(F.col("q.mid") - F.col("q.low"), F.col("down").cast("long"))
    return best.select("q_lang", "q_source", "rule", F.when(F.col("rule").isin([k for k, r in RULES.items() if r.low]), floor).alias("floor"), ceiling.alias("ceiling"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: tuple[str, ...] = (), min_words: int = 50, rate_words: int = 50, min_docs: int = MIN_DOCS) -> DataFrame:
    """Measures and verdicts of every row.

    base_failed: fewer than min_words words, or over half of the words in repeated 3-word
    windows. The other rows of rate_words words or more make quantile sketches of four rates per language
    and source (null is a group of its own); sketches are merged by language, and over all, for groups of
    fewer than min_docs rows. Their quantiles give each rate of a group its fences (see Rule), joined
    to the rows; a row outside any fence is not kept. Rows with fewer than rate_words words (if
    min_words lets them through) are held against no fence. Fences follow what is usual in a group, so a
    group whose documents are alike loses none of them.

    Result: id_col, keep columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept. Null and blank texts have no words and fail. Repeated rows are judged
    alike; other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(text_col).alias("q_text"), F.col(id_col).alias("q_id"), F.col(lang_col).cast("string").alias("q_lang"), F.col(source_col).cast("string").alias("q_source"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    rows = rows.withColumns(measures(F.col("q_text"))).drop("q_text").select("*", "of_words.*").drop("of_words")
    failed = (F.col("n_words") < max(1, min_words)) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rows = settle(rows.withColumn("base_failed", failed))
    rated = ~F.col("base_failed") & (F.col("n_words") >= max(1, rate_words))
    sketch = sketches(rows.where(rated).withColumns({k: F.expr(r.smooth).cast("long") for k, r in RULES.items()}), list(RULES), ["q_lang", "q_source"])
    wide = fences(sketch, min_docs).groupBy(F.col("q_lang").alias("f_lang"), F.col("q_source").alias("f_source"))
    wide = wide.agg(*[F.first(F.when(F.col("rule") == k, F.struct("floor", "ceiling")), ignorenulls=True).alias(f"f_{k}") for k in RULES])
    inside = F.lit(True)
    for k, r in RULES.items():
        rate, fence = F.expr(r.rate), F.col(f"f_{k}")
        inside = inside & (rate <= fence["ceiling"])
        if r.low:
            inside = inside & (rate >= fence["floor"])
    judged = rows.join(wide, F.col("q_lang").eqNullSafe(F.col("f_lang")) & F.col("q_source").eqNullSafe(F.col("f_source")), "left")
    kept = ~F.col("base_failed") & F.when(rated, F.coalesce(inside, F.lit(False))).otherwise(F.lit(True))
    return judged.select(F.col("q_id").alias(id_col), *[F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
