"""Quality rules with adaptive thresholds, DataFrame functions only.

Counts per document give four integer rates (per thousand words or lines).  Each rate has a
mergeable quantile sketch per language and source: a histogram over integer log-linear bins
(exact below 64, then 32 bins per doubling, so quantiles are within about 3 %).  Sketches add
up: a group with fewer than ``MIN_GROUP`` documents uses its language's sum, or that of all.
A document fails a rate beyond the far fence of its group, quartile plus ``FENCE`` times the
quartile distance, plus a slack that covers chance in short texts.  Fixed base rules come first.

Null texts have no words (they fail the base rule); null languages and sources are groups of
their own; repeated rows count each; an empty table gives no rows; columns other than id,
text, language and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.base import stored
from tidemark.llm.words import BLANKS, trimmed, word_array

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SHINGLE = 5
MIN_GROUP = 200
FENCE = 6
#: Rate: numerator, denominator, whether low values fail too, slack, slack times the root of the denominator.
RATES = {
    "word_length": ("word_chars", "n_words", True, 500, 15_000),
    "symbols": ("n_symbols", "n_words", False, 100, 3_000),
    "dup_lines": ("n_dup_lines", "n_lines", False, 100, 3_000),
    "repeats": ("n_repeat_words", "n_words", False, 50, 2_000),
}


def text_counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """Exact counts of each document: id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", "lang", "source", word_array(F.col("text")).alias("words"),
                       F.length(F.translate("text", BLANKS, "")).alias("word_chars"),
                       (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
                       F.filter(F.split("text", "\n"), lambda x: trimmed(x) != "").alias("lines"))
    rows = rows.select("id", "lang", "source", F.size("words").alias("n_words"), "word_chars", "n_symbols", F.size("lines").alias("n_lines"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
                       F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    shingle = ", ".join(f"h[i + {k}]" for k in range(SHINGLE))
    rows = rows.withColumn("g", F.expr(f"IF(n_words >= {SHINGLE}, transform(sequence(0, n_words - {SHINGLE}), i -> xxhash64({shingle})), array())"))
    rows = rows.withColumn("s", F.expr("IF(size(array_distinct(g)) < size(g), array_sort(transform(g, (x, i) -> struct(x AS g, i AS p))), NULL)"))
    rows = rows.withColumn("p", F.expr("array_sort(transform(filter(s, (e, i) -> coalesce(get(s, i - 1).g = e.g, false) OR coalesce(get(s, i + 1).g = e.g, false)), e -> e.p))"))
    covered = F.expr(f"aggregate(p, struct(0 AS n, -{SHINGLE} AS last), (a, x) -> struct(a.n + least({SHINGLE}, x - a.last) AS n, x AS last), a -> a.n)")
    return rows.select("id", "lang", "source", *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")],
                       F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def rate(name: str) -> Column:
    top, bottom, *_ = RATES[name]
    return F.expr(f"CASE WHEN {bottom} > 0 THEN {top} * 1000 DIV {bottom} END")


def bin_of(value: Column) -> Column:
    """Log-linear bin: the value itself below 64, then its six leading bits with their place."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return shift.cast("long") * 32 + F.call_function("shiftrightunsigned", value, shift)


def bin_value(bin_: Column) -> Column:
    """Smallest value of a bin."""
    shift = F.greatest(F.floor(bin_ / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", bin_ - shift.cast("long") * 32, shift)


def sketches(counts: DataFrame) -> DataFrame:
    """Rows of lang, source, rate, bin and count: sketches merge by adding counts."""
    return (counts.select("lang", "source", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in RATES]), F.array(*[rate(k) for k in RATES]))).alias("rate", "value"))
            .where("value IS NOT NULL").groupBy("lang", "source", "rate", bin_of(F.col("value")).alias("bin")).agg(F.count(F.lit(1)).alias("m")))


def quartiles(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Quartiles and size of each group of sketches, merged over ``keys``."""
    merged = bins.groupBy(*keys, "rate", "bin").agg(F.sum("m").alias("m"))
    part = Window.partitionBy(*keys, "rate")
    upto = merged.withColumns({"upto": F.sum("m").over(part.orderBy("bin")), "n": F.sum("m").over(part)})
    at = {f"q{q}": F.min(F.when(F.col("upto") * 100 >= F.col("n") * q, bin_value(F.col("bin")))) for q in (25, 75)}
    return upto.groupBy(*keys, "rate").agg(F.max("n").alias("n"), *[v.alias(k) for k, v in at.items()])


def limits(bins: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per language and source with the fences of every rate."""
    own, by_lang, all_ = quartiles(bins, ["lang", "source"]), quartiles(bins, ["lang"]), quartiles(bins, [])
    renamed = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])                                    # noqa: E731
    lang, every = renamed(by_lang, "l"), renamed(all_, "a")
    joined = (own.join(lang, own["lang"].eqNullSafe(lang["l_lang"]) & (own["rate"] == lang["l_rate"]), "left")
              .join(every, own["rate"] == every["a_rate"], "left"))
    pick = lambda c: F.when(F.col("n") >= min_group, F.col(c)).when(F.col("l_n") >= min_group, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))     # noqa: E731
    fences = joined.select("lang", "source", "rate", (pick("q75") + FENCE * (pick("q75") - pick("q25"))).alias("high"), (pick("q25") - FENCE * (pick("q75") - pick("q25"))).alias("low"))
    of = lambda k, c: F.max(F.when(F.col("rate") == k, F.col(c))).alias(f"{k}_{c}")                                        # noqa: E731
    return fences.groupBy("lang", "source").agg(*[of(k, c) for k in RATES for c in ("high", "low")])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """Per document: id, the counts, base_failed, kept."""
    counts = stored(text_counts(docs, id_col, text_col, lang_col, source_col), "counts")
    fences = stored(limits(sketches(counts), min_group), "limits").withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    rows = counts.join(fences, counts["lang"].eqNullSafe(fences["f_lang"]) & counts["source"].eqNullSafe(fences["f_source"]), "left")
    failed = F.lit(False)
    for name, (_, bottom, both, slack, chance) in RATES.items():
        room = slack + F.floor(F.lit(float(chance)) / F.sqrt(F.greatest(F.col(bottom), F.lit(1)).cast("double")))
        failed = failed | F.coalesce(rate(name) > F.col(f"{name}_high") + room, F.lit(False))
        if both:
            failed = failed | F.coalesce(rate(name) < F.col(f"{name}_low") - room, F.lit(False))
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return rows.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       base.alias("base_failed"), (~base & ~failed).alias("kept"))
