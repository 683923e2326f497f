"""Host-level quality rules, in built-in DataFrame functions only.

Every document is measured against base and soft rules. Soft failures are added up by domain, and a
domain's rate is shrunk towards the others by a beta prior that is fitted to the domains themselves
(method of moments over all domains, each with the weight of its documents). A domain whose shrunk rate of any soft rule
passes `host_limit` is strict: none of its documents may fail a soft rule. In an open domain a document
may fail one. A document that fails no rule is kept wherever it is from.

Cases: a null text has no words and fails the base rule; a null domain is a domain of its own; a
repeated row gets the same verdict each time; an empty table gives an empty result; other columns of the
input don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, table, word_array

SYMBOLS = "[#*$%&|<>]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Base rule: fewer words than this, or more than this share (in percent) of words in repeated 3-word windows.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Soft rules by name: the condition of a failure, over the measures of a document.
SOFT_RULES = {
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
    "repeats": "100 * n_repeat_words > 30 * n_words",
}
HOST_LIMIT = 0.5


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(windows: Column) -> Column:
    """How many words the 3-word windows cover whose hash occurs twice or more; windows: hash of the window at each position."""

    def covered(positions: Column) -> Column:
        steps = F.transform(positions, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(positions, j + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(some, let(let(F.sort_array(pairs), repeated), covered)).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """The measures of a text: a struct of longs."""

    def of_words(w: Column) -> Column:
        n = F.size(w)
        windows = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(n - 2, F.lit(0)))
        return F.struct(n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), let(windows, _repeat_words).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    def of(whole: Column) -> Column:
        full = F.filter(F.split(whole, "\n"), lambda x: F.rlike(x, F.lit(NOT_SPACE)))
        return F.struct(let(word_array(whole), of_words).alias("by_word"), let(full, of_lines).alias("by_line"), F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))

    return let(F.coalesce(text, F.lit("")), of)


def flat_measures(df: DataFrame, *keep: str) -> DataFrame:
    """The measures of column m, as columns."""
    names = ("m.by_word.n_words", "m.by_word.word_chars", "m.n_symbols", "m.by_line.n_dup_lines", "m.by_word.n_repeat_words", "m.by_line.n_lines")
    return df.select(*keep, *names)


def failures() -> tuple[Column, Column]:
    """(base_failed, soft) over flat measures; soft is an array of the soft rules' failures, 0 or 1."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return base.alias("base_failed"), F.array(*[F.expr(rule).cast("int") for rule in SOFT_RULES.values()]).alias("soft")


def measured(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, host, measures, base_failed, soft): one row per document."""
    rows = df.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), measures(F.col(text_col)).alias("m"))
    return flat_measures(rows, "id", "host").select("*", *failures())


def host_verdicts(rows: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """(host, host_docs, host_rates, strict) of the documents of `measured`."""
    rules = list(SOFT_RULES)
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_docs"), *[F.sum(F.col("soft")[i]).alias(r) for i, r in enumerate(rules)])
    moments = []
    for r in rules:
        rate = F.col(r) / F.col("host_docs")
        mean = F.sum(r) / F.sum("host_docs")
        square = F.sum(rate * F.col(r)) / F.sum("host_docs")
        moments += [mean.alias(f"{r}_mean"), F.greatest(square - mean * mean, F.lit(0.0)).alias(f"{r}_var")]
    prior = hosts.agg(*moments)
    joined = hosts.crossJoin(F.broadcast(prior))  # the prior is one row
    rates = []
    for r in rules:
        mean, var = F.col(f"{r}_mean"), F.col(f"{r}_var")
        # the strength of the prior in documents: between 1 and 1000, the latter where domains don't differ
        strength = F.when(var > 0, F.least(F.greatest(mean * (1 - mean) / var - 1, F.lit(1.0)), F.lit(1000.0))).otherwise(F.lit(1000.0))
        rates.append(((F.col(r) + mean * strength) / (F.col("host_docs") + strength)).alias(r))
    return joined.select("host", "host_docs", F.struct(*rates).alias("host_rates"), (F.greatest(*rates, F.lit(0.0)) > host_limit).alias("strict"))


def judged(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Documents with their measures, their host's verdict and `kept`."""
    v = verdicts.withColumnRenamed("host", "its_host")
    out = rows.join(v, F.col("host").eqNullSafe(F.col("its_host")), "left").drop("its_host")
    fails = F.aggregate("soft", F.lit(0), lambda a, x: a + x)
    allowed = F.when(F.coalesce("strict", F.lit(False)), F.lit(0)).otherwise(F.lit(1))
    return out.withColumn("kept", ~F.col("base_failed") & (fails <= allowed))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """Verdicts of all documents; the measures are computed once and kept in the shared folder, without texts."""
    scratch = Scratch(df.sparkSession, "quality")
    rows = scratch.keep(measured(df, id_col, text_col, host_col), "measures")
    return judged(rows, host_verdicts(rows, host_limit)).withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of df whose verdict is to keep them, with df's columns.

    Texts are measured once: rows that pass the base rules are written with their measures, as hosts' verdicts need all measures first.
    """
    scratch = Scratch(df.sparkSession, "quality-keep")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    full = df.select(whole, F.col(host_col).cast("string").alias("host"), measures(F.col(text_col)).alias("m"))
    flat = flat_measures(full, "row", "host").select("row", "host", *failures())
    flat = scratch.keep(flat.withColumn("row", F.when(~F.col("base_failed"), F.col("row"))), "measured")
    verdicts = scratch.keep(host_verdicts(flat.select("host", "soft"), host_limit), "hosts")
    return judged(flat, verdicts).filter("kept").select("row.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "host_docs", "strict")
