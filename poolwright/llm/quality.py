"""Quality rules whose cutoffs are certified on labelled holdouts (native).

Signals are exact integers.  A rule rejects a document when its signal exceeds
the cutoff of the document's stratum.  A cutoff is usable only if the exact
binomial tail P(Bin(n, alpha) <= k) is at most ``delta / m``, where n is the
number of good holdout documents of the stratum, k of them would be rejected
and m is the number of (stratum, rule) pairs: with probability 1 - ``delta`` no
rule in use rejects more than ``alpha`` of the good documents of any stratum,
and all rules together no more than ``false_rejection``.  Along one rule the
cutoffs go from loose to tight and stop at the first failure (fixed sequence),
so they need no correction of their own.

A stratum with too few good documents for any cutoff to pass, whatever it
rejects, is judged in one pool with the others of its kind; there the bound
holds for the pool.
"""

import math


from pyspark.sql import Column, DataFrame, functions as F

from poolwright.llm.stage import materialize

# The characters that separate words, and the symbol characters.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
NOT_SYMBOLS = r"[^#*$%&|<>]+"

# Rules: signal (per mille, or tenths of a character) and its cutoffs.
GRID = [5, 10, 15, 20, 30, 40, 50, 75, 100, 125, 150, 200, 250, 300, 400, 500, 600, 750]
RULES = {
    "symbols": "n_symbols * 1000 div greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines * 1000 div greatest(n_lines, 1)",
    "repeats": "n_repeat_words * 1000 div greatest(n_words, 1)",
    "word_length": "word_chars * 10 div greatest(n_words, 1)",
}


#: The stratum of those with few good documents.
POOL = "(pooled)"


def words(text: Column) -> Column:
    """Words of a text that is not null; none for a blank text."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def signals(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, stratum and the counts.

    A null text has no words.  A null stratum is the stratum ``und``.  Repeated
    rows and ids stay.  Windows of five words are compared by a 64-bit hash of
    the words; other columns are dropped, whatever their names.
    """
    stratum = F.lit("all") if stratum is None else stratum
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(stratum.cast("string"), F.lit("und")).alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    base = base.select(
        "doc_id", "stratum",
        words(F.col("_t")).alias("_w"),
        F.length(F.regexp_replace("_t", NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_l"),
    )
    base = base.select(
        "doc_id", "stratum", "n_symbols",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= 6, F.transform(F.sequence(F.lit(0), F.size("_w") - 5), lambda i: F.xxhash64(*(F.get(F.col("_w"), i + k) for k in range(5))))).alias("_g"),
    )
    base = base.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda x, j: F.coalesce(F.get(F.col("_s"), j)["h"] == x["h"], F.lit(False))
    base = base.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda x, j: near(x, j - 1) | near(x, j + 1)), lambda x: x["i"])))
    covered = F.aggregate(
        "_p", F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")),
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_g", "_s", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed exactly in log space."""
    first = n * F.log1p(F.lit(-p))
    step = lambda a, i: F.struct(
        (a["lp"] + F.ln((n - i + 1) / i) + F.ln(F.lit(p / (1 - p)))).alias("lp"), a["ls"].alias("ls"))
    add = lambda a: F.struct(a["lp"].alias("lp"), (F.greatest(a["lp"], a["ls"]) + F.log1p(F.exp(-F.abs(a["lp"] - a["ls"])))).alias("ls"))
    more = F.aggregate(
        F.sequence(F.lit(1).cast("long"), k), F.struct(first.alias("lp"), first.alias("ls")),
        lambda a, i: F.element_at(F.transform(F.array(step(a, i)), add), 1), lambda a: a["ls"],
    )
    return F.exp(F.when(k < 1, first).otherwise(more))


def certified_cutoffs(good: DataFrame, *, false_rejection: float, delta: float) -> DataFrame:
    """stratum and ``cutoffs`` (map rule -> tightest certified cutoff).

    ``good`` has the signals of good holdout documents.  A stratum with no
    certified rule is left out; an empty ``good`` gives no rows.
    """
    alpha = false_rejection / len(RULES)
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.expr(v).alias("value")) for k, v in RULES.items())))
    long = good.select("stratum", values.alias("x")).select("stratum", "x.*")
    tally = long.select("stratum", "rule", "value", F.explode(F.array(*map(F.lit, GRID))).alias("cutoff")).groupBy("stratum", "rule", "cutoff").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > F.col("cutoff")).alias("k"))
    tally = materialize(tally)
    m = max(1, tally.select("stratum", "rule").distinct().count())
    passed = tally.where((F.col("k") <= F.lit(alpha) * F.col("n")) & (binomial_tail(F.col("n"), F.col("k"), alpha) <= delta / m))
    return passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff")).groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum: Column | None = None,
          false_rejection: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The signals of every row of ``docs`` with base_failed, kept and the
    rules that rejected it.  Labels: doc_id and quality; a document is good if
    all its labels say 1, null labels count as not good.  ``stratum`` is the one
    by which a row was judged.
    """
    feats = materialize(signals(docs, id_col=id_col, text_col=text_col, stratum=stratum).withColumn("base_failed", base_failed()))
    good = labels.groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).where("q = 1").select("doc_id")
    holdout = materialize(feats.where(~F.col("base_failed")).join(good, "doc_id", "left_semi"))
    sizes = holdout.groupBy("stratum").count()
    alone = materialize(sizes.where(F.col("count") >= math.log(delta / (len(RULES) * max(1, sizes.count()))) / math.log1p(-false_rejection / len(RULES))).select(F.col("stratum").alias("_alone")))
    pooled = lambda rows: rows.join(alone, F.col("stratum") == F.col("_alone"), "left").withColumn("stratum", F.coalesce("_alone", F.lit(POOL))).drop("_alone")
    cutoffs, feats = certified_cutoffs(pooled(holdout), false_rejection=false_rejection, delta=delta), pooled(feats)
    hits = F.filter(F.array(*(F.when(F.expr(v) > F.try_element_at("cutoffs", F.lit(k)), F.lit(k)) for k, v in RULES.items())), lambda x: x.isNotNull())
    out = feats.join(cutoffs, "stratum", "left").withColumn("rejected_by", F.when(F.col("cutoffs").isNull(), F.array().cast("array<string>")).otherwise(hits))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("cutoffs")
