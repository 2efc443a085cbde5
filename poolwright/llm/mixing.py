"""Mixing sources to target weights by iterative proportional fitting (native).

Tokens are summed per cell (source, language, topic).  The cells' weights are
raked to each marginal in turn until all hold, and a document is sampled with
the calibrated probability of its cell, so the sample's expected tokens have
the target marginals.  Only the table of cells is iterated on.

Where a cell would need more tokens than it has, either the whole sample
shrinks until none does, or (``fill``) that cell is taken whole and the others
make up for it, so one rare cell does not decide the size of the sample.
"""

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from poolwright.llm.quality import words
from poolwright.llm.stage import materialize

#: Marginals: shares by value (values left out get the mean share of those
#: named), or an exponent that tempers the observed shares.
#: Sweeps after which a gap that hasn't shrunk by a hundredth is taken to stay.
STALLED = 10
#: Names that a dimension must not have.
TAKEN = {"doc_id", "n_tokens", "tokens", "weight", "target", "wish", "v", "x", "probability", "sampled", "_off", "_sum", "_factor"}
TARGETS: dict[str, Mapping[str, float] | float] = {"source": 0.7, "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}, "topic": 0.9}


def shape(text: Column) -> Column:
    """A topic from the form of the text, where a corpus declares none."""
    return (F.when(F.regexp_like(text, F.lit(r"(?i)licen[cs]e|copyright")), "licensed")
            .when(F.regexp_like(text, F.lit(r"\|[^|\n]*\|")), "tabular")
            .when(F.regexp_like(text, F.lit(r"[#*$%&]{3}")), "symbolic")
            .when(F.regexp_like(text, F.lit(r"\d{3}")), "numeric").otherwise("prose"))


def weigh(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", dims: Mapping[str, Column] | None = None) -> DataFrame:
    """doc_id, the dimensions (null: ``und``) and n_tokens (words) per row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    dims = dims or {"source": F.col("source"), "lang": F.col("lang"), "topic": shape(text)}
    return docs.select(F.col(id_col).alias("doc_id"), *(F.coalesce(v.cast("string"), F.lit("und")).alias(k) for k, v in dims.items()), F.size(words(text)).cast("long").alias("n_tokens"))


def shares(cells: DataFrame, dim: str, target: Mapping[str, float] | float) -> DataFrame:
    """dim, target: shares over the observed values, of sum 1."""
    seen = cells.groupBy(dim).agg(F.sum("tokens").alias("x"))
    if isinstance(target, Mapping):
        mean = sum(target.values()) / max(1, len(target))
        wish = F.coalesce(*(F.when(F.col(dim) == k, F.lit(float(v))) for k, v in target.items()), F.lit(mean))
    else:
        wish = F.pow(F.col("x"), F.lit(float(target)))
    seen = seen.withColumn("wish", wish)
    total = seen.agg(F.sum("wish")).first()[0] or 1.0
    return seen.select(dim, (F.col("wish") / total).alias("target"))


def filled(rows: DataFrame, want: str, have: str, total: float) -> float:
    """The scale x at which the sum of least(``have``, x * ``want``) is
    ``total``, or infinity if all of ``have`` is no more than that.

    Newton steps on a concave function from below: each makes at least one more
    row reach its ``have``, or is the last.
    """
    scale, full = 0.0, -1
    while True:
        over = (F.col(want) > 0) & (F.col(want) * F.lit(scale) >= F.col(have))
        r = rows.agg(F.count_if(over), F.sum(F.when(over, F.col(have)).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col(want)))).first()
        if not r[2]:
            return float("inf")
        if r[0] <= full:
            return scale
        scale, full = (total - r[1]) / r[2], r[0]


def goals(cells: DataFrame, dim: str, target: Mapping[str, float] | float, budget: float) -> DataFrame:
    """dim, target: shares of ``budget`` tokens, none above what its value has.

    A value that a mapping leaves out has its observed share; the named ones
    divide the rest.  What a value lacks goes to the others in proportion.
    """
    seen = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("x"))
    if isinstance(target, Mapping):
        named = F.coalesce(*(F.when(F.col(dim) == k, F.lit(float(v))) for k, v in target.items()), F.lit(None).cast("double"))
        seen = seen.withColumn("v", named)
        has, x = seen.agg(F.sum("v"), F.sum(F.when(F.col("v").isNotNull(), F.col("x")))).first()
        seen = seen.withColumn("wish", F.coalesce(F.col("v") * F.lit((x or 0.0) / (has or 1.0)), F.col("x")))
    else:
        seen = seen.withColumn("wish", F.pow(F.col("x"), F.lit(float(target))))
    seen = materialize(seen)
    scale = filled(seen, "wish", "x", budget)
    return seen.select(dim, (F.when(F.col("wish") > 0, F.least(F.col("x"), F.col("wish") * F.lit(scale))).otherwise(0.0) / budget).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | float], *, budget: float | None = None, tolerance: float = 1e-11) -> DataFrame:
    """``cells`` (dimensions, tokens > 0) with ``weight``, of sum 1, whose sums
    per value are the targets to within ``tolerance``.  Where the cells that
    exist do not allow that, sweeps end when the gap no longer shrinks, with a
    warning that tells the gap.  No cells: no rows.

    With a ``budget`` of tokens a cell counts up to the share that it can fill,
    and targets are ``goals``.  Each step reads the cells twice, so it is
    written before the next one.
    """
    wished = {d: materialize(shares(cells, d, t) if budget is None else goals(cells, d, t, budget)) for d, t in targets.items()}
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    cells = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    counted = F.col("weight") if budget is None else F.least(F.col("weight"), F.col("tokens") / F.lit(budget))
    gaps: list[float] = []
    while True:
        cells = cells.withColumn("_off", F.lit(0.0))
        for d, wish in wished.items():
            sums = cells.groupBy(d).agg(F.sum(counted).alias("_sum")).join(wish, d).select(d, F.when(F.col("_sum") > 0, F.col("target") / F.col("_sum")).otherwise(0.0).alias("_factor"))
            cells = materialize(cells.join(sums, d).withColumns({"weight": F.col("weight") * F.col("_factor"), "_off": F.greatest("_off", F.abs(F.col("_factor") - 1))}).drop("_factor"))
        off = cells.agg(F.max("_off")).first()[0] or 0.0
        cells = cells.drop("_off")
        gaps.append(off)
        if off <= tolerance:
            break
        if len(gaps) > STALLED and off > 0.99 * gaps[-1 - STALLED]:
            warnings.warn(f"the cells that exist miss their targets by a factor of up to 1 + {off:.3g}", stacklevel=2)
            break
    return cells


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) for each id: the first 52 bits of an MD5."""
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(1 << 52))


def calibrate(docs: DataFrame, *, targets: Mapping[str, Mapping[str, float] | float] | None = None, id_col: str = "doc_id", text_col: str = "text",
              dims: Mapping[str, Column] | None = None, keep: float = 0.5, seed: str = "mix", fill: bool = False) -> DataFrame:
    """Every row: doc_id, dimensions, n_tokens, probability, sampled.

    No document is taken twice.  Expected tokens are the share ``keep`` of all,
    or less where a cell would need more tokens than it has.  With ``fill`` they
    are ``keep`` of all even then: such a cell is taken whole, values that a
    target leaves out keep their observed share, the marginals are as near as
    that allows.  Without it probabilities are told to nine places, and draws
    use them in full.  Rows without tokens have the probability 0.  Rows with
    one id share their draw.  Other columns of ``docs`` are dropped, whatever
    their names; a dimension called as in ``TAKEN`` is an error.
    """
    targets = targets or TARGETS
    if clash := TAKEN.intersection(targets, dims or ()):
        raise ValueError(f"names that a dimension must not have: {sorted(clash)}")
    rows = materialize(weigh(docs, id_col=id_col, text_col=text_col, dims=dims))
    dims_ = list(targets)
    cells = materialize(rows.where("n_tokens > 0").groupBy(*dims_).agg(F.sum("n_tokens").alias("tokens")))
    if fill:
        budget = keep * float(cells.agg(F.sum("tokens")).first()[0] or 0)
        raked = rake(cells, targets, budget=budget, tolerance=1e-7) if budget else cells.withColumn("weight", F.lit(0.0))
        scale = filled(raked, "weight", "tokens", budget)
        chance = raked.select(*dims_, F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.col("weight") * F.lit(scale) / F.col("tokens"))).otherwise(0.0).alias("probability"))
    else:
        raked = rake(cells, targets)
        bound = raked.agg(F.sum("tokens").alias("all"), F.min(F.col("tokens") / F.col("weight")).alias("most")).first()
        budget = min(keep * float(bound["all"]), float(bound["most"])) if bound["all"] else 0.0
        chance = raked.select(*dims_, F.least(F.lit(1.0), F.col("weight") * budget / F.col("tokens")).alias("probability"))
    out = rows.join(chance, dims_, "left").withColumn("probability", F.when(F.col("n_tokens") > 0, F.col("probability")).otherwise(0.0))
    out = out.withColumn("sampled", draw(F.col("doc_id"), seed) < F.col("probability"))
    return out if fill else out.withColumn("probability", F.round("probability", 9))
