"""Secret scans over an incremental ledger of content-addressed blobs (native).

Every version of a file is a row (path, text).  Its blob is the SHA-256 of the
text; equal texts share one.  The ledger holds, per blob, which rule versions
have scanned it and what they found, so a scan reads only blobs with a rule
version they have not met, and findings are joined back to every path.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from poolwright.llm.graph import join_by_key
from poolwright.llm.stage import materialize, sieved


class Rule(NamedTuple):
    """Leftmost non-overlapping matches of ``pattern``; those whose group
    ``group`` has under ``least`` code points are dropped after the match."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


# Base kinds in listed order.  Runs of one character class are
# maximal either way, so their least length can stand in the pattern.
BASE = (
    Rule("assign", 1, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("github", 1, r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + MORE
#: For redaction a private key runs to its END line, or without one over the
#: key's headers and base64 lines that follow, their breaks as written or escaped.
KEY = Rule("pem", 2, MORE[0].pattern + r"(?:(?:[^-]++|-(?!----)){0,400}+-----END [A-Z ]{0,40}PRIVATE KEY-----"
           r"|(?:\s*+(?:Proc-Type|DEK-Info):[^\n]*+){0,4}+(?:(?:(?:\s|\\[rn])*+[A-Za-z0-9+/]{16,}+={0,2}+){1,400}+(?:(?:\s|\\[rn])*+[A-Za-z0-9+/]{1,15}+={1,2}+)?)?)")
REDACTED = tuple(KEY if r.kind == "pem" else r for r in RULES)

SPAN = "array<struct<start:int,end:int>>"
SCANNED = f"array<struct<kind:string,version:int,spans:{SPAN}>>"


def spans(text: Column, rule: Rule) -> Column:
    """Spans [start, end) in code points.  The pieces between matches and the
    matches come from the same left-to-right search, so their lengths place them."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("part"),
    )
    walked = F.aggregate(
        F.filter(found, lambda x: x["size"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["size"]).alias("at"),
            F.when(x["part"] < rule.least, a["spans"]).otherwise(
                F.concat(a["spans"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["size"]).alias("end"))))).alias("spans")),
        lambda a: a["spans"],
    )
    return F.when(F.regexp_like(text, pattern), walked).otherwise(F.array().cast(SPAN))


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(versions: DataFrame, *, text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob, scanned) for the pairs that ``ledger`` lacks.

    A blob that all rule versions have met gives no row; a null text is empty.
    Blobs are compared with the ledger before any text moves; texts of blobs
    that still have something to meet collapse in each map task before their
    shuffle.  Append the rows to the ledger; a blob may have several.
    """
    texts = versions.select(blob_id(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ledger is None:
        return texts.dropDuplicates(["blob"]).select("blob", F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans")) for r in rules)).cast(SCANNED).alias("scanned"))
    met = ledger.select("blob", F.explode("scanned").alias("x")).groupBy("blob").agg(F.collect_set(F.concat_ws(":", "x.kind", "x.version")).alias("met"))
    wanted = F.array(*(F.lit(f"{r.kind}:{r.version}") for r in rules))
    todo = texts.select("blob").distinct().join(met, "blob", "left").select("blob", F.array_except(wanted, F.coalesce("met", F.array().cast("array<string>"))).alias("todo"))
    todo = materialize(todo.where(F.size("todo") > 0))
    blobs = sieved(texts, todo, ["blob"])[1].dropDuplicates(["blob"]).join(todo, "blob")
    pairs = F.array(*(F.when(F.array_contains("todo", f"{r.kind}:{r.version}"), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))) for r in rules)).cast(SCANNED)
    return blobs.select("blob", F.filter(pairs, lambda x: x.isNotNull()).alias("scanned"))


class Ledger:
    """A ledger kept as Parquet in ``path``, on a store that all executors
    share; every ``scan`` appends what it finds, whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """blob, scanned; no rows before the first scan."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"blob string, scanned {SCANNED}")
        return self.spark.read.schema(f"blob string, scanned {SCANNED}").parquet(self.path)

    def scan(self, versions: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is unseen; the ledger rows that came to it."""
        new = materialize(scan(versions, text_col=text_col, ledger=self.rows(), rules=rules))
        new.write.mode("append").parquet(self.path)
        return new


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Blobs with a finding of the current rule versions: blob and ``found``,
    structs (start, kind_no, end, kind) in the order of start, then rule."""
    rows = ledger.where(F.exists("scanned", lambda x: F.size(x["spans"]) > 0)).groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("scanned"))
    number = lambda x: F.coalesce(*(F.when((x["kind"] == r.kind) & (x["version"] == r.version), F.lit(i)) for i, r in enumerate(rules)))
    each = F.transform(F.filter("scanned", lambda x: number(x).isNotNull()), lambda x: F.transform(
        x["spans"], lambda s: F.struct(s["start"].alias("start"), number(x).alias("kind_no"), s["end"].alias("end"), x["kind"].alias("kind"))))
    return rows.select("blob", F.array_distinct(F.sort_array(F.flatten(each))).alias("found")).where(F.size("found") > 0)


FOUND = "array<struct<start:int,kind_no:int,end:int,kind:string>>"


def by_path(versions: DataFrame, found: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Every row of ``versions`` with ``blob`` and ``found`` (empty if none).

    Only texts whose blob may have findings are moved to them; a blob with very
    many paths gets its findings where they are.
    """
    found = materialize(found)
    clean, may = sieved(versions.withColumn("blob", blob_id(F.col(text_col))), found, ["blob"])
    out = clean.withColumn("found", F.lit(None).cast(FOUND)).unionByName(join_by_key(materialize(may), found, "blob"))
    return out.withColumn("found", F.coalesce("found", F.array().cast(FOUND)))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """doc_id with the counts of the base kinds, their digest and all spans.

    With a ledger only what it has not seen is scanned, and it grows by that.
    Repeated rows and ids stay; a null or empty text has no spans.
    """
    if ledger is None:
        found = findings(materialize(scan(docs, text_col=text_col)))
    else:
        ledger.scan(docs, text_col=text_col)
        found = findings(ledger.rows())
    base = F.filter("found", lambda x: x["kind_no"] < len(BASE))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    facts = found.select("blob", *(count(r.kind) for r in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
    paths = join_by_key(materialize(docs.select(F.col(id_col).alias("doc_id"), blob_id(F.col(text_col)).alias("blob"))), materialize(facts), "blob")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return paths.select("doc_id", *(zero(f"n_{r.kind}") for r in BASE), F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """``text`` with each span, or run of overlapping spans, as ``[kind]``."""
    walked = F.aggregate(
        found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(x["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit("["), x["kind"], F.lit("]"))).alias("out")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(found) == 0, text).otherwise(walked)


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All rows of ``docs``, columns as before, secrets in the text redacted,
    private keys with their bodies."""
    found = findings(materialize(scan(docs, text_col=text_col, rules=REDACTED)), REDACTED)
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(text_col).alias("_text"))
    out = by_path(held, found, text_col="_text").withColumn("_text", redacted(F.col("_text"), F.col("found")))
    return out.select(*(F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
