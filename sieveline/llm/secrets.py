"""Incremental secret scans over content-addressed blobs, in DataFrame operations only.

Every version of every path is addressed by the SHA-256 of its text.  A ledger
holds one row for each (blob, rule, version) that was scanned, with the spans
found, also where there are none.  A run scans only the pairs the ledger lacks,
each blob once however many paths have it, and joins the findings back to all
paths.

Defined results: a null text is the empty text; empty texts have no spans;
repeated rows stay repeated; an empty table gives an empty result; columns
other than the key and the text are ignored, whatever their names.  Spans are
in code points, the end exclusive.  Matches are leftmost and do not overlap
within a rule; a match that is too short is dropped after matching.  Text and
findings are never gathered per path, so any number of paths may share a blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace, unused

#: Spark's split needs a text in the result for each match: no rule may match the empty text.


@dataclass(frozen=True)
class Rule:
    """A pattern; ``group`` of each match must have ``least`` characters.  A changed rule gets another version.

    ``strict`` matches somewhere in a text wherever a match is long enough.  For
    group 0 its matches are those of ``pattern`` that are long enough.
    """

    kind: str
    pattern: str
    group: int
    least: int
    strict: str
    version: int = 1


#: The patterns and lengths of the base rules.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
)

LEDGER = T.StructType(
    [
        T.StructField("blob", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
    ]
)


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """blobs with ``due``: the kinds of the rules whose present version the ledger lacks; blobs with none go."""
    every = F.array(*[F.lit(r.kind) for r in rules])
    if ledger is None:
        return blobs.withColumn("due", every)
    now = F.lit(False)
    for r in rules:
        now = now | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    done = ledger.where(now).groupBy("blob").agg(F.collect_set("kind").alias("done"))
    due = F.array_except(every, F.coalesce(F.col("done"), F.array().cast("array<string>")))
    return blobs.join(done, "blob", "left").withColumn("due", due).where(F.size("due") > 0).drop("done")


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Ledger rows of (blob, text, due): one for each due rule."""
    cases = []
    for r in rules:
        due = F.array_contains("due", r.kind) & F.col("text").rlike(r.strict)
        each = r.pattern if r.group else r.strict
        found = F.struct(
            F.lit(r.kind).alias("kind"),
            F.transform(F.regexp_extract_all("text", F.lit(each), F.lit(0)), F.length).alias("whole"),
            F.transform(F.regexp_extract_all("text", F.lit(each), F.lit(r.group)), F.length).alias("judged"),
            F.transform(F.split("text", each, -1), F.length).alias("between"),
        )
        cases.append(F.when(due, found))
    hits = (
        blobs.select("blob", F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("m"))
        .select("blob", "m.kind", F.posexplode(F.arrays_zip(F.col("m.whole").alias("whole"), F.col("m.judged").alias("judged"), F.slice("m.between", 1, F.size("m.whole")).alias("between"))).alias("i", "z"))
        .select("blob", "kind", "i", "z.*")
    )
    # Where a match ends: what lies between matches and the matches themselves, summed up to it.
    stop = F.sum(F.col("between") + F.col("whole")).over(_in_order())
    least = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.least))])
    spans = (
        hits.withColumn("stop", stop)
        .where(F.col("judged") >= least[F.col("kind")])
        .groupBy("blob", "kind")
        .agg(F.array_sort(F.collect_list(F.struct((F.col("stop") - F.col("whole")).cast("long").alias("start"), F.col("stop").cast("long").alias("stop")))).alias("spans"))
    )
    version = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    return (
        blobs.select("blob", F.explode("due").alias("kind"))
        .join(spans, ["blob", "kind"], "left")
        .select("blob", "kind", version[F.col("kind")].alias("version"), F.coalesce("spans", F.array().cast(LEDGER["spans"].dataType)).alias("spans"))
    )


def _in_order():
    from pyspark.sql import Window

    return Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)


def scan_increment(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE_RULES, text: str = "text") -> DataFrame:
    """The ledger rows of the pairs that ``ledger`` lacks.

    With a ledger, addresses alone ask it first, and only texts of blobs that
    are due are shuffled, or none where few are due.
    """
    versions = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    if ledger is None:
        return scan(unseen(versions.dropDuplicates(["blob"]).select("blob", "text"), None, rules), rules)
    due = unseen(versions.select("blob").distinct(), ledger, rules)
    return scan(versions.join(due, "blob").dropDuplicates(["blob"]).select("blob", "text", "due"), rules)


def blob_spans(ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """(blob, spans) of blobs with findings of the rules' present versions; spans by start, then kind as listed."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    now = F.lit(False)
    for r in rules:
        now = now | ((F.col("kind") == r.kind) & (F.col("version") == r.version))

    def entry(s):
        return F.struct(s["start"].alias("start"), rank[F.col("kind")].alias("rank"), F.col("kind").alias("kind"), s["stop"].alias("stop"))

    return ledger.where(now & (F.size("spans") > 0)).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(F.transform("spans", entry)))).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per path: ``key``, blob, and ``spans``, array<struct<start,rank,kind,stop>>."""
    found = blob_spans(ledger, rules)
    return docs.select(key, address(F.col(text)).alias("blob")).join(found, "blob", "left").select(key, "blob", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))


def scan_all(spark: SparkSession, docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE_RULES, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings of every path, the ledger with this run's rows, written to the shared folder)."""
    new = Workspace(spark, "ledger").keep(scan_increment(docs, ledger, rules, text), "blobs")
    whole = new if ledger is None else ledger.select(new.columns).unionByName(new)
    return findings(docs, whole, rules, key, text), whole


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def digest(found: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, key: str = "doc_id") -> DataFrame:
    """One row of counts, joined spans and their SHA-256 for each path."""
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    return found.select(
        key,
        *[F.size(F.filter("spans", _of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in rules],
        F.sha2(joined, 256).alias("base_sha256"),
        joined.alias("spans"),
    )


def redact(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, mask: str = "[secret]", text: str = "text") -> DataFrame:
    """docs with every span of secrets in ``text`` replaced by ``mask``; overlapping spans become one."""
    value, address_of, blob, spans = unused(docs.columns, "_value", "_address", "_blob", "_spans")
    hit = blob_spans(ledger, rules).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    state = "struct<out:array<string>,upto:bigint>"
    whole = F.col(value)

    def step(s, x):
        before = F.substring(whole, (s["upto"] + 1).cast("int"), (x["start"] - s["upto"]).cast("int"))
        grown = F.when(x["start"] >= s["upto"], F.array(before, F.lit(mask))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(s["out"], grown).alias("out"), F.greatest(s["upto"], x["stop"]).alias("upto"))

    none = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("upto")).cast(state)
    folded = F.aggregate(spans, none, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(whole, (s["upto"] + 1).cast("int"), F.length(whole))))
    joined = docs.withColumn(value, F.col(text)).withColumn(address_of, address(F.col(text))).join(hit, F.col(address_of) == F.col(blob), "left")
    return joined.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(folded)).select(docs.columns)
