"""URL filters: rules first, then a ratio of two character language models.

A rule fits its host and all subdomains if the path of the url starts with the
rule's; the longest that fits decides.  Other urls are judged by smoothed
variable-order Markov models of accepted and of rejected urls: the probability
of a character after its context of k characters is

    (n(context, character) + WEIGHT * p(character | context of k - 1)) / (n(context) + WEIGHT)

for k up to ``ORDER``, so contexts that were never seen fall back to shorter
ones.  The urls that rules decide are the examples; all of them are counted,
by exact keys in tables that grow with the urls.  The mean log-likelihood difference
a character is compared with a cut calibrated on the examples of one fold,
under models of the other folds: the cut with the least mean error of the two
classes.  The final models count all examples.

Defined results: for a null url, or one without ``://``, host and path are
empty and no rule fits; a null url is scored as the empty text; without
examples of both classes the verdict is ``allow``; ties of rules can't occur
among rules of different text; repeated rows are each judged; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Workspace
from .words import text_buffer

#: The rules of the query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

ORDER = 5
WEIGHT = 2.0
BITS = 9  # hold a symbol
SYMBOLS = 257
PART_BITS = 12  # rows that are scored together, as a power of two
FOLDS = 5
BINS = 400
REACH = 4.0  # scores beyond count as this

#: Said and fold of examples, and the folds that each model counts.
CLASSES = ("allow0", "block0", "allow1", "block1")
MODELS = {"every": (0, 1), "rest": (0,)}


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)"""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({u}, instr({u}, '://') + 3)".format(u="url"))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def with_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """urls (key, url) with host, path, rule and said (the rule's verdict); both are null where no rule fits."""
    host, path = parts(F.col("url"))
    out = urls.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    cases = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        h, _, p = rule.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)
        cases.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("said"))))
    best = F.coalesce(*cases) if cases else F.lit(None).cast("struct<rule:string,said:string>")
    return out.withColumn("_best", best).withColumn("rule", F.col("_best.rule")).withColumn("said", F.col("_best.said")).drop("_best")


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(gram of each character, the first character of each url); an end mark counts as one.

    A gram is the character after its longest context, BITS each: the
    character lowest, then the one before it.  So the pair of order k is the
    lowest k + 1 places, and no two of them share a key.
    """
    raw, at = text_buffer(column)
    n = len(at) - 1
    gap = ORDER + 1
    code = np.zeros(len(raw) + n * gap + ORDER, dtype=np.int64)
    owner = np.repeat(np.arange(n), np.diff(at))
    place = np.arange(len(raw)) + owner * gap + ORDER
    code[place] = raw.astype(np.int64) + 1
    ends = at[1:] + np.arange(n) * gap + ORDER
    code[ends] = SYMBOLS
    every = np.sort(np.concatenate([place, ends]))
    gram = np.zeros(len(every), dtype=np.int64)
    for k in range(ORDER + 1):
        gram |= code[every - k] << (BITS * k)
    return gram, at[:-1] + np.arange(n)


def count(rows: DataFrame) -> DataFrame:
    """(gram, *CLASSES) of rows (url, said, fold): how often each gram is in the examples of each class; 0 if only in other urls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column(1).to_pylist()
            kind = np.array([-1 if s is None else int(s == "block") for s in said], dtype=np.int64)
            kind[kind >= 0] += 2 * batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)[kind >= 0]
            gram, first = grams(batch.column(0))
            key, which = np.unique(gram, return_inverse=True)
            kind = np.repeat(kind, np.diff(np.append(first, len(gram))))
            n = [np.bincount(which[kind == c], minlength=len(key)) for c in range(len(CLASSES))]
            yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, n)], ["gram", *CLASSES])

    counted = rows.select("url", "said", "fold").mapInArrow(run, ", ".join(f"{c} bigint" for c in ("gram", *CLASSES)))
    return counted.groupBy("gram").agg(*[F.sum(c).alias(c) for c in CLASSES])


def differences(counted: DataFrame, totals: dict[str, int]) -> DataFrame:
    """(gram, *MODELS): the log-likelihood difference of each gram's character under each model.

    A row of order k joins the row of order k - 1 that it ends with; at most
    as many rows share one as there are characters, and so with a context.
    """
    classes = {f"{m}_{said}": [f"{said}{f}" for f in folds] for m, folds in MODELS.items() for said in ("allow", "block")}
    sums = [reduce(Column.__add__, [F.col(c) for c in cs]).alias(f"n_{name}") for name, cs in classes.items()]
    named = counted.select("gram", *sums)
    lower = None
    for k in range(ORDER + 1):
        pair = F.col("gram").bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1))
        level = named.groupBy(pair.alias("gram")).agg(*[F.sum(f"n_{name}").alias(f"n_{name}") for name in classes]) if k < ORDER else named
        if k:
            context = Window.partitionBy(F.shiftright("gram", BITS))
            level = level.select("*", *[F.sum(f"n_{name}").over(context).alias(f"all_{name}") for name in classes])
            level = level.withColumn("_lower", F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))).join(lower, "_lower")
        before = lambda name, k=k: F.col(f"p_{name}") if k else F.lit(1 / SYMBOLS)
        all_of = lambda name, k=k: F.col(f"all_{name}") if k else F.lit(sum(totals[c] for c in classes[name]))
        p = {name: (F.col(f"n_{name}") + WEIGHT * before(name)) / (all_of(name) + WEIGHT) for name in classes}
        lower = level.select(F.col("gram").alias("_lower"), *[v.alias(f"p_{name}") for name, v in p.items()])
    return lower.select(F.col("_lower").alias("gram"), *[(F.log(f"p_{m}_allow") - F.log(f"p_{m}_block")).alias(m) for m in MODELS])


def scored(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows (``key``, url, _part) with the mean difference a character under each of MODELS; positive for accepted.

    Each part of the rows asks for each of its grams once, so a gram of all
    urls is asked for once a part.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(1).to_numpy()
            gram, first = grams(batch.column(0))
            owner = np.repeat(part, np.diff(np.append(first, len(gram))))
            for p in np.unique(part):
                own = np.unique(gram[owner == p])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), p)), pa.array(own)], ["_part", "gram"])

    def score(own: pa.Table, known: pa.Table) -> pa.Table:
        gram, first = grams(own.column("url"))
        keys = known.column("gram").to_numpy()
        order = np.argsort(keys)
        at = order[np.searchsorted(keys, gram, sorter=order)]
        sizes = np.diff(np.append(first, len(gram)))
        out = own.select([key, "url"])
        for m in MODELS:
            out = out.append_column(m, pa.array(np.add.reduceat(known.column(m).to_numpy()[at], first) / sizes))
        return out

    asked = rows.select("url", "_part").mapInArrow(ask, "_part bigint, gram bigint").join(found, "gram")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(key, "url").schema)
    return rows.groupBy("_part").cogroup(asked.groupBy("_part")).applyInArrow(score, ", ".join([fields, *[f"{m} double" for m in MODELS]]))


def calibrate(examples: DataFrame, score: str) -> float:
    """The cut of the examples' (said, score) with the least mean error of the two classes."""
    bins = F.least(F.greatest(F.floor((F.col(score) / REACH + 1) * (BINS / 2)), F.lit(0)), F.lit(BINS - 1)).cast("int")
    table = np.zeros((2, BINS))
    for r in examples.groupBy("said", bins.alias("bin")).count().collect():  # BINS rows a class at most
        table[int(r["said"] == "block"), r["bin"]] = r["count"]
    share = table / np.maximum(table.sum(axis=1, keepdims=True), 1)
    wrong = np.concatenate([[0], np.cumsum(share[0])]) + 1 - np.concatenate([[0], np.cumsum(share[1])])  # allow is at or above the cut
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return (float(best.mean()) / (BINS / 2) - 1) * REACH


def judge(pages: DataFrame, key: str = "page_id", rules=RULES) -> DataFrame:
    """(``key``, host, path, rule, verdict, lm_score) of every row of pages (key, url)."""
    work = Workspace(pages.sparkSession, "urls")
    part = F.shiftright(F.monotonically_increasing_id(), PART_BITS)
    rows = work.keep(pages.select(key, "url").withColumn("_part", part), "urls")
    fold = (F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(FOLDS)) == 0).cast("int")  # 1: calibrates
    counted = work.keep(count(with_rules(rows, rules).withColumn("fold", fold)), "grams")
    totals = {c: n or 0 for c, n in counted.agg(*[F.sum(c).alias(c) for c in CLASSES]).first().asDict().items()}
    columns = [key, "host", "path", "rule"]
    if not all(totals[f"{said}0"] + totals[f"{said}1"] for said in ("allow", "block")):
        return with_rules(rows, rules).select(*columns, F.coalesce("said", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("lm_score"))
    out = work.keep(with_rules(scored(rows, differences(counted, totals), key), rules), "scored")
    work.drop("grams")
    work.drop("urls")
    examples = out.where(F.col("said").isNotNull())
    cut = calibrate(examples.where(fold == 1), "rest") if all(totals.values()) else calibrate(examples, "every")
    by_model = F.when(F.col("every") >= cut, "allow").otherwise("block")
    return out.select(*columns, F.coalesce("said", by_model).alias("verdict"), F.col("every").alias("lm_score"))
