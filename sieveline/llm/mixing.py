"""Temperature mixing of sources to target weights, in DataFrame operations.

A source with share s of the tokens gets a weight in proportion to s**a.  The
exponent a is found by bisection in [0, 1]: the largest with at least the
target entropy, raised if need be until no source is repeated more than the
limit.  Each pass over the source table tries all exponents of LEVELS further
halvings at once, so a few small jobs reach full precision and no source is
collected to the driver.

Weights become token budgets.  A source is passed over as often as its budget
covers it, every time in another order (that of a seeded hash), and the last
time up to what is left: a draw is made if it still fits beside the draws
before it, so a document that doesn't fit keeps no shorter later one out.  A
few rounds find them, each over the rows that may still fit.  A draw's place in
its source's budget decides its block, so each block of the result has every
source at its weight, and a seeded hash decides the order in the block.

The tokens before a draw are summed in two steps, within buckets of the hash
order and over the totals of buckets, so a source may hold any share of the
rows.

A draw carries the hash of its whole row, so rows that share a key, or have
none, are told apart; with the key it gives their place in the order of draws,
so a key that very many rows have is dealt over all buckets.

Defined results: a null source is a source of its own; sources without tokens
have weight 0 and get no draws, but where no row is to be left out every row of
theirs is drawn once; null and empty texts have 0 tokens and are drawn with their
source; repeated rows are drawn each; an empty table gives an empty result;
extra columns are ignored but for that hash.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Workspace, row_hash, unused

LEVELS = 4
HALVINGS = 24
BUCKET_ROWS = 2000
SPAN = 1024  # buckets
BLOCKS = 64
SEED = 17


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def measures(shares: DataFrame, exponents: list[float], budget_share: float | None) -> list[tuple[float, float]]:
    """(entropy, most repeats) of the weights for each exponent.

    ``budget_share``: the budget as a share of all tokens; None for the least
    budget that covers every source once.
    """
    # Exponents are data, so that all calls run the same generated code.
    each = shares.select("share", F.posexplode(F.array(*[F.lit(float(a)) for a in exponents])).alias("i", "a"))
    p, rate = F.pow("share", F.col("a")), F.pow("share", F.col("a") - 1)
    found = each.groupBy("i").agg(F.sum(p).alias("z"), F.sum(p * F.log("share")).alias("e"), F.max(rate).alias("most"), F.min(rate).alias("least")).collect()  # a row an exponent
    of = {r["i"]: r for r in found}
    repeats = lambda r: r["most"] / r["least"] if budget_share is None else r["most"] / r["z"] * budget_share
    return [(math.log(of[i]["z"]) - a * of[i]["e"] / of[i]["z"], repeats(of[i])) for i, a in enumerate(exponents)]


def bisect(shares: DataFrame, holds: Callable[[float, float], bool], budget_share: float | None, upward: bool) -> float:
    """The end of the range of exponents for which ``holds(entropy, repeats)``: the largest if it holds from 0 up, else the least."""
    low, high = 0.0, 1.0
    at_low, at_high = measures(shares, [low, high], budget_share)
    if upward and (holds(*at_high) or not holds(*at_low)):
        return high if holds(*at_high) else low
    if not upward and (holds(*at_low) or not holds(*at_high)):
        return low if holds(*at_low) else high
    for _ in range(HALVINGS // LEVELS):
        n = 1 << LEVELS
        grid = [low + (high - low) * k / n for k in range(n + 1)]
        known = [None, *measures(shares, grid[1:-1], budget_share)]
        a, b = 0, n
        while b - a > 1:
            middle = (a + b) // 2
            if holds(*known[middle]) == upward:
                a = middle
            else:
                b = middle
        low, high = grid[a], grid[b]
    return low if upward else high


def weigh(sources: DataFrame, total: int, budget_share: float | None = 1.0, entropy_share: float | None = None, most_repeats: float | None = None) -> tuple[DataFrame, float]:
    """sources (source, tokens, rows) with share, weight and quota; and the exponent.

    ``entropy_share`` is the target entropy as a share of that of equal
    weights.  Without ``budget_share`` the budget is the least that covers
    every source once, and no row is left out.
    """
    shares = sources.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(total)))
    count = shares.count()
    exponent = 1.0
    if entropy_share is not None:
        target = entropy_share * math.log(max(1, count)) - 1e-9
        exponent = bisect(shares, lambda h, r: h >= target, budget_share, True)
    if most_repeats is not None:
        exponent = max(exponent, bisect(shares, lambda h, r: r <= most_repeats + 1e-9, budget_share, False))
    rate = F.pow("share", F.lit(exponent - 1))
    z, least = shares.agg(F.sum(F.pow("share", F.lit(exponent))), F.min(rate)).first()
    weighed = shares.withColumn("weight", F.pow("share", F.lit(exponent)) / F.lit(z))
    if budget_share is None:
        quota = F.greatest(F.round(F.col("tokens") * rate / F.lit(least)), F.col("tokens"))
    else:
        quota = F.floor(F.round(F.col("weight") * math.floor(total * budget_share), 3))
    weighed = weighed.withColumn("quota", quota.cast("long"))
    if budget_share is None:
        weighed = weighed.unionByName(weightless(sources.where("tokens = 0")))
    return weighed, exponent


def weightless(sources: DataFrame) -> DataFrame:
    return sources.select("*", F.lit(0.0).alias("share"), F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"))


def before(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """rows with ``before``: the tokens of the rows of their group that come first in the order of bucket, h, key and row."""
    earlier = lambda x, part, order: F.coalesce(F.sum(x).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy(*group, "bucket").agg(F.sum("tokens").alias("_sum")).withColumn("_span", F.floor(F.col("bucket") / SPAN))
    # Totals of spans of buckets, then of buckets in a span: no task has all buckets of a source.
    spans = sums.groupBy(*group, "_span").agg(F.sum("_sum").alias("_all")).withColumn("_spans", earlier("_all", group, ["_span"]))
    spans = spans.select(F.col("source").alias("s3"), F.col("pass").alias("p3"), F.col("_span").alias("x3"), "_spans")
    ahead = sums.withColumn("_ahead", earlier("_sum", [*group, "_span"], ["bucket"]))
    ahead = ahead.join(spans, F.col("source").eqNullSafe(F.col("s3")) & (F.col("pass") == F.col("p3")) & (F.col("_span") == F.col("x3")))
    ahead = ahead.select(F.col("source").alias("s2"), F.col("pass").alias("p2"), F.col("bucket").alias("b2"), (F.col("_ahead") + F.col("_spans")).alias("_ahead"))
    same = (F.col("source").eqNullSafe(F.col("s2"))) & (F.col("pass") == F.col("p2")) & (F.col("bucket") == F.col("b2"))
    rows = rows.join(ahead, same).drop("s2", "p2", "b2")
    within = earlier("tokens", [*group, "bucket"], ["h", key, "row"])
    return rows.withColumn("before", F.col("_ahead") + within).drop("_ahead")


def draw(work: Workspace, docs: DataFrame, weighed: DataFrame, key: str = "doc_id", blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """(``key``, source, tokens, row, copies, pass, block, place) of each draw; docs has key, source, tokens, row, copies and alone."""
    passes = F.sequence(F.lit(0), F.greatest(F.ceil(F.try_divide("quota", "all")) - 1, F.lit(0)).cast("int"))
    known = weighed.select(F.col("source").alias("_source"), F.col("tokens").alias("all"), "rows", "quota").where("quota > 0 OR all = 0").withColumn("passes", passes)
    rows = docs.select(key, "source", "tokens", "row", "copies", "alone").join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("pass", F.explode("passes")).drop("passes")
    # Rows that share a key, or have none, are told apart by their hash, so that no bucket holds them all.
    own = [F.lit(seed), F.col("pass"), F.col(key)]
    h = F.when(F.col("alone"), F.xxhash64(*own)).otherwise(F.xxhash64(*own, F.col("row")))
    # The upper 31 bits of the hash, as a share, deal rows out to buckets in hash order.
    share = (F.shiftrightunsigned(h, 33).cast("double")) / F.lit(float(1 << 31))
    rows = rows.withColumn("h", F.shiftrightunsigned(h, 1)).withColumn("bucket", F.floor(share * F.ceil(F.col("rows") / BUCKET_ROWS)).cast("long"))
    waiting = rows.withColumn("taken", F.col("pass") * F.col("all")).drop("rows", "all", "alone")
    group = ["source", "pass"]
    drawn = None
    # What is left only shrinks, so a row that is longer is out for good; of the others, those before the first that doesn't fit are drawn.
    for i in itertools.count():
        tried = before(waiting, group, key).withColumn("start", F.col("taken") + F.col("before")).drop("before")
        tried = work.keep(tried.withColumn("fits", F.col("start") + F.col("tokens") <= F.col("quota")), f"tried-{i}")
        drawn = tried.where("fits") if drawn is None else drawn.unionByName(tried.where("fits"))
        more = tried.groupBy(*group).agg(F.sum(F.when(F.col("fits"), F.col("tokens")).otherwise(0)).alias("_more"), F.bool_and("fits").alias("_all"))
        more = more.where(~F.col("_all")).select(F.col("source").alias("s2"), F.col("pass").alias("p2"), "_more")
        refused = tried.where(~F.col("fits")).join(more, F.col("source").eqNullSafe(F.col("s2")) & (F.col("pass") == F.col("p2")))
        waiting = refused.withColumn("taken", F.col("taken") + F.col("_more")).where("taken + tokens <= quota").drop("s2", "p2", "_more", "start", "fits")
        if waiting.isEmpty():
            break
    block = F.coalesce(F.least(F.floor(F.try_divide(F.col("start") * blocks, "quota")), F.lit(blocks - 1)), F.lit(0)).cast("int")
    return drawn.select(key, "source", "tokens", "row", "copies", "pass", block.alias("block"), F.xxhash64(F.lit(seed + 1), F.col("pass"), F.col(key), F.col("source"), F.col("row")).alias("place"))


def mix(spark: SparkSession, docs: DataFrame, budget_share: float | None = 1.0, entropy_share: float | None = None, most_repeats: float | None = None, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(draws, weights by source); the parameters are those of ``weigh``."""
    work = Workspace(spark, "mixing")
    counted = work.keep(docs.select(F.col(key), F.col(source).alias("source"), count_words(F.col(text)).alias("tokens"), row_hash(docs).alias("row")), "counted")
    # Rows whose key others have too, with how many are equal in all columns: none, in a table whose keys are unique.
    shared = work.keep(counted.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1"), "shared")
    if shared.isEmpty():
        rows = counted.withColumn("copies", F.lit(1).cast("long")).withColumn("alone", F.lit(True))
    else:
        flagged = counted.join(shared, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn("alone", F.col("_n").isNull()).drop("_key", "_n")
        equal = flagged.where("NOT alone").groupBy(F.col(key).alias("_key"), F.col("row").alias("_row")).agg(F.count("*").alias("copies")).where("copies > 1")
        rows = flagged.join(equal, F.col(key).eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_row")), "left").drop("_key", "_row").withColumn("copies", F.coalesce("copies", F.lit(1)))
        rows = work.keep(rows, "rows")
    sources = work.keep(counted.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        weighed = weightless(sources if budget_share is None else sources.limit(0)).withColumn("exponent", F.lit(1.0))
    else:
        found, exponent = weigh(sources, total, budget_share, entropy_share, most_repeats)
        weighed = work.keep(found.withColumn("exponent", F.lit(exponent)), "weights")
    return draw(work, rows, weighed, key), weighed


def drawn_rows(spark: SparkSession, docs: DataFrame, draws: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs, each row as often as it was drawn; draws are those of ``mix`` over the same docs.

    Rows are known by key and hash.  Of k equal rows drawn n times in all, each
    comes n // k times and n % k of them once more.
    """
    work = Workspace(spark, "drawn")
    row, own, known, each, more, turn = unused(docs.columns, "_row", "_key", "_known", "_each", "_more", "_turn")
    hashed = docs.withColumn(row, row_hash(docs))
    drawn = draws.groupBy(F.col(key).alias(own), F.col("row").alias(known)).agg(F.count("*").alias("n"), F.max("copies").alias("k"))
    times = work.keep(drawn.select(own, known, F.floor(F.col("n") / F.col("k")).cast("int").alias(each), (F.col("n") % F.col("k")).cast("int").alias(more)), "times")
    same = F.col(key).eqNullSafe(F.col(own)) & (F.col(row) == F.col(known))
    out = hashed.join(times.where(F.col(each) > 0), same).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(each)))).select(docs.columns)
    rest = times.where(F.col(more) > 0)
    if not rest.isEmpty():
        once = hashed.join(rest, same).dropDuplicates([key, row])
        out = out.unionByName(once.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(more)))).select(docs.columns))
    return out
