"""Exact Jaccard join of sets of word shingles, with components of the links.

Two texts link if their sets of distinct five-word shingles have 100 * |A & B|
>= 75 * |A | B|.  The result is the class (component) of each text; links are
found until every component is whole, not all written out.

1. Sets.  Each batch of texts becomes sets of 64-bit shingle hashes and a
   128-bit digest of each set.  Equal sets are one set from here on; those
   that may link get a number, which stands for them in all that follows.
2. Frequencies.  A batch asks for each of its distinct shingles, once with the
   number of its sets that have it, in how many sets the shingle occurs at all.
   Parts of the hash range answer; shingles of one set only are dropped from
   the answer, as no other set shares them.  A set that keeps less than 75 % of
   its shingles links with nothing and is done.  Of more than 1 << FAN parts
   each batch addresses the upper FAN bits only: routers, one for each of these
   and each group of batches, sum up what their batches ask, ask the parts and
   send the answers back.  So no message is a shingle or few, and a shingle
   that every batch has is asked once a router.
3. Index.  The shingles of a set stand in the order (frequency, hash), rarest
   first.  Linked sets share a shingle within their first n - ceil(0.75 n) + 1,
   so only those are posted, with their position, in lists that are cut into
   blocks by set size: sizes of linked sets lie in the same block or in
   neighbours, so all other blocks of a list are skipped, and the position
   bounds the overlap that is still possible, and with it the blocks further.
   A list of more than LONG sets is dealt to sublists of about that many; what
   is known of a list is sent to each of them, so no task has a long list.
4. Answers.  In each round every list offers its members against one of them,
   the head; pairs of one component are never offered again, and a list whose
   sets are all of one component is left out for good.  When rounds link
   little more, the pairs across components that remain are verified, except
   those that a similar set's answers settle: if a is linked to a head h with
   known overlap, then |a & b| <= |h & b| + |a - h|, and the pair is skipped if
   that is too little.

Everything is exact but for hash collisions.  Frequencies only order the
shingles; any order gives the same result.  A list is never gathered in one
task, no list, link or component is collected to the driver.

Defined results: texts without words (null, empty, blank) have the empty set,
n_shingles 0, and are linked with nothing: the component is their own key.
Repeated rows and equal texts share a component.  Rows with a null key get
their component's least key, or null if there is none.  Rows that share a key
but not a text are rows of their own, each with the component of its text.
``one_of_each`` keeps one row of each component: that with the least key (null
last), of several the one with the least hash of the whole row; rows without
words all stay.  An empty table gives an empty result; extra columns are
ignored by ``link`` and come with the rows of ``one_of_each``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.spread import spread
from .language import pieces_of
from .shared import Workspace, give_back, row_hash, steady, total_bytes, trimmed, unused
from .words import mix, shingles, word_hashes

PERCENT = 75
#: Sizes of sets in a block of a list differ by this factor at most.
BLOCK = 1.08
#: Bytes of text whose shingles one task handles at once, and that one part of the hash range answers for.
TOGETHER = 4 << 20
PART_BYTES = 4 << 20
#: A batch addresses 1 << FAN parts at most, and so does a router: enough for 1 << 2 * FAN parts.
FAN = 13
#: Rounds of offers against heads before the pairs that remain are verified.
MOST_ROUNDS = 3
#: Rounds end when one adds less than this part of all links.
ENOUGH = 50
#: Sets in a list, or in a sublist of a longer one.
LONG = 1024
REPEATED = 0xFFFFFFFF
ASK, SETS, SHARED, HELD = 0, 1, 2, 3
_U = np.uint64

MESSAGE = "part int, batch bigint, kind int, n binary, a binary, b binary, c binary"


def least_overlap(n: np.ndarray) -> np.ndarray:
    """ceil(0.75 n): the least overlap of a set of n shingles with any set that links to it."""
    return -(-PERCENT * n // 100)


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _planes(x: np.ndarray) -> bytes:
    """How many integers, and these byte by byte, the least first: bytes that have few values stand together and are coded by their entropy, which shuffles' LZ4 doesn't do."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(x.astype(x.dtype.newbyteorder("<")).view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _of_planes(b: bytes | None, dtype: str) -> np.ndarray:
    if not b:
        return np.empty(0, dtype="<" + dtype)
    size = np.dtype(dtype).itemsize
    planes = pa.decompress(memoryview(b)[8:], decompressed_size=size * int.from_bytes(b[:8], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(size, -1).T).view("<" + dtype).reshape(-1)


def _gaps(tokens: np.ndarray) -> bytes:
    """Ascending shingles by their differences."""
    return _planes(np.diff(tokens, prepend=_U(0)))


def _of_gaps(b: bytes | None) -> np.ndarray:
    return np.cumsum(_of_planes(b, "u8"), dtype=np.uint64)


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(tokens).sum(dtype=np.uint64)), int(mix(tokens ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64))


def ask(docs: DataFrame, bits: int, carried: list[str], text: str) -> DataFrame:
    """Messages of each batch: ASK to each part it has shingles for, SETS and SHARED (who has the shingles that several of its sets have) to itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # The batch's number is that of the task and of the batch within it, so a task that runs again sends the same.
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for part in pieces_of(whole, 0, TOGETHER):
                number += 1
                keys = pa.RecordBatch.from_arrays(part.columns[1:], carried)
                words, at = word_hashes(part.column(0))
                own: dict[tuple[int, int, int], int] = {}
                of_row = np.empty(part.num_rows, dtype=np.uint32)
                sets: list[np.ndarray] = []
                for i in range(part.num_rows):
                    tokens = shingles(words[at[i] : at[i + 1]])
                    name = (len(tokens), *_digest(tokens))
                    if name not in own:
                        own[name] = len(sets)
                        sets.append(tokens)
                    of_row[i] = own[name]
                names = np.array(list(own), dtype=object)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                tokens = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
                owner = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
                order = np.argsort(tokens, kind="stable")
                tokens, owner = tokens[order], owner[order]
                fresh = np.ones(len(tokens), dtype=bool)
                fresh[1:] = tokens[1:] != tokens[:-1]
                heads = np.flatnonzero(fresh)
                counts = np.diff(np.append(heads, len(tokens))).astype(np.uint32)
                distinct = tokens[heads]
                who = np.where(counts == 1, owner[heads], np.uint32(REPEATED))
                parts = distinct >> _U(64 - bits)  # ascending
                edges = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else np.empty(0, dtype=np.int64)
                rows = []
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(distinct)]):
                    rows.append((int(parts[a]), number, ASK, None, _gaps(distinct[a:b]), _planes(counts[a:b]), _planes(who[a:b])))
                home = number % (1 << bits)
                many = np.repeat(counts > 1, counts)
                rows.append((home, number, SHARED, None, _gaps(distinct[counts > 1]), _planes(counts[counts > 1]), _planes(owner[many])))
                names = np.array([[x for x in name] for name in names], dtype=np.uint64).reshape(-1, 3)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, keys.schema) as w:
                    w.write_batch(keys)
                rows.append((home, number, SETS, _bytes(names), sink.getvalue().to_pybytes(), _bytes(of_row), None))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                for a in range(0, len(rows), 64):
                    chunk = rows[a : a + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in chunk], kind) for k, kind in enumerate(kinds)], ["part", "batch", "kind", "n", "a", "b", "c"])

    return steady(spread(docs.select(text, *carried))).mapInArrow(trimmed(run), MESSAGE)


def gather(messages: DataFrame, bits: int) -> DataFrame:
    """Messages to the upper FAN bits become those of routers: ASK to each part, once for each shingle, and HELD (who asked) to the router itself; other messages pass."""
    spare = bits - FAN

    def run(table: pa.Table) -> pa.Table:
        out = gathered(table)
        give_back()
        return out

    def gathered(table: pa.Table) -> pa.Table:
        home = table.column("part")[0].as_py() << spare | table.column("salt")[0].as_py()
        router = -1 - home  # batches have numbers from 0
        table = table.drop_columns("salt").set_column(0, "part", pa.array(np.full(table.num_rows, home, dtype=np.int32)))
        asked = pa.compute.equal(table.column("kind"), ASK)
        rest = table.filter(pa.compute.invert(asked))
        table = table.filter(asked)
        if not table.num_rows:
            return rest
        tokens = [_of_gaps(b) for b in table.column("a").to_pylist()]
        batch = np.repeat(table.column("batch").to_numpy(), [len(t) for t in tokens])
        counts, who = (np.concatenate([_of_planes(b, "u4") for b in table.column(c).to_pylist()]) for c in ("b", "c"))
        tokens = np.concatenate(tokens)
        order = np.argsort(tokens, kind="stable")
        tokens = tokens[order]
        heads = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        total = np.minimum(np.add.reduceat(counts[order].astype(np.uint64), heads), REPEATED).astype(np.uint32)
        distinct = tokens[heads]
        parts = distinct >> _U(64 - bits)  # ascending
        edges = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])).tolist()
        rows = [(int(parts[a]), router, ASK, None, _gaps(distinct[a:b]), _planes(total[a:b]), None) for a, b in zip(edges, [*edges[1:], len(distinct)])]
        rows.append((home, router, HELD, _planes(batch[order]), _gaps(tokens), None, _planes(who[order])))
        return pa.concat_tables([pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(rest.schema.types)], rest.schema.names), rest])

    salt = F.pmod(F.xxhash64("batch"), F.lit(1 << spare)).cast("int")
    return messages.withColumn("salt", salt).groupBy("part", "salt").applyInArrow(run, MESSAGE)


def scatter(answers: DataFrame) -> DataFrame:
    """What routers were answered, as a message to each batch that asked; other messages pass."""

    def run(table: pa.Table) -> pa.Table:
        out = scattered(table)
        give_back()
        return out

    def scattered(table: pa.Table) -> pa.Table:
        held = table.filter(pa.compute.equal(table.column("kind"), HELD)).to_pylist()
        if not held:
            return table
        known = table.filter(pa.compute.equal(table.column("kind"), ASK))
        found = np.concatenate([_of_gaps(b) for b in known.column("a").to_pylist()])
        rate = np.concatenate([_of_planes(b, "u4") for b in known.column("b").to_pylist()])
        order = np.argsort(found)
        found, rate = found[order], rate[order]
        tokens, batch, who = _of_gaps(held[0]["a"]), _of_planes(held[0]["n"], "i8"), _of_planes(held[0]["c"], "u4")
        at = np.searchsorted(found, tokens)
        at[at == len(found)] = 0
        kept = found[at] == tokens if len(found) else np.zeros(len(tokens), dtype=bool)
        tokens, rate, batch, who = tokens[kept], rate[at[kept]], batch[kept], who[kept]
        order = np.argsort(batch, kind="stable")  # shingles stay in order
        tokens, rate, batch, who = tokens[order], rate[order], batch[order], who[order]
        edges = np.flatnonzero(np.append(True, batch[1:] != batch[:-1])).tolist() if len(batch) else []
        rows = [(0, int(batch[a]), ASK, None, _gaps(tokens[a:b]), _planes(rate[a:b]), _planes(who[a:b])) for a, b in zip(edges, [*edges[1:], len(batch)])]
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(table.schema.types)], table.schema.names)

    return answers.groupBy("batch").applyInArrow(run, MESSAGE)


def answer(messages: DataFrame) -> DataFrame:
    """In each part: ASK becomes the shingles found in several sets with their frequency; other messages pass."""

    def run(table: pa.Table) -> pa.Table:
        out = answered(table)
        give_back()
        return out

    def answered(table: pa.Table) -> pa.Table:
        asked = pa.compute.equal(table.column("kind"), ASK)
        rest = table.filter(pa.compute.invert(asked))
        table = table.filter(asked)
        tokens = [_of_gaps(b) for b in table.column("a").to_pylist()]
        counts, who = ([_of_planes(b, "u4") for b in table.column(c).to_pylist()] for c in ("b", "c"))
        if not tokens:
            return rest
        every, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate(counts), minlength=len(every))
        at, out_a, out_b, out_c = 0, [], [], []
        for t, w in zip(tokens, who):
            f = total[inverse[at : at + len(t)]]
            at += len(t)
            keep = f > 1
            out_a.append(_gaps(t[keep]))
            out_b.append(_planes(np.minimum(f[keep], REPEATED).astype(np.uint32)))
            out_c.append(_planes(w[keep] if len(w) else w))  # a router holds itself who asked
        table = table.set_column(4, "a", pa.array(out_a, pa.binary())).set_column(5, "b", pa.array(out_b, pa.binary())).set_column(6, "c", pa.array(out_c, pa.binary()))
        return pa.concat_tables([table, rest.cast(table.schema)])

    return messages.groupBy("part").applyInArrow(run, MESSAGE)


def answers_to(docs: DataFrame, bits: int, carried: list[str], text: str, work: Workspace) -> DataFrame:
    """Messages to each batch: its SETS and SHARED, and its ASK answered; by way of routers where there are more than 1 << FAN parts.

    Answers are written before they are dealt, so what was asked, which is far more, goes first.
    """
    if bits <= FAN:
        return work.keep(answer(ask(docs, bits, carried, text)), "answers")
    return scatter(work.keep(answer(gather(ask(docs, FAN, carried, text), min(bits, 2 * FAN))), "answers"))


def assemble(answers: DataFrame, carried: list[str], fields: str) -> DataFrame:
    """Per row: what is carried, n, sid (16 bytes; null for the empty set), and for one row of each set that may link, its shared shingles in order and how many are posted."""

    def run(table: pa.Table) -> pa.Table:
        out = assembled(table)
        give_back()
        return out

    def assembled(table: pa.Table) -> pa.Table:
        messages = list(zip(*[table.column(c).to_pylist() for c in ("kind", "n", "a", "b", "c")]))
        _, names, keys, of_row, _ = next(m for m in messages if m[0] == SETS)
        names, of_row = np.frombuffer(names, dtype=np.uint64).reshape(-1, 3), np.frombuffer(of_row, dtype=np.uint32)
        with pa.ipc.open_stream(keys) as stream:
            keys = stream.read_all()
        asked = [m for m in messages if m[0] == ASK]
        tokens = np.concatenate([_of_gaps(m[2]) for m in asked] or [np.empty(0, dtype=np.uint64)])
        freq, who = (np.concatenate([_of_planes(m[k], "u4") for m in asked] or [np.empty(0, dtype=np.uint32)]) for k in (3, 4))
        repeated = next(m for m in messages if m[0] == SHARED)
        shared, counts, members = _of_gaps(repeated[2]), _of_planes(repeated[3], "u4"), _of_planes(repeated[4], "u4")
        alone = who != REPEATED
        order = np.argsort(tokens[~alone])
        many_tokens, many_freq = tokens[~alone][order], freq[~alone][order]  # the same shingles as ``shared``, which is sorted
        assert len(many_tokens) == len(shared)
        every = np.concatenate([tokens[alone], np.repeat(many_tokens, counts)])
        rate = np.concatenate([freq[alone], np.repeat(many_freq, counts)])
        owner = np.concatenate([who[alone], members])
        n = names[:, 0].astype(np.int64)
        kept = np.bincount(owner, minlength=len(n))
        links = (kept >= least_overlap(n)) & (n > 0)
        use = links[owner]
        every, rate, owner = every[use], rate[use], owner[use]
        order = np.lexsort((every, rate, owner))
        every = every[order]
        edges = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).astype(np.int64)
        posted = n - least_overlap(n) + 1 - (n - kept)
        first = np.zeros(len(of_row), dtype=bool)
        first[np.unique(of_row, return_index=True)[1]] = True
        carries = (first & links[of_row]).tolist()
        sids = [_bytes(x[1:].astype(">u8")) for x in names]
        rows = of_row.tolist()
        return pa.table(
            {
                **{c: keys.column(c) for c in carried},
                "n": pa.array(n[of_row], pa.int64()),
                "sid": pa.array([sids[s] if n[s] else None for s in rows], pa.binary()),
                "tokens": pa.array([_bytes(every[edges[s] : edges[s + 1]]) if c else None for s, c in zip(rows, carries)], pa.binary()),
                "posted": pa.array([int(posted[s]) if c else None for s, c in zip(rows, carries)], pa.int64()),
            }
        )

    return answers.groupBy("batch").applyInArrow(run, f"{fields}, n bigint, sid binary, tokens binary, posted bigint")


def post(sets: DataFrame) -> DataFrame:
    """(token, before, sid, n, rest, block): before is the shingle that stands before it in the set (0: none), rest is how many stand at or after this position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, n, tokens, posted = (batch.column(c).to_pylist() for c in ("sid", "n", "tokens", "posted"))
            firsts = [np.frombuffer(t, dtype=np.int64)[:p] for t, p in zip(tokens, posted)]
            sizes = [len(f) for f in firsts]
            owner = np.repeat(np.arange(len(sid)), sizes)
            rest = [len(t) // 8 - np.arange(len(f)) for t, f in zip(tokens, firsts)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(firsts) if firsts else np.empty(0, dtype=np.int64), pa.int64()),
                    pa.array(np.concatenate([np.append(0, f)[: len(f)] for f in firsts]) if firsts else np.empty(0, dtype=np.int64), pa.int64()),
                    batch.column("sid").take(pa.array(owner)),
                    batch.column("n").take(pa.array(owner)),
                    pa.array(np.concatenate(rest) if rest else np.empty(0, dtype=np.int64), pa.int64()),
                ],
                ["token", "before", "sid", "n", "rest"],
            )

    return sets.select("sid", "n", "tokens", "posted").mapInArrow(trimmed(run), "token bigint, before bigint, sid bigint, n bigint, rest bigint").withColumn("block", block_of(F.col("n")))


def block_of(size: Column) -> Column:
    """The block of a list in which a set of this size stands."""
    return F.floor(F.log(size.cast("double")) / math.log(BLOCK)).cast("int")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, overlap, linked) of each pair (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            overlap, linked = [], []
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            ta, tb = batch.column("ta"), batch.column("tb")
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), dtype=np.uint64) for c in (ta, tb))
                o = len(np.intersect1d(x, y, assume_unique=True))
                overlap.append(o)
                linked.append(bool(100 * o >= PERCENT * (int(na[i]) + int(nb[i]) - o)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(overlap, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "overlap", "linked"])

    of = lambda side: sets.select(F.col("sid").alias(side), F.col("n").alias(f"n{side}"), F.col("tokens").alias(f"t{side}"))
    joined = pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a")
    return joined.select("a", "b", "na", "nb", "ta", "tb").mapInArrow(trimmed(run), "a bigint, b bigint, overlap bigint, linked boolean")


def star(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """A large-star and a small-star step over edges (u, v) with u > v: the same components, nearer to stars round their least nodes.

    The least neighbours are written before edges join them, so both sides of
    the join come straight from a shuffle and a hub with very many edges is
    split where it is skewed.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = work.keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-low")
    # Larger neighbours of a node move to its least neighbour.
    large = work.keep(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v"), f"{name}-large")
    # A node's smaller neighbours, and itself, move to the least of them.
    least = work.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    out = work.keep(small, name)
    work.drop(f"{name}-low", f"{name}-large", f"{name}-least")
    return out


def ordered_edges(linked: DataFrame) -> DataFrame:
    return linked.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")


def settled(edges: DataFrame, work: Workspace) -> DataFrame:
    """Star steps until nothing changes: every node then has one edge, to the least node of its component."""
    state, step = None, 0
    while True:
        edges = star(edges, work, f"settled-{step}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges
        if step:
            work.drop(f"settled-{step - 1}")
        state, step = tuple(now), step + 1


def roots_of(edges: DataFrame) -> DataFrame:
    """(node, root): a node of the same component for each node but roots; the component's least once edges are settled."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def rooted(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """sets, or postings, with the root of each set's component; a set without links is its own."""
    return sets.drop("root").join(roots_of(edges).withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def each_sublist(lists: DataFrame) -> DataFrame:
    """lists (token, parts, ...) with a row, and its ``salt``, for each sublist."""
    return lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def to_sublists(rows: DataFrame, groups: DataFrame, by: str, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """rows (``by``, sid, ...) with their sublist, and groups (``by``, parts, ...) with a row for each sublist."""
    long = work.keep(groups.where("parts > 1").select(by, "parts"), f"long-{by}")  # a LONG-th of the rows at most
    rows = rows.join(long, by, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return rows.withColumn("salt", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")), each_sublist(groups)


def dealt(postings: DataFrame, work: Workspace) -> DataFrame:
    """postings of lists with several sets, with the sublist (salt) and how many the list has (parts); each set is its own root."""
    # Counted before rows meet by token, so that a long list is never one task's.  A set stands in a list once.
    lists = postings.groupBy("token").agg(F.count("*").alias("_n")).where("_n > 1")
    lists = work.keep(lists.select("token", F.ceil(F.col("_n") / LONG).cast("int").alias("parts")), "lists")
    rows, each = to_sublists(postings, lists, "token", work)
    out = work.keep(rows.join(each, ["token", "salt"], "left_semi").withColumn("root", F.col("sid")), "postings")
    work.drop("lists", "long-token")
    return out


def open_lists(postings: DataFrame) -> DataFrame:
    """The postings of tokens that several components have."""
    several = postings.groupBy("token").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.max("parts").alias("parts")).where("_low != _high")
    return postings.join(each_sublist(several.select("token", "parts")), ["token", "salt"], "left_semi")


def could_link(na, nb, rest_a, rest_b):
    """The sizes allow a link, and so do the shingles from these positions on, for the first shingle that both share."""
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * PERCENT) & (F.least(rest_a, rest_b) * (100 + PERCENT) >= (na + nb) * PERCENT)


def offers(postings: DataFrame, turn: int) -> DataFrame:
    """Pairs of one member of each component in a sublist against the list's head.  The head changes with ``turn``."""
    # At first the same sets are heads everywhere, which makes few pairs; then every list has its own.
    near = F.struct((F.xxhash64("sid", "token", F.lit(turn)) if turn else F.xxhash64("sid")).alias("h"), "sid", "root", "n")
    member = postings.groupBy("token", "salt", "root").agg(F.min(near).alias("m"), F.max("parts").alias("parts"))
    head = each_sublist(postings.groupBy("token").agg(F.min(near).alias("h"), F.max("parts").alias("parts")))
    pair = member.join(head, ["token", "salt"]).where("m.root != h.root").where(F.least("m.n", "h.n") * 100 >= F.greatest("m.n", "h.n") * PERCENT)
    return pair.select(F.least("m.sid", "h.sid").alias("a"), F.greatest("m.sid", "h.sid").alias("b")).distinct()


def remaining(postings: DataFrame, tests: DataFrame) -> DataFrame:
    """Pairs across components that could still link, without those already verified or settled by a similar set's answers."""
    # A set looks for sets that aren't larger.  From this position on its partner's size is bounded, so are the blocks to visit.
    most = F.least(F.col("n"), F.floor(F.col("rest") * (100 + PERCENT) / F.lit(PERCENT)) - F.col("n"))
    least = F.greatest(F.floor(F.col("n") * PERCENT / F.lit(100)), F.lit(1))
    blocks = F.sequence(block_of(least), block_of(most))
    left = each_sublist(postings.where(most >= least).drop("salt")).select("token", "salt", F.explode(blocks).alias("block"), F.col("sid").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), F.col("root").alias("ca"), F.col("before").alias("ta"))
    right = postings.select("token", "salt", "block", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"), F.col("root").alias("cb"), F.col("before").alias("tb"))
    # At the first shingle that a pair shares, what stands from there on must be enough; so lists where it isn't need not offer the pair.
    # Where they share the shingle before it too, an earlier list offers it: sets that share a long passage meet once, not once a shingle.
    pairs = left.join(right, ["token", "salt", "block"]).where("(na > nb OR na = nb AND a > b) AND ca != cb AND (ta != tb OR ta = 0)").where(could_link(F.col("na"), F.col("nb"), F.col("ra"), F.col("rb")))
    ordered = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y))
    pairs = pairs.select(ordered("a", "b").alias("a"), ordered("b", "a").alias("b"), ordered("na", "nb").alias("na"), ordered("nb", "na").alias("nb")).distinct()
    pairs = pairs.join(tests.select("a", "b"), ["a", "b"], "left_anti")
    need = F.ceil((F.col("na") + F.col("nb")) * PERCENT / F.lit(100 + PERCENT))
    either = tests.select(F.col("a").alias("h"), F.col("b").alias("x"), "overlap", "linked").unionByName(tests.select(F.col("b").alias("h"), F.col("a").alias("x"), "overlap", "linked"))
    # The linked head with the largest overlap stands for a set.
    of = either.where("linked").groupBy("x").agg(F.max(F.struct("overlap", "h")).alias("best")).select("x", "best.h", F.col("best.overlap").alias("oh"))
    known = of.select(F.col("x").alias("a"), F.col("h").alias("_h"), F.col("oh").alias("_oh"))
    seen = either.where("not linked").select(F.col("h").alias("_h"), F.col("x").alias("b"), F.col("overlap").alias("_ob"))
    settled_before = F.col("_ob") + F.col("na") - F.col("_oh") < need
    return pairs.join(known, "a", "left").join(seen, ["_h", "b"], "left").where(~F.coalesce(settled_before, F.lit(False))).select("a", "b")


def members(spark: SparkSession, docs: DataFrame, carried: list[str], key: str, text: str) -> DataFrame:
    """(what is carried, n, component, component_id) of every row; component is null for the empty set."""
    work = Workspace(spark, "jaccard")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    bits = max(4, math.ceil(math.log2(max(1, total_bytes(docs, text)) / PART_BYTES + 1)))
    rows = work.keep(assemble(answers_to(docs, bits, carried, text, work), carried, fields), "rows")
    work.drop("answers")
    # One row a set; equal sets of different batches carry the same shingles.
    sets = rows.where(F.col("tokens").isNotNull()).groupBy(F.col("sid").alias("digest")).agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.max("posted").alias("posted")).where("posted > 0")
    # Numbers differ by run, but are only ever read from this table.
    sets = work.keep(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")
    postings, kept = dealt(post(sets), work), "postings"
    tests, edges, turn = None, None, 0
    while turn < MOST_ROUNDS:
        pairs = offers(postings, turn)
        if tests is not None:
            pairs = pairs.join(tests.select("a", "b"), ["a", "b"], "left_anti")
        new = work.keep(verify(pairs, sets), f"tests-{turn}")
        linked = new.where("linked")
        found = linked.count()
        tests = new if tests is None else tests.unionByName(new)
        if found:
            # One step is enough between rounds: sets with one root are in one component, if not yet all of them.
            added = ordered_edges(linked)
            edges = star(added if edges is None else edges.unionByName(added), work, f"edges-{turn}")
            # A list whose sets are of one component has no pair to verify, now or later.
            postings = work.keep(open_lists(rooted(postings, edges)), f"open-{turn}")
            work.drop(kept)
            kept = f"open-{turn}"
        turn += 1
        if not found or turn > 1 and found * ENOUGH < tests.where("linked").count():
            break
    last = work.keep(verify(remaining(postings, tests), sets), "last")
    work.drop(kept, *[f"tests-{k}" for k in range(turn)])
    added = ordered_edges(last.where("linked"))
    edges = settled(added if edges is None else edges.unionByName(added), work)
    roots = work.keep(rooted(sets.select("sid", "digest"), edges).select(F.col("digest").alias("sid"), "root"), "roots")
    work.drop("sets")
    return numbered(rows, roots, carried, key, work)


def numbered(rows: DataFrame, roots: DataFrame, carried: list[str], key: str, work: Workspace) -> DataFrame:
    """The least key of each component, joined to its rows by way of the sets.  A large component is dealt like a long list; a set without a root is a component."""
    least = rows.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min(key).alias("low"))
    least = work.keep(least.join(roots, "sid", "left"), "least")
    several = least.where("root IS NOT NULL")
    # A component is known by the least digest of its sets.
    low = several.groupBy("root").agg(F.min("sid").alias("component"), F.min("low").alias("component_id"), F.ceil(F.count("*") / LONG).cast("int").alias("parts"))
    dealt_out, each = to_sublists(several, work.keep(low, "low"), "root", work)
    several = dealt_out.join(each, ["root", "salt"]).select("sid", "component", "component_id")
    least = several.unionByName(least.where("root IS NULL").select("sid", F.col("sid").alias("component"), F.col("low").alias("component_id")))
    return rows.join(least, "sid", "left").select(*carried, "n", "component", F.coalesce("component_id", F.col(key)).alias("component_id"))


def link(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, n_shingles, component_id) of every row."""
    return members(spark, docs, [key], key, text).select(key, F.col("n").alias("n_shingles"), "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component, with its columns; see above which."""
    work = Workspace(spark, "first")
    row, own, known = unused(docs.columns, "_row", "_own", "_known")
    hashed = docs.withColumn(row, row_hash(docs))
    # key and row may have any names: what members adds is renamed by place.
    every = members(spark, hashed.select(F.col(text).alias("_text"), F.col(key).alias("_key"), F.col(row).alias("_row")), ["_key", "_row"], "_key", "_text")
    every = work.keep(every.select("_key", "_row", "component"), "members")
    first = F.min(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("k"), F.col("_row").alias("r")))
    kept = every.where("component IS NOT NULL").groupBy("component").agg(first.alias("f")).select(F.col("f.k").alias(own), F.col("f.r").alias(known))
    empty = every.where("component IS NULL").select(F.col("_key").alias(own), F.col("_row").alias(known)).distinct()
    same = lambda other: F.col(key).eqNullSafe(other[own]) & (F.col(row) == other[known])
    kept = work.keep(kept, "kept")
    equal = every.where("component IS NOT NULL").groupBy(F.col("_key").alias("k"), F.col("_row").alias("r")).agg(F.count("*").alias("c")).where("c > 1")
    equal = work.keep(kept.join(equal, F.col(own).eqNullSafe(F.col("k")) & (F.col(known) == F.col("r")), "left_semi"), "equal")
    if equal.isEmpty():
        stay = kept.unionByName(empty)
        return hashed.join(stay, same(stay), "left_semi").select(docs.columns)
    # Of rows that are equal in all columns, one.
    single = kept.join(equal.select(F.col(own).alias("k"), F.col(known).alias("r")), F.col(own).eqNullSafe(F.col("k")) & (F.col(known) == F.col("r")), "left_anti").unionByName(empty)
    one = hashed.join(equal, same(equal), "left_semi").dropDuplicates([key, row])
    return hashed.join(single, same(single), "left_semi").unionByName(one).select(docs.columns)
