"""Quality rules with line sequence labelling.

A linear-chain conditional random field marks each line of a text as content
or boilerplate by Viterbi decoding; the share of characters in content lines
decides whether the text stays.  Its features are counts of what a line is
made of, and of how many of its words are known from recurring lines.  It learns
from seed lines, with all other lines latent: the gradient is the difference
between free and clamped expectations.  Boilerplate seeds are lines that recur
in the corpus between different neighbours, which copies of a document or a
passage don't, and lines that are hardly words (symbols, bars, capitals with
exclamation marks, echoes); content seeds are runs of plain words that don't
recur so.  Contexts are counted over all lines of all rows.  The sample
is bounded, by default by ``TRAIN_DOCS`` rows and ``TRAIN_LINES`` lines of each:
of longer texts, runs of ``RUN`` neighbouring lines spread over the whole text,
each a sequence of its own, of which only the first begins a text; the three
are parameters of ``learn``.  So is how many contexts a recurring line has, by
default ``CONTEXTS``, and how many words of a line the lexicon of recurring lines
takes up, by default ``LINE_WORDS``.  Decoding reads every line.

Base counts come beside it: words, code points in words, symbols, lines with a
word that equal an earlier line, and words in three-word windows found twice
or more in the text.

Defined results: null and empty texts have all counts 0 and fail the base
rules; a text with no word outside boilerplate has content share 0; repeated
rows are each judged; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.spread import spread
from . import style
from .crf import Adam, Layout, forward_backward, viterbi
from .language import pieces_of
from .shared import sample, trimmed

TRAIN_DOCS = 3000
TRAIN_LINES = 64
RUN = 16
LEAST_WORDS = 50
LEAST_CONTENT = 0.5
ROUNDS = 60
CONTENT, BOILERPLATE = 0, 1
CONTEXTS = 3
#: A recurring line has at least this many contexts an occurrence: near copies give a line a few new ones only.
OFTEN_NEW = 0.5
LINE_WORDS = 64
#: A word is in the lexicon if it stands in so many lines of the sample and this share of them recur.
LEXICON_LINES, LEXICON_SHARE = 3, 0.9
FEATURES = 17


def line_features(t: style.Texts, lexicon: np.ndarray) -> np.ndarray:
    """(lines, FEATURES); lexicon: hashes of words, in order."""
    c = t.line_counts.astype(np.float64)
    words = t.line_words.astype(np.float64)
    some = np.maximum(words, 1)
    letters = c[:, style.UPPER] + c[:, style.LOWER] + c[:, style.LEAD]
    chars = np.maximum(c.sum(axis=1) - c[:, style.CONTINUATION] - c[:, style.NEWLINE], 1)
    found = np.minimum(np.searchsorted(lexicon, t.words), max(0, len(lexicon) - 1))
    known = lexicon[found] == t.words if len(lexicon) else np.zeros(len(t.words), dtype=bool)
    recurring = np.bincount(t.word_line, weights=known, minlength=len(words)) / some
    place = np.arange(len(words)) - np.repeat(t.line_at[:-1], np.diff(t.line_at))
    return np.stack(
        [
            np.ones(len(words)),
            np.minimum(np.log1p(words), 5) / 5,
            (words == 0).astype(float),
            (words < 4).astype(float),
            (words > 11).astype(float),
            c[:, style.UPPER] / np.maximum(letters, 1),
            (c[:, style.UPPER] > c[:, style.LOWER]).astype(float),
            np.minimum(c[:, style.SYMBOL] / some, 3),
            np.minimum(c[:, style.PIPE] / some, 1) * 3,
            np.minimum(c[:, style.BANG] / some, 2),
            c[:, style.DIGIT] / chars * 3,
            np.minimum(c[:, style.STOP] / some, 1),
            t.line_echo / some * 2,
            t.line_seen.astype(float),
            recurring * 2,
            np.abs(letters / np.maximum(words, 1) - 5) / 10,
            (place == 0).astype(float),
        ],
        axis=1,
    )


def seeds(x: np.ndarray, recurs: np.ndarray) -> np.ndarray:
    """CONTENT, BOILERPLATE or -1 for each line with these features, and whether it recurs."""
    words = np.expm1(x[:, 1] * 5)
    noise = (x[:, 7] > 0.5) | (x[:, 8] > 0.9) | ((x[:, 9] > 0.5) & (x[:, 6] > 0)) | ((x[:, 12] > 1) & (words > 7)) | recurs
    plain = (words > 5) & (x[:, 5] < 0.3) & (x[:, 7] == 0) & (x[:, 8] == 0) & (x[:, 9] == 0) & (x[:, 12] < 0.4)
    return np.where(noise, BOILERPLATE, np.where(plain, CONTENT, -1))


@dataclass
class Model:
    weights: np.ndarray  # (FEATURES, 2)
    transition: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray  # hashes of words of recurring lines, in order


NO_WORDS = np.empty(0, dtype=np.uint64)


def train(x: np.ndarray, lengths: np.ndarray, opens: np.ndarray | None = None, recurs: np.ndarray | None = None, lexicon: np.ndarray = NO_WORDS) -> Model:
    """From the features of lines, sequence by sequence; ``opens``: whether a sequence begins a text (all do if None); ``recurs``: of each line (none does if None)."""
    m = Model(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2), lexicon)
    if not len(x):
        return m
    layout = Layout(lengths)
    opens = (np.ones(len(lengths), dtype=bool) if opens is None else opens) & (lengths > 0)
    first = (np.cumsum(lengths) - lengths)[opens]
    begins = np.zeros((int(layout.running[0]), 1))
    begins[layout.rank[opens]] = 1
    seed = seeds(x, np.zeros(len(x), dtype=bool) if recurs is None else recurs)
    barred = np.zeros((len(x), 2))
    known = np.flatnonzero(seed >= 0)
    barred[known, 1 - seed[known]] = -30
    adam = Adam({"weights": m.weights, "transition": m.transition, "start": m.start}, 0.1)
    for _ in range(ROUNDS):
        scores = x @ m.weights
        start = begins * m.start  # by rank; a run within a text begins with either label
        free, free_pairs, *_ = forward_backward(layout, scores, m.transition, start, count=True)
        held, held_pairs, *_ = forward_backward(layout, scores + barred, m.transition, start, count=True)
        adam.step(
            {
                "weights": x.T @ (free - held) / len(x) + 1e-4 * m.weights,
                "transition": (free_pairs - held_pairs) / len(x) + 1e-3 * m.transition,
                "start": (free[first] - held[first]).sum(axis=0) / len(x) + 1e-3 * m.start,
            }
        )
    return m


def recurring(docs: DataFrame, keys: DataFrame, text: str, contexts: int) -> DataFrame:
    """(key) of lines, by XXH64, that stand between so many different pairs of neighbours, and seldom between the same; keys has those to look for, a bounded number."""
    hashed = F.transform(F.split(text, "\n", -1), lambda line: F.xxhash64(line))
    each = F.transform("_lines", lambda key, i: F.struct(key.alias("key"), F.xxhash64(F.get("_lines", i - 1), F.get("_lines", i + 1)).alias("context")))
    lines = docs.where(F.col(text).isNotNull()).select(hashed.alias("_lines")).select(F.explode(each).alias("l")).select("l.*")
    pairs = lines.join(F.broadcast(keys), "key", "left_semi").groupBy("key", "context").agg(F.count("*").alias("n"))
    return pairs.groupBy("key").agg(F.count("*").alias("contexts"), F.sum("n").alias("n")).where((F.col("contexts") >= contexts) & (F.col("contexts") >= OFTEN_NEW * F.col("n"))).select("key")


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES, size: int = RUN, contexts: int = CONTEXTS, most_words: int = LINE_WORDS) -> Model:
    """A model from a bounded sample of rows.

    ``most``: different rows (key, text) that are learned from, chosen by their
    hash; ``most_lines``: lines of each; ``size``: neighbouring lines of a run
    of texts with more; ``contexts``: of a recurring line; ``most_words``: words
    of a line that the lexicon takes up.
    """
    chosen = sample(docs.select(key, text), most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in pieces_of(batch, 0):
                t = style.read(part.column(0))
                x = line_features(t, NO_WORDS).astype(np.float32)
                ends = np.append(t.line_start[1:], len(t.raw))
                first = np.searchsorted(t.word_line, np.arange(len(x) + 1))
                rows = []
                for i, (a, b) in enumerate(zip(t.line_at[:-1], t.line_at[1:])):
                    whole = b - a <= most_lines
                    begins = [a] if whole else np.linspace(a, b - size, most_lines // size).astype(int)
                    length = int(b - a if whole else size)
                    places = [j for c in begins for j in range(c, c + length)]
                    hashes = [xxhash.xxh64_intdigest(t.raw[t.line_start[j] : ends[j] - (j < b - 1)].tobytes(), 42) for j in places]
                    words = [np.unique(t.words[first[j] : first[j + 1]][:most_words]) for j in places]
                    rows.append((x[places].tobytes(), length, np.array(hashes, dtype=np.uint64).view(np.int64).tolist(), [w.tobytes() for w in words]))
                columns = list(zip(*rows)) or [[]] * 4
                kinds = (pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["x", "run", "keys", "words"])

    got = chosen.select(text).mapInArrow(trimmed(run), "x binary, run int, keys array<bigint>, words array<binary>").collect()  # most rows of most_lines lines at most
    if not got:
        return train(np.zeros((0, FEATURES)), np.zeros(0, dtype=int))
    got = sorted((bytes(r["x"]), r["run"], list(r["keys"]), [bytes(w) for w in r["words"]]) for r in got)
    x = np.concatenate([np.frombuffer(g[0], dtype=np.float32) for g in got]).reshape(-1, FEATURES).astype(np.float64)
    keys = np.array([k for g in got for k in g[2]], dtype=np.int64)
    words = [np.frombuffer(w, dtype=np.uint64) for g in got for w in g[3]]
    asked = docs.sparkSession.createDataFrame(pa.table({"key": np.unique(keys[x[:, 2] == 0])}))  # lines with words
    recurs = np.isin(keys, [r["key"] for r in recurring(docs, asked, text, contexts).collect()])
    of_line = np.repeat(np.arange(len(words)), [len(w) for w in words])
    every, which, many = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
    lexicon = every[(many >= LEXICON_LINES) & (np.bincount(which, weights=recurs[of_line], minlength=len(every)) >= LEXICON_SHARE * many)]
    sizes = np.array([len(w) for w in words])
    in_lexicon = np.isin(np.concatenate(words), lexicon)
    x[:, 14] = 2 * np.bincount(of_line, weights=in_lexicon, minlength=len(words)) / np.maximum(sizes, 1)
    lengths, opens = [], []
    for _, length, own, _ in got:
        n = len(own) // max(1, length)
        lengths += [length] * n
        opens += [k == 0 for k in range(n)]
    return train(x, np.array(lengths, dtype=np.int64), np.array(opens, dtype=bool), recurs, lexicon)


def judge(model: Model, column: pa.Array) -> dict[str, np.ndarray]:
    """Base counts, content share and verdict of each text."""
    t = style.read(column)
    n = len(t.at) - 1
    words = np.diff(t.word_at)
    inside = t.counts[:, style.UPPER : style.LEAD + 1].sum(axis=1)
    symbols = t.counts[:, style.SYMBOL] + t.counts[:, style.PIPE]
    owner = np.repeat(np.arange(n), np.diff(t.line_at))
    label = viterbi(Layout(np.diff(t.line_at)), line_features(t, model.lexicon) @ model.weights, model.transition, model.start)
    size = t.line_counts[:, style.UPPER : style.LEAD + 1].sum(axis=1) * (t.line_words > 0)
    total = np.bincount(owner, weights=size, minlength=n)
    content = np.bincount(owner, weights=size * (label == CONTENT), minlength=n)
    share = content / np.maximum(total, 1)
    failed = (words < LEAST_WORDS) | (100 * t.repeated > 50 * words)
    return {
        "n_words": words,
        "word_chars": inside,
        "n_symbols": symbols,
        "n_dup_lines": np.bincount(owner, weights=t.line_seen, minlength=n).astype(np.int64),
        "n_repeat_words": t.repeated,
        "base_failed": failed,
        "kept": ~failed & (share >= LEAST_CONTENT),
        "content_share": share,
    }


def apply(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and verdict of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "content_share": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 1):
                got = judge(sent.value, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v, kinds.get(k, pa.int64())) for k, v in got.items()]], [key, *got])

    return spread(docs.select(key, text)).mapInArrow(
        run,
        f"{key} {docs.schema[key].dataType.simpleString()}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double",
    )
