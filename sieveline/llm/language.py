"""Language identification with a linear-chain conditional random field over words.

Items are the letter runs of a text.  Their features are the byte n-grams of
the run with marks at both ends (those that touch a mark are its affixes) and
its entry in a lexicon learned with the model; transitions and starts are
learned too.  Words of code-switched text are labelled by forward-backward;
the document takes the label with the largest sum of word marginals.

Training uses a bounded sample, by default ``TRAIN_DOCS`` rows of ``WINDOWS``
windows of ``WINDOW`` words spread over the whole text each; all three are
parameters of ``learn``.  Windows of different documents are joined to
code-switched sequences, which is where the transitions between languages come
from.  Prediction reads every word.

Defined results: a null text or one without a letter is ``und`` with score 0;
with no labelled row to learn from every text is ``und``; ties go to the
label that sorts first; repeated rows are each labelled; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.spread import spread
from .crf import Adam, Layout, forward_backward
from .shared import sample, trimmed
from .words import mix, text_buffer

TRAIN_DOCS = 1200
WINDOWS = 3
WINDOW = 60
JOINED = 4
ROWS = 1 << 15
ROUNDS = 30
UNKNOWN = "und"
#: Texts of at most so many bytes together are labelled at once.
TOGETHER = 3 << 20

_U = np.uint64
_BYTE = np.zeros(256, dtype=np.uint64)
_BYTE[128:] = np.arange(128, 256)
_BYTE[97:123] = np.arange(97, 123)
_BYTE[65:91] = np.arange(97, 123)


@dataclass
class Words:
    """Letter runs of texts: rows of the n-gram table by byte, and where runs and texts start."""

    rows: np.ndarray  # (n-gram sizes, bytes)
    runs: np.ndarray  # first byte of each run
    texts: np.ndarray  # first run of each text, and the total
    lexicon: np.ndarray  # hash of each run


def letter_runs(raw: np.ndarray, at: np.ndarray) -> Words:
    """Runs of ASCII letters and non-ASCII bytes, cut where texts begin; A-Z is lower-cased."""
    # Texts are set apart by a zero byte each.
    code = np.zeros(len(raw) + len(at) + 3, dtype=np.uint64)
    lengths = np.diff(at)
    code[np.arange(len(raw)) + np.repeat(np.arange(len(lengths)), lengths) + 2] = _BYTE[raw]
    letter = code > 0
    first = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    stops = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    begins = at + np.arange(len(at)) + 2
    inside = np.flatnonzero(letter)
    b = [code[inside + d] for d in (-2, -1, 0, 1)]
    after = code[np.minimum(inside + 2, len(code) - 1)]
    b.append(after * (b[3] > 0))  # nothing beyond a mark
    b[0] = b[0] * (b[1] > 0)
    three = b[1] | b[2] << _U(8) | b[3] << _U(16)
    rows = np.empty((3, len(inside)), dtype=np.int32)
    mask = _U(ROWS - 1)
    rows[0] = mix(three) & mask
    rows[1] = mix(three | b[0] << _U(32) | _U(1 << 50)) & mask
    rows[2] = mix(three | b[0] << _U(32) | b[4] << _U(40) | _U(1 << 51)) & mask
    runs = np.searchsorted(inside, first)
    if len(first):
        # A run's own hash: the sum of its spread bytes by place.
        place = inside - np.repeat(first, stops - first)
        lexicon = mix(np.add.reduceat(mix(b[2] + (place.astype(np.uint64) << _U(8))), runs))
    else:
        lexicon = np.empty(0, dtype=np.uint64)
    return Words(rows, runs, np.searchsorted(first, begins), lexicon)


@dataclass
class Model:
    labels: list[str]
    grams: np.ndarray  # (3, ROWS, labels)
    known: np.ndarray  # sorted hashes of the lexicon
    entries: np.ndarray  # (lexicon + 1, labels); the last row is for unknown words
    transition: np.ndarray
    start: np.ndarray

    def entry(self, words: Words) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(words.lexicon), dtype=np.int64)
        found = np.minimum(np.searchsorted(self.known, words.lexicon), len(self.known) - 1)
        return np.where(self.known[found] == words.lexicon, found, len(self.known))

    def scores(self, words: Words) -> np.ndarray:
        out = self.entries[self.entry(words)]
        if len(words.runs):
            for n in range(3):
                out = out + np.add.reduceat(self.grams[n][words.rows[n]], words.runs, axis=0)
        return out


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """A model from windows of words and their languages."""
    labels = sorted(set(langs))
    n = len(labels)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    raw, at = text_buffer(pa.array([texts[i] for i in order], pa.string()))
    words = letter_runs(raw, at)
    sizes = np.diff(words.texts)
    gold = np.repeat(np.array([labels.index(langs[i]) for i in order]), sizes)
    # Windows in random order, JOINED at a time, are the sequences.
    layout = Layout(np.add.reduceat(sizes, np.arange(0, len(sizes), JOINED)))
    known, counts = np.unique(words.lexicon, return_counts=True)
    model = Model(labels, np.zeros((3, ROWS, n)), known[counts >= 3], None, np.zeros((n, n)), np.zeros(n))
    model.entries = np.zeros((len(model.known) + 1, n))
    entry = model.entry(words)
    target = np.eye(n)[gold]
    heads = np.cumsum(layout.lengths) - layout.lengths
    heads = heads[layout.lengths > 0]
    inner = np.ones(len(gold), dtype=bool)
    inner[heads] = False
    seen = np.zeros((n, n))
    np.add.at(seen, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    params = {"grams": model.grams, "entries": model.entries, "transition": model.transition, "start": model.start}
    adam = Adam(params, 0.05)
    gram_run = np.repeat(np.arange(len(words.runs)), np.diff(np.append(words.runs, words.rows.shape[1])))
    total = max(1, len(gold))
    for _ in range(ROUNDS):
        marginal, pairs, starts, _ = forward_backward(layout, model.scores(words), model.transition, model.start, count=True)
        error = marginal - target
        spread = error[gram_run]
        g = {
            "grams": np.stack([np.stack([np.bincount(words.rows[k], spread[:, j], ROWS) for j in range(n)], axis=1) for k in range(3)]) / total + 1e-6 * model.grams,
            "entries": np.stack([np.bincount(entry, error[:, j], len(model.entries)) for j in range(n)], axis=1) / total + 1e-6 * model.entries,
            "transition": (pairs - seen) / total + 1e-4 * model.transition,
            "start": (starts - target[heads].sum(axis=0)) / total + 1e-4 * model.start,
        }
        adam.step(g)
    model.grams, model.entries = model.grams.astype(np.float32), model.entries.astype(np.float32)
    return model


def cuts_between_runs(raw: np.ndarray, most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Stretches of about ``most`` bytes of a text that begin and end outside runs."""
    a = 0
    while a < len(raw):
        b = min(len(raw), a + most)
        while b < len(raw) and _BYTE[raw[b]]:
            b += 1
        yield a, b
        a = b


def label_texts(model: Model | None, column: pa.Array) -> tuple[list[str], np.ndarray, list[np.ndarray]]:
    """(label, score and share of each language) of each text."""
    raw, at = text_buffer(column)
    n = len(at) - 1
    labels, score = [UNKNOWN] * n, np.zeros(n)
    if model is None or not model.labels or not len(raw):
        return labels, score, []
    if n == 1:  # one text of any length, cut between runs
        parts = [letter_runs(raw[a:b], np.array([0, b - a])) for a, b in cuts_between_runs(raw)]
    else:
        parts = [letter_runs(raw, at)]
    sizes = sum(np.diff(w.texts) for w in parts)
    if not sizes.any():
        return labels, score, []
    marks = np.concatenate([model.scores(w).astype(np.float32) for w in parts])
    marginal, *_ = forward_backward(Layout(sizes), marks, model.transition, model.start)
    has = np.flatnonzero(sizes)
    share = np.add.reduceat(marginal.astype(np.float64), (np.cumsum(sizes) - sizes)[has], axis=0) / sizes[has, None]
    best = share.argmax(axis=1)
    for i, k, s in zip(has.tolist(), best.tolist(), share):
        labels[i], score[i] = model.labels[k], min(1.0, max(0.0, float(s[k])))
    # Non-ASCII bytes need not be letters.
    for i in has:
        part = raw[at[i] : at[i + 1]]
        if not ((part | 32) - 97 < 26).any() and not any(c.isalpha() for c in part.tobytes().decode("utf-8", "replace")):
            labels[i], score[i] = UNKNOWN, 0.0
    return labels, score, share


def pieces_of(batch: pa.RecordBatch, column: int, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of text."""
    _, at = text_buffer(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def windows(docs: DataFrame, text: str, most: int = WINDOWS, size: int = WINDOW) -> DataFrame:
    """At most ``most`` windows of ``size`` words of each row, spread evenly over its text: (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            langs: list[str] = []
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (t or "").split()
                count = min(most, -(-len(words) // size))
                for k in range(count):
                    a = (len(words) - size) * k // max(1, count - 1) if count > 1 else 0
                    out.append(" ".join(words[a : a + size]))
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(langs, pa.string())], ["text", "lang"])

    return docs.select(text, "lang").mapInArrow(trimmed(run), "text string, lang string")


def learn(docs: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", most: int = TRAIN_DOCS, most_windows: int = WINDOWS, window: int = WINDOW) -> Model | None:
    """A model from rows of ``docs`` (key, text, lang) that ``may_learn`` holds for.

    ``most``: different rows (key, text, lang) that are learned from, chosen by
    their hash; ``most_windows``: windows of each; ``window``: words of a window.
    """
    rows = docs.where(may_learn & F.col("lang").isNotNull() & F.col(text).isNotNull()).select(key, text, "lang")
    picked = windows(sample(rows, most), text, most_windows, window).collect()  # most * most_windows rows at most
    picked = sorted((r["text"], r["lang"]) for r in picked)
    return train([t for t, _ in picked], [lang for _, lang in picked]) if picked else None


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 1):
                labels, score, _ = label_texts(sent.value, part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(labels, pa.string()), pa.array(score, pa.float64())], [key, "lang_pred", "score"])

    return spread(docs.select(key, text)).mapInArrow(trimmed(run), f"{key} {docs.schema[key].dataType.simpleString()}, lang_pred string, score double")
