"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding is our own: every adjacent pair of symbols whose concatenation is a
piece stands on an agenda ordered by the piece's score (ties: leftmost); the
best pair is merged until none is left, and symbols outside the vocabulary
become byte pieces.  Where no piece has a space mark inside, texts are cut at
those marks without changing a result, and equal stretches have equal ids, so
they are remembered in a table of bounded size.  The agendas of all short
stretches that a group of texts brings anew are worked off side by side, a row
of an array each; longer ones have a heap.  Each Arrow batch is checked against
the sentencepiece library: every stretch that was encoded anew and one whole
text of every ``ONE_OF`` (``check="stretches"``) or every whole text
(``check="texts"``), begin and end included; a difference raises an error.
Decoding is the library's.

Vocabularies of another type, or with rules that change a text before it is
cut, are not for this agenda: the check raises at their first difference.

Null and empty texts have the begin and end ids only and decode to the empty
text.  Rows may repeat; each is encoded for itself.  Extra columns are dropped
from the result.  An empty table gives an empty result.  Texts are handled in
groups of bounded size, longer ones in parts.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.spread import spread
from .language import pieces_of
from .shared import kept_in_worker, trimmed

SPACE = "▁"
#: Entries of one generation of a table; two are held.
CACHE = 150_000
TOGETHER = 64
ONE_OF = 128
#: Characters of texts that are encoded together, and of the parts of longer texts.
PART = 1 << 20
#: Stretches of so many characters and fewer stand in arrays, by length up to each of these.
SHORT = (8, 14, 40)
ROWS = 8192
NEVER = np.inf

_PROCESSORS: dict[str, "PieceCodec"] = kept_in_worker("pieces")


class DifferentIds(ValueError):
    """The agenda and the library disagree."""


class PieceCodec:
    """A vocabulary with its merge agenda."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = sp.unk_id()
        self.byte_fallback = sp.is_byte(self.byte_ids[0])
        for k in range(sp.get_piece_size()):
            if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k)):
                piece = sp.id_to_piece(k)
                self.rank[piece] = -sp.get_score(k)
                self.ids[piece] = k
        #: a space symbol starts a cut of its own unless some piece has one inside
        self.words_apart = all(SPACE not in p.lstrip(SPACE) for p in self.rank)
        # What is remembered, and what was before: entries in use move from the second to the first, none is in both.
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.fresh: dict[str, bytes] = {}
        self.pairs: Pairs | None = None

    def ids_of(self, symbols: Iterable[str]) -> bytes:
        """Ids of symbols as little-endian 32-bit integers."""
        ids: list[int] = []
        for s in symbols:
            k = self.ids.get(s)
            if k is not None:
                ids.append(k)
            elif self.byte_fallback:
                ids.extend(self.byte_ids[b] for b in s.encode("utf-8", "replace"))
            else:
                ids.append(self.unknown)
        return np.array(ids, dtype="<u4").tobytes()

    def merged(self, text: str) -> list[str]:
        """Symbols after all merges; the agenda is a heap, whose outdated entries are passed over."""
        rank, n = self.rank, len(text)
        symbols: list[str] = list(text)
        if n > 1:
            before, after = list(range(-1, n - 1)), [*range(1, n), -1]
            agenda = []
            for i in range(n - 1):
                pair = text[i : i + 2]
                if pair in rank:
                    agenda.append((rank[pair], i, i + 1, pair))
            heapq.heapify(agenda)
            while agenda:
                _, i, j, pair = heapq.heappop(agenda)
                if not symbols[i] or not symbols[j] or after[i] != j or len(symbols[i]) + len(symbols[j]) != len(pair):
                    continue
                symbols[i], symbols[j] = pair, ""
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    longer = pair + symbols[k]
                    if longer in rank:
                        heapq.heappush(agenda, (rank[longer], i, k, longer))
                h = before[i]
                if h >= 0:
                    longer = symbols[h] + pair
                    if longer in rank:
                        heapq.heappush(agenda, (rank[longer], h, i, longer))
        return [s for s in symbols if s]

    def merged_rows(self, words: list[str]) -> Iterator[list[str] | bytes]:
        """The ids of short words, or their symbols where some are no piece: all agendas advance a merge at a time."""
        pairs = self.pairs = self.pairs or Pairs(self)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        state = np.zeros((len(words), width), dtype=np.int32)  # 0: nothing
        state[inside] = pairs.symbol(codes)
        rows = np.arange(len(words))
        now = state.copy()
        agenda, joined = pairs.find(now[:, :-1], now[:, 1:])
        while len(rows) and agenda.shape[1]:
            at = agenda.argmin(axis=1)  # the leftmost of the best
            line = np.arange(len(rows))
            due = agenda[line, at] < NEVER
            if not due.all():
                state[rows[~due], : now.shape[1]] = now[~due]
                state[rows[~due], now.shape[1] :] = 0
                rows, now, agenda, joined, at = rows[due], now[due], agenda[due], joined[due], at[due]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            made = joined[line, at]
            # What stands after the pair moves up by one place.
            take = np.arange(now.shape[1] - 1)
            now = np.take_along_axis(now, take + (take > at[:, None]), axis=1)
            now[line, at] = made
            take = take[:-1]
            moved = take + (take >= at[:, None])
            agenda, joined = np.take_along_axis(agenda, moved, axis=1), np.take_along_axis(joined, moved, axis=1)
            for left in (at - 1, at):
                use = np.flatnonzero((left >= 0) & (left < agenda.shape[1]))
                if len(use):
                    l = left[use]  # noqa: E741
                    agenda[use, l], joined[use, l] = pairs.find(now[use, l], now[use, l + 1])
        if len(rows):
            state[rows, : now.shape[1]] = now
            state[rows, now.shape[1] :] = 0
        ends = (state != 0).sum(axis=1)
        ids = pairs.ids[np.maximum(state, 0)]
        whole = ((ids >= 0) & (state >= 0) | (state == 0)).all(axis=1)
        data, step = ids.astype("<u4").tobytes(), 4 * width
        for k, (n, plain) in enumerate(zip(ends.tolist(), whole.tolist())):
            yield data[k * step : k * step + 4 * n] if plain else [pairs.strings[x] if x > 0 else chr(-1 - x) for x in state[k, :n].tolist()]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of stretches that no merge crosses the ends of."""
        out: dict[str, bytes] = {}
        least = 0
        for most in SHORT:
            some = [w for w in words if least < len(w) <= most]
            for a in range(0, len(some), ROWS):
                part = some[a : a + ROWS]
                for w, found in zip(part, self.merged_rows(part)):
                    out[w] = found if isinstance(found, bytes) else self.ids_of(found)
            least = most
        for w in words:
            if len(w) > least:
                out[w] = self.ids_of(self.merged(w))
        return out

    def cut(self, text: str) -> list[str]:
        """Stretches of a text that begin with a space symbol; the whole text if pieces may have one inside."""
        text = SPACE + text.replace(" ", SPACE)
        if not self.words_apart:
            return [text]
        if SPACE + SPACE in text:
            return re.findall(f"{SPACE}+[^{SPACE}]*", text)
        return [SPACE + w for w in text[1:].split(SPACE)]

    def parts(self, text: str) -> Iterator[str]:
        """A long text in parts that begin with a space, which stands for the symbol that begins a text, and don't end with one."""
        a = 0
        while a < len(text):
            b = -1
            if self.words_apart:
                spaces = re.compile(f"[ {SPACE}]")
                found = spaces.search(text, a + PART)
                while found and text[found.start() - 1] in (" ", SPACE):
                    found = spaces.search(text, found.end())
                b = found.start() if found else -1
            b = b if b > 0 else len(text)
            yield text[a:b] if a == 0 else text[a + 1 : b]
            a = b

    def stretches(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without begin and end, as little-endian 32-bit integers."""
        cuts = [self.cut(t) for t in texts]
        needed = set().union(*cuts)
        missing = needed.difference(self.words)
        if missing:
            old = self.old_words
            self.fresh = self.encode_words([w for w in missing if w not in old])
            found = {w: old.pop(w, None) or self.fresh[w] for w in missing}
            if len(self.words) + len(missing) > CACHE:
                found |= {w: self.words.pop(w) for w in needed.difference(missing)}
                self.words, self.old_words = found, self.words
            else:
                self.words.update(found)
        known = self.words.__getitem__
        return [b"".join(map(known, c)) for c in cuts]

    def encode(self, texts: list[str], check: bool = True) -> list[bytes]:
        """The same, with new stretches checked against the library and long texts in parts."""
        out: list[bytes] = []
        for group in groups(texts):
            parts = list(self.parts(group[0])) if len(group) == 1 else group
            ids: list[bytes] = []
            for some in [[p] for p in parts] if len(group) == 1 else [parts]:
                ids += self.stretches(some)
                if check:
                    self.compare_fresh()
            out += [b"".join(ids)] if len(group) == 1 else ids
        # The empty text has no symbol, not even the one that begins others.
        return [x if t else b"" for t, x in zip(texts, out)]

    def compare_fresh(self) -> None:
        """Compare stretches that were encoded anew with the library: glued, each run of spaces that ends a text behind one stretch."""
        words, self.fresh = self.fresh, {}
        names = [w for w in words if not w.endswith(SPACE)]
        glued = [names[a : a + TOGETHER] for a in range(0, len(names), TOGETHER)]
        runs = [w for w in words if w.endswith(SPACE)]
        if runs:
            before = SPACE + "a"
            words |= self.encode_words([before])
            glued += [[before, w] for w in runs]
        compare(self, ["".join(g)[1:] for g in glued], [b"".join(map(words.get, g)) for g in glued])


def groups(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, of PART characters together or one longer one."""
    some: list[str] = []
    size = 0
    for t in texts:
        if some and size + len(t) > PART:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


class Pairs:
    """Symbols by number, and which pairs of them make a piece.

    Number 0 stands for nothing; characters that occur in no piece are -1 less
    their code point.
    """

    def __init__(self, codec: "PieceCodec") -> None:
        chars = sorted({c for p in codec.rank for c in p} - codec.rank.keys())
        self.strings = ["", *codec.rank, *chars]
        number = {s: k for k, s in enumerate(self.strings)}
        self.ids = np.array([-1, *[codec.ids[s] for s in codec.rank], *[-1] * len(chars)], dtype=np.int64)
        self.of_char = np.zeros(0x110000, dtype=np.int32)
        for s, k in number.items():
            if len(s) == 1:
                self.of_char[ord(s)] = k
        made = {}
        for piece, rank in codec.rank.items():
            for i in range(1, len(piece)):
                left, right = number.get(piece[:i]), number.get(piece[i:])
                if left and right:
                    made[left << 32 | right] = (rank, number[piece])
        self.keys = np.array(sorted(made), dtype=np.int64)
        self.rank = np.array([made[k][0] for k in self.keys.tolist()] + [NEVER], dtype=np.float64)
        self.made = np.array([made[k][1] for k in self.keys.tolist()] + [0], dtype=np.int32)

    def symbol(self, codes: np.ndarray) -> np.ndarray:
        known = self.of_char[codes]
        return np.where(known > 0, known, -1 - codes).astype(np.int32)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol) of what pairs make; NEVER where they make no piece."""
        key = left.astype(np.int64) << 32 | np.maximum(right, 0)
        at = np.searchsorted(self.keys, key)
        at[at < len(self.keys)] = np.where(self.keys[at[at < len(self.keys)]] == key[at < len(self.keys)], at[at < len(self.keys)], len(self.keys))
        return self.rank[at], self.made[at]


def codec(model_path: str) -> PieceCodec:
    if model_path not in _PROCESSORS:
        _PROCESSORS[model_path] = PieceCodec(model_path)
    return _PROCESSORS[model_path]


def compare(c: PieceCodec, texts: list[str], mine: list[bytes], ends: bool = False) -> None:
    """Raise if the library has other ids for one of the texts; ``ends``: with begin and end."""
    for t, x, own in zip(texts, mine, c.library.encode(texts, num_threads=1, add_bos=ends, add_eos=ends) if texts else []):
        if np.array(own, dtype="<u4").tobytes() != x:
            raise DifferentIds(f"{len(x) // 4} ids by the agenda, {len(own)} by the library, for a text of {len(t)} characters")


def encode_texts(texts: list[str | None], model_path: str, check: str = "stretches") -> tuple[list[np.ndarray], list[str]]:
    """(ids with begin and end, decoded text) of each text, checked against the library."""
    c = codec(model_path)
    if check not in ("", "texts", "stretches") or check == "stretches" and not c.words_apart:
        raise ValueError(f"this vocabulary can't be checked by {check}")
    begin, end = (np.array([k], dtype="<u4").tobytes() for k in (c.library.bos_id(), c.library.eos_id()))
    plain = [t or "" for t in texts]
    ids = [np.frombuffer(begin + x + end, dtype="<u4") for x in c.encode(plain, check == "stretches")]
    if check:
        step = 1 if check == "texts" else ONE_OF
        compare(c, plain[::step], [x.tobytes() for x in ids[::step]], ends=True)
    return ids, [c.library.decode(x.tolist()) for x in ids]


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", with_ids: bool = False, check: str = "stretches") -> DataFrame:
    """``key``, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 1):
                ids, decoded = encode_texts(part.column(1).to_pylist(), model_path, check)
                columns = [
                    part.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded], pa.string()),
                ]
                names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[key].dataType.simpleString()
    extra = ", ids array<int>, decoded string" if with_ids else ""
    return spread(docs.select(key, text)).mapInArrow(trimmed(run, "pieces"), f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}")
