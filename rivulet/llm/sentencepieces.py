"""SentencePiece encoding and decoding, over batches of distinct words at once.

A text is cut into words (a run of the space mark and what follows it up to the next mark; no piece crosses such a cut, which
is checked when a model is read). Distinct words of equal length advance together: hashes of all their substrings probe the
sorted hashes of the pieces, and vectorised maxima over the start positions store backpointers (Viterbi). The best sum of scores is
what unigram models encode, and it is the default for all. The score of a piece in a BPE model is its rank in a list of merges, and
its own encoding merges the best pair of neighbours, leftmost first, until none is left; that is there beside it (algorithm=BPE),
on the same probes, for short words all at once and for long ones by a heap. What no piece covers falls back to bytes.

Texts are taken in slices of about a megabyte, whatever the sizes of their batches; the ids of words up to REMEMBERED_CHARS
characters are remembered, for at most REMEMBERED words or those of a slice.

Defined results: a null or empty text has no ids; repeated rows give repeated results; decode(encode(text)) is the text, byte by
byte, for models with byte fallback and an identity normaliser, but for the space mark U+2581 itself, which becomes a blank; a model
without byte pieces gives its unknown piece, which decodes to a blank and U+2047 as the reference library has it; a column that has
the name of the result is replaced, all others pass through whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, slices, with_made

SPACE = "▁"
#: What the unknown piece decodes to, fixed by the model format.
UNKNOWN_TEXT = " \u2047 "
#: Fixed numbers of the model format: piece kinds and model kinds.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Distinct words whose ids a worker remembers (and where little else is in memory), and how long they are at most. Beyond it those
#: of the last slice stay.
REMEMBERED, REMEMBERED_ALONE, REMEMBERED_CHARS = 50_000, 200_000, 64
#: Words up to which merges are found round by round for all words at once; longer ones go by a heap.
ROUNDS_CHARS = 48
_CHAR = U64(0x2545F4914F6CDD1D)
_SLOT_SHIFT = U64(44)


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if b[i - 1] < 128:
            return out, i


def _messages(b: bytes) -> list[tuple[int, object]]:
    """The fields of a protocol buffer: (number, value)."""
    out, i = [], 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 1:
            value, i = b[i : i + 8], i + 8
        elif kind == 5:
            value, i = b[i : i + 4], i + 4
        else:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        out.append((key >> 3, value))
    return out


@dataclass
class Model:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    algorithm: int = BPE
    dummy_prefix: bool = True
    unknown: int = 0
    byte_ids: np.ndarray | None = None
    keys: np.ndarray = field(init=False)
    key_ids: np.ndarray = field(init=False)
    slots: np.ndarray = field(init=False)
    crowd: int = field(init=False)
    ranked: np.ndarray = field(init=False, repr=False)
    longest: int = field(init=False)
    seen: dict = field(init=False, default_factory=dict)
    _raw: list | None = field(init=False, default=None, repr=False)

    def __post_init__(self):
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER) and self.pieces[i]]
        bad = [self.pieces[i] for i in usable if SPACE in self.pieces[i].lstrip(SPACE)]
        if bad:
            raise ValueError(f"pieces cross words: {bad[:3]}")
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        hashes = _hashes([self.pieces[i] for i in usable])
        order = np.argsort(hashes)
        self.keys, self.key_ids = hashes[order], np.array(usable, np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        slot, first, shared = np.unique(self.keys >> _SLOT_SHIFT, return_index=True, return_counts=True)
        self.slots = np.full(1 << 20, -1, np.int32)  # the first key of each value of the leading bits: most substrings are no pieces and stop here
        self.slots[slot.astype(np.int64)], self.crowd = first, int(shared.max(initial=0))
        self.ranked = np.append(np.asarray(self.scores, float), -np.inf)  # at -1, of no piece
        by_name = {p: i for i, p in enumerate(self.pieces)}
        if all(f"<0x{b:02X}>" in by_name for b in range(256)):
            self.byte_ids = np.array([by_name[f"<0x{b:02X}>"] for b in range(256)], np.int64)

    # --- probes -------------------------------------------------------------------------------------------------

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids by hash, -1 where there is none."""
        out = np.full(hashes.shape, -1, np.int32)
        at = self.slots[(hashes >> _SLOT_SHIFT).astype(np.int64)]
        maybe = np.flatnonzero(at >= 0)
        few, at = hashes.ravel()[maybe], at.ravel()[maybe]
        for _ in range(self.crowd):  # keys that share a slot follow each other
            found = self.keys[at] == few
            out.ravel()[maybe[found]] = self.key_ids[at[found]]
            at = np.minimum(at + 1, len(self.keys) - 1)
        return out

    def encode_words(self, words: list[str], algorithms: tuple[int, ...]) -> dict[str, tuple[bytes, ...]]:
        """The ids of distinct words by each algorithm, as 32-bit numbers in bytes; words of equal length are done together."""
        out: dict[str, tuple[bytes, ...]] = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, own in by_length.items():
            if not n:
                out[""] = (b"",) * len(algorithms)
                continue
            most = max(1, (1 << 20) // (n * min(n, self.longest)))
            for k in range(0, len(own), most):
                part = own[k : k + most]
                chars = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).reshape(len(part), n)
                table = self._table(chars)
                done = [self._viterbi(chars, table) if a == UNIGRAM else self._merges(chars, table) if n <= ROUNDS_CHARS else self._heap_merges(chars, table) for a in algorithms]
                out.update(zip(part, zip(*done, strict=True), strict=True))
        return out

    def _table(self, chars: np.ndarray) -> np.ndarray:
        """The piece at [length - 1, start, word], -1 where the substring is none or ends outside the word."""
        rows, n = chars.shape
        sums, down = np.ascontiguousarray(_prefix(chars).T), _down(n)
        out = np.full((min(n, self.longest), n, rows), -1, np.int32)
        for size in range(1, out.shape[0] + 1):
            h = (sums[size:] - sums[: n + 1 - size]) * down[: n + 1 - size, None]
            out[size - 1, : n + 1 - size] = self.probe(mix(h ^ (U64(size) << U64(40))))
        return out

    def _bytes_of(self, char: int) -> list[int]:
        return [self.unknown] if self.byte_ids is None else self.byte_ids[list(chr(char).encode("utf-8", "surrogatepass"))].tolist()

    def _viterbi(self, chars: np.ndarray, table: np.ndarray) -> list[bytes]:
        """best[e] is the best sum of scores of the first e characters; size[e] is the length of its last piece."""
        rows, n = chars.shape
        low = float(self.scores.min()) - 10.0  # of a character that no piece covers
        scores, some = self.ranked[table], (table >= 0).any(axis=2)
        best, size, every = np.zeros((n + 1, rows)), np.zeros((n + 1, rows), np.int64), np.arange(rows)
        for e in range(1, n + 1):
            best[e], size[e] = -np.inf, 1
            for k in range(min(e, len(table)), 0, -1):  # of equal sums the longest last piece
                if k > 1 and not some[k - 1, e - k]:
                    continue
                here = scores[k - 1, e - k]
                total = best[e - k] + (np.where(table[0, e - 1] >= 0, here, low) if k == 1 else here)
                more = total > best[e]
                np.copyto(best[e], total, where=more)
                np.copyto(size[e], k, where=more)
        ids = np.full((n, rows), -2, np.int32)  # filled from the end, -1 where a character goes by bytes
        starts = np.zeros((n, rows), np.int64)
        end = np.full(rows, n)
        for k in range(n - 1, -1, -1):
            last = size[end, every]
            starts[k] = end - last
            ids[k] = np.where(end > 0, table[np.maximum(last, 1) - 1, starts[k], every], -2)
            end = starts[k]
            if not end.any():
                break
        return self._flat(chars, ids.T, ids.T >= -1, starts.T)

    def _merges(self, chars: np.ndarray, table: np.ndarray) -> list[bytes]:
        """start[:, k] is where symbol k starts; each round merges the best neighbours of each word that has any, so that all words
        that are left have the same number of symbols. s and score are those of the words left and of their neighbours."""
        rows, n = chars.shape
        longest = len(table)

        def ids_of(row, a, b):
            size = b - a
            fits = (a < n) & (size > 0) & (size <= longest)
            return np.where(fits, table[np.clip(size, 1, longest) - 1, np.minimum(a, n - 1), row], -1)

        start = np.tile(np.arange(n + 1), (rows, 1))  # n beyond the last symbol
        live, s = np.arange(rows), start
        score = self.ranked[table[1, : n - 1].T] if longest > 1 else np.zeros((rows, 0))
        while len(live) and score.shape[1]:
            at = np.arange(len(live))
            top = score.argmax(axis=1)
            can = score[at, top] > -np.inf
            start[live[~can], : s.shape[1]] = s[~can]
            start[live[~can], s.shape[1] :] = n
            live, top, at, m = live[can], top[can], at[: np.count_nonzero(can)], score.shape[1]
            kept = np.ones((len(live), m + 2), bool)
            kept[at, top + 1] = False
            s = s[can][kept].reshape(len(live), m + 1)
            score = score[can][kept[:, 1:-1] if m > 1 else kept[:, :0]].reshape(len(live), m - 1)
            for on, k in ((top < m - 1, top), (top > 0, top - 1)):  # the merged symbol and its neighbours
                r, k = at[on], k[on]
                score[r, k] = self.ranked[ids_of(live[r], s[r, k], s[r, k + 2])]
        if len(live):
            start[live, : s.shape[1]] = s
            start[live, s.shape[1] :] = n
        ends = np.concatenate([start[:, 1:], np.full((rows, 1), n)], axis=1)
        return self._flat(chars, ids_of(np.arange(rows)[:, None], start, ends), start < n, start)

    def _heap_merges(self, chars: np.ndarray, table: np.ndarray) -> list[bytes]:
        """The same merges, word by word: a heap of neighbours by score and place, n log n in the length."""
        rows, n = chars.shape
        longest, out = len(table), np.full((rows, n + 1), n)
        for r in range(rows):
            own = np.ascontiguousarray(table[:, :, r].T)
            after, before = list(range(1, n + 2)), list(range(-1, n))  # starts of the symbols next to each
            end = list(range(1, n + 1))
            heap: list[tuple[float, int, int, int]] = []

            def offer(a, b):  # noqa: B023
                size = end[b] - a
                if size <= longest and own[a, size - 1] >= 0:
                    heapq.heappush(heap, (-self.scores[own[a, size - 1]], a, b, end[b]))

            for a in range(n - 1):
                offer(a, a + 1)
            gone = bytearray(n)
            while heap:
                _, a, b, stop = heapq.heappop(heap)
                if gone[a] or gone[b] or end[a] != b or end[b] != stop:
                    continue
                gone[b], end[a], after[a] = 1, stop, after[b]
                if after[a] < n:
                    before[after[a]] = a
                    offer(a, after[a])
                if before[a] >= 0:
                    offer(before[a], a)
            kept = [a for a in range(n) if not gone[a]]
            out[r, : len(kept)] = kept
        ends = np.minimum(np.concatenate([out[:, 1:], np.full((rows, 1), n)], axis=1), n)
        size = ends - out
        ids = np.where((out < n) & (size > 0) & (size <= longest), table[np.clip(size, 1, longest) - 1, np.minimum(out, n - 1), np.arange(rows)[:, None]], -1)
        return self._flat(chars, ids, out < n, out)

    def _flat(self, chars: np.ndarray, ids: np.ndarray, real: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The real ids of each row, those below 0 as the bytes of the character at their start."""
        gone = real & (ids < 0)
        if gone.any():  # a character of one byte is one id as well
            r, k = np.nonzero(gone)
            char = chars[r, starts[r, k]]
            one = char < 128
            ids, gone = np.array(ids), gone.copy()
            ids[r[one], k[one]] = self.unknown if self.byte_ids is None else self.byte_ids[char[one]]
            gone[r[one], k[one]] = False
        raw, ends = ids[real].astype("<i4").tobytes(), (4 * np.cumsum(real.sum(axis=1))).tolist()
        out = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for r in np.flatnonzero(gone.any(axis=1)).tolist():
            flat: list[int] = []
            for i, k in zip(ids[r][real[r]].tolist(), starts[r][real[r]].tolist(), strict=True):
                flat += [i] if i >= 0 else self._bytes_of(int(chars[r, k]))
            out[r] = np.array(flat, "<i4").tobytes()
        return out

    # --- texts --------------------------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", SPACE)
        return _WORDS.findall(SPACE + text if self.dummy_prefix else text)

    def encode(self, texts: list[str | None], algorithm: int = UNIGRAM) -> list[np.ndarray]:
        (out,) = self.encode_cut([self.words(t or "") for t in texts], (algorithm,))
        return out

    def encode_cut(self, cut_up: list[list[str]], algorithms: tuple[int, ...], remembered: int | None = None) -> list[list[np.ndarray]]:
        """The ids of texts that are cut into words, by each of the algorithms."""
        seen, words = self.seen.setdefault(algorithms, {}), set().union(*cut_up)
        new = words.difference(seen)
        if len(seen) + len(new) > (remembered or REMEMBERED):  # words that come again stay
            seen = self.seen[algorithms] = {w: seen[w] for w in words.intersection(seen)}
        seen.update(self.encode_words(list(new), algorithms))
        out: list[list[np.ndarray]] = [[] for _ in algorithms]
        for ws in cut_up:
            found = zip(*map(seen.__getitem__, ws), strict=True) if ws else [()] * len(algorithms)
            for ids, parts in zip(out, found, strict=True):
                ids.append(np.frombuffer(b"".join(parts), "<i4"))
        for w in new:
            if len(w) > REMEMBERED_CHARS:
                del seen[w]
        return out

    def decode(self, ids: np.ndarray) -> str:
        if self._raw is None:
            self._raw = [p.replace(SPACE, " ").encode("utf-8") if k in (NORMAL, USER) else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]
            if self._raw:
                self._raw[self.unknown] = UNKNOWN_TEXT.encode("utf-8")
            for b, i in enumerate(self.byte_ids if self.byte_ids is not None else ()):
                self._raw[int(i)] = bytes((b,))
        raw = self._raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _prefix(chars: np.ndarray) -> np.ndarray:
    """Sums of hashed characters times powers, so that a substring's hash is a difference times an inverse power."""
    n = chars.shape[1]
    up = np.cumprod(np.concatenate([[U64(1)], np.full(n, _CHAR)]).astype(U64), dtype=U64)
    out = np.zeros((chars.shape[0], n + 1), U64)
    np.cumsum(mix(chars.astype(U64) + U64(1)) * up[:n], axis=1, dtype=U64, out=out[:, 1:])
    return out


_CHAR_INVERSE = U64(pow(int(_CHAR), -1, 1 << 64))


def _down(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[U64(1)], np.full(n, _CHAR_INVERSE)]).astype(U64), dtype=U64)


def _span(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the characters a to b of each row, arrays of positions."""
    h = (np.take_along_axis(sums, b, axis=1) - np.take_along_axis(sums, a, axis=1)) * _down(sums.shape[1])[a]
    return mix(h ^ ((b - a).astype(U64) << U64(40)))


def _hashes(pieces: list[str]) -> np.ndarray:
    out = np.zeros(len(pieces), U64)
    size = np.array([len(p) for p in pieces])
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        chars = np.frombuffer("".join(pieces[i] for i in own).encode("utf-32-le"), np.uint32).reshape(len(own), n)
        out[own] = _span(_prefix(chars), np.zeros((len(own), 1), np.int64), np.full((len(own), 1), n))[:, 0]
    return out


def read_model(raw: bytes) -> Model:
    """A model from the bytes of its file."""
    pieces, scores, kinds, algorithm, dummy, unknown = [], [], [], UNIGRAM, True, 0
    for number, value in _messages(raw):
        if number == 1:
            f = dict(_messages(value))
            pieces.append(f.get(1, b"").decode("utf-8"))
            scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
            kinds.append(f.get(3, NORMAL))
        elif number == 2:
            f = dict(_messages(value))
            algorithm, unknown = f.get(3, UNIGRAM), f.get(40, 0)
        elif number == 3:
            f = dict(_messages(value))
            dummy = bool(f.get(3, 1))
            if f.get(1, b"identity") not in (b"identity", b"") or f.get(4, 1) or not f.get(5, 1):
                raise ValueError("only models with an identity normaliser that keep all white space are read")
    return Model(pieces, np.array(scores), np.array(kinds), algorithm, dummy, unknown)


# --- columns ----------------------------------------------------------------------------------------------------

_models: dict[str, Model] = {}


def _model_of(raw: bytes) -> Model:
    key = hashlib.sha1(raw).hexdigest()
    if key not in _models:
        _models[key] = read_model(raw)
    return _models[key]


def _load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", *, algorithm: int = UNIGRAM) -> DataFrame:
    """df with the ids of its texts (array<int>). The model file is read once, on the driver; its bytes go along with the task."""
    raw = _load(model_path)

    def make(texts: pa.Array) -> list[pa.Array]:
        ids = _model_of(raw).encode(texts.to_pylist(), algorithm)
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]

    return with_made(df, text_col, make, [(ids_col, "array<int>")])


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the texts of its ids; null ids give an empty text."""
    raw = _load(model_path)

    def make(ids: pa.Array) -> list[pa.Array]:
        model = _model_of(raw)
        return [pa.array([model.decode(np.array(x or [], np.int64)) for x in ids.to_pylist()], pa.string())]

    return with_made(df, ids_col, make, [(text_col, "string")])


SUMMARY = "id {kind}, n_ids bigint, ids_sha256 string, n_merged bigint, merged_sha256 string, same boolean"


def summary(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_ids, ids_sha256, n_merged, merged_sha256, same) for each row: the ids with the best sum of scores by Viterbi, those by
    merges over the same pieces, and whether both decode to the text. Ids are hashed as 32-bit numbers, low byte first."""
    raw = _load(model_path)

    def digest(ids):
        return hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()

    def run(batches):
        model = _model_of(raw)
        for b in batches:
            for part in slices(b, "text", most_rows=500):
                texts = part.column("text").to_pylist()
                words = [model.words(t or "") for t in texts]
                best, merged = model.encode_cut(words, (UNIGRAM, BPE), REMEMBERED_ALONE)
                same = [model.decode(x) == (t or "") == model.decode(y) for t, x, y in zip(texts, best, merged, strict=True)]
                cols = [part.column("id"), pa.array([len(x) for x in best], pa.int64()), pa.array([digest(x) for x in best], pa.string()), pa.array([len(x) for x in merged], pa.int64()), pa.array([digest(x) for x in merged], pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_ids", "ids_sha256", "n_merged", "merged_sha256", "same"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SUMMARY.format(kind=dict(df.dtypes)[id_col]))
