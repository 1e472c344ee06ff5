"""SentencePiece encoding and decoding (BPE models with byte fallback) by suffix-array matching."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from samplery.llm.common import col, quoted
from samplery.shipping import map_arrow

#: A public vocabulary; any other model's path may be given.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Characters that one suffix array indexes, and different segments that a worker remembers.
INDEX_CHARS, SEGMENTS = 1 << 16, 500_000
#: Segments up to this length are relaxed side by side and remembered; longer ones are relaxed by themselves.
SHORT = 40
#: Remembered pairs of neighbours, a power of two; a pair that shares a slot with a later one is tried again.
PAIR_SLOTS = 1 << 20
_NORMAL, _CONTROL, _BYTE = 1, 3, 6
#: Separates segments among code points: the first number that is none.
_END = 0x110000


@dataclass
class PieceModel:
    """What encoding needs of a model file, plain and small enough to broadcast (a vocabulary's size)."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    prefix: bool
    unknown: int
    digest: str = field(init=False)

    def __post_init__(self) -> None:
        """The digest stands for the whole vocabulary: workers keep encoders by it."""
        self.digest = hashlib.md5(repr((self.pieces, self.scores, self.kinds, self.prefix, self.unknown)).encode("utf-8", "surrogatepass")).hexdigest()

    @staticmethod
    def load(path: str = MODEL) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        trainer, rules = model.trainer_spec, model.normalizer_spec
        if trainer.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only BPE models that leave characters as they are and keep white space are supported")
        kinds = [p.type for p in model.pieces]
        if set(kinds) - {1, 2, 3, 6}:
            raise ValueError("user-defined and unused pieces are not supported")
        return PieceModel([p.piece for p in model.pieces], [p.score for p in model.pieces], kinds, rules.add_dummy_prefix, kinds.index(2))


class Encoder:
    """Encodes batches of texts.

    Texts are cut into segments that no merge can join. The different segments that a worker does not yet remember
    are indexed together, by a suffix array over their concatenation; all others are looked up, so most of a text is.

    BPE merges pairs by score, so not every path through the pieces that match a text is its encoding. But a path is
    the encoding exactly if each two neighbouring pieces are the encoding of their own concatenation: merges on one
    side of a boundary that is never merged across do not depend on the other side. So each prefix of a segment has
    one last piece, and one pass over the matches in the order of their starts finds it.
    """

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.score = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds, strict=True) if k == _NORMAL}
        self.size = len(model.pieces)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == _BYTE}
        normal = [i for i, k in enumerate(model.kinds) if k == _NORMAL]
        chars = sorted(set("".join(model.pieces[i] for i in normal)))
        self.code = np.zeros(_END + 1, np.uint16)  # 0: in no piece
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.single = np.zeros(_END + 1, bool)
        self.single[[ord(model.pieces[i]) for i in normal if len(model.pieces[i]) == 1]] = True
        reach = np.array([i for i in normal if len(model.pieces[i]) == 1 or self.merge(model.pieces[i]) == [model.pieces[i]]])
        self.ids, self.lengths = reach, np.array([len(model.pieces[i]) for i in reach])
        self.columns = -(-int(self.lengths.max()) // 4)
        low = np.zeros((self.columns, len(reach)), np.uint64)
        high = np.zeros((self.columns, len(reach)), np.uint64)
        for n, i in enumerate(reach):
            codes = self.code[[ord(c) for c in model.pieces[i]]]
            for k in range(4 * self.columns):
                shift = np.uint64(48 - 16 * (k % 4))
                low[k // 4, n] |= np.uint64(codes[k] if k < len(codes) else 0) << shift
                high[k // 4, n] |= np.uint64(codes[k] if k < len(codes) else 0xFFFF) << shift
        self.low, self.high = low, high
        splits = all(BLANK not in model.pieces[i].lstrip(BLANK) for i in normal)
        alone = "\n" if "\n" not in chars else ""
        self.segment = re.compile(rf"{alone}| +[^ {alone}]*|[^ {alone}]+" if alone and splits else r" +[^ ]*|[^ ]+" if splits else r"(?s).+")
        self.pair_key, self.pair_fits = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        self.place: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])

    def merge(self, text: str, apart: int = 0) -> list[str] | None:
        """Plain BPE of a short string: the best-scored neighbours merge first, the leftmost of equal ones. None as soon as parts merge across the place ``apart``, if that is not 0."""
        parts, none, of = list(text), float("-inf"), self.score.get
        scores = [of(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) != none:
            at = scores.index(best)
            if at == apart - 1:
                return None
            apart -= at < apart
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = of(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = of(parts[at] + parts[at + 1], none)
        return parts

    def text_of(self, piece: int) -> str:
        return self.model.pieces[piece] if piece < self.size else chr(piece - self.size)

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which pairs of pieces are the encoding of their concatenation."""
        key = left.astype(np.int64) * (self.size + _END) + right
        slot = (key * 0x9E3779B1 >> 7) & (PAIR_SLOTS - 1)
        out = self.pair_fits[slot]
        at = np.flatnonzero(self.pair_key[slot] != key)
        if len(at):
            _, first, which = np.unique(key[at], return_index=True, return_inverse=True)
            new = np.zeros(len(first), bool)
            for k, n in enumerate(at[first].tolist()):
                a, b = self.text_of(int(left[n])), self.text_of(int(right[n]))
                new[k] = self.merge(a + b, len(a)) == [a, b]
            out[at] = new[which]
            self.pair_key[slot[at]], self.pair_fits[slot[at]] = key[at], out[at]
        return out

    def matches(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of every occurrence of every piece in a text of code points (``_END`` separates segments), by start.

        The suffix array sorts suffixes by as many characters as the longest piece has; a piece's occurrences are the
        range of suffixes that begin with it, found by binary search, four characters at a time.
        """
        n = len(points)
        codes = np.zeros(n + 4 * self.columns + 4, np.uint64)
        codes[:n] = self.code[points]
        four = (codes[:-3] << np.uint64(48)) | (codes[1:-2] << np.uint64(32)) | (codes[2:-1] << np.uint64(16)) | codes[3:]
        suffixes = np.lexsort([four[4 * k : 4 * k + n] for k in reversed(range(self.columns))])
        lo, hi, own = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), n), np.arange(len(self.ids))
        for k in range(self.columns):
            column = four[suffixes + 4 * k]
            go = np.flatnonzero(self.lengths[own] > 4 * k)
            if k == 0:
                a, b = np.searchsorted(column, self.low[0, own], "left"), np.searchsorted(column, self.high[0, own], "right")
            else:
                a, b = lo.copy(), hi.copy()
                a[go] = _bisect(column, self.low[k, own[go]], lo[go], hi[go], False)
                b[go] = _bisect(column, self.high[k, own[go]], lo[go], hi[go], True)
            some = b > a
            lo, hi, own = a[some], b[some], own[some]
        count = hi - lo
        start = suffixes[np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))]
        length, piece = np.repeat(self.lengths[own], count), np.repeat(self.ids[own], count)
        bare = np.flatnonzero(~self.single[points] & (points != _END))  # characters that are no piece
        start, length, piece = np.r_[start, bare], np.r_[length, np.ones(len(bare), np.int64)], np.r_[piece, self.size + points[bare].astype(np.int64)]
        return start, length, piece

    def relax(self, points: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last piece and its length of every prefix of every segment, at the place after it; -1 where a segment begins.

        Edges are sorted by their place in their segment, and a step relaxes those of one place of all segments.
        """
        last, step = np.full(len(points) + 1, -1, np.int32), np.zeros(len(points) + 1, np.int32)
        start, length, piece = self.matches(points)
        offset = start - np.repeat(begins, sizes + 1)[start]
        order = np.argsort(offset.astype(np.uint16), kind="stable")
        start, length, piece = start[order], length[order], piece[order]
        ends = np.cumsum(np.bincount(offset))
        for lo, hi in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            at, n, p = start[lo:hi], length[lo:hi], piece[lo:hi]
            if lo:
                own = np.flatnonzero(self.fits(last[at], p))
                at, n, p = at[own], n[own], p[own]
            last[at + n], step[at + n] = p, n
        return last, step

    def relax_long(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``relax`` of one segment of any length: its matches are found in windows that overlap by the longest piece, so that only one window's edges are held."""
        last, step = np.full(len(points) + 1, -1, np.int32), np.zeros(len(points) + 1, np.int32)
        longest, known, base = int(self.lengths.max()), {}, self.size + _END
        for lo in range(0, len(points), INDEX_CHARS):
            start, length, piece = self.matches(points[lo : lo + INDEX_CHARS + longest - 1])
            own = np.flatnonzero((start < INDEX_CHARS) & (start + length <= len(points) - lo))
            own = own[np.argsort(start[own], kind="stable")]
            open_ = array("i", last[lo : lo + INDEX_CHARS + longest].tobytes())  # -1: not reached
            for i, n, p in zip(start[own].tolist(), length[own].tolist(), piece[own].tolist(), strict=True):
                if open_[i + n] != -1:
                    continue
                if lo + i:
                    key = open_[i] * base + p
                    ok = known.get(key)
                    if ok is None:
                        if len(known) > PAIR_SLOTS:
                            known.clear()
                        ok = known[key] = bool(self.fits(np.array([open_[i]]), np.array([p]))[0])
                    if not ok:
                        continue
                open_[i + n] = p
                step[lo + i + n] = n
            last[lo : lo + len(open_)] = np.frombuffer(open_, np.int32)
        return last, step

    def ids_of(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in order, characters without a piece as their bytes, and how many each piece gives."""
        bare = np.flatnonzero(pieces >= self.size)
        count = np.ones(len(pieces), np.int64)
        if not len(bare):
            return pieces, count
        parts = [[self.bytes[b] for b in chr(p - self.size).encode("utf-8", "surrogatepass")] if self.bytes else [self.model.unknown] for p in pieces[bare].tolist()]
        count[bare] = [len(x) for x in parts]
        out = np.repeat(pieces, count)
        at = np.repeat(np.cumsum(count)[bare] - count[bare], count[bare])
        out[at + np.concatenate([np.arange(len(x)) for x in parts])] = np.concatenate(parts)
        return out, count

    def learn(self, segments: list[str]) -> None:
        """Encodes segments (their blanks still spaces, which keeps them small) and remembers their ids."""
        points = np.frombuffer((" ".join(segments) + " ").replace(" ", BLANK).encode("utf-32-le", "surrogatepass"), "<u4").copy()
        sizes = np.array([len(s) for s in segments])
        ends = np.cumsum(sizes + 1) - 1
        begins = ends - sizes
        points[ends] = _END
        last, step = self.relax_long(points[:-1]) if len(segments) == 1 and sizes[0] > SHORT else self.relax(points, begins, sizes)
        # back along the pieces of all segments at once
        on = np.zeros(len(points) + 1, bool)
        at, begin = ends, begins
        while len(at):
            on[at] = True
            at = at - step[at]
            more = at > begin
            at, begin = at[more], begin[more]
        ids, count = self.ids_of(last[: len(points)][on[: len(points)]])
        held = np.zeros(len(points), np.int64)
        held[on[: len(points)]] = count
        before = self.ends[-1]
        self.place.update(zip(segments, range(len(self.ends) - 1, len(self.ends) - 1 + len(segments)), strict=True))
        self.flat.frombytes(ids.astype(np.int32).tobytes())
        self.ends.frombytes((before + np.cumsum(held)[ends]).astype(np.int64).tobytes())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Segments are parts that no merge can join; different ones are matched once."""
        cut = [self.segment.findall((" " * self.model.prefix + t.replace(BLANK, " ")) if t else "") for t in texts]
        if len(self.place) > SEGMENTS:
            self.place, self.flat, self.ends = {}, array("i"), array("q", [0])
        new, long, held = [], [], 0
        for s in set().union(*cut).difference(self.place):
            if len(s) > SHORT:
                long.append(s)
                continue
            new.append(s)
            held += len(s) + 1
            if held >= INDEX_CHARS:
                self.learn(new)
                new, held = [], 0
        if new:
            self.learn(new)
        known = len(self.flat), len(self.ends)
        for s in long:
            self.learn([s])
        flat, ends = np.frombuffer(self.flat, np.int32), np.frombuffer(self.ends, np.int64)
        out = []
        for segments in cut:
            at = np.fromiter(map(self.place.__getitem__, segments), np.int64, len(segments))
            count = ends[at + 1] - ends[at]
            before = np.cumsum(count) - count
            out.append(flat[np.repeat(ends[at] - before, count) + np.arange(int(count.sum()))])
        del flat, ends
        for s in long:  # long segments hardly come back
            del self.place[s]
        del self.flat[known[0] :], self.ends[known[1] :]
        return out


def _bisect(column: np.ndarray, value: np.ndarray, lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
    """For each value the first place in [lo, hi) of the column, sorted there, that is not below it (``after``: that is above it)."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        x = column[np.minimum(mid, len(column) - 1)]
        right = open_ & ((x <= value) if after else (x < value))
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo


class Decoder:
    def __init__(self, model: PieceModel) -> None:
        self.bytes = [bytes([int(p[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else p.replace(BLANK, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.prefix = model.prefix

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_encoders: dict[str, Encoder] = {}


def _encoder(model: PieceModel) -> Encoder:
    """One for each worker process and vocabulary, kept between its tasks."""
    if model.digest not in _encoders:
        _encoders.clear()
        _encoders[model.digest] = Encoder(model)
    return _encoders[model.digest]


def _parts(column: pa.Array, limit: int = 1 << 21) -> Iterator[list[str | None]]:
    """Texts by a few MB at a time."""
    part, held = [], 0
    for x in column:
        part.append(x.as_py())
        held += len(part[-1] or "")
        if held >= limit:
            yield part
            part, held = [], 0
    if part:
        yield part


def _schema(df: DataFrame, rest: list[str], added: str) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in rest], *T.StructType.fromDDL(added).fields])


def encode(docs: DataFrame, model: PieceModel, text_col: str = "text", out_col: str = "piece_ids") -> DataFrame:
    """``docs`` without the text and with ``out_col`` (array of int).

    Nulls: a null text has null ids, an empty one none. Equal rows get equal ids. No documents: no rows. Other columns
    pass through, but for one named as ``out_col``, which is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != text_col and c.lower() != out_col.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared.value)
        for b in batches:
            done = 0
            for texts in _parts(b.column(text_col)):
                ids = own.encode([t or "" for t in texts])
                ends = np.r_[0, np.cumsum([len(x) for x in ids])]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.r_[[t is None for t in texts], False]), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                part = b.slice(done, len(texts))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in rest], lists], [*rest, out_col])
                done += len(texts)

    return map_arrow(docs, run, _schema(docs, rest, f"{quoted(out_col)} array<int>"))


def decode(encoded: DataFrame, model: PieceModel, ids_col: str = "piece_ids", out_col: str = "text") -> DataFrame:
    """``encoded`` without the ids and with ``out_col``; null ids give a null text. A column named as ``out_col`` is replaced."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in encoded.columns if c != ids_col and c.lower() != out_col.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Decoder(shared.value)
        for b in batches:
            texts = [None if not x.is_valid else own.decode(x.as_py()) for x in b.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(texts, pa.string())], [*rest, out_col])

    return map_arrow(encoded, run, _schema(encoded, rest, f"{quoted(out_col)} string"))


def round_trips(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_pieces``, ``ids_md5`` (of the ids as 32-bit little-endian numbers) and ``exact`` (decoding gives the text again) for every whole text.

    Text that holds the blank mark U+2581 itself decodes to a space there, as the model defines it; that counts as
    exact. Nulls: a null text has null digests and is exact.
    """
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, back = _encoder(shared.value), Decoder(shared.value)
        for b in batches:
            done = 0
            for texts in _parts(b.column("text")):
                ids = own.encode([t or "" for t in texts])
                digest = [None if t is None else hashlib.md5(x.astype("<i4").tobytes()).hexdigest() for t, x in zip(texts, ids, strict=True)]
                exact = [t is None or back.decode(x.tolist()) == t.replace(BLANK, " ") for t, x in zip(texts, ids, strict=True)]
                columns = [b.column("doc_id").slice(done, len(texts)), pa.array([None if t is None else len(x) for t, x in zip(texts, ids, strict=True)], pa.int64()), pa.array(digest, pa.string()), pa.array(exact)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_pieces", "ids_md5", "exact"])
                done += len(texts)

    return map_arrow(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_pieces long, ids_md5 string, exact boolean")
