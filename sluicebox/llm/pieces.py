"""SentencePiece encoding and decoding: batched Viterbi search in numpy.

New words are put into groups of equal length that advance together, position by position. Substrings are hashed from
prefix hashes and probe the sorted keys of the pieces; of all pieces that end at a position the one with the largest
path score wins, and its length is the backpointer.

The public model at hand is a byte-pair model, whose segmentation is not the one of the largest sum of piece scores.
The path score is therefore minus the number of neighbouring pieces that the merges would not have left apart. A
sequence of pieces is what the merges give exactly if no two neighbours are such a pair, so the best path has score
0, is unique for every prefix, and equals the library's encoding id for id.

Defined cases. Null and empty texts have no ids; decoding no ids gives an empty text, and null ids a null text.
Characters that no piece holds become their bytes. A text that holds U+2581, the mark for a space, reads back with
spaces in its place: `lossless` says so. Words of over 128 characters advance together too, the longest first, and
leave when they end. Words behind runs of several spaces, whose pieces share one score, which the path score can't
tell apart, take the exact merges with a heap, as would a word without a path. Other columns, also with null or
repeated ids, pass through.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import GOLDEN, U64, bound_batches, mix, slices, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BASE = U64(0x9DDFEA08EB382D69)
NEVER = np.int64(1 << 40)
#: Longer words advance with others of their kind, of at most so many characters in all; more cached words are forgotten.
LONG, CELLS, CACHE = 128, 1 << 18, 400_000
#: Units that no merge crosses: a line feed, a word with the spaces before it, spaces before a line feed or the end.
UNIT = re.compile(r"\n| *[^ \n]+| +")


def codes(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)


class Pieces:
    """The tables of a model: keys, ranks and merges of its pieces."""

    def __init__(self, model: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = library.get_piece_size()
        self.names = [library.id_to_piece(i) for i in range(n)]
        kinds = np.zeros(n, np.int8)  # 0: a piece of text, 1: a byte, 2: unknown, 3: control or unused
        for i in range(n):
            kinds[i] = 1 if library.is_byte(i) else 2 if library.is_unknown(i) else 3 if library.is_control(i) or library.is_unused(i) else 0
        self.kinds = kinds
        self.plain = {self.names[i]: i for i in range(n) if kinds[i] == 0}
        self.bytes = np.array([self.names.index(f"<0x{b:02X}>") for b in range(256)], np.int32)
        scores = np.array([library.get_score(i) for i in range(n)])
        # The rank of a piece is the order of its merge; equal scores have equal ranks.
        _, place = np.unique(-scores, return_inverse=True)
        self.rank = np.append(place.astype(np.int64), 0)
        # A pseudo-piece, the last, stands for a character that no piece holds.
        self.unknown = n
        self.left, self.right = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)
        self.alone = np.zeros(n + 1, bool)  # whether the merges make the piece of its own text
        for text, i in self.plain.items():
            made = self.merge(text, merges := [])
            self.alone[i] = made == [i]
            if len(text) == 1:
                self.rank[i] = -1
            elif self.alone[i]:
                self.left[i], self.right[i] = merges[-1]
        self.rank[n] = -1
        self.alone[n] = True
        self.longest = max(map(len, self.plain))
        crossing = [p for p in self.plain if "\n" in p or MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross words: {crossing[:3]}")
        self.powers = np.array([pow(int(BASE), k, 1 << 64) for k in range(self.longest * 2 + 1)], U64)
        self.sizes = np.array([len(x) for x in self.names] + [1])
        self.hashes = np.zeros(n + 1, U64)
        for text, i in self.plain.items():
            h = 0
            for c in text:
                h = (h * int(BASE) + ord(c) + 1) & (1 << 64) - 1
            self.hashes[i] = h
        ids = np.array(list(self.plain.values()), np.int32)
        spread = self.hashes[ids] * GOLDEN  # hashes of short pieces are small numbers
        order = np.argsort(spread)
        self.keys, self.key_ids = spread[order], ids[order]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a key")
        #: For the high 20 bits of a key where such keys begin among the sorted ones, and the most that share them.
        high = (self.keys >> U64(44)).astype(np.int64)
        self.begin = np.searchsorted(high, np.arange((1 << 20) + 1)).astype(np.int32)
        self.crowd = int(np.diff(self.begin).max())
        #: Pairs of pieces that were tested lately.
        self.seen_pair, self.seen_apart = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        out = [
            bytes([int(x[3:5], 16)]) if k == 1 else b" \xe2\x81\x87 " if k == 2 else b"" if k == 3 else x.replace(MARK, " ").encode()
            for x, k in zip(self.names, kinds)
        ]
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.out_sizes = np.array([len(x) for x in out])
        self.out_starts = np.cumsum(self.out_sizes) - self.out_sizes

    # ------------------------------------------------------------------ exact merges

    def merge(self, text: str, merges: list | None = None) -> list[int]:
        """The pieces that the merges give: best score first, of equal scores the leftmost. -1 - c: character c."""
        symbol, size = list(text), len(text)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < size:
                both = symbol[i] + symbol[after[i]]
                if both in self.plain:
                    heapq.heappush(heap, (int(self.rank_of(both)), i, both))

        for i in range(size - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i] if symbol[i] is not None else size
            if j >= size or symbol[i] + symbol[j] != both:
                continue
            if merges is not None:
                merges.append((self.plain.get(symbol[i], -1), self.plain.get(symbol[j], -1)))
            symbol[i], symbol[j] = both, None
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [self.plain.get(s, -1 - ord(s[0])) for s in symbol if s is not None]

    def rank_of(self, piece: str) -> int:
        """The order of a piece's merge, also while the tables are being made."""
        i = self.plain[piece]
        return int(self.rank[i]) if len(piece) > 1 else -1

    # ------------------------------------------------------------------ Viterbi

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each key, -1 where there is none."""
        out = np.full(hashes.shape, -1, np.int32)
        hashes = hashes * GOLDEN
        high = (hashes >> U64(44)).astype(np.int64)
        place, end = self.begin[high], self.begin[high + 1]
        at = np.flatnonzero(place < end)
        for _ in range(self.crowd):
            p = place[at]
            hit = self.keys[p] == hashes[at]
            out[at[hit]] = self.key_ids[p[hit]]
            at = at[~hit & (p + 1 < end[at])]
            if not len(at):
                break
            place[at] += 1
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave piece a and piece b apart where they are neighbours."""
        pair = a.astype(np.int64) << 32 | b
        slot = (mix(pair.view(U64)) >> U64(44)).astype(np.int64)
        ok = self.seen_apart[slot]
        new = np.flatnonzero(self.seen_pair[slot] != pair)
        if len(new):
            ok[new] = self._apart(a[new], b[new])
            self.seen_pair[slot[new]] = pair[new]
            self.seen_apart[slot[new]] = ok[new]
            # Of several pairs in one slot the last is kept; the flag must be that pair's.
            lost = self.seen_pair[slot[new]] != pair[new]
            self.seen_pair[slot[new[lost]]] = -1
        return ok

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The test itself: merges are undone from the last back.

        The two are joined if, at any time, the symbols on both sides of their border make a piece of an earlier
        rank than the merge that came next.
        """
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a != self.unknown) & (b != self.unknown))
        a, b = a[live], b[live]
        limit = np.full(len(live), NEVER)
        while len(live):
            joined = self.probe(self.hashes[a] * self.powers[self.sizes[b]] + self.hashes[b])
            bad = (joined >= 0) & (self.rank[joined] < limit)
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return ok

    def viterbi(self, points: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """The piece that ends at each position of the best path of each word, -1 inside a piece.

        The words are of one length; or of `sizes`, the longest first, and padded. A word without a path is -2.
        """
        n, size = points.shape
        sizes = np.full(n, size) if sizes is None else sizes
        going = np.searchsorted(-sizes, -np.arange(size + 1), "right")  # words of at least so many characters
        prefix = np.zeros((n, size + 1), U64)
        for j in range(size):
            prefix[:, j + 1] = prefix[:, j] * BASE + points[:, j] + U64(1)
        score = np.full((n, size + 1), -(1 << 20), np.int64)
        score[:, 0] = 0
        last = np.full((n, size + 1), -1, np.int32)
        for j in range(1, size + 1):
            k = int(going[j])
            lengths = np.arange(1, min(j, self.longest) + 1)
            hashes = prefix[:k, j, None] - prefix[:k, j - lengths] * self.powers[lengths]
            piece = self.probe(hashes.ravel()).reshape(k, len(lengths))
            piece[:, 0] = np.where(piece[:, 0] < 0, self.unknown, piece[:, 0])
            word, at = np.nonzero((piece >= 0) & self.alone[piece])
            found, begin = piece[word, at], j - lengths[at]
            previous = last[word, begin]
            fits = np.ones(len(word), bool)
            inner = np.flatnonzero(begin > 0)
            fits[inner] = self.apart(previous[inner], found[inner])
            path = np.full((k, len(lengths)), -(1 << 20), np.int64)
            path[word, at] = score[word, begin] - ~fits
            best = path.argmax(axis=1)
            rows = np.arange(k)
            score[:k, j], last[:k, j] = path[rows, best], piece[rows, best]
        ends = np.full((n, size), -1, np.int32)
        at, rows = sizes.copy(), np.arange(n)
        while len(rows):
            piece = last[rows, at]
            ends[rows, at - 1] = piece
            at = at - self.sizes[piece]
            rows, at = rows[at > 0], at[at > 0]
        ends[score[np.arange(n), sizes] != 0] = -2
        return ends

    def ids(self, pieces: list[int]) -> list[int]:
        """Pieces with characters beyond the model as their bytes."""
        out: list[int] = []
        for p in pieces:
            out += [int(self.bytes[b]) for b in chr(-1 - p).encode("utf-8", "surrogatepass")] if p < 0 else [p]
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words in any order, and for each word where its ids begin and how many they are.

        A word begins with the marks of its spaces.
        """
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        parts, total = [], 0

        def put(at, ids: np.ndarray, counts: np.ndarray) -> None:
            nonlocal total
            starts[at], sizes[at] = total + np.cumsum(counts) - counts, counts
            parts.append(ids.astype(np.int32))
            total += len(ids)

        def merged(at: list[int]) -> None:
            for i in at:
                found = np.array(self.ids(self.merge(words[i])), np.int32)
                put([i], found, np.array([len(found)]))

        def advance(group: np.ndarray, points: np.ndarray, lengths: np.ndarray | None = None) -> None:
            ends = self.viterbi(points, lengths)
            lost = ends[:, 0] == -2
            if lost.any():
                merged(group[lost].tolist())
                group, points, ends = group[~lost], points[~lost], ends[~lost]
            row, at = np.nonzero(ends >= 0)
            put(group, ends[row, at], np.bincount(row, minlength=len(group)))
            for k in np.flatnonzero((ends == self.unknown).any(axis=1)):
                made = [-1 - int(points[k, w]) if ends[k, w] == self.unknown else int(ends[k, w]) for w in np.flatnonzero(ends[k] >= 0)]
                found = np.array(self.ids(made), np.int32)
                put([group[k]], found, np.array([len(found)]))

        by_size: dict[int, list[int]] = {}
        long, spaced = [], []
        for i, w in enumerate(words):
            if w.startswith(MARK * 2):
                spaced.append(i)
            elif len(w) > LONG:
                long.append(i)
            else:
                by_size.setdefault(len(w), []).append(i)
        merged(spaced)
        for size, group in by_size.items():
            advance(np.array(group), codes("".join(words[i] for i in group)).reshape(len(group), size))
        long.sort(key=lambda i: -len(words[i]))
        while long:
            size = len(words[long[0]])
            group, long = long[: max(1, CELLS // size)], long[max(1, CELLS // size) :]
            padded = np.zeros((len(group), size), U64)
            lengths = np.array([len(words[i]) for i in group])
            for k, i in enumerate(group):
                padded[k, : lengths[k]] = codes(words[i])
            advance(np.array(group), padded, lengths)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), starts, sizes

    # ------------------------------------------------------------------ texts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of rows of ids: their pieces' bytes, without the space that encoding has put in front."""
        sizes = self.out_sizes[ids]
        total = int(sizes.sum())
        where = np.repeat(self.out_starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
        data = self.out[where]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        first = ends[:-1][counts > 0]
        first = first[first < total]
        drop = first[data[first] == 32]
        keep = np.ones(total, bool)
        keep[drop] = False
        ends = ends - np.searchsorted(drop, ends, "left")
        raw = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[keep].tobytes()))
        try:
            raw.validate(full=True)
            return raw
        except pa.ArrowInvalid:  # ids of any origin may not be UTF-8
            body = data[keep].tobytes()
            return pa.array([body[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], pa.large_string())


class Encoder:
    """Encodes texts, and remembers the ids of the words it has met."""

    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, and how many each has."""
        if len(self.code) > CACHE:
            self.forget()
        units = [UNIT.findall(" " + t) if t else [] for t in texts]
        number = np.fromiter(map(len, units), np.int64, len(units))
        flat = [w for u in units for w in u]
        del units
        code = self.code
        new = [w for w in set(flat) if w not in code]
        if new:
            made, starts, sizes = self.pieces.encode_words([w.replace(" ", MARK) for w in new])
            code.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
            self.starts, self.sizes = np.concatenate([self.starts, starts + len(self.pool)]), np.concatenate([self.sizes, sizes])
            self.pool = np.concatenate([self.pool, made])
        codes = np.fromiter(map(code.__getitem__, flat), np.int64, len(flat))
        lens = self.sizes[codes]
        total = np.concatenate([[0], np.cumsum(lens)])
        ids = self.pool[np.repeat(self.starts[codes] - total[:-1], lens) + np.arange(total[-1])]
        bounds = np.concatenate([[0], np.cumsum(number)])
        return ids.astype(np.int32), np.diff(total[bounds])


_encoders: dict[int, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    """One encoder for each model in a Python worker."""
    key = hash(model)
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))


def _encode(model, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            _, offsets = text_bytes(column)
            for a, b in slices(offsets, 2 << 20):
                part = column.slice(a, b - a)
                texts = [t or "" for t in part.to_pylist()]
                ids, counts = encoder.encode(texts)
                rest = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                names = [*batch.schema.names[:-1], "ids"]
                more = []
                if keep_text:
                    same = pc.equal(encoder.pieces.decode(ids, counts), pa.array(texts, pa.large_string()))
                    more, names = [pa.array(counts, pa.int64()), same], [*names, "n_tokens", "lossless"]
                yield pa.RecordBatch.from_arrays([*rest, _lists(ids, counts), *more], names=names)

    return run


def _decode(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _encoder(model.value).pieces
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = pieces.decode(ids, counts)
            texts = pc.if_else(pc.is_null(column), pa.scalar(None, pa.large_string()), texts).cast(pa.string())
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, texts], names=[*batch.schema.names[:-1], "text"])

    return run


def _fields(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*names).schema.fields)


def _model(docs: DataFrame, model: str):
    with open(model, "rb") as file:  # a file of the driver, below 1 MB; the tasks get its bytes
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, check: bool = True) -> DataFrame:
    """`docs` with ids in place of `text`; with `check` also n_tokens and lossless, whether they read back.

    Columns with the names of the results are replaced.
    """
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, "ids", "n_tokens", "lossless")]
    out = _fields(docs, kept) + "ids array<int>" + (", n_tokens long, lossless boolean" if check else "")
    return docs.select(*kept, F.col(text)).mapInArrow(_encode(_model(docs, model), check), out)


def decode(docs: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """`docs` with text in place of `ids`; a column named text is replaced."""
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (ids, "text")]
    return docs.select(*kept, F.col(ids)).mapInArrow(_decode(_model(docs, model)), _fields(docs, kept) + "text string")
