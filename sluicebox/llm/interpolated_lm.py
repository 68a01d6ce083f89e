"""Language-model scoring by deleted interpolation.

P(w | h) = a2 f(w | h) + a1 f(w) + a0 / (V + 1), where f are maximum-likelihood estimates of the training counts and
the weights a depend on the bucket of the context's count. The weights are learned by expectation-maximisation on
held-out counts: every training token is held out once, with its own occurrence deleted from the counts.

Texts are read in chunks of bounded size. A chunk sends the distinct words and word pairs it holds to the parts of a
hash space, as one compressed run of sorted keys for each part; a part sums the training counts of its keys and
answers every chunk with the counts of just the keys that it asked for. Then a chunk knows all counts that its tokens
need. Neither a vocabulary nor a table of pairs is ever in one place, and nothing is pruned. The number of parts follows
that of the chunks, so a part stays of one size, and runs without a key are not sent, so there are never more runs than keys.

Defined cases. Null and empty texts hold only the end token. Without training rows N and V are 0 and all of a token's
probability is 1 / (V + 1); the base score's formula gives log10(1) = 0 for each token. Repeated rows count as often
as they occur. A null doc_id belongs to the training part. Words and pairs are told apart by 64-bit hashes. Columns of
any name pass through; those with the names of the results are replaced.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import GOLDEN, LOWER, U64, bound_batches, fresh, mix, slices, stage_bucketed, text_bytes, words_of

#: The bytes of text in a chunk, and of text whose keys are in a part.
CHUNK_BYTES, PART_BYTES = 6 << 20, 16 << 20
#: Fixed hashes of the end token and of the context before the first word: they stand for no word.
END, START = U64(0x5E4D), U64(0x57A7)
#: Contexts are put into buckets by the power of two of their count; the last takes all larger ones.
BUCKETS = 24
#: Estimates are put into steps of a quarter of a power of two for the EM; the steps bound its table.
STEP = 4
LOWEST = 40 * STEP

ASK = "chunk long, part int, keys binary, n_keys int, counts binary"
ANSWER = "chunk long, part int, counts binary, n_keys int, tokens long, types long"
#: The chunk that stands for the parts' totals.
TOTALS = -1


# --------------------------------------------------------------------------- compact columns


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes: empty high planes are left out, which suits small numbers."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    used = 8
    while used and not planes[used - 1].any():
        used -= 1
    return bytes([used]) + planes[:used].tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    """The numbers that `pack` has packed."""
    used = data[0]
    out = np.zeros((8, n), np.uint8)
    out[:used] = np.frombuffer(data, np.uint8, used * n, 1).reshape(used, n)
    return np.ascontiguousarray(out.T).view("<u8").reshape(n).astype(U64)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return pack(np.diff(keys, prepend=U64(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n), dtype=U64)


# --------------------------------------------------------------------------- tokens


def tokens_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of some rows, every row closed by the end token, and the tokens of each row.

    Words are hashed slice by slice: the arrays by byte are what takes memory.
    """
    parts = [words_of(LOWER[raw[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, 1 << 20)]
    hashes, counts = (np.concatenate(x) for x in zip(*parts))
    out = np.empty(len(hashes) + len(counts), U64)
    ends = np.cumsum(counts + 1) - 1
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word] = hashes
    out[ends] = END
    return out, counts + 1


class Chunk:
    """Some documents: columns without text, the tokens of each row, and the distinct words, frequent ones first.

    The start context is a word of each row, so that its count is there like any other's.
    """

    def __init__(self, rest: pa.RecordBatch, sizes: np.ndarray, words: np.ndarray, word_at: np.ndarray):
        self.rest, self.sizes, self.words, self.word_at = rest, sizes, words, word_at
        self.train = rest.column(rest.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
        self.taught = np.repeat(self.train, sizes)
        self.firsts = np.cumsum(sizes) - sizes
        self.before_at = np.empty(len(word_at), np.int64)
        self.before_at[1:] = word_at[:-1]
        self.before_at[self.firsts] = len(words) - 1  # START is kept last
        self.order = np.argsort(words, kind="stable")
        keys = mix(words[self.before_at] * GOLDEN + words[word_at])
        self.pairs, self.pair_at = np.unique(keys, return_inverse=True)

    @classmethod
    def of(cls, rest: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray) -> Chunk:
        tokens, sizes = tokens_of(raw, offsets)
        words, place, times = np.unique(tokens, return_inverse=True, return_counts=True)
        rank = np.argsort(-times, kind="stable")
        to = np.empty(len(words), np.int64)
        to[rank] = np.arange(len(words))
        return cls(rest, sizes, np.append(words[rank], START), to[place])

    def body(self) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.rest.schema) as writer:
            writer.write_batch(self.rest)
        # Words of equal frequency are in the order of their keys, so all but few differences are small.
        parts = [sink.getvalue().to_pybytes(), pack(self.sizes), pack(self.word_at), pack_sorted(self.words)]
        head = np.array([len(self.sizes), len(self.word_at), len(self.words), *map(len, parts)], "<i8").tobytes()
        return head + zlib.compress(b"".join(parts), 1)

    @classmethod
    def read(cls, body: bytes) -> Chunk:
        rows, tokens, words, *lens = (int(x) for x in np.frombuffer(body, "<i8", 7))
        plain = zlib.decompress(body[56:])
        a, b, c, d = np.cumsum(lens).tolist()
        rest = pa.ipc.open_stream(plain[:a]).read_all().combine_chunks().to_batches()[0]
        return cls(rest, unpack(plain[a:b], rows).astype(np.int64), unpack_sorted(plain[c:d], words), unpack(plain[b:c], tokens).astype(np.int64))

    def word_counts(self) -> np.ndarray:
        """Training counts of the words in the order of their keys."""
        out = np.bincount(self.word_at, self.taught, len(self.words))
        out[-1] = self.train.sum()
        return out[self.order].astype(U64)

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair_at, self.taught, len(self.pairs)).astype(U64)


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows gathered up to `size` bytes of text: the rows without text, their bytes and offsets.

    The columns are: any, then `train`, then `text`.
    """
    held: list[pa.RecordBatch] = []
    held_bytes = 0

    def join() -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        raw, offsets = text_bytes(table.column(table.num_columns - 1))
        rest = table.select(range(table.num_columns - 1)).to_batches()
        return rest[0], raw, offsets

    for batch in batches:
        raw, offsets = text_bytes(batch.column(batch.num_columns - 1))
        first = 0
        while first < batch.num_rows:
            room = max(0, size - held_bytes)
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + room, "right")) - 1)
            last = min(last, batch.num_rows)
            held.append(batch.slice(first, last - first))
            held_bytes += int(offsets[last] - offsets[first])
            first = last
            if held_bytes >= size or first < batch.num_rows:
                yield join()
                held, held_bytes = [], 0
    if held and sum(b.num_rows for b in held):
        yield join()


def _chunk(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, raw, offsets in chunks(batches, size):
            name = int.from_bytes(os.urandom(8), "little") >> 1
            body = Chunk.of(rest, raw, offsets).body()
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([body], pa.binary())], names=["chunk", "body"])

    return run


def _ask(parts: int):
    """For each chunk its sorted word keys and pair keys with their training counts, cut into parts; none is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([p * (1 << 64) // parts for p in range(1, parts)], U64)
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunk, rows = Chunk.read(body.as_py()), []
                asked = (chunk.words[chunk.order], chunk.word_counts()), (chunk.pairs, chunk.pair_counts())
                for kind, (keys, counts) in enumerate(asked):
                    edges = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
                    for p in np.flatnonzero(np.diff(edges)).tolist():
                        a, b = edges[p], edges[p + 1]
                        rows.append((name, 2 * p + kind, pack_sorted(keys[a:b]), b - a, pack(counts[a:b])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()))],
                    names=["chunk", "part", "keys", "n_keys", "counts"],
                )

    return run


def _answer(table: pa.Table) -> pa.Table:
    """The training counts of a part, for each chunk those of its own keys in order; for a part of words its totals too."""
    sizes, part = table.column("n_keys").to_pylist(), table.column("part")[0].as_py()
    keys = [unpack_sorted(k, n) for k, n in zip(table.column("keys").to_pylist(), sizes)]
    counts = [unpack(c, n) for c, n in zip(table.column("counts").to_pylist(), sizes)]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts).astype(np.float64), len(every)).astype(U64)
    rows = [(c, part, pack(a), n, 0, 0) for c, a, n in zip(table.column("chunk").to_pylist(), np.split(total[place], np.cumsum(sizes)[:-1]), sizes)]
    if part % 2 == 0:
        real = every != START
        rows.append((TOTALS, part, b"", 0, int(total[real].sum()), int((total[real] > 0).sum())))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["chunk", "part", "counts", "n_keys", "tokens", "types"])


class Counted:
    """A chunk with the training counts of its tokens, contexts and pairs."""

    def __init__(self, body: bytes, answers: list[tuple], totals: tuple[int, int]):
        chunk = Chunk.read(body)
        self.rest, self.sizes, self.firsts, self.taught, self.rows = chunk.rest, chunk.sizes, chunk.firsts, chunk.taught, len(chunk.sizes)
        answers = sorted(answers)
        sums = [np.concatenate([unpack(c, n) for p, c, n in answers if p % 2 == kind]).astype(np.int64) for kind in (0, 1)]
        self.n, self.v = totals
        words = np.empty(len(chunk.words), np.int64)
        words[chunk.order] = sums[0]
        self.word, self.context, self.pair = words[chunk.word_at], words[chunk.before_at], sums[1][chunk.pair_at]


def bucket_of(context: np.ndarray) -> np.ndarray:
    """The bucket of a context's count: 0 for an unseen one, else 1 + the power of two below it."""
    return np.where(context > 0, np.minimum(1 + np.floor(np.log2(np.maximum(context, 1))), BUCKETS - 1), 0).astype(np.int64)


def step_of(estimate: np.ndarray) -> np.ndarray:
    """The step of an estimate; 0 is for zero."""
    with np.errstate(divide="ignore"):
        step = np.rint(-np.log2(estimate) * STEP)
    return np.where(estimate > 0, 1 + np.minimum(step, LOWEST - 2), 0).astype(np.int64)


def deleted(counted: Counted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, and the steps of both estimates, of each training token with its own occurrence deleted."""
    taught = counted.taught
    word, context, pair = counted.word[taught] - 1, counted.context[taught] - 1, counted.pair[taught] - 1
    f2 = pair / np.maximum(context, 1)
    f1 = word / max(1, counted.n - 1)
    return bucket_of(context), step_of(f2), step_of(f1)


def _held(totals: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counted in read(batch, totals):
                bucket, s2, s1 = deleted(counted)
                cell, n = np.unique((bucket * LOWEST + s2) * LOWEST + s1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (cell, n)], names=["cell", "n"])

    return run


def weights(cells: np.ndarray, n: np.ndarray, types: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (a2, a1, a0) of each bucket by expectation-maximisation on held-out counts.

    A bucket without held-out tokens takes the weights of the next smaller one. A context that was never seen has
    no pair estimate, so its first weight goes to the other two in their proportion.
    """
    out = np.tile(np.array([0.5, 0.4, 0.1]), (BUCKETS, 1))
    bucket, s2, s1 = cells // LOWEST**2, cells // LOWEST % LOWEST, cells % LOWEST
    floor = 1.0 / (types + 1)
    estimates = np.stack(
        [np.where(s > 0, 2.0 ** (-(s - 1) / STEP), 0.0) for s in (s2, s1)] + [np.full(len(cells), floor)], axis=1
    )
    for b in range(BUCKETS):
        here = bucket == b
        if not here.any():
            out[b] = out[b - 1] if b else out[b]
            continue
        f, count, a = estimates[here], n[here].astype(float), np.array([0.5, 0.4, 0.1])
        for _ in range(rounds):
            share = f * a
            share /= share.sum(axis=1, keepdims=True)
            a = (share * count[:, None]).sum(axis=0) / count.sum()
            a = np.maximum(a, 1e-6)
            a /= a.sum()
        out[b] = a
    out[0] = np.array([0.0, out[0][1], out[0][2]]) / (out[0][1] + out[0][2])
    return out


def token_probability(counted: Counted, mixture: np.ndarray) -> np.ndarray:
    """The interpolated probability of every token."""
    a = mixture[bucket_of(counted.context)]
    f2 = np.where(counted.context > 0, counted.pair / np.maximum(counted.context, 1), 0.0)
    f1 = counted.word / counted.n if counted.n else np.zeros(len(counted.word))
    if not counted.n:
        return np.full(len(counted.word), 1.0 / (counted.v + 1))
    return a[:, 0] * f2 + a[:, 1] * f1 + a[:, 2] / (counted.v + 1)


def _scores(mixture: np.ndarray, totals: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in read(batch, totals):
                base = np.log10((c.word + 0.5) / (c.n + 0.5 * (c.v + 1)))
                model = np.log10(token_probability(c, mixture))
                known = (c.word > 0).astype(np.int64)
                sums = [np.add.reduceat(x, c.firsts) for x in (known, base, model)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.rest.column(i) for i in range(c.rest.num_columns - 1)), pa.array(c.sizes), pa.array(sums[0]),
                        pa.array(np.full(c.rows, c.n)), pa.array(sums[1]), pa.array(sums[2]),
                    ],
                    names=[*c.rest.schema.names[:-1], "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def read(batch: pa.RecordBatch, totals: tuple[int, int]) -> Iterator[Counted]:
    """The chunks of a batch of (body, answers)."""
    for body, answers in zip(batch.column(0), batch.column(1)):
        yield Counted(body.as_py(), [(a["part"], a["counts"], a["n_keys"]) for a in answers.as_py()], totals)


@dataclass
class Corpus:
    """(body, answers) for each chunk of some documents: the documents, and the training counts of all their tokens.

    `totals` are the number of training tokens and that of different ones.
    """

    chunks: DataFrame
    totals: tuple[int, int]


def counted(docs: DataFrame, train: str, text: str = "text", size: int = CHUNK_BYTES, parts: int | None = None) -> Corpus:
    """The documents in chunks, with their counts."""
    spark = docs.sparkSession
    bound_batches(spark)
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rest = [c for c in docs.columns if c not in (train, text)]
    teaches, body = fresh(rest, "_train", "_text")
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(train, F.lit(True)).alias(teaches), F.col(text).alias(body))
    bodies = stage_bucketed(rows.mapInArrow(_chunk(size), "chunk long, body binary"), "lm-chunks", "chunk", buckets)
    parts = parts or max(buckets, bodies.count() * size // PART_BYTES)
    answers = bodies.mapInArrow(_ask(parts), ASK).groupBy("part").applyInArrow(_answer, ANSWER)
    gathered = answers.groupBy("chunk").agg(F.collect_list(F.struct("part", "counts", "n_keys", "tokens", "types")).alias("answers"))
    answered = stage_bucketed(gathered, "lm-answers", "chunk", buckets)
    found = answered.where(F.col("chunk") == TOTALS).select(F.explode("answers").alias("a")).agg(F.sum("a.tokens"), F.sum("a.types")).first()
    slim = answered.select("chunk", F.transform("answers", lambda a: F.struct(a["part"].alias("part"), a["counts"].alias("counts"), a["n_keys"].alias("n_keys"))).alias("answers"))
    # Both tables lie in equal buckets: the chunks are not shuffled, however often they are read.
    return Corpus(bodies.hint("merge").join(slim, "chunk").select("body", "answers"), (found[0] or 0, found[1] or 0))


def learn(corpus: Corpus) -> np.ndarray:
    """The mixture weights, learned from the held-out counts of all chunks.

    What reaches the driver is a table of steps, bounded by buckets x steps x steps.
    """
    held = corpus.chunks.mapInArrow(_held(corpus.totals), "cell long, n long")
    cells = held.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    return weights(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.int64), corpus.totals[1])


def score(docs: DataFrame, train: str, text: str = "text", size: int = CHUNK_BYTES, parts: int | None = None) -> DataFrame:
    """`docs` without `train` and `text`, with n_tokens, n_known, train_tokens, base_score and score.

    Rows teach where `train` is true. Columns with the names of the results are replaced.
    """
    results = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    names = {x.split()[0] for x in results.split(", ")}
    docs = docs.drop(*(c for c in docs.columns if c.lower() in names and c not in (train, text)))
    corpus = counted(docs, train, text, size, parts)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.drop(train, text).schema.fields)
    return corpus.chunks.mapInArrow(_scores(learn(corpus), corpus.totals), fields + results)
