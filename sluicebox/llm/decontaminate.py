"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment.

A signature of a whole long document can't find a short item in it: of its few registers hardly one holds a shingle
of the item. So items are partitioned by the power of two of their number of shingles, and for each partition the
documents are cut into windows of twice its size, each beginning in the middle of the one before. An item and a window
have signatures of one fixed length, by one-permutation MinHash: the hash's high bits choose a register, which keeps
the smallest hash. At a containment of 0.8 the Jaccard similarity of an item and a window that holds it is at least
0.19, so bands of one register each tell them from the rest; a partition is signed with as many independent hashes as
its smallest item needs to be missed less than once in 10^6. A document one of whose windows shares a band with an item
is a candidate; there the shingle sets of whole document and item are compared exactly. A shared shingle is as likely to
be a window's minimum wherever it stands, so items whose parts are scattered over a document are found alike.

Words are lower-case runs of letters and digits, so that markup and punctuation don't hide a passage. Shingles have
five words; an item of one to four words is one shorter shingle and is looked for as such.

The items are a stated query set: they go to the tasks in blocks of bounded bytes, one pass over the documents each.

Defined cases. Null or empty items and documents match nothing. Items that repeat match each on their own. Null ids
are reported as null. An empty table gives no matches. `clean` passes further columns through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import ALNUM, U64, bound_batches, distinct_in_rows, mix, shingles_of, slices, text_bytes, words_of

SHINGLE = 5
CONTAINMENT = 0.8
#: Registers of a signature; partitions of items below 16 shingles take four for each shingle.
REGISTERS = 64
#: The bytes of items in a block, and an upper bound of the bytes that each item has besides its text.
BLOCK_BYTES, ITEM_BYTES = 4 << 20, 64
#: Flags by the low bits of a hash: most windows' minima are told by them to be no item's.
FLAGS = 18
EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def shingle_rows(column: pa.Array, k: int = SHINGLE):
    """For ranges of rows: first row, last row, row and hash of their shingles of k words in order, words of each row."""
    raw, offsets = text_bytes(pc.utf8_lower(column))
    for a, b in slices(offsets):
        hashes, counts = words_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
        values, number = shingles_of(hashes, counts, k)
        yield a, b, np.repeat(np.arange(b - a), number), values, counts


def partition_of(sizes: np.ndarray) -> np.ndarray:
    """The partition of an item of a size: the power of two that holds it."""
    return np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)


def register_bits(partition: int) -> int:
    """The power of two of a partition's registers."""
    return min(REGISTERS.bit_length() - 1, partition + 2)


def hashes_needed(partition: int, smallest: int, least: float) -> int:
    """Hashes by which a partition's smallest item, contained to `least`, is missed less than once in 10^6.

    Of the shingles that a window shares with the item each is its register's smallest with a probability that
    follows from the window's shingles by register.
    """
    load = 2 * 2.0**partition / 2.0 ** register_bits(partition)
    hit = (1 - np.exp(-load)) / load
    shared = max(1, int(np.ceil(least * smallest - 1e-9)))
    return max(1, int(np.ceil(np.log(1e-6) / (shared * np.log1p(-hit)) - 0.05)))


def permuted(values: np.ndarray, turn: int) -> np.ndarray:
    """The values by hash `turn`."""
    return mix(values ^ mix(np.array([turn], U64)))


def minima(values: np.ndarray, group: np.ndarray, groups: int, bits: int) -> np.ndarray:
    """The smallest hash of each register of each group: (groups, registers); EMPTY where there is none."""
    out = np.full(groups << bits, EMPTY)
    np.minimum.at(out, (group << bits) | (values >> U64(64 - bits)).astype(np.int64), values)
    return out.reshape(groups, -1)


def windows(row: np.ndarray, values: np.ndarray, rows: int, partition: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The row and the signature of each window: two neighbouring blocks of 2^partition shingles of a row."""
    number = np.bincount(row, minlength=rows)
    blocks = -(-number >> partition)  # rounded up
    first = np.cumsum(blocks) - blocks
    place = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    signed = minima(values, first[row] + (place >> partition), int(blocks.sum()), bits)
    owner = np.repeat(np.arange(rows), blocks)
    paired = owner[1:] == owner[:-1]
    alone = np.flatnonzero(blocks == 1)
    both = np.minimum(signed[1:][paired], signed[:-1][paired])
    return np.concatenate([owner[1:][paired], alone]), np.concatenate([both, signed[first[alone]]])


class Index:
    """Signatures of a block of items by partition, and their shingle sets for the exact check."""

    def __init__(self, ids: list, texts: list[str | None], least: float = CONTAINMENT):
        self.ids, self.least = ids, least
        column = pa.array(texts, pa.string())
        item, values, words = [], [], []
        for a, b, row, found, counts in shingle_rows(column):
            r, v, _ = distinct_in_rows(found, np.bincount(row, minlength=b - a))
            item.append(a + r)
            values.append(v)
            words.append(counts)
        self.item, self.values, words = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((item, np.int64), (values, U64), (words, np.int64)))
        self.sizes = np.bincount(self.item, minlength=len(ids))
        order = np.argsort(self.values, kind="stable")
        self.sorted_values, self.sorted_item = self.values[order], self.item[order]
        self.whole = words >= SHINGLE
        #: Items shorter than a shingle, by their number of words.
        self.short = sorted({int(n) for n in words[(words > 0) & ~self.whole]})
        self.made: dict[tuple[bool, int, int], tuple] = {}
        self.plans = {whole: self.plan(whole) for whole in (True, False)}

    def plan(self, whole: bool) -> list[tuple[int, int]]:
        """(partition, hashes) of the items of whole shingles, or of shorter ones."""
        sizes = self.sizes[(self.whole == whole) & (self.sizes > 0)]
        part = partition_of(sizes)
        return [(int(p), hashes_needed(int(p), int(sizes[part == p].min()), self.least)) for p in np.unique(part)]

    def signature(self, whole: bool, partition: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted minima of all items of a partition, and flags of their low bits."""
        key = whole, partition, turn
        if key not in self.made:
            mine = ((self.whole == whole) & (self.sizes > 0) & (partition_of(self.sizes) == partition))[self.item]
            signed = minima(permuted(self.values[mine], turn), self.item[mine], len(self.ids), register_bits(partition)).ravel()
            signed = np.unique(signed[signed != EMPTY])
            flags = np.zeros(1 << FLAGS, bool)
            flags[(signed & U64((1 << FLAGS) - 1)).astype(np.int64)] = True
            self.made[key] = signed, flags
        return self.made[key]

    def candidates(self, row: np.ndarray, values: np.ndarray, rows: int, whole: bool) -> np.ndarray:
        """Which rows have a window that shares a register with an item; `whole`: shingles of full length."""
        found = np.zeros(rows, bool)
        if not len(row):
            return found
        for partition, turns in self.plans[whole]:
            for turn in range(turns):
                signed, flags = self.signature(whole, partition, turn)
                owner, least = windows(row, permuted(values, turn), rows, partition, register_bits(partition))
                at, register = np.nonzero(flags[(least & U64((1 << FLAGS) - 1)).astype(np.int64)])
                probe = least[at, register]
                place = np.minimum(np.searchsorted(signed, probe), len(signed) - 1)
                found[owner[at[signed[place] == probe]]] = True
        return found

    def contained(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items with shingles among the distinct `values`, and how many."""
        low, high = (np.searchsorted(self.sorted_values, values, side) for side in ("left", "right"))
        lens = high - low
        at = np.repeat(low - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        return np.unique(self.sorted_item[at], return_counts=True)

    def hits(self, column: pa.Array) -> dict[tuple[int, int], int]:
        """(row, item) of the texts that hold an item, and how many shingles they share."""
        out = {}
        for k in (SHINGLE, *self.short):
            for a, b, row, values, counts in shingle_rows(column, k):
                if k < SHINGLE:  # a document of fewer words has no such shingle
                    far = counts[row] >= k
                    row, values = row[far], values[far]
                for i in np.flatnonzero(self.candidates(row, values, b - a, k == SHINGLE)):
                    items, shared = self.contained(np.unique(values[slice(*np.searchsorted(row, [i, i + 1]))]))
                    out |= {(int(a + i), int(j)): int(n) for j, n in zip(items, shared) if n >= self.least * self.sizes[j] - 1e-9}
        return dict(sorted(out.items()))


def _index(block, least: float) -> Index:
    """The index of a broadcast block; its parts are made once in a task."""
    ids, texts = block.value
    return Index(ids, texts, least)


def _search(block, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(block, least)
        for batch in batches:
            hits = index.hits(batch.column(1))
            rows = pa.array([i for i, _ in hits], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), pa.array([index.ids[j] for _, j in hits], pa.int64()),
                    pa.array(list(hits.values()), pa.int64()), pa.array([int(index.sizes[j]) for _, j in hits], pa.int64()),
                ],
                names=["doc_id", "item_id", "shared", "item_shingles"],
            )

    return run


def _without(block, least: float, place: int):
    """Batches without the rows whose column `place` holds an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(block, least)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            clean[[i for i, _ in index.hits(batch.column(place))]] = False
            yield batch.filter(pa.array(clean))

    return run


def blocks(items: DataFrame, key: str, text: str, most: int) -> Iterator:
    """The items as broadcast blocks of at most `most` bytes of text; a longer item stands alone."""
    context, ids, texts, held = items.sparkSession.sparkContext, [], [], 0
    for row in items.select(F.col(key).cast("long"), F.col(text)).toLocalIterator():
        size = len((row[1] or "").encode()) + ITEM_BYTES
        if ids and held + size > most:
            yield context.broadcast((ids, texts))
            ids, texts, held = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        held += size
    yield context.broadcast((ids, texts))


def matches(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", least: float = CONTAINMENT, block: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of every document and item of at least `least`."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = None
    for part in blocks(items, item_key, item_text, block):
        found = rows.mapInArrow(_search(part, least), "doc_id long, item_id long, shared long, item_shingles long")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def clean(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
    least: float = CONTAINMENT, block: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` without the rows whose text holds an item. Rows are judged where they are: nothing is shuffled."""
    bound_batches(docs.sparkSession)
    out, place = docs, docs.columns.index(text)
    for part in blocks(items, item_key, item_text, block):
        out = out.mapInArrow(_without(part, least, place), docs.schema)
    return out
