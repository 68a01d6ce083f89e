"""Near-duplicate detection with ProbMinHash, banding and exact verification.

A document is a set of weighted five-word shingles. Every shingle is a Poisson process whose points arrive at the rate
of its weight and fall on random registers; a register keeps the shingle that arrives first. Arrivals are drawn in
rounds, and a shingle stops as soon as its last point is later than every register of the document: the early
termination of ProbMinHash. Two documents agree on a register with the probability Jaccard similarity of their
weights. Registers are cut into bands, and texts that share a band are compared exactly by the very similarity that
the registers estimate.

Weights are a choice: with `sets` every distinct shingle weighs 1, and probability Jaccard is the Jaccard similarity of
the shingle sets; with `counts` a shingle weighs as often as it occurs, so a repeated passage counts for more.

Exact copies are one text: they are joined by hash before anything else and never paired. Texts that bands connect are
a family. A family is first compared within blocks of its texts; then the blocks of a band's texts are paired, but only
between texts that are not in one class yet and whose sizes allow the similarity. No pair is emitted but the verified
links of a spanning forest, and no link is lost between texts that share a band.

Defined cases. Null texts and texts without words are never duplicates: each such row is a class of its own. A text
of one to four words has one shingle, all its words. A class is named by its smallest doc_id; rows with a null doc_id
join classes, and a class of null ids alone, or of a row without words, has its row's own doc_id. Repeated rows share
a class. Texts are told apart by two 64-bit hashes: where texts share the first, the second is their node. Columns of
any name pass through `keep_one`; `label` replaces columns of its results' names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import (
    GOLDEN, U64, bound_batches, components, distinct_in_rows, fresh, mix, shingles_of, sized, slices, stage, text_bytes, words_of,
)

SHINGLE = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 two texts share a band with a probability of 1 - (1 - 0.8^5)^24 = 0.9999.
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Texts in a block; a task holds two blocks at most.
BLOCK = 256
#: How shingles weigh.
WEIGHTS = ("sets", "counts")


def signatures(values: np.ndarray, row: np.ndarray, weights: np.ndarray, rows: int, m: int = REGISTERS) -> np.ndarray:
    """The shingle in each of the `m` registers of each row: (rows, m); zero in a row without shingles.

    `values` are the distinct shingles of each row, `row` the rows, sorted, `weights` their weights.
    """
    times = np.full(rows * m, np.inf)
    holders = np.zeros(rows * m, U64)
    live = np.arange(len(values))
    clock = np.zeros(len(values))
    turn = 0
    while len(live):
        turn += 1
        draw = mix(values[live] ^ mix(np.array([turn], U64)))
        clock = clock - np.log(((draw >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weights[live]
        register = (mix(draw ^ GOLDEN) % U64(m)).astype(np.int64)
        slot = row[live] * m + register
        before = clock < times[slot]
        at, when, who = slot[before], clock[before], values[live[before]]
        np.minimum.at(times, at, when)
        won = times[at] == when
        holders[at[won]] = who[won]
        last = times.reshape(rows, m).max(axis=1)
        stays = clock < last[row[live]]
        live, clock = live[stays], clock[stays]
    return holders.reshape(rows, m)


def bands_of(holders: np.ndarray) -> np.ndarray:
    """One hash for each band of each row."""
    out = np.zeros((len(holders), BANDS), U64)
    grouped = holders.reshape(len(holders), BANDS, ROWS)
    for j in range(ROWS):
        out = mix(out * GOLDEN + grouped[:, :, j])
    return mix(out + np.arange(1, BANDS + 1, dtype=U64) * GOLDEN)


def shingle_sets(column: pa.Array):
    """For ranges of rows: first row, last row, and row, hash and multiplicity of their distinct shingles."""
    raw, offsets = text_bytes(column)
    for a, b in slices(offsets, 2 << 20):
        hashes, counts = words_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield (a, b, *distinct_in_rows(*shingles_of(hashes, counts, SHINGLE)))


def weights_of(times: np.ndarray, weights: str) -> np.ndarray:
    """The weights of shingles that occur so many times."""
    return np.ones(len(times)) if weights == "sets" else times.astype(float)


def size_level(total: np.ndarray) -> np.ndarray:
    """A step of a text's weight: those of similar texts differ by one at most."""
    return np.floor(np.log(np.maximum(total, 1)) / -np.log(SIMILARITY) + 1e-9).astype(np.int32)


def _sign(weights: str):
    """Rows (node, text) to rows (node, level, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, values, times in shingle_sets(batch.column(1)):
                weight = weights_of(times, weights)
                found = bands_of(signatures(values, row, weight, b - a)).view(np.int64)
                total = np.bincount(row, weight, minlength=b - a)
                has = total > 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, has.sum() * BANDS + 1, BANDS, dtype=np.int32)), pa.array(found[has].ravel()))
                # Only sets have a bound by size: of counts, which are shares of a whole, all sizes are one level.
                level = size_level(total[has]) if weights == "sets" else np.zeros(has.sum(), np.int32)
                nodes = batch.column(0).slice(a, b - a).filter(pa.array(has))
                yield pa.RecordBatch.from_arrays([nodes, pa.array(level), lists], names=["node", "level", "bands"])

    return run


def text_hash(text: str, second: bool = False) -> Column:
    """A 64-bit hash of a text, and another one."""
    return F.xxhash64(F.lit(7), F.col(text)) if second else F.xxhash64(F.col(text))


def has_words(text: str) -> Column:
    """Whether a text has a word."""
    return F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


class Texts:
    """The different texts of `docs` that have words, and the node of every row.

    A node is the first hash of a text. Of the texts that share it (three are expected among 10^10) the second hash is
    the node, which takes a join, but only where there are such.
    """

    def __init__(self, docs: DataFrame, text: str, key: str):
        self.docs, self.text = docs, text
        hashes = docs.where(has_words(text)).groupBy(text_hash(text).alias("h"), text_hash(text, True).alias("g"))
        found = stage(hashes.agg(F.min(key).alias("first"), F.count("*").alias("copies")), "texts")
        shared = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("shared"))
        self.shared = stage(shared, "shared-hashes")
        self.clash = self.shared.limit(1).count() > 0
        self.nodes = self._noded(found).select("node", "first", "copies") if self.clash else found.select(F.col("h").alias("node"), "first", "copies")

    def _noded(self, rows: DataFrame) -> DataFrame:
        """Rows (h, g, ...) with their node."""
        joined = rows.join(sized(self.shared), F.col("h") == F.col("shared"), "left")
        return joined.withColumn("node", F.when(F.col("shared").isNotNull(), F.col("g")).otherwise(F.col("h"))).drop("h", "g", "shared")

    def with_node(self, rows: DataFrame, node: str) -> DataFrame:
        """`rows` of the same text column with their node, null without words."""
        if not self.clash:
            return rows.withColumn(node, F.when(has_words(self.text), text_hash(self.text)))
        (row,) = fresh(rows.columns, "_row")
        packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(row), text_hash(self.text).alias("h"), text_hash(self.text, True).alias("g"))
        noded = self._noded(packed)
        body = F.col(row)[self.text]
        words = F.coalesce(body.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        return noded.select(*[F.col(row)[c].alias(c) for c in rows.columns], F.when(words, F.col("node")).alias(node))

    def rows(self) -> DataFrame:
        """(node, text) of every row that has words."""
        return self.with_node(self.docs.where(has_words(self.text)).select(self.text), "node" if self.text != "node" else "_node").toDF("text", "node").select("node", "text")


def signed_rows(texts: Texts, weights: str) -> DataFrame:
    """(node, level, bands) of every row."""
    bound_batches(texts.docs.sparkSession)
    return stage(texts.rows().mapInArrow(_sign(weights), "node long, level int, bands array<long>"), "bands")


def band_links(signed: DataFrame) -> DataFrame:
    """(a, b): links that connect all texts that share a band.

    Only a band's hash and a node travel; partial minima are taken before the shuffle, so a band that a third of
    the texts share is no burden. A text is linked to the smallest of its bands' smallest texts, and those among
    each other: in a large family they are few, so there are hardly more links than texts.
    """
    rows = signed.select("node", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("band", "a")
    stars = rows.join(shared, "band").groupBy("node").agg(F.array_sort(F.collect_set("a")).alias("smallest"))
    ends = F.explode(F.array_append("smallest", F.col("node")))
    return stars.select(F.col("smallest")[0].alias("a"), ends.alias("b")).where("a <> b").distinct()


def verified(texts: DataFrame, weights: str) -> DataFrame:
    """(a, b): links of exact similarity that connect what is similar, from rows (grp, node, text)."""
    bound_batches(texts.sparkSession)
    spread = texts.repartition("grp").sortWithinPartitions("grp", "node")
    return spread.mapInArrow(_verify(weights), "a long, b long")


def _verify(weights: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets, heavy = None, [], [], []
        for batch in batches:
            groups, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            links = []
            for a, b, row, values, times in shingle_sets(batch.column(2)):
                at = np.searchsorted(row, np.arange(1, b - a))
                parts, weight = np.split(values, at), np.split(weights_of(times, weights), at)
                for i, part, w in zip(range(a, b), parts, weight):
                    if groups[i] != group:
                        links += forest(nodes, sets, heavy)
                        group, nodes, sets, heavy = groups[i], [], [], []
                    if not nodes or nodes[-1] != ids[i]:
                        nodes.append(ids[i])
                        sets.append(part)
                        heavy.append(w)
            yield _links(links)
        yield _links(forest(nodes, sets, heavy))

    return run


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def probability_jaccard(x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray) -> float:
    """The probability Jaccard similarity of two weighted sets of sorted values: the sum over the shared values i of
    1 / sum over all j of max(x[j] / x[i], y[j] / y[i])."""
    shared, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    # With r = x[j] / y[j] in order, the maximum is the first quotient where r is at least that of i, else the second.
    a, b = wx[i], wy[j]
    only_x, only_y = wx.sum() - a.sum(), wy.sum() - b.sum()
    ratio = a / b
    order = np.argsort(ratio, kind="stable")
    up, down = np.cumsum(b[order]), np.cumsum(a[order][::-1])[::-1]
    low = np.searchsorted(ratio[order], ratio, "left")  # values of a smaller ratio
    below = np.where(low > 0, up[np.maximum(low - 1, 0)], 0.0)
    return float((1.0 / ((only_x + down[low]) / a + (only_y + below) / b)).sum())


def forest(nodes: list[int], sets: list[np.ndarray], weights: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that connect the texts of a group exactly as all its pairs of at least `least` would.

    Texts are taken in the order of their size. A text is compared with those before it that share enough of their
    weight, by an index from shingles to texts, and each connected part is needed once only.
    """
    n = len(nodes)
    if n < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    owner = np.repeat(np.arange(n), sizes[order])
    flat = np.concatenate([sets[i] for i in order])
    weight = np.concatenate([weights[i] for i in order])
    total = np.array([weights[i].sum() for i in order])
    plain = bool((weight == 1).all())
    by_value = np.argsort(flat, kind="stable")
    _, code = np.unique(flat, return_inverse=True)
    starts = np.searchsorted(code[by_value], np.arange(code.max() + 2))
    holder, held = owner[by_value], weight[by_value]
    begin = np.concatenate([[0], np.cumsum(sizes[order])])
    root = np.arange(n)
    links = []
    for i in range(1, n):
        codes = code[begin[i] : begin[i + 1]]
        lens = starts[codes + 1] - starts[codes]
        where = np.repeat(starts[codes] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        if plain:
            common = np.bincount(holder[where], minlength=n)[:i]
            near = np.flatnonzero(common >= least * (total[i] + total[:i] - common) - 1e-9)
        else:  # the similarity is no more than the share of either's weight that lies on shared shingles
            mine = np.bincount(holder[where], np.repeat(weight[begin[i] : begin[i + 1]], lens), minlength=n)[:i] / total[i]
            theirs = np.bincount(holder[where], held[where], minlength=n)[:i] / total[:i]
            near = np.flatnonzero(np.minimum(mine, theirs) >= least - 1e-9)
            me = order[i]
            near = np.array(
                [j for j in near if probability_jaccard(sets[order[j]], sets[me], weights[order[j]], weights[me]) >= least - 1e-9], np.int64
            )
        for r in np.unique(root[near]):
            j = near[root[near] == r][0]
            links.append((int(nodes[order[j]]), int(nodes[order[i]])))
            if root[i] != r:
                root[root == root[i]] = r
    return links


def family_texts(texts: Texts, placed: DataFrame) -> DataFrame:
    """(node, root, blocks, text) of the texts of families; hashes choose the rows, so no other text is shuffled."""
    chosen = texts.rows().join(sized(placed.select("node", "root", "blocks")), "node")
    return stage(chosen.groupBy("node", "root", "blocks").agg(F.max("text").alias("text")), "family-texts")


def block_links(texts: DataFrame, weights: str) -> DataFrame:
    """Links within blocks, and of every block to its family's root, whose text is in all of them."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    places = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block.cast("int")))
    dealt = texts.select("node", "text", "root", F.explode(places).alias("block"))
    return verified(dealt.select(F.xxhash64("root", "block").alias("grp"), "node", "text"), weights)


def cross_links(texts: DataFrame, signed: DataFrame, found: DataFrame, weights: str) -> DataFrame:
    """Links between texts of large families that share a band and that `found` (node, root as class) does not connect.

    A band all of whose texts are one class is done. Of the others, classes of a block's size or more are parts of their
    own, all else is one part. Parts are cut into levels of size, and those into blocks; blocks are paired between
    parts and within the part of the rest, if their levels are the same or next to each other: texts further apart
    can't be similar. What is one class already is not compared again.
    """
    classed = texts.select("node", F.col("root").alias("family")).join(found.select("node", F.col("root").alias("cls")), "node", "left")
    classed = stage(classed.withColumn("cls", F.coalesce("cls", "node")), "classed")
    torn = classed.groupBy("family").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("family")
    placed = stage(classed.join(torn, "family").select("node", "cls"), "torn-families")
    each = signed.join(sized(placed), "node").select("node", "cls", "level", F.explode("bands").alias("band"))
    members = stage(each.groupBy("band", "node", "cls").agg(F.min("level").alias("level")), "band-members")
    # Bands of the same texts are one.
    bands = members.groupBy("band").agg(
        F.min("cls").alias("low"), F.max("cls").alias("high"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n")
    )
    one = bands.where("low <> high").groupBy("sum", "n").agg(F.min("band").alias("band")).select("band")
    rows = stage(members.join(sized(stage(one, "open")), "band"), "open-bands")
    sizes = rows.groupBy("band", "cls").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("rest", F.col("n") < BLOCK).withColumn("part", F.when(F.col("rest"), 0).otherwise(F.col("cls"))).drop("n")
    parted = stage(rows.join(sizes, ["band", "cls"]), "parted-bands")
    parts = stage(parted.groupBy("band", "rest", "part", "level").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k")), "band-parts")
    a, b = (parts.select("band", *[F.col(c).alias(f"{c}_{side}") for c in ("rest", "part", "level", "k")]) for side in "ab")
    between = (F.col("rest_a") & ~F.col("rest_b")) | (~F.col("rest_a") & ~F.col("rest_b") & (F.col("part_a") < F.col("part_b")))
    within = F.col("rest_a") & F.col("rest_b") & (F.col("level_a") <= F.col("level_b"))
    place = ("band", "rest", "part", "level", "block")
    pairs = (
        a.join(b, "band").where(F.abs(F.col("level_a") - F.col("level_b")) <= 1).where(between | within)
        .withColumn("block_a", F.explode(F.sequence(F.lit(0), F.col("k_a") - 1))).withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("k_b") - 1)))
        .where(~F.col("rest_b") | (F.col("level_a") < F.col("level_b")) | (F.col("block_a") <= F.col("block_b")))
        .withColumn("grp", F.xxhash64("band", *[f"{c}_{side}" for side in "ab" for c in place[1:]]))
    )
    sides = [pairs.select("grp", "band", *[F.col(f"{c}_{side}").alias(c) for c in place[1:]]) for side in "ab"]
    blocked = parted.join(parts, ["band", "rest", "part", "level"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = blocked.join(sides[0].union(sides[1]).distinct(), list(place)).select("grp", "node")
    return verified(dealt.join(texts.select("node", "text"), "node").select("grp", "node", "text"), weights)


def classes(texts: Texts, weights: str = "sets") -> DataFrame:
    """(node, class_node, class_id, ...) of every text that has words: its class's root and smallest doc_id."""
    if weights not in WEIGHTS:
        raise ValueError(f"weights are one of {WEIGHTS}")
    signed = signed_rows(texts, weights)
    families = components(band_links(signed), "families")
    sizes = families.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = stage(families.join(sizes, "root"), "placed")
    found = family_texts(texts, placed)
    links = stage(block_links(found, weights).distinct(), "links")
    large = found.where("blocks > 1")
    if large.limit(1).count():
        more = cross_links(large, signed, components(links, "block-classes"), weights)
        links = links.unionByName(stage(more.distinct(), "cross-links"))
    joined = components(links, "classes")
    rooted = texts.nodes.join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("class_node"), "first", "copies")
    ids = rooted.groupBy("class_node").agg(F.min("first").alias("class_id"), F.count("*").alias("n_texts"), F.sum("copies").alias("n_documents"))
    return stage(rooted.join(ids, "class_node").select("node", "class_node", "class_id", "n_texts", "n_documents"), "class-of")


def label(docs: DataFrame, text: str = "text", key: str = "doc_id", weights: str = "sets") -> DataFrame:
    """`docs` without its text, with class_id, class_texts (different texts) and class_documents of its class."""
    texts = Texts(docs, text, key)
    kept = [c for c in docs.columns if c != text and c.lower() not in ("class_id", "class_texts", "class_documents")]
    node, other, root, n_texts, n_documents = fresh([*kept, text], "_node", "_other", "_id", "_texts", "_documents")
    found = sized(classes(texts, weights)).select("node", "class_id", "n_texts", "n_documents").toDF(other, root, n_texts, n_documents)
    rows = texts.with_node(docs.select(*[F.col(f"`{c}`") for c in kept], text), node).drop(text)
    return rows.join(found, F.col(node) == F.col(other), "left").select(
        *[F.col(f"`{c}`") for c in kept],
        F.coalesce(root, key).alias("class_id"),
        F.coalesce(n_texts, F.lit(1)).cast("long").alias("class_texts"),
        F.coalesce(n_documents, F.lit(1)).cast("long").alias("class_documents"),
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", weights: str = "sets") -> DataFrame:
    """`docs` with one row of each class: that of the smallest doc_id, of equal ids that of the smallest text hash.

    Rows without words are not duplicates and all stay. Texts don't move, but for rows that repeat the kept one.
    """
    texts = Texts(docs, text, key)
    found = classes(texts, weights)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    node, win, win_id, same = fresh(docs.columns, "_node", "_win", "_win_id", "_same")
    rows = texts.with_node(docs, node)
    # Of each class the smallest (doc_id, node), a null id last; and how many rows are just that.
    best = F.struct(F.col("id").isNull().alias("none"), "id", "node")
    slim = rows.where(F.col(node).isNotNull()).select(F.col(key).alias("id"), F.col(node).alias("node")).groupBy("id", "node").agg(F.count("*").alias("n"))
    winners = (
        slim.join(sized(found.select("node", "class_node")), "node")
        .groupBy("class_node")
        .agg(F.min(F.struct(best.alias("best"), "n")).alias("w"))
        .select(F.col("w.best.id").alias(win_id), F.col("w.best.node").alias(win), F.col("w.n").alias(same))
    )
    winners = stage(winners, "winners")
    joined = rows.join(sized(winners), (F.col(node) == F.col(win)) & F.col(key).eqNullSafe(F.col(win_id)), "inner")
    single = joined.where(F.col(same) == 1).select(*columns)
    repeated = joined.where(F.col(same) > 1).dropDuplicates([win]).select(*columns)
    return single.unionByName(repeated).unionByName(rows.where(F.col(node).isNull()).select(*columns))
