"""Near-duplicate documents by exact similarity of their runs of words.

Two documents are linked when their sets of runs of ``SIZE`` words share at least
four fifths of their union; groups are what such links connect.  Links are only
taken from exact similarities, of 64-bit hashes of the runs.

Candidates are found by SimHash without a pass over all pairs.  The hashes of a set are
in order, and each two neighbours among its ``LOWEST`` smallest name a shard.  If a union
has at most ``LOWEST`` runs, a linked pair always shares a shard, as the runs of one
side only, a fifth at most, cannot part all others.  In a larger union each run is
one of both sides with a probability of at least 0.8, independently, and that of no
two neighbours among ``LOWEST`` is below 0.52 ** 48 = 2e-14.  Blocks of fingerprint bits,
which make the shards of ``simhash``, would not do here: a link bridges too many bits.
Inside a shard the SimHash fingerprints of ``BITS`` bits are searched by vantage points, and
sets are candidates whose sizes fit, which is exact, and whose fingerprints differ in
``MOST_BITS`` at most: those of a linked pair differ in about 39 bits, and in 48 with a
spread of 6.2 for the worst sets (four runs of five), so one is lost 7 spreads away.

A group of n near copies has n * n pairs, of which none need leave a task.  In a first
step the sets of a key are joined to families by their fingerprints; a key gives a row for
each set that is not the first of its family.  All links lie inside the families that
all keys together make.  In a second step the sets of a family, each sent once, are
compared exactly; what has been linked is not compared again, and pairs whose distances
to the family's first set differ by more than a link can bridge are not looked at (the
distance of sets, one less the share in common, keeps the triangle inequality).  A
family or key of more than ``BLOCK`` sets is cut into blocks, any two of which meet in a
task, so no task holds more than two blocks.

Defined cases: words are as in ``simhash``; a text of fewer than ``SIZE`` words has one
run, its words; texts without words (NULL, empty, only white space) are one group;
repeated rows are one group; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sectionflow.llm.common import may_be_in
from sectionflow.llm.components import connected_components
from sectionflow.llm.simhash import Labels, row_hash
from sectionflow.llm.substrings import _A, _B, _random, hashed_words
from sectionflow.session import materialize

SIZE = 5
SHARE = 4, 5  # of the union that linked sets have in common
LOWEST = 48
BITS, MOST_BITS = 256, 92
BLOCK = 2048  # sets of a key or family that are met at once
SMALL_SHARD = 16  # groups up to this size are compared row by row
LEAF = 64  # sets in a leaf of a vantage tree
CHUNK = 4096  # hashes of a set whose bits are counted at once

_FACTORS = _random(3, BITS // 64) | np.uint64(1)
_FINGERPRINT = [f"simhash_{i}" for i in range(BITS // 64)]


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the distinct runs of ``SIZE`` words in order, from the hashes of the words."""
    size = min(SIZE, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    runs = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        runs = (runs ^ words[i : len(runs) + i]) * _A
        runs ^= runs >> np.uint64(29)
    runs *= _B
    runs ^= runs >> np.uint64(32)
    return np.unique(runs)


def text_shingles(texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
    """The runs of each text."""
    return map(shingles, hashed_words((t or b"").lower() for t in texts))


def fingerprint(runs: np.ndarray) -> np.ndarray:
    """SimHash of ``BITS`` bits, those set in over half of the runs' hashes, as signed longs."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(runs), CHUNK):
        bits = runs[i : i + CHUNK, None] * _FACTORS
        bits = (bits ^ bits >> np.uint64(32)) * _B
        bits ^= bits >> np.uint64(29)
        ones += np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(runs), bitorder="little").view("<i8")


def described(docs: DataFrame) -> DataFrame:
    """Columns doc_id, row, set (hash of its runs), n (their number), keys, simhash_0, ...; one row per row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, keys, bits = [], [], [], np.zeros((len(_FINGERPRINT), batch.num_rows), np.int64)
            for i, runs in enumerate(text_shingles(x.as_py() for x in batch.column("text"))):
                if i == batch.num_rows:
                    break
                low = runs[:LOWEST]
                names.append(xxhash.xxh64_intdigest(runs.tobytes()))
                sizes.append(len(runs))
                keys.append(((low[:-1] * _A ^ low[1:]) * _B).view(np.int64))
                bits[:, i] = fingerprint(runs)
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(np.array(names, np.uint64).view(np.int64))]
            columns += [pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *map(pa.array, bits)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "set", "n", "keys", *_FINGERPRINT])

    rows = docs.select(F.col("doc_id").cast("long"), row_hash().alias("row"), F.col("text").cast("binary"))
    schema = "doc_id long, row long, set long, n long, keys array<long>, " + ", ".join(f"{x} long" for x in _FINGERPRINT)
    return rows.mapInArrow(kernel, schema)


def sizes_fit(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    part, whole = SHARE
    return whole * np.minimum(one, two) >= part * np.maximum(one, two)


def bits_apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Bits in which the fingerprints of rows (n, fingerprint) differ; of equal numbers of rows, or of one and many."""
    return np.bitwise_count((one[..., 1:] ^ two[..., 1:]).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def alike(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which rows of two arrays of equal length, or of one row and many, can be linked."""
    return sizes_fit(one[..., 0], two[..., 0]) & (bits_apart(one, two) <= MOST_BITS)


def families(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first member of each of n rows' family; ``near(i, others)`` tells which of them are linked with i.

    From each row the ones not reached yet are searched, so a close family costs little more than its size.
    """
    first, left = np.arange(n), np.arange(n)
    while len(left):
        start, left = left[0], left[1:]
        open_ = [start]
        while open_ and len(left):
            found = near(open_.pop(), left)
            open_ += left[found].tolist()
            first[left[found]] = start
            left = left[~found]
    return first


def vantage_families(rows: np.ndarray) -> np.ndarray:
    """For each row (n, fingerprint) of a shard the first row of its family, by a vantage-point tree.

    A vantage point splits rows by their distance to it.  Rows of sizes that fit within half of
    ``MOST_BITS`` of it are alike by the triangle inequality and not compared.  After a split only
    rows whose distances differ by ``MOST_BITS`` at most meet those of the other side, and of
    these only rows that are not in one family yet.
    """
    labels, todo = Labels(len(rows)), [np.arange(len(rows))]
    while todo:
        ids = todo.pop()
        own = rows[ids]
        far = bits_apart(own[0], own)
        core = (far <= MOST_BITS // 2) & sizes_fit(own[:, 0].min(), own[:, 0])
        core &= sizes_fit(own[:, 0].max(), own[:, 0])
        if core.any():
            labels.link(ids[core], np.full(int(core.sum()), ids[core][0]))
            if core.all():
                continue
        cut = int(np.median(far))
        inner, outer = far <= cut, far > cut
        if len(ids) <= LEAF or not outer.any():
            first = families(len(ids), lambda i, left: alike(own[i], own[left]))
            labels.link(ids, ids[first])
            continue
        todo += [ids[inner], ids[outer]]
        a, b = ids[inner & (far > cut - MOST_BITS)], ids[outer & (far <= cut + MOST_BITS)]
        for x in b:
            apart = a[labels.of[a] != labels.of[x]]
            met = apart[alike(rows[x], rows[apart])]
            labels.link(met, np.full(len(met), x))
    return labels.of


def key_families(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row (n, fingerprint) the number of the first row of its family; rows of a key are next to each other."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    labels = Labels(len(keys))
    small = np.repeat(sizes <= SMALL_SHARD, sizes)
    for step in range(1, min(SMALL_SHARD, len(keys))):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & small[step:])
        at = at[alike(rows[at], rows[at + step])]
        labels.link(at, at + step)
    for k in np.flatnonzero(sizes > SMALL_SHARD):
        own = rows[starts[k] : starts[k] + sizes[k]]
        labels.of[starts[k] : starts[k] + sizes[k]] = starts[k] + vantage_families(own)
    return labels.of


def exact_families(runs: list[np.ndarray]) -> np.ndarray:
    """The same for sets of sorted hashes that share enough of their union."""
    part, whole = SHARE
    sizes = np.array([len(r) for r in runs])
    bridge = 1 - part / whole + 1e-9
    distance = np.zeros(len(runs))  # to the first set, once it has been compared

    def shared(i: int, others: np.ndarray) -> np.ndarray:
        flat = np.concatenate([runs[j] for j in others])
        own = runs[i]
        met = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat if len(own) else np.zeros(len(flat), bool)
        total = np.r_[0, np.cumsum(met)]
        ends = np.cumsum(sizes[others])
        return total[ends] - total[ends - sizes[others]]

    def near(i: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), bool)
        fits = whole * np.minimum(sizes[i], sizes[others]) >= part * np.maximum(sizes[i], sizes[others])
        at = np.flatnonzero(fits & (np.abs(distance[i] - distance[others]) <= bridge))
        if len(at):
            common = shared(i, others[at])
            out[at] = whole * common >= part * (sizes[i] + sizes[others[at]] - common)
        return out

    if len(runs) > 2:
        common = shared(0, np.arange(len(runs)))
        distance[:] = 1 - common / np.maximum(sizes[0] + sizes - common, 1)
    return families(len(runs), near)


def _met(members: DataFrame, group: str) -> DataFrame:
    """Rows with a column ``size``, the members of their ``group``, sent to ``meeting``, the tasks' groups.

    A group of one block is a meeting; of more blocks any two are.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("set"), blocks).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (x != F.col("own")) | (F.col("blocks") == 1))
    pairs = F.transform(others, lambda x: F.xxhash64(F.col(group), F.least(x, F.col("own")), F.greatest(x, F.col("own"))))
    cut = members.withColumn("blocks", blocks).withColumn("own", own)
    return cut.withColumn("meeting", F.explode(pairs)).drop("blocks", "own", "size")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold all rows of each of their meetings; meetings come together, in any batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        first, last = batch.column("meeting")[0], batch.column("meeting")[-1]
        if first == last and held[0].column("meeting")[-1] == last:
            continue  # one meeting so far, or the meeting that is held goes on
        table = pa.Table.from_batches(held).combine_chunks()
        meetings = table.column("meeting").to_numpy()
        end = int(np.flatnonzero(meetings != meetings[-1])[-1]) + 1  # the last one may go on
        yield table.slice(0, end)
        held = table.slice(end).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _linked(sets: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    on = np.flatnonzero(first != np.arange(len(first)))
    return pa.RecordBatch.from_arrays([pa.array(sets[first[on]]), pa.array(sets[on])], ["a", "b"])


def key_links(sets: DataFrame) -> DataFrame:
    """Columns a, b: a row for each set and key in which it is not the first of its family."""
    rows = sets.select("set", F.explode("keys").alias("key"))
    # Most keys have one set; they are found before anything else moves.
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = rows.join(shared, "key").join(sets.select("set", "n", *_FINGERPRINT), "set")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            meeting, names, *rest = (c.to_numpy() for c in table.columns)
            yield _linked(names, key_families(meeting, np.stack(rest, axis=1)))

    met = _met(members, "key").select("meeting", "set", "n", *_FINGERPRINT).repartition("meeting").sortWithinPartitions("meeting")
    return met.mapInArrow(kernel, "a long, b long").distinct()


def exact_links(docs: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Columns a, b: a row for each set that is not the first of those it is exactly linked with in a meeting.

    ``roots(node, root)`` are the families; only the texts of their members move.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_shingles(x.as_py() for x in batch.column("text"))
            runs = pa.array([x.view(np.int64) for x, _ in zip(found, range(batch.num_rows))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("set"), batch.column("root"), runs], ["set", "root", "runs"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            meeting, names = (table.column(c).to_numpy() for c in ("meeting", "set"))
            runs = table.column("runs").combine_chunks()
            ends, flat = runs.offsets.to_numpy(), runs.values.to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, meeting[1:] != meeting[:-1]])
            first = np.arange(len(names))
            for a, b in zip(starts, np.r_[starts[1:], len(names)]):
                first[a:b] = a + exact_families([flat[ends[i] : ends[i + 1]] for i in range(a, b)])
            yield _linked(names, first)

    wanted = sets.select("set", F.col("first.row").alias("row")).join(roots.withColumnRenamed("node", "set"), "set")
    wanted = materialize(wanted, "family-sets")
    texts = docs.select(row_hash().alias("row"), F.col("text").cast("binary"))
    texts = may_be_in(texts, F.col("row"), wanted.select(F.col("row").alias("h")), "wanted").where("wanted").drop("wanted")
    runs = texts.join(wanted, "row").select("set", "root", "text").mapInArrow(hashed, "set long, root long, runs array<long>")
    runs = materialize(runs.dropDuplicates(["set"]), "family-runs")
    sizes = runs.groupBy("root").agg(F.count("*").alias("size"))
    met = _met(runs.join(sizes, "root"), "root").select("meeting", "set", "runs")
    return met.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(kernel, "a long, b long").distinct()


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each group, unchanged; a row without id only if all have none."""
    rows = described(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    same = [F.any_value(x).alias(x) for x in ("n", "keys", *_FINGERPRINT)]
    sets = materialize(rows.groupBy("set").agg(first, *same), "shingle-sets")
    families_ = connected_components(key_links(sets), "shingle-families")
    links = exact_links(docs, sets, families_)
    roots = connected_components(links, "shingle-components").withColumnRenamed("node", "set")
    groups = sets.select("set", "first").join(roots, "set", "left")
    kept = groups.groupBy(F.coalesce("root", "set")).agg(F.min("first").alias("first"))
    return kept_rows(docs, kept.select("first.row"))


def kept_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs``, each once, whose hash is in ``kept(row)``.

    Only rows that may have to go move: those of other hashes, and those that occur twice.
    """
    kept = materialize(kept.select("row"), "group-firsts")
    every = docs.select(row_hash().alias("row")).groupBy("row").agg(F.count("*").alias("n"))
    marked = every.join(kept.withColumn("keep", F.lit(True)), "row", "left")
    doubtful = materialize(marked.where("keep IS NULL OR n > 1").select("row", F.col("keep").isNotNull().alias("keep")), "doubtful")
    told = may_be_in(docs, row_hash(), doubtful.select(F.col("row").alias("h")), "shingle_doubt")
    sure = told.where("NOT shingle_doubt").select(*docs.columns)
    rest = told.where("shingle_doubt").select(*docs.columns).withColumn("shingle_row", row_hash())
    rest = rest.join(doubtful.toDF("shingle_row", "shingle_keep"), "shingle_row", "left")
    number = F.row_number().over(Window.partitionBy("shingle_row").orderBy("shingle_row"))
    rest = rest.where("coalesce(shingle_keep, true)").withColumn("shingle_no", number)
    return sure.union(rest.where("shingle_no = 1").select(*docs.columns))
