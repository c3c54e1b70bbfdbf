"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

1. Every document gets its distinct word shingles, MinHash samples with one key for each band
   of samples, and an odd sketch. The sketch folds one-permutation MinHash samples (the least
   hash in each of 4,096 equal ranges) into a parity bitmap. Documents with the same shingles
   are one class from here on.
2. Classes that share a band key meet in a bucket. Inside it the XOR of two sketches counts
   differing samples, and a forest of the most similar pairs is proposed: at most one pair
   less than there are members, never all pairs.
3. Proposed pairs are confirmed on the full sets. Confirmed links are contracted and judged
   pairs are not proposed again. In buckets that still hold several components, each member proposes
   its 16 most similar partners in other components, then 256, and so on, up to all.

Which buckets are open is decided on ids alone; sketches join only the members of open buckets.

A pair at similarity 0.75 shares a band with probability 1 - (1 - 0.75**4)**32 = 1 - 5e-6,
and the sketch passes it unless samples and bitmap together are more than four standard
deviations off. Buckets above ``block`` members
are split into blocks by hash. Where those leave several components, blocks by other hashes,
each with members of most components, propose forests between components. What is still
apart from the largest component of its bucket is compared in pairs of blocks with everything
there, so that no pair goes untested and no task holds more than two blocks; members of the
largest component are not compared with each other.

Defined results: a null or empty text has no shingles, links with nothing and is kept;
fewer words than a shingle are one shingle; rows that repeat an id and its text are in one
component; rows that repeat an id with another text are judged each by its own text; a null id
is never the smallest unless a component has no other, and is kept only then; columns beside id
and text are not read. ``dedup_near`` keeps one row of each component, and of rows without
shingles all but those that repeat an id that is not null and its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatt.llm.components import components
from tidewatt.llm.frames import add_struct, discard, free_name, released, small_batches
from tidewatt.llm.words import NON_SPACE_BYTES, hash_runs, hash_words, mixed, run_starts, slices, split_words
from tidewatt.session import staged

SHINGLE = 5
SIMILAR = 75  # of 100
BANDS, ROWS = 32, 4
BINS = 4096  # one-permutation samples in a sketch
SKETCH_BITS = 4096
DEVIATIONS = 4.5
BLOCK = 4096
REGROUPED = 3  # at most so many times a large bucket is split by another hash
ROWS_AT_ONCE = 64  # members measured against all others at once

_samples = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
FACTORS, TERMS = _samples[: BANDS * ROWS] | np.uint64(1), _samples[BANDS * ROWS :]


class Shingles(NamedTuple):
    hashes: np.ndarray  # distinct in each text, texts one after the other
    first: np.ndarray  # where each text begins, and the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles_of(column: pa.Array) -> Shingles:
    words = split_words(column, NON_SPACE_BYTES, True)
    hashes, owner, counts = hash_words(words), words.text_of_word(), words.counts
    at = run_starts(words, SHINGLE)
    found, texts = [hash_runs(hashes, at, SHINGLE)], [owner[at]]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        found.append(hash_runs(hashes, words.first[:-1][short], n))
        texts.append(short)
    flat, text = np.concatenate(found), np.concatenate(texts).astype(np.uint64)
    order = np.argsort((text << np.uint64(48)) | (flat >> np.uint64(16)), kind="stable")
    flat, text = flat[order], text[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (text[1:] != text[:-1])
    flat, text = flat[new], text[new]
    return Shingles(flat, np.searchsorted(text, np.arange(len(column) + 1, dtype=np.uint64)))


def fixed_binary(values: np.ndarray) -> pa.Array:
    """Rows of an array as binary values."""
    values = np.ascontiguousarray(values)
    width = values.dtype.itemsize * values.shape[1]
    return pa.Array.from_buffers(pa.binary(width), len(values), [None, pa.py_buffer(values.tobytes())]).cast(pa.binary())


def from_binary(column: pa.Array, columns: int) -> np.ndarray:
    """Binary values of one width as rows of unsigned 64-bit integers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, columns)


def node_ids(sets: Shingles, rows: np.ndarray) -> np.ndarray:
    """128 bits that tell sets of shingles apart."""
    first = sets.first[:-1][rows]
    sums = [np.add.reduceat(mixed(sets.hashes ^ salt), first) for salt in (np.uint64(0), FACTORS[0])]
    return np.stack(sums, axis=1)


def band_keys(sets: Shingles, rows: np.ndarray) -> np.ndarray:
    """A key for each band of MinHash samples of the texts that have shingles."""
    first = sets.first[:-1][rows]
    keys = np.zeros((len(rows), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        sample = np.minimum.reduceat((sets.hashes * FACTORS[k] + TERMS[k]) >> np.uint64(32), first)
        keys[:, k // ROWS] = mixed(keys[:, k // ROWS] ^ sample ^ (np.uint64(k + 1) << np.uint64(40)))
    return keys


def short_key(keys: np.ndarray) -> np.ndarray:
    """The 32 bits by which members of a bucket tell whether they share a key of another band."""
    return (keys.astype(np.int64) & 0xFFFFFFFF).astype(np.uint32).view(np.int32)


def odd_sketches(sets: Shingles, rows: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the least hash in each range of hashes."""
    row = np.repeat(np.arange(len(rows)), sets.counts[rows])
    range_ = (sets.hashes >> np.uint64(64 - int(np.log2(BINS)))).astype(np.int64)
    least = np.ones(len(row), bool)  # hashes of a text are in order
    least[1:] = (range_[1:] != range_[:-1]) | (row[1:] != row[:-1])
    bit = (mixed(sets.hashes[least] ^ TERMS[0]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    out = np.zeros((len(rows), SKETCH_BITS // 8), np.uint8)
    np.bitwise_xor.at(out, (row[least], bit >> 3), (1 << (bit & 7)).astype(np.uint8))
    return out


def samples_of(size: np.ndarray) -> np.ndarray:
    """How many ranges of hashes so many shingles are expected to hit."""
    return BINS * -np.expm1(size * np.log1p(-1 / BINS))


def farthest(size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many bits the sketches of similar sets may differ in, for sets of these sizes.

    At the least similarity the union has (sizes) * 100 / 175 shingles. Its samples are drawn
    from them without replacement, so the number of common samples has a known mean and
    deviation; each sample that differs flips a bit, and bits that are hit twice are lost.
    """
    j = SIMILAR / 100
    union = np.maximum((size + other) / (1 + j), 2.0)
    drawn = samples_of(union)
    deviation = np.sqrt(drawn * j * (1 - j) * np.maximum(union - drawn, 0) / (union - 1))
    differing = np.maximum(samples_of(size) + samples_of(other) - 2 * j * drawn, 1.0)
    loss = np.exp(-2 * differing / SKETCH_BITS)
    noise = np.maximum(SKETCH_BITS / 4 * (1 - loss * loss) - differing * loss * loss, 0)
    slack = DEVIATIONS * np.sqrt(4 * deviation * deviation * loss * loss + noise)
    # no more bits differ than samples do
    return np.minimum(SKETCH_BITS / 2 * (1 - loss) + slack, differing + 2 * DEVIATIONS * deviation) + 1


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, node, keys, sketch) of every document; the last three null without shingles."""
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingles_of(part.column(1))
                rows = np.flatnonzero(sets.counts)
                place = np.full(part.num_rows, -1)
                place[rows] = np.arange(len(rows))
                take = pa.array(place, mask=place < 0)
                if len(rows):
                    keys, nodes = band_keys(sets, rows), fixed_binary(node_ids(sets, rows))
                    odd = fixed_binary(odd_sketches(sets, rows))
                else:
                    keys = np.zeros((0, BANDS), np.uint64)
                    nodes = odd = pa.array([], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sets.counts.astype(np.int64)), *[column.take(take) for column in (nodes, lists, odd)]],
                    names=["doc_id", "n_shingles", "node", "keys", "sketch"],
                )

    return small_batches(narrow).mapInArrow(lambda batches: released(run(batches)), "doc_id bigint, n_shingles bigint, node binary, keys array<bigint>, sketch binary")


class Bucket(NamedTuple):
    """Members of a bucket, or of two of its blocks."""

    node: np.ndarray
    group: np.ndarray  # equal for members that are known to be in one component
    size: np.ndarray
    sketch: np.ndarray
    keys: np.ndarray  # of all bands, 32 bits each
    band: int  # the one whose key made this bucket

    def apart(self, rows: slice) -> np.ndarray:
        """Differing bits of some members' and all members' sketches, in units of what similar sets may have.

        Infinite for pairs that meet in an earlier band, so that each pair is proposed in one bucket.
        """
        size = self.size[rows, None]
        bits = np.bitwise_count(self.sketch[rows, None] ^ self.sketch).sum(axis=2)
        out = bits / farthest(self.size, size)
        out[100 * np.minimum(self.size, size) < SIMILAR * np.maximum(self.size, size)] = np.inf
        for band in range(self.band):
            out[self.keys[rows, band, None] == self.keys[:, band]] = np.inf
        return out


def forest(bucket: Bucket) -> list[tuple[int, int]]:
    """Pairs that join the groups of members that may be similar, most similar first, into trees."""
    m = len(bucket.size)
    near, source, waiting = np.full(m, np.inf), np.zeros(m, np.int64), np.ones(m, bool)
    out = []
    for _ in range(m):
        v = int(np.argmin(np.where(waiting, near, np.inf)))
        if not waiting[v]:
            v = int(np.argmax(waiting))
        if 0 <= near[v] <= 1:
            out.append((int(source[v]), v))
        waiting[v] = False
        away = bucket.apart(slice(v, v + 1))[0]
        away[bucket.group == bucket.group[v]] = -1  # joined without a pair
        better = (away < near) & waiting
        near[better], source[better] = away[better], v
    return out


def partners(bucket: Bucket, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """For each member the ``k`` most similar ones of other groups, a few members at a time; and whether there are more."""
    m = len(bucket.size)
    for at in range(0, m, ROWS_AT_ONCE):
        rows = slice(at, min(at + ROWS_AT_ONCE, m))
        away = bucket.apart(rows)
        away[bucket.group[rows, None] == bucket.group] = np.inf
        more = bool(((away <= 1).sum(axis=1) > k).any())
        if more:
            best = np.argpartition(away, k - 1, axis=1)[:, :k]
            x = np.repeat(np.arange(len(away)), k)
            y = best.reshape(-1)
            close = away[x, y] <= 1
            x, y = x[close], y[close]
        else:
            x, y = np.nonzero(away <= 1)
            once = y > x + at  # the other side proposes it too
            x, y = x[once], y[once]
        yield x + at, y, more


MORE = fixed_binary(np.zeros((1, 2), np.uint64))  # both sides of a row that says that some partners were left out
PAIR_ROWS = 1 << 16  # proposed pairs handed on at once


def propose(buckets: DataFrame, k: int) -> DataFrame:
    """(a, b): pairs to confirm, a forest or ``k`` partners of each member (with a row of equal sides if a
    member has more), from rows (key, low, high, node, component, n_shingles, sketch, keys)."""
    rows = buckets.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def of_bucket(bucket: Bucket) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        if len(bucket.size) == 1 or (bucket.group == bucket.group[0]).all():
            return
        if k:
            yield from partners(bucket, k)
        else:
            yield *np.array(forest(bucket), np.int64).reshape(-1, 2).T, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        left_out = False

        def handed_on() -> pa.RecordBatch:
            sides = [fixed_binary(np.concatenate([w[s] for w in waiting])) for s in (0, 1)]
            waiting.clear()
            return pa.RecordBatch.from_arrays(sides, names=["a", "b"])

        def pairs(table: pa.Table, end: int) -> Iterator[pa.RecordBatch]:
            """Of the buckets in the first ``end`` rows."""
            nonlocal left_out
            table = table.slice(0, end).combine_chunks()
            marks = np.stack([table.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, [len(marks)]])
            node, group = (from_binary(table.column(k), 2) for k in (3, 4))
            group = np.unique(group, axis=0, return_inverse=True)[1].reshape(-1)
            size = table.column(5).to_numpy()
            sketch = from_binary(table.column(6), SKETCH_BITS // 64)
            keys = pa.concat_arrays(table.column(7).chunks).flatten().to_numpy().reshape(-1, BANDS)
            band = (keys == short_key(marks[:, :1])).argmax(axis=1)
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for i, j, more in of_bucket(Bucket(node[x:y], group[x:y], size[x:y], sketch[x:y], keys[x:y], int(band[x]))):
                    left_out = left_out or more
                    if len(i):
                        waiting.append((node[x + i], node[x + j]))
                    if sum(len(w[0]) for w in waiting) >= PAIR_ROWS:
                        yield handed_on()

        def whole(table: pa.Table) -> int:
            """The rows before the last bucket, which may go on."""
            marks = np.stack([table.column(k).to_numpy() for k in range(3)], axis=1)
            change = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1))
            return int(change[-1]) + 1 if len(change) else 0

        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            end = whole(held)
            if end:
                yield from pairs(held, end)
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield from pairs(held, held.num_rows)
        if waiting:
            yield handed_on()
        if left_out:
            yield pa.RecordBatch.from_arrays([MORE, MORE], names=["a", "b"])

    made = small_batches(rows).mapInArrow(lambda batches: released(run(batches)), "a binary, b binary")
    return made.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def full_sets(docs: DataFrame, doc_id: str, text: str, nodes: DataFrame) -> DataFrame:
    """(node, hashes) of the classes in ``nodes`` (node, least_id), from the texts of their smallest documents."""
    wanted = nodes.select("least_id").distinct()
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    texts = narrow.join(wanted, F.col("doc_id").eqNullSafe(F.col("least_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingles_of(part.column(1))
                rows = np.flatnonzero(sets.counts)
                if len(rows):
                    hashes = [sets.hashes[sets.first[r] : sets.first[r + 1]].tobytes() for r in rows.tolist()]
                    yield pa.RecordBatch.from_arrays([fixed_binary(node_ids(sets, rows)), pa.array(hashes, pa.binary())], names=["node", "hashes"])

    made = small_batches(texts).mapInArrow(lambda batches: released(run(batches)), "node binary, hashes binary")
    return made.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked): the pairs, judged on the full sets."""
    sides = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= SIMILAR * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return small_batches(sides.select("a", "b", "of_a", "of_b")).mapInArrow(lambda batches: released(run(batches)), "a binary, b binary, linked boolean")


def _blocks(rows: DataFrame, block: int, salt: int) -> DataFrame:
    """The block, as low and high, of a bucket that a member is in; another one for another ``salt``."""
    parts = F.ceil(F.col("members") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(salt)), parts).cast("int")
    return rows.withColumns({"low": own, "high": own})


def _pairs_of_blocks(rows: DataFrame, block: int) -> DataFrame:
    """(low, high) of the pairs of blocks in which a member is compared with members of other components.

    Blocks of the members beside a bucket's largest component come first; those of that component
    meet them and not each other.
    """
    counts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"))

    def parts(members) -> Column:
        return F.ceil(members / F.lit(block)).cast("int")

    rest_parts, main_parts = parts(F.col("members") - F.col("n_main")), parts(F.col("n_main"))
    hashed, in_main = F.xxhash64("node"), F.col("component") == F.col("main")
    own = F.when(in_main, rest_parts + F.pmod(hashed, main_parts)).otherwise(F.pmod(hashed, rest_parts)).cast("int")
    last = F.when(in_main, rest_parts - 1).otherwise(rest_parts + main_parts - 1)
    other = rows.join(main, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return other.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("own", "other", "main", "n_main")


def _groups(docs: DataFrame, text: str, doc_id: str, block: int) -> DataFrame:
    """What ``find_groups`` gives, with the node and the component of each row; both null without shingles."""
    marked = staged(signatures(docs, doc_id, text), "signatures")
    per_class = marked.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = staged(per_class, "classes")
    # sets of fewer than three shingles are similar to equal sets only
    keyed = classes.where("n_shingles >= 3").select(F.explode("keys").alias("key"), "node")
    full = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = staged(keyed.join(full, "key"), "members")
    short = F.transform("keys", lambda key: F.shiftright(F.shiftleft(key, 32), 32).cast("int"))
    measured = classes.select("node", "n_shingles", "sketch", short.alias("keys"))
    large = not members.where(F.col("members") > block).isEmpty()

    links = judged = sets = None
    labels: DataFrame | None = None
    step, regrouped = 0, 0 if large else None  # regrouped: the last split by another hash, or none any more
    while True:
        k = 0
        if labels is None:
            rows = members.withColumn("component", F.col("node"))
        else:
            rows = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
            several = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
            rows = rows.join(several, "key", "left_semi")
            rows = staged(rows, "open") if large else rows  # read several times where buckets are cut into blocks
        if labels is None:
            dealt = _blocks(rows, block, 0)
        elif regrouped is not None:
            regrouped += 1
            dealt = _blocks(rows.where(F.col("members") > block), block, regrouped)
        else:
            step += 1
            k = 16**step
            dealt = rows.where(F.col("members") <= block).withColumns({"low": F.lit(0), "high": F.lit(0)})
            if large:
                dealt = dealt.unionByName(_pairs_of_blocks(rows.where(F.col("members") > block), block))
        wide = dealt.select("key", "low", "high", "node", "component").join(measured, "node")
        proposed = propose(wide.select("key", "low", "high", "node", "component", "n_shingles", "sketch", "keys"), k)
        if judged is not None:
            proposed = proposed.join(judged, ["a", "b"], "left_anti")
        made = staged(proposed, "pairs")
        pairs = made.where("a <> b")
        if large and labels is not None:
            discard(rows)
        if labels is not None and pairs.isEmpty():
            if regrouped is not None:
                regrouped = None
            elif made.isEmpty():  # every close pair of the open buckets has been judged
                break
            continue
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        if sets is not None:
            nodes = nodes.join(sets.select("node"), "node", "left_anti")
        new = staged(full_sets(docs, doc_id, text, classes.select("node", "least_id").join(nodes, "node")), "sets") if sets is None or not nodes.isEmpty() else None
        sets = new if sets is None else sets if new is None else sets.unionByName(new)
        now = staged(confirmed(pairs, sets), "judged")
        discard(made)
        judged = now.select("a", "b") if judged is None else judged.unionByName(now.select("a", "b"))
        good = now.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        links = good if links is None else links.unionByName(good)
        joined = not good.isEmpty()
        if regrouped is not None and (regrouped == REGROUPED or labels is not None and not joined):
            regrouped = None
        if labels is None or joined:
            before, labels = labels, staged(components(links), "labels")
            if before is not None:
                discard(before)
    for stage in (members, sets) if sets is not None else (members,):
        discard(stage)

    ids = classes.select("node", "least_id").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = ids.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = ids.join(least, "component").select("node", "component", "component_id", F.lit(True).alias("has_words"))
    out = marked.select("doc_id", "n_shingles", "node").join(of_class, "node", "left")
    component = F.when(F.col("has_words"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", "node", "component", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def find_groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    return _groups(docs, text, doc_id, block).select("doc_id", "n_shingles", "component_id", "kept")


def _with_nodes(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with a struct ``name`` that holds the node of each text, null without shingles."""

    def work(column: pa.Array) -> list[pa.Array]:
        sets = shingles_of(column)
        rows = np.flatnonzero(sets.counts)
        if not len(rows):
            return [pa.nulls(len(column), pa.binary())]
        place = np.full(len(column), -1)
        place[rows] = np.arange(len(rows))
        return [fixed_binary(node_ids(sets, rows)).take(pa.array(place, mask=place < 0))]

    return add_struct(docs, text, name, T.StructType([T.StructField("node", T.BinaryType())]), work)


def dedup_near(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each group. Rows whose id does not tell them apart are told apart by their shingles."""
    rows = staged(_groups(docs, text, doc_id, block).select("doc_id", "node", "component", "kept"), "rows")
    kept_id, node, kept_node = (free_name(docs, name) for name in ("kept_id", "node", "kept_node"))
    per_id = rows.groupBy(F.col("doc_id").alias(kept_id)).agg(F.count("*").alias("rows"), F.count_if("kept").alias("kept"))
    kept = staged(per_id.where("kept > 0"), "kept")
    same_id = F.col(doc_id).cast("bigint").eqNullSafe(F.col(kept_id))
    once, repeated = kept.where("rows = 1").select(kept_id), kept.where("rows > 1").select(kept_id)
    out = docs.join(once, same_id, "left_semi")
    if repeated.isEmpty():
        return out
    # the kept rows of a component have one id
    best = rows.where("kept AND node IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias(kept_id), F.min("node").alias("node"))
    best = best.select(kept_id, F.struct("node").alias(kept_node))
    told = _with_nodes(docs.join(repeated, same_id, "left_semi"), text, node)
    words = told.join(best, same_id & (F.col(node) == F.col(kept_node)), "left_semi").dropDuplicates([node])
    none = told.where(F.col(node)["node"].isNull())
    parts = words, none.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id, text]), none.where(F.col(doc_id).isNull())
    for part in parts:
        out = out.unionByName(part.select(docs.columns))
    return out
