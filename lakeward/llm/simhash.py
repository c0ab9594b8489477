"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that differ in at most two bits agree on at least two of their four 16-bit blocks, so
each distinct fingerprint is dealt to six tables by two of its blocks. Within a key the fingerprints
stand as vertical bit planes; carry-save counters add up many distances at once, and a block of
comparisons is abandoned once all of it exceeds the radius. A key with many fingerprints is cut into
pairs of blocks, which go to different tasks. A task emits a star for each set of fingerprints that it
finds connected, never all pairs; labels then spread over these edges to the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeward.llm.common import CHUNK, free_name, materialize, mix64, released, reread, run_hashes, shared_folder, shuffle_partitions, small_batches, span_hashes, table, text_buffers, text_chunks, word_bounds

SHINGLE = 3
RADIUS = 2
#: Fingerprints of one key that are compared in one task at most (about): two blocks of these.
BLOCK = 2048
#: The pipeline's stage: words of a shingle, least Jaccard similarity (4/5), radius that SimHashes of such
#: sets keep to (about 10 bits apart at 0.8), bands and their rows (a pair at 0.8 shares one but for 1e-4).
STAGE_SHINGLE, SIMILAR, STAGE_RADIUS, BANDS, BAND_ROWS = 5, (4, 5), 30, 24, 5
#: A group of more sets than this is compared in parts, so that no task holds more than about so many sets.
GROUP_BLOCK = 256
#: Nodes that are sent to every task at most: 8 MB of them.
MOST_SENT = 1 << 20
_SMALL = 32


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Signed 64-bit SimHash of each text; zero for a text without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    data, offsets = text_buffers(column)
    out = np.zeros(len(column), dtype=np.uint64)
    for low, high in text_chunks(offsets):
        part = data[offsets[low] : offsets[high]]
        part = part + (((part >= 0x41) & (part <= 0x5A)).astype(np.uint8) << 5)
        starts, ends, first = word_bounds(part, offsets[low : high + 1] - offsets[low])
        if not len(starts):
            continue
        # The words again with one space between, so that a shingle is one slice.
        lengths = ends - starts
        at = np.cumsum(lengths + 1) - lengths - 1
        joined = np.full(int(at[-1] + lengths[-1]), 0x20, dtype=np.uint8)
        shift = np.repeat(at - starts, lengths)
        source = np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        joined[source + shift] = part[source]
        words = np.diff(first)
        rows = np.flatnonzero(words)
        count = np.maximum(words[rows] - shingle + 1, 1)
        begin = np.cumsum(count) - count
        head = np.arange(int(count.sum())) - np.repeat(begin - first[:-1][rows], count)
        tail = np.minimum(head + shingle, np.repeat(first[1:][rows], count)) - 1
        text, stop = joined.tobytes(), at[tail] + lengths[tail]
        # Most parts are done in one step; a long text, which is a part of its own, in several.
        ones = np.zeros((64, len(rows)), dtype=np.int64)
        for some in range(0, len(head), CHUNK) if len(rows) == 1 else [0]:
            to = some + CHUNK if len(rows) == 1 else len(head)
            hashes = np.array([digest(text[a:b], 42) for a, b in zip(at[head[some:to]].tolist(), stop[some:to].tolist(), strict=True)], dtype=np.uint64)
            for bit in range(64):
                ones[bit] += np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), begin)
        value = np.zeros(len(rows), dtype=np.uint64)
        for bit in range(64):
            value |= (2 * ones[bit] > count).astype(np.uint64) << np.uint64(bit)
        out[low + rows] = value
    return out.view(np.int64)


def fingerprint_documents(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (long) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1), shingle))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, fp long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Row k holds bit k of all values, 64 to a word (padded with zeros)."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(len(values), 8), axis=1, bitorder="little")
    padded = np.zeros((64, -(-len(values) // 64) * 64), dtype=np.uint8)
    padded[:, : len(values)] = bits.T
    return np.packbits(padded, axis=1).view(np.uint64)


def close_mask(differences: Iterator[np.ndarray], radius: int) -> np.ndarray | None:
    """Words of bits that say where the planes of differences add up to at most `radius`; None: nowhere.

    Carry-save counters take one plane after another; after every eight planes the block is abandoned
    if all of its distances exceed the radius.
    """
    counters: list[np.ndarray] = []
    over = None
    for k, plane in enumerate(differences):
        if over is None:
            counters = [np.zeros_like(plane) for _ in range((radius + 1).bit_length())]
            over = np.zeros_like(plane)
        carry = plane
        for i, counter in enumerate(counters):
            counters[i], carry = counter ^ carry, counter & carry
        over |= carry
        if k % 8 == 7 and not (~(over | _exceeds(counters, radius))).any():
            return None
    return ~(over | _exceeds(counters, radius))


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the number in the counters is greater than the radius, from the highest bit down."""
    greater, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for i in range(len(counters) - 1, -1, -1):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            greater |= equal & counters[i]
            equal &= ~counters[i]
    return greater


def _set_bits(mask: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), axis=-1)[..., :n])


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Positions at which two arrays of fingerprints are at most `radius` bits apart."""
    hits = []
    for low in range(0, len(left), 1 << 16):
        apart = left[low : low + (1 << 16)] ^ right[low : low + (1 << 16)]
        mask = close_mask(iter(bit_planes(apart)), radius)
        if mask is not None:
            hits.append(low + _set_bits(mask, len(apart)))
    return np.concatenate(hits) if hits else np.zeros(0, np.int64)


def close_in_block(queries: np.ndarray, block: np.ndarray, radius: int, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of queries and block members at most `radius` bits apart."""
    planes, one = bit_planes(block), np.uint64(1)
    found: tuple[list, list] = ([], [])
    for low in range(0, len(queries), step):
        part = queries[low : low + step]
        sign = (np.uint64(0) - ((part[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & one))[:, :, None]
        mask = close_mask((planes[k][None, :] ^ sign[k] for k in range(64)), radius)
        if mask is not None:
            bits = np.unpackbits(mask.view(np.uint8), axis=1)[:, : len(block)]
            q, b = np.nonzero(bits)
            found[0].append(q + low)
            found[1].append(b)
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)  # type: ignore[return-value]


def stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n items is connected with over the links (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def link_groups(fp: np.ndarray, group: np.ndarray, side: np.ndarray, crossed: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges among the fingerprints of each group. `group` is sorted; in a crossed group only
    fingerprints of different sides are compared."""
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    sizes = np.diff(edge)
    a, b = [], []
    small = np.repeat(sizes <= _SMALL, sizes)
    for d in range(1, int(sizes[sizes <= _SMALL].max(initial=1))):
        i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d] & (~crossed[:-d] | (side[:-d] != side[d:])))
        hit = i[close_pairs(fp[i], fp[i + d], radius)]
        a.append(hit)
        b.append(hit + d)
    for k in np.flatnonzero(sizes > _SMALL).tolist():
        low, high = edge[k], edge[k + 1]
        members = np.arange(low, high)
        if crossed[low]:
            split = side[low:high] == side[low:high].min()
            left, right = members[split], members[~split]
        else:
            left = right = members
        if len(left) and len(right):
            q, m = close_in_block(fp[left], fp[right], radius)
            keep = left[q] != right[m]
            a.append(left[q][keep])
            b.append(right[m][keep])
    if not a:
        return fp[:0], fp[:0]
    label = stars(len(fp), np.concatenate(a), np.concatenate(b))
    on = np.flatnonzero(label != np.arange(len(fp)))
    return fp[label[on]], fp[on]


def near_links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `fp` at most `radius` (2) bits apart."""
    if radius > 2:
        raise ValueError("four blocks of which two agree find pairs up to two bits apart")
    word = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = [F.shiftleft(F.lit(t).cast("long"), 32).bitwiseOR(F.shiftleft(word(i), 16)).bitwiseOR(word(j)) for t, (i, j) in enumerate(combinations(range(4), 2))]
    dealt = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    counts = materialize(dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = dealt.join(counts, "key").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    shared = shared.withColumn("side", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("side", j).alias("p"), F.greatest("side", j).alias("q")))
    shared = shared.select("fp", "key", "side", F.explode(pairs).alias("pq")).select("fp", "key", "side", "pq.p", "pq.q")
    count = shuffle_partitions(nodes.sparkSession)
    spread = shared.repartition(count, "key", "p", "q").sortWithinPartitions("key", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(x: np.ndarray) -> pa.RecordBatch:
            group = np.concatenate(([0], np.cumsum((np.diff(x[1:4], axis=1) != 0).any(axis=0))))
            a, b = link_groups(x[0].view(np.uint64), group, x[4], x[2] != x[3], radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        kept = np.zeros((5, 0), dtype=np.int64)
        for batch in batches:
            kept = np.concatenate((kept, np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)])), axis=1)
            if not kept.shape[1]:
                continue
            last = (kept[1:4] == kept[1:4, -1:]).all(axis=0)
            whole = int(np.argmax(last))  # the last group may go on in the next batch
            if whole >= 50_000:
                yield linked(np.ascontiguousarray(kept[:, :whole]))
                kept = kept[:, whole:]
        if kept.shape[1]:
            yield linked(np.ascontiguousarray(kept))

    return spread.select("fp", "key", "p", "q", "side").mapInArrow(released(run), "a long, b long").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, label (the least `rep` reachable over the edges) and root (the least fp); only fingerprints
    with edges.

    Roots spread, since a `rep` may stand for several fingerprints (a repeated id, or none). Each round
    takes the least root of the neighbours, then the root of the root, so that long chains shorten by
    half; rounds end when no root has changed.
    """
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    state = materialize(both.select(F.col("a").alias("fp")).distinct().withColumn("root", F.col("fp")))
    total = None
    while True:
        now = state.agg(F.sum(F.col("root").cast("decimal(38,0)")), F.count("*")).first()
        if not now[1] or now[0] == total:
            break
        total = now[0]
        near = both.join(state.select(F.col("fp").alias("a"), "root"), "a").groupBy(F.col("b").alias("fp")).agg(F.min("root").alias("near"))
        state = materialize(state.join(near, "fp").select("fp", F.least("root", "near").alias("root")))
        of_root = state.select(F.col("fp").alias("root"), F.col("root").alias("further"))
        state = materialize(state.join(of_root, "root").select("fp", F.least("root", "further").alias("root")))
    least = state.join(nodes, "fp").groupBy("root").agg(F.min("rep").alias("label"))
    return state.join(least, "root").select("fp", "label", "root")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint and component_id of each row.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows and ids
    stay, each with its own fingerprint; a row without id takes part and gets the component's least
    id. Other columns are not read. An empty table gives no rows.
    """
    prints = materialize(fingerprint_documents(docs, shingle))
    nodes = materialize(prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit((1 << 63) - 1)).alias("rep")))
    labels = components(nodes, near_links(nodes, radius))
    found = materialize(nodes.join(labels, "fp", "left").select("fp", F.coalesce("label", "rep").alias("component_id")))
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of a column: rows with words, start of each row's shingle set, the sets' sorted hashes."""
    data, offsets = text_buffers(column)
    for low, high in text_chunks(offsets):
        part = data[offsets[low] : offsets[high]]
        part = part + (((part >= 0x41) & (part <= 0x5A)).astype(np.uint8) << 5)
        starts, ends, first = word_bounds(part, offsets[low : high + 1] - offsets[low])
        if not len(starts):
            continue
        words = np.diff(first)
        rows = np.flatnonzero(words)
        hashes, of = [], []
        runs = span_hashes(part, starts, ends)
        for n in range(1, shingle):
            short = np.flatnonzero(words == n)
            if len(short):
                hashes.append(run_hashes(runs, n)[first[:-1][short]])
                of.append(short)
        long = np.flatnonzero(words >= shingle)
        if len(long):
            count = words[long] - shingle + 1
            at = np.arange(int(count.sum())) + np.repeat(first[:-1][long] - (np.cumsum(count) - count), count)
            hashes.append(run_hashes(runs, shingle)[at])
            of.append(np.repeat(long, count))
        value, row = np.concatenate(hashes), np.concatenate(of)
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])))
        value, row = value[new], row[new]
        yield low + rows, np.searchsorted(row, rows), value


def set_keys(column: pa.Array, shingle: int = STAGE_SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: a hash of its shingle set (zero: no words), the row among those with words or -1,
    and these rows' band keys: each hashes BAND_ROWS least values under random orders of the shingles."""
    node, place, bands = np.zeros(len(column), np.uint64), np.full(len(column), -1), []
    rng = np.random.default_rng(17)
    salts = rng.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)
    done = 0
    for rows, begin, value in shingle_sets(column, shingle):
        size = np.diff(np.append(begin, len(value))).astype(np.uint64)
        node[rows] = mix64(np.add.reduceat(mix64(value ^ np.uint64(0xA5A5)), begin) + mix64(size)) | np.uint64(1)
        keys = np.zeros((len(rows), BANDS), np.uint64)
        for k, salt in enumerate(salts):
            least = np.minimum.reduceat((value ^ salt) * (salt | np.uint64(1)) ^ (value >> np.uint64(29)) * salt, begin)
            keys[:, k // BAND_ROWS] = mix64(keys[:, k // BAND_ROWS] + least + np.uint64(k))
        bands.append(keys)
        place[rows] = done + np.arange(len(rows))
        done += len(rows)
    return node, place, np.concatenate(bands) if bands else np.zeros((0, BANDS), np.uint64)


def set_prints(begin: np.ndarray, value: np.ndarray) -> np.ndarray:
    """SimHash of each set."""
    size = np.diff(np.append(begin, len(value)))
    out = np.zeros(len(begin), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat(((value >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), begin)
        out |= (2 * ones > size).astype(np.uint64) << np.uint64(bit)
    return out


def similar_to(one: np.ndarray, print_of: np.uint64, prints: np.ndarray, sets: list[np.ndarray], some: np.ndarray, radius: int) -> np.ndarray:
    """Which of `some` sets have a Jaccard similarity of at least SIMILAR with `one`: bit planes sort out those beyond the
    radius, whatever the number of sets, and the sets themselves decide."""
    num, den = SIMILAR
    size = np.array([len(sets[j]) for j in some], np.int64)
    some = some[den * np.minimum(size, len(one)) >= num * np.maximum(size, len(one))]
    if not len(some):
        return some
    few = len(some) <= _SMALL  # compared one by one
    one_print = np.array([print_of], np.uint64)
    some = some[close_pairs(np.repeat(one_print, len(some)), prints[some], radius) if few else close_in_block(one_print, prints[some], radius)[1]]
    good = [np.zeros(0, np.int64)]
    for low in range(0, len(some), 1024):
        part = some[low : low + 1024]
        values = np.concatenate([sets[j] for j in part])
        size = np.array([len(sets[j]) for j in part], np.int64)
        at = np.minimum(np.searchsorted(one, values), len(one) - 1)
        both = np.add.reduceat((one[at] == values).astype(np.int64), np.cumsum(size) - size)
        good.append(part[den * both >= num * (size + len(one) - both)])
    return np.concatenate(good)


def similar_links(prints: np.ndarray, sets: list[np.ndarray], radius: int) -> list[tuple[int, int]]:
    """Links that connect all sets whose Jaccard similarity is at least SIMILAR; pairs that are already
    connected are left out."""
    label, found = np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        good = similar_to(sets[i], prints[i], prints, sets, rest, radius)
        found += [(i, int(j)) for j in good]
        label[np.isin(label, label[good])] = label[i]
    return found


_EDGE = "a long, b long"


def similar_sets(marked: DataFrame, node: str, keys: str) -> DataFrame:
    """Edges (a, b) between nodes of similar shingle sets.

    Sets that share a band meet. Bands with the same members are the same group, of which one is kept; equal sets
    are one node, so copies take no part. A group of up to GROUP_BLOCK sets is compared in a task. Of a larger one, all are
    compared with its least node, in parts that have that node's set; what is then not connected with it is
    compared with all the group, block by block. So no task holds a group, and no pair is left out: two sets that
    are not connected yet are not both connected with the least node.
    """
    nodes = marked.where(F.col(keys).isNotNull()).select(F.col(node).alias("node"), F.col(keys).alias("keys")).dropDuplicates(["node"])
    dealt = materialize(nodes.select("node", F.explode("keys").alias("key")))
    groups = dealt.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("node").alias("hub")).where("n > 1")
    chosen = materialize(groups.groupBy("n", "members").agg(F.min(F.struct("key", "hub")).alias("k")).select("k.key", "k.hub", "n"))
    shared = materialize(dealt.join(chosen, "key"))
    wanted = materialize(shared.select(F.col("node").alias(node)).distinct())
    # Few nodes go to every task: then only texts of these are moved, and of the copies of one only one from each task.
    few = wanted.count() <= MOST_SENT
    text = marked.join(F.broadcast(wanted) if few else wanted, node, "left_semi").groupBy(node).agg(F.any_value("text").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, begin, value in shingle_sets(batch.column(1), STAGE_SHINGLE):
                ends = np.append(begin, len(value))
                sets = [value[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(set_prints(begin, value).view(np.int64)), pa.array(sets, pa.binary())], names=["node", "fp", "grams"])

    sets = text.mapInArrow(released(read), "node long, fp long, grams binary")
    large = shared.where(F.col("n") > GROUP_BLOCK)
    if large.isEmpty():
        return _group_links(shared, sets)
    sets = reread(sets, shared_folder(marked.sparkSession, "sets"), "sets")  # read for groups, stars and rests
    edges = materialize(_group_links(shared.where(F.col("n") <= GROUP_BLOCK), sets).unionByName(_star_links(large, sets)))
    return edges.unionByName(_rest_links(large, sets, edges))


def _group_links(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges of groups, each compared in a task."""
    spread = shared.select("key", "node").join(sets, "node").select("key", "node", "fp", "grams").repartition(shuffle_partitions(shared.sparkSession), "key").sortWithinPartitions("key", "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(group: list[tuple]) -> list[tuple[int, int]]:
            prints = np.array([g[1] for g in group], np.int64).view(np.uint64)
            return [(group[i][0], group[j][0]) for i, j in similar_links(prints, [np.frombuffer(g[2], np.uint64) for g in group], STAGE_RADIUS)]

        last, group, edges = None, [], []
        for batch in batches:
            for key, *member in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if key != last:
                    edges += linked(group)
                    last, group = key, []
                group.append(member)
            yield _edges(edges)
            edges = []
        yield _edges(edges + linked(group))

    return spread.mapInArrow(released(link), _EDGE).distinct()


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in range(2)], names=["a", "b"])


def _blocks(count: Column) -> Column:
    return F.ceil(count / F.lit(GROUP_BLOCK)).cast("int")


def _met(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges between the two sides of each (group, block): those of side 0 are held, those of side 1 pass by. Sets of one
    root are connected and not compared."""
    full = rows.join(sets, "node").select("group", "block", "side", "node", "root", "fp", "grams").repartition("group", "block").sortWithinPartitions("group", "block", "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, roots, prints, sets_of = None, [], None, None, []
        for batch in batches:
            edges: list[tuple[int, int]] = []
            for group, block, side, name, root, fp, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, block) != current:
                    current, held, prints = (group, block), [], None
                if side == 0:
                    held.append((name, root, fp, grams))
                    continue
                if not held:
                    continue
                if prints is None:
                    roots, prints = (np.array([h[k] for h in held], np.int64) for k in (1, 2))
                    prints, sets_of = prints.view(np.uint64), [np.frombuffer(h[3], np.uint64) for h in held]
                good = similar_to(np.frombuffer(grams, np.uint64), np.array([fp], np.int64).view(np.uint64)[0], prints, sets_of, np.flatnonzero(roots != root), STAGE_RADIUS)
                first = np.unique(roots[good], return_index=True)[1]  # one link to each root
                edges += [(held[j][0], name) for j in good[first].tolist()]
            yield _edges(edges)

    return full.mapInArrow(released(compare), _EDGE).distinct()


def _star_links(large: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges between each large group's least node and its others, which are dealt to blocks by their hash."""
    pairs = large.where("node <> hub").select("hub", "node").distinct()
    sizes = materialize(pairs.groupBy("hub").agg(_blocks(F.count("*")).alias("blocks")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = pairs.join(sizes, "hub").select(F.col("hub").alias("group"), block.alias("block"), F.lit(1).alias("side"), "node", F.col("node").alias("root"))
    hubs = sizes.select(F.col("hub").alias("group"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), F.col("hub").alias("node"), F.col("hub").alias("root"))
    return _met(hubs.unionByName(members), sets)


def _rest_links(large: DataFrame, sets: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between what is not connected with its group's least node and all others of the group."""
    ends = edges.select(F.col("a").alias("fp")).unionByName(edges.select(F.col("b").alias("fp"))).distinct().withColumn("rep", F.lit(0).cast("long"))
    roots = materialize(components(ends, edges).select("fp", "root"))
    root_of = lambda rows, c, name: rows.join(roots.select(F.col("fp").alias(c), F.col("root").alias(f"_{c}")), c, "left").withColumn(name, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    placed = materialize(root_of(root_of(large, "node", "root"), "hub", "hub_root"))
    apart = placed.where("root <> hub_root")
    sizes = materialize(apart.groupBy("key", "n").agg(_blocks(F.count("*")).alias("rests")).withColumn("parts", _blocks(F.col("n"))))
    at = lambda to: F.pmod(F.xxhash64("node"), F.col(to)).cast("int")
    sized = lambda rows: rows.join(sizes.select("key", "rests", "parts"), "key")
    every = lambda to: F.explode(F.sequence(F.lit(0), F.col(to) - 1))
    columns = ["node", "root", F.col("key").alias("group")]
    held = sized(apart).select(*columns, F.lit(0).alias("side"), every("parts").alias("_part"), at("rests").alias("_rest"), "rests")
    passing = sized(placed).select(*columns, F.lit(1).alias("side"), at("parts").alias("_part"), every("rests").alias("_rest"), "rests")
    rows = held.unionByName(passing).withColumn("block", F.col("_part") * F.col("rests") + F.col("_rest"))
    return _met(rows.select("group", "block", "side", "node", "root"), sets)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of near copies: that of the least id, then of the least text hash.

    Near copies have a Jaccard similarity of at least 0.8 on sets of five-word shingles (a shorter text
    is one shingle), directly or over others. Rows without id come last; texts without words are alike.
    An empty table gives no rows.
    """
    small_batches(spark)
    node, keys, row = free_name(docs, "near_node"), free_name(docs, "near_keys"), free_name(docs, "near_row")
    fields = ", ".join((f"`{node}` long", f"`{keys}` array<long>"))
    names, at = docs.columns, docs.columns.index("text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node_of, place, bands = set_keys(batch.column(at))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node_of.view(np.int64)), lists.take(pa.array(place, mask=place < 0))], names=[*names, node, keys])

    kind = StructType([*docs.schema.fields, *StructType.fromDDL(fields).fields])
    marked = reread(docs.mapInArrow(released(mark), kind).withColumn(row, F.monotonically_increasing_id()), shared_folder(spark, "near"), "marked")
    nodes = marked.select(F.col(node).alias("fp"), F.lit(0).cast("long").alias("rep"))
    found = components(nodes.distinct(), materialize(similar_sets(marked, node, keys))).select(F.col("fp").alias(node), "root")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), row)
    whose = marked.select(node, row, order.alias("order")).join(found, node, "left").groupBy(F.coalesce("root", node)).agg(F.min("order").alias("first"))
    return marked.join(whose.select(F.col(f"first.{row}").alias(row)), row, "left_semi").select(*names)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
