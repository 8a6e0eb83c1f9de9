"""SimHash near-duplicates: fingerprints, a binary trie self-join within a Hamming budget, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanika.llm.common import LOWER, blocks, cut, drop, hash_spans, join_hot, mix, parts, repeat_ranges, text_buffers, words

#: The hash of a shingle is XXH64 with this seed.
SEED = 42
#: Differing bits at which two fingerprints still link.
BUDGET = 2
#: Twice the distinct fingerprints that a bucket should have; one with eight times as many is dealt out again by more of their bits.
BUCKET = 4096
_TOP = np.uint64(1 << 63)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of so many words, repeats included; of all words if there are fewer."""
    w = text.lower().split()  # of bytes: A-Z and the blanks \x20 \x09-\x0D only
    if not w:
        return np.empty(0, "<u8")
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(b" ".join(w), SEED)], "<u8")
    return np.fromiter((h(b" ".join(x), SEED) for x in zip(*(w[k:] for k in range(words)), strict=False)), "<u8", len(w) - words + 1)


def simhash(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half the hashes; no hashes: 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every document; a null text is empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch):
                data, offs = text_buffers(b.column("text"))
                raw, at = data.tobytes(), offs.tolist()
                fp = [simhash(shingle_hashes(raw[i:j], words)) for i, j in zip(at, at[1:], strict=False)]
                yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": np.array(fp, np.uint64).view(np.int64)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(each, "doc_id long, fp long")


#: Pairs of trie nodes that are held at once; more of them are walked part by part.
FRONTIER = 1 << 16
#: Two nodes with no more pairs of values than this are compared value by value.
SMALL = 4


def trie_pairs(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of values within budget differing bits, for each range lo:hi of ascending distinct values; in parts.

    A node of the binary trie over a range is a sub-range whose values share their first bits. Pairs of nodes go down one
    bit at a time, many at once; a pair's errors grow where its two sides take different children, and a
    pair over the budget is dropped. Pairs of SMALL nodes are compared value by value. What is held is bounded by FRONTIER, not by the pairs found.
    """
    zeros: dict[int, np.ndarray] = {}
    a0, a1 = lo.astype(np.int64), hi.astype(np.int64)
    stack = [(63, a0, a1, a0.copy(), a1.copy(), np.zeros(len(a0), np.int8))]
    while stack:
        bit, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(bit, *(x[half:] for x in (a0, a1, b0, b1, err))), (bit, *(x[:half] for x in (a0, a1, b0, b1, err)))]
            continue
        small = (a1 - a0) * (b1 - b0) <= SMALL if bit >= 0 else np.ones(len(a0), bool)
        if small.any():
            na, nb = (a1 - a0)[small], (b1 - b0)[small]
            pair = np.repeat(np.arange(len(na)), na * nb)
            within = np.arange(len(pair)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            i, j = a0[small][pair] + within // nb[pair], b0[small][pair] + within % nb[pair]
            keep = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
            if keep.any():
                yield i[keep], j[keep]
            a0, a1, b0, b1, err = (x[~small] for x in (a0, a1, b0, b1, err))
        if not len(a0):
            continue
        if bit not in zeros:
            zeros[bit] = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1) == 0)])
        z = zeros[bit]
        am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
        other = a0 != b0  # a node with itself has its two children as one pair
        sides = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), (am[other], a1[other], b0[other], bm[other], err[other] + 1)]
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*sides, strict=True))
        live = (a1 > a0) & (b1 > b0) & (err <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        stack.append((bit - 1, a0[live], a1[live], b0[live], b1[live], err[live]))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n can be reached from by the pairs."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if np.array_equal(label[i], label[j]):
            return label


#: Fingerprints that differ in two bits or fewer agree in one of three groups of their bits, whatever the groups are.
GROUPS = 3


def _group_width(n: int, bucket: int) -> int:
    """Bits of a group, so that n values of one bucket each make buckets of about half the given size."""
    return min(63 // GROUPS, max(1, math.ceil(math.log2(max(2.0, 2 * n / bucket)))))


def _group(value: Column, width: int, g: int) -> Column:
    return F.shiftrightunsigned(value, width * g).bitwiseAND(F.lit((1 << width) - 1))


def _rest(value: Column, width: int, g: int) -> Column:
    """The bits outside group g, moved together."""
    return value.bitwiseAND(F.lit((1 << width * g) - 1)).bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, width * (g + 1)), width * g))


def _first_group(x: np.ndarray, width: int) -> np.ndarray:
    """The first group in which x has no bit."""
    mask = np.uint64((1 << width) - 1)
    return np.argmax(np.stack([(x >> np.uint64(width * g)) & mask == 0 for g in range(GROUPS)]), axis=0)


def _rest_bits(x: np.ndarray, width: int, group: np.ndarray) -> np.ndarray:
    low = np.uint64(width) * group.astype(np.uint64)
    return x & ((np.uint64(1) << low) - np.uint64(1)) | (x >> (low + np.uint64(width))) << low


def link(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """fp, root, links: each fingerprint's root in some bucket, and the copies of others that it links with there.

    fps: distinct fp, with their copies. Fingerprints meet in three buckets, one for each of three disjoint groups of their bits, so all that differ
    in two bits or fewer meet. The groups' width follows from the count, so that a bucket holds about half of bucket fingerprints. One with eight times bucket
    is dealt out again by three groups of the bits that are left. In a bucket, trie_pairs() finds the pairs; a
    task gives back a row for each fingerprint, never the pairs.
    """
    spark = fps.sparkSession
    width = _group_width(fps.count(), bucket)
    inner = min(16, (64 - width) // GROUPS)
    keys = F.array(*(F.struct((F.lit(g << width) + _group(F.col("fp"), width, g)).cast("long").alias("key"), _rest(F.col("fp"), width, g).alias("rest")) for g in range(GROUPS)))
    rows = fps.select("fp", "copies", F.explode(keys).alias("k")).select("fp", "copies", "k.key", "k.rest")
    hot = rows.groupBy("key").count().filter(F.col("count") > 8 * bucket).select("key")
    if hot.isEmpty():
        rows = rows.withColumn("sub", F.lit(0).cast("long"))
    else:  # a bucket of so many is one of n / bucket at most
        subs = F.array(*((F.lit(1 + (g << inner)) + _group(F.col("rest"), inner, g)).cast("long") for g in range(GROUPS)))
        rows = rows.join(hot.withColumn("hot", F.lit(True)), "key", "left")
        rows = rows.withColumn("sub", F.explode(F.when(F.col("hot"), subs).otherwise(F.array(F.lit(0).cast("long")))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 4

        def joined(key: np.ndarray, sub: np.ndarray, fp: np.ndarray, copies: np.ndarray) -> pa.RecordBatch:
            u = fp.view(np.uint64) ^ _TOP  # ascending as the signed values are
            at = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1, [len(key)]])
            more = np.diff(at) > 1
            label, links = np.arange(len(u)), np.zeros(len(u))
            for i, j in trie_pairs(u, at[:-1][more], at[1:][more], BUDGET):
                label = roots(len(u), label[i], label[j])[label]
                x, group = u[i] ^ u[j], key[i] >> width
                # A pair that several buckets hold counts in the first of them.
                first = _first_group(x, width) == group
                deep = np.flatnonzero(first & (sub[i] > 0))
                first[deep] = _first_group(_rest_bits(x[deep], width, group[deep]), inner) == (sub[i[deep]] - 1) >> inner
                links += np.bincount(i[first], copies[j[first]], len(u)) + np.bincount(j[first], copies[i[first]], len(u))
            out = np.flatnonzero((label != np.arange(len(u))) | (links > 0))
            return pa.record_batch({"fp": fp[out], "root": fp[label[out]], "links": links[out].astype(np.int64)})

        for batch in batches:
            held = [np.concatenate([x, np.asarray(batch.column(c))]) for x, c in zip(held, ("key", "sub", "fp", "copies"), strict=True)]
            key, sub = held[:2]
            new = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1]))
            if len(new):
                end = int(new[-1]) + 1
                yield joined(*(x[:end] for x in held))
                held = [x[end:] for x in held]
        if len(held[0]):
            yield joined(*held)

    dealt = rows.select("key", "sub", "fp", "copies").repartition(parts(spark), "key", "sub").sortWithinPartitions("key", "sub", "fp")
    return dealt.mapInArrow(each, "fp long, root long, links long")


#: So few edges are joined in one task (16 bytes each); more of them in rounds, until they are so few.
FEW_EDGES = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """u, root for every u that the edges (u, v: longs) join to a smaller one: root is the smallest of its component.

    Large stars and small stars take turns: each round hangs a node's larger, then its smaller neighbours
    on the smallest of them. A round is one table in the shared folder, and
    the last has a row for each node only. FEW_EDGES or fewer are joined in one task instead, with the same result. Null ends and loops are ignored; no edges: no rows.
    """
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        last = edges
        if edges.count() <= FEW_EDGES:
            edges = cut(edges.coalesce(1).mapInArrow(_joined, "u long, v long"), "edges")
            drop(last)
            break
        if _stars(edges):
            break
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        edges = cut(small, "edges")
        drop(last)
    return edges.toDF("u", "root")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a few nodes as stars: each node that isn't the smallest of its component, and that."""
    held = [(np.asarray(b.column("u")), np.asarray(b.column("v"))) for b in batches]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held, strict=True))
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = roots(len(names), at[: len(u)], at[len(u) :])
    out = np.flatnonzero(label != np.arange(len(names)))
    yield pa.record_batch({"u": names[out], "v": names[label[out]]})


def _stars(edges: DataFrame) -> bool:
    """Every u hangs on one v only, and no v on anything."""
    return edges.groupBy("u").count().filter("count > 1").isEmpty() and edges.select(F.col("v").alias("u")).join(edges, "u", "left_semi").isEmpty()


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_links of every document.

    Fingerprints of documents (doc_id, text) link within BUDGET bits; component_id is the smallest doc_id
    that links lead to, n_links how many other rows a document links with. Copies of a fingerprint are one
    from the first shuffle on, so a large group costs no more than a small one. A null or blank text has fingerprint
    zero, which links like any other. Null doc_ids don't count as smallest; repeated rows are repeated in the result. Other columns
    are ignored.
    """
    marks = cut(fingerprints(docs, words), "fingerprints")
    fps = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "distinct")
    linked = cut(link(fps), "links")
    label = components(linked.select(F.col("fp").alias("u"), F.col("root").alias("v")))
    links = linked.groupBy("fp").agg(F.sum("links").alias("links"))
    known = fps.join(label.withColumnRenamed("u", "fp"), "fp", "left").join(links, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(least, "root").select("fp", "copies", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return join_hot(marks, known, "fp", "copies", marks.count()).select("doc_id", hexed, "component_id", "n_links")


#: Bands of the text's own fingerprints in similar(), and shingles that each is made of.
BANDS, ROWS = 16, 4
_ODD = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_31 = np.uint64(31)


class Shingled:
    """The shingles (of so many words) of a block of texts, as hashes: where each text's begin, and how many it has."""

    def __init__(self, column: pa.Array, k: int) -> None:
        data, offs = text_buffers(column)
        low = LOWER[data]
        starts, lens, per = words(low, offs)
        h = hash_spans(low, starts, lens)
        first = np.cumsum(per) - per
        within = np.arange(len(h)) - np.repeat(first, per)
        # The text as a sequence of words: a sum of its words' hashes, each mixed with its place.
        placed = np.concatenate([mix(h ^ mix(within.astype(np.uint64))), [np.uint64(0)]])
        sums = np.add.reduceat(placed, np.minimum(first, len(h))) if len(per) else np.empty(0, np.uint64)
        self.text_id = mix(np.where(per > 0, sums, np.uint64(0)) + per.astype(np.uint64)).view(np.int64)
        # A text of fewer words is one shingle: the words that it lacks are zeros.
        n = np.where(per > 0, np.maximum(per - k + 1, 1), 0)
        at = repeat_ranges(first, n)
        left = np.repeat(per, n) - (at - np.repeat(first, n))
        out = mix(h[at])
        for d in range(1, k):
            ok = left > d
            out = mix(out + np.where(ok, h[np.minimum(at + d, len(h) - 1)] if len(h) else 0, np.uint64(0)))
        self.hashes, self.n, self.first = out, n, np.cumsum(n) - n

    def set_of(self, t: int) -> np.ndarray:
        return np.unique(self.hashes[self.first[t] : self.first[t] + self.n[t]])

    def distinct(self) -> np.ndarray:
        """How many different shingles each text has."""
        owner = np.repeat(np.arange(len(self.n)), self.n)
        order = np.lexsort((self.hashes, owner))
        h, owner = self.hashes[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        return np.bincount(owner[new], minlength=len(self.n))


def band_fingerprints(s: Shingled) -> np.ndarray:
    """For each text BANDS SimHashes, each of the ROWS shingles that come first in ROWS orders of all its shingles; zeros for a text without any."""
    some = np.flatnonzero(s.n)
    least = np.empty((len(some), BANDS * ROWS), np.uint64)
    if len(some):
        for k, odd in enumerate(_ODD):
            x = s.hashes * odd
            x ^= x >> _31
            least[:, k] = np.minimum.reduceat(x, s.first[some])
    out = np.zeros((len(s.n), BANDS), np.uint64)
    for i in range(0, len(some), 4096):
        chosen = mix(least[i : i + 4096]).astype("<u8")
        bits = np.unpackbits(chosen.view(np.uint8).reshape(-1, BANDS, ROWS, 8), axis=3, bitorder="little")
        ones = bits.sum(axis=2, dtype=np.uint8)
        out[some[i : i + 4096]] = np.packbits(2 * ones > ROWS, axis=2, bitorder="little").view("<u8")[:, :, 0]
    return out


#: Texts of a block at most, and shingles of its texts together: what a task compares with another block at once.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: A class of sizes spans a little more than two alike texts can differ by, so texts that are more than a class apart can't be alike.
SLACK = 1.01


def similar(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, component_id of every document: texts whose word shingles have a Jaccard similarity of threshold or more.

    One 64-bit SimHash doesn't tell a similarity of 0.8 from none: such pairs differ in 4 to 14 bits. So the fingerprints here
    are banded: each is the SimHash of a few shingles chosen by minwise orders, equal or nearly so for similar texts. The
    same texts (as words, ASCII case aside) are one from the first shuffle on. The trie self-join puts nearly equal fingerprints of a band in one bucket;
    texts of a bucket are candidates of each other. Candidates that hang together and are few meet in one task, all with all. Where they are many, each
    is first compared with central texts of its largest bucket; then all pairs of each bucket that this has not joined, block by block (open_cells()). Every comparison is exact,
    on whole shingle sets, whose sizes are counts of distinct shingles. A similarity of 0.8 leaves 2 of 10,000 pairs without a common band; no other pair is lost.
    Null or blank texts are copies of each other. component_id: the smallest doc_id of the group (nulls don't count). Texts are told apart by 64 bits of hash.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, limit=2 << 20):
                s = Shingled(b.column("text"), words)
                bands = pa.array(band_fingerprints(s).view(np.int64).ravel())
                yield pa.record_batch({"doc_id": b.column("doc_id"), "text_id": s.text_id, "size": s.distinct(), "bands": pa.ListArray.from_arrays(np.arange(0, BANDS * len(s.n) + 1, BANDS, dtype=np.int32), bands)})

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, limit=2 << 20):
                s = Shingled(b.column("text"), words)
                yield pa.record_batch({"text_id": s.text_id, "shingles": pa.array([s.set_of(t).tobytes() for t in range(len(s.n))], pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marks = cut(rows.mapInArrow(each, "doc_id long, text_id long, size long, bands array<long>"), "bands")
    texts = cut(marks.groupBy("text_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")), "texts")
    banded = band_buckets(texts)
    heads = banded.groupBy("band", "fp").agg(F.min("text_id").alias("v"))
    near = components(banded.join(heads, ["band", "fp"]).select(F.col("text_id").alias("u"), "v"))
    near = near.union(near.select("root", "root").distinct()).toDF("text_id", "near")
    near = cut(near.join(texts.select("text_id", "size"), "text_id"), "near")
    groups = near.groupBy("near").agg(((F.count("*") <= BLOCK) & (F.sum("size") <= 2 * BLOCK_SHINGLES)).alias("few"))
    near = cut(near.join(groups, "near"), "groups")

    # Sets are made again, of one document of each text that has candidates: the sets of all texts would be larger than the texts.
    some = texts.join(near, "text_id", "left_semi").select("first").distinct()
    sets = rows.join(some, rows["doc_id"].eqNullSafe(some["first"]), "left_semi").mapInArrow(shingles, "text_id long, shingles binary")
    sets = cut(sets.join(near, "text_id", "left_semi").dropDuplicates(["text_id"]), "sets")

    few = near.filter("few").select(F.col("near").alias("cell"), F.lit(0).alias("side"), "text_id")
    many = cut(banded.join(near.filter("NOT few").select("text_id", "size"), "text_id"), "many")
    edges = cut(compare(few.union(star_cells(many)), sets, threshold), "alike")
    label = components(edges)
    cells = open_cells(many, label, threshold)
    if cells is not None:
        label = components(edges.union(compare(cells, sets, threshold)))
    known = texts.select("text_id", "copies", "first").join(label.withColumnRenamed("u", "text_id"), "text_id", "left").withColumn("root", F.coalesce("root", "text_id"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = cut(known.join(least, "root").select("text_id", "copies", "component_id"), "known")
    drop(banded, near, sets, many, edges, texts)
    return join_hot(marks.select("doc_id", "text_id"), known, "text_id", "copies", marks.count()).select("doc_id", "component_id")


def band_buckets(texts: DataFrame) -> DataFrame:
    """text_id, band, fp, n: the bucket of each text in each band, named by a fingerprint that it links to, and how many texts are in it (if more than one)."""
    rows = texts.filter("size > 0").select("text_id", F.posexplode("bands").alias("band", "fp"))
    # Nearly equal fingerprints of all bands are found in one join: chance pairs across bands are as rare as within one.
    fps = cut(rows.groupBy("fp").agg(F.count("*").alias("copies")), "band_fps")
    linked = link(fps).filter("root <> fp").select("fp", "root").distinct()
    # A fingerprint is in its own bucket, and in that of each root it has in some bucket of the join.
    more = rows.join(linked, "fp").select("text_id", "band", F.col("root").alias("fp"))
    rows = cut(rows.select("text_id", "band", "fp").union(more).distinct(), "band_rows")
    sizes = rows.groupBy("band", "fp").agg(F.count("*").alias("n")).filter("n > 1")
    out = cut(rows.join(sizes, ["band", "fp"]), "band_sizes")
    drop(fps, rows)
    return out


def _parts_of(count: Column, shingles: Column) -> Column:
    """Blocks for so many texts with so many shingles."""
    return F.greatest(F.ceil(count / BLOCK), F.ceil(shingles / BLOCK_SHINGLES))


def star_cells(many: DataFrame) -> DataFrame:
    """cell, side, text_id: every text (side 1) with the two most central ones (side 0) of the largest bucket that it is in.

    many: text_id, band, fp, n, size. Central are the text with most neighbours over all its buckets, and the one of the least text_id.
    """
    top = many.groupBy("text_id").agg(F.max(F.struct("n", "band", "fp")).alias("top"), F.sum("n").alias("weight"), F.first("size").alias("size")).select("text_id", "weight", "size", "top.band", "top.fp")
    stars = top.groupBy("band", "fp").agg(F.max(F.struct("weight", "text_id")).alias("most"), F.min("text_id").alias("low"), _parts_of(F.count("*"), F.sum("size")).alias("k"))
    own = top.join(stars, ["band", "fp"]).select("band", "fp", F.pmod("text_id", "k").alias("part"), F.lit(1).alias("side"), "text_id", "most.text_id", "low").toDF("band", "fp", "part", "side", "text_id", "most", "low")
    heads = stars.select("band", "fp", "k", F.explode(F.array_distinct(F.array("most.text_id", "low"))).alias("text_id"))
    heads = heads.select("band", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("part"), F.lit(0).alias("side"), "text_id")
    own = own.filter("text_id <> most AND text_id <> low").drop("most", "low")
    return own.union(heads).select(F.xxhash64("band", "fp", "part").alias("cell"), "side", "text_id")


def open_cells(many: DataFrame, label: DataFrame, threshold: float) -> DataFrame | None:
    """cell, side, text_id: the blocks of large buckets that have to be compared with each other; None: none have to.

    many: text_id, band, fp, n, size (distinct shingles: sets that are alike by threshold have sizes of at least that ratio); label (u, root): what is joined
    already. A bucket whose texts are not all joined is dealt into blocks by size class, each of BLOCK texts and BLOCK_SHINGLES shingles at most; joined texts that are more have blocks of their own, which are not compared with
    each other. A cell is two blocks of the same or of neighbouring classes, or one with itself (side 0 only).
    """
    rows = many.join(label.withColumnRenamed("u", "text_id"), "text_id", "left").withColumn("root", F.coalesce("root", "text_id"))
    groups = rows.groupBy("band", "fp", "root").agg(F.count("*").alias("g"), F.first("n").alias("n")).filter("g < n")
    rows = cut(rows.drop("n").join(groups.drop("n"), ["band", "fp", "root"]), "open")
    if rows.isEmpty():
        return None
    rows = rows.withColumn("only", F.when(F.col("g") > BLOCK, F.col("root"))).withColumn("class", F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / math.log(SLACK / threshold)))
    key = ["band", "fp", "only", "class"]
    dealt = rows.groupBy(*key).agg(_parts_of(F.count("*"), F.sum("size")).alias("k")).toDF("b", "f", "o", "c", "k")
    rows = rows.join(dealt, (F.col("band") == F.col("b")) & (F.col("fp") == F.col("f")) & F.col("only").eqNullSafe(F.col("o")) & (F.col("class") == F.col("c")))
    rows = rows.withColumn("block", F.xxhash64("band", "fp", F.col("only").isNull(), "only", "class", F.pmod("text_id", "k")))
    rows = cut(rows.select("text_id", "band", "fp", "only", "class", "block"), "blocks")
    each = rows.select("band", "fp", "block", "only", "class").distinct()
    pairs = each.toDF("band", "fp", "x", "ox", "cx").join(each.toDF("band", "fp", "y", "oy", "cy"), ["band", "fp"]).filter("x <= y AND abs(cx - cy) <= 1 AND NOT coalesce(ox = oy, false)")
    pairs = pairs.select("x", "y", F.xxhash64("x", "y").alias("cell"))
    sides = pairs.select("cell", F.lit(0).alias("side"), F.col("x").alias("block")).union(pairs.filter("x <> y").select("cell", F.lit(1), "y"))
    return sides.join(rows.select("block", "text_id"), "block").select("cell", "side", "text_id")


#: Shingles whose columns are made at once.
COLUMNS = 4096


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values the sets (ascending) at left and those at right have in common, as a table of left by right: products of 0/1 tables, some columns at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    start = np.flatnonzero(new)
    shared = np.repeat(np.diff(start, append=len(flat)) > 1, np.diff(start, append=len(flat)))
    column = np.cumsum(new & shared) - 1
    column, owner = column[shared], owner[shared]
    edges = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + COLUMNS, COLUMNS))
    same = len(left) == len(right) and np.array_equal(left, right)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a == b:
            continue
        table = np.zeros((len(sets), int(column[b - 1] - column[a]) + 1), np.float32)
        table[owner[a:b], column[a:b] - column[a]] = 1.0
        x = table if len(left) == len(sets) else table[left]
        out += x @ (x if same else table[right]).T
    return out


def compare(cells: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """u, v: joins of the texts that are alike in each cell (cell, side, text_id): those of side 0 with those of side 1, or, if that has none, with each other. A row for a text at most, not for a pair."""

    def joined(ids: list[int], sides: list[int], own: list[np.ndarray]) -> pa.RecordBatch:
        side, size = np.array(sides), np.array([len(x) for x in own], np.float64)
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if any(sides) and not all(sides) else (np.arange(len(ids)),) * 2
        common = common_counts(own, left, right)
        i, j = np.nonzero(common >= threshold * (size[left][:, None] + size[right] - common) - 1e-9)
        label = roots(len(ids), left[i], right[j])
        out = np.flatnonzero(label != np.arange(len(ids)))
        names = np.array(ids, np.int64)
        return pa.record_batch({"u": names[out], "v": names[label[out]]})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sides, own = None, [], [], []
        for batch in batches:
            for cell, side, text_id, data in zip(*(batch.column(c).to_pylist() for c in ("cell", "side", "text_id")), batch.column("shingles"), strict=True):
                if cell != now:
                    if len(ids) > 1:
                        yield joined(ids, sides, own)
                    now, ids, sides, own = cell, [], [], []
                ids.append(text_id)
                sides.append(side)
                own.append(np.frombuffer(data.as_buffer(), "<u8").copy())
        if len(ids) > 1:
            yield joined(ids, sides, own)

    dealt = cells.join(sets, "text_id").repartition(parts(cells.sparkSession), "cell").sortWithinPartitions("cell", "side", "text_id")
    return dealt.mapInArrow(each, "u long, v long")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those whose group has a smaller doc_id, columns as they are. Rows of one doc_id stay or go together; null doc_ids stay."""
    gone = similar(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
