"""Benchmark decontamination by latent semantic retrieval.

Texts are read once: each word becomes its place among the benchmark's words, and what follows works on these places. Passages of all documents
are TF-IDF vectors. A randomised SVD of them, by a sparse sign sketch of all passages in one distributed pass, gives a latent
space; the benchmark's items are rows too, with as much weight as the whole corpus, so that the space
holds what tells them apart. Windows of every document are compared with every item by their cosine there: since both are sums of word vectors,
a window's product with an item is a sum of one number a word, and the products of all windows with all items come from running
sums, without any window's vector being made. A candidate is confirmed by the longest common subsequence of its words with the item's; one that is
less than nearly whole also has to hold the item's answer, its rarest words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanika.llm.common import blocks, cut, hash_spans, lower_latin, mix, parts, text_buffers, words

#: Words of the passages that the SVD is made of, latent dimensions at most, columns of the sketch, and those that a passage is added to.
PASSAGE, RANK, SKETCH, SIGNS = 64, 256, 320, 8
#: Items whose products are summed at once, and the bytes of products that a worker keeps.
ITEMS, KEPT_BYTES = 1024, 64 << 20
#: Least product of a window with an item as a share of the item's own, and least cosine, of a candidate.
LEAST_SHARE, LEAST_COSINE = 0.45, 0.3
#: Common subsequence, as a share of the item's words: confirmed by itself; confirmed with the answer.
WHOLE, PARAPHRASE = 0.8, 0.6
#: Rarest words of an item that are its answer, and the share of them that must be there.
ANSWER_WORDS, ANSWER_SHARE = 5, 0.6
#: A shorter item has no paraphrases: all its words must follow each other as in the item.
SHORT = 5

#: Signs between words.
_GAP = np.zeros(256, bool)
_GAP[[c for c in range(128) if not chr(c).isalnum()]] = True


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (lower case, without signs) of all texts, and how many each text has."""
    data, offs = text_buffers(column)
    low = lower_latin(data)
    starts, lens, per = words(low, offs, _GAP)
    return hash_spans(low, starts, lens), per


def _slots(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places in the ascending vocabulary, -1 for other words."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def _entries(slots: np.ndarray, per: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passage, word and count of each distinct word of each passage; and how many passages each text has."""
    passages = -(-per // PASSAGE)
    base = np.cumsum(passages) - passages
    keep = np.flatnonzero(slots >= 0)
    text = np.repeat(np.arange(len(per)), per)[keep]
    p = base[text] + (keep - (np.cumsum(per) - per)[text]) // PASSAGE
    key = np.sort(p * size + slots[keep])
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    count, key = np.diff(start, append=len(key)), key[start]
    return key // size, key % size, count, passages


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit of an integer for each entry of a."""
    places: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for y in b.tolist():
        m = row & places.get(y, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


class Items:
    """The benchmark's items and its latent space: what the benchmark's size bounds, so it goes to every task."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        hashes, per = word_hashes(pa.array(texts, pa.string()))
        at = np.cumsum(per) - per
        keep = np.flatnonzero(per)
        self.ids = [ids[k] for k in keep]
        self.vocabulary = np.unique(hashes)
        self.words = [_slots(self.vocabulary, hashes[at[k] : at[k] + per[k]]) for k in keep] if len(keep) else []

    def place(self, df: np.ndarray, n: int) -> None:
        """idf of the vocabulary by the corpus's document frequencies, and the items' TF-IDF entries and answers."""
        self.idf = np.log((n + 1) / (df + 1)) + 0.05
        self.entries, self.answers, self.counts = [], [], []
        for w in self.words:
            u, count = np.unique(w, return_counts=True)
            self.entries.append((u, count * self.idf[u]))
            self.counts.append(list(zip(u.tolist(), count.tolist(), strict=True)))
            self.answers.append(u[np.argsort(-self.idf[u], kind="stable")[:ANSWER_WORDS]])

    def span(self, sketch: np.ndarray, n: int) -> None:
        """The latent space: leading left singular vectors of the sketch of all rows, items included."""
        weight = np.sqrt(max(1.0, n / max(1, len(self.ids))))
        sign = np.random.default_rng(11).standard_normal((len(self.ids), sketch.shape[1])) / np.sqrt(sketch.shape[1])
        for (u, x), r in zip(self.entries, sign, strict=True):
            sketch[u] += weight * (x / np.linalg.norm(x))[:, None] * r
        left, _, _ = np.linalg.svd(sketch, full_matrices=False)
        basis = left[:, : min(RANK, left.shape[1])]
        latent = np.stack([x @ basis[u] for u, x in self.entries])
        self.norm2 = (latent**2).sum(axis=1)
        self.word_vectors = (basis * self.idf[:, None]).astype(np.float32)
        self.latent = latent.astype(np.float32)
        length = np.array([len(w) for w in self.words])
        self.classes = []  # words of a window, and the items that are looked for in such windows
        size = 8
        while (length > 0.375 * size).any() or size == 8:
            own = np.flatnonzero((length <= 0.75 * size) & (length > (0.375 * size if size > 8 else 0)))
            self.classes += [(size, own[k : k + ITEMS]) for k in range(0, len(own), ITEMS)]
            size *= 2
        self.keep = 4 * len(self.vocabulary) * len(self.ids) <= KEPT_BYTES
        self.products: dict[int, np.ndarray] = {}

    def _shares(self, k: int, some: np.ndarray | slice) -> np.ndarray:
        """What each of some words adds to a window's product with each item of class k, as a share of the least that counts."""
        own = self.classes[k][1]
        return self.word_vectors[some] @ (self.latent[own] / (LEAST_SHARE * self.norm2[own, None] + 1e-12).astype(np.float32)).T

    def search(self, slots: np.ndarray, per: np.ndarray) -> list[tuple[int, tuple[int, float, float, float, int]]]:
        """By text: item, cosine, subsequence share, answer share and word position of each item that its words hold.

        slots: the words of all texts, per: how many each text has. A class's windows are four steps long: products are summed
        step by step, and each four neighbouring steps are a window. Three empty steps keep texts apart.
        """
        first = np.cumsum(per) - per
        inside = np.flatnonzero(slots >= 0)
        if not len(inside):
            return []
        text = np.repeat(np.arange(len(per)), per)[inside]
        within, word = inside - first[text], slots[inside]
        if not self.keep:
            some, word = np.unique(word, return_inverse=True)
        found: dict[tuple[int, int], tuple[float, float, float, int]] = {}
        for c, (size, own) in enumerate(self.classes):
            if not self.keep:
                product = self._shares(c, some)
            elif c in self.products:
                product = self.products[c]
            else:
                product = self.products[c] = np.ascontiguousarray(self._shares(c, slice(None)))
            step = size // 4
            steps = -(-per // step) + 3
            base = np.cumsum(steps) - steps + 3
            at = base[text] + within // step
            start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sums = np.zeros((int(steps.sum()) + 6, product.shape[1]), np.float32)
            # The first words of all steps, then the second ones, and so on: faster than reduceat along rows.
            nth = np.arange(len(at)) - np.repeat(start, np.diff(start, append=len(at)))
            for k in range(int(nth.max()) + 1):
                one = np.flatnonzero(nth == k)
                sums[at[one]] += product[word[one]]
            two = sums[:-1] + sums[1:]
            windows = two[:-2]
            windows += two[2:]
            last, there = -1, frozenset()
            for k, i in zip(*(x.tolist() for x in np.nonzero(windows >= 1.0)), strict=True):
                if k != last:
                    last, d = k, int(np.searchsorted(base, k + 3, "right")) - 1
                    a = (k - int(base[d])) * step
                    there = frozenset(slots[first[d] + max(0, a - step) : min(first[d] + per[d], first[d] + a + size + step)].tolist())
                item = int(own[i])
                # A common subsequence has no words but those that both hold.
                if found.get((d, item), (0.0,))[0] < 1.0 and sum([n for w, n in self.counts[item] if w in there]) >= PARAPHRASE * len(self.words[item]):
                    self._confirm(found, (d, item), slots[first[d] : first[d] + per[d]], a, size)
        return [(d, (self.ids[item], c, s, x, a)) for (d, item), (s, c, x, a) in sorted(found.items())]

    def _confirm(self, found: dict, key: tuple[int, int], slots: np.ndarray, a: int, size: int) -> None:
        item, words = key[1], self.words[key[1]]
        w = slots[max(0, a) : a + size]
        v = self.word_vectors[w[w >= 0]].sum(axis=0)
        cosine = float(v @ self.latent[item]) / (float(np.linalg.norm(v)) * float(np.sqrt(self.norm2[item])) + 1e-12)
        if cosine < LEAST_COSINE:
            return
        region = slots[max(0, a - size // 4) : a + size + size // 4]
        if len(words) < SHORT:
            runs = np.lib.stride_tricks.sliding_window_view(region, len(words)) if len(region) >= len(words) else region[:0, None]
            share = 1.0 if (runs == words).all(axis=1).any() else 0.0
        else:
            share = lcs_length(words, region) / len(words)
        answer = float(np.isin(self.answers[item], region).mean())
        if (share >= WHOLE or (share >= PARAPHRASE and answer >= ANSWER_SHARE)) and share > found.get(key, (0.0,))[0]:
            found[key] = (share, cosine, answer, max(0, a))


def _sum_chunks(rows: DataFrame, shape: tuple[int, int], each: object, chunk: int = 512) -> np.ndarray:
    """The sum over all tasks of a table of the given, bounded shape; each yields (first row, rows) parts of a task's table."""
    width = shape[1]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = each(batches)
        for i in range(0, shape[0], chunk):
            if table[i : i + chunk].any():
                yield pa.record_batch({"chunk": np.array([i // chunk], np.int32), "data": pa.array([table[i : i + chunk].astype("<f8" if width == 1 else "<f4").tobytes()], pa.binary())})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for part in batches:
            for c, data in zip(part["chunk"], part["data"], strict=True):
                x = np.frombuffer(data, "<f8" if width == 1 else "<f4").astype(float)
                sums[c] = sums[c] + x if c in sums else x
        for c, x in sums.items():
            yield pd.DataFrame({"chunk": [c], "data": [x.tobytes()]})

    out = np.zeros(shape)
    dealt = rows.mapInArrow(emit, "chunk int, data binary").repartition(parts(rows.sparkSession), "chunk").mapInPandas(add, "chunk int, data binary")
    for r in dealt.collect():
        x = np.frombuffer(r["data"]).reshape(-1, width)
        out[r["chunk"] * chunk : r["chunk"] * chunk + len(x)] = x
    return out


#: Columns and signs that a passage is added to in the sketch follow from its document and place.
_SALTS = mix(np.arange(1, SIGNS + 1, dtype=np.uint64))


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Places of all words, and how many each text has."""
    return text_buffers(batch.column("slots"))[0].view("<i4").astype(np.int64), np.asarray(batch.column("n"))


def _sketch(table: DataFrame, items: Items) -> np.ndarray:
    """The sum over all passages of their unit TF-IDF vectors, each with SIGNS signs into as many of the sketch's columns."""
    size, idf = len(items.vocabulary), items.idf

    def sketch(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(size * SKETCH, np.float32)
        for batch in batches:
            for b in blocks(batch, "slots"):
                slots, per = _unpack(b)
                passage, word, count, passages = _entries(slots, per, size)
                if not len(word):
                    continue
                a = count * idf[word]
                start = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
                a /= np.repeat(np.sqrt(np.add.reduceat(a * a, start)), np.diff(start, append=len(a)))
                ids = np.asarray(b.column("doc_id").fill_null(-1)).view(np.uint64)
                number = np.arange(passages.sum()) - np.repeat(np.cumsum(passages) - passages, passages)
                name = mix(np.repeat(ids, passages) ^ mix(number.astype(np.uint64)))
                order = np.argsort(word, kind="stable")  # so that sums stay near each other in memory
                passage, word, a = passage[order], word[order], a[order]
                for salt in _SALTS:
                    h = mix(name ^ salt)
                    sign = np.where(h & np.uint64(1), 1.0, -1.0)
                    column = ((h >> np.uint64(1)) % np.uint64(SKETCH)).astype(np.int64)
                    key = word * SKETCH + column[passage]
                    np.add.at(out, key, (a * sign[passage]).astype(np.float32))
        return out.reshape(size, SKETCH)

    return _sum_chunks(table, (size, SKETCH), sketch)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document (doc_id, text) and benchmark item (item_id, text) that it holds: the best window's cosine, the
    common subsequence's and the answer's share of the item, and the window's first word.

    Documents are read once, and the places of their words (-1: no word of the benchmark's) are a table; only tables of the benchmark's size
    are shuffled. All items have one latent space. Items without words, null ones included, aren't searched for, and those of
    fewer than SHORT words only as they are; a null text is empty; a very long one is searched whole, block of its own; repeated rows and items are found each; null ids are kept; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text").collect()
    items = Items([r["item_id"] for r in asked], [r["text"] for r in asked])
    if not items.ids:
        return spark.createDataFrame([], "doc_id long, item_id long, cosine double, subsequence double, answer double, word_position long")
    vocabulary, size = items.vocabulary, len(items.vocabulary)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 1, np.int64)
        for batch in batches:
            for b in blocks(batch, limit=2 << 20):
                hashes, per = word_hashes(b.column("text"))
                slots = _slots(vocabulary, hashes)
                _, word, _, passages = _entries(slots, per, size)
                df[:size] += np.bincount(word, minlength=size)
                df[size] += passages.sum()
                ends = np.concatenate([[0], np.cumsum(per)])
                coded = slots.astype("<i4")
                yield pa.record_batch({"df": pa.nulls(len(per), pa.binary()), "doc_id": b.column("doc_id"), "n": per, "slots": pa.array([coded[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())})
        yield pa.record_batch({"df": pa.array([df.astype("<i8").tobytes()], pa.binary()), "doc_id": pa.nulls(1, pa.int64()), "n": np.zeros(1, np.int64), "slots": pa.array([b""], pa.binary())})

    table = cut(rows.mapInArrow(tokens, "df binary, doc_id long, n long, slots binary"), "word_places")

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((size + 1, 1))
        for batch in batches:
            for x in batch.column("df").to_pylist():
                out[:, 0] += np.frombuffer(x, "<i8")
        return out

    counted = _sum_chunks(table.filter("df IS NOT NULL").select("df"), (size + 1, 1), add)[:, 0]
    items.place(counted[:size], int(counted[size]))
    table = table.filter("df IS NULL").select("doc_id", "n", "slots")
    items.span(_sketch(table, items), int(counted[size]))
    held = spark.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = held.value
        for batch in batches:
            for b in blocks(batch, "slots", limit=1 << 20):
                found = space.search(*_unpack(b))
                columns = list(zip(*(x for _, x in found), strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                keys = b.column("doc_id").take(pa.array([k for k, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "item_id", "cosine", "subsequence", "answer", "word_position"])

    return table.mapInArrow(search, "doc_id long, item_id long, cosine double, subsequence double, answer double, word_position long")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, columns as they are; null doc_ids stay."""
    gone = leaks(docs, benchmark).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("_gone"), "left_anti")
