"""Language-model scores: add-one unigrams, and a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The class of a word follows from its ending; endings are
grouped into classes by the company they keep. P(class | history) is a softmax over hashed features of the words
before: the last word, the last two endings, and the second and third last word (skips). P(word | class) is the add-one share of
the word in its class, unknown words together being one more. The weights are trained by gradient updates in every task
on its own part of the training documents and then averaged, each feature by how often a task has seen it.

Counts of words are exact over all training documents. They are not sent to the tasks, as a vocabulary grows with the
corpus; instead each block of documents sends its distinct words to their hash buckets, where counts are summed
and looked up, and gets back a sum for each document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanika.llm.common import LOWER, blocks, cut, hash_spans, mix, parts, repeat_ranges, text_buffers, words

#: Endings (hashed), classes without the end's, rows of the weight table, tokens of a gradient step, step size.
TYPES, CLASSES, ROWS, BATCH, RATE = 2048, 31, 1 << 15, 8192, 0.5
#: Endings before, hashed, that the company of an ending is counted by.
COMPANY = 64
FAMILIES = 4
_END = np.uint64(0x5851F42D4C957F2D)
_SALT = mix(np.arange(11, 11 + FAMILIES, dtype=np.uint64))


class Tokens:
    """The words of a block of texts, an end after each text's: hashes, endings and where each text begins."""

    def __init__(self, column: pa.Array) -> None:
        data, offs = text_buffers(column)
        low = LOWER[data]
        starts, lens, per = words(low, offs)
        self.raw, self.offs = data, offs
        hashes = hash_spans(low, starts, lens)
        tail = np.zeros(len(starts), np.uint64)
        for k in (1, 2, 3):
            ok = lens >= k
            tail[ok] = tail[ok] << np.uint64(8) | low[(starts + lens)[ok] - k]
        types = (mix(tail) % np.uint64(TYPES)).astype(np.int64)
        ends = np.cumsum(per)
        self.hashes = np.insert(hashes, ends, _END)
        self.types = np.insert(types, ends, TYPES)  # the end is an ending of its own
        self.per = per + 1
        self.first = np.cumsum(self.per) - self.per

    def history(self) -> np.ndarray:
        """For each token, a row number of the weight table for each family of features."""
        n = len(self.hashes)
        doc = np.repeat(self.first, self.per)
        at = np.arange(n)
        back = [np.maximum(at - k, 0) for k in (1, 2, 3)]
        inside = [at - k >= doc for k in (1, 2, 3)]
        word = [np.where(ok, self.hashes[b], np.uint64(k)) for k, (ok, b) in enumerate(zip(inside, back, strict=True))]
        kind = [np.where(ok, self.types[b], TYPES + 1).astype(np.uint64) for ok, b in zip(inside, back, strict=True)]
        keys = [word[0], kind[0] * np.uint64(4099) + kind[1], word[1], word[2]]
        return np.stack([(mix(k ^ s) % np.uint64(ROWS)).astype(np.int64) for k, s in zip(keys, _SALT, strict=True)], axis=1)


def in_training(doc_ids: pa.Array, folds: int, held: int) -> np.ndarray:
    return np.array([zlib.crc32(("null" if x is None else str(x)).encode()) % folds != held for x in doc_ids.to_pylist()], bool)


def _company(t: Tokens, train: np.ndarray) -> np.ndarray:
    """Counts of endings by the ending before, in training texts."""
    keep = np.repeat(train, t.per)
    keep[t.first] = False
    i = np.flatnonzero(keep)
    return np.bincount(t.types[i] * COMPANY + t.types[i - 1] % COMPANY, minlength=(TYPES + 1) * COMPANY)


def _requests(t: Tokens, train: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """By bucket: the block's distinct words, each with its ending, count in training texts and the texts that hold it."""
    doc = np.repeat(np.arange(len(t.per)), t.per)
    order = np.lexsort((doc, t.hashes))
    h, d = t.hashes[order], doc[order]
    new_pair = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    pair = np.flatnonzero(new_pair)
    times = np.diff(pair, append=len(h)).astype(np.uint32)
    ph, pd_ = h[pair], d[pair].astype(np.uint32)
    new_word = np.concatenate([[True], ph[1:] != ph[:-1]])
    word = np.flatnonzero(new_word)
    pairs = np.diff(word, append=len(ph)).astype(np.uint32)
    counts = np.add.reduceat(times * train[pd_], word).astype(np.uint32)
    u = ph[word]
    kind = t.types[order][pair][word].astype(np.uint16)
    bucket = (u >> np.uint64(40)) % np.uint64(buckets)
    by = np.argsort(bucket, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[by])) + 1, [len(by)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        w = by[a:b]
        at = repeat_ranges(word[w], pairs[w].astype(np.int64))
        head = np.array([len(w), len(at)], "<u4")
        yield int(bucket[w[0]]), b"".join(x.tobytes() for x in (head, u[w], counts[w], pairs[w], kind[w], pd_[at], times[at]))


def _open(data: bytes) -> list[np.ndarray]:
    n, m = np.frombuffer(data, "<u4", 2).tolist()
    out, at = [], 8
    for kind, k in (("<u8", n), ("<u4", n), ("<u4", n), ("<u2", n), ("<u4", m), ("<u4", m)):
        out.append(np.frombuffer(data, kind, k, at))
        at += out[-1].nbytes
    return out


def _answers(requests: list[tuple[int, bytes]]) -> tuple[list[tuple[int, bytes]], np.ndarray]:
    """For each block its texts' sums of log10(count + 1) and of known tokens; and each ending's tokens and distinct words."""
    opened = [(block, _open(data)) for block, data in requests]
    every = np.concatenate([x[0] for _, x in opened])
    unique, first, back = np.unique(every, return_index=True, return_inverse=True)
    count = np.bincount(back, np.concatenate([x[1] for _, x in opened]), len(unique))
    kind = np.concatenate([x[3] for _, x in opened])[first]
    known = count > 0
    totals = np.stack([np.bincount(kind[known], count[known], TYPES + 1), np.bincount(kind[known], minlength=TYPES + 1)])
    logs, out, at = np.log10(count + 1), [], 0
    for block, (u, _, pairs, _, doc, times) in opened:
        slot = np.repeat(back[at : at + len(u)], pairs)
        at += len(u)
        sums = np.bincount(doc, times * logs[slot])
        seen = np.bincount(doc, times * known[slot])
        some = np.flatnonzero(np.bincount(doc)).astype("<u4")
        out.append((block, b"".join([np.array([len(some)], "<u4").tobytes(), some.tobytes(), sums[some].astype("<f8").tobytes(), seen[some].astype("<u4").tobytes()])))
    return out, totals


def group_endings(company: np.ndarray, classes: int = CLASSES, rounds: int = 25) -> np.ndarray:
    """The class of each ending (the end's is the last): k-means on the direction of the logs of its company's excess."""
    total = company.sum(axis=1)
    share = company.sum(axis=0) + 1.0
    x = np.log((company + 0.1) / ((total[:, None] + 0.1 * COMPANY) * share / share.sum()))
    x *= np.minimum(1.0, np.sqrt(total[:, None] / 50.0))
    x = x[:TYPES] / (np.linalg.norm(x[:TYPES], axis=1, keepdims=True) + 1e-9)
    weight = np.sqrt(total[:TYPES])
    order = np.argsort(-total[:TYPES], kind="stable")
    centre, far = [x[order[0]]], 1 - x @ x[order[0]]
    while len(centre) < classes:
        k = int(np.argmax(far * weight))
        centre.append(x[k])
        far = np.minimum(far, 1 - x @ x[k])
    c = np.array(centre)
    for _ in range(rounds):
        label = np.argmax(x @ c.T, axis=1)
        for k in range(classes):
            own = label == k
            if weight[own].sum() > 0:
                v = (x[own] * weight[own, None]).sum(axis=0)
                c[k] = v / (np.linalg.norm(v) + 1e-9)
    return np.append(np.argmax(x @ c.T, axis=1), classes)


class Weights:
    """The softmax over classes given the rows of a token's features."""

    def __init__(self, table: np.ndarray, bias: np.ndarray) -> None:
        self.table, self.bias = table, bias

    def logs(self, rows: np.ndarray) -> np.ndarray:
        """Natural log probabilities of all classes for each token."""
        z = self.table[rows[:, 0]] + self.bias
        for k in range(1, FAMILIES):
            z += self.table[rows[:, k]]
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z


def train_part(parts_of: Iterator[tuple[np.ndarray, np.ndarray]], bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and how often each row was used, after adaptive gradient steps over (feature rows, classes) in turn."""
    model = Weights(np.zeros((ROWS, len(bias)), np.float32), bias.astype(np.float32))
    square = np.full(ROWS, 1e-3, np.float32)
    used = np.zeros(ROWS, np.int64)
    for rows, y in parts_of:
        for i in range(0, len(y), BATCH):
            r, c = rows[i : i + BATCH], y[i : i + BATCH]
            g = np.exp(model.logs(r))
            g[np.arange(len(c)), c] -= 1
            for k in range(FAMILIES):
                order = np.argsort(r[:, k], kind="stable")
                ids = r[order, k]
                at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                total, u = np.add.reduceat(g[order], at, axis=0), ids[at]
                square[u] += (total * total).mean(axis=1)
                model.table[u] -= RATE / FAMILIES * total / np.sqrt(square[u])[:, None]
                used[u] += np.diff(at, append=len(ids))
    return model.table, used


#: Weight rows that one row of a shuffle holds.
CHUNK = 1024


def _trained(rows: DataFrame, cls: np.ndarray, bias: np.ndarray, folds: int, held: int) -> np.ndarray:
    """Distributed training: each task's weights, averaged by use. The driver gets one table of fixed size."""
    width = len(bias)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def examples() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for b in blocks(batch, limit=2 << 20):
                    t = Tokens(b.column("text"))
                    keep = np.flatnonzero(np.repeat(in_training(b.column("doc_id"), folds, held), t.per))
                    yield t.history()[keep], cls[t.types[keep]]

        table, used = train_part(examples(), bias)
        for i in range(0, ROWS, CHUNK):
            some = np.flatnonzero(used[i : i + CHUNK]) + i
            if len(some):
                data = some.astype("<u4").tobytes() + used[some].astype("<u4").tobytes() + table[some].astype("<f2").tobytes()
                yield pa.record_batch({"chunk": np.array([i // CHUNK], np.int32), "n": np.array([len(some)], np.int32), "data": pa.array([data], pa.binary())})

    def average(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        uses: dict[int, np.ndarray] = {}
        for part in batches:
            for chunk, n, data in zip(part["chunk"], part["n"], part["data"], strict=True):
                s = sums.setdefault(chunk, np.zeros((CHUNK, width)))
                u = uses.setdefault(chunk, np.zeros(CHUNK))
                some = np.frombuffer(data, "<u4", n).astype(np.int64) - chunk * CHUNK
                use = np.frombuffer(data, "<u4", n, 4 * n).astype(float)
                s[some] += use[:, None] * np.frombuffer(data, "<f2", n * width, 8 * n).reshape(n, width)
                u[some] += use
        for chunk, s in sums.items():
            yield pd.DataFrame({"chunk": [chunk], "data": [(s / np.maximum(uses[chunk], 1)[:, None]).astype("<f4").tobytes()]})

    found = rows.mapInArrow(each, "chunk int, n int, data binary").repartition(min(ROWS // CHUNK, parts(rows.sparkSession)), "chunk").mapInPandas(average, "chunk int, data binary")
    table = np.zeros((ROWS, width), np.float32)
    for r in found.collect():
        table[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["data"], "<f4").reshape(CHUNK, width)
    return table


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document (doc_id, text).

    It learns from documents whose crc32(doc_id as text) mod folds is not held. A null or blank text is one end. Without training
    documents all counts are 0. Rows of one doc_id with the same text have the same scores and are all
    returned; a null doc_id counts as the text 'null'. Other columns are ignored. Words are told apart by 64 bits of hash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = parts(spark)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        company = np.zeros((TYPES + 1) * COMPANY, np.int64)
        for batch in batches:
            for b in blocks(batch):
                t = Tokens(b.column("text"))
                train = in_training(b.column("doc_id"), folds, held)
                company += _company(t, train)
                raw, at = t.raw.tobytes(), t.offs.tolist()
                mark = np.array([xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(at, at[1:], strict=False)], np.uint64)
                keys = b.column("doc_id")
                known = np.array(keys.is_valid()).astype(np.uint8)
                info = b"".join([np.array(keys.fill_null(0), "<i8").tobytes(), known.tobytes(), mark.tobytes(), t.per.astype("<u4").tobytes()])
                out = [(-1, info), *_requests(t, train, buckets)]
                yield pa.record_batch({"bucket": np.array([k for k, _ in out], np.int32), "block": np.full(len(out), block), "data": pa.array([x for _, x in out], pa.binary())})
                block += 1
        yield pa.record_batch({"bucket": np.array([-2], np.int32), "block": np.array([block]), "data": pa.array([zlib.compress(company.astype("<i8").tobytes(), 1)], pa.binary())})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held_rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None and now >= 0:
                out, totals = _answers(held_rows)
                out.append((-1, totals.astype("<f8").tobytes()))
            else:
                out = [(b, d) for b, d in held_rows] if now == -1 else []
                if now == -2:
                    out = [(-2, zlib.compress(sum(np.frombuffer(zlib.decompress(d), "<i8") for _, d in held_rows).astype("<i8").tobytes(), 1))]
            if out:
                yield pa.record_batch({"info": np.full(len(out), now == -1), "block": np.array([b for b, _ in out], np.int64), "data": pa.array([d for _, d in out], pa.binary())})

        for batch in batches:
            for k, block, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "data")), strict=True):
                if k != now:
                    yield from done()
                    now, held_rows = k, []
                held_rows.append((block, data))
                if k == -1:  # nothing has to be brought together
                    yield from done()
                    held_rows = []
                elif k == -2 and len(held_rows) > 64:
                    held_rows = [(0, zlib.compress(sum(np.frombuffer(zlib.decompress(d), "<i8") for _, d in held_rows).astype("<i8").tobytes(), 1))]
        yield from done()

    asked = rows.mapInArrow(ask, "bucket int, block long, data binary")
    # The blocks' own rows and the company's go to any task; words go to their bucket's.
    dealt = asked.withColumn("to", F.when(F.col("bucket") == -1, F.pmod("block", F.lit(buckets))).when(F.col("bucket") == -2, F.pmod("block", F.lit(buckets))).otherwise(F.col("bucket")))
    answered = cut(dealt.repartition(buckets, "to").sortWithinPartitions("to", "bucket").drop("to").mapInArrow(answer, "info boolean, block long, data binary"), "answers")

    company, totals = np.zeros((TYPES + 1) * COMPANY, np.int64), np.zeros((2, TYPES + 1))
    for r in answered.filter("block < 0").toLocalIterator():  # a row of fixed size for each task
        if r["block"] == -2:
            company += np.frombuffer(zlib.decompress(r["data"]), "<i8")
        else:
            totals += np.frombuffer(r["data"], "<f8").reshape(2, -1)
    n_all, distinct = int(totals[0].sum()), int(totals[1].sum())
    cls = group_endings(company.reshape(TYPES + 1, COMPANY).astype(float))
    size, kinds = (np.bincount(cls, t, CLASSES + 1) for t in totals)
    bias = np.log((size + 1) / (size + 1).sum())
    inner = np.log10(size + kinds + 1)
    model = Weights(_trained(rows, cls, bias, folds, held), bias.astype(np.float32))
    base = math.log10(n_all + distinct + 1)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, limit=1 << 20):
                t = Tokens(b.column("text"))
                c = cls[t.types]
                history, logs = t.history(), np.empty(len(c))
                for i in range(0, len(c), BATCH):
                    x = model.logs(history[i : i + BATCH])
                    logs[i : i + BATCH] = x[np.arange(len(x)), c[i : i + BATCH]]
                sums = np.add.reduceat(logs / math.log(10) - inner[c], t.first)
                raw, at = t.raw.tobytes(), t.offs.tolist()
                mark = np.array([xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(at, at[1:], strict=False)], np.uint64).view(np.int64)
                yield pa.record_batch({"doc_id": b.column("doc_id"), "mark": mark, "held_out": ~in_training(b.column("doc_id"), folds, held), "class_score": sums})

    def gather(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        info = part.loc[part["info"], "data"].iloc[0]
        n = len(info) // 21
        ids, ok, mark, per = np.frombuffer(info, "<i8", n), np.frombuffer(info, np.uint8, n, 8 * n), np.frombuffer(info, "<i8", n, 9 * n), np.frombuffer(info, "<u4", n, 17 * n)
        sums, known = np.zeros(n), np.zeros(n, np.int64)
        for data in part.loc[~part["info"], "data"]:
            k = int(np.frombuffer(data, "<u4", 1)[0])
            some = np.frombuffer(data, "<u4", k, 4)
            sums[some] += np.frombuffer(data, "<f8", k, 4 + 4 * k)
            known[some] += np.frombuffer(data, "<u4", k, 4 + 12 * k)
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64").copy() if ok.all() else pd.Series(ids, dtype="Int64").mask(ok == 0), "mark": mark, "n_tokens": per.astype(np.int64), "n_known": known, "logs": sums})

    sums = answered.filter("block >= 0").groupBy("block").applyInPandas(gather, "doc_id long, mark long, n_tokens long, n_known long, logs double")
    sums = sums.groupBy("doc_id", "mark").agg(*(F.first(c).alias(c) for c in ("n_tokens", "n_known", "logs"))).withColumnRenamed("doc_id", "key")
    scored = rows.mapInArrow(classes, "doc_id long, mark long, held_out boolean, class_score double")
    both = scored.join(sums, F.col("doc_id").eqNullSafe(F.col("key")) & (scored["mark"] == sums["mark"]))
    return both.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * F.lit(base)).alias("base_score"), (F.col("logs") + F.col("class_score")).alias("score"))
