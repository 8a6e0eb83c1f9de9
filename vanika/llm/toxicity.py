"""Toxicity: a learned lexicon matched by Levenshtein automata over its trie, weighed by the words around.

The lexicon comes from labelled training documents: words, and stems of words, that toxic documents hold much
more often than others. Its trie is intersected with the Levenshtein automaton of each distinct word of the
corpus, so misspelled terms are found as well. A term in quotation marks, or next to a word of
reporting, counts for less; next to a word of address it counts for more. A logistic model turns what a document holds into a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanika.llm.common import blocks, crc_mod, cut, hash_spans, lower_latin, mix, repeat_ranges, text_buffers, words

#: Toxic training documents that a term must be in, however many there are.
MIN_COUNT = 5
#: The least log odds of a term, and of a stem.
MIN_ODDS, MIN_STEM_ODDS = 2.5, 3.0
#: With more terms than this the letter filter, which looks at each of them, costs more than the variants that it saves.
LETTER_TERMS = 64
#: Labelled rows that the logistic model is fitted on at most, those whose hash is smallest.
FIT_ROWS = 20_000
#: Code points of the longest word that can be a term.
MAX_WORD = 40
STEM_CHARS = (3, 10)

#: Between words: ASCII signs other than those that stand for letters, and an apostrophe.
_GAP = np.zeros(256, bool)
_GAP[[c for c in range(128) if not (chr(c).isalnum() or chr(c) in "@$'")]] = True

#: First bytes of other signs, with those of the bytes after them that are letters or digits: Latin-1, general punctuation, CJK signs, wide forms.
_SIGNS = ((b"\xc2", b"\xaa\xb2\xb3\xb5\xb9\xba\xbc\xbd\xbe"), (b"\xe2\x80", b""), (b"\xe2\x81", b"\xb0\xb1" + bytes(range(0xB4, 0xBA)) + b"\xbf"), (b"\xe3\x80", b"\x85\x86\x87" + bytes(range(0xA1, 0xAA))), (b"\xef\xbc", bytes(range(0x90, 0x9A)) + bytes(range(0xA1, 0xBB))))


def terms_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with signs as blanks, and the starts, lengths and (by text) counts of their words, which have no apostrophe at an end."""
    low = data.copy()
    for head, letters in _SIGNS:
        at = np.flatnonzero(data[: len(data) - len(head)] == head[0])
        for k in range(1, len(head)):
            at = at[data[at + k] == head[k]]
        if len(at):
            at = at[~np.isin(data[at + len(head)], np.frombuffer(letters, np.uint8))]
            for k in range(len(head) + 1):
                low[at + k] = 32
    starts, lens, per = words(low, offs, _GAP)
    text = np.repeat(np.arange(len(per)), per)
    for last in (False, True):
        while len(live := np.flatnonzero((lens > 0) & (low[np.where(last, starts + lens - 1, starts)] == 39) if len(starts) else [])):
            lens[live] -= 1
            if not last:
                starts[live] += 1
    keep = lens > 0
    return low, starts[keep], lens[keep], np.bincount(text[keep], minlength=len(per))


#: A bit for each letter.
_LETTER = np.zeros(256, np.uint32)
_LETTER[97:123] = np.uint32(1) << np.arange(26, dtype=np.uint32)

#: Words of reporting and of address, as they stand near a term.
REPORTING = frozenset("said says wrote writes called quoted quote term word phrase dit écrit mot sagte schrieb wort dijo escribió palabra".split())
ADDRESS = frozenset("you your you're u tu toi vous ton votre du dich dein ihr sie te usted tú su eres are".split())
QUOTED, ADDRESSED = 0.25, 1.25
CONTEXT_CHARS = 40


@dataclass
class Node:
    """A state of the lexicon's trie."""

    next: dict[str, Node] = field(default_factory=dict)
    term: int = -1


_PRIME = np.uint64(0x100000001B3 * 2 + 1)
_BACK, _BACK2 = (np.uint64(pow(int(_PRIME), -k, 1 << 64)) for k in (1, 2))


def variant_hashes(some: list[str], edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word without up to so many (two at most) of its characters, and the word's place. Words within so many edits of each other have one in common.

    A hash is a sum of characters times powers; without a character, what follows it moves down one power. Words of one length are done together.
    """
    size = np.array([len(w) for w in some])
    hashes, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        points = np.frombuffer("".join([some[k] for k in own.tolist()]).encode("utf-32-le"), "<u4").reshape(len(own), n).astype(np.uint64)
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), _PRIME)]))[:n]
        sums = np.zeros((len(own), n + 1), np.uint64)
        np.cumsum(mix(points + np.uint64(1)) * powers, axis=1, out=sums[:, 1:])
        total = sums[:, -1:]
        made = [total]
        if edits > 0 and n > 0:
            made.append(sums[:, :-1] + (total - sums[:, 1:]) * _BACK)
        if edits > 1 and n > 1:
            j, k = np.triu_indices(n, 1)
            made.append(sums[:, j] + (sums[:, k] - sums[:, j + 1]) * _BACK + (total - sums[:, k + 1]) * _BACK2)
        for gone, x in enumerate(made):
            hashes.append(mix(x + np.uint64(n - gone)).ravel())
            owner.append(np.repeat(own, x.shape[1]))
    return np.concatenate(hashes), np.concatenate(owner)


def errors_allowed(term: str) -> int:
    """Edits at which a word still matches: none for short terms, two for long ones."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Lexicon:
    """Terms with their log odds; terms that end in * are stems, which match at a word's start without errors."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = list(weights.values())
        self.exact = {t: k for k, t in enumerate(weights) if not t.endswith("*")}
        self.stems = {t[:-1]: k for k, t in enumerate(weights) if t.endswith("*")}
        self.stem_lens = sorted({len(s) for s in self.stems})
        # A trie for each length, as only terms about as long as a word can be near it.
        self.roots: dict[int, Node] = {}
        self.fuzzy = [t for t in self.exact if errors_allowed(t)]
        for t in self.fuzzy:
            node = self.roots.setdefault(len(t), Node())
            for c in t:
                node = node.next.setdefault(c, Node())
            node.term = self.exact[t]
        # Hashes of all terms' variants, ascending, and marks of their first bits.
        self.variants = np.unique(np.concatenate([variant_hashes([t for t in self.fuzzy if errors_allowed(t) == k], k)[0] for k in (1, 2)]))
        self.marks = np.zeros(1 << 20, bool)
        self.marks[self.variants >> np.uint64(44)] = True
        self.shortest = {k: min((len(t) for t in self.fuzzy if errors_allowed(t) == k), default=1 << 30) - k for k in (1, 2)}

    def share_variants(self, some: list[str]) -> np.ndarray:
        """Which words have a variant in common with a term: all within a term's edits, and few others."""
        out = np.zeros(len(some), bool)
        size = np.array([len(w) for w in some], np.int64)
        for edits, which in ((2, size >= self.shortest[2]), (1, (size >= self.shortest[1]) & (size < self.shortest[2]))):
            own = np.flatnonzero(which)
            for i in range(0, len(own), 1024):
                part = own[i : i + 1024]
                hashes, owner = variant_hashes([some[k] for k in part.tolist()], edits)
                live = np.flatnonzero(self.marks[hashes >> np.uint64(44)])
                at = np.minimum(np.searchsorted(self.variants, hashes[live]), max(0, len(self.variants) - 1))
                out[part[owner[live[self.variants[at] == hashes[live]]]]] = True
        return out

    def near_some_term(self, letters: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Which words may be within a term's edits: about as long, and without more of its letters missing than edits allowed."""
        out = np.zeros(len(lens), bool)
        for t in self.fuzzy:
            k = errors_allowed(t)
            mask = np.uint32(sum(1 << (ord(c) - 97) for c in set(t) if "a" <= c <= "z"))
            out |= (np.abs(lens - len(t)) <= k) & (np.bitwise_count(mask & ~letters) <= k)
        return out

    def match(self, word: str, near: bool = True) -> tuple[int, int]:
        """The term that the word is, begins with or (if near) misspells, and the edits between; (-1, 0): none."""
        if word in self.exact:
            return self.exact[word], 0
        for n in self.stem_lens:
            if word[:n] in self.stems:
                return self.stems[word[:n]], 0
        return self.nearest(word) if near else (-1, 0)

    def nearest(self, word: str) -> tuple[int, int]:
        """The closest term within its allowed edits, of equally close ones the first; (-1, 0): none."""
        term, edits = self.nearest_of([word])
        return int(term[0]), int(edits[0])

    def nearest_of(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """nearest() of each word, of MAX_WORD + 2 characters at most: the words' Levenshtein automata walk the trie together.

        An automaton's states after some letters of a term are bit sets, one for each count of errors so far: bit i means that
        i letters of the word are used. At each branch only words with any state left go on.
        """
        n = np.array([len(w) for w in some], np.uint64)
        best, edits = np.full(len(some), -1), np.full(len(some), 3)
        points = np.zeros((len(some), int(n.max(initial=0))), np.uint32)
        for k, w in enumerate(some):
            points[k, : len(w)] = np.frombuffer(w.encode("utf-32-le"), "<u4")
        places = _ONE << np.arange(points.shape[1], dtype=np.uint64)
        letters: dict[str, np.ndarray] = {}
        full = (_ONE << (n + _ONE)) - _ONE
        for size, root in self.roots.items():
            allowed = errors_allowed("x" * size)
            live = np.flatnonzero(np.abs(n.astype(np.int64) - size) <= allowed)
            stack = [(root, live, np.full(len(live), 1, np.uint64), np.full(len(live), 3, np.uint64), np.full(len(live), 7, np.uint64))] if len(live) else []
            while stack:
                node, live, r0, r1, r2 = stack.pop()
                if node.term >= 0:
                    end = n[live]
                    e = np.where(r0 >> end & _ONE, 0, np.where(r1 >> end & _ONE, 1, np.where((r2 >> end & _ONE) & np.uint64(allowed > 1), 2, 3)))
                    better = (e <= allowed) & ((e < edits[live]) | (e == edits[live]) & (node.term < best[live]))
                    best[live[better]], edits[live[better]] = node.term, e[better]
                for c, child in node.next.items():
                    if c not in letters:
                        letters[c] = (points == ord(c)) @ places
                    m, top = letters[c][live], full[live]
                    s0 = (r0 & m) << _ONE
                    s1 = ((r1 & m) << _ONE | r0 | r0 << _ONE | s0 << _ONE) & top
                    s2 = ((r2 & m) << _ONE | r1 | r1 << _ONE | s1 << _ONE) & top if allowed > 1 else np.zeros_like(s1)
                    on = (s1 | s2) > 0
                    if on.any():
                        stack.append((child, live[on], s0[on], s1[on], s2[on]))
        return best, np.where(best >= 0, edits, 0)


_ONE = np.uint64(1)


def _root_of(bare: str, kept: dict[str, float], low: int, upto: int) -> bool:
    return any(bare[:k] + "*" in kept for k in range(low, upto))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, t, n: for each block of labelled texts its words of 3 to MAX_WORD code points, the toxic texts and the texts that hold them."""
    for batch in batches:
        for b in blocks(batch):
            data, offs = text_buffers(b.column("text"))
            low, starts, lens, per = terms_of(lower_latin(data), offs)
            text = np.repeat(np.arange(len(per)), per)
            short = np.flatnonzero((lens >= 3) & (lens <= 4 * MAX_WORD))
            _, where, back = np.unique(hash_spans(low, starts[short], lens[short]), return_index=True, return_inverse=True)
            found = [low[s : s + k].tobytes().decode(errors="replace").lower() for s, k in zip(starts[short[where]].tolist(), lens[short[where]].tolist(), strict=True)]
            place = {w: k for k, w in enumerate(dict.fromkeys(found))}
            names = list(place)
            pair = np.unique(np.array([place[w] for w in found], np.int64)[back] * len(per) + text[short]) if found else np.empty(0, np.int64)
            word, doc = pair // max(1, len(per)), pair % max(1, len(per))
            n = np.bincount(word, minlength=len(names))
            t = np.bincount(word, np.asarray(b.column("toxic"))[doc], len(names)).astype(np.int64)
            keep = [3 <= len(w) <= MAX_WORD for w in names]
            yield pa.record_batch({"word": pa.array(names, pa.string()), "t": t, "n": n}).filter(pa.array(keep, pa.bool_()))


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Terms and stems by the log odds of their documents' labels; labelled: text, toxic.

    Words are counted once a document, over all labelled rows; the stems' counts are sums over their words. Only
    the terms above the bounds go to the driver.
    """
    total = labelled.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    t, n = int(total["t"] or 0), int(total["n"])
    if not 0 < t < n:
        return {}
    counts = labelled.select("toxic", "text").mapInArrow(_word_counts, "word string, t long, n long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    low, high = STEM_CHARS
    stems = F.transform(F.sequence(F.lit(low), F.least(F.length("word"), F.lit(high))), lambda k: F.concat(F.substring("word", F.lit(1), k), F.lit("*")))
    terms = counts.select(F.explode(F.concat(F.array("word"), stems)).alias("term"), "t", "n").groupBy("term").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.count("*").alias("forms"))
    odds = F.log((F.col("t") + 0.5) / (t + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (n - t + 1.0))
    terms = terms.filter(F.col("t") >= MIN_COUNT).withColumn("odds", odds)
    is_stem = F.col("term").endswith("*")
    terms = terms.filter(F.when(is_stem, (F.col("odds") > MIN_STEM_ODDS) & (F.col("forms") > 2)).otherwise(F.col("odds") > MIN_ODDS))
    found = {r["term"]: r["odds"] for r in terms.collect()}
    # A stem stands for what begins with it.
    kept: dict[str, float] = {}
    for term in sorted(found, key=lambda x: (not x.endswith("*"), len(x), x)):
        bare = term.rstrip("*")
        if not _root_of(bare, kept, low, len(bare) + (not term.endswith("*"))):
            kept[term] = found[term]
    return dict(sorted(kept.items()))


FEATURES = 9


class Scorer:
    """What a document holds of the lexicon. Each distinct word is matched once a worker."""

    #: Words to remember; when there are more, all are forgotten. It bounds memory and changes no result.
    KEEP = 2_000_000

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.known = np.empty(0, np.uint64)
        self.term = np.empty(0, np.int32)
        self.edits = np.empty(0, np.int8)

    def features(self, column: pa.Array) -> np.ndarray:
        """A row of FEATURES numbers for each text."""
        data, offs = text_buffers(column)
        written = lower_latin(data)
        low, starts, lens, per = terms_of(written, offs)
        out = np.zeros((len(per), FEATURES))
        if not len(starts):
            return out
        hashes = hash_spans(low, starts, lens)
        unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.KEEP:
            self.known, self.term, self.edits = self.known[:0], self.term[:0], self.edits[:0]
        place = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != unique[inside]
        if new.any():
            first, size = starts[where[new]], lens[where[new]]
            at = np.cumsum(size) - size
            own = low[repeat_ranges(first, size)]
            letters = np.bitwise_or.reduceat(_LETTER[own], at)
            points = np.add.reduceat((own & 0xC0) != 0x80, at, dtype=np.int64)
            near_one = (size <= 4 * MAX_WORD) & (self.lexicon.near_some_term(letters, points) if len(self.lexicon.fuzzy) <= LETTER_TERMS else True)
            text = [low[s : s + k].tobytes().decode(errors="replace").lower() if k <= 4 * MAX_WORD else "" for s, k in zip(first.tolist(), size.tolist(), strict=True)]
            near_one &= np.array([len(w) <= MAX_WORD + 2 for w in text])  # no term is within two edits of a longer one
            term = np.array([self.lexicon.match(w, False)[0] if w else -1 for w in text])
            errors = np.zeros(len(term), np.int64)
            some = np.flatnonzero(near_one & (term < 0))
            some = some[self.lexicon.share_variants([text[k] for k in some.tolist()])]
            if len(some):
                term[some], errors[some] = self.lexicon.nearest_of([text[k] for k in some.tolist()])
            at = place[new]
            self.known = np.insert(self.known, at, unique[new])
            self.term = np.insert(self.term, at, term)
            self.edits = np.insert(self.edits, at, errors)
            place = np.searchsorted(self.known, unique)
        term, edits = self.term[place][back], self.edits[place][back]
        hits = np.flatnonzero(term >= 0)
        doc = np.searchsorted(np.cumsum(per), hits, "right")
        for d in np.unique(doc).tolist():
            own = hits[doc == d] if len(hits) < 200 else hits[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
            a, b = int(offs[d]), int(offs[d + 1])
            exact = fuzzy = weight = 0.0
            top, quoted, addressed, terms = 0.0, 0, 0, set()
            for i in own.tolist():
                s, e = int(starts[i]), int(starts[i] + lens[i])
                k, factor = int(term[i]), 1.0
                before = written[max(a, s - CONTEXT_CHARS) : s].tobytes().decode(errors="ignore")
                after = written[e : min(b, e + CONTEXT_CHARS)].tobytes().decode(errors="ignore")
                if in_quotes(before, after):
                    factor *= QUOTED
                    quoted += 1
                if near(before, after, ADDRESS):
                    factor *= ADDRESSED
                    addressed += 1
                w = self.lexicon.weights[k]
                terms.add(k)
                if edits[i]:
                    fuzzy += factor
                    w /= 1.0 + edits[i]
                else:
                    exact += factor
                weight += w * factor
                top = max(top, w * factor)
            n = int(per[d])
            out[d] = np.log1p([exact, fuzzy, weight, len(terms), 100.0 * (exact + 0.5 * fuzzy) / n, top, quoted, addressed, weight / max(1, len(own))])
        return out


def in_quotes(before: str, after: str) -> bool:
    """The word is inside quotation marks that open and close near it, or a word of reporting is just before it."""
    opened = max(before.rfind(q) for q in '"“«„‘')
    closed = max(before.rfind(q) for q in "”»")
    if opened > closed and any(q in after for q in '"”»“’') and (before.count('"') % 2 == 1 or '"' not in before):
        return True
    return near(before[-24:], "", REPORTING)


def near(before: str, after: str, some: frozenset[str]) -> bool:
    """One of the three words before or the three after is in some."""
    w = re.findall(r"[^\W\d_']+", before)[-3:] + re.findall(r"[^\W\d_']+", after)[:3]
    return any(x in some for x in w)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights and bias of a logistic model, by Newton's method on standardised features."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1] + 1)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = penalty * len(y) / 100 * np.eye(len(w)) + 1e-6 * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    out = np.append(w[:-1] / scale, 0.0)
    out[-1] = w[-1] - out[:-1] @ mean
    return out


def _features_of(rows: DataFrame, lexicon: Lexicon, keep: str) -> DataFrame:
    """keep (a long column) and the features of the text column."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            for b in blocks(batch):
                yield pa.record_batch({keep: b.column(keep), "x": pa.array(list(scorer.features(b.column("text"))), pa.list_(pa.float64()))})

    return rows.mapInArrow(each, f"{keep} long, x array<double>")


#: Bits of the filter that keeps most texts without labels out of the join: its size is fixed, whatever the labels are.
FILTER_BITS = 1 << 23


def _may_be_labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows without those whose doc_id's hash no label has; what is kept by chance, the join drops."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    marks = known.select(place.alias("b")).groupBy(F.floor(F.col("b") / 32768).alias("k")).agg(F.bitmap_construct_agg(F.col("b") % 32768).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in marks.collect():
        bits[r["k"] * 4096 : r["k"] * 4096 + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column("place"))
            yield batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))).select(["doc_id", "text"])

    return rows.select("doc_id", "text", place.alias("place")).mapInArrow(keep, "doc_id long, text string")


def score(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document (doc_id, text).

    Labels (doc_id, toxic) are learned from rows whose crc32(doc_id as text) mod folds is not held, and only text goes into a
    score. Of several labels of a document the largest counts; null ones don't. A null text is empty. Without labels of both kinds in
    the training rows every score is 0. A null doc_id can't have a label. Repeated rows are scored each; other columns are ignored. A very
    long text is scored whole, a block of its own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    train = crc_mod("doc_id", folds) != held
    known = labels.filter(train & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("toxic"))
    known = cut(known, "labels")
    labelled = cut(_may_be_labelled(rows.filter(train), known).join(known, "doc_id"), "labelled")
    lexicon = Lexicon(learn_lexicon(labelled))
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").select("toxic", "text")
    n = labelled.count()
    if n > FIT_ROWS:  # by hash, so that no sort of all texts is needed
        edge = int(2**32 * FIT_ROWS / n)
        sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**32)) < edge).select("toxic", "text").limit(FIT_ROWS)
    got = _features_of(sample, lexicon, "toxic").toPandas()
    x = np.array(got["x"].tolist()) if len(got) else np.zeros((0, FEATURES))
    y = got["toxic"].to_numpy(float)
    weights = fit(x, y)
    learned = bool(len(y)) and 0 < y.sum() < len(y)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            for b in blocks(batch):
                p = 1 / (1 + np.exp(-np.clip(scorer.features(b.column("text")) @ weights[:-1] + weights[-1], -30, 30))) if learned else np.zeros(b.num_rows)
                yield pa.record_batch({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": p, "predicted": (p >= threshold).astype(np.int32)})

    scored = rows.select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "text")
    return scored.mapInArrow(each, "doc_id long, held_out boolean, score double, predicted int")
