"""Token counts: batches of about equal bytes through the tokenizer's own library, of which only lengths are kept."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanika.llm.common import blocks, hash_spans, text_buffers

#: Characters after which a text is cut at its next safe place, and UTF-8 bytes of a batch (a longer piece alone).
PIECE, BATCH = 1 << 14, 1 << 18

# What the libraries' versions of Unicode may or may not take for blanks is no safe side of a cut.
_INK = "[^\\s\\u180e\\u200b-\\u200f\\u2060\\ufeff]"
#: Between ink and the blank or line feed after it: no match of the byte-level or word-end files' first step crosses that, nor looks back over it.
_BLANKS = re.compile(f"(?<={_INK})(?=[ \\n])")
#: Also between letters and digits, and before a stop of a script without blanks: different classes of those first steps.
_CLASSES = re.compile(f"(?<={_INK})(?=[ \\n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5])(?=[\\u3001\\u3002\\uff0c\\uff01\\uff1f])")
#: At a single blank between ink: the blank itself goes, as the library puts one before each text.
_SINGLE = re.compile(f"(?<={_INK}) (?={_INK})")


#: Bytes that begin a character, and whether one that begins so is ink for sure: letters of ASCII to U+07FF, of India and of East Asia, and all beyond U+FFFF.
_LEADS = np.zeros(256, bool)
_LEADS[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xEE), *range(0xF0, 0xF5)]] = True


def _cuts(data: np.ndarray, single: bool) -> np.ndarray:
    """Places of the blanks (and line feeds, unless single) that come right after ink, and, if single, right before ink."""
    at = np.flatnonzero((data[1:] == 32) | ((data[1:] == 10) & (not single))) + 1
    lead = at - 1
    for _ in range(3):
        lead = lead - ((data[lead] & 0xC0) == 0x80) * (lead > 0)
    at = at[_LEADS[data[lead]]]
    return at[(at + 1 < len(data)) & _LEADS[data[np.minimum(at + 1, len(data) - 1)]]] if single else at


class Lengths:
    """Token counts of texts as the file's library gives them: tokenizers for .json, sentencepiece for .model.

    Special strings in a text count as the library takes them unless told otherwise; no begin, end or added tokens, no truncation, no padding. safe: where a text may be cut so that the
    pieces' counts add up to its own; None, if the file's first step is none that is known here: then every text is one piece.

    column() cuts texts at all safe blanks and gives each distinct piece to the library once a worker; pieces are told apart by 64 bits of hash.
    """

    #: Pieces to keep; when there are more, all are forgotten. It bounds memory and changes no result.
    KEEP = 3_000_000

    def __init__(self, path: str) -> None:
        self.known, self.n = np.empty(0, np.uint64), np.empty(0, np.int64)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.safe: re.Pattern[str] | None = None
        self.count: Callable[[list[str]], list[int]]
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            lib = SentencePieceProcessor(model_file=path)
            self.count = lambda texts: [len(x) for x in lib.encode(texts, num_threads=1)]
            space = "▁"
            # No piece goes on over a blank, and a text gets one in front: then both sides of a single blank are encoded on their own.
            if not any(space in x.lstrip(space) for x in map(lib.id_to_piece, range(lib.get_piece_size()))) and lib.encode("b", out_type=str)[0].startswith(space):
                self.safe = _SINGLE
        else:
            from tokenizers import Tokenizer

            lib = Tokenizer.from_file(path)
            lib.no_truncation()
            lib.no_padding()
            self.count = lambda texts: [len(x) for x in lib.encode_batch_fast(texts, add_special_tokens=False)]
            self.safe = _safe(json.loads(Path(path).read_text()))

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces of about PIECE characters, cut at safe places; where there is none, a piece goes on to the next."""
        at = 0
        while self.safe and len(text) - at > PIECE and (m := self.safe.search(text, at + PIECE)):
            yield text[at : m.start()] if at else text[: m.start()]
            at = m.end()
        yield text[at:] if at else text

    def of(self, texts: list[str]) -> np.ndarray:
        """The count of each text."""
        out = np.zeros(len(texts), np.int64)
        held: list[str] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            np.add.at(out, owners, self.count(held))
            held.clear()
            owners.clear()

        for i, text in enumerate(texts):
            for piece in self.pieces(text):
                n = len(piece) if piece.isascii() else len(piece.encode())
                if held and size + n > BATCH:
                    flush()
                    size = 0
                held.append(piece)
                owners.append(i)
                size += n
        if held:
            flush()
        return out


    def column(self, texts: pa.Array) -> np.ndarray:
        """The count of each text of a column without nulls."""
        data, offs = text_buffers(texts)
        if not self.safe or not len(data):
            return self.of(texts.to_pylist())
        single = self.safe is _SINGLE
        cuts = _cuts(data, single)
        cuts = cuts[~np.isin(cuts, offs) & ~(single & np.isin(cuts + 1, offs))]  # what is ink must be the same text's
        starts = np.unique(np.concatenate([offs[:-1], cuts]))
        ends = np.append(starts[1:], len(data))
        per = np.diff(np.searchsorted(starts, offs))
        if single:  # the blank belongs to neither side
            starts = starts + np.isin(starts, cuts)
        lens = ends - starts
        hashes = hash_spans(data, starts, lens)
        unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.KEEP:
            self.known, self.n = np.empty(0, np.uint64), np.empty(0, np.int64)
        place = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != unique[inside]
        if new.any():
            found = self.of([data[a : a + k].tobytes().decode() for a, k in zip(starts[where[new]].tolist(), lens[where[new]].tolist(), strict=True)])
            self.known, self.n = np.insert(self.known, place[new], unique[new]), np.insert(self.n, place[new], found)
            place = np.searchsorted(self.known, unique)
        sums = np.concatenate([[0], np.cumsum(self.n[place][back])])
        return np.diff(sums[np.concatenate([[0], np.cumsum(per)])])


def _safe(file: dict) -> re.Pattern[str] | None:
    """Where texts of a tokenizers file may be cut, as its first step says."""
    added = file.get("added_tokens") or []
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or _BLANKS.search(x["content"]) for x in added) or file.get("truncation") or file.get("padding"):
        return None
    first, before = file.get("pre_tokenizer") or {}, file.get("normalizer")
    if before is None and first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space"):
        return _BLANKS if any(_CLASSES.search(x["content"]) for x in added) else _CLASSES
    steps = [x.get("type") for x in first.get("pretokenizers", [])]
    plain = {"NFC", "Replace", "Lowercase"}
    if steps == ["Split", "ByteLevel"] and before and {x["type"] for x in before.get("normalizers", [])} <= plain and "\\s" not in first["pretokenizers"][0]["pattern"].get("Regex", "\\s").replace("[^\\s", "["):
        return _BLANKS
    return None


@lru_cache(maxsize=2)
def lengths(path: str) -> Lengths:
    """The worker's own library, kept for the tasks that follow."""
    return Lengths(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens) of every whole text of docs (doc_id, text).

    A null text is empty: no bytes, no tokens. Repeated rows and null doc_ids are rows as others; other columns are ignored; no rows: no rows.
    Rows stay in their partitions; of a text, only its two counts leave the task. A text without any safe place to cut is one piece, however long.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lengths(path)
        for batch in batches:
            for b in blocks(batch):
                _, offs = text_buffers(b.column("text"))
                n = own.column(b.column("text"))
                yield pa.record_batch({"doc_id": b.column("doc_id"), "n_bytes": np.diff(offs), "n_tokens": n, "over_limit": n > limit})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
