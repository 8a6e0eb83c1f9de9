"""Personal data: base patterns, and a semi-Markov conditional random field over what looks like it.

A text is looked at only around anchors (digits and at-signs): the words near them form
windows, however long, and the field labels each window. A segment is up to MAX_WORDS words of one type, or one other word. Features look
at a whole span: its shape, digit groups, checksum, bounds and neighbours. The best segmentation is found by dynamic
programming over ends, span lengths and types together; training follows the gradient of the
log likelihood, with the same recursion in log space.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_ORDER = {k: i for i, k in enumerate(KINDS)}
#: The most words that a segment of each kind has.
MAX_WORDS = {"email": 5, "ip": 1, "card": 5, "phone": 5}
_LONGEST = max(MAX_WORDS.values())
#: Words of context on both sides of an anchor.
CONTEXT = 3

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(x) <= 3 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in text.split(".")))


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns that pass their checks, per kind leftmost and not overlapping, by start, then kind.

    An email's local part is the run of its characters before the at-sign (from the last match on), so each at-sign is looked at once.
    """
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = max(free, at)  # a later local part can't hold this at-sign
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m.group())]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]]))


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: Words end at blanks, and after signs that separate fields.
_WORD = re.compile(r"[^\s,;|]++[,;|]*+|[,;|]++")
_CORE = re.compile(r"[A-Za-z0-9+(](?:.*[A-Za-z0-9)])?")
_GROUPS = re.compile(r"[0-9]+")
#: An address that is spelled out somewhere; only then is the word "at" an anchor.
_SAID = re.compile(r"\s[\[(]?at[\])]?\s+[A-Za-z0-9-]{1,64}\s+[\[(]?dot[\])]?\s")


def _windows(text: str) -> Iterator[list[re.Match]]:
    """The words around anchors, as runs."""
    said = _SAID.search(text) is not None if " at" in text or "[at" in text or "(at" in text else False
    if "@" not in text and not _DIGIT.search(text) and not said:
        return
    run: list[re.Match] = []
    before: list[re.Match] = []
    since = CONTEXT + 1
    for m in _WORD.finditer(text):
        word = m.group()
        anchor = "@" in word or _DIGIT.search(word) is not None or (said and word in ("at", "(at)", "[at]"))
        if anchor:
            if not run:
                run = before[-CONTEXT:]
            run.append(m)
            since = 0
        elif run:
            run.append(m)
            since += 1
            if since == CONTEXT:
                yield run
                run = []
        before = [*before[-CONTEXT:], m]
    if run:
        yield run


#: Words before or in a span that speak for a kind.
CUES = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "debit", "payment", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "ring", "telephone"),
    "other": ("order", "invoice", "version", "isbn", "serial", "id", "no", "number", "page", "figure", "section", "year", "ref", "total", "license", "licensed"),
}
_CUE = {w: k for k, ws in CUES.items() for w in ws}


def _features(kind: str, words: list[str], i: int, j: int) -> list[str]:
    """Of words i to j (exclusive) as one segment of the kind."""
    span = " ".join(words[i:j])
    m = _CORE.search(span)
    core = m.group() if m else ""
    digits = [len(g) for g in _GROUPS.findall(core)]
    n = sum(digits)
    rest = re.sub(r"[0-9 ().+-]", "", core)
    shape = "-".join(map(str, digits)) if len(digits) <= 6 else "many"
    separators = "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", core))))[:6]
    out = [f"{kind}|bias", f"{kind}|words={j - i}", f"{kind}|digits={min(n, 20)}", f"{kind}|groups={shape}", f"{kind}|letters={min(len(rest), 6)}", f"{kind}|signs={separators}"]
    cue = _CUE.get(words[i - 1].strip(":,.;#()").lower(), "-") if i else "^"
    out.append(f"{kind}|cue={cue}")
    if kind == "other":
        return out
    if kind == "card":
        ok = 12 <= n <= 19 and not rest and luhn("".join(_GROUPS.findall(core)))
        out.append(f"card|luhn={ok}")
    elif kind == "ip":
        ok = len(digits) == 4 and re.fullmatch(r"\d+(\.\d+){3}", core) is not None
        out.append(f"ip|octets={ok and _octets(core)}")
    elif kind == "phone":
        out.append(f"phone|plus={core.startswith('+')}|n={9 <= n <= 15}")
        out.append(f"phone|form={re.fullmatch(r'[+(]?[0-9(][0-9() .+-]*[0-9]', core) is not None and 7 <= n <= 15}")
    else:
        out.append(f"email|at={re.fullmatch(r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', core) is not None}")
        out.append(f"email|said={re.fullmatch(r'[A-Za-z0-9._-]+ [([]?at[])]? [A-Za-z0-9-]+( [([]?dot[])]? [A-Za-z]+|[.][A-Za-z]+)+', core) is not None}")
    out.append(f"{kind}|whole={_whole(words[i:j])}")
    return out


def _whole(words: list[str]) -> bool:
    """Only the first and the last word of a span may have signs around them."""
    return all(w[-1:] not in ",;:!?" for w in words[:-1])


def _allowed(kind: str, words: list[str], i: int, j: int) -> bool:
    """Candidate segments: a type's span begins and ends with a word that can be a part of it."""
    if j - i > MAX_WORDS[kind]:
        return False
    first, last = words[i], words[j - 1]
    if kind == "email":
        return (j - i == 1 and "@" in first) or (j - i > 4 and words[i + 1].strip("([])") == "at" and words[i + 3].strip("([])") == "dot")
    if kind == "ip":
        return first.count(".") >= 3
    return all(_DIGIT.search(w) for w in (first, last)) and all(_DIGIT.search(w) or w == "-" for w in words[i:j])


Segment = tuple[int, int, str]


def _ending(words: list[str], j: int) -> list[tuple[int, str]]:
    """Candidate segments that end before word j: their first words and kinds."""
    out = [(j - 1, "other")]
    for i in range(max(0, j - _LONGEST), j):
        out += [(i, k) for k in KINDS if _allowed(k, words, i, j)]
    return out


def _lattice(words: list[str]) -> list[Segment]:
    """All candidate segments."""
    return [(i, j, k) for j in range(1, len(words) + 1) for i, k in _ending(words, j)]


class SemiCrf:
    """Weights of features; the score of a segmentation is the sum over its segments."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def _score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features])

    def best(self, words: list[str]) -> list[Segment]:
        """The best segmentation, by dynamic programming over ends: linear in the words, as spans are bounded."""
        n = len(words)
        top, back = [0.0] + [-math.inf] * n, [(0, "")] * (n + 1)
        for j in range(1, n + 1):
            for i, kind in _ending(words, j):
                s = top[i] + self._score(_features(kind, words, i, j))
                if s > top[j]:
                    top[j], back[j] = s, (i, kind)
        out, j = [], n
        while j:
            i, kind = back[j]
            out.append((i, j, kind))
            j = i
        return out[::-1]

    @classmethod
    def train(cls, labelled: list[tuple[list[str], list[Segment]]], rounds: int = 6, rate: float = 0.5, decay: float = 1e-4) -> SemiCrf:
        """Stochastic gradient ascent of the log likelihood: features of the given segmentation less those expected."""
        weights: dict[str, float] = defaultdict(float)
        squares: dict[str, float] = defaultdict(float)
        lattices = []
        for words, gold in labelled:
            lattice = _lattice(words)
            lattices.append((len(words), [(i, j, _features(k, words, i, j)) for i, j, k in lattice], [_features(k, words, i, j) for i, j, k in gold]))
        for _ in range(rounds):
            for n, segments, gold in lattices:
                for f, g in gradient(n, segments, gold, weights)[0].items():
                    if abs(g) > 1e-6:
                        g -= decay * weights[f]
                        squares[f] += g * g
                        weights[f] += rate * g / math.sqrt(squares[f] + 1e-8)
        return cls(dict(weights))


def gradient(n: int, segments: list[tuple[int, int, list[str]]], gold: list[list[str]], weights: dict[str, float]) -> tuple[dict[str, float], float]:
    """The log likelihood's gradient by feature, and the log likelihood, of the gold segments' features among all segmentations of n words."""
    scores = [sum([weights[f] for f in features]) for _, _, features in segments]
    fore, aft = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for (i, j, _), s in sorted(zip(segments, scores, strict=True), key=lambda x: x[0][1]):
        fore[j] = _logadd(fore[j], fore[i] + s)
    for (i, j, _), s in sorted(zip(segments, scores, strict=True), key=lambda x: -x[0][0]):
        aft[i] = _logadd(aft[i], aft[j] + s)
    change: dict[str, float] = defaultdict(float)
    for features in gold:
        for f in features:
            change[f] += 1.0
    for (i, j, features), s in zip(segments, scores, strict=True):
        p = math.exp(fore[i] + s + aft[j] - fore[n])
        for f in features:
            change[f] -= p
    return change, sum(weights[f] for features in gold for f in features) - fore[n]


def _logadd(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


#: Sentences that the field is trained on. They are made, not taken from the corpus, and their number is fixed.
TRAINING = 500


def made_sentences(n: int = TRAINING, seed: int = 7) -> list[tuple[list[str], list[Segment]]]:
    """Labelled sentences: personal data in many forms among words, and numbers that are none."""
    r = random.Random(seed)
    syllables = "an be ci do en for ga hi in jo ka la mi no or pe qui ra st tion ver wo".split()

    def word() -> str:
        return "".join(r.choices(syllables, k=r.randint(1, 3))) + r.choice(["", "", "", "", ",", "."])

    def number(k: int) -> str:
        return "".join(r.choices("0123456789", k=k))

    def card() -> str:
        head = r.choice("3456") + number(14)
        digits = next(head + d for d in "0123456789" if luhn(head + d))
        return r.choice([digits, " ".join(digits[i : i + 4] for i in range(0, 16, 4)), "-".join(digits[i : i + 4] for i in range(0, 16, 4))])

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+{number(2)} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{number(11)}"])

    def email() -> str:
        name, host = word().strip(",."), word().strip(",.")
        return r.choice([f"{name}.{number(2)}@{host}.com", f"{name}@mail{number(1)}.{host}.org", f"{name} at {host} dot com", f"{name} [at] {host} [dot] org"])

    def other() -> str:
        bad = number(16)
        while luhn(bad):
            bad = number(16)
        return r.choice([number(r.randint(1, 6)), f"{r.randint(1900, 2030)}-{number(2)}-{number(2)}", f"{number(2)}.{number(1)}.{number(1)}", bad, f"$ {number(3)}.{number(2)}", f"{number(3)}.{number(3)}.999.{number(3)}", number(10), number(16) + "abc", f"@{word().strip(',.')}", "at", f"{number(4)} {number(4)}", f"{word().strip(',.')}{number(3)}", '"' + "%040x" % r.getrandbits(160) + '"', "4.0.", "2.0."])

    def ip() -> str:
        return ".".join(str(r.randint(1, 255)) for _ in range(4))

    made = {"email": email, "ip": ip, "card": card, "phone": phone, "other": other}
    def table() -> str:
        """Numbers in columns, and names with digits in them."""
        form = r.choice(["{0}", "{0}", "{0}.{1}", "20{1}{1}-0{1}-1{1}", "{2}{0}{2}", "{0}%", "{1}:{0}", "{0};", "{0},"])
        k = r.randint(1, 5)
        return " ".join(form.format(number(r.choice([k, k, k, r.randint(1, 5)])), number(1), r.choice("vxnk")) for _ in range(r.randint(5, 14)))

    out = []
    for at in range(n):
        words: list[str] = []
        gold: list[Segment] = []

        def add(text: str, kind: str, words: list[str] = words, gold: list[Segment] = gold) -> None:
            new = _WORD.findall(text)
            if kind == "other":
                gold.extend((len(words) + k, len(words) + k + 1, "other") for k in range(len(new)))
            else:
                gold.append((len(words), len(words) + len(new), kind))
            words.extend(new)

        if at % 5 == 0:
            add(table(), "other")
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(0, 3)):
                add(word(), "other")
            kind = r.choice(("email", "ip", "card", "phone", "other", "other"))
            if r.random() < 0.3:
                add(r.choice(CUES[kind]) + r.choice(["", ":"]), "other")
            add(made[kind]() + r.choice(["", "", "", ".", ","]), kind)
        for _ in range(r.randint(0, 2)):
            add(word(), "other")
        out.append((words, gold))
    return out


@lru_cache(maxsize=1)
def trained() -> SemiCrf:
    """The field trained on made_sentences(); the same wherever it is trained."""
    return SemiCrf.train(made_sentences())


def all_spans(text: str, base: list[Span], field: SemiCrf) -> list[Span]:
    """The base spans, and those that the field finds where no base span is, by start, then kind."""
    out = list(base)
    for run in _windows(text):
        words = [m.group() for m in run]
        for i, j, kind in field.best(words):
            if kind == "other":
                continue
            start, end = run[i].start(), run[j - 1].end()
            m = _CORE.search(text, start, end)
            if m:
                start, end = m.start(), m.end()
                if all(b <= start or a >= end for _, a, b in base):
                    out.append((kind, start, end))
    return sorted(out, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def find(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, text): counts of base spans by kind, base_sha256, spans, and n_added by the field.

    Whole texts are scanned where they are read; nothing is shuffled. A null or empty text has no spans;
    repeated rows and null doc_ids are kept; other columns are ignored; no rows: no rows. A very long text, and a run of
    numbers of any length, is labelled as one: the work is in proportion to it.
    """
    field = trained()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                spans = all_spans(text, base, field)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans), len(spans) - len(base)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
