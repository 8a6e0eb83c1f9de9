"""The Hindi text frontend: Column -> Column functions in the order normalize, expand_numbers, transliterate, delete_schwa, inject_prosody.

All but Unicode's NFC, which Spark has no function for, and numbers within texts are built-in expressions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Cardinals from 0 to 99.
CARDINALS = (
    "शून्य एक दो तीन चार पाँच छह सात आठ नौ दस ग्यारह बारह तेरह चौदह पंद्रह सोलह सत्रह अठारह उन्नीस "
    "बीस इक्कीस बाईस तेईस चौबीस पच्चीस छब्बीस सत्ताईस अट्ठाईस उनतीस तीस इकतीस बत्तीस तैंतीस चौंतीस पैंतीस छत्तीस सैंतीस अड़तीस उनतालीस "
    "चालीस इकतालीस बयालीस तैंतालीस चौवालीस पैंतालीस छियालीस सैंतालीस अड़तालीस उनचास पचास इक्यावन बावन तिरेपन चौवन पचपन छप्पन सत्तावन अट्ठावन उनसठ "
    "साठ इकसठ बासठ तिरेसठ चौंसठ पैंसठ छियासठ सरसठ अड़सठ उनहत्तर सत्तर इकहत्तर बहत्तर तिहत्तर चौहत्तर पचहत्तर छिहत्तर सतहत्तर अठहत्तर उनासी "
    "अस्सी इक्यासी बयासी तिरासी चौरासी पचासी छियासी सत्तासी अट्ठासी नवासी नब्बे इक्यानवे बानवे तिरानवे चौरानवे पचानवे छियानवे सत्तानवे अट्ठानवे निन्यानवे"
).split()
# Months, and words of the number patterns.
MONTHS = "जनवरी फ़रवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर अक्टूबर नवंबर दिसंबर".split()
HUNDRED, THOUSAND, LAKH, CRORE, ARAB, MINUS, POINT = "सौ", "हज़ार", "लाख", "करोड़", "अरब", "ऋण", "दशमलव"
HOURS, PAST, MINUTES, PERCENT, RUPEES = "बजे", "बजकर", "मिनट", "प्रतिशत", "रुपये"
# Transliteration, longest first where one begins another.
LATIN = {
    "sh": "श", "ch": "च", "th": "थ", "ph": "फ", "kh": "ख", "gh": "घ", "jh": "झ", "dh": "ध", "bh": "भ",
    "aa": "आ", "ee": "ई", "oo": "ऊ", "ai": "ऐ", "au": "औ", "a": "अ", "e": "ए", "i": "इ", "o": "ओ", "u": "उ",
    "k": "क", "g": "ग", "j": "ज", "t": "त", "d": "द", "n": "न", "p": "प", "b": "ब", "m": "म", "y": "य", "r": "र", "l": "ल",
    "v": "व", "w": "व", "s": "स", "h": "ह", "f": "फ", "z": "ज़", "x": "क्स", "q": "क", "c": "क",
}
# Prosody tokens, and the signs they stand for, in the order in which they are replaced.
PROSODY_TOKENS = ["<p_short>", "<p_medium>", "<p_long>", "<falling>", "<rising>", "<emphasis>", "<trail>"]
PROSODY = [
    ("...", " <trail> <p_long> "), ("…", " <trail> <p_long> "), ("॥", " <falling> <p_long> "), ("।", " <falling> <p_medium> "),
    ("?", " <rising> <p_medium> "), ("!", " <emphasis> <p_medium> "), (";", " <p_medium> "), (":", " <p_short> "),
    ("—", " <p_short> "), ("–", " <p_short> "), (",", " <p_short> "), (".", " <falling> <p_medium> "),
]
DROPPED_SIGNS = "[\"'`~@#$%^&*=+\\[\\]{}|\\\\/]"
# Devanagari classes. The nukta (U+093C) counts as a consonant; candra vowels are in no class.
CONSONANTS = "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह\u093c"
VOWEL_SIGNS = "ािीुूृेैोौंःँ"
VOWELS = "अआइईउऊऋएऐओऔ"
HALANT = "\u094d"
INVISIBLE = "[\u200b-\u200f\u2060\ufeff]"

_DEVANAGARI_DIGITS = "०१२३४५६७८९"
_D = f"[0-9{_DEVANAGARI_DIGITS}]"
_LEFT, _RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def collapse(text: Column) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """NFC, without invisible characters, white space collapsed; null becomes empty."""
    return collapse(F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), INVISIBLE, ""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once and written once in the plan, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _below_100(n: Column) -> Column:
    return F.get(F.split(F.lit(" ".join(CARDINALS)), " "), n.cast("int"))


def _below_billion(n: Column) -> Column:
    """n from 1 to 999,999,999; 0 gives an empty text."""
    units = F.array(*(F.struct(F.lit(size).alias("size"), F.lit(mod).alias("mod"), F.lit(unit).alias("unit")) for size, mod, unit in ((10_000_000, 100, f" {CRORE}"), (100_000, 100, f" {LAKH}"), (1000, 100, f" {THOUSAND}"), (100, 10, f" {HUNDRED}"), (1, 100, ""))))
    parts = F.transform(units, lambda u: F.struct((F.floor(n / u["size"]) % u["mod"]).alias("k"), u["unit"].alias("unit")))
    return F.array_join(F.transform(F.filter(parts, lambda p: p["k"] > 0), lambda p: F.concat(_below_100(p["k"]), p["unit"])), " ")


def spell_digits(digits: Column) -> Column:
    """The cardinal of a run of digits of any length: nine digits at a time from the right, without any number type that ends somewhere."""
    def spelled(plain: Column) -> Column:
        n = F.ceil(F.length(plain) / 9).cast("int")
        padded = F.lpad(plain, 9 * n, F.lit("0"))
        groups = F.transform(F.sequence(F.lit(0), n - 1), lambda k: _below_billion(F.substring(padded, 9 * k + 1, F.lit(9)).cast("long")))
        # What is higher is so many times a thousand million, whatever the next group is.
        return F.aggregate(groups, F.lit(""), lambda higher, g: F.concat_ws(" ", F.when(higher != "", F.concat(higher, F.lit(f" {ARAB}"))), F.when(g != "", g)))

    def of(d: Column) -> Column:
        plain = F.regexp_replace(F.translate(d, _DEVANAGARI_DIGITS, "0123456789"), "^0+", "")
        return _let(plain, lambda p: F.when(p == "", CARDINALS[0]).otherwise(spelled(p)))

    return _let(digits, of)


def cardinal(n: Column) -> Column:
    """An integer in words, in the Indian grouping."""
    words = spell_digits(F.regexp_replace(n.cast("string"), "^-", ""))
    return F.when(n < 0, F.concat(F.lit(f"{MINUS} "), words)).otherwise(words)


def replace_matches(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """text with change() of each match of the pattern: the pieces between matches and the changed matches, in turn."""
    def of(t: Column) -> Column:
        changed = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), change)
        return F.array_join(F.zip_with(F.split(t, pattern, -1), changed, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")

    return _let(text, of)


#: Unicode's white space, as a regular expression of Java has it by (?U).
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
WHITE_SPACE = re.compile(_SPACE)
_NUMBER = f"{_D}+(?:\\.{_D}+)?"
_PLAIN = str.maketrans(_DEVANAGARI_DIGITS, "0123456789")
_SIZES = ((10_000_000, 100, f" {CRORE}"), (100_000, 100, f" {LAKH}"), (1000, 100, f" {THOUSAND}"), (100, 10, f" {HUNDRED}"), (1, 100, ""))


def _said(digits: str) -> str:
    """spell_digits() of one run."""
    plain = digits.translate(_PLAIN).lstrip("0")
    words: list[str] = []
    for at in range(-(-len(plain) % 9), len(plain), 9):
        n = int(plain[max(0, at) : at + 9])
        words += [ARAB] if words else []
        words += [CARDINALS[n // size % mod] + unit for size, mod, unit in _SIZES if n // size % mod]
    return " ".join(words) or CARDINALS[0]


def _said_amount(number: str) -> str:
    """Whole part in words, then digit by digit; digits of the fraction that aren't ASCII stay."""
    whole, point, fraction = number.partition(".")
    return f"{_said(whole)} {POINT} {' '.join(CARDINALS[int(c)] if c.isascii() else c for c in fraction)}" if point else _said(whole)


def _said_time(m: re.Match) -> str:
    h, minute = map(int, m[0].split(":"))
    if h > 23 or minute > 59:
        return m[0]
    return f"{CARDINALS[h]} {PAST} {CARDINALS[minute]} {MINUTES}" if minute else f"{CARDINALS[h]} {HOURS}"


def _said_date(m: re.Match) -> str:
    d, month, y = map(int, re.split("[/-]", m[0]))
    if not (1 <= d <= 31 and 1 <= month <= 12):
        return m[0]
    return f"{CARDINALS[d]} {MONTHS[month - 1]} {_said(str(y + 2000 if y < 50 else y + 1900 if y < 100 else y))}"


#: The passes in order; the last one takes what the others have left.
_PASSES: list[tuple[re.Pattern, Callable[[re.Match], str]]] = [
    (re.compile(f"{_LEFT}{_D}{{1,2}}:{_D}{{2}}{_RIGHT}"), _said_time),
    (re.compile(f"{_LEFT}{_D}{{1,2}}[/-]{_D}{{1,2}}[/-]{_D}{{2,4}}{_RIGHT}"), _said_date),
    (re.compile(f"{_LEFT}({_NUMBER}){_SPACE}*%"), lambda m: f"{_said_amount(m[1])} {PERCENT}"),
    (re.compile(f"(?:₹|Rs\\.?{_SPACE}*)({_NUMBER})"), lambda m: f"{_said_amount(m[1])} {RUPEES}"),
    (re.compile(f"{_LEFT}{_D}+\\.{_D}+{_RIGHT}"), lambda m: _said_amount(m[0])),
    (re.compile(f"{_LEFT}{_D}+{_RIGHT}"), lambda m: _said(m[0])),
]


def _expanding(passes: list[tuple[re.Pattern, Callable[[re.Match], str]]]) -> Callable[[Column], Column]:
    digit = re.compile(_D)

    def of(t: str | None) -> str | None:
        # Most texts have no digits at all; they are left untouched.
        if t is not None and digit.search(t):
            for pattern, said in passes:
                t = pattern.sub(said, t)
        return t

    @pandas_udf(StringType())
    def each(text: pd.Series) -> pd.Series:
        return text.map(of)

    return each


_ALL_PASSES, _INTEGERS = _expanding(_PASSES), _expanding(_PASSES[-1:])


def expand_numbers(text: Column) -> Column:
    """Times, dates, percentages, amounts in rupees, decimals and integers in words, in this order of passes.

    Digits next to Devanagari letters count, those in ASCII words don't. What a pass leaves, a later one may take. A match is changed
    by its own value; expressions do that in functions of arrays, which Spark interprets: 600,000 texts took 3.6 times as long.
    """
    return _ALL_PASSES(text)


def expand_integers(text: Column) -> Column:
    """The last pass of expand_numbers() alone."""
    return _INTEGERS(text)


def _by_rule(low: Column) -> Column:
    """Lower-case Latin letters by rule: first the units of two letters, in the table's order, then what one letter stands for."""
    for unit, sign in LATIN.items():
        if len(unit) > 1 or len(sign) > 1:
            low = F.replace(low, F.lit(unit), F.lit(sign))
    single = {k: v for k, v in LATIN.items() if len(k) == len(v) == 1}
    return F.translate(low, "".join(single), "".join(single.values()))


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def transliterate(text: Column, dictionary: Column | None = None) -> Column:
    """Each run of Latin letters by the dictionary (map of lower-case words) if it has it, else by rule."""
    if dictionary is None:
        return _by_rule(F.translate(text, _CAPITALS, _CAPITALS.lower()))
    return replace_matches(text, "[A-Za-z]+", lambda w: F.coalesce(F.try_element_at(dictionary, F.lower(w)), _by_rule(F.lower(w))))


_WORD = re.compile("[A-Za-z]+")


@lru_cache(1 << 16)
def _ruled(word: str) -> str:
    """_by_rule() of one word; common words come up again and again."""
    low = word.lower()
    for unit, sign in LATIN.items():
        low = low.replace(unit, sign)
    return low


@pandas_udf(StringType())
def transliterated(text: pd.Series, words: pd.Series, spoken: pd.Series) -> pd.Series:
    """transliterate() of texts that each have a dictionary of their own: lower-case words and what they are spoken as, in two arrays; null: none."""
    def of(t: str | None, w: Sequence[str] | None, s: Sequence[str] | None) -> str | None:
        if t is None:
            return None
        own = {} if w is None else dict(zip(w, s, strict=True))

        def said(m: re.Match) -> str:
            known = own.get(m[0].lower())
            return _ruled(m[0]) if known is None else known

        return _WORD.sub(said, t)

    return pd.Series(map(of, text, words, spoken), dtype=object)


SCHWA_PATTERN = "([{c}{v}][{c}{v}{m}{h}]*[{c}])((?:[{v}][{v}{m}{h}]*)?)([^{c}{v}{m}{h}]|$)".format(c=CONSONANTS, v=VOWELS, m=VOWEL_SIGNS, h=HALANT)


def delete_schwa(text: Column) -> Column:
    """A halant after the last consonant of each Devanagari run that has no vowel sign, if a letter comes before it."""
    return F.regexp_replace(text, SCHWA_PATTERN, f"$1{HALANT}$2$3")


def inject_prosody(text: Column) -> Column:
    """Punctuation as prosody tokens; signs that stand for nothing are dropped."""
    for sign, token in PROSODY:
        text = F.replace(text, F.lit(sign), F.lit(token))
    return collapse(F.regexp_replace(text, DROPPED_SIGNS, " "))


def frontend(text: Column, dictionary: Column | None = None, schwa: bool = True, prosody: bool = True) -> Column:
    """All steps in order; schwa and prosody can be left out."""
    t = transliterate(expand_numbers(normalize(text)), dictionary)
    if schwa:
        t = delete_schwa(t)
    return inject_prosody(t) if prosody else t
