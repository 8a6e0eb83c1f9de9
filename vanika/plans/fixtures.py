"""Inline inputs with expected results, for what the tables have no examples of."""

from __future__ import annotations


def values(rows: list[tuple]) -> str:
    """The rows as SQL values."""
    def one(x: object) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, float):
            return f"{x!r}::DOUBLE"
        return str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


URLS = [
    (100000, "https://www.youtube.com/watch?v=dQw4w9WgXcQ"), (100001, "https://youtu.be/dQw4w9WgXcQ"), (100002, "https://www.youtube.com/shorts/abc123xyz"),
    (100003, "https://www.youtube.com/embed/XXXyyy123"), (100004, "not-a-url"), (100005, "https://youtu.be/dQw4w9WgXcQ"),
]

CARDINALS = [
    (0, "शून्य"), (19, "उन्नीस"), (99, "निन्यानवे"), (101, "एक सौ एक"), (999, "नौ सौ निन्यानवे"), (2026, "दो हज़ार छब्बीस"), (99999, "निन्यानवे हज़ार नौ सौ निन्यानवे"),
    (100000, "एक लाख"), (123456789, "बारह करोड़ चौंतीस लाख छप्पन हज़ार सात सौ नवासी"), (-100, "ऋण एक सौ"), (1000000000, "एक अरब"), (2500000001, "दो अरब पचास करोड़ एक"),
]

NUMBERS = [
    ("3.14", "तीन दशमलव एक चार"), ("समय 10:30 है", "समय दस बजकर तीस मिनट है"), ("10:00 बजे", "दस बजे बजे"), ("15/03/2026", "पंद्रह मार्च दो हज़ार छब्बीस"),
    ("1-2-49 1-2-50", "एक फ़रवरी दो हज़ार उनचास एक फ़रवरी एक हज़ार नौ सौ पचास"), ("₹500", "पाँच सौ रुपये"), ("Rs 100", "एक सौ रुपये"), ("Rs.2.5", "दो दशमलव पाँच रुपये"), ("50%", "पचास प्रतिशत"), ("2.5 %", "दो दशमलव पाँच प्रतिशत"),
    ("1,000", "एक,शून्य"), ("25:99", "पच्चीस:निन्यानवे"), ("3.14.15", "तीन दशमलव एक चार.पंद्रह"), ("-5", "-पाँच"), ("x2", "x2"), ("15वें", "पंद्रहवें"), ("१५ है", "पंद्रह है"), ("", ""),
    ("32/13/2020", "बत्तीस/तेरह/दो हज़ार बीस"), ("1000000000000000000", "एक अरब अरब"), ("007", "सात"),
]

SCHWA = [("राम", "राम्"), ("कमल", "कमल्"), ("और", "और्"), ("कैसे", "कैसे"), ("नमस्ते", "नमस्ते"), ("hello", "hello"), ("राम्", "राम्"), ("राम घर", "राम् घर्"), ("न", "न"), ("डॉक्टर", "डॉक्टर्")]

NORMALIZE = [("यह   है", "यह है"), ("a\n\tb", "a b"), ("   ", ""), ("क​ख‌‍﻿⁠", "कख"), ("é", "é"), ("क़", "क़"), ("a b", "a b")]

PROSODY = [
    ("राम है।", "राम है <falling> <p_medium>"), ("वाह!", "वाह <emphasis> <p_medium>"), ("रुको...", "रुको <trail> <p_long>"), ("राम सीता", "राम सीता"),
    ("क्या? हाँ, ठीक; वह: \"यह\" (है)", "क्या <rising> <p_medium> हाँ <p_short> ठीक <p_medium> वह <p_short> यह (है)"), ("a*b\\c|d", "a b c d"),
]

FRONTEND = [("वर्ष 1947, 15 अगस्त को 3 बजे।", "वर्ष् एक् हज़ार् नौ सौ सैंतालीस् <p_short> पंद्रह् अगस्त् को तीन् बजे <falling> <p_medium>"), ("ram", "रअम्"), ("", "")]

_THREE = "1\n00:00:01,000 --> 00:00:03,500\nनमस्ते\n\n2\n00:00:04,000 --> 00:00:06,250\nदो\nपंक्ति\n\n3\n00:00:07,100 --> 00:00:09,000\nतीन\n"
SUBTITLES = [
    ("plain", _THREE), ("bom", "﻿" + _THREE), ("crlf", _THREE.replace("\n", "\r\n")),
    ("no_index", "00:00:01,000 --> 00:00:02,000\nA\n\n00:00:02.000 --> 00:00:03.000\nB"), ("no_arrow", "1\n00:00:01,000\nA\n\n2\n00:00:02,000 --> 00:00:03,000\nB"),
    ("two_arrows", "1\n00:00:01,000 --> 00:00:02,000 --> 00:00:03,000\nA"), ("empty_text", "1\n00:00:01,000 --> 00:00:02,000\n\n2\n00:00:02,000 --> 00:00:03,000\nB"),
    ("position", "1\n00:00:01,000 --> 00:00:02,000 X1:40\nA"), ("blank", "  \n "),
]


def _three(path: str) -> list[tuple]:
    return [(path, 1, 1.0, 3.5, "नमस्ते", None), (path, 2, 4.0, 6.25, "दो पंक्ति", None), (path, 3, 7.1, 9.0, "तीन", None)]


CUES = [
    *_three("plain"), *_three("bom"), *_three("crlf"), ("no_index", 1, 1.0, 2.0, "A", None), ("no_index", 2, 2.0, 3.0, "B", None), ("no_arrow", 2, 2.0, 3.0, "B", None),
    ("two_arrows", None, None, None, None, "two arrows"), ("empty_text", 2, 2.0, 3.0, "B", None), ("position", 1, 1.0, 2.0, "A", None),
]

ATEMPO = [(1.0, "1.0"), (2.0, "2.0"), (3.0, "2.0 1.5"), (0.3, "0.5 0.6"), (0.7, "0.7"), (1.2, "1.2"), (2.5, "2.0 1.25"), (4.0, "2.0 2.0")]
