"""Attack signatures: one search for all fixed texts, then guarded regular expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import or_
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The signature patterns of each category.
SIGNATURES = {
    "SQLi": (
        r"union\s+select", r"select\s+.*\s+from", r"or\s+1=1", r"drop\s+table", r"insert\s+into",
        r"update\s+.*\s+set", r"delete\s+from", r"alter\s+table", r"create\s+table", r"--", r"#",
        r"/\*.*\*/", r"'\s*or\s*'", r"or\s+'.*'='.*'", r"having\s+1=1", r"sleep\s*\(",
        r"benchmark\s*\(", r"information_schema", r"load_file\s*\(", r"into\s+outfile",
    ),
    "XSS": (
        r"<script.*?>", r"javascript:", r"onerror=", r"alert\(", r"onload=", r"onmouseover=",
        r"onfocus=", r"onmouseenter=", r"document\.cookie", r"document\.location",
        r"window\.location", r"<img.*?src=", r"<svg.*?>", r"<iframe.*?>", r"eval\(",
        r"settimeout\(", r"setinterval\(", r"fromcharcode",
    ),
    "Command_Injection": (
        r";\s*ls", r";\s*cat", r";\s*whoami", r"&&\s*", r"\|\s*", r"`.*`", r"\$\(", r";\s*id",
        r";\s*pwd", r";\s*uname", r";\s*ps", r";\s*netstat", r";\s*curl", r";\s*wget",
        r";\s*bash", r";\s*sh",
    ),
    "Path_Traversal": (
        r"\.\./\.\./", r"/etc/passwd", r"/windows/system32", r"\.\.\\", r"\.\./", r"\.\.\/",
        r"%2e%2e%2f", r"%2e%2e/", r"%252e%252e", r"/proc/self/environ", r"/boot.ini",
        r"c:\\windows", r"\.\.%2f",
    ),
    "File_Inclusion": (
        r"php://", r"file://", r"include\(", r"require\(", r"include_once\(", r"require_once\(",
        r"data://", r"expect://", r"zip://", r"phar://", r"php:\/\/input",
    ),
    "SSRF": (
        r"http://127\.0\.0\.1", r"localhost", r"169\.254\.169\.254", r"0\.0\.0\.0",
        r"http://0\.0\.0\.0", r"127\.0\.0\.1", r"http://localhost", r"http://\[::1\]",
        r"metadata", r"internal",
    ),
    "Credential_Leak": (
        r"password=", r"passwd=", r"authorization:", r"api_key=", r"apikey=", r"secret=",
        r"token=", r"bearer\s+[a-z0-9\-\._]+", r"client_secret", r"aws_access_key",
        r"private_key",
    ),
    "Malware_Indicators": (
        r"powershell\s+-enc", r"base64,", r"wget\s+http", r"curl\s+http", r"Invoke-Expression",
        r"iex\s*\(", r"cmd\.exe", r"mshta", r"certutil", r"bitsadmin", r"nc\s+-e",
        r"reverse\s+shell",
    ),
    "Scanning": (
        r"nmap", r"masscan", r"zmap", r"nikto", r"sqlmap", r"dirbuster", r"gobuster", r"wfuzz",
        r"whatweb", r"hydra",
    ),
    "Binary_Exploit": (
        r"\x90\x90\x90", r"\xcc", r"\x41\x41\x41", r"A{100,}", r"\x90{10,}", r"\x00{2,}",
        r"\\x90", r"segfault",
    ),
}

# Without case in all scripts, \s in all scripts, and "." stops at line feeds only.
_FLAGS = "(?iuUd)"
# Letters outside ASCII that equal an ASCII letter when case is ignored.
_FOLDED_FROM, _FOLDED_TO = "\u0130\u017f\u0131\u212a", "isik"


def literal_runs(pattern: str) -> tuple[list[str], bool]:
    """Texts every match contains, lower case, and whether the pattern is just one text.

    Knows the syntax the patterns use: escapes, classes, groups of escapes and quantifiers.
    """
    runs, run, plain = [], "", True

    def close() -> None:
        nonlocal run
        if run:
            runs.append(run.lower())
        run = ""

    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and not pattern[i + 1].isalnum():
            run, i = run + pattern[i + 1], i + 2
        elif c == "\\" and pattern[i + 1] == "x":
            run, i = run + chr(int(pattern[i + 2:i + 4], 16)), i + 4
        elif c == "\\":
            close()
            plain, i = False, i + 2
        elif c == "{":
            # "At least n" holds wherever n in a row are found.
            end = pattern.index("}", i)
            run += run[-1] * (int(pattern[i + 1:end].rstrip(",")) - 1)
            plain, i = plain and end + 1 == len(pattern), end + 1
            close()
        elif c in "*?":
            run = run[:-1]
            close()
            plain, i = False, i + 1
        elif c == "[":
            close()
            plain, i = False, pattern.index("]", i) + 1
        elif c in ".+":
            close()
            plain, i = False, i + 1
        else:
            run, i = run + c, i + 1
    close()
    return runs, plain


def category_patterns(disabled: Iterable[str] = ()) -> dict[str, list[str]]:
    """The enabled patterns per category, categories in sorted order."""
    off = set(disabled)
    kept = {c: [p for p in SIGNATURES[c] if p not in off] for c in sorted(SIGNATURES)}
    return {c: patterns for c, patterns in kept.items() if patterns}


def folded(text: Column) -> Column:
    """The text as the literal tests read it."""
    return F.lower(F.translate(text, _FOLDED_FROM, _FOLDED_TO))


class Tests(NamedTuple):
    """What a category takes: the bit of its fixed texts, and bit, further fixed parts and pattern of its expressions."""

    category: str
    plain: int
    guarded: list[tuple[int, list[str], str]]


def plan_tests(disabled: Iterable[str] = ()) -> tuple[dict[str, int], list[Tests]]:
    """The texts to search for, each with its bits, and the tests on the bits found.

    A pattern that is just a text sets the bit of its category. Any other pattern has a bit of its own,
    set by the longest of its fixed parts.
    """
    literals: dict[str, int] = {}
    tests, bit = [], 0
    for category, patterns in category_patterns(disabled).items():
        own, bit, guarded = bit, bit + 1, []
        for pattern in patterns:
            runs, plain = literal_runs(pattern)
            key = max(runs, key=len)
            if not plain:
                guarded.append((bit, [r for r in runs if r != key], pattern))
            literals[key] = literals.get(key, 0) | 1 << (own if plain else bit)
            bit += not plain
        tests.append(Tests(category, own, guarded))
    if bit > 63:
        raise ValueError("a mark holds 63 bits")
    return literals, tests


def finder(literals: dict[str, int]) -> Callable[[str], int]:
    """A function from a text to the bits of all literals in it; one pass where the automaton is installed."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: reduce(or_, (bits for literal, bits in literals.items() if literal in text), 0)
    automaton = ahocorasick.Automaton()
    for literal, bits in literals.items():
        automaton.add_word(literal, bits)
    automaton.make_automaton()
    return lambda text: reduce(or_, (bits for _, bits in automaton.iter(text)), 0)


def literal_marks(disabled: Iterable[str] = ()) -> Callable[[str], Column]:
    """A function of a column of arrays of folded texts: for each text the bits of the literals it contains.

    One automaton of all literals reads every text once, an Arrow batch at a time.
    """
    literals = plan_tests(disabled)[0]

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = finder(literals)
        for lows in batches:
            yield lows.map(lambda held: None if held is None else [None if t is None else find(t) for t in held])

    return marks


def signatures_any(forms: Column, disabled: Iterable[str] = ()) -> Column:
    """Sorted categories found in some text of an array of (_forms, _lows, _marks).

    A regular expression only runs on texts that have all its fixed parts.
    """

    def some(test: Tests) -> Column:
        def found(form: Column) -> Column:
            marks, low = form["_marks"], form["_lows"]
            hit = marks.bitwiseAND(1 << test.plain) != 0
            for bit, runs, pattern in test.guarded:
                parts = [marks.bitwiseAND(1 << bit) != 0, *[low.contains(r) for r in runs]]
                hit = hit | reduce(Column.__and__, [*parts, form["_forms"].rlike(_FLAGS + pattern)])
            return hit

        return F.exists(forms, found)

    return F.array_compact(F.array(*[F.when(some(t), t.category) for t in plan_tests(disabled)[1]]))
