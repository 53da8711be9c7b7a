"""The English suffix stemmer: a rule table and its interpreters.

A step is a list of rules; the first rule whose suffix ends the word decides the step, whether or not its
condition lets it change anything. Words with anything but ASCII letters are only lowered. The table is read
by ``stem`` (Python, with remembered results) and by ``stem_column`` (an Arrow UDF, once a distinct word of a batch); ``stem_sql``
is a chain of SQL selects with rules of its own, to check them by.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (suffix, replacement) of the stemmer's steps; the condition of a step is named with it.
STEP_1A = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEP_1B_FIRST = [("eed", "ee")]
STEP_1B_SECOND = [("ing", ""), ("ed", "")]
STEP_1B_REPAIR = [("at", "ate"), ("bl", "ble"), ("iz", "ize")]
STEP_1C = [("y", "i")]
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = [(s, "") for s in "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive es".split()]
STEP_5A = [("e", "")]

_PLAIN = re.compile(r"[A-Za-z]*\Z")
_VOWELS = set("aeiou")


def kinds(word: str) -> str:
    """V or C for each letter; y is the opposite of the letter before it, and a vowel at the start."""
    out, vowel = [], False
    for c in word:
        vowel = (not vowel) if c == "y" else c in _VOWELS
        out.append("V" if vowel else "C")
    return "".join(out)


def measure(word: str) -> int:
    """Number of vowel runs that a consonant run follows."""
    return kinds(word).count("VC")


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and w[-1] not in _VOWELS


def _short_end(w: str) -> bool:
    """Consonant, vowel, consonant (not w, x, y), with y taken as a consonant."""
    return len(w) > 2 and w[-1] not in _VOWELS and w[-1] not in "wxy" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def _step(w: str, rules: list[tuple[str, str]], condition) -> str:
    for suffix, new in rules:
        if w.endswith(suffix):
            rest = w[: len(w) - len(suffix)]
            return rest + new if condition(rest, suffix) else w
    return w


def _has_vowel(rest: str, _: str) -> bool:
    return "V" in kinds(rest)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word.lower()
    if not _PLAIN.match(word):
        return w
    w = _step(w, STEP_1A, lambda r, s: True)
    first = _step(w, STEP_1B_FIRST, lambda r, s: measure(r) >= 1)
    if first != w:
        w = first
    else:
        cut = _step(w, STEP_1B_SECOND, _has_vowel)
        if cut != w:
            w = cut
            for suffix, new in STEP_1B_REPAIR:
                if w.endswith(suffix):
                    w = w[: len(w) - len(suffix)] + new
                    break
            else:
                if _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and _short_end(w):
                    w += "e"
    w = _step(w, STEP_1C, _has_vowel)
    w = _step(w, STEP_2, lambda r, s: measure(r) >= 1)
    w = _step(w, STEP_3, lambda r, s: measure(r) >= 1)
    w = _step(w, STEP_4, lambda r, s: measure(r) >= 2 and (s != "ion" or r[-1:] in ("s", "t")))
    w = _step(w, STEP_5A, lambda r, s: measure(r) >= 2)
    return w[:-1] if _double(w) and w[-1] == "l" and measure(w) >= 1 else w


def _each(f, kind: pa.DataType):
    def run(words: pa.Array) -> pa.Array:
        d = pc.dictionary_encode(words)
        own = pa.array([None if w is None else f(w) for w in d.dictionary.to_pylist()], kind)
        return own.take(d.indices)

    return run


def stem_column(word: Column) -> Column:
    return F.arrow_udf(_each(stem, pa.string()), "string")(word)


def stems_column(words: Column, empty: str = "") -> Column:
    """An array of words, each as its stem; ``empty`` stands for an empty one. A null array is an empty one."""
    stems = _each(lambda w: stem(w) or empty, pa.string())

    def run(lists: pa.Array) -> pa.Array:
        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0))
        return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())]), stems(lists.flatten()))

    return F.arrow_udf(run, "array<string>")(words)


def measure_column(word: Column) -> Column:
    return F.arrow_udf(_each(measure, pa.int64()), "long")(word)


def kinds_sql(w: str) -> str:
    """DuckDB expression of ``kinds`` for the lower-case letters of ``w``."""
    e = f"translate({w}, 'aeioubcdfghjklmnpqrstvwxz', 'VVVVVCCCCCCCCCCCCCCCCCCCC')"
    for _ in range(6):
        e = f"regexp_replace(regexp_replace({e}, '(^|C)y', '\\1V', 'g'), 'Vy', 'VC', 'g')"
    return e


def _measure_sql(cv: str) -> str:
    return f"len(regexp_extract_all({cv}, 'V+C+'))"


# The rules once more, as the SQL side states them, so that a wrong rule in the table above shows.
SQL_RULES = {
    name: [tuple(rule.split(">")) for rule in rules.split()]
    for name, rules in {
        "plural": "sses>ss ies>i ss>ss s>",
        "eed": "eed>ee",
        "past": "ing> ed>",
        "repair": "at>ate bl>ble iz>ize",
        "y": "y>i",
        "double": "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble",
        "single": "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>",
        "long": "al> ance> ence> er> ic> able> ible> ant> ement> ment> ent> ion> ou> ism> ate> iti> ous> ive> es>",
        "e": "e>",
    }.items()
}


def stem_sql(source: str) -> str:
    """DuckDB common table expressions that end in ``stems(word, stem)`` over the distinct words of ``source(word)``."""

    def chain(rules, condition, otherwise="w"):
        arms = []
        for s, new in rules:
            rest = f"left(w, len(w) - {len(s)})"
            cond = condition(f"left(cv, len(w) - {len(s)})", rest, s)
            arms.append(f"WHEN ends_with(w, '{s}') THEN " + (f"{rest} || '{new}'" if cond is None else f"CASE WHEN {cond} THEN {rest} || '{new}' ELSE w END"))
        return "CASE " + " ".join(arms) + f" ELSE {otherwise} END"

    at_least = lambda n: lambda cv, r, s: f"{_measure_sql(cv)} >= {n}"
    vowel = lambda cv, r, s: f"contains({cv}, 'V')"
    four = lambda cv, r, s: f"{_measure_sql(cv)} >= 2" + (f" AND right({r}, 1) IN ('s', 't')" if s == "ion" else "")
    double = "len(w) > 1 AND right(w, 1) = w[-2] AND right(w, 1) NOT IN ('a', 'e', 'i', 'o', 'u')"
    short = "regexp_matches(w, '[^aeiou][aeiou][^aeiouwxy]$')"
    repair = chain(SQL_RULES["repair"], lambda *_: None, f"CASE WHEN {double} AND right(w, 1) NOT IN ('l', 's', 'z') THEN left(w, len(w) - 1) WHEN {_measure_sql('cv')} = 1 AND {short} THEN w || 'e' ELSE w END")
    ctes = [f"t0 AS (SELECT DISTINCT word, lower(word) AS w, regexp_full_match(word, '[A-Za-z]*') AS plain FROM {source})"]

    def add(expression: str, where: str = "plain", keep: str = "") -> None:
        n = len(ctes)
        cv = f"(SELECT *, {kinds_sql('w')} AS cv FROM t{n - 1})"
        ctes.append(f"t{n} AS MATERIALIZED (SELECT word, CASE WHEN {where} THEN {expression} ELSE w END AS w, plain{keep} FROM {cv})")

    add(chain(SQL_RULES["plural"], lambda *_: None))
    add(chain(SQL_RULES["eed"], at_least(1)), keep=", w AS before")
    add(chain(SQL_RULES["past"], vowel), "plain AND w = before", keep=", w = before AS open, w AS before")
    add(repair, "plain AND open AND w <> before")
    add(chain(SQL_RULES["y"], vowel))
    add(chain(SQL_RULES["double"], at_least(1)))
    add(chain(SQL_RULES["single"], at_least(1)))
    add(chain(SQL_RULES["long"], four))
    add(chain(SQL_RULES["e"], at_least(2)))
    add(f"CASE WHEN {_measure_sql('cv')} >= 1 AND {double} AND right(w, 1) = 'l' THEN left(w, len(w) - 1) ELSE w END")
    ctes.append(f"stems AS (SELECT word, w AS stem FROM t{len(ctes) - 1})")
    return ", ".join(ctes)
