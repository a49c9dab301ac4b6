"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980, with the later -logi and -bli) as column expressions, for the distinct terms of an index.

A stem's measure is the number of its runs of vowels that a run of consonants follows; y is a vowel after a consonant.  So that patterns can tell, a term's
consonant y is written as Y while it is worked on."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let

SHORTEST, LONGEST = 3, 64
# Suffixes of the steps and what they become.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_V, _C = "[aeiouy]", "[^aeiouy]"
_OVER_0, _IS_1, _OVER_1 = f"^{_C}*{_V}+{_C}", f"^{_C}*{_V}+{_C}+{_V}*$", f"^{_C}*{_V}+{_C}+{_V}+{_C}"
_SHORT_END = "[^aeiouy][aeiouy][^aeiouywxY]$"  # consonant, vowel, consonant other than w, x and y


def _less(t: Column, n: int) -> Column:
    return F.left(t, F.length(t) - n)


def _swapped(t: Column, endings: dict[str, str], measure: str) -> Column:
    """The longest of some endings replaced, where what is before it has the measure."""
    suffix = F.regexp_extract(t, "(" + "|".join(sorted(endings, key=len, reverse=True)) + ")$", 1)

    def done(s: Column) -> Column:
        new = F.lit("")
        for old, value in endings.items():
            new = F.when(s == old, F.lit(value)).otherwise(new)
        stem = F.left(t, F.length(t) - F.length(s))
        return F.when((s != "") & stem.rlike(measure), F.concat(stem, new)).otherwise(t)

    return let(suffix, done)


def _plurals(t: Column) -> Column:
    return F.when(t.endswith("sses") | t.endswith("ies"), _less(t, 2)).when(t.endswith("s") & ~t.endswith("ss"), _less(t, 1)).otherwise(t)


def _past(t: Column) -> Column:
    def mended(s: Column) -> Column:
        double = s.rlike(r"([^aeiouylsz])\1$") | s.endswith("YY")
        return F.when(s.rlike("(at|bl|iz)$"), F.concat(s, F.lit("e"))).when(double, _less(s, 1)).when(s.rlike(_IS_1) & s.rlike(_SHORT_END), F.concat(s, F.lit("e"))).otherwise(s)

    holds = lambda n: _less(t, n).rlike(_V)
    eed = F.when(_less(t, 3).rlike(_OVER_0), _less(t, 1)).otherwise(t)
    return F.when(t.endswith("eed"), eed).when(t.endswith("ed") & holds(2), let(_less(t, 2), mended)).when(t.endswith("ing") & holds(3), let(_less(t, 3), mended)).otherwise(t)


def _y(t: Column) -> Column:
    return F.when(t.rlike("[yY]$") & _less(t, 1).rlike(_V), F.concat(_less(t, 1), F.lit("i"))).otherwise(t)


def _bare(t: Column) -> Column:
    """Step 4: the longest ending goes where the measure before it is over one; -ion only after s or t."""
    suffix = F.regexp_extract(t, "(" + "|".join(sorted((*STEP_4, "(?<=[st])ion"), key=len, reverse=True)) + ")$", 1)
    return let(suffix, lambda s: let(F.left(t, F.length(t) - F.length(s)), lambda stem: F.when((s != "") & stem.rlike(_OVER_1), stem).otherwise(t)))


def _final(t: Column) -> Column:
    stem = _less(t, 1)
    without_e = F.when(t.endswith("e") & (stem.rlike(_OVER_1) | (stem.rlike(_IS_1) & ~stem.rlike(_SHORT_END))), stem).otherwise(t)
    return let(without_e, lambda x: F.when(x.endswith("ll") & _less(x, 1).rlike(_OVER_1), _less(x, 1)).otherwise(x))


def stem(term: Column) -> Column:
    """The stem of a lower-cased term of ASCII letters; other terms, and those of under 3 or over 64 characters, are their own."""
    marked = F.regexp_replace(F.regexp_replace(term, "^y", "Y"), "([aeiou])y", "$1Y")
    steps = (_plurals, _past, _y, lambda t: _swapped(t, STEP_2, _OVER_0), lambda t: _swapped(t, STEP_3, _OVER_0), _bare, _final)
    out = marked
    for step in steps:
        out = let(out, step)
    return F.when(term.rlike(f"^[a-z]{{{SHORTEST},{LONGEST}}}$"), F.lower(out)).otherwise(term)
