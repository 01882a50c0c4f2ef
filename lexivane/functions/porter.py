"""Suffix stripping after M. F. Porter, "An algorithm for suffix stripping",
Program 14(3), 1980, with the author's two later step-2 rules (bli, logi)."""

from __future__ import annotations

import re

_VOWEL_RUN = re.compile("v+c+")

# suffix -> replacement, tried longest first
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "logi": "log",
}
_STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "",
    "ness": "",
}
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _shape(word: str) -> str:
    """The word as vowels and consonants; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(_VOWEL_RUN.findall(_shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double_end(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    fits = [s for s in suffixes if word.endswith(s) and len(word) > len(s)]
    return max(fits, key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    end = _longest(w, ("ed", "ing"))
    if end is None or not _has_vowel(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if _double_end(w) and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if _measure(w) == 1 and _cvc_end(w) else w


def _mapped(w: str, rules: dict[str, str]) -> str:
    end = _longest(w, rules)
    if end is None or _measure(w[: -len(end)]) == 0:
        return w
    return w[: -len(end)] + rules[end]


def _residue(w: str) -> str:
    end = _longest(w, _STEP4)
    if end is None:
        return w
    stem = w[: -len(end)]
    if _measure(stem) > 1 and (end != "ion" or stem[-1] in "st"):
        return stem
    return w


def porter_stem(word: str) -> str:
    if len(word) < 3 or len(word.encode()) > 64:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _residue(_mapped(_mapped(w, _STEP2), _STEP3))
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
