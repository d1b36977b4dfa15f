"""Porter's English and the Snowball Russian stemmer, after their published descriptions."""

from __future__ import annotations

import re
from functools import lru_cache

# --- English ---------------------------------------------------------------------------------------------------------


def _shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _short(stem: str) -> bool:
    return len(stem) > 2 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c"


# Suffixes of the steps of Porter's algorithm and what replaces them.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
          ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
          ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# Stop words of the English analyser.
ENGLISH_STOP = frozenset(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)


def _longest(word: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for end, new in sorted(pairs, key=lambda p: -len(p[0])):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + new if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=100_000)
def english(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and _has_vowel(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _longest(_longest(word, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


# --- Russian ---------------------------------------------------------------------------------------------------------

_VOWELS = "аеиоуыэюя"
# Endings of the Snowball description. Group 1 endings follow а or я.
_GERUND1, _GERUND2 = ("вшись", "вши", "в"), ("ившись", "ывшись", "ивши", "ывши", "ив", "ыв")
_ADJECTIVE = ("ими", "ыми", "его", "ого", "ему", "ому", "ее", "ие", "ые", "ое", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
_PARTICIPLE1, _PARTICIPLE2 = ("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ")
_REFLEXIVE = ("ся", "сь")
_VERB1 = ("ете", "йте", "ешь", "нно", "ла", "на", "ли", "ем", "ло", "но", "ет", "ют", "ны", "ть", "й", "л", "н")
_VERB2 = ("ейте", "уйте", "ила", "ыла", "ена", "ите", "или", "ыли", "ило", "ыло", "ено", "ует", "уют", "ены", "ить", "ыть", "ишь", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ят", "ит", "ыт", "ую", "ю")
_NOUN = ("иями", "ями", "ами", "ией", "иям", "ием", "иях", "ев", "ов", "ие", "ье", "еи", "ии", "ей", "ой", "ий", "ям", "ем", "ам", "ом", "ях", "ах", "ию", "ью", "ия", "ья", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я")
_DERIVATIONAL = ("ость", "ост")
_SUPERLATIVE = ("ейше", "ейш")
# End of the fixed values.


def _cut(word: str, start: int, endings: tuple[str, ...], after: str = "") -> str | None:
    """word without the longest of the endings that lies behind start, or None."""
    for end in sorted(endings, key=len, reverse=True):
        at = len(word) - len(end)
        if at >= start and word.endswith(end) and (not after or (at > start and word[at - 1] in after)):
            return word[:at]
    return None


def _either(word: str, start: int, first: tuple[str, ...], second: tuple[str, ...]) -> str | None:
    found = [x for x in (_cut(word, start, first, "ая"), _cut(word, start, second)) if x is not None]
    return min(found, key=len) if found else None


@lru_cache(maxsize=100_000)
def russian(word: str) -> str:
    word = word.replace("ё", "е")
    vowel = re.search(f"[{_VOWELS}]", word)
    if not vowel:
        return word
    rv = vowel.end()
    region = re.compile(f"[{_VOWELS}][^{_VOWELS}]")
    first = region.search(word)
    second = region.search(word, first.end()) if first else None
    r2 = second.end() if second else len(word)
    done = _either(word, rv, _GERUND1, _GERUND2)
    if done is None:
        word = _cut(word, rv, _REFLEXIVE) or word
        done = _cut(word, rv, _ADJECTIVE)
        if done is not None:
            done = _either(done, rv, _PARTICIPLE1, _PARTICIPLE2) or done
        else:
            done = _either(word, rv, _VERB1, _VERB2)
        if done is None:
            done = _cut(word, rv, _NOUN)
    word = word if done is None else done
    if len(word) > rv and word.endswith("и"):
        word = word[:-1]
    cut = _cut(word, r2, _DERIVATIONAL)
    word = word if cut is None else cut
    if len(word) > rv and word.endswith("нн"):
        return word[:-1]
    cut = _cut(word, rv, _SUPERLATIVE)
    if cut is not None:
        return cut[:-1] if cut.endswith("нн") else cut
    if len(word) > rv and word.endswith("ь"):
        return word[:-1]
    return word
