"""The English (Porter2) stemmer after its published description."""

from __future__ import annotations

import re

V = "aeiouy"
# Exceptional forms and suffix tables of the published algorithm.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAY = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
AFTER_VOWEL = re.compile(f"[{V}][^{V}]")
SHORT_END = re.compile(f"(^[{V}][^{V}]$)|([^{V}][{V}][^{V}wxY]$)")


def _regions(word: str) -> tuple[int, int]:
    first = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if first is None:
        found = AFTER_VOWEL.search(word)
        first = found.end() if found else len(word)
    found = AFTER_VOWEL.search(word, first)
    return first, found.end() if found else len(word)


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _has_vowel(part: str) -> bool:
    return any(c in V for c in part)


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = word.removeprefix("'")
    word = re.sub(f"(?<=[{V}])y|^y", "Y", word)
    r1, r2 = _regions(word)
    word = word[: len(word) - len(_longest(word, ("'", "'s", "'s'")))]
    # plural forms
    end = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in STAY:
        return word
    # past and progressive forms
    end = _longest(word, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and _has_vowel(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and SHORT_END.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in V:
        word = word[:-1] + "i"
    end = _longest(word, STEP2)
    if end and len(word) - len(end) >= r1:
        before = word[: -len(end)]
        if end == "ogi":
            word = word[:-1] if before.endswith("l") else word
        elif end == "li":
            word = before if before and before[-1] in "cdeghkmnrt" else word
        else:
            word = before + STEP2[end]
    end = _longest(word, STEP3)
    if end and len(word) - len(end) >= r1 and (end != "ative" or len(word) - len(end) >= r2):
        word = word[: -len(end)] + STEP3[end]
    end = _longest(word, STEP4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[: -len(end)].endswith(("s", "t"))):
        word = word[: -len(end)]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
