"""The published Porter2 stemmer for English, applied once per distinct term."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_V = "aeiouy"
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_LI = "cdeghkmnrt"
#: Fixed values of the published algorithm: words with stems of their own, and words that stay as they are.
_OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_SAME_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.compile(f"[{_V}][^{_V}]").search(w, start)
        return m.end() if m else len(w)

    head = re.match("gener|commun|arsen", w)
    r1 = head.end() if head else after(0)
    return r1, after(r1)


def _short(w: str, r1: int) -> bool:
    return r1 >= len(w) and bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$|^[{_V}][^{_V}]$", w))


def stem_en(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters and those joined by _ stay as they are."""
    if len(word) < 3 or "_" in word or word in _SAME:
        return word
    if word in _OWN:
        return _OWN[word]
    w = re.sub(f"(?<=[{_V}])y|^y", "Y", word.lstrip("'"))
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    # plural endings
    if w.endswith("sses"):
        w = w[:-2]
    elif re.search("(ied|ies)$", w):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not re.search("(us|ss)$", w) and re.search(f"[{_V}].+s$", w):
        w = w[:-1]
    if w in _SAME_1A:
        return w.lower()
    # past and -ing forms
    if m := re.search("(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search(f"[{_V}]", w[: m.start()]):
        w = w[: m.start()]
        if re.search("(at|bl|iz)$", w):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif _short(w, r1):
            w += "e"
    if len(w) > 2 and re.search(f"[^{_V}][yY]$", w):
        w = w[:-1] + "i"
    for end, new in _STEP2:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ogi" or w[at - 1] == "l") and (end != "li" or w[at - 1] in _LI):
                w = w[:at] + new
            break
    for end, new in _STEP3:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r1 and (end != "ative" or at >= r2):
                w = w[:at] + new
            break
    for end in _STEP4:
        if w.endswith(end):
            at = len(w) - len(end)
            if at >= r2 and (end != "ion" or w[at - 1] in "st"):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1], 0 if r1 < len(w) - 1 else len(w) - 1) and not re.search(f"[^{_V}][{_V}][^{_V}wxY]$|^[{_V}][^{_V}]$", w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stems(terms: DataFrame, term: str = "term") -> DataFrame:
    """term and stem of each distinct term: join it to any number of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["stem"] = b[term].map(stem_en)
            yield b

    return terms.where(f"`{term}` IS NOT NULL").select(term).distinct().mapInPandas(run, f"`{term}` string, stem string")
