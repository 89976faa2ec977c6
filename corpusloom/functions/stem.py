"""The English (Porter2) stemming algorithm, as published, applied to the distinct tokens of each Arrow batch."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from ..checkpoints import ship

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_FIXED = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_STAY = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"),
    ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]


def _region(w: str, start: int) -> int:
    for i in range(start + 1, len(w)):
        if w[i] not in _V and w[i - 1] in _V:
            return i + 1
    return len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word.lower().replace("’", "'").replace("‘", "'")
    if len(w) <= 2:
        return w
    w = w.removeprefix("'")
    if w in _FIXED:
        return _FIXED[w]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    head = re.match(r"gener|commun|arsen", w)
    r1 = head.end() if head else _region(w, 0)
    r2 = _region(w, r1)
    # plurals and possessives
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _STAY:
        return w
    # -ed, -ing
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not w.endswith(s):
            continue
        base = w[: -len(s)]
        if s.startswith("eed"):
            if len(base) >= r1:
                w = base + "ee"
        elif any(c in _V for c in base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLE):
                w = w[:-1]
            elif _short_end(w) and r1 >= len(w):
                w += "e"
        break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for s, r in _STEP2 + [("ogi", "og"), ("li", "")]:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and not (s == "ogi" and w[at - 1 : at] != "l") and not (s == "li" and w[at - 1 : at] not in tuple("cdeghkmnrt")):
                w = w[:at] + r
            break
    for s, r in sorted([*_STEP3, ("ative", "")], key=lambda x: -len(x[0])):
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ative" or at >= r2):
                w = w[:at] + r
            break
    for s in sorted([*_STEP4, "ion"], key=lambda x: -len(x)):
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and (s != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w.endswith("ll"):
        w = w[:-1]
    return w.replace("Y", "y")


def stemmed(tokens: Column, keep: tuple[str, ...] = ()) -> Column:
    """Stems of an array of tokens; those in ``keep`` stay as they are. Each distinct token of a batch is stemmed once."""
    ship()
    kept = frozenset(keep)

    def run(arrays: pa.Array) -> pa.Array:
        flat = arrays.flatten()
        coded = flat.dictionary_encode()
        stems = pa.array([w if w is None or w in kept else stem(w) for w in coded.dictionary.to_pylist()], pa.string())
        out = stems.take(coded.indices)
        offsets = arrays.offsets if arrays.offset == 0 else pc.subtract(arrays.offsets, arrays.offsets[0])
        return pa.ListArray.from_arrays(offsets, out, mask=arrays.is_null() if arrays.null_count else None)

    return arrow_udf(run, "array<string>")(tokens)
