"""Stems, transliteration and spelling neighbourhoods."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latin spellings of Cyrillic letters. One letter each, then those with several or none.
CYRILLIC = "абвгдеёзийклмнопрстуфыэ"
LATIN = "abvgdeeziyklmnoprstufye"
SEVERAL = {"ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "yu", "я": "ya", "ъ": "", "ь": ""}


def transliterate(text: Column) -> Column:
    """Lower-case text with Cyrillic letters written in Latin ones."""
    out = F.translate(F.lower(text), CYRILLIC, LATIN)
    for letter, latin in SEVERAL.items():
        out = F.replace(out, F.lit(letter), F.lit(latin))
    return out


def deletions(word: Column) -> Column:
    """The word and all forms with one or two letters left out: words within edit distance 2 share one."""

    def without(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1)))
        return F.transform(places, lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w))))

    one = without(word)
    return F.array_distinct(F.concat(F.array(word), one, F.flatten(F.transform(one, without))))


_VOWELS = "aeiouy"


def _regions(word: str) -> tuple[int, int]:
    """Starts of R1 and R2: what follows the first consonant after a vowel, and the same within R1."""
    for prefix in ("gener", "commun", "arsen"):
        if word.startswith(prefix):
            r1 = len(prefix)
            break
    else:
        found = re.search(f"[{_VOWELS}][^{_VOWELS}]", word)
        r1 = found.end() if found else len(word)
    found = re.search(f"[{_VOWELS}][^{_VOWELS}]", word[r1:])
    return r1, r1 + found.end() if found else len(word)


def _short(word: str, r1: int) -> bool:
    return r1 >= len(word) and bool(re.search(f"(^[{_VOWELS}][^{_VOWELS}]|[^{_VOWELS}][{_VOWELS}][^{_VOWELS}wxY])$", word))


# Endings of the published English stemmer, by step.
_STEP2 = [("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"),
          ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"),
          ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ["ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic"]
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
               "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}


def stem_english(word: str) -> str:
    """The published English (Porter2) algorithm, for lower-case words of Latin letters."""
    if len(word) <= 2 or word in _EXCEPTIONS:
        return _EXCEPTIONS.get(word, word)
    word = re.sub(rf"(^y|(?<=[{_VOWELS}])y)", "Y", word.lstrip("'"))
    r1, r2 = _regions(word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(f"[{_VOWELS}].*.s$", word):
        word = word[:-1]
    if word in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return word
    if word.endswith(("eedly", "eed")):
        end = "eedly" if word.endswith("eedly") else "eed"
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if word.endswith(end):
                if re.search(f"[{_VOWELS}]", word[: -len(end)]):
                    word = word[: -len(end)]
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
                        word = word[:-1]
                    elif _short(word, r1):
                        word += "e"
                break
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    for end, new in _STEP2:
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                word = word[: -len(end)] + new
            break
    else:
        if word.endswith("ogi") and len(word) - 3 >= r1 and word[-4:-3] == "l":
            word = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] in "cdeghkmnrt":
            word = word[:-2]
    for end, new in _STEP3:
        if word.endswith(end):
            if len(word) - len(end) >= r1:
                word = word[: -len(end)] + new
            break
    else:
        if word.endswith("ative") and len(word) - 5 >= r2:
            word = word[:-5]
    for end in _STEP4:
        if word.endswith(end):
            if len(word) - len(end) >= r2:
                word = word[: -len(end)]
            break
    else:
        if word.endswith("ion") and len(word) - 3 >= r2 and word[-4:-3] in "st":
            word = word[:-3]
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or at >= r1 and not re.search(f"([^{_VOWELS}][{_VOWELS}][^{_VOWELS}wxY]|^[{_VOWELS}][^{_VOWELS}])$", word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


# Endings of the published Russian stemmer. Those marked 1 follow а or я.
_RU_VOWELS = "аеиоуыэюя"
_GERUND1, _GERUND2 = ("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись")
_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_PARTICIPLE1, _PARTICIPLE2 = ("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ")
_VERB1 = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()
_VERB2 = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def _cut(word: str, rv: int, plain, after_a=()) -> str | None:
    """The word without the longest ending in its region; ``after_a`` endings need а or я before them."""
    for end in sorted([*plain, *after_a], key=len, reverse=True):
        if word.endswith(end) and len(word) - len(end) >= rv:
            if end in plain or (len(word) - len(end) - 1 >= rv and word[-len(end) - 1] in "ая"):
                return word[: -len(end)]
    return None


def stem_russian(word: str) -> str:
    """The published Russian algorithm, for lower-case words of Cyrillic letters; a stem of under three letters is refused."""
    whole = word = word.replace("ё", "е")
    found = re.search(f"[{_RU_VOWELS}]", word)
    rv = found.end() if found else len(word)
    pairs = [m.end() for m in re.finditer(f"(?<=[{_RU_VOWELS}])[^{_RU_VOWELS}]", word)]
    r1 = pairs[0] if pairs else len(word)
    later = [p for p in (m.end() + r1 for m in re.finditer(f"(?<=[{_RU_VOWELS}])[^{_RU_VOWELS}]", word[r1:]))]
    r2 = later[0] if later else len(word)
    cut = _cut(word, rv, _GERUND2, _GERUND1)
    if cut is not None:
        word = cut
    else:
        cut = _cut(word, rv, ("ся", "сь"))
        word = cut if cut is not None else word
        adjective = _cut(word, rv, _ADJECTIVE)
        if adjective is not None:
            participle = _cut(adjective, rv, _PARTICIPLE2, _PARTICIPLE1)
            word = participle if participle is not None else adjective
        else:
            verb = _cut(word, rv, _VERB2, _VERB1)
            noun = _cut(word, rv, _NOUN) if verb is None else None
            word = verb if verb is not None else noun if noun is not None else word
    if word.endswith("и") and len(word) - 1 >= rv:
        word = word[:-1]
    for end in ("ость", "ост"):
        if word.endswith(end) and len(word) - len(end) >= r2:
            word = word[: -len(end)]
            break
    for end in ("ейше", "ейш"):
        if word.endswith(end) and len(word) - len(end) >= rv:
            word = word[: -len(end)]
    if word.endswith("нн") and len(word) - 1 >= rv:
        word = word[:-1]
    elif word.endswith("ь") and len(word) - 1 >= rv:
        word = word[:-1]
    if len(word) < 3 < len(whole):  # the stem lost its meaning: take a case ending off only
        noun = _cut(whole, rv, _NOUN)
        word = noun if noun is not None and len(noun) > 2 else whole
    return word


def stem_word(word: str) -> str:
    """Cyrillic words by the Russian, Latin ones by the English algorithm, others unchanged."""
    if re.search("[а-яё]", word):
        return stem_russian(word)
    return stem_english(word) if re.fullmatch("[a-z']+", word) else word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Stems of arrays of lower-case words; each distinct word of a batch is stemmed once."""
    known: dict[str, str] = {}
    return words.map(lambda ws: None if ws is None else [known.get(w) or known.setdefault(w, stem_word(w)) for w in ws])
