"""Colloquial Nepali in one written form: stages that a Folder runs after the orthographic ones.

A stage is a name and a function of a key and of the word as it was written; it leaves alone what holds no
Devanagari. Word tables and patterns are data below; the stages say in which order they apply.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping

DEVANAGARI = re.compile("[ऀ-ॿ]")

# --- fixed values: words and patterns that results depend on -------------------------------------------
#: Whole words, spoken = written, by the rule that they stand under.
WORDS = {
    "contracted-verb": "हैन=होइन भो=भयो भा=भए भको=भएको नभको=नभएको गको=गएको लाको=लगाएको थ्यो=थियो थ्यौँ=थियौँ थेँ=थिएँ थिएन=थिइनँ थेन=थिइनँ हुन्न=हुँदैन खोइ=खै चै=चाहिँ",
    "pronoun": "उल्ले=उसले तेल्लाई=त्यसलाई त्यलाई=त्यसलाई जोले=जसले जल्ले=जसले एले=यसले यल्ले=यसले त्यल्ले=त्यसले अर्ले=अरूले कस्ले=कसले",
    "emphatic": "मात्रै=मात्र एकदमै=एकदम ठ्याक्कै=ठ्याक्क भर्खरै=भर्खर अझै=अझ आजै=आज बाहिरै=बाहिर मेरै=मेरो मै=मा बिस्तारो=बिस्तारै पहिल्यै=पहिले खत्रा=खतरा खत्त्रै=खतरा बब्बाल=बबाल सक्केसम्म=सकेसम्म",
    "loose": "नि=पनि या=यहाँ छुइनँ=छैन अलिकति=अलि अलिकता=अलि अलिक=अलि अलिअलि=अलि अलिकत्ति=अलि",
    "unseen": "जान्न=जान्दिनँ भन्नि=भन्ने हुन्या=हुने",
    "other-words": "पहिला=पहिले पहिलाको=पहिलेको रुपियाँ=रुपैयाँ बुवा=बुबा बिहा=बिहे जवाब=जवाफ गलती=गल्ती हजुरबा=हजुरबुबा",
}
#: A word of the tables keeps its written form before these endings, if two letters or more are left.
ENDINGS = ("देखि", "सम्म", "लाइ", "बाट", "संग", "हरु", "को", "का", "कि", "मा", "ले")
#: Patterns of a key and what takes their place, in order. C stands for any consonant.
PATTERNS = {
    "nasal-cluster": [("[ङञणनम]्(?=[कखगघचछजझटठडढतथदधपफबभ])", "ं")],
    "western-participle": [("(?<=्न)्या$", "े"), ("(?<=.C)्या$", "ेको")],
    "launu": [("^(न?)ला(?=उ|ए)", r"\1लगा"), ("^(न?)लाइ(?=दि|स|हाल|रा|रह)", r"\1लगाइ")],
    "contracted-verb": [
        ("(?<=C)एक(?=[ोा])", "ाक"), ("(?<=[ाआ])एक(?=[ोा])", "क"), ("(?<=C)एछ", "ाछ"), ("(?<=[ाआ])एछ", "छ"), ("(?<=[दल])िए(?=छ|पछि)", "े"), ("(?<=C)िछु$", "ेछु"), ("रैछ", "रहेछ"),
    ],
    "progressive": [("(?<=[िइ])र(?:हे|ाखे)", "रा"), ("(?<=..ि)रा$", "राको"), ("(?<=.इ)रा$", "राको"), ("(?<=[िइ])र(?:हं|ाहुं|ाख्)थ", "राथ"), ("(?<=[िइ])राहुं", "रहं")],
    "benefactive": [
        ("(?<=C)िदि(?!न$)", "्दि"), ("(?<=C)िदे", "्दे"), ("दिइ(?=र|ह)", "दि"), ("(?<=्द)िया$", "िए"), ("्दिए(?=र$|ं$|$)", "्दे"), ("दिए(?=क[ोा]|ला)", "दे"), ("्देउ$", "्दे"),
    ],
    "first-plural": [("(?<=.C)ुं$", "ौं"), ("(?<=[ािीेो])(?:उं|औं)$", "ौं"), ("(?<=C)ियौं$", "्यौं")],
    "emphatic": [("(?<=..)मै$", "मा"), ("एरै$", "एर"), ("^(क|त्य|य|उ|ज)त्ति", r"\1ति"), ("^मज्जा", "मजा"), ("^आफैं", "आफै"), ("^भेट्टा", "भेटा"), ("^(फुल|बिल|पेल)्ल", r"\1"), ("^सब(?=भंदा|ले$)", "सबै")],
    "loose": [
        ("(?<=[्ािुउ])(?<!दि)नु(?=$|लाइ$|मा$)", "न"), ("नु(?=प[रऱ]|को$)", "न"), ("नुहोस$", "नुस"), ("दाखेरि?$", "दा"), ("(?<=ा)इयो$", "यो"), ("(?<!^हर)(?<!^बल)(?<!^रेड)(?<=C)ियो$", "्यो"),
    ],
    "unseen": [("(?<=्)च(?=ु$|ौं$)", "छ")],
    "joined": [("ाको(?=छ)", "ा"), ("कोथिएं$", "कोथें"), ("कोथिए$", "कोथे"), ("को(?=थ्यो$|थें$|थे$)", "")],
}
#: Patterns for words written with a short i at the end.
SHORT_I = {"unseen": [("(?<=े)सि$", "पछि")], "joined": [("(?<=[ेए])नि$", "पनि")]}
#: Patterns for words written with a final virama on m; the first that changes the key is the only one.
FINAL_M = [("ेम$", "्यौं"), ("एम$", "यौं"), ("^थिम$", "थ्यौं"), ("(?<=[दल]ि)म$", "ौं"), ("(?<=C)िम$", "्यौं"), ("(?<=[ा])म$", "ौं"), ("(?<=C)ु?म$", "ौं")]
#: Nouns, which no participle pattern touches.
NOUNS = ("संख्या", "समस्या", "तपस्या", "व्याख्या", "हत्या", "विद्या", "कन्या", "संध्या", "चर्या", "वैश्या")
#: The order of the stages.
ORDER = "table final-m nasal-cluster western-participle launu contracted-verb progressive benefactive first-plural emphatic loose unseen joined nasal-cluster table".split()
# --------------------------------------------------------------------------------------------------------

TABLE = "colloquial-table"
Stage = tuple[str, Callable[[str, str], str]]


def _rewrites(pairs: list[tuple[str, str]]) -> list[tuple[re.Pattern, str]]:
    return [(re.compile(p.replace("C", "[क-ह]")), by) for p, by in pairs]


class Table:
    """Words by their orthographic keys: what is written for a spoken one, and under which rule."""

    def __init__(self, words: Mapping[str, str], spelled: Callable[[str], str]) -> None:
        self.of: dict[str, tuple[str, str]] = {}
        for rule, pairs in words.items():
            for spoken, written in (p.split("=") for p in pairs.split()):
                self.of[spelled(spoken)] = (spelled(written), rule)

    def find(self, key: str) -> tuple[str, str] | None:
        """The written form of a key, with a case ending as it was, and the rule."""
        stems = [("", key), *((e, key.removesuffix(e)) for e in ENDINGS)]
        for ending, stem in stems:
            if stem in self.of and (not ending or (stem != key and len(stem) > 2)):
                return self.of[stem][0] + ending, self.of[stem][1]
        return None


def stages(spelled: Callable[[str], str]) -> tuple[tuple[Stage, ...], Table]:
    """The stages in order, and the table that two of them look words up in; spelled is the orthographic
    key of a word."""
    table = Table(WORDS, spelled)

    def by_table(key: str, _: str) -> str:
        found = table.find(key)
        return found[0] if found else key

    final_m = _rewrites(FINAL_M)

    def by_final_m(key: str, word: str) -> str:
        if not word.endswith("म्") or len(key) < 2:
            return key
        changed = (p.sub(by, key) for p, by in final_m)
        return next((k for k in changed if k != key), key)

    def by_patterns(name: str) -> Callable[[str, str], str]:
        usual, short = _rewrites(PATTERNS[name]), _rewrites(SHORT_I.get(name, []))

        def apply(key: str, word: str) -> str:
            if name == "western-participle" and key.endswith(NOUNS):
                return key
            for p, by in usual:
                key = p.sub(by, key)
            for p, by in short if unicodedata.normalize("NFC", word).endswith("ि") else ():
                key = p.sub(by, key)
            return key

        return apply

    def in_devanagari(f: Callable[[str, str], str]) -> Callable[[str, str], str]:
        return lambda key, word: f(key, word) if DEVANAGARI.search(key) else key

    made = {"table": (TABLE, by_table), "final-m": ("first-plural", by_final_m)} | {n: (n, by_patterns(n)) for n in PATTERNS}
    return tuple((made[n][0], in_devanagari(made[n][1])) for n in ORDER), table
