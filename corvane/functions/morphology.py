"""Stemmers, a rule lemmatizer and sentence splitting, as pure functions.

They are applied to the distinct vocabulary and joined back, so the cost follows the vocabulary and
not the corpus.
"""

from __future__ import annotations

import re

_VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")


def _shape(word: str) -> str:
    """Consonants c and vowels v; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _ends_cvc(stem: str) -> bool:
    return len(stem) > 2 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


#: Suffix tables of the published algorithm (Porter, 1980), longest first where it matters.
_STEP2 = [(a, b) for a, b in (p.split(">") for p in (
    "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate "
    "alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble").split())]  # fmt: skip
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """Porter's algorithm of 1980."""
    w = word.lower()
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: -len(end)] + to
            break
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and "v" in _shape(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and "v" in _shape(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _ends_cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, to in sorted(table, key=lambda p: -len(p[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + to
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _ends_cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


_VOWELS = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Words and suffixes of the published second algorithm (Porter2, English Snowball).
_P2_WORDS = dict(p.split(">") for p in (
    "skis>ski skies>sky dying>die lying>lie tying>tie idly>idl gently>gentl ugly>ugli early>earli only>onli singly>singl sky>sky news>news howe>howe "
    "atlas>atlas cosmos>cosmos bias>bias andes>andes").split())  # fmt: skip
_P2_KEPT = "inning outing canning herring earring proceed exceed succeed".split()
_P2_STEP2 = [tuple(p.split(">")) for p in (
    "ization>ize ational>ate fulness>ful ousness>ous iveness>ive tional>tion biliti>ble lessli>less entli>ent ation>ate alism>al aliti>al ousli>ous iviti>ive "
    "fulli>ful enci>ence anci>ance abli>able izer>ize ator>ate alli>al bli>ble ogi>og li>").split()]  # fmt: skip
_P2_STEP3 = [tuple(p.split(">")) for p in "ational>ate tional>tion alize>al icate>ic iciti>ic ative> ical>ic ness> ful>".split()]
_P2_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()


def _regions(w: str) -> tuple[int, int]:
    """Starts of the regions after the first and the second vowel that a consonant follows."""

    def after(at: int) -> int:
        for i in range(at + 1, len(w)):
            if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_syllable(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-1] not in _VOWELS + "wxY" and w[-2] in _VOWELS and w[-3] not in _VOWELS


def snowball(word: str) -> str:
    """The English Snowball stemmer (Porter2)."""
    w = word.lower().replace("’", "'")
    if len(w) < 3 or not w.isascii():
        return w
    if w in _P2_WORDS:
        return _P2_WORDS[w]
    w = w.removeprefix("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWELS) else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith(("us", "ss")):
        pass
    elif w.endswith("s") and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w.lower() in _P2_KEPT:
        return w.lower()
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            if end.startswith("eed"):
                if len(w) - len(end) >= r1:
                    w = w[: -len(end)] + "ee"
            elif any(c in _VOWELS for c in w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLE):
                    w = w[:-1]
                elif r1 >= len(w) and _short_syllable(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for end, to in _P2_STEP2:
        if w.endswith(end):
            stem = w[: -len(end)]
            if len(stem) >= r1 and (end != "ogi" or stem.endswith("l")) and (end != "li" or stem[-1:] in "cdeghkmnrt"):
                w = stem + to
            break
    for end, to in _P2_STEP3:
        if w.endswith(end):
            stem = w[: -len(end)]
            if len(stem) >= r1 and (end != "ative" or len(stem) >= r2):
                w = stem + to
            break
    for end in _P2_STEP4:
        if w.endswith(end):
            stem = w[: -len(end)]
            if len(stem) >= r2 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


#: Rules of the published Paice/Husk algorithm: ending backwards, * if the word is intact, letters to drop, letters to add, > to go on or . to stop.
_HUSK = (
    "ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2. hsiug5ct. hsi3> i*1. i1y> ji1d. juf1s. ju1d. jo1d. "
    "jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. lufi4y. luf3> lu2. lai3> lau3> la2> ll1. mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. "
    "ne2> nn1. pihs4> pp1. re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3> tna3> tpir2b. tpro2b. tcud1. "
    "tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1. yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s."
).split()
_HUSK_RULE = re.compile(r"([a-z]+)(\*?)(\d)([a-z]*)([>.])")
_HUSK_BY: dict[str, list[tuple[str, bool, int, str, bool]]] = {}
for _m in map(_HUSK_RULE.fullmatch, _HUSK):
    _HUSK_BY.setdefault(_m[1][0], []).append((_m[1][::-1], _m[2] == "*", int(_m[3]), _m[4], _m[5] == ">"))


def lancaster(word: str) -> str:
    """The Paice/Husk stemmer."""
    first = w = word.lower()
    while w and w.isalpha():
        for end, intact, drop, add, again in _HUSK_BY.get(w[-1], ()):
            if not w.endswith(end) or (intact and w != first):
                continue
            stem = w[: len(w) - drop]
            ok = len(stem) >= 2 if w[0] in "aeiouy" else len(stem) >= 3 and any(c in _VOWELS for c in stem)
            if not ok:
                continue
            w = stem + add
            break
        else:
            return w
        if not again:
            return w
    return w


def light(word: str) -> str:
    """A light stemmer: plural and participle endings only, at least three letters left."""
    w = word.lower()
    for end, to in (("ies", "y"), ("sses", "ss"), ("ing", ""), ("ed", ""), ("es", "e"), ("s", "")):
        if w.endswith(end) and len(w) - len(end) >= 3 and not w.endswith("ss"):
            return w[: -len(end)] + to
    return w


#: Irregular forms.
EXCEPTIONS = dict(
    p.split(">") for p in
    "was>be were>be is>be are>be been>be has>have had>have did>do done>do went>go gone>go made>make grew>grow grown>grow rose>rise "
    "fell>fall held>hold led>lead paid>pay said>say saw>see seen>see took>take taken>take children>child men>man women>woman "
    "people>person feet>foot indices>index analyses>analysis crises>crisis data>datum better>good best>good worse>bad worst>bad "
    "gases>gas buses>bus biases>bias viruses>virus bonuses>bonus statuses>status censuses>census lenses>lens gas>gas bus>bus lens>lens "
    "series>series species>species news>news means>means economics>economics statistics>statistics physics>physics politics>politics".split()
)


def lemma(word: str) -> str:
    """Exceptions, then plural rules, then verb rules; short all-capital words stay, in lower case."""
    w = word.lower()
    if word.isupper() and len(word) <= 6:
        return w
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    if w.endswith("ies") and len(w) > 4:
        return w[:-3] + "y"
    if w.endswith(("sses", "shes", "ches", "xes", "zes")):
        return w[:-2]
    if w.endswith("s") and not w.endswith(("ss", "us", "is")) and len(w) > 3:
        return w[:-1]
    for end in ("ing", "ed"):
        stem = w[: -len(end)]
        if w.endswith(end) and len(stem) >= 3 and _VOWEL.search(stem):
            if len(stem) > 3 and stem[-1] == stem[-2] and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _ends_cvc(stem) else stem
    return w


#: Abbreviations that end no sentence.
ABBREVIATIONS = "mr mrs ms dr prof sr jr st no vs etc e.g i.e fig eq cf al inc ltd co dept approx".split()
_BREAK = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(\[]?[A-Z0-9ÄÖÜÀ-Þ])")


def sentences(text: str) -> list[str]:
    """Breaks after sentence marks before a capital or digit, but not after an abbreviation or initial."""
    out, start = [], 0
    for m in _BREAK.finditer(text):
        last = text[start : m.start()].rstrip(".!?\"')]").rsplit(None, 1)[-1:] or [""]
        if text[m.start() - 1 : m.start()] == "." and (last[0].lower() in ABBREVIATIONS or re.fullmatch(r"[A-Za-z]", last[0])):
            continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    if text[start:].strip():
        out.append(text[start:].strip())
    return out


STEMMERS = {"porter": porter, "snowball": snowball, "lancaster": lancaster, "light": light, "lemma": lemma}
