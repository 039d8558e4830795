"""Porter (1980), Paice/Husk (Lancaster, 1990) and Snowball Spanish stemmers, after their published descriptions.

They are applied to distinct terms only; the result is joined back where tokens are needed.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Porter ---------------------------------------------------------------------------------
# fixed values: the suffix tables of steps 2 to 4
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(w: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _short(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _longest(w: str, table) -> str | None:
    return max((s for s in table if w.endswith(s)), key=len, default=None)


@lru_cache(maxsize=200_000)
def porter(w: str) -> str:
    w = w.lower()
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            stem = w[: -len(end)]
            if w.endswith(end) and "v" in _shape(stem):
                w = stem
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (s := _longest(w, table)) and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    if s := _longest(w, _STEP4):
        stem = w[: -len(s)]
        if _measure(stem) > 1 and (s != "ion" or stem[-1:] in ("s", "t")):
            w = stem
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


# --- Lancaster ------------------------------------------------------------------------------
# fixed values: the published rules; reversed ending, * for words still whole, letters to remove, letters to add, > to go on or . to stop
_RULES = """ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2. hsiug5ct. hsi3> i*1. i1y>
ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. lufi4y. luf3> lu2. lai3> lau3> la2> ll1. mui3. mu*2. msi3> mm1.
nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1. re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0.
tacilp4y. ta2> tnem4> tne3> tna3> tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1.
yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s."""


@lru_cache(maxsize=1)
def _lancaster_rules() -> dict[str, list[tuple[str, bool, int, str, bool]]]:
    out: dict[str, list] = {}
    for r in _RULES.split():
        end, whole, cut, add, more = re.fullmatch(r"([a-z]+)(\*?)(\d)([a-z]*)([.>])", r).groups()
        out.setdefault(end[0], []).append((end[::-1], bool(whole), int(cut), add, more == ">"))
    return out


@lru_cache(maxsize=200_000)
def lancaster(w: str) -> str:
    w = w.lower()
    whole = True
    while w:
        for end, only_whole, cut, add, more in _lancaster_rules().get(w[-1], ()):
            if not w.endswith(end) or only_whole and not whole:
                continue
            left = w[: len(w) - cut]
            enough = len(left) >= 2 if w[0] in "aeiouy" else len(left) >= 3 and any(c in "aeiouy" for c in left)
            if not enough and cut:
                continue
            w, whole = left + add, False
            if not more:
                return w
            break
        else:
            return w
    return w


# --- Snowball Spanish -----------------------------------------------------------------------
# fixed values: the suffix lists of the Spanish stemmer
_ES_VOWELS = "aeiouáéíóúü"
_PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
_STD_1 = ("anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos")
_STD_2 = ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias")
_STD_LOG, _STD_UC, _STD_ENC, _STD_IDAD, _STD_IVO = ("logía", "logías"), ("ución", "uciones"), ("encia", "encias"), ("idad", "idades"), ("iva", "ivo", "ivas", "ivos")
_Y_VERBS = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos")
_VERBS_E = ("en", "es", "éis", "emos")
_VERBS = tuple(
    """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré
    aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais
    arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos""".split()
)
_PLAIN = str.maketrans("áéíóú", "aeiou")


def _regions(w: str) -> tuple[int, int, int]:
    """Starts of RV, R1 and R2."""
    v = [c in _ES_VOWELS for c in w]
    n = len(w)

    def after(i: int) -> int:
        while i < n and not v[i]:
            i += 1
        while i < n and v[i]:
            i += 1
        return min(i + 1, n)

    r1 = after(0)
    r2 = after(r1)
    rv = n
    if n > 2:
        if not v[1]:
            rv = next((i + 1 for i in range(2, n) if v[i]), n)
        elif v[0] and v[1]:
            rv = next((i + 1 for i in range(2, n) if not v[i]), n)
        else:
            rv = 3
    return rv, r1, r2


@lru_cache(maxsize=200_000)
def spanish(w: str) -> str:
    w = w.lower()
    rv, r1, r2 = _regions(w)

    def ends(suffixes, at: int) -> str | None:
        """The longest suffix of the word, if it lies in the region."""
        s = max((x for x in suffixes if w.endswith(x)), key=len, default=None)
        return s if s and len(w) - len(s) >= at else None

    if s := ends(_PRONOUNS, rv):
        stem = w[: -len(s)]
        base = max((x for x in ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo") if stem.endswith(x) and len(stem) - len(x) >= rv), key=len, default=None)
        if base == "yendo":
            if stem[:-5].endswith("u"):
                w = stem
        elif base in ("iéndo", "ándo", "ár", "ér", "ír"):
            w = stem[: -len(base)] + base.translate(_PLAIN)
        elif base:
            w = stem
    before = w
    every = (*_STD_1, *_STD_2, *_STD_LOG, *_STD_UC, *_STD_ENC, *_STD_IDAD, *_STD_IVO, "amente", "mente")
    s = max((x for x in every if w.endswith(x)), key=len, default=None)
    if s:
        at, cut = len(w) - len(s), w[: len(w) - len(s)]
        drop = lambda t, *ends_: next((t[: -len(e)] for e in ends_ if t.endswith(e) and len(t) - len(e) >= r2), t)
        if s == "amente":
            if at >= r1:
                w = cut
                t = drop(w, "iv", "os", "ic", "ad")
                w = drop(t, "at") if t != w and w.endswith("iv") else t
        elif at >= r2:
            if s in _STD_1:
                w = cut
            elif s in _STD_2:
                w = drop(cut, "ic")
            elif s in _STD_LOG:
                w = cut + "log"
            elif s in _STD_UC:
                w = cut + "u"
            elif s in _STD_ENC:
                w = cut + "ente"
            elif s == "mente":
                w = drop(cut, "ante", "able", "ible")
            elif s in _STD_IDAD:
                w = drop(cut, "abil", "ic", "iv")
            else:
                w = drop(cut, "at")
    if w == before:
        s = ends(_Y_VERBS, rv)
        if s and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        else:
            s = max((x for x in (*_VERBS, *_VERBS_E) if w.endswith(x) and len(w) - len(x) >= rv), key=len, default=None)
            if s:
                w = w[: -len(s)]
                if s in _VERBS_E and w.endswith("gu") and len(w) - 1 >= rv:
                    w = w[:-1]
    if s := ends(("os", "a", "o", "á", "í", "ó"), rv):
        w = w[: -len(s)]
    elif s := ends(("e", "é"), rv):
        w = w[: -len(s)]
        if w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_PLAIN)


STEMMERS = {"porter": porter, "lancaster": lancaster, "spanish": spanish}


def stems(terms: DataFrame, stemmer: str, term: str = "term") -> DataFrame:
    """(term, stem) of distinct terms; null terms are left out."""
    f = STEMMERS[stemmer]

    @F.pandas_udf("string")
    def stem(s: pd.Series) -> pd.Series:
        return s.map(f)

    return terms.select(F.col(term).alias("term")).where("term is not null").distinct().select("term", stem("term").alias("stem"))
