"""Weak labels for the PII tagger: patterns that mark spans in a bounded sample of texts.

They are used for training and for held-out comparison only; at query time the spans come
from the tagger in :mod:`tamiz.llm.pii`.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "ident", "address", "name")

# --- fixed values: shapes of labelled spans -------------------------------------------------
_AT = r"(?:@| @ | ?[(\[] ?(?i:at|arroba|arobase) ?[)\]] ?)"
_DOT = r"(?:\.| ?[(\[] ?(?i:dot|punto|ponto|point) ?[)\]] ?)"
EMAIL = rf"[A-Za-z0-9][\w.+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+"
PHONE = (
    r"(?<![\w.+-])(?:\+\d{1,3} (?:\(\d{1,4}\) ?)?\d[\d .-]{5,}\d"
    r"|\(\d{2,4}\) 9?\d{3,4}[- ]\d{4}|(?:011 15 |011 |\d\d )?5550[- ]\d{4}|54115550\d{4}|0800-555-\d{4}"
    r"|(?:\d{3}[-.])?555[-.]\d{4}|020 7946 \d{4}|0199 00 \d{4}|01([ .])99\1\d\d\1\d\d\1\d\d)"
    r"(?: (?:ext|int)\. ?\d+| (?:ramal|poste|interno) \d+)?(?!\w)"
)
IDENT = (
    r"(?:(?i:\bdni(?: nro\.)?|\bdocumento n°|\bnie|\bcui[tl]:?|\bpasaporte(?: n°)?|\bpassport(?: no\.)?|\bssn"
    r"|\bsocial security number|\bid card|\bcpf|\brg|\bpassaporte(?: n°)?|\bcarte d'identité|\bpasseport"
    r"|\bsécurité sociale|\bnir|\bnif|\bnuss|\bni number)):? "
    r"([A-Z]{2}(?: \d\d){3} [A-Z]|[A-Z0-9][A-Z0-9]*(?:[ .-][A-Z0-9]*\d[A-Z0-9]*)*(?:-[A-Z0-9]+)?)(?!\w)"
)
BARE_IDENT = (
    r"(?<![\w.-])(?:99\.\d{3}\.\d{3}(?:-[A-Z0-9])?|99 \d{3} \d{3}|\d\d-99\d{6}-\d|X-00\d{5}-Q|ZZX\d{6}|99ZZ\d{5}|9999\d{6}ZZ"
    r"|QX-\d{3}-\d{3}-\d|9\d\d-\d\d-\d{4}|999\.\d{3}\.\d{3}-\d\d|QQ(?: \d\d){3} [A-Z]|\d 99 \d\d 99 \d{3} \d{3} \d\d)(?![\w-])"
)
_CAP = r"[A-ZÀ-Ý][\w'’]+"
ADDRESS = (
    rf"(?:\b(?:[Cc]alle|[Aa]venida|[Aa]v\.|[Bb]ulevar|[Pp]je\.|[Pp]asaje|[Rr]ua|[Tt]ravessa|[Aa]lameda|[Pp]raça|R\.)|\bC/) "
    rf"(?:d[eao]s? (?:l[oa]s? )?)?{_CAP}(?: {_CAP})*,? (?:N° |nº |n° )?\d{{1,5}}[A-Z]?"
    rf"(?:,? (?:piso \d+(?: [A-Z]\b)?|dpto\. \d+|apto\.? \d+|ap\. \d+|\d+º andar))*"
    rf"|\b\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|bd|boulevard|impasse|place|allée|chemin|quai) "
    rf"(?:d(?:es?|u) (?:la )?|de l')?{_CAP}(?: {_CAP})*(?:, (?:appt|apt|bât)\.? \w+)?"
    rf"|(?:\b(?:Flat|Unit|Apt) \d+, )?\b\d{{1,5}}[A-Z]? {_CAP}(?: {_CAP})? (?:Street|Lane|Avenue|Close|Road|Drive|Rd\.|St\.|Ave\.)"
    rf"(?:, (?:Apt|Flat|Unit) \d+)?"
)
_SUR = (
    r"(?i:(?:tess|lamb|ulm|tov|yar|nard|ost|pell|zul|fend|bram|rusk|wend|kest|isk|jorv|harl|querr|mald|vint|sard|orv)"
    r"(?:ovar|etti|ikov|ero|andi|ulle|ena|mark|sson|irier|alba|ueda|iego|inho|uoz|estri))\b"
)
_SURS = rf"(?=[A-Z]){_SUR}(?:[ -](?=[A-Z]){_SUR})?"
_GIVEN = r"(?:[A-ZÀ-Ý]\w+|[A-ZÀ-Ý]\.)"
_TITLE = r"(?:Dra?|Lic|Sra?|Ing|Prof|prof|Mrs?|Ms|Mme|M)\.? "
_LEAD = r"(?:Seg[uú]n|According to|Selon|Segundo|Conforme|Saludos|Regards|Cordialement|Abraços)"
NAME = rf"(?:{_SURS}, [A-ZÀ-Ý]\w+|(?:(?!{_TITLE}|{_LEAD}\b|{_SUR})(?<!\w){_GIVEN} ){{0,2}}\b{_SURS})"
#: A given name and a surname in lower case; not the local part of an address.
_LOWS = rf"(?=[a-z]){_SUR}(?:[ -](?=[a-z]){_SUR})?"
LOW_NAME = rf"(?<![\w@.+/-])(?!(?:est|para|por|con|que|los|las|pour|par|the|and|from|said)\b)[a-zà-ÿ]{{3,}} {_LOWS}(?![\w@+-]|\.\w| ?@| ?[(\[] ?(?i:at|arroba|arobase)\b)"
# --------------------------------------------------------------------------------------------

_RULES = [(k, re.compile(p)) for k, p in (("email", EMAIL), ("address", ADDRESS), ("ident", IDENT), ("ident", BARE_IDENT), ("phone", PHONE), ("name", NAME), ("name", LOW_NAME))]


def spans(text: str) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind), earlier rules first."""
    out: list[tuple[int, int, str]] = []
    for kind, rx in _RULES:
        for m in rx.finditer(text):
            a, b = m.span(1) if kind == "ident" and rx.groups else m.span()
            if all(b <= x or a >= y for x, y, _ in out):
                out.append((a, b, kind))
    return sorted(out)


_SYL = ("ba", "cor", "del", "fur", "gom", "hin", "jal", "kor", "lom", "mir", "nov", "pol", "quin", "ral", "sov", "tan", "vel", "wil", "xim", "zar", "Mc", "O'B")
_END = ("ez", "son", "man", "ini", "eau", "ska", "ton", "ley", "eira", "ado", "ic", "aux", "elli", "ero", "ardi", "ung", "ola", "berg")


def invented_name(rnd: random.Random) -> str:
    s = "".join(rnd.choice(_SYL) for _ in range(rnd.randint(1, 2))) + rnd.choice(_END)
    return s[0].upper() + s[1:]


_SPELL = (("at", "dot"), ("arroba", "punto"), ("arroba", "ponto"), ("arobase", "point"))


def disguised(mail: str, rnd: random.Random) -> str:
    """The address with its sign and the dots of its host as bracketed words of one language."""
    (at, dot), (left, right), (out, inner) = rnd.choice(_SPELL), rnd.choice(("()", "()", "[]")), rnd.choice(((" ", ""), (" ", ""), ("", ""), (" ", " ")))
    word = lambda x: f"{out}{left}{inner}{x}{inner}{right}{out}"
    m = re.search(_AT, mail)
    return mail[: m.start()] + word(at) + re.sub(_DOT, word(dot), mail[m.end() :])


def augment(text: str, found: list[tuple[int, int, str]], rnd: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with other values: some addresses disguised, some surnames replaced by invented ones, digits redrawn, a few names in capitals or in lower case."""
    out, new, at, shift = [], [], 0, 0
    for a, b, kind in found:
        v = text[a:b]
        if kind == "email" and rnd.random() < 0.25:
            v = disguised(v, rnd)
        if kind == "name" and rnd.random() < 0.5:
            v = re.sub(_SUR, lambda m: n if (n := invented_name(rnd)) and m[0][0].isupper() else n.lower(), v)
            v = v.upper() if rnd.random() < 0.06 else v
        elif kind == "name" and " " in v and rnd.random() < 0.3:
            v = v.lower()
        elif kind in ("phone", "ident", "address") and rnd.random() < 0.5:
            v = re.sub(r"(?<!^)\d", lambda m: rnd.choice("0123456789"), v)
        out += [text[at:a], v]
        new.append((a + shift, a + shift + len(v), kind))
        shift += len(v) - (b - a)
        at = b
    return "".join([*out, text[at:]]), new
