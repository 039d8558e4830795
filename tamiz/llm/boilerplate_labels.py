"""Weak labels for page lines, from patterns over a bounded sample of pages; used in training only."""

from __future__ import annotations

import re
from collections import Counter

# --- fixed values: patterns of page furniture in Spanish, English, Portuguese and French --------
_STARTS = r"""Inicio|Home|Início|Accueil"""
FURNITURE = re.compile(
    rf"^(?:(?:{_STARTS}) (?:»|>|/|›) .+"
    r"|(?:Etiquetas|Tags|Marcadores|Mots-clés) ?: .+"
    r"|(?:Dejá tu comentario|Leave a comment|Deixe seu comentário|Laisser un commentaire) ?\(.+\)"
    r"|(?:Compartir|Share|Compartilhar|Partager)\b.* \| .+"
    r"|« ?(?:Anterior|Previous|Précédent).+"
    r"|(?:Tiempo de lectura|Leitura de) ?:? ?\d+ .+|\d+ min(?: read| de lecture)? · .+"
    r"|(?:Hoy|Today is|Hoje|Aujourd'hui|Nous sommes le|Hoje é)\b.* · \d+ .+"
    r"|(?:Suscribite a nuestro|Sign up for our newsletter|Assine nosso|Recevez notre lettre).*"
    r"|(?:Reportar un error|Report a problem|Relatar um erro|Reportar erro|Signaler un).*"
    r"|(?:Tu navegador no|Your browser cannot|Seu navegador não|Votre navigateur ne).*"
    r"|(?:Volver arriba|Back to top|Voltar ao topo|Haut de page)"
    r"|(?:Publicidad|Advertisement|Publicidade|Publicité)"
    r"|(?:Sitio mantenido por|A site of the|Um site da rede|Un site du réseau).*"
    r"|©.*|(?:Prohibida su reproducción|No part may be|Proibida a reprodução|Reproduction interdite).*"
    r"|(?:Contenido bajo licencia|Content under an open|Conteúdo sob licença|Contenu sous licence).*"
    r"|(?:Términos y condiciones|Terms of use|Termos de uso|Conditions d'utilisation) · .+"
    r"|(?:Lea también|Read next|Leia também|À lire aussi) ?:.*)$"
)
NOTICE = re.compile(
    r"^(?:Este sitio guarda datos|This site stores data|Este site guarda dados|Ce site garde des données"
    r"|Usamos cookies|We use our own|Nous utilisons des cookies|Para que \w+ (?:funcione|funcionar)|For \w+ to work|Pour que \w+ fonctionne"
    r"|Valoramos tu privacidad|Your privacy matters|Sua privacidade importa|Votre vie privée compte)"
)
RELATED = re.compile(
    r"^(?:Seguí leyendo|En otras secciones|Te puede interesar|Notas relacionadas|Lo más leído|You may also like|Keep reading|Elsewhere on the site"
    r"|Related stories|Most read|Articles liés|Les plus lus|Poursuivre la lecture|Vous aimerez aussi|Ailleurs sur le site"
    r"|Notícias relacionadas|Você também pode gostar|Mais lidas|Continue lendo|Em outras seções"
    r"|(?:Lea también|Read next|Leia também|À lire aussi) ?:$) ?:?"
)
BYLINE = re.compile(r"^(?:Por (?:Redacción|Redação)|By .+ Desk|Par la rédaction)\b")
# ------------------------------------------------------------------------------------------------
_MARK = re.compile(r"^(?:[•*\-–] )+")
_SEP = re.compile(r" [·|\-/] |\s{3,}")


def tidy(line: str) -> str:
    return re.sub(r"</?[A-Za-z][^<>]{0,60}>", "", line).replace("&nbsp;", " ").replace("\xa0", " ").strip()


def menu_words(pages: list[str], least: int = 10) -> set[str]:
    """Short phrases that stand alone on many pages."""
    seen: Counter[str] = Counter()
    for t in pages:
        rows = [[p for p in _SEP.split(_MARK.sub("", tidy(x)).casefold()) if p] for x in t.split("\n")]
        for part in {p for r in rows if len(r) == 1 or len(r) > 2 for p in r}:
            if len(part.split()) <= 4 and part[-1] not in ".;:":
                seen[part] += 1
    return {p for p, n in seen.items() if n >= least}


def labels(text: str, menu: set[str]) -> list[int]:
    """For each line 1 (furniture), 0 (main body) or -1 (blank)."""
    lines = [tidy(x) for x in text.split("\n")]
    out, related, notice = [], False, False
    for i, s in enumerate(lines):
        after = lines[i + 1] if i + 1 < len(lines) else ""
        if not s:
            out.append(-1)
            related = notice = False
            continue
        bare = _MARK.sub("", s)
        parts = [p.strip().casefold() for p in _SEP.split(bare) if p.strip()]
        got = 0
        if notice and (s[0].islower() or s[0].isdigit()):
            got, notice = 1, s[-1] not in ".!"
        elif NOTICE.match(s):
            got, notice = 1, s[-1] not in ".!"
        elif RELATED.match(s) and s[-1] != "." or FURNITURE.match(s) or parts and 2 * sum(p in menu for p in parts) >= len(parts) + (len(parts) == 1):
            got = 1
            related = bool(RELATED.match(s)) or related and not (FURNITURE.match(s) or any(p in menu for p in parts))
            related = related or s.endswith(":") and bool(FURNITURE.match(s))
        elif related and s[-1] != "." and not BYLINE.match(s) and not BYLINE.match(after) and (not after or after[-1] != "." or len(after) < 60 or FURNITURE.match(after) or NOTICE.match(after)):
            got = 1
        if not got:
            related = notice = False
        out.append(got)
    return out
