"""Wide generators of names, addresses, numbers and sentences around them; used in training only."""

from __future__ import annotations

import random

# --- fixed values: common names, street words and sentence frames in four languages --------------
GIVEN = (
    "Ana Juan María José Carlos Laura Luis Carmen Jorge Marta Diego Paula Andrés Sofía Miguel Elena Raúl Julia Pedro Rocío João Ana Maria António Beatriz Tiago Catarina Rui Inês Paulo Luísa Marcos Fernanda "
    "Pierre Marie Jean Camille Luc Sophie Antoine Chloé Paul Élise Hugo Manon Louis Claire Michel Anne John Mary James Linda Robert Susan David Karen Peter Emma Thomas Olivia George Alice Kevin Nora "
    "Priya Wei Yuki Ahmed Fatima Olga Ivan Ingrid Lars Aisha"
).split()
SURNAMES = (
    "García Pérez Rodríguez González Fernández López Martínez Sánchez Gómez Díaz Torres Romero Álvarez Ruiz Suárez Castro Molina Ortiz Silva Santos Oliveira Souza Pereira Costa Ferreira Almeida Carvalho "
    "Ribeiro Gomes Barbosa Rocha Dias Martin Bernard Dubois Durand Leroy Moreau Laurent Lefebvre Fournier Girard Mercier Dupont Blanchard Rousseau Smith Johnson Williams Brown Jones Miller Davis Wilson "
    "Taylor Anderson Clark Walker Wright Baker Turner Murphy O'Connor MacDonald Nguyen Patel Kowalski Schmidt Müller Rossi Tanaka Haddad Ivanova Larsen"
).split()
_ES = ("Calle", "Avenida", "Av.", "calle", "Pasaje", "Bulevar", "C/")
_PT = ("Rua", "Avenida", "Av.", "R.", "Travessa", "Praça", "rua")
_FR = ("rue", "avenue", "boulevard", "place", "allée", "chemin")
_EN = ("Street", "Road", "Avenue", "Lane", "Drive", "Close", "St.", "Ave.", "Rd.")
_NAMED = "San Martín,Mitre,Las Flores,del Sol,Belgrano,los Pinos,Mayor,Rivadavia,das Flores,Augusta,do Comércio,XV de Novembro,Oak,Maple,King,Station,Church,Mill,High,Victor Hugo,de la Paix,du Moulin,des Lilas,Pasteur,de la Gare,Colón,Sarmiento,Park".split(",")
_HOSTS = "mail correo empresa uni lab web datos ejemplo post serv info escuela net box".split()
_ENDS = "com org net edu example com.ar com.br fr es pt co.uk info".split()
PHONES = ("+## # ## ## ## ##", "0# ## ## ## ##", "+54 9 11 ####-####", "(011) ####-####", "11 ####-####", "+34 ### ### ###", "### ### ###", "+55 11 9####-####", "(11) 9####-####", "+1 ### ### ####", "(###) ###-####", "###-###-####", "+44 20 #### ####", "0### ######", "+351 ### ### ###", "+33 # ## ## ## ##", "0800-###-####", "+54 (351) ###-####", "0#.##.##.##.##")
IDENTS = (
    ("DNI ", "##.###.###"), ("DNI: ", "########"), ("documento n° ", "##.###.###"), ("NIE ", "X#######K"), ("CUIT ", "##-########-#"), ("CUIL: ", "##-########-#"), ("pasaporte ", "AAA######"), ("pasaporte n° ", "AA#######"), ("CPF ", "###.###.###-##"), ("CPF: ", "###########"),
    ("RG ", "##.###.###-#"), ("passaporte ", "AA######"), ("SSN ", "###-##-####"), ("social security number ", "###-##-####"), ("passport no. ", "#########"), ("passport ", "A########"), ("NI number ", "AA ## ## ## A"), ("NIR ", "# ## ## ## ### ### ##"), ("sécurité sociale ", "# ## ## ## ### ### ##"), ("carte d'identité ", "##AA#####"), ("NIF ", "########K"), ("ID card ", "########A"),
)
FRAMES = (
    "Me llamo {name} y vivo en {address}.", "Escribile a {name} ({email}) o llamá al {phone}.", "Según {name}, la corrida terminó bien.", "{name} firmó el acta con {ident}.", "Contacto: {name}, tel. {phone}", "El paquete va a {address}, a nombre de {name}.", "Mi correo es {email}", "La profesora {name} revisó las notas.", "Cualquier duda, {email} o {phone}.", "Firmado: {name}",
    "My name is {name} and I live at {address}.", "Please call {name} on {phone}.", "{name} wrote to {email} yesterday.", "Reviewed by {name} and {name}.", "Send it to {address} before Friday.", "My {ident} is on the form.", "Dr. {name} asked for {phone} again.", "Best regards,{nl}{name}", "Author: {name} <{email}>", "Ask {name} about the index.",
    "Meu nome é {name} e moro na {address}.", "Fale com {name} pelo telefone {phone}.", "O {ident} de {name} está errado.", "Escreva para {email}.", "Atenciosamente, {name}", "A entrega é na {address}.", "Segundo {name}, falta um arquivo.", "Ligue para {phone} e pergunte por {name}.",
    "Je m'appelle {name} et j'habite {address}.", "Appelez {name} au {phone}.", "Son adresse est {email}.", "Cordialement, {name}", "Selon {name}, tout est prêt.", "Numéro : {ident}, au nom de {name}.", "Le colis part au {address}.", "Écrivez à {name} ({email}).",
    "{name}", "{name}, {phone}", "{email} | {phone}", "Tel: {phone}", "{ident}", "{address}",
)
PLAIN = (
    "El nodo {word} respondió en {n} ms y el {word} en {n}.", "La versión {n}.{n}.{n} salió el {n}/{n}/{year}.", "Model {word}-{n} scored {dec} on set {n}.", "Error {n}{n}{n}: see page {n}.", "O lote {n}-{n} tem {n}{n} registros.", "La table {n} contient {n} {n} lignes.", "Job {n}{n}{n}{n} ended with code {n}.", "{word} y {word} son bibliotecas, no personas.",
    "Apparently, {word} reads the index again.", "Besides, {word} loses track of the {word} queue.", "Sous charge normale, {word} est lent.", "El turno de {word} empieza a las {n}.", "Zipf, Heaps y Porter dan nombre a métodos.", "The Okapi formula beats the {word} baseline.", "Visitamos Córdoba, Madrid y São Paulo.", "IP 10.{n}.{n}.{n}, puerto 80{n}.", "ISBN 978-{n}-{n}{n}{n}-{n}{n}-{n}", "Ver https://www.{word}.example/a/{n}?q={n}", "DOI 10.{n}{n}/{word}.{year}.{n}", "Ticket #{n}{n}{n}{n} cerrado.",
)
# ---------------------------------------------------------------------------------------------
_PART = ("al bar ca do el fa gu he is jo ka lo mi na or pe qui ra sol ti ur ve wa xi yo zu").split()


def invented(rnd: random.Random) -> str:
    return "".join(rnd.choice(_PART) for _ in range(rnd.randint(2, 4))).capitalize()


def digits(form: str, rnd: random.Random) -> str:
    return "".join(rnd.choice("0123456789") if c == "#" else rnd.choice("ABCDEFGHJKLMNPRSTVXYZ") if c in "AK" else c for c in form)


def surname(rnd: random.Random) -> str:
    return rnd.choice(SURNAMES) if rnd.random() < 0.8 else invented(rnd)


def name(rnd: random.Random, hints: list[str]) -> str:
    """A person's name of at least a surname."""
    given = rnd.choice(hints) if hints and rnd.random() < 0.4 else rnd.choice(GIVEN)
    s, k = surname(rnd), rnd.random()
    full = f"{given} {s}" if k < 0.6 else f"{given} {rnd.choice('ABCDEFGLMPRST')}. {s}" if k < 0.7 else f"{given[0]}. {s}" if k < 0.78 else f"{given} {s} {surname(rnd)}" if k < 0.88 else f"{given} {s}-{surname(rnd)}" if k < 0.92 else f"{s}, {given}"
    return full.upper() if rnd.random() < 0.02 else full.lower() if rnd.random() < 0.01 and "." not in full and "," not in full else full


def email(rnd: random.Random) -> str:
    local = rnd.choice((rnd.choice(GIVEN), surname(rnd), f"{rnd.choice(GIVEN)}.{surname(rnd)}", f"{surname(rnd)}{rnd.randint(1, 99)}")).lower()
    local = "".join(c for c in local if c.isascii() and c not in "' ") or "x"
    return f"{local}@{rnd.choice(_HOSTS)}{rnd.choice(('', str(rnd.randint(1, 9)), '-' + rnd.choice(_HOSTS)))}.{rnd.choice(_ENDS)}"


def address(rnd: random.Random) -> str:
    street, n = rnd.choice(_NAMED) if rnd.random() < 0.6 else invented(rnd), rnd.randint(1, 4999)
    k = rnd.randrange(4)
    if k == 0:
        return f"{rnd.choice(_ES)} {street} {n}" + rnd.choice(("", "", f", piso {rnd.randint(1, 20)}", f", piso {rnd.randint(1, 20)} {rnd.choice('ABCD')}", f", dpto. {rnd.randint(1, 20)}"))
    if k == 1:
        return f"{rnd.choice(_PT)} {street}, {n}" + rnd.choice(("", "", f", apto {rnd.randint(1, 200)}", f", {rnd.randint(1, 20)}º andar"))
    if k == 2:
        return f"{n % 300 + 1}{rnd.choice(('', '', ' bis'))}{rnd.choice((' ', ', '))}{rnd.choice(_FR)} {street}"
    return rnd.choice(("", "", f"Flat {rnd.randint(1, 90)}, ")) + f"{n} {street} {rnd.choice(_EN)}" + rnd.choice(("", "", f", Apt {rnd.randint(1, 90)}"))


def line(rnd: random.Random, hints: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence and its spans; three in ten have none."""
    if rnd.random() < 0.3:
        word, n = lambda: invented(rnd) if rnd.random() < 0.7 else invented(rnd).lower(), lambda: str(rnd.randint(1, 99))
        t = rnd.choice(PLAIN)
        for key, f in (("{word}", word), ("{n}", n), ("{year}", lambda: str(rnd.randint(1990, 2030))), ("{dec}", lambda: f"0.{rnd.randint(100, 9999)}")):
            while key in t:
                t = t.replace(key, f(), 1)
        return t, []
    out, spans, rest = "", [], rnd.choice(FRAMES).replace("{nl}", " ")
    while "{" in rest:
        before, _, rest = rest.partition("{")
        kind, _, rest = rest.partition("}")
        out += before
        lead = ""
        if kind == "ident":
            lead, form = rnd.choice(IDENTS)
            v = digits(form, rnd)
        else:
            v = {"name": lambda: name(rnd, hints), "phone": lambda: digits(rnd.choice(PHONES), rnd), "email": lambda: email(rnd), "address": lambda: address(rnd)}[kind]()
        out += lead
        spans.append((len(out), len(out) + len(v), kind))
        out += v
    return out + rest, spans
