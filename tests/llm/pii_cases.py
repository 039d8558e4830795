"""Hand-written sentences, none of whose values comes from the test tables; used to measure, never to train."""

from __future__ import annotations

CASES = [
    ("I met John Smith at the station.", [("name", "John Smith")]),
    ("Mary Johnson sent the report to us on Monday.", [("name", "Mary Johnson")]),
    ("Ayer hablé con Juan Pérez sobre el informe.", [("name", "Juan Pérez")]),
    ("The form was signed by Robert Miller.", [("name", "Robert Miller")]),
    ("Pierre Dupont a corrigé le texte hier soir.", [("name", "Pierre Dupont")]),
    ("João Silva respondeu à mensagem.", [("name", "João Silva")]),
    ("Saludos, Lucía Fernández Ocampo", [("name", "Lucía Fernández Ocampo")]),
    ("Le rendez-vous est avec Mme Hélène Garnier.", [("name", "Hélène Garnier")]),
    ("Fale com Rodrigo Meireles na recepção.", [("name", "Rodrigo Meireles")]),
    ("Prof. Whitfield will mark the exam.", [("name", "Whitfield")]),
    ("O CPF 529.982.247-25 já está no cadastro.", [("ident", "529.982.247-25")]),
    ("Su DNI 34.567.891 figura en la planilla.", [("ident", "34.567.891")]),
    ("My SSN 219-09-9999 was on the letter.", [("ident", "219-09-9999")]),
    ("CUIT 30-71234567-8, razón social pendiente.", [("ident", "30-71234567-8")]),
    ("Passport no. 533380006 expires in May.", [("ident", "533380006")]),
    ("Sécurité sociale 2 69 05 49 588 157 80, dossier ouvert.", [("ident", "2 69 05 49 588 157 80")]),
    ("NI number QQ 12 34 56 C was entered twice.", [("ident", "QQ 12 34 56 C")]),
    ("Appelez le 06 12 34 56 78 avant midi.", [("phone", "06 12 34 56 78")]),
    ("Call me on +1 415 555 0132 after six.", [("phone", "+1 415 555 0132")]),
    ("Llamar al (0351) 456-7890 por la mañana.", [("phone", "(0351) 456-7890")]),
    ("Tel. +55 21 98765-4321", [("phone", "+55 21 98765-4321")]),
    ("The office number is 020 7946 0018.", [("phone", "020 7946 0018")]),
    ("Mi móvil es +34 612 345 678, gracias.", [("phone", "+34 612 345 678")]),
    ("Vive en Avenida Corrientes 1234, piso 5 B.", [("address", "Avenida Corrientes 1234, piso 5 B")]),
    ("She lives at 221 Baker Street.", [("address", "221 Baker Street")]),
    ("Envie para Rua Augusta, 1500, apto 42.", [("address", "Rua Augusta, 1500, apto 42")]),
    ("Il habite 12, rue de la Paix.", [("address", "12, rue de la Paix")]),
    ("The shop moved to 48 Elm Road last year.", [("address", "48 Elm Road")]),
    ("La oficina queda en Calle Alcalá 45.", [("address", "Calle Alcalá 45")]),
    ("Write to jane.doe@acme-tools.com today.", [("email", "jane.doe@acme-tools.com")]),
    ("Correo: r.quiroga (arroba) fastmail (punto) com", [("email", "r.quiroga (arroba) fastmail (punto) com")]),
    ("m_dubois at the desk said no.", []),
    ("contact [at] univ-lille [dot] fr est l'adresse.", [("email", "contact [at] univ-lille [dot] fr")]),
    ("O e-mail marina77@ig.com.br voltou.", [("email", "marina77@ig.com.br")]),
    ("The Dirichlet prior and Okapi weights were compared.", []),
    ("Build 20240517.3 took 1234567 ms on node 12.", []),
    ("Paris and Buenos Aires are far apart.", []),
    ("Version 3.14.159 of NumPy and Spark 4.1 were used.", []),
    ("El artículo 12 de la ley 24.240 se aplica.", []),
    ("Page 250 of 1024, table 7-12.", []),
]


def score(q) -> dict[str, tuple[int, int, int]]:
    """(found, true, both) by kind."""
    from tamiz.llm import pii

    out = {k: [0, 0, 0] for k in ("email", "phone", "ident", "address", "name")}
    for (text, want), got in zip(CASES, pii.tag_texts(q, [t for t, _ in CASES])):
        seen = {(k, text[a:b]) for a, b, k in got}
        for k, _ in seen:
            out[k][0] += 1
        for x in want:
            out[x[0]][1] += 1
            out[x[0]][2] += x in seen
    return {k: tuple(v) for k, v in out.items()}
