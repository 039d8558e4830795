"""Boolean retrieval: AND, OR, NOT over posting lists, from a query string to one plan.

Operators bind NOT > AND > OR, all to the left.  ``strict=False`` keeps the historical evaluation: a
stack machine over the postfix form, whose result is the top of the stack, whatever is left below
it; ``a NOT b`` is then ``NOT b``.  ``strict=True`` rejects such queries and reads ``a NOT b`` as
``a AND NOT b``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed value: the tokens of a query
_LEX = re.compile(r"\(|\)|AND|OR|NOT|\w+")


@dataclass(frozen=True)
class Node:
    op: str  # TERM, AND, OR, NOT or EMPTY
    parts: tuple = ()
    term: str = ""


def lex(query: str) -> list[str]:
    """Operators are found inside words too: ``ORACLE`` is ``OR ACLE``."""
    return _LEX.findall(query)


def parse(query: str, strict: bool = False) -> Node:
    """The query's tree; an empty query matches nothing."""
    p = _Parser(lex(query), strict)
    while p.at < len(p.tokens):
        p.level("OR", "AND")
        if p.take(")") and strict:
            raise ValueError("unexpected )")
    if strict and len(p.known) > 1:
        raise ValueError("terms without an operator between them")
    return p.known[-1] if p.known else Node("EMPTY")


class _Parser:
    """Recursive descent; finished operands lie on ``known``, and an operator takes its own from there.

    Loose queries may leave operands over, or name several where one is expected: an operator then
    takes the latest.  A parenthesis that is never closed stands for nothing, behind what it holds.
    """

    def __init__(self, tokens: list[str], strict: bool):
        if strict:  # a NOT b: a AND NOT b
            tokens = [x for i, t in enumerate(tokens) for x in (("AND", "NOT") if t == "NOT" and i and tokens[i - 1] not in ("AND", "OR", "NOT", "(") else (t,))]
        self.tokens, self.strict, self.at, self.known = tokens, strict, 0, []

    def take(self, token: str) -> bool:
        found = self.tokens[self.at : self.at + 1] == [token]
        self.at += found
        return found

    def apply(self, op: str) -> None:
        n = 1 if op == "NOT" else 2
        if len(self.known) < n:
            raise ValueError(f"{op} lacks an operand")
        self.known[-n:] = [Node(op, tuple(self.known[-n:]))]

    def level(self, op: str | None = None, *higher: str) -> None:
        if op is None:
            return self.unit() if self.strict else self.operands(True)
        self.level(*higher)
        while self.take(op):
            self.level(*higher)
            self.apply(op)

    def operands(self, negated: bool) -> None:
        """Terms and groups up to the next operator; with ``negated`` also their negations."""
        while self.at < len(self.tokens) and self.tokens[self.at] not in ("AND", "OR", ")"):
            if self.tokens[self.at] != "NOT":
                self.primary()
            elif negated:
                self.at += 1
                self.operands(False)
                self.apply("NOT")
            else:
                return

    def primary(self) -> None:
        if not self.take("("):
            self.known.append(Node("TERM", term=self.tokens[self.at]))
            self.at += 1
            return
        self.level("OR", "AND")
        if not self.take(")"):
            if self.strict:
                raise ValueError("missing )")
            self.known.append(Node("EMPTY"))

    def unit(self) -> None:
        """Exactly one operand."""
        if self.take("NOT"):
            self.unit()
            self.apply("NOT")
        elif self.tokens[self.at : self.at + 1] in ([], ["AND"], ["OR"], [")"]):
            raise ValueError("an operator lacks an operand")
        else:
            self.primary()


def terms(node: Node) -> set[str]:
    return {node.term} if node.op == "TERM" else {t for p in node.parts for t in terms(p)}


def evaluate(node: Node, posts: DataFrame, universe: DataFrame, fold: bool = True) -> DataFrame:
    """(doc_id) of the documents that match.

    One pass instead of chained set operations: the query's terms are filtered at the scan, each document gets
    one flag a term, and the tree is a Boolean expression over the flags.  The
    universe is read only if documents without any of the terms can match.
    """
    names = sorted(terms(node))
    seen = {t: F.max(F.col("term") == (t.lower() if fold else t)).alias(f"t{i}") for i, t in enumerate(names)}
    if names:
        hits = posts.where(F.col("term").isin(*[t.lower() if fold else t for t in names])).groupBy("doc_id").agg(*seen.values())
    else:
        hits = posts.where(F.lit(False)).select("doc_id")
    flag = {t: F.coalesce(F.col(f"t{i}"), F.lit(False)) for i, t in enumerate(names)}

    def expr(n: Node):
        if n.op == "TERM":
            return flag[n.term]
        if n.op == "EMPTY":
            return F.lit(False)
        p = [expr(x) for x in n.parts]
        return ~p[0] if n.op == "NOT" else p[0] & p[1] if n.op == "AND" else p[0] | p[1]

    def blank(n: Node) -> bool:
        """Whether a document without any term matches."""
        if n.op in ("TERM", "EMPTY"):
            return False
        p = [blank(x) for x in n.parts]
        return not p[0] if n.op == "NOT" else p[0] and p[1] if n.op == "AND" else p[0] or p[1]

    rows = universe.select("doc_id").distinct().join(hits, "doc_id", "left") if blank(node) else hits
    return rows.where(expr(node)).select("doc_id")


def search(query: str, posts: DataFrame, universe: DataFrame, strict: bool = False) -> DataFrame:
    return evaluate(parse(query, strict), posts, universe)


def patterns(words: list[str]) -> list[str]:
    """The benchmark's query forms of two or three terms."""
    if len(words) == 2:
        a, b = words
        return [f"{a} AND {b}", f"{a} OR {b}", f"{a} NOT {b}"]
    a, b, c = words
    return [f"{a} AND {b} AND {c}", f"({a} OR {b}) NOT {c}", f"({a} AND {b}) OR {c}"]


def known_queries(queries: DataFrame, vocab: DataFrame, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(qid, words) of queries with so many words, all of them in the vocabulary."""
    q = queries.where(F.size("words").isin(*sizes))
    have = q.select("qid", F.explode(F.array_distinct("words")).alias("term")).join(vocab.select("term"), "term", "left_semi")
    n = have.groupBy("qid").agg(F.count(F.lit(1)).alias("__n"))
    return q.join(n, "qid").where(F.col("__n") == F.size(F.array_distinct("words"))).select("qid", "words")
