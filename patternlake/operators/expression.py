"""Raw full-text expressions: parsed, and answered by one pass over the token table.

    expression := expression OR expression | expression AND expression | expression NOT expression
                | columns : ( expression ) | ( expression ) | list
    list       := [columns :] near ...                   all of them, tighter than NOT, AND and OR
    columns    := name | - name | { name ... } | - { name ... }
    near       := phrase | ^ phrase | NEAR ( phrase ... [, n] )
    phrase     := string [*] [+ string [*] ...]

NOT binds tighter than AND, AND than OR. A string is a bare word (letters, digits, _ and all that
isn't ASCII) or stands in double quotes, where a doubled quote is one. Its tokens follow one another in
one column; a star lets the last one be the start of a token, a caret wants the column's first token.
NEAR wants its phrases in one column with n tokens between at most (10). A string without tokens
is left out of a list and else matches nothing.

Each phrase and NEAR is a leaf. The token table's rows of all leaves' tokens are read at once, a
row of flags per id says which leaves it has, and the expression is a condition on these flags: one
scan and one grouping (two where phrases have several tokens), however many operators there are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Names of columns in expressions, and in the token table.
COLUMNS = {"name": "name", "description": "description", "tags": "tags_text", "source_object": "source_object", "pattern_type": "pattern_type"}
NEAR_TOKENS = 10


class ExpressionError(ValueError):
    """The expression doesn't follow the grammar, or names a column that there isn't."""


@dataclass(frozen=True)
class Phrase:
    """Tokens, each with whether it may be just the start of one."""

    tokens: tuple[tuple[str, bool], ...]
    first: bool = False


@dataclass(frozen=True)
class Near:
    """Phrases within `apart` tokens, in one of `columns` (None: any)."""

    phrases: tuple[Phrase, ...]
    apart: int = NEAR_TOKENS
    columns: frozenset[str] | None = None


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


@dataclass(frozen=True)
class But:
    wanted: object
    unwanted: object


NOTHING = Near(())

_LEXEME = re.compile(r'\s*(?:("(?:[^"]|"")*")|([A-Za-z0-9_\x1a\x80-\U0010ffff]+)|([(){}:,+*^-]))')


def _lexemes(text: str) -> list[tuple[str, str]]:
    """(kind, value): kind is string, AND, OR, NOT, or a mark itself."""
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        found = _LEXEME.match(text, at)
        if not found:
            raise ExpressionError(f"syntax error near {text[at:].lstrip()[:20]!r}")
        quoted, word, mark = found.groups()
        at = found.end()
        if quoted is not None:
            out.append(("string", quoted[1:-1].replace('""', '"')))
        elif word is not None:
            out.append((word, word) if word in ("AND", "OR", "NOT") else ("word", word))
        else:
            out.append((mark, mark))
    return out


class _Parser:
    def __init__(self, text: str, columns: dict[str, str]):
        self.lexemes, self.at, self.columns = _lexemes(text), 0, columns

    def kind(self, ahead: int = 0) -> str:
        k = self.at + ahead
        found = self.lexemes[k][0] if k < len(self.lexemes) else ""
        return "string" if found == "word" else found

    def take(self, kind: str) -> str:
        if self.kind() != kind:
            near = self.lexemes[self.at][1] if self.at < len(self.lexemes) else ""
            raise ExpressionError(f"syntax error near {near!r}")
        self.at += 1
        return self.lexemes[self.at - 1][1]

    def whole(self):
        found = self.either()
        if self.at < len(self.lexemes):
            raise ExpressionError(f"syntax error near {self.lexemes[self.at][1]!r}")
        return found

    def either(self):
        parts = [self.both()]
        while self.kind() == "OR":
            self.at += 1
            parts.append(self.both())
        return Any(tuple(parts)) if len(parts) > 1 else parts[0]

    def both(self):
        parts = [self.but()]
        while self.kind() == "AND":
            self.at += 1
            parts.append(self.but())
        return All(tuple(parts)) if len(parts) > 1 else parts[0]

    def but(self):
        found = self.part()
        while self.kind() == "NOT":
            self.at += 1
            found = But(found, self.part())
        return found

    def part(self):
        if self.kind() == "(":
            return self.group()
        mark = self.at
        columns = self.column_set()
        if columns is not None and self.kind() == "(":
            return _within(self.group(), columns)
        self.at = mark
        parts = [self.near_of_columns()]
        while self.kind() in ("string", "^", "{", "-"):
            parts.append(self.near_of_columns())
        # strings without tokens don't count beside others
        parts = [p for p in parts if p != NOTHING] or [NOTHING]
        return All(tuple(parts)) if len(parts) > 1 else parts[0]

    def group(self):
        self.take("(")
        found = self.either()
        self.take(")")
        return found

    def column_set(self) -> frozenset[str] | None:
        """The columns before a colon; None, with nothing taken, where there are none."""
        start, out = self.at, self.kind() == "-"
        self.at += out
        names = []
        if self.kind() == "{":
            self.at += 1
            while self.kind() == "string":
                names.append(self.take("string"))
            self.take("}")
        elif self.kind() == "string" and self.kind(1) == ":":
            names.append(self.take("string"))
        if not names or self.kind() != ":":
            if out or self.at > start:
                near = self.lexemes[self.at][1] if self.at < len(self.lexemes) else ""
                raise ExpressionError(f"syntax error near {near!r}")
            return None
        self.take(":")
        known = {n.lower(): c for n, c in self.columns.items()}
        for n in names:
            if n.lower() not in known:
                raise ExpressionError(f"no such column: {n}")
        named = frozenset(known[n.lower()] for n in names)
        return frozenset(self.columns.values()) - named if out else named

    def near_of_columns(self):
        columns = self.column_set()
        found = self.near()
        return found if columns is None else _within(found, columns)

    def near(self):
        if self.kind() == "string" and self.kind(1) == "(":
            if self.lexemes[self.at] != ("word", "NEAR"):
                raise ExpressionError(f"syntax error near {self.lexemes[self.at][1]!r}")
            self.at += 2
            phrases = [self.phrase()]
            while self.kind() == "string":
                phrases.append(self.phrase())
            apart = NEAR_TOKENS
            if self.kind() == ",":
                self.at += 1
                number = self.take("string")
                if not re.fullmatch("[0-9]+", number):
                    raise ExpressionError(f"expected integer, got {number!r}")
                apart = int(number)
            self.take(")")
            phrases = [p for p in phrases if p.tokens]
            return Near(tuple(phrases), apart) if phrases else NOTHING
        first = self.kind() == "^"
        self.at += first
        phrase = self.phrase()
        return Near((Phrase(phrase.tokens, first),)) if phrase.tokens else NOTHING

    def phrase(self) -> Phrase:
        tokens: list[tuple[str, bool]] = []
        while True:
            tokens += [(t, False) for t in T._plain_tokens(self.take("string"))]
            if self.kind() == "*":
                self.at += 1
                tokens[-1:] = [(t, True) for t, _ in tokens[-1:]]
            if self.kind() != "+":
                return Phrase(tuple(tokens))
            self.at += 1


def _within(node, columns: frozenset[str]):
    if isinstance(node, Near):
        return node if node == NOTHING else Near(node.phrases, node.apart, columns if node.columns is None else columns & node.columns)
    if isinstance(node, But):
        return But(_within(node.wanted, columns), _within(node.unwanted, columns))
    return type(node)(tuple(_within(p, columns) for p in node.parts))


def parse(text: str, columns: dict[str, str] = COLUMNS):
    """The tree of an expression; ExpressionError where it has none."""
    return _Parser(text, columns).whole()


def leaves(node) -> list[Near]:
    if isinstance(node, Near):
        return [] if node == NOTHING else [node]
    parts = [node.wanted, node.unwanted] if isinstance(node, But) else node.parts
    return list(dict.fromkeys(x for p in parts for x in leaves(p)))


def _condition(node, flag: dict[Near, Column]) -> Column:
    if isinstance(node, Near):
        return flag.get(node, F.lit(False))
    if isinstance(node, But):
        return _condition(node.wanted, flag) & ~_condition(node.unwanted, flag)
    joint = (lambda a, b: a & b) if isinstance(node, All) else (lambda a, b: a | b)
    return reduce(joint, (_condition(p, flag) for p in node.parts))


def _spots(index: DataFrame, near: list[Near]) -> DataFrame:
    """id, column, leaf, phrase, start and size of every place where a leaf's phrase is."""
    wanted, told = [], []
    for leaf, n in enumerate(near):
        for number, phrase in enumerate(n.phrases):
            for k, (token, start) in enumerate(phrase.tokens):
                condition = F.col("token").startswith(token) if start else F.col("token") == token
                if n.columns is not None:
                    condition &= F.col("column").isin(*sorted(n.columns)) if n.columns else F.lit(False)
                if phrase.first:
                    condition &= F.col("pos") == k
                wanted.append((token, start))
                spot = F.struct(F.lit(leaf).alias("leaf"), F.lit(number).alias("phrase"), F.lit(k).alias("k"), F.lit(len(phrase.tokens)).alias("size"))
                told.append(F.when(condition, spot))
    exact = sorted({t for t, start in wanted if not start})
    read = [F.col("token").isin(*exact)] if exact else []
    read += [F.col("token").startswith(t) for t in sorted({t for t, start in wanted if start})]
    rows = index.where(reduce(lambda a, b: a | b, read))
    found = rows.select("id", "column", "pos", F.explode(F.array_compact(F.array(*told))).alias("s")).select("id", "column", "s.*", (F.col("pos") - F.col("s.k")).alias("start"))
    if all(len(p.tokens) == 1 for n in near for p in n.phrases):
        return found
    place = ["id", "column", "leaf", "phrase", "start", "size"]
    return found.groupBy(*place).agg(F.count("*").alias("n")).where("n = size").select(*place)


def _close(spots: DataFrame, near: dict[int, Near]) -> DataFrame:
    """id and leaf of the NEARs that hold: from a place, the last one of each phrase before it is close enough."""
    before = Window.partitionBy("id", "column", "leaf").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    most = max(len(n.phrases) for n in near.values())
    ends = [F.max(F.when(F.col("phrase") == p, F.col("start") + F.col("size"))).over(before).alias(f"end{p}") for p in range(most)]
    rows = spots.where(F.col("leaf").isin(*near)).select("id", "leaf", "start", *ends)
    holds = [(F.col("leaf") == leaf) & reduce(lambda a, b: a & b, (F.col("start") - F.col(f"end{p}") <= n.apart for p in range(len(n.phrases)))) for leaf, n in near.items()]
    return rows.where(F.coalesce(reduce(lambda a, b: a | b, holds), F.lit(False))).select("id", "leaf")


def ids_matching(index: DataFrame, expression: str, columns: dict[str, str] = COLUMNS) -> DataFrame:
    """id of the rows that the expression matches."""
    tree = parse(expression, columns)
    near = leaves(tree)
    if not near:
        return index.where("false").select("id")
    spots = _spots(index, near)
    several = {k: n for k, n in enumerate(near) if len(n.phrases) > 1}
    hits = spots.select("id", "leaf")
    if several:
        hits = hits.where(~F.col("leaf").isin(*several)).unionByName(_close(spots, several))
    flags = hits.groupBy("id").agg(*[F.bool_or(F.col("leaf") == k).alias(f"leaf{k}") for k in range(len(near))])
    return flags.where(_condition(tree, {n: F.col(f"leaf{k}") for k, n in enumerate(near)})).select("id")
