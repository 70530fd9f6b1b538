"""Personal data: fixed patterns, and a semi-Markov conditional random field for the rest.

Patterns find the plain forms. The field looks at what they leave: in windows
around digits or spelled-out addresses it scores whole candidate segments of at most
LONGEST words by features of the whole span, plus the transition between neighbouring
labels, and a dynamic programme over (position, label) picks boundaries and types
together. It is trained by likelihood on TRAINING generated sentences (a fixed
seed, so every run has the same weights), on the driver, and is some 200 numbers.
An entity holds a trigger and has MOST characters at most, so windows of twice as many on either
side of the triggers, widened to whole words, lose nothing. A window is labelled as a whole.

Defined results: null text is the empty text (no spans); texts are read whole, in time
that grows in proportion to them, also where they have no blanks; spans are in code points, end exclusive; spans of one kind don't overlap and spans that the
field adds overlap no others; repeated rows are read each on its own; an empty table
gives no rows; no shuffle.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

KINDS = ("email", "ip", "card", "phone")
#: Words and characters of a segment at most; sentences and rounds of training.
LONGEST, MOST, TRAINING, EPOCHS = 8, 80, 240, 12

# Patterns ----------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Starts inside a run of digits can't be leftmost, and giving back digits can't help: both forms are linear.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        n = int(x) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octet(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) <= 3 and int(x or 0) <= 255


def _digits(x: str) -> str:
    return "".join(_DIGIT.findall(x))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the patterns find, sorted."""
    found = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at)):
            end = m.end()
            found.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() <= 40 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


# The field ---------------------------------------------------------------------

#: Where entities that the patterns miss can be.
_NUMBER = re.compile(r"[0-9](?:[ ().:/_-]{0,3}[0-9]){6,24}")
_DOT = re.compile(r"(?<!\w)[\[({<]?(?:dot|DOT|Dot)[\])}>]?(?!\w)")
_AT = re.compile(r"[\[({<] ?(?:at|AT|At) ?[\])}>]")
_HEX = re.compile(r"[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}")
#: Four short numbers, with any sign for a dot between them; plain dots alone are the patterns'.
_BETWEEN = r" ?(?:[\[({<] ?(?:\.|dot) ?[\])}>]|dot|,|\.) ?"
_FOUR = re.compile(rf"(?i)(?<![0-9])(?!(?:[0-9]+\.){{3}}[0-9])[0-9]{{1,3}}(?:{_BETWEEN}[0-9]{{1,3}}){{3}}(?![0-9])")
#: Addresses with a run of zeros left out; those of four groups and more without one are in _HEX.
_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
_SHORTENED = re.compile(rf"(?<![0-9A-Za-z_])(?:{_GROUPS}::(?:{_GROUPS})?|::{_GROUPS})(?![0-9A-Za-z_])")


def triggers(text: str) -> list[tuple[int, int]]:
    found = [m.span() for p in (_NUMBER, _FOUR) for m in p.finditer(text)] if _DIGIT.search(text) else []
    if "dot" in text or "DOT" in text or "Dot" in text:
        found += [m.span() for m in _DOT.finditer(text)]
    if "[" in text or "(" in text or "{" in text or "<" in text:
        found += [m.span() for m in _AT.finditer(text)]
    if text.count(":") > 2:
        found += [m.span() for m in _HEX.finditer(text)]
    if "::" in text:
        found += [m.span() for m in _SHORTENED.finditer(text)]
    return sorted(found)


_WORD, _SPACE = re.compile(r"\S+"), re.compile(r"\s")
_EDGE = ".,;:!?\"'*$%&#"
_CUES = {
    0: re.compile(r"(?i)(?:e?-?mail|contact|write|reach|an|adresse?)\W*$"),
    1: re.compile(r"(?i)(?:ip|host|server|address|node|gateway)\W*$"),
    2: re.compile(r"(?i)(?:card|visa|mastercard|amex|karte|carte|tarjeta|cc|no|number)\W*$"),
    3: re.compile(r"(?i)(?:tel|phone|call|fax|mobile|cell|whatsapp|telefon|tél|at|number|no)\W*$"),
}
_BAD_CUE = re.compile(r"(?i)(?:id|order|version|isbn|ref|sku|page|serial|ticket|invoice|code|build|issue|seq)\W*$")
_SPELLED = re.compile(r"(?i)[A-Za-z0-9._%+-]+ ?(?:[\[({<] ?at ?[\])}>]|at|@) ?[A-Za-z0-9-]+(?: ?(?:[\[({<] ?dot ?[\])}>]|dot|\.) ?[A-Za-z0-9-]+)*? ?(?:[\[({<] ?dot ?[\])}>]|dot|\.) ?[A-Za-z]{2,6}")
_ENDING = re.compile(r"(?i)(?:com|org|net|edu|gov|io|co|info|de|fr|es|uk|eu)$")
_SIX = re.compile(rf"[0-9A-Fa-f]{{1,4}}(?::[0-9A-Fa-f]{{1,4}}){{3,7}}|{_SHORTENED.pattern}")
_PHONE_SHAPE = re.compile(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}|0[0-9]{1,4}[ /.-][0-9]{3,4}[ .-]?[0-9]{3,5}|00[0-9]{1,2}[ .-][0-9 .-]{7,14}")
_CARD_SHAPE = re.compile(r"[0-9]{4}([./_ -]+)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([./_ -]+)[0-9]{6}\2[0-9]{4,5}")
N_FEATURES = 18


class Segment:
    """Features of one span; `text` has the span and what precedes it."""

    @staticmethod
    def features(span: str, before: str, words: int) -> np.ndarray:
        digits = _digits(span)
        letters = sum(c.isalpha() for c in span)
        shape, four = _PHONE_SHAPE.fullmatch(span), bool(_FOUR.fullmatch(span))
        out = np.zeros((len(KINDS), N_FEATURES))
        common = [1.0, words / LONGEST, letters > 0 and len(digits) > 0, bool(_BAD_CUE.search(before))]
        groups = re.findall(r"[0-9]+", span)
        own = (
            [bool(_SPELLED.fullmatch(span)), bool(_ENDING.search(span)), "dot" in span.lower(), bool(re.search(r"[\[({<]", span)), letters >= 8, len(digits) <= 4],
            [four or bool(_SIX.fullmatch(span)), "::" in span, four, len(groups) == 4 and all(map(_octet, groups)), span.count(":") >= 4, letters == 0],
            [bool(_CARD_SHAPE.fullmatch(span)), 14 <= len(digits) <= 19 and luhn(digits), 14 <= len(digits) <= 19, span[:1] in "3456", letters == 0, len(groups) >= 3],
            [bool(shape), 9 <= len(digits) <= 13, "(" in span, len(groups) >= 3, letters == 0, span[:1] in "(0"],
        )
        for k in range(len(KINDS)):
            cue = bool(_CUES[k].search(before))
            row = [*common, cue, *own[k], bool(own[k][0]) and cue, bool(own[k][0]) and bool(own[k][1]), bool(own[k][0]) and common[3], not own[k][0], bool(span[:1] in _EDGE or span[-1:] in _EDGE), "," in span, bool(re.search(r"[0-9] ?[\[({<]", span))]
            out[k] = row
        return out


def _segments(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, int, np.ndarray]]:
    """(first word, words, start, end, features) of the candidate segments."""
    found = []
    for i in range(len(tokens)):
        before = text[max(0, tokens[i][0] - 16) : tokens[i][0]]
        for n in range(1, min(LONGEST, len(tokens) - i) + 1):
            start, end = tokens[i][0], tokens[i + n - 1][1]
            while end > start and text[end - 1] in _EDGE and text[end - 2 : end] != "::":
                end -= 1
            while start < end and text[start] in _EDGE and text[start : start + 2] != "::":
                start += 1
            span = text[start:end]
            if len(span) <= MOST and triggers(span):
                found.append((i, n, start, end, Segment.features(span, before, n)))
    return found


class Field:
    """weights: (kinds, features); moves: (labels, labels), label 0 is outside."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros((len(KINDS), N_FEATURES)) if weights is None else weights
        self.moves = np.zeros((len(KINDS) + 1,) * 2) if moves is None else moves

    def _scores(self, segments: list) -> np.ndarray:
        return np.stack([(s[4] * self.weights).sum(axis=1) for s in segments]) if segments else np.zeros((0, len(KINDS)))

    def best(self, n: int, segments: list) -> list[tuple[int, int]]:
        """(number of the segment, kind) along the best labelling of n words."""
        labels = len(KINDS) + 1
        top = np.full((n + 1, labels), -np.inf)
        top[0, 0] = 0.0
        back: dict[tuple[int, int], tuple[int, int, int]] = {}
        by_start: dict[int, list[int]] = {}
        for k, s in enumerate(segments):
            by_start.setdefault(s[0], []).append(k)
        scores = self._scores(segments)
        for i in range(n):
            if i not in by_start and np.isinf(top[i, 1:]).all():  # only outside words meet here
                top[i + 1, 0], back[i + 1, 0] = top[i, 0] + self.moves[0, 0], (i, 0, -1)
                continue
            into = top[i][:, None] + self.moves
            arrive, source = into.max(axis=0), into.argmax(axis=0)
            if arrive[0] > top[i + 1, 0]:
                top[i + 1, 0], back[i + 1, 0] = arrive[0], (i, int(source[0]), -1)
            for k in by_start.get(i, ()):
                j = i + segments[k][1]
                for y in range(1, labels):
                    if (value := arrive[y] + scores[k, y - 1]) > top[j, y]:
                        top[j, y], back[j, y] = value, (i, int(source[y]), k)
        path, at, y = [], n, int(top[n].argmax())
        while at:
            i, before, k = back[at, y]
            if k >= 0:
                path.append((k, y - 1))
            at, y = i, before
        return path[::-1]

    def gradient(self, n: int, segments: list, gold: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood; gold: kind by number of the segment."""
        labels = len(KINDS) + 1
        scores = self._scores(segments)
        arcs: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]  # from i: (to, segment, label)
        for i in range(n):
            arcs[i].append((i + 1, -1, 0))
        for k, s in enumerate(segments):
            arcs[s[0]] += [(s[0] + s[1], k, y) for y in range(1, labels)]
        ahead, behind = np.full((n + 1, labels), -np.inf), np.full((n + 1, labels), -np.inf)
        ahead[0, 0], behind[n] = 0.0, 0.0
        value = lambda k, y: 0.0 if k < 0 else scores[k, y - 1]
        arrive = np.zeros((n, labels))
        for i in range(n):
            arrive[i] = np.logaddexp.reduce(ahead[i][:, None] + self.moves, axis=0)
            for j, k, y in arcs[i]:
                ahead[j, y] = np.logaddexp(ahead[j, y], arrive[i, y] + value(k, y))
        leave = np.full((n, labels), -np.inf)  # of what follows when a segment labelled y starts at i
        for i in range(n - 1, -1, -1):
            for j, k, y in arcs[i]:
                leave[i, y] = np.logaddexp(leave[i, y], value(k, y) + behind[j, y])
            behind[i] = np.logaddexp.reduce(self.moves + leave[i][None, :], axis=1)
        whole = np.logaddexp.reduce(ahead[n])
        to_weights, to_moves = np.zeros_like(self.weights), np.zeros_like(self.moves)
        for i in range(n):
            to_moves -= np.exp(ahead[i][:, None] + self.moves + leave[i][None, :] - whole)
        for k, s in enumerate(segments):
            for y in range(1, labels):
                share = np.exp(arrive[s[0], y] + scores[k, y - 1] + behind[s[0] + s[1], y] - whole)
                to_weights[y - 1] -= share * s[4][y - 1]
        i, label, starts = 0, 0, {segments[k][0]: (k, y) for k, y in gold.items()}
        while i < n:
            k, y = starts.get(i, (-1, -1))
            to_moves[label, y + 1] += 1
            label = y + 1
            if k >= 0:
                to_weights[y] += segments[k][4][y]
            i += segments[k][1] if k >= 0 else 1
        return to_weights, to_moves


def generated(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with (start, kind, end) of the entities that the patterns don't find."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(("an", "er", "th", "ou", "sch", "ión", "tre", "le", "on", "st")) for _ in range(rng.randint(1, 3)))

    def card() -> str:
        while not luhn(x := rng.choice("3456") + number(15)):
            pass
        return x

    def entity(kind: int) -> str:
        if kind == 0:
            a, b = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" AT ", " DOT ")])
            host = word() + (b + word() if rng.random() < 0.3 else "")
            return f"{word()}{rng.choice(['', '.' + word(), number(2)])}{a}{host}{b}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io'])}"
        if kind == 1:
            if rng.random() < 0.5:
                groups = [f"{rng.randrange(65536):x}" for _ in range(8)]
                if rng.random() < 0.5:
                    return ":".join(groups)
                a = rng.randrange(7)
                return ":".join(groups[:a]) + "::" + ":".join(groups[a + rng.randint(2, min(7, 8 - a)) :])
            numbers = [str(rng.randrange(10 ** rng.randint(1, 3)) % 256) for _ in range(4)]
            sep = rng.choice(["[.]", " dot ", "(.)", ". ", "[dot]", "(dot)", "dot", ", ", ""])
            return sep.join(numbers) if sep else ".".join(numbers[:3]) + "[.]" + numbers[3]
        if kind == 2:
            x, sep = card(), rng.choice([".", "/", "_", "  "])
            return sep.join((x[:4], x[4:8], x[8:12], x[12:]))
        return rng.choice([f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"0{number(3)} {number(3)} {number(4)}", f"0049 {number(3)} {number(7)}"])

    cues = (["mail", "contact", "write to", ""], ["host", "server", "ip", ""], ["card", "visa", "card no", ""], ["tel", "phone", "call", ""])
    decoys = [
        lambda: number(rng.randint(7, 20)),
        lambda: f"{number(4)}-{number(2)}-{number(2)} {number(2)}:{number(2)}:{number(2)}",
        lambda: f"order {number(3)}-{number(3)}-{number(4)}",
        lambda: f"version {number(1)}.{number(2)}.{number(3)}.{number(4)}",
        lambda: " ".join(number(rng.randint(1, 6)) for _ in range(rng.randint(3, 7))),
        lambda: f"isbn {number(3)}-{number(1)}-{number(5)}-{number(3)}-{number(1)}",
        lambda: f"{word()} dot {word()}",
        lambda: f"meet {word()} at {word()} by the dot",
        lambda: "4000.1111.2222." + number(4),
        lambda: f"ticket {number(4)}/{number(6)}",
        lambda: ":".join(number(2) for _ in range(4)),
        lambda: f"{number(6)} {number(6)}",
        lambda: ", ".join(number(rng.randint(1, 3)) for _ in range(rng.randint(4, 6))),
        lambda: ", ".join(number(rng.randint(1, 2)) for _ in range(4)),
        lambda: f"{rng.choice(('add', 'cafe', 'dec', 'bad', 'ace'))}::{rng.choice(('add', 'fade', 'dec', 'be', 'face'))}",
        lambda: f"{number(2)}:{number(2)}:{number(2)}",
    ]
    out = []
    for _ in range(n):
        text, marks = " ".join(word() for _ in range(rng.randint(1, 4))), []
        for _ in range(rng.choice((0, 1, 1, 2))):
            if rng.random() < 0.5:
                text += " " + rng.choice(decoys)()
            else:
                kind = rng.randrange(4)
                x = entity(kind)
                # numbers with commas are an address only where the text says so
                text += " " + rng.choice(cues[kind][: 3 if "," in x else 4])
                text = text.rstrip() + " "
                marks.append((len(text), kind, len(text) + len(x)))
                text += x
            text += rng.choice(["", ".", ",", ""]) + " " + " ".join(word() for _ in range(rng.randint(1, 3)))
        out.append((text, marks))
    return out


@cache
def trained(n: int = TRAINING, epochs: int = EPOCHS, seed: int = 1) -> Field:
    """By stochastic gradient ascent with per-weight steps and a small penalty."""
    examples = []
    for text, marks in generated(n, seed):
        tokens = [m.span() for m in _WORD.finditer(text)]
        segments = _segments(text, tokens)
        place = {(s[2], s[3]): k for k, s in enumerate(segments)}
        if lost := [text[a:b] for a, _, b in marks if (a, b) not in place]:
            raise ValueError(f"no candidate segment for {lost}")
        gold = {place[a, b]: kind for a, kind, b in marks}
        if segments:
            examples.append((len(tokens), segments, gold))
    field, order = Field(), random.Random(seed)
    seen_w, seen_m = np.full_like(field.weights, 1e-3), np.full_like(field.moves, 1e-3)
    for _ in range(epochs):
        order.shuffle(examples)
        for example in examples:
            gw, gm = field.gradient(*example)
            gw, gm = gw - 0.002 * field.weights, gm - 0.002 * field.moves
            seen_w, seen_m = seen_w + gw * gw, seen_m + gm * gm
            field.weights = field.weights + 0.4 * gw / np.sqrt(seen_w)
            field.moves = field.moves + 0.4 * gm / np.sqrt(seen_m)
    return field


def _windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of whole words that hold a trigger with what may matter on either side, merged."""
    begin = stop = -1
    for start, end in triggers(text):
        if end + 2 * MOST <= stop:
            continue
        a = max(0, start - 2 * MOST)
        while a > stop and a and not text[a - 1].isspace():
            a -= 1  # never back into the window before, so each character is passed once
        if a > stop:
            if stop >= 0:
                yield begin, stop
            begin = a
        after = _SPACE.search(text, min(len(text), max(stop, end + 2 * MOST)))
        stop = after.start() if after else len(text)
    if stop >= 0:
        yield begin, stop


def field_spans(text: str, field: Field) -> list[tuple[int, int, int]]:
    found = []
    for a, b in _windows(text):
        part = text[a:b]
        tokens = [m.span() for m in _WORD.finditer(part)]
        segments = _segments(part, tokens)
        found += [(a + segments[k][2], kind, a + segments[k][3]) for k, kind in field.best(len(tokens), segments)]
    return found


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The patterns' spans, and these with what the field adds."""
    base = base_spans(text)
    taken = [[-1, -1]]  # what the patterns cover, merged
    for a, _, b in base:
        if a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    added = []
    for a, kind, b in field_spans(text, field):
        k = bisect_left(taken, [b, -1]) - 1  # the last stretch that starts before the span ends
        if taken[k][1] <= a:
            added.append((a, kind, b))
    return base, sorted(base + added)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone (of the patterns), base, spans (texts as told() writes them)."""
    weights = docs.sparkSession.sparkContext.broadcast((trained().weights, trained().moves))

    def make():
        field = Field(*weights.value)

        def row(text: str) -> tuple:
            base, every = all_spans(text, field)
            return (*[sum(x[1] == k for x in base) for k in range(len(KINDS))], told(base), told(every))

        return lambda texts: [row(t) for t in texts]

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_texts(docs, id_col, text_col, make, f"{counts}, base string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """`text` with [KIND] for each span; of overlapping spans the first gives the name."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the spans in its text replaced; null texts stay null."""
    weights = docs.sparkSession.sparkContext.broadcast((trained().weights, trained().moves))

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*weights.value)
        for batch in batches:
            texts = [None if t is None else masked(t, all_spans(t, field)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.names[at], pa.array(texts, pa.string()))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names with dots or backquotes don't go to Python
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
