"""Many terms at once: a trie as one pattern, and a table of labels that is looked up by hash.

A flat alternation is tried term by term at each place of a text. In a trie each character of the
text rules out all terms but those that go on with it, so the time for a text doesn't
grow with the number of terms.

Where the terms are themselves a table, texts and terms meet by keys (`keys`, `key`), so that a text
gets just those terms that it may have, which `replacer` then looks for.
"""

from __future__ import annotations

import json
import re
import string
import zlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms to a bucket of the label table, on average.
PER_BUCKET = 4
_MARK = "\ue000"
BUCKETS = "array<struct<terms:array<string>,labels:array<string>>>"
UNKNOWN = "[BRAND]"
#: What [a-zA-Z] is in a pattern that ignores case, by whether only a to z have capital letters; else long s, the Kelvin sign and both odd i are folded to letters.
_LETTERS = {False: "a-zA-Z\u017f\u212a\u0131\u0130", True: "a-zA-Z"}
_RUNS = {k: re.compile(f"[{x}]+|[^{x}]+") for k, x in _LETTERS.items()}
_PIECES = {k: re.compile(f"[{x}]+|[^{x}]") for k, x in _LETTERS.items()}
_CAPITALS, _SMALL = string.ascii_uppercase, string.ascii_lowercase
_ASCII_FOLDS = str.maketrans(_CAPITALS, _SMALL)
#: Characters of a key that has no letter.
GRAM = 3


def trie_pattern(terms: list[str]) -> str:
    """A pattern, for Java and Python, of any of the terms whatever their case, the longest that fits, that no letter adjoins.

    Where the longest one at a place is followed by a letter, shorter ones are tried there, as in a list
    of terms that has the longest first.
    """
    root: dict = {}
    for term in sorted({t.lower() for t in terms}):
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}
    return f"(?iu)(?<![a-zA-Z])(?:{_written(root)})(?![a-zA-Z])"


def _written(root: dict) -> str:
    """Depth first with a stack of its own, as terms may be longer than Python's."""
    done: dict[int, str] = {}
    stack = [root]
    while stack:
        node = stack[-1]
        waiting = [n for n in node.values() if n and id(n) not in done]
        if waiting:
            stack += waiting
            continue
        stack.pop()
        parts = [_escaped(c) + done.pop(id(n), "") for c, n in sorted(node.items()) if c]
        if "" in node:
            done[id(node)] = f"(?:{'|'.join(parts)})?" if parts else ""
        else:
            done[id(node)] = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return done[id(root)]


def _escaped(c: str) -> str:
    return c if c.isalnum() or c == "_" else "\\" + c


def label_buckets(labels: dict[str, str]) -> list[dict[str, list[str]]]:
    """Labels by lower-case term, dealt to buckets by the terms' hashes."""
    buckets: list[dict[str, list[str]]] = [{"terms": [], "labels": []} for _ in range(max(1, len(labels) // PER_BUCKET))]
    for term, label in labels.items():
        bucket = buckets[zlib.crc32(term.encode()) % len(buckets)]
        bucket["terms"].append(term)
        bucket["labels"].append(label)
    return buckets


def label_of(hit: Column, buckets: Column) -> Column:
    """The label of a lower-case term, null where it has none: one bucket is looked at."""
    bucket = F.get(buckets, F.pmod(F.crc32(hit.cast("binary")), F.size(buckets)).cast("int"))
    place = F.array_position(bucket["terms"], hit).cast("int")
    return F.get(bucket["labels"], F.when(place > 0, place - 1))


def replaced(text: Column, pattern: Column, buckets: Column, unknown: str = UNKNOWN) -> Column:
    """`text` with each match's label in its place, in one pass.

    Matches are put between marks, by which the text is then split: of Spark's functions, replacing keeps
    a pattern compiled from row to row, splitting and testing don't. Texts with a mark of their own are split by the pattern.
    """

    def label(hit: Column) -> Column:
        return F.coalesce(label_of(F.lower(hit), buckets), F.lit(unknown))

    def by_marks(marked: Column) -> Column:
        return F.array_join(F.transform(F.split(marked, _MARK), lambda x, i: F.when(i % 2 == 0, x).otherwise(label(x))), "")

    marked = F.get(F.transform(F.array(F.regexp_replace(text, pattern, F.lit(f"{_MARK}$0{_MARK}"))), by_marks), F.lit(0))
    hits, parts = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    # there is one part more than there are hits
    by_pattern = F.array_join(F.zip_with(parts, hits, lambda x, h: F.when(h.isNull(), x).otherwise(F.concat(x, label(h)))), "")
    return F.when(text.isNull(), text).when(F.contains(text, F.lit(_MARK)), by_pattern).otherwise(marked)


def scrubbed(text: Column, labels: dict[str, str]) -> Column:
    """Labels for terms that no letter adjoins, whatever their case, longest first; `labels` is one project's table."""
    labels = {t: label for t, label in labels.items() if t}
    if not labels:
        return text
    low = {t.lower(): labels[t] for t in sorted(labels, key=lambda t: (len(t), t), reverse=True)}
    table = F.from_json(F.lit(json.dumps(label_buckets(low))), BUCKETS)
    return replaced(text, F.lit(trie_pattern(list(labels))), table)


class _Folds(dict):
    """Of code points, what patterns that ignore case compare: the small letter of the capital one."""

    def __missing__(self, c: int) -> str:
        up = chr(c).upper()
        low = (up if len(up) == 1 else chr(c)).lower()
        self[c] = low if len(low) == 1 else "i"  # just U+0130 has a longer one
        return self[c]


_folds = _Folds()


def _folded(text: str, ascii_only: bool) -> str:
    return text.lower() if text.isascii() else text.translate(_ASCII_FOLDS if ascii_only else _folds)


def _lower(text: str, ascii_only: bool) -> str:
    """What labels are found by: see `lowered`."""
    return text.translate(_ASCII_FOLDS) if ascii_only else text.lower()


def lowered(term: Column, ascii_only: bool = False) -> Column:
    return F.translate(term, _CAPITALS, _SMALL) if ascii_only else F.lower(term)


def _is_word(folded: str) -> bool:
    return "a" <= folded[0] <= "z"


def keys(texts: Iterable[str | None], ascii_only: bool = False) -> set[str]:
    """Of texts, all that `key` may be of a term that they have: words, and up to GRAM characters of what lies between."""
    runs: set[str] = set()
    for text in texts:
        runs.update(_RUNS[ascii_only].findall(text or ""))
    found = set()
    for run in (_folded(x, ascii_only) for x in runs):
        if _is_word(run):
            found.add(run)
        else:
            found.update(run[i : i + n] for n in range(1, GRAM + 1) for i in range(len(run) - n + 1))
    return found


def key(term: str, ascii_only: bool = False) -> str:
    """A term's longest word, which is a whole word wherever the term is found; the first characters of one that has no letter."""
    folded = _folded(term, ascii_only)
    words = [run for run in _RUNS[ascii_only].findall(folded) if _is_word(run)]
    return max(words, key=len) if words else folded[:GRAM]


class _Words(dict):
    """What stands for each run of a text, where all terms are single words."""

    def __init__(self, labels: dict[str, str], whole: set[str], ascii_only: bool):
        self.labels, self.whole, self.ascii_only = labels, whole, ascii_only

    def __missing__(self, run: str) -> str:
        self[run] = self.labels.get(_lower(run, self.ascii_only), UNKNOWN) if _folded(run, self.ascii_only) in self.whole else run
        return self[run]


def replacer(labels: dict[str, str], ascii_only: bool = False) -> Callable[[str], str]:
    """What puts labels (by term as `lowered`) for the terms in a text, as `replaced` does: longest first, where no letter adjoins.

    Words of a term are whole words of the text, so they are compared whole, in a trie of words and other characters.
    With `ascii_only` just a to z have capital letters and are letters, as in patterns that ignore the case of ASCII alone.
    """
    runs, parts = _RUNS[ascii_only], _PIECES[ascii_only]
    whole = {_folded(t, ascii_only) for t in labels}
    if all(_is_word(t) and runs.fullmatch(t) for t in whole):
        words = _Words(labels, whole, ascii_only)
        return lambda text: "".join(map(words.__getitem__, runs.findall(text)))
    root: dict = {}
    for term in whole:
        node = root
        for piece in parts.findall(term):
            node = node.setdefault(piece, {})
        node[""] = {}

    def end(folded: list[str], i: int) -> int:
        """Where the longest term at i ends, 0 if there is none."""
        node, found = root.get(folded[i]), 0
        if node is None or i and not _is_word(folded[i]) and _is_word(folded[i - 1]):
            return 0
        for j in range(i + 1, len(folded) + 1):
            if "" in node and (j == len(folded) or _is_word(folded[j - 1]) or not _is_word(folded[j])):
                found = j
            node = node.get(folded[j]) if j < len(folded) else None
            if node is None:
                break
        return found

    def replace(text: str) -> str:
        pieces = parts.findall(text)
        folded, done, i = [_folded(x, ascii_only) for x in pieces], [], 0
        while i < len(pieces):
            j = end(folded, i)
            done.append(labels.get(_lower("".join(pieces[i:j]), ascii_only), UNKNOWN) if j else pieces[i])
            i = j or i + 1
        return "".join(done)

    return replace
