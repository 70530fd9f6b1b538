"""Scalar functions on text, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from . import terms

# Fixed values. What is scrubbed and the marks that take its place; the order matters, as earlier marks hide text from later patterns.
_ID = r"\b(?=(?:%s|a[0-3]))[A-Za-z0-9]{15}(?:[A-Za-z0-9]{3})?\b" % "|".join(vocab.RECORD_ID_PREFIXES)
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_URL = r"(?i)https?://[^\s<>\"']+"
_IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
_MONEY = r"\$[\d,]+\.?\d*"
SCRUBS = ((_ID, "[SF_ID]"), (_EMAIL, "[EMAIL]"), (_URL, "[URL]"), (_IP, "[IP]"), (_MONEY, "[AMOUNT]"))
#: Plain patterns that a text must have for the costly ones to be tried.
_RUN_OF_15, _AT, _DOTTED = "[A-Za-z0-9]{15}", "@", r"\d\.\d"


def _scrubbed(text: Column, pattern: str, mark: str, hint: str | None = None) -> Column:
    out = F.regexp_replace(text, "(?U)" + pattern, mark.replace("$", r"\$"))
    return out if hint is None else F.when(text.rlike("(?U)" + hint), out).otherwise(text)


def scrub_ids(text: Column) -> Column:
    return _scrubbed(text, *SCRUBS[0], _RUN_OF_15)


def scrub_emails(text: Column) -> Column:
    return _scrubbed(text, *SCRUBS[1], _AT)


def scrub_urls(text: Column) -> Column:
    return _scrubbed(text, *SCRUBS[2])


def scrub_ips(text: Column) -> Column:
    return _scrubbed(text, *SCRUBS[3], _DOTTED)


def scrub_money(text: Column) -> Column:
    return _scrubbed(text, *SCRUBS[4])


def anonymize(text: Column, labels: dict[str, str] | None = None) -> Column:
    """Ids, mail and web addresses, IP addresses and amounts, then brand terms by their labels; texts under three characters stay."""
    out = text
    for (pattern, mark), hint in zip(SCRUBS, (_RUN_OF_15, _AT, "(?i)http", _DOTTED, r"\$"), strict=True):
        # as a lambda variable a step's result is evaluated once, though its guard and its pattern both read it
        out = F.get(F.transform(F.array(out), lambda v: _scrubbed(v, pattern, mark, hint)), F.lit(0))
    return F.when(F.length(text) < 3, text).otherwise(terms.scrubbed(out, labels or {}))


def redact(key: str, value: Column) -> Column:
    """What a content key's value becomes: its key and length."""
    return F.concat(F.lit(f"[{key.upper()}:"), F.length(value).cast("string"), F.lit("chars]"))


# Full text ----------------------------------------------------------------------


@cache
def _marked() -> tuple[str, str]:
    """Lower-case letters with marks, of all scripts, and the letters without: what decomposition makes of them."""
    source, target = "", ""
    for code in range(0xC0, 0x10000):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and chr(code).lower() == chr(code) and unicodedata.category(base[0])[0] == "L" and all(unicodedata.category(c) == "Mn" for c in base[1:]):
            source, target = source + chr(code), target + base[0]
    return source, target


def fold(text: Column) -> Column:
    """Lower case without diacritics, as index and query see it; marks that follow their letter go as well."""
    low = F.lower(text)
    return F.when(low.rlike("[^\\x00-\\x7F]"), F.regexp_replace(F.translate(low, *_marked()), r"\p{Mn}+", "")).otherwise(low)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def has_term(text: Column, term: str) -> Column:
    """Whether the tokens of `term` occur next to each other in `text`; a term without any matches nothing."""
    wanted = [t for t in _plain_tokens(term) if t]
    if not wanted:
        return F.lit(False)
    if len(wanted) == 1:
        return F.array_contains(tokens(text), wanted[0])
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")), F.lit(f" {' '.join(wanted)} "))


def has_prefix(text: Column, start: str) -> Column:
    """Whether a token of `text` begins with the last token of `start`, after its others."""
    wanted = _plain_tokens(start)
    if not wanted:
        return F.lit(False)
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens(text), " ")), F.lit(f" {' '.join(wanted)}"))


def _plain_tokens(term: str) -> list[str]:
    folded = term.lower().translate(str.maketrans(*_marked()))
    folded = "".join(c for c in folded if unicodedata.category(c) != "Mn")
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in folded).split()


# Keywords, names ------------------------------------------------------------------


def keywords(text: Column, most: int = 10) -> Column:
    """Distinct words in order, without stop words and outer punctuation, `most` of them."""
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,!?;:()]+|[.,!?;:()]+$", ""))
    kept = F.filter(words, lambda w: (w != "") & ~w.isin(*vocab.STOP_WORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def map_field(ref: Column, target_object: str = "") -> Column:
    """Target name for a field reference: custom fields as they are, paths by their last part, on the target object if one is given."""
    last = F.element_at(F.split(ref, r"\."), -1)
    last = F.concat(F.lit(f"{target_object}."), last) if target_object else last
    return F.when(ref.contains("__c"), ref).when(ref.contains("."), last).otherwise(ref)


def company_core(name: Column) -> Column:
    """Lower-case name without its longest corporate suffix."""
    ends = sorted(vocab.COMPANY_SUFFIXES, key=len, reverse=True)
    lower = F.regexp_replace(F.trim(F.lower(name)), r"[.,;]+$", "")
    pattern = "(?:" + "|".join(x.replace(".", r"\.") for x in ends) + ")$"
    # of endings that fit, the leftmost match is the longest
    return F.regexp_replace(F.trim(F.regexp_replace(lower, pattern, "")), r"[,.]+$", "")


def normalized(name: Column) -> Column:
    clean = F.regexp_replace(name, r"(?U)[^\w\s\-&]", "")
    return F.lower(F.trim(F.regexp_replace(clean, r"\s+", " ")))


def acronym(name: Column) -> Column:
    """Lower-case initials of capitalised words, null if under three."""
    initials = F.array_join(F.transform(F.filter(F.split(name, " "), lambda w: w.rlike(r"^\p{Lu}")), lambda w: F.substring(w, 1, 1)), "")
    return F.when((F.size(F.split(name, " ")) >= 2) & (F.length(initials) >= 3), F.lower(initials))


def distinctive_words(name: Column, generic: list[str]) -> Column:
    """Words of five letters or more of a name of several, without generic ones and numbers."""
    words = F.split(name, " ")
    clean = F.transform(words, lambda w: F.regexp_replace(w, r"^[.,;&-]+|[.,;&-]+$", ""))
    kept = F.filter(clean, lambda w: (F.length(w) >= 5) & ~w.isin(*generic) & ~w.rlike(r"^[0-9]+$"))
    return F.when(F.size(words) >= 2, F.array_distinct(kept)).otherwise(F.array().cast("array<string>"))


def readable(name: Column) -> Column:
    return F.trim(F.replace(name, F.lit("_"), F.lit(" ")))


# Formulas -----------------------------------------------------------------------------


def formula_functions(formula: Column) -> Column:
    """Known functions whose name, before a parenthesis, occurs anywhere (also inside longer names)."""
    upper = F.upper(formula)
    return F.filter(F.array(*map(F.lit, vocab.FORMULA_FUNCTIONS)), lambda f: F.contains(upper, F.concat(f, F.lit("("))))


def condition_count(formula: Column) -> Column:
    upper = F.upper(formula)
    return F.regexp_count(upper, F.lit(r"AND\(")) + F.regexp_count(upper, F.lit(r"OR\(")) + 1


def nesting_depth(text: Column) -> Column:
    """The greatest number of open parentheses."""
    steps = F.split(F.regexp_replace(text, "[^()]", ""), "")
    state = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, c: F.struct(
            (s["now"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("now"),
            F.greatest(s["most"], s["now"] + F.when(c == "(", 1).otherwise(0)).alias("most"),
        ),
    )
    return state["most"]


def formula_fields(formula: Column) -> Column:
    """Custom fields, fields behind $ variables, and Object.Field paths, sorted."""
    every = F.array_union(
        F.array_union(
            F.regexp_extract_all(formula, F.lit(r"(?U)\b(\w+__[cr])\b"), F.lit(1)),
            F.regexp_extract_all(formula, F.lit(r"(?U)\$\w+\.(\w+)"), F.lit(1)),
        ),
        F.regexp_extract_all(formula, F.lit(r"(?U)\b([A-Z]\w+\.[A-Z]\w+)\b"), F.lit(1)),
    )
    return F.array_sort(every)


# Scores, tags, hashes -------------------------------------------------------------------


def complexity(factors: dict[str, Column]) -> Column:
    """1 to 5 from weighted counts."""
    score = F.lit(0.0)
    for name, count in factors.items():
        score = score + count * F.lit(float(vocab.COMPLEXITY_WEIGHTS.get(name, 1)))
    out = None
    for k, step in enumerate(vocab.COMPLEXITY_STEPS, 1):
        out = F.when(score <= step, k) if out is None else out.when(score <= step, k)
    return out.otherwise(len(vocab.COMPLEXITY_STEPS) + 1)


def auto_tags(kind: Column, category: Column, source_object: Column, api_version: Column, score: Column) -> Column:
    return F.array_compact(
        F.array(
            kind,
            F.replace(F.lower(category), F.lit(" "), F.lit("-")),
            F.when((source_object != "") & (source_object != "Unknown"), F.lower(source_object)),
            F.when(api_version != "", F.concat(F.lit("api-v"), api_version)),
            F.when(score >= 4, F.lit("complex")),
            F.when(score <= 1, F.lit("simple")),
        )
    )


def short_hash(text: Column, chars: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, chars)


def complexity_label(score: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, vocab.COMPLEXITY_LABELS)), F.least(score, F.lit(5)))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def shortened(text: Column, most: int = 40) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(done / total * 100, 1)).otherwise(F.lit(0.0))


def json_ids(text: Column) -> Column:
    """The array of ids inside free text, empty where there is none."""
    return F.coalesce(F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), "array<long>"), F.array().cast("array<long>"))
