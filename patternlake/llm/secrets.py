"""Secret scans: a pattern finds candidates, a random forest removes false positives.

A candidate is a run of at least SHORTEST characters of the alphabets in which keys and
tokens are written, or what its context makes one whatever its characters: the value after a
cue such as password or key (quoted, or up to the next blank), the password or token before
the @ of an address, each of at least FLOOR characters, and a quoted value without blanks of
at least QUOTED. A run ends where such a value starts that
reaches its end; other candidates may lie in each other. Its features, over the whole of it, are its length, the
likelihood of its letter transitions under the words of a dictionary, the share that such words cover, shares of
character classes, entropy, whether it lies in a path or address, and the words around it. The dictionary is
what the vocabulary file of a public tokenizer has of whole words of four letters or more. The forest is Spark's, trained
on LABELLED findings that are generated with labels from a fixed seed; their number bounds what
the driver holds.

Defined results: null text has no findings; texts and candidates are read whole, however long; positions are code
points, end exclusive; repeated rows are scanned each; an empty table gives no rows; no
shuffle of documents; columns other than id and text are ignored.
"""

from __future__ import annotations

import base64
import math
import random
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHORTEST, LABELLED, TREES, DEPTH = 20, 3000, 30, 8
FLOOR, QUOTED = 4, 8
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{%d,}" % SHORTEST)
#: A cue with what may stand between it and its value.
_NAMED = re.compile(
    r"(?i)(?:token|secret|passw|passphrase|passcode|pwd|key|auth|bearer|credential|private|signature)[\w-]{0,30}[\"'`]?\]?\s{0,4}(?:=>|:=|==|[=:])\s{0,4}"
    r"|\b(?:password|passwd|passphrase|passcode|pwd|secret|token|bearer|key)(?:[ \t]{1,4}is)?[ \t]{1,4}"
)
_IN_QUOTES = {q: re.compile(rf"{q}((?:\\.|[^{q}\\\r\n])*){q}") for q in "\"'`"}
#: Up to a blank, a quote or the next name of a list such as a query string.
_PLAIN = re.compile(r"(?:(?![&;,|?][\w.-]{1,40}[=:])[^\s\"'`<>])+")
_QUOTED = re.compile(r"([\"'`])([^\s\"'`]{%d,})\1" % QUOTED)
_USERINFO = re.compile(r"://([^\s/\"'<>]+)@")
_PLACEHOLDER = re.compile(r"(?i)[$%%<{\[(*]|x{3,}|(?:your|example|change_?me|none|null|nil|true|false|required|optional|string|str|int)\b|\w+[.(\[][A-Za-z_\"']".replace("%%", "%"))
_LETTERS = re.compile(r"[a-z]{3,}")
_CUE = re.compile(r"(?i)token|secret|passw|pwd|api|key|auth|bearer|credential|private|signature")
#: Right before a value.
_SECRET_CUE = re.compile(r"(?i)(?:passw\w*|passphrase|passcode|pwd|secret\w*|token|(?:api|access|auth|private|secret)[_ -]?key)[\"'`]?\]?\s*(?:=>|:=|==|[=:]|is)?\s*[\"'`]?$")
_INNOCENT = re.compile(r"(?i)commit|sha|md5|checksum|digest|uuid|guid|etag|hash|revision|build|image|data:|file|path|href|src|id\b")
#: The tokenizer file that gives the dictionary, and the letters of its words.
VOCABULARY, WORD_LETTERS = "byte_bpe_multi_50k.tiktoken", (4, 16)
#: Names for generated findings.
_NAMES = (
    "time people year good work first well even give most day world service config module handler request response version user account manager controller "
    "application information description international development nicht haben werden aussi entre donde cuando"
).split()
_CLASS = {c: 0 for c in string.ascii_lowercase} | {c: 1 for c in string.ascii_uppercase} | {c: 2 for c in string.digits}


@cache
def dictionary(path: str | None = None) -> frozenset[str]:
    """The lower-case words that follow a blank in a vocabulary of ranks."""
    shortest, longest = WORD_LETTERS
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
        words = (base64.b64decode(line.split()[0]).decode("utf-8", "replace") for line in lines if line.strip())
        return frozenset(w[1:] for w in words if w[:1] == " " and shortest < len(w) <= longest + 1 and w[1:].isalpha() and w.islower())


@cache
def _transitions() -> np.ndarray:
    """Log-likelihood of letter pairs, from the dictionary, smoothed; 26 is any other character."""
    seen = np.full((27, 27), 0.3)
    for word in dictionary():
        codes = _letters(word)
        np.add.at(seen, (codes[:-1], codes[1:]), 1)
    return np.log(seen / seen.sum(axis=1, keepdims=True))


def _letters(low: str) -> np.ndarray:
    codes = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32).astype(np.int64) - 97
    return np.where((codes >= 0) & (codes < 26), codes, 26)


def covered(low: str) -> int:
    """Characters that words of the dictionary cover, taking the longest at each place from the left."""
    words, (shortest, longest) = dictionary(), WORD_LETTERS
    at = total = 0
    while at <= len(low) - shortest:
        step = next((k for k in range(min(longest, len(low) - at), shortest - 1, -1) if low[at : at + k] in words), 0)
        total += step
        at += step or 1
    return total


def features(text: str, start: int, end: int) -> list[float]:
    span, low = text[start:end], text[start:end].lower()
    before, after = text[max(0, start - 40) : start], text[end : end + 12]
    n = len(span)
    classes = np.fromiter((_CLASS.get(c, 3) for c in span), np.int64, n)
    counts = Counter(span)
    codes = _letters(low)
    near = before[-24:]
    return [
        math.log2(n),
        *(float((classes == k).mean()) for k in range(3)),
        float((classes[1:] != classes[:-1]).mean()),
        float(_transitions()[codes[:-1], codes[1:]].mean()),
        covered(low) / n,
        max((len(x) for x in _LETTERS.findall(low)), default=0) / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        len(counts) / n,
        float(all(c in "0123456789abcdef" for c in low)),
        float(span.count("/") + span.count(".")) / n * 10,
        float(span.count("-") + span.count("_")) / n * 10,
        float(bool(re.search(r"(?:[/\\]|https?:|www\.)\S*$", before)) or after[:1] in ("/", "\\")),
        float(bool(_CUE.search(near))),
        float(bool(_INNOCENT.search(near))),
        float(before.rstrip()[-1:] in ('"', "'", "`") and after[:1] in ('"', "'", "`")),
        float(bool(re.search(r"[=:]\s*[\"'`]?$", before))),
        float(bool(re.match(r"(?:AKIA|ASIA|ghp_|gho_|glpat-|sk_live_|sk-|xox[bp]-|eyJ|AIza)", span))),
        float(bool(re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))),
        float(bool(_PLACEHOLDER.match(span))),
        float(bool(re.search(r"://[^\s/]*$", before)) and after[:1] == "@"),
        float(any(c.isspace() for c in span)),
        float(bool(_SECRET_CUE.search(near))),
    ]


def values(text: str) -> Iterator[tuple[int, int]]:
    """What the context makes a candidate; in time linear in the text.

    A value without quotes is a candidate as a whole. What a name inside it introduces is one
    of its own, up to the next such name, however long the value.
    """
    run, m = 0, _NAMED.search(text)  # where the last value without quotes ends
    while m:
        start, end = m.end(), -1
        following = _NAMED.search(text, start)
        mark = text[start : start + 1]
        if mark in _IN_QUOTES and (quoted := _IN_QUOTES[mark].match(text, start)):
            yield quoted.span(1)
        elif start < run:
            end = min(run, following.start()) if following else run
        elif plain := _PLAIN.match(text, start + (mark in _IN_QUOTES)):
            start, end = plain.span()
            run = end
        if end >= 0:
            while end > start and text[end - 1] in ".=~-,;:)]}" and text[end - 2 : end] != "==":
                end -= 1
            yield start, end
        m = following
    for m in _QUOTED.finditer(text):
        yield m.span(2)
    for m in _USERINFO.finditer(text):
        yield m.start(1) + m[1].find(":") + 1, m.end(1)


def candidates(text: str) -> list[tuple[int, int]]:
    found = {(a, b) for a, b in values(text) if b - a >= FLOOR}
    ends: dict[int, int] = {}
    for a, b in found:
        ends[a] = max(b, ends.get(a, 0))
    starts = sorted(ends)
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while end > start and text[end - 1] in ".=~-" and not text[end - 2 : end] == "==":
            end -= 1
        # what a value has to the end of the run, with padding or a name before it, isn't a candidate twice
        for a in starts[bisect_left(starts, start) : bisect_left(starts, end)]:
            if ends[a] >= end:
                end = a
                break
        if end - start >= SHORTEST:
            found.add((start, end))
    return sorted(found)


def labelled(n: int, seed: int) -> Iterator[tuple[str, int, int, int]]:
    """(text, start, end, 1 for a secret) of generated findings."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexa, base, alnum = string.hexdigits[:16], string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve tion ment ing eau oi ung sch heit ción mente que ado ez".split()
    long_word = lambda k: "".join(rng.choice(syllables) for _ in range(40))[:k]
    name = lambda: rng.choice(_NAMES)
    cues = ("password", "passwd", "pwd", "secret", "SECRET", "db_password", "PASSWORD", "api_key", "passphrase", "token")

    def password() -> str:
        if rng.random() < 0.4:
            return pick(alnum + "!$%&*#?^", rng.randint(7, 24))
        x = "".join(rng.choice((name(), long_word(rng.randint(3, 7)))) for _ in range(rng.randint(1, 2)))
        x = rng.choice((x, x.capitalize(), x.replace("o", "0").replace("e", "3")))
        return x + pick(string.digits, rng.randint(1, 4)) + rng.choice(("", "", pick("!$%&*#?", 1), pick("!$&#", 1) + pick(string.digits, 1)))

    def quoted(cue: str, value: str) -> tuple[str, str, str]:
        q = rng.choice(('"', "'", "", ""))
        return cue + rng.choice((" = ", ": ", "=", " := ")) + q, value, q

    secrets = [
        lambda: (rng.choice(("token", "api_key", "secret", "auth_token", "access_key", "password", "client_secret")) + rng.choice((' = "', ": '", "=", ": ", ' : "')), pick(hexa, rng.choice((32, 40, 40, 40, 48, 64))), rng.choice(('"', "'", "", " "))),
        lambda: (rng.choice(("key=", "aws_secret_access_key = ", 'secret: "', "Authorization: Bearer ", "")), pick(base, rng.choice((40, 44, 32))), ""),
        lambda: (rng.choice(("", "id ", "key: ")), "AKIA" + pick(string.ascii_uppercase + string.digits, 16), ""),
        lambda: (rng.choice(("", "token ", "use ")), rng.choice(("ghp_", "glpat-", "sk_live_", "xoxb-", "AIza", "sk-")) + pick(alnum, rng.choice((24, 32, 36))), ""),
        lambda: (rng.choice(("jwt ", "bearer ", "")), "eyJ" + pick(alnum, 30) + "." + pick(alnum, 60) + "." + pick(alnum, 43), ""),
        lambda: (rng.choice(("PASSWORD=", "pwd: ", 'passwd = "')), pick(alnum + "_-", rng.randint(20, 30)), ""),
        lambda: quoted(rng.choice(cues), password()),
        lambda: quoted(rng.choice(cues), password()),
        lambda: (rng.choice(("password", "token", "pwd", "secret", "passcode", "api_key")) + rng.choice((": ", "=", " is ", " ")), password(), ""),
        lambda: quoted(rng.choice(("api_key", "access_key", "token", "secret", "client_secret")), pick(rng.choice((hexa, alnum)), rng.randint(8, 19))),
        lambda: (rng.choice(("postgres", "mysql", "https", "redis", "amqp")) + "://" + rng.choice((name() + ":", ":")), password(), "@" + name() + rng.choice(("", ".example.com", ":5432/" + name()))),
        lambda: (rng.choice(("connect('app', '", "login('", "auth('me', '")), pick(alnum + "!$%&*#@?", rng.randint(12, 24)), "')"),
        lambda: (rng.choice(('passphrase = "', 'password: "')), " ".join(name() for _ in range(rng.randint(4, 6))), '"'),
    ]
    decoys = [
        lambda: (" ", long_word(rng.randint(20, 45)), rng.choice((" ", ".", ","))),
        lambda: (". ", long_word(rng.randint(20, 40)).capitalize(), " "),
        lambda: (rng.choice(("commit ", "sha1 ", "revision ", "build ", "tree ")), pick(hexa, 40), ""),
        lambda: (rng.choice(("md5: ", "checksum ", 'etag: "', "sha256:", "hash=")), pick(hexa, rng.choice((32, 64))), '"'),
        lambda: (rng.choice(("uuid ", "id=", "", "key ")), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), ""),
        lambda: (rng.choice(("/", "src=", "file ", "see ", "./")), "/".join(name() for _ in range(rng.randint(4, 8))) + rng.choice((".py", ".html", "", ".js")), ""),
        lambda: ("https://", "www." + name() + ".example.com/" + "/".join(name() for _ in range(4)), ""),
        lambda: ("", pick("=-_", 1) * rng.randint(20, 60), ""),
        lambda: ("number ", pick(string.digits, rng.randint(20, 30)), ""),
        lambda: (rng.choice(("class ", "call ", "token = ")), "".join(name().capitalize() for _ in range(rng.randint(4, 7))), "("),
        lambda: (rng.choice(("set ", "key ", "token: ")), "_".join(name() for _ in range(rng.randint(4, 7))), " ="),
        lambda: ("data:image/png;base64,", pick(base, 160), ""),
        lambda: (" ", rng.choice(syllables) * rng.randint(11, 20), " "),
        lambda: (" ", "-".join(name() for _ in range(rng.randint(5, 8))), " "),
        lambda: (rng.choice(("key", "token", "the secret", "password", "auth", "private", "keyboard", "author")) + rng.choice((" ", " is ", ": ")), rng.choice((name(), long_word(rng.randint(4, 12)))), rng.choice((" ", ".", ","))),
        lambda: quoted(rng.choice(("key", "keyword", "sort_key", "primary_key", "author", "token_type")), rng.choice((name(), name() + "_" + name(), long_word(rng.randint(4, 12))))),
        lambda: quoted(rng.choice(cues), rng.choice(("None", "null", "required", "string", "${" + name().upper() + "}", "<your-" + name() + ">", "********", "xxxxxxxx", "request." + name(), "os.environ['" + name() + "']", "get_" + name() + "()", "{{ " + name() + " }}", "example"))),
        lambda: (rng.choice(("= '", '("', ': "', "`")), rng.choice((long_word(rng.randint(8, 18)), name() + "_" + name() + "_" + name(), name() + "." + name() + "." + name(), pick(string.digits, 4) + "-" + pick(string.digits, 2) + "-" + pick(string.digits, 2))), rng.choice(('"', "'", "`"))),
        lambda: (rng.choice(("key: ", "max_tokens = ", "tokens: ", "key = ")), pick(string.digits, rng.randint(4, 6)), ""),
        lambda: ("https://", name() + "@" + name(), ".example.com"),
    ]
    while n > 0:
        secret = rng.random() < 0.45
        before, span, after = rng.choice(secrets if secret else decoys)()
        lead = " ".join(name() for _ in range(rng.randint(0, 5))) + " "
        text = lead + before + span + after + " " + name()
        for a, b in candidates(text):
            n -= 1
            yield text, a, b, int(secret and a < len(lead) + len(before) + len(span) and b > len(lead) + len(before))


def train(spark: SparkSession, n: int = LABELLED, seed: int = 3) -> RandomForestClassificationModel:
    rows = [(features(t, a, b), float(y)) for t, a, b, y in labelled(n, seed)]
    frame = spark.createDataFrame(rows, "f array<double>, label double").select(array_to_vector("f").alias("features"), "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(frame)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: RandomForestClassificationModel | None = None) -> DataFrame:
    """id, start, end, score (the forest's share for a secret) and is_secret of every candidate."""
    model = model or train(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, a, b, features(t, a, b)) for k, t in enumerate(batch["t"].to_pylist()) for a, b in candidates(t)]
            row, start, end, f = ([x[c] for x in found] for c in range(4))
            arrays = [batch["i"].take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(f, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["i", "start", "end", "f"])

    given = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = given.schema["i"].dataType.simpleString()
    found = given.mapInArrow(run, f"i {kind}, start long, end long, f array<double>")
    scored = model.transform(found.withColumn("features", array_to_vector("f")))
    score = F.get(vector_to_array("probability"), F.lit(1))
    return scored.select(F.col("i").alias(id_col), "start", "end", score.alias("score"), (F.col("prediction") == 1).alias("is_secret"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that remain."""
    return find_secrets(table(spark, sf_dir, "documents")).where("is_secret").select("doc_id", "start", "end", F.round("score", 6).alias("score"))
