"""Language of a text by a bidirectional gated recurrent network over its UTF-8 bytes.

The network reads a stretch of bytes forwards and backwards; at each byte both states give
the log probabilities of the languages, which is the label of that position. A document's
probabilities pool those of all its positions. A long text is read in stretches of STRETCH
bytes, each with fresh states, so that its time is linear and many stretches go through
numpy at once; the last one starts early enough to be full, and a position is counted once.

`fit` learns by backpropagation through time, in numpy on the driver, from a sample that is
bounded: PER_LANGUAGE documents of each language, and of each EXCERPT characters at a place
that a hash of its id chooses. All else covers every byte of every text.

Defined results: a text that is null or has no letter is `und` with score 0, as is every
text where nothing could be learned (an empty table, no languages); with one language every
other text has it; a null language teaches nothing; repeated rows are judged one by one; tied
languages fall to the one that sorts first; columns of other names are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .hashing import bytes_of

#: Documents of each language to learn from, at most, and characters of each.
PER_LANGUAGE, EXCERPT = 400, 400
UNITS, STRETCH, TOGETHER = 8, 128, 1024
BATCH, LENGTH, STEPS, RATE = 192, 64, 260, 0.02
UNKNOWN = "und"


@dataclass(frozen=True)
class Network:
    """For each direction d: embed[d] (gates, bytes) and turn[d] (gates, units); then out (languages, both units), bias.

    Gates are update, reset and candidate, UNITS rows each.
    """

    languages: tuple[str, ...]
    embed: np.ndarray
    turn: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) + np.float32(0.5) * np.tanh(np.float32(0.5) * x)


def _log_softmax(x: np.ndarray, axis: int) -> np.ndarray:
    x = x - x.max(axis=axis, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=axis, keepdims=True))


# Learning ---------------------------------------------------------------------------


def _forward(embed: np.ndarray, turn: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each of the bytes x (steps, rows): (steps + 1, units, rows), and what the way back needs."""
    h = turn.shape[1]
    states = np.zeros((len(x) + 1, h, x.shape[1]), np.float32)
    kept = []
    for t, now in enumerate(x):
        a, s = embed[:, now], turn @ states[t]
        gates = _sigmoid(a[: 2 * h] + s[: 2 * h])
        new = np.tanh(a[2 * h :] + gates[h:] * s[2 * h :])
        states[t + 1] = new + gates[:h] * (states[t] - new)
        kept.append((gates, new, s[2 * h :]))
    return states, kept


def _backward(turn: np.ndarray, x: np.ndarray, states: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of embed and turn, where dout (steps, units, rows) is the loss's gradient by each state."""
    h = turn.shape[1]
    back, dturn = np.zeros_like(states[0]), np.zeros_like(turn)
    dgates = np.zeros((len(x), 3 * h, x.shape[1]), np.float32)
    for t in range(len(x) - 1, -1, -1):
        (gates, new, s), d = kept[t], back + dout[t]
        z, r = gates[:h], gates[h:]
        dnew = d * (1 - z) * (1 - new * new)
        dgates[t, :h] = d * (states[t] - new) * z * (1 - z)
        dgates[t, h : 2 * h] = dnew * s * r * (1 - r)
        dgates[t, 2 * h :] = dnew
        ds = dgates[t].copy()
        ds[2 * h :] *= r
        dturn += ds @ states[t].T
        back = d * z + turn.T @ ds
    flat, seen = dgates.transpose(1, 0, 2).reshape(3 * h, -1), x.reshape(-1)
    dembed = np.stack([np.bincount(seen, row, 256) for row in flat]).astype(np.float32)
    return dembed, dturn


def gradients(net: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over all positions of x (steps, rows), of languages y, and its gradient by every weight."""
    steps, rows = x.shape
    ways = [(0, x), (1, x[::-1])]
    run = [_forward(net["embed"][d], net["turn"][d], seen) for d, seen in ways]
    both = np.concatenate([run[0][0][1:], run[1][0][1:][::-1]], axis=1)
    log_p = _log_softmax(np.matmul(net["out"], both) + net["bias"][:, None], 1)
    right = np.zeros((len(net["bias"]), rows), np.float32)
    right[y, np.arange(rows)] = 1
    loss = -float((log_p * right).sum()) / (steps * rows)
    dlogit = (np.exp(log_p) - right) / np.float32(steps * rows)
    dboth = np.matmul(net["out"].T, dlogit)
    h = net["turn"].shape[2]
    parts = [_backward(net["turn"][d], seen, *run[d], dboth[:, :h] if d == 0 else dboth[::-1, h:]) for d, seen in ways]
    return loss, {
        "embed": np.stack([p[0] for p in parts]),
        "turn": np.stack([p[1] for p in parts]),
        "out": np.einsum("tlb,thb->lh", dlogit, both, optimize=True),
        "bias": dlogit.sum((0, 2)),
    }


def fit(texts: list[bytes], names: list[str], units: int = UNITS, seed: int = 11, steps: int = STEPS) -> Network | None:
    """A network that tells the names of these texts apart; None where there are none."""
    pairs = sorted((t, n) for t, n in zip(texts, names) if t)
    languages = tuple(sorted({n for _, n in pairs}))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    k = len(languages)
    net = {
        "embed": rng.normal(0, 0.3, (2, 3 * units, 256)).astype(np.float32),
        "turn": rng.normal(0, units**-0.5, (2, 3 * units, units)).astype(np.float32),
        "out": rng.normal(0, units**-0.5, (k, 2 * units)).astype(np.float32),
        "bias": np.zeros(k, np.float32),
    }
    by_language = [[np.frombuffer(t, np.uint8) for t, n in pairs if n == x] for x in languages]
    first, second = ({n: np.zeros_like(w) for n, w in net.items()} for _ in range(2))
    for step in range(1, steps + 1 if k > 1 else 1):
        y = (np.arange(BATCH) + (step - 1) * BATCH) % k  # every language as often as any other
        x = np.zeros((BATCH, LENGTH), np.uint8)
        for row, language in enumerate(y):
            text = by_language[language][rng.integers(len(by_language[language]))]
            at = rng.integers(max(1, len(text) - LENGTH + 1))
            piece = text[at : at + LENGTH]
            x[row, : len(piece)] = piece
        _, slope = gradients(net, np.ascontiguousarray(x.T), y)
        rate = RATE * min(1, 2 * (1 - (step - 1) / steps))
        for n, g in slope.items():
            g = np.clip(g, -1, 1)
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.99 * second[n] + 0.01 * g * g
            net[n] = (net[n] - rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(languages, net["embed"], net["turn"], net["out"], net["bias"])


# Reading ----------------------------------------------------------------------------


def _states(embed: np.ndarray, turn: np.ndarray, x: np.ndarray) -> np.ndarray:
    """States after each byte; sigmoids are taken as halved hyperbolic tangents, so that two gates need one call."""
    h, n = turn.shape[1], x.shape[1]
    scale = np.repeat(np.array([0.5, 0.5, 1], np.float32), h)[:, None]
    embed, turn = np.ascontiguousarray(embed * scale), np.ascontiguousarray(turn * scale)
    out = np.zeros((len(x) + 1, h, n), np.float32)
    a, s, new = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((h, n), np.float32)
    for t in range(len(x)):
        np.take(embed, x[t], axis=1, out=a, mode="clip")
        np.matmul(turn, out[t], out=s)
        gates = a[: 2 * h]
        gates += s[: 2 * h]
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        np.multiply(gates[h:], s[2 * h :], out=new)
        new += a[2 * h :]
        np.tanh(new, out=new)
        np.subtract(out[t], new, out=out[t + 1])
        out[t + 1] *= gates[:h]
        out[t + 1] += new
    return out


def position_log_probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    """(steps, languages, rows) for bytes x (steps, rows)."""
    ahead = _states(net.embed[0], net.turn[0], x)[1:]
    behind = _states(net.embed[1], net.turn[1], x[::-1])[1:][::-1]
    h = net.turn.shape[2]
    logits = np.matmul(net.out[:, :h], ahead)
    logits += np.matmul(net.out[:, h:], behind)
    logits += net.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def _stretches(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts that end there: each stretch's text, start, first byte that counts, and end of the text."""
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    each = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(ends)), each)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    counted = starts[owner] + k * STRETCH
    start = np.minimum(counted, np.maximum(starts[owner], ends[owner] - STRETCH))
    return owner, start, counted, ends[owner]


def pooled(net: Network, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text (languages): the mean log probability over its bytes, and how many bytes have it as their label."""
    total, votes = np.zeros((len(ends), len(net.languages))), np.zeros((len(ends), len(net.languages)))
    owner, start, counted, end = _stretches(ends)
    for a in range(0, len(owner), TOGETHER):
        b = slice(a, a + TOGETHER)
        at = start[b] + np.arange(STRETCH)[:, None]
        inside = at < end[b]
        x = np.where(inside, data[np.minimum(at, len(data) - 1)], 0)
        log_p = position_log_probabilities(net, x)
        counts = (inside & (at >= counted[b])).astype(np.float32)[:, None]
        np.add.at(total, owner[b], (log_p * counts).sum(axis=0).T)
        np.add.at(votes, owner[b], ((log_p == log_p.max(axis=1, keepdims=True)) * counts).sum(axis=0).T)
    return total / np.maximum(votes.sum(axis=1, keepdims=True), 1), votes


def position_labels(net: Network, text: str) -> list[tuple[int, int, str]]:
    """(start, end, language) of the runs of bytes with one label, over the whole text."""
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return []
    _, start, counted, end = _stretches(np.array([len(data)]))
    at = start + np.arange(STRETCH)[:, None]
    label = position_log_probabilities(net, np.where(at < end, data[np.minimum(at, len(data) - 1)], 0)).argmax(axis=1)
    told = np.zeros(len(data), np.int64)
    use = (at < end) & (at >= counted)
    told[at[use]] = label[use]
    edges = np.flatnonzero(np.diff(told)) + 1
    return [(int(a), int(b), net.languages[told[a]]) for a, b in zip([0, *edges], [*edges, len(data)])]


# On tables --------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: a fifth, by the id alone. A null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = PER_LANGUAGE, excerpt: int = EXCERPT) -> DataFrame:
    """lang and t: excerpts of `per_language` documents of each language at most, those of the smallest hashes.

    A share by hash, twice what is needed, goes before the ranking, so that just a few rows
    are dealt by language. The languages' sizes come to the driver, as the network does, which
    has a row for each language too.
    """
    place = F.xxhash64(F.col(id_col).cast("string"))
    known = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    sizes = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int((2 * per_language + 50) / n * (1 << 20)) + 1)])
    drawn = F.pmod(F.xxhash64(F.lit(1), F.col(id_col).cast("string")), F.lit(1 << 20)) < share[F.col(lang_col)]
    rows = known.where(drawn).where(has_letter(F.col(text_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), place.alias("h"))
    spare = F.greatest(F.length("t") - excerpt, F.lit(0)) + 1
    cut = rows.select("lang", "h", F.substr("t", (F.pmod(F.col("h"), spare) + 1).cast("int"), F.lit(excerpt)).alias("t"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    return cut.withColumn("k", rank).where(F.col("k") <= per_language).select("lang", "t")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    rows = labelled_sample(docs, id_col, text_col, lang_col).collect()
    return fit([r.t.encode() for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score and agreement: the share of the text's bytes whose own label is the document's."""
    text = F.col(text_col)
    given = docs.select(F.col(id_col).alias("i"), F.when(has_letter(text), text).otherwise("").alias("t"))
    kind = given.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = bytes_of(batch["t"])
            size = np.diff(ends, prepend=0)
            names, score, agreement = [UNKNOWN] * len(ends), np.zeros(len(ends)), np.zeros(len(ends))
            if net is not None and len(data):
                mean, votes = pooled(net, data, ends)
                best = mean.argmax(axis=1)
                row = np.arange(len(ends))
                told = size > 0
                # sums differ in their last bits with a stretch's place among others
                score = np.where(told, np.round(np.exp(_log_softmax(mean, 1))[row, best], 6), 0)
                agreement = np.where(told, votes[row, best] / np.maximum(size, 1), 0)
                names = [net.languages[b] if ok else UNKNOWN for b, ok in zip(best, told)]
            columns = [batch["i"], pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(np.minimum(agreement, 1), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["i", "lang_pred", "score", "agreement"])

    out = given.mapInArrow(run, f"i {kind}, lang_pred string, score double, agreement double")
    return out.withColumnRenamed("i", id_col)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = identify(docs, learn(docs))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "agreement")
