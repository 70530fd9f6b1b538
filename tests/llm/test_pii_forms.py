import random
import re
import time

import numpy as np
import pytest

from patternlake.llm import pii

ADDRESSES = ("192[.]168[.]10[.]254", "10[.]0[.]0[.]1", "10.0.0[.]1", "10(.)0(.)0(.)1", "10. 0. 0. 1", "10, 0, 0, 1", "10[dot]0[dot]0[dot]1", "10dot0dot0dot1", "2001:db8::1", "fe80::1ff", "::1", "fe80::")


@pytest.mark.parametrize("address", ADDRESSES)
def test_each_form_is_found(address):
    text = f"reach the host {address} then"
    at = text.index(address)
    assert pii.all_spans(text, pii.trained()) == ([], [(at, 1, at + len(address))])


def form(text, kind):
    if kind != 1:
        return pii.KINDS[kind]
    return re.sub("[0-9]+", "n", text) if ":" not in text else "::" if "::" in text else ":"


def test_recall_of_each_form():
    field, hit, of = pii.trained(), {}, {}
    for text, marks in pii.generated(4000, 78):
        _, every = pii.all_spans(text, field)
        for a, kind, b in marks:
            key = form(text[a:b], kind)
            of[key] = of.get(key, 0) + 1
            hit[key] = hit.get(key, 0) + ((a, kind, b) in every)
    assert len(of) == 14
    assert {k: hit[k] / of[k] for k in of if hit[k] / of[k] < 0.6} == {}


def test_training_needs_a_segment_for_each_mark(monkeypatch):
    monkeypatch.setattr(pii, "generated", lambda n, seed: [("plain words only", [(0, 0, 5)])])
    with pytest.raises(ValueError, match="plain"):
        pii.trained(1, 1, 12345)


def test_lists_and_scopes_stay():
    for text in ("rows 1, 2, 3, 4 of it", "see std::vector and add::dec here", "at 12:30:45 then"):
        assert pii.all_spans(text, pii.trained()) == ([], [])


def test_best_labelling_is_the_best_of_all():
    rng = np.random.default_rng(8)
    labels = len(pii.KINDS) + 1
    for _ in range(150):
        n = int(rng.integers(1, 6))
        field = pii.Field(rng.normal(size=(len(pii.KINDS), pii.N_FEATURES)), rng.normal(size=(labels, labels)))
        spots = [(i, k) for i in range(n) for k in range(1, n - i + 1) if rng.random() < 0.5]
        segments = [(i, k, 0, 0, rng.normal(size=(len(pii.KINDS), pii.N_FEATURES)) / 4) for i, k in spots]

        def scored(path):
            return sum((segments[k][4][y] * field.weights[y]).sum() for k, y in path)

        def labellings(i, label, value):
            if i == n:
                yield value, ()
                return
            for rest in labellings(i + 1, 0, value + field.moves[label, 0]):
                yield rest
            for k, s in enumerate(segments):
                if s[0] == i:
                    for y in range(labels - 1):
                        for got, path in labellings(i + s[1], y + 1, value + field.moves[label, y + 1] + scored([(k, y)])):
                            yield got, ((k, y), *path)

        assert tuple(field.best(n, segments)) == max(labellings(0, 0, 0.0))[1]


def test_unbroken_text_stays_linear():
    text = ("x" * 393 + "1234567") * 2500
    began = time.perf_counter()
    assert pii.all_spans(text, pii.trained()) == ([], [])
    assert time.perf_counter() - began < 10
    many = "a@b.co " * 60_000 + "tel (555) 123-4567"
    base, every = pii.all_spans(many, pii.trained())
    assert len(base) == 60_000 and len(every) == 60_001


def test_windows_lose_nothing():
    """Spans do not depend on how triggers fall into windows: the same with one window over the whole text."""
    rng, field = random.Random(11), pii.trained()
    parts = ["tel (555) 123-4567", "host 10[.]0[.]0[.]1", "ana at host dot com", "word", "x" * 90, "...", " " * 100, "\n", "mail"]
    for _ in range(60):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))
        windows = list(pii._windows(text))
        assert all(b <= c for (_, b), (c, _) in zip(windows, windows[1:], strict=False))
        for a, b in windows:
            assert (a == 0 or text[a - 1].isspace()) and (b == len(text) or text[b].isspace())
        tokens = [m.span() for m in pii._WORD.finditer(text)]
        segments = pii._segments(text, tokens)
        whole = [(segments[k][2], kind, segments[k][3]) for k, kind in field.best(len(tokens), segments)]
        assert pii.field_spans(text, field) == whole
