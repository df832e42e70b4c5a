"""Winnowed fingerprints against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from assayframe.llm import winnowing as w
from assayframe.llm.winnowing import as_string, code_points, edited_fingerprints, fingerprints, gram_hashes, winnow

from .data import documents, texts


def _hash(points):
    h = 0
    for p in points:
        h = (h * w._BASE + p + 1) % (1 << 64)
    h = (h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    return h ^ (h >> 29)


def _winnow(text, gram=w.GRAM, window=w.WINDOW):
    points = [ord(c) for c in text]
    if not points:
        return []
    gram = min(gram, len(points))
    hashes = [_hash(points[i : i + gram]) for i in range(len(points) - gram + 1)]
    window = min(window, len(hashes))
    chosen = set()
    for i in range(len(hashes) - window + 1):
        chosen.add(max(range(i, i + window), key=lambda k: (-hashes[k], k)))
    return [(hashes[k], k) for k in sorted(chosen)]


def _print(text):
    return " ".join(f"{h & 0xFFFFFFFF:08x}{k:08x}" for h, k in _winnow(text))


def _alike(a, b):
    a, b = (Counter(h for h, _ in _winnow(t)) for t in (a, b))
    return 2 * (a & b).total() / (a.total() + b.total()) if a or b else 1.0


def _expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), _print(t), _print(edited), _alike(t, edited), _alike(t, following)))
    return Counter(out)


@pytest.mark.parametrize(("gram", "window"), [(w.GRAM, w.WINDOW), (1, 1), (5, 4), (7, 3), (64, 2)])
def test_chosen_hashes(gram, window, monkeypatch):
    monkeypatch.setattr(w, "PIECE", 37)
    rng = random.Random(5)
    for text in [*(t for t in texts() if t and len(t) < 2000), "a" * 500, "ab" * 200, "".join(rng.choice("aé漢😀") for _ in range(700))]:
        h, p = winnow(code_points(text.encode()), gram, window)
        assert list(zip(h.tolist(), p.tolist())) == _winnow(text, gram, window)


def test_shared_passages_are_found():
    rng = random.Random(11)
    for _ in range(100):
        passage = "".join(rng.choice("abcdef ") for _ in range(w.GRAM + w.WINDOW - 1))
        one, two = ("".join(rng.choice("abcdef ") for _ in range(rng.randrange(300))) for _ in range(2))
        a, b = (set(winnow(code_points(t.encode()))[0].tolist()) for t in (one + passage, passage + two))
        assert a & b


def test_a_long_text_is_worked_through_in_pieces(spark):
    text = "".join(random.Random(2).choice("stone river ") for _ in range(3 * w.PIECE))
    h, p = winnow(code_points(text.encode()))
    whole = gram_hashes(code_points(text.encode()))
    want = np.unique([k + w.WINDOW - 1 - int(np.argmin(whole[k : k + w.WINDOW][::-1])) for k in range(0, len(whole) - w.WINDOW + 1, 97)])
    assert np.isin(want, p).all() and (whole[p] == h).all()
    row = fingerprints(documents(spark, [(1, text)])).first()
    assert row.positions == p.tolist()


def test_edited_texts(spark):
    rows = list(enumerate(t if t is None or len(t) < 9000 else t[:9000] for t in texts()))
    got = edited_fingerprints(documents(spark, rows))
    assert [f.name for f in got.schema] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert Counter(map(tuple, got.collect())) == _expected(rows)


def test_odd_ids(spark):
    rows = [(None, "one"), (None, "two words"), (7, "same text here"), (7, "same text here"), (-(2**62), "least"), (2**62, None), (3, "")]
    got = Counter(map(tuple, edited_fingerprints(documents(spark, rows)).collect()))
    assert sum(got.values()) == 7 and {r[0] for r in got} == {None, 7, -(2**62), 2**62, 3}
    assert Counter(r for r in got.elements() if r[0] is not None and r[0] != -(2**62)) == Counter(r for r in _expected(rows).elements() if r[0] is not None and r[0] != -(2**62))
    assert edited_fingerprints(documents(spark, [])).collect() == []
    (only,) = edited_fingerprints(documents(spark, [(5, "ab" * 40)])).collect()
    assert only.near_next == 1.0 and only.n_chars == 80


def test_hot_ids_are_shared_out_in_order(spark):
    rows = [(2**60 + 1, f"hot {k} " * 20) for k in range(300)] + [(None, f"void {k} " * 20) for k in range(300)] + [(2**60 + k, f"x{k} " * 20) for k in range(100)]
    got = edited_fingerprints(documents(spark, rows)).select("doc_id", "near_next", "edited_sha256").collect()
    shas = {(r.doc_id, r.edited_sha256) for r in got}
    assert len(got) == 700
    # every text is the next one of exactly one row: the heads of the edited texts' last halves tell which
    texts_of = [t for _, t in rows]
    found = {hashlib.sha256((t[: len(t) - len(t) // 2] + f[: len(t) // 2]).encode()).hexdigest(): (t, f) for t in texts_of for f in texts_of}
    pairs = [found[s] for _, s in shas]
    assert Counter(t for t, _ in pairs) == Counter(f for _, f in pairs) == Counter(texts_of)
    ids = {t: i for i, t in rows}
    assert sum(ids[t] != ids[f] for t, f in pairs) == 101


def test_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(w, "REPEATS", 3)
    rows = [(4, "four " * 30)] * 11 + [(9, "nine " * 30)] * 5 + [(k, f"text {k} " * 20) for k in range(20, 40)]
    assert Counter(map(tuple, edited_fingerprints(documents(spark, rows)).collect())) == _expected(rows)


def test_string_form():
    assert as_string(np.array([0xABCDEF0123456789, (1 << 32) + 1], np.uint64), np.array([0, 258])) == "2345678900000000 0000000100000102"
