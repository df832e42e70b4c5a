"""Rules, licences, language model, tokens and packing against brute force."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayframe.llm.lattice_lm import default_vocabulary, score_documents, word_log
from assayframe.llm.licenses import BASE, scan
from assayframe.llm.packing import best_windows, pack
from assayframe.llm.rules import judge
from assayframe.llm.token_files import read_documents, read_token_files, write_token_files
from assayframe.llm.tokens import default_path
from assayframe.session import shared_folder

from .data import documents, texts, words

ROWS = list(enumerate(texts()))


def _tokens(end):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {i: [*tok.encode(t or "", add_special_tokens=False).ids, end] for i, t in ROWS}


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_base_rules(spark):
    got = {r.doc_id: r for r in judge(documents(spark)).collect()}
    for i, t in ROWS:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.base_failed and r.kept) and 0 <= r.char_distance <= 1 and 0 <= r.word_distance <= 1


def test_license_places(spark):
    got = {r.doc_id: r for r in scan(documents(spark)).collect()}
    for i, t in ROWS:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        places = {b: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for b, p in BASE.items()}
        every = sorted(k for v in places.values() for k in v)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(every), every[0] if every else None, every[-1] if every else None)
        assert r.base_labels == ",".join(sorted(b for b, v in places.items() if v))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    extra = documents(spark, [(1, "x y permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"), (2, "permission software fee")])
    assert [(r.doc_id, r.labels) for r in scan(extra).orderBy("doc_id").collect()] == [(1, "isc"), (2, "")]


def test_two_licenses_in_one_file(spark):
    """The rare words of one licence do not push out another's."""
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted"
    cc, lgpl = "Licensed under CC BY-NC 4.0.", "under the terms of the GNU Lesser General Public License"
    filler = " river stone market" * 200
    rows = [(1, f"{bsd}{filler} {cc}"), (2, f"{lgpl}{filler} {bsd} {cc}"), (3, cc), *((k, f"licensed under cc by the {k}") for k in range(10, 30))]
    got = {r.doc_id: r.labels for r in scan(documents(spark, rows)).collect()}
    assert (got[1], got[2], got[3]) == ("bsd,cc-by-nc", "bsd,cc-by-nc,gpl,lgpl", "cc-by-nc")


def test_language_model(spark):
    got = {r.doc_id: r for r in score_documents(documents(spark), default_vocabulary()).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in ROWS}
    c = Counter(x for i, t in ROWS if not held[i] for x in [*words(t), None])
    n, v = sum(c.values()), len(c)
    for i, t in ROWS:
        tokens = [*words(t), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(c[x] > 0 for x in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens))
        assert -1e9 < r.score < 0


def test_lattice_sums_all_segmentations():
    logs = {p: math.log(x) for p, x in {"▁": 0.1, "a": 0.2, "b": 0.3, "▁a": 0.05, "ab": 0.15, "▁ab": 0.02}.items()}

    def ways(t):
        return 1.0 if not t else sum(math.exp(p) * ways(t[len(s) :]) for s, p in logs.items() if t.startswith(s))

    assert word_log("abab", logs, 3) == pytest.approx(math.log(ways("▁abab")))
    assert word_log("abab", logs, 3, math.log(0.25), math.log(0.125)) == pytest.approx(math.log(0.125 + 0.25 * ways("▁abab")))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_text_is_likelier_than_by_word_counts(spark):
    """Against word counts that are a distribution too: an unknown word is spelt, its bytes and an end equally likely."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in score_documents(docs, default_vocabulary()).where("held_out").collect()}
    rows = docs.select("doc_id", "text").collect()
    known = {w for r in rows if r.doc_id not in got for w in words(r.text)}
    spelt = sum(len(w) + 1 for r in rows if r.doc_id in got for w in words(r.text) if w not in known) * math.log10(257)
    n = sum(r.n_tokens for r in got.values())
    model, base = sum(r.score for r in got.values()) / n, sum(r.base_score for r in got.values()) / n
    print("log10 a token, held out:", model, base, base - spelt / n)
    assert model > base - spelt / n


def test_token_files(spark):
    path = f"{shared_folder(spark)}/test_token_files_{np.random.randint(1 << 60)}"
    write_token_files(documents(spark), path, default_path())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, path).collect()}
    ids, at = _tokens(2), 0
    for i, t in sorted(ids.items()):
        assert got[i] == (at, len(t), _crc(t))
        at += len(t)
    assert {r.doc_id: r.ids for r in read_documents(spark, path, [3, 7]).collect()} == {3: ids[3], 7: ids[7]}


def test_packing(spark):
    got = pack(documents(spark).coalesce(2), default_path()).collect()
    ids = _tokens(1)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == _crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(ids)
    for groups, field in ((by_doc, "start"), (by_sequence, "offset")):
        for rows in groups.values():
            at = 0
            for r in sorted(rows, key=lambda r: r[field]):
                assert r[field] == at
                at += r.length
            assert field == "start" and at == rows[0].doc_tokens or field == "offset" and at <= 2048
    assert pack(documents(spark, []), default_path()).count() == 0


def test_windows_are_the_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(20):
        cuts = np.unique(rng.integers(1, 60, 14))
        kinds = rng.integers(0, 3, len(cuts))
        cuts = np.union1d(cuts, np.arange(10, cuts[-1], 10))
        kinds = np.resize(kinds, len(cuts))
        fees, at = (0, 3, 9), [0, *cuts.tolist()]
        cost = [0] + [math.inf] * len(cuts)
        for j in range(1, len(at)):
            cost[j] = min(cost[i] + 20 - (at[j] - at[i]) + fees[kinds[j - 1]] for i in range(j) if at[j] - at[i] <= 20)
        plan = best_windows(cuts, kinds, 20, fees)
        paid = sum(20 - (b - a) + fees[kinds[at.index(b) - 1]] for a, b in zip([0, *plan], plan))
        assert paid == cost[-1]


def test_licence_words_are_counted_over_all_files(spark):
    """Also in files that hold no key phrase's last word."""
    from assayframe.llm.licenses import file_columns

    rows = [(1, "Permission granted, permission given"), (2, "nothing here"), (3, None), (4, "released under the MIT License")]
    got = {r.doc_id: (sorted(r.held), len(r.hits)) for r in file_columns(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (["granted", "permission"], 0) and got[3] == ([], 0) and got[2] == ([], 0)
    assert got[4] == (["license", "mit", "released", "the", "under"], 5)
