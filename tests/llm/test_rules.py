"""Divergence rules against plain Python: distances, limits and verdicts, languages without lists, odd rows."""

import math
from collections import Counter

from assayframe.llm import rules
from assayframe.llm.common import SPACES

NAMES = "doc_id long, text string, lang string"


def _histograms(text, lang):
    kinds = [sum("a" <= c <= "z" for c in text), sum("A" <= c <= "Z" for c in text), sum("0" <= c <= "9" for c in text)]
    kinds += [sum(c in s for c in text) for s in (SPACES, ".,;:!?'\"()-", *rules.SYMBOLS)]
    words = [w for w in "".join(" " if c in SPACES else c for c in text).split(" ") if w]
    seen, places = Counter(w.lower() for w in words), rules.COMMON.get(lang, rules.EVERY)
    common = [seen[w] for w in places]
    return [*kinds, len(text) - sum(kinds)], [*common, *[0] * (len(rules.EVERY) - len(common)), len(words) - sum(common)], len(words)


def _distance(p, q):
    if not sum(p) or not sum(q):
        return 0.0
    total = 0.0
    for x, y in zip([v / sum(p) for v in p], [v / sum(q) for v in q]):
        for a, b in ((x, y), (y, x)):
            total += 0.5 * a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(0.0, total))


def _judged(rows):
    """(char distance, word distance, within limits) of each row."""
    own = [(lang or "", *_histograms(text or "", lang or "")) for _, text, lang in rows]
    whole = {}
    for lang, chars, words, _ in own:
        c, w = whole.get(lang, ([0] * len(chars), [0] * len(words)))
        whole[lang] = ([a + b for a, b in zip(c, chars)], [a + b for a, b in zip(w, words)])
    found = []
    for lang, chars, words, n in own:
        c, w = _distance(chars, whole[lang][0]), _distance(words, whole[lang][1])
        found.append((lang, n, c, w, c / math.sqrt(1 + rules.CHAR_LENGTH / max(1, sum(chars))), w / math.sqrt(1 + rules.WORD_LENGTH / max(1, n))))
    out = []
    for lang, n, c, w, cs, ws in found:
        peers = [f for f in found if f[0] == lang and f[1] >= rules.MIN_WORDS]
        near = bool(peers)
        for at, value, least in ((4, cs, rules.LEAST_CHAR), (5, ws, rules.LEAST_WORD)):
            order = sorted(f[at] for f in peers)
            half, upper = (order[max(0, math.ceil(q * len(order)) - 1)] if order else 0.0 for q in (0.5, 0.75))
            near = near and value <= max(least, half + rules.SPREADS * (upper - half))
        out.append((c, w, near))
    return out


def _check(spark, rows):
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, NAMES)).collect()}
    assert len(got) == len(rows)
    for (doc_id, _, _), (c, w, near) in zip(rows, _judged(rows)):
        r = got[doc_id]
        assert math.isclose(r.char_distance, c, abs_tol=1e-6) and math.isclose(r.word_distance, w, abs_tol=1e-6), (doc_id, r, c, w)
        assert r.kept == (near and not r.base_failed), doc_id
    return got


def _prose(seed, n):
    words = "the of and to in a report river stone light because under morning walked quiet garden it was for that".split()
    return " ".join(words[(seed * 7 + i * i * 3 + i // 5) % len(words)] + ("." if i % 9 == 8 else "") for i in range(n))


def test_judge_against_plain_python(spark):
    rows = [(i, _prose(i, 60 + 13 * i), "en") for i in range(24)] + [(30 + i, _prose(i + 5, 80 + i), lang) for i, lang in enumerate(["de", "xx", None, "", "xx", "xx"])]
    rows += [(90, None, "en"), (91, "", None), (92, "word", "xx"), (93, " | ".join(_prose(3, 200).split()), "en"), (94, "É" * 5000 + " ß" * 60, "de"), (95, _prose(2, 86), "en")]
    got = _check(spark, rows)
    assert not got[93].kept and not got[90].kept and got[95].kept


def test_odd_tables(spark):
    assert rules.judge(spark.createDataFrame([], NAMES)).count() == 0
    rows = [(None, _prose(1, 70), "en"), (7, _prose(1, 70), "en"), (7, _prose(1, 70), "en")]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], f"{NAMES}, kept string, char_limit double")
    assert [r.kept for r in rules.judge(docs).collect()] == [rules.judge(docs).first().kept] * 3
