"""Token ids of whole texts, from a public tokenizer file, with a bounded store of words already seen.

The tokenizer drops white space and never joins characters across it, so a text's
ids are those of its white-space-separated words one after another.  Words repeat
a lot, so each Python worker keeps the ids of up to ``STORE`` words; when that is
full it starts afresh.  A new word made of plain Latin letters goes straight to
the model of the tokenizers library (its lower case, in byte-level letters); any
other word goes through the whole library tokenizer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that one Python worker keeps; about 200 bytes each.
STORE = 300_000
#: Longest word kept, in bytes.
LONGEST = 64
#: Bytes of text looked at together.
STRETCH = 2 << 20
_TAIL = b".,!?*$%&#|;:"


class WordIds:
    """``store``: lower-cased word (bytes) to its ids as little-endian numbers of ``kind``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.store: dict[bytes, bytes] = {}
        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.whole.get_vocab(True)
        self.kind = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.closes = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(33, 256)) if c.isalpha()}

    def _learn(self, words: set[bytes]) -> None:
        """Ids of new words: plain Latin words in one call of the model, others one by one."""
        store, split = self.store, {}
        for w in words:
            core = w.rstrip(_TAIL)
            if len(core) < len(w) and (core[-1:].isalpha() or core[-2:-1] == b"\xc3" and core[-1:] not in b"\x97\xb7"):
                split[w] = (core, w[len(core) :])  # Latin letters and a run of marks are split anyway
        need = (words - split.keys()).union(*split.values()).difference(store)
        plain = []
        for w in need:
            if w.isalpha():
                plain.append((w, w.decode("ascii")))
                continue
            text = w.decode("utf-8")
            if text.isalpha() and max(text) < "Ā":
                plain.append((w, text.lower().translate(self.letters)))
            else:
                store[w] = np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if plain:
            ids = np.array(self.bare.encode_batch_fast([" ".join(t for _, t in plain)], add_special_tokens=False)[0].ids, self.kind)
            raw, size = ids.tobytes(), self.kind.itemsize
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * size).tolist()
            for (w, _), lo, hi in zip(plain, [0, *ends], ends, strict=False):
                store[w] = raw[lo:hi]
            if len(ends) != len(plain):
                raise ValueError("the tokenizer does not close each word with one token")
        for w, (core, tail) in split.items():
            store[w] = store[core] + store[tail]

    def ids(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For stretches of the texts (strings, no nulls): all ids one after another, and each text's number of ids."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + STRETCH, side="right")))
            words = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(lo, hi - lo)))
            coded = words.flatten().dictionary_encode()
            distinct = coded.dictionary.cast(pa.binary() if pa.types.is_string(coded.type.value_type) else pa.large_binary()).to_pylist()
            found = list(map(self.store.get, distinct))
            new = {w for w, k in zip(distinct, found) if k is None}
            if new:
                if len(self.store) + len(new) > STORE:
                    self.store.clear()
                self._learn(new)
                found = [self.store[w] if k is None else k for w, k in zip(distinct, found)]
                for w in new:
                    if len(w) > LONGEST:
                        del self.store[w]
            flat = np.frombuffer(b"".join(found), self.kind)
            lengths = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
            which = coded.indices.to_numpy(zero_copy_only=False)
            many = lengths[which]
            ends = np.cumsum(many)
            shift = (np.cumsum(lengths) - lengths)[which] - (ends - many)
            ids = flat[np.repeat(shift, many) + np.arange(len(ends) and ends[-1])]
            at = np.concatenate([[0], ends])[words.offsets.to_numpy() - words.offsets[0].as_py()]
            yield ids, np.diff(at)
            lo = hi


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One store for each tokenizer file in each Python worker."""
    return WordIds(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
