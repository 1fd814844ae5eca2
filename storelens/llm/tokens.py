"""Token ids of whole texts by a public word-level BPE vocabulary.

Texts whose characters lie in Latin-1 take a vectorised way: they are lower-cased, cut into pre-tokens by a byte
table, and only the distinct pre-tokens of a batch are encoded. All others, and texts that spell out a special
token, go through ``tokenizers`` itself. Both ways give the same ids (tests compare them).
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa

from storelens.llm import buffers

#: Id appended to every document by the packing and ordering operators.
END_ID = 1
#: Contractions the vocabulary's pre-tokeniser keeps whole (fixed values).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
BLANK, LETTER, DIGIT, OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for code in range(256):
        kind = unicodedata.category(chr(code))[0]
        if chr(code) in " \t\n\v\f\r\x85\xa0":
            out[code] = BLANK
        elif kind == "L":
            out[code] = LETTER
        elif kind == "N":
            out[code] = DIGIT
    return out


CLASS = _classes()
LOWER = np.array([ord(chr(code).lower()) for code in range(256)], np.uint8)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordEncoder:
    """Encoder of batches of texts; one per worker process."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        letters = _byte_letters()
        # Lower-cased text has no "A", so that byte can mark the end of a word.
        ranks, self.ends = {}, np.zeros(max(vocab.values()) + 1, bool)
        for token, rank in vocab.items():
            last = token.endswith("</w>")
            name = token[:-4] if last else token
            if all(c in letters for c in name):
                ranks[bytes(letters[c] for c in name) + b"A" * last] = rank
                self.ends[rank] = last
        self.fast = tiktoken.Encoding("words", pat_str="[^A]+A", mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]

    def _plain(self, text: str) -> bytes | None:
        """The text as Latin-1, or None if it needs the slow way."""
        if any(s in text for s in self.special):
            return None
        try:
            return text.encode("latin-1")
        except UnicodeEncodeError:
            return None

    def _word_ids(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, and their bounds."""
        data, at = buffers.text_bytes(names)
        marked = np.full(len(data) + len(names), ord("A"), np.uint8)
        marked[np.arange(len(data)) + np.repeat(np.arange(len(names)), np.diff(at))] = data
        ids = np.array(self.fast.encode_ordinary(marked.tobytes().decode("latin-1")), np.uint32)
        return ids, np.append(0, np.flatnonzero(self.ends[ids]) + 1)

    def encode(self, texts: list[str | None], end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array and the bounds of each; ``end`` is appended to every text (null: empty)."""
        plain = [self._plain(t or "") for t in texts]
        data, starts, stops, rows = self._pre_tokens(plain)
        code, names = buffers.coded(data, starts, stops)
        ids, bounds = self._word_ids(names)
        lengths = np.diff(bounds)[code] if len(code) else np.empty(0, np.int64)
        flat = ids[buffers.ranges(bounds[:-1][code], lengths)] if len(code) else np.empty(0, np.uint32)
        sizes = np.bincount(rows, weights=lengths, minlength=len(texts)).astype(np.int64)
        slow = {k: self.slow.encode(texts[k], add_special_tokens=False).ids for k, p in enumerate(plain) if p is None}
        extra = 0 if end is None else 1
        total = sizes.copy()
        for k, found in slow.items():
            total[k] = len(found)
        out_at = np.append(0, np.cumsum(total + extra))
        out = np.empty(int(out_at[-1]), np.uint32)
        out[buffers.ranges(out_at[:-1], sizes)] = flat
        for k, found in slow.items():
            out[out_at[k] : out_at[k] + len(found)] = found
        if extra:
            out[out_at[1:] - 1] = end
        return out, out_at

    def _pre_tokens(self, plain: list[bytes | None]):
        """Bytes of the plain texts with start, end and text number of every pre-token."""
        data = LOWER[np.frombuffer(b"".join(p or b"" for p in plain), np.uint8)]
        bounds = np.append(0, np.cumsum([len(p or b"") for p in plain])).astype(np.int64)
        kind = CLASS[data]
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        cut[bounds] = True
        self._contractions(data, bounds, kind, cut)
        at = np.flatnonzero(cut)
        starts, stops = at[:-1], at[1:]
        if not len(data):
            return data, starts[:0], stops[:0], starts[:0]
        used = kind[starts] != BLANK
        starts, stops = starts[used], stops[used]
        return data, starts, stops, np.searchsorted(bounds, starts, "right") - 1

    @staticmethod
    def _contractions(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray, cut: np.ndarray) -> None:
        """Move cuts so that an apostrophe that begins a pre-token takes its contraction along."""
        taken = 0
        for p in np.flatnonzero(data == 39).tolist():
            if not cut[p] and p != taken:
                continue  # inside a run of other signs
            stop = int(bounds[np.searchsorted(bounds, p, "right")])
            tail = data[p : min(stop, p + 3)].tobytes().decode("latin-1")
            found = next((c for c in CONTRACTIONS if tail.startswith(c)), None)
            if found:
                cut[p] = True
                cut[p + 1 : p + len(found)] = False
                cut[p + len(found)] = True
                taken = p + len(found)


@functools.cache
def encoder(path: str) -> WordEncoder:
    """The process's encoder for one vocabulary file."""
    return WordEncoder(path)
