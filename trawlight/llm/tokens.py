"""Token ids of whole texts, word by word.

The vocabulary file normalises characters one by one, drops white space and never joins characters
across it, so the ids of a text are the ids of its white-space separated words, one after the other.
Words repeat: a batch looks up each distinct word once, and each worker keeps the ids of the words it
met lately. A word of ASCII and Latin-1 letters is cut into the pieces of the file's own split
pattern first, which repeat more often still; every piece is encoded by the tokenizers library.
``tests/llm/test_tokens.py`` compares with encoding whole texts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The split pattern of the vocabulary file, for lower-case ASCII and Latin-1 letters.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """Latin-1 letters as the vocabulary spells their UTF-8 bytes: bytes without a visible Latin-1
    form, taken in order, stand from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in seen]
    spelled = {byte: chr(byte) for byte in seen} | {byte: chr(256 + n) for n, byte in enumerate(hidden)}
    return {code: "".join(spelled[byte] for byte in chr(code).encode()) for code in range(0xC0, 0x100)}


_SPELLED = _byte_letters()

END_ID = 1
_KEPT_WORDS = 200_000
_BLOCK_BYTES = 4 << 20


class _Memo(dict):
    """Values by key, computed when asked for; emptied when it holds too many."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        if len(self) >= _KEPT_WORDS:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class WordEncoder:
    """Encodes texts with one vocabulary file."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.pieces = _Memo(self._piece)
        self.words = _Memo(self._word)

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.translate(_SPELLED)
        return array("I", [token.id for token in self.model.tokenize(spelled)]).tobytes()

    def _word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(word.lower())))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def blocks(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of consecutive texts of some megabytes: the first one's place, the ids of all, and
        where each text's ids begin (one more entry than texts). A null text has no ids."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(texts):
            limit = (ends[first - 1] if first else 0) + _BLOCK_BYTES
            last = max(first + 1, int(np.searchsorted(ends, limit, side="right")))
            yield first, *self._block(texts.slice(first, last - first))
            first = last

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(texts)
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        ids = list(map(self.words.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(ids), np.uint32)
        of_word = coded.indices.to_numpy()
        counts = sizes[of_word]
        ends = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat(starts[of_word] - ends[:-1], counts)
        places += np.arange(len(places))
        return flat[places], ends[bounds]


_encoders: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = WordEncoder(vocabulary)
    return _encoders[vocabulary]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
