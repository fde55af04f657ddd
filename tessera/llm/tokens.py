"""Token ids of whole texts by the public word-level BPE vocabulary.

The tokenizer takes some microseconds for each word, and texts repeat their
words.  So a slice of texts is split at ASCII white space and its distinct words
are found by Arrow; only these are looked up or encoded, and numpy gathers the
ids of all words.  Words that a slice repeats are remembered for the next ones.  An unknown word is split with the tokenizer's own pattern and
its parts are looked up or encoded.  Words with characters whose lower-casing or
composition depends on more than the character itself, and words that may spell a
special token, go to the tokenizer whole.  The ids are the tokenizer's.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm._text import kept

#: Words that a Python process remembers: two generations of so many, and the last slice's.
REMEMBERED = 100_000
#: Longer words are not remembered.
LONGEST = 64
#: A longer text is encoded in stretches of about so many bytes, cut at white space.
STRETCH = 4 << 20
_SPACES = b" \t\n\r\x0b\x0c"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stretches(text: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes that end at white space; a longer word stays whole."""
    start = 0
    while len(text) - start > size:
        cut = max(text.rfind(bytes([c]), start, start + size) for c in _SPACES) + 1
        if not cut:
            ahead = [p for p in (text.find(bytes([c]), start + size) for c in _SPACES) if p >= 0]
            cut = min(ahead, default=len(text) - 1) + 1
        yield text[start:cut]
        start = cut
    yield text[start:]


class WordIds:
    """The tokenizer with what it has encoded lately."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        # One character at a time maps to lower case here, and is composed already.
        self.plain = regex.compile("[!-~¡-įı-˿]+").fullmatch
        spelt = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # The sign that stands for each byte; the bytes of UTF-8 that occur are those of these characters.
        signs = {chr(b): s for c in map(chr, range(0x300)) for b, s in zip(c.encode(), spelt.pre_tokenize_str(c)[0][0], strict=True)}
        self.signs = str.maketrans(signs)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.signs)
        return array("i", [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()

    def _word(self, word: str, parts: dict[str, bytes]) -> bytes:
        """The ids of a word; ``parts`` has those of parts of other words."""
        if word.isascii() and word.isalpha():
            spelt = [word.lower()]
        elif "<|" not in word and self.plain(word):
            spelt = self.split(word.lower())
        else:
            return array("i", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        out = []
        for p in spelt:
            ids = parts.get(p)
            if ids is None:
                ids = parts[p] = self.young.get(p) or self.old.get(p) or self._part(p)
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def _known(self, words: list[str], repeated: list[bool]) -> list[bytes]:
        """The ids of distinct words; those that are repeated are remembered."""
        parts: dict[str, bytes] = {}
        out = []
        for word, again in zip(words, repeated, strict=True):
            ids = self.young.get(word)
            if ids is None:
                ids = self.old.get(word)
                if ids is None:
                    ids = self._word(word, parts)
                if again and len(word) <= LONGEST:
                    self.young[word] = ids
            out.append(ids)
        if len(self.young) > REMEMBERED:  # a full generation replaces the one before it
            self.young, self.old = {}, self.young
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each begin (and the last ends); null is empty."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        named = words.flatten().dictionary_encode()
        word = named.indices.to_numpy()
        known = self._known(named.dictionary.to_pylist(), (np.bincount(word, minlength=len(named.dictionary)) > 1).tolist())
        sizes = np.fromiter(map(len, known), np.int32, len(known)) // 4
        begins = np.cumsum(sizes, dtype=np.int32) - sizes
        flat = np.frombuffer(b"".join(known), "<u4")
        many = sizes[word]
        ends = np.cumsum(many, dtype=np.int32)  # a slice has fewer than 2**31 bytes
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total, dtype=np.int32) + np.repeat(begins[word] - (ends - many), many)
        per_text = np.concatenate(([0], ends))[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return flat[at], per_text

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of one text of any length, in stretches."""
        parts = [self.encode_all(pa.array([s.decode()], pa.large_string()))[0] for s in stretches(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def word_ids(path: str) -> WordIds:
    """The one instance of this process, so that tasks that follow find the words of those before."""
    return kept(f"word ids {path}", lambda: WordIds(path))
