"""Pre-tokens of the word-end BPE vocabulary, exactly as its library makes them.

A text is cut at special strings, then each part is normalised (NFC, runs of white space to one
space, lower case) and split by the vocabulary's pattern.  For texts whose characters all lie below
U+0180, where NFC changes nothing and lower case works character by character, the split is one
compiled pattern; other texts go through the library's own normaliser and splitter.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata

import numpy as np

#: Characters below this neither compose under NFC nor depend on their neighbours in lower case.
FAST_BELOW = 0x180


def _range_class(prefix: str) -> str:
    """Character class of all characters below FAST_BELOW in one general category."""
    cells, start = [], None
    for c in range(FAST_BELOW + 1):
        inside = c < FAST_BELOW and unicodedata.category(chr(c)).startswith(prefix)
        if inside and start is None:
            start = c
        if not inside and start is not None:
            cells.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "".join(cells)


class WordSplitter:
    """Splits texts into pre-tokens and special strings, and encodes pre-tokens."""

    def __init__(self, vocab_path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(vocab_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = Tokenizer.from_file(vocab_path)
        self.normalizer = self.full.normalizer
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.splitter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or "(?!)")
        letters, digits = _range_class("L"), _range_class("N")
        white = "".join(f"\\u{c:04x}" for c in (*range(9, 14), 0x20, 0x85, 0xA0))
        fast = pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{digits}]")
        fast = fast.replace(r"\s", white).replace(r"\p{L}", letters).replace(r"\p{N}", digits)
        self.fast = re.compile(fast).findall
        self.slow_char = re.compile(f"[^\\u0000-\\u{FAST_BELOW - 1:04x}]").search
        # the same model without normaliser: encodes pre-tokens that spaces separate
        bare = dict(spec)
        bare["normalizer"], bare["added_tokens"], bare["post_processor"] = None, [], None
        bare["pre_tokenizer"] = {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        }
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.suffix = spec["model"]["end_of_word_suffix"]
        size = max([*spec["model"]["vocab"].values(), *self.special.values()]) + 1
        self.pieces = [""] * size
        for piece, i in spec["model"]["vocab"].items():
            self.pieces[i] = piece
        for piece, i in self.special.items():
            self.pieces[i] = piece
        self.ends = np.zeros(size, dtype=bool)
        for piece, i in spec["model"]["vocab"].items():
            self.ends[i] = piece.endswith(self.suffix)

    def _part(self, text: str) -> list[str]:
        if self.slow_char(text) is None:
            return self.fast(text.lower())
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def split(self, text: str) -> list[str]:
        """Pre-tokens in order.  A special string appears as a space and its content."""
        if "<|" not in text or self.special_re.search(text) is None:
            return self._part(text)
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += self._part(text[at : m.start()])
            out.append(" " + m[0])
            at = m.end()
        return out + self._part(text[at:])

    def encode_words(self, words: list[str], block: int = 8192) -> list[np.ndarray]:
        """Ids of each pre-token.  Each word's last piece carries the word end, which cuts the stream."""
        out: list[np.ndarray] = []
        for at in range(0, len(words), block):
            part = words[at : at + block]
            plain = [w for w in part if not w.startswith(" ")]
            ids = np.array(self.bare.encode(" ".join(plain), add_special_tokens=False).ids, dtype=np.int32)
            cuts = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.zeros(0, dtype=np.int64)
            if len(cuts) != len(plain):
                raise ValueError("the vocabulary has words without a word end")
            found = iter(np.split(ids, cuts[:-1]) if len(cuts) else [])
            out += [np.array([self.special[w[1:]]], dtype=np.int32) if w.startswith(" ") else next(found) for w in part]
        return out

    def single_words(self) -> dict[str, int]:
        """Pre-tokens that encode alone as one token, proved by encoding each vocabulary string alone.

        A token that stands for a whole pre-token ends with the word end; its other characters,
        mapped back to bytes, are the only pre-token that can give it.  Each candidate is encoded by
        the model and stays only if the result is that one id.
        """
        back = byte_of_char()
        names, ids = [], []
        for i, piece in enumerate(self.pieces):
            if not self.ends[i]:
                continue
            try:
                word = bytes(back[c] for c in piece[: -len(self.suffix)]).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if word and " " not in word:
                names.append(word)
                ids.append(i)
        proved = {w: i for w, i, got in zip(names, ids, self.encode_words(names)) if len(got) == 1 and got[0] == i}
        return proved | {" " + s: i for s, i in self.special.items()}


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others take the code points from 256 on, in order.
    """
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


_loaded: dict[str, WordSplitter] = {}


def splitter(vocab_path: str) -> WordSplitter:
    """One per Python worker."""
    if vocab_path not in _loaded:
        _loaded[vocab_path] = WordSplitter(vocab_path)
    return _loaded[vocab_path]


def intern_all(words: list[str]) -> list[str]:
    return [sys.intern(w) for w in words]
