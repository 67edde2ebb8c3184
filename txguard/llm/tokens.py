"""Token ids of public vocabularies, with each distinct word encoded once.

Both vocabularies cut a text into small pieces before merging, and no piece crosses a blank between words: ``word_bpe`` drops white space,
``byte_bpe`` gives a word the blank before it, and a line break between words is a piece of its own. So a text's ids are those of its words,
one after the other, and words repeat. A full stop or comma after a letter is a piece of its own too, and to letters in lower case (``word_bpe``)
or any letters (``byte_bpe``) nothing applies but the merges. Texts with special tokens' strings or other white space are encoded whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import lru_cache

# Words kept per task in each of two generations, about 200 bytes each: when the newer is full, the older goes.
MAX_PARTS = 800_000
# White space (or what some libraries take for it) other than blanks and line breaks, and letters with unusual lower case.
_UNUSUAL = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u0130\\u03a3\\u1680\\u180e\\u2000-\\u200d\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")
_BLANKS = ("  ", " \n", "\n ", "\n\n\n", "\t", "\x0b", "\f", "\r")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: itself if it prints, else one from 256 on, in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: 256 + i for i, b in enumerate(others)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids (the byte order of the machines that Spark runs on)."""

    def __init__(self, path: str, words: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = words
        self.letters = _byte_letters()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.fixed = {m: self.whole(m) for m in ("", ".", ",", "\n")}
        self.parts: dict[str | bytes, bytes] = {}
        self.older: dict[str | bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special.search(text) or _UNUSUAL.search(text) or not self.words and (text.endswith("\n\n") or any(x in text for x in _BLANKS)):
            return self.whole(text)
        if self.words:
            parts, skip = text.encode().lower().split(), 0
        else:
            # A part has a blank before it, unless it begins with a line break, as the text does here; that break's id is skipped.
            parts, skip = f"\n{text}".replace("\n", " \n").split(" ")[1:], 4
        try:
            return b"".join(map(self.parts.__getitem__, parts))[skip:]
        except KeyError:
            if len(self.parts) > MAX_PARTS:
                self.older, self.parts = self.parts, {}
            self.learn({p for p in parts if p not in self.parts})
            return b"".join(map(self.parts.__getitem__, parts))[skip:]

    def learn(self, new: set[str | bytes]) -> None:
        """Encode parts not seen before."""
        cut: dict[str | bytes, tuple[str, str, str]] = {}
        for part in new:
            known = self.older.get(part)
            if known is not None:
                self.parts[part] = known
                continue
            text = part.decode() if self.words else part
            start = "\n" if text[:1] == "\n" else ""
            mark = text[-1] if text[-1:] in (".", ",") and text[-2:-1].isalpha() else ""
            if mark and not start:
                known = self.parts.get(part[:-1])
                if known is not None:
                    self.parts[part] = known + self.fixed[mark]
                    continue
            core = text[len(start) : len(text) - len(mark)]
            cut[part] = start, core if self.words or start else f" {core}", mark
        coded: dict[str, bytes] = {"": b""}
        rest = []
        for core in {c for _, c, _ in cut.values()}:
            word = core if self.words else core.removeprefix(" ")
            if word.isalpha() and (not self.words or word.isascii() or word.lower() == word and unicodedata.is_normalized("NFC", word)):
                found = self.model.tokenize(core.encode().decode("latin-1").translate(self.letters))
                coded[core] = array("I", [t.id for t in found]).tobytes()
            elif core:
                rest.append(core)
        # Blocks bound what the library holds at once.
        for i in range(0, len(rest), 5000):
            block = rest[i : i + 5000]
            for core, ids in zip(block, self.tokenizer.encode_batch_fast(block, add_special_tokens=False)):
                coded[core] = array("I", ids.ids).tobytes()
        for part, (start, core, mark) in cut.items():
            self.parts[part] = self.fixed[start] + coded[core] + self.fixed[mark]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary file."""
    from tokenizers import Tokenizer

    name = Tokenizer.from_file(path).pre_tokenizer.__class__.__name__
    return Encoder(path, words=name != "ByteLevel")
