"""Token ids of whole texts, by a tokenizer file that only white space cuts.

The file's tokenizer drops white space and never joins across it, so the ids of a text are
the ids of its blank-separated chunks one after another. Chunks repeat, so each Python
worker remembers their ids over its tasks, in a table of bounded size. New chunks of plain characters are cut
at the tokenizer's own word rule and their words encoded thousands at a time, as one text of words: the last id of each word
is one of those that end words, which tells the words apart again. All other chunks are encoded as they are.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import regex
from tokenizers import Tokenizer, pre_tokenizers

REMEMBERED = 1_400_000  # chunks; the table starts anew beyond that
PART = 100_000  # chunks of texts encoded at a time
TOGETHER = 5000  # words encoded as one text
# no apostrophe (contractions), no blanks or controls, beyond ASCII letters only
PLAIN = regex.compile(r"[!-&(-~\p{L}]+")
# fixed rule of the tokenizer for such chunks: runs of letters, single digits, runs of anything else
WORDS = regex.compile(r"\p{L}+|[0-9]|[^\p{L}0-9]+")


class TextTokenizer:
    """Ids as little-endian unsigned 32-bit bytes, equal to those of encoding the text whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.words_only = Tokenizer(self.tokenizer.model)  # for lower-case ASCII letters the file's other steps change nothing
        self.words_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}  # of chunks, and of the words in them

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _learn_words(self, words: list[str], tokenizer: Tokenizer) -> None:
        for at in range(0, len(words), TOGETHER):
            part = words[at : at + TOGETHER]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            raw = ids.tobytes()
            self.known.update(zip(part, (raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)), strict=True))

    def _learn(self, chunks: set[str]) -> None:
        known, simple, mixed, built, other = self.known, [], set(), [], []
        for c in chunks:
            if c.isascii() and c.isalpha():
                simple.append(c)
            elif PLAIN.fullmatch(c) and (c.isascii() or (c == c.lower() and unicodedata.is_normalized("NFC", c))):
                words = WORDS.findall(c)
                mixed.update(w for w in words if w not in known and w not in chunks)
                if len(words) > 1:
                    built.append((c, words))
                else:
                    mixed.add(c)
            else:
                other.append(c)
        for w in [w for w in mixed if w.isascii() and w.isalpha()]:
            mixed.remove(w)
            simple.append(w)
        self._learn_words(simple, self.words_only)
        self._learn_words(list(mixed), self.tokenizer)
        for c, words in built:
            known[c] = b"".join(map(known.__getitem__, words))
        for c, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            known[c] = self._bytes(e.ids)

    def _encoded(self, chunks: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, chunks))

    def _know(self, texts: list[list[str]]) -> None:
        """Learns what is new in lists of chunks, at most ``PART`` of them at a time (plus one list)."""
        new = {c for chunks in texts for c in chunks if c not in self.known}
        if len(self.known) + 2 * len(new) > REMEMBERED:
            self.known = {"": b""}
            new = {c for chunks in texts for c in chunks} - {""}
        self._learn(new)

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text in order; new chunks of many texts are learnt together."""
        held: list[list[str]] = []  # a text each
        count = 0
        for text in texts:
            if text and "<|" in text:  # special tokens are found in the text as it is
                yield from self._released(held)
                held, count = [], 0
                yield self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
                continue
            # the tokenizer lower-cases; doing so for A-Z first makes chunks repeat more
            chunks = text.encode("utf-8", "replace").lower().decode("utf-8").replace("\n", " ").split(" ") if text else []
            held.append(chunks)
            count += len(chunks)
            if count > PART:
                yield from self._released(held)
                held, count = [], 0
        yield from self._released(held)

    def _released(self, held: list[list[str]]) -> Iterator[bytes]:
        if len(held) == 1 and len(held[0]) > PART:  # a long text, in parts
            parts = [held[0][at : at + PART] for at in range(0, len(held[0]), PART)]
            out = []
            for part in parts:
                self._know([part])
                out.append(self._encoded(part))
            yield b"".join(out)
        elif held:
            *short, last = held
            self._know(short)
            yield from map(self._encoded, short)
            if len(last) > PART:
                yield from self._released([last])
            else:
                self._know([last])
                yield self._encoded(last)


@cache
def worker_tokenizer(path: str) -> TextTokenizer:
    """One tokenizer and table per Python process and file."""
    return TextTokenizer(path)
