"""Token ids of whole texts by a public tokenizer, through a bounded cache of blank-separated chunks.

A text is cut before each blank. For byte-level and word-end BPE such a cut is a boundary of the pre-tokenizer unless white
space stands before the blank, so ids of a text are those of its chunks in order; texts with white space before a blank are
encoded whole. Natural text repeats chunks, so most of them come from the cache.
"""

from __future__ import annotations

import gc
import os
from string import punctuation

import numpy as np

_ENCODERS: dict[tuple, ChunkEncoder] = {}
#: A control character that is neither white space nor part of another character's bytes.
MARK = "\x01"


def _byte_letters() -> dict[int, str]:
    """Letters below U+0250 as the characters that byte-level tokenizers have for their bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(own))}
    return {c: "".join(of[b] for b in chr(c).encode()) for c in range(128, 0x250)}


_BYTES = _byte_letters()


class ChunkEncoder:
    """ids(text) gives the ids as little-endian bytes of dtype.

    They are those of the plain call encode(text, add_special_tokens=False): a text that may hold the string of an added token is encoded whole.
    A missing or empty text has no ids.
    """

    def __init__(self, path: str, dtype: str = "<u4", cache_entries: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype, self.limit = np.dtype(dtype), cache_entries
        if self.tokenizer.get_vocab_size() > np.iinfo(self.dtype).max + 1:
            raise ValueError(f"ids of {path} don't fit into {dtype}")
        self.cache: dict[str, bytes | None] = {}
        self.again: set[str] = set()
        # the first characters of the added tokens' strings, in small letters, as a normalizer may change a text's
        self.special = sorted({t.content[:2].lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.cased = any(x.upper() != x for x in self.special)
        self.mark = self.tokenizer.encode(" " + MARK, add_special_tokens=False).ids
        self.line = self._encode(["\n"])[0]
        # what a word is before the merges: what stands before it for the blank (None: of another kind), and whether it's in small letters
        plain = " Abé" if self.tokenizer.normalizer is None else self.tokenizer.normalizer.normalize_str(" Abé")
        made = [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)] if self.tokenizer.pre_tokenizer else []
        forms = {(lead + word.translate(_BYTES),): (lead, word == "abé") for lead in ("", "Ġ") for word in ("Abé", "abé")}
        self.lead, self.small = forms.get(tuple(made), (None, False))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, chunks: list[str], most: int = 256) -> list[bytes]:
        """ids of each chunk as it stands after a blank. Many chunks are encoded as one text, with a mark between them that is cut out again."""
        if any(MARK in c for c in chunks):
            return self._encode([" " + c for c in chunks])
        groups = [chunks[k : k + most] for k in range(0, len(chunks), most)]
        between, last = f" {MARK} ", self.mark[-1]
        out: list[bytes] = []
        for group, encoding in zip(groups, self.tokenizer.encode_batch_fast([" " + between.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(encoding.ids, self.dtype)
            marks = np.flatnonzero(ids == last)
            if len(marks) != len(group) - 1:  # can't be, as no chunk holds the mark
                raise ValueError("the tokenizer didn't keep the marks apart")
            begins, ends = np.append(0, marks + 1).tolist(), np.append(marks + 1 - len(self.mark), len(ids)).tolist()
            out += [ids[i:j].tobytes() for i, j in zip(begins, ends, strict=True)]
        return out

    def _word(self, word: str, lead: str) -> list[int] | None:
        """ids of a word of Latin letters by the merges alone, lead before it; None for other words, and if the tokenizer is of another kind."""
        if self.lead is None or not word.isalpha() or not word.isascii() and max(word) >= "\u0250":
            return None
        word = word.lower() if self.small else word
        if not word.isascii():
            if not word.isalpha():  # small letters with a mark of their own
                return None
            word = word.translate(_BYTES)
        return [t.id for t in self.tokenizer.model.tokenize(lead + word)]

    @staticmethod
    def _pieces(chunk: str) -> list[str]:
        """Keys of the pieces that a chunk is made of. The pre-tokenizer cuts before ASCII marks after a Latin letter, and before a single line break.

        No chunk holds a blank, so one at the end tells pieces that don't stand after a blank.
        """
        if chunk[:-1].isalpha() and chunk[-1] in punctuation and chunk[-2] < "\u0250":  # the usual case
            return [chunk[:-1], chunk[-1] + " "]
        out = []
        for n, line in enumerate(chunk.split("\n")):
            core = line.rstrip(punctuation)
            if not core or not core[-1].isalpha() or core[-1] >= "\u0250" or n and core[0].isspace():
                return [chunk]
            out.append(f"\n{core} " if n else core)
            if core != line:
                out.append(line[len(core) :] + " ")
        return out

    def _learn(self, chunks: list[str]) -> None:
        """Put chunks and their pieces into the cache."""
        cache = self.cache
        alone = {c for c in chunks if c.isalpha()}  # one piece
        made = [(c, self._pieces(c)) for c in chunks if c not in alone]
        rest, marked, words, flat, ends = [], [], [], [], [0]
        plain, lead, small, tokenize = self.lead is not None, self.lead or "", self.small, self.tokenizer.model.tokenize
        for k in alone.union(*(p for _, p in made)).difference(cache):
            if plain and k.isascii() and k.isalpha():
                words.append(k)
                flat += [t.id for t in tokenize(lead + (k.lower() if small else k))]
                ends.append(len(flat) * self.dtype.itemsize)
                continue
            ids = self._word(k[1:-1], "") if k[0] == "\n" and k[-1] == " " else None if k[-1] == " " else self._word(k, self.lead or "")
            if ids is None:
                (rest if k[-1] == " " else marked).append(k)
            else:
                words.append(k)
                flat += ids
                ends.append(len(flat) * self.dtype.itemsize)
        joined = np.array(flat, self.dtype).tobytes()
        cache.update([(k, self.line + joined[a:b] if k[0] == "\n" else joined[a:b]) for k, a, b in zip(words, ends, ends[1:], strict=False)])
        cache.update(zip(marked, self._encode_chunks(marked), strict=True))
        cache.update(zip(rest, self._encode([k[:-1] for k in rest]), strict=True))
        cache.update([(c, b"".join([cache[k] for k in p])) for c, p in made if len(p) > 1])

    def _bounded(self) -> dict[str, bytes | None]:
        """The cache; when it's full, only chunks stay that were met again since it was half full."""
        if len(self.cache) > self.limit:
            some = {c: self.cache[c] for c in self.again if c in self.cache} if len(self.again) <= self.limit * 3 // 4 else {}
            self.cache, self.again = some, set()
        return self.cache

    def _may_hold_special(self, text: str) -> bool:
        text = text.lower() if self.cased else text
        return any(x in text for x in self.special)

    def batch(self, texts: list[str | None], chars: int = 1 << 21) -> list[bytes]:
        """ids of each text; works through about chars characters at a time, so that memory is bounded.

        The garbage collector pauses meanwhile: it would look through millions of strings again and again, and nothing in here refers to itself.
        """
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._batch(texts, chars)
        finally:
            if collects:
                gc.enable()

    def _batch(self, texts: list[str | None], chars: int) -> list[bytes]:
        out: list[bytes] = []
        start, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size >= chars:
                out += self._some(texts[start : k + 1])
                start, size = k + 1, 0
        return out + self._some(texts[start:])

    def _some(self, texts: list[str | None]) -> list[bytes]:
        whole = [k for k, text in enumerate(texts) if text and self._may_hold_special(text)]
        if whole:
            held = set(whole)
            out = self._some([None if k in held else text for k, text in enumerate(texts)])
            for k, ids in zip(whole, self._encode([texts[k] for k in whole]), strict=True):
                out[k] = ids
            return out
        parts = [text.split(" ") if text else [] for text in texts]
        chunks = set().union(*parts)
        cache = self._bounded()
        missing = chunks.difference(cache)
        if len(cache) > self.limit // 2:
            self.again |= chunks.difference(missing)
        if missing:
            # what ends in white space, and so what is empty too, can't be followed by a cut: None sends the text to the slow way
            cache.update(dict.fromkeys(c for c in missing if not c or c[-1].isspace()))
            self._learn([c for c in missing if c and not c[-1].isspace()])
        heads = self._encode([p[0] for p in parts if p])
        out, k = [], 0
        for text, p in zip(texts, parts, strict=True):
            if not p:
                out.append(b"")
                continue
            try:
                if len(p) > 1 and (not p[0] or p[0][-1].isspace()):
                    raise TypeError
                out.append(b"".join([heads[k], *map(cache.__getitem__, p[1:])]))
            except TypeError:
                out.append(self._encode([text])[0])
            k += 1
        return out


def encoder(path: str, dtype: str = "<u4", cache_entries: int = 600_000) -> ChunkEncoder:
    """One encoder for a Python worker, so that its cache lasts over the tasks it runs."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = ChunkEncoder(path, dtype, cache_entries)
    return _ENCODERS[path, dtype]


def public_tokenizer(name: str) -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)
