"""Tokenizing inside Arrow batches, with each different word encoded once per worker.

A tokenizer never makes a token across a boundary between a non-space and a following space, so a text is cut
there, and the pieces that recur (nearly all of them) are looked up instead of encoded again. Pieces are encoded by
the library itself; texts with unusual white space, where such a cut could matter, go to it whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that some regular expression engine counts as white space and another does not.
ODD_SPACE = "\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\u200b\\ufeff\\u180e"
ODD = re.compile(f"[{ODD_SPACE}]")
ODD_RE2 = "[\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}\\x{180e}]"
PIECE = re.compile("[ \\t\\n\\r]*[^ \\t\\n\\r]+|[ \\t\\n\\r]+")
PLAIN = re.compile("[ \\t\\n\\r]+")

#: A word of letters on which all engines agree (Latin, without the dotted capital I), perhaps with a mark after it:
#: one or two pre-tokens, which the library's model can take without its pre-tokenizer.
LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"
WORD = re.compile(f"([ \\n]?)({LETTERS})([.,]?)")
#: Such a word after white space, and how many of them the model takes at once.
LED_RE2, JOINED = f"^[ \\n]{LETTERS}[.,]?$", 64

#: Most bytes of text that are cut up at once, and of different pieces that a worker remembers, each with what it takes besides its characters.
SLICE_BYTES, MEMO_BYTES, PIECE_BYTES = 8 << 20, 48 << 20, 160
#: Texts whose ids are put together at once.
ROWS = 256

_codecs: dict[str, PieceCodec] = {}


def by_bytes(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a batch of about ``most`` bytes each, at least one row, with the row each begins at."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


def give_back() -> None:
    """Give back to the machine what this worker holds free from the work before: workers outlive stages, and the peak of
    one would stay theirs in the next."""
    import gc

    gc.collect()
    trim()


def trim() -> None:
    """Give back what the allocators hold free."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


class PieceCodec:
    """Token ids of texts by a ``tokenizers`` file. ``drops_space``: the tokenizer drops all white space."""

    def __init__(self, path: str, drops_space: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.drops_space = drops_space
        # fixed values: how the byte-level alphabet writes the bytes that aren't printable
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(kept)))}
        self.marks = {c: self.tokenizer.model.tokenize(self.alphabet[ord(c)])[0].id for c in ".,\n"}
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("the vocabulary has more than 65,536 ids, which don't fit the 16 bits kept for each")
        model = self.tokenizer.model
        #: The model alone, if all that it makes of a word it makes of the word amid others, too.
        self.bare: Tokenizer | None = None
        if not drops_space and isinstance(model, models.BPE) and not (model.continuing_subword_prefix or model.end_of_word_suffix or model.dropout or model.ignore_merges):
            self.bare = Tokenizer(model)
        # which ids begin a word (a newline before it by itself alone, as the pre-tokenizer parts them), and which are a mark
        self.leads, self.is_mark = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        self.leads[[i for t, i in self.tokenizer.get_vocab(False).items() if t[:1] == self.alphabet[32] or t == self.alphabet[10]]] = True
        self.is_mark[[self.marks["."], self.marks[","]]] = True
        self.clear()

    @classmethod
    def of(cls, path: str, drops_space: bool = False) -> PieceCodec:
        """The worker's one codec of this file."""
        if path not in _codecs:
            _codecs[path] = cls(path, drops_space)
        return _codecs[path]

    @staticmethod
    def release() -> None:
        """Free what this worker remembers, where it goes on to other work."""
        _codecs.clear()
        give_back()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.starts, self.lengths, self.pool = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.uint16)
        self.used = self.filled = self.held = 0
        #: How many pieces and ids are kept, once the memory is full.
        self.most: tuple[int, int] | None = None

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Flat ids of words after white space and where each begins, from many at once; None if they can't be told apart.

        A model merges neighbours by rank alone, so words next to each other don't change each other unless a token
        lies across two of them or holds a mark and more: then fewer ids begin a word, or are a mark, than were given.
        """
        # spelled in the byte-level alphabet all at once; no word holds a tab
        texts = "\t".join("".join(words[at : at + JOINED]) for at in range(0, len(words), JOINED))
        n_marks = texts.count(".") + texts.count(",")
        spelled = texts.encode().decode("latin-1").translate(self.alphabet).split(self.alphabet[9])
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.bare.encode_batch_fast(spelled, add_special_tokens=False)), np.uint16)
        begins = np.flatnonzero(self.leads[ids])
        if len(begins) != len(words) or np.count_nonzero(self.is_mark[ids]) != n_marks:
            return None
        return ids, begins

    def _single(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces one by one: simple words by the library's model, all others by its whole pipeline."""
        found = [WORD.fullmatch(p) for p in pieces]
        others = [p for p, m in zip(pieces, found, strict=True) if m is None]
        rest = iter([e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)] if others else [])
        # spelled in the byte-level alphabet all at once; no word holds a newline
        words = [m[2].lower() if self.drops_space else m[2] if m[1] == "\n" else m[1] + m[2] for m in found if m is not None]
        spelled = iter("\n".join(words).encode().decode("latin-1").translate(self.alphabet).split(self.alphabet[10]))
        tokenize, get, marks = self.tokenizer.model.tokenize, self.code.get, self.marks
        out = []
        for m in found:
            if m is None:
                out.append(next(rest))
                continue
            space, _, mark = m.groups()
            word = next(spelled)
            if mark and (known := get(m.string[:-1])) is not None:
                # the same word without its mark is known, with all that comes before the word
                ids = self.pool[self.starts[known] : self.starts[known] + self.lengths[known]].tolist()
            else:
                ids = [t.id for t in tokenize(word)]
                if space == "\n" and not self.drops_space:
                    ids.insert(0, marks["\n"])
            if mark:
                ids.append(marks[mark])
            out.append(ids)
        return out

    def _store(self, at: np.ndarray, ids: np.ndarray, begins: np.ndarray) -> None:
        """Put ids into the pool; those of the piece with code ``at[i]`` begin at ``begins[i]``."""
        while len(at) and at[-1] >= len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.starts[at], self.lengths[at] = self.used + begins, np.diff(begins, append=len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _add(self, pieces: list[str]) -> None:
        """Encode pieces, some thousands at a time; they get the next codes and are remembered while there is room."""
        for at in range(0, len(pieces), 8192):
            some = pieces[at : at + 8192]
            led = np.zeros(len(some), bool)
            if self.bare is not None:
                led = pc.match_substring_regex(pa.array(some, pa.string()), LED_RE2).to_numpy(zero_copy_only=False)
                if led.any() and (found := self._joined([some[i] for i in np.flatnonzero(led).tolist()])):
                    self._store(self.filled + np.flatnonzero(led), *found)
                else:
                    led[:] = False
            encoded = self._single([some[i] for i in np.flatnonzero(~led).tolist()])
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            self._store(self.filled + np.flatnonzero(~led), np.fromiter(chain.from_iterable(encoded), np.uint16), np.cumsum(sizes) - sizes)
            if self.most is None:
                self.code.update(zip(some, range(self.filled, self.filled + len(some)), strict=True))
                self.held += sum(map(len, some)) + PIECE_BYTES * len(some)
            self.filled += len(some)
            if self.most is None and self.held > MEMO_BYTES:
                self.most = self.filled, self.used

    def _forget(self) -> None:
        """Drop what came after the memory was full; what came first is what recurs most."""
        if self.most is not None:
            self.filled, self.used = self.most

    def _codes(self, pieces: pa.Array) -> np.ndarray:
        """Codes of pieces that are all different."""
        own = pieces.to_numpy(zero_copy_only=False).tolist()
        got = np.fromiter(map(self.code.get, own, repeat(-1)), np.int32, len(own))
        if len(missing := np.flatnonzero(got < 0)):
            got[missing] = self.filled + np.arange(len(missing))
            self._add([own[i] for i in missing.tolist()])
        return got

    def _codes_of(self, pieces: pa.Array) -> np.ndarray:
        encoded = pieces.dictionary_encode()
        return self._codes(encoded.dictionary)[encoded.indices.to_numpy()]

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pieces of all texts, and the offsets at which each text's pieces begin."""
        if self.drops_space:
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            return self._codes_of(split.flatten()), _offsets(split)
        plain = pc.invert(pc.match_substring_regex(texts, f"[ \\t\\n\\r][ \\t\\n\\r]|\\t|\\r|{ODD_RE2}"))
        if pc.all(plain).as_py() or not len(texts):
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
            offsets, flat = _offsets(split), split.flatten()
            encoded = flat.dictionary_encode()
            words = encoded.dictionary
            led = pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise(" ", words, ""))
            codes = self._codes(led)[encoded.indices.to_numpy()]
            codes[offsets[:-1]] = self._codes_of(flat.take(pa.array(offsets[:-1])))  # the only pieces without a space before them
            return codes, offsets
        pieces = [[t] if ODD.search(t) else PIECE.findall(t) for t in texts.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        return self._codes_of(pa.array([p for own in pieces for p in own], pa.string())), offsets

    def lengths_of(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for at, some in by_bytes(texts):
            codes, offsets = self._cut(some)
            total = np.concatenate([[0], np.cumsum(self.lengths[codes], dtype=np.int64)])
            out[at : at + len(some)] = total[offsets[1:]] - total[offsets[:-1]]
            self._forget()
        return out

    def ids_of(self, texts: pa.Array, end: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By slices: the first row, the flat ids (with ``end`` after each text) and the offsets of the rows."""
        for at, some in by_bytes(texts):
            codes, offsets = self._cut(some)
            if end is not None:
                # a piece more for each text, with the next code
                self._store(np.array([self.filled]), np.array([end], np.uint16), np.array([0]))
                codes, offsets = np.insert(codes, offsets[1:], self.filled), offsets + np.arange(len(offsets))
                self.used -= 1
            bounds = np.zeros(len(offsets), np.int64)
            flat = []
            for row in range(0, len(some), ROWS):  # some texts at a time: places take several times the room of ids
                own = offsets[row : row + ROWS + 1]
                of = codes[own[0] : own[-1]]
                sizes = self.lengths[of]
                ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                bounds[row : row + len(own)] = bounds[row] + ends[own - own[0]]
                places = np.arange(ends[-1])
                places += np.repeat(self.starts[of] - ends[:-1], sizes)
                flat.append(self.pool[places])
            del codes
            self._forget()
            trim()
            yield at, np.concatenate(flat), bounds


def _offsets(lists: pa.ListArray) -> np.ndarray:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0]
