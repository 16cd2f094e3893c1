"""Token ids of whole texts with a public byte-level BPE tokenizer.

Such a tokenizer never joins what stands on either side of a blank between two
words, so a text is cut there and each different piece is encoded once per worker
(the pieces are remembered up to a bound).  Arrow cuts a slice of texts and numbers
its different pieces; only those are looked up one by one.  New pieces are encoded
many at a time, one to a line: a line end between words is always an id of its own.
Texts with blanks beside other white space, or with the string of a special token,
are encoded whole.  Pieces of letters alone are one word for the tokenizer, so they
go to a second one that cuts at line ends only, without its pattern.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from seqthin.llm.batches import ranges, worker_state

PIECES_KEPT = 600_000
LINES_PER_CALL = 200
SPECIAL = "<|endoftext|>"
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
LETTERS_ALONE = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: Words the library itself remembers; pieces never come twice, so they pass it by.
WORDS_REMEMBERED = 10_000
BLANK_BESIDE_SPACE = f" [{SPACES}]|[{SPACES}] "


def encoded_whole(texts: pa.Array) -> np.ndarray:
    """Which texts must not be cut at their blanks."""
    odd = pc.or_(pc.match_substring_regex(texts, BLANK_BESIDE_SPACE), pc.match_substring(texts, SPECIAL))
    return odd.to_numpy(zero_copy_only=False)


def remember(tokenizer, words: int) -> None:
    """How many words the library remembers, where it lets us say."""
    if hasattr(tokenizer.model, "_resize_cache"):
        tokenizer.model._resize_cache(words)


class Encoder:
    """Ids of texts; equal to encoding every text whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.of_words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        ])
        for tokenizer in (self.tokenizer, self.of_words):
            remember(tokenizer, 0)
        (self.line_end,) = self._ids(["\n"])[0]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, texts: list[str], tokenizer=None) -> list[list[int]]:
        return [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[str], tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        ids = self._ids(texts, tokenizer)
        flat = np.concatenate([np.array(x, np.uint32) for x in ids]) if ids else np.zeros(0, np.uint32)
        return flat, np.array(list(map(len, ids)), np.int64)

    def _lines(self, pieces: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces after a blank, one to a line."""
        calls = [" " + "\n ".join(pieces[i : i + LINES_PER_CALL]) + "\n" for i in range(0, len(pieces), LINES_PER_CALL)]
        ids, _ = self._each(calls, tokenizer)
        ends = np.flatnonzero(ids == self.line_end)
        return ids[ids != self.line_end], np.diff(np.concatenate(([-1], ends))) - 1

    def _learn(self, new: np.ndarray) -> None:
        """Number and encode pieces that are not known."""
        self.known.update(zip(new.tolist(), range(len(self.known), len(self.known) + len(new))))
        of_letters = pc.match_substring_regex(pa.array(new, pa.string()), LETTERS_ALONE).to_numpy(zero_copy_only=False)
        # Lines hold pieces that neither touch the line end with white space nor contain one.
        others = new[~of_letters].tolist()
        is_plain = of_letters.copy()
        is_plain[~of_letters] = [bool(p) and "\n" not in p and p.strip() == p for p in others]
        parts = (
            (of_letters, lambda p: self._lines(p, self.of_words)),
            (is_plain & ~of_letters, lambda p: self._lines(p, self.tokenizer)),
            (~is_plain, lambda p: self._each([" " + x for x in p])),
        )
        flat, sizes, first, done = [self.flat], np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), 0
        for some, encode in parts:
            if some.any():
                ids, n = encode(new[some].tolist())
                sizes[some], first[some] = n, done + np.cumsum(n) - n
                flat.append(ids)
                done += len(ids)
        ids = np.concatenate(flat[1:])
        self.flat = np.concatenate([self.flat, ids[ranges(first, sizes)]])
        self.sizes = np.concatenate([self.sizes, sizes])

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32), and how many each text has; null is empty."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.known) > PIECES_KEPT:
            self.forget()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        whole = encoded_whole(texts)
        cut = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
        pieces, offsets = cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        opens = np.zeros(len(pieces), bool)
        opens[offsets[:-1]] = True
        openings = np.empty(len(texts), object)
        openings[whole] = texts.filter(pa.array(whole)).to_numpy(zero_copy_only=False)
        openings[~whole] = pieces.filter(pa.array(opens)).to_numpy(zero_copy_only=False)
        rest = pieces.filter(pa.array(~opens)).dictionary_encode()
        different = rest.dictionary.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.known.get, different, repeat(-1)), np.int64, len(different))
        if (new := number < 0).any():
            number[new] = len(self.known) + np.arange(new.sum())
            self._learn(different[new])
        rest_at = number[rest.indices.to_numpy()]
        if whole.any():
            remember(self.tokenizer, WORDS_REMEMBERED)
        opened, opened_sizes = self._each(openings.tolist())
        if whole.any():
            remember(self.tokenizer, 0)
        n_pieces = np.ones(len(texts), np.int64)
        n_pieces[~whole] = np.diff(offsets)
        flat = np.concatenate([self.flat, opened])
        sizes = np.concatenate([self.sizes, opened_sizes])
        first = np.cumsum(sizes) - sizes
        starts = np.cumsum(n_pieces) - n_pieces
        at = np.empty(int(n_pieces.sum()), np.int64)
        opens = np.zeros(len(at), bool)
        opens[starts] = True
        at[opens] = len(self.sizes) + np.arange(len(texts))
        at[~opens] = rest_at
        sizes = sizes[at]
        return flat[ranges(first[at], sizes)], np.add.reduceat(sizes, starts)


def encoder(path: str) -> Encoder:
    return worker_state(("encoder", path), lambda: Encoder(path))


def with_end(ids: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every document closed by ``end``."""
    sizes = n + 1
    out = np.full(int(sizes.sum()), end, np.uint32)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(sizes) - 1] = False
    out[inner] = ids
    return out, sizes
