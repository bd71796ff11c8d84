"""Byte-level BPE in linear time, with the ids of a public rank file.

A rank file lists tokens as bytes with their rank, which is also the id; merges happen in rank
order. Encoding runs no merge loop. An automaton over all tokens (bytes mapped to Latin-1
characters) gives the tokens that start at each place; the longest is tried first. A token may
follow the one before only if the two are compatible, that is, if merging their joined bytes would
leave exactly this seam; the answer for a pair of tokens is remembered. Where no token fits, the last
one is taken back and a shorter one tried, and the place is marked so that it is never tried again;
each place is marked once, so the time is linear in the text. Greedy longest match with compatible
neighbours is the one segmentation that the merges yield.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from functools import cache
from pathlib import Path

import ahocorasick
import regex

#: Fixed value: how byte-level BPE files of this kind split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces of text whose ids are remembered in each worker.
PIECES = 500_000


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a vocabulary file: LODESPARK_TOKENIZERS, the installed vocabularies, or /opt/tokenizers."""
    folder = os.environ.get("LODESPARK_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = str(Path(spec.origin).parent) if spec and spec.origin else "/opt/tokenizers"
    return str(Path(folder) / name)


class BytePairEncoder:
    """Encodes texts by the ranks of one file."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        lines = Path(path).read_bytes().split(b"\n")
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        self.split_text = regex.compile(pattern).findall
        self.rank_of = {t.decode("latin-1"): r for t, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank_of.items():
            self.automaton.add_word(t, (len(t), r))
        self.automaton.make_automaton()
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits_memo: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}
        for t, r in sorted(self.rank_of.items(), key=lambda x: x[1]):
            two = [r, r] if len(t) == 1 else self._two(t, r)
            self.halves[r] = (two[0], two[1])
            if len(t) > 1:
                self.pair_rank[(two[0], two[1])] = r

    def _two(self, token: str, rank: int) -> list[int]:
        """The two tokens whose merge makes ``token``: its bytes merged by the ranks before its own."""
        parts = [self.rank_of[c] for c in token]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.pair_rank.get((parts[i], parts[i + 1]), rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                raise ValueError(f"token {rank} can't be made by merges")
            parts[at : at + 2] = [best]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left``: no merge across the seam comes before those that made the two."""
        key = (left, right)
        known = self.fits_memo.get(key)
        if known is None:
            if len(self.fits_memo) > 2_000_000:
                self.fits_memo.clear()
            known = self.fits_memo[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, a: int, b: int) -> bool:
        halves, pair_rank = self.halves, self.pair_rank
        before = 1 << 60  # merges of this rank or later are undone at the seam
        while True:
            if pair_rank.get((a, b), before) < before:
                return False
            if a > b:  # a was made last of the two: look at its right half
                before, inner = a, halves[a][1]
                if inner == a:
                    before, inner = b + 1, halves[b][0]
                    if inner == b:
                        return True
                    b = inner
                else:
                    a = inner
            else:
                before, inner = b + 1, halves[b][0]
                if inner == b:
                    before, inner = a, halves[a][1]
                    if inner == a:
                        return True
                    a = inner
                else:
                    b = inner

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as Latin-1 characters."""
        whole = self.rank_of.get(piece)
        if whole is not None:
            return [whole]
        starts: list[list[tuple[int, int]]] = [[] for _ in piece]
        for end, (length, rank) in self.automaton.iter(piece):
            starts[end + 1 - length].append((length, rank))  # shorter ones come first
        n, at = len(piece), 0
        dead = bytearray(n + 1)
        ids: list[int] = []
        lengths: list[int] = []
        nth = [len(s) for s in starts]  # how many candidates of each start are still untried
        while at < n:
            found = False
            while nth[at]:
                nth[at] -= 1
                length, rank = starts[at][nth[at]]
                if not dead[at + length] and (not ids or self.fits(ids[-1], rank)):
                    ids.append(rank)
                    lengths.append(length)
                    at += length
                    found = True
                    break
            if not found:
                dead[at] = 1
                at -= lengths.pop()
                ids.pop()
            elif at < n:
                nth[at] = len(starts[at])
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; [] for null and empty. Strings of special tokens are ordinary text."""
        out: list[int] = []
        if not text:
            return out
        pieces = self.pieces
        for p in self.split_text(text):
            ids = pieces.get(p)
            if ids is None:
                if len(pieces) > PIECES:
                    pieces.clear()
                ids = self.encode_piece(p.encode().decode("latin-1"))
                if len(p) <= 64:
                    pieces[p] = ids
            out += ids
        return out


@cache
def encoder(path: str) -> BytePairEncoder:
    """The encoder of a file, built once in each worker."""
    return BytePairEncoder(path)
