"""Byte-level BPE by rank-synchronous array merging.

A text splits into pre-tokens. Pre-tokens not met before are held as one ragged numpy array and
merged in rounds: each round finds every sequence's lowest-rank adjacent pair and applies all of
that pair's non-overlapping occurrences, in all sequences at once. Symbols that survive are the
tokens. Long pre-tokens (base64, unspaced scripts) are held as linked arrays instead, with places listed by
the rank of their pair: a round takes the least rank that any of them has, applies it wherever it still
occurs, and looks again only at the pairs it made, so the work grows with the merges and not with rounds times
length. Ids of frequent pre-tokens stay in a bounded table of the worker.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from itertools import compress, count, repeat
from operator import is_

import numpy as np
import regex

#: The fixed pre-token pattern of byte-level tokenizers of this family.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII alone, in which these are all letters and figures there are.
PRETOKEN_ASCII = PRETOKEN.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace(" ?a-zA-Z+", " ?[a-zA-Z]+").replace(" ?0-9+", " ?[0-9]+")
#: Pre-tokens whose ids a worker keeps; those met later are merged anew each time.
KEEP = 250_000
#: Pre-tokens of more bytes are merged over linked arrays and not kept.
LONG = 192
NEVER = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merger:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.base = np.array([vocabulary[c] for c in byte_symbols()], dtype=np.int64)
        self.width = np.int64(max(vocabulary.values()) + 1)
        keys = np.array([vocabulary[a] * int(self.width) + vocabulary[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
        self.by_rank, self.made_by_rank = keys, made
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], np.append(order.astype(np.int64), NEVER), made[order]
        self.byte_pairs, _ = self.found((self.base[:, None] * self.width + self.base).reshape(-1))

    def found(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair is among the merges (behind them: nowhere), and its rank (NEVER)."""
        at = np.searchsorted(self.keys, key)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != key] = len(self.keys)
        return at, self.rank[at]

    def ids(self, sequences: list[bytes]) -> list[bytes]:
        """Token ids of each (non-empty) byte sequence, as little-endian unsigned 32-bit integers."""
        long = [i for i, s in enumerate(sequences) if len(s) > LONG]
        if not long:
            return self.in_rounds(sequences)
        rest = iter(self.in_rounds([s for s in sequences if len(s) <= LONG]))
        made = dict(zip(long, self.in_links([sequences[i] for i in long]), strict=True))
        return [made[i] if i in made else next(rest) for i in range(len(sequences))]

    def in_links(self, sequences: list[bytes]) -> list[bytes]:
        """As in_rounds; what is done grows with the merges, whatever the sequences' lengths."""
        ends = np.cumsum(np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences)) + 1)
        # one stop (symbol -1) behind each sequence, and one before the first by index -1
        symbols = np.full(ends[-1] + 1, -1, dtype=np.int64)
        for s, end in zip(sequences, ends.tolist(), strict=True):
            symbols[end - 1 - len(s) : end - 1] = self.base[np.frombuffer(s, dtype=np.uint8)]
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(places: np.ndarray) -> None:
            places = places[(symbols[places] >= 0) & (symbols[after[places]] >= 0)]
            _, rank = self.found(symbols[places] * self.width + symbols[after[places]])
            known = rank < NEVER
            places, rank = places[known], rank[known]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else []
            for r, group in zip(rank[cuts].tolist() if len(rank) else [], np.split(places, cuts[1:]) if len(rank) else [], strict=True):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(group)

        note(np.arange(len(symbols) - 1))
        while ranks:
            r = heapq.heappop(ranks)
            hit = np.unique(np.concatenate(waiting.pop(r)))
            left, right = divmod(int(self.by_rank[r]), int(self.width))
            hit = hit[symbols[hit] == left]
            hit = hit[symbols[after[hit]] == right]
            if left == right and len(hit):  # a run of one symbol: every second place, from the left
                start = np.flatnonzero(np.r_[True, after[hit[:-1]] != hit[1:]])
                inner = np.arange(len(hit)) - np.repeat(start, np.diff(np.r_[start, len(hit)]))
                hit = hit[inner % 2 == 0]
            if not len(hit):
                continue
            gone = after[hit]
            symbols[hit], symbols[gone] = self.made_by_rank[r], -2
            after[hit] = after[gone]
            before[after[hit]] = hit
            ahead = before[hit]
            note(np.unique(np.r_[hit, ahead[ahead >= 0]]))
        out, start = [], 0
        for end in ends.tolist():
            own = symbols[start : end - 1]
            out.append(own[own >= 0].astype("<u4").tobytes())
            start = end
        return out

    def in_rounds(self, sequences: list[bytes]) -> list[bytes]:
        """All sequences at once, one round for each merge of the longest; for short ones.

        Pairs of bytes have a table of their own; after a round only the pairs it made are looked up.
        """
        if not sequences:
            return []
        lengths = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
        data = np.frombuffer(b"".join(sequences), dtype=np.uint8)
        symbols, owner = self.base[data], np.repeat(np.arange(len(sequences)), lengths)
        pair = np.append(data[:-1].astype(np.int64) << 8 | data[1:], 0)  # with the symbol behind
        at = self.byte_pairs[pair]
        at[np.cumsum(lengths) - 1] = len(self.keys)
        done_owner, done_symbols = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank = self.rank[at]
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            over = np.repeat(best == NEVER, sizes)
            hit = np.flatnonzero((rank == np.repeat(best, sizes)) & ~over)
            stay = ~over
            if len(hit):
                # overlapping occurrences (a run of one symbol): every second one, from the left
                new_run = np.r_[True, hit[1:] != hit[:-1] + 1]
                first = hit[new_run][np.cumsum(new_run) - 1]
                hit = hit[(hit - first) % 2 == 0]
                symbols[hit] = self.made[at[hit]]
                stay[hit + 1] = False
            if over.any():
                done_owner.append(owner[over])
                done_symbols.append(symbols[over])
            place = np.cumsum(stay) - 1  # where a symbol goes
            symbols, owner, at = symbols[stay], owner[stay], at[stay]
            if len(hit):
                made = place[hit]
                new = np.zeros(len(symbols) + 1, dtype=bool)
                new[made] = new[made - 1] = True  # the last is no symbol: there is none before the first
                look = np.flatnonzero(new[:-1])
                behind = np.minimum(look + 1, len(symbols) - 1)
                found, _ = self.found(symbols[look] * self.width + symbols[behind])
                at[look] = np.where((behind > look) & (owner[look] == owner[behind]), found, len(self.keys))
        owner, symbols = np.concatenate(done_owner), np.concatenate(done_symbols)
        order = np.argsort(owner, kind="stable")
        return _parts(symbols[order], np.cumsum(np.bincount(owner, minlength=len(sequences))))


def _parts(symbols: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Symbols as bytes, cut at the ends."""
    data, cuts = symbols.astype("<u4").tobytes(), (4 * ends).tolist()
    return [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


class Encoder:
    """Texts to ids, as the library gives them for the same file without added special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merger = Merger(spec["model"]["vocab"], merges)
        self.any_pieces, self.ascii_pieces = regex.compile(PRETOKEN).findall, re.compile(PRETOKEN_ASCII, re.ASCII).findall
        added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in spec["added_tokens"]}
        self.added = added
        self.apart = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return self.ascii_pieces(text) if text.isascii() else self.any_pieces(text)

    def split(self, text: str) -> list[str]:
        """Pre-tokens; an added token's string is one of its own."""
        if self.apart is None or not self.apart.search(text):
            return self.pieces(text)
        out, end = [], 0
        for m in self.apart.finditer(text):
            out += self.pieces(text[end : m.start()])
            out.append(m[0])
            end = m.end()
        return out + self.pieces(text[end:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        known, found, gaps, new = self.known, [], [], {}
        for text in texts:
            pieces = self.split(text)
            ids = list(map(known.get, pieces))
            gap = [(i, pieces[i]) for i in compress(count(), map(is_, ids, repeat(None)))]
            new.update((p, self.added.get(p)) for _, p in gap)
            found.append(ids)
            gaps.append(gap)
        plain = [p for p, ids in new.items() if ids is None]
        new.update(zip(plain, self.merger.ids([p.encode() for p in plain]), strict=True))
        for ids, gap in zip(found, gaps, strict=True):
            for i, p in gap:
                ids[i] = new[p]
        if len(known) < KEEP:
            known.update((p, ids) for p, ids in new.items() if len(p) <= LONG)
        return list(map(b"".join, found))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)
