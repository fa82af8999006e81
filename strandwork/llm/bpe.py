"""Byte-pair encoding of whole corpora by walking a trie of distinct words.

A word's prefixes form a path in the trie; each node keeps one thing, the last token of the encoding of its prefix. That
token is the one vocabulary entry which ends the prefix and stays apart from the last token of the prefix before
it, so a node's state follows from its ancestors' states alone, and a prefix shared by many words is encoded once. The
ids of a word are read backwards from its node."""

from __future__ import annotations

import base64

import numpy as np
import regex

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value of the vocabulary: the pattern that splits text into words before any merge.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_KEPT_WORDS = 300_000
_ENCODERS: dict[int, "TrieEncoder"] = {}
_NEVER = 1 << 60


def encoder(ranks: bytes) -> "TrieEncoder":
    """The encoder of a rank file's content; one per worker process, whatever number of tasks it runs."""
    key = hash(ranks)
    if key not in _ENCODERS:
        _ENCODERS[key] = TrieEncoder(ranks)
    return _ENCODERS[key]


class TrieEncoder:
    def __init__(self, ranks: bytes):
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes = {i: b for b, i in self.rank.items()}
        #: For each ending of three bytes, the lengths of the tokens that can end there, longest first.
        self._lengths: dict[bytes, list[int]] = {}
        for b in sorted(self.rank, key=len, reverse=True):
            if len(b) > 2 and (own := self._lengths.setdefault(b[-3:], []))[-1:] != [len(b)]:
                own.append(len(b))
        for end, own in self._lengths.items():
            own += [2, 1] if end[1:] in self.rank else [1]
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[tuple[int, int], bool] = {}
        self._words: dict[str, np.ndarray] = {}
        self._split = regex.compile(WORD_PATTERN).findall

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self._halves:
            parts = [self.rank[bytes([b])] for b in self.bytes[token]]
            while len(parts) > 2:
                joined = [self.rank.get(self.bytes[a] + self.bytes[b], _NEVER) for a, b in zip(parts, parts[1:])]
                at = min(range(len(joined)), key=joined.__getitem__)
                if joined[at] >= token:
                    raise ValueError(f"token {token} does not follow from earlier merges")
                parts[at : at + 2] = [joined[at]]
            self._halves[token] = tuple(parts) if len(parts) == 2 else None
        return self._halves[token]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens at one edge (0 left, 1 right) of a token while it is built, outermost last, each with the rank that absorbs it."""
        out, until = [], _NEVER
        while True:
            out.append((token, until))
            parts = self.halves(token)
            if parts is None:
                return out[::-1]
            token, until = parts[side], token

    def apart(self, a: int, b: int) -> bool:
        """Whether a followed by b is left as two tokens: no merge across the border comes before both sides have grown past it."""
        known = self._apart.get((a, b))
        if known is None:
            left, right = self._edge(a, 1), self._edge(b, 0)
            known, i, j = True, 0, 0
            while i < len(left) and j < len(right):
                (x, x_until), (y, y_until) = left[i], right[j]
                m = self.rank.get(self.bytes[x] + self.bytes[y])
                if m is not None:
                    when = max(m, x if len(self.bytes[x]) > 1 else -1, y if len(self.bytes[y]) > 1 else -1)
                    if when < x_until and when <= y_until:
                        known = False
                        break
                if x_until <= y_until:
                    i += 1
                if y_until <= x_until:
                    j += 1
            self._apart[(a, b)] = known
        return known

    def learn(self, words: set[str]) -> None:
        """Encode new distinct words by one depth-first walk over their trie."""
        trie: dict = {}
        for w in words:
            node = trie
            for b in w.encode():
                node = node.setdefault(b, {})
            node[-1] = w
        rank, apart, lengths = self.rank, self.apart, self._lengths
        path = bytearray()
        last: list[int] = []  # last[i]: last token of the encoding of path[: i + 1]
        size: list[int] = []
        stack = [(trie, iter(trie.items()))]
        while stack:
            node, children = stack[-1]
            step = next(children, None)
            if step is None:
                stack.pop()
                if path:
                    path.pop()
                    last.pop()
                    size.pop()
                continue
            b, child = step
            if b == -1:
                ids, at = [], len(path)
                while at:
                    ids.append(last[at - 1])
                    at -= size[at - 1]
                self._words[child] = np.array(ids[::-1], dtype=np.int32)
                continue
            path.append(b)
            prefix = bytes(path)
            n = len(prefix)
            for k in lengths.get(prefix[-3:], (2, 1)):
                if k > n:
                    continue
                t = rank.get(prefix[n - k :])
                if t is not None and (k == n or apart(last[n - k - 1], t)):
                    last.append(t)
                    size.append(k)
                    break
            stack.append((child, iter(child.items())))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of each text; null and empty texts give none."""
        split = [self._split(t) if t else [] for t in texts]
        if len(self._words) > _KEPT_WORDS:
            self._words.clear()
        known = self._words
        new = {w for ws in split for w in ws if w not in known}
        if new:
            self.learn(new)
        none = np.empty(0, dtype=np.int32)
        return [np.concatenate([known[w] for w in ws]) if ws else none for ws in split]
