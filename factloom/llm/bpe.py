"""Prefix dynamic programming over byte-pair encodings.

The encoding of a string ends with the one token t for which the encoding of the rest ends with a token that t may follow:
a pair may stand side by side if the pair's joined string is encoded as just this pair. So one pass from left to right
gives the last token, and with it the number of tokens, of every prefix.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

Trie = dict  # letter: the trie behind it; "": True where a token ends


def merged(symbols: list[str], rank: Callable[[str, str], float]) -> list[str]:
    """Byte-pair merging: the pair of lowest rank first, the leftmost of equals. n log n steps."""
    none, own, n = float("inf"), list(symbols), len(symbols)
    if n < 12:
        while len(own) > 1:
            best, at = min((rank(own[i], own[i + 1]), i) for i in range(len(own) - 1))
            if best == none:
                break
            own[at : at + 2] = [own[at] + own[at + 1]]
        return own
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, own[i], own[i + 1]) for i in range(n - 1) if (r := rank(own[i], own[i + 1])) < none]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if own[i] == a else n
        if j >= n or own[j] != b:
            continue  # one of both has been merged meanwhile
        own[i], own[j] = a + b, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank(own[i], own[k])) < none:
                heapq.heappush(heap, (r, i, own[i], own[k]))
        if (h := before[i]) >= 0 and (r := rank(own[h], own[i])) < none:
            heapq.heappush(heap, (r, h, own[h], own[i]))
    return [s for s in own if s]


def backwards(tokens: Iterable[str]) -> Trie:
    """A trie of the tokens, read from their last letter on."""
    root: Trie = {}
    for t in tokens:
        at = root
        for c in reversed(t):
            at = at.setdefault(c, {})
        at[""] = True
    return root


def ending_at(trie: Trie, word: str, i: int) -> list[int]:
    """Where tokens begin that end at word[:i], the longest first."""
    found, at = [], trie
    while i:
        i -= 1
        at = at.get(word[i])
        if at is None:
            break
        if "" in at:
            found.append(i)
    found.reverse()
    return found


class PrefixCoder:
    """tokens: the strings that can be tokens inside of a word; rank: of a merge of two strings, infinite if there is none;
    split: the smallest symbols of a string; end: what the last token of a word has behind it."""

    def __init__(self, tokens: set[str], rank: Callable[[str, str], float], split: Callable[[str], list[str]] = list, end: str = ""):
        self.rank, self.split, self.end = rank, split, end
        self.usable = {t for t in tokens if merged(self._symbols(t), rank) == [t]}
        self.inner = backwards(self.usable)
        self.last = backwards(t[: -len(end)] for t in self.usable if end and t.endswith(end) and t != end) if end else self.inner
        self.pairs: dict[tuple[str, str], bool] = {}

    def _symbols(self, t: str) -> list[str]:
        if self.end and t.endswith(self.end) and len(t) > len(self.end):
            own = self.split(t[: -len(self.end)])
            return [*own[:-1], own[-1] + self.end]
        return self.split(t)

    def follows(self, a: str, b: str) -> bool:
        key = (a, b)
        if (got := self.pairs.get(key)) is None:
            got = merged([*self._symbols(a), *self._symbols(b)], self.rank) == [a, b]
            if len(self.pairs) < 1_000_000:
                self.pairs[key] = got
        return got

    def grow(self, word: str, last: list[str], count: list[int]) -> None:
        """Goes on from a prefix of the word, whose last tokens and numbers of tokens are known, to all of it."""
        for i in range(len(last), len(word) + 1):
            for k in ending_at(self.inner, word, i):
                t = word[k:i]
                if not k or self.pairs.get((last[k], t)) or self.follows(last[k], t):
                    last.append(t)
                    count.append(count[k] + 1)
                    break
            else:  # a symbol that no token covers stands alone
                last.append(word[i - 1])
                count.append(count[i - 1] + 1)

    def prefixes(self, word: str) -> tuple[list[str], list[int]]:
        """Last token and number of tokens of each prefix, from the empty one on, as they are inside of a word."""
        last, count = [""], [0]
        self.grow(word, last, count)
        return last, count

    def ended(self, word: str, i: int, last: list[str]) -> tuple[str, int]:
        """The last token of word[:i] when the word ends there, and where it begins."""
        for k in ending_at(self.last, word, i):
            t = word[k:i] + self.end
            if not k or self.follows(last[k], t):
                return t, k
        return "", i - 1
