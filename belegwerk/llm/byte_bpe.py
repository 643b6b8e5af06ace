"""Byte-level BPE by depth-first traversal of a trie of distinct words.

The encoding of a prefix is fixed by its last token: it is the encoding of what
stands before that token, followed by it, and of all tokens that end there just
one is compatible with the last token before. Words are visited in sorted order,
which is the depth-first order of their trie; a path holds the last token of each
prefix, so a prefix shared by many words is encoded once.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from tokenizers import pre_tokenizers

from belegwerk.llm.arrow_text import slices, spread, strings

LETTER, NUMBER, OTHER, BLANK, UNKNOWN = range(5)
SUFFIXES = ("s", "t", "m", "d", "re", "ve", "ll")  # after an apostrophe: tokens of their own


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Encoder:
    """Encodes and decodes batches of texts with a byte-level BPE vocabulary file."""

    KNOWN_WORDS = 300_000
    KNOWN_PAIRS = 2_000_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_characters()
        as_bytes = lambda token: bytes(chars[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.token = {as_bytes(t): i for t, i in vocab.items()}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: t for t, i in (self.token | self.special).items()}
        self.longest = max(map(len, self.token))
        count = max(self.bytes_of) + 1
        self.size = [len(self.bytes_of.get(i, b"")) for i in range(count)]
        self.merges: dict[tuple[int, int], int] = {}  # pair: rank
        self.rank = [-1] * count  # of the merge that makes a token; -1: a single byte
        self.parts: list[tuple[int, int] | None] = [None] * count
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pair, made = (vocab[left], vocab[right]), vocab[left + right]
            self.merges[pair] = rank
            if self.parts[made] is None:
                self.parts[made], self.rank[made] = pair, rank
        self.find_special = re.compile(b"|".join(map(re.escape, self.special)) or b"(?!)")
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.rule = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.table_at = np.zeros(len(table) + 1, np.int64)
        np.cumsum([len(t) for t in table], out=self.table_at[1:])
        self.table = np.frombuffer(b"".join(table), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Empty the memory of encoded words; special tokens are words from the start."""
        self.known = {w: array("i", [i]).tobytes() for w, i in self.special.items()}

    # ---- words -------------------------------------------------------------
    def classify(self, points: np.ndarray) -> np.ndarray:
        """Letter, number, blank or other, as the library's own rule groups characters."""
        kinds = self.kinds[points]
        if (kinds == UNKNOWN).any():
            one = lambda text: len(self.rule.pre_tokenize_str(text)) == 1
            for point in np.unique(points[kinds == UNKNOWN]).tolist():
                c = chr(point)
                self.kinds[point] = (
                    LETTER if one("a" + c) else NUMBER if one("1" + c) else OTHER if one("!" + c) else BLANK
                )
            kinds = self.kinds[points]
        return kinds

    def word_starts(self, body: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Byte offsets where the words of all texts start, by the splitting rule.

        A blank joins the word behind it, other white space before it stands
        alone, an apostrophe with a known ending is a word; nothing crosses the
        end of a text or a special token.
        """
        if not len(body):
            return np.zeros(0, np.int64)
        raw = body.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        place = np.flatnonzero((body & 0xC0) != 0x80)  # of each character
        kinds = self.classify(points)
        n = len(points)
        edge = np.zeros(n + 1, bool)
        edge[np.searchsorted(place, at)] = True
        marks = [m.span() for m in self.find_special.finditer(raw)] if self.special else []
        own = np.searchsorted(place, np.array([p for p in marks], np.int64).reshape(-1, 2))
        # A special token that two neighbouring texts only form together is none.
        own = own[[not edge[a + 1:b].any() for a, b in own]] if len(own) else own
        edge[own.ravel()] = True

        start = np.ones(n + 1, bool)
        start[1:n] = kinds[1:] != kinds[:-1]
        start |= edge
        blank = kinds == BLANK
        run_end = np.flatnonzero(blank[:-1] & ~blank[1:] & ~edge[1:n]) + 1  # a word follows
        start[run_end - 1] = True
        start[run_end[points[run_end - 1] == 0x20]] = False
        for ending in SUFFIXES:
            size = len(ending) + 1
            if n < size:
                continue
            hit = (points[:n - size + 1] == 0x27) & start[:n - size + 1] & start[1:n - size + 2]
            for k, c in enumerate(ending, 1):
                hit &= (points[k:n - size + 1 + k] == ord(c)) & ~edge[k:n - size + 1 + k]
            hit = np.flatnonzero(hit)
            start[hit + 1] = False
            start[hit + size] = True
        for a, b in own:
            start[a + 1:b] = False
        return place[np.flatnonzero(start[:n])]

    # ---- merges ------------------------------------------------------------
    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes.

        Undo the latest merge at their border again and again. If a merge across
        the border would have come before the one undone, merging would have
        taken it and the two tokens could not stand there.
        """
        key = (left, right)
        if len(self.fits) >= self.KNOWN_PAIRS:
            self.fits.clear()
        rank, parts, merges = self.rank, self.parts, self.merges
        limit = len(merges)
        while True:
            across = merges.get((left, right))
            if across is not None and across < limit:
                self.fits[key] = False
                return False
            if rank[left] > rank[right]:  # of equal merges the left one comes first
                limit, left = rank[left], parts[left][1]
            elif rank[right] >= 0:
                limit, right = rank[right] + 1, parts[right][0]
            else:
                self.fits[key] = True
                return True

    def alone(self, token: int) -> bool:
        """Whether a token is the encoding of its own bytes."""
        known = self.whole.get(token)
        if known is None:
            parts = self.parts[token]
            known = parts is None or all(map(self.alone, parts)) and self._merges_last(token)
            self.whole[token] = known
        return known

    def _merges_last(self, token: int) -> bool:
        """No merge across the two parts comes before they are complete."""
        left, right = self.parts[token]
        own, rank, parts = self.rank[token], self.rank, self.parts
        limit = own
        while True:
            across = self.merges.get((left, right))
            if across is not None and across != own and across < limit:
                return False
            if rank[left] > rank[right]:
                limit, left = rank[left], parts[left][1]
            elif rank[right] >= 0:
                limit, right = rank[right] + 1, parts[right][0]
            else:
                return True

    def encode_words(self, distinct: list[bytes]) -> None:
        """Encode sorted distinct words: one depth-first walk over their trie.

        ``last`` holds the last token of each prefix on the current path, found
        when an encoding first needs it and kept while the walk stays below.
        """
        token, fits, longest, size = self.token, self.fits, self.longest, self.size
        last: list[int | None] = [None]
        word = before = b""

        def find(end: int) -> int:
            for begin in range(max(0, end - longest), end):
                t = token.get(word[begin:end])
                if t is None:
                    continue
                if begin:
                    previous = last[begin]
                    if previous is None:
                        previous = find(begin)
                    fit = fits.get((previous, t))
                    if fit is None:
                        fit = self.compatible(previous, t)
                else:
                    fit = self.alone(t)
                if fit:
                    last[end] = t
                    return t
            raise ValueError(f"the vocabulary cannot encode {word!r}")

        for word in distinct:
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del last[depth + 1:]
            last.extend([None] * (len(word) - depth))
            for end in range(64, len(word), 64):  # keeps the recursion flat in long words
                if last[end] is None:
                    find(end)
            found, end = [], len(word)
            while end:
                t = last[end]
                if t is None:
                    t = find(end)
                found.append(t)
                end -= size[t]
            found.reverse()
            self.known[word] = array("i", found).tobytes()
            before = word

    # ---- texts -------------------------------------------------------------
    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts and ``n + 1`` offsets into them; null is empty."""
        ids, counts = [], []
        for _, _, body, at in slices(texts):
            starts = self.word_starts(body, at)
            if not len(starts):
                counts.append(np.zeros(len(at) - 1, np.int64))
                continue
            coded = strings(body, np.append(starts, len(body))).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(self.known) > self.KNOWN_WORDS:
                self.forget()
            self.encode_words(sorted(w for w in distinct if w not in self.known))
            encoded = [self.known[w] for w in distinct]
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
            pool = np.frombuffer(b"".join(encoded), np.int32)
            index = coded.indices.to_numpy(zero_copy_only=False)
            per_word = sizes[index]
            ids.append(pool[spread((np.cumsum(sizes) - sizes)[index], per_word)])
            total = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(per_word, out=total[1:])
            counts.append(np.diff(total[np.searchsorted(starts, at)]))
        bounds = np.zeros(len(texts) + 1, np.int64)
        if counts:
            np.cumsum(np.concatenate(counts), out=bounds[1:])
        return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of the id runs; special tokens stay, broken UTF-8 becomes U+FFFD."""
        sizes = (self.table_at[1:] - self.table_at[:-1])[ids]
        body = self.table[spread(self.table_at[ids], sizes)].tobytes()
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        at = total[bounds].tolist()
        return [body[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)
