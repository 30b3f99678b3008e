"""Marginal log-probability of words over all segmentations into vocabulary pieces.

Text is split at white space and every word gets the vocabulary's word mark in
front. Pieces with a mark elsewhere aren't used, so no piece spans two words and
the marginal of a text is the product of its words' marginals. Within a word
the forward recursion runs over the lattice of all pieces::

    alpha[0] = 0;  alpha[j] = logsumexp over pieces word[i:j] of alpha[i] + score(piece)

A character that is no piece by itself has one more arc, its UTF-8 bytes as
byte pieces, so every text has a finite score. Several models that share the
vocabulary are scored at once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
_LONG = 64


@lru_cache(maxsize=4)
def processor(path: str):
    """The tokenizer of a model file, one for each Python worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[list[str], dict[str, int], np.ndarray]:
    """All pieces by id, ids of those that the lattice uses, ids of the 256 byte pieces."""
    sp = processor(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    used = {p: i for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) or MARK in p[1:])}
    ids = {p: i for i, p in enumerate(pieces) if sp.is_byte(i)}
    return pieces, used, np.array([ids[f"<0x{b:02X}>"] for b in range(256)])


def count_pieces(path: str, words: list[str], counts: list[int]) -> np.ndarray:
    """How often each piece occurs when the tokenizer itself segments these words."""
    sp = processor(path)
    total = np.zeros(sp.get_piece_size(), np.int64)
    for s in range(0, len(words), 20_000):
        part = sp.encode(words[s : s + 20_000], num_threads=1)
        n = np.fromiter(map(len, part), np.int64, len(part))
        flat = np.fromiter((i for p in part for i in p), np.int64, int(n.sum()))
        total += np.bincount(flat, weights=np.repeat(counts[s : s + 20_000], n), minlength=len(total)).astype(np.int64)
    return total


def log_probabilities(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Counts (models x pieces) as log-probabilities, ``smooth`` added to each."""
    c = np.atleast_2d(counts).astype(np.float64) + smooth
    return np.log(c) - np.log(c.sum(axis=1, keepdims=True))


class Lattice:
    """The pieces as a trie in arrays, with the scores of one or more models (models x pieces)."""

    def __init__(self, used: dict[str, int], scores: np.ndarray, byte_ids: np.ndarray):
        self.n_models = len(scores)
        self.reach = max(map(len, used))
        nodes, piece = [{}], [-1]
        for p, i in used.items():
            at = 0
            for ch in p:
                nxt = nodes[at].get(ch)
                if nxt is None:
                    nxt = nodes[at][ch] = len(nodes)
                    nodes.append({})
                    piece.append(-1)
                at = nxt
            piece[at] = i
        keys = [((a << 21) | ord(ch), b) for a, kids in enumerate(nodes) for ch, b in kids.items()]
        keys.sort()
        self.keys = np.array([k for k, _ in keys], np.int64)
        self.child = np.array([b for _, b in keys], np.int64)
        piece = np.array(piece)
        self.ends = piece >= 0
        self.score = np.where(self.ends[:, None], scores.T[piece], -np.inf)
        self.first = np.zeros(0x110000, np.int32)
        for ch, b in nodes[0].items():
            self.first[ord(ch)] = b
        self.byte_score = scores.T[byte_ids]
        self.alone = np.zeros(0x110000, bool)
        for ch, b in nodes[0].items():
            self.alone[ord(ch)] = piece[b] >= 0

    def _bytes(self, ch: int) -> np.ndarray:
        return self.byte_score[list(chr(ch).encode("utf-8", "replace"))].sum(axis=0)

    def _group(self, codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Scores (models x words) of words as rows of code points, longest first."""
        w, width = codes.shape
        alpha = np.full((width + 1, self.n_models, w), -np.inf)
        alpha[0] = 0.0
        for i in range(width):
            n = int(np.searchsorted(-lens, -i, side="left"))  # words longer than i
            ch = codes[:n, i]
            lost = np.flatnonzero(~self.alone[ch])
            if len(lost):
                kinds, inv = np.unique(ch[lost], return_inverse=True)
                s = np.stack([self._bytes(int(c)) for c in kinds], axis=1)[:, inv]
                alpha[i + 1][:, lost] = np.logaddexp(alpha[i + 1][:, lost], alpha[i][:, lost] + s)
            node = self.first[ch].astype(np.int64)
            on = np.flatnonzero(node)
            node = node[on]
            j = i + 1
            while len(on):
                e = self.ends[node]
                t = on[e] if not e.all() else on
                a = alpha[j]
                a[:, t] = np.logaddexp(a[:, t], alpha[i][:, t] + self.score[node[e]].T)
                if j >= width:
                    break
                more = lens[on] > j
                on, node = on[more], node[more]
                key = (node << 21) | codes[on, j]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                on, node = on[hit], self.child[at[hit]]
                j += 1
        return alpha[lens, :, np.arange(w)].T

    def _one(self, word: str) -> np.ndarray:
        """The same for one word in plain Python: what the others are held against."""
        keys = dict(zip(self.keys.tolist(), self.child.tolist()))
        out = np.zeros(self.n_models)
        for m in range(self.n_models):
            alpha = [0.0] + [-math.inf] * len(word)

            def add(j, v, alpha=alpha):
                hi, lo = (v, alpha[j]) if v > alpha[j] else (alpha[j], v)
                alpha[j] = hi + math.log1p(math.exp(lo - hi))

            for i, ch in enumerate(word):
                if alpha[i] == -math.inf:
                    continue
                if not self.alone[ord(ch)]:
                    add(i + 1, alpha[i] + float(self._bytes(ord(ch))[m]))
                node, j = 0, i
                while j < len(word) and (node := keys.get((node << 21) | ord(word[j]))) is not None:
                    j += 1
                    if self.ends[node]:
                        add(j, alpha[i] + float(self.score[node, m]))
            out[m] = alpha[-1]
        return out

    def _arcs(self, codes: np.ndarray):
        """(start, length, node) of all pieces in a row of code points, by length."""
        n = len(codes)
        at = np.arange(n)
        node = self.first[codes].astype(np.int64)
        k = 1
        at, node = at[node > 0], node[node > 0]
        while len(at):
            e = self.ends[node]
            yield at[e], k, node[e]
            on = at + k < n
            at, node = at[on], node[on]
            key = (node << 21) | codes[at + k]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            at, node = at[hit], self.child[i[hit]]
            k += 1

    def _cuts(self, codes: np.ndarray) -> np.ndarray:
        """Where a word can be cut: positions that no piece spans, the ends among them. The marginal is the product over the parts."""
        spans = np.zeros(len(codes) + 1, np.int64)
        for at, k, _ in self._arcs(codes):
            if k > 1:
                np.add.at(spans, at + 1, 1)
                np.add.at(spans, at + k, -1)
        free = np.cumsum(spans) == 0
        free[0] = free[-1] = True
        return np.flatnonzero(free)

    def _long(self, codes: np.ndarray, side: int = 512) -> np.ndarray:
        """Score of one long part, ``side`` squared positions at a time: they are cut into equal blocks, and all blocks' matrices from the last positions before a block to its own last ones are multiplied up together, then the blocks one by one.

        Probabilities are scaled every few steps by the largest of the last positions.
        """
        reach = self.reach
        v = np.full((self.n_models, reach), -np.inf)
        v[:, 0] = 0.0
        for s in range(0, len(codes), side * side):
            back = min(s, reach)
            self._stretch(codes[s - back : s + side * side], back, v, side)
        return v[:, 0]

    def _stretch(self, codes: np.ndarray, back: int, v: np.ndarray, side: int) -> None:
        """Carries ``v`` (models x last positions, the nearest first) over the positions from ``back`` on; after fewer than ``side`` squared only its first is right."""
        n, reach = len(codes) - back, self.reach
        arcs = [(at[at + k > back], k, node[at + k > back]) for at, k, node in self._arcs(codes)]
        lost = back + np.flatnonzero(~self.alone[codes[back:]])
        size = min(side, max(64, int(n**0.5)))
        blocks = -(-n // size)
        begin = np.arange(blocks) * size
        for m in range(self.n_models):
            p = np.zeros((reach + 1, blocks * size + 1))  # p[k, j]: a piece of k characters that ends at j
            for at, k, node in arcs:
                p[k, at + k - back] = np.exp(self.score[node, m])
            if len(lost):
                kinds, inv = np.unique(codes[lost], return_inverse=True)
                p[1, lost + 1 - back] += np.exp(np.array([self._bytes(int(c))[m] for c in kinds]))[inv]
            p[1, n + 1 :] = 1.0  # fills the last block up; the positions before move one back each
            used = [k for k in range(1, reach + 1) if p[k].any()]
            win = np.zeros((reach, blocks, reach))  # win[b, block, a]: at b positions back, from a positions before the block
            for a in range(reach):
                win[a, :, a] = 1.0
            log = np.zeros((blocks, reach))
            for t in range(1, size + 1):
                new = np.zeros((blocks, reach))
                for k in used:
                    new += p[k, begin + t][:, None] * win[k - 1]
                win = np.concatenate([new[None], win[:-1]])
                if t % 4 == 0 or t == size:
                    top = win.max(axis=0)
                    top[top == 0] = 1.0
                    win /= top[None]
                    log += np.log(top)
            with np.errstate(divide="ignore"):
                step = np.log(win) + log[None]
                for b in range(blocks):
                    x = step[:, b, :] + v[m][None, :]
                    top = x.max(axis=1)
                    safe = np.where(np.isfinite(top), top, 0.0)
                    v[m] = safe + np.log(np.exp(x - safe[:, None]).sum(axis=1))

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log-probability (words x models) of words that are given without their mark.

        A long word, as a whole text without white space is one, is cut where
        no piece spans, and its parts are scored as words are.
        """
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        out = np.zeros((len(words), self.n_models))
        short = np.flatnonzero(lens <= _LONG)
        out[short] = self._all([MARK + words[k] for k in short.tolist()])
        for k in np.flatnonzero(lens > _LONG).tolist():
            text = MARK + words[k]
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            at = self._cuts(codes)
            size = np.diff(at)
            small = np.flatnonzero(size <= _LONG)
            parts: dict[str, int] = {}
            for i in small.tolist():
                w = text[at[i] : at[i + 1]]
                parts[w] = parts.get(w, 0) + 1
            if parts:
                out[k] += np.fromiter(parts.values(), np.float64, len(parts)) @ self._all(list(parts))
            for i in np.flatnonzero(size > _LONG).tolist():
                out[k] += self._long(codes[at[i] : at[i + 1]])
        return out

    def _all(self, parts: list[str]) -> np.ndarray:
        """Scores (parts x models) of short strings, a mark among their characters or not."""
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        out = np.zeros((len(parts), self.n_models))
        order = np.argsort(-lens, kind="stable")
        s = 0
        while s < len(order):
            width = int(lens[order[s]])
            at_once = max(64, min(8192, (1 << 22) // (self.n_models * (width + 1))))
            part = order[s : s + at_once]
            s += at_once
            n = lens[part]
            flat = np.frombuffer("".join([parts[k] for k in part.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            codes = np.zeros((len(part), width), np.int64)
            codes[np.arange(width)[None, :] < n[:, None]] = flat
            out[part] = self._group(codes, n).T
        return out


_SPACE = re.compile(r"\s")


def slices(text: str | None, size: int = 1 << 20) -> Iterator[str]:
    """The text in slices of about ``size`` characters, cut at white space; a longer run without any stays whole."""
    text = text or ""
    s = 0
    while len(text) - s > size:
        m = _SPACE.search(text, s + size)
        if m is None:
            break
        yield text[s : m.start()]
        s = m.start()
    yield text[s:] if s else text


class Scorer:
    """Scores of texts, with a memory of the words met, which starts anew when it holds ``most`` or is of many characters."""

    def __init__(self, lattice: Lattice, most: int = 400_000):
        self.lattice, self.most = lattice, most
        self.ids: dict[str, int] = {}
        self.chars = 0
        self.scores = np.zeros((0, lattice.n_models))

    def texts(self, texts: list[str | None], at_once: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(texts x models) log-probabilities and the number of words of each text; 0 for a text without words."""
        total, sizes = np.zeros((len(texts), self.lattice.n_models)), np.zeros(len(texts), np.int64)
        rows, parts, room = [], [], at_once

        def done():
            if parts:
                v, n = self._some(parts)
                np.add.at(total, rows, v)
                np.add.at(sizes, rows, n)

        for k, text in enumerate(texts):
            for part in slices(text, at_once):
                rows.append(k)
                parts.append(part)
                room -= len(part)
                if room <= 0:
                    done()
                    rows, parts, room = [], [], at_once
        done()
        return total, sizes

    def _some(self, texts):
        if len(self.ids) > self.most or self.chars > 64 * self.most:
            self.ids, self.scores, self.chars = {}, self.scores[:0], 0
        ids = self.ids
        split = [t.split() for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        known = len(ids)
        flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in split for w in ws), np.int64, int(n.sum()))
        if len(ids) > known:
            fresh = list(ids)[known:] if known == 0 else _tail(ids, known)
            self.chars += sum(map(len, fresh))
            self.scores = np.concatenate([self.scores, self.lattice.score_words(fresh)])
        cum = np.zeros((len(flat) + 1, self.lattice.n_models))
        np.cumsum(self.scores[flat], axis=0, out=cum[1:])
        end = np.cumsum(n)
        return cum[end] - cum[end - n], n


def _tail(ids: dict[str, int], known: int) -> list[str]:
    from itertools import islice

    return list(islice(reversed(ids), len(ids) - known))[::-1]
