"""Scores for abusive, hateful and sexual content.

A subword-bag classifier: a piece of text is the average of the embeddings of its words, their character n-grams and its word
pairs, followed by a linear softmax; embeddings and softmax are trained jointly, in numpy. A misspelling shares most n-grams
with the word it stands for, and so its vector. A document is scored by its worst piece: every sentence, and overlapping
windows of the words of longer ones, so one line in a long text counts as much as alone. The model is fitted on labelled rows
and on words of public vocabularies only, so a document's score does not depend on the other documents.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import clean

CLASSES = ["none", "abusive", "hateful", "sexual"]
#: Embedding table and dimension; n-gram lengths.
BUCKETS, DIM, GRAMS = 1 << 16, 24, (3, 4, 5)
#: Words of a window, of a sentence that is still scored as one, between windows, and of a sentence that stands alone.
WINDOW, WHOLE, STRIDE, SHORT = 8, 13, 2, 3
#: How much more than all others together the class none weighs in training: most texts are of it.
NEUTRAL = 1.3
#: Labelled rows that a model is fitted on at most.
LABELLED = 20_000
#: What an n-gram never seen in training counts in the average, compared with one seen.
UNSEEN = 0.35
#: Words whose sums a task keeps; with more, it begins anew.
KEPT = 200_000
#: Words that are scored side by side.
WORDS = 20_000
#: Score from which a document counts as a case.
CUT = 0.3

#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters in words.
LOOKALIKES = str.maketrans("абвгезикмнорстухѕіјԁһӏԛԝαβεηικνορτυχωɡı", "abbre3nkmhopctyxsijdhlqwabenikvoptuxwgi")
STAND_INS = str.maketrans("01345789@$!|€", "oleastbgasile")
_WORD = re.compile(r"[^\W_]+(?:['’*_▁·@$!|.\-]+[^\W_]+)*|[🍆🍑💦🔞]", re.UNICODE)
_SPLIT = re.compile(r"[.!?]\s+|[。！？]\s*|[\n\r]+|\s(?:-+\s|//\s?|\.\.\.\s?|\|\s)|//\s?|\.\.\.\s?|[\"“”«»()\[\]]+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][\s.\-_*·]{1,3}){3,}[^\W\d_](?![^\W_])", re.UNICODE)


_INVISIBLE = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}\p{Co}]+")


def plain(text: str) -> str:
    """Without compatibility forms, invisible characters, accents and runs of a letter; in lower case."""
    if text.isascii():
        return text.lower()
    return _INVISIBLE.sub("", unicodedata.normalize("NFKD", text).casefold())


def words(piece: str) -> list[str]:
    """The words of a plain piece: look-alikes read as Latin letters, signs within a word as the letters they stand for or as
    a mask, and repeated letters as one."""
    return [_word(w) for w in _WORD.findall(_joined(piece))]


def _joined(text: str) -> str:
    """The text with words that are spelt with spaces or signs between their letters put together."""
    return _SPACED.sub(lambda m: re.sub(r"[\s.\-_*·]", "", m[0]), text)


_REPEATED, _QUOTES, _MASKS = re.compile(r"([^\W\d_])\1+"), re.compile(r"['’]"), re.compile(r"[^\w]|[_▁·\d]")


@functools.lru_cache(100_000)
def _word(w: str) -> str:
    if not w.isascii():
        w = w.translate(LOOKALIKES)
    elif w.upper() == w.lower():  # no letter
        return "#"
    if not w.isalpha():
        letters = sum(c.isalpha() for c in w)
        if letters == 0 and not any(ord(c) > 0x1F000 for c in w):
            w = "#"
        elif letters * 2 >= len(w):
            w = _MASKS.sub("*", _QUOTES.sub("", w).translate(STAND_INS).lower())
    return _REPEATED.sub(r"\1", w)


def sentences(text: str) -> list[list[str]]:
    """The words, as they are written, of each sentence of a text."""
    return [w for s in _SPLIT.split(_joined(plain(text))) if s and (w := _WORD.findall(s))]


def spans(sizes: list[int]) -> list[tuple[int, int]]:
    """Where the pieces that a text is scored by lie among its words, by the sizes of its sentences. All words are in one,
    however long it is. Sentences of fewer than SHORT words go with the next one; long ones are cut into windows."""
    out, begin, held = [], 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held < SHORT and i < len(sizes) - 1:
            continue
        if held > WHOLE:
            out += [(begin + k, min(WINDOW, held - k)) for k in range(0, held - WINDOW + STRIDE, STRIDE)]
        else:
            out.append((begin, held))
        begin, held = begin + held, 0
    return out


def _hash(s: str) -> int:
    return zlib.crc32(s.encode()) % BUCKETS


def word_features(w: str) -> list[int]:
    x = f"<{w}>"
    return [_hash("w" + w), *(_hash(x[i : i + n]) for n in GRAMS for i in range(len(x) - n + 1))]


def _pairs(h: np.ndarray) -> np.ndarray:
    """The buckets of the pairs of successive words, by the words' hashes."""
    a, b = h[:-1].astype(np.uint64), h[1:].astype(np.uint64)
    return ((a * np.uint64(0x9E3779B1) + b * np.uint64(0x85EBCA6B)) >> np.uint64(15)).astype(np.int64) % BUCKETS


@dataclass
class Model:
    emb: np.ndarray  # BUCKETS x DIM
    seen: np.ndarray  # BUCKETS, whether trained
    out: np.ndarray  # DIM x classes
    bias: np.ndarray
    rows: dict[str, int] = field(default_factory=dict)  # where the sums of a word, as it is written, are kept
    known: dict[str, int] = field(default_factory=dict)  # and as it is read: numbers, for one, are all the same
    kept: dict[str, np.ndarray] = field(default_factory=dict)

    def _size(self) -> int:
        return len(self.kept["weight"]) if self.kept else 0

    def _room(self, new: int) -> None:
        """Makes room for the sums of so many new words; if they are too many, those kept are made again. Bounds memory only."""
        if len(self.rows) + new > self._size():
            self.rows.clear()
            self.known.clear()
            n = max(KEPT, new)
            self.kept = {"sum": np.zeros((n, DIM)), "weight": np.zeros(n), "hash": np.zeros(n, np.uint32), "letter": np.zeros(n, bool)}

    def _add(self, w: str) -> int:
        x = _word(w)
        if (at := self.known.get(x)) is not None:
            self.rows[w] = at
            return at
        f = np.array(word_features(x))
        known = self.seen[f]
        at = self.rows[w] = self.known[x] = len(self.known)
        self.kept["sum"][at], self.kept["weight"][at] = self.emb[f[known]].sum(0), known.sum() + UNSEEN * (~known).sum()
        self.kept["hash"][at], self.kept["letter"][at] = zlib.crc32(x.encode()), x != "#"
        return at

    def _ids(self, ws: list[str]) -> list[int]:
        get = self.rows.get
        out = [get(w) for w in ws]
        if None in out:
            out = [self._add(w) if i is None and w not in self.rows else self.rows[w] for w, i in zip(ws, out)]
        return out

    def _scored(self, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The class probabilities of the pieces of `size` words (at least one) from `start` on."""
        k = self.kept
        pair = _pairs(k["hash"][ids])
        known = self.seen[pair]
        vec = np.zeros((len(ids) + 1, DIM))
        vec[1:] = k["sum"][ids]
        vec[2:] += np.where(known[:, None], self.emb[pair], 0)  # a pair counts with its second word
        weight = np.r_[0.0, k["weight"][ids]]
        weight[2:] += known
        end = start + size
        first = np.where(known[np.maximum(start - 1, 0)] & (start > 0), pair[np.maximum(start - 1, 0)], -1) if len(pair) else np.full(len(start), -1)
        vec, weight = np.cumsum(vec, 0), np.cumsum(weight)
        total = vec[end] - vec[start] - np.where(first[:, None] >= 0, self.emb[first], 0)  # but not the pair with the word before the piece
        norm = weight[end] - weight[start] - (first >= 0)
        z = total / (norm + 1e-9)[:, None] @ self.out + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def scores(self, pieces: list[list[str]]) -> np.ndarray:
        """The class probabilities of each piece (of at least one word)."""
        size = np.array([len(p) for p in pieces], int)
        self._room(int(size.sum()))
        ids = np.array([i for p in pieces for i in self._ids(p)], int)
        return self._scored(ids, np.cumsum(size) - size, size)

    def documents(self, texts: Iterable[str | None]) -> np.ndarray:
        """For each text the highest 1 - P(none) of any piece, and for each class but none its highest probability; 0 without
        any letter."""
        out: list[np.ndarray] = []
        ids: list[int] = []
        starts: list[int] = []
        sizes: list[int] = []
        pieces: list[int] = []  # of each text

        def flush() -> None:
            if not pieces:
                return
            n = np.array(pieces)
            top = np.zeros((len(n), len(CLASSES)))
            if ids:
                at, start, size = np.array(ids), np.array(starts), np.array(sizes)
                p = self._scored(at, start, size)
                p = np.c_[1 - p[:, 0], p[:, 1:]]
                letters = np.r_[0, np.cumsum(self.kept["letter"][at])]
                p[letters[start + size] == letters[start]] = 0
                has = n > 0
                top[has] = np.maximum.reduceat(p, (np.cumsum(n) - n)[has], axis=0)
            out.append(top)
            for x in (ids, starts, sizes, pieces):
                x.clear()

        for t in texts:
            held = sentences(t) if t else []
            ws = [w for s in held for w in s]
            if len(self.rows) + len(ws) > self._size():
                flush()
                self._room(len(ws))
            cut = spans([len(s) for s in held])
            base = len(ids)
            ids += self._ids(ws)
            starts += [base + a for a, _ in cut]
            sizes += [n for _, n in cut]
            pieces.append(len(cut))
            if len(ids) > WORDS:
                flush()
        flush()
        return np.concatenate(out) if out else np.zeros((0, len(CLASSES)))

    def document(self, text: str | None) -> np.ndarray:
        return self.documents([text])[0]


def _noise(ws: list[str], rng: np.random.Generator) -> list[str]:
    """A misspelling of some of the words: a letter left out, doubled out, swapped, masked or replaced."""
    out = []
    for w in ws:
        if len(w) > 3 and rng.random() < 0.3:
            i, kind = int(rng.integers(1, len(w) - 1)), int(rng.integers(5))
            w = [w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "*" + w[i + 1 :], w[:i] + "***" + w[i + 3 :], w[:i] + "aeiou"[rng.integers(5)] + w[i + 1 :]][kind]
        out.append(w)
    return out


def vocabulary(folder: str | None = None, names: tuple[str, ...] = ("byte_bpe_50k", "byte_bpe_multi_50k")) -> list[str]:
    """Words of many languages from the public tokenizers' vocabularies: tokens that begin a word and have only letters."""
    from tickloom.llm.tokens import encoding, tokenizer_dir

    found = set()
    for name in names:
        enc = encoding(folder or tokenizer_dir(), name)
        for t in enc.token_byte_values():
            w = t.decode("utf-8", "ignore")
            if len(w) > 2 and w[0] == " " and w[1:].isalpha() and w.encode() == t:
                found.update(words(plain(w)))
    return sorted(found)


#: Words of a phrase by which parts of labelled texts are known from texts of class none.
PHRASE = 3
#: Distinct texts without labels that a model is fitted on beside the labelled ones, and characters of such a text at most.
UNLABELLED, LENGTH = 2_000, 50_000
#: Share of the letter trigrams of both from which a word is close to another.
CLOSE = 0.5


def _trigrams(ws: list[str]) -> set[tuple[str, ...]]:
    return {tuple(ws[i : i + PHRASE]) for i in range(len(ws) - PHRASE + 1)}


def _labelled(texts: list[str], labels: list[str]) -> list[tuple[list[str], int]]:
    """The words of each labelled text with its class. Where a sentence of an offending text is one that offends by itself
    elsewhere, its other sentences explain nothing: such sentences are left out, here and in all offending texts."""
    split = [([[_word(w) for w in s] for s in sentences(t)], CLASSES.index(c)) for t, c in zip(texts, labels)]
    alone = {x for ss, k in split if k and len(ss) == 1 for x in _trigrams(ss[0])}
    idle: set[tuple[str, ...]] = set()
    for ss, k in split:
        if k and len(ss) > 1:
            share = [len(_trigrams(s) & alone) / max(1, len(s) - PHRASE + 1) for s in ss]
            if max(share) >= 0.5:
                idle |= {tuple(s) for s, x in zip(ss, share) if x == 0 and len(s) >= PHRASE}
    return [([w for s in (ss if k == 0 else [s for s in ss if tuple(s) not in idle] or ss) for w in s], k) for ss, k in split]


class Suspects:
    """What labelled texts offend with, as far as words tell: words that are in offending texts and in none of class none
    (`only`), among them those that public vocabularies do not have as one token (`rare`), and which of them follow each
    other, next or next but one, in offending texts (`pairs`)."""

    def __init__(self, split: list[tuple[list[str], int]], vocabulary: list[str]):
        calm = {w for ws, k in split if not k for w in ws}
        self.only = {w for ws, k in split if k for w in ws} - calm - {"#"}
        self.rare = self.only - set(vocabulary)
        self.pairs = {(a, b) for ws, k in split if k for n in (1, 2) for a, b in zip(ws, ws[n:]) if a in self.only and b in self.only}
        self.grams = {w: {f"<{w}>"[i : i + 3] for i in range(len(w))} for w in self.only}
        self.by_gram: dict[str, list[str]] = {}
        for w, g in self.grams.items():
            for x in g:
                self.by_gram.setdefault(x, []).append(w)

    @functools.lru_cache(200_000)
    def like(self, w: str) -> str | None:
        """The word of `only` that w is, or else is closest to."""
        if w in self.only:
            return w
        g = {f"<{w}>"[i : i + 3] for i in range(len(w))}
        near = {v for x in g for v in self.by_gram.get(x, ())} if len(w) > 3 else ()
        best = max(((len(g & self.grams[v]) / len(g | self.grams[v]), v) for v in near), default=(0, None))
        return best[1] if best[0] >= CLOSE else None

    def has(self, ws: list[str]) -> bool:
        """Whether a piece has a word like a rare offending one, or a pair of offending words as offending texts have it."""
        return any(self.like(w) in self.rare for w in ws) or any(p in self.pairs for n in (1, 2) for p in zip(ws, ws[n:]))


def train(texts: list[str], labels: list[str], vocabulary: list[str], unlabelled: list[str] = (), seed: int = 5, epochs: int = 15) -> Model:
    """A model from labelled texts, in two rounds. A label other than none holds for some part of its text. Where phrases of
    PHRASE words are also in texts labelled none, the longest part between them bears the label. The first round learns from
    the texts so divided, the second from the part of each that the first finds worst, and takes the rest for neutral.

    vocabulary: words that are neutral by default; unlabelled: texts whose sentences are, each counted once however often it
    occurs. Neither is taken where it is close to what the labelled texts offend with (Suspects), and no label is given up
    for them: so an offence that is frequent is not taught to be neutral."""
    rng = np.random.default_rng(seed)
    split = _labelled(texts, labels)
    usual = {x for ws, k in split if k == 0 for x in _trigrams(ws)}
    whole: list[tuple[list[str], int]] = []
    for ws, k in split:
        covered = np.zeros(len(ws), bool)
        for i in range(len(ws) - PHRASE + 1):
            covered[i : i + PHRASE] |= tuple(ws[i : i + PHRASE]) in usual
        at = np.flatnonzero(np.diff(np.r_[True, covered, True].astype(int)))
        runs = [(b - a, a, b) for a, b in zip(at[::2], at[1::2])]  # between the usual phrases
        if k and covered.any() and runs and (longest := max(runs))[0] >= SHORT:
            _, a, b = longest
            whole += [(x, y) for x, y in ((ws[a:b], k), (ws[:a], 0), (ws[b:], 0)) if len(x) >= PHRASE or y]
        else:
            whole.append((ws, k))
    suspects = Suspects(whole, vocabulary)
    pieces = sorted({tuple(_word(w) for w in s) for t in unlabelled for s in sentences(t)})
    background = [[[w] for w in vocabulary if suspects.like(w) not in suspects.rare], [list(p) for p in pieces if not suspects.has(p)]]
    first = _fit(whole, background, rng, max(1, epochs // 3))
    calm = {tuple(w) for w, k in whole if k == 0}
    parts: list[tuple[list[str], int]] = []
    for ws, k in whole:
        if k == 0 or len(ws) < 6:
            parts.append((ws, k))
            continue
        # the best cut into a neutral and an offending part, either of which may be empty
        cuts = [i for i in range(3, len(ws) - 2)]
        pieces = [ws, *(ws[:i] for i in cuts), *(ws[i:] for i in cuts)]
        p = first.scores(pieces)[:, 0]
        p0, p1 = np.log(np.maximum(p, 1e-6)), np.log(np.maximum(1 - p, 1e-6))
        n = len(cuts)
        gain = np.r_[p1[0] - 1.0, p0[1 : n + 1] + p1[n + 1 :], p1[1 : n + 1] + p0[n + 1 :]]
        prior = np.r_[0.0, [2.0 * (tuple(ws[:i]) in calm) for i in cuts], [2.0 * (tuple(ws[i:]) in calm) for i in cuts]]
        at = int(np.argmax(gain + prior))
        if at == 0:
            parts.append((ws, k))
        else:
            i = cuts[(at - 1) % n]
            a, b = (ws[i:], ws[:i]) if at <= n else (ws[:i], ws[i:])
            parts += [(a, k), (b, 0)]
    return _fit(parts, background, rng, epochs)


def _fit(cores: list[tuple[list[str], int]], background: list[list[list[str]]], rng: np.random.Generator, epochs: int, copies: int = 12, others: int = 6_000) -> Model:
    """Each labelled part is seen as it is, misspelt, and in windows among neutral words, as in documents; neutral ones also
    side by side in windows. the background's last list is of class none too, and `others` rows drawn from the
    background, mostly from that list. Embeddings and softmax are
    trained together by Adagrad."""
    calm = [ws for ws, k in cores if k == 0 and ws]
    background = [b for b in background if b]
    rows: list[tuple[list[str], int]] = []

    def draw(n: int) -> list[str]:
        b = background[int(rng.random() < 0.7) * (len(background) - 1)]
        out: list[str] = []
        while len(out) < n:
            out += b[int(rng.integers(0, len(b)))]
        i = int(rng.integers(0, len(out) - n + 1))
        return out[i : i + n]

    def side(n: int) -> list[str]:
        if not n:
            return []
        if rng.random() < 0.5 and background:
            return draw(n)
        return [w for i in rng.integers(0, len(calm), 4) for w in calm[i]][:n] if calm else []

    for core, k in cores:
        if not core:
            continue
        for j in range(copies):
            ws = _noise(core, rng) if j % 3 == 1 else core
            if k and j % 2:
                room = int(rng.integers(0, 1 + max(5, WINDOW - len(ws) + 2)))
                left = int(rng.integers(0, room + 1))
                ws = (side(left + 9)[-left:] if left else []) + ws + side(room - left)
                if len(ws) > WHOLE:
                    i = int(rng.integers(0, len(ws) - WINDOW + 1))
                    ws = ws[i : i + WINDOW]
            elif not k and j % 2:
                ws = side(40)
                i = int(rng.integers(0, max(1, len(ws) - WINDOW)))
                ws = ws[i : i + WINDOW]
            rows.append((ws, k))
    for ws in background[-1] if background else []:  # each as it is, a window of a long one
        i = int(rng.integers(0, max(1, len(ws) - WINDOW + 1))) if len(ws) > WHOLE else 0
        rows.append((ws[i : i + WINDOW] if len(ws) > WHOLE else ws, 0))
    for _ in range(others if background else 0):
        ws = draw(int(rng.integers(1, WHOLE)))
        if calm and rng.random() < 0.4:  # among words of the neutral examples
            ws += side(3)
        rows.append((ws, 0))
    if not any(ws and k for ws, k in rows):  # no offence to learn from: nothing is found
        return Model(np.zeros((BUCKETS, DIM), np.float32), np.zeros(BUCKETS, bool), np.zeros((DIM, len(CLASSES))), np.where(np.arange(len(CLASSES)) == 0, 20.0, 0.0))
    rows = [r for r in rows if r[0]]
    index, owner = [], []
    features = functools.lru_cache(None)(word_features)
    for i, (ws, _) in enumerate(rows):
        f = [x for w in ws for x in features(w)] + _pairs(np.array([zlib.crc32(w.encode()) for w in ws], np.uint32)).tolist()
        index += f
        owner += [i] * len(f)
    index, owner = np.array(index), np.array(owner)
    start = np.searchsorted(owner, np.arange(len(rows) + 1))
    kind = np.array([k for _, k in rows])
    y = np.eye(len(CLASSES))[kind]
    share = np.bincount(kind, minlength=len(CLASSES)) / len(rows)
    weight = np.where(kind == 0, NEUTRAL, (share[0] / (3 * np.maximum(share, 1e-9)))[kind])
    emb, sq = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32), np.full((BUCKETS, 1), 1e-6, np.float32)
    out, bias = rng.normal(0, 0.3, (DIM, len(CLASSES))), np.zeros(len(CLASSES))
    out_sq, bias_sq = np.full_like(out, 1e-6), np.full_like(bias, 1e-6)
    size = 128
    for epoch in range(epochs):
        order, rate = rng.permutation(len(rows)), 0.15 * (1 - epoch / epochs) + 0.005
        for lo in range(0, len(rows), size):
            batch = order[lo : lo + size]
            n = start[batch + 1] - start[batch]
            begin = np.cumsum(n) - n
            at = np.repeat(start[batch] - begin, n) + np.arange(n.sum())
            of = np.repeat(np.arange(len(batch)), n)
            keep = rng.random(len(at)) > 0.2  # no single n-gram is to decide
            keep[begin] = True
            f, of = index[at[keep]], of[keep]
            n = np.bincount(of, minlength=len(batch))
            v = np.add.reduceat(emb[f], np.cumsum(n) - n, axis=0) / n[:, None]
            z = v @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - y[batch]) * weight[batch][:, None] / len(batch)
            back = (g @ out.T / n[:, None]).astype(np.float32)
            by = np.argsort(f, kind="stable")
            ends = np.flatnonzero(np.r_[True, np.diff(f[by]) != 0])
            used = f[by[ends]]
            ge = np.add.reduceat(back[of[by]], ends, axis=0) + np.float32(1e-7) * emb[used]
            sq[used] += (ge**2).mean(1, keepdims=True)
            emb[used] -= np.float32(rate) * ge / np.sqrt(sq[used])
            go, gb = v.T @ g + 1e-5 * out, g.sum(0)
            out_sq += go**2
            bias_sq += gb**2
            out -= rate * go / np.sqrt(out_sq)
            bias -= rate * gb / np.sqrt(bias_sq)
    seen = np.zeros(BUCKETS, bool)
    seen[index] = True
    return Model(np.where(seen[:, None], emb, 0).astype(np.float32), seen, out, bias)


_MODELS: dict[int, Model] = {}


def fitted(examples: DataFrame, docs: DataFrame, text_col: str = "text") -> Model:
    """A model fitted on the labelled rows (text, category), on at most LABELLED of them, and on UNLABELLED distinct texts of
    docs of at most LENGTH characters, each the smallest by a hash of the text; rows without text or with another category are left out. The same texts
    give the same model, which is kept."""
    rows = examples.filter(F.col("text").isNotNull() & F.col("category").isin(CLASSES)).select("text", "category").distinct()
    rows = rows.orderBy(F.xxhash64("text"), "text", "category").limit(LABELLED).collect()
    texts = docs.select(F.col(text_col).alias("text")).filter(F.length("text") <= LENGTH).groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    texts = [r["text"] for r in texts.orderBy("h").limit(UNLABELLED).collect()]
    key = hash((tuple(map(tuple, rows)), tuple(texts)))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = train([r[0] for r in rows], [r[1] for r in rows], vocabulary(), texts)
    return _MODELS[key]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns to keep, score (the highest 1 - P(none) of any piece) and the highest probability of each class, of
    every row. A null, empty or blank text scores 0. Every word of a text is scored. The model goes to the executors as a
    broadcast of fixed size; texts are scored side by side."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    sent = docs.sparkSession.sparkContext.broadcast(Model(model.emb, model.seen, model.out, model.bias))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            s = m.documents(b.column("_text").to_pylist())
            cols = [pa.array(s[:, i]) for i in range(len(CLASSES))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *cols], [*b.schema.names[:-1], "score", *CLASSES[1:]])

    names = [id_col, *keep]
    made = ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "score double", *(f"{c} double" for c in CLASSES[1:])])
    return docs.select(*names, F.col(text_col).alias("_text")).mapInArrow(run, made)


def rates(scored: DataFrame, source_col: str = "source") -> DataFrame:
    """Of each source, compared trimmed and in lower case: documents, flagged, rate. Rows without a source come under null."""
    flagged = F.count_if(F.col("score") >= CUT)
    return scored.groupBy(clean.source(source_col).alias("source")).agg(
        F.count(F.lit(1)).alias("documents"), flagged.alias("flagged"), F.round(flagged / F.count(F.lit(1)), 6).alias("rate")
    )
