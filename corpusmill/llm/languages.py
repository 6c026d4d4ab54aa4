"""Languages of texts: a mixture over n-gram likelihoods, fitted by expectation-maximisation for each text."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

#: Words, and marks that end a sentence or a line.
TOKEN = re.compile(r"[^\W_]+|[.!?;:…](?=\s|$|[\"'”»)])|[\n\t|•]|(?<=\s)[-–—*](?=\s)")
WORDLIKE = re.compile(r"[^\W_]")
#: English names, two- and three-letter codes of languages (ISO 639), a fixed table of names.
CODES = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german"), "fr": ("fra", "fre", "french"), "es": ("spa", "spanish"),
    "pt": ("por", "portuguese"), "it": ("ita", "italian"), "nl": ("nld", "dut", "dutch"), "ru": ("rus", "russian"),
    "pl": ("pol", "polish"), "cs": ("ces", "cze", "czech"), "sv": ("swe", "swedish"), "da": ("dan", "danish"),
    "fi": ("fin", "finnish"), "tr": ("tur", "turkish"), "ar": ("ara", "arabic"), "zh": ("zho", "chi", "chinese"),
    "ja": ("jpn", "japanese"), "ko": ("kor", "korean"), "uk": ("ukr", "ukrainian"), "hi": ("hin", "hindi"),
}
KNOWN = {name: code for code, names in CODES.items() for name in (code, *names)}
#: Labelled sentences a model is fitted on at most.
MOST_SAMPLES = 20_000
#: What one word may speak against a language at most (natural logarithm), so that no single one decides.
FLOOR = 3.5


def declared(label: str | None) -> str | None:
    """The two-letter code that a label names, whatever its case, region or form; None if it says nothing."""
    return KNOWN.get(re.split(r"[-_ ]", label.strip().lower())[0]) if label and label.strip() else None


class LanguageModel:
    """Likelihoods of words in each language, and the languages of texts and of their segments."""

    def __init__(self, samples: list[tuple[str, str]], common: list[tuple[str, str, int]], *, piece: int = 10, memo: int = 300_000):
        """``samples``: (language, sentence); ``common``: (language, word, rank).

        A word known in some language is worth its smoothed frequency there; any other its letter trigrams, within
        bounds, as it may be a name. Segments of more than 1.5 ``piece`` words are cut into such of about ``piece``.
        """
        self.codes = sorted({x for x, _ in samples} | {x for x, _, _ in common})
        self.piece, self.memo = piece, memo
        k = {c: i for i, c in enumerate(self.codes)}
        words, grams = defaultdict(lambda: np.zeros(len(k))), defaultdict(lambda: np.zeros(len(k)))
        spread: dict[str, set[str]] = defaultdict(set)
        for lang, sentence in samples:
            inner = re.findall(r"[^\W_]+", sentence)
            for i, w in enumerate(inner):
                named = w[0].isupper() and i > 0 and lang != "de" or any(c.isdigit() for c in w)
                if not named:
                    spread[w.lower()].add(sentence)
        for lang, sentence in samples:
            for w in re.findall(r"[^\W_]+", sentence.lower()):
                if len(spread[w]) > 1:  # what comes in one sentence may be a name
                    words[w][k[lang]] += 1
        for lang, word, rank in common:
            words[word.lower()][k[lang]] += 30 / (rank + 5)
        for w, n in words.items():
            for g in self._grams(w):
                grams[g] += np.minimum(n, 3)
        total = np.sum(list(words.values()), axis=0)
        self.rows = [np.zeros(len(k)), np.zeros(len(k))]  # 0: marks, 1: numbers
        self.number: dict[str, int] = {}
        for w, n in words.items():
            score = np.log((n + 0.05) / (total + 0.05 * len(words)))
            self.number[w] = len(self.rows)
            self.rows.append(np.maximum(score - score.max(), -FLOOR))
        gram_total = np.sum(list(grams.values()), axis=0)
        self.grams = {g: np.log((n + 0.2) / (gram_total + 0.2 * len(grams))) for g, n in grams.items()}
        self.known = len(self.rows)
        # words that speak for one language against all others
        self.lead = {w: int(r.argmax()) for w, i in self.number.items() if (r := self.rows[i]).max() - np.sort(r)[-2] >= 2.0} if len(self.codes) > 1 else {}

    def knows(self, word: str) -> bool:
        """Whether a word came often enough in the samples, or is a common one."""
        return 1 < self.number.get(word, 0) < self.known

    def alike(self, one: list[str], two: list[str], *, least: int = 3) -> bool:
        """Whether the words of two texts speak clearly, and for the same language: ``least`` different words or more, and thrice as many as for any other."""
        best = []
        for own in (one, two):
            votes = Counter(map(self.lead.__getitem__, self.lead.keys() & {*own})).most_common(2)
            if not votes or votes[0][1] < least or len(votes) > 1 and votes[0][1] < 3 * votes[1][1]:
                return False
            best.append(votes[0][0])
        return best[0] == best[1]

    @staticmethod
    def _grams(word: str) -> list[str]:
        word = f"^{word}$"
        return [word[i : i + 3] for i in range(len(word) - 2)]

    def _new(self, token: str) -> int:
        """The row of a token that was not met before."""
        if not WORDLIKE.match(token):
            return self.number.setdefault(token, 0)
        if token.isdigit():
            return 1
        found = [self.grams[g] for g in self._grams(token) if g in self.grams]
        score = np.sum(found, axis=0) if found else np.zeros(len(self.codes))
        foreign = max(token) > "Ͱ"  # another script can't be a Latin name
        bound = 4.0 if foreign else 1.0
        score = np.maximum((score - score.max()) * (1.0 if foreign else 0.4), -bound)
        self.number[token] = len(self.rows)
        self.rows.append(score)
        return len(self.rows) - 1

    matrix = None

    def _forget(self) -> None:
        """Rows of unknown words are forgotten where there are more than ``memo``; only between batches, as ids of a batch point to them."""
        if len(self.rows) - self.known > self.memo:
            del self.rows[self.known :]
            self.number = {w: i for w, i in self.number.items() if i < self.known}
            self.matrix = None

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        self._forget()
        number = self.number
        for text in texts:
            tokens = TOKEN.findall(text.lower())
            own = [number[t] if t in number else self._new(t) for t in tokens]
            ids += own
            sizes.append(len(own))
        if self.matrix is None or len(self.matrix) < len(self.rows):
            fresh = np.array(self.rows[0 if self.matrix is None else len(self.matrix) :])
            self.matrix = fresh if self.matrix is None else np.concatenate([self.matrix, fresh])
        return np.array(ids, np.int64), np.array(sizes, np.int64)

    def segments(self, texts: list[str], *, rounds: int = 8, penalty: float = 7.0) -> list[list[tuple[int, int, int, float]]]:
        """For each text its segments: (first word, words, language number or -1, confidence), one language each.

        Pieces of a text, cut at marks and every so many words, are drawn from a mixture of languages whose proportions
        are found by expectation-maximisation. A language is in a text's set if without it the likelihood falls by more
        than ``penalty`` (twice that where only one short piece speaks for it); pieces then get the likeliest of the
        set, their posterior is the confidence, and neighbours of one language become one segment. A text without any
        evidence gets language -1.
        """
        ids, sizes = self._ids(texts)
        n = len(ids)
        if not n:
            return [[] for _ in texts]
        doc = np.repeat(np.arange(len(texts)), sizes)
        mark = ids == 0
        # Pieces: between marks, and evenly cut where they are long.
        edge = np.r_[True, mark[:-1] | (doc[1:] != doc[:-1])]
        stretch = np.cumsum(edge) - 1
        first = np.flatnonzero(edge)
        real = (~mark).astype(np.int64)
        inside = np.cumsum(real) - real
        rank = inside - inside[first][stretch]
        count = np.add.reduceat(real, first)
        parts = np.maximum(1, np.round(count / self.piece - 0.2)).astype(np.int64)
        part = np.minimum(rank * parts[stretch] // np.maximum(count[stretch], 1), parts[stretch] - 1)
        edge = edge | np.r_[False, part[1:] != part[:-1]]
        begin = np.flatnonzero(edge)
        like = np.add.reduceat(self.matrix[ids], begin, axis=0)
        words = np.add.reduceat(real, begin)
        of = doc[begin]
        some = words > 0
        like, words, of = like[some], words[some], of[some]
        if not len(of):
            return [[] for _ in texts]
        d = len(texts)
        top = like.max(axis=1, keepdims=True)
        prob = np.exp(like - top)
        total = np.bincount(of, words, d)
        share = np.full((d, len(self.codes)), 1.0 / len(self.codes))
        for _ in range(rounds):
            post = share[of] * prob
            post /= post.sum(axis=1, keepdims=True)
            share = self._sums(of, post * words[:, None], d) / np.maximum(total, 1)[:, None]
            share = (share + 1e-4) / (share + 1e-4).sum(axis=1, keepdims=True)
        # Penalised choice of the set: what the text loses without the language.
        allowed = np.ones((d, len(self.codes)), bool)
        for _ in range(3):
            masked = np.where(allowed[of], like, -1e9)
            best = masked.argmax(axis=1)
            main = self._sums(of, np.where(np.arange(len(self.codes)) == best[:, None], words[:, None], 0), d)
            # against the language that explains the whole text best: others are needed where that one can't explain a piece
            chief = np.where(allowed, self._sums(of, like, d), -1e9).argmax(axis=1)
            gap = masked[np.arange(len(of)), best] - masked[np.arange(len(of)), chief[of]]
            need = np.zeros((d, len(self.codes)))
            np.add.at(need, (of, best), gap)
            bar = np.where(main < 5, 2 * penalty, penalty)
            keep = (need > bar) & (main >= 3)
            keep[np.arange(d), chief] = True
            allowed &= keep
        post = np.where(allowed[of], np.maximum(share[of], 1e-3) * prob, 0)
        seen = np.abs(like).sum(axis=1) > 0
        norm = post.sum(axis=1, keepdims=True)
        post = np.where(norm > 0, post / np.maximum(norm, 1e-300), allowed[of] / allowed[of].sum(axis=1, keepdims=True))
        lang = post.argmax(axis=1)
        evidence = np.bincount(of, np.where(seen, -like.min(axis=1), 0), d)
        code = np.where(evidence[of] > 3, lang, -1)
        sure = np.where(code >= 0, post[np.arange(len(of)), lang], 0.0) * words
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        # neighbours of one language and text become one segment
        start = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (code[1:] != code[:-1])])
        count, weighed = np.add.reduceat(words, start), np.add.reduceat(sure, start)
        for t, c, w, x in zip(of[start].tolist(), code[start].tolist(), count.tolist(), (weighed / count).tolist()):
            own = out[t]
            own.append((own[-1][0] + own[-1][1] if own else 0, w, c, x))
        return out

    @staticmethod
    def _sums(of: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
        """Sums of rows by text number, which never falls."""
        out = np.zeros((count, rows.shape[1]))
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        out[of[first]] = np.add.reduceat(rows, first, axis=0)
        return out

    def languages(self, texts: list[str]) -> list[list[tuple[str, float, float]]]:
        """For each text its languages, (code, share of words, confidence), the main one first."""
        out = []
        for own in self.segments(texts):
            if len(own) < 2:
                out.append([(self.codes[c], 1.0, x) for _, _, c, x in own if c >= 0])
                continue
            words, sure = Counter(), Counter()
            for _, w, c, x in own:
                if c >= 0:
                    words[c] += w
                    sure[c] += w * x
            all_words = sum(words.values())
            out.append([(self.codes[c], w / all_words, sure[c] / w) for c, w in sorted(words.items(), key=lambda x: (-x[1], x[0]))])
        return out
