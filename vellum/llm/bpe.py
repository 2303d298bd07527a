"""BPE encoding and decoding: speculate and verify.

Greedy longest match proposes the tokens of each new word. A sequence of tokens is the
exact BPE encoding of its word if every adjacent pair is the encoding of its own
concatenation, so one vectorised look-up over all adjacent pairs of a batch verifies the
proposals, and only the words with an incompatible pair undergo exact merging.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from vellum.llm.common import map_rows, table

#: White space as the tokenizer's normaliser sees it (the White_Space property).
SPACE = r"\t-\r \x85\xa0  -     　"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
BETWEEN = regex.compile(rf"[^{SPACE}]+")
CONTROL = "\x1c\x1d\x1e\x1f"  # str.split() takes these for white space; the tokenizer doesn't
#: Words and pairs a Python worker remembers in a generation; bounds memory, without effect on results.
WORDS_KEPT, PAIRS_KEPT = 100_000, 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [letters[b] for b in range(256)]


class Remembered:
    """Two generations of a dictionary: what is still in use moves on, the rest is forgotten."""

    def __init__(self, kept: int):
        self.kept, self.now, self.old = kept, {}, {}

    def missing(self, keys: set) -> list:
        """The keys that are in neither generation; those in the old one are brought forward."""
        if len(self.now) > self.kept:
            self.now, self.old = {}, self.now
        out = []
        for k in keys:
            if k not in self.now:
                if (v := self.old.get(k)) is not None:
                    self.now[k] = v
                else:
                    out.append(k)
        return out


class SpeculativeBpe:
    """A word-end BPE vocabulary, with remembered words and remembered pair checks."""

    def __init__(self, file: str, words_kept: int = WORDS_KEPT):
        spec = json.loads(open(file, encoding="utf-8").read())
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank = {tuple(pair): i for i, pair in enumerate(model["merges"])}
        self.middle = {t: i for t, i in self.vocab.items() if not t.endswith(self.end)}
        self.final = {t[: -len(self.end)]: i for t, i in self.vocab.items() if t.endswith(self.end)}
        self.reach: dict[str, int] = {}  # the longest token that begins with these two letters
        for t in [*self.middle, *self.final]:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 1))
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")")
        self.letters = str.maketrans({b: c for b, c in enumerate(byte_letters())})
        self.byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.file, self.library, self.assigned = file, None, set()
        self.pairs: dict[int, bool] = {}
        self.words, self.chunks = Remembered(words_kept), Remembered(words_kept)

    def chunks_of(self, text: str) -> list[str]:
        """The normalised text cut at white space; special tokens come with a space in front, words that the library cut with two."""
        cut = (lambda part: self.cut(self.normal(part))) if text.isascii() or self.known_letters(text) else self.library_words
        if not any(s in text for s in self.special):
            return cut(text)
        out: list[str] = []
        for part in self.split.split(text):
            out += [f" {part}"] if part in self.special else cut(part)
        return out

    def known_letters(self, text: str) -> bool:
        """Whether Python's Unicode tables have every character; the library's may be newer and differ on the rest."""
        for c in set(text) - self.assigned:
            if unicodedata.category(c) == "Cn":
                return False
            self.assigned.add(c)
        return True

    def library_words(self, text: str) -> list[str]:
        """The words of a text as the library's own normaliser and pre-tokenizer cut it."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.file)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return ["  " + bytes(self.byte_of[c] for c in w).decode("utf-8", "surrogatepass") for w, _ in found]

    @staticmethod
    def cut(text: str) -> list[str]:
        return BETWEEN.findall(text) if any(c in text for c in CONTROL) else text.split()

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final-sigma rule
        return text.lower()

    def symbols(self, token: str) -> list[str]:
        """The symbols before any merge: letters, the last one of a final token with the end mark."""
        if token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """Exact BPE: merge the pair of least rank, leftmost first, until none is left."""
        if len(symbols) > 200:
            return self.merged_long(symbols)
        rank, none, symbols = self.rank.get, 1 << 30, list(symbols)
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            symbols[i] += symbols.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), none)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), none)
        return symbols

    def merged_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap and linked neighbours, for very long words."""
        part: list[str | None] = list(symbols)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (part[i], part[j]) != pair:
                continue
            part[i], part[j] = pair[0] + pair[1], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := (part[i], part[k])) in self.rank:
                    heapq.heappush(heap, (self.rank[p], i, p))
            if (h := before[i]) >= 0 and (p := (part[h], part[i])) in self.rank:
                heapq.heappush(heap, (self.rank[p], h, p))
        return [s for s in part if s is not None]

    def greedy(self, word: str) -> list[int]:
        """Longest match from the left, over a word in byte letters."""
        out, i, n = [], 0, len(word)
        middle, reach = self.middle.get, self.reach.get
        while i < n:
            j = i + reach(word[i : i + 2], 1)
            if j >= n:
                if (t := self.final.get(word[i:])) is not None:
                    out.append(t)
                    break
                j = n - 1 if n - 1 > i else n
            while (t := middle(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def compatible(self, code: int) -> bool:
        """Whether the pair (or, with all upper bits set, the single token) encodes to itself."""
        left, right = code >> 16, code & 0xFFFF
        parts = ([] if left == 0xFFFF else [self.token[left]]) + [self.token[right]]
        return self.merged([s for p in parts for s in self.symbols(p)]) == parts

    def learn(self, words: set[str]) -> None:
        """Remember the encodings of words: propose, verify all adjacent pairs at once, repair."""
        if len(self.pairs) > PAIRS_KEPT:
            self.pairs = {}
        fresh = self.words.missing(words)
        if not fresh:
            return
        spelled = [w if w.isascii() and w.isalnum() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters) for w in fresh]
        proposed = [self.greedy(w) for w in spelled]
        sizes = np.array([len(p) for p in proposed])
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(sizes.sum()))
        left = np.concatenate([[0xFFFF], flat[:-1]])
        starts = np.cumsum(sizes) - sizes
        left[starts] = 0xFFFF  # a word's first token is only checked alone if it is the whole word
        codes = left << 16 | flat
        single = np.zeros(len(flat), bool)
        single[starts] = True
        judged = ~single | np.repeat(sizes == 1, sizes)
        known, where = np.unique(codes[judged], return_inverse=True)
        for c in known.tolist():
            if c not in self.pairs:
                self.pairs[c] = self.compatible(c)
        verdict = np.ones(len(flat), bool)
        verdict[judged] = np.fromiter((self.pairs[c] for c in known.tolist()), bool, len(known))[where]
        passed = np.logical_and.reduceat(verdict, starts)
        for word, letters, tokens, ok in zip(fresh, spelled, proposed, passed.tolist()):
            if not ok:
                tokens = [self.vocab[s] for s in self.merged([*letters[:-1], letters[-1] + self.end])]
            self.words.now[word] = (len(tokens), " ".join(map(str, tokens)), " ".join(self.token[t] for t in tokens))

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: token count, decimal ids joined by spaces, and the decoded text."""
        split = [self.chunks_of(text) for text in texts]
        fresh = self.chunks.missing({c for chunks in split for c in chunks})
        words = {c: [c[2:]] if c.startswith("  ") else WORD.findall(c) for c in fresh if c[0] != " " or c.startswith("  ")}
        self.learn({w for found in words.values() for w in found})
        known, of_word, out = self.chunks.now, self.words.now, []
        for c in fresh:
            if c not in words:
                known[c] = (1, str(self.special[c[1:]]), c[1:])
            elif len(found := words[c]) == 1:
                known[c] = of_word[found[0]]
            else:
                known[c] = (sum(of_word[w][0] for w in found), " ".join([of_word[w][1] for w in found]), " ".join([of_word[w][2] for w in found]))
        for chunks in split:
            found = [known[c] for c in chunks]
            out.append((sum([x[0] for x in found]), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])))
        return out

    def decode(self, ids: list[int]) -> str:
        """The library's decode of a vocabulary without a decoder: token strings joined by spaces."""
        return " ".join(self.token[i] for i in ids)


def encode(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, decoded: bool = True, words_kept: int = WORDS_KEPT) -> DataFrame:
    """Encode and decode every whole text.

    Returns id, n_tokens, ids_sha256, decoded_sha256 and, with ``ids`` and ``decoded``, the token
    ids (array<int>) and the decoded string. A null text counts as empty: no tokens, hashes of
    the empty string. Repeated rows give repeated rows; an empty table gives an empty one;
    columns other than the two named are never read. A worker remembers the encodings of
    ``words_kept`` words in a generation: fewer take less memory and more time.
    """

    def work(batch: pa.RecordBatch, bpe: SpeculativeBpe):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = bpe.encode([t or "" for t in part.column(1).to_pylist()])
            out = {
                id_col: part.column(0),
                "n_tokens": [n for n, _, _ in found],
                "ids_sha256": [hashlib.sha256(s.encode()).hexdigest() for _, s, _ in found],
                "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for _, _, d in found],
            }
            if ids:
                out["ids"] = [np.fromstring(s, np.int32, sep=" ") for _, s, _ in found]
            if decoded:
                out["decoded"] = [d for _, _, d in found]
            yield out

    kind = dict(docs.select(id_col).dtypes)[id_col]
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    return map_rows(docs, [id_col, text_col], work, schema, lambda: SpeculativeBpe(file, words_kept))


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False, decoded=False)
