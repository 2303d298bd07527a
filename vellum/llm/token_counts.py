"""Exact token counts at every prefix, by dynamic programming over compatible pieces.

The encoding of a prefix ends in exactly one piece: the one that is compatible with the
last piece of the encoding of what precedes it. So one pass over a text gives the token
count of each of its prefixes, and any truncation or budget question is answered from the
stored counts without encoding again. Pieces never hold the word mark after another
letter, so counts add up over words and the pass over a word is remembered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from vellum.llm.bpe import Remembered
from vellum.llm.common import map_rows, table

MARK = "▁"
UNIT = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Words and pairs remembered by a Python worker; bounds memory, without effect on results.
WORDS_KEPT, LONGEST_KEPT, PAIRS_KEPT = 400_000, 64, 3_000_000
#: Letters of a stem, stems remembered, letters at the end of a piece by which its length is looked up.
STEM, STEMS_KEPT, TAIL = 5, 200_000, 3
LIMIT = 4096


class PrefixCounter:
    """Token counts of all prefixes for a sentencepiece BPE model with byte fallback."""

    def __init__(self, file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        self.piece = {i: model.id_to_piece(i) for i in normal}
        self.vocab = {p: i for i, p in self.piece.items()}
        self.rank = {p: -model.get_score(i) for p, i in self.vocab.items()}
        self.longest = max(map(len, self.vocab))
        if any(MARK in p.lstrip(MARK) for p in self.vocab) or "\n" in self.vocab:
            raise ValueError("pieces must not run over word marks or line ends")
        self.reach: dict[str, int] = {}  # the longest piece that ends in these letters
        for p in self.vocab:
            if len(p) > TAIL:
                self.reach[p[-TAIL:]] = max(len(p), self.reach.get(p[-TAIL:], TAIL))
        self.stems: dict[str, tuple[list[int], list[int]]] = {}
        self.pairs: dict[int, bool] = {}
        self.units = Remembered(WORDS_KEPT)

    def merged(self, symbols: list[str]) -> list[str]:
        """Exact merging: best score first, then leftmost."""
        rank, none = self.rank.get, float("inf")
        ranks = [rank(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            symbols[i] += symbols.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(symbols[i - 1] + symbols[i], none)
            if i < len(ranks):
                ranks[i] = rank(symbols[i] + symbols[i + 1], none)
        return symbols

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces (or with left -1 the one) are the encoding of their letters."""
        code = left << 16 | right
        if (known := self.pairs.get(code)) is None:
            if len(self.pairs) > PAIRS_KEPT:
                self.pairs = {}
            parts = [self.piece[i] for i in (left, right) if i >= 0]
            known = self.pairs[code] = self.merged(list("".join(parts))) == parts
        return known

    def stem(self, letters: str) -> tuple[list[int], list[int]]:
        """The last pieces and counts of all prefixes of the letters many units begin with, remembered."""
        if (known := self.stems.get(letters)) is None:
            if len(self.stems) > STEMS_KEPT:
                self.stems = {}
            known = self.stems[letters] = self.extended(letters, [-1], [0])
        return known

    def prefixes(self, unit: str) -> tuple[int, ...]:
        """Token counts of unit[:1], unit[:2], ... unit. What a prefix holds doesn't depend on what follows, so units share their stems."""
        if len(unit) <= STEM:
            last, counts = [-1], [0]
        else:
            last, counts = self.stem(unit[:STEM])
            last, counts = last.copy(), counts.copy()
        return tuple(self.extended(unit, last, counts)[1][1:])

    def extended(self, unit: str, last: list[int], counts: list[int]) -> tuple[list[int], list[int]]:
        """Go on from the prefixes that are known to those of the whole unit."""
        vocab, reach, pairs = self.vocab.get, self.reach.get, self.pairs.get
        for end in range(len(last), len(unit) + 1):
            far = end - reach(unit[end - TAIL : end] if end > TAIL else "", TAIL)
            for start in range(far if far > 0 else 0, end):
                t = vocab(unit[start:end])
                if t is not None:
                    before = last[start]
                    known = pairs(before << 16 | t)
                    if known is None:
                        known = self.compatible(before, t)
                        pairs = self.pairs.get
                    if known:
                        last.append(t)
                        counts.append(counts[start] + 1)
                        break
            else:  # a letter outside the vocabulary: its bytes, compatible with everything
                last.append(-1)
                counts.append(counts[end - 1] + len(unit[end - 1].encode("utf-8", "surrogatepass")))
        return last, counts

    def units_of(self, text: str) -> list[list[str]]:
        """The units of each line: marks and the letters that follow them. Line ends stand between lines."""
        out = []
        for i, line in enumerate(text.split("\n")):
            parts = line.split(" ")
            if MARK in line or "" in parts:
                out.append(UNIT.findall((MARK if i == 0 else "") + line.replace(" ", MARK)))
            else:
                out.append([parts[0] if i else MARK + parts[0], *[MARK + p for p in parts[1:]]])
        return out

    def learn(self, texts: list[list[list[str]]]) -> dict[str, tuple[int, ...]]:
        for u in self.units.missing({u for lines in texts for line in lines for u in line if len(u) <= LONGEST_KEPT}):
            self.units.now[u] = self.prefixes(u)
        return self.units.now

    def counts(self, texts: list[str], limit: int) -> list[tuple[int, int]]:
        """For each text: its token count and how many leading characters fit into ``limit`` tokens."""
        split = [self.units_of(t) if t else [] for t in texts]
        known, out = self.learn(split), []
        for text, lines in zip(texts, split):
            rows = [[known.get(u) or self.prefixes(u) for u in line] for line in lines]
            n = sum([r[-1] for row in rows for r in row]) + max(0, len(lines) - 1)
            out.append((n, len(text) if n <= limit else self.fitting(rows, limit)))
        return out

    @staticmethod
    def fitting(rows: list[list[tuple[int, ...]]], limit: int) -> int:
        """The longest prefix within the limit, read off the stored counts."""
        total, chars = 0, -1  # the first mark stands for no character
        for i, row in enumerate(rows):
            if i:
                if total + 1 > limit:
                    return max(chars, 0)
                total, chars = total + 1, chars + 1
            for r in row:
                if total + r[-1] > limit:
                    return max(chars + max((k + 1 for k, c in enumerate(r) if total + c <= limit), default=0), 0)
                total, chars = total + r[-1], chars + len(r)
        return chars

    def table(self, text: str) -> np.ndarray:
        """Token counts of text[:1], text[:2], ... text: the whole prefix table of a text."""
        if not text:
            return np.zeros(0, np.int64)
        lines, total, out = self.units_of(text), 0, []
        for i, line in enumerate(lines):
            for u in ([None] if i else []) + line:
                counts = np.array((1,) if u is None else self.prefixes(u), np.int64)
                out.append(counts + total)
                total = int(out[-1][-1])
        return np.concatenate(out)[1:]


def token_counts(docs: DataFrame, file: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of every whole text and say what fits into a token budget.

    Returns id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) and fit_chars, the
    length of the longest prefix of at most ``limit`` tokens. Null or empty texts: 0 bytes,
    0 tokens. Repeated rows give repeated rows; an empty table gives an empty one; other
    columns are never read.
    """

    def work(batch: pa.RecordBatch, counter: PrefixCounter):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [t or "" for t in part.column(1).to_pylist()]
            found = counter.counts(texts, limit)
            yield {
                id_col: part.column(0),
                "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
                "n_tokens": [n for n, _ in found],
                "over_limit": [n > limit for n, _ in found],
                "fit_chars": [k for _, k in found],
            }

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return map_rows(docs, [id_col, text_col], work, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long", lambda: PrefixCounter(file))


def prefix_tables(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the token count of every prefix: id and prefix_tokens array<int>, one entry for each character.

    ``truncate_chars`` answers budget questions from this column alone; so does a difference of two entries.
    """

    def work(batch: pa.RecordBatch, counter: PrefixCounter):
        for at in range(0, batch.num_rows, 32):
            part = batch.slice(at, 32)
            yield {id_col: part.column(0), "prefix_tokens": [counter.table(t or "").tolist() for t in part.column(1).to_pylist()]}

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return map_rows(docs, [id_col, text_col], work, f"{id_col} {kind}, prefix_tokens array<int>", lambda: PrefixCounter(file))


def truncate_chars(tables: DataFrame, limit: int, name: str = "fit_chars") -> DataFrame:
    """Add the length of the longest prefix of at most ``limit`` tokens, read from prefix_tokens."""
    from pyspark.sql import functions as F

    fits = F.transform("prefix_tokens", lambda c, i: F.when(c <= limit, i + 1).otherwise(0))
    return tables.withColumn(name, F.coalesce(F.array_max(fits), F.lit(0)).cast("long"))


def op2_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_bytes, n_tokens, over_limit (and fit_chars) of every document."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
