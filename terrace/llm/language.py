"""Language identification by cross-parsing entropy over suffix automata.

For each language the suffix automaton of labelled text gives, for any text, the greedy
parse into longest substrings of that labelled text: the fewer phrases a symbol, the closer
the language. The language with the lowest rate wins, ties by code point.

The labelled text is a bounded sample: of ``LEARN_DOCS`` documents of a language in hash order
a stretch each, from anywhere in it, until ``LEARN_SYMBOLS`` symbols are reached. All languages
are learned; beyond 30 they share ``ALL_SYMBOLS``, down to ``LEAST_SYMBOLS`` each, so that a
worker's tables stay under 300 MB for up to some 900 languages. Texts are reduced to lower-case letters and single
separators. Since the greedy parse starts anew at the root after each phrase, the automaton
becomes one table. Whole texts are parsed: many in step with numpy and, where fewer than
``IN_STEP`` are still left, each of these alone from the state it has reached.

A null text, or one without a letter, is ``und`` with score 0, as is every text where nothing
was learned. The score is 1 - lowest / second lowest rate (one language: 1). Repeated rows
score alike; extra columns are kept by ``identify``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.common import append, held, table

LEARN_SYMBOLS = 30_000
LEARN_DOCS = 64
ALL_SYMBOLS, LEAST_SYMBOLS = 900_000, 1000
#: Symbols that a document gives at least, where it has them.
STRETCH = 1000
#: Texts from which a step of numpy is cheaper than steps of each text.
IN_STEP = 40
#: Letters with a code of their own, most frequent first; others share one.
LETTERS = 61
UNKNOWN = "und"
_GAP, _OTHER = 0, 1


def _lower_letters() -> np.ndarray:
    """Lower-case letter of each code point, 0 if it is none."""
    out = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


def suffix_automaton(codes: list[int], width: int) -> np.ndarray:
    """Transitions (states, width) of the suffix automaton, -1 for none."""
    moves, link, length, last = [[-1] * width], [-1], [0], 0
    for c in codes:
        now = len(moves)
        moves.append([-1] * width)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and moves[p][c] < 0:
            moves[p][c] = now
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                twin = len(moves)
                moves.append(moves[q][:])
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p][c] == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return np.array(moves, np.int32)


class Model:
    """Parse tables of the learned languages."""

    def __init__(self, learned: dict[str, str]):
        self.lower = _lower_letters()
        self.langs = sorted(learned)
        texts = [self.lower[_points(learned[x])] for x in self.langs]
        seen, counts = np.unique(np.concatenate([t[t > 0] for t in texts] or [np.zeros(0, np.uint32)]), return_counts=True)
        common = seen[np.lexsort((seen, -counts))][:LETTERS]
        self.code = np.full(0x110000, _OTHER, np.uint8)
        self.code[0] = _GAP
        self.code[common] = np.arange(2, 2 + len(common), dtype=np.uint8)
        self.code = self.code[self.lower]
        self.width = len(common) + 2
        self.tables = [self._table(self.codes(learned[x])) for x in self.langs]

    def codes(self, text: str | None) -> np.ndarray:
        """A text's symbols, runs of separators as one."""
        c = self.code[_points(text)]
        return c[(c != _GAP) | (np.concatenate([[1], c[:-1]]) != _GAP)] if len(c) else c

    def _table(self, codes: np.ndarray) -> np.ndarray:
        """state * width + symbol -> 2 * (next state * width) + (1 if a phrase ended)."""
        moves = suffix_automaton(codes.tolist(), self.width)
        known = moves >= 0
        root = np.maximum(moves[0], 0)
        out = np.where(known, moves, root[None, :]) * self.width * 2 + ~known
        return out.astype(np.int32).ravel()

    def rates(self, texts: list) -> np.ndarray:
        """Phrases a symbol, (texts, languages); NaN without a letter."""
        coded = [self.codes(t) for t in texts]
        letters = np.array([bool((c != _GAP).any()) for c in coded], bool)
        order = sorted(np.nonzero(letters)[0].tolist(), key=lambda i: -len(coded[i]))
        phrases = np.zeros((len(texts), len(self.langs)))
        if order:
            sizes = np.array([len(coded[i]) for i in order])
            together = int(sizes[IN_STEP - 1]) if len(order) >= IN_STEP else 0
            grid = np.zeros((len(order), together), np.uint8)
            for row, i in zip(grid, order):
                row[: min(together, len(coded[i]))] = coded[i][:together]
            grid = np.ascontiguousarray(grid.T)
            active = np.searchsorted(-sizes, -np.arange(1, together + 1), side="right").tolist()
            longer = [(k, coded[i][together:].tolist()) for k, i in enumerate(order[:IN_STEP]) if len(coded[i]) > together]
            for lang, moves in enumerate(self.tables):
                state, count = np.zeros(len(order), np.int32), np.ones(len(order), np.int64)
                for symbols, n in zip(grid, active):
                    step = moves[state[:n] + symbols[:n]]
                    count[:n] += step & 1
                    state[:n] = step >> 1
                table = memoryview(moves)  # single values without a copy
                for k, rest in longer:
                    at, ended = int(state[k]), 0
                    for c in rest:
                        at = table[at + c]
                        ended += at & 1
                        at >>= 1
                    count[k] += ended
                phrases[order, lang] = count
        total = np.array([max(1, len(c)) for c in coded])
        return np.where(letters[:, None], phrases / total[:, None], np.nan)

    def identify(self, texts: list) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for row in self.rates(texts):
            if not len(row) or np.isnan(row[0]):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best, *others = np.argsort(row, kind="stable").tolist()
            names.append(self.langs[best])
            scores.append(float(1 - row[best] / row[others[0]]) if others else 1.0)
        return names, scores


def model_of(learned: dict[str, str]) -> Model:
    """One for each Python worker and sample."""
    return held("language", hash(tuple(sorted(learned.items()))), lambda: Model(learned))


def learn(labelled: DataFrame, symbols: int = LEARN_SYMBOLS, docs: int = LEARN_DOCS, every: int = ALL_SYMBOLS) -> dict[str, str]:
    """Text of each language from labelled (doc_id, text, lang): a stretch of each of ``docs``
    documents in hash order, ``symbols`` characters together, fewer where all languages would
    have over ``every``. What reaches the driver is bounded by these and the names of languages."""
    rows = labelled.where("lang is not null and text is not null")
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return {}
    symbols = min(symbols, max(LEAST_SYMBOLS, every // len(per)))
    h = F.xxhash64(F.lit("language"), "doc_id", "text")
    wanted = F.try_element_at(F.create_map(*[x for k, n in per.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * docs / n)))]), F.col("lang"))
    share = F.try_element_at(F.create_map(*[x for k, n in per.items() for x in (F.lit(k), F.lit(max(min(STRETCH, symbols), symbols // min(n, docs))))]), F.col("lang"))
    start = F.pmod(F.xxhash64(F.lit("stretch"), h), F.greatest(F.lit(1), F.length("text") - share + 1)) + 1
    drawn = rows.select("lang", h.alias("h"), F.substring(F.col("text"), start.cast("int"), share).alias("text")).where(F.pmod("h", F.lit(1 << 40)) / float(1 << 40) < wanted)
    placed = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= docs)
    out: dict[str, str] = {}
    for r in sorted(placed.collect(), key=lambda r: (r.lang, r.k)):
        out[r.lang] = out.get(r.lang, "") + (r.text + "\n")[: max(0, symbols - len(out.get(r.lang, "")))]
    return out


def identify(docs: DataFrame, learned: dict[str, str], fields: str = "lang_pred string, score double") -> DataFrame:
    """docs (with text) and the two fields."""
    return append(docs, lambda texts: model_of(learned).identify(texts), fields)


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
