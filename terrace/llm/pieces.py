"""SentencePiece encoding and decoding by max-plus transfer over chunks of giant documents.

A segmentation is a path through the lattice of vocabulary pieces. The vocabulary here is a
merge (BPE) one, whose result is the one path in which merging would leave every two
neighbouring pieces side by side; such a pair weighs -1 (a piece more), any other minus
infinity, so the best path is the library's own result, piece by piece. Characters outside
the vocabulary fall back to their bytes and bind to nothing.

A document of more than ``CHUNK`` symbols is cut at fixed places. A state at a cut is the
piece across it: (symbols it reaches beyond the cut, piece). For each chunk the weights
between its entry and exit states form a max-plus matrix; matrices combine associatively, an
exclusive scan from both ends names the best state at every cut, and each chunk is then
backtraced on its own from its two states. A place where a space follows another character
is passed by every path, so only stretches without one carry several states. Shorter
documents are a single chunk; words are remembered by each worker (``CACHE_WORDS``).

Decoding joins pieces and bytes and drops the dummy space in front. A null or empty text has
no ids and decodes to the empty text. U+2581 in a text is a space to the model. Repeated rows
encode alike; null doc_ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import SLICE_ROWS, append, held, stage, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CHUNK = 32_768
CACHE_WORDS, CACHE_PAIRS = 150_000, 250_000
#: The state of a cut that every path passes between two pieces.
OPEN = -(1 << 30)
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

State = tuple[int, int]
Matrix = dict[State, dict[State, int]]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Segmenter:
    """The lattice of one vocabulary. Tokens are piece ids, or -1 - code point for a
    character that has no piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        self.byte_id = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.text = {i: model.id_to_piece(i) for i in ids if not special(i)}
        self.score = {self.text[i]: model.get_score(i) for i in self.text}
        self.ids = {p: i for i, p in self.text.items()}
        self.reach = max(map(len, self.ids))
        #: Pieces by their symbols: symbol -> (what may follow, the id of a piece that ends
        #: here and that merging makes at all, or OPEN).
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p[:-1]:
                node = node.setdefault(c, ({}, OPEN))[0]
            node[p[-1]] = (node.get(p[-1], ({}, OPEN))[0], i if self.merged(p) == [p] else OPEN)
        #: Neighbours inside any piece; between others no piece passes.
        self.bound = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.raw = [b""] * len(ids)
        for b, i in self.byte_id.items():
            self.raw[i] = bytes([b])
        for i, p in self.text.items():
            self.raw[i] = p.replace(SPACE, " ").encode()

    def merged(self, text: str) -> list[str]:
        """Merging in order of score, leftmost first; for the few symbols of two pieces."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def joins(self, a: int, b: int) -> bool:
        """Whether b may follow a: merging leaves the two as they are."""
        if a < 0 or b < 0:
            return True
        found = self.pairs.get(a << 20 | b)
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                for key in list(islice(reversed(self.pairs), CACHE_PAIRS // 2)):  # the last ones: the first are mostly frequent
                    del self.pairs[key]
            x, y = self.text[a], self.text[b]
            found = self.pairs[a << 20 | b] = x[-1] + y[0] not in self.bound or self.merged(x + y) == [x, y]
        return found

    def starting(self, text: str, at: int) -> list[tuple[int, int]]:
        """(token, length) of what may start at a place."""
        out, node = [], self.trie
        for end in range(at, min(at + self.reach, len(text))):
            found = node.get(text[end])
            if found is None:
                break
            node, i = found
            if i >= 0:
                out.append((i, end + 1 - at))
        return out or [(-1 - ord(text[at]), 1)]

    def run(self, text: str, at: int, last: int, stop: int) -> dict[int, tuple[int, int, int]]:
        """place -> (last token, its start, pieces) for every place that an admissible path
        from ``at``, after token ``last``, reaches with its last piece starting before
        ``stop``. A place has one such path at most."""
        reached = {at: (last, at, 0)}
        trie, pairs, size = self.trie, self.pairs, len(text)
        for place in range(at, min(stop, size)):
            here = reached.get(place)
            if here is None:
                continue
            before, count, found, node, end = here[0], here[2] + 1, False, trie, place
            while end < size:
                step = node.get(text[end])
                if step is None:
                    break
                node, token = step
                end += 1
                if token >= 0:
                    found = True
                    if end not in reached:
                        fits = before < 0 or pairs.get(before << 20 | token)
                        if fits is None:
                            fits = self.joins(before, token)
                        if fits:
                            reached[end] = (token, place, count)
            if not found:
                reached[place + 1] = (-1 - ord(text[place]), place, count)
        return reached

    def back(self, reached: dict[int, tuple[int, int, int]], at: int, end: int) -> list[int]:
        """Tokens from at to end."""
        out = []
        while end > at:
            token, end, _ = reached[end]
            out.append(token)
        return out[::-1]

    def sole(self, text: str) -> list[int]:
        """Tokens of the one admissible path over a stretch that every path enters and leaves
        between pieces: ``run`` and ``back`` in depth, longest piece first. A place has one
        admissible path to it at most, so a place that leads nowhere is given up for good."""
        trie, pairs, size = self.trie, self.pairs, len(text)
        out: list[int] = []
        places: list[int] = []
        choices: list[list[tuple[int, int]]] = []
        lost: set[int] = set()
        place, before, options = 0, OPEN, None
        while place < size:
            if options is None:
                options, node, end = [], trie, place
                while end < size:
                    step = node.get(text[end])
                    if step is None:
                        break
                    node, token = step
                    end += 1
                    if token >= 0:
                        options.append((token, end))
                if not options:
                    options.append((-1 - ord(text[place]), place + 1))
            while options:
                token, end = options.pop()
                if end in lost:
                    continue
                if before < 0 or token < 0:
                    break
                fits = pairs.get(before << 20 | token)
                if fits is None:
                    fits = self.joins(before, token)
                if fits:
                    break
            else:
                lost.add(place)
                place, options = places.pop(), choices.pop()
                out.pop()
                before = out[-1] if out else OPEN
                continue
            out.append(token)
            places.append(place)
            choices.append(options)
            place, before, options = end, token, None
        return out

    def emit(self, tokens: list[int]) -> bytes:
        if min(tokens, default=0) >= 0:
            return array("I", tokens).tobytes()
        ids = array("I")
        for t in tokens:
            if t >= 0:
                ids.append(t)
            elif self.byte_id:
                ids.extend(self.byte_id[b] for b in chr(-1 - t).encode("utf-8", "surrogatepass"))
            else:
                ids.append(self.unknown)
        return ids.tobytes()

    def word(self, word: str) -> bytes:
        """ids of a stretch that every path enters and leaves between pieces."""
        found = self.known.get(word)
        if found is None:
            bound, starts = self.bound, [0]
            starts += [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in bound]
            if len(starts) > 1:
                found = b"".join(self.word(word[i:j]) for i, j in zip(starts, [*starts[1:], len(word)]))
            else:
                found = self.emit(self.sole(word))
            if len(word) <= 64:
                if len(self.known) >= CACHE_WORDS:
                    self.known = dict(islice(self.known.items(), CACHE_WORDS // 2))  # the first ones: mostly frequent
                self.known[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """ids of escaped text as little-endian 32-bit integers."""
        return b"".join(map(self.word, _WORD.findall(text)))

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "surrogatepass" if b"\xed" in raw else "replace")


def segmenter(path: str) -> Segmenter:
    """One for each Python worker and vocabulary."""
    return held("pieces", path, lambda: Segmenter(path))


def escaped(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


class Chunk:
    """A piece of a document: symbols [start, stop) of text, which holds context around."""

    def __init__(self, seg: Segmenter, text: str, start: int, stop: int):
        self.seg, self.text, self.start, self.stop = seg, text, start, stop
        opens = lambda i: i <= 0 or i >= len(text) or (text[i] == SPACE and text[i - 1] != SPACE)
        self.opens = opens
        self.first = next((i for i in range(start, stop + 1) if opens(i)), None)
        self.last = next((i for i in range(stop, start - 1, -1) if opens(i)), None)

    def states(self, cut: int) -> list[State]:
        """All pieces of the text that reach or pass a cut, as states."""
        if self.opens(cut):
            return [(0, OPEN)]
        reach, out = self.seg.reach, []
        for at in range(max(0, cut - reach), cut):
            out += [(at + n - cut, t) for t, n in self.seg.starting(self.text, at) if at + n >= cut]
        return out

    def _exits(self, reached: dict, used: int) -> dict[State, int]:
        if self.opens(self.stop):
            return {(0, OPEN): -(used + reached[self.stop][2])} if self.stop in reached else {}
        return {(p - self.stop, t): -(used + n) for p, (t, s, n) in reached.items() if p >= self.stop and s < self.stop}

    def matrix(self) -> Matrix:
        """Weights between entry and exit states. What lies between the first and the last
        open place is common to every path, so it is left out."""
        out: Matrix = {}
        after = self.seg.run(self.text, self.last, OPEN, self.stop) if self.last is not None else {}
        for offset, token in self.states(self.start):
            at = self.start + offset
            if self.first is None:
                if at > self.stop or (at == self.stop and not self.opens(at)):  # the piece passes the chunk whole
                    out[offset, token] = {(at - self.stop, token): 0}
                    continue
                out[offset, token] = self._exits(self.seg.run(self.text, at, token, self.stop), 0)
                continue
            reached = self.seg.run(self.text, at, token, self.first)
            if self.first in reached:
                out[offset, token] = self._exits(after, reached[self.first][2])
        return {k: v for k, v in out.items() if v}

    def middle(self) -> bytes:
        return self.seg.encode(self.text[self.first : self.last])

    def backtrace(self, entry: State, exit: State) -> bytes:
        """ids of the pieces after the entry state's, up to the exit state's."""
        at, end = self.start + entry[0], self.stop + exit[0]
        run, back, emit = self.seg.run, self.seg.back, self.seg.emit
        if self.first is None:
            return emit(back(run(self.text, at, entry[1], self.stop), at, end)) if end > at else b""
        head = emit(back(run(self.text, at, entry[1], self.first), at, self.first))
        return head + self.middle() + emit(back(run(self.text, self.last, OPEN, self.stop), self.last, end))


def combine(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product: associative."""
    out: Matrix = {}
    for i, row in a.items():
        best: dict[State, int] = {}
        for j, w in row.items():
            for k, v in b.get(j, {}).items():
                if k not in best or w + v > best[k]:
                    best[k] = w + v
        if best:
            out[i] = best
    return out


def scan(matrices: list[Matrix]) -> list[Matrix]:
    """Inclusive prefix products, by pairs: combine neighbours, scan the halves, fill in."""
    if len(matrices) <= 1:
        return list(matrices)
    halves = scan([combine(a, b) for a, b in zip(matrices[::2], matrices[1::2])])
    out = []
    for i, m in enumerate(matrices):
        out.append(matrices[0] if i == 0 else halves[i // 2] if i % 2 else combine(halves[i // 2 - 1], m))
    return out


def states_at_cuts(matrices: list[Matrix]) -> list[State]:
    """The state of the best whole path at each cut, both ends included."""
    turned = lambda m: {j: {i: m[i][j] for i in m if j in m[i]} for j in {j for row in m.values() for j in row}}
    ends = (0, OPEN)
    ahead = [{ends: 0}, *(m.get(ends, {}) for m in scan(matrices))]
    behind = [{ends: 0}, *(m.get(ends, {}) for m in scan([turned(m) for m in reversed(matrices)]))][::-1]
    return [max((w + b[s], s) for s, w in a.items() if s in b)[1] for a, b in zip(ahead, behind)]


def _split(batches: Iterable[pa.RecordBatch], seg_path: str, chunk: int) -> Iterator[pa.RecordBatch]:
    """(key, k, text, start, stop) of documents longer than a chunk."""
    reach = segmenter(seg_path).reach
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = escaped(text.as_py())
            cuts = [*range(0, len(s), chunk), len(s)]
            rows = [{"key": key, "k": k, "text": s[max(0, a - reach) : b + reach], "start": a - max(0, a - reach), "stop": b - max(0, a - reach)} for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.int64()), ("k", pa.int32()), ("text", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))


def _chunk(seg: Segmenter, row: dict) -> Chunk:
    return Chunk(seg, row["text"], row["start"], row["stop"])


_WAYS = "key long, k int, ways array<struct<in_at: int, in_token: int, out_at: int, out_token: int, weight: long>>"


def _matrices(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    seg = segmenter(path)
    kinds = pa.schema([("key", pa.int64()), ("k", pa.int32()), ("ways", pa.list_(pa.struct([("in_at", pa.int32()), ("in_token", pa.int32()), ("out_at", pa.int32()), ("out_token", pa.int32()), ("weight", pa.int64())])))])
    for batch in batches:
        rows = [{"key": r["key"], "k": r["k"], "ways": [{"in_at": i[0], "in_token": i[1], "out_at": o[0], "out_token": o[1], "weight": w} for i, row in _chunk(seg, r).matrix().items() for o, w in row.items()]} for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def _cuts(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["k"])
    matrices: list[Matrix] = []
    for r in rows:
        m: Matrix = {}
        for w in r["ways"]:
            m.setdefault((w["in_at"], w["in_token"]), {})[w["out_at"], w["out_token"]] = w["weight"]
        matrices.append(m)
    at = states_at_cuts(matrices)
    out = [{"key": r["key"], "k": r["k"], "in_at": a[0], "in_token": a[1], "out_at": b[0], "out_token": b[1]} for r, a, b in zip(rows, at, at[1:])]
    return pa.Table.from_pylist(out, schema=pa.schema([("key", pa.int64()), *((n, pa.int32()) for n in ("k", "in_at", "in_token", "out_at", "out_token"))]))


def _traced(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    seg = segmenter(path)
    for batch in batches:
        rows = [{"key": r["key"], "k": r["k"], "ids": _chunk(seg, r).backtrace((r["in_at"], r["in_token"]), (r["out_at"], r["out_token"]))} for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.int64()), ("k", pa.int32()), ("ids", pa.binary())]))


def _joined(parts: pa.Table) -> pa.Table:
    """A document's ids, which are one value of the result, from its chunks'."""
    ids = b"".join(parts.sort_by("k")["ids"].to_pylist())
    return pa.table({"key": parts["key"][:1], "ids": pa.array([ids], pa.binary())})


def _whole(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    seg = segmenter(path)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            ids = [seg.encode(escaped(t.as_py())) for t in part.column(2)]
            yield pa.record_batch([*part.columns, pa.array(ids, pa.binary())], names=[*part.schema.names, "ids"])


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text and ids (binary, little-endian 32-bit integers) for every row of docs."""
    path = path or model_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("key"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    short = rows.where(size < chunk).mapInArrow(lambda b: _whole(b, path), "doc_id long, key long, text string, ids binary").drop("key")
    long = stage(rows.where(size >= chunk), "piece-giants")
    chunks = stage(long.select("key", "text").mapInArrow(lambda b: _split(b, path, chunk), "key long, k int, text string, start int, stop int").repartition("key", "k"), "piece-chunks")
    ways = chunks.mapInArrow(lambda b: _matrices(b, path), _WAYS)
    cuts = ways.groupBy("key").applyInArrow(_cuts, "key long, k int, in_at int, in_token int, out_at int, out_token int")
    traced = chunks.join(cuts, ["key", "k"]).mapInArrow(lambda b: _traced(b, path), "key long, k int, ids binary")
    joined = traced.groupBy("key").applyInArrow(_joined, "key long, ids binary")
    return short.unionByName(long.join(joined, "key").select("doc_id", "text", "ids"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (with ids) and the text that its ids spell, as ``decoded``."""
    path = path or model_path()
    return append(encoded, lambda ids: [[segmenter(path).decode(x) for x in ids]], "decoded string", "ids")


def _report(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    seg = segmenter(path)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            ids = part.column(2).to_pylist()
            texts = [seg.decode(x) for x in ids]
            same = [d == (t or "").replace(SPACE, " ") for d, t in zip(texts, part.column(1).to_pylist())]
            yield pa.record_batch({"doc_id": part.column(0), "n_pieces": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_crc32": pa.array(map(zlib.crc32, ids), pa.int64()), "decoded_crc32": pa.array([zlib.crc32(d.encode("utf-8", "surrogatepass")) for d in texts], pa.int64()), "round_trip": pa.array(same)})


def report(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as 32-bit integers), decoded_crc32, round_trip."""
    path = path or model_path()
    return encode(docs, path, chunk).mapInArrow(lambda b: _report(b, path), "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
