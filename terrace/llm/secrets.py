"""Secret scans: fixed patterns, and a character convolutional network over candidates.

``base`` patterns are matched leftmost and non-overlapping for each kind; they always stay.
Candidates are what base spans leave of runs of 16 or more token characters. Each is scored
over its whole length, in windows of ``INSIDE`` of its characters, ``STRIDE`` apart, and
``AROUND`` characters on either side, by one convolution, maxima inside and around, and a
logistic output, all in numpy. A candidate is added as kind ``model`` when any of its windows
reaches the threshold of its shape (letters alone, with digits, with signs).

Training: labelled findings are the base matches of all documents, with the pattern's key word
left out of the window, against candidates that no pattern takes and whose shape is surely
harmless (``HARMLESS``: words, paths, numbers, dates), and generated findings of usual secret
and harmless shapes. Other candidates may be secrets without a key word, so they have no label.
Every different window of a finding is used. Together those of a class weigh as ``FINDINGS``
ones at most, so that generated shapes keep their share in tables of any size. They are dealt
by hash into groups of about ``GROUP``; in a round each group makes a pass of Adam steps over its
own and the generated findings, and the groups' parameters and moments are averaged.
A calibration split sets slope and offset (Platt, by damped Newton steps) and the thresholds:
for each shape the highest one that keeps ``RECALL`` of its secrets, that of all secrets where a
shape has fewer than ``FEW``, and ``LEAST_CHANCE`` where there are none. Both are sums and exact
ranks over all findings of the split.

Null and empty texts have no span; repeated rows are scanned alike; an empty table trains on
generated findings only. ``scan`` keeps all columns of its input.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import append, release, stage, table
from terrace.operators import ranks

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_PART = r"(?:[A-Z]?[a-z]{2,20}(?:[A-Z][a-z]{2,20})*[0-9]{0,4}|[A-Z]{2,15}[0-9]{0,4}|[0-9]+(?:T[0-9]+Z?)?)"
#: Words, each with a short number at most, and numbers, between signs; or signs alone.
HARMLESS = re.compile(rf"[+/_=-]*(?:{_PART}(?:[+/_=-]+{_PART})*[+/_=-]*)?")
KEY_WORDS = ("passw", "secret", "token", "key")
KINDS = ("assign", "access", "hex", "model")
INSIDE, AROUND = 48, 16
#: Half a window, so that every key has a window with all or 24 of its characters.
STRIDE = INSIDE // 2
WINDOW = INSIDE + 2 * AROUND
CODES, DEPTH, FILTERS, WIDTH = 98, 10, 24, 5
FINDINGS, GROUP, ROUNDS = 3000, 20_000, 8
RECALL, LEAST_CHANCE = 0.98, 0.5
PRIOR, FEW = 1e-3, 50
SHAPES = 3
#: Parts of words, for long words that can be spoken, in capitals or not: these are no secrets.
SYLLABLES = ["tion", "elle", "ment", "la", "ai", "ing", "er", "en", "sch", "un", "der", "que", "re", "es", "ou", "ci", "on", "al", "ver", "te", "ma", "ro", "li", "so"]


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    found = []
    low = text.lower()
    if any(w in low for w in KEY_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What base spans leave of each run. Both are in order of their starts, so one pass over
    the base spans is enough: what matters is the furthest end among those begun before b."""
    out, at, reached = [], 0, 0
    for m in CANDIDATE.finditer(text):
        a, b = max(m.start(), reached), m.end()
        while at < len(taken) and taken[at][0] < b:
            if taken[at][0] > a:
                out.append((a, taken[at][0]))
            reached = max(reached, taken[at][2])
            a = max(a, reached)
            at += 1
        if a < b:
            out.append((a, b))
    return out


def window(text: str, start: int, end: int) -> bytes:
    """Codes of the characters around and inside: 0 outside the text, 1 beyond ASCII."""
    code = lambda s: bytes(ord(c) - 30 if " " <= c <= "~" else 97 if c == "\n" else 1 for c in s)
    before = code(text[max(0, start - AROUND) : start]).rjust(AROUND, b"\0")
    own = code(text[start : min(end, start + INSIDE)]).ljust(INSIDE, b"\0")
    return before + own + code(text[end : end + AROUND]).ljust(AROUND, b"\0")


def windows(text: str, start: int, end: int) -> Iterator[bytes]:
    """The windows of a span, the last one at its end."""
    last = max(start, end - INSIDE)
    return (window(text, a, min(end, a + INSIDE)) for a in (*range(start, last, STRIDE), last))


def shapes(x: np.ndarray) -> np.ndarray:
    """Of each window the shape of what is inside: 0 letters alone, 1 with digits, 2 with signs."""
    own = x[:, AROUND : AROUND + INSIDE]
    digit, letter = (own >= 18) & (own <= 27), ((own >= 35) & (own <= 60)) | ((own >= 67) & (own <= 92))
    return np.where(((own > 0) & ~digit & ~letter).any(1), 2, digit.any(1).astype(int))


def _goal(y, secret, harmless):
    """Platt's answers: a little within 0 and 1."""
    return (secret + 1) / (secret + 2) * y + (1 - y) / (harmless + 2)


def _below(n: int, recall: float = RECALL) -> int:
    """How many of n secrets may lie below a threshold."""
    return int((1 - recall) * n)


class Network:
    """Embedding, convolution, two maxima, logistic output."""

    NAMES = ("embed", "kernel", "bias", "out", "level")

    def __init__(self, seed: int = 5):
        dice = np.random.default_rng(seed)
        self.embed = dice.normal(0, 0.3, (CODES, DEPTH))
        self.kernel = dice.normal(0, (2 / (WIDTH * DEPTH)) ** 0.5, (WIDTH * DEPTH, FILTERS))
        self.bias = np.zeros(FILTERS)
        self.out = dice.normal(0, 0.1, 2 * FILTERS)
        self.level = np.zeros(1)
        self.slope, self.offset, self.thresholds = 1.0, 0.0, np.full(SHAPES, LEAST_CHANCE)
        self.first, self.second = ({n: np.zeros_like(getattr(self, n)) for n in self.NAMES} for _ in range(2))
        self.steps = 0

    def pack(self) -> np.ndarray:
        """Parameters and Adam's two moments in one row of numbers."""
        return np.concatenate([d[n].ravel() for d in (vars(self), self.first, self.second) for n in self.NAMES])

    def unpack(self, row: np.ndarray, steps: int) -> Network:
        at = 0
        for d in (vars(self), self.first, self.second):
            for n in self.NAMES:
                d[n], at = row[at : at + d[n].size].reshape(d[n].shape).copy(), at + d[n].size
        self.steps = steps
        return self

    def _forward(self, x: np.ndarray):
        e = self.embed[x]
        steps = WINDOW - WIDTH + 1
        patches = np.concatenate([e[:, k : k + steps] for k in range(WIDTH)], axis=2)
        maps = np.maximum(patches @ self.kernel + self.bias, 0)
        inside = slice(AROUND, AROUND + INSIDE - WIDTH + 1)
        near = maps.copy()
        near[:, inside] = -1
        at = np.stack([maps[:, inside].argmax(1) + AROUND, near.argmax(1)], axis=1)
        top = np.take_along_axis(maps, at, axis=1).reshape(len(x), -1)
        return patches, at, top, top @ self.out + self.level

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[3] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def scaled(self, z: np.ndarray) -> np.ndarray:
        """Chances of raw outputs."""
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -35, 35)))

    def chance(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(self.raw(x))

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> dict[str, np.ndarray]:
        patches, at, top, z = self._forward(x)
        dz = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) / len(x)
        dtop = (dz[:, None] * self.out * (top > 0)).reshape(len(x), 2, FILTERS)
        rows = np.arange(len(x))[:, None, None]
        picked = patches[rows, at]  # (rows, 2, filters, width * depth)
        dpatch = dtop[..., None] * self.kernel.T
        embed = np.zeros_like(self.embed)
        for k in range(WIDTH):
            np.add.at(embed, x[rows, at + k], dpatch[..., k * DEPTH : (k + 1) * DEPTH])
        return {"embed": embed, "kernel": np.einsum("rpf,rpfd->df", dtop, picked), "bias": dtop.sum((0, 1)), "out": top.T @ dz, "level": dz.sum(keepdims=True)}

    def learn(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, dice: np.random.Generator, batch: int = 64, rate: float = 0.01) -> None:
        """One pass of Adam steps."""
        order = dice.permutation(len(x))
        for i in range(0, len(x), batch):
            self.steps += 1
            at = order[i : i + batch]
            for n, g in self._gradients(x[at], y[at], weight[at]).items():
                self.first[n] = 0.9 * self.first[n] + 0.1 * g
                self.second[n] = 0.999 * self.second[n] + 0.001 * g * g
                setattr(self, n, getattr(self, n) - rate * (self.first[n] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[n] / (1 - 0.999**self.steps)) + 1e-8))

    def settle(self, measure: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], total: float) -> None:
        """Slope and offset. measure gives for both the loss, its gradient and its curvature,
        summed over findings that weigh total."""
        pull = PRIOR * total  # towards slope 1, offset 0: separable findings would drive them off
        whole = lambda found, a: found[0] + pull / 2 * float(((a - [1, 0]) ** 2).sum())
        a = np.array([1.0, 0.0])
        found = measure(a)
        for _ in range(100):
            step, size, now = np.linalg.solve(found[2] + pull * np.eye(2), found[1] + pull * (a - [1, 0])), 1.0, whole(found, a)
            new = measure(a - step)
            while size > 1e-6 and whole(new, a - size * step) > now + 1e-9 * abs(now):
                size /= 2
                new = measure(a - size * step)
            a, found = a - size * step, new
            if np.abs(size * step).max() < 1e-6:
                break
        self.slope, self.offset = max(1e-3, float(a[0])), float(a[1])

    def keep(self, raw: list[float | None], counts: list[int]) -> None:
        """Thresholds from the raw outputs that keep enough secrets of each shape and of all."""
        chosen = [raw[k] if counts[k] >= FEW else raw[SHAPES] for k in range(SHAPES)]
        self.thresholds = np.array([LEAST_CHANCE if z is None else float(self.scaled(np.array([z]))[0]) for z in chosen])

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        z = self.raw(x)
        d, goal = np.stack([z, np.ones_like(z)], axis=1), _goal(y, y.sum(), (1 - y).sum())

        def measure(a: np.ndarray):
            p = 1 / (1 + np.exp(-np.clip(d @ a, -35, 35)))
            return float((np.logaddexp(0, d @ a) - goal * (d @ a)).sum()), d.T @ (p - goal), (d * (p * (1 - p))[:, None]).T @ d

        self.settle(measure, len(z))
        kind = shapes(x)
        of = [z[(y == 1) & (kind == k)] for k in range(SHAPES)] + [z[y == 1]]
        self.keep([float(np.sort(c)[_below(len(c), recall)]) if len(c) else None for c in of], [len(c) for c in of])

    def over(self, x: np.ndarray) -> np.ndarray:
        """How far each window's chance is above its shape's threshold."""
        return self.chance(x) - self.thresholds[shapes(x)]


def generated(count: int = 1200, seed: int = 17) -> tuple[list[bytes], list[int]]:
    """Windows of usual secret shapes (1) and of harmless long tokens (0) between words."""
    dice = np.random.default_rng(seed)
    pick = lambda letters, n: "".join(letters[i] for i in dice.integers(0, len(letters), n))
    low, both = string.ascii_lowercase, string.ascii_letters + string.digits
    word = lambda: pick(low, int(dice.integers(2, 9)))
    spoken = lambda n: "".join(SYLLABLES[i] for i in dice.integers(0, len(SYLLABLES), n // 2))[: max(n, 16)]
    secret = [
        lambda n: pick(both, n), lambda n: pick(both + "+/", n) + "==", lambda n: pick(both + "-_", n),
        lambda n: "ghp_" + pick(both, 36), lambda n: "sk-" + pick(both, n), lambda n: pick("0123456789abcdef", n), lambda n: pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", n), lambda n: pick(string.ascii_letters, n),
    ]
    plain = [
        lambda n: "-".join(word() for _ in range(4)) + "-" + pick("0123456789", 4), lambda n: "_".join(word() for _ in range(4)) + pick("12", 1),
        lambda n: "/" + "/".join(word() for _ in range(4)) + "/" + pick("0123456789", 3), lambda n: pick("0123456789", n), lambda n: "-".join(pick("0123456789", 4) for _ in range(4)),
        lambda n: word() + word() + word() + pick("0123456789", 2), lambda n: "=" * n + pick("123", 1), lambda n: pick(low, n) + pick("0123456789", 1), lambda n: f"20{pick('012', 1)}{pick('0123456789', 1)}-0{pick('123456789', 1)}-1{pick('0123456789', 1)}T" + pick("0123456789", 6),
        lambda n: word().capitalize() + word().capitalize() + word().capitalize() + pick("0123456789", 1),
        lambda n: "-".join(word() for _ in range(5)), lambda n: "_".join(word() for _ in range(5)), lambda n: "/".join(word() for _ in range(5)), lambda n: pick(low, n),
        lambda n: "".join(word().capitalize() for _ in range(int(dice.integers(3, 8)))), lambda n: pick("=-_/+", 1) * n, lambda n: pick(both, 1) * n,
        lambda n: spoken(n).upper(), lambda n: spoken(n).capitalize(), lambda n: spoken(n) + pick("0123456789", 1), lambda n: spoken(n // 3 + 4).upper() * 2,
    ]
    out, labels = [], []
    for i in range(count):
        for label, shapes in ((1, secret), (0, plain)):
            token = shapes[i % len(shapes)](int(dice.integers(20, 44)))
            before = " ".join(word() for _ in range(4)) + (["", " ", ": ", "= "][int(dice.integers(0, 4))] if label else " ")
            lead = pick("/_-", 1).join(word() for _ in range(int(dice.integers(1, 20)))) + pick("/=_-", 1) if i % 4 == 3 else ""
            after = f" {word()} {word()} {word()}"
            if not label and i % 4 == 1:  # what is left of a run before a base span
                lead, token, after = "", word().upper() + pick("_-/?&", 1), f"{KEY_WORDS[i % 3]}={pick(both, 20)}"
            text = f"{before} {lead}{token}{after}"
            at, end = len(before) + 1, len(before) + 1 + len(lead) + len(token)
            last = max(at, end - INSIDE)
            for a in (*range(at, last, STRIDE), last):
                held = min(end, a + INSIDE) - max(a, at + len(lead))  # characters of the token
                if not label or held <= 0 or held >= min(len(token), STRIDE - 4):
                    out.append(window(text, a, min(end, a + INSIDE)))
                    labels.append(int(label and held > 0))
    return out, labels


def _findings(texts: list) -> list[list[list[tuple]]]:
    """(window, label) of each text: base matches, and harmless shapes that no pattern takes."""
    out = []
    for text in texts:
        text = text or ""
        taken = base(text)
        rows = []
        for start, kind, end in taken:
            if kind == 0:
                start = ASSIGN.match(text, start).start(2)
            if end - start >= 16:
                rows += [{"w": w, "label": 1} for w in windows(text, start, end)]
        rows += [{"w": w, "label": 0} for a, b in candidates(text, taken) if HARMLESS.fullmatch(text, a, b) for w in windows(text, a, b)]
        out.append(rows)
    return [out]


def labelled(docs: DataFrame) -> DataFrame:
    """The different windows of the findings of all docs (text), as written: (w, label, part).
    What is a secret anywhere has label 1; part 0 of 4 is left for calibration."""
    rows = append(docs.select("text"), _findings, "found array<struct<w: binary, label: int>>").select(F.explode("found").alias("f")).select("f.w", "f.label")
    part = F.pmod(F.xxhash64(F.lit("part"), "w"), F.lit(4)).cast("int")
    return stage(rows.groupBy("w").agg(F.max("label").alias("label")).withColumn("part", part), "findings")


def _matrix(windows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW)


def train(docs: DataFrame, group: int = GROUP, rounds: int = ROUNDS) -> Network:
    """A calibrated network from the findings of all docs (text) and generated ones."""
    found = labelled(docs)
    counts = {r.label: r.n for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weights = {k: min(1.0, FINDINGS / max(1, counts.get(k, 0))) for k in (0, 1)}
    shown, labels = generated()
    order = np.random.default_rng(23).permutation(len(shown))
    x, y = _matrix(shown)[order], np.array(labels, np.float64)[order]
    part = np.arange(len(x)) % 4 == 0
    model = _fitted(found.where("part > 0"), weights, max(1, -(-sum(counts.values()) // group)), x[~part], y[~part], rounds)
    _calibrate(model, found.where("part = 0"), weights, max(1, round(counts.get(1, 0) / FINDINGS)), x[part], y[part])
    return model


def _fitted(found: DataFrame, weights: dict[int, float], groups: int, x: np.ndarray, y: np.ndarray, rounds: int) -> Network:
    """Rounds of passes in groups of findings, each with x and y, and averages of what they learn.
    A finding weighs as many times more as there are groups, so each group's sums stand for all."""
    dealt = found.withColumn("g", F.pmod(F.xxhash64(F.lit("group"), "w"), F.lit(groups)).cast("int"))
    model = Network()

    def passed(g: int, own: list[tuple[bytes, int]], state: np.ndarray, steps: int, turn: int) -> Network:
        net = Network().unpack(state, steps)
        label = np.array([k for _, k in own], np.float64)
        weight = groups * np.where(label == 1, weights[1], weights[0])
        net.learn(np.concatenate([x, _matrix([w for w, _ in own])]), np.concatenate([y, label]), np.concatenate([np.ones(len(y)), weight]), np.random.default_rng([3, turn, g]))
        return net

    for turn in range(rounds):
        state, steps = model.pack(), model.steps

        def run(rows):  # run within this turn
            release()
            g, own = rows.column("g")[0].as_py(), sorted(zip(rows.column("w").to_pylist(), rows.column("label").to_pylist()))
            net = passed(g, own, state, steps, turn)
            return pa.table({"g": pa.array([g], pa.int32()), "steps": pa.array([net.steps], pa.int64()), "state": pa.array([net.pack().tobytes()], pa.binary())})

        got = sorted(dealt.repartition(groups, "g").groupBy("g").applyInArrow(run, "g int, steps long, state binary").collect())  # parameters of each group
        if got:
            model.unpack(np.mean([np.frombuffer(r.state) for r in got], axis=0), max(r.steps for r in got))
        else:
            model = passed(0, [], state, steps, turn)
    return model


def _calibrate(model: Network, found: DataFrame, weights: dict[int, float], times: int, x: np.ndarray, y: np.ndarray) -> None:
    """Slope, offset and thresholds by all of found and by x and y, whose secrets count several
    times among the thresholds', as they weigh more."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            own = _matrix(batch.column(0).to_pylist())
            yield pa.record_batch({"z": pa.array(model.raw(own), pa.float64()), "label": batch.column(1), "kind": pa.array(shapes(own), pa.int32())})

    weight = F.when(F.col("label") == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    scored = stage(found.select("w", "label").mapInArrow(score, "z double, label int, kind int").withColumns({"weight": weight, "times": F.lit(1)}), "scores")
    made = [(float(z), int(k), int(s), 1.0, times if k else 1) for z, k, s in zip(model.raw(x), y, shapes(x))]
    rows = scored.unionByName(found.sparkSession.createDataFrame(made, "z double, label int, kind int, weight double, times int"))
    total = {r.label: r.w for r in rows.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    goal = _goal(F.col("label"), *[F.lit(total.get(k, 0.0)) for k in (1, 0)])

    def measure(a: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        u = F.col("z") * float(a[0]) + float(a[1])
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), u))))
        loss, miss, bend = F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u))) - goal * u, p - goal, p * (1 - p)
        r = rows.select("z", "weight", loss.alias("l"), miss.alias("m"), bend.alias("b")).selectExpr(*[f"sum(weight * {e})" for e in ("l", "m * z", "m", "b * z * z", "b * z", "b")]).first()
        return r[0], np.array([r[1], r[2]]), np.array([[r[3], r[4]], [r[4], r[5]]])

    model.settle(measure, sum(total.values()))
    secret = rows.where("label = 1").select("z", "kind", F.explode(F.sequence(F.lit(1), "times")))
    counts = {r.kind: r.n for r in secret.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    kept = ranks.exact(secret, {**{str(k): F.when(F.col("kind") == k, F.col("z")) for k in range(SHAPES)}, "all": F.col("z")}, lambda n, _: [_below(n) + 1])
    model.keep([(kept.get(k) or [None])[0] for k in (*map(str, range(SHAPES)), "all")], [counts.get(k, 0) for k in range(SHAPES)])


def spans(texts: list, model: Network) -> list[list[tuple[int, int, int]]]:
    """All spans (start, kind number, end) of each text, sorted."""
    release()
    found = [base(t or "") for t in texts]
    asked = [(i, a, b) for i, t in enumerate(texts) if t for a, b in candidates(t, found[i])]
    best = np.full(len(asked), -1.0)
    for part in batched(((k, w) for k, (i, a, b) in enumerate(asked) for w in windows(texts[i], a, b)), 4096):
        x = np.frombuffer(b"".join(w for _, w in part), np.uint8).reshape(-1, WINDOW)
        np.maximum.at(best, [k for k, _ in part], model.over(x))
    for (i, a, b), p in zip(asked, best):
        if p >= 0:
            found[i].append((a, 3, b))
    return [sorted(x) for x in found]


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redacted(text: str | None, found: list[tuple[int, int, int]], mark: str = "<secret>") -> str | None:
    """text with its spans, merged where they overlap, replaced by mark."""
    if not found:
        return text
    out, at = [], 0
    for a, _, b in found:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, model: Network, compute, fields: str) -> DataFrame:
    """docs with the fields that compute makes of its texts and their spans."""
    return append(docs, lambda texts: compute(texts, spans(texts, model)), fields)


def _report(texts: list, found: list) -> list[list]:
    count = lambda kind: [sum(k == kind for _, k, _ in x) for x in found]
    sha = [hashlib.sha256(joined([s for s in x if s[1] < 3]).encode()).hexdigest() for x in found]
    return [count(0), count(1), count(2), sha, [joined(x) for x in found]]


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs), _report, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return found.drop("text")
