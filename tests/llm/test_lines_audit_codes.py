"""Line dedup, filter audit and vector codes on small fixtures, against brute force: nulls,
empty texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest

from terrace.llm import audit, codes, lines

SPACES = " \t\n\x0b\x0c\r"


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def line_rows():
    dice = random.Random(5)
    pool = [f"A passage of some length, number {i} of them" for i in range(12)] + ["short one", "x" * 19, "y" * 20, "É" * 19, "ü" * 20, " \x0bpadded on both of its sides\r", " not trimmed here, really ", "", "\t"]
    vary = lambda s: dice.choice([s, s.upper(), f"  {s}\t", f"{s}\r"])
    texts = ["\n".join(vary(dice.choice(pool)) for _ in range(dice.randint(0, 14))) for _ in range(60)]
    texts += [None, "", "\n", "\n\n", pool[0], pool[0], "only in two documents at all", "only in two documents at all\nand more", f"{pool[1]}\n" * 40]
    out = [(i, t, "k", 7) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, pool[2], "k", 7), (None, pool[2], "k", 7), (None, "held by rows without any id", "k", 7), *[(None, "held by rows without any id", "k", 7)] * 3]


def brute_lines(data):
    key = lambda line: ascii_lower(line.strip(SPACES))
    rows, keeper = {}, {}
    for doc, text, *_ in data:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                rows[k] = rows.get(k, 0) + 1
                keeper[k] = max(keeper.get(k, -1), -1 if doc is None else doc)
    out = []
    for doc, text, *_ in data:
        own = (text or "").split("\n")
        kept = [x for x in own if rows.get(key(x), 0) < 3 or keeper[key(x)] == (-1 if doc is None else doc)]
        out.append((-1 if doc is None else doc, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize(("shard_keys", "head"), [(lines.SHARD_KEYS, lines.HEAD), (8, 1), (8, 30)])
def test_lines_against_a_loop(spark, shard_keys, head):
    data = line_rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, kept string, n long").repartition(3)
    got = lines.dedup(docs, shard_keys=shard_keys, head=head)
    assert got.columns == ["doc_id", "text", "n", "n_lines", "n_dropped", "kept"]
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect())
    assert found == brute_lines(data) and sum(r[2] for r in found) > 50


def test_lines_of_an_empty_table(spark):
    assert lines.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_perfect_hash_in_levels():
    for n in (0, 1, 2, 17, 5000):
        h = np.random.default_rng(n).integers(0, 1 << 63, (n, 2), dtype=np.int64).view(np.uint64)
        built = lines.PerfectHash.unpack(*lines.PerfectHash.build(h).pack())
        assert sorted(built.slots(h).tolist()) == list(range(n))
    h[:, 0] = 5  # half of each key may be equal
    assert sorted(lines.PerfectHash.build(h).slots(h).tolist()) == list(range(n))


def test_foreign_keys_are_told_apart():
    dice = np.random.default_rng(3)
    h, other = (dice.integers(0, 1 << 63, (3000, 2), dtype=np.int64).view(np.uint64) for _ in range(2))
    shard = lines.Shard.unpack(*lines.Shard.build(h, np.arange(3000), np.arange(3000) % 7).pack())
    held, goes = shard.goes(h, np.zeros(3000, np.int64), 3)
    assert held.all() and (goes == ((np.arange(3000) >= 3) & (np.arange(3000) % 7 != 0))).all()
    assert not shard.goes(other, np.zeros(3000, np.int64), 0)[0].any()


def test_levels_end_in_a_list(monkeypatch):
    monkeypatch.setattr(lines, "LEVELS", 1)
    h = np.random.default_rng(1).integers(0, 1 << 63, (500, 2), dtype=np.int64).view(np.uint64)
    built = lines.PerfectHash.build(h)
    assert len(built.rest) and sorted(built.slots(h).tolist()) == list(range(500))


def document_rows():
    dice = random.Random(8)
    words = ["alpha", "Beta", "gamma", "delta", "one", "TWO", "price $5", "a|b", "été", "x"]
    pool = [" ".join(dice.choice(words[: dice.randint(1, 10)]) for _ in range(dice.randint(0, 130))) for _ in range(30)]
    pool += [None, "", " ".join(f"w{i}" for i in range(60)), "\t".join(f"Q{i}" for i in range(50)), "a b " * 60]
    out = [(i, dice.choice([None, "", "s0", "s1", "s2"]), dice.choice(pool), "d", 1) for i in range(120)]
    out += [(200 + i, f"s{i % 3}", pool[32], "d", 1) for i in range(15)] + [out[4], out[4], (None, "s1", pool[32], "d", 1), (None, None, None, "d", 1)]
    said = [(i, dice.choice([0, 1, None]), dice.choice([0, 1, None])) for i in range(0, 220, 2)] + [(4, 1, 0), (None, 1, 1), (999, 1, 1)]
    return out, said


def brute_audit(docs, said):
    def fails(doc, text):
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        yield len(w) < 50
        yield 100 * len(set(w)) < 65 * len(w)
        yield 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)
        yield bool(re.search("[#$%&*|]", t))
        yield doc is not None and any(d is not None and d < doc and (x or "") == t for d, _, x, *_ in docs)

    one = lambda doc, i: doc is not None and any(r[0] == doc and r[i] == 1 for r in said)
    rows = [(source or "", dict(zip("ABCDE", fails(doc, text))), one(doc, 1), one(doc, 2)) for doc, source, text, *_ in docs]
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                out[part, order, step] = [len(left), len(removed), sum(r[1][f] for r in gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in removed), sum(r[3] for r in removed)]
                gone += removed
    for (part, order, step), v in out.items():
        v.append(sum(out[part, o, o.index(order[step - 1]) + 1][1] for o in map("".join, permutations("ABCDE"))))
    return out


def test_audit_against_a_loop(spark):
    docs, said = document_rows()
    table = spark.createDataFrame(docs, "doc_id long, source string, text string, digest string, docs int").repartition(4)
    got = audit.audit(table, spark.createDataFrame(said, "doc_id long, quality int, toxic int")).collect()
    want = brute_audit(docs, said)
    assert len(got) == len(want) and all(list(r)[3:] == want[r.part, r.filter_order, r.step] for r in got)
    assert sum(r.toxic_lost + r.good_lost for r in got) > 0 and {r.part for r in got} == {"", "s0", "s1", "s2"}


def test_audit_of_empty_tables(spark):
    docs, _ = document_rows()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(spark.createDataFrame([], "doc_id long, source string, text string"), none).count() == 0
    got = audit.audit(spark.createDataFrame(docs[:5], "doc_id long, source string, text string, a string, b int"), none).toPandas()
    assert (got.good_lost == 0).all() and len(got) == 600 * got.part.nunique()


def test_outcomes_are_complete():
    m = audit.incidence()
    fails = np.array([[bool(mask >> "ABCDE".index(f) & 1) for order in audit.ORDERS for f in order] for mask in range(32)])
    assert m["kept"].shape == (32, 600) and (m["removed"] + m["redundant"] == fails).all()
    assert (m["removed"].reshape(32, 120, 5).sum(2) == (np.arange(32) > 0)[:, None]).all()  # who fails is removed once


def vector_rows(n=90, width=32):
    dice = np.random.default_rng(6)
    x = (dice.normal(size=(n, width)) * dice.choice([0.01, 0.3, 2.0], (n, 1))).astype(np.float32)
    out = [(int(i), v.tolist(), None if i % 7 == 0 else int(i % 3), "c", 1.0) for i, v in zip(dice.permutation(n) * 3 - 50, x)]
    out += [out[1], out[1], (out[2][0], out[3][1], 1, "c", 1.0), (None, out[4][1], 1, "c", 1.0), (7001, [0.5, -0.25, 1e30, -1e30], 2, "c", 1.0), (7002, [], 2, "c", 1.0)]
    return out, [(7003, None, 1, "c", 1.0), (7004, [float("nan")] * width, 1, "c", 1.0), (7005, [1.0] * 31 + [None], 1, "c", 1.0), (7006, [float("inf")] * width, None, "c", 1.0)]


def brute_codes(data, width):
    bound = codes.most(width)
    ints = [[min(bound, max(-bound, int(np.floor(np.float64(c) * 256)))) for c in v] + [0] * (width - len(v)) for _, v, *_ in data]
    size = width // 16
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is None, data[i][0] or 0, data[i][1]))[:64]
    books = [[ints[i][p * size : (p + 1) * size] for i in order] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(3):
        got = []
        for v in ints:
            parts = [v[p * size : (p + 1) * size] for p in range(16)]
            best = [min(range(len(order)), key=lambda e, p=p: (far(parts[p], books[p][e]), e)) for p in range(16)]
            got.append((best, sum(far(parts[p], books[p][e]) for p, e in enumerate(best))))
        if r < 2:
            for p in range(16):
                for e in range(len(order)):
                    own = [v[p * size : (p + 1) * size] for v, (best, _) in zip(ints, got) if best[p] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    return got, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize("n", [90, 20])
def test_codes_against_a_loop(spark, tmp_path, n):
    good, bad = vector_rows(n)
    spark.createDataFrame(good + bad, "vec_id long, embedding array<float>, label int, code string, error double").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = codes.op13_codes(spark, str(tmp_path)).collect()
    want, digest = brute_codes([(i, np.array(v, np.float32).tolist(), k) for i, v, k, *_ in good], 32)
    sums = {}
    for (_, _, label, *_), (_, error) in zip(good, want):
        sums[label] = sums.get(label, 0) + error
    rows = [(-1 if i is None else i, "".join(f"{e:02x}" for e in best), error, sums[label]) for (i, _, label, *_), (best, error) in zip(good, want)]
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted(rows)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_codes_restore_entries(spark):
    good, bad = vector_rows(40)
    done = codes.compress(spark.createDataFrame(good[:40] + bad, "vec_id long, embedding array<float>, label int, code string, error double"))
    back = {r.vec_id: np.array(r.integers) for r in done.restored().collect()}
    ints = {i: np.floor(np.array(v, np.float32).astype(float) * 256).astype(int) for i, v, *_ in good[:40]}
    assert all(((back[r.vec_id] - ints[r.vec_id]) ** 2).sum() == r.error for r in done.rows.collect()) and len(back) == 40
    nothing = codes.compress(spark.createDataFrame(bad, "vec_id long, embedding array<float>, label int, code string, error double"))
    assert nothing.books is None and nothing.rows.count() == 0
