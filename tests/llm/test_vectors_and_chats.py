"""Vector and chat operators against brute force."""

import math
import random

import numpy as np
import pytest

from skarn.llm import chat, hamming, lattice


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i] + 0.12 * rng.standard_normal(16)).tolist(), i % 3) for i in range(40)]
    rows += [(200 + i, (base[i] * 7).tolist(), (i + 1) % 3) for i in range(10)]
    rows += [(300, base[0].tolist(), 0), (301, base[0].tolist(), None), (302, None, 0), (303, [0.0] * 16, 0), (304, [], 0), (305, [math.nan] * 16, 0), (306, [1.0, None], 0), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0), (0, base[0].tolist(), 0), (309, [1e200] * 16, 1), (310, [1e200] * 15 + [1.1e200], 1), (311, [1e-200, 0.0] * 8, 2), (312, [2e-200, 0.0] * 8, 2), (313, [math.inf] + [1.0] * 15, 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_e8():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)) * 2
    p = lattice.e8(x)
    near = np.vstack([np.zeros(8), lattice.roots()])
    assert len(near) == 241 and np.allclose((lattice.roots() ** 2).sum(1), 2)
    assert np.allclose(p * 2, np.rint(p * 2)) and np.allclose(p.sum(1) % 2, 0)
    for a, b in zip(x, p, strict=True):  # no neighbour of the point is nearer
        assert ((a - b) ** 2).sum() <= (((a - b) - near) ** 2).sum(1).min() + 1e-9


@pytest.mark.parametrize("block, stages", [(1024, None), (4, 2)])
def test_lattice(vectors, brute_groups, block, stages):
    rows, df = vectors
    ok = [v is not None and len(v) > 0 and None not in v and all(map(math.isfinite, v)) and any(v) and l is not None for _, v, l in rows]
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in (a, b))
                if (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= 0.93:
                    pairs.append((a, b))
    got = lattice.links(df, tables=24, probes=12, block=block, stages=stages).collect()
    assert len(got) == len(rows)
    root = brute_groups(pairs, range(len(rows)))
    ids = {}
    for i, (v, _, _) in enumerate(rows):
        ids[root[i]] = min(ids.get(root[i], v), v)
    n = [sum(i in p for p in pairs) for i in range(len(rows))]
    want = sorted((rows[i][0], n[i], ids[root[i]]) for i in range(len(rows)))
    have = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    assert sum(h[1] for h in have) >= 0.97 * sum(w[1] for w in want)
    assert sum(h == w for h, w in zip(have, want, strict=True)) >= 0.95 * len(want)
    assert all(h[1] <= w[1] for h, w in zip(have, want, strict=True))


def test_lattice_nothing(vectors, spark):
    assert lattice.links(spark.createDataFrame([], vectors[1].schema)).count() == 0


def code(v):
    return None if v is None or not v or None in v or any(map(math.isnan, v)) else tuple(x < 0 for x in v)


@pytest.mark.parametrize("block, query_block", [(8192, 512), (16, 8)])
def test_hamming(vectors, spark, block, query_block):
    rows, df = vectors
    got = hamming.top_k(df, df, 5, block=block, query_block=query_block).collect()
    have = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        have.setdefault(r["query_id"], []).append((r["distance"], r["vec_id"]))
    for q, v, _ in rows:
        if q == 0:  # this id is there twice
            continue
        c = code(v)
        want = sorted((sum(a != b for a, b in zip(c, code(w), strict=True)), i) for i, w, _ in rows if i != q and code(w) and c and len(w) == len(v))[:5]
        assert have.get(q, []) == want


def test_hamming_few(spark):
    """With k above the number of others a query gets all of them, in codes of several lengths at once; empty tables give nothing."""
    rng = np.random.default_rng(8)
    every = [rng.standard_normal(5).tolist() for _ in range(9)] + [rng.standard_normal(64).tolist() for _ in range(6)] + [rng.standard_normal(12).tolist() for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(every)), "vec_id long, embedding array<double>")
    have = {}
    for r in sorted(hamming.top_k(df, df.filter("vec_id < 20"), 30).collect(), key=lambda r: r["rank"]):
        have.setdefault(r["query_id"], []).append((r["distance"], r["vec_id"]))
    for q in range(20):
        want = sorted((sum(a != b for a, b in zip(code(every[q]), code(v), strict=True)), i) for i, v in enumerate(every) if i != q and len(v) == len(every[q]))[:30]
        assert have.get(q, []) == want
    none = spark.createDataFrame([], df.schema)
    assert hamming.top_k(none, df).count() == hamming.top_k(df, none).count() == hamming.top_k(none, none).count() == 0


def test_segments():
    """Every code within distance m * (r + 1) - 1 shares a segment up to r flips; masks name each flip once."""
    rng = np.random.default_rng(1)
    for bits, n in ((128, 500), (64, 50_000), (64, 10**9), (5, 2), (200, 3000)):
        segs = hamming.segments(bits, n)
        assert segs[0][0] == 0 and segs[-1][1] == bits and all(x[1] == y[0] for x, y in zip(segs, segs[1:]))
        words = -(-bits // 64)
        for r in range(3):
            far = min(len(segs) * (r + 1) - 1, bits)
            for _ in range(50):
                q, c = np.zeros((1, words), np.uint64), np.zeros((1, words), np.uint64)
                for at in rng.choice(bits, far, replace=False).tolist():
                    c[0, at // 64] |= np.uint64(1 << at % 64)
                apart = [bin(int(hamming.value_of(q, s, e)[0] ^ hamming.value_of(c, s, e)[0])).count("1") for s, e in segs]
                assert min(apart) <= r and sum(apart) == far
    assert len(set(hamming.flips(10, 3).tolist())) == math.comb(10, 3)


def test_hamming_rounds(spark):
    """Enough codes that several radii are joined with the index; some queries end early, others late."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 64))
    near = np.concatenate([base[i % 300] + 0.25 * rng.standard_normal((1, 64)) for i in range(1500)])
    every = np.concatenate([base, near, rng.standard_normal((4200, 64)), np.ones((20, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>")
    got = hamming.top_k(df, df.filter("vec_id % 60 = 0"), 10).collect()
    sign = every < 0
    have = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        have.setdefault(r["query_id"], []).append((r["distance"], r["vec_id"]))
    for q in range(0, len(every), 60):
        d = (sign != sign[q]).sum(1)
        assert have[q] == sorted((int(d[i]), i) for i in range(len(every)) if i != q)[:10]


@pytest.mark.parametrize("stages", [1, 2, 3])
def test_lattice_recall(stages):
    """With production parameters, pairs at cosine 0.93 share a cell, one of the two at home, and their sketches stay near."""
    n = {1: 3000, 2: 1500, 3: 250}[stages]
    rng = np.random.default_rng(9)
    a = rng.standard_normal((n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((n, 64))
    o -= (o * a).sum(1, keepdims=True) * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * o / np.linalg.norm(o, axis=1, keepdims=True)
    tables = 8 * lattice.MORE ** (stages - 1)
    label = np.zeros(n, np.int64)
    x, y = (lattice.keys(v, label, tables, stages, 6, 0.55) for v in (a, b))
    met = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1)
    assert met.mean() >= 0.99
    assert (np.bitwise_count(lattice.sketches(a) ^ lattice.sketches(b)).sum(1) <= lattice.APART).all()


TEXTS = ["", " ok", "</s>[INST] ok [/INST]", "<|turn|>", "<⁣|turn|>x<⁣⁣|says|>", "é😀漢字 ", "\n\n a\n", "<|endoftext|>", "<", "|turn|>", "[INST", "a" * 300, "it's 12,5% <s>", "⁣", "<⁣"]


def test_escape():
    rnd = random.Random(0)
    for _ in range(2000):
        t = "".join(rnd.choice([*TEXTS, *chat.CONTROL, chat.ESCAPE]) for _ in range(rnd.randint(0, 6)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)


def test_chat(spark, path):
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(TEXTS) + rnd.choice(TEXTS)) for c in range(60) for t in range(rnd.randint(1, 6))]
    rows += [(-7, 0, "user", TEXTS[2]), (-7, 1, "assistant", TEXTS[2]), (None, None, None, None), (None, 1, "assistant", "x"), (70, 0, "assistant", "same"), (70, 0, "assistant", "same"), (71, 0, "assistant", "word " * 20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df, path).collect()
    assert len(out) == 64
    for r in out:
        turns = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]))
        assert chat.parse(r["formatted"]) == [(role, text) for _, role, text in turns]
        texts = chat.loss_texts(r["formatted"], r["loss"], r["loss_start"], r["loss_end"], r["loss_turn"])
        assert "".join(texts) == "".join(t for _, role, t in turns if role == "assistant")
        assert len(r["ids"]) // 4 == len(r["loss"])
    assert chat.digests(chat.format_chats(df, path)).count() == 64
    assert chat.digests(chat.format_chats(df.limit(0), path)).count() == 0


def test_lattice_stages(spark, monkeypatch):
    """Links at the threshold are found at production parameters where the number of vectors asks for two stages."""
    rnd = np.random.default_rng(5)
    a, z = rnd.standard_normal((2, 600, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    z -= (z * a).sum(1)[:, None] * a
    z /= np.linalg.norm(z, axis=1)[:, None]
    b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * z
    k, m = (lattice.keys(x, np.ones(600, np.int64), 8, 2, 6, 0.55) for x in (a, b))
    hit = ((k[:, :, :1] == m).any(2) | (k == m[:, :, :1]).any(2)).any(1)
    a, b = (np.concatenate([x[~hit], x[hit][: 40 - (~hit).sum()]]) for x in (a, b))  # those that eight tables miss, and some others
    assert 0 < (~hit).sum() < 40
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(lattice, "CELLS", 1.2)
    got = lattice.links(df).collect()
    assert sum(r["n_links"] for r in got) == 80
    assert all(r["component_id"] == r["vec_id"] % 40 for r in got)
