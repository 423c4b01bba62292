import numpy as np
import pytest
import xxhash

from skytriage.llm import embeddings, simhash
from skytriage.llm.common import components
from skytriage.llm.fingerprint import simhash as fingerprint
from skytriage.llm.golay import near_keys, own_key, tables


def groups(n, links):
    top = list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    grams = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprint():
    for t in (None, "", "  ", "One", "One two", "a b c a b c a b c", "ÀB c\td\nE f g", "x " * 70000):
        assert fingerprint(t) == slow_fingerprint(t)


def test_golay_words_one_flip_apart_share_a_key():
    assert np.bincount(tables()[1]).tolist() == [1, 23, 253, 1771]
    words = np.random.default_rng(0).integers(0, 1 << 23, 20000)
    for bit in range(23):
        keys, real = near_keys(words ^ (1 << bit))
        assert ((keys == own_key(words)[:, None]) & real).any(axis=1).all()


@pytest.mark.parametrize("limit", [512, 1])
def test_links_within_three_bits(spark, limit):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(centres.tolist()) | {0}
    for _ in range(400):
        x = int(rng.choice(centres))
        for bit in rng.choice(64, rng.integers(1, 7), replace=False):
            x ^= 1 << int(bit)
        fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64).view(np.int64)
    got = components(simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp bigint"), limit)).collect()
    label = {r["node"]: r["component"] for r in got}
    near = np.bitwise_count(fps[:, None].view(np.uint64) ^ fps[None, :].view(np.uint64)) <= 3
    want = groups(len(fps), zip(*np.nonzero(near)))
    same = {}
    for x, w in zip(fps.tolist(), want):
        same.setdefault(w, set()).add(label.get(x, x))
    assert all(len(v) == 1 for v in same.values()) and len({*map(tuple, same.values())}) == len(same)


def test_documents_against_brute_force(odd):
    rows = odd.select("doc_id", "text").collect()
    fps = np.array([slow_fingerprint(r["text"]) for r in rows], dtype=np.uint64)
    want = groups(len(fps), zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)))
    low = {}
    for w, r in zip(want, rows):
        low[w] = min([x for x in (r["doc_id"], low.get(w)) if x is not None], default=None)
    expected = sorted((str(r["doc_id"]), f"{f:016x}", str(low[w])) for r, f, w in zip(rows, fps.tolist(), want))
    got = simhash.near_duplicates(odd).select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id").collect()
    assert sorted((str(a), b, str(c)) for a, b, c in got) == expected
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(50)] + [(1000, 1000 + k) for k in range(1, 300)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(51)}, **{1000 + k: 1000 for k in range(300)}}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 24)) * np.linspace(3, 0.1, 24)
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(100 + k, (base[k % 5] * 2 + rng.normal(size=24) * rng.choice([0.0, 0.3, 1.0])).tolist()) for k in range(60)]
    rows += [(200, None), (201, []), (202, [0.0] * 24), (203, [float("nan")] * 24), (204, [1.0] * 3), (205, [2.0] * 3), (206, [None] + [1.0] * 23), (207, [float("inf")] + [0.0] * 23), (None, base[7].tolist()), (1, base[1].tolist())]
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "vec_id bigint, embedding array<double>, label int, rep string, key string").repartition(3)
    rows = [tuple(r)[:2] for r in frame.collect()]
    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v) / np.linalg.norm(v) if ok else None for (_, v), ok in zip(rows, usable)]
    links = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and usable[i] and usable[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    label = groups(len(rows), links)
    low = {}
    for w, r in zip(label, rows):
        low[w] = min([x for x in (r[0], low.get(w)) if x is not None], default=None)
    want = sorted((str(r[0]), sum(i == k for i, _ in links), str(low[w]), r[0] is not None and r[0] == low[w]) for k, (r, w) in enumerate(zip(rows, label)))
    got = embeddings.near_duplicates(frame).collect()
    assert sorted((str(a), n, str(c), k) for a, n, c, k in got) == want
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_tile_pairs_stop_early_without_losing_links():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 32)) * np.linspace(2, 0.2, 32)
    x = np.concatenate([x, x[:50] + rng.normal(size=(50, 32)) * 0.2])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {(int(a), int(b)) for i, j in embeddings.linked(x, x, 0.9) for a, b in zip(i, j)}
    assert got == set(zip(*(k.tolist() for k in np.nonzero(x @ x.T >= 0.9))))


def test_links_at_the_threshold_itself(spark):
    """Whole-number vectors of squared length 100, many of them with a product of exactly 90."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(40):
        at = rng.permutation(64)[:4]
        a, b = np.zeros(64), np.zeros(64)
        a[at[0]] = 10
        b[at] = [9, *rng.permutation([1, 3, 3])]
        sign = rng.choice([-1, 1], 64)
        # Lengths do not matter to a cosine, powers of two do not even to its digits.
        rows += [a * sign * 2.0 ** (k % 5), b * sign]
    whole = np.array([r / (np.sqrt(r @ r) / 10) for r in rows]).round()
    near = whole @ whole.T >= 90
    np.fill_diagonal(near, False)
    assert near.sum() >= 80 and (whole @ whole.T == 90).sum() >= 80
    got = embeddings.near_duplicates(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], "vec_id bigint, embedding array<double>")).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(near.sum(axis=1).tolist()))
