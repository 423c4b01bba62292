import hashlib
import random

import pytest

from skytriage.llm import piecewise as P


def slow_hash(window):
    h = 0
    for b in window:
        h = (h * 0x2C1B3C6D + b) % 2**32
    h = h * 0x9E3779B1 % 2**32
    h ^= h >> 15
    h = h * 0x85EBCA6B % 2**32
    return h ^ h >> 13


def slow_depths(data):
    """Zero low bits of the hash of every window, by its end."""
    out = {}
    for end in range(P.WINDOW, len(data) + 1):
        h = slow_hash(data[end - P.WINDOW: end])
        out[end] = (h & -h).bit_length() - 1 if h else 32
    return out


def slow_distance(s, t):
    row = list(range(len(t) + 1))
    for i, a in enumerate(s, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(row[j - 1] if a == b else 1 + min(row[j], new[-1]))
        row = new
    return row[-1]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgéhij日") for _ in range(rng.randrange(1, 9))) for _ in range(n))


@pytest.mark.parametrize("n", [0, 1, 3, 40, 700, -700])
def test_pieces_against_plain_loops(n, monkeypatch):
    monkeypatch.setattr(P, "SPAN", 50)
    data = prose(random.Random(n), n).encode() if n >= 0 else b"again " * -n
    depths = slow_depths(data)
    top = max(P.FINEST, (len(data) // P.PIECES).bit_length() - 1)
    low = max(P.FINEST, top - 2)
    level = max([k for k in range(low, top + 1) if sum(d >= k for d in depths.values()) >= P.PIECES], default=low)
    got, *parts = P.fingerprint(data).split(":")
    assert int(got) == level and len(parts) == P.LEVELS
    for k, part in enumerate(parts):
        cuts = [0]
        for end in range(1, len(data)):
            if depths.get(end, 0) >= level + k or end - cuts[-1] == P.LONGEST << level + k:
                cuts.append(end)
        cuts.append(len(data))
        assert part == "".join(f"{P.xxhash.xxh3_64_intdigest(data[a:b]) & 0xFFFF:04x}" for a, b in zip(cuts, cuts[1:]))


def test_edit_distance_against_plain_loops():
    rng = random.Random(1)
    for _ in range(200):
        s, t = ([rng.randrange(9) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        assert len(s) + len(t) - 2 * P._common(s, t) == slow_distance(s, t)


def test_likeness():
    rng = random.Random(2)
    a, b = prose(rng, 900), prose(rng, 900)
    mark = lambda t: P.fingerprint(t.encode())
    assert P.likeness(mark(a), mark(a)) == 1
    assert P.likeness(mark(a), mark(b)) < 0.1
    assert P.likeness(mark(a), mark(a[:2000] + "!" + a[2000:])) > 0.9
    assert P.likeness(mark(a), mark("moved " + a)) > 0.9
    assert 0.35 < P.likeness(mark(a), mark(a[: len(a) // 2] + b[: len(a) // 2])) < 0.7
    assert P.likeness(mark(a), mark(a[: len(a) // 2])) > 0.5
    assert P.likeness(mark(a), mark(a * 40)) == 0 or P.likeness(mark(a), mark(a[:5])) == 0
    assert P.likeness(mark(""), mark("x")) == 0


@pytest.mark.parametrize("text", ["a" * 300_000, "ab\n" * 100_000, "the same line again\n" * 9000])
def test_texts_that_repeat_themselves_stay_bounded(text):
    mark = P.fingerprint(text.encode())
    assert len(mark) < 4 * (P.CROWDED + 2) * P.LEVELS
    assert P.likeness(mark, P.fingerprint((text + text[:30]).encode())) > 0.5


def follows(rows):
    """(id, text) rows in the documented order with the row after each, but for the order of equal ids."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return list(zip(order, order[1:] + order[:1]))


def expected(mine, following):
    text, other = mine[1] or "", following[1] or ""
    half = len(text) // 2
    edited = (text[: len(text) - half] + other[:half]).encode()
    marks = [P.fingerprint(x) for x in (text.encode(), edited, other.encode())]
    return (mine[0], len(text), hashlib.sha256(edited).hexdigest(), marks[0], marks[1], P.likeness(marks[0], marks[1]), P.likeness(marks[0], marks[2]))


@pytest.mark.parametrize("count", [1, 2, 90])
def test_next_document(spark, count):
    rng = random.Random(3)
    rows = [(rng.choice([1, -1]) * k * 7, prose(rng, rng.choice([1, 5, 60]))) for k in range(count - 1)] + [(None, None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id bigint, text string, block string, guest int").repartition(4)
    got = sorted((tuple(r) for r in P.fingerprints(docs).collect()), key=str)
    assert got == sorted((expected(a, b) for a, b in follows(rows)), key=str)


def test_repeated_ids_form_one_ring(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    got = P.fingerprints(odd).collect()
    assert sorted(str((r["doc_id"], r["n_chars"])) for r in got) == sorted(str((i, len(t or ""))) for i, t in rows)
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(t)
    lone = {(a[0], expected(a, b)) for a, b in follows(rows) if len(ids[a[0]]) == 1 and len(ids[b[0]]) == 1}
    assert lone <= {(r["doc_id"], tuple(r)) for r in got}


def test_empty_table(spark):
    assert P.fingerprints(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
