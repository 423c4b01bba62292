import random
import re
from collections import Counter

import pytest

from skytriage.llm import byte_terms, divergence

PATTERN = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def slow(rows, top, min_docs=3):
    """The contract with dictionaries and plain loops."""
    docs = [(lang or "", source or "", PATTERN.findall(lower(text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(w for d in docs if d[0] == lang for w in set(d[2]))
        kept = [w for w, n in df.items() if n >= min_docs]
        counts = {s: Counter() for l, s, _ in docs if l == lang}
        for l, s, words in docs:
            if l == lang:
                counts[s].update(w for w in words if df[w] >= min_docs)
        whole = sum(counts.values(), Counter())

        def p(c, w):
            return 1 + 1000000000 * (c[w] + 1) // (sum(c.values()) + len(kept))

        for s, c in counts.items():
            pairs = [(-sum((p(c, w) - p(o, w)) ** 2 // p(o, w) for w in kept), b.encode(), b) for b, o in counts.items() if b != s]
            out += [(lang, s, "pair", b, -v, k) for k, (v, _, b) in enumerate(sorted(pairs), 1)]
            own = [(-((p(c, w) - p(whole, w)) ** 2 // p(whole, w)), w.encode(), w) for w in kept if c[w] and p(c, w) > p(whole, w)]
            out += [(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def read(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def documents(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "lang string, source string, text string, term string, p0 int")


@pytest.mark.parametrize("block, part", [(divergence.BLOCK, 4096), (25, 3)])
def test_against_plain_loops(spark, monkeypatch, block, part):
    monkeypatch.setattr(divergence, "PART", part)
    rng = random.Random(2)
    words = ["de", "Of", "été", "naïve", "x", "日本", "ab", "abc", "Zz"] + ["w" + chr(97 + k) for k in range(26)]
    rows = [(rng.choice(["en", "fr", None]), f"s{min(rng.randrange(9), 5)}", " ".join(rng.choices(words, k=rng.randrange(30))) + rng.choice(["", "7don't", "\x00Q\x7fq"])) for _ in range(200)]
    rows += [("en", "mute", None), ("en", None, ""), ("xx", "alone", "one"), ("yy", "a", "rare words"), ("yy", "b", "others"), ("en", "s0", "de de de")] + [("en", "s1", "ab ab of")] * 9
    found = divergence.divergence(documents(spark, rows).repartition(5), top=6, shards=3, block_size=block)
    assert read(found) == slow(rows, 6)


def test_empty_table(spark):
    assert divergence.divergence(documents(spark, [])).collect() == []


def test_pairs_of_sources_cut_at_any_batch(spark):
    rows = [("en", f"s{k % 4}", f"a b c {'d' * (k % 3)} e{'f' * (k % 5)}") for k in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert read(divergence.divergence(documents(spark, rows))) == slow(rows, divergence.TOP_TERMS)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("Über the  LAZY dog7 " * 50).encode()
    whole = [w for part in byte_terms.terms(text, byte_terms.LETTERS) for w in part]
    monkeypatch.setattr(byte_terms, "CHUNK", 7)
    assert [w for part in byte_terms.terms(text, byte_terms.LETTERS) for w in part] == whole == [w.encode() for w in PATTERN.findall(lower(text.decode()))]
