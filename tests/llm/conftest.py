import random

import pytest

#: Names that operators use inside; a table may hold them too.
CLASHING = ("fp key copies component component_id toxic toxic_score score _toxicity lang_pred _language hash shard_id depth n word words classes place start cell hits seed unit rep node").split()


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, blank and very long texts, ties, repeated rows and clashing extra columns."""
    rng = random.Random(4)
    words = ["".join(rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(rng.choice([1, 2, 3]))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(80).split(" ")
    rows = [(None, text(5)), (1, None), (2, ""), (3, " \n\t"), (4, "..."), (5, "word"), (6, "x" * 30000), (7, text(20000)), (8, text(12)), (8, text(12)), (9, None), (None, None)]
    rows += [(20 + k, " ".join([*base[:k], "changed", *base[k + 1:]])) for k in range(0, 30, 3)]
    rows += [(60, " ".join(base))] * 3 + [(61, " ".join(base).upper())] + [(100 + k, text(rng.choice([1, 2, 3, 40, 200]))) for k in range(40)]
    names = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), *["z"] * len(CLASHING)) for i, t in rows], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {names}").repartition(3)
