import random

import pytest

WORDS = [f"w{chr(97 + i % 26)}{i}" for i in range(400)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, empty, null and long texts, odd white space, special strings, repeated and missing ids."""
    rng = random.Random(5)
    base = [prose(rng, n) for n in (120, 80, 300, 60, 5, 4, 1)]
    rows = [(10, base[0]), (3, base[0].replace(" ", "\n", 3)), (11, base[0] + "  "), (12, base[1]), (13, "\t".join(base[1].split()))]
    words = base[2].split()
    for k in range(8):
        near = words.copy()
        for _ in range(k % 4):
            near[rng.randrange(len(near))] = "Edited" + str(k)
        rows.append((20 + k, " ".join(near)))
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, base[4]), (44, base[4].upper()), (45, base[5]), (46, base[5]), (47, base[6]), (None, base[3]), (None, None)]
    rows += [(50, base[3]), (50, base[3]), (50, "another text"), (60, prose(rng, 9000)), (61, "a <|endoftext|> b H̱ don't x y Été... stop!!! 123abc"), (62, "中文 한국 don't"), (63, "x" * 5000)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{k % 3}", -1, 0.5) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, digest long, score double").repartition(3)
