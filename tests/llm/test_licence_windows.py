import random

from quirespark.llm import licences
from tests.llm.conftest import prose


def test_notices_within_texts(spark):
    rng = random.Random(4)
    notice = dict(licences.TEMPLATES)
    around = lambda t: prose(rng, 200) + "\n" + t + "\n" + prose(rng, 300)
    wrap = lambda t, n=6, mark=" * ": "\n".join(mark + " ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    gpl, apache, texts = notice["GPL-3.0"], notice["Apache-2.0"], dict(licences.TEXTS)
    rows = [
        (1, around(wrap(gpl))),
        (2, prose(rng, 40) + " " + gpl + " " + prose(rng, 60)),
        (3, around(wrap(apache, 4, "# ") + "\n" + prose(rng, 30) + "\n" + wrap(apache, 5, "// "))),
        (4, around(wrap(gpl)) + "\n" + wrap(apache)),
        (5, around(" ".join(gpl.split()[:12]))),
        *((10 + k, around("Copyright (c) 2020 Someone\n" + t)) for k, t in enumerate(texts.values())),
    ]
    found = {(r.doc_id, r.licence): (r.n_units, round(r.dice, 2)) for r in licences.licence_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = {(1, "GPL-3.0"): (1, 1.0), (2, "GPL-3.0"): (1, 1.0), (3, "Apache-2.0"): (2, 1.0), (4, "GPL-3.0"): (1, 1.0), (4, "Apache-2.0"): (1, 1.0)}
    expected |= {(10 + k, licence): (1, 1.0) for k, licence in enumerate(texts)}
    assert {k: v for k, v in found.items() if k[0] < 10} == {k: v for k, v in expected.items() if k[0] < 10}
    assert {k: found.get(k) for k in expected} == expected
