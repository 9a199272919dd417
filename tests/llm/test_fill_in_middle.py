"""Fill-in-middle against a plain reading, and the exact round trip."""

import hashlib
import random
import re
from collections import Counter

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from convoy.llm import fill_in_middle as fim


def plainly(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the definition."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_awkward_rows(spark):
    odd = ["<P>", "<P", "a<S>b", "é", "漢字😀 x", "<P>é<M><S>", "P>x<", "\n\n", "z" * 70_000, "q9 " * 90_000]
    some = cases.rows() + [(100 + i, odd[i % len(odd)], "en", "s", None, *["c"] * 10) for i in range(80)]
    docs = cases.documents(spark, some).withColumn("form", F.lit("x")).withColumn("output", F.lit("y"))
    made = fim.fill_in_middle(docs)
    assert set(docs.columns) - {"form", "output"} <= set(made.columns) and len(set(made.columns)) == len(made.columns)
    rows = fim.restored(made).select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(r[:2] for r in some)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode()) == plainly(r.doc_id, r.text)
        assert bytes(r.restored).decode() == (r.text or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert fim.restored(fim.fill_in_middle(cases.empty(spark))).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_kernels_on_random_batches(seed):
    """Outputs next to one another whose ends and starts look like tags."""
    rng = random.Random(seed)
    texts = ["".join(rng.choice("abZ <PSM>é漢😀\n") for _ in range(rng.choice([0, 1, 2, 5, 30]))) for _ in range(rng.choice([1, 3, 8]))]
    form = np.array([0 if not t or re.search("<[PSM]>", t) else rng.choice([0, 1, 2]) for t in texts])
    cuts = np.array([[rng.randrange(2**32), rng.randrange(2**32)] for _ in texts])
    data, size = np.frombuffer("".join(texts).encode(), np.uint8), np.array([len(t.encode()) for t in texts])
    out, length, *_ = fim.transform(data, size, form, cuts)
    back, again = fim.restore(out, length, form)
    assert back.tobytes() == data.tobytes() and (again == size).all()


def test_an_output_without_its_tags_is_refused():
    with pytest.raises(ValueError):
        fim.restore(np.frombuffer(b"<P>a<S>b", np.uint8), np.array([8]), np.array([fim.PSM]))
