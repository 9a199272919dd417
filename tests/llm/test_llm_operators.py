"""Every operator against a plain reading of its definition, on the awkward rows and on nothing."""

import hashlib
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from convoy.llm import bpe, byte_cnn, common, decontaminate, domain_lm, line_runs, minhash, quality_ratio, substrings, surrogates, toxicity
from convoy.llm.components import components

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


def plain(rows):
    return Counter(map(tuple, rows))


# 1 surrogates


def test_surrogates_keep_type_gender_script_and_format():
    text = (
        "Mr. John Smith and Mrs SMITH; Smith wrote. г-жа Анна Иванова. +1 (279) 555-0024, +12795550024, 4111 1111 1111 1111, "
        "10.1.2.3, 142.226.109.250, a.b@mail2.x.com, DE89 3704 0044 0532 0130 00"
    )
    found = surrogates.mentions(text)
    kinds = Counter(k for *_, k, _ in found)
    assert kinds == {"GIVEN_M": 1, "GIVEN_F": 1, "SURNAME": 4, "PHONE": 2, "CARD": 1, "IP": 2, "EMAIL": 1, "IBAN": 1}
    new = {(k, e): surrogates.candidate(b"k", k, e, 0) for *_, k, e in found}
    assert new["GIVEN_M", "john"] in {n.lower() for n in surrogates.GIVEN["M"]}
    assert new["GIVEN_F", "анна"] in {n.lower() for n in surrogates.GIVEN_CYRILLIC["F"]}
    assert all("а" <= c <= "я" for c in new["SURNAME", "иванова"])
    assert surrogates.luhn_ok(new["CARD", "4" + "1" * 15]) and new["IP", "10.1.2.3"].startswith("10.")
    assert surrogates._iban_ok(new["IBAN", "DE89370400440532013000"])
    assert surrogates.render("SMITH", "SURNAME", "hovu") == "HOVU"
    phone = surrogates.render("+1 (279) 555-0024", "PHONE", new["PHONE", "12795550024"])
    assert [c if not c.isdigit() else "9" for c in phone] == list("+9 (999) 999-9999")
    assert not surrogates.mentions(None) and not surrogates.mentions("nothing here, version 2.0.")
    for long in ("a" * 200_000, "1" * 200_000, "f0" * 100_000, "@" * 50_000):
        surrogates.mentions(long)


def test_surrogates_of_any_length():
    key, address = "0f" * 100, "x." * 60 + "y@mail.org"
    text = f"key {key}, mail {address}."
    assert [(text[a:b], k) for a, b, k, _ in surrogates.mentions(text)] == [(key, "TOKEN"), (address, "EMAIL")]
    long = "a" * 200_000 + "@m.org"
    assert [(a, b) for a, b, *_ in surrogates.mentions(long)] == [(0, len(long))]


def test_surrogates_over_a_corpus(spark, docs):
    mails = [f"u{i}@m.org" for i in range(40)]
    texts = [(100 + i, f"Write to {m.upper() if i % 2 else m} or 159.210.220.{i}.") for i, m in enumerate(mails * 2)]
    some = [(i, t, "en", "s", None, *["c"] * 10) for i, t in texts] + cases.rows()
    out = surrogates.surrogates(cases.documents(spark, some), b"key")
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "kinds" in out.columns
    got = out.collect()
    assert plain((r.doc_id, r.text) for r in got if not r.n_mentions) == plain(r[:2] for r in cases.rows())
    stand_in = defaultdict(set)
    for r in got:
        if r.n_mentions:
            stand_in[mails[(r.doc_id - 100) % 40]].add(r.text.split()[2].lower())
            assert r.text.split()[2].lower() not in mails
    assert all(len(s) == 1 for s in stand_in.values())  # coreference
    assert len({min(s) for s in stand_in.values()}) == 40  # distinctness
    assert surrogates.surrogates(cases.empty(spark), b"key").count() == 0


def test_stand_ins_never_clash(spark):
    """More given names than the pool has: the losers draw again."""
    names = [("GIVEN_F", f"name{i}") for i in range(60)] + [("GIVEN_F", n.lower()) for n in surrogates.GIVEN["F"]]
    entities = common.stage(spark.createDataFrame(names, "kind string, entity string"), "names")
    given = surrogates.stand_ins(entities, b"k").collect()
    assert len(given) == len(names) == len({r.stand_in for r in given})
    assert not {r.stand_in for r in given} & {n for _, n in names}


# 2 near-dedup


def brute_components(texts: list[tuple], width: int, percent: int = 80):
    """(doc_id, n, component, kept) by comparing all pairs of sets."""

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()

    sets = [shingles(t) for _, t in texts]
    group = list(range(len(texts)))
    changed = True
    links = [
        (i, j) for i in range(len(texts)) for j in range(i)
        if sets[i] and sets[j] and texts[i][0] is not None and texts[j][0] is not None
        and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    while changed:
        changed = False
        for i, j in links:
            low = min(group[i], group[j])
            changed |= group[i] != group[j]
            group[i] = group[j] = low
    return sets, group


def test_candidates_are_verified_down_to_the_shared_bound(spark):
    """Sketches that share 55 to 60 of the 96 least values of their union."""
    rows, pairs = [], []
    for k in range(55, 61):
        rest = range(k, 96)
        for side in (0, 1):
            own = [v for v in rest if v % 2 == side]
            rows.append((2 * k + side, [*range(k), *own, *range(1000 * (side + 1), 1000 * (side + 1) + 96 - k - len(own))]))
        pairs.append((2 * k, 2 * k + 1))
    classes = spark.createDataFrame(rows, "rep long, sketch array<long>")
    got = minhash.estimated(spark.createDataFrame(pairs, "a long, b long"), classes).collect()
    assert sorted(r.a // 2 for r in got) == [56, 57, 58, 59, 60]


@pytest.mark.parametrize("width", [2, 5])
@pytest.mark.parametrize("short", [32, 2])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, width, short):
    """Also with every list over two documents treated as a long one, in blocks of four."""
    monkeypatch.setattr(minhash, "SHORT", short)
    monkeypatch.setattr(minhash, "TRIES", 1 if short == 2 else 6)
    monkeypatch.setattr(minhash, "BLOCK", 4 if short == 2 else 512)
    base = cases.prose(50, 400)
    crowd = [(200 + k, cases.edited(cases.edited(base, 19 + k), 31 + 2 * k)) for k in range(24)]
    some = [r for r in cases.rows() if r[0] is not None and r[0] not in (14, 15)] + [(i, t, "en", "s", 1, *["c"] * 10) for i, t in crowd]
    sets, group = brute_components([r[:2] for r in some], width)
    least = {}
    for r, g in zip(some, group, strict=True):
        least[g] = min(least.get(g, r[0]), r[0])
    got = {r.doc_id: r for r in minhash.near_duplicates(cases.documents(spark, some), width).collect()}
    assert len(got) == len(some)
    for r, s, g in zip(some, sets, group, strict=True):
        x = got[r[0]]
        assert (x.n_shingles, x.component_id, x.kept) == (len(s), least[g], r[0] == least[g])


def test_near_duplicates_of_awkward_rows(spark, docs):
    out = minhash.near_duplicates(docs, 2).collect()
    assert len(out) == docs.count()
    none = [r for r in out if r.doc_id is None]
    # the copy of document 1 joins it; the others have nothing to join
    assert sorted((r.component_id is None, r.kept) for r in none) == [(False, False), (True, True), (True, True)]
    assert {r.component_id for r in out if r.doc_id in (4, 5, 6)} == {4, 5, 6}
    assert len({(r.n_shingles, r.component_id) for r in out if r.doc_id == 14}) == 1
    kept = minhash.drop_near_duplicates(docs, 2)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in out)
    assert minhash.near_duplicates(cases.empty(spark), 2).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, 2, 0.5)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100} and got[201] == 200 and 3 in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3 quality ratio


def test_quality_rules(spark, docs):
    trusted = spark.createDataFrame([(14,), (15,), (12,)], "doc_id long")
    got = quality_ratio.quality_rules(docs, trusted).collect()
    assert len(got) == docs.count()
    by_text = {(r[0], r[1]) for r in cases.rows()}
    for r in got:
        fits = [t for i, t in by_text if i == r.doc_id and len((t or "").encode().split()) == r.n_words]
        counts = [quality_ratio.base_counts(t or "") for t in fits]
        assert any(all(r[k] == v for k, v in c.items()) for c in counts)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.log_ratio >= quality_ratio.THRESHOLD)
    assert next(r for r in got if r.doc_id == 4).log_ratio == 0.0
    assert quality_ratio.quality_rules(cases.empty(spark), trusted).count() == 0
    none = quality_ratio.quality_rules(docs, trusted.where("false")).collect()
    assert {r.log_ratio for r in none} == {0.0}


def test_base_counts_by_hand():
    text = "a b c\n\n a b c\nd# a b c *\n\na b c\n"
    got = quality_ratio.base_counts(text)
    assert got == {"n_words": 14, "word_chars": 15, "n_symbols": 2, "n_dup_lines": 1, "n_repeat_words": 12}
    words = [b"x", b"y", b"z", b"q", b"y", b"z", b"x", b"y", b"z"]

    def slow(words):
        w = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(w)
        return len({i + k for i, x in enumerate(w) if n[x] > 1 for k in range(3)})

    assert quality_ratio.repeated_words(words) == slow(words) == 6
    rng = np.random.default_rng(1)
    for _ in range(50):
        words = [b"%d" % x for x in rng.integers(0, 4, rng.integers(0, 40))]
        assert quality_ratio.repeated_words(words) == slow(words)


def test_log_ratios_against_counting(spark):
    some = [(1, "a b a", "en", "s", 5, *["c"] * 10), (2, "a c!", "en", "s", 4, *["c"] * 10)]
    counts = quality_ratio.count_buckets(cases.documents(spark, some), spark.createDataFrame([(2,)], "doc_id long"), 10)
    expected = np.zeros((2, 1024))
    for i, t in ((0, "a b a"), (0, "a c!"), (1, "a c!")):
        np.add.at(expected[i], quality_ratio.ngram_buckets(t, 10), 1)
    assert (counts == expected).all() and counts[0].sum() == 5 + 5


# 4 line runs


def slow_line_dedup(texts: list[tuple], min_words: int = 50) -> list[str | None]:
    """Texts without lines of repeated runs, by trying every run of lines."""
    first, runs = {}, []
    for d, (_, text) in enumerate(texts):
        lines = text.split("\n") if text is not None else []
        use = [i for i, x in enumerate(lines) if x.strip(" \t\r\f\v")]
        for a in range(len(use)):
            words = 0
            for b in range(a, len(use)):
                words += len(lines[use[b]].split())
                if words >= min_words:
                    body = tuple(lines[i] for i in use[a : b + 1])
                    first.setdefault(body, (d, a))
                    runs.append((d, a, use[a], use[b], body))
                if words >= 3 * min_words:
                    break
    gone = defaultdict(set)
    for d, a, i, j, body in runs:
        if first[body] != (d, a):
            gone[d] |= set(range(i, j + 1))
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, (_, t) in enumerate(texts)]


def test_line_runs_against_all_runs(spark):
    run = cases.prose(60, 130, 9)
    head, tail = cases.prose(61, 30, 7), cases.prose(62, 30, 7)
    inner = "\n".join(run.split("\n")[2:12])
    some = [
        (1, head + "\n" + run), (2, run + "\n" + tail), (3, "short\n\n" + inner + "\n \nlast"), (4, run + "\n" + run), (5, None), (6, ""),
        (7, "\n".join(["one"] * 120)), (8, cases.prose(63, 60, 1000)), (9, "x\n" + cases.prose(63, 60, 1000) + "\ny"), (10, "boilerplate line\n" + cases.prose(64, 90)),
        (11, "boilerplate line\n" + cases.prose(65, 90)), (12, cases.prose(66, 49, 1000)), (13, cases.prose(66, 49, 1000)),
    ]
    expected = slow_line_dedup(some)
    out = line_runs.drop_repeated_runs(cases.documents(spark, [(i, t, "en", "s", 1, *["c"] * 10) for i, t in some]))
    got = {r.doc_id: r for r in out.collect()}
    assert {i: got[i].text for i, _ in some} == dict(zip([i for i, _ in some], expected, strict=True))
    assert got[8].n_removed == 0 and got[9].text == "x\ny" and got[13].n_removed == 0 and got[5].n_lines == 0 and got[6].n_lines == 1


def test_line_runs_of_awkward_rows(spark, docs):
    out = line_runs.drop_repeated_runs(docs)
    assert [c for c in out.columns if c != "n_lines"][:5] == docs.columns[:5]
    got = out.collect()
    assert len(got) == docs.count()
    text = defaultdict(list)
    for r in got:
        text[r.doc_id].append(r.text)
    # null ids come first, so documents 1 and 3 are copies of a null one
    assert text[1] == [""] and text[3] == [""] and text[4] == [None] and text[14] == [cases.prose(6, 120)] * 2
    assert line_runs.drop_repeated_runs(cases.empty(spark)).count() == 0


# 5, 6 classifiers


def marked(spark, bad: str):
    some, marks = [], []
    for i in range(240):
        text, toxic = cases.prose(1000 + i, 120), i % 3 == 0
        words = text.split(" ")
        if toxic:
            for k in range(4):
                words.insert((i + 29 * k) % len(words), bad + "zqx"[(i + k) % 3])
        some.append((i, " ".join(words), "en", "s", 1, *["c"] * 10))
        marks.append((i, 0 if toxic else 1, int(toxic)))
    return cases.documents(spark, some), cases.labels(spark, marks), {i: t for i, _, t in marks}


def held(i) -> bool:
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_toxicity_learns_subwords(spark, docs):
    texts, labels, truth = marked(spark, "grobian")
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(texts, labels).collect()}
    unseen = [i for i in got if held(i)]
    assert np.mean([(got[i] >= 0.7) == truth[i] for i in unseen]) > 0.9
    column = toxicity.toxicity_column(texts, labels)
    odd = {r[0]: r[1] for r in docs.select("doc_id", column("text").alias("s")).collect()}
    assert all(0 <= s <= 1 for s in odd.values()) and odd[4] == odd[5]
    # a misspelling that no training text has
    line = cases.prose(5000, 60)
    two = spark.createDataFrame([(1, line), (2, line.replace(" ", " grobiaan ", 2))], "doc_id long, text string")
    s = {r[0]: r[1] for r in two.select("doc_id", column("text").alias("s")).collect()}
    assert s[2] > s[1]
    assert toxicity.toxicity_scores(cases.empty(spark), labels).count() == 0
    alone = toxicity.toxicity_scores(texts, cases.labels(spark)).collect()
    assert len({r.score for r in alone}) == 1  # nothing learnt


def test_held_out_labels_change_nothing(spark):
    texts, labels, truth = marked(spark, "grobian")
    flipped = cases.labels(spark, [(i, t, 1 - t) if held(i) else (i, 1 - t, t) for i, t in truth.items()])
    a, b = (sorted(map(tuple, toxicity.toxicity_scores(texts, x).collect())) for x in (labels, flipped))
    assert a == b


def test_byte_cnn(spark, docs):
    texts, labels, truth = marked(spark, "### $$$ ")
    got = {r.doc_id: r.score for r in byte_cnn.quality_scores(texts, labels).collect()}
    assert np.mean([(got[i] >= 0.5) != truth[i] for i in got if held(i)]) > 0.9
    scored = byte_cnn.quality_scores(docs, labels).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert byte_cnn.quality_scores(cases.empty(spark), labels).count() == 0


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 479, 480, 512, 513, 992, 5000])
def test_chunks_cover_the_text(n):
    raw = bytes(i % 251 + 1 for i in range(n))
    chunks = byte_cnn.chunks_of(raw)
    step = byte_cnn.CHUNK - byte_cnn.OVERLAP
    whole = b"".join(c[: step if i + 1 < len(chunks) else None].tobytes() for i, c in enumerate(chunks))
    assert whole[:n] == raw and not any(whole[n:])


def test_label_sample_is_bounded(spark):
    texts, labels, _ = marked(spark, "grobian")
    sample = common.label_sample(texts, labels, "toxic", 10, 10_000)
    assert Counter(y for _, y in sample) == {0: 10, 1: 10} and sample == common.label_sample(texts, labels, "toxic", 10, 10_000)
    assert common.label_sample(texts, labels, "toxic", 10, 1) == []
    # one labelled id repeated many times: only its least text is learnt, and the copies meet before the driver
    known = texts.join(labels.where("toxic = 1"), "doc_id", "left_semi").where(~common.held_out()).select("doc_id", "text").orderBy("doc_id").limit(1)
    crowd = known.crossJoin(spark.range(50_000)).select("doc_id", F.concat("text", F.lit(" z"), F.col("id").cast("string")).alias("text"))
    many = common.label_sample(texts.select("doc_id", "text").unionByName(crowd), labels, "toxic", 10**6, 10_000)
    assert sorted(many) == sorted(common.label_sample(texts, labels, "toxic", 10**6, 10_000))


# 7 BPE


@pytest.fixture(scope="module")
def codec():
    ranks = bpe.read_ranks(VOCABULARY)
    pattern = public_tokenizers.PATTERN
    return bpe.BytePairEncoder(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", " ", "  a  b ", "x\n\n y \r\n", "don't can'T 12 3456", "a" * 5000, " " * 3000 + "z", "日本語テキスト" * 60, "<|endoftext|> a", "é!!? ß*** über|", "\x1c a b c",
    "́̈ é", "🙂🙂 🙂", "".join(map(chr, range(32, 0x2FFF, 7))), "ab" * 40 + " " + "ba" * 33, "word," * 300,
]


@pytest.mark.parametrize("text", TEXTS)
def test_encoder_equals_the_library(codec, text):
    ours, library = codec
    ids = ours.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert ours.decode(ids) == text.encode()


def test_encode_documents(spark, docs, codec):
    got = bpe.encode_documents(docs, VOCABULARY, public_tokenizers.PATTERN).collect()
    expected = plain((i, codec[1].encode_ordinary(t or "") and hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in cases.rows() if t)
    assert plain((r.doc_id, hashlib.sha256(bytes(r.decoded)).hexdigest()) for r in got if r.n_tokens) == expected
    assert len(got) == docs.count() and all(r.n_tokens == 0 and bytes(r.ids) == b"" for r in got if r.doc_id in (4, 5))
    assert bpe.encode_documents(cases.empty(spark), VOCABULARY, public_tokenizers.PATTERN).count() == 0


# 8 cross-entropy difference


def test_domain_lm_against_counting(spark, docs):
    some = [(1, "a b a b"), (2, "a c"), (3, "b b"), (4, None), (5, "")]
    texts = cases.documents(spark, [(i, t, "en", "s", 1, *["c"] * 10) for i, t in some])
    trusted = spark.createDataFrame([(1,)], "doc_id long")
    got = {r.doc_id: r for r in domain_lm.cross_entropy_difference(texts, trusted, size=10, bits=16).collect()}

    def loss(text, corpus):
        words = text.split()
        one, two = Counter(w for t in corpus for w in t.split()), Counter(p for t in corpus for p in zip(t.split(), t.split()[1:], strict=False))
        total = 0.0
        for i, w in enumerate(words):
            p1 = (one[w] + 1) / (sum(one.values()) + 4)  # three words and the unknown one
            before = one[words[i - 1]] if i else 0
            total -= np.log(0.6 * two[words[i - 1], w] / before + 0.4 * p1 if before else p1)
        return total / len(words)

    every = [t for _, t in some if t]
    for i in (1, 2, 3):
        assert got[i].background_loss == pytest.approx(loss(some[i - 1][1], every), rel=1e-5)
        assert got[i].target_loss == pytest.approx(loss(some[i - 1][1], ["a b a b"]), rel=1e-5)
    assert got[4].difference == got[5].difference == 0.0 and got[1].difference < 0 < got[3].difference
    assert domain_lm.cross_entropy_difference(docs, trusted, bits=12).count() == docs.count()
    assert domain_lm.cross_entropy_difference(cases.empty(spark), trusted, bits=12).count() == 0


def test_domain_lm_tells_all_words_and_pairs_apart(spark):
    """More distinct words than any fixed vocabulary held, all as rare, over many shards."""
    texts = [" ".join(f"w{i}x{k}" for k in range(300)) for i in range(200)] + ["w1x2 w1x1 w1x0", "common common"]
    rows = cases.documents(spark, [(i, t, "en", "s", 1, *["c"] * 10) for i, t in enumerate(texts)])
    trusted = spark.createDataFrame([(1,)], "doc_id long")
    got = {r.doc_id: r for r in domain_lm.cross_entropy_difference(rows, trusted, shard_bytes=50_000).collect()}
    one, two = Counter(w for t in texts for w in t.split()), Counter(p for t in texts for p in zip(t.split(), t.split()[1:], strict=False))
    good, good_two = Counter(texts[1].split()), Counter(zip(texts[1].split(), texts[1].split()[1:], strict=False))

    def loss(text, singles, pairs):
        words = text.split()
        p1 = [(singles[w] + 1) / (singles.total() + len(one) + 1) for w in words]
        seen = [0, *(singles[w] for w in words[:-1])]
        pair = [0, *(pairs[p] for p in zip(words, words[1:], strict=False))]
        return -sum(np.log(0.6 * c / b + 0.4 * p if b else p) for c, b, p in zip(pair, seen, p1, strict=True)) / len(words)

    assert len(one) == 60_001 and len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(t.split())
        assert got[i].background_loss == pytest.approx(loss(t, one, two))
        assert got[i].target_loss == pytest.approx(loss(t, good, good_two))
    assert got[1].difference < 0 < got[2].difference


# 9 substrings


def slow_cut(texts: list[tuple]):
    first = {}
    for i, t in texts:
        raw = (t or "").encode()
        for s in range(len(raw) - 49):
            key = raw[s : s + 50]
            first[key] = min(first.get(key, substrings.LAST), substrings.LAST if i is None else i)
    out = []
    for i, t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 49):
            if first[raw[s : s + 50]] < (substrings.LAST if i is None else i):
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), bytes(gone).replace(b"\0", b" ").split().__len__(), kept))
    return out


@pytest.mark.parametrize("shard, chunk", [(8 << 20, 1 << 18), (4000, 700)])
def test_repeated_strings_against_all_strings(spark, monkeypatch, shard, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    base = cases.prose(70, 200)
    some = [r[:2] for r in cases.rows() if r[0] not in (10, 11, 20)]
    some += [(30, base), (31, base[100:149]), (32, base[100:150]), (33, "q" + base[90:165] + "w"), (34, "ab" * 60), (35, "ba" * 60), (36, "é" * 80), (37, "zé" + "é" * 40)]
    rows = [(i, t, "en", "s", 1, *["c"] * 10) for i, t in some]
    got = substrings.drop_repeated_strings(cases.documents(spark, rows), shard).collect()
    assert plain((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == plain(slow_cut(some))


def shared_phrase(n: int) -> list[tuple]:
    """Documents with one phrase of under 50 bytes in texts of their own; every tenth also repeats the text before it."""
    phrase = " All rights reserved under this notice. "
    return [(i, cases.prose(500 + (i if i % 10 else 0), 12, 1000) + phrase + cases.prose(9000 + i, 12, 1000)) for i in range(n)]


@pytest.mark.parametrize("hot", [2, 64])
def test_repeated_strings_around_hot_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    some = shared_phrase(200) + [(None, shared_phrase(1)[0][1]), (1000, cases.prose(500, 12, 1000))]
    rows = [(i, t, "en", "s", 1, *["c"] * 10) for i, t in some]
    got = substrings.drop_repeated_strings(cases.documents(spark, rows), 4000).collect()
    assert plain((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == plain(slow_cut(some))


def test_contents_of_a_hot_anchor_do_not_meet_in_one_bucket(monkeypatch):
    own = lambda x: hashlib.sha256(str(x).encode()).hexdigest()
    some = [(i, own(i) + " All rights reserved under this notice, as is " + own(-i)) for i in range(1, 800)]
    buckets, table = 16, substrings.pa.table
    shards = []
    for k in range(buckets):
        ids, texts = zip(*some[k::buckets], strict=True)
        shards.append(table({"doc_id": ids, "key": [0] * len(ids), "text": texts, "shard": [k] * len(ids)}))
    of = lambda t, c, k: t.filter(substrings.pa.array([x == k for x in t[c].to_pylist()]))
    names = substrings.pa.concat_tables([substrings.anchor_names(s, buckets) for s in shards])

    def strings(hot):
        """Strings that meet in each bucket."""
        monkeypatch.setattr(substrings, "HOT", hot)
        repeated = substrings.pa.concat_tables([substrings.repeated_names(of(names, "bucket", b)) for b in range(buckets)])
        sent = Counter()
        for k, s in enumerate(shards):
            rows = substrings.contents(s, of(repeated, "shard", k), buckets)
            for b, more in zip(rows["bucket"].to_pylist(), rows["more"].to_pylist(), strict=True):
                sent[b] += len(more) + sum(more)
        return sent

    met, spread = strings(1 << 40), strings(8)
    assert max(met.values()) > met.total() / 3  # one anchor's contents in one bucket
    assert len(spread) == buckets and max(spread.values()) < 2 * spread.total() / buckets


def test_repeated_strings_of_long_and_no_texts(spark, docs):
    got = substrings.drop_repeated_strings(docs).collect()
    assert len(got) == docs.count() and next(r for r in got if r.doc_id == 10).n_removed == 0
    assert substrings.drop_repeated_strings(cases.empty(spark)).count() == 0


# 10 decontamination


def slow_hits(text: str | None, items: list[tuple]):
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1) if w else ():
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(words), len(hit), sorted((i for i in found if i is not None), key=str)


def test_find_items_against_all_windows(spark, docs):
    base = cases.prose(1, 300).split()
    items = [
        (10, " ".join(base[20:45])), (9, " ".join(base[40:52]).upper()), (2, "One, two"), (3, "one"), (4, None), (5, "?!"), (6, "É é"),
        (11, " ".join(base[20:30])), (12, cases.prose(99, 30)), (None, " ".join(base[60:75])), (13, "spam spam spam"), (11, "b c a b c"),
    ]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_items(docs, table).collect()
    expected = plain((i, *map(repr, slow_hits(t, items))) for i, t, *_ in cases.rows())
    assert plain((r.doc_id, repr(r.n_words), repr(r.n_hit), repr(r["items"])) for r in got) == expected
    kept = decontaminate.drop_contaminated(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(n for (_, _, hit, _), n in expected.items() if hit == "0")
    assert decontaminate.drop_contaminated(docs, table.where("false")).count() == docs.count()
    assert decontaminate.find_items(cases.empty(spark), table).count() == 0
