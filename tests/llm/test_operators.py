"""Each operator against brute force on small tables that hold nulls, empty and long texts, ties and repeated rows."""

import hashlib
import os
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import common, decontaminate, extract, lm_score, neardup, neighbours, packing, pii, quality, secrets, toxicity
from lodestone.llm.components import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega café naïve ÉCOLE straße 日本 x1 42".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) * (rng.random() < 0.5) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    out = base + base[:8] + [None, None, "", " \n", "one", "one", "one two", "ONE two"]
    for t in base[:25]:  # near copies
        w = t.split(" ")
        for _ in range(3):
            v = list(w)
            for _ in range(max(1, len(v) // 25)):
                v[rng.randrange(len(v))] = rng.choice(WORDS)
            out.append(" ".join(v))
    out.append(" ".join(prose(rng, 3000) for _ in range(10)))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "a row without an id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


def empty(docs):
    return docs.limit(0)


# words and components


def test_words_are_found_within_texts_only():
    import pyarrow as pa

    data, offsets = common.text_bytes(pa.array(["ab cd", None, "", "ef", "gé h"]))
    starts, ends, owner = common.find_words(data, offsets, common.ALNUM)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == ["ab", "cd", "ef", "gé", "h"]
    assert owner.tolist() == [0, 0, 3, 4, 4]
    assert len(set(common.word_hashes(data, starts, ends).tolist())) == 5


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400, 400 + k) for k in range(1, 90)] + [(600 + k, 601 + k) for k in range(40)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {x: root(x) for x in parent if root(x) != x}
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1


def secret_brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@pytest.fixture(scope="module")
def secret_models(spark):
    return secrets.Models(secrets.labelled_samples(spark, 2000))


def test_secret_spans(spark, secret_models):
    rng = random.Random(2)
    pieces = ["password=", "Token: ", "api_key = \"", "secret", ":", "=", "abc", "hunter2hunter", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", " ", "\n", "🙂", "\"", "deadbeef"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "password=token=abcdefgh"), (903, "secret: token: abcdefg"), (904, "x é🙂 qZ8vK2mP9xR4tW7yB3nC6 and getUserAccountBalanceFromServer end")]
    rows.append(rows[902 - 900 + 400])
    found = secrets.report(spark.createDataFrame(rows, "doc_id long, text string"), secret_models).collect()
    assert len(found) == len(rows)
    by_id = dict(rows)
    for r in found:
        base = secret_brute(by_id[r.doc_id] or "")
        told = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest(), by_id[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b[1] == k for b in base) for k in range(3)]
        assert r.spans == told or set(filter(None, told.split(","))) < set(r.spans.split(","))
    extra = next(r.spans for r in found if r.doc_id == 904)
    assert extra == "markov:5:26"


def test_secret_models_part_random_from_ordinary(spark, secret_models):
    held = secrets.labelled_samples(spark, 3000, seed="held out").where("length(text) >= 20").select("label", (secrets._ratio_of(F.col("text"), secret_models.ratios) > secret_models.threshold).alias("hit"))
    share = {r.label: r.s for r in held.groupBy("label").agg(F.avg(F.col("hit").cast("int")).alias("s")).collect()}
    assert share[1] > 0.99 and share[0] < 0.01


def test_redaction_keeps_rows_and_columns(spark, secret_models):
    rows = [(1, "a password=hunter22 b", 21, "x"), (2, None, None, "y"), (3, "AKIA" + "A" * 20 + " é", 26, "z"), (4, "clean", 5, "_found")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, `odd.name` string")
    out = {r.doc_id: r for r in secrets.redact(docs, secret_models).collect()}
    assert [out[k].text for k in (1, 2, 3, 4)] == ["a [SECRET] b", None, "[SECRET] é", "clean"]
    assert [out[k].n_chars for k in (1, 2, 3, 4)] == [12, None, 10, 5] and out[4]["odd.name"] == "_found"


def test_random_parts_of_longer_strings(spark, secret_models):
    texts = ["see /service/application/configuration/settings/default/production/user/account/qZ8vK2mP9xR4tW7yB3nC/settings/transaction/history", "key q7Zk2Vx9Lm4Rt8Wp end", "the thatthedtherthinganderea of internationalization", "a/long/path/of/plain/words/and/more-words-still"]
    got = {r.doc_id: r.spans for r in secrets.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), secret_models).collect()}
    at = texts[0].index("qZ8")
    assert got == {0: f"markov:{at}:{at + 20}", 1: "markov:4:20", 2: "", 3: ""}


def test_many_spans_and_overlaps(spark, secret_models):
    """More spans than are gathered at once, and kinds that overlap: redaction covers what the spans do."""
    rng = random.Random(7)
    bits = ["token=" + "ab12cd34" * 4, "0123456789abcdef" * 2, "AKIA" + "B" * 20, " secret: " + "f" * 30 + "zz", " plain words ", "é🙂 "]
    texts = [" ".join("token=abc%05d" % k for k in range(3000)), *("".join(rng.choice(bits) for _ in range(12)) for _ in range(40)), "password=" + "a1" * 20 + "AKIA" + "C" * 18]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in secrets.report(docs, secret_models).collect()}
    assert found[0].n_assign == 3000
    clean = {r.doc_id: r.text for r in secrets.redact(docs.withColumn("base", F.lit(1)).withColumn("row", F.lit(2)), secret_models).collect()}
    for i, t in enumerate(texts):
        spans = sorted(tuple(map(int, x.split(":")[1:])) for x in found[i].spans.split(",") if x)
        out, at = "", 0
        for s, e in spans:
            if s >= at:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        assert clean[i] == out + t[at:], t


def test_secrets_of_an_empty_table(docs, secret_models):
    assert secrets.report(empty(docs), secret_models).count() == 0


# 2


def leak_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leak_brute(text, items, window=10):
    words = leak_words(text)
    hit, names = set(), set()
    for name, item in items:
        own = leak_words(item)
        size = min(window, len(own))
        for k in range(len(own) - size + 1 if own else 0):
            for p in range(len(words) - size + 1):
                if words[p : p + size] == own[k : k + size]:
                    hit.update(range(p, p + size))
                    names.add(name)
    return len(words), len(hit), sorted(str(n) for n in names if n is not None)


@pytest.fixture(scope="module")
def leaks(spark, texts):
    rng = random.Random(8)
    items = [(k, " ".join(texts[k].split()[:25])) for k in range(0, 40, 4)] + [(100, "alpha"), (101, "one two"), (102, None), (103, ""), (104, prose(rng, 30)), (None, "one"), (100, "x1 42")]
    return items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 200])
def test_contamination(docs, leaks, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCKS_AT_ONCE", 2)
    items, benchmark = leaks
    got = decontaminate.scan(docs, benchmark, block_bytes=block).collect()
    source = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((str(i), *map(str, leak_brute(t, items))) for i, t in source)
    assert sorted((str(r.doc_id), str(r.n_words), str(sum(s.end - s.start for s in r.spans)), str(list(r["items"]))) for r in got) == want


def test_contamination_digest_and_filter(docs, leaks):
    items, benchmark = leaks
    source = {r.doc_id: r.text for r in docs.collect()}
    for r in decontaminate.report(docs, benchmark).collect():
        n, hit, names = leak_brute(source[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(names), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
    wide = docs.withColumn("row", F.lit("clash")).withColumn("spans", F.lit(1))
    kept = decontaminate.decontaminate(wide, benchmark)
    assert kept.columns == wide.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in docs.collect() if not leak_brute(r.text, items)[1])


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x x a b c d e f y a b c d e"), (2, "b c")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, "a b c d e f g"), (8, "q")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.doc_word, r.item_word, r.n_words) for r in decontaminate.longest_matches(docs, benchmark, window=3).collect()}
    assert got == {(1, "7", 2, 0, 6), (1, "7", 9, 0, 5)}


def test_contamination_of_empty_tables(docs, leaks):
    _, benchmark = leaks
    assert decontaminate.report(empty(docs), benchmark).count() == 0
    assert decontaminate.report(docs, benchmark.limit(0)).where("contaminated").count() == 0


# 3


def shingle_set(text, words):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set()


def near_brute(rows, words, percent):
    sets = [(i, shingle_set(t, words)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicate_groups(docs, words, percent):
    want = near_brute([(r.doc_id, r.text) for r in docs.collect()], words, percent)
    got = neardup.groups(docs, words=words, percent=percent).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_with_chains_and_blocks(spark, monkeypatch):
    """Families of drifting copies: links between members that no leader joins, over many small blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 700)
    rng = random.Random(3)
    rows = []
    for f in range(4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        for k in range(30):
            rows.append((rng.randrange(10**6), " ".join(words)))
            for _ in range(rng.choice([0, 1, 1, 2])):
                words = list(words)
                words[rng.randrange(80)] = f"v{rng.randrange(10**6)}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_brute(rows, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(docs).collect()} == want


def test_deduplicate_keeps_one_of_each_group(docs):
    wide = docs.withColumn("stays", F.lit("clash"))
    want = near_brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    got = neardup.deduplicate(wide)
    assert got.columns == wide.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, r) in want.items() if i == r) and None in ids


def near_brute_rows(rows, words, percent):
    """Components where a document has several texts: it is linked through any of them."""
    sets = [(i, shingle_set(t, words)) for i, t in rows if i is not None]
    edges = {(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and b and 100 * len(a & b) >= percent * len(a | b)}
    root = {i: i for i, _ in sets}
    while True:
        new = dict(root)
        for i, j in edges:
            new[i] = new[j] = min(new[i], new[j])
        if new == root:
            return root
        root = new


@pytest.mark.parametrize("partitions", [1, 3])
def test_repeated_ids_with_unlike_texts_lose_no_link(spark, partitions):
    rng = random.Random(12)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(100))
    a, b, c = text(), text(), text()
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " less"), (4, c), (5, c + " x"), (5, b + " y"), (6, text()), (1, a), (7, None), (7, text())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    want = near_brute_rows(rows, 3, 85)
    got = neardup.groups(docs).collect()
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] for r in got)
    kept = sorted((r.doc_id, r.text or "") for r in neardup.deduplicate(docs.withColumn("told_id", F.lit(1)).withColumn("id", F.lit(2)), 3, 85).collect())
    assert kept == sorted({(i, t or "") for i, t in rows if want[i] == i})


def test_large_groups_of_copies_are_split(spark, monkeypatch):
    """One hot class of near copies: leaders and stars over the bound for one task."""
    monkeypatch.setattr(neardup, "PART", 40)
    rng = random.Random(13)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for k in range(300):
        v = list(words)
        v[rng.randrange(60)] = f"x{k}"
        rows.append((k, " ".join(v)))
    rows += [(1000 + k, " ".join(words)) for k in range(300)]
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 600 and {r.component_id for r in got} == {0}


def test_banding_for_any_threshold(spark):
    assert neardup.banding(85) == (32, 5) and neardup.banding(80) == (32, 4)
    for percent in range(10, 101):
        bands, rows = neardup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= neardup.MISSED * 1.0001 and bands * rows <= 255
    with pytest.raises(ValueError):
        neardup.banding(1)
    with pytest.raises(TypeError):
        neardup.groups(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    rng = random.Random(14)
    base = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    rows = [(k, " ".join(base[: 20 + k])) for k in range(20)]
    want = near_brute(rows, 2, 60)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), words=2, percent=60).collect()} == want


def test_near_duplicates_of_an_empty_table(docs):
    assert neardup.groups(empty(docs)).count() == 0


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(200):
        a = rng.integers(0, 2**63, 60).astype(np.uint64)
        b = np.concatenate([a[:45], rng.integers(0, 2**63, 15).astype(np.uint64)])
        s = neardup.super_minhash(np.concatenate([a, b]), np.array([0, 60, 120]), 160)
        errors.append((s[0] == s[1]).mean() - 45 / 75)
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < (0.6 * 0.4 / 160) ** 0.5  # less than with independent hashes


# 4


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_ids_are_the_library_s(vocabulary):
    import pyarrow as pa

    from lodestone.llm.tokenize import Encoder

    encode = Encoder(vocabulary)
    rng = random.Random(6)
    signs = "abcdeéÉñÑß!?'<|>. \n\t12ÀøØ÷×\x00\x1c\xa0日́ı🙂"
    samples = ["".join(rng.choice(signs) for _ in range(rng.randrange(50))) for _ in range(1500)]
    samples += ["", None, "  ", "<|endoftext|>", "don't 'LL it's", "x" * 300, "aaaa " * 20, "é", "1234567890", prose(rng, 400)]
    ids, cuts = encode(*common.text_bytes(pa.array(samples, pa.string())))
    for s, a, b in zip(samples, cuts, cuts[1:]):
        assert ids[a:b].tolist() == encode.library.encode(s or "", add_special_tokens=False).ids, s


def test_packing_round_trip(docs, vocabulary, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "PART_PIECES", 7)

    size = 256
    got = packing.pack(docs, vocabulary, size=size).collect()
    library = Tokenizer.from_file(vocabulary)
    left = [(str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids + [packing.END]) for r in docs.collect()]
    pieces = []
    for i, ids in left:
        for k, at in enumerate(range(0, len(ids), size)):
            own = ids[at : at + size]
            pieces.append((i, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted(pieces) == sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    total = sum(p[3] for p in pieces)
    assert len(places) <= -(-total // size) + 1
    assert packing.pack(empty(docs), vocabulary).count() == 0


def test_best_fit_over_counts():
    rng = random.Random(9)
    for _ in range(60):
        counts = {rng.randrange(1, 41): rng.randrange(1, 60) for _ in range(rng.randrange(1, 12))}
        plan = packing.best_fit(counts, 40)
        room = {}
        for length, slots in plan.slots.items():
            ends = [s[0] for s in slots[1:]] + [counts[length]]
            for (rank, sequence, each, offset), end in zip(slots, ends):
                for k in range(end - rank):
                    room.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
        assert sum(map(len, room.values())) == sum(counts.values()) and len(room) == plan.sequences
        for own in room.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 40
        # best-fit decreasing, one piece at a time
        free = []
        for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fits = [k for k, r in enumerate(free) if r >= length]
            k = min(fits, key=lambda k: free[k]) if fits else len(free)
            free[k : k + 1] = [(free[k] if fits else 40) - length]
        assert plan.sequences == len(free)


# 5


def pii_brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_personal_data(spark):
    rng = random.Random(5)
    signs = "ab1.2@+- ()43,5\né"
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(60)))) for i in range(600)]
    rows += [(900, None), (901, ""), (902, "mail a.b@c.example.com 10.0.0.255 256.1.1.1 4111 1111 1111 1111 +1 (555) 555-0100"), (903, "9" * 3000 + "a" * 3000 + "@")]
    rows.append(rows[3])
    by_id = dict(rows)
    for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        base = pii_brute(by_id[r.doc_id] or "")
        told = ",".join("%s:%d:%d" % b for b in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and r.spans.startswith(told)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in pii.KINDS]


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled_samples())


def added(spark, field, texts):
    """The crf spans of texts as (kind, text)."""
    rows = list(enumerate(texts))
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()}
    out = []
    for i, t in rows:
        spans = [x.split(":") for x in got[i].split(",") if x.startswith("crf_")]
        out.append([(k, t[int(s) : int(e)]) for k, s, e in spans])
    return out


def test_a_name_is_labelled_alike_however_often_it_repeats(spark, field):
    mail, name = "quvbxz.41@mail3.example.com", "quvbxz.41"
    texts = [f"the {name} of"] + [f"to {mail} in" + f" the {name} of page" * n for n in (1, 5, 15, 30, 120)] + [f"the {name} of " * 40 + mail]
    got = added(spark, field, texts)
    assert got[0] == []
    for spans, n in zip(got[1:], (1, 5, 15, 30, 120, 40)):
        assert spans == [("crf_email", name)] * n


def test_bare_names_without_digits_and_roles(spark, field):
    texts = ["to john.smith@corp.example.com and\nlater john.smith, or John.Smith.", "write to contact@corp.example.com, a contact of ours; contact us", "john.smith alone"]
    assert added(spark, field, texts) == [[("crf_email", "john.smith"), ("crf_email", "John.Smith")], [], []]


def test_long_pieces_and_texts_without_spaces(spark, field):
    phone = "212-555-0199"
    texts = [f"call {phone}" + "." * 190 + " now", '{"rows":[' + ",".join('{"id":%d,"phone":"%s"}' % (k, phone) for k in range(60)) + "]}", f"电话{phone}。" + "日本語" * 200]
    got = added(spark, field, texts)
    assert got == [[("crf_phone", phone)], [("crf_phone", phone)] * 60, [("crf_phone", phone)]]


def test_numbers_that_fail_the_check_digit_are_no_cards(spark, field):
    rng = random.Random(3)
    numbers = ["".join(rng.choice("0123456789") for _ in range(16)) for _ in range(200)]
    texts = [f"the {n} of that" for n in numbers if not pii.luhn(n)]
    assert sum(map(len, added(spark, field, texts))) <= 0.02 * len(texts)


def test_messages_settle(field):
    """A long chain of resembling tokens: one more round would move nothing."""
    graph = pii.Graph()
    graph.document([(f"ab{k:04d}.{k}@x{k}.example.com" if k % 7 == 0 else f"{k % 50}555{k:04d}", "the", k % 2 == 0, "") for k in range(3000)])
    arrays = graph.arrays()
    before = field.marginals(*arrays)
    tight = pii.SETTLED
    try:
        pii.SETTLED = tight / 1000
        assert np.abs(field.marginals(*arrays) - before).max() < 0.01
    finally:
        pii.SETTLED = tight


def test_personal_data_model_on_held_out_samples(field):
    samples = pii.labelled_samples(300, seed=99)
    graph = pii.Graph()
    nodes = [graph.document([p for p, _ in s]) for s in samples]
    got = field.marginals(*graph.arrays()).argmax(axis=1)
    hits = [got[n] == label for own, s in zip(nodes, samples) for n, (_, label) in zip(own, s)]
    assert np.mean(hits) > 0.92


# 6


def test_neighbours_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 16)
    monkeypatch.setattr(neighbours, "BLOCK_NUMBERS", 64)
    monkeypatch.setattr(neighbours, "SHARD_NUMBERS", 1500)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(500 + k, rows[5][1]) for k in range(40)] + [(600, None), (601, [0.0] * 8), (602, [1.0] * 7 + [None]), (603, [1.0] * 7 + [float("nan")]), (604, [float("inf")] * 8), (620, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    got = {}
    for r in neighbours.report(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {}
    for q, v in good:
        if q % 20 == 0:
            near = sorted((-float((v * w).sum()), i) for i, w in good if i != q)[:20]
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert {q: sorted(x) for q, x in got.items()} == want


def nearest(rows, queries, want):
    """(score, id) of each query row's nearest by brute force."""
    held = [(i, np.array(v, np.float64)) for i, v in rows]
    out = []
    for q, v in queries:
        near = sorted((-float((np.array(v, np.float64) * w).sum()), i) for i, w in held if i != q)[:want]
        out.append((q, [(k + 1, i, -s) for k, (s, i) in enumerate(near)]))
    return sorted(out)


def test_neighbours_with_more_ties_than_any_list_holds(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_NUMBERS", 2500)
    rng = np.random.default_rng(5)
    # distinct vectors with one product for every query, and whole numbers with few products
    flat = [(i, [1.0, float(i % 1000), float(i // 1000)]) for i in range(3000, 0, -1)]
    df = spark.createDataFrame(flat, "vec_id long, embedding array<double>").repartition(2)
    asked = spark.createDataFrame([(q, [2.0, 0.0, 0.0]) for q in (0, 7, 2999)] + [(7, [0.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, asked).collect():
        got.setdefault((r.query_id, r.score > 2), []).append((r["rank"], r.vec_id, r.score))
    want = nearest(flat, [(0, [2.0, 0, 0]), (7, [2.0, 0, 0]), (2999, [2.0, 0, 0])], 20)
    assert [(q, sorted(got[q, False])) for q, _ in want] == want
    assert sorted(got[7, True]) == nearest(flat, [(7, [0.0, 1, 0])], 20)[0][1]
    whole = [(i, rng.integers(-1, 2, 6).astype(float).tolist()) for i in range(1500)]
    whole = [(i, v) for i, v in whole if any(v)]
    df = spark.createDataFrame(whole, "vec_id long, embedding array<double>").repartition(2)
    got = {}
    for r in neighbours.report(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted((q, sorted(x)) for q, x in got.items()) == nearest(whole, [x for x in whole if x[0] % 20 == 0], 20)


def test_neighbours_beside_rows_of_extreme_length(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(400)] + [(1000, [1e9, 0.0, 0.0, 0.0, 1.0]), (1001, [1e200, 1e200, 0.0, 0.0, 0.0]), (1002, [1e-200] * 5), (1003, [-1e9, 3.0, 0.0, 0.0, 0.0])]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (1020, rows[9][1]), (1020, rows[8][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, df.where("vec_id < 60 and vec_id <> 3")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted((q, sorted(x)) for q, x in got.items()) == nearest(rows, [x for x in rows if x[0] < 60 and x[0] != 3], 20)


def test_relaxed_pruning_keeps_most(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 3
    rows = [(i, (centres[i % 20] + rng.normal(size=16)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 100 = 0")
    exact, relaxed = ({(r.query_id, r.vec_id) for r in neighbours.search(df, asked, factor=f).collect()} for f in (1.0, 0.8))
    assert len(exact & relaxed) >= 0.9 * len(exact)


def test_relaxed_pruning_looks_at_less():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 3
    rows = np.concatenate([centres + rng.normal(size=(40, 16)) * 0.5 for _ in range(200)])
    index = neighbours.Index.unpack(neighbours.Index(np.arange(len(rows)), rows).pack())
    searches = [neighbours.Search(index, np.arange(80), rows[:80], 20, f) for f in (1.0, 0.7)]
    assert searches[1].looked < searches[0].looked < 0.8 * 80 * len(rows)
    exact, relaxed = ({(q, v) for q, line in enumerate(s.found.tolist()) for v in line} for s in searches)
    assert len(exact & relaxed) >= 0.9 * len(exact)


def test_neighbours_of_an_empty_table(spark):
    assert neighbours.report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 7

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy, buy, buy.</div><div id="cookie-notice">We use cookies, ok?</div>
<%s><h1>Head &amp; tail</h1><p><b>First   paragraph, of some length,<br>with a break.<p>Second&nbsp;one &#233;t&eacute;, also long enough to be told apart.</p><ul><li>point one</li><li>point two</li></ul>
<form><p>Sign up, now, please</p></form></%s><div class="comments"><p>nice, very, nice, comment, of, a, reader</p></div><aside>Side, bar</aside><footer>&copy; foot</footer>"""


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text(tag):
    assert extract.extract(PAGE % (tag, tag)) == "Head & tail\n\nFirst paragraph, of some length, with a break.\n\nSecond one été, also long enough to be told apart.\n\npoint one\n\npoint two"


def test_main_text_keeps_short_parts_and_checks_class_words():
    long, short = "Words of a long story, told at length. " * 8, "A short part of the story, which is still a part of it. " * 3
    clean = lambda *parts: "\n\n".join(" ".join(x.split()) for x in parts)
    first = "".join(f"<p>{long}</p>" for _ in range(5))
    links = "<ul><li><a href=/a>Another page of the site</a></li><li><a href=/b>And one more page</a></li></ul>"
    got = extract.extract(f"<body><div id=story><div class=part>{first}</div><h2>Next</h2><div class=part><p>{short}</p></div><p>End.</p>{links}</div></body>")
    assert got == clean(*[long] * 5, "Next", short, "End.")
    # a class word cuts lists of links and scraps, not paragraphs, words of a sentence or the article's own header
    got = extract.extract(
        f"<article><div class=post-header><h1>Title</h1></div><p>A <span class=notice>public</span> thing.</p><div class=share><p>{long}</p></div><div class=related>{links}</div><div class=share>Tweet</div>{first}</article>"
    )
    assert got == clean("Title", "A public thing.", long, *[long] * 5)
    # containers apart are held by what is around both
    got = extract.extract(f"<body><div>{links}</div><div><div><div>{first}</div></div><div><div>{first}</div></div></div></body>")
    assert got == clean(*[long] * 10)


@pytest.mark.parametrize("name", ["has-sidebar", "layout no-sidebar", "content share-enabled", "page header-fixed", "wrap"])
def test_class_words_around_the_article_cut_nothing(name):
    text = "A sentence of the story, told at some length, with commas. " * 4
    page = "<body><nav><a href=/>Home</a></nav><div class='%s'><h1>Head</h1>" % name + "".join(f"<p>{text}</p>" for _ in range(5)) + "</div><div class=sidebar><a href=/x>More</a></div></body>"
    assert extract.extract(page) == "\n\n".join(["Head"] + [text.strip()] * 5)


def test_slashes_before_the_end_of_a_tag_mean_nothing():
    assert extract.extract('<p>one<script src="a.js"/>var x=1;</script> two') == "one two"
    assert extract.extract("<div><p>Words of a <a href=/x/>link</a> and more.</p><br/><p>End</div>") == "Words of a link and more.\n\nEnd"


@pytest.mark.parametrize(
    "page",
    ["<?" * 500_000, "<div>" * 60_000 + "</zz>" * 60_000, "<b>" * 60_000 + "<p>x" * 60_000, "<![CDATA[>" * 100_000, "<div class=ad>" * 40_000 + "x" * 100, "<header>" * 60_000 + "x", "<b><table>" + "<div>" * 60_000 + "</b>" * 60_000]
    + ["<div class=ad><p>" + "long text, " * 9 + "</p>" + "<div class=ad>" * 30_000 + "<p>" + "long text, " * 9, "".join("<div><p>" + "words, of text, " * 8 for _ in range(8000)), "<a \"" * 200_000, "<p a='" * 100_000],
)
def test_time_follows_the_length_of_a_page(page):
    import time

    started = time.perf_counter()
    extract.extract(page)
    assert time.perf_counter() - started < 4


def test_main_text_of_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>x"), (4, "u", "plain &lt;b&gt; text"), (5, "u", "<html><body></body>"), (6, "u", "<div>" * 3000 + "deep"), (7, "u", "<<<p >a<b"), (7, "u", "<<<p >a<b")]
    got = extract.report(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = {r.page_id: r for r in got.collect()}
    assert [out[k].text for k in (1, 2, 3, 4, 5, 6)] == ["", "", "x", "plain <b> text", "", "deep"]
    assert all(r.n_chars == len(r.text) for r in out.values()) and got.count() == 8


# 8


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    n = 20_000
    clean = rng.random(n) < 0.8
    kind = rng.integers(0, len(quality.HEURISTICS), n)
    votes = np.full((n, len(quality.HEURISTICS)), quality.CLEAN)
    for h in range(len(quality.HEURISTICS)):
        votes[~clean & (kind == h) & (rng.random(n) < 0.9), h] = quality.JUNK
        votes[clean & (rng.random(n) < 0.01), h] = quality.JUNK
        votes[rng.random(n) < 0.2, h] = quality.NONE
    codes, counts = np.unique(quality.pattern(votes), return_counts=True)
    labeller = quality.Labeller(dict(zip(codes.tolist(), counts.tolist())))
    seen = ((votes == quality.JUNK).sum(axis=1) > 0) | clean
    assert ((labeller(votes) >= 0.5) == clean)[seen].mean() > 0.9
    assert all(a > 0.97 for a, _ in labeller.accuracy.values())


def test_quality_parts_junk_from_prose(spark):
    rng = random.Random(2)
    clean = [". ".join(re.sub("[.,\n]", "", prose(rng, 12)).capitalize() for _ in range(6)) + "." for _ in range(150)]
    junk = [t.upper().replace(" ", "!! ") for t in clean[:12]] + [t.replace(" ", " | ") for t in clean[12:24]] + [t.replace(" ", "*** ") for t in clean[24:36]]
    rows = [(i, t) for i, t in enumerate(clean + junk)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.report(docs).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[i].kept for i in range(150)]) > 0.97
    assert np.mean([not got[i].kept for i in range(150, 186)]) > 0.9
    assert quality.report(docs.limit(0)).count() == 0


def test_votes_that_no_training_document_showed(spark):
    seen = np.full((5, len(quality.HEURISTICS)), quality.CLEAN)
    labeller = quality.Labeller({int(quality.pattern(seen)[0]): 5})
    fresh = np.array([[quality.JUNK] * len(quality.HEURISTICS), [quality.NONE] * len(quality.HEURISTICS)])
    told = labeller(np.concatenate([fresh, seen]))
    assert told[0] < 0.05 and told[2] > 0.9 and np.isfinite(told).all()
    assert np.isfinite(quality.Labeller({})(fresh)).all()
    model = quality.train(spark.createDataFrame([(1, "A plain text, of some words that say little.")], "doc_id long, text string"))
    got = quality.score(spark.createDataFrame([("a", "||| ### !!!"), (None, None)], "`source-url` string, text string"), model, "source-url").collect()
    assert len(got) == 2 and all(0 <= r.score <= 1 for r in got)


# 9


def lm_brute(texts, target):
    """The models by dictionaries of words; texts by row, and which rows are of the target. Each row is scored without its own counts."""
    from collections import Counter

    rows = [leak_words(t) for t in texts]
    uni = [Counter(w for k, r in enumerate(rows) if k in side for w in r) for side in (target, range(len(rows)))]
    bi = [Counter(p for k, r in enumerate(rows) if k in side for p in zip(r, r[1:])) for side in (target, range(len(rows)))]
    size = len(uni[1])

    def loss(side, k):
        s, own = rows[k], side == 1 or k in target
        words, pairs = uni[side] - Counter(s) if own else uni[side], bi[side] - Counter(zip(s, s[1:])) if own else bi[side]
        total = sum(words.values())
        out = []
        for j, w in enumerate(s):
            base = (words[w] + 1) / (total + size + 1)
            if j:
                base = (pairs[s[j - 1], w] + lm_score.PRIOR * base) / (words[s[j - 1]] + lm_score.PRIOR)
            out.append(-np.log2(base))
        return float(np.mean(out)) if out else None

    return loss


def test_language_model_scores(spark, docs, monkeypatch):
    monkeypatch.setattr(lm_score, "HELD", 100)
    monkeypatch.setattr(lm_score, "PART_BYTES", 20_000)
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 10_000)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 80)] + [(6, 1), (None, 1)], "doc_id long, quality int")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    loss = lm_brute([t for _, t in rows], {k for k, (i, _) in enumerate(rows) if i is not None and i < 80 and i % 3 == 0})
    got = lm_score.report(docs, labels).collect()
    assert len(got) == len(rows)
    place = {i: k for k, (i, _) in enumerate(rows)}
    for r in got:
        k = place[r.doc_id]
        one, two = loss(0, k), loss(1, k)
        assert r.target_loss == (one and pytest.approx(one, rel=1e-9)) and r.background_loss == (two and pytest.approx(two, rel=1e-9))
        assert r.score == pytest.approx(two - one if one else 0, abs=1e-9) and r.n_words == len(leak_words(rows[k][1]))


def test_language_model_keeps_rare_words_of_either_side(spark, monkeypatch):
    # "rare words" is two in more than 2^20 bigrams of the background, and "only here" is in the target alone
    monkeypatch.setattr(lm_score, "PART_BYTES", 1_000_000)
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 500_000)
    background = [(i, "the common text " * 10_000) for i in range(40)] + [(40, "rare words"), (41, "rare words")]
    target = [(50, "only here"), (51, "the rare words")]
    one, two = (spark.createDataFrame(rows, "doc_id long, text string") for rows in (target, background))
    both = one.withColumn("one", F.lit(True)).withColumn("two", F.lit(False)).union(two.withColumn("one", F.lit(False)).withColumn("two", F.lit(True)))
    got = {r.doc_id: r for r in lm_score.score(both, lm_score.text_size(both)).collect()}

    def loss(first, second, pair, total):
        a, b = ((n + 1) / (total + 8) for n in (first, second))
        return -(np.log2(a) + np.log2((pair + lm_score.PRIOR * b) / (first + lm_score.PRIOR))) / 2

    # each without its own counts: two words of its side less
    assert len(got) == 44
    assert got[40].background_loss == pytest.approx(loss(1, 1, 1, 1_200_002))
    assert got[50].target_loss == pytest.approx(loss(0, 0, 0, 3)) and got[50].background_loss == pytest.approx(loss(0, 0, 0, 1_200_004))
    # as in the other target text, where it is not left out
    assert got[40].target_loss == pytest.approx(loss(1, 1, 1, 5))


def test_language_model_without_target(docs, spark):
    assert lm_score.report(docs, spark.createDataFrame([], "doc_id long, quality int")).where("score is null").count() == 0
    assert lm_score.report(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


# 10


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        parts = [prose(rng, rng.randrange(4, 12)).replace(".", "").replace("\n", " ") for _ in range(rng.randrange(1, 12))]
        bad = rng.random() < 0.2
        if bad:
            parts[rng.randrange(len(parts))] += " you " + rng.choice(["villain", "rotter" + str(rng.randrange(1000)), "cad"]) + " there"
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, 1, int(bad)))
    rows += [(1001, None), (1002, ""), (None, "a cad")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(toxic_docs):
    docs, labels = toxic_docs
    got = {r.doc_id: r for r in toxicity.report(docs, labels).collect()}
    told = {r.doc_id: r.toxic for r in labels.where("toxic is not null and doc_id is not null").collect()}
    held = [i for i in told if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in told)
    assert np.mean([got[i].predicted == told[i] for i in held]) > 0.97
    assert got[1001].score == got[1002].score == 0 and all(0 <= r.score <= 1 for r in got.values())


def test_offending_sentences_are_found(toxic_docs):
    docs, labels = toxic_docs
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = toxicity.offending(docs, model).collect()
    assert found and all(re.search("villain|rotter|cad", texts[r.doc_id][r.start : r.end]) and "." not in texts[r.doc_id][r.start : r.end] for r in found)


def test_toxicity_without_labels(toxic_docs, spark):
    docs, labels = toxic_docs
    assert toxicity.report(docs, labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.report(docs.limit(0), labels).count() == 0
    wide = docs.withColumn("score", F.lit(7)).withColumn("row", F.lit("x")).withColumn("source-url", F.lit("u"))
    kept = toxicity.reject(wide, toxicity.train(docs, labels))
    assert kept.columns == wide.columns and 600 < kept.count() < 800


def test_release_hands_freed_memory_back(spark):
    """Blocks too small for mappings of their own, with some kept among them, stay with the process until it is told to give them up."""
    jvm = spark.sparkContext._jvm
    pids = {"python": os.getpid(), "jvm": jvm.java.lang.ProcessHandle.current().pid()}

    def resident():
        return {k: int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{p}/status").read_text())[1]) // 1024 for k, p in pids.items()}

    blocks = [bytearray(100_000) for _ in range(1500)]
    kept, buffers = blocks[::40], jvm.java.util.ArrayDeque()
    del blocks
    for k in range(1500):
        buffer = jvm.java.nio.ByteBuffer.allocateDirect(100_000)
        (buffers.add if k % 40 else kept.append)(buffer)
    buffers.clear()
    del buffer
    for _ in range(2):  # the JVM frees the buffers after it has found them unused
        jvm.System.gc()
        time.sleep(1)
    before = resident()
    common.release(spark)
    after = resident()
    assert all(before[k] - after[k] > 70 for k in pids), (before, after)
