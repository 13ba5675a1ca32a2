"""The stages one after another on a small corpus, each against brute force over its own input."""

import random
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lodestone.llm import common, secrets  # noqa: E402
from tests.llm.test_operators import WORDS, leak_brute, near_brute, prose, secret_brute  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(500):
        text = " ".join(prose(rng, 20) for _ in range(rng.randrange(1, 5)))
        bad = i % 7 == 0
        rows.append((i, text + " you utter villain there" * bad, "en", "src0", len(text)))
        labels.append((i, 1, int(bad)))
    items = [(k, prose(rng, 30)) for k in range(6)]
    for k in range(40):
        i = 1000 + k
        text = rows[k + 1][1] if k % 3 == 0 else rows[k + 50][1] + " " + items[k % 6][1] if k % 3 == 1 else prose(rng, 30) + " password=hunter2hunter2 end"
        rows.append((i, text, "en", "src0", len(text)))
    rows += [(2000, None, None, None, None), (2001, "", "en", "src1", 0), rows[4]]
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), items


def test_stages(spark, folder):
    where, items = folder
    docs = common.table(spark, where, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = common.settle(stage(spark, docs, where), name)
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["toxicity"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {r.doc_id for r in before if "villain" in (r.text or "")}
    before, after = seen["near_duplicates"]
    want = near_brute([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, root) in want.items() if i == root)
    before, after = seen["decontamination"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not leak_brute(r.text, items)[1])
    before, after = seen["secrets"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    texts = {r.doc_id: r.text for r in after}
    assert not any(secret_brute(t or "") for t in texts.values()) and any("[SECRET]" in (t or "") for t in texts.values())
    assert all(texts[r.doc_id] == r.text for r in before if not secret_brute(r.text or ""))
    before, after = seen["packing"]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    want = []
    for r in before:
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(want) == sorted((r.doc_id, r.length, r.ids_crc32) for r in after)
    assert sorted((r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, where).collect()) == sorted((i, c) for i, _, c in want)
    assert WORDS and secrets.KINDS
