import hashlib
import math
import re
from array import array
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from quaverlake.llm.shared import cut, table

from .test_minhash import brute
from .test_pfair import edf


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    columns = docs.columns
    good = cut(P.quality(spark, docs, d))
    assert good.columns == columns
    ids = {r.doc_id for r in good.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, d, "labels").collect()}
    assert sum(labels[i] == 1 for i in labels if i not in ids) <= 0.02 * len(labels)
    assert sum(labels[i] == 0 for i in labels if i in ids) <= 0.02 * len(labels) and len(ids) < docs.count()

    one = cut(P.near_dedup(spark, good, d))
    kept = {i for i, _, _, k in brute([(r.doc_id, r.text) for r in good.collect()]) if k}
    assert {r.doc_id for r in one.collect()} == kept and one.columns == columns and one.count() == len(kept) < len(ids)

    safe = cut(P.private(spark, one, d))
    assert safe.columns == columns and {r.doc_id for r in safe.collect()} == kept
    assert all(r.n_chars == len(r.text) for r in safe.collect())
    before = {x for r in one.collect() for x in re.findall(r"\S+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}", r.text)}
    assert before and not [x for x in before for r in safe.collect() if x in r.text]

    mixed = cut(P.mix(spark, safe, d))
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, safe.collect()))

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    out = P.tokens(spark, mixed, d).collect()
    assert len(out) == len(texts)
    for r in out:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == array("I", want).tobytes() and r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest()


def test_run_and_empty(spark, tmp_path):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, "/root/testdata/sf0.001", "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_null_ids_stay(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in P.near_dedup(spark, docs, "").collect()) == ["1", "2", "None"]
    assert P.mix(spark, docs, "").count() == 4 and P.private(spark, docs, "").count() == 4


def mixture(rows):
    """The ids of (doc_id, source) in the order of the EDF schedule, from the definition."""
    by = defaultdict(list)
    for i, source in rows:
        by["n" if source is None else "s" + source].append(i)
    names, period = sorted(by), max(1000, 4 * len(by))
    weight = {n: math.sqrt(len(by[n])) for n in names}
    exact = {n: weight[n] / sum(weight.values()) * (period - len(names)) for n in names}
    quota = {n: math.floor(exact[n]) + 1 for n in names}
    for n in sorted(names, key=lambda n: (math.floor(exact[n]) - exact[n], n))[: period - sum(quota.values())]:
        quota[n] += 1
    line = edf([quota[n] for n in names], period)
    left = {n: sorted(by[n], key=lambda i: hashlib.md5(f"mix-1|{i}".encode()).hexdigest()) for n in names}
    out, t = [], 0
    while len(out) < len(rows):
        n = names[line[t % period]]
        out += left[n][:32]
        left[n] = left[n][32:]
        t += 1
    return out


def test_order_of_the_mixture_reaches_the_last_stage(spark, tmp_path):
    # Most rows are of one source, which alone would come first in the files.
    docs = spark.createDataFrame([(i, f"word {i}", "en", "hot" if i < 1500 else "ab"[i % 2] if i % 7 else None, 6) for i in range(2000)], "doc_id long, text string, lang string, source string, n_chars long")
    want = mixture([(r.doc_id, r.source) for r in docs.collect()])
    for n in (1, 5):
        P.tokens(spark, cut(P.mix(spark, docs, "")).repartition(n, "doc_id"), "").write.parquet(f"{tmp_path}/{n}")
        out = spark.read.parquet(f"{tmp_path}/{n}").collect()
        assert [r.doc_id for r in sorted(out, key=lambda r: (r.slot, r.place))] == want


def test_order_of_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001").where("doc_id is not null").collect()
    assert len({(r.slot, r.place) for r in out}) == len(out) > 0
    assert [r.doc_id for r in sorted(out, key=lambda r: (r.slot, r.place))] == mixture([(r.doc_id, r.source) for r in out])
