import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from tracewright.llm import queries, toxicity


def test_pipeline_matches_the_stages_in_plain_python(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    kept = sorted((r.doc_id, r.text) for r in toxicity.classify(docs, labels).where("toxicity < 0.5").collect())
    texts = brute.cut_runs(kept)
    classes = brute.jaccard_classes(list(texts.items()))
    left = [(i, t) for i, t in texts.items() if classes[i][1] == i]
    bad = {x[0] for x in brute.contained(left, items)}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, x in left:
        if i not in bad:
            ids = t.encode(x or "", add_special_tokens=False).ids
            want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and bad and len(left) < len(texts) < docs.count()


def test_stages_return_documents_and_take_odd_rows(spark, sf):
    odd = spark.createDataFrame([(None, "a", "en", "s", 1, 1), (1, None, None, None, None, 2), (2, "", "en", "s", 0, 3), (2, "", "en", "s", 0, 3)], "doc_id long, text string, lang string, source string, n_chars long, toxicity int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        if name != "bpe encoding":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        assert out.count() == (3 if name == "n-gram jaccard join" else 4)
        assert stage(spark, odd.limit(0), sf).count() == 0


def test_every_operator_is_registered():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] and set(queries.ORACLE_SQL) <= set(names)
