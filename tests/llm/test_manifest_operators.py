"""Merkle manifest, best-fit packing and source divergence against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import divergence, merkle, packing, queries
from tracewright.llm.common import cut

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each node the siblings before and after it, level by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, q in enumerate(at):
            b = q - q % 3
            proofs[i].append(("".join(nodes[b:q]), "".join(nodes[q + 1 : b + 3])))
            at[i] = q // 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], proofs


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    of = lambda *fields: sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        cut = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        groups[source].append((i is not None, i or 0, of(i, source, lang, n, text), of(i, source, lang, n, cut), i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s])]) for s in order}
    root, tops = plain_tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (_, _, leaf, now, i), own in zip(sorted(groups[s]), trees[s][1], strict=True):
            for before, after in own + top:
                now = sha(before + now + after)
            out.append((str(i), leaf, trees[s][0], root, sha("".join(b + a for b, a in own + top)), now, now == root))
    return sorted(out)


def manifest_rows(spark, rows):
    got = merkle.audit(merkle.manifest(spark.createDataFrame(rows, DOCS))).collect()
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_over_blocks_of_any_size(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    r = random.Random(levels)
    sources = ["a", "b", "", None, "é", "z", "\U0001f600", "one"]
    rows = [(i, r.choice(["x\ny", "", None, "ä\n\n中", "plain"]), r.choice(["en", None]), r.choice(sources[:2] * 6 + sources[2:7]), r.choice([None, i])) for i in range(170)]
    rows += [(900, "lone\n", "en", "one", 5), (None, "a\nb", "en", "a", 1), (None, None, None, None, None)]
    rows += [(7, "same\n", "en", "b", 1)] * 30  # one row again and again, and one doc_id with several texts
    rows += [(7, f"t{k}", "en", "b", 1) for k in range(9)]
    assert manifest_rows(spark, rows) == plain_manifest(rows)


def test_manifest_of_one_source_one_row_and_none(spark):
    for rows in ([(1, "a", "en", "s", 1)], [(i, "a", "en", None, 1) for i in range(4)], []):
        assert manifest_rows(spark, rows) == (plain_manifest(rows) if rows else [])
    extra = spark.createDataFrame([(1, "a", "en", "s", 1, "g", 2, 3)], DOCS + ", g string, n long, pos long")
    assert merkle.manifest(extra).count() == 1


def test_a_changed_row_fails_and_the_rest_stands(spark):
    rows = [(i, f"text {i}\n", "en", f"s{i % 3}", i) for i in range(40)]
    got = merkle.audit(merkle.manifest(spark.createDataFrame(rows, DOCS)))
    assert {r.doc_id: r.verified for r in got.collect()} == {i: zlib.crc32(str(i).encode()) % 2 == 1 for i in range(40)}


TEXTS = [
    "", None, " ", "a", " a", "a ", "a  b", "a   b", "two\n\nlines", "x \n y", "\n x", "tab\there", "nbsp  x  y", "déjà vu 中文 \u0001 \x1c z \x1c", "it's we'll I'D", "<|endoftext|> a<|endoftext|>b",
    "Number 1234 and 5,678.90!", "trailing\n", "wórd é", "\U0001f600 smile", "mixed   wide", "a \x85b",
]


def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_are_those_of_the_library(spark):
    r = random.Random(3)
    more = ["".join(r.choice(["a", "B", " ", " ", "\n", "'s", "7", ".", " ", "\t", "ß", "word"]) for _ in range(r.randint(0, 40))) for _ in range(400)]
    c, t = packing.coder(open(public_tokenizers.path("byte_bpe_50k.json")).read()), library()
    long = ["ab" * 200_000, " " * 300_000 + "x", "\n \t" * 100_000, "word " * 100_000]
    for x in TEXTS + more + long:
        assert np.frombuffer(c.encode(x or ""), "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids
    assert c.fast
    other = packing.coder(open(public_tokenizers.path("word_bpe_49k.json")).read())
    assert not other.fast and len(other.encode("Some Words")) == 8


def test_pieces_and_sequences(spark):
    t = library()
    data = list(enumerate(TEXTS)) + [(100, "long text " * 3000), (101, "w " * 2047), (102, "w" + " w" * 2046), (None, "no id"), (3, "a"), (3, "a")]
    docs = spark.createDataFrame([(i, x, 5) for i, x in data], "doc_id long, text string, uid long")
    parts = cut(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces")
    rows = packing.placed(parts).collect()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in data}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in rows:
        by_doc[x.doc_id].append(x)
        by_sequence[x.sequence_id].append(x)
        assert np.frombuffer(x.ids, "<u4").tolist() == ids[x.doc_id][x.start : x.start + x.length]
    copies = Counter(i for i, _ in data)
    for i, some in by_doc.items():
        n = -(-len(ids[i]) // 2048)
        assert sorted(x.piece for x in some) == sorted([*range(n)] * copies[i])
        assert all(x.length == (2048 if x.piece else len(ids[i]) - 2048 * (n - 1)) for x in some)
    for some in by_sequence.values():
        at = 0
        for x in sorted(some, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 2048
    total = sum(x.length for x in rows)
    assert len(by_sequence) <= -(-total // 2048) + 1
    whole = packing.sequences(packing.placed(parts)).collect()
    assert sum(x.length for x in whole) == total and all(4 * x.length == len(x.ids) for x in whole)


def test_best_fit_takes_the_least_room_that_suffices():
    where, left = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert where.tolist() == [0, 1, 0, 1, 1] and left.tolist() == [0, 0]
    r = np.random.default_rng(1)
    sizes = r.integers(1, 2049, 3000)
    where, left = packing.best_fit(sizes, 2048)
    assert (np.bincount(where, sizes) == 2048 - left).all() and (left >= 0).all()
    open_bins: list[int] = []
    for size in sorted(sizes.tolist(), reverse=True):  # the same by looking at every bin
        fits = [k for k, room in enumerate(open_bins) if room >= size]
        k = min(fits, key=lambda k: open_bins[k]) if fits else len(open_bins)
        if not fits:
            open_bins.append(2048)
        open_bins[k] -= size
    assert sorted(open_bins) == sorted(left.tolist())


@pytest.mark.parametrize("sizes", ["any", "large", "small", "equal"])
def test_packing_in_rounds(spark, sizes):
    r = random.Random(5)
    draw = {"any": lambda: r.randint(1, 100), "large": lambda: r.choice([55, 60, 70, 30]), "small": lambda: r.randint(1, 9), "equal": lambda: 34}[sizes]
    data = [(i, draw()) for i in range(6000)]
    got = packing.pack(spark.createDataFrame(data, "uid long, length long"), 100, items=600, fan=4, nearly=1).collect()
    length = dict(data)
    assert sorted(x.uid for x in got) == sorted(length)
    bins = defaultdict(list)
    for x in got:
        bins[x.sequence_id].append((x.offset, length[x.uid]))
    for some in bins.values():
        some.sort()
        assert [o for o, _ in some] == [sum(n for _, n in some[:k]) for k in range(len(some))] and sum(n for _, n in some) <= 100
    best = len(set(packing.best_fit(np.array([n for _, n in data]), 100)[0]))  # all at once
    assert best <= len(bins) <= best * 1.02 + 1


def test_packing_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.placed(cut(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces")).count() == 0


def plain_divergence(rows: list[tuple], least: int = 10, top: int = 10) -> list[tuple]:
    """rows: (lang, source, text)."""
    groups, docs, per = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups[lang, source].update(words)
        docs[lang].update(set(words))
        per[lang].add(source)
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in per.items():
        kept = {t for t, n in docs[lang].items() if n >= least}
        v = len(kept)

        def shares(count, kept=kept, v=v):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * v) for t in kept}

        own = {s: shares(groups[lang, s]) for s in sources}
        q = shares(sum((groups[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(own[s][t], q[t]), t) for t in kept if groups[lang, s][t] and own[s][t] > q[t]]
            for part, some, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                some.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(some[:most])]
    return sorted(out)


def audited(spark, rows, least=10):
    docs = spark.createDataFrame([(1, *x) for x in rows], "doc_id long, lang string, source string, text string").repartition(3)
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in divergence.audit(docs, least).collect())


@pytest.mark.parametrize(("held", "batch"), [(1 << 20, 10000), (8, 3)])
def test_divergence_is_that_of_the_dense_table(spark, monkeypatch, held, batch):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "EMIT", held // 2)
    r = random.Random(held)
    terms = ["the", "THE", "Of", "Été", "été", "naïve", "zz", "中文", "x y", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [(r.choice(["en", "fr", None]), r.choice(["a", "a", "a", "b", "c", "é", None]), " 1_,\t".join(r.choice(terms) for _ in range(r.randint(0, 30)))) for _ in range(160)]
    rows += [("en", "empty", ""), ("en", "none", None), ("de", "few", "alone words"), ("de", "other", "alone"), ("xx", "lone", "w " * 30)] + [("en", "a", "the copy")] * 20
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert audited(spark, rows) == plain_divergence(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_divergence_of_little(spark):
    assert audited(spark, []) == []
    rows = [("en", "a", "b c"), ("en", "b", "c")]
    assert audited(spark, rows) == plain_divergence(rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert audited(spark, rows, least=1) == plain_divergence(rows, least=1)


def test_separators_are_found_in_slices():
    texts = pa.array(["skip", "A-b", None, "ÄB9c", ""])
    assert divergence._spaced(texts[1:]).to_pylist() == ["a b", "", "Äb c", ""]
    assert divergence._spaced(pa.array([], pa.string())).to_pylist() == []


def test_queries_have_the_asked_columns(spark, sf):
    kinds = {
        "op11_merkle_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
        "op12_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
        "op13_source_divergence": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    }
    for name, kind in kinds.items():
        out = queries.QUERIES[name](spark, sf)
        assert dict(out.dtypes) == kind and out.select(F.count("*")).first()[0] > 0
