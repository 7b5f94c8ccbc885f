import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tracewright.llm import bpe, decontam, grammar, jaccard, lines, toxicity
from tracewright.llm.common import components, cut

DOC = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(40)]


def near_texts(seed: int) -> list[tuple]:
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) for _ in range(n)) for n in (1, 2, 4, 5, 6, 8, 9, 12, 14, 20, 60, 61, 120, 200)]
    out = []
    for b in base:
        for _ in range(4):
            w = b.split()
            for _ in range(r.randint(0, 2)):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randint(0, 1)] = [r.choice(WORDS)] * r.randint(0, 1)
            out.append(" ".join(w))
    # hot passage in otherwise different texts, exact copies, and odd ones
    hot = " ".join(WORDS[:30])
    out += [" ".join(r.choice(WORDS) + str(r.random()) for _ in range(60)) + " " + hot for _ in range(8)]
    out += [base[-1]] * 6 + [base[2].upper()] * 2 + ["", " \n\t", None, "x " * 3000]
    return list(enumerate(out))


def rows(spark, data, schema=DOC):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_classes_match_brute_force(spark, seed):
    docs = near_texts(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(rows(spark, docs)).collect()}
    assert got == brute.jaccard_classes(docs)


def test_jaccard_of_texts_that_share_a_frame(spark):
    r = random.Random(9)
    frame = [f"f{i}" for i in range(100)]
    docs = []
    for i in range(60):  # a frame, and words of its own at its end: some groups link, others don't
        docs.append((i, " ".join(frame[: r.choice((80, 90, 100))] + [f"own{i}x{k}" for k in range(r.choice((0, 3, 6, 9, 12, 16, 25)))])))
    docs += [(100 + i, " ".join(f"w{k}" for k in range(18) if k != i)) for i in range(18)]
    want = brute.jaccard_classes(docs)
    for sieve in (True, False):
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.classes(rows(spark, docs), sieve).collect()} == want
    assert 3 < len({c for _, c in want.values()}) < len(docs)


def test_the_light_boundary_is_that_of_least_cost():
    assert jaccard.light_size([]) == 0 and jaccard.light_size([(20, 5, 10)]) == 0
    sizes = [(5, 1000, 10**6), (12, 1000, 10**8), (30, 10, 1000)]
    cost = lambda x: sum(n * jaccard.enumerated(s, x) if s <= x else read for s, n, read in sizes)
    assert jaccard.light_size(sizes) == min(range(30), key=cost) >= 12


def test_light_sets_link_by_equal_subsets_of_the_needed_size():
    for a in range(1, 13):
        for b in range(a, 13):
            need = jaccard.needed(a, b)
            assert 100 * need >= 80 * (a + b - need) and 100 * (need - 1) < 80 * (a + b - need + 1)
            x, y = list(range(a)), list(range(a - need, a - need + b))  # they share `need`
            if 100 * a >= 80 * b and need <= a:
                assert set(jaccard.subset_keys(a, x, 12)) & set(jaccard.subset_keys(b, y, 12))


def test_jaccard_edge_rows(spark):
    data = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "other words"), (2, None), (3, ""), (4, None)]
    df = rows(spark, data).withColumn("component_id", F.lit("clash"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 1, None), (2, 0, 2), (3, 0, 3), (4, 0, 4)], key=str)
    assert jaccard.classes(rows(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    edges = rows(spark, [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 7)], "u long, v long")
    got = {r.node: r.component for r in components(edges, "u", "v").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def line_docs() -> list[tuple]:
    r = random.Random(3)
    line = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(9)) for _ in range(n))
    long, short = [line(60) for _ in range(3)], [line(12) for _ in range(6)]
    block = "\n".join(short)
    return [
        (0, f"{line(5)}\n{long[0]}\n{line(7)}"), (1, f"{long[0]}\n{line(30)}"), (2, f"x\n{block}\n\nz"), (3, f"a\nb\n{block}\nend"), (4, f"{short[0]}\n{line(9)}\n{short[0]}"),
        (5, f"{long[1]}\n{long[1].upper()}\nq"), (6, long[0]), (7, ""), (8, f"{line(55)}\n" * 3), (9, "\n".join(short[:2])), (10, f"{long[2]}\n \n{long[0]}"), (11, f"pre\n{long[2]}\n\n{long[0]}\npost"),
    ]


def test_line_dedup_matches_brute_force(spark):
    docs = line_docs()
    got = {r.doc_id: r.text for r in lines.dedup_lines(rows(spark, docs)).collect()}
    assert got == brute.cut_runs(docs) == all_runs_cut(docs, 50)
    assert got[6] == "" and "end" in got[3] and got[4] == docs[4][1] and got[9] == docs[9][1]


def all_runs_cut(docs: list[tuple], n: int) -> dict:
    """The texts without any run of lines of n words or more that equals an earlier one: every diagonal of every two texts."""
    split = {i: [(k, x.lower(), len(x.split())) for k, x in enumerate(t.split("\n")) if x.split()] for i, t in docs}
    gone = {i: set() for i in split}
    for b, later in split.items():
        for a in (a for a in split if a <= b):
            for diag in range(1 if a == b else 1 - len(split[a]), len(later)):
                run = []
                for p in range(max(0, diag), min(len(later), len(split[a]) + diag) + 1):
                    if p < min(len(later), len(split[a]) + diag) and later[p][1] == split[a][p - diag][1]:
                        run.append(later[p])
                        continue
                    if sum(w for _, _, w in run) >= n:
                        gone[b] |= set(range(run[0][0], run[-1][0] + 1))
                    run = []
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs}


def test_line_dedup_finds_runs_whose_lines_stood_elsewhere_first(spark):
    r = random.Random(8)
    line = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(9)) for _ in range(n))
    parts = [line(n) for n in (44, 10, 8, 20, 30)]
    # each line's first place is a text of its own; the run of 112 words stands in 10 first
    docs = [(i, f"{x}\n{line(9)}") for i, x in enumerate(parts)] + [(10, "\n".join(parts)), (11, "\n".join([line(3), *parts, line(4)]))]
    got = {x.doc_id: x.text for x in lines.dedup_lines(rows(spark, docs)).collect()}
    assert len(got[11].split("\n")) == 2 and got[10] == docs[5][1] and got == all_runs_cut(docs, 50)
    # a short line that ends a run, first met after a long line that had another one after it
    long, end = line(60), line(5)
    docs = [(1, f"{long}\n{line(6)}"), (2, f"{long}\n\n{end}"), (3, f"{long}\n\n{end}\nrest")]
    assert {x.doc_id: x.text for x in lines.dedup_lines(rows(spark, docs)).collect()} == all_runs_cut(docs, 50) == dict(docs) | {2: f"\n{end}", 3: "rest"}


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_matches_all_equal_runs(spark, seed):
    r = random.Random(seed)
    pool = [" ".join(f"a{i}x{j}" for j in range(r.choice((2, 3, 5, 9, 13)))) for i in range(r.choice((2, 4, 12)))] + ["", " "]
    docs = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 16)))) for i in range(40)]
    for i in range(40, 80):  # copies of parts, some edited
        x, y = (r.choice(docs)[1].split("\n") for _ in range(2))
        docs.append((i, "\n".join(x[r.randrange(len(x)) :] + y[: r.randrange(len(y) + 1)] + [r.choice(pool)])))
    want = all_runs_cut(docs, 12)
    assert {x.doc_id: x.text for x in lines.dedup_lines(rows(spark, docs), 12).collect()} == want and want != dict(docs)


def test_line_dedup_finds_runs_that_overlap_others(spark):
    r = random.Random(11)
    line = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(n))
    docs = []
    for i in range(30):  # the first holds X, the second X and Y, the third X and Y: all of the third's copy goes
        x, y = [line(10) for _ in range(10)], [line(10) for _ in range(10)]
        docs += [(3 * i, "\n".join([*x, line(5)])), (3 * i + 1, "\n".join([line(6), *x, *y])), (3 * i + 2, "\n".join([*x, *y, f"end {i}"]))]
    got = {x.doc_id: x.text for x in lines.dedup_lines(rows(spark, docs)).collect()}
    assert got == brute.cut_runs(docs) and all(got[3 * i + 2] == f"end {i}" for i in range(30))


def test_line_dedup_of_a_very_repetitive_text(spark):
    same, short = " ".join(f"k{i}" for i in range(55)), "\n".join(["one two"] * 20_000)
    got = {x.doc_id: (x.text, x.n_deleted) for x in lines.dedup_lines(rows(spark, [(1, "\n".join([same] * 20_000)), (2, short)])).collect()}
    assert got[1] == (same, 19_999) and got[2] == ("one two", 19_999)


def test_line_dedup_beside_columns_of_any_name(spark):
    long = " ".join(f"k{i}" for i in range(70))
    names = ["run_list", "run_id", "run_th", "_t", "_left", "row", "left", "n", "th", "a.b", "N_Lines"]
    df = rows(spark, [(1, long), (2, long)]).select("*", *(F.lit("clash").alias(x) for x in names))
    got = lines.dedup_lines(df)
    assert got.columns == ["doc_id", "text", *names[:-1], "n_lines", "n_deleted"] and {(x.doc_id, x.text, x["a.b"], x.n_deleted) for x in got.collect()} == {(1, long, "clash", 0), (2, "", "clash", 1)}


def test_line_dedup_edge_rows(spark):
    long = " ".join(f"k{i}" for i in range(70))
    df = rows(spark, [(None, long), (1, None), (2, ""), (3, long), (3, long), (4, "one line")]).withColumn("n_lines", F.lit("clash"))
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in lines.dedup_lines(df).collect()), key=str)
    assert got == sorted([(None, long, 1, 0), (1, None, 1, 0), (2, "", 1, 0), (3, "", 1, 1), (3, "", 1, 1), (4, "one line", 1, 0)], key=str)
    assert lines.dedup_lines(rows(spark, [])).count() == 0


def test_fingerprints_are_few_and_only_shared_ones_have_candidates(spark):
    r = random.Random(8)
    line = lambda: " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(r.randint(3, 12)))
    passage = [line() for _ in range(12)]
    docs = [(i, "\n".join([line() for _ in range(40)] + (passage if i in (3, 17) else []) + [line() for _ in range(5)])) for i in range(30)]
    selected = cut(lines.fingerprints(lines.line_table(rows(spark, docs)), 50), "selected")
    places, windows = selected.count(), selected.agg(F.sum(F.size("windows"))).first()[0]
    assert places * 3 < windows  # neighbouring windows select the same line
    for x in selected.collect():  # the place that is selected is the least line hash of each of its windows
        assert all(w.s <= x.at <= w.e for w in x.windows)
    found = lines.candidates(selected)
    assert 0 < found.count() * 5 < windows and {x.doc_id for x in found.collect()} == {3, 17}
    every = selected.select("doc_id", "th", F.explode("windows").alias("x")).count()
    assert every == windows > found.count()  # without the minimum, every window would be a candidate


def test_a_match_goes_on_as_far_as_the_texts_agree(spark):
    text = [f"line {i} " + " ".join(f"w{i}x{k}" for k in range(18)) for i in range(30)]
    # the tail of the run stands first elsewhere, together with its last windows
    docs = [(1, "\n".join(text[20:])), (2, "\n".join(["own start of two"] + text + ["own end of two"])), (3, "\n".join(["other start"] + text[3:29] + ["other end"]))]
    got = {x.doc_id: x.text for x in lines.dedup_lines(rows(spark, docs)).collect()}
    assert got == brute.cut_runs(docs) and got[3] == "other start\nother end" and got[2].endswith("line 19 " + " ".join(f"w19x{k}" for k in range(18)) + "\nown end of two")


def test_contained_items_match_brute_force(spark):
    r = random.Random(5)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(n))) for i, n in enumerate((4, 5, 6, 9, 17, 33, 64, 80))]
    docs = []
    for i in range(60):
        w = [r.choice(WORDS) + "q" for _ in range(r.choice((0, 5, 50, 800)))]
        x = r.choice(items)[1].split()
        for _ in range(r.randint(0, 3)):
            x[r.randrange(len(x))] = "zz"
        docs.append((i, " ".join([*w, "!?", *x]).title() if i % 2 else "\n".join([*x, *w])))
    docs += [(100, None), (101, ""), (102, items[-1][1])]
    got = {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in decontam.contained(rows(spark, docs), rows(spark, items, "item_id long, text string")).collect()}
    assert got == brute.contained(docs, items) and got
    left = {r.doc_id for r in decontam.decontaminate(rows(spark, docs), rows(spark, items, "item_id long, text string")).collect()}
    assert left == {i for i, _ in docs} - {x[0] for x in got}


def test_contamination_edge_tables(spark):
    items, docs = rows(spark, [(1, "a b c d e f")], "item_id long, text string"), rows(spark, [(None, "x a b c d e f"), (1, "A, b; c. D e f"), (1, "A, b; c. D e f"), (2, None)])
    assert sorted(((r.doc_id, r.item_id) for r in decontam.contained(docs, items).collect()), key=str) == [(1, 1), (None, 1)]
    assert decontam.decontaminate(docs.withColumn("items", F.lit(1)), items).columns == ["doc_id", "text", "items"]
    assert decontam.contained(docs, items.limit(0)).count() == 0 and decontam.contained(docs.limit(0), items).count() == 0


ODD = ["", " ", "  a", "a \n b", "x'll I'VE don't", "<|endoftext|>", "a<|endoftext|> b <|startoftext|>", "é́ ΣΑΣ İ", "\x1c\x85 x", "12345 6½", "a" * 3000, "你好 😀", "tab\tcr\r\nend "]


def test_bpe_is_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    r = random.Random(2)
    texts = ODD + ["".join(r.choice("ab ctehr'sn\n\t é!1") for _ in range(50)) for _ in range(300)]
    df = rows(spark, [*enumerate(texts), (9999, None)]).withColumn("ids", F.lit("clash"))
    for x in bpe.decode(bpe.encode(df, path), path).collect():
        ids = t.encode(x.text or "", add_special_tokens=False).ids
        assert x.ids == ids and x.decoded == t.decode(ids, skip_special_tokens=False), repr(x.text)
    assert bpe.decode(bpe.encode(rows(spark, []), path), path).count() == 0


def token_rows(spark) -> tuple[list, list]:
    """Odd and plain rows, and the same in the order of the files: doc_id (null first), then a hash of the text."""
    texts = ODD + [" ".join(random.Random(i).choices(WORDS, k=i)) for i in range(60)]
    data = [*enumerate(texts), (5, "again"), (None, "no id"), (None, None), (7777, None)]
    return data, [(r.doc_id, r.text) for r in rows(spark, data).orderBy("doc_id", F.xxhash64("text")).collect()]


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_files_round_trip(spark, vocabulary):
    path = public_tokenizers.path(vocabulary)
    t = Tokenizer.from_file(path)
    data, ordered = token_rows(spark)
    shards = cut(grammar.encode(rows(spark, data).withColumn("ids", F.lit("clash")), path), "shards")
    got = [(x.doc_id, x.start, x.ids) for x in grammar.decode(shards).orderBy("start").collect()]
    want, at = [], 0
    for i, x in ordered:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, grammar.END]
        want.append((i, at, ids))
        at += len(ids)
    assert got == want
    crc = {(x.doc_id, x.start): (x.n_tokens, x.ids_crc32) for x in grammar.digests(shards).collect()}
    assert crc == {(i, s): (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, ids in want}
    assert grammar.digests(cut(grammar.encode(rows(spark, []), path), "shards")).count() == 0


def test_words_come_out_as_the_library_has_them():
    path = public_tokenizers.path("word_bpe_49k.json")
    t, c = Tokenizer.from_file(path), grammar.coder(open(path).read())
    r = random.Random(4)
    texts = ODD + [None, "<|endoftext|>", " ", "\u03a3 ΑΣ", "a\u0301b ﬁ ½x"] + ["".join(r.choice("ab ctehr'sΣéñ\u0301\n\t !1.\x1c,王") for _ in range(40)) for _ in range(400)]
    for some in (texts, texts[:1], texts[-3:], [], [None], ["\x1c"]):
        assert [x.tolist() for x in c.encode(pa.array(some, pa.string()))] == [t.encode(x or "", add_special_tokens=False).ids for x in some]


def repeats(s) -> int:
    """The most often that a pair stands in s, not overlapping."""
    n, last = {}, {}
    for i, p in enumerate(zip(s, s[1:], strict=False)):
        if last.get(p) != i - 1:
            n[p], last[p] = n.get(p, 0) + 1, i
    return max(n.values(), default=0)


def test_grammar_expands_and_gives_random_access():
    r = np.random.default_rng(1)
    passage = r.integers(0, 90, 700)
    for ids in (r.integers(0, 50, 60_000), np.zeros(1000, int), r.integers(0, 9, 3), np.empty(0, int), np.tile([1, 2, 3, 4], 5000), np.concatenate([np.append(passage, r.integers(0, 90, 5)) for _ in range(40)])):
        s, left, right, length = grammar.compress(ids.astype(np.uint32), 100)
        assert (grammar.expand(s, 100, left, right, length) == ids).all() and len(s) <= len(ids)
        assert repeats(s.tolist()) < grammar.LEAST_COUNT
        for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (5, 6)):
            if b <= len(ids):
                assert (grammar.read_ids(s, 100, left, right, length, a, b) == ids[a:b]).all()
        assert (grammar.compress(ids.astype(np.uint32), 1 << 30)[0] < 1 << 30).sum() == (s < 100).sum()


def test_repetitions_shrink_to_a_few_symbols():
    for ids in (np.zeros(65_536, np.uint32), np.tile(np.arange(8, dtype=np.uint32), 8192)):
        s, left, *_ = grammar.compress(ids, 100)
        assert len(s) <= 8 and len(left) <= 20


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.classify(docs, labels).join(labels, "doc_id").where("crc32(encode(cast(doc_id AS string), 'UTF-8')) % 5 = 0").select("toxicity", "toxic").collect()
    good, bad = [x.toxicity for x in got if not x.toxic], [x.toxicity for x in got if x.toxic]
    assert np.mean([b > g for b in bad for g in good]) > 0.9 and np.mean([g < 0.5 for g in good]) > 0.95


def test_toxicity_edge_rows(spark):
    docs = rows(spark, [(1, None), (2, ""), (3, "x" * 50_000), (3, "y"), (None, "z")]).withColumn("toxicity", F.lit("clash"))
    labels = rows(spark, [(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels)
    assert got.count() == 5 and got.where("toxicity BETWEEN 0 AND 1").count() == 5
    assert toxicity.classify(docs, labels.limit(0)).count() == 5 and toxicity.classify(docs.limit(0), labels).count() == 0


def test_the_classifier_matches_a_plain_version():
    r = random.Random(6)
    word = lambda bad: r.choice(["hate", "vile", "scum"] if bad and r.random() < 0.6 else ["fine", "calm", "tree", "river", "stone"])
    y = [int(i % 3 == 0) for i in range(90)]
    texts = [" ".join(word(b) for _ in range(r.randint(2, 6))) for b in y]
    grams = [{f" {t.lower()} "[k : k + n] for n in toxicity.ORDERS for k in range(len(t) + 3 - n)} for t in texts]
    count = lambda g, c: sum(g in x for x, b in zip(grams, y, strict=True) if b == c)
    n1, n0 = sum(y), len(y) - sum(y)
    ratio = {g: math.log((count(g, 1) + 1) / (n1 + 2)) - math.log((count(g, 0) + 1) / (n0 + 2)) for g in set().union(*grams)}
    names = sorted(g for g in ratio if count(g, 0) + count(g, 1) >= toxicity.MIN_TEXTS and abs(ratio[g]) >= toxicity.MIN_RATIO)
    x = np.array([[ratio[g] if g in t else 0.0 for g in names] for t in grams])
    w, bias, n, target = np.zeros(len(names)), 0.0, len(y), np.array(y)
    balance, scale = np.where(target, n / (2 * n1), n / (2 * n0)), (x**2).sum(0) / n + 1e-3
    for _ in range(300):
        g = (1 / (1 + np.exp(-(x @ w + bias))) - target) * balance
        w, bias = w - 0.1 * ((g @ x) / n + 1e-4 * w) / np.sqrt(scale * np.sqrt(len(names))), bias - 0.5 * g.mean()
    want = 1 / (1 + np.exp(-(x @ w + bias)))
    m = toxicity.fit(texts, y)
    margin = np.zeros(n)
    for start, keys in toxicity.features(texts, m.weights != 0):
        part = np.bincount(keys >> 20, m.weights[keys & (toxicity.BUCKETS - 1)])
        margin[start : start + len(part)] += part
    assert np.abs(m.score(margin) - want).max() < 1e-3 and ((want > 0.5) == target).mean() > 0.9


def test_toxicity_features_do_not_span_texts():
    keys = [k for s, k in toxicity.features(["ab", "cd", None, ""])]
    alone = [k + i * toxicity.BUCKETS for i, t in enumerate(["ab", "cd", None, ""]) for _, k in toxicity.features([t])]
    assert sorted(np.concatenate(keys)) == sorted(np.concatenate(alone))
