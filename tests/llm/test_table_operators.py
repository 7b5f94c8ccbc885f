import hashlib
import math
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tests.llm import brute
from tracewright.llm import hosts, pii, sharding, vectors
from tracewright.llm.common import cut

DOC = "doc_id long, text string"


def shard_rows(spark, data, shards=4):
    return sharding.assign(spark.createDataFrame(data, DOC).withColumn("shard", F.lit("clash")), shards).collect()


def test_shards_are_even_gapless_and_keep_groups(spark):
    r = random.Random(1)
    data = [(i, "t" * r.randint(0, 400) + str(i)) for i in range(600)] + [(1000 + i, "copy " * 20) for i in range(40)] + [(2000, None), (2001, ""), (5, "again"), (None, "no id")]
    got = shard_rows(spark, data)
    assert len(got) == len(data)
    size, slots, at = [0] * 4, [[] for _ in range(4)], {}
    for x in got:
        size[x.shard] += x.size
        slots[x.shard].append(x.slot)
        at.setdefault((x.text_crc32, x.size), set()).add(x.shard)
    assert max(size) < 1.01 * min(size) and all(sorted(s) == list(range(len(s))) for s in slots)
    assert all(len(s) == 1 for s in at.values()) and {x.law for x in got} == {"bytes"} and {x.grown_shard for x in got} == {None}


def test_a_group_larger_than_a_shard_is_cut(spark):
    got = shard_rows(spark, [(i, "hot " * 30) for i in range(900)] + [(5000 + i, f"{i} " * 20) for i in range(300)])
    size = [sum(x.size for x in got if x.shard == s) for s in range(4)]
    assert max(size) < 1.15 * min(size)


def test_a_hot_group_without_ids_is_cut_as_well(spark):
    got = shard_rows(spark, [(None, "hot " * 30)] * 900 + [(7, "warm " * 30)] * 200 + [(5000 + i, f"{i} " * 20) for i in range(300)])
    size, slots = [sum(x.size for x in got if x.shard == s) for s in range(4)], [sorted(x.slot for x in got if x.shard == s) for s in range(4)]
    assert max(size) < 1.15 * min(size) and all(s == list(range(len(s))) for s in slots)


@pytest.mark.parametrize("seed", range(5))
def test_packing_matches_a_plain_version(seed):
    r = random.Random(seed)
    items = [(r.choice((1, 5, 20, 90)) * r.random() * 50, r.random() * 30, r.randint(1, 9)) for _ in range(60)]
    total = [max(sum(x[k] for x in items), 1) for k in range(3)]
    left, want = [[1 / 5] * 3 for _ in range(5)], {}
    share = [[x[k] / total[k] for k in range(3)] for x in items]
    for i in sorted(range(60), key=lambda i: (-max(share[i]), i)):
        fits = [s for s in range(5) if left[s][0] >= share[i][0]]
        best = max(fits, key=lambda s: (round(sum(a * b for a, b in zip(left[s], share[i], strict=True)), 15), -s)) if fits else max(range(5), key=lambda s: (left[s][0], -s))
        want[i] = best
        left[best] = [a - b for a, b in zip(left[best], share[i], strict=True)]
    assert sharding.pack(np.array(items), 5).tolist() == [want[i] for i in range(60)]


def test_sharding_empty_table(spark):
    assert shard_rows(spark, []) == []


def test_packing_prefers_what_is_left():
    items = np.array([[10, 0, 1], [10, 0, 1], [0, 10, 1], [0, 10, 1]], float)
    a = sharding.pack(items, 2)
    assert a[0] != a[1] and a[2] != a[3]


BASE = brute.pii_patterns()


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind: str, v: str) -> bool:
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def base_spans(text: str | None) -> list[tuple]:
    out = [(m.start(), k, m.end(), n) for k, (n, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if valid(n, m.group())]
    return [(n, s, e) for s, _, e, n in sorted(out)]


def test_base_spans_match_the_plain_patterns(spark):
    r = random.Random(4)
    texts = ["", None, "a@b.co_x@d.com y", "x@y@z.com", "é 1.2.3.4.5.6.7.8 \x01\x02 a@b.c", "300.1.1.1 007.0.0.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (771) 555-1655 +123", "9" * 5000, "a." * 4000 + "@x.y", "1." * 3000]
    texts += ["".join(r.choice("ab@@..--+ 0123456789() é\n") for _ in range(80)) for _ in range(400)]
    texts += ["".join(r.choice(["4111", "1111", "-", " ", ".", "+", "9", "25", "a@b", ".c"]) for _ in range(12)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), DOC)
    for x in pii.base_spans(df).collect():
        got = sorted((m.s, i, m.e, k) for i, k in enumerate(BASE) for m in x[k])
        assert [(k, s, e) for s, _, e, k in got] == base_spans(x.text), repr(x.text)
        assert all(x.text[m.s : m.e].replace("\x01", "\x03").replace("\x02", "\x03") == m.v for k in BASE for m in x[k])


def test_terms_that_disclose_are_spans(spark):
    r = random.Random(7)
    fill = lambda: " ".join("".join(r.choice("aeioulmnrst") for _ in range(6)) for _ in range(8))
    data = [(i, f"{fill()} Zebulon {fill()} joe@x.com {fill()}\nother line {fill()}") for i in range(5)] + [(10 + i, fill()) for i in range(120)] + [(200, "zebulon alone"), (201, None), (202, "")]
    df = spark.createDataFrame(data, DOC).withColumn("email", F.lit("clash"))
    got = {x.doc_id: x for x in pii.sanitise(pii.find(df)).collect()}
    assert len(got) == len(data) and [m.v for m in got[200].term] == ["zebulon"] and [m.v for m in got[0].term] == ["Zebulon"]
    assert "<EMAIL>" in got[0].clean and "<TERM>" in got[0].clean and "joe@" not in got[0].clean and got[201].clean is None and got[10].term == []
    assert pii.sanitise(pii.find(df.where("doc_id = 200")), remove_terms=True).first().clean == "zebulon alone"
    assert pii.find(df.limit(0)).count() == 0


def test_a_context_is_the_whole_line(spark):
    r = random.Random(11)
    fill = lambda n: " ".join("".join(r.choice("aeioulmnrst") for _ in range(6)) for _ in range(n))
    data = [(i, f"{fill(40)} Zebulon {fill(400)} joe@x.com {fill(9)}") for i in range(5)] + [(10 + i, fill(60)) for i in range(1000)]
    got = {x.doc_id: [m.v for m in x.term] for x in pii.find(spark.createDataFrame(data, DOC)).collect()}
    assert all(("Zebulon" in v) == (i < 5) for i, v in got.items())


def test_planted_names_are_found_and_little_else(spark):
    """Names beside values, in lines of any length: recall and false spans of the method at its thresholds."""
    r = random.Random(12)
    common = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    fill = lambda n: " ".join(r.choice(common) for _ in range(n))
    names, data = {f"Name{chr(97 + k // 26)}{chr(97 + k % 26)}": f"u{k}@mail{k}.org" for k in range(60)}, []
    for name, mail in names.items():
        for _ in range(r.randint(3, 8)):  # as often beside the value as alone, at most
            data.append(f"{fill(r.randint(3, 60))} {name} {fill(r.choice((0, 3, 50)))} {mail} {fill(r.randint(3, 60))}\n{fill(30)}")
        data += [f"{fill(20)} {name} {fill(20)}" for _ in range(r.randint(0, 3))]
    data += [fill(r.randint(20, 200)) for _ in range(2000)]
    found = pii.find(spark.createDataFrame(list(enumerate(data)), DOC)).collect()
    spans = [m.v for x in found for m in x.term]
    assert {v for v in spans if v in names} == set(names) and sum(v not in names for v in spans) == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_terms_match_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.choice((1, 2, 3, 6))))
    people = [(f"p{i}@x{i}.org", f"Näme{chr(97 + i)}", f"{i + 1}.2.3.4") for i in range(24)]
    docs = []
    for i in range(300):
        t = [word() for _ in range(r.randint(3, 60))]
        for _ in range(r.choice((0, 0, 1, 2))):
            mail, name, ip = r.choice(people)
            k = r.randrange(len(t))
            t[k:k] = r.choice(([name, mail], [mail, word(), name, "\n" if r.random() < 0.3 else word()], [name] * 2, [mail, "999.1.1.1", ip, word(), name], ["王" if mail[1] in "01" else "李李", mail]))
        docs.append((i if r.random() < 0.95 else None, " ".join(t)))
    docs += [docs[3]] * 40 + [docs[7]] * 3 + [(None, None)] * 2 + [(400, "")]
    want = brute.disclosed_terms(docs, base_spans)
    df = spark.createDataFrame(docs, DOC)
    assert {x.term for x in pii.disclosing_terms(cut(pii.base_spans(df), "spans")).collect()} == want and want
    for x in pii.find(df).collect():
        base = base_spans(x.text)
        mine = [(m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{M}]+", x.text or "") if m.group().lower() in want]
        assert [(m.s, m.e) for m in x.term] == [(s, e) for s, e in mine if not any(a <= s and e <= b for _, a, b in base)]


def test_rows_given_more_than_once_change_nothing(spark):
    r = random.Random(7)
    fill = lambda: " ".join("".join(r.choice("aeioulmnrst") for _ in range(6)) for _ in range(8))
    data = [(i, f"{fill()} Zebulon {fill()} joe@x.com {fill()}") for i in range(5)] + [(10 + i, fill()) for i in range(120)]
    df = spark.createDataFrame(data, DOC)
    assert {x.v for row in pii.find(df.union(df).union(df)).collect() for x in row.term} == {"Zebulon"} == {x.v for row in pii.find(df).collect() for x in row.term}


def test_a_text_with_very_many_values(spark):
    text = " ".join(f"u{i}@h.org {i}" for i in range(30_000))
    (x,) = pii.base_spans(spark.createDataFrame([(1, text)], DOC)).collect()
    assert len(x.email) == 30_000 and all(text[m.s : m.e] == m.v == f"u{i}@h.org" for i, m in enumerate(x.email)) and x.email[5].near == " 4   5 "


def test_query_digest_of_spans(spark):
    df = pii.find(spark.createDataFrame([(1, "1.2.3.4 a@b.co")], DOC)).select(F.sha2(pii.joined_spans(tuple(pii.PATTERNS)), 256).alias("h"))
    assert df.first().h == hashlib.sha256(b"ip:0:7,email:8:14").hexdigest()


def test_hosts_and_rules(spark):
    urls = ["http://A.Example.COM/en/7x?q", "https://example.com/en/8", "x.net/de/8", "://h.net/de/1#a", "http://example.net/de/80", "http://example.org?x=/es/", None, "", "ftp://a.org/es/é", "http://xcom/en/1", "http://com/en/1", "http://a.b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in hosts.judge(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert got == {0: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 1: ("example.com", "/en/8", "com/en/", "block"), 2: ("", "", None, "allow"), 3: ("h.net", "/de/1", "net/de/", "allow"), 4: ("example.net", "/de/80", "example.net/de/8", "block"), 5: ("example.org", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("a.org", "/es/é", "org/es/", "block"), 9: ("xcom", "/en/1", None, "allow"), 10: ("com", "/en/1", "com/en/", "block"), 11: ("a.b:", "//c/d", None, "allow")}
    assert hosts.judge(pages.limit(0), spark.createDataFrame([], "page_id long, bad int")).count() == 0


def test_rules_are_the_listed_ones(spark):
    """Each rule's word, on a page of a host that all labels call bad: only a rule can allow it."""
    urls = {"x.com/en/1": "block", "example.com/en/7": "allow", "x.net/de/1": "allow", "example.net/de/8": "block", "x.org/es/1": "block"}
    pages = spark.createDataFrame([(i, f"http://{u}") for i, u in enumerate(urls)] + [(100 + i, f"http://{h}/") for h in ("example.com", "x.net") for i in range(40 * (h == "x.net"), 40 + 40 * (h == "x.net"))], "page_id long, url string")
    bad = pages.where("page_id >= 100").select("page_id", F.lit(1).alias("bad"))
    got = {r.page_id: r.verdict for r in hosts.judge(pages, bad).collect()}
    assert [got[i] for i in range(len(urls))] == list(urls.values()) and got[100] == got[140] == "block"


def strength(units):
    """units: (labels of the unit, prior mean). The level's strength from pairs of labels."""
    off = most = 0.0
    for x, m in units:
        if len(x) > 1:
            off += sum((a - m) * (b - m) for i, a in enumerate(x) for j, b in enumerate(x) if i != j) / (len(x) - 1)
            most += len(x) * m * (1 - m)
    rho = max(hosts.LEAST_RHO, min(hosts.MOST_RHO, off / most if most else hosts.LEAST_RHO))
    return (1 - rho) / rho


def posteriors(labels, names):
    """labels: (host, 0 or 1). Each host's beta by adding up labels level by level, none of them twice."""
    cut = lambda h, level: (".".join(h.split(".")[-2:]) if level == 2 else h.split(".")[-1] if level == 1 else "" if level == 0 else h)
    prior = {("", 0): (hosts.MOST_BAD / 2, 1.0)}  # what stands before the labels of a unit: mean and weight
    for level in (1, 2, 3):
        before = {}
        for u in {cut(h, level) for h in names}:
            up = cut(u, level - 1)
            m, s = prior[up, level - 1]
            around = [x for h, x in labels if cut(h, level - 1) == up and cut(h, level) != u]
            before[u] = ((m * s + sum(around)) / (s + len(around)), s + len(around))
        z = strength([([x for h, x in labels if cut(h, level) == u], m) for u, (m, _) in before.items()])
        prior |= {(u, level): (m, min(z, held)) for u, (m, held) in before.items()}
    out = {}
    for h in names:
        m, s = prior[h, 3]
        own = [x for g, x in labels if g == h]
        out[h] = (m * s + sum(own), (1 - m) * s + len(own) - sum(own))
    return out


def upper_tail(limit, a, b):
    """The share of Beta(a, b) above limit, by adding up its density over the logits of the rate."""
    t = np.linspace(-60, 60, 1_200_001)
    log = a * -np.logaddexp(0, -t) + b * -np.logaddexp(0, t)
    weight = np.exp(log - log.max())
    return weight[t > math.log(limit / (1 - limit))].sum() / weight.sum()


def test_beta_tail_is_exact(spark):
    data = [(0.3, 9.0), (1.0, 1.0), (2.0, 8.0), (1.2, 1.8), (20.0, 80.0), (150.0, 500.0), (0.5, 0.5), (900.0, 4000.0), (3.0, 0.7), (0.11, 1.9)]
    for x in spark.createDataFrame(data, "a double, b double").withColumn("p", hosts.exceeds(0.2)).collect():
        assert x.p == pytest.approx(upper_tail(0.2, x.a, x.b), abs=2e-4)
    exact = spark.createDataFrame([(1.0, 3.0), (2.0, 1.0), (400000.0, 1600000.0)], "a double, b double").withColumn("p", hosts.exceeds(0.2)).collect()
    assert [x.p for x in exact[:2]] == pytest.approx([0.8**3, 1 - 0.2**2], abs=1e-11) and abs(exact[2].p - 0.5) < 1e-3


def test_posterior_matches_hand_calculation(spark):
    r = random.Random(2)
    names = ["a.x.com", "b.x.com", "x.com", "c.y.com", "d.z.org", "e.z.org", "solo"]
    rate = dict(zip(names, (0.9, 0.1, 0.3, 0.2, 0.8, 0.05, 0.5), strict=True))
    pages, out = [], []
    for i in range(600):
        h = r.choice(names)
        pages.append((i, h))
        if i % 3:
            out.append((i, int(r.random() < rate[h])))
    got = {x.host: x for x in hosts.reputation(spark.createDataFrame(pages, "page_id long, host string"), spark.createDataFrame(out + [(1, 0), (None, 1)], "page_id long, bad int")).collect()}
    of = dict(pages)
    for u, (a, b) in posteriors([(of[i], x) for i, x in dict(out).items()], names).items():
        assert got[u].a == pytest.approx(a) and got[u].b == pytest.approx(b) and got[u].bad == pytest.approx(upper_tail(hosts.MOST_BAD, a, b), abs=2e-4)


@pytest.mark.parametrize("around", ["good", "mixed", "none"])
def test_little_evidence_blocks_no_host(spark, around):
    """(labelled, bad) of planted hosts: what must come out whatever the other hosts are like."""
    planted = {"one.example.com": (1, 1, "allow"), "two.example.org": (2, 1, "allow"), "twelve.example.net": (12, 12, "block"), "spam.shared.com": (15, 14, "block"), "fine.shared.com": (40, 1, "allow"), "new.example.com": (0, 0, "allow")}
    r, labels, pages = random.Random(4), [], []
    others = {"good": [(f"h{k}.g{k % 40}.com", 0) for k in range(1000)], "mixed": [(f"h{k % 60}.m{k % 12}.{('com', 'org', 'net')[k % 3]}", int(r.random() < 0.12)) for k in range(1500)], "none": []}[around]
    for host, bad in others + [(h, int(i < k)) for h, (n, k, _) in planted.items() for i in range(n)]:
        labels.append((len(pages), bad))
        pages.append((len(pages), f"http://{host}/x"))
    pages.append((len(pages), "http://new.example.com/x"))
    got = {x.host: x.verdict for x in hosts.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert {h: got[h] for h in planted} == {h: v for h, (_, _, v) in planted.items()}
    assert all(v == "allow" for h, v in got.items() if h not in planted)


def test_ports_and_users_share_a_hosts_labels(spark):
    pages = spark.createDataFrame([(i, f"http://{u}bad.example{p}/x") for i, (u, p) in enumerate([("", ""), ("", ":80"), ("me@", ":8080"), ("", ":")] * 10)] + [(900, "http://good.example:80/x")], "page_id long, url string")
    out = spark.createDataFrame([(i, 1) for i in range(20)] + [(900, 0)], "page_id long, bad int")
    got = {x.page_id: x for x in hosts.judge(pages, out).collect()}
    assert {got[i].verdict for i in range(40)} == {"block"} and {got[i].n_labelled for i in range(40)} == {20} and got[1].host == "bad.example:80" and got[2].host == "me@bad.example:8080"


def brute_vectors(data):
    ok = {}
    for i, v, l in data:
        if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            ok[i] = (x / np.linalg.norm(x), l)
    parent, links = {i: i for i in ok}, dict.fromkeys(ok, 0)
    ids = sorted(ok)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if ok[i][1] == ok[j][1] and len(ok[i][0]) == len(ok[j][0]) and ok[i][0] @ ok[j][0] >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = brute.find(parent, i), brute.find(parent, j)
                parent[max(a, b)] = min(a, b)
    return {i: (links.get(i, 0), brute.find(parent, i) if i in ok else i) for i, _, _ in data if i is not None}


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    r = np.random.default_rng(3)
    data = []
    for c in range(12):
        center = r.normal(size=16)
        for _ in range(15):
            data.append((len(data), [float(x) for x in (center + r.normal(size=16) * r.choice([0.01, 0.05, 0.12, 0.2]))], int(c % 3)))
    data += [(len(data) + i, data[0][1], 0) for i in range(9)]
    n = len(data)
    data += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, [1.0] * 15 + [None], 1), (n + 4, data[0][1], None), (n + 5, [1.0, 2.0], 0), (n + 6, [2.0, 4.0], 0), (n + 7, [], 0), (n + 8, [1e-38] * 16, 2), (n + 9, [3e38] * 16, 2), (None, data[0][1], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("clash"))
    got = vectors.near_duplicates(df).collect()
    assert {x.vec_id: (x.n_links, x.component_id) for x in got if x.vec_id is not None} == brute_vectors(data)
    assert all(x.kept == (x.vec_id is not None and x.vec_id == x.component_id) for x in got) and len(got) == len(data)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_different_vectors_under_one_id(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.001], 0), (3, [0.0, 2.0], 0), (4, [1.0, 1.0], 0)]
    got = {(x.vec_id, x.n_links, x.component_id, x.kept) for x in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {(1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)}


def test_the_quantisation_bound_holds():
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + r.normal(size=x.shape) * 0.03
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    i, j, again = vectors.tile_links(x, y)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(x @ y.T >= 0.98)), strict=True)) and 0 < again < x.shape[0] * 20


def test_what_meets_other_blocks_is_int8(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 20)
    seen = []
    keep = vectors.cut
    monkeypatch.setattr(vectors, "cut", lambda df, name, **k: (seen.append((name, dict(df.dtypes))), keep(df, name, **k))[1])
    r = np.random.default_rng(5)
    base = r.normal(size=(6, 40))
    rows = [(i, [float(x) for x in base[i % 6] + r.normal(size=40) * r.choice([0.02, 0.1, 0.14])], i % 2) for i in range(160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(x.vec_id, x.n_links, x.component_id) for x in vectors.near_duplicates(df).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    links = {i: [j for j, _, m in rows if j != i and m == k and unit[i] @ unit[j] >= 0.98] for i, _, k in rows}
    parent = {i: i for i in links}
    for i, js in links.items():
        for j in js:
            a, b = brute.find(parent, i), brute.find(parent, j)
            parent[max(a, b)] = min(a, b)
    assert got == {(i, len(js), brute.find(parent, i)) for i, js in links.items()} and sum(map(len, links.values())) > 100
    small = dict(seen)["quantised"]
    assert small["q"] == "binary" and "vectors" not in small and "vectors" not in dict(seen)["tiles"]
