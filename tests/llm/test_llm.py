"""The training-data operators against plain versions on small tables, and their edge cases."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.llm import chains, components, decontaminate, embeddings, mixing, neardup, pii, quality, suffixes, tokens, toxicity, urls, windows
from quillspan.llm.scratch import IdFilter, Scratch

RNG = np.random.default_rng(3)
VOCABULARY = ["".join(RNG.choice(list("abcdefghijklmnop"), RNG.integers(2, 9))) for _ in range(900)]
DOCS_NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


def table(spark, rows, extra=False):
    """rows: (doc_id, text[, source]). Extra columns have names that operators might use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.withColumn("score", F.lit(1)).withColumn("taken", F.lit("x")).withColumn("key", F.lit(2)) if extra else df


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (6, "one two three four"), (7, "é日本 😀 …"), (8, "word " * 3000)]


def edited(text, every, seed):
    w = text.split()
    for i in range(int(np.random.default_rng(seed).integers(1, every)), len(w), every):
        w[i] = f"zz{seed}x{i}"
    return " ".join(w)


# ---- words and windows


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n.-“日", max_size=30), max_size=6))
def test_words_as_a_regular_expression_finds_them(texts):
    column = pa.array(texts, pa.string())
    for lo, hi, data, offsets in tokens.pieces(column):
        starts, ends, first = tokens.words(data, offsets)
        got = [[bytes(data[a:b]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)] for i in range(hi - lo)]
        assert got == [re.findall(r"[ab0-9é日]+", t) for t in texts[lo:hi]]


def test_hashes_are_of_content_only():
    a, fa = tokens.word_hashes(*[x for x in next(tokens.pieces(pa.array(["x aa bb", "bb"])))[2:]])
    assert a[2] == a[3] and len(set(a.tolist())) == 3 and fa.tolist() == [0, 3, 4]
    g, before = tokens.grams(a, fa, 5)
    assert before.tolist() == [0, 1, 2]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.integers(1, 9), st.integers(0, 60))
def test_minimizers_by_brute_force(values, w, cut):
    h = np.array(values, dtype=np.uint64) << np.uint64(40)
    cut = min(cut, len(values))
    before = np.array([0, cut, len(values)])
    want = set()
    for lo, hi in ((0, cut), (cut, len(values))):
        for i in range(lo, max(hi - w + 1, lo + (hi > lo))):
            part = values[i : min(i + w, hi)]
            want.add(i + part.index(min(part)))
    assert windows.minimizers(h, before, w).tolist() == sorted(want)


def test_components_and_id_filter(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20, 40)] + [(1, 9), (9, 5), (50, 50)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(Scratch(spark, "t"), links).collect()}
    assert all(got[i] == 20 for i in range(20, 41)) and got[5] == got[9] == got[1] == 1 and got[50] == 50
    ids = spark.range(0, 500, 5)
    f = IdFilter(ids, "id")
    hashed = spark.range(500).select(F.xxhash64("id")).toPandas().iloc[:, 0].to_numpy()
    passed = f(hashed)
    assert passed[::5].all() and passed.mean() < 0.5


# ---- 1 mixing


def fill(sizes, weights, factor, epochs):
    """Clamp and reshare until none is above."""
    budget, full, out = factor * sum(sizes), set(), [0.0] * len(sizes)
    while True:
        live = [i for i in range(len(sizes)) if i not in full and sizes[i]]
        left = budget - sum(epochs * sizes[i] for i in full)
        share = {i: left * weights[i] / sum(weights[k] for k in live) for i in live}
        over = [i for i in live if share[i] > epochs * sizes[i]]
        if not over:
            for i in live:
                out[i] = share[i]
            for i in full:
                out[i] = epochs * sizes[i]
            return out
        full |= set(over)


def test_mixing_by_repeated_clamping(spark):
    names = ["a", "b", "é", "z", None]
    rows = [(i, prose(int(RNG.integers(1, 60)), i), names[min(4, int(RNG.integers(0, 12)) // 2)]) for i in range(400)]
    out = mixing.mix(table(spark, rows), [5, 2, 1]).toPandas()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    want = dict(zip(order, fill([size[s] for s in order], [[5, 2, 1][k % 3] for k in range(len(order))], 1.5, 2), strict=True))
    for s, part in out.groupby(out["source"].fillna("?")):
        s = None if s == "?" else s
        assert abs(part["target"].iloc[0] - want[s]) < 1e-6 and abs(part["taken"].sum() - want[s]) < 1
    assert (out["taken"] <= 2 * out["size"]).all()
    again = mixing.mix(table(spark, rows).repartition(7), [5, 2, 1]).toPandas()
    assert out.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()


def test_mixed_copies_hold_the_words_taken(spark):
    docs = table(spark, [(i, prose(20, i), "ab"[i % 2]) for i in range(30)] + [(90, None), (91, "")], extra=True)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, [5, 1]).collect()}
    got = collections.Counter()
    for r in mixing.repeated(docs, [5, 1]).collect():
        got[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"]) and r["score"] == 1
    assert got == collections.Counter({k: v for k, v in taken.items() if v})


def test_mixing_without_a_broadcast_is_the_same(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (i % 13)), f"s{i % 7}" if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = lambda: {r["doc_id"]: (r["taken"], r["target"], r["source_size"]) for r in mixing.mix(df, [5, 2, 1]).collect()}
    small = taken()
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert len(small) == 400 and taken() == small


def test_mixing_of_nothing(spark):
    assert mixing.mix(table(spark, []), [5]).count() == 0
    assert [r["taken"] for r in mixing.mix(table(spark, [(1, None), (2, "")]), [5]).collect()] == [0, 0]


# ---- 2 and 8, the classifiers


def labelled(spark, n=500):
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 3 == 0
        t = prose(40, i + 5000)
        t = t.upper().replace(" ", "!! ") if bad else t
        rows.append((i, t + (" moronic garbage idiocy" if toxic else " plain words here"), "s"))
        labels.append((i, int(not bad), int(toxic)))
    return table(spark, rows + [(n + k, t) for k, (_, t) in enumerate(EDGES)], extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, module, label):
    docs, labels = labelled(spark)
    model = module.train(docs, labels)
    out = module.score(docs, model).join(labels, "doc_id").filter(quality.held_out(F.col("doc_id"))).toPandas()
    assert (out["predicted"] == out[label]).mean() > 0.95
    all_scores = module.score(docs, model).toPandas()
    assert len(all_scores) == docs.count() and all_scores["score"].between(0, 1).all()
    twice = module.score(docs.repartition(5), module.train(docs.repartition(3), labels)).toPandas()
    assert np.allclose(all_scores.sort_values("doc_id")["score"], twice.sort_values("doc_id")["score"])


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_without_labels_or_rows(spark, module):
    docs = table(spark, EDGES)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = module.train(docs, none)
    assert module.score(docs, model).count() == len(EDGES) and module.score(table(spark, []), model).count() == 0
    one = spark.createDataFrame([(6, 1, 1), (4, 1, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")
    assert module.score(docs, module.train(docs, one)).count() == len(EDGES)


def test_segments_are_the_maximal_ones():
    def plain(s):
        """All maximal segments, by their definition: the best part, then left and right of it."""
        best, span = 0, None
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                v = sum(s[i:j])
                if v > best + 1e-12 or (span and abs(v - best) < 1e-12 and j - i < span[1] - span[0] and span[0] <= i and j <= span[1]):
                    best, span = v, (i, j)
        return [] if span is None else plain(s[: span[0]]) + [best] + plain(s[span[1] :])

    for seed in range(40):
        r = np.random.default_rng(seed)
        s = np.where(r.random(14) < 0.4, r.integers(1, 9, 14) / 2, -r.integers(1, 9, 14) / 4).astype(np.float32)
        got = toxicity.segments(s, np.arange(14))
        assert np.allclose(sorted(got), sorted(plain(s.tolist()))), seed


def test_a_token_repeated_nearby_counts_once():
    s = np.array([2, -0.05, 2, 2], dtype=np.float32)
    assert np.allclose(toxicity.segments(s, np.array([7, 1, 7, 7])), [2])
    far = np.concatenate([[2.0], np.full(60, -0.1), [2.0]]).astype(np.float32)
    assert np.allclose(toxicity.segments(far, np.concatenate([[7], np.ones(60), [7]])), [2, 2])


def test_the_curve_of_rows_that_a_line_parts():
    """Evidence of 0 in all clean rows and more in all others: steps of full length diverge here."""
    x = np.concatenate([np.zeros(9000), np.random.default_rng(1).exponential(9, 900) + 4])
    slope, base = toxicity.logistic(x, (x > 0).astype(float))
    assert slope > 1 and base < -2 and np.isfinite([slope, base]).all()


def test_copies_share_one_rows_weight(spark):
    """A toxic text repeated a hundred times says no more of its rare words than one row does."""
    docs, labels = labelled(spark)
    again = table(spark, [(2000 + k, "rareword " + prose(60, 9999)) for k in range(100)])
    toxic = spark.createDataFrame([(2000 + k, 1, 1) for k in range(100)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs.select(DOCS_NAMES).unionByName(again), labels.union(toxic))
    h, first = toxicity.tokens_of(*next(tokens.pieces(pa.array(["rareword idiocy"])))[2:])
    s = model.of(h)
    assert s[0] < 0 < s[1]


# ---- 3 embeddings


def test_embedding_links_by_brute_force(spark):
    base = RNG.standard_normal((300, 32))
    near = base[RNG.integers(0, 40, 300)] + RNG.standard_normal((300, 32)) * RNG.choice([0.02, 0.2, 0.4], (300, 1))
    x = np.concatenate([base, near, base[:3] * 5]).astype(np.float32)
    rows = [(i + 10, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1, None), (2, [0.0] * 32), (3, [float("nan")] + [1.0] * 31), (4, [None] + [1.0] * 31), (5, []), (6, rows[0][1]), (7, [1e38] * 3), (8, [1e38] * 3), (9, [float("inf")] * 32)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = embeddings.near_duplicates(df).toPandas().set_index("vec_id")
    cut = embeddings.near_duplicates(df, at_once=5).toPandas().set_index("vec_id")  # lists over several blocks
    assert cut.loc[got.index, "n_links"].tolist() == got["n_links"].tolist()
    u = np.concatenate([x, x[:1]]).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ids = [i for i, _ in rows] + [6]
    links = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.9, 1)), strict=True)}
    want = collections.Counter(k for p in links for k in p)
    found = sum(min(want[i], got.loc[i, "n_links"]) for i in ids)
    assert found >= 0.95 * sum(want.values()) and all(got.loc[i, "n_links"] <= want[i] for i in ids)
    assert got.loc[[1, 2, 3, 4, 5, 9], "n_links"].sum() == 0 and got.loc[[7, 8], "n_links"].tolist() == [1, 1] and got.loc[8, "component_id"] == 7
    assert got.loc[10, "component_id"] <= 6 and len(got) == len(rows) + len(odd)
    assert ((got.index == got["component_id"]) == got["kept"]).all()


@pytest.mark.parametrize("sets", [2, 3])
def test_sum_lines_are_those_furthest_out(sets):
    unit = np.random.default_rng(sets).standard_normal((40, 16))
    lines = embeddings.Lines(16, 9, 12, 0.9, sets)
    lines.top = 9  # all directions, so the best of all sums
    line, value = lines.of(unit)
    sums = np.zeros((40, 1))
    for directions in lines.sets:
        sums = (sums[:, :, None] + (unit @ directions)[:, None, :]).reshape(40, -1)
    assert np.allclose(np.sort(value), np.sort(sums)[:, -12:])
    assert np.allclose(np.take_along_axis(sums, line, 1), value)


def test_calibration_reaches_the_recall_for_many_vectors():
    """Of other pairs at the threshold, as many as were asked for meet often enough, with three sets of directions too."""
    rng = np.random.default_rng(99)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((1500, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for n, wanted in ((50_000, 2), (10_000_000, 3)):
        sets, side, lists, count = embeddings.calibrate(64, n, 0.9, 0.98)
        lines = embeddings.Lines(64, side, lists, 0.9, sets)
        (lx, vx), (ly, vy) = lines.of(x), lines.of(y)
        met = ((lx[:, :, None] == ly[:, None, :]) & (np.abs(vx[:, :, None] - vy[:, None, :]) <= lines.window)).sum(axis=(1, 2))
        assert sets == wanted and side**sets >= 32 * n
        assert (met >= count).mean() >= 0.96


def test_no_embeddings(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- 4 chains


def best_chain(seeds):
    """Score of the best chain, by looking at all earlier seeds."""
    seeds, f = sorted(seeds), {}
    for p, c in seeds:
        f[p, c] = chains.SEED + max([0.0, *(f[q] - chains.GAP * (p - q[0] + c - q[1]) for q in f if q[0] < p and q[1] < c)])
    return max(f.values())


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=25))
def test_fenwick_chains_are_optimal(seeds):
    out = chains.chain(list(seeds))
    score = lambda own: chains.SEED * len(own) - chains.GAP * (own[-1][0] - own[0][0] + own[-1][1] - own[0][1])
    assert abs(max(score(c) for c in out) - best_chain(seeds)) < 1e-9
    assert sorted(s for c in out for s in c) == sorted(seeds)
    assert all(a[0] < b[0] and a[1] < b[1] for c in out for a, b in zip(c, c[1:], strict=False))


def test_fuzzy_passages_are_found_and_clean_texts_left(spark):
    p = [prose(70, 900 + k) for k in range(4)]
    rows = [(10, prose(100, 1) + " " + p[0] + " " + prose(80, 2)), (11, prose(60, 3) + " " + p[0]), (12, p[0]), (13, edited(p[1], 12, 5) + " " + prose(90, 4)), (14, prose(40, 5) + " " + p[1]), (15, prose(200, 6)), (16, prose(300, 7)), (17, prose(50, 8) + " " + " ".join(p[2].split()[:30])), (18, p[2])]
    cut = p[3].split()
    rows += [(19, " ".join(cut)), (20, " ".join(cut[:30] + ["in", "between"] + cut[30:50] + cut[53:]))]
    got = {r["doc_id"]: r for r in chains.repeated_words(table(spark, rows + EDGES, extra=True)).collect()}
    assert {k for k, r in got.items() if r["n_spans"]} == {11, 12, 14, 20}
    assert got[11]["sources"] == [10] and got[12]["n_repeated"] == 70 and got[10]["n_later"] == 2 and got[14]["sources"] == [13]
    assert got[20]["n_repeated"] >= 50 and len(got) == len(rows) + len(EDGES)
    assert chains.repeated_words(table(spark, [])).count() == 0


def test_a_passage_whose_pieces_stand_in_earlier_documents(spark):
    """Each piece of the passage has another first place; the document before has it whole."""
    p = prose(70, 990).split()
    rows = [(k, prose(30, 60 + k) + " " + " ".join(p[10 * k : 10 * k + 20]) + " " + prose(30, 70 + k)) for k in range(6)]
    rows += [(20, prose(40, 80) + " " + " ".join(p)), (21, " ".join(p) + " " + prose(40, 81))]
    got = {r["doc_id"]: r for r in chains.repeated_words(table(spark, rows)).collect()}
    assert got[21]["sources"] == [20] and got[21]["n_repeated"] >= 68


def test_long_gaps_are_aligned():
    r = np.random.default_rng(4)
    x = r.integers(0, 60, 900).astype("<u2")
    y = x[np.sort(r.choice(900, 700, replace=False))]
    assert chains._subsequence(x, y).sum() == 700
    assert chains._subsequence(x[:1], y).sum() == int(x[0] in y) and chains._lengths(x, y)[-1] == 700


# ---- 5 pseudonyms


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def plain_feistel(key, tweak, left, right, a, b):
    for k in range(pii.ROUNDS):
        other = right if k % 2 == 0 else left
        add = int(hashlib.sha256(f"{key}|{tweak}|{k}|{other}".encode()).hexdigest()[:15], 16)
        left, right = ((left + add % a) % a, right) if k % 2 == 0 else (left, (right + add % b) % b)
    return left, right


def test_feistel_is_a_permutation_and_as_defined(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = df.select("d", pii.permuted_digits("k", F.lit("t"), F.col("d")).alias("x")).collect()
    assert len({r["x"] for r in out}) == 1000
    for r in out[::37]:
        l, q = plain_feistel("k", "t3", int(r["d"][:1]), int(r["d"][1:]), 10, 100)
        assert r["x"] == f"{l}{q:02d}"


def test_personal_data_is_replaced_in_its_format(spark):
    card, bad = "4539 1488 0343 6467", "4539 1488 0343 6468"
    iban = "DE89 3704 0044 0532 0130 00"
    text = f"Mail jo.doe@mail.example.org or +1 (743) 555-3824; {card}, not {bad}. {iban}; 2024-02-29, 31/12/1999, 2023-02-30; ip 10.1.2.250 v1.2.3; 078-05-1120; key \"{'ab12' * 10}\"."
    docs = table(spark, [(100, text), (101, "again " + card + " on 2024-02-29"), *EDGES], extra=True)
    out = {r["doc_id"]: r for r in pii.pseudonymise(docs, "k").collect()}
    new = out[100]["text"]
    assert {k: out[100][f"n_{k}"] for k in pii.KINDS} == {"email": 1, "iban": 1, "secret": 1, "ip": 1, "date": 2, "ssn": 1, "card": 1, "phone": 1}
    for gone in ("jo.doe", "555-3824", card, iban, "2024-02-29", "31/12/1999", "10.1.2.250", "078-05-1120", "ab12" * 10):
        assert gone not in new, gone
    assert bad in new and "2023-02-30" in new and "v1.2.3" in new and "+1 (743) " in new
    shape = re.fullmatch(r"Mail \S+@example\.invalid or \+1 \(743\) \d{3}-\d{4}; (\d{4} \d{4} \d{4} \d{4}), not .*\. (DE\d\d(?: \d{4}){4} \d\d); (\d{4}-\d\d-\d\d), (\d\d/\d\d/(?:19|20)\d\d), .* ip \d+\.\d+\.\d+\.\d+ v1\.2\.3; \d{3}-\d\d-\d{4}; key \"[0-9a-f]{40}\"\.", new)
    assert shape and luhn(shape[1].replace(" ", ""))
    flat = shape[2].replace(" ", "")
    assert int(flat[4:] + "1314" + flat[2:4]) % 97 == 1
    assert shape[1] in out[101]["text"] and shape[3] in out[101]["text"]
    for i, t in EDGES:
        assert out[i]["text"] == t
    assert out[101]["score"] == 1 and pii.pseudonymise(table(spark, []), "k").count() == 0


def test_valid_values_beside_other_numbers_are_replaced(spark):
    card, iban = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    hidden = {f"card {card} 05/27": [card], f"card {card} 123": [card], f"no 12 {card}": [card], f"{iban} 2024 paid": [iban], f"{iban} EUR": [iban], f"AB12 {card}": [card], f"{iban} {card} 4539-1488-0343-6467": [iban, card, "4539-1488-0343-6467"]}
    hidden |= {"743-555-3824 743-555-3825": ["555-3824", "555-3825"], "k " + "ab" * 14 + "1a2b": ["ab" * 14], "c 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1": ["4-1-1-1-1-1"], "0" * 300 + f" {card}": [card]}
    for tail in ("SE45 5000 0000 0583 9825 7466", "CZ65 0800 0000 1920 0014 5399", "PL61 1090 1014 0000 0712 1981 2874"):
        hidden[f"to {tail.replace(' ', '')} 2024 A1"] = [tail.replace(" ", "")]
    left = ["not 4539 1488 0343 6468 05", "1" * 13, "DE89 3704 0044 0532 0130 02 x", "12 3456"]
    texts = [*hidden, *left]
    got = {r["doc_id"]: r for r in pii.pseudonymise(table(spark, list(enumerate(texts))), "k").collect()}
    for i, t in enumerate(texts):
        new = got[i]["text"]
        for gone in hidden.get(t, ()):
            assert gone not in new, (t, new)
        assert len(new) == len(t) and (t not in left or new == t), (t, new)
    assert got[0]["text"].endswith(" 05/27") and got[1]["text"].endswith(" 123") and got[3]["text"].endswith(" 2024 paid")
    assert got[0]["n_card"] == 1 and got[6]["n_iban"] == 1 and got[6]["n_card"] == 2


def test_secrets_of_letters_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "key deadbeefdeadbeefcafebabecafebabe end", "mine", "x")], "doc_id long, text string, n_email string, __cut string")
    r = pii.pseudonymise(docs, "k").first()
    assert "deadbeef" not in r["text"] and r["n_email"] == "mine" and r["_n_secret"] == 1


def test_social_security_numbers_stay_valid_and_apart(spark):
    rows = spark.range(3000).select(F.format_string("%03d-%02d-%04d", 100 + F.col("id") % 500, 1 + F.col("id") % 98, 1 + F.col("id")).alias("d"))
    out = [r["x"] for r in rows.select(pii._ssn("k", F.col("d")).alias("x")).collect()]
    assert len(set(out)) == 3000 and all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in out)


def test_dates_are_permuted_among_dates(spark):
    days = spark.range(73049).select(F.date_format(F.expr("date_add(date '1900-01-01', cast(id as int))"), "yyyy-MM-dd").alias("d"))
    out = days.select(pii._date("k", F.col("d")).alias("x")).agg(F.count_distinct("x"), F.min("x"), F.max("x")).first()
    assert tuple(out) == (73049, "1900-01-01", "2099-12-31")


# ---- 6 urls

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def plain_verdict(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(v, r) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    if fits:
        v, r = max(fits, key=lambda x: len(x[1]))
        return host, path, r, v
    return host, path, None, "block" if any(w in host + path for w in ("spam", "pills", "casino", "porn")) else "allow"


def test_urls_by_plain_rules(spark):
    urls_ = [None, "", "no scheme", "http://", "http://A.Example.NET/en/x?y#z", "http://example.net", "http://example.net/EN/", "https://evil.com/x.net/", "x://y://example.net/", "http://net/", "http://xnet/", "http://a.b.org/fr/", "http://org/fr", "http://example.com/de/ü", "http://example.com:80/de/", "http://spam.org/fr/x", "http://Spam.com/", "a://b/CASINO/casino", "http://x/" + "p" * 5000 + "ills", "http://ex\nample.net/en/", "http://ÉXAMPLE.net/en/"]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(pages, RULES).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(urls_)}
    assert urls.judge(pages.limit(0), RULES).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab*/", min_size=1, max_size=9), min_size=1, max_size=30), st.lists(st.text(alphabet="ab/", max_size=12), min_size=1, max_size=8))
def test_automaton_against_regular_expressions(globs, texts):
    """Many rules need several words of state."""
    _, _, data, offsets = next(tokens.pieces(pa.array(texts)))
    got = urls.Automaton(globs).run(data, offsets)
    for r, g in enumerate(globs):
        parts = re.split(r"(\*\*|\*)", g)
        rx = "".join({"*": "[^/]*", "**": "(?s:.*)"}.get(x, re.escape(x)) for x in parts)
        if "***" in g:  # one run of stars is read from the left
            continue
        assert [bool(x) for x in got[:, r]] == [re.fullmatch(rx, t) is not None for t in texts], g


# ---- 7 suffixes


def plain_removed(rows, n):
    seen = collections.Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        seen.update(b[p : p + n] for p in range(len(b) - n + 1))
    out = {}
    for i, b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("most", [50_000, 1])
def test_suffixes_by_brute_force(spark, most):
    p = [prose(60, 700 + k) for k in range(4)]
    rows = [(10, prose(50, 1) + p[0] + prose(30, 2)), (11, prose(40, 3) + p[0] + p[1]), (12, p[1] + prose(20, 4)), (13, prose(300, 5)), (14, prose(300, 5)), (15, prose(300, 5)[7:-9]), (16, p[2] + " mid " + p[2]), (17, "ab" * 700), (18, "x" * 399), (19, "x" * 399), (20, "é" * 250), (21, p[3][:200]), (22, p[3][:201])]
    rows += [(30 + k, edited(prose(150, 9), 25, k)) for k in range(8)] + EDGES
    out = suffixes.dedup(table(spark, rows, extra=True), most=most, run_bytes=5000).collect()
    assert {r["doc_id"]: tuple(r)[1:5] for r in out} == plain_removed(rows, 400)
    assert {r["doc_id"]: r["n_repeated"] for r in out} == {i: x[1] for i, x in plain_removed(rows, 280).items()}


def test_suffixes_of_repeated_rows_and_nothing(spark):
    t = prose(100, 12)
    out = suffixes.dedup(table(spark, [(1, t), (1, t), (2, prose(100, 13))])).collect()
    assert sorted(r["n_removed"] for r in out) == [0, len(t), len(t)]
    odd = suffixes.dedup(table(spark, [(None, t), (3, t), (3, prose(100, 14)), (None, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"] > 0) for r in odd) == [(0, False), (0, True), (3, False), (3, True)]
    assert suffixes.dedup(table(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab", max_size=8), max_size=8), max_size=6))
def test_loser_tree_merges_and_keeps_prefixes(runs):
    raw = [sorted(x.encode() for x in r) for r in runs]
    coded = [suffixes.front_coded(r) for r in raw]
    streams = [suffixes.decoded(a.tobytes(), b.tobytes(), c, 100 * k) for k, (a, b, c) in enumerate(coded)]
    out = list(suffixes.merge(streams))
    assert [s for s, _, _ in out] == sorted(x for r in raw for x in r)
    assert all(n == suffixes.shared(a, b) for (a, _, _), (b, n, _) in zip(out, out[1:], strict=False))
    assert len({p for _, _, p in out}) == len(out)


# ---- 9 near duplicates


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def test_near_duplicates_by_brute_force(spark):
    rows = [(i + 20, prose(int(RNG.integers(30, 120)), 300 + i)) for i in range(40)]
    rows += [(100 + k, edited(rows[k % 6][1], int(RNG.integers(18, 70)), k)) for k in range(60)]
    rows += [(300 + k, prose(150, 77) + " " + prose(20, 400 + k)) for k in range(30)]  # one long passage in common
    rows += EDGES
    bag = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in bag}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i, _ in rows]
    close = set()
    for x in range(len(ids)):
        for y in range(x):
            a, b = bag[ids[x]], bag[ids[y]]
            both = sum((a & b).values())
            j = both / max(1, sum(a.values()) + sum(b.values()) - both)
            if abs(j - 0.8) < 0.01:
                close |= {ids[x], ids[y]}
            if j >= 0.8:
                p, q = root(ids[x]), root(ids[y])
                parent[max(p, q)] = min(p, q)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table(spark, rows, extra=True)).collect()}
    assert got == {i: root(i) for i in ids}
    assert neardup.near_duplicates(table(spark, [])).count() == 0


def test_rows_of_one_id_and_without_an_id(spark):
    t = [prose(60, 880 + k) for k in range(4)]
    rows = [(1, t[0]), (1, t[0]), (2, t[0]), (None, t[0]), (None, t[1]), (None, t[1]), (None, edited(t[1], 55, 3)), (5, t[2]), (5, t[3]), (6, t[3]), (None, None), (None, "")]
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(table(spark, rows)).collect())
    # null and "" are two nameless documents without words
    assert got == {(1, 1, True): 1, (1, 1, False): 1, (2, 1, False): 1, (None, 1, False): 1, (None, None, True): 3, (None, None, False): 2, (5, 5, True): 1, (5, 5, False): 1, (6, 5, False): 1}


def test_documents_that_share_a_passage_with_their_head_only(spark):
    """Many members of one bucket that aren't linked: those that are near each other are found all the same."""
    head = prose(120, 4242)
    rows = [(1, head)] + [(10 + k, head + " " + prose(60, 5000 + k // 2) + f" w{k}") for k in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(table(spark, rows)).collect()}
    assert got == {1: 1} | {10 + k: 10 + k - k % 2 for k in range(40)}


def test_bag_signatures_are_unbiased():
    diff = []
    for t in range(60):
        r = np.random.default_rng(t)
        a = {k: int(r.integers(1, 12)) for k in range(50)}
        b = {k: max(1, v + int(r.integers(-3, 4))) for k, v in list(a.items())[:40]} | {k: int(r.integers(1, 12)) for k in range(90, 100)}
        pack = [(tokens.mix(np.array(list(d), dtype=np.uint64) + np.uint64(1000 * t)), np.array(list(d.values())), np.full(len(d), i)) for i, d in enumerate((a, b))]
        sig = neardup.signatures(*[np.concatenate(x) for x in zip(*pack, strict=True)], 2)
        true = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
        diff.append((sig[0] == sig[1]).mean() - true)
        assert (sig != 0).all()
    assert abs(np.mean(diff)) < 0.015


# ---- 10 decontamination


def test_benchmark_items_are_found_with_substitutions(spark):
    items = [(k, prose(int(n), 800 + k)) for k, n in enumerate(RNG.integers(16, 60, 20))] + [(50, "tiny item of five"), (51, ""), (52, None), (53, items0 := prose(30, 850)), (54, items0)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(100 + k, prose(50, k) + " " + items[k][1].upper().replace(" ", ", ") + " " + prose(40, k + 1)) for k in range(10)]
    rows += [(200, prose(30, 60) + " " + edited(items[11][1], 11, 1)), (201, "a tiny item of five here"), (202, prose(60, 61) + " " + items0), (203, " ".join(items[12][1].split()[:8])), (204, prose(400, 62))]
    docs = table(spark, rows + EDGES, extra=True)
    for size, passes in ((4_000_000, 1), (300, 0)):  # with several blocks no pass is left in the plan, whatever their number
        found = decontaminate.contaminated(docs, bench, block_words=size)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == passes
        rows_of = {r["doc_id"]: r for r in found.collect()}
        assert {k: r["items"] for k, r in rows_of.items() if r["items"]} == {**{100 + k: [k] for k in range(10)}, 200: [11], 201: [50], 202: [53, 54]}
        assert (rows_of[202]["n_items"], rows_of[202]["words"]) == (2, 30) and (rows_of[204]["n_items"], rows_of[204]["words"]) == (0, 0)
    assert decontaminate.contaminated(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contaminated(table(spark, []), bench).count() == 0


def test_a_row_is_judged_by_itself(spark):
    """An item's end opens a row and its beginning ends the row before: neither hides the other."""
    item = prose(40, 4321).split()
    rows = [(1, prose(30, 1) + " " + " ".join(item[:20])), (2, " ".join(item[20:]) + " " + prose(30, 2))]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    for part in (rows, rows[1:], rows[::-1]):
        got = {r["doc_id"]: r["items"] for r in decontaminate.contaminated(table(spark, part).coalesce(1), bench).collect()}
        assert got == {i: [7] for i, _ in part}


def test_short_items_are_found_whichever_words_are_replaced(spark):
    """Any 13 words in a row, or the whole item where it is shorter, of which 80 % are equal: as brute force has it."""
    r = np.random.default_rng(17)
    items = {k: prose(n, 6000 + k).split() for k, n in enumerate([11, 12, 13, 14, 15, 17, 20, 24])}
    rows = {}
    for k, words in items.items():
        for share in (0.0, 0.1, 0.2, 0.3):
            for _ in range(12):
                own = list(words)
                for i in r.choice(len(own), int(share * len(own)), replace=False):
                    own[i] = f"zz{i}"
                rows[1000 + len(rows)] = (k, own)
    docs = table(spark, [(i, prose(20, i) + " " + " ".join(w) + " " + prose(20, i + 1)) for i, (_, w) in rows.items()])
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {x["doc_id"]: (x["items"], x["words"]) for x in decontaminate.contaminated(docs, bench).collect()}
    for i, (k, own) in rows.items():
        same = [a == b for a, b in zip(own, items[k], strict=True)]
        need = min(13, len(same))
        fits = any(sum(same[a:b]) >= 0.8 * (b - a) for a in range(len(same)) for b in range(a + need, len(same) + 1))
        assert got[i][0] == ([k] if fits else []), (len(same), same)
        assert (got[i][1] > 0) == fits


# ---- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark, 400)
    dirty = spark.createDataFrame([(1000, prose(50, 5001), "en", "s", 1), (1001, prose(30, 1) + " " + prose(25, 2), "en", None, 1), (1002, "call +1 (743) 555-3824 " + prose(30, 3), "en", "t", 1)], DOCS).withColumns({"score": F.lit(1), "taken": F.lit("x"), "key": F.lit(2)})
    root = str(tmp_path)
    docs.unionByName(dirty).write.parquet(f"{root}/documents.parquet")
    labels.write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, prose(25, 2))], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    kept = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, root)
        assert after.columns == kept.columns, name
        before, kept = kept, spark.createDataFrame(after.toPandas(), kept.schema)
        gone = {r["doc_id"] for r in before.join(kept, "doc_id", "left_anti").collect()}
        if name == "quality":
            assert len([i for i in gone if i < 400 and i % 4 == 0]) > 95 and not [i for i in gone if i < 400 and i % 4]
        if name == "decontamination":
            assert gone == {1001}
        if name == "personal_data":
            assert not gone and kept.filter("text like '%555-3824%'").isEmpty()
    mixed = corpus_pipeline.run(spark, root)
    assert mixed.columns == [*kept.columns, "copy_no"] and mixed.count() > 0


def test_alignment_without_gaps_is_one_comparison():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 3, 90).astype("<u2")
    b = np.concatenate([rng.integers(0, 3, 7).astype("<u2"), a[:80]])
    b[20:30] = 9
    same, skipped = chains.align(a, b, np.array([[2, 9], [40, 47]]))
    assert not skipped.any() and same.tolist() == [bool(i + 7 < len(b) and a[i] == b[i + 7]) for i in range(90)]


def test_dense_edits_and_every_source_of_a_passage(spark):
    """every sixth word replaced leaves no six equal words in a row; a passage of many documents names them all."""
    prefix = lambda k: prose(60, 5000 + k) + " "
    rows, wanted = [], {}
    for k in range(12):
        p = prose(60, 6000 + k)
        rows += [(100 + 2 * k, prefix(k) + p), (101 + 2 * k, edited(p, 6, k + 1) + " " + prefix(100 + k))]
        wanted[101 + 2 * k] = [100 + 2 * k]
    p = prose(70, 7000)
    rows += [(200 + k, prefix(200 + k) + p + " " + prefix(300 + k)) for k in range(8)]
    rows += [(300, rows[0][1])]
    got = {r["doc_id"]: r for r in chains.repeated_words(table(spark, rows)).collect()}
    assert {k: got[k]["sources"] for k in wanted} == wanted and all(got[k]["n_repeated"] >= 50 for k in wanted)
    assert all(got[200 + k]["sources"] == list(range(200, 200 + k)) and got[200 + k]["n_later"] == 7 - k for k in range(8))
    assert got[300]["class_id"] == 100 and got[300]["sources"] == [100] and got[100]["n_later"] == 2


def test_chains_that_can_add_nothing_are_not_aligned(monkeypatch):
    """A pair of documents of one repeated line has as many chains as places; what the best ones cover is not aligned again."""
    calls = []
    align = chains.align
    monkeypatch.setattr(chains, "align", lambda *a: calls.append(1) or align(*a))
    has = np.zeros(1 << 16, dtype=bool)
    line = np.arange(10, dtype=np.uint16)
    a, b = np.tile(line, 30), np.tile(line, 20)
    places = np.array([(p, q) for p in range(0, 297, 10) for q in range(0, 197, 10)])
    found = chains.found_in(a, b, places[:, 0], places[:, 1], 50, 0.8, has)
    covered = np.zeros(len(a), dtype=bool)
    for lo, hi, equal in found:
        covered[lo:hi] = True
        assert equal >= 0.8 * (hi - lo)
    assert covered.all() and len(calls) < 40 and not has.any()
    few = np.concatenate([np.arange(20, 110), np.zeros(6)]).astype(np.uint16)  # has the word six times
    calls.clear()
    places = np.array([(p, 90) for p in range(900)])
    assert chains.found_in(np.zeros(1000, dtype=np.uint16), few, places[:, 0], places[:, 1], 50, 0.8, has) == [] and not calls


def test_places_are_packed_whole():
    rng = np.random.default_rng(3)
    for kind, x in (("<i8", rng.integers(-(1 << 62), 1 << 62, 999)), ("<i4", rng.integers(0, 1 << 31, 999)), ("u1", rng.integers(0, 255, 999)), ("<u4", rng.integers(0, 1 << 32, 999))):
        column = pa.chunked_array([[chains._packed(x[:400], kind)], [chains._packed(x[400:], kind)]], pa.binary())
        assert (chains._unpacked(column, kind) == x).all()
