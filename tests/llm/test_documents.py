"""Operators 2 to 8 and 10 on small documents, against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from math import exp, factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import components, fm_index, line_rules, mixing, partenum, pseudo_likelihood, repeats, suffix, token_files, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, texts, schema=SCHEMA):
    rows = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, schema)


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


def odd_rows():
    """Nulls, empty and blank texts, one word, a long text, repeated rows, and a null id."""
    long = prose(1, 6000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "Word"), (5, long), (6, long), (7, prose(2, 40)), (7, prose(2, 40)), (None, prose(3, 30)), (8, "Ünï " + prose(2, 40))]


# Suffix arrays


@pytest.mark.parametrize(("n", "letters"), [(1, 3), (2, 1), (60, 1), (400, 2), (500, 300)])
def test_suffix_array_and_common_prefixes(n, letters):
    x = np.random.default_rng(n).integers(0, letters, n)
    sa = suffix.suffix_array(x)
    assert sa.tolist() == sorted(range(n), key=lambda i: x[i:].tolist())

    def shared(i, j):
        k = 0
        while max(i, j) + k < n and x[i + k] == x[j + k] and k < 9:
            k += 1
        return k

    assert suffix.common_prefixes(x, sa, 9).tolist() == [0] + [shared(sa[i - 1], sa[i]) for i in range(1, n)]


# 2: decontamination


def contaminated(docs, items):
    grams = {}
    for i, t in items:
        w = WORD.findall((t or "").encode().lower())
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            grams.setdefault(tuple(w[k : k + size]), set()).add("" if i is None else str(i))
    for _, t in docs:
        w = WORD.findall((t or "").encode().lower())
        hit, found = set(), set()
        for g, ids in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= ids
        yield len(w), len(hit), sorted(found)


def test_decontamination_matches_brute_force(spark, monkeypatch):
    passage = prose(10, 25)
    items = [(1, passage), (2, prose(11, 12)), (3, "Tiny item"), (4, None), (5, ""), (1, prose(12, 15)), (None, prose(13, 11))]
    docs = [*odd_rows(), (20, prose(4, 30) + " " + passage.upper() + ". " + prose(5, 20)), (21, passage[30:120]), (22, "a tiny ITEM, here"), (23, prose(12, 15) + " " + prose(11, 12)), (24, prose(13, 11))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    clash = frame(spark, docs).withColumns({"hits": F.lit(1), "n_words": F.lit(2), "items": F.lit(3)})
    expected = sorted(contaminated(docs, items))
    got = fm_index.find_contamination(clash, benchmark).collect()
    assert sorted((r.n_words, sum(h.n_words for h in r.hits), list(r["items"])) for r in got) == expected
    monkeypatch.setattr(fm_index, "PASS_BYTES", 60)  # several passes find the same
    got = fm_index.find_contamination(frame(spark, docs), benchmark).collect()
    assert sorted((r.n_words, sum(h.n_words for h in r.hits), list(r["items"])) for r in got) == expected


def test_decontamination_cuts_spans_and_keeps_clean_rows(spark):
    passage = prose(10, 25)
    docs = frame(spark, [(1, f"keep {passage} this"), (2, passage), (3, "clean text"), (4, None)])
    out = {r.doc_id: r for r in fm_index.decontaminate(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert set(out) == {1, 3, 4}
    assert out[1].text == "keep  this" and out[1].n_chars == len("keep  this")
    assert out[3].text == "clean text" and out[4].text is None


def test_decontamination_of_empty_tables(spark):
    none = frame(spark, [])
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert fm_index.find_contamination(none, benchmark).count() == 0
    assert fm_index.find_contamination(frame(spark, [(1, "a b c")]), benchmark).first().hits == []


def test_wavelet_ranks():
    x = np.random.default_rng(3).integers(0, 13, 300)
    tree = fm_index.WaveletMatrix(x, 4)
    c, e = np.repeat(np.arange(13), 301), np.tile(np.arange(301), 13)
    assert tree.rank(c, e).tolist() == [int((x[:j] == i).sum()) for i, j in zip(c, e, strict=True)]


# 3: toxicity


def test_toxicity_learns_and_keeps_its_fold(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(900):
        words = prose(1000 + i, 60).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(6):
                words.insert(r.randrange(len(words)), r.choice(["zork", "blarg", "quux"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs += [(10_000 + i, t) for i, (_, t) in enumerate(odd_rows())]
    labels += [(10_001, None, None), (None, 1, 1)]
    table = frame(spark, docs).withColumn("score", F.lit("x"))
    out = toxicity.score_toxicity(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).withColumn("fold", toxicity.fold(F.col("doc_id"))).collect()
    assert len(out) == len(docs) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in out)
    held = [x for x in out if x.doc_id < 900 and x.fold == 0]
    assert all(x.fold == zlib.crc32(str(x.doc_id).encode()) % 5 for x in held)
    assert sum(x.predicted == int(x.doc_id % 3 == 0) for x in held) >= 0.95 * len(held)


def test_kneser_ney_estimates_match_plain_python(spark):
    r, rare = random.Random(12), 0.75
    texts = [(" ".join(r.choice("abcdefg" if k % 2 else "abcxyz") for _ in range(r.randint(1, 30))), k % 2) for k in range(30)] + [("A, b!", 0), ("", 1), (None, 0)]
    seen = {0: set(), 1: set()}
    for t, c in texts:
        w = ["<", "<", *re.findall(r"[0-9a-z]+", (t or "").lower())]
        seen[c] |= {tuple(w[k - 2 : k + 1]) for k in range(2, len(w))}
    n = {c: Counter(x[1:] for x in seen[c]) for c in (0, 1)}  # by different words before
    ends = {c: Counter(w for _, w in n[c]) for c in (0, 1)}
    both = Counter(w for _, w in set(n[0]) | set(n[1]))

    def p(c, v, w):
        low = (both[w] + 1) / (sum(both.values()) + len(both) + 1)
        total = sum(ends[c].values())
        low = max(ends[c][w] - rare, 0) / total + sum(min(x, rare) for x in ends[c].values()) / total * low
        of_v = {k: x for k, x in n[c].items() if k[0] == v}
        mass = sum(of_v.values())
        return low if not mass else max(n[c][v, w] - rare, 0) / mass + sum(min(x, rare) for x in of_v.values()) / mass * low

    found = spark.createDataFrame(texts, "text string, toxic int").transform(toxicity.map_arrow, toxicity._trigrams, "u long, v long, w long, toxic int")
    counts = found.groupBy("u", "v", "w", "toxic").count().groupBy("v", "w").agg(F.count_if(F.col("toxic") == 0).alias("n0"), F.count_if(F.col("toxic") == 1).alias("n1"))
    model = toxicity._estimate(counts, rare)
    for text in ("a b c x y z", "g g q a q", "new", "x a g b"):
        raw = np.frombuffer(text.encode(), np.uint8)
        h, _, _, row = toxicity.words(raw, np.array([0, len(raw)]), toxicity.ALNUM_SEPARATORS)
        w = ["<", *text.split()]
        expected = [np.log(p(1, w[k - 1], w[k]) / p(0, w[k - 1], w[k])) for k in range(1, len(w))]
        assert np.allclose(model.ratio(h, row), expected, atol=1e-5), text


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [x.score for x in toxicity.score_toxicity(frame(spark, [(1, "a b"), (2, None)]), none).collect()] == [0.0, 0.0]
    assert toxicity.score_toxicity(frame(spark, []), none).count() == 0


# 4: mixing


def test_mixing_inverts_the_poisson_distribution(spark):
    docs = frame(spark, [(i, f"text {i}") for i in range(3000)]).withColumn("copy", F.lit(0))
    weights = {"src0": 0.6, "src1": 0.1}
    out = mixing.poisson_mix(docs, weights, size=1.5).collect()
    counts = Counter(r.doc_id for r in out)
    rate = {s: w * 1.5 * 3 for s, w in {**weights, "src2": 0.3}.items()}
    for i in range(0, 3000, 37):
        digest = hashlib.md5(f"17|{i}|{hashlib.md5(f'text {i}'.encode()).hexdigest()}".encode()).hexdigest()
        u, n, total = int(digest[:12], 16) / 2**48, 0, 0.0
        lam = rate[f"src{i % 3}"]
        while (total := total + exp(-lam) * lam**n / factorial(n)) <= u:
            n += 1
        assert counts[i] == n
    per = Counter(r.source for r in out)
    assert abs(per["src0"] / len(out) - 0.6) < 0.03 and abs(len(out) / 4500 - 1) < 0.05
    assert len({(r.doc_id, r.copy) for r in out}) == len(out)


def test_mixing_edge_cases(spark):
    docs = frame(spark, odd_rows()).withColumn("source", F.when(F.col("doc_id") == 7, None).otherwise(F.col("source")))
    out = mixing.poisson_mix(docs, {"": 0.5}, size=5.0).collect()
    assert {r.doc_id for r in out} <= {1, 2, 3, 4, 5, 6, 7, 8, None}
    sevens = Counter(r.copy for r in out if r.doc_id == 7)
    assert set(sevens.values()) == {2}  # equal rows draw equal counts
    assert mixing.poisson_mix(frame(spark, [])).count() == 0
    assert mixing.poisson_mix(docs, size=0.0).count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    names = ("thresholds", "rate", "source_key", "parts", "_rate", "_SOURCE", "_text", "_u")
    docs = frame(spark, [(i, f"t {i}") for i in range(30)])
    plain = mixing.poisson_mix(docs, size=3.0)
    out = mixing.poisson_mix(docs.withColumns({n: F.lit(n) for n in names}), size=3.0)
    assert out.columns == [*docs.columns, *names, "n_copies", "copy", "mix_key"]
    rows = out.collect()
    assert all(r[n] == n for r in rows for n in names) and sorted(r.mix_key for r in rows) == sorted(r.mix_key for r in plain.collect())


def test_mixing_reaches_rates_above_one_draw(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "small" if i < 10 else "big", 6) for i in range(8000)], SCHEMA)
    rates = {r.source_key: r.rate for r in mixing.source_rates(docs, {"small": 0.5, "big": 0.5}).collect()}
    assert rates["small"] == 400.0
    out = mixing.poisson_mix(docs, {"small": 0.5, "big": 0.5})
    per = Counter(r.source for r in out.select("source").collect())
    assert abs(per["small"] - 4000) < 5 * 4000**0.5 and abs(per["big"] - 4000) < 5 * 4000**0.5
    copies = sorted(r.n_copies for r in out.where("source = 'small' and copy = 1").collect())
    assert len(copies) == 10 and 300 < copies[0] < copies[-1] < 500  # 5 standard deviations of 20


# 5: pseudo-likelihood


def test_pseudo_likelihood_is_the_sum_of_normalised_conditionals():
    flat = pseudo_likelihood.initial(3)
    ids, row = np.array([5, 900, 33, 5, 1023, 7]), np.array([0, 0, 0, 0, 1, 1])
    e, w1, b1, wc, bc, ww, bw = pseudo_likelihood.unpack(flat)
    got = pseudo_likelihood.log_probabilities(flat, ids, row)
    for i in range(len(ids)):
        around = [ids[i + d] if 0 <= i + d < len(ids) and row[i + d] == row[i] else pseudo_likelihood._EDGE for d in (-2, -1, 1, 2)]
        h = np.tanh(e[around].ravel() @ w1 + b1)
        classes = np.exp(h @ wc + bc)
        total = 0.0
        for g in range(pseudo_likelihood.CLASSES):
            words = np.exp(h @ ww[g] + bw[g])
            p = classes[g] / classes.sum() * words / words.sum()
            total += p.sum()
            if g == ids[i] // pseudo_likelihood.PER_CLASS:
                assert abs(np.log(p[ids[i] % pseudo_likelihood.PER_CLASS]) - got[i]) < 1e-4
        assert abs(total - 1) < 1e-4


def test_pseudo_likelihood_learns(spark):
    r = random.Random(8)
    ordered = [(i, " ".join(f"w{(s + k) % 12}" for s in [r.randrange(12)] for k in range(200))) for i in range(150)]
    shuffled = (500, " ".join(r.choice([f"w{k}" for k in range(12)]) for _ in range(200)))
    docs = frame(spark, [*ordered, shuffled, (600, None), (601, "")]).withColumn("n_tokens", F.lit("x"))
    out = {x.doc_id: x for x in pseudo_likelihood.score_documents(docs).collect()}
    assert len(out) == 153 and out[600].n_tokens == 0 and out[600].log_likelihood == 0 and out[601].mean_log_likelihood is None
    assert np.mean([out[i].mean_log_likelihood for i in range(150)]) > out[500].mean_log_likelihood + 0.2
    assert pseudo_likelihood.score_documents(frame(spark, [])).count() == 0


def test_pseudo_likelihood_predicts_words_within_buckets(spark):
    common = " ".join(f"c{k}" for k in range(800))
    docs = frame(spark, [*((i, common) for i in range(5)), *((10 + i, f"r{i}") for i in range(500)), (600, "r7"), (601, "r7"), (602, "r8 c1 r8")])
    counts = Counter(w for (t,) in docs.select("text").collect() for w in t.split())
    vocabulary = pseudo_likelihood.build_vocabulary(docs)
    h = {w: pseudo_likelihood.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), pseudo_likelihood.ALNUM_SEPARATORS)[0] for w in counts}
    bucket = {w: int(vocabulary.encode(x)[0]) for w, x in h.items()}
    assert all((bucket[w] >= 800) == (w[0] == "r") for w in counts)
    out = {x.doc_id: x.log_likelihood for x in pseudo_likelihood.score_documents(docs).collect()}
    assert len(out) == 508 and out[17] == out[600] == out[601]
    same = [i for i in range(500) if bucket[f"r{i}"] == bucket["r7"]]
    assert len(same) > 1
    for i in same:  # the network sees one word for all of a bucket; what differs is the words' counts
        assert abs(out[17] - out[10 + i] - np.log(counts["r7"] / counts[f"r{i}"])) < 1e-6


# 6: token counts


def test_token_counts_round_trip(spark):
    docs = frame(spark, odd_rows())
    coder = token_files.encoding(token_files.TOKENIZER, token_files.PATTERN)
    expected = Counter((None if i is None else str(i), len(coder.encode_ordinary(t or ""))) for i, t in odd_rows())
    for size in (7, 1000, 1 << 20):
        found = token_files.count_tokens(token_files.tokenise(docs, block_tokens=size)).collect()
        assert Counter((r.name, r.n_tokens) for r in found) == expected
    assert token_files.count_tokens(token_files.tokenise(frame(spark, []))).count() == 0


def test_token_files_without_index(spark, tmp_path):
    end = token_files.END
    shards = {"a.bin": [1, 2, end, end, 3, 4, 5, end], "b.bin": [end, 9, 9, 9], "c.bin": [7] * 11}
    for name, ids in shards.items():
        np.array(ids, np.uint16).tofile(tmp_path / name)
    (tmp_path / "empty.bin").write_bytes(b"")
    blocks = token_files.read_token_files(spark, f"file://{tmp_path}/*.bin", block_tokens=3, partition_blocks=2)
    assert sorted(map(tuple, blocks.select("shard", "block", "tokens").collect())) == sorted(map(tuple, token_files._whole_files(spark.read.format("binaryFile").load(f"file://{tmp_path}/*.bin"), 3).select("shard", "block", "tokens").collect()))
    got = sorted((r.shard[-5:], r.ordinal, r.n_tokens) for r in token_files.count_tokens(blocks).collect())
    assert got == [("a.bin", 0, 2), ("a.bin", 1, 0), ("a.bin", 2, 3), ("b.bin", 0, 0), ("b.bin", 1, 3), ("c.bin", 0, 11)]


# 7: near duplicates


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_copies(seed, n, words, edits):
    r, base = random.Random(seed), prose(seed, words).split()
    for _ in range(n):
        out = list(base)
        for _ in range(r.randint(0, edits)):
            out[r.randrange(len(out))] = r.choice(["xx", "yy", "zz"])
        yield " ".join(out)


def test_near_duplicates_match_brute_force(spark):
    texts = [t for _, t in odd_rows()]
    for seed, n, words, edits in ((30, 40, 60, 4), (31, 40, 250, 14), (32, 15, 12, 2), (33, 10, 7, 1), (34, 25, 33, 2)):
        texts += list(near_copies(seed, n, words, edits))
    passage = prose(77, 40)
    texts += [f"{prose(200 + i, 60)} {passage} {prose(300 + i, 60)}" for i in range(60)]
    docs = list(enumerate(texts))
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(docs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    out = {r.doc_id: r for r in partenum.jaccard_components(frame(spark, docs)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in out.items()} == {i: (len(sets[i]), find(i)) for i in range(len(docs))}
    kept = sorted(r.doc_id for r in partenum.keep_one_of_each(frame(spark, docs)).collect())
    assert kept == sorted({find(i) for i in range(len(docs))})


def test_near_duplicates_of_odd_tables(spark):
    out = partenum.jaccard_components(frame(spark, odd_rows()).withColumn("component_id", F.lit(1))).collect()
    assert len(out) == len(odd_rows())
    found = {(r.doc_id, r.component_id) for r in out}
    assert {(1, 1), (2, 2), (3, 3), (6, 5), (7, 7)} <= found
    assert sum(r.doc_id == 7 for r in partenum.keep_one_of_each(frame(spark, odd_rows())).collect()) == 1
    assert partenum.jaccard_components(frame(spark, [])).count() == 0


def test_signatures_meet_for_every_similar_pair():
    r = np.random.default_rng(5)
    none = np.zeros(0, np.uint64)
    for size in (1, 3, 8, 24, 26, 33, 60, 90, 130, 400, 1500):
        for _ in range(12):
            shared = r.integers(0, 1 << 63, size, dtype=np.uint64)
            most = size // 3  # |A and B| / |A or B| stays at 3/4 or more
            extra = r.integers(0, 1 << 63, most, dtype=np.uint64)
            cut = r.integers(0, most + 1)
            a, b = (np.unique(np.concatenate((shared, e))) for e in (extra[:cut], extra[cut:]))
            frequent = np.sort(shared[: size // 2]) if r.random() < 0.5 else none
            both = []
            for x in (a, b):
                sig, _ = partenum.signatures(x, np.zeros(len(x), np.int64), np.array([len(x)]), frequent)
                both.append(set(sig.tolist()))
            assert both[0] & both[1], (size, len(a), len(b))
            sk = [partenum.sketches(x, np.zeros(len(x), np.int64), np.array([len(x)]))[0] for x in (a, b)]
            assert partenum.possible(len(a), sk[0], len(b), sk[1])


def test_packed_signatures():
    r = np.random.default_rng(2)
    for bits, buckets, n in ((40, 3, 50), (63, 7, 200), (32, 1, 0), (40, 1, 3000), (20, 2**19, 40)):
        sig, row, ids = r.integers(0, 1 << bits, n, dtype=np.uint64), np.sort(r.integers(0, 9, n)), r.integers(0, 1 << 63, 9, dtype=np.uint64)
        out = [(k, *x) for k, data in partenum.packed(sig, ids, row, bits, buckets) for x in zip(*partenum.unpacked(data, bits, buckets), strict=True)]
        assert sorted(out) == sorted((int(x) % buckets, int(x) // buckets, ids[k]) for x, k in zip(sig, row, strict=True))


@pytest.mark.parametrize(("at_once", "hot", "block"), [(4_000_000, 1_000_000, 400), (50, 2, 3)])
def test_partenum_in_small_steps(spark, monkeypatch, at_once, hot, block):
    """Groups whose members are alike only in chains, with signatures sorted in pieces, hot ones linked at once and small blocks."""
    for name, value in (("_AT_ONCE", at_once), ("HOT_SETS", hot), ("_BLOCK", block), ("_MEMBERS", 2)):
        monkeypatch.setattr(partenum, name, value)
    r, docs = random.Random(9), []
    for group in range(4):
        words = prose(4000 + group, 90).split()
        for _ in range(14):
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(words) - 8)
                words[k : k + r.randint(1, 4)] = prose(r.randrange(10**6), r.randint(1, 4)).split()
            docs.append((len(docs), " ".join(words)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in docs)]
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    got = {x.doc_id: (x.component_id, x.n_shingles) for x in partenum.jaccard_components(frame(spark, docs)).collect()}
    assert got == {i: (label[i], len(sets[i])) for i in range(len(docs))} and 4 < len(set(label)) < 50


def test_components(spark):
    edges = [(9, 4), (4, 2), (7, 8), (8, 7), (5, 5), (2, 1), (30, 31), (31, 32), (32, 33), (33, 34), (34, 35)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {9: 1, 4: 1, 2: 1, 8: 7, 31: 30, 32: 30, 33: 30, 34: 30, 35: 30}


# 8: repeated passages


def without_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        yield bytes(x for x, g in zip(b, gone, strict=True) if not g)


@pytest.mark.parametrize(("spans", "hot", "piece"), [(8000, 20_000, 1 << 19), (3, 20_000, 1 << 19), (8000, 1, 1 << 19), (3, 1, 1 << 19), (8000, 20_000, 700)])
def test_repeats_match_brute_force(spark, monkeypatch, spans, hot, piece):
    monkeypatch.setattr(repeats, "SHARD_SPANS", spans)  # 3: one key goes to several shards
    monkeypatch.setattr(repeats, "HOT_SPANS", hot)  # 1: every key of the sample is dealt to several tasks
    monkeypatch.setattr(repeats, "_SAMPLED", 2 if hot == 1 else 64)
    if piece == 700:  # texts in several slices
        monkeypatch.setattr(repeats, "BYTES", repeats.Unit(False, 32, piece, False))
    passage, part = prose(50, 120), prose(51, 60)
    texts = [t for _, t in odd_rows()] + [f"{prose(60 + i, 40)} {passage} {prose(90 + i, 30)}" for i in range(9)]
    texts += [f"{prose(600 + i, 30)} {part[:350]} {prose(700 + i, 30)}" for i in range(6)]  # shorter than a window
    texts += [passage + passage, "é" * 500, "x" * 1000, part[:420], "y" + part[:399] + "z", prose(99, 300)]
    docs = list(enumerate(texts))
    given = frame(spark, docs).withColumns({"kept": F.lit(0), "doc": F.lit("d"), "Runs": F.lit(7)})
    found = repeats.remove_repeats(given, unit=repeats.BYTES)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "doc", "Runs", "kept", "n_bytes", "n_removed", "spans"]
    out = {r.doc_id: r for r in found.collect()}
    assert {(r.doc, r.Runs) for r in out.values()} == {("d", 7)}
    for (i, t), kept in zip(docs, without_repeats(texts, 400), strict=True):
        assert bytes(out[i].kept) == kept, i
        assert out[i].n_bytes == len((t or "").encode()) and out[i].n_removed == out[i].n_bytes - len(kept)
        assert sum(s.end - s.start for s in out[i].spans) == out[i].n_removed


def test_windows_of_spans_that_agree_beyond_the_length():
    r = random.Random(4)
    for trial in range(150):
        shared = bytes(r.choice(b"ab") for _ in range(512 + trial % 10))
        tails = [bytes(r.choice(b"abcd") for _ in range(522 - len(shared))) for _ in range(2)]
        others = [bytes(r.choice(b"ab") for _ in range(r.randint(400, 522))) for _ in range(4)]
        pieces = [*others[:2], shared + b"z" + tails[0], others[2], shared + b"a" + tails[1], others[3]]
        counts = Counter(p[i : i + 400] for p in pieces for i in range(len(p) - 399))
        got = repeats.repeated_windows([np.frombuffer(p, np.uint8) for p in pieces])
        assert [g.tolist() for g in got] == [[counts[p[i : i + 400]] > 1 for i in range(len(p) - 399)] for p in pieces]


def words_in_passages(docs, length):
    """For each row, the words in windows of `length` words that another document (doc_id and text) holds too."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    holders = {}
    for d, w in zip(docs, split, strict=True):
        for k in range(len(w) - length + 1):
            holders.setdefault(tuple(w[k : k + length]), set()).add(d)
    return [{p for k in range(len(w) - length + 1) if len(holders[tuple(w[k : k + length])]) > 1 for p in range(k, k + length)} for w in split]


@pytest.mark.parametrize(("spans", "hot"), [(8000, 20_000), (3, 20_000), (8000, 1), (3, 1)])
def test_passages_that_documents_share(spark, monkeypatch, spans, hot):
    monkeypatch.setattr(repeats, "SHARD_SPANS", spans)
    monkeypatch.setattr(repeats, "HOT_SPANS", hot)
    monkeypatch.setattr(repeats, "_SAMPLED", 2 if hot == 1 else 64)
    short, one, other = prose(20, 49), prose(21, 53), prose(22, 90)
    docs = [*odd_rows(), (9, f"{one} {prose(23, 20)} {one}"), (10, other + " x " + other)]  # what only one document holds stays
    docs += [(100 + i, f"{prose(200 + i, 30)} {short} {prose(300 + i, 30)}") for i in range(5)]
    docs += [(200 + i, f"{prose(400 + i, 20 + i)}\n{' '.join(prose(24, 120).split()[i : 60 + i])} {prose(500 + i, 9)}") for i in range(9)]
    docs += [(300, "é " * 60), (301, "é " * 55 + "x"), (302, prose(25, 51)), (302, prose(25, 51)), (303, prose(26, 400)), (304, " ".join(prose(26, 400).split()[100:151]) + "\u2003.")]
    expected = words_in_passages(docs, 50)
    out = repeats.remove_repeats(frame(spark, docs), passage_words=50).collect()
    assert Counter((r.doc_id, r.text, r.n_passage_words) for r in out) == Counter((*d, len(x)) for d, x in zip(docs, expected, strict=True))
    cut = repeats.remove_passages(frame(spark, docs)).collect()
    left = lambda t, gone: [w for p, w in enumerate(re.findall(r"[^\x20\x09-\x0D]+", t or "")) if p not in gone]
    assert Counter((r.doc_id, " ".join(re.findall(r"[^\x20\x09-\x0D]+", bytes(r.kept).decode()))) for r in cut) == Counter((d, " ".join(left(t, x))) for (d, t), x in zip(docs, expected, strict=True))
    assert len(expected[docs.index((302, prose(25, 51)))]) == 0 and len(expected[-1]) == 50
    assert repeats.remove_passages(frame(spark, [])).count() == 0


def test_words_of_long_texts_come_in_pieces(monkeypatch):
    from chronoloom.llm import words as W

    texts = ["", prose(1, 300), "x" * 500, " ", prose(2, 40) + " ", "y", prose(3, 90)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    whole = W.words(raw, offsets, W.SPACE_SEPARATORS)
    monkeypatch.setattr(W, "_AT_ONCE", 100)
    assert all(np.array_equal(a, b) for a, b in zip(whole, W.words(raw, offsets, W.SPACE_SEPARATORS), strict=True))


def test_repeats_of_odd_tables(spark):
    out = repeats.remove_repeats(frame(spark, [*odd_rows(), (9, prose(5, 200)), (9, prose(5, 200))])).collect()
    assert [r.n_removed for r in out if r.doc_id == 9] == [len(prose(5, 200))] * 2
    assert [r.n_removed for r in out if r.doc_id == 1] == [0]
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


# 10: line rules


def test_line_rules(spark):
    body = "\n".join(prose(800 + k, 12) for k in range(4))
    rows = [(i, f"{prose(900 + i, 25)}\nSubscribe  TO our\tnewsletter now\n{prose(950 + i, 25)}") for i in range(40)]
    rows += [(100 + i, body) for i in range(30)]
    rows += [(200, None), (201, ""), (202, "one two"), (203, " ".join(["same eight words over and over again now"] * 6)), (204, "a # b\na # b\n\n \n" + prose(3, 30)), (205, prose(4, 30)), (205, prose(4, 30))]
    table = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").withColumn("kept", F.lit(5))
    out = {r.doc_id: r for r in line_rules.line_frequency_filter(table.drop("kept"), least_docs=20, least_percent=10.0).collect()}
    assert all(out[i].kept and out[i].n_removed_words == 5 for i in range(40))
    assert all(not out[100 + i].kept and out[100 + i].n_removed_words == 48 for i in range(30))
    assert not any(out[i].kept for i in (200, 201, 202, 203)) and out[200].n_words == 0
    assert out[203].n_repeat_words == 48 and out[203].base_failed
    assert (out[204].n_dup_lines, out[204].n_symbols) == (1, 2)
    assert out[205].kept and out[205].n_removed_words == 0
    assert line_rules.line_frequency_filter(table.drop("kept").limit(0)).count() == 0


def test_repeated_window_words_matches_brute_force(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("ab") for _ in range(n)) for n in (7, 8, 9, 30, 60, 200)] + [None, "", prose(7, 50) + " x " + prose(7, 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {x.i: x.n for x in docs.select("i", line_rules.repeated_window_words(line_rules.split_words(F.col("text"))).alias("n")).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {p for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        assert got[i] == len(hit)
