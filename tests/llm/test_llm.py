"""The training-data operators against brute force, exact round trips and held-out accuracy, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clausework.llm import bpe_reuse, fingerprints, fst_count, lm, mixing, near_copies, pipeline, quality_mil, queries, simhash_dedup, suffix_dedup, topk, toxicity, votes
from clausework.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix a jug of strong potion for the king of the north and his guests. "


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def corpus():
    rnd = random.Random(5)
    syllables = ["ka", "lo", "mi", "ré", "tu", "san", "vor", "eß", "の", "qu"]
    make = lambda n: " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(n))
    texts = [make(rnd.randrange(0, 60)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5] + " Zusatz", LINE + texts[7], texts[8] + " " + LINE + texts[9], LINE, LINE * 3, "", None, "a", "a b", "  \t\n ", "x" * 900, make(4000)]
    texts += [texts[20].replace(" ", "\n"), "ab <|endoftext|> it's we'll 12３  !"]
    return [(k, t, "en", f"s{k % 3}" if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]


def trigram_scores(rows):
    """Sum of log10 probabilities of each document, by an interpolated modified Kneser-Ney trigram model in plain Python."""
    tokens = {k: [*words(t), "</s>"] for k, t, *_ in rows}
    padded = {k: ["<s>", "<s>", *t] for k, t in tokens.items()}
    train = [k for k in tokens if zlib.crc32(str(k).encode()) % 7 != 2]
    v = len({w for k in train for w in tokens[k]})
    counts = {3: Counter(g for k in train for g in zip(padded[k], padded[k][1:], padded[k][2:], strict=False))}
    for n in (2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut = {n: lm.Discounts(*(sum(x == k for x in c.values()) for k in (1, 2, 3, 4))).d for n, c in counts.items()}
    total, free = Counter(), Counter()
    for n, c in counts.items():
        for g, x in c.items():
            total[n, g[:-1]] += x
            free[n, g[:-1]] += cut[n][min(x, 3)]

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / (v + 1)
        key = len(g), g[:-1]
        return (max(counts[len(g)][g] - cut[len(g)][min(counts[len(g)][g], 3)], 0) + free[key] * lower) / total[key] if total[key] else lower

    return {k: sum(math.log10(p(g)) for g in zip(t, t[1:], t[2:], strict=False)) for k, t in padded.items()}


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, repeated ids, clashing names."""
    some = [(1, "aa bb cc", 1), (1, "aa bb cc", 1), (1, "other text here", 2), (None, "null id text", 3), (None, None, 4), (7, "", 5)]
    return spark.createDataFrame(some, "doc_id long, text string, count long").withColumn("node", F.lit(1)).withColumn("tokens", F.lit("x")).withColumn("source", F.lit("s")).withColumn("doc", F.lit(0)).withColumn("term", F.lit(0))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# 1


def test_language_model_matches_brute_force(docs, rows):
    model = lm.fit(docs.filter(~lm.held_out("doc_id", 7, 2)), order=2)
    out = got(lm.score(docs, model))
    tokens = {k: [*words(t), "</s>"] for k, t, *_ in rows}
    train = [tokens[k] for k in tokens if zlib.crc32(str(k).encode()) % 7 != 2]
    c, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    followers = Counter(w for _, w in pairs)
    cut_pairs, cut_words = (lm.Discounts(*(sum(x == k for x in table.values()) for k in (1, 2, 3, 4))) for table in (pairs, followers))
    free_words = sum(cut_words(np.array([x]))[0] for x in followers.values()) / len(pairs)
    total, free = Counter(), Counter()
    for (a, _), x in pairs.items():
        total[a] += x
        free[a] += cut_pairs(np.array([x]))[0]

    def p(a, w):
        q = max(followers[w] - cut_words(np.array([followers[w]]))[0], 0) / len(pairs) + free_words / (v + 1)
        return max(pairs[a, w] - cut_pairs(np.array([pairs[a, w]]))[0], 0) / total[a] + free[a] / total[a] * q if total[a] else q

    for k, t in tokens.items():
        r = out[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), abs_tol=1e-8)
        assert math.isclose(r["score"], sum(math.log10(p(a, w)) for a, w in zip(["<s>", *t], t, strict=False)), abs_tol=1e-8)
    assert math.isclose(sum(p("ka", w) for w in c) + free["ka"] / total["ka"] * free_words / (v + 1), 1, rel_tol=1e-9)


def test_language_model_of_three_words_and_odd_rows(docs, odd, none):
    assert lm.score(docs, lm.fit(docs, order=3)).filter("score > 0 or score is null").count() == 0
    assert lm.score(odd, lm.fit(none)).filter("score = 0 and train_tokens = 0").count() == 6
    assert lm.score(none, lm.fit(odd)).count() == 0


# 2


def test_registered_language_model_is_of_three_words(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = got(queries.op1_lm_scoring(spark, str(tmp_path)))
    for k, score in trigram_scores(rows).items():
        assert math.isclose(out[k]["score"], score, abs_tol=1e-8)


def test_language_model_of_many_small_parts(docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "COUNT_TOKENS", 40)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 500)
    out = got(lm.score(docs, lm.fit(docs.filter(~lm.held_out("doc_id", 7, 2)))))
    for k, score in trigram_scores(rows).items():
        assert math.isclose(out[k]["score"], score, abs_tol=1e-8)


def test_a_task_of_pairs_that_runs_again_finds_the_contexts(tmp_path):
    import pyarrow as pa

    folder, bits = str(tmp_path), 2
    rnd = np.random.default_rng(2)
    key = np.unique(rnd.integers(1, 9, (200, 3)).astype("u4"), axis=0)
    a, b, c = key.T
    bucket = lm.C.bucket_of(lm._pair_hash(a, b), bits)
    batch = lambda x, y, z: [lm._batch([("gram", 1, lm._pack_triples(x, y, z, np.full(len(x), 3, "u4")))])]
    mine = bucket == 1
    assert all((x == y).all() for x, y in zip(lm._unpack_triples(lm._pack_triples(a, b, c, c)), (a, b, c, c), strict=True))
    list(lm._gram_reducer(folder, bits)(iter(batch(a[mine], b[mine], c[mine]))))
    reduce = lm._pair_reducer(folder, bits, False, bytes([2]))
    first = pa.Table.from_batches(list(reduce(iter(batch(a[mine], b[mine], c[mine])))))
    files = {f.name: f.read_bytes() for f in tmp_path.iterdir()}
    assert not any(f.startswith("context") for f in files)
    assert pa.Table.from_batches(list(reduce(iter(batch(a[mine], b[mine], c[mine]))))).equals(first)
    assert {f.name: f.read_bytes() for f in tmp_path.iterdir()} == files


def test_fingerprints_and_edits(docs, rows):
    out = got(fingerprints.compare(docs))
    order = sorted(rows, key=lambda r: -r[0])
    prints = {}
    for (k, t, *_), (_, n, *_) in zip(order, [*order[1:], order[0]], strict=True):
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        assert (out[k]["n_chars"], out[k]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(t, out[k]["fingerprint"]) == out[k]["fingerprint"]
    for (k, *_), (j, *_) in zip(order, [*order[1:], order[0]], strict=True):
        apart = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
        assert math.isclose(out[k]["near_next"], apart(out[k]["fingerprint"], out[j]["fingerprint"]))
        assert math.isclose(out[k]["near_edited"], apart(out[k]["fingerprint"], out[k]["edited_fingerprint"]))


def test_fingerprints_of_odd_rows(odd, none):
    assert fingerprints.compare(odd).count() == 6 and fingerprints.compare(none).count() == 0
    assert fingerprints.compare(odd.filter("doc_id = 7")).first()["near_next"] == 1.0


def test_block_tables_find_all_within_the_radius(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(128) for _ in range(20)]
    some = base + [b ^ sum(1 << rnd.randrange(128) for _ in range(rnd.randrange(0, 6))) for b in base for _ in range(4)]
    df = spark.createDataFrame([(f"{x:032x}",) for x in some], "fingerprint string")
    found = {(r["query"], r["fingerprint"], r["distance"]) for r in fingerprints.near(df, df.limit(10), 3).collect()}
    asked = {r["fingerprint"] for r in df.limit(10).collect()}
    assert found == {(q, f"{x:032x}", d) for q in asked for x in set(some) if (d := (int(q, 16) ^ x).bit_count()) <= 3}


def test_votes_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(votes, "SEGMENT", 7)
    text = " ".join(f"w{k % 13}" for k in range(60))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    monkeypatched = simhash_dedup.fingerprints(df).first()["fingerprint"]
    monkeypatch.undo()
    assert monkeypatched == simhash_dedup.fingerprints(df).first()["fingerprint"]


# 3 and 9


def labelled(n, bad, seed):
    rnd = random.Random(seed)
    make = lambda: " ".join(rnd.choice("stone river light house green walk never again under cloud music table paper glass winter".split()) for _ in range(rnd.randrange(20, 60)))
    return [(bad(make(), rnd), 1) if k % 3 == 0 else (make(), 0) for k in range(n)]


def accuracy(score, rows):
    s = score([t for t, _ in rows])
    return np.mean([(x >= 0.3) == bool(y) for x, (_, y) in zip(s, rows, strict=True)])


def test_toxicity_on_unseen_texts():
    insult = lambda t, rnd: t.replace(" ", f" {rnd.choice(['grobnak', 'vilmoxer', 'zupplehead'])} ", 1)
    model = toxicity.fit(labelled(600, insult, 1))
    assert accuracy(model.score, labelled(200, insult, 2)) > 0.95
    spaced = [("stone river g r o b n a k under cloud", 1), ("stone vilmoxxer under cloud music", 1), ("stone river under cloud music", 0)]
    s = model.score([t for t, _ in spaced])
    assert s[0] > 3 * s[2] and s[1] > 3 * s[2]


def test_toxicity_scores_do_not_depend_on_neighbours():
    model = toxicity.fit(labelled(200, lambda t, rnd: t + " grobnak", 1))
    texts = ["grobnak", "", "stone river", "a", "x" * 50]
    assert np.allclose(model.score(texts), [model.score([t])[0] for t in texts])


def test_subsequence_kernel_is_exact():
    """A stretch's value equals the sum over all its subsequences."""
    code, start = toxicity.encode(["abcab"])
    weights = np.random.default_rng(0).normal(size=1 << 18).astype(np.float32)
    _, wide = toxicity.stretches(code, weights)
    want = 0.0
    for i in range(min(toxicity.REACH, len(code) - toxicity.SPAN + 1)):
        for a in range(1, toxicity.SPAN):
            for b in range(a + 1, toxicity.SPAN):
                want += toxicity.DECAY ** (b + 1) * weights[int(code[i]) << 12 | int(code[i + a]) << 6 | int(code[i + b])]
    assert math.isclose(wide[start[0]], want, rel_tol=1e-4)


def test_quality_on_unseen_texts():
    junk = lambda t, rnd: rnd.choice([t.upper().replace(" ", "!! "), " ".join([t.split()[0]] * 40), t.replace(" ", "### ")])
    flip = lambda rows: [(t, 1 - y) for t, y in rows]
    model = quality_mil.fit(flip(labelled(300, junk, 3)))

    def score(texts):
        raw = [t.encode() for t in texts]
        return model.score(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))

    assert accuracy(score, flip(labelled(100, junk, 4))) > 0.95


def test_quality_gradient():
    model = quality_mil.fit(labelled(30, lambda t, rnd: t.upper(), 5))
    x, first = quality_mil.encode(np.frombuffer((LINE * 9).encode(), np.uint8), np.array([0, 700, 700, len(LINE) * 9]))
    y = np.array([1.0, 0.0, 1.0])
    loss = lambda: float(-np.mean(y * np.log(model.forward(x, first)["y"]) + (1 - y) * np.log(1 - model.forward(x, first)["y"])))
    g = model.gradient(model.forward(x, first), first, y)
    for k in ("W", "V", "U", "w", "c"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = model.p[k][i]
        model.p[k][i] = old + 1e-5
        up = loss()
        model.p[k][i] = old - 1e-5
        assert math.isclose((up - loss()) / 2e-5, g[k][i], rel_tol=1e-3, abs_tol=1e-8)
        model.p[k][i] = old


def test_classifiers_without_labels(odd, none):
    for module in (toxicity, quality_mil):
        for some in ([], [("a", 1)], [("a", 0), ("b", 0)]):
            model = module.fit(some)
            assert {0 <= r["score"] <= 1 for r in module.score(odd, model).collect()} == {True}
        assert module.score(none, module.fit([])).count() == 0


# 4


def removed_by_hand(rows, width=100):
    seen, out = set(), {}
    for k, t in sorted((k, (t or "").encode()) for k, t, *_ in rows):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            if t[p : p + width] in seen:
                gone[p : p + width] = True
            seen.add(t[p : p + width])
        edge = np.diff(np.concatenate(([False], gone)).astype(int))
        out[k] = (len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup_matches_brute_force(spark, docs, rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    judge, spread = suffix_dedup._judge, suffix_dedup._read
    assert judge and spread
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digest(docs).collect()}
    assert out == removed_by_hand(rows)


def test_deep_shallow_sorting():
    rnd = random.Random(3)
    for _ in range(60):
        strings = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randrange(0, 30))) for _ in range(rnd.randrange(1, 40))]
        group = np.array([rnd.randrange(2) for _ in strings])
        size = np.array([len(s) for s in strings])
        order, lcp = suffix_dedup.deep_shallow(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size, group, rnd.randrange(3))
        assert [(group[i], strings[i]) for i in order] == sorted(zip(group, strings, strict=True))
        for j in range(1, len(order)):
            same = group[order[j]] == group[order[j - 1]]
            assert lcp[j] == (suffix_dedup.common_prefix(strings[order[j]], strings[order[j - 1]]) if same else -1)


def test_suffix_dedup_of_odd_rows(spark, odd, none):
    assert suffix_dedup.digest(odd).count() == 6 and suffix_dedup.digest(none).count() == 0
    out = suffix_dedup.dedup(odd)
    assert out.columns == odd.columns and out.count() == 6
    twice = spark.createDataFrame([(1, LINE), (1, LINE), (2, LINE), (None, LINE)], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in suffix_dedup.digest(twice).collect()) == [(False, 0), (False, 0), (False, len(LINE)), (True, len(LINE))]


# 5


def fingerprint(text):
    w = words(text)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_by_hand(prints):
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in prints}


def test_near_dedup_matches_brute_force(docs, rows):
    out = got(simhash_dedup.classes(docs))
    prints = {k: fingerprint(t) for k, t, *_ in rows}
    assert {k: r["fingerprint"] for k, r in out.items()} == {k: f"{x:016x}" for k, x in prints.items()}
    assert {k: r["component_id"] for k, r in out.items()} == classes_by_hand(prints)


@pytest.mark.parametrize("cell", [8192, 3])
def test_links_connect_what_is_near(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash_dedup, "CELL", cell)
    rnd = random.Random(4)
    prints, at = {}, 0
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(8):
            prints[at] = x
            at += 1
            for _ in range(rnd.choice((1, 2, 3))):
                x ^= 1 << rnd.randrange(64)
    signed = {k: x - (1 << 64) if x >> 63 else x for k, x in prints.items()}
    df = spark.createDataFrame([(x,) for x in set(signed.values())], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash_dedup.links(df)).collect()}
    want = classes_by_hand(prints)
    for a in prints:
        for b in prints:
            assert (want[a] == want[b]) == (found.get(signed[a], signed[a]) == found.get(signed[b], signed[b]))


def test_near_dedup_of_odd_rows(odd, none):
    assert simhash_dedup.classes(odd).count() == 6 and simhash_dedup.classes(none).count() == 0


def test_near_copies_of_long_texts_are_decided_exactly(spark):
    shingled = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts, alike = [], []
    for k in range(40):
        one = [f"w{k}x{i}" for i in range(3000)]
        other = list(one)
        for e in range(57 + k // 2):  # five shingles each
            other[10 + 37 * e] += "e"
        a, b = shingled(one), shingled(other)
        texts += [" ".join(one), " ".join(other)]
        alike.append(len(a & b) / len(a | b) >= 0.8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one(df).collect()) == sorted([*range(0, 80, 2), *(2 * k + 1 for k in range(40) if not alike[k])])
    assert 0 < sum(alike) < 40


def test_near_copies_keep_one_of_each_group(spark, odd, none):
    rnd = random.Random(6)
    base = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(200)) for _ in range(6)]

    def edit(t):
        w = t.split()
        for _ in range(3):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(999)}"
        return " ".join(w)

    texts = base + [edit(t) for t in base for _ in range(5)] + [base[0]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one(df).collect()) == list(range(6))
    assert near_copies.keep_one(none).count() == 0
    out = near_copies.keep_one(odd)
    assert out.columns == odd.columns and sorted((r["text"] or "") for r in out.collect()) == ["", "aa bb cc", "null id text", "other text here"]


# 6 and 8


def reference(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    return t, {k: t.encode(x or "", add_special_tokens=False).ids for k, x, *_ in rows}


def test_encoding_matches_the_library(docs, rows, odd, none):
    t, ids = reference(rows)
    out = got(bpe_reuse.digest(docs, queries.vocabulary()))
    for k, i in ids.items():
        text = t.decode(i, skip_special_tokens=False)
        assert (out[k]["n_tokens"], out[k]["ids_sha256"], out[k]["decoded_sha256"]) == (len(i), hashlib.sha256(array("I", i).tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert all(r["text"] == (dict((k, x) for k, x, *_ in rows)[r["doc_id"]] or "") for r in bpe_reuse.encode(docs, queries.vocabulary()).collect())
    assert bpe_reuse.digest(odd, queries.vocabulary()).count() == 6 and bpe_reuse.digest(none, queries.vocabulary()).count() == 0


def strange(n, seed=1):
    rnd = random.Random(seed)
    signs = "ab 'srevl \n\n\t  é中1２٣.,!'  \x0b\x1c\x85 　é🙂"
    return ["".join(rnd.choice(signs) for _ in range(rnd.randrange(0, 50))) + ("<|endoftext|>" if k % 9 == 0 else "") for k in range(n)]


def test_small_chunks_are_repaired():
    t, ids = reference(enumerate(strange(1500)))
    codec = bpe_reuse.Codec(queries.vocabulary(), chunk_bytes=4)
    for k, text in enumerate(strange(1500)):
        assert list(codec.encode(text)) == ids[k] and codec.decode(codec.encode(text)) == t.decode(ids[k], skip_special_tokens=False)
    assert codec.regrown == 0


def test_pieces_that_disagree_are_encoded_again():
    t, ids = reference(enumerate(["one two three four five six seven eight nine ten " * 9]))
    codec = bpe_reuse.Codec(queries.vocabulary(), chunk_bytes=16)
    text = "one two three four five six seven eight nine ten " * 9
    codec.encode(text)
    for key, (head, inner, tail, left, right) in codec.cache.items():
        codec.cache[key] = head, inner, tail, left and (left[0], left[1] + left[1]), right
    assert list(codec.encode(text)) == ids[0] and codec.regrown == 1


def test_counts_match_the_library(docs, rows, odd, none, monkeypatch):
    _, ids = reference(rows)
    out = got(fst_count.token_counts(docs, queries.vocabulary()))
    assert {k: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for k, r in out.items()} == {k: (len((t or "").encode()), len(ids[k]), len(ids[k]) > 1024) for k, t, *_ in rows}
    assert fst_count.token_counts(odd, queries.vocabulary()).count() == 6 and fst_count.token_counts(none, queries.vocabulary()).count() == 0


def test_counts_of_strange_texts_with_few_states(monkeypatch):
    from clausework.llm.common import text_bytes
    import pyarrow as pa

    texts = strange(800) + ["z" * 3000]
    _, ids = reference(enumerate(texts))
    for most, chunk in ((32_000, 128), (40, 5)):
        monkeypatch.setattr(fst_count, "MAX_STATES", most)
        monkeypatch.setattr(fst_count, "CHUNK", chunk)
        assert list(fst_count.Counter(queries.vocabulary()).count(*text_bytes(pa.array(texts)))) == [len(ids[k]) for k in range(len(texts))]


# 7


@pytest.mark.parametrize("large", [1, 2**27])
def test_top_k_matches_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(topk, "TILE", 3)
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "FAN", 2)
    monkeypatch.setattr(topk, "GROUP_BYTES", 200)
    monkeypatch.setattr(topk, "SHARD_BYTES", 900)
    rnd = np.random.default_rng(1)
    vectors = {k: [int(x) * large for x in rnd.integers(-3, 4, 4)] for k in range(120)}
    some = [(k, v) for k, v in vectors.items()] + [(500, None), (501, [1, 2])]
    df = spark.createDataFrame(some, "vec_id long, vector array<long>").repartition(5)
    out = {}
    for r in topk.search(df, F.col("vec_id") % 20 == 0, 10).collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(out) == {k for k in vectors if k % 20 == 0}
    for q, found in out.items():
        want = sorted(((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), k) for k, v in vectors.items() if k != q))[:10]
        assert [found[i] for i in range(1, 11)] == [(k, -s) for s, k in want]


def test_top_k_of_odd_vectors(spark):
    df = spark.createDataFrame([(0, [0.5, float("nan")]), (20, [0.5, -0.1]), (3, [float("inf"), 0.0]), (4, [1.0, None]), (None, [1.0, 1.0]), (40, None), (5, [0.25, 0.5])], "vec_id long, embedding array<double>")
    rows = df.select("vec_id", topk.quantized().alias("vector"))
    assert [tuple(r) for r in topk.search(rows, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 5, 32 * 16 - 7 * 32)]
    assert topk.search(rows.limit(0), F.lit(True)).count() == 0


# 10


def test_mixing_meets_its_targets(spark):
    rnd = random.Random(8)
    some = [(k, "w " * rnd.randrange(1, 30), "big" if k % 3 else f"s{k % 4}") for k in range(900)] + [(900, "", "empty"), (901, None, None)]
    df = spark.createDataFrame(some, "doc_id long, text string, source string")
    tokens = Counter()
    for _, t, s in some:
        tokens[s or ""] += len((t or "").split())
    total = sum(tokens.values())
    out = mixing.mix(df, entropy=0.97, repeats=2.5).collect()
    drawn = Counter()
    for r in out:
        drawn[r["source"] or ""] += len((r["text"] or "").split())
    share = {s: n / total for s, n in tokens.items() if n}
    lo, hi = 0.0, 8.0
    for _ in range(60):
        a = (lo + hi) / 2
        w = {s: p**a for s, p in share.items()}
        z = sum(w.values())
        good = -sum(x / z * math.log(x / z) for x in w.values()) <= 0.97 * math.log(len(w)) and max(x / z / share[s] for s, x in w.items()) <= 2.5
        lo, hi = (lo, a) if good else (a, hi)
    for s, p in share.items():
        want = p**hi / sum(q**hi for q in share.values()) * total
        assert want - 31 <= drawn[s] <= want + 2
    assert Counter(r["doc_id"] for r in out)[900] == 1 and Counter(r["doc_id"] for r in out)[901] == 1


def test_mixing_that_covers_keeps_every_document(spark, odd, none):
    df = spark.createDataFrame([(k, "w " * (k % 9), "big" if k % 5 else "small") for k in range(300)], "doc_id long, text string, source string")
    copies = Counter(r["doc_id"] for r in mixing.mix(df, repeats=1.5, budget_share=None).collect())
    assert set(copies) == set(range(300)) and max(copies.values()) == 2 and all(copies[k] == 1 for k in range(300) if k % 5)
    assert mixing.mix(none, repeats=2.0).count() == 0
    out = mixing.mix(odd, repeats=1.5, budget_share=None)
    assert out.columns[: len(odd.columns)] == odd.columns and out.count() >= 6


# the whole


def test_pipeline(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [len(s) for s in pipeline.STAGES] == [2] * 5
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, df, str(tmp_path))
        if k < 4:
            assert out.columns == df.columns
        df = out
    out = df.collect()
    kept = {r["doc_id"] for r in out}
    texts = {k: " ".join(words(t)) for k, t, *_ in rows}
    assert len({texts[k] for k in kept}) == len(kept) and {texts[k] for k in texts} >= {texts[k] for k in kept}
    assert {r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()} == kept


# what is lost must be noticed


def test_lost_arrays_are_an_error(spark, docs, tmp_path):
    import glob
    import os

    model = lm.fit(docs, order=3)
    files = glob.glob(model.folder.removeprefix("file://") + "/pair-*.high")
    assert files
    os.remove(files[0])
    with pytest.raises(Exception, match="No such file"):
        lm.score(docs, model).collect()
    shelf = suffix_dedup.removed(docs)
    assert sum(b.bit_count() for b in shelf.there) == len(glob.glob(shelf.folder.removeprefix("file://") + "/span-*.0")) > 0
    for f in glob.glob(shelf.folder.removeprefix("file://") + "/span-*.1"):
        os.remove(f)
    with pytest.raises(FileNotFoundError):
        shelf.of(np.arange(0, 2**64 - 1, 2**54, dtype=np.uint64))


def test_shelves_hold_all_rows(spark):
    from clausework.llm import common as C

    df = spark.range(5000).select(F.xxhash64("id").alias("k"), "id", (F.col("id") % 3).cast("int").alias("v"))
    shelf = C.shelve(df, 5000 << 12, ["u8", "i8", "u1"], "shelf-test")
    assert shelf.bits == 6
    rows = df.collect()
    keys = np.array([r["k"] for r in rows] + [17], np.int64).view(np.uint64)
    who, (ids, v) = shelf.of(keys)
    assert len(who) == 5000 and all(rows[w]["id"] == i and i % 3 == x for w, i, x in zip(who, ids, v, strict=True))


# the registered queries, against their contracts


@pytest.fixture(scope="module")
def tables(spark, docs, rows, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    docs.write.parquet(str(top / "documents.parquet"))
    labels = [(k, int("ka" in (t or "")), int("lo" in (t or ""))) for k, t, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    rnd = np.random.default_rng(4)
    vectors = [(k, [float(x) for x in rnd.normal(size=5)], 0) for k in range(60)] + [(61, [1.0, float("nan"), 0.0, 0.0, 0.0], 0), (80, None, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(top / "embeddings.parquet"))
    return str(top)


def crc(k, modulus):
    return zlib.crc32(str(k).encode()) % modulus


def run(spark, tables, number):
    (name,) = (n for n in queries.QUERIES if n.startswith(f"op{number}_"))
    return queries.QUERIES[name](spark, tables)


def test_query_1(spark, tables, rows):
    df = run(spark, tables, 1)
    assert df.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert dict(df.dtypes)["train_tokens"] == "bigint" and dict(df.dtypes)["held_out"] == "boolean"
    tokens = {k: [*words(t), "</s>"] for k, t, *_ in rows}
    c = Counter(w for k in tokens if crc(k, 7) != 2 for w in tokens[k])
    n, v = sum(c.values()), len(c)
    for k, r in got(df).items():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(k, 7) == 2, len(tokens[k]), sum(c[w] > 0 for w in tokens[k]), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[k]), abs_tol=1e-8)


def split_words(text):
    """Lower-cased words of a text."""
    return [w for w in re.split("[ \\t\\n\\x0b\\f\\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def test_query_2(spark, tables, rows):
    df = run(spark, tables, 2)
    assert df.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    texts = {k: t or "" for k, t, *_ in rows}
    order, out = sorted(texts, reverse=True), got(df)
    edited = {}
    for k, nxt in zip(order, [*order[1:], order[0]], strict=True):
        third = len(texts[k]) // 3
        edited[k] = texts[k][: len(texts[k]) - third] + texts[nxt][:third]
        assert (out[k]["n_chars"], out[k]["edited_sha256"]) == (len(texts[k]), hashlib.sha256(edited[k].encode()).hexdigest())
    # fingerprints by hand: Spark hashes every pair of words of every text, plain Python counts the votes
    pairs = [(k, which, i, a, b) for which, some in (("own", texts), ("edited", edited)) for k, t in some.items() for w in [split_words(t)] for i, (a, b) in enumerate(zip(w, [*w[1:], None][: len(w)], strict=True))]
    hashed = spark.createDataFrame(pairs, "k long, which string, i int, a string, b string").select("k", "which", F.xxhash64("a", "b").alias("h"), F.xxhash64(F.xxhash64("a", "b")).alias("g")).collect()
    votes_of = {}
    for r in hashed:
        votes_of.setdefault((r["which"], r["k"]), []).append((r["h"] % 2**64, r["g"] % 2**64))
    bits = lambda h: sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    prints = {key: "".join(f"{bits(x):016x}" for x in zip(*v, strict=True)) for key, v in votes_of.items()}
    none = "0" * 32
    like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    distinct = {prints.get(("own", k), none) for k in texts}
    for k, nxt in zip(order, [*order[1:], order[0]], strict=True):
        own, other, behind = prints.get(("own", k), none), prints.get(("edited", k), none), prints.get(("own", nxt), none)
        assert (out[k]["fingerprint"], out[k]["edited_fingerprint"]) == (own, other)
        assert math.isclose(out[k]["near_edited"], like(own, other)) and math.isclose(out[k]["near_next"], like(own, behind))
        assert out[k]["n_near"] == (sum(0 < (int(own, 16) ^ int(x, 16)).bit_count() <= fingerprints.RADIUS for x in distinct) if k % 50 == 0 else None)


@pytest.mark.parametrize("number, modulus, remainder", [(3, 5, 0), (9, 4, 2)])
def test_queries_3_and_9(spark, tables, rows, number, modulus, remainder, tmp_path):
    df = run(spark, tables, number)
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and [t for _, t in df.dtypes[:4]] == ["bigint", "boolean", "double", "int"]
    out = got(df)
    assert len(out) == len(rows)
    for k, r in out.items():
        assert r["held_out"] == (crc(k, modulus) == remainder) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    # labels of held-out rows, and any row's language, source and id, tell nothing
    import shutil

    shutil.copytree(tables, tmp_path / "t")
    shutil.rmtree(tmp_path / "t" / "labels.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    held = lm.held_out("doc_id", modulus, remainder)
    labels.select("doc_id", *(F.when(held, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic"))).write.parquet(str(tmp_path / "t" / "labels.parquet"))
    assert {k: r["score"] for k, r in got(run(spark, str(tmp_path / "t"), number)).items()} == {k: r["score"] for k, r in out.items()}


def test_query_4(spark, tables, rows):
    df = run(spark, tables, 4)
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    seen, out = {}, got(df)
    for k, t, *_ in sorted(rows):
        data = (t or "").encode()
        for i in range(len(data) - 99):
            seen.setdefault(data[i : i + 100], (k, i))
    for k, t, *_ in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if seen[data[i : i + 100]] != (k, i):
                gone[i : i + 100] = b"\x01" * 100
        runs = len(re.findall(b"\x01+", bytes(gone)))
        assert (out[k]["n_bytes"], out[k]["n_removed"], out[k]["n_spans"], out[k]["kept_sha256"]) == (len(data), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(data, gone, strict=True) if not g)).hexdigest())


def test_query_5(spark, tables, rows):
    df = run(spark, tables, 5)
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    prints = {k: fingerprint(t) for k, t, *_ in rows}
    want = classes_by_hand(prints)
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got(df).items()} == {k: (f"{prints[k]:016x}", want[k]) for k in prints}


def test_queries_6_and_8(spark, tables, rows):
    t, ids = reference(rows)
    six, eight = run(spark, tables, 6), run(spark, tables, 8)
    assert six.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and eight.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert {k: r["ids_sha256"] for k, r in got(six).items()} == {k: hashlib.sha256(array("I", i).tobytes()).hexdigest() for k, i in ids.items()}
    assert {k: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for k, r in got(eight).items()} == {k: (len((x or "").encode()), len(ids[k]), len(ids[k]) > 1024) for k, x, *_ in rows}


def test_query_7(spark, tables):
    df = run(spark, tables, 7)
    assert df.columns == ["query_id", "rank", "vec_id", "score"] and [t for _, t in df.dtypes] == ["bigint", "int", "bigint", "bigint"]
    some = {r["vec_id"]: [math.floor(64 * float(x)) for x in r["embedding"]] for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect() if r["embedding"] and all(map(math.isfinite, r["embedding"]))}
    want = {(q, i + 1, c, -s) for q in some if q % 20 == 0 for i, (s, c) in enumerate(sorted((-sum(a * b for a, b in zip(some[q], v, strict=True)), c) for c, v in some.items() if c != q)[:20])}
    assert {tuple(r) for r in df.collect()} == want


# odd tables


def test_columns_that_clash_and_a_very_long_text(spark):
    """Columns named as the operators' own, and a document of 3 MB."""
    rnd = random.Random(9)
    long = " ".join(f"w{rnd.randrange(4000)}" for _ in range(500_000))
    assert len(long) > 2_500_000
    some = [(1, long), (2, long + " end"), (3, LINE), (4, LINE), (5, None), (6, "")]
    names = ["full", "whole", "upto", "mix_tokens", "mix_source", "mix_key", "mix_block", "toxicity_score", "near_copy_hash", "near_copy_place", "dedup_doc", "dedup_text", "left", "key", "node", "hash", "row", "segment"]
    df = spark.createDataFrame(some, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(3).cast("long").alias("n_chars"), *(F.lit(f"own {n}").alias(n) for n in names))
    ours = lambda out: all(r[n] == f"own {n}" for r in out.select(*names).collect() for n in names)
    mixed = mixing.mix(df, repeats=1.5, budget_share=None)
    assert mixed.columns[: len(df.columns)] == df.columns and mixed.count() == 6 and ours(mixed)
    scored = toxicity.scored(df, toxicity.fit([("you idiot " * 3, 1), ("a fine day", 0)]), "tox")
    assert scored.columns == [*df.columns, "tox"] and ours(scored)
    with pytest.raises(ValueError):
        toxicity.scored(df, toxicity.fit([]))
    kept = near_copies.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [1, 3, 5] and ours(kept)
    rest = suffix_dedup.dedup(df)
    left = {r["doc_id"]: r["text"] or "" for r in rest.collect()}
    assert rest.columns == df.columns and ours(rest) and left[1] == long and left[2].endswith(" end") and len(left[2]) < 110 and left[3] == LINE and left[4] == ""
    few = df.select("doc_id", "text", "key", "node", "hash", "row", "segment")
    assert got(simhash_dedup.classes(few))[2]["component_id"] == 1
    assert got(fst_count.token_counts(few, queries.vocabulary()))[1]["n_tokens"] == got(bpe_reuse.digest(few, queries.vocabulary()))[1]["n_tokens"]
    assert got(lm.score(few, lm.fit(few)))[1]["n_tokens"] == 500_001
    assert fingerprints.compare(few).count() == 6


def test_near_copies_match_brute_force(spark):
    """Groups by five-word shingles at 0.8, over edits of all sizes, copies that only share a passage, and short texts."""
    rnd = random.Random(12)
    word = lambda: f"v{rnd.randrange(3000)}"
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rnd.choice((6, 12, 40, 150)))]
        for _ in range(4):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + len(w) // 12)):
                w[rnd.randrange(len(w))] = word()
            texts.append(" ".join(w))
    shared = [word() for _ in range(60)]
    texts += [" ".join(shared + [word() for _ in range(50)]) for _ in range(30)] + ["a b", "A  b", "", None, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in map(words, texts)]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in near_copies.keep_one(df).collect()) == sorted({find(k) for k in range(len(texts))})


def test_cells_of_many_texts_are_dealt_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    rnd = random.Random(13)
    shared = [f"s{k}" for k in range(300)]
    texts = [" ".join(shared[: 200 + 4 * k] + [f"x{k}y{i}" for i in range(100)]) for k in range(24)]
    texts += [t + " more" for t in texts[3:20]]
    rnd.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = {}
    for k, t in enumerate(texts):
        names.setdefault(t.removesuffix(" more"), k)
    assert sorted(r["doc_id"] for r in near_copies.keep_one(df).collect()) == sorted(names.values())


def test_unreachable_targets_of_mixing(spark):
    even = spark.createDataFrame([(k, "w " * 10, f"s{k % 4}") for k in range(400)], "doc_id long, text string, source string")
    assert Counter(r["source"] for r in mixing.mix(even, entropy=0.9).collect()) == {f"s{k}": 100 for k in range(4)}
    nearly = spark.createDataFrame([(k, "w " * (100 if k % 4 else 101), f"s{k % 4}") for k in range(400)], "doc_id long, text string, source string")
    by = mixing.shares(nearly.select("source", mixing.n_tokens(F.col("text")).alias("n_tokens")))
    a = mixing.exponent(by, entropy=0.97, budget_share=1.0)
    assert a > 8
    share = [100 * 101 / (100 * 401), *[100 * 100 / (100 * 401)] * 3]
    w = [(x / max(share)) ** a for x in share]
    assert math.isclose(-sum(x / sum(w) * math.log(x / sum(w)) for x in w) / math.log(4), 0.97, abs_tol=1e-4)
