"""Merkle manifests, two-tier byte-level BPE and vector codes against plain Python on small tables with odd rows; mixing of many sources; toxicity of few rows and long texts."""

import base64
import hashlib
import math
import os
import random
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from clausework.llm import byte_bpe, merkle, mixing, queries, toxicity, vector_codes

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def framed(*fields):
    return "".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields)


def climb(hashes):
    """The root of a list of nodes, and for each its steps (before, after)."""
    steps, where, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for s, i in zip(steps, range(len(hashes)), strict=True):
            run, at = level[where[i] // 16 * 16 : where[i] // 16 * 16 + 16], where[i] % 16
            s.append(("".join(run[:at]), "".join(run[at + 1 :])))
        where = [w // 16 for w in where]
        level = [sha("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
    return level[0], steps


def manifest_by_hand(rows):
    by, out = {}, []
    for r in rows:
        k, source, lang, n, text = r
        low = text.translate(LOWER) if text is not None and k is not None and zlib.crc32(str(k).encode()) % 5 == 0 else text
        by.setdefault(source, []).append((-1 if k is None else k, sha(framed(k, source, lang, n, text)), sha(framed(k, source, lang, n, low)), k))
    order = sorted(by, key=lambda s: b"" if s is None else b"\x01" + s.encode())
    roots, steps = {}, {}
    for s in order:
        by[s].sort()
        roots[s], steps[s] = climb([x[1] for x in by[s]])
    root, above = climb([roots[s] for s in order])
    for s, up in zip(order, above, strict=True):
        for (_, leaf, now, k), mine in zip(by[s], steps[s], strict=True):
            path = mine + up
            for a, b in path:
                now = sha(a + now + b)
            out.append((k, leaf, roots[s], root, sha("".join(a + b for a, b in path)), now, now == root))
    return out


def some_documents():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abCDé のx") for _ in range(rnd.randrange(1, 9)))
    rows = [(k, rnd.choice(["hot", "hot", "hot", "b", "é", "Z", "", None]), rnd.choice(["en", None]), rnd.choice([k, None]), " ".join(word() for _ in range(rnd.randrange(0, 30)))) for k in range(700)]
    rows += [(k, f"s{k}", "en", 1, "One lone ROW") for k in range(700, 740)]
    return rows + [(1000, "hot", None, None, None), (1005, "hot", "en", 0, ""), (1010, "hot", "en", 9, "MANY Words " * 30_000)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(some_documents(), SCHEMA).repartition(5).write.parquet(str(top / "documents.parquet"))
    rnd = np.random.default_rng(4)
    vectors = [(k * 3 % 701, [float(np.float32(x)) for x in rnd.normal(size=12)], int(k % 3) if k % 4 else None) for k in range(700)]
    vectors += [(2000, None, 1), (2001, [1.0, None] + [0.0] * 10, 1), (2002, [float("inf")] + [0.0] * 11, 1), (2003, [float("nan")] * 12, None), (2004, [0.25] * 12, 7), (2005, [0.25] * 12, 7)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").repartition(4).write.parquet(str(top / "embeddings.parquet"))
    return str(top)


def test_manifest_matches_plain_python(spark, tables):
    df = queries.op11_merkle_manifest(spark, tables)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = manifest_by_hand(some_documents())
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert 0 < sum(not r[-1] for r in want) < len(want) / 4


def test_manifest_of_odd_rows(spark):
    rows = [(None, "a", "x", 1, "t"), (None, "a", "x", 1, "t"), (3, "a", "x", 1, "u"), (3, "a", "x", 2, "u"), (3, "a", "x", 2, "u"), (9, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).select("doc_id", "source", merkle.leaf(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text"))).alias("leaf"), *(F.lit(c).alias(c) for c in ("root", "proof", "hash", "tree", "place", "n", "run", "up", "task", "at", "g", "k", "more")))
    out = merkle.manifest(df)
    assert out.columns == [*df.columns, "subroot", "root_", "proof_"] and all(r["root"] == "root" and r["more"] == "more" for r in out.collect())
    assert sorted((r["leaf"], r["subroot"], r["root_"]) for r in out.collect()) == sorted(x[1:4] for x in manifest_by_hand(rows))
    assert out.filter(merkle.fold(F.col("leaf"), F.col("proof_")) != F.col("root_")).count() == 0
    one = merkle.manifest(df.limit(1).select("doc_id", "source", "leaf")).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof"] == []
    assert merkle.manifest(df.filter("false").select("doc_id", "source", "leaf")).count() == 0


def test_manifest_with_other_runs_and_a_hot_repeated_row(spark):
    rows = [(5, "a", "en", 1, "same")] * 300 + [(k, "b", "en", 1, str(k)) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).select("doc_id", "source", merkle.leaf(F.col("text")).alias("leaf"))
    out = merkle.manifest(df, fan=3)
    assert out.count() == 340 and out.filter(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert {r["n"] for r in out.filter("source = 'a'").select(F.size("proof").alias("n")).collect()} == {7}  # 300 leaves are 6 levels of threes, and one more for the two subroots


# 12


@pytest.fixture(scope="module")
def engine():
    import tiktoken

    with open(queries.vocabulary(queries.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_two_tiers_match_the_library(spark, engine, tmp_path):
    rnd = random.Random(1)
    far = [c for c in (chr(rnd.randrange(0x110000)) for _ in range(400)) if not 0xD800 <= ord(c) < 0xE000]
    pool = [*"abcst  \n\t'reverl 123,.!é日本  ", *far, "'s", "'re", " <|endoftext|>", "\x85", "\x1c", "՘", "꟎", " the", " and"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 200))) for _ in range(1500)]
    texts += ["", None, "a", "x" * 5000, "ab" * 3000, " " * 300, "\n \n", "aaaaaaa" * 50, "hello world " * 100_000, "".join(rnd.choice("abcdefgh") for _ in range(100_000)), "The quick brown fox. " * 3]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.op12_byte_bpe(spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and dict(df.dtypes)["n_tokens"] == "bigint"
    want = {k: engine.encode_ordinary(t or "") for k, t in enumerate(texts)}
    got = {r["doc_id"]: tuple(r)[1:] for r in df.collect()}
    assert got == {k: (len(i), sha(" ".join(map(str, i))), hashlib.sha256(engine.decode_bytes(i)).hexdigest()) for k, i in want.items()}
    out = byte_bpe.encode(spark.read.parquet(str(tmp_path / "documents.parquet")), queries.vocabulary(queries.RANKS)).collect()
    assert {r["doc_id"]: r["ids"] for r in out} == want and all(bytes(r["bytes"]).decode() == (texts[r["doc_id"]] or "") for r in out)


def test_two_tiers_on_odd_tables(spark):
    path = queries.vocabulary(queries.RANKS)
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit(1))
    assert sorted(r["n_tokens"] for r in byte_bpe.digest(odd, path).collect()) == [0, 2, 2, 2]
    assert byte_bpe.digest(odd.filter("false"), path).count() == 0


def test_perfect_hash_is_minimal_and_perfect():
    for n in (1, 2, 3, 5, 100, 20_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        assert sorted(byte_bpe.PerfectHash(keys).of(keys).tolist()) == list(range(len(keys)))


def test_equal_hashes_of_different_pieces(engine, monkeypatch):
    """Bytes decide, not hashes: with all hashes of misses equal the ids are the same."""
    c = byte_bpe.Codec(byte_bpe.ranks_of(queries.vocabulary(queries.RANKS)), byte_bpe.character_classes()).ready()
    text = "zzqqx qqzzx  zzqqx vvxxq qzqzq the wwwq"
    data = np.frombuffer(text.encode(), np.uint8)
    misses = c.misses
    monkeypatch.setattr(c, "misses", lambda d, s, n, keys: misses(d, s, n, np.zeros_like(keys)))
    assert c.encode(data, np.array([0, len(data)]))[0].tolist() == engine.encode_ordinary(text)


# 13


def codes_by_hand(rows, entries=256, rounds=4):
    kept = [(k, [math.floor(1024 * x) for x in v], lab) for k, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    each = len(kept[0][1]) // 4
    cut = lambda v: [v[p * each : (p + 1) * each] for p in range(4)]
    books = [list(x) for x in zip(*(cut(v) for _, v, _ in sorted(kept, key=lambda r: r[:2])[:entries]), strict=True)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            to = {}
            for _, v, _ in kept:
                x = cut(v)[p]
                to.setdefault(near(x, book)[1], []).append(x)
            books[p] = [[sum(c) // len(to[i]) for c in zip(*to[i], strict=True)] if i in to else e for i, e in enumerate(book)]
    out, by = [], {}
    for k, v, lab in kept:
        found = [near(x, book) for x, book in zip(cut(v), books, strict=True)]
        out.append((k, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), lab))
        by[lab] = by.get(lab, 0) + out[-1][2]
    digest = sha(",".join(str(x) for book in books for e in book for x in e))
    return [(k, code, error, by[lab], digest) for k, code, error, lab in out]


def test_codes_match_plain_python(spark, tables):
    df = queries.op13_vector_codes(spark, tables)
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and [t for _, t in df.dtypes] == ["bigint", "string", "bigint", "bigint", "string"]
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    assert sorted(map(tuple, df.collect())) == sorted(codes_by_hand(rows))


def test_nearest_drops_only_what_is_farther():
    rnd = np.random.default_rng(5)
    for d, n, k in ((1, 50, 7), (3, 3000, 256), (4, 10, 1), (5, 500, 256), (16, 400, 256)):
        x, book = rnd.integers(-5, 5, (n, d)), rnd.integers(-5, 5, (k, d))  # many ties
        book[: k // 2] = book[k - k // 2 :]
        far = ((x[:, None] - book) ** 2).sum(2)
        to, least = vector_codes.nearest(x, book)
        assert (to == far.argmin(1)).all() and (least == far.min(1)).all()


def test_codes_of_odd_tables(spark):
    rows = [(None, [1.0] * 8, None), (4, [2.0] * 8, 1), (4, [1.0] * 8, 1), (4, [1.0] * 8, 1), (2, [-1.0] * 8, 1), (1, [], 2), (0, [5.0] * 7, 2), (3, [-1e30] * 8, 2), (7, [1.0] * 12, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x")).withColumn("vector", F.lit("x"))
    out = {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.compress(df).collect()}
    assert (3, None, None, None) in out and (1, None, None, None) in out and (7, None, None, None) in out and len(out) == 8
    assert (None, "02020202", 0, 0) in out or any(k is None and e == 0 for k, _, e, _ in out)
    books = vector_codes.fit(vector_codes.prepared(df.select("vec_id", "embedding")))
    assert vector_codes.decoded("00010203", books) == [int(x) for p in range(4) for x in books[p][p]]
    none = vector_codes.compress(df.filter("false"))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.compress(df.filter("vec_id = 1")).first()["code"] is None


# sources and lengths


@pytest.mark.parametrize("bound", [1, 2])
def test_mixing_of_more_sources_than_are_broadcast(spark, monkeypatch, bound):
    rows = [(k, "w " * (1 + k * 7 % 13), f"s{k % 2 if k % 3 else k % 11}" if k % 17 else None) for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 8)
    drawn = lambda: sorted(tuple(r) for r in mixing.mix(df, entropy=0.9, repeats=3.0).select("doc_id", "mix_epoch", "mix_order").collect())
    want = drawn()
    assert len(want) > 1000
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", bound)
    assert drawn() == want


def test_mixing_does_not_shuffle_texts(spark):
    df = spark.createDataFrame([(k, "w " * 9, f"s{k % 3}") for k in range(300)], "doc_id long, text string, source string")
    plan = mixing.mix(df, repeats=2.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_toxicity_score_matches_brute_force():
    rows = [(f"{w} day number {k} was {'you id-iot go' if k % 4 == 0 else 'quiet and fine'} at {w}", int(k % 4 == 0)) for k, w in enumerate(("green", "blue", "plain", "warm", "cold") * 16)]
    model = toxicity.fit(rows)
    assert model.weights.any()
    for text in ("", "id", "you idiot", "a fine day. " * 60 + "what an i d i o t", "you id.iot and more " * 9):
        code = [int(c) for c in toxicity.encode([text])[0]]
        at = []
        for i in range(len(code) - toxicity.SPAN + 1):
            pairs = ((i + a, i + b) for a in range(1, toxicity.SPAN) for b in range(a + 1, toxicity.SPAN))
            at.append(sum(toxicity.DECAY ** (k - i + 1) * float(model.weights[code[i] << 12 | code[j] << 6 | code[k]]) for j, k in pairs))
        tops = [max(0.0, *(sum(at[i : i + n]) for i in range(len(at)))) for n in (toxicity.SHORT, toxicity.REACH)]
        length = math.log(min(max(len(text), 500), 20_000) / 500)
        z = sum(w * x for w, x in zip(model.link, [*tops, length, 1.0], strict=True))
        assert math.isclose(model.score([text])[0], 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-3, abs_tol=1e-6)


@pytest.mark.parametrize("toxic, least", [(40, 0.84), (100, 0.93), (300, 0.93)])
def test_toxicity_learns_from_few_rows(toxic, least):
    """Held-out rows of the generated table, learning from so many toxic rows and nine times as many others; somewhat less than measured."""
    import pandas as pd

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no generated tables")
    rows = pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id", "text"]).merge(pd.read_parquet(f"{folder}/labels.parquet", columns=["doc_id", "toxic"]), on="doc_id")
    rows = sorted((zlib.crc32(str(i).encode()), t or "", int(v)) for i, t, v in rows.itertuples(index=False))
    fit_on = [(t, v) for h, t, v in rows if h % 4 != 2]
    model = toxicity.fit([r for r in fit_on if r[1]][:toxic] + [r for r in fit_on if not r[1]][: 9 * toxic])
    out = [(t, v) for h, t, v in rows if h % 4 == 2]
    scores = model.score([t for t, _ in out])
    good = sorted(s for s, (_, v) in zip(scores, out, strict=True) if not v)
    bad = [s for s, (_, v) in zip(scores, out, strict=True) if v]
    assert sum(bisect_left(good, s) + bisect_right(good, s) for s in bad) / 2 / len(good) / len(bad) >= least
    if toxic == 300:
        long = [s for s, (t, v) in zip(scores, out, strict=True) if not v and len(t) > 3000]
        assert sum(s >= queries.THRESHOLD for s in long) <= 0.07 * len(long)  # 9.3 % where the length doesn't count
