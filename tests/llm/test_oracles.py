"""The queries that have SQL against it, over whole tables; BPE and fingerprints against the library and brute force."""

import base64
import hashlib
import random

import duckdb
import pytest
import xxhash

from fragmill.llm import bpe, order_minhash, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = registry.queries()[name](spark, SF).select(*names)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def library():
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_of_dense_and_long_texts(spark):
    """A text of words of 240 letters ran out of DuckDB's memory; digests, which the query uses, were not tested."""
    path, pattern, tok = library()
    draw = random.Random(2)
    word = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = [" ".join(word(240) for _ in range(200)), word(100_000), "a" * 5000, "é" * 3000, "aab" * 700, None, "", " ", "x\n\n\ty  z", "tail"] + ["same"] * 3
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids int")
    ids = [tok.encode_ordinary(t or "") for t in texts]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(x), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())) for i, (x, t) in enumerate(zip(ids, texts, strict=True))]
    assert sorted(map(tuple, bpe.digests(docs, path, pattern).collect())) == want
    both = sorted((r.doc_id, r.text, r.ids, r.n_tokens, r.decoded_sha256) for r in bpe.round_trip(docs, path, pattern).collect())
    assert both == [(i, t, x, len(x), w[3]) for (i, t), x, w in zip(enumerate(texts), ids, want, strict=True)]
    empty = docs.where("false")
    assert bpe.digests(empty, path, pattern).collect() == [] and bpe.round_trip(empty, path, pattern).collect() == []


def test_pieces_contracted_one_by_one_and_together_are_equal():
    path, pattern, tok = library()
    codec, draw = bpe.Codec(bpe.read_ranks(path), pattern), random.Random(4)
    pieces = [bytes(draw.choice(b"abent er") for _ in range(draw.randrange(1, 40))) for _ in range(200)]
    want = [codec.contract_long(p) for p in pieces]
    assert codec.contract(pieces) == want
    assert [ids for _, ids, _ in sorted(codec._query(dict(enumerate(pieces)), bpe.ONE))] == want


def brute_bands(text):
    """The fingerprint of a text by plain loops; hashes are xxh64 with seed 42, chained over the parts."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def h(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed)
        return signed(seed)

    number = lambda x, n: (x & ((1 << 8 * n) - 1)).to_bytes(n, "little")
    words = [w for w in (text or "").encode().split()]
    if not words:
        return [None] * order_minhash.BANDS
    seen, bands = {}, {}
    for i in range(max(len(words) - order_minhash.K, 0) + 1):
        k = h(*[words[i + j] if i + j < len(words) else b"" for j in range(order_minhash.K)])
        seen[k] = seen.get(k, -1) + 1
        v = h(number(k, 8), number(seen[k], 4))
        bands.setdefault(v % order_minhash.BANDS, []).append((v >> 5, i, k))
    out = []
    for b in range(order_minhash.BANDS):
        least = sorted(bands.get(b, []))[: order_minhash.LENGTH]
        out.append(h(*[number(k, 8) for _, k in sorted((i, k) for _, i, k in least)]) if least else None)
    return out


def test_order_minhash_equals_brute_force(spark):
    draw = random.Random(9)
    some = lambda n: " ".join(draw.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(n))
    texts = {7: some(80), 5: some(300), 4: None, 3: "one", 2: "", 1: some(12)}
    rows = [(d, t, 1, "x") for d, t in texts.items()] + [(5, texts[5], 2, "y"), (5, texts[5], 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a int, part string")
    order = sorted(((d, t or "") for d, t, _, _ in rows), key=lambda r: -r[0])
    printed = lambda b: ".".join("-" if x is None else f"{x & (1 << 64) - 1:X}" for x in b)

    def near(x, y):
        n = sum(p is not None or q is not None for p, q in zip(x, y, strict=True))
        return 1.0 if n == 0 else sum(p is not None and p == q for p, q in zip(x, y, strict=True)) / n

    want = []
    for (d, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        m = len(t) // 3
        e = t[: len(t) - m] + n[:m]
        f, g, u = brute_bands(t), brute_bands(e), brute_bands(n)
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), printed(f), printed(g), near(f, g), near(f, u)))
    got = order_minhash.edited(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert sorted(map(tuple, got)) == sorted(want)
