"""The whole pipeline against a brute-force version of what each stage must do, on a small corpus with labels."""

import base64
import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import pytest

import corpus_pipeline
from fragmill.llm import quality

MAIL = re.compile(r"[\w.]+@[\w.]+\w")


def corpus():
    """(rows of documents, rows of labels, ids that quality must reject)."""
    draw = random.Random(5)
    prose = lambda n: " ".join("".join(draw.choices("abcdefghij", k=7)) for _ in range(n))
    texts, labels, bad = {}, {}, set()
    for i in range(160):  # enough good texts for a bound: 0.95 ** 160 < 0.05 / 20
        texts[i], labels[i] = prose(12 + i % 9), 1
    for i in range(160, 190):
        texts[i], labels[i] = prose(10) + " #" * 10, 0
        bad.add(i)
    texts[190] = prose(12) + " #" * 3  # unlabelled, below the bad ones
    texts[191] = prose(10) + " #" * 15  # unlabelled, above them
    texts[192], texts[193], texts[194] = None, "few words", "again and again it says " * 20
    bad |= {191, 192, 193, 194}
    base = prose(200)
    texts |= {200: base, 201: base, 202: base + " tail", 203: "head " + base.title()}
    chain = prose(100).split()
    texts |= {210 + k: " ".join(chain[k * 8 : k * 8 + 60]) for k in range(5)}  # neighbours overlap, too little for a link
    texts[220] = prose(20) + " write to bob.miller@example.org today"
    texts[221] = prose(30) + " or bob.miller@example.org and eve.stone@example.org too"
    rows = [(i, t, "en", ["a", "b", "c", None][i % 4], len(t or "")) for i, t in texts.items()]
    rows += [(None, texts[0] + " more", "en", "a", 0), rows[5]]
    return rows, labels, bad


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def classes(texts):
    """The classes of positions under links of 75 in 100."""
    sets, of = [shingles(t) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and 100 * common >= 75 * len(sets[i] | sets[j]) and of[i] != of[j]:
            of = [of[i] if x == of[j] else x for x in of]
    return of


def targets(sizes):
    """Weights 5, 2, 1 by source, null last; 150% of all; at most twice a source's size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights, left, want = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), {}
    while weights:
        share = {s: left * w / sum(weights.values()) for s, w in weights.items()}
        full = [s for s in weights if share[s] > 2 * sizes[s]]
        want |= {s: 2 * sizes[s] for s in full} if full else share
        left -= sum(2 * sizes[s] for s in full)
        weights = {s: w for s, w in weights.items() if s not in full} if full else {}
    return want


def test_pipeline_equals_brute_force(spark, tmp_path, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    rows, labels, bad = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen, cut = {}, corpus_pipeline.cut

    def noted(df, name):
        seen[name.removeprefix("stage-")] = out = cut(df, name)
        return out

    monkeypatch.setattr(corpus_pipeline, "cut", noted)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert list(seen) == [name for name, _ in corpus_pipeline.STAGES]
    after = {name: df.collect() for name, df in seen.items()}
    assert all(seen[name].columns == ["doc_id", "text", "lang", "source", "n_chars"] for name in list(seen)[:-1])
    assert quality.RISK == 0.05 and quality.DELTA == 0.05 and quality.GRID == 20

    # Quality: the base rule, and the cutoff that catches all labelled bad texts and no good one.
    good = [r for r in rows if r[0] not in bad]
    assert Counter(map(tuple, after["quality"])) == Counter(good)

    # Near duplicates: one whole row of each class.
    of = dict(zip([(r[0], r[1]) for r in good], classes([r[1] for r in good]), strict=True))
    left = after["near_duplicates"]
    assert sorted(of[r.doc_id, r.text] for r in left) == sorted(set(of.values())) and {tuple(r) for r in left} <= set(good)

    # Surrogates: other texts stay; addresses become others of their form, one for each.
    before, names = {r.doc_id: r.text for r in left}, {}
    assert len(after["pii"]) == len(left)
    for r in after["pii"]:
        assert MAIL.sub("@", r.text) == MAIL.sub("@", before[r.doc_id]) and r.n_chars == len(r.text)
        for old, new in zip(MAIL.findall(before[r.doc_id]), MAIL.findall(r.text), strict=True):
            assert old != new and names.setdefault(old, new) == new
    assert len(names) == 2 == len(set(names.values()))

    # Mixing: whole documents, at most two of each, near the targets.
    given, taken = Counter(map(tuple, after["pii"])), Counter(map(tuple, after["mixing"]))
    assert set(taken) <= set(given) and all(n <= 2 * given[r] for r, n in taken.items())
    sizes, words, longest = Counter(), Counter(), Counter()
    for r, n in given.items():
        sizes[r[3]] += n * len(r[1].split())
        words[r[3]] += taken[r] * len(r[1].split())
        longest[r[3]] = max(longest[r[3]], len(r[1].split()))
    want = targets(sizes)
    assert all(abs(words[s] - want[s]) <= longest[s] for s in want)

    # Tokens: as the library's, and back.
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def coded(r):
        ids = own.encode_ordinary(r[1])
        return r[0], r[2], r[3], len(ids), tuple(ids), hashlib.sha256(r[1].encode()).hexdigest()

    assert Counter((r.doc_id, r.lang, r.source, r.n_tokens, tuple(r.ids), r.decoded_sha256) for r in final) == Counter(map(coded, taken.elements()))
