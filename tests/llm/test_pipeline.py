"""The pipeline's rows against a version of all five stages in plain Python, on a small table."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kmerloom.llm import op8_cnn, op10_rules
from tests.llm.test_operators import SF, brute_copies, brute_rules, groups_of, words

N_RULES = len(op10_rules.RULES)


def votes(text):
    n, chars, symbols, dup, again = brute_rules(text)
    raw, letters, some = (text or "").encode(), max(chars, 1), max(n, 1)
    lines = sum(bool(words(x)) for x in (text or "").split("\n"))
    solid = [b for b in raw if b not in b" \t\n\x0b\x0c\r"]
    is_letter = [65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in solid]
    x = {
        "n_words": n, "symbol_share": symbols / letters, "dup_line_share": dup / max(lines, 1), "repeat_share": again / some,
        "capital_share": sum(65 <= b <= 90 for b in raw) / letters, "mark_share": sum(b in b"!?" for b in raw) / some,
        "letter_share": sum(is_letter) / max(len(solid), 1), "plain_share": sum(bool(re.match(op10_rules.PLAIN, w)) for w in words(text)) / some,
        "mean_word": chars / some,
    }
    out = []
    for name, (low, high), good in op10_rules.RULES:
        v = x[name]
        out.append(0 if v < low or v > high else 2 if good and good[0] <= v <= good[1] else 1)
    return tuple(out), n < 10 or 100 * again > 20 * n


def posterior(seen):
    """Expectation-maximisation over documents, one at a time."""
    start = [[0.5, 0.25, 0.25], [0.02, 0.53, 0.45]]
    odds, share = [[list(start[c]) for _ in range(N_RULES)] for c in (0, 1)], 0.8
    counts = Counter(seen)
    for _ in range(50):
        p = {}
        for v in counts:
            like = [math.prod(odds[c][r][v[r]] for r in range(N_RULES)) for c in (0, 1)]
            p[v] = like[1] * share / (like[1] * share + like[0] * (1 - share))
        share = min(0.98, max(0.02, (sum(counts[v] * p[v] for v in counts) + 1) / (len(seen) + 2)))
        for c in (0, 1):
            weight = {v: counts[v] * (p[v] if c else 1 - p[v]) for v in counts}
            for r in range(N_RULES):
                for o in range(3):
                    odds[c][r][o] = (sum(w for v, w in weight.items() if v[r] == o) + 2 * start[c][o]) / (sum(weight.values()) + 2)
        for r in range(N_RULES):
            rare = min(odds[1][r][0], odds[0][r][0] / 2)
            scale = (1 - rare) / (1 - odds[1][r][0])
            odds[1][r] = [rare, odds[1][r][1] * scale, odds[1][r][2] * scale]
    return p


def by_rules(docs):
    judged = [votes(d["text"]) for d in docs]
    p = posterior([v for v, failed in judged if not failed])
    return [d for d, (v, failed) in zip(docs, judged) if not failed and p[v] >= 0.5]


def convolved(net, text):
    """The network's score, place by place."""
    raw = bytes(op8_cnn.WIDTH - 1) + text.encode()
    halves = max(2, math.ceil(len(raw) / op8_cnn.HALF))
    raw += bytes(halves * op8_cnn.HALF + op8_cnn.WIDTH - 1 - len(raw))
    place = np.stack([sum(net.taps[o][raw[i + o]].astype(float) for o in range(op8_cnn.WIDTH)) + net.bias for i in range(halves * op8_cnn.HALF)])
    chunks = np.stack([place[k * op8_cnn.HALF : (k + 2) * op8_cnn.HALF].max(0) for k in range(halves - 1)])
    chunks = np.maximum(chunks, 0)
    return 1 / (1 + math.exp(-float(np.concatenate([chunks.mean(0), chunks.max(0)]) @ net.dense + net.shift)))


def by_network(docs, labels):
    known = {r["doc_id"]: r["quality"] for r in labels if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    fit = sorted((d["doc_id"], known[d["doc_id"]], d["text"]) for d in docs if d["doc_id"] in known and len(d["text"].encode()) <= op8_cnn.FIT_BYTES)
    assert len(known) <= op8_cnn.FIT_ROWS
    net = op8_cnn.Network().fit([t for _, _, t in fit], np.array([y for _, y, _ in fit], np.float32))
    return [d for d in docs if convolved(net, d["text"]) >= 0.3]


def by_similarity(docs):
    sets = []
    for d in docs:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), d["text"]))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    at = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            at[x].add(i)
    pairs = {(i, j) for held in at.values() for i in held for j in held if i < j}
    root = groups_of(len(docs), [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    least = {g: min(d["doc_id"] for d, r in zip(docs, root) if r == g) for g in root}
    return [d for d, g in zip(docs, root) if d["doc_id"] == least[g]]


def by_mix(docs):
    copies = brute_copies([(d["doc_id"], d["text"], d["source"]) for d in docs])
    return [d for d, (_, _, _, n) in zip(docs, copies) for _ in range(n)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage kept, from the rows that the one before kept."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def ids(rows):
    return Counter(r["doc_id"] for r in rows)


def test_stages_against_brute_force(spark, stages):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k, step in enumerate((by_rules, lambda d: by_network(d, labels), by_similarity, by_mix)):
        docs = step(docs)
        assert ids(stages[k]) == ids(docs), corpus_pipeline.STAGES[k][0]
    want = Counter()
    for d in docs:
        piece = np.array(whole.encode(d["text"], add_special_tokens=False).ids + [0], "<u4")
        want.update((d["doc_id"], i // 2048, i, len(piece[i : i + 2048]), zlib.crc32(piece[i : i + 2048].tobytes())) for i in range(0, len(piece), 2048))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in stages[-1]) == want
