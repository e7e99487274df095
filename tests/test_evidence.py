"""Evidence of a hundred questions against a plain model of the rules, one question and one chunk at a time."""

import random
import re

import numpy as np
import pytest

from factloom.operators import graph, retrieval
from factloom.operators.index import Index, hashed_vectors
from factloom.plans import questions as plans

STOP = "what which show give about from with this that the and for how much".split()
METRICS = "ebit ebitda revenue margin cash fcf capex volume guidance profit".split()
TIMES = [r"\b\d+\s+years?\s+(?:before|after)\b", r"\btakes place\b.{0,80}\b\d+\s+years?\b", r"\bset\b.{0,80}\b\d+\s+years?\b"]
PLACES = ["Ketterby harbour", "Sundmoor terminal", "Vostra pier", "Haldrup lighthouse", "Arnsby dock"]


def words(text, stop):
    return [t for t in re.findall(r"[a-z0-9]{2,}", text.lower()) if t not in stop]


def time_score(text):
    return min(1.0, sum(0.34 for p in TIMES if re.search(p, text, re.I)))


def covers(anchor, text):
    a, t = anchor.lower(), text.lower()
    toks = words(a, STOP)
    return round((1.5 if a in t else 0.0) + (min(1.0, sum(k in t for k in toks) / len(toks)) if toks else 0.0), 6)


def corpus():
    rng = random.Random(4)
    say = ["The {p} opened {n} years before the {q}.", "Revenue of the {p} rose in 2014.", "The margin at {p} fell.", "Ships call at the {p} and the {q}.", "Guidance for {q} is set about {n} years ahead."]
    texts = [" ".join(rng.choice(say).format(p=rng.choice(PLACES), q=rng.choice(PLACES), n=rng.randint(2, 90)) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    asked = [f"How many years are between {a} and {b}?" for a in PLACES for b in PLACES if a != b]
    asked += [f"What was the {m} of {p} in {y}?" for m in ("revenue", "margin", "cargo") for p in PLACES for y in (2014, 2015, 2016)]
    asked += [f"Compare {a} vs {b}" for a in PLACES for b in PLACES if a != b] + ["Show guidance", "Why did profit fall?", "the difference in years between the moon and Vostra pier", "is it open", "zzz"] + [f"{p} opened" for p in PLACES] + ["Ships"]
    return texts, asked


def expected(text, question, intent, canonical, texts, vectors, query, nodes, edges, k=8):
    """(ids, coverage, temporal, confidence, graph lines) of one question."""
    low = intent["normalized_question"].lower()
    toks = words(low, STOP)
    scored = [((5 if n.lower() in low or low in n.lower() else 0) + sum(t in n.lower() for t in toks), n) for n in nodes]
    hits = [n for s, n in sorted((x for x in scored if x[0] > 1), key=lambda x: (-x[0], x[1]))[:8]]
    anchors = list(intent["comparison_anchors"])
    entities = (hits + [a for a in anchors if a.lower() not in {h.lower() for h in hits}])[:8]
    metrics = [m for m in METRICS if m in low]
    # dense and sparse scores of the canonical text
    dense = vectors @ query / (np.linalg.norm(vectors, axis=1) * (np.linalg.norm(query) + 1e-8) + 1e-8)
    docs = [words(t, "the and for with this that".split()) for t in texts]
    terms = {t for d in docs for t in d}
    raw = {t: np.log(len(docs) - sum(t in d for d in docs) + 0.5) - np.log(sum(t in d for d in docs) + 0.5) for t in terms}
    mean, avg = np.mean(list(raw.values())), np.mean([len(d) for d in docs])
    asked = words(canonical, "the and for with this that".split())
    sparse = np.array([sum((raw[t] if raw[t] >= 0 else 0.25 * mean) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in asked if t in d) for d in docs])
    best = lambda s, n: sorted((i for i in range(len(s))), key=lambda i: (-s[i], i))[:n]
    near = {a: [i for i in best([covers(a, t) for t in texts], 6) if covers(a, texts[i]) > 0.30] for a in anchors}
    tagged = {i for i, t in enumerate(texts) if any(m in words(t, ()) for m in metrics) or any(e.lower() in (w.lower() for w in re.findall(r"\b[A-Z][A-Za-z0-9&\.\-]{2,}\b", t)) for e in entities)}
    prior = tagged | {i for ids in near.values() for i in ids}
    shared = [i for i in best(sparse, len(texts)) if any(t in docs[i] for t in asked)][:16]
    found = sorted(set(best(dense, 16)) | set(shared) | prior)
    scale = lambda s: (s - s.min()) / (s.max() - s.min() + 1e-8)
    d, s = scale(dense), scale(sparse)
    blend = {}
    for i in found:
        t = texts[i]
        bonus = 0.06 * sum(e.lower() in t.lower() for e in entities) + 0.05 * sum(m in t.lower() for m in metrics) + (0.08 if i in prior else 0)
        bonus += sum(0.10 if i in near[a] else 0.05 if covers(a, t) >= 0.75 else 0 for a in anchors) + min(0.18, 0.18 * time_score(t))
        blend[i] = 0.56 * d[i] + 0.34 * s[i] + min(0.35, bonus)
    left, taken = sorted(found, key=lambda i: (-blend[i], i)), []
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    while left and len(taken) < k:
        gain = [0.72 * blend[i] - 0.28 * max((unit[i] @ unit[j] for j in taken), default=0.0) for i in left]
        taken.append(left.pop(int(np.argmax(gain))))
    must = []
    for a in sorted(anchors):
        if near[a] and not any(covers(a, texts[i]) >= 0.65 for i in taken) and near[a][0] not in taken:
            taken.append(near[a][0])
            must.append(near[a][0])
    while len(taken) > k:
        taken.remove(min([i for i in taken if i not in must] or taken, key=blend.get))
    lines = []
    for e in entities:
        for u, p, v in [x for x in edges if x[0] == e] + [x for x in edges if x[2] == e]:
            if (line := f"{u} -[{p}]-> {v}") not in lines:
                lines.append(line)
    held = {a: [i for i in taken if covers(a, texts[i]) >= 0.65] for a in anchors}
    coverage = sum(bool(x) for x in held.values()) / len(anchors) if anchors else 1.0
    temporal = sum(any(time_score(texts[i]) > 0 for i in x) for x in held.values()) / len(anchors) if anchors else min(1.0, np.mean([time_score(texts[i]) for i in taken])) if taken else 0.0
    marks = len(set(taken)) + bool(lines)
    conf = 0.45 * np.mean([min(1.0, blend[i]) for i in taken]) + 0.20 * min(1.0, marks / max(2, k)) + 0.20 * coverage + 0.15 * temporal
    if intent["requires_derivation"] and coverage < 1:
        conf = min(conf, 0.35)
    if intent["requires_derivation"] and temporal < 0.30:
        conf = min(conf, 0.45)
    return taken, coverage, temporal, max(0.0, min(1.0, conf)), lines[:110], entities, metrics


def test_evidence_equals_the_model(spark, tmp_path):
    texts, asked = corpus()
    assert len(asked) >= 90
    c = spark.createDataFrame([(i, f"c{i}", "s", t) for i, t in enumerate(texts)], "pos long, chunk_id string, source_id string, text string")
    q = spark.createDataFrame(list(enumerate(asked)), "qid int, question string")
    triples = [(PLACES[i % 5], "near", PLACES[(i + 2) % 5] if i % 3 else f"Quay {i}") for i in range(12)]
    e = spark.createDataFrame([(i, *t, "") for i, t in enumerate(triples)], "seq long, src string, label string, dst string, source_ref string")
    nodes = graph.node_degrees(e).select("id")
    index = Index.build(c, str(tmp_path / "index"))
    got = {r["qid"]: r for r in retrieval.evidence(q, index, e, nodes).collect()}
    intents = {r["qid"]: r for r in plans.with_intent(q).collect()}
    vectors = np.array([r["embedding"] for r in index.vectors.orderBy("pos").collect()], float)
    canonical = hashed_vectors(retrieval.canonical_questions(q), "question").collect()
    query = {r["qid"]: (r["question"], np.array(r["embedding"], float)) for r in canonical}
    names = sorted(r["id"] for r in nodes.collect())
    assert len(got) == len(asked)
    for i, text in enumerate(asked):
        taken, coverage, temporal, conf, lines, entities, metrics = expected(text, text, intents[i], query[i][0], texts, vectors, query[i][1], names, triples)
        r = got[i]
        assert (r["entity_hits"], r["metric_hits"]) == (entities, metrics), text
        assert r["chunk_ids"] == [f"c{x}" for x in taken], text
        assert r["graph_lines"] == lines, text
        assert (r["anchor_coverage"], r["temporal_signal"]) == (pytest.approx(coverage, abs=1e-6), pytest.approx(temporal, abs=1e-6)), text
        assert r["confidence"] == pytest.approx(conf, abs=2e-6), text
        assert r["derivation_ready"] == pytest.approx(min(coverage, temporal), abs=1e-6)
        assert r["context_citation_ids"] == r["chunk_ids"] and r["allowed_citations"][0] == ("[Graph]" if lines else f"[Chunk c{taken[0]}]")
    # a derivation keeps its own anchors, though chunks are scored by its canonical text
    assert got[0]["entity_hits"][-1] in PLACES and "before after years" in got[0]["canonical_query"]
