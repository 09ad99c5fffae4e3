"""Queries that do their whole job, against brute force on small tables."""

import random
import re
from collections import Counter

from lectern.functions.similarity import lcs
from lectern.operators import rules
from lectern.queries import registry

SEG = "video_id bigint, id bigint, start_s double, end_s double, text string, avg_logprob double, no_speech_prob double, compression_ratio double"
RULE_TABLE = [(1, "rao 53", "Route 53", "literal", True, ["dns"]), (2, "lam da", "Lambda", "literal", False, None), (3, "vi pi si", "VPC", "literal", True, None)]
TERMS = ["CloudFront", "Lambda"]


def tables(spark, folder, rows):
    spark.createDataFrame(rows, SEG).write.parquet(f"{folder}/segments_raw.parquet")
    spark.createDataFrame(RULE_TABLE, "rule_id bigint, from_text string, to_text string, match_kind string, auto boolean, requires_context array<string>").write.parquet(f"{folder}/correction_rules.parquet")
    spark.createDataFrame([(1, 1, TERMS)], "glossary_id bigint, version bigint, terms array<string>").write.parquet(f"{folder}/glossary_files.parquet")
    return folder


def fixed(texts):
    """Spelled and corrected in order; the text before is corrected, the one behind as it came."""
    made, out = rules.Rules([rules.Rule(a, b, True, auto, list(c or [])) for _, a, b, _, auto, c in RULE_TABLE]), []
    for i, t in enumerate(texts):
        out.append(made.fix(out[-1] if out else "", rules.Speller(TERMS).spell(t)[0], texts[i + 1] if i + 1 < len(texts) else "")[0])
    return out, made


def near_miss(text):
    """Each run of one to three words against each term, as the reference's service does."""
    words, known = rules.folded(text).split(), [rules.folded(t) for t in TERMS]
    runs = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return any(r not in known and 78 <= 200 * lcs(r, t) / (len(r) + len(t)) < 100 for r in runs for t in known)


def flags(row, text, before, behind, made):
    _, _, start, end, _, logprob, nospeech, ratio = row
    t, seconds = text.strip(), max(end - start, 0.001)
    checks = {
        "LOW_LOGPROB": logprob is not None and logprob < -0.7, "HIGH_NOSPEECH": nospeech is not None and nospeech > 0.6, "HIGH_COMPRESSION": ratio is not None and ratio > 2.4,
        "REPETITION": re.search(r"(?i)\b(\w+(?:\s+\w+)?)\b(?:\s+\1\b){3,}", t), "FAST_TEXT": len(t) / seconds > 25, "SHORT_SEGMENT": seconds < 0.35 and len(t) > 12,
        "GLOSSARY_NEAR_MISS": near_miss(t), "CORRECTION_CANDIDATE": made.candidates(before, text, behind),
    }
    return [k for k, x in checks.items() if x]


def test_flags_of_all_checks_reach_counts_and_batches(spark, tmp_path):
    rng = random.Random(7)
    parts = ["xin chào", "hay hay hay hay", "lam da", "gọi lamda", "rao 53", "dns", "vi pi si", "cloudfront", "cloudfronts", "một bài"]
    rows = [
        (v, i, 0.0, rng.choice([0.3, 9.0, 9.0, 9.0]), " ".join(rng.sample(parts, rng.randint(1, 2))), rng.choice([None, -0.1, -0.1, -0.8]), rng.choice([None, 0.1, 0.1, 0.7]), rng.choice([None, 1.0, 1.0, 2.5]))
        for v in range(5) for i in range(60)
    ]
    want = {}
    for v in range(5):
        own = [r for r in rows if r[0] == v]
        texts, made = fixed([r[4] for r in own])
        for i, r in enumerate(own):
            want[v, i] = flags(r, texts[i], texts[i - 1] if i else "", texts[i + 1] if i + 1 < len(own) else "", made)
    alone = {f for x in want.values() if len(x) == 1 for f in x}
    assert {"REPETITION", "GLOSSARY_NEAR_MISS", "CORRECTION_CANDIDATE"} <= alone
    sf, q = tables(spark, str(tmp_path), rows), registry.QUERIES
    assert {(r.video_id, r.id): r.flags.split(",") for r in q["all_segment_flags"](spark, sf).collect()} == {k: x for k, x in want.items() if x}
    counts = Counter((v, f) for (v, _), x in want.items() for f in x)
    assert {(r.video_id, r.flag): r.n for r in q["all_flag_counts"](spark, sf).collect()} == counts
    top = {}
    for v in range(5):
        first = {}
        for i in range(60):
            for k, f in enumerate(want[v, i]):
                first.setdefault(f, (i, k))
        ranked = sorted(first, key=lambda f: (-counts[v, f], first[f]))[:3]
        top |= {(v, n + 1): (f, counts[v, f]) for n, f in enumerate(ranked)}
    assert {(r.video_id, r["rank"]): (r.flag, r.n) for r in q["all_top_flags"](spark, sf).collect()} == top
    batches = {}
    for v in range(5):
        ids = [i for i in range(60) if want[v, i]]
        batches |= {(v, b // 10): (len(ids[b : b + 10]), ids[b], ids[b : b + 10][-1]) for b in range(0, len(ids), 10)}
    assert {(r.video_id, r.batch): (r.n, r.first_id, r.last_id) for r in q["all_llm_batches"](spark, sf).collect()} == batches
