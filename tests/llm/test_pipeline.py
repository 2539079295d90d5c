"""Every stage of the pipeline on what its predecessor kept. The classifier's decisions are held against the ranks of its
operator, which has a held-out test of its own; all other stages against brute force."""

import random
import re
from collections import Counter

import pytest
public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from foliant.llm import quality  # noqa: E402
from foliant.llm.common import LOWER, batches, materialise  # noqa: E402

GOOD = "river mountain forest evening letter garden winter music window harbour morning bridge".split()
BAD = "buy cheap click now free deal win cash offer sale bonus prize".split()


def fixture():
    rng = random.Random(8)
    prose = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(GOOD, rng.randrange(20, 200)) for _ in range(60)]
    texts += [t.upper() for t in texts[:6]]  # equal once lower-cased
    for t in texts[6:12]:  # near copies
        words = t.split()
        words[0] = "changed"
        texts.append(" ".join(words))
    texts += [prose(BAD, rng.randrange(20, 200)) for _ in range(40)] + [None, "", prose(GOOD, 4000)]
    return [(i, t, ["s1", "s2", None][i % 3]) for i, t in enumerate(texts)]


def low(text):
    return (text or "").encode().translate(LOWER)


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", low(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 72), 0) for i in range(0, len(rows) - 3, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    batches(spark)
    docs, frames = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        frames.append((name, docs, materialise(stage(spark, docs, str(tmp_path)), "test")))
        docs = frames[-1][2]
    kept = {name: (before.collect(), after.collect()) for name, before, after in frames}
    assert all(after.columns == ["doc_id", "text", "source"] for _, _, after in frames[:-1])

    _, after = kept["quality_classifier"]
    ranks = quality.resample(frames[0][1], spark.read.parquet(str(tmp_path / "labels.parquet"))).filter("kept").collect()
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in ranks} and 0 < len(after) < len(rows)

    before, after = kept["exact_dedup"]
    best = {}
    for r in before:
        best[low(r["text"])] = max(best.get(low(r["text"]), -1), r["doc_id"])
    assert {r["doc_id"] for r in after} == set(best.values())

    before, after = kept["ngram_jaccard_join"]
    sets, comp = {r["doc_id"]: shingles(r["text"]) for r in before}, {r["doc_id"]: r["doc_id"] for r in before}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                old, new = sorted((comp[a], comp[b]), reverse=True)
                comp = {k: new if v == old else v for k, v in comp.items()}
    assert {r["doc_id"] for r in after} == set(comp.values())

    before, after = kept["mixing"]
    size = {r["doc_id"]: len(re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode())) for r in before}
    times, source = Counter(r["doc_id"] for r in after), {r["doc_id"]: r["source"] for r in before}
    assert set(times) <= set(size) and max(times.values()) <= 2
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    whole = {s: sum(n for i, n in size.items() if source[i] == s) for s in names}
    target, free, left = {}, dict(zip(names, (5, 2, 1), strict=False)), 1.5 * sum(whole.values())
    while free:
        over = [s for s in free if left * free[s] / sum(free.values()) > 2 * whole[s]]
        if not over:
            target |= {s: left * w / sum(free.values()) for s, w in free.items()}
            break
        for s in over:
            target[s] = 2.0 * whole[s]
        left -= sum(target[s] for s in over)
        free = {s: w for s, w in free.items() if s not in over}
    for s in names:
        taken = sum(size[i] * n for i, n in times.items() if source[i] == s)
        assert abs(taken - target[s]) <= max(size[i] for i in size if source[i] == s)

    before, after = kept["best_fit_packing"]
    vocabulary = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] or "" for r in before}
    tokens = Counter({i: 0 for i in times})
    for r in after:
        tokens[r["doc_id"]] += r["length"]
    by_sequence = {}
    for r in after:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by_sequence) <= 1.2 * sum(tokens.values()) / 2048 + 2
    assert all(tokens[i] == n * (len(vocabulary.encode(text[i], add_special_tokens=False).ids) + 1) for i, n in times.items())


def run_all(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, source string, row int, comp string, _key int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_empty_tables(spark, tmp_path):
    assert run_all(spark, tmp_path, [], []) == []


def test_odd_rows_go_through(spark, tmp_path):
    """Without labels, with repeated and null identifiers, equal rows, a null source, and columns with the stages' own names."""
    rng = random.Random(14)
    text = lambda n: " ".join(rng.choice(GOOD) for _ in range(n))
    rows = [(i, text(60), "s1", i, "c", i) for i in range(10)] + [(3, text(50), None, 90, "c", 1), (None, text(40), "s1", 91, None, None), (None, text(30), "s2", 92, "c", 2)]
    rows += [rows[0], (20, rows[1][1].upper(), "s1", 93, "c", 3), (21, None, "s2", 94, "c", 4)]
    got = run_all(spark, tmp_path, rows, [])
    held = Counter()
    for r in got:
        held[r["doc_id"]] += r["length"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {}
    for i, t, *_ in rows:
        sizes.setdefault(i, []).append(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1)
    assert set(held) <= set(sizes) and all(n <= 2 * sum(sizes[i]) for i, n in held.items()) and 1 not in held  # row 1 is a copy of 20
    ends = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
