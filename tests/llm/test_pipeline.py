"""The pipeline on a small corpus with planted rows, each stage against plain Python."""

from __future__ import annotations

import collections
import itertools
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tagframe.llm import tokens

WORDS = [f"{a}{b}{c}" for a, b, c in itertools.product("bdkm", "aeio", "lnrst")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, _sha string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus():
    texts, toxic = {}, set()
    for i in range(500):
        words = prose(i, 40 + i % 60).split()
        if i % 5 == 0:
            toxic.add(i)
            for k in range(6):
                words[k * 5] = random.Random(i * 7 + k).choice(["rubbish", "dolt", "worthless"])
        texts[i] = " ".join(words)
    base, passage = prose(1001, 120), prose(1002, 50)
    for k in range(30):
        texts[600 + k] = base
    for k in range(20):
        texts[700 + k] = " ".join(base.split()[:-2] + [f"near{k}", "end"])
    for k in range(10):
        texts[800 + k] = f"{prose(2000 + k, 60)} {passage} {prose(3000 + k, 50)}"
    texts |= {900: None, 901: "", 902: "short one", 903: prose(4000, 5000)}
    return texts, toxic


@pytest.fixture(scope="module")
def folder_of(spark, tmp_path_factory):
    texts, toxic = corpus()
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t), "clash", f"own{i}") for i, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, int(i in toxic)) for i in range(450)], "doc_id long, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def exact(texts):
    best = {}
    for i, t in texts.items():
        best[t or ""] = max(best.get(t or "", -1), i)
    return {i: texts[i] for i in best.values()}


def near(texts):
    def shingles(t):
        w = (t or "").split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, top = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: t for i, t in texts.items() if find(i) == i}


def repeats(texts):
    starts = collections.Counter(t[k : k + 200] for t in texts.values() if t for k in range(len(t) - 199))
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t or ""))
        for k in range(len(t or "") - 199):
            if starts[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        out[i] = t if t is None else "".join(c for c, g in zip(t, gone, strict=True) if not g)
    return out


def test_stages_equal_plain_loops(spark, folder_of):
    texts, toxic = corpus()
    docs = spark.read.parquet(f"{folder_of}/documents.parquet")
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder_of), name)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        rows = docs.collect()
        assert len({r["doc_id"] for r in rows}) == len(rows) and all((r["spans"], r["_sha"]) == ("clash", f"own{r['doc_id']}") for r in rows)
        got[name] = {r["doc_id"]: r["text"] for r in rows}
    assert set(texts) - set(got["toxicity"]) == toxic
    assert all(got["toxicity"][i] == texts[i] for i in got["toxicity"])
    assert got["exact_dedup"] == exact(got["toxicity"])
    assert got["near_dedup"] == near(got["exact_dedup"])
    assert got["suffix_dedup"] == repeats(got["near_dedup"])
    assert sum(len(got["near_dedup"][i] or "") - len(got["suffix_dedup"][i] or "") for i in got["near_dedup"]) > 1000

    packed = corpus_pipeline.run(spark, folder_of).collect()
    encoder = tokens.word_tokenizer(tokens.file_of("word_bpe_49k.json")).tokenizer
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(got["suffix_dedup"])
    for i, t in got["suffix_dedup"].items():
        ids = np.array([*encoder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert sorted(pieces[i]) == [(k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r["length"] for r in packed) // 4096) + 1


def test_pipeline_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
