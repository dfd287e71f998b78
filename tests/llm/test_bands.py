"""Compression bands against plain loops."""

import base64
import collections
import os
import random
import re

import pytest
import zstandard

from tagframe.llm import bands
from tagframe.llm.queries import op11_compression_bands

SCHEMA = "doc_id long, text string, kept string, verdict int, ratio string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered, seen, again = set(), set(), 0
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    data = text.encode()

    def side(part):
        ratio = len(part) / len(zstandard.ZstdCompressor(level=3).compress(part)) if part else 0.0
        band = [b for b in bands.BANDS if b.size <= len(part)][-1]
        return ratio, "noise" if ratio < band.least else "repetitive" if ratio > band.most else ""

    ratio, out = side(data)
    chunks = [data[i : i + 4096] for i in range(0, len(data), 4096)]
    bad = sum(len(c) for c in chunks if side(c)[1])
    verdict = "base" if failed else out or ("chunks" if bad > 0.25 * len(data) else "kept")
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered), failed, verdict == "kept", len(data), ratio, len(chunks), bad, verdict


def prose(seed, n):
    r = random.Random(seed)
    vowels, rest = "aeiou", "bcdfghklmnprstvw"
    words = ["".join(r.choice(rest) + r.choice(vowels) for _ in range(r.randint(1, 4))) for _ in range(900)]
    return " ".join(r.choice(words) + ("." if r.random() < 0.08 else "") for _ in range(n))


TEXTS = [
    (1, prose(1, 300)), (2, prose(2, 40) + "\n" + prose(2, 40)), (3, None), (4, ""), (5, " \t\n\x0b "), (6, "word"), (7, "a b " * 400), (8, prose(3, 9000)), (9, prose(4, 2500) + " x" * 9000), (10, base64.b64encode(os.urandom(9000)).decode()), (10, prose(5, 30)),
    (None, prose(6, 100)), (11, " ".join(f"w{random.Random(i).getrandbits(60):x}" for i in range(400))), (12, "日本語 テキスト 🙂 é\r\n" * 30), (13, "line\nline\r\nline\n \n \nother\nline"), (14, "#*$%&|<> " * 3 + prose(7, 50)), (15, "x" * 200_000),
    (16, " ".join(f"n{i}" for i in range(8)) + " mid " + " ".join(f"n{i}" for i in range(8)) + " " + prose(8, 200)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in TEXTS], SCHEMA).repartition(3).cache()


def got(df):
    return sorted((tuple(r[c.split()[0]] for c in bands.SCHEMA.split(", ")) for r in df.collect()), key=str)


def test_measures(docs):
    assert got(bands.measure(docs)) == sorted(((i, *brute(t)) for i, t in TEXTS), key=str)


def test_noise_and_repetition_go_and_prose_stays(docs):
    kept = bands.drop_failed(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {1, 8, 14, 16} <= set(ids) and not set(ids) & {7, 9, 15} and ids.count(10) == 1
    verdicts = {r["doc_id"]: r["verdict"] for r in bands.measure(docs).where("doc_id in (8, 9, 11)").collect()}
    assert verdicts[8] == "kept" and verdicts[9] in ("base", "repetitive", "chunks")


def test_a_repetitive_part_of_a_long_text_is_found():
    plain, ratios = prose(9, 20_000), bands.Ratios()
    assert ratios.of(plain.encode())[3] == "kept"
    blocks = [prose(10, 30) for _ in range(12)]
    part = " ".join(b for b in blocks for _ in range(40))
    assert ratios.of((plain[: len(part)] + part).encode())[3] != "kept"


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bands.measure(none).count() == 0 and bands.drop_failed(none).count() == 0


def test_bands_must_rise(docs):
    with pytest.raises(ValueError):
        bands.measure(docs, bands=(bands.Band(10, 0, 1),))


def test_query_matches_loops(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got(op11_compression_bands(spark, sf)) == sorted(((r["doc_id"], *brute(r["text"])) for r in rows), key=str)
