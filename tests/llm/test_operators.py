"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, no rows and clashing columns."""

import base64
import collections
import hashlib
import io
import random
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagframe.llm import exact_dedup, induced, lm_score, matroska, near_dedup, order, packing, pieces, suffix_dedup, tokens, toxicity, warc
from tagframe.llm.space import folder

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 50)) for _ in range(n))


BASE = prose(1, 120)
TEXTS = [
    (1, BASE), (2, BASE), (3, BASE.replace("alpha", "ALPHA")), (4, BASE.rsplit(" ", 3)[0] + " changed end here"), (5, None), (6, ""), (7, "   "), (8, "one two"), (9, "one two"), (10, prose(2, 3000)), (11, prose(3, 60) + " " + BASE[:400] + " " + prose(4, 30)),
    (12, "x" * 5000), (13, "日本語 текст 🙂 é"), (14, prose(5, 200)), (14, prose(5, 200)), (None, prose(6, 20)), (None, BASE),
]
SCHEMA = "doc_id long, text string, sha string, n int, _sha string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, none):
    rows = exact_dedup.exact_groups(docs).collect()
    groups = collections.defaultdict(list)
    for i, t in TEXTS:
        groups[t or ""].append(i)
    want = []
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want.append((i, best, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in rows)
    assert sum(r["kept"] for r in rows) == len(groups)
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_exact(none).count() == 0


def test_bloom_never_misses(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), (F.col("id") % 4000).cast("string")).alias("k"))
    bloom, bits = exact_dedup.bloom_filter(keys, "k", bits_per_row=2, least=2)
    again = keys.distinct().where(exact_dedup.maybe_in(F.col("k"), bloom.scalar(), bits))
    assert {f"k{i}" for i in range(1000)} <= {r[0] for r in again.collect()}


def shingle_set(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(texts, percent):
    sets, top = [shingle_set(t) for _, t in texts], list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            same = texts[a][0] is not None and texts[a][0] == texts[b][0]
            if texts[a][0] is not None and texts[b][0] is not None and (same or sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for a in range(len(texts)):
        groups[find(a)].append(texts[a][0])
    return [(i, len(s), None if i is None else min(x for x in groups[find(a)] if x is not None)) for a, ((i, _), s) in enumerate(zip(texts, sets, strict=True))]


def near_corpus():
    r, out = random.Random(9), []
    for g in range(6):
        base = prose(100 + g, 90).split()
        for _ in range(40 if g == 0 else 6):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"edit{r.randint(0, 40)}"
            out.append(" ".join(w))
    return list(enumerate(out))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_groups_equal_brute_force(spark, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    texts = near_corpus() + [(1000 + i if i is not None else None, t) for i, t in TEXTS]
    df = spark.createDataFrame([(i, t, b"clash") for i, t in texts], "doc_id long, text string, set_key binary")
    got = near_dedup.near_groups(df, percent).collect()
    assert sorted(map(str, brute_components(texts, percent))) == sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_empty(none):
    assert near_dedup.near_groups(none).count() == 0 and near_dedup.drop_near(none).columns == none.columns


def test_least_matches():
    assert near_dedup.least_matches(64, 0.85, 1e-6) < 54 and near_dedup.least_matches(64, 0.5, 1e-6) >= 1


def test_suffix_array_and_prefixes():
    r = random.Random(5)
    for _ in range(300):
        b = bytes(r.randint(1, r.choice([1, 2, 5])) for _ in range(r.randint(0, 50))) + b"\0"
        t = np.frombuffer(b, np.uint8)
        sa = induced.suffix_array(t)
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert sa.tolist() == want
        before, share = induced.common_prefixes(t, sa)
        for a, i in zip(want, want[1:], strict=False):
            n = 0
            while max(a, i) + n < len(b) and b[a + n] == b[i + n]:
                n += 1
            assert (before[i], share[i]) == (a, n)


def brute_repeats(texts, length):
    starts = collections.Counter(d[i : i + length] for d in texts for i in range(len(d) - length + 1))
    out = []
    for d in texts:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if starts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(g and not p for g, p in zip(gone, [0, *gone], strict=False)), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeats_equal_brute_force(docs, hot):
    data = [(t or "").encode() for _, t in TEXTS]
    got = suffix_dedup.repeats(docs, shard_bytes=2000, hot=hot).collect()
    want = [(i, *x) for (i, _), x in zip(TEXTS, brute_repeats(data, 200), strict=True)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_drop_repeats_keeps_rows_and_characters(docs, none):
    out = suffix_dedup.drop_repeats(docs, chars_col=None)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r["doc_id"]: r["text"] for r in out.where("doc_id = 13").collect()}[13] == "日本語 текст 🙂 é"
    assert suffix_dedup.repeats(none).count() == 0


def test_packing_plan_places_everything_once():
    r = random.Random(2)
    for _ in range(200):
        cap = r.choice([5, 20, 60])
        counts = collections.Counter(r.randint(1, cap) for _ in range(r.randint(0, 150)))
        per, seqs = collections.defaultdict(list), collections.defaultdict(list)
        for x in packing.plan(counts, cap):
            per[x.length].append((x.first, x.count))
            for k in range(x.count):
                seqs[x.sequence + k].append((x.offset, x.length))
        assert {k: sum(c for _, c in v) for k, v in per.items()} == dict(counts)
        for v in seqs.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= cap


def test_reduction_fixes_exact_pairs_and_lone_items():
    p = packing._Plan({10: 1, 9: 2, 6: 1, 4: 1, 5: 1}, 10)
    p.reduce()
    assert p.sequences >= 5 and p.left.sum() == 0


def test_pack_rows(docs, none):
    rows = packing.pack(docs, capacity=256, keep_ids=True).collect()
    t = tokens.word_tokenizer(tokens.file_of("word_bpe_49k.json"))
    by, ids = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        ids[r["doc_id"]].append((r["piece"], r["start"], r["ids"]))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 256
    text = dict(TEXTS)[10]
    assert np.frombuffer(b"".join(x[2] for x in sorted(ids[10])), "<u4").tolist() == [*t.tokenizer.encode(text, add_special_tokens=False).ids, 1]
    assert sum(r["length"] for r in rows) == sum(len(x) + 1 for x in t.encode_batch([t for _, t in TEXTS]))
    assert packing.pack(none).count() == 0


def test_word_tokenizer_is_the_tokenizer():
    t = tokens.WordTokenizer(tokens.file_of("word_bpe_49k.json"), max_words=30, keep_words=10)
    texts = ["", None, "Ünï code　x", "a\x1cb c", "é ́x ΑΣ ΑΣ.", "it's they'll 123 <|endoftext|> x​y", "İstanbul STRASSE, ẞ! ok. ok.. (ok)", prose(8, 80)]
    for _ in range(2):
        for text, got in zip(texts, t.encode_batch(texts), strict=True):
            assert got.tolist() == t.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_training_order(docs, none):
    manifest = order.write_shards(docs, folder(docs.sparkSession, "t"), length_max=64, shard_bytes=4000).cache()
    rows = order.read_order(manifest).collect()
    assert manifest.count() > 1 and sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert sum(r["length"] for r in rows) == sum(len(x) + 1 for x in tokens.word_tokenizer(tokens.file_of("word_bpe_49k.json")).encode_batch([t for _, t in TEXTS]))
    part = order.read_order(manifest, 5, 17).collect()
    assert sorted(part) == sorted(r for r in rows if 5 <= r["slot"] < 17)
    assert order.read_order(order.write_shards(none, folder(none.sparkSession, "t"))).count() == 0


def test_feistel_is_a_bijection():
    for n in (1, 2, 3, 10, 1000):
        assert sorted(order.permute(np.arange(n), n, 7).tolist()) == list(range(n))
    assert order.permute(np.arange(50), 50, 1).tolist() != order.permute(np.arange(50), 50, 2).tolist()


def test_matroska(docs, none):
    rows = matroska.describe(matroska.mux(docs)).collect()
    want = sorted((len((t or "").encode()), hashlib.sha256(matroska.padded((t or "").encode())).hexdigest()) for _, t in TEXTS)
    assert want == sorted((r["n_bytes"], r["payload_sha256"]) for r in rows)
    assert all(r["payload_bytes"] % 64 == 0 and r["payload_bytes"] > 0 for r in rows)
    packets = matroska.packet_table(matroska.mux(docs)).where("doc_id = 10").orderBy("packet").collect()
    media = matroska.mux_bytes(matroska.padded(dict(TEXTS)[10].encode()))
    assert b"".join(media[p["byte_offset"] : p["byte_offset"] + p["byte_size"]] for p in packets) == matroska.padded(dict(TEXTS)[10].encode())
    assert matroska.describe(matroska.mux(none)).count() == 0


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_lacing(lacing):
    r = random.Random(lacing)
    for n in (64, 1024, 1088, 8192, 40_000 * 4):
        data = r.randbytes(n)
        file = matroska.mux_bytes(data, lacing)
        media = matroska.parse(file)
        assert matroska.payload_of(file, media) == data
        assert [c[0] for c in media.clusters] == [c[2] for c in media.cues]
    with pytest.raises(ValueError, match="cut off"):
        matroska.parse(file[:-5])
    with pytest.raises(ValueError, match="not a Matroska"):
        matroska.parse(b"")


def test_block_groups_and_unknown_sizes():
    cluster = matroska._uint(matroska.TIMESTAMP, 5) + matroska._element(matroska.BLOCK_GROUP, matroska._element(matroska.BLOCK, b"\x81\x00\x01\x00abc") + matroska._uint(matroska.REFERENCE_BLOCK, 1))
    file = matroska._HEAD + matroska._id(matroska.SEGMENT) + b"\xff" + 2 * (matroska._id(matroska.CLUSTER) + b"\xff" + cluster)
    assert [(p.timestamp, file[p.offset : p.offset + p.size], p.keyframe) for p in matroska.parse(file).packets] == [(6, b"abc", False)] * 2


PAGES = [(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, None, None), (4, "u4", ""), (None, "u5", "<p>a</p>"), (2, "u2", "<p>a</p>"), (7, "u 7", "é" * 30_000)]


@pytest.mark.parametrize("zip64", [False, True])
def test_warc_round_trip(spark, zip64):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, package string")
    packages = warc.write_packages(df, folder(spark, "w"), roll_bytes=1000, zip64=zip64)
    rows = warc.resolve(warc.read_records(warc.record_index(packages))).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"<p>a</p>": 1, "": 3, PAGES[-1][2]: 7}
    want = [(i, len((h or "").encode()), digest(h), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in PAGES]
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in rows)


def test_warc_small_payloads_and_empty(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert {r["record_type"] for r in warc.round_trip(df.where("page_id < 7"), min_revisit_bytes=100).collect()} == {"response"}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_zip_directory_and_unindexed_members():
    records = [(warc.record_bytes("response", str(i), "u", b"x" * i, warc.base32_sha1(b"x" * i), None), str(i)) for i in range(5)]
    for zip64 in (False, True):
        raw = warc.package(records, zip64)
        f = io.BytesIO(raw)
        members = warc.central_directory(f, len(raw))
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            assert [m.name for m in members] == z.namelist()
            assert all(warc.member_bytes(f, m) == z.read(m.name) for m in members)
        data = next(m for m in members if m.name.startswith("archive/"))
        assert len(list(warc._walk(f, warc.data_start(f, data), data.packed))) == 5


def test_pieces_are_the_best_segmentation():
    from sentencepiece import sentencepiece_model_pb2

    p, model = pieces.Pieces(tokens.file_of("piece_bpe_32k.model")), sentencepiece_model_pb2.ModelProto()
    with open(tokens.file_of("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    known = {x.piece: (i, x.score) for i, x in enumerate(model.pieces) if x.type in (1, 4)}
    r = random.Random(3)
    for _ in range(500):
        t = "".join(r.choice("▁▁theinranster.,éß日\n\t0") for _ in range(r.randint(0, 25)))
        best = [(0.0, [])]
        for e in range(1, len(t) + 1):
            found = [(best[s][0] + known[t[s:e]][1], best[s][1] + [known[t[s:e]][0]]) for s in range(e) if t[s:e] in known]
            found += [] if t[e - 1] in known else [(best[e - 1][0] + p.unknown_score, best[e - 1][1] + [p.byte_ids[x] for x in t[e - 1].encode()])]
            best.append(max(found, key=lambda x: x[0]))
        assert p.segment(t) == best[-1][::-1]


def test_pieces_round_trip(docs, none):
    rows = pieces.decode(pieces.encode(docs)).collect()
    assert sorted((t or "") for _, t in TEXTS) == sorted(r["text"] for r in rows)
    assert pieces.decode(pieces.encode(none)).count() == 0


def labelled(spark):
    r, rows, labels = random.Random(4), [], []
    for i in range(900):
        words = prose(i, r.randint(20, 60)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["rubbish", "ru88ish", "dolt", "d0lt"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (2000, None)], "doc_id long, toxic int")


def test_toxicity(spark, docs, none):
    df, labels = labelled(spark)
    model = toxicity.fit(df, labels, keep=toxicity.fold_of() != 0)
    held = toxicity.score(df, model).where(toxicity.fold_of() == 0).join(labels, "doc_id").collect()
    assert sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in held) >= 0.97 * len(held)
    assert toxicity.drop_toxic(df, model).count() in range(700, 735)
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(none, model).count() == 0


def test_exceptions_and_folding():
    m = toxicity.Model({" bad ": 2.0}, [toxicity.fold("not bad")], [0.0] * 5)
    a = toxicity.automaton(m)
    assert toxicity.hits(a, toxicity.fold("so b4d")) == [2.0]
    assert toxicity.hits(a, toxicity.fold("not bad")) == []
    assert toxicity.hits(a, toxicity.fold("Bаd!")) == [2.0]  # a Cyrillic letter
    assert not toxicity.fold(None).strip()


def test_lm_base_scores_equal_brute_force(spark, none):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(WORDS[:10] if i % 2 else WORDS[10:]) for _ in range(40)) + (" rare%d" % i if i % 7 == 0 else "")) for i in range(200)] + [(900, None), (901, ""), (902, "Alpha ALPHA unseen")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, row string").repartition(3)
    got = {x["doc_id"]: x for x in lm_score.score(df, frequent=16, rows=1 << 10).collect()}
    tokens_of = {i: [*(t or "").encode().lower().split(), b" end"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens_of}
    c = collections.Counter(w for i, ws in tokens_of.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens_of.items():
        base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        x = got[i]
        assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(x["base_score"] - base) < 1e-6
    out = [x for x in got.values() if x["held_out"] and x["n_tokens"] > 20]
    assert sum(x["score"] for x in out) > sum(x["base_score"] for x in out)
    assert lm_score.score(none).count() == 0
