"""What a worker costs besides its results."""

import io
import os
import subprocess
import sys

import numpy as np
import pyarrow as pa

from tagframe.llm import induced, suffix_dedup, tokens

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ENCODE = """
import os
import pyarrow as pa
from tagframe.llm.tokens import file_of, word_tokenizer
texts = pa.array([" ".join(f"w{chr(97 + i % 26)}{chr(97 + j % 26)}x 1{i}{j}" for j in range(200)) for i in range(50)])
encoder = word_tokenizer(file_of("word_bpe_49k.json"))
before = len(os.listdir("/proc/self/task"))
encoder.encode_flat(texts)
print(len(os.listdir("/proc/self/task")) - before)
"""


def test_tokenizer_starts_no_threads():
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"} | {"PYTHONPATH": ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")}
    out = subprocess.run([sys.executable, "-c", ENCODE], env=env, capture_output=True, text=True, timeout=100)
    assert out.stdout.split()[-1] == "0", out.stderr


def test_inducing_one_by_one_equals_inducing_by_blocks():
    r = np.random.default_rng(3)
    for k in range(60):
        base = r.integers(1, int(r.integers(2, 200)), int(r.integers(1, 300)))
        t = np.append(np.tile(base, 3) if k % 3 == 0 else base, 0).astype(np.int64)
        small = induced._types(t)
        starts, size = induced._starts(small), np.bincount(t)
        order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        ordered = np.array([i for i in order if i in set(starts.tolist())], np.int64)
        for induce in (induced._induce, induced._induce_each):
            assert induce(t, small, ordered, size).tolist() == order


def test_second_reading_encodes_no_word_of_the_first_again(monkeypatch):
    encoder = tokens.WordTokenizer(tokens.file_of("word_bpe_49k.json"), max_words=60, keep_words=10)
    encoder.count(pa.array([" ".join(f"früher{i}" for i in range(45))]))  # an earlier task of this worker
    task = [pa.array([" ".join(f"x{i}y," for i in range(a, a + 25))]) for a in (0, 20)]
    encoder.forget()
    counts = [encoder.count(t).tolist() for t in task]
    sink = io.BytesIO()
    encoder.save(sink)
    for again in (task[::-1], [*task, pa.array(["and more"])]):  # in another order words are encoded again
        encoder.load(io.BytesIO(sink.getvalue()))
        for t in again:
            assert encoder.encode_flat(t)[0].tolist() == encoder.encode_whole(t[0].as_py())
    encoder.load(io.BytesIO(sink.getvalue()))
    monkeypatch.setattr(encoder, "_encode_new", None)
    for t, n in zip(task, counts, strict=True):
        flat, sizes = encoder.encode_flat(t)
        assert sizes.tolist() == n
        assert flat.tolist() == encoder.encode_whole(t[0].as_py())


def test_words_of_one_hash_and_signs_after_letters(monkeypatch):
    texts = ["İ. İ?, É$$$ é. क़! don't's ß###, x-- y_'_ \x1ca b ǅ; ς!?", "É$$$ é. nié&&& ß"]
    whole = tokens.WordTokenizer(tokens.file_of("word_bpe_49k.json")).encode_whole
    for same in (False, True):
        if same:
            monkeypatch.setattr(tokens, "hashes", lambda words: np.zeros(len(words), np.uint64))
        encoder = tokens.WordTokenizer(tokens.file_of("word_bpe_49k.json"))
        for _ in range(2):
            assert [g.tolist() for g in encoder.encode_batch(texts)] == [whole(t) for t in texts]


def test_names_are_induced_once_a_level(monkeypatch):
    r, met, each = np.random.default_rng(5), [], induced._induce_each
    monkeypatch.setattr(induced, "_induce_each", lambda t, *rest: met.append(len(t)) or each(t, *rest))
    part = r.integers(1, 2000, 900)
    for base in (part, np.tile(part, 3), np.concatenate([np.sort(part)] * 3 + [np.sort(part)[::-1]] * 2)):
        met.clear()
        t = np.append(base, 0)
        assert induced.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert met and len(met) == len(set(met))


def test_anchors_of_texts_together_equal_those_of_each(monkeypatch):
    r = np.random.default_rng(6)
    texts = [bytes(r.integers(97, 97 + int(r.integers(1, 4)), int(r.integers(0, 90))).astype(np.uint8)) for _ in range(200)] + [b"", b"ab" * 10, b"x" * 19, b"y" * 500]
    want = sorted((i, *map(int, row)) for i, text in enumerate(texts) for found in suffix_dedup.anchors(np.frombuffer(text, np.uint8), 20, 10) for row in zip(*found, strict=True))
    owners, calls = suffix_dedup._owners, []
    monkeypatch.setattr(suffix_dedup, "_owners", lambda *a: calls.append(1) or owners(*a))
    for together in (1, 100, 1000, 1 << 15):
        calls.clear()
        monkeypatch.setattr(suffix_dedup, "_TOGETHER", together)
        assert sorted(tuple(map(int, row)) for found in suffix_dedup.anchors_of(texts, 20, 10) for row in zip(*found, strict=True)) == want
    assert len(calls) == 1
