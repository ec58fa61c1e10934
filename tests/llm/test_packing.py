import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from casefuse.llm import packing
from casefuse.llm.queries import QUERIES
from tests.llm.common import awkward, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, window=4096, slack=0.02, plain_specials=False):
    """Pieces against a plain encoding of whole texts; rows of one document share a doc_id."""
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = plain_specials
    want = {}
    for i, text in texts.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want[i] = ids
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = want[i][r.start:r.start + r.length]
            assert r.start == at and r.doc_tokens == len(want[i])
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(want[i])
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    total = sum(map(len, want.values()))
    assert len(by_sequence) <= total / window * (1 + slack) + 1


def test_query_equals_plain_encoding(spark, sf):
    docs = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    check(QUERIES["op9_packing_best_fit"](spark, sf).collect(), docs)


def test_awkward_texts(spark):
    texts = [t for _, t, _ in awkward()] + [
        "I'LL don't 's", "<|endoftext|> x<|startoftext|>", "the end <|endoftext|> of it x<|endoftext|>y.",
        "Word. WORD, wörd; ÉTÉ!? a...b c.'d can't. 's. ÿ: ŭ. ªº! ß. x.y, İ. ΣΑΣ. e\u0301. \u0301. n\u0303, 5. 5a. a5.", "a b c\x1cd", "İ ΣΑΣ ﬁ é",
        "x" * 30000, "１２ ½ ²"]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    check(packing.pack(docs, PATH).collect(), dict(enumerate(texts)))
    plain = packing.pack(docs, PATH, plain_specials=True).collect()
    check(plain, dict(enumerate(texts)), plain_specials=True)
    assert packing.pack(documents(spark, []), PATH).count() == 0
    twice = packing.pack(documents(spark, [(None, "one two", "s")] * 2), PATH).collect()
    assert [(r.doc_id, r.start) for r in twice] == [(None, 0)] * 2
    assert sorted(r.offset for r in twice) == [0, twice[0].length]


def test_windows_hold_the_ids(spark):
    docs = documents(spark, [(i, f"word{i} and {'more ' * (i * 7 % 300)}", "s") for i in range(60)])
    packed = packing.pack(docs, PATH, window=256, keep_ids=True)
    rows = packed.collect()
    for s in packing.sequences(packed, 256, 7).collect():
        ids = [x for r in sorted((r for r in rows if r.sequence_id == s.sequence_id),
                                 key=lambda r: r.offset) for x in r.ids]
        assert s.ids == ids + [7] * (256 - len(ids)) and s.n_tokens == len(ids)


def test_best_fit_equals_search_of_all_windows():
    rng = np.random.default_rng(0)
    for window in (10, 64, 100):
        lengths = np.sort(rng.integers(1, window + 1, 400))[::-1]
        free, want = [], []
        for need in lengths.tolist():
            fits = [f for f in free if f >= need]
            room = min(fits) if fits else window
            if fits:
                free.remove(room)
            want.append(window - room)
            if room > need:
                free.append(room - need)
        at, offset = packing.best_fit(lengths, window)
        assert offset.tolist() == want
        assert np.bincount(at, lengths).max() <= window


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 5)
    memory = packing.WordMemory(PATH)
    texts = [f"a{i} b{i} common".encode() for i in range(30)]
    assert [memory.encode([t])[0] for t in texts] == packing.WordMemory(PATH).encode(texts)
    assert len(memory.new) + len(memory.old) <= 20


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_are_tokenised_many_in_a_text_and_marks_once():
    rnd = np.random.default_rng(1)
    words = ["".join(rnd.choice(list("aeiounstrlÉÿß"), 7)) for _ in range(2000)]
    texts = [" ".join(w + m for w in words[i::40]).encode() for i, m in enumerate(["", ".", ",***", "$$$", "&&&"] * 8)]
    memory, plain = packing.WordMemory(PATH), Tokenizer.from_file(PATH)
    memory.tokenizer = Counting(memory.tokenizer)
    want = [np.array(plain.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert memory.encode(texts) == want
    assert memory.tokenizer.texts < len(words) / 20
    unmarked = packing.WordMemory(PATH)
    unmarked.ends[:] = False
    assert unmarked.encode(texts) == want


def test_remembered_words_take_few_bytes():
    rnd = np.random.default_rng(2)
    texts = [" ".join(map("".join, rnd.choice(list("aeiounstrl"), (20000, 7)))).encode() for _ in range(4)]
    memory = packing.WordMemory(PATH)
    memory.encode([b"some first text"])
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    for t in texts:
        memory.encode([t])
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    words = len(memory.new) + len(memory.old)
    assert words > 75000 and held < 64 * words


def test_runs_hold_all_texts_in_turn():
    texts = pa.array(["abc", None, "", "x" * 50, None, "de", "f" * 9, "gh"] * 3)
    runs = list(packing._some(texts[1:], 10))
    assert len(runs) > 6 and pa.concat_arrays(runs).equals(texts[1:])
    assert list(packing._some(texts[:0], 10)) == []
    memory = packing.WordMemory(PATH)
    plain = memory.encode([(t or "").encode() for t in texts.to_pylist()[1:]])
    assert [ids for run in runs for ids in memory.encode(run)] == plain
