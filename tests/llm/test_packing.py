import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm import common, packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def classes_well(n, capacity, padding):
    return capacity % n <= padding * capacity


@given(st.integers(1, 60_000))
@settings(deadline=None)
def test_pieces_add_up(n):
    got = packing.cut(n)
    assert sum(got) == n and all(0 < x <= 4096 and classes_well(x, 4096, packing.PADDING) for x in got)
    assert len(got) <= n // 4096 + 3


def test_rests_are_the_fewest_pieces():
    good = [n for n in range(1, 97) if classes_well(n, 96, 1 / 16)]
    fewest = {0: 0}
    for n in range(1, 97):
        fewest[n] = 1 + min(fewest[n - g] for g in good if g <= n)
    got = packing.rests(96, 1 / 16)
    assert [len(x) for x in got] == [fewest[n] for n in range(97)]
    assert all(sum(x) == n and set(x) <= set(good) for n, x in enumerate(got))


def test_memory_keeps_what_is_common(monkeypatch):
    monkeypatch.setattr(common, "REMEMBERED", 4)
    memory, asked = common.Memory(), []

    def work(words):
        asked.extend(words)
        return [w.encode() for w in words]

    for i in range(20):
        words = ["the", "of", f"w{i}", f"v{i}"]
        assert memory.all(words, work) == [w.encode() for w in words]
        assert len(memory.young) + len(memory.old) <= 16
    assert asked.count("the") == asked.count("of") == 1 and len(asked) == 42


def test_ids_are_the_tokenizers():
    odd = ["It's we're o'clock ΣΑΣ", "½ cup² Ⅷ", "a\x1cb c\x1dd", "hi<|endoftext|>there <| x", "éa İstanbul ŒUVRE ß", "日本語 12 345", "__a__ ''", "", "   ", None, " a\u0085b　c", "!!\n\t x--y", "\U0001f642 text", " lead  and trail ", "é café"]
    for texts in (odd, odd[4:9], [None], []):
        got = list(packing.WordIds("word_bpe_49k.json").batches(pa.array(texts, pa.string())))
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [TOKENIZER.encode(t or "", add_special_tokens=False).ids for t in texts]


def checked(rows, texts):
    """Every piece is where it says, each id in one piece, sequences gapless; returns the share of padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in texts.items():
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding / max(1, sum(r.length for r in rows))


def test_packs_every_id_once(docs):
    rows = packing.pack(docs).collect()
    assert checked(rows, dict(docs.select("doc_id", "text").collect())) < 0.03


def test_classes_have_a_fixed_count(docs):
    by = defaultdict(list)
    for r in packing.pack(docs).collect():
        by[r.sequence_id].append(r)
    for s, own in by.items():
        if s >> 44:
            assert len(own) == s >> 44 and {4096 // r.length for r in own} == {s >> 44}


def test_odd_rows(odd, empty):
    rows = packing.pack(odd).collect()
    texts = {r.doc_id: r.text for r in odd.where("doc_id not in (5)").collect()}
    assert checked(rows, {}) < 0.05
    for i, t in texts.items():
        if i is not None:
            assert sum(r.length for r in rows if r.doc_id == i) == len(TOKENIZER.encode(t or "", add_special_tokens=False).ids) + 1
    assert packing.pack(empty).count() == 0
