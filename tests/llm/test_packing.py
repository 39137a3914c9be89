import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from labelspark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPLITTER = Tokenizer.from_file(PATH).pre_tokenizer


def check(pieces, texts):
    """Every id in exactly one piece, sequences gapless and of a power of two."""
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for doc_id, text in texts:
        want[doc_id].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])
    got = defaultdict(list)
    sequences = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p.length > 0
        got[p.doc_id].append((p.start, ids, p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length, p.tier))
    assert set(got) == set(want)
    for doc_id, parts in got.items():
        if len(want[doc_id]) == 1:
            parts = sorted(parts)
            assert [i for _, ids, _ in parts for i in ids] == want[doc_id][0]
            assert all(n == len(want[doc_id][0]) for *_, n in parts)
            assert [s for s, *_ in parts] == np.cumsum([0, *[len(ids) for _, ids, _ in parts]])[:-1].tolist()
        else:  # repeated ids: the same pieces as often
            assert sum(len(ids) for _, ids, _ in parts) == sum(map(len, want[doc_id]))
    for parts in sequences.values():
        parts.sort()
        total = sum(n for _, n, _ in parts)
        assert [o for o, *_ in parts] == np.cumsum([0, *[n for _, n, _ in parts]])[:-1].tolist()
        assert total & (total - 1) == 0 and total <= 1024
    return sequences


def test_edge_rows(edge_docs, edge_rows, no_docs):
    check(packing.pack(edge_docs, PATH).collect(), [(r[0], r[1]) for r in edge_rows])
    assert packing.pack(no_docs, PATH).count() == 0


def test_whole_table(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.pack(docs, PATH).collect()
    sequences = check(pieces, [(r.doc_id, r.text) for r in docs.collect()])
    full = sum(sum(n for _, n, _ in p) == p[0][2] for p in sequences.values())
    assert full >= len(sequences) - 12  # all but the last few of the task fill their tier
    groups = defaultdict(lambda: [0, set()])
    for p in pieces:
        groups[p.step_group][0] += p.length
        groups[p.step_group][1].add(p.tier)
    assert all(n <= packing.GROUP_TOKENS and len(tiers) == 1 for n, tiers in groups.values())


def test_encoder_forgets_and_agrees(spark, monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 50)
    encoder = packing.Encoder(PATH)
    tokenizer = Tokenizer.from_file(PATH)
    texts = ["it's  we'll\n\n x_y__z !!! 12ab  ", "don't\tstop", "ÀÉ ñandú ×÷", "a\x1cb c", "", " ", "<|endoftext|>", "½²", "mixed ½ and plain",
             *[f"word{i} and more{i}'s" for i in range(200)]]
    for _ in range(2):
        for at in range(0, len(texts), 20):
            got = encoder.encode(texts[at : at + 20])
            assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[at : at + 20]]


@given(st.text(st.sampled_from("' stmdrevlaZé9_.,\n\t \r\"-"), max_size=40))
@settings(max_examples=400, deadline=None)
def test_parts_are_those_of_the_vocabulary(text):
    raw = text.encode()
    found = packing.part_starts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).tolist()
    assert [raw[a:b].decode() for a, b in zip(found, [*found[1:], len(raw)])] == [text[a:b] for _, (a, b) in SPLITTER.pre_tokenize_str(text)]


def test_parts_of_several_texts():
    texts = [b"it's", b"", b" a", b"b \n", b" ", b"'t", b"x'", b"s  y"]
    where = np.cumsum([0, *map(len, texts)])
    found = packing.part_starts(np.frombuffer(b"".join(texts), np.uint8), where).tolist()
    want = []
    for text, at in zip(texts, where):
        want += [at + i for i in packing.part_starts(np.frombuffer(text, np.uint8), np.array([0, len(text)])).tolist()]
    assert found == want


def test_rests_beyond_half_a_window_do_not_pile_up():
    packer, windows = packing.Packer((4, 8, 16), 10), []
    for i in range(200):
        packer.add(i, 0, 9 + i % 7)
        if len(packer.rests) >= 10:
            windows += packer.pack()
            assert len(packer.rests) <= 5
    assert all(sum(r[0] for r in w) == 16 for w in windows)
    windows += packer.pack(last=True)
    assert sum(r[0] for w in windows for r in w) == sum(9 + i % 7 for i in range(200))


def test_packer_fills_gaps_and_cuts():
    packer = packing.Packer((4, 8, 16), 10)
    for i, n in enumerate([15, 9, 7, 5, 3, 3, 2, 1, 1]):
        packer.add(i, 0, n)
    windows = [*packer.pack(), *packer.pack(last=True)]
    assert sum(r[0] for w in windows for r in w) == 46
    assert all((t := sum(r[0] for r in w)) & (t - 1) == 0 for w in windows)
    assert zlib.crc32(b"") == 0
